"""Relational operators: graphs, splits, quality checks, statistics, pairings."""
