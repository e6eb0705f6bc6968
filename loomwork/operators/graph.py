"""Undirected graphs as DataFrames: construction, neighbours and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.session import materialise


def build_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (a, b) with a < b; self-loops and rows with a null end are dropped."""
    return (
        pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b")
        .select("a", "b")
        .distinct()
    )


def contracted(edges: DataFrame) -> DataFrame:
    """edges(a, b) as fewer edges that join the same vertices: each Arrow batch becomes a star per component of its own.

    What partial aggregation is to a sum, this is to components: no shuffle, memory of one batch, and where the edges of
    a component lie near each other hardly any rounds are left for connected_components. Rows with a null end or
    equal ends are dropped; a vertex on no other edge is on none of the result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above: dict = {}

            def top(v):
                while (up := above.setdefault(v, v)) != v:
                    above[v] = above[up]
                    v = up
                return v

            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                low, high = sorted((top(a), top(b)))
                above[high] = low
            stars = [(top(v), v) for v in above]
            yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["a", "b"]).astype(dict(batch.dtypes))

    kinds = dict(edges.dtypes)
    return edges.where("a <> b").select("a", "b").mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}")


def build_vertices(singles: DataFrame, single: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct vertices: every single and both ends of every pair, self-pairs included."""
    ends = singles.select(F.col(single).alias("vertex"))
    for end in (a, b):
        ends = ends.unionByName(pairs.select(F.col(end).alias("vertex")))
    return ends.where("vertex IS NOT NULL").distinct()


def neighbors(edges: DataFrame) -> DataFrame:
    """(vertex, neighbors) with the neighbours sorted; vertices without edges are absent."""
    both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("a").alias("other"))
    )
    return both.groupBy("vertex").agg(F.array_sort(F.collect_set("other")).alias("neighbors"))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free hash of the edges, to tell whether a round changed them."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def _stars(sides: DataFrame, keep: Column) -> DataFrame:
    """From (u, v), link each v that passes keep to the least of u's neighbours and u itself."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = sides.where(keep).join(least, "u").select(F.col("v").alias("x"), "m")
    return linked.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(vertex, component) for every vertex on an edge of edges(a, b); component is the least vertex.

    Alternates the published large-star and small-star steps, each a grouped minimum and an equi-join,
    until the edges stop changing: O(log n) rounds in practice even on long chains. Each round is
    written to the shared folder, so that plans stay short and a lost executor costs one round.
    A hub's neighbours meet in one shuffle key; adaptive execution splits that side of the join.
    """
    current = materialise(build_edges(edges, "a", "b"), "edges")
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _stars(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = materialise(small, "stars")
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct()
    )


def components_of_pairs(pairs: DataFrame) -> DataFrame:
    """connected_components of pairs(a, b): contracted into stars first, of which only those that share vertices go through rounds.

    A vertex in one star alone is done after one grouping; stars that share a vertex are joined by their centres, so the
    rounds run over centres, and nothing is lost where edges lie far from each other. Rows with a null end are dropped.
    """
    stars = materialise(contracted(pairs), "contracted")
    sides = stars.select(F.col("b").alias("vertex"), F.col("a").alias("centre")).unionByName(stars.select(F.col("a").alias("vertex"), F.col("a").alias("centre")))
    seen = materialise(sides.groupBy("vertex").agg(F.min("centre").alias("low"), F.max("centre").alias("high")), "star-members")
    shared = sides.join(seen.where("low < high").select("vertex", "low"), "vertex").where("centre <> low")
    found = connected_components(shared.select(F.col("low").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("vertex", "low")
    return seen.join(found, "low", "left").select("vertex", F.coalesce("component", "low").alias("component"))
