"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from loomwork.llm import ball_tree, chat_format, compression_bands, line_dedup, merkle, mixing, packing, pii_crf, sequence_files, simhash, spelling, token_counts, url_filters

QUERIES = {
    "op1_compression_bands": compression_bands.query,
    "op2_skip_chain_crf": pii_crf.query,
    "op3_length_buckets": packing.query,
    "op4_simhash_covering": simhash.query,
    "op5_ball_tree_top_k": ball_tree.query,
    "op6_line_dedup": line_dedup.query,
    "op7_token_counts": token_counts.query,
    "op8_url_trees": url_filters.query,
    "op9_sequence_files": sequence_files.query,
    "op10_source_mixing": mixing.query,
    "op11_merkle_manifest": merkle.query,
    "op12_chat_rendering": chat_format.query,
    "op13_spelling_variants": spelling.query,
}

ORACLES = {
    "op3_length_buckets": packing.ORACLE_SQL,
    "op5_ball_tree_top_k": ball_tree.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_chat_rendering": chat_format.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
