"""Columns named like the operators' own, and empty tables, through every stage and operator."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import ball_tree, compression_bands, line_dedup, mixing, packing, pii_crf, sequence_files, simhash, simhash_groups, token_counts, url_filters

CLASHES = ["_row", "_text", "_id", "_mark", "_lines", "_drops", "_gone", "gone", "group_id", "label_id", "quality_weight", "size", "source_size", "target", "copies", "_copy",
           "_source", "_key", "_bucket", "kept", "n_words", "n_lines", "n_dropped", "n_tokens", "fp", "part", "block", "piece", "shard", "component_id", "v", "w0"]


@pytest.fixture(scope="module")
def clashing(spark):
    prose = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    rows = [(1, prose, "en", "a", 3), (2, prose + " end", "en", "a", 3), (3, None, None, None, None), (None, "short text", "en", "b", 1), (4, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.array(F.lit(k)).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("clashes"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, clashing, folder):
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, clashing, folder)
        assert got.columns == corpus_pipeline.COLUMNS, name
        assert got.count() <= 2 * clashing.count()
        assert stage(spark, clashing.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, clashing, folder).count() == clashing.count()
    assert corpus_pipeline.STAGES[4][1](spark, clashing.limit(0), folder).count() == 0


def test_operators(spark, clashing, tmp_path):
    n = clashing.count()
    extra = [c for c in CLASHES if c not in ("kept", "n_words")]
    judged = compression_bands.judge(clashing)
    assert judged.count() == n and set(extra) <= set(judged.columns)
    lines = line_dedup.dedup_lines(clashing)
    assert lines.count() == n and lines.columns == clashing.columns
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    mixed = mixing.mix_sources(clashing.drop("size").withColumn("size", F.length("text")), quality=mixing.quality_weights(labels))
    assert mixed.count() == n and set(mixed.columns) == {*clashing.columns, "epochs"}
    assert simhash.near_duplicates(clashing).count() == n
    left = simhash_groups.keep_one(clashing)
    assert left.columns == clashing.columns and {r[0] for r in left.select("doc_id").collect()} == {1, 3, None}
    assert packing.pack(clashing.drop("n_tokens").withColumn("n_tokens", F.length("text"))).count() == n
    assert token_counts.count_tokens(clashing, public_tokenizers.path("piece_bpe_32k.model"), part_tokens=2).count() == n
    written = sequence_files.write_sequences(clashing, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/out", shards=2)
    assert sequence_files.read_documents(written).count() == n
    assert pii_crf.find_spans(clashing, pii_crf.train(clashing, made=40)).count() == n
    vectors = clashing.select("*", F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert ball_tree.top_k(vectors, F.col("vec_id") == 1).count() == 3 - 1 + 1
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.org/"), "doc_id").alias("url"), *[F.array(F.lit(1)).alias(c) for c in ("host", "path", "rule", "verdict", "blocked", "domain", "suffix", "_url", "label")])
    assert url_filters.judge(pages, url_filters.train(url_filters.seed_labels(pages))).count() == n
