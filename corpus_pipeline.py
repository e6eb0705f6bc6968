"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The driver of a run writes every stage's result as Parquet and reads it as the next one's docs.

Cases, for every stage: other columns than those of documents are left out, whatever their names; null ids,
sources and texts and repeated rows are as the operator's docstring says; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.llm import compression_bands, line_dedup, mixing, packing, simhash_groups
from loomwork.llm.texts import word_count
from loomwork.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return compression_bands.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars is counted anew."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    return simhash_groups.keep_one(docs.select(*COLUMNS), shingle=5, similarity=0.8).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources near their target weights, whole documents only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"), F.xxhash64(*COLUMNS).alias("mark"))
    taken = mixing.mix_sources(marked, quality=mixing.quality_weights(labels), mark_col="mark")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.where("copies > 0").withColumn("_copy", copies).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of pieces in length buckets, with words as tokens."""
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("source mixing", mixed),
    ("packing", packed),
]

#: Compression and fingerprints have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
