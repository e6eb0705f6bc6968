"""The corpus pipeline's contract: columns, order of stages and what each stage may change."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from loomwork.llm import registry


def test_stages(spark, tmp_path):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))

    rows = []
    for i in range(60):
        rows.append((i, "Terms apply.\n" + prose(120), "en", f"s{i % 3}", 0))
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "again and again " * 400, "en", "s1", 0), (102, None, "en", None, 0), (103, prose(90), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path)).cache()
        if k < 4:
            assert docs.columns == columns
        kept.append(docs)
    assert {r[0] for r in kept[0].select("doc_id").collect()} == {*range(60), 100, 103}
    assert kept[1].count() == kept[0].count() and kept[1].where(F.col("text").contains("Terms apply")).count() == 0
    assert {r[0] for r in kept[2].select("doc_id").collect()} == {*range(60), 103}
    copies = {r[0]: r[1] for r in kept[3].groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= {*range(60), 103}
    assert kept[4].agg(F.sum("n_tokens")).first()[0] == sum(len(r[0].split()) for r in kept[3].select("text").collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
