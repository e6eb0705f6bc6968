"""Quality checks deal their tables by numbers of rows."""

from loomwork.operators import quality

SCHEMA = "image_id string, split string, label string, identities array<string>"


def test_checks_are_dealt_by_rows_and_find_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(f"i{k // 2}", ("train", "val")[k % 2], "bona_fide", [f"p{k // 4}"]) for k in range(40)], SCHEMA)
    members = spark.createDataFrame([(f"p{k}", "c") for k in range(10)], "identity string, component string")
    ids = spark.createDataFrame([(f"i{k}",) for k in range(5, 25)], "image_id string")
    found = lambda: quality.verify(rows, members, ids, ids, "/images")
    count = lambda issues: {r["check"]: r["count"] for r in issues.groupBy("check").count().collect()}
    usual = count(found())
    assert usual == {"duplicate_image": 20, "identity_leakage": 10, "component_leakage": 1, "split_completeness": 10, "missing_file": 5}
    monkeypatch.setattr(quality, "TASK_ROWS", 4)
    small = found()
    assert "hashpartitioning(image_id#" in (plan := small._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    assert count(small) == usual
