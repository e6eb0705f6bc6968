"""Training series against plain loops, and their stream form against the batch form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import training
from loomwork.streaming.series import patience_stream


def plain(values, patience, min_delta, mode):
    best, counter, told = math.inf, 0, []
    for value in values:
        signed = None if value is None else value if mode == "min" else -value
        if signed is not None and signed < best - min_delta:
            best, counter = signed, 0
        else:
            counter += 1
        told.append((value, best if mode == "min" else -best, counter, counter > patience))
    return told


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(8)
    made = {name: [rng.choice([None, *[rng.randint(0, 20) / 4] * 9]) for _ in range(n)] for name, n in (("a", 40), ("b", 1), ("c", 400))}
    return made | {None: [3.0, 2.0, 2.0, 2.5]}


@pytest.fixture(scope="module")
def history(spark, runs):
    rows = [(run, k, value) for run, values in runs.items() for k, value in enumerate(values)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "run string, epoch int, loss double")


@pytest.mark.parametrize(("min_delta", "mode"), [(0.0, "min"), (0.5, "min"), (0.25, "max")])
def test_early_stopping_equals_a_plain_loop(history, runs, min_delta, mode):
    got = training.early_stopping(history, ["run"], "epoch", "loss", 3, min_delta, mode)
    assert got.columns == ["run", "epoch", "value", "best_value", "counter", "should_stop"]
    rows = got.collect()
    assert len(rows) == sum(map(len, runs.values()))
    for run, values in runs.items():
        mine = sorted((r[1:] for r in rows if r["run"] == run), key=lambda r: r[0])
        assert [tuple(r[1:]) for r in mine] == plain(values, 3, min_delta, mode)


def test_runs_of_several_keys_none_and_nan(spark, history):
    doubled = history.withColumn("part", F.lit(1)).unionByName(history.withColumn("part", F.lit(2)))
    assert training.early_stopping(doubled, ["run", "part"], "epoch", "loss", 1).where("epoch = 0").count() == 8
    one = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, 0.5)], "epoch int, loss double")
    assert [r["counter"] for r in training.early_stopping(one, [], "epoch", "loss", 1, mode="max").orderBy("epoch").collect()] == [0, 1, 2]
    assert training.early_stopping(history.limit(0), ["run"], "epoch", "loss", 1).count() == 0
    rates = training.plateau_rates(spark.createDataFrame([(k, 1.0) for k in range(7)], "epoch int, loss double"), [], "epoch", "loss", 1.0, 0.5, 1, 0.3)
    assert [r["learning_rate"] for r in rates.orderBy("epoch").collect()] == [1.0, 1.0, 0.5, 0.5, 0.3, 0.3, 0.3]


def test_stream_of_shuffled_epochs_equals_the_batch_after_a_restart(spark, history, tmp_path):
    rows = history.where("run IS NOT NULL")
    parts = rows.randomSplit([1.0] * 4, seed=5)

    def more(some):
        for part in some:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        told = patience_stream(stream, "run", "epoch", "loss", 3, 0.5)
        query = told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    more(parts[:2])
    early = spark.read.parquet(f"{tmp_path}/out").count()
    more([*parts[2:], parts[0]])  # the first part comes again
    want = training.early_stopping(rows, ["run"], "epoch", "loss", 3, 0.5)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert 0 < early < want.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
