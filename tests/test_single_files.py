"""Single CSV files, logs, split rows, class checks and attention maps."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import attention, metrics
from loomwork.operators import split
from loomwork.sources import sinks


def plain(rows):
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerows(rows)
    return out.getvalue().encode()


def test_manifests_are_those_of_a_plain_writer(spark, tmp_path):
    rows = [(f"i{k:03d}", ("train", "val")[k % 2], "morph" if k % 3 else "bona_fide", ["A", "B"] if k % 3 else [f'q"{k}']) for k in range(50)] + [("a,b", "train", "x\ny", ["é"])]
    assigned = spark.createDataFrame(rows, "image_id string, split string, label string, identities array<string>").repartition(7)
    cells = lambda name: [[*r[:3], "|".join(r[3])] for r in sorted(rows) if r[1] == name]
    head, files = ["image_id", "split", "label", "identities"], {"train": "train", "val": "validation", "test": "test"}
    sinks.manifest_files(assigned, str(tmp_path))
    for name, file in files.items():
        assert (tmp_path / f"{file}.csv").read_bytes() == plain([head, *cells(name)])
    sinks.manifest_files(assigned, str(tmp_path), append=True)
    for name, file in files.items():
        assert (tmp_path / f"{file}.csv").read_bytes() == plain([head, *cells(name), *cells(name)])
    sinks.manifest_files(assigned, str(tmp_path))
    assert (tmp_path / "train.csv").read_bytes() == plain([head, *cells("train")]) and not list(tmp_path.glob("*.part"))
    assert sorted(split.rows_of(assigned, "train").toPandas()["image_id"]) == sorted(r[0] for r in rows if r[1] == "train")
    with pytest.raises(ValueError, match="unknown split"):
        split.rows_of(assigned, "validation")


def test_log_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.log_rows(spark, path) == 0
    for n in (3, 6):
        sinks.append_log(spark.range(3), path)
        assert sinks.log_rows(spark, path) == n


def test_both_classes(spark):
    rows = lambda *labels: spark.createDataFrame([(x,) for x in labels], "true_label int")
    assert metrics.check_both_classes(rows(0, 1, 1)).count() == 3
    for bad in ((0, 0), (1,), (0, 1, 2), (0, 1, None), ()):
        with pytest.raises(ValueError, match="must hold"):
            metrics.check_both_classes(rows(*bad))


def test_attention_maps(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2, 5, 6))
    rows = [(i, t, vectors[i, t].tolist()) for i in range(2) for t in range(5)]
    tokens = spark.createDataFrame(rows, "image int, token int, vector array<double>")
    weights = attention.head_weights(tokens, 2)
    parts = vectors.reshape(2, 5, 2, 3).transpose(0, 2, 1, 3)
    want = np.exp(parts @ parts.transpose(0, 1, 3, 2) / np.sqrt(3))
    want /= want.sum(axis=-1, keepdims=True)
    got = np.zeros(want.shape)
    for r in weights.collect():
        got[r["image"], r["head"], r["row"], r["col"]] = r["weight"]
    assert np.allclose(got, want)
    layers = weights.withColumn("layer", F.lit(0)).unionByName(weights.withColumn("layer", F.lit(1)).withColumn("weight", F.col("weight") / 2))
    grids = {(r["image"], r["y"], r["x"]): r["weight"] for r in attention.class_grids(attention.mean_maps(layers)).collect()}
    assert all(abs(grids[i, y, x] - 0.75 * want[i, :, 0, 1 + 2 * y + x].mean()) < 1e-9 for i in range(2) for y in range(2) for x in range(2)) and len(grids) == 8
    with pytest.raises(Exception, match="fill a square"):
        attention.class_grids(attention.mean_maps(layers.where("col < 4"))).collect()
    with pytest.raises(ValueError):
        attention.head_weights(tokens, 0)
