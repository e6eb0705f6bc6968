"""Training by epochs against plain numpy, and runs that are broken off and resumed."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.operators import fit, model

RNG = np.random.default_rng(8)
X = RNG.normal(size=(90, 4))
Y = (X @ [1.0, -2.0, 0.5, 0.0] + RNG.normal(size=90) > 0.4).astype(int)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(x.tolist(), int(y)) for x, y in zip(X, Y, strict=True)] + [(None, 1), (X[0].tolist(), None), (X[0].tolist(), 7)]
    known = spark.createDataFrame(rows, "embedding array<double>, label int").withColumn("_x", F.lit("clash")).withColumn("_w", F.lit(0))
    return known, known.limit(30)


def plain(rule: fit.Optimizer, epochs: int, gamma: float | None = None):
    """(losses, weights) of full batches."""
    x, n = np.c_[X, np.ones(len(X))], len(X)
    k = np.where(Y == 1, n / (2 * Y.sum()), n / (2 * (n - Y.sum())))
    w, m, v, losses = np.zeros(5), np.zeros(5), np.zeros(5), []
    for t in range(1, epochs + 1):
        loss = lambda w: (lambda pt: (k * -np.log(pt) if gamma is None else k * -((1 - pt) ** gamma) * np.log(pt)).sum() / (k.sum() if gamma is None else n))(np.where(Y == 1, 1 / (1 + np.exp(-x @ w)), 1 - 1 / (1 + np.exp(-x @ w))))
        losses.append(loss(w))
        if gamma is None:
            g = x.T @ (k * (1 / (1 + np.exp(-x @ w)) - Y)) / k.sum()
        else:
            g = np.array([(loss(w + h) - loss(w - h)) / 2e-6 for h in np.eye(5) * 1e-6])
        if rule.name != "adamw":
            g = g + rule.decay * w
        if rule.name == "sgd":
            m = rule.momentum * m + g
            w = w - rule.rate * m
            continue
        w = w * (1 - rule.rate * rule.decay) if rule.name == "adamw" else w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rule.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return losses, w


@pytest.mark.parametrize("name, gamma", [("adamw", None), ("adam", None), ("sgd", None), ("adamw", 2.0)])
def test_losses_and_weights_are_those_of_numpy(tables, name, gamma):
    rule = fit.Optimizer(name, rate=0.1, decay=0.05)
    state = fit.fit(*tables, optimizer=rule, epochs=4, gamma=gamma)
    losses, weights = plain(rule, 4, gamma)
    assert np.allclose([h["train_loss"] for h in state.history], losses, rtol=1e-6) and np.allclose(state.weights, weights, atol=1e-4)


@pytest.mark.parametrize("name", fit.RULES)
def test_a_resumed_run_equals_an_unbroken_one(spark, tables, tmp_path, name):
    options = {"optimizer": fit.Optimizer(name, rate=0.1), "batches": 2, "schedule": lambda epoch: 0.5**epoch}
    whole = fit.fit(*tables, epochs=4, **options)
    fit.fit(*tables, epochs=2, folder=str(tmp_path / name), **options)
    resumed = fit.fit(*tables, epochs=4, folder=str(tmp_path / name), **options)
    assert resumed == whole and len(resumed.history) == 4
    assert fit.restored(spark, str(tmp_path / name), 1).epoch == 1 and model.latest(spark, str(tmp_path / name)).endswith("epoch_0003")
    assert model.best(spark, str(tmp_path / name), "val_loss").endswith(f"epoch_{whole.best_epoch:04d}")


def test_early_stopping_and_scores(spark, tables):
    state = fit.fit(*tables, optimizer=fit.Optimizer("sgd", rate=1e-6), epochs=9, patience=1, monitor="val_accuracy", mode="max")
    assert state.stopped and len(state.history) == 3 and state.best_epoch == 0
    assert [r.is_best for r in fit.history(spark, state).collect()] == [True, False, False]
    good = fit.fit(*tables, optimizer=fit.Optimizer(rate=0.3), epochs=15)
    scored = fit.score(good, tables[0].where("label < 2"))
    assert scored.where("predicted_label = label").count() >= 75 and "_x" not in scored.columns


def test_bad_arguments(spark, tables):
    for call in (lambda: fit.Optimizer("lion"), lambda: fit.Optimizer(rate=0.0), lambda: fit.fit(*tables, patience=-1), lambda: fit.fit(*tables, epochs=1, monitor="eer"), lambda: fit.fit(tables[0], tables[0].limit(0))):
        with pytest.raises(ValueError):
            call()
    assert fit.restored(spark, "/tmp/no-such-folder") is None and math.isnan(fit.validated(fit.prepared(tables[0].limit(0), "embedding", "label", None), fit.State.start(5), None)["val_loss"])


def test_gradient_sums_are_exact_in_every_order(spark, monkeypatch):
    monkeypatch.setattr(fit, "PRODUCTS", 40)
    draws = np.random.default_rng(5).normal(size=(97, 4)) * 10.0 ** np.random.default_rng(6).integers(-9, 4, size=(97, 1))
    draws[3, 1], draws[4, 2], draws[5, 0] = np.nan, np.inf, -0.0
    rows = [pa.array(draws[:, :3].tolist()), pa.array(draws[:, 3]), pa.array([None, *np.abs(draws[1:, 3])]), pa.array(np.ones(97))]
    whole = pa.RecordBatch.from_arrays(rows, names=["_x", "_g", "_l", "_n"])

    def sums(batches):
        total = {}
        for part in fit._partial_sums(iter(batches)):
            for j, *limbs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total[j] = total.get(j, 0) + (limbs[0] << 50) + (limbs[1] << 25) + limbs[2]
        return total

    mixed = whole.take(pa.array(np.random.default_rng(7).permutation(97)))
    got = sums([whole])
    assert got == sums([mixed.slice(0, 13), mixed.slice(13, 0), mixed.slice(13)])
    products = np.column_stack([draws[:, :3] * draws[:, 3:], draws[:, 3], [np.nan, *np.abs(draws[1:, 3])], np.ones(97)])
    for j in range(6):
        assert got[j] / 2**60 == pytest.approx(math.fsum(v for v in products[:, j] if math.isfinite(v)), rel=1e-12, abs=1e-15)
    with pytest.raises(OverflowError):
        sums([pa.RecordBatch.from_arrays([pa.array([[1e9]]), pa.array([11.0]), pa.array([0.0]), pa.array([1.0])], names=["_x", "_g", "_l", "_n"])])


def test_sums_without_finite_values_and_without_rows(spark):
    rows = spark.createDataFrame([([1.0, float("nan")], 1, 1.0), ([2.0, 1.0], 0, 0.5)], "_x array<double>, _y int, _w double")
    gradient, loss = fit._sums(rows.where("_x[1] = 1"), fit.State.start(3), None)
    assert gradient.tolist() == [1.0, 0.5, 0.5] and loss == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        fit._sums(rows.where("isnan(_x[1])"), fit.State.start(3), None)
    assert fit._sums(rows.where("_y > 1"), fit.State.start(3), None)[1] == 0.0
