import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import curves, metrics


@pytest.fixture
def make(spark):
    def rows(labels, scores, predicted=None):
        predicted = predicted or [int(s >= 0.5) for s in scores]
        data = [(i, y, p, float(s), float(s)) for i, (y, p, s) in enumerate(zip(labels, predicted, scores, strict=True))]
        return spark.createDataFrame(data, "index long, true_label int, predicted_label int, probability double, score double")

    return rows


# The label and score vectors below have known results.


def test_rates(make):
    rows = make([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.6, 0.8, 0.3, 0.9])
    row = metrics.rates(metrics.confusion(rows)).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 1, 1, 2)
    for name in ("precision", "recall", "f1", "accuracy"):
        assert row[name] == pytest.approx(2 / 3)
    assert row["apcer"] == row["bpcer"] == row["acer"] == pytest.approx(1 / 3)


def test_absent_class_is_null(make):
    row = metrics.rates(metrics.confusion(make([0, 0], [0.1, 0.9]))).first()
    assert row["apcer"] is None and row["acer"] is None and row["bpcer"] == 0.5 and row["recall"] == 0.0


@pytest.mark.parametrize(
    ("labels", "scores", "auc", "eer", "threshold"),
    [
        ([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.6, 0.8, 0.3, 0.9], 0.777778, 0.333333, 0.6),
        ([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.2, 0.9], None, 0.333333, 0.4),
        ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0, 0.0, 0.8),
        ([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1], 0.0, 1.0, 0.8),
        ([0, 1, 0, 1], [0.5] * 4, 0.5, None, None),
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, None, None),
    ],
)
def test_curves(make, labels, scores, auc, eer, threshold):
    for bucket_rows in (50_000, 2):
        steps = curves.score_steps(make(labels, scores), bucket_rows=bucket_rows)
        if auc is not None:
            assert curves.areas(steps).first()["roc_auc"] == pytest.approx(auc, abs=1e-6)
        if eer is not None:
            found = curves.eer_interpolated(curves.roc_points(steps)).first()
            assert found["eer"] == pytest.approx(eer, abs=1e-6)
            if eer < 1:
                assert found["eer_threshold"] == pytest.approx(threshold)


def test_pr_auc(make):
    steps = curves.score_steps(make([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.6, 0.8, 0.3, 0.9]))
    assert curves.areas(steps).first()["pr_auc"] == pytest.approx(0.866667, abs=1e-6)
    last = curves.precision_recall_points(steps).where("threshold IS NULL").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


def test_thresholds(make):
    far = metrics.at_threshold(make([1, 1, 1, 0, 0], [0.9, 0.3, 0.8, 0.1, 0.2]), [0.5]).first()
    frr = metrics.at_threshold(make([0, 0, 0, 1], [0.1, 0.6, 0.2, 0.9]), [0.5]).first()
    assert far["far"] == pytest.approx(1 / 3) and frr["frr"] == pytest.approx(1 / 3)


def test_errors_and_hard_examples(make):
    rows = make([0, 0, 1, 1], [0.1, 0.9, 0.8, 0.2])
    assert [r["index"] for r in metrics.top_errors(rows, "fp", 5).collect()] == [1]
    assert [r["index"] for r in metrics.top_errors(rows, "fn", 5).collect()] == [3]
    assert metrics.rates(metrics.confusion(rows)).first()["error_rate"] == 0.5
    assert {r["index"] for r in metrics.hard_examples(make([0, 1, 1], [0.48, 0.95, 0.55]), 0.1).collect()} == {0, 2}
    assert metrics.top_errors(make([0] * 20, [0.9] * 20), "fp", 5).count() == 5


def test_class_weights_and_k_class(make, spark):
    labels = spark.createDataFrame([(x,) for x in (0, 0, 0, 0, 3, 3)], "label int")
    got = {r["label"]: (r["n"], r["weight"]) for r in metrics.class_weights(labels).collect()}
    assert got == {0: (4, 0.75), 1: (0, 0.0), 2: (0, 0.0), 3: (2, 1.5)}
    cells = metrics.k_class_confusion(make([0, 1, 0, 0], [0.0] * 4, [0, 1, 1, 0]), 2)
    assert {(r[0], r[1]): r[2] for r in cells.collect()} == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 1}


def test_labels_outside_the_grid_are_refused(make):
    for true, predicted in (([0, 2], [0, 1]), ([0, 1], [0, -1])):
        with pytest.raises(Exception, match="must be one of"):
            metrics.k_class_confusion(make(true, [0.0, 0.0], predicted), 2).collect()
    with pytest.raises(Exception, match="probability must be within"):
        metrics.check_predictions(make([0, 1], [0.2, 1.2], [0, 1])).agg(F.sum("probability")).collect()
    with pytest.raises(ValueError, match="nothing"):
        metrics.check_filled(make([0], [0.1]).limit(0))


def test_curves_in_buckets(make):
    """Skewed scores: nearly all of them lie in a thousandth of the range, and any number of buckets gives the same steps."""
    rng = random.Random(4)
    scores = [0.999 + rng.random() / 1000 for _ in range(300)] + [rng.random() for _ in range(20)]
    rows = make([rng.randint(0, 1) for _ in scores], scores)
    one = sorted(map(tuple, curves.score_steps(rows).collect()))
    assert one == sorted(map(tuple, curves.score_steps(rows, bucket_rows=17).collect())) and len(one) == len(set(scores))


def test_weighted_mean(spark):
    rows = spark.createDataFrame([(1.0, 8), (0.5, 2)], "v double, n int")
    assert metrics.weighted_mean(rows, "v", "n").first()["mean"] == pytest.approx(0.9)
    assert metrics.weighted_mean(rows.limit(0), "v", "n").first()["mean"] == 0.0


def test_bad_label_raises(make):
    with pytest.raises(Exception, match="true_label must be one of"):
        metrics.check_labels(make([0, 2], [0.1, 0.2])).agg(F.sum("true_label")).collect()
