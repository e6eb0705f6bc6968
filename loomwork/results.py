"""Everything that an evaluation leaves behind, written by one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from loomwork import reports
from loomwork.functions import curves, metrics
from loomwork.session import materialise
from loomwork.sources import sinks


def evaluate(rows: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(one row of all metrics, steps of the score curve) of predictions (true_label, predicted_label, score)."""
    steps = curves.score_steps(rows)
    one = metrics.rates(metrics.confusion(rows)).withColumn("_k", F.lit(1))
    for part in (curves.areas(steps), curves.eer_interpolated(curves.roc_points(steps)), metrics.at_threshold(rows, [threshold]).drop("threshold")):
        one = one.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")  # one row each
    return one.drop("_k"), steps


def export(predictions: DataFrame, out_dir: str, name: str = "evaluation", threshold: float = 0.5, margin: float = 0.1, top: int = 10, notes: str = "") -> Row:
    """Metrics, report, curves, decisions, predictions and errors of predictions(index, true_label, score) below out_dir.

    metrics.json and report.md are single files; roc, precision_recall, classes, confusion, predictions, misclassified,
    hard, top_fp, top_fn and errors are folders of CSV or JSON lines, as they grow with the input. Fails without rows
    and on labels or scores out of range. Returns the row of metrics.
    """
    metrics.check_filled(predictions)
    rows = metrics.decide(metrics.check_labels(predictions), threshold=threshold).withColumn("probability", F.col("score"))
    rows = materialise(metrics.check_predictions(rows), "predictions")
    one, steps = evaluate(rows, threshold)
    row, classes, base = one.first(), metrics.class_report(rows), out_dir.rstrip("/")
    spark, narrow = rows.sparkSession, rows.drop("score")
    sinks.write_text(spark, f"{base}/metrics.json", reports.as_json(row, name, notes))
    sinks.write_text(spark, f"{base}/report.md", reports.markdown(row, classes, name, notes))
    sinks.report(curves.roc_points(steps), f"{base}/roc")
    sinks.report(curves.precision_recall_points(steps), f"{base}/precision_recall")
    sinks.report(classes, f"{base}/classes")
    sinks.report(metrics.k_class_confusion(rows, 2), f"{base}/confusion")
    sinks.report(metrics.confidence(narrow), f"{base}/predictions")
    sinks.report(metrics.misclassified(narrow), f"{base}/misclassified")
    sinks.report(metrics.hard_examples(narrow, margin), f"{base}/hard")
    for kind in ("fp", "fn"):
        sinks.report(metrics.top_errors(narrow, kind, top), f"{base}/top_{kind}")
    sinks.summary(metrics.error_summary(rows, margin), f"{base}/errors")
    return row
