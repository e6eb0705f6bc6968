"""Text, Markdown and JSON reports of small results, laid out on the driver by one table helper."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row

#: Metrics in reports: column of the metrics row, heading.
METRICS = (
    ("num_samples", "samples"), ("accuracy", "accuracy"), ("error_rate", "error rate"), ("precision", "precision"), ("recall", "recall"), ("f1", "F1"),
    ("roc_auc", "ROC area"), ("pr_auc", "PR area"), ("eer", "equal error rate"), ("eer_threshold", "threshold of the equal error rate"), ("far", "false acceptance"),
    ("frr", "false rejection"), ("apcer", "APCER"), ("bpcer", "BPCER"), ("acer", "ACER"), ("loss", "loss"),
)
MAIN = ("accuracy", "f1", "roc_auc", "eer", "acer")
CLASSES = {0: "bonafide", 1: "attack"}


def shown(value) -> str:
    """A cell: numbers with four places, a dash for what is undefined."""
    if value is None:
        return "-"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def table(head: Sequence[str], rows: Sequence[Sequence], markdown: bool = False) -> str:
    """Aligned columns, the first to the left and the others to the right; as a Markdown table on demand."""
    cells = [list(head), *([shown(x) for x in row] for row in rows)]
    widths = [max(len(line[k]) for line in cells) for k in range(len(head))]
    pad = lambda line: [x.ljust(w) if k == 0 else x.rjust(w) for k, (x, w) in enumerate(zip(line, widths, strict=True))]
    if markdown:
        rule = [":" + "-" * (widths[0] - 1 or 1), *("-" * (w - 1 or 1) + ":" for w in widths[1:])]
        return "\n".join(f"| {' | '.join(line)} |" for line in (pad(cells[0]), rule, *map(pad, cells[1:])))
    return "\n".join(" | ".join(pad(line)).rstrip() for line in cells)


def metric_rows(metrics: Row) -> list[tuple]:
    known = metrics.asDict()
    return [(title, known[name]) for name, title in METRICS if name in known]


def metric_table(metrics: Row, markdown: bool = False) -> str:
    """The metrics that the row has, undefined ones as a dash."""
    return table(("metric", "value"), metric_rows(metrics), markdown)


def class_table(classes: DataFrame, names: dict[int, str] | None = None, markdown: bool = False) -> str:
    """One line per class of metrics.class_report, by label."""
    names = CLASSES if names is None else names
    rows = [(names.get(r["label"], str(r["label"])), r["support"], r["precision"], r["recall"], r["f1"]) for r in sorted(classes.collect(), key=lambda r: r["label"])]
    return table(("class", "rows", "precision", "recall", "F1"), rows, markdown)


def confusion_table(metrics: Row, names: dict[int, str] | None = None, markdown: bool = False) -> str:
    """True classes down, predicted ones across."""
    names = CLASSES if names is None else names
    body = [(names[0], metrics["tn"], metrics["fp"]), (names[1], metrics["fn"], metrics["tp"])]
    return table(("true / predicted", names[0], names[1]), body, markdown)


def summary(metrics: Row, experiment: str, notes: str = "") -> dict:
    """Name, time, number of rows, the main metrics and notes."""
    if not experiment.strip():
        raise ValueError("experiment name is blank")
    known = metrics.asDict()
    head = {"experiment_name": experiment, "timestamp": datetime.now(UTC).isoformat(), "num_samples": known["num_samples"]}
    return head | {name: known.get(name) for name in MAIN} | {"notes": notes}


def markdown(metrics: Row, classes: DataFrame, experiment: str, notes: str = "") -> str:
    """The whole report of an evaluation."""
    head = summary(metrics, experiment, notes)
    said = [f"{experiment}: {head['num_samples']} rows, {head['timestamp']}", *([notes] if notes else [])]
    parts = {"What was evaluated": "\n\n".join(said), "All metrics": metric_table(metrics, True), "By class": class_table(classes, markdown=True), "Decisions": confusion_table(metrics, markdown=True)}
    return "\n\n".join(f"## {title}\n\n{text}" for title, text in parts.items()) + "\n"


def as_json(metrics: Row, experiment: str, notes: str = "") -> str:
    return json.dumps({"summary": summary(metrics, experiment, notes), "metrics": metrics.asDict()}, indent=2)


def console(stats: DataFrame) -> str:
    """Split statistics as a table."""
    rows = [(r["split"], r["total_count"], r["bona_fide_count"], r["morph_count"], r["identity_count"], f"{r['percentage_of_dataset']:.2f}%") for r in stats.collect()]
    return table(("split", "images", "bona fide", "morphs", "identities", "share"), rows)
