"""Training series: early stopping, learning rates, running means and best epochs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loomwork.functions.metrics import ratio


class Patience:
    """Best value so far and the number of epochs since, told one epoch after another.

    An epoch improves if it beats the best so far by more than min_delta; null and NaN never do.
    """

    def __init__(self, patience: int, min_delta: float = 0.0, mode: str = "min", best: float | None = None, counter: int = 0):
        if mode not in ("min", "max"):
            raise ValueError("mode must be min or max")
        if patience < 0 or min_delta < 0:
            raise ValueError("patience and min_delta must not be negative")
        self.patience, self.min_delta, self.least = patience, min_delta, mode == "min"
        self.best = (math.inf if self.least else -math.inf) if best is None else best
        self.counter = counter

    def __call__(self, value: float | None) -> tuple[float, int, bool]:
        """(best, counter, should_stop) after an epoch of this value."""
        if value is not None and (value < self.best - self.min_delta if self.least else value > self.best + self.min_delta):
            self.best, self.counter = value, 0
        else:
            self.counter += 1
        return self.best, self.counter, self.counter > self.patience


def _folded(history: DataFrame, run: list[str], epoch: str, metric: str, added: str, start: Callable[[], Callable]) -> DataFrame:
    """(run keys, epoch, value, added columns): each run's epochs in order through the function that start() makes for it.

    Runs are dealt by hash and sorted, and rows stream by with the state of one run: work grows in proportion
    to the epochs, and no run is held as a whole.
    """
    rows = history.select(*run, F.col(epoch).cast("long").alias("epoch"), F.col(metric).cast("double").alias("value"))
    extra = StructType.fromDDL(added)
    types, names = [to_arrow_type(f.dataType) for f in extra], [*rows.columns, *extra.names]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(c.to_pylist() for c in batch.columns[: len(run)]), strict=True)) or [()] * batch.num_rows
            told = []
            for key, value in zip(keys, batch.column(len(run) + 1).to_pylist(), strict=True):
                if step is None or key != last:
                    last, step = key, start()
                told.append(step(value))
            fresh = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], names)

    dealt = rows.repartition(*run) if run else rows.repartition(1)
    return dealt.sortWithinPartitions(*run, "epoch", "value").mapInArrow(fold, StructType([*rows.schema.fields, *extra.fields]))


def early_stopping(history: DataFrame, run: list[str], epoch: str, metric: str, patience: int, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """(run keys, epoch, value, best_value, counter, should_stop) for each epoch.

    The counter grows with every epoch that does not improve (see Patience), and training should stop once it
    exceeds the patience. Each run's epochs are folded in order; runs are independent.
    """
    Patience(patience, min_delta, mode)
    return _folded(history, run, epoch, metric, "best_value double, counter int, should_stop boolean", lambda: Patience(patience, min_delta, mode))


def plateau_rates(history: DataFrame, run: list[str], epoch: str, metric: str, rate: float, factor: float = 0.1, patience: int = 2, min_rate: float = 0.0, threshold: float = 1e-4) -> DataFrame:
    """(run keys, epoch, learning_rate): cut by factor after more than `patience` epochs without a relative gain over threshold."""

    def start() -> Callable[[float | None], tuple[float]]:
        best, bad, now = math.inf, 0, float(rate)

        def step(value: float | None) -> tuple[float]:
            nonlocal best, bad, now
            if value is not None and value < best * (1.0 - threshold):
                best, bad = value, 0
            else:
                bad += 1
            if bad > patience:
                now, bad = max(now * factor, float(min_rate)), 0
            return (now,)

        return step

    return _folded(history, run, epoch, metric, "learning_rate double", start).drop("value")


def cosine_factor(step: Column, warmup: int, total: int, min_ratio: float = 0.0) -> Column:
    """Share of the base rate at a step: a linear warm-up, then half a cosine down to min_ratio."""
    progress = F.least(F.greatest((step - warmup) / float(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    cosine = min_ratio + (1.0 - min_ratio) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(cosine)


def step_factor(epoch: Column, total_epochs: int) -> Column:
    """A tenth after each third of the epochs."""
    return F.pow(F.lit(0.1), F.floor(epoch / max(1, total_epochs // 3)))


def running_mean(rows: DataFrame, run: list[str], order: str, value: str, weight: str) -> DataFrame:
    """rows with running_mean, weighted by size, over each run in order."""
    upto = Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", ratio(F.sum(F.col(value) * F.col(weight)).over(upto), F.sum(weight).over(upto), 0.0))


def best_epoch(history: DataFrame, run: list[str], epoch: str, metric: str, mode: str = "min") -> DataFrame:
    """(run keys, best_epoch, best_value); the earliest of equal ones."""
    value = F.col(metric) if mode == "min" else -F.col(metric)
    return history.groupBy(*run).agg(F.min(F.struct(value.alias("v"), F.col(epoch).alias("e"))).alias("_b")).select(*run, F.col("_b.e").alias("best_epoch"), (F.col("_b.v") * (1 if mode == "min" else -1)).alias("best_value"))
