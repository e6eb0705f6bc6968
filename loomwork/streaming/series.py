"""Early stopping over a stream of epochs. It extends the batch operator; its rows are the same."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from loomwork.functions.training import Patience


def patience_stream(history: DataFrame, run: str, epoch: str, metric: str, patience: int, min_delta: float = 0.0, mode: str = "min", first: int = 0) -> DataFrame:
    """(run, epoch, value, best_value, counter, should_stop) of a stream of epochs, once each, as early_stopping gives them.

    Epochs are numbered without gaps from `first` and can come in any order and more than once: those that come
    before their turn wait in the state of their run until the ones before them are there, so that micro-batches
    and restarts change nothing. The state holds the next epoch, the best value, the counter and what waits.
    Rows of epochs that are null, below first or told already are left out; of a repeated epoch the first counts.
    """
    Patience(patience, min_delta, mode)
    rows = history.select(run, F.col(epoch).cast("long").alias("epoch"), F.col(metric).cast("double").alias("value")).where("epoch IS NOT NULL")
    out = StructType([rows.schema[run], *StructType.fromDDL("epoch long, value double, best_value double, counter int, should_stop boolean").fields])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, best, counter, epochs, values = state.get if state.exists else (first, None, 0, [], [])
        waiting = dict(zip(epochs, values, strict=True))
        for frame in frames:
            for number, value in zip(frame["epoch"].tolist(), frame["value"].tolist(), strict=True):
                if number >= due:
                    waiting.setdefault(number, value)
        judge, told = Patience(patience, min_delta, mode, best, counter), []
        while due in waiting:
            value = waiting.pop(due)
            told.append((*key, due, None if math.isnan(value) else value, *judge(value)))
            due += 1
        state.update((due, judge.best, judge.counter, list(waiting), list(waiting.values())))
        if told:
            yield pd.DataFrame(told, columns=out.names)

    kept = "due long, best double, counter int, epochs array<bigint>, waiting array<double>"
    return rows.groupBy(run).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
