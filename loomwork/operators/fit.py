"""Training of a linear scorer by epochs: gradients as grouped sums over the rows, validation, early stopping and resumable state."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.functions.metrics import class_weights
from loomwork.functions.paths import epoch_folder
from loomwork.operators.model import checkpoints
from loomwork.session import materialise
from loomwork.sources.sinks import write_text

RULES = ("adamw", "adam", "sgd")


@dataclass(frozen=True)
class Optimizer:
    """A rule for steps against a gradient; decay pulls weights to 0, in adamw apart from the gradient."""

    name: str = "adamw"
    rate: float = 0.05
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    momentum: float = 0.9
    epsilon: float = 1e-8

    def __post_init__(self):
        if self.name not in RULES:
            raise ValueError(f"unknown optimiser {self.name!r}; known are {', '.join(RULES)}")
        if self.rate <= 0 or self.decay < 0 or not all(0 <= b < 1 for b in (*self.betas, self.momentum)):
            raise ValueError("rate must be positive, decay not negative, betas and momentum in [0, 1)")


@dataclass
class State:
    """All that a run needs to go on: weights with the bias last, both moments, and what early stopping counts."""

    weights: list[float]
    first: list[float]
    second: list[float]
    steps: int = 0
    epoch: int = -1
    best: float | None = None
    best_epoch: int | None = None
    bad: int = 0
    stopped: bool = False
    history: list[dict] = field(default_factory=list)

    @classmethod
    def start(cls, size: int) -> State:
        return cls([0.0] * size, [0.0] * size, [0.0] * size)


def stepped(state: State, gradient: np.ndarray, rule: Optimizer, rate: float) -> None:
    """Moves the weights one step and keeps the moments."""
    w, m, v = (np.array(x) for x in (state.weights, state.first, state.second))
    state.steps += 1
    if rule.name != "adamw":
        gradient = gradient + rule.decay * w
    if rule.name == "sgd":
        m = rule.momentum * m + gradient
        w = w - rate * m
    else:
        one, two = rule.betas
        if rule.name == "adamw":
            w = w * (1.0 - rate * rule.decay)
        m, v = one * m + (1.0 - one) * gradient, two * v + (1.0 - two) * gradient**2
        w = w - rate * (m / (1.0 - one**state.steps)) / (np.sqrt(v / (1.0 - two**state.steps)) + rule.epsilon)
    state.weights, state.first, state.second = w.tolist(), m.tolist(), v.tolist()


def _score(weights: list[float]) -> Column:
    """The probability of class 1."""
    known = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    z = F.aggregate(F.zip_with("_x", known, lambda x, w: x * w), F.lit(float(weights[-1])), lambda s, t: s + t)
    return 1.0 / (1.0 + F.exp(-z))


def _parts(p: Column, gamma: float | None) -> tuple[Column, Column, Column]:
    """Loss of a row, its derivative by the score before the logistic function, and what the mean divides by."""
    y, weight = F.col("_y"), F.col("_w")
    of = F.least(F.greatest(F.when(y == 1, p).otherwise(1.0 - p), F.lit(1e-15)), F.lit(1.0))
    sign = F.when(y == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    if gamma is None:
        return -weight * F.log(of), weight * (p - y), weight
    far = F.pow(1.0 - of, F.lit(float(gamma)))
    return -weight * far * F.log(of), sign * weight * far * (gamma * of * F.log(of) - (1.0 - of)), F.lit(1.0)


#: Products that a task holds at once, and the largest of them.
PRODUCTS, LARGEST = 1 << 20, 1e10


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(j, high, middle, low) of batches(_x, _g, _l, _n): sums of _x times _g by place, then of _g, _l and _n, in units of 2**-10, 2**-35 and 2**-60.

    Null, NaN and infinite values count for nothing; a place without others is left out.
    """
    for batch in batches:
        size = len(batch.column("_x")[0]) + 3 if batch.num_rows else 3
        step = max(PRODUCTS // size, 1)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            slope, loss, weight = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_l", "_n"))
            x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size - 3)
            values = np.column_stack([x * slope[:, None], slope, loss, weight])
            known = np.isfinite(values)
            values = np.where(known, values, 0.0) * 2.0**10
            if (np.abs(values) >= LARGEST * 2.0**10).any():
                raise OverflowError(f"a product of {LARGEST:g} or more in a gradient")
            whole, sums = np.floor(values), []
            for _ in range(2):
                sums.append(whole.astype(np.int64).sum(axis=0))
                values = (values - whole) * 2.0**25
                whole = np.floor(values)
            sums.append(np.rint(values).astype(np.int64).sum(axis=0))
            there = known.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there), pa.int32()), *[pa.array(s[there]) for s in sums]], names=["j", "high", "middle", "low"])


def _sums(rows: DataFrame, state: State, gamma: float | None) -> tuple[np.ndarray, float]:
    """Mean gradient and mean loss: one aggregate of as many sums as there are weights, partial sums first.

    Sums are of whole numbers, so that they are the same in whatever order the rows come.
    """
    loss, slope, weight = _parts(F.col("_p"), gamma)
    scored = rows.select("_x", "_y", "_w", _score(state.weights).alias("_p")).select("_x", slope.alias("_g"), loss.alias("_l"), weight.cast("double").alias("_n"))
    parts = scored.mapInArrow(_partial_sums, "j int, high long, middle long, low long")
    found = parts.groupBy("j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "middle", "low")]).collect()
    sums = np.zeros(len(state.weights) + 2)
    if found and len(found) < len(sums):
        raise ValueError("a place of the vectors holds no finite value")
    for r in found:
        sums[r.j] = ((int(r.high) << 50) + (int(r.middle) << 25) + int(r.low)) / (1 << 60)
    total = sums[-1] or 1.0
    return sums[:-2] / total, float(sums[-2] / total)


def validated(rows: DataFrame, state: State, gamma: float | None) -> dict[str, float]:
    """val_loss and val_accuracy over rows, in one aggregate."""
    loss, _, weight = _parts(F.col("_p"), gamma)
    scored = rows.select("_x", "_y", "_w", _score(state.weights).alias("_p"))
    right = F.avg(((F.col("_p") >= 0.5).cast("int") == F.col("_y")).cast("double"))
    row = scored.agg((F.sum(loss) / F.sum(weight)).alias("val_loss"), right.alias("val_accuracy")).first()
    return {k: math.nan if v is None else float(v) for k, v in row.asDict().items()}


def prepared(rows: DataFrame, vector: str, label: str, weights: dict[int, float] | None) -> DataFrame:
    """(_x, _y, _w): vectors, labels 0 or 1, and class weights; rows without a vector or label are left out."""
    known = rows.where(F.col(f"`{vector}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
    weight = F.lit(1.0)
    for k, w in (weights or {}).items():
        weight = F.when(F.col(f"`{label}`") == k, F.lit(float(w))).otherwise(weight)
    return known.select(F.col(f"`{vector}`").cast("array<double>").alias("_x"), F.col(f"`{label}`").cast("int").alias("_y"), weight.alias("_w"))


def fit(
    train: DataFrame,
    validation: DataFrame,
    vector: str = "embedding",
    label: str = "label",
    optimizer: Optimizer | None = None,
    epochs: int = 30,
    batches: int = 1,
    weighted: bool = True,
    gamma: float | None = None,
    monitor: str = "val_loss",
    mode: str = "min",
    patience: int = 5,
    schedule: Callable[[int], float] | None = None,
    folder: str | None = None,
    seed: int = 0,
) -> State:
    """Trains on one table, validates on the other after each epoch, and stops when `monitor` hasn't improved for more than `patience` epochs.

    Each step is one aggregate over a batch of rows, dealt anew each epoch by hash of vector and label; with one batch
    that is one aggregate an epoch. Only as many numbers as the vector is long reach the driver. Losses are cross-entropy
    with inverse-frequency class weights if weighted, or focal with gamma. schedule(epoch) scales the rate.

    With a folder each epoch's state is saved there, and a run that finds states goes on from the last: it ends with
    the same weights and history as an unbroken one.

    Cases: rows without a vector or with a label other than 0 and 1 are left out; a table without rows raises ValueError;
    vectors of another length than the first row's raise an error at run time.
    """
    if mode not in ("min", "max") or patience < 0 or epochs < 1 or batches < 1:
        raise ValueError("mode must be min or max, patience not negative, epochs and batches positive")
    rule, spark = optimizer or Optimizer(), train.sparkSession
    good = train.where(F.col(f"`{vector}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
    known = {r.label: r.weight for r in class_weights(good, label).collect()} if weighted else None
    rows = materialise(prepared(train, vector, label, known), "fit-train")
    held = materialise(prepared(validation, vector, label, known), "fit-validation")
    one = rows.select(F.size("_x")).first()
    if one is None or held.isEmpty():
        raise ValueError("both tables need rows with a vector and a label of 0 or 1")
    fits = F.when(F.size("_x") == one[0], F.col("_x")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    rows, held = rows.withColumn("_x", fits), held.withColumn("_x", fits)
    state = (restored(spark, folder) if folder else None) or State.start(one[0] + 1)
    for epoch in range(state.epoch + 1, epochs):
        if state.stopped:
            break
        rate, losses = rule.rate * (schedule(epoch) if schedule else 1.0), []
        for batch in range(batches):
            dealt = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "_x", "_y"), F.lit(batches)) == batch
            gradient, loss = _sums(rows.where(dealt) if batches > 1 else rows, state, gamma)
            stepped(state, gradient, rule, rate)
            losses.append(loss)
        found = validated(held, state, gamma)
        if monitor not in found:
            raise ValueError(f"monitor must be one of {', '.join(found)}, not {monitor}")
        value = found[monitor]
        better = state.best is None or (value < state.best if mode == "min" else value > state.best)
        state.epoch, state.bad = epoch, 0 if better else state.bad + 1
        if better:
            state.best, state.best_epoch = value, epoch
        state.stopped = state.bad > patience
        state.history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), **found, "learning_rate": rate, "is_best": better})
        if folder:
            saved(spark, state, folder)
    return state


def saved(spark: SparkSession, state: State, folder: str) -> str:
    """The state as a checkpoint below folder; its metrics come last and tell whole checkpoints."""
    path = f"{folder.rstrip('/')}/{epoch_folder(state.epoch)}"
    write_text(spark, f"{path}/state.json", json.dumps(asdict(state)))
    numbers = {k: float(v) for k, v in state.history[-1].items() if k != "epoch"}
    write_text(spark, f"{path}/metrics.json", json.dumps({"epoch": state.epoch, "metrics": numbers}))
    return path


def restored(spark: SparkSession, folder: str, epoch: int | None = None) -> State | None:
    """The state of an epoch, by default the last, or None if there is none."""
    if not _exists(spark, folder):
        return None
    whole = checkpoints(spark, folder).where(F.lit(epoch is None) | (F.col("epoch") == F.lit(epoch))).orderBy(F.desc("epoch")).first()
    if whole is None:
        return None
    text = spark.read.text(f"{whole['path']}/state.json", wholetext=True).first()
    return State(**json.loads(text[0]))


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether the folder has a whole checkpoint."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/epoch_*/metrics.json")
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found))


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, train_loss, val_loss, val_accuracy, learning_rate, is_best), one row an epoch."""
    names = "epoch long, train_loss double, val_loss double, val_accuracy double, learning_rate double, is_best boolean"
    return spark.createDataFrame([tuple(h[c.split()[0]] for c in names.split(", ")) for h in state.history], names)


def score(state: State, rows: DataFrame, vector: str = "embedding", threshold: float = 0.5) -> DataFrame:
    """rows with probability (of class 1) and predicted_label; rows without a vector are left out."""
    ready = rows.where(F.col(f"`{vector}`").isNotNull()).withColumn("_x", F.col(f"`{vector}`").cast("array<double>"))
    scored = ready.withColumn("probability", _score(state.weights)).drop("_x")
    return scored.withColumn("predicted_label", (F.col("probability") >= threshold).cast("int"))
