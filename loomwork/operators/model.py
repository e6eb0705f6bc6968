"""Scoring models over embedding columns: training, batch prediction, history and checkpoints."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.metrics import class_weights
from loomwork.functions.paths import epoch_folder
from loomwork.sources.sinks import write_text


def train(rows: DataFrame, vector: str = "embedding", label: str = "label", weighted: bool = True, epochs: int = 30, decay: float = 1e-4) -> PipelineModel:
    """A logistic classifier on the vector, with inverse-frequency class weights if weighted."""
    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("int").alias("label"))
    if weighted:
        weights = class_weights(known).select(F.col("label"), F.col("weight"))
        known = known.join(F.broadcast(weights), "label")  # one row per class
    else:
        known = known.withColumn("weight", F.lit(1.0))
    return Pipeline(stages=[LogisticRegression(maxIter=epochs, regParam=decay, weightCol="weight")]).fit(known)


def predict(model: PipelineModel, rows: DataFrame, vector: str = "embedding", threshold: float = 0.5) -> DataFrame:
    """rows with probability (of class 1) and predicted_label; the batch runs where the rows are."""
    ready = rows.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    scored = model.transform(ready).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return scored.withColumn("predicted_label", (F.col("probability") >= threshold).cast("int")).drop("features", "rawPrediction", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def history(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(epoch, loss): the objective before training and after each pass over the rows."""
    losses = model.stages[-1].summary.objectiveHistory
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "epoch long, loss double")


def save_epoch(model: PipelineModel, folder: str, epoch: int, metrics: dict[str, float]) -> str:
    """A checkpoint below folder with its metrics; returns its path. The metrics come last, so that they tell whole checkpoints."""
    path = f"{folder.rstrip('/')}/{epoch_folder(epoch)}"
    save(model, f"{path}/model")
    write_text(SparkSession.active(), f"{path}/metrics.json", json.dumps({"epoch": epoch, "metrics": metrics}))
    return path


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, epoch, metrics) of the whole checkpoints below folder, one row each."""
    files = spark.read.schema("epoch long, metrics map<string,double>").json(f"{folder.rstrip('/')}/epoch_*/metrics.json")
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "/metrics[.]json$", "").alias("path"), "epoch", "metrics")


def latest(spark: SparkSession, folder: str) -> str | None:
    """The path of the newest checkpoint."""
    row = checkpoints(spark, folder).orderBy(F.desc("epoch")).first()
    return row["path"] if row else None


def best(spark: SparkSession, folder: str, metric: str, mode: str = "min") -> str | None:
    """The path of the checkpoint with the best metric, of equal ones the earliest; those without it don't count."""
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode}")
    value = F.try_element_at("metrics", F.lit(metric))
    row = checkpoints(spark, folder).where(value.isNotNull()).orderBy(value.asc() if mode == "min" else value.desc(), "epoch").first()
    return row["path"] if row else None


def prune(spark: SparkSession, folder: str, keep: int, metric: str | None = None, mode: str = "min") -> list[str]:
    """Delete all but the newest `keep` checkpoints, and but the best one if a metric is named; returns what went."""
    if keep < 1:
        raise ValueError("keep at least one checkpoint")
    spared = best(spark, folder, metric, mode) if metric else None
    old = [r["path"] for r in checkpoints(spark, folder).orderBy(F.desc("epoch")).collect()[keep:] if r["path"] != spared]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, old):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return old
