"""Classifiers over image files: folders and manifests become vectors of pixels, which any scorer of vectors takes."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.operators import faces, model
from loomwork.sources import scans


def vectors(decoded: DataFrame, size: int = 32, flip_share: float = 0.0, seed: int = 0) -> DataFrame:
    """decoded(height, width, data, error_message, ...) with embedding instead of height, width and data; no shuffle.

    embedding is the image at size x size, channels first and normalised; null, with an error_message, where it is unreadable.
    The other columns stay; a clashing column named embedding is replaced.
    """
    kept = [c for c in decoded.columns if c not in ("height", "width", "data", "embedding")]
    item = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_item")
    made = faces.model_inputs(decoded.select(item, "height", "width", "data"), "_item", size, flip_share, seed)
    told = F.coalesce(F.col("_item.error_message"), F.when(F.col("values").isNull(), F.lit("unreadable image"))).alias("error_message")
    return made.select(*[F.col(f"_item.`{c}`") for c in kept if c != "error_message"], F.col("values").alias("embedding"), told)


def folder_vectors(spark: SparkSession, root: str, size: int = 32, recursive: bool = False) -> DataFrame:
    """(image_path, embedding, error_message) of the images right in root, or anywhere below it; FileNotFoundError if there are none."""
    files = scans.image_files(spark, root, recursive=recursive, required=True)
    return vectors(scans.pixels(files.select(F.col("relative").alias("image_path"), "content")), size)


def manifest_vectors(spark: SparkSession, path: str, root: str, size: int = 32, image_col: str = "image_path", label_col: str = "label", flip_share: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows of a CSV manifest with embedding and error_message of their files below root; FileNotFoundError naming the first few that are missing.

    Tasks open files of a mounted folder by their names; other stores are listed once by the driver.
    """
    rows = scans.manifest(spark, path, image_col, label_col)
    base = scans.mounted(spark, root)
    if base is not None:
        return vectors(scans.named_items(scans.check_named(rows, base, image_col), base, image_col), size, flip_share, seed)
    files = scans.image_files(spark, root)
    return vectors(scans.items(scans.check_files(rows, files, image_col), files, image_col), size, flip_share, seed)


def predictions(scorer: PipelineModel, images: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(predictions, failures) of images(image_path, embedding, error_message).

    Fixed values: the columns image_path, predicted_label, probability_morph and probability_bonafide, which other tools read.
    Failures are (image_path, error_message).
    """
    scored = model.predict(scorer, images.where("embedding IS NOT NULL"), "embedding", threshold)
    chance = F.col("probability")
    done = scored.select("image_path", "predicted_label", chance.alias("probability_morph"), (1.0 - chance).alias("probability_bonafide"))
    return done, images.where("embedding IS NULL").select("image_path", "error_message")
