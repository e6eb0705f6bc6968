"""Files written from the tables and scanned again: images, manifests, logs, reports and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions import metrics
from loomwork.operators import statistics
from loomwork.plans import imaging, series
from loomwork.plans.evaluation import P1009, predictions
from loomwork.session import materialise, scratch_path
from loomwork.sources import scans, sinks


def hashed(data) -> F.Column:
    return F.md5(F.hex(data))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's image written as a PNG file in its label's folder, found, inspected and decoded again."""
    root = scratch_path(spark, "images")
    named = F.concat(F.lit("label"), "label", F.lit("/"), "vec_id", F.lit(".png"))
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("img/"), "vec_id").alias("path"), named.alias("name"))
    images = imaging.images(spark, sf_dir).join(labels, "path").select(F.col("name").alias("path"), "height", "width", "data")
    materialise(sinks.image_files(images, root, "png"), "written-images").count()
    files = scans.image_files(spark, root).withColumn("identity", F.element_at(F.split("relative", "/"), 1))
    kinds = scans.inspect(files).select("relative", "size", "identity", "format", F.col("width").alias("w"), F.col("height").alias("h"), "corrupted")
    decoded = scans.pixels(files.select("relative", "content")).select("relative", hashed("data").alias("pixels"))
    return kinds.join(decoded, "relative").select("relative", "identity", "format", "w", "h", "corrupted", (F.col("size") > 60).alias("has_body"), "pixels")


def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity folders of written images, one without any too, with their counts, formats and a broken file in each."""
    root = scratch_path(spark, "folders")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    whole = imaging.images(spark, sf_dir).withColumn("vec_id", F.substring("path", 5, 20).cast("long")).join(rows, "vec_id")
    named = whole.select(F.concat(F.lit("label"), "label", F.lit("/"), "vec_id", F.lit(".bmp")).alias("path"), "height", "width", "data")
    materialise(sinks.image_files(named, root, "bmp"), "written-folders").count()
    sinks.write_text(spark, f"{root}/nobody/notes.txt", "no image")
    for label in rows.select("label").distinct().collect():  # one folder each
        sinks.write_text(spark, f"{root}/label{label['label']}/broken.bmp", "BM and no more")
    found = statistics.identity_inventory(scans.image_inventory(spark, root), scans.identity_folders(spark, root))
    return found.select("identity", "image_count", F.array_join("formats", "|").alias("formats"), F.array_join("resolutions", "|").alias("resolutions"), "corrupted_count")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as split manifests on disk, read back and checked; a doc of several rows is several entries."""
    folder = scratch_path(spark, "manifests")
    turn = F.col("doc_id") % 10
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.concat(F.lit("doc/"), "doc_id").alias("image_id"),
        F.when(turn < 7, "train").when(turn < 9, "val").otherwise("test").alias("split"),
        F.when(F.col("quality") == 1, "bona_fide").otherwise("morph").alias("label"),
        F.array(F.col("doc_id").cast("string"), F.concat(F.lit("t"), "toxic")).alias("identities"),
    )
    sinks.split_manifests(rows, folder)
    parts = [scans.manifest(spark, f"{folder}/{name}", "image_id") for name in sinks.FILES.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("image_id", "split", F.col("label").cast("int").alias("label"), "identities")


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events appended to one log in three turns, with nothing in the last."""
    path = scratch_path(spark, "log")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.round("value", 6).alias("value"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1", "event_id < 0"):
        sinks.append_log(events.where(part), path)
    return sinks.read_log(spark, path)


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their confidence as a CSV report with four places, read back as text."""
    path = scratch_path(spark, "report")
    sinks.report(metrics.confidence(predictions(spark, sf_dir)).select("index", "true_label", "confidence", "is_correct"), path, 4)
    return spark.read.option("header", True).csv(path)


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned orders by outcome, with the commonest reasons of failure."""
    done = series.aligned(spark, sf_dir).select(F.when(F.col("success"), "aligned").otherwise("failed").alias("status"), F.regexp_replace("failure_reason", "[(].*", "").alias("reason"))
    return statistics.run_report(done).withColumn("reasons", F.array_join("reasons", "; "))


QUERIES = {
    "image_files": image_files,
    "folder_inventory": folder_inventory,
    "split_manifests": manifests,
    "appended_log": appended_log,
    "written_report": written_report,
    "alignment_report": alignment_report,
}

HEX = "array_to_string([printf('%02X%02X%02X', x, x, x) for x in p], '')"
ORACLES = {
    "image_files": f"""WITH {imaging.GRAY} SELECT 'label' || label || '/' || vec_id || '.png' AS relative, 'label' || label AS identity, 'PNG' AS format, 8 AS w, 8 AS h, false AS corrupted,
    true AS has_body, md5({HEX}) AS pixels FROM g JOIN embeddings USING (vec_id)""",
    "folder_inventory": """SELECT 'label' || label AS identity, count(*) + 1 AS image_count, 'BMP' AS formats, '8x8' AS resolutions, 1 AS corrupted_count FROM embeddings GROUP BY label
  UNION ALL SELECT 'nobody', 0, '', '', 0""",
    "split_manifests": """SELECT 'doc/' || doc_id AS image_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label, doc_id || '|t' || toxic AS identities FROM labels""",
    "appended_log": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
    "written_report": f"""WITH {P1009} SELECT index::VARCHAR AS index, true_label::VARCHAR AS true_label, printf('%.4f', CASE WHEN predicted_label = 1 THEN score ELSE 1 - score END) AS confidence,
    CASE WHEN true_label = predicted_label THEN 'true' ELSE 'false' END AS is_correct FROM p""",
    "alignment_report": f"""WITH a AS ({series.ORACLES["face_alignment"]}),
  b AS (SELECT CASE WHEN success THEN 'aligned' ELSE 'failed' END AS status, regexp_replace(failure_reason, '[(].*', '') AS reason FROM a),
  c AS (SELECT status, reason, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT status, sum(n)::BIGINT AS n, coalesce(string_agg(reason || ': ' || n, '; ' ORDER BY n DESC, reason) FILTER (WHERE reason IS NOT NULL), '') AS reasons FROM c GROUP BY 1""",
}
