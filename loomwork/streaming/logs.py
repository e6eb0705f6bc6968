"""Structured Streaming forms of run logs and counters. These extend the batch operators; rows and results are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a log as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(rows: DataFrame, time: str, status: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, status, n) in tumbling windows; rows later than `late` behind the newest are dropped once a window closed."""
    timed = rows.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def append_new(rows: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's unseen keys to a Parquet log: resumption as a stream."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.select(*batch.columns).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
