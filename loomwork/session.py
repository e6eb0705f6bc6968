"""Session settings and the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "loomwork", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary one, gone when the process ends; on a cluster no
    such folder is shared, so it fails.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all this application's intermediate results."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> bool:
    """Delete the run's intermediate results; for the end of a job, as no DataFrame made of them can be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The rows survive lost executors, later uses do not compute them again, and Parquet takes
    less room than a checkpoint of the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many partitions as shuffles have, however small it is: for rows that take long to compute.

    A small file is one partition, and adaptive execution would join partitions of few bytes again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a small intermediate result in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
