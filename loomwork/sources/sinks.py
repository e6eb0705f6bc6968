"""Writers of manifests, reports, logs and images."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.operators.statistics import statistics_rows
from loomwork.session import scratch_path

MANIFEST = ("image_id", "split", "label", "identities")
FILES = {"train": "train", "val": "validation", "test": "test"}


def split_manifests(assigned: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """A folder of CSV files for each split, sorted by image id, identities joined by |; empty splits get a header."""
    rows = assigned.select("image_id", "split", "label", F.array_join(F.col("identities").cast("array<string>"), "|").alias("identities"))
    for split, name in FILES.items():
        mine = rows.where(F.col("split") == split).orderBy("image_id")
        target = f"{out_dir.rstrip('/')}/{name}"
        if mine.isEmpty():
            mine = mine.coalesce(1)
        mine.write.mode(mode).option("header", "true").option("emptyValue", "").csv(target)


def _csv_cell(column: Column) -> Column:
    """A cell as plain CSV writers make it: quoted only where it holds a comma, a quote or a line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(column.rlike('[",\\r\\n]'), quoted).otherwise(column), F.lit(""))


def csv_file(rows: DataFrame, path: str, order: list[str], append: bool = False) -> None:
    """rows as one CSV file of that name, in order, with one header and \\r\\n as line ends.

    Sorted parts are written by tasks and then streamed one behind the other into a file that takes its name when whole, so no
    reader sees half of it. With append the rows of an existing file come first and its header counts; a missing or empty
    one is begun anew.
    """
    spark = rows.sparkSession
    cells = [_csv_cell(F.col(f"`{c}`").cast("string")) for c in rows.columns]
    folder = scratch_path(spark, "csv-file")
    lines = rows.orderBy(*order).select(F.concat(F.concat_ws(",", *cells), F.lit("\r")).alias("value"))
    lines.write.option("lineSep", "\n").text(folder)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs, source = target.getFileSystem(conf), hadoop.fs.Path(folder)
    begun = append and fs.exists(target) and fs.getFileStatus(target).getLen() > 0
    parts = sorted((f.getPath() for f in source.getFileSystem(conf).listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = fs.create(part, True)
    try:
        if not begun:
            out.write(bytearray((",".join(rows.columns) + "\r\n").encode()))
        for place in [*([target] if begun else []), *parts]:
            piece = place.getFileSystem(conf).open(place)
            hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
            piece.close()
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def manifest_files(assigned: DataFrame, out_dir: str, append: bool = False) -> None:
    """train.csv, validation.csv and test.csv below out_dir, sorted by image id, identities joined by |."""
    rows = assigned.select("image_id", "split", "label", F.array_join(F.col("identities").cast("array<string>"), "|").alias("identities"))
    for split, name in FILES.items():
        csv_file(rows.where(F.col("split") == split), f"{out_dir.rstrip('/')}/{name}.csv", ["image_id"], append)


def report(rows: DataFrame, path: str, places: int = 6, mode: str = "overwrite") -> None:
    """rows as CSV with doubles of fixed places and arrays joined by |."""
    cells = []
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            cells.append(F.format_string(f"%.{places}f", F.col(name)).alias(name))
        elif kind.startswith("array"):
            cells.append(F.array_join(F.col(name).cast("array<string>"), "|").alias(name))
        else:
            cells.append(F.col(name))
    rows.select(*cells).write.mode(mode).option("header", "true").csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, made on the driver; it appears under its name when whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def document(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one indented JSON list; ValueError beyond `most` rows, for which summary writes JSON lines."""
    found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    write_text(rows.sparkSession, path, json.dumps(found, indent=2, ensure_ascii=False) + "\n")


def statistics_table(stats: DataFrame, path: str) -> None:
    """Split statistics, one row a split and the overall row last, as one CSV file."""
    rows = statistics_rows(stats)
    order = F.when(F.col("split") == "overall", 1).otherwise(0)
    report(rows.coalesce(1).sortWithinPartitions(order, "split"), path)


def summary(rows: DataFrame, path: str) -> None:
    """rows as JSON lines with nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet log; fails if the log has other columns, and does nothing without rows."""
    if rows.isEmpty():
        return
    try:
        known = rows.sparkSession.read.parquet(path).schema
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        known = rows.schema
    if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in rows.schema]:
        raise ValueError(f"the log has {known.simpleString()}, not {rows.schema.simpleString()}")
    rows.write.mode("append").parquet(path)


def _ppm(height: int, width: int, data: bytes) -> bytes:
    return b"P6 %d %d 255\n" % (width, height) + data


def _png(height: int, width: int, data: bytes) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = b"".join(b"\0" + data[at : at + 3 * width] for at in range(0, 3 * width * height, 3 * width))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _bmp(height: int, width: int, data: bytes) -> bytes:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, 3)[::-1, :, ::-1]
    body = np.pad(pixels.reshape(height, 3 * width), ((0, 0), (0, -3 * width % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


ENCODERS = {"ppm": _ppm, "png": _png, "bmp": _bmp}


def image_files(images: DataFrame, out_dir: str, kind: str = "png") -> DataFrame:
    """Write images(path, height, width, data) as files below out_dir; returns (path, target, bytes). Lazy.

    Kinds are png, bmp and ppm, for which no codec is needed; a path without that suffix gets it. Rows without data are left
    out. A task writes each file under another name first, so that a repeated task leaves whole files.
    """
    encode = ENCODERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}")
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for path, h, w, data in zip(batch["path"], batch["height"], batch["width"], batch["data"], strict=True):
                target = f"{base}/{path.lstrip('/').removesuffix('.' + kind)}.{kind}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                whole = encode(h, w, bytes(data))
                with fs.open_output_stream(f"{target}.{attempt}") as out:
                    out.write(whole)
                fs.move(f"{target}.{attempt}", target)
                rows.append((path, target, len(whole)))
            yield pd.DataFrame(rows, columns=["path", "target", "bytes"])

    kept = images.where("data IS NOT NULL").select("path", "height", "width", "data")
    return kept.mapInPandas(run, "path string, target string, bytes long")


def log_rows(spark: SparkSession, path: str) -> int:
    """Number of rows of a Parquet log; 0 if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return read_log(spark, path).count() if fs.exists(place) and fs.listStatus(place) else 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
