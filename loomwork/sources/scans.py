"""Scans of image folders, manifests and metadata."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

from loomwork.functions.paths import has_extension
from loomwork.session import spread

IMAGE_EXTENSIONS = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
METADATA = (
    "bona_fide array<struct<image_id string, identity string, label string>>, "
    "morphs array<struct<image_id string, identity_a string, identity_b string, label string>>"
)


def _relative(root: str) -> Column:
    """The path below root; binaryFile paths carry a scheme that root may lack."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.substring_index("path", bare + "/", -1)


def image_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, recursive: bool = True, content: bool = True, required: bool = False) -> DataFrame:
    """(path, relative, size, content) of the files below root with one of the extensions, whatever their case; with `required`, fails where there are none.

    As with every file source of Spark, folders and files whose names begin with . or _ are not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    kept = files.where(has_extension(F.col("path"), extensions))
    if required and kept.select("path").isEmpty():
        raise FileNotFoundError(f"no image files below {root}")
    found = kept.select("path", _relative(root).alias("relative"), F.col("length").alias("size"), *(["content"] if content else []))
    return found if recursive else found.where(~F.col("relative").contains("/"))


def identity_folders(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(dataset_root, identity) for the folders right below root, also those without images; fails where root is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    rows = [(root, n) for n in names if hidden or not n.startswith(".")]
    return spark.createDataFrame(rows, "dataset_root string, identity string")


def header(data: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the first bytes of an image file; ValueError if they aren't there."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return "WEBP", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        sizes = {}
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
            sizes[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), data[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])[0]
        return "TIFF", sizes[256], sizes[257]
    if data[:2] == b"\xff\xd8":
        at = 2
        while data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    raise ValueError("no image header")


def whole(data: bytes, kind: str) -> None:
    """ValueError where the file ends before its image does; TIFF has no such mark and counts as whole."""
    if kind == "PNG":
        at, last = 8, b""
        while last != b"IEND":
            size = int.from_bytes(data[at : at + 4], "big")
            last, body, check = data[at + 4 : at + 8], data[at + 4 : at + 8 + size], data[at + 8 + size : at + 12 + size]
            if len(check) < 4 or zlib.crc32(body) != int.from_bytes(check, "big"):
                raise ValueError("damaged or missing chunk")
            at += 12 + size
    elif kind == "JPEG":
        if not data.rstrip(b"\0").endswith(b"\xff\xd9"):
            raise ValueError("no end of image")
    elif kind == "GIF":
        if not data.rstrip(b"\0").endswith(b";"):
            raise ValueError("no trailer")
    elif kind == "BMP":
        if len(data) < int.from_bytes(data[2:6], "little"):
            raise ValueError("shorter than its header says")
    elif kind == "WEBP" and len(data) < int.from_bytes(data[4:8], "little") + 8:
        raise ValueError("shorter than its header says")


def _png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, b"", None
    while at < len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if depth != 8 or interlaced or colour not in (0, 2, 3, 4, 6):
        raise ValueError("only plain PNG files of 8 bits are decoded")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.int64)  # a line above and a pixel to the left of zeros
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].reshape(width, step).astype(np.int64)
        up, row = out[y], out[y + 1]
        if kind in (0, 2):
            row[1:] = (line + (up[1:] if kind == 2 else 0)) & 255
        elif kind == 1:
            row[1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                left, above, corner = row[x], up[x + 1], up[x]
                guess = (left + above) // 2
                if kind == 4:
                    away = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
                    guess = np.where((away[0] <= away[1]) & (away[0] <= away[2]), left, np.where(away[1] <= away[2], above, corner))
                row[x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:].astype(np.uint8)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if step < 3 else np.ascontiguousarray(pixels[..., :3])


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("only plain BMP files of 24 or 32 bits are decoded")
    step, stride = bits // 8, -(-width * bits // 32) * 4
    lines = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = lines[:, : width * step].reshape(abs(height), width, step)[..., 2::-1]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def decoded(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG or BMP file; ValueError for other kinds, for which no codec is here."""
    kind = header(data)[0]
    if kind not in ("PNG", "BMP"):
        raise ValueError(f"no decoder for {kind}")
    whole(data, kind)
    return _png(data) if kind == "PNG" else _bmp(data)


def _decoded_row(data: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    """(height, width, data, error_message) of a file's bytes."""
    try:
        image = decoded(data)
        return *image.shape[:2], image.tobytes(), None
    except (ValueError, IndexError, KeyError, struct.error, TypeError, zlib.error) as error:
        return None, None, None, str(error)


def pixels(files: DataFrame) -> DataFrame:
    """files(path, content, ...) with height, width, data and error_message; data is null where nothing was decoded. No shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields if f.name != "content"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_decoded_row(data) for data in batch["content"]]
            more = pd.DataFrame(out, columns=["height", "width", "data", "error_message"], index=batch.index)
            yield pd.concat([batch.drop(columns="content"), more.astype({"height": "Int32", "width": "Int32"})], axis=1)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return files.mapInPandas(run, f"{schema}, height int, width int, data binary, error_message string")


def inspect(files: DataFrame) -> DataFrame:
    """files(path, content, ...) with format, width, height, corrupted and error_message; no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields if f.name != "content"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["content"]:
                try:
                    found = header(data)
                    whole(data, found[0])
                    out.append((*found, False, None))
                except (ValueError, IndexError, KeyError, struct.error, TypeError) as error:
                    out.append((None, None, None, True, str(error)))
            more = pd.DataFrame(out, columns=["format", "width", "height", "corrupted", "error_message"], index=batch.index)
            yield pd.concat([batch.drop(columns="content"), more.astype({"width": "Int32", "height": "Int32"})], axis=1)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return files.mapInPandas(run, f"{schema}, format string, width int, height int, corrupted boolean, error_message string")


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every image below root's identity folders, inspected: (dataset_root, identity, path, format, width, height, corrupted, error_message)."""
    files = image_files(spark, root).withColumn("identity", F.element_at(F.split("relative", "/"), 1)).where(F.col("relative").contains("/"))
    return inspect(files).select(F.lit(root).alias("dataset_root"), "identity", "path", "format", "width", "height", "corrupted", "error_message")


def split_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bona_fide, morphs) of a JSON document with two lists, in order, with default labels; fails on malformed JSON or a missing list."""
    document = spark.read.schema(METADATA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    listed = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing")))
    singles = document.select(F.posexplode(listed("bona_fide")).alias("ord", "s"))
    pairs = document.select(F.posexplode(listed("morphs")).alias("ord", "s"))
    return (
        singles.select("ord", "s.image_id", "s.identity", F.coalesce("s.label", F.lit("bona_fide")).alias("label")),
        pairs.select("ord", "s.image_id", "s.identity_a", "s.identity_b", F.coalesce("s.label", F.lit("morph")).alias("label")),
    )


def encoded_label(label: Column) -> Column:
    """bona_fide is 0, morph 1, digits themselves."""
    return F.when(label == "bona_fide", 0).when(label == "morph", 1).otherwise(label.try_cast("int"))


def manifest(spark: SparkSession, path: str, image_col: str = "image_path", label_col: str = "label") -> DataFrame:
    """A CSV manifest with its label as an int; fails at run time on a null path or a label that isn't a non-negative int."""
    rows = spark.read.option("header", "true").csv(path)
    missing = {image_col, label_col} - set(rows.columns)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    label = encoded_label(F.col(label_col))
    bad = F.raise_error(F.concat(F.lit("bad label: "), F.coalesce(F.col(label_col), F.lit("null")))).cast("int")
    good = rows.withColumn(label_col, F.when(label >= 0, label).otherwise(bad))
    return good.withColumn(image_col, F.when(F.col(image_col).isNotNull(), F.col(image_col)).otherwise(F.raise_error(F.lit("null path"))))


def dataset_roots(spark: SparkSession, root: str) -> list[str]:
    """The folders right below root that hold identity folders, in order; fails where there are none."""
    roots = [f"{root.rstrip('/')}/{r['identity']}" for r in identity_folders(spark, root).orderBy("identity").collect()]
    found = [r for r in roots if not identity_folders(spark, r).isEmpty()]
    if not found:
        raise NotADirectoryError(f"no datasets below {root}")
    return found


def check_files(rows: DataFrame, files: DataFrame, image_col: str = "image_path", shown: int = 5) -> DataFrame:
    """rows of a manifest; FileNotFoundError with the number of paths that files(relative) lacks and the first few of them."""
    missing = rows.select(image_col).distinct().join(files.select(F.col("relative").alias(image_col)), image_col, "left_anti")
    return _none_missing(rows, missing, image_col, shown)


def _none_missing(rows: DataFrame, missing: DataFrame, image_col: str, shown: int) -> DataFrame:
    number = missing.count()
    if number:
        first = [r[0] for r in missing.orderBy(image_col).limit(shown).collect()]
        raise FileNotFoundError(f"{number} files of the manifest are missing, such as {first}")
    return rows


def items(rows: DataFrame, files: DataFrame, image_col: str = "image_path") -> DataFrame:
    """rows of a manifest with height, width, data and error_message of their files(relative, content); each file is decoded once."""
    wanted = files.join(rows.select(F.col(image_col).alias("relative")).distinct(), "relative", "left_semi").select("relative", "content")
    known = pixels(wanted).withColumnRenamed("relative", image_col)
    return rows.join(known, image_col, "left").withColumn("error_message", F.coalesce("error_message", F.when(F.col("data").isNull(), F.lit("no such file"))))


def mounted(spark: SparkSession, root: str) -> str | None:
    """The plain path of a folder that tasks can open by themselves, as it lies in a mounted file system; None for other stores, patterns and what is no folder."""
    if any(c in root for c in "{[*?\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return None
    return fs.makeQualified(path).toUri().getPath()


def _place(base: str, path: str | None, extensions: tuple[str, ...]) -> str | None:
    """Where the file is that image_files would list under this path; None where it would list none."""
    if path is None or "\0" in path or not path.lower().endswith(extensions):
        return None
    for name in path.split("/"):
        shown = "=" in name or name.startswith(("_metadata", "_common_metadata"))
        if not name or name[0] == "." or (name[0] == "_" and not shown) or name.endswith("._COPYING_"):
            return None
    place = f"{base.rstrip('/')}/{path}"
    return place if os.path.isfile(place) else None


def check_named(rows: DataFrame, base: str, image_col: str = "image_path", shown: int = 5, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """check_files for files below a mounted folder: each task looks for those that its rows name, and no folder is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_place(base, p, extensions) is None for p in batch.column(0).to_pylist()], pa.bool_()))

    paths = rows.select(image_col)
    return _none_missing(rows, paths.mapInArrow(run, paths.schema).distinct(), image_col, shown)


#: Decoded bytes that a task holds before it passes them on.
PIECE_BYTES = 1 << 24


def named_items(rows: DataFrame, base: str, image_col: str = "image_path", extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """items for files below a mounted folder: each task opens those that its rows name, and no folder is listed.

    Rows are dealt and sorted by path, so that each file is decoded once. Columns of the rows named height, width, data or
    error_message are replaced.
    """
    made = StructType().add("height", IntegerType()).add("width", IntegerType()).add("data", BinaryType()).add("error_message", StringType())
    kept = [image_col, *[c for c in rows.columns if c != image_col and c not in made.names]]
    ready = spread(rows.select(*[F.col(f"`{c}`") for c in kept]), f"`{image_col}`").sortWithinPartitions(f"`{image_col}`")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())

    def joined(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        more = [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*part.columns, *more], names=[*kept, *made.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (None, None, None, "no such file")
        for batch in batches:
            begun, held, found = 0, 0, []
            for path in batch.column(0).to_pylist():
                if path != last:
                    place = _place(base, path, extensions)
                    if place is None:
                        known = (None, None, None, "no such file")
                    else:
                        with open(place, "rb") as file:
                            known = _decoded_row(file.read())
                    last = path
                found.append(known)
                held += len(known[2] or b"")
                if held >= PIECE_BYTES:
                    yield joined(batch.slice(begun, len(found)), found)
                    begun, held, found = begun + len(found), 0, []
            if found:
                yield joined(batch.slice(begun, len(found)), found)

    return ready.mapInArrow(run, StructType([*ready.schema.fields, *made.fields]))
