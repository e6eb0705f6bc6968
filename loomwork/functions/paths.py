"""Paths, file names and times as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The time format, the templates of file names and the extensions of image formats.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
NAMES = {"operator_suffix": "{stem}_aug_{operators}{ext}", "operator_prefix": "aug_{operators}_{stem}{ext}", "flat": "{stem}{ext}"}
FORMATS = {"png": ".png", "jpg": ".jpg", "jpeg": ".jpg", "bmp": ".bmp", "tif": ".tif", "tiff": ".tiff"}


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.?(\.[^./]+)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    wanted = [e.strip().lower() if e.strip().startswith(".") else "." + e.strip().lower() for e in extensions]
    return extension(path).isin(*wanted)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def part(path: Column, at: int) -> Column:
    """The at-th part counted from 1, or from the end if negative; '' where there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(at)), F.lit(""))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def mirrored(path: Column, source: str, target: str, suffix: str | None = None) -> Column:
    """The same relative path below target, with another suffix if given."""
    root = source.rstrip("/") + "/"
    below = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    moved = F.concat(F.lit(target.rstrip("/") + "/"), below)
    return with_suffix(moved, suffix) if suffix else moved


def resolved(path: Column, root: str) -> Column:
    """Absolute paths as they are, others below root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def morph_name(a: Column, b: Column, alpha: Column) -> Column:
    """morph_{a}_{b}_a{hundredths of alpha, cut off, three digits}.jpg"""
    return F.format_string("morph_%s_%s_a%03d.jpg", a, b, (alpha.cast("double") * 100.0).cast("int"))


def epoch_name(epoch: Column) -> Column:
    """epoch_{number, four digits}.pt"""
    return F.format_string("epoch_%04d.pt", epoch)


def epoch_folder(epoch: int) -> str:
    """epoch_{number, four digits}"""
    return f"epoch_{epoch:04d}"


def output_suffix(path: Column, image_format: str | None = None) -> Column:
    """The extension of a written copy: the source's, or that of a named format; ValueError for an unknown format."""
    if image_format is None:
        return extension(path)
    wanted = image_format.strip().lower().lstrip(".")
    if wanted not in FORMATS:
        raise ValueError(f"{image_format} is none of {sorted(FORMATS)}")
    return F.lit(FORMATS[wanted])


def metric_name(column: str) -> str:
    """The metric that a monitored column holds."""
    return column.removeprefix("val_")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def augmented_name(path: Column, applied: Column, suffix: Column, strategy: str = "operator_suffix") -> Column:
    """A copy's file name by one of NAMES, with the operators joined by _, or noop where none was applied."""
    if strategy not in NAMES:
        raise ValueError(f"{strategy} is none of {sorted(NAMES)}")
    operators = F.when(F.size(applied) > 0, F.array_join(applied, "_")).otherwise("noop")
    known = {"stem": stem(path), "operators": operators, "ext": suffix}
    parts = [p for p in re.split(r"[{}]", NAMES[strategy]) if p]
    return F.concat(*[known.get(p, F.lit(p)) for p in parts])


def path_order(path: Column) -> Column:
    """A sort key that orders paths part by part."""
    return F.split(path, "/")


def iso_seconds(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def is_timestamp(text: Column) -> Column:
    return F.coalesce(text.rlike(TIMESTAMP), F.lit(False))
