"""Point kernels as column expressions over array<int> pixels, row by row; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _n(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _byte(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def flipped(pixels: Column, width: Column | int, channels: int = 1) -> Column:
    """Columns in reverse order, channels in their own."""
    at = F.sequence(F.lit(0), F.size(pixels) - 1)
    row = width * channels

    def source(i: Column) -> Column:
        column = F.floor((i % row) / channels).cast("int")
        return (i - i % row + (width - 1 - column) * channels + i % channels + 1).cast("int")

    return F.transform(at, lambda i: F.element_at(pixels, source(i)))


def brightened(pixels: Column, factor: Column | float) -> Column:
    """Rounded to even and kept within a byte."""
    return F.transform(pixels, lambda p: _byte(F.rint(F.abs(p * _n(factor)))))


def mean(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + p) / F.size(pixels)


def gray(pixels: Column) -> Column:
    """Weighted red, green and blue of array<int> pixels in three channels, rounded."""
    at = F.sequence(F.lit(0), F.floor(F.size(pixels) / 3).cast("int") - 1)
    part = lambda i, c: F.element_at(pixels, 3 * i + c + 1)
    return F.transform(at, lambda i: F.rint(0.299 * part(i, 0) + 0.587 * part(i, 1) + 0.114 * part(i, 2)).cast("int"))


def contrasted(pixels: Column, factor: Column | float, average: Column) -> Column:
    """average + factor * (p - average), kept within a byte and cut off; average, a column of its own, is mean(p) of one channel or mean(gray(p)) of three."""
    return F.transform(pixels, lambda p: _byte(F.floor(F.least(F.greatest(average + _n(factor) * (p - average), F.lit(0.0)), F.lit(255.0)))))


def contrasted_rounded(pixels: Column, factor: Column | float, average: Column) -> Column:
    """|factor * p + average * (1 - factor)| rounded; average is a whole number."""
    return F.transform(pixels, lambda p: _byte(F.rint(F.abs(_n(factor) * p + average * (1.0 - _n(factor))))))


def gamma_corrected(pixels: Column, gamma: Column | float) -> Column:
    """(p / 255) ** gamma * 255, cut off."""
    return F.transform(pixels, lambda p: _byte(F.floor(F.pow(p / 255.0, _n(gamma)) * 255.0)))


def normalised(pixels: Column, average: float, deviation: float) -> Column:
    """Shares of 255, less the channel's average, over its deviation."""
    return F.transform(pixels, lambda p: (p / 255.0 - average) / deviation)


def packed(pixels: Column) -> Column:
    """Pixels as binary."""
    return F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p), 2, "0")), ""))


def unpacked(data: Column) -> Column:
    """Binary as pixels; none for no bytes."""
    digits = F.hex(data)
    return F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1 "), " "), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))


def resized_nearest(pixels: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(new_height * new_width - 1))
    y, x = (lambda i: F.floor(F.floor(i / new_width) * height / new_height)), (lambda i: F.floor(i % new_width * width / new_width))
    return F.transform(at, lambda i: F.element_at(pixels, (y(i) * width + x(i) + 1).cast("int")))
