"""Kernels that look at neighbouring pixels, as column expressions over array<int> pixels; they stay in the JVM.

Pixels lie row by row, channels interleaved. Sizes, angles and shares are columns or numbers, so that each row can
have its own; so can the taps of blurs, as columns or as a table of numbers. Borders are mirrored at the outermost pixels, which are not repeated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

from loomwork.functions.kernels import SMALL_KERNELS
from loomwork.functions.pixels import _byte

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where a lambda reads it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mirrored(at: Column, size: Number) -> Column:
    period = F.greatest(2 * _c(size) - 2, F.lit(1))
    return F.when(_c(size) == 1, F.lit(0)).otherwise(F.least(F.pmod(at, period), period - F.pmod(at, period))).cast("int")


def pixel(pixels: Column, y: Column, x: Column, channel: Column, width: Number, channels: int) -> Column:
    return F.element_at(pixels, ((y * _c(width) + x) * channels + channel + 1).cast("int"))


def each(height: Number, width: Number, channels: int, value: Callable[[Column, Column, Column], Column]) -> Column:
    """value(y, x, channel) for every place of an image."""
    row = _c(width) * channels
    last = (_c(height) * row - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: value(F.floor(i / row), F.floor(i % row / channels), i % channels))


def bilinear(pixels: Column, y: Column, x: Column, channel: Column, height: Number, width: Number, channels: int) -> Column:
    """The value at (y, x), between four pixels."""
    y0, x0 = F.floor(y), F.floor(x)
    fy, fx = y - y0, x - x0
    corner = lambda dy, dx: pixel(pixels, mirrored(y0 + dy, height), mirrored(x0 + dx, width), channel, width, channels)
    top = corner(0, 0) * (1.0 - fx) * (1.0 - fy) + corner(0, 1) * fx * (1.0 - fy)
    return top + corner(1, 0) * (1.0 - fx) * fy + corner(1, 1) * fx * fy


def between(y: Column, x: Column, height: Number, width: Number, channels: int) -> Column:
    """Where (y, x) lies, for all channels: struct of the four pixels' places (p0 to p3, from 1) and its distances fy and fx."""
    y0, x0 = F.floor(y), F.floor(x)
    first = lambda dy, dx: ((mirrored(y0 + dy, height) * _c(width) + mirrored(x0 + dx, width)) * channels + 1).cast("int")
    corners = [first(dy, dx).alias(f"p{2 * dy + dx}") for dy in (0, 1) for dx in (0, 1)]
    return F.struct(*corners, (y - y0).alias("fy"), (x - x0).alias("fx"))


def weighed(pixels: Column, s: Column, channel: int) -> Column:
    """The value of a channel at a place that between told, as bilinear gives it."""
    part = lambda k: F.element_at(pixels, s[f"p{k}"] + channel)
    top = part(0) * (1.0 - s["fx"]) * (1.0 - s["fy"]) + part(1) * s["fx"] * (1.0 - s["fy"])
    return top + part(2) * (1.0 - s["fx"]) * s["fy"] + part(3) * s["fx"] * s["fy"]


def sampled(pixels: Column, height: Number, width: Number, channels: int, place: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Each pixel from its place (y, x) in the old image, bilinear between four pixels, rounded."""
    spots = each(height, width, channels, lambda y, x, c: F.struct(*[v.cast("double").alias(n) for v, n in zip(place(y, x), "yx", strict=True)], c.alias("c")))
    return F.transform(spots, lambda s: _byte(F.rint(bilinear(pixels, s["y"], s["x"], s["c"], height, width, channels))))


def rotated(pixels: Column, height: Number, width: Number, angle: Number, channels: int = 1, turn: tuple[Column, Column] | None = None) -> Column:
    """Turned counter-clockwise by angle degrees about the centre; turn is its cosine and sine, where they are known."""
    a, b = turn or (F.cos(F.radians(_c(angle))), F.sin(F.radians(_c(angle))))
    cy, cx = _c(height) / 2.0, _c(width) / 2.0
    return sampled(pixels, height, width, channels, lambda y, x: (b * (x - cx) + a * (y - cy) + cy, a * (x - cx) - b * (y - cy) + cx))


def shifted(pixels: Column, height: Number, width: Number, share_x: Number, share_y: Number, channels: int = 1) -> Column:
    """Moved right and down by shares of the width and height."""
    return sampled(pixels, height, width, channels, lambda y, x: (y - _c(share_y) * _c(height), x - _c(share_x) * _c(width)))


def enlarged(pixels: Column, height: Number, width: Number, scale: Number, channels: int = 1) -> Column:
    """By a scale of 1 or more: the middle of the image resized bilinearly, at its old size."""

    def along(k: Column, size: Column) -> Column:
        new = F.greatest(F.rint(size * _c(scale)), F.lit(1.0))
        at = (k + F.floor((new - size) / 2.0) + 0.5) * size / new - 0.5
        return F.least(F.greatest(at, F.lit(0.0)), size - 1.0)

    return sampled(pixels, height, width, channels, lambda y, x: (along(y, _c(height)), along(x, _c(width))))


def reduced(pixels: Column, height: Number, width: Number, scale: Number, channels: int = 1) -> Column:
    """By a scale below 1: resized by areas, in the middle of a mirrored border, at its old size."""

    def cells(k: Column, size: Column) -> Column:
        """(cell, share) of the old pixels that the k-th new one covers."""
        new = F.greatest(F.rint(size * _c(scale)), F.lit(1.0))
        at, step = mirrored(k - F.floor((size - new) / 2.0), new), size / new
        low, high = at * step, (at + 1) * step
        covered = F.sequence(F.floor(low).cast("int"), F.least(F.ceil(high), size).cast("int") - 1)
        return F.transform(covered, lambda i: F.struct(i.alias("i"), ((F.least(i + 1.0, high) - F.greatest(i * 1.0, low)) / step).alias("share")))

    def value(y: Column, x: Column, c: Column) -> Column:
        line = lambda cy: F.aggregate(cells(x, _c(width)), F.lit(0.0), lambda s, cx: s + cx["share"] * pixel(pixels, cy["i"], cx["i"], c, width, channels))
        return _byte(F.rint(F.aggregate(cells(y, _c(height)), F.lit(0.0), lambda s, cy: s + cy["share"] * line(cy))))

    return each(height, width, channels, value)


def listed(taps: np.ndarray) -> Column:
    """A table of numbers as taps: array<struct<y, x, k>>, places from the middle."""
    ry, rx = taps.shape[0] // 2, taps.shape[1] // 2
    return F.array(*[F.struct(F.lit(int(i - ry)).alias("y"), F.lit(int(j - rx)).alias("x"), F.lit(float(taps[i, j])).alias("k")) for i, j in zip(*np.nonzero(taps), strict=True)])


def gaussian_taps(size: Number, sigma: Number) -> Column:
    """A row of taps as array<double>, by an odd size and a deviation; with 0 a small size has its fixed row, a larger one a deviation by its size."""
    size, sigma = _c(size).cast("int"), _c(sigma).cast("double")
    spread = F.when(sigma > 0, sigma).otherwise(0.3 * ((size - 1) * 0.5 - 1.0) + 0.8)
    bell = bound(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.exp(-F.pow(i - F.floor(size / 2), F.lit(2)) / (2.0 * spread * spread))), lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(e, lambda x: x / s)))
    taps = F.when(F.lit(False), bell)
    for n, line in SMALL_KERNELS.items():
        taps = taps.when((sigma == 0) & (size == n), F.array(*[F.lit(x) for x in line]))
    return taps.otherwise(bell)


def motion_taps(size: Number, angle: Number) -> Column:
    """Taps of a line through the middle of a size x size square, turned by angle degrees: array<struct<y, x, k>>."""
    size, a, b = _c(size).cast("int"), F.cos(F.radians(_c(angle))), F.sin(F.radians(_c(angle)))
    middle = F.floor(size / 2)
    row = F.struct(size.alias("n"), middle.alias("c"), a.alias("a"), b.alias("b"))

    def weighed(r: Column) -> Column:
        def cell(k: Column) -> Column:
            y, x = F.floor(k / r["n"]) - r["c"], k % r["n"] - r["c"]
            along = r["a"] * x - r["b"] * y + r["c"]
            low = F.floor(along)
            inside = lambda i, share: F.when((i >= 0) & (i < r["n"]), share).otherwise(F.lit(0.0))
            across = F.greatest(1.0 - F.abs(r["b"] * x + r["a"] * y), F.lit(0.0))
            return F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), (across * (inside(low, 1.0 - (along - low)) + inside(low + 1, along - low))).alias("k"))

        return F.filter(F.transform(F.sequence(F.lit(0), r["n"] * r["n"] - 1), cell), lambda t: t["k"] > 0)

    point = F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("k")))
    share = lambda taps, total: F.transform(taps, lambda t: F.struct(t["y"].alias("y"), t["x"].alias("x"), (t["k"] / total).alias("k")))
    return bound(bound(row, weighed), lambda taps: bound(F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["k"]), lambda total: F.when(total > 0, share(taps, total)).otherwise(point)))


def convolved(pixels: Column, height: Number, width: Number, taps: Column | np.ndarray, channels: int = 1) -> Column:
    """Correlation with taps, an odd table of numbers or array<struct<y, x, k>>, as doubles."""
    if isinstance(taps, np.ndarray):
        return _convolved(pixels, height, width, listed(taps), channels)
    return bound(taps, lambda known: _convolved(pixels, height, width, known, channels))


def _convolved(pixels: Column, height: Number, width: Number, taps: Column, channels: int) -> Column:
    def value(y: Column, x: Column, c: Column) -> Column:
        return F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["k"] * pixel(pixels, mirrored(y + t["y"], height), mirrored(x + t["x"], width), c, width, channels))

    return each(height, width, channels, value)


def _crossed(pixels: Column, height: Number, width: Number, line: Column | np.ndarray, channels: int) -> Column:
    """Correlation with a row of taps, first down, then across, as doubles."""
    if isinstance(line, np.ndarray):
        down, across = line[:, None], line[None, :]
    else:
        place = lambda i: (i - F.floor(F.size(line) / 2)).cast("int")
        tap = lambda y, x, k: F.struct(y.alias("y"), x.alias("x"), k.alias("k"))
        down, across = F.transform(line, lambda k, i: tap(place(i), F.lit(0), k)), F.transform(line, lambda k, i: tap(F.lit(0), place(i), k))
    return bound(convolved(pixels, height, width, down, channels), lambda p: convolved(p, height, width, across, channels))


def blurred(pixels: Column, height: Number, width: Number, line: Column | np.ndarray, channels: int = 1) -> Column:
    """By a symmetric row of taps."""
    return F.transform(_crossed(pixels, height, width, line, channels), lambda v: _byte(F.rint(v)))


def smeared(pixels: Column, height: Number, width: Number, taps: Column | np.ndarray, channels: int = 1) -> Column:
    """By any table of taps, such as a motion's line."""
    return F.transform(convolved(pixels, height, width, taps, channels), lambda v: _byte(F.rint(v)))


def sharpened(pixels: Column, height: Number, width: Number, strength: Number, line: Column | np.ndarray, channels: int = 1) -> Column:
    """(1 + strength) times the image less strength times its blur."""
    return F.zip_with(pixels, _crossed(pixels, height, width, line, channels), lambda p, q: _byte(F.rint((1.0 + _c(strength)) * p - _c(strength) * q)))


def area_weights(old: Number, new: Number) -> Column:
    """For each of `new` cells the old ones that it covers: array<array<struct<i, k>>>."""
    old, new = _c(old).cast("int"), _c(new).cast("int")
    scale = old / new

    def cell(n: Column) -> Column:
        low, high = n * scale, (n + 1) * scale
        covered = F.sequence(F.floor(low).cast("int"), F.greatest(F.least(F.ceil(high), old).cast("int") - 1, F.floor(low).cast("int")))
        return F.transform(covered, lambda i: F.struct(i.alias("i"), ((F.least(i + 1.0, high) - F.greatest(i * 1.0, low)) / scale).alias("k")))

    return F.transform(F.sequence(F.lit(0), new - 1), cell)


def bilinear_weights(old: Number, new: Number) -> Column:
    """For each of `new` centres the two old ones beside it: array<array<struct<i, k>>>."""
    old, new = _c(old).cast("int"), _c(new).cast("int")

    def cell(n: Column) -> Column:
        at = F.least(F.greatest((n + 0.5) * (old / new) - 0.5, F.lit(0.0)), old - 1.0)
        low = F.floor(at).cast("int")
        return F.array(F.struct(low.alias("i"), (1.0 - (at - low)).alias("k")), F.struct(F.least(low + 1, old - 1).alias("i"), (at - low).alias("k")))

    return F.transform(F.sequence(F.lit(0), new - 1), cell)


def resized(pixels: Column, height: Number, width: Number, new_height: Number, new_width: Number, area: Column | bool, channels: int = 1) -> Column:
    """To any size, as doubles: by the areas that new pixels cover, or bilinear between centres; first down, then across.

    Both steps take a few old values for each new one, from lists of weights that are computed once a row.
    """
    by = lambda old, new: F.when(_c(area), area_weights(old, new)).otherwise(bilinear_weights(old, new))
    pick = lambda weights, n: F.element_at(weights, (n + 1).cast("int"))
    known = F.struct(by(height, new_height).alias("down"), by(width, new_width).alias("across"))

    def run(w: Column) -> Column:
        down = each(new_height, width, channels, lambda y, x, c: F.aggregate(pick(w["down"], y), F.lit(0.0), lambda s, t: s + t["k"] * pixel(pixels, t["i"], x, c, width, channels)))
        across = lambda p: each(new_height, new_width, channels, lambda y, x, c: F.aggregate(pick(w["across"], x), F.lit(0.0), lambda s, t: s + t["k"] * pixel(p, y, t["i"], c, width, channels)))
        return bound(down, across)

    return bound(known, run)


def uniform(key: Column, at: Column, seed: int) -> Column:
    """A number in (0, 1) for each key and place; 48 bits of MD5."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), at.cast("string")))
    return (F.conv(F.substring(mixed, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def noisy(pixels: Column, key: Column, sigma: Number, seed: int = 0) -> Column:
    """Normal noise added to every value, cut off; the draws depend on the key and the place alone."""
    normal = lambda i: F.sqrt(-2.0 * F.log(uniform(key, i, seed))) * F.cos(2.0 * F.pi() * uniform(key, i, seed + 1))
    return F.transform(pixels, lambda p, i: _byte(F.floor(F.least(F.greatest(p + _c(sigma) * normal(i), F.lit(0.0)), F.lit(255.0)))))


def speckled(pixels: Column, key: Column, share: Number, channels: int = 1, seed: int = 0) -> Column:
    """Pixels black or white, evenly, with a chance of `share`; all channels of a pixel alike."""

    def value(p: Column, i: Column) -> Column:
        at = F.floor(i / channels)
        return F.when(uniform(key, at, seed) >= _c(share), p).when(uniform(key, at, seed + 1) < 0.5, F.lit(255)).otherwise(F.lit(0)).cast("int")

    return F.transform(pixels, value)


def _cosines() -> list[float]:
    """basis[frequency * 8 + place] of the 8-point cosine transform."""
    k = np.arange(8)
    return (np.sqrt((1 + (k > 0)) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)).ravel().tolist()


def quantiser(table: list[int], quality: Column) -> Column:
    """A quantisation table at a quality of 1 to 100."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.transform(F.array(*[F.lit(t) for t in table]), lambda t: F.greatest(F.least(F.floor((t * scale + 50) / 100), F.lit(255)), F.lit(1)).cast("double"))


def _requantised(plane: Column, height: Column, width: Column, table: Column) -> Column:
    """Cosine blocks of 8 x 8 values around 0, quantised and put back; both sides are multiples of 8."""
    basis, inside = F.array(*[F.lit(x) for x in _cosines()]), F.sequence(F.lit(0), F.lit(63))
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))

    def through(values: Column, table: Column | None) -> Column:
        """Into cosines and quantised with a table, back from them without one."""
        forward = table is not None

        def value(y: Column, x: Column, _) -> Column:
            top, left, u, v = y - y % 8, x - x % 8, y % 8, x % 8

            def term(s: Column, k: Column) -> Column:
                i, j = F.floor(k / 8), k % 8
                weights = at(basis, u * 8 + i) * at(basis, v * 8 + j) if forward else at(basis, i * 8 + u) * at(basis, j * 8 + v)
                return s + weights * at(values, (top + i) * width + left + j)

            total = F.aggregate(inside, F.lit(0.0), term)
            return F.rint(total / at(table, u * 8 + v)) * at(table, u * 8 + v) if forward else total

        return each(height, width, 1, value)

    quantised = bound(table, lambda t: bound(plane, lambda p: through(p, t)))
    return bound(quantised, lambda kept: through(kept, None))


def recompressed(pixels: Column, height: Number, width: Number, quality: Number, luminance: list[int], chrominance: list[int], channels: int = 1) -> Column:
    """What quantisation of 8 x 8 cosine blocks at a quality leaves of an image; colour has half the resolution."""
    block = 8 if channels == 1 else 16  # colour is halved before it is cut
    tall, wide = (F.ceil(_c(n) / block) * block for n in (height, width))
    part = lambda y, x, c: pixel(pixels, mirrored(y, height), mirrored(x, width), F.lit(c), width, channels)
    luma = (lambda y, x: part(y, x, 0) * 1.0) if channels == 1 else (lambda y, x: 0.299 * part(y, x, 0) + 0.587 * part(y, x, 1) + 0.114 * part(y, x, 2))
    light = _requantised(each(tall, wide, 1, lambda y, x, _: luma(y, x) - 128.0), tall, wide, quantiser(luminance, _c(quality)))
    at = lambda a, y, x, w: F.element_at(a, (y * w + x + 1).cast("int"))
    if channels == 1:
        return bound(light, lambda a: each(height, width, 1, lambda y, x, _: _byte(F.rint(at(a, y, x, wide) + 128.0))))

    def colour(c: int, factor: float) -> Column:
        quarter = lambda y, x, _: sum((part(2 * y + i, 2 * x + j, c) - luma(2 * y + i, 2 * x + j)) * factor for i in (0, 1) for j in (0, 1)) / 4.0
        return _requantised(each(tall / 2, wide / 2, 1, quarter), tall / 2, wide / 2, quantiser(chrominance, _c(quality)))

    planes = F.array(light, colour(2, 0.564), colour(0, 0.713))

    def value(a: Column, y: Column, x: Column, c: Column) -> Column:
        light = at(F.element_at(a, 1), y, x, wide) + 128.0
        blue, red = (at(F.element_at(a, k), F.floor(y / 2), F.floor(x / 2), wide / 2) for k in (2, 3))
        mixed = F.when(c == 0, light + 1.403 * red).when(c == 1, light - 0.344 * blue - 0.714 * red).otherwise(light + 1.773 * blue)
        return _byte(F.rint(mixed))

    return bound(planes, lambda a: each(height, width, channels, lambda y, x, c: value(a, y, x, c)))
