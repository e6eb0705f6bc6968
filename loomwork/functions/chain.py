"""Chains of kernels over images as one plan of columns: every row draws its gates and parameters by hash; no Python worker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions import kernels, pixels, warps

#: A parameter from a number in (0, 1).
Draw = Callable[[Column], Column]


@dataclass(frozen=True)
class Image:
    """What a kernel sees of a row: pixels as array<int>, row by row, channels interleaved, and a key for draws by place."""

    pixels: Column
    height: Column
    width: Column
    key: Column
    channels: int


@dataclass(frozen=True)
class Kernel:
    """apply(image, parameters) gives the new pixels: an array<int> of the old size, or null if the kernel fails."""

    apply: Callable[[Image, dict[str, Column]], Column]
    draws: dict[str, Draw] = field(default_factory=dict)


def between(low: float, high: float) -> Draw:
    if low > high:
        raise ValueError(f"{low} is above {high}")
    return lambda u: F.lit(float(low)) + F.lit(float(high - low)) * u


def whole(low: int, high: int) -> Draw:
    """A whole number, both ends included."""
    if low > high:
        raise ValueError(f"{low} is above {high}")
    return lambda u: F.lit(low) + F.floor(F.lit(high - low + 1) * u)


def odd(low: int, high: int) -> Draw:
    if low % 2 == 0 or high % 2 == 0 or not 1 <= low <= high:
        raise ValueError("kernel sizes must be odd and ascending")
    return lambda u: F.lit(low) + 2 * F.floor(F.lit((high - low) // 2 + 1) * u)


def _average(image: Image) -> Column:
    return pixels.mean(pixels.gray(image.pixels) if image.channels == 3 else image.pixels)


def _scaled(i: Image, p: dict[str, Column]) -> Column:
    size = (i.pixels, i.height, i.width, p["scale"], i.channels)
    return F.when(p["scale"] < 1, warps.reduced(*size)).otherwise(warps.enlarged(*size))


def default_kernels() -> dict[str, Kernel]:
    """All kernels with their default ranges."""
    sized = lambda i: (i.pixels, i.height, i.width)
    soft = lambda i, p: warps.blurred(*sized(i), warps.gaussian_taps(p["kernel_size"], p.get("sigma", F.lit(0.0))), i.channels)
    return {
        "rotation": Kernel(lambda i, p: warps.rotated(*sized(i), p["angle"], i.channels), {"angle": between(-15, 15)}),
        "translation": Kernel(lambda i, p: warps.shifted(*sized(i), p["tx_percent"], p["ty_percent"], i.channels), {"tx_percent": between(-0.1, 0.1), "ty_percent": between(-0.1, 0.1)}),
        "scaling": Kernel(_scaled, {"scale": between(0.9, 1.1)}),
        "horizontal_flip": Kernel(lambda i, p: pixels.flipped(i.pixels, i.width, i.channels)),
        "brightness": Kernel(lambda i, p: pixels.brightened(i.pixels, p["factor"]), {"factor": between(0.7, 1.3)}),
        "contrast": Kernel(lambda i, p: warps.bound(_average(i), lambda m: pixels.contrasted(i.pixels, p["factor"], m)), {"factor": between(0.7, 1.3)}),
        "contrast_rounded": Kernel(lambda i, p: warps.bound(_average(i), lambda m: pixels.contrasted_rounded(i.pixels, p["factor"], m)), {"factor": between(0.7, 1.3)}),
        "gamma": Kernel(lambda i, p: pixels.gamma_corrected(i.pixels, p["gamma"]), {"gamma": between(0.7, 1.5)}),
        "gaussian_blur": Kernel(soft, {"kernel_size": odd(3, 11)}),
        "gaussian_blur_random": Kernel(soft, {"kernel_size": odd(3, 9), "sigma": between(0.1, 2.0)}),
        "motion_blur": Kernel(lambda i, p: warps.smeared(*sized(i), warps.motion_taps(p["kernel_size"], p["angle"]), i.channels), {"kernel_size": odd(3, 9), "angle": between(0, 180)}),
        "gaussian_noise": Kernel(lambda i, p: warps.noisy(i.pixels, i.key, p["sigma"]), {"sigma": between(2, 15)}),
        "salt_pepper": Kernel(lambda i, p: warps.speckled(i.pixels, i.key, p["noise_probability"], i.channels), {"noise_probability": between(0.01, 0.05)}),
        "jpeg_compression": Kernel(lambda i, p: warps.recompressed(*sized(i), p["quality"], kernels.LUMINANCE, kernels.CHROMINANCE, i.channels), {"quality": whole(30, 90)}),
        "sharpen": Kernel(lambda i, p: warps.sharpened(*sized(i), p["strength"], kernels.gaussian_line(19, 3.0), i.channels), {"strength": between(0.5, 2.0)}),
    }


def checked(names: list[str], known: dict[str, Kernel], probability: float) -> None:
    """ValueError for a name that isn't known or a share that is none."""
    if not 0 <= probability <= 1:
        raise ValueError("probability must be between 0 and 1")
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown kernels: {', '.join(missing)}")


def _on_row(kernel: Kernel, channels: int) -> Callable[[Column], Column]:
    return lambda row: kernel.apply(Image(row["_pixels"], row["_height"], row["_width"], row["_key"], channels), {what: row[what] for what in kernel.draws})


def apply_chain(
    images: DataFrame, names: list[str], key: Column, known: dict[str, Kernel] | None = None, seed: int = 0, probability: float = 0.5, channels: int = 3
) -> DataFrame:
    """images(height, width, pixels, ...) with pixels after the chain, applied, parameters and error added.

    A kernel runs where a number drawn by (seed, key, name) is below the probability; its parameters are drawn likewise, so
    nothing depends on the order of rows or on the other kernels. A kernel that gives null, nulls or another number of
    pixels leaves the image as it was, is not in applied, and is told in error; the chain goes on.

    Cases: pixels that are null, hold nulls or aren't height * width * channels come back as null with the error
    "unreadable image" and nothing applied; a name listed twice runs twice, with the same draws.
    """
    known = default_kernels() if known is None else known
    checked(names, known, probability)
    good = (F.size("pixels") == F.col("height") * F.col("width") * channels) & (F.col("height") > 0) & (F.col("width") > 0) & ~F.exists("pixels", lambda p: p.isNull())
    rest = [F.col(f"`{c}`") for c in images.columns if c not in ("pixels", "applied", "parameters", "error")]
    none = F.array().cast("array<string>")
    state = images.select(*rest, F.when(good, F.col("pixels")).alias("pixels"), key.cast("string").alias("_key"), none.alias("applied"), none.alias("_errors"), F.create_map().cast("map<string,double>").alias("parameters"))
    for name in names:
        kernel = known[name]
        drawn = {what: warps.uniform(F.col("_key"), F.lit(f"{name}.{what}"), seed) for what in ("gate", *kernel.draws)}
        given = [draw(drawn[what]).cast("double").alias(what) for what, draw in kernel.draws.items()]
        # The pixels and what is drawn are bound once a row: inside the kernel's lambdas they would be computed for each pixel.
        whole_row = F.struct(F.col("pixels").alias("_pixels"), F.concat_ws(":", "_key", F.lit(name)).alias("_key"), F.col("height").alias("_height"), F.col("width").alias("_width"), *given)
        gate = F.col("pixels").isNotNull() & (drawn["gate"] < probability)
        stepped = state.withColumn("_gate", gate).withColumn("_draws", F.when(F.col("_gate"), whole_row)).withColumn("_new", F.when(F.col("_gate"), warps.bound(F.col("_draws"), _on_row(kernel, channels))))
        fine = F.coalesce((F.size("_new") == F.size("pixels")) & ~F.exists("_new", lambda p: p.isNull()), F.lit(False))
        stepped = stepped.withColumn("_fine", F.col("_gate") & fine)
        numbers = F.map_from_arrays(F.array(*[F.lit(f"{name}.{w}") for w in kernel.draws]), F.array(*[F.col("_draws")[w] for w in kernel.draws]))
        state = stepped.select(
            *rest,
            F.when(F.col("_fine"), F.col("_new")).otherwise(F.col("pixels")).alias("pixels"),
            "_key",
            F.when(F.col("_fine"), F.array_append("applied", F.lit(name))).otherwise(F.col("applied")).alias("applied"),
            F.when(F.col("_gate") & ~F.col("_fine"), F.array_append("_errors", F.lit(f"{name}: no image of the old size"))).otherwise(F.col("_errors")).alias("_errors"),
            (F.when(F.col("_fine"), F.map_from_entries(F.array_distinct(F.concat(F.map_entries("parameters"), F.map_entries(numbers))))).otherwise(F.col("parameters")) if kernel.draws else F.col("parameters")).alias("parameters"),
        )
    error = F.when(F.col("pixels").isNull(), "unreadable image").when(F.size("_errors") > 0, F.array_join("_errors", "; "))
    return state.select(*rest, "pixels", "applied", "parameters", error.alias("error"))


def augment(images: DataFrame, names: list[str] | None = None, known: dict[str, Kernel] | None = None, seed: int = 0, probability: float = 0.5, copies: int = 1) -> DataFrame:
    """images(path, height, width, data) as (path, copy, height, width, data, applied, parameters, error), `copies` rows an image.

    data are the bytes of three channels. Gates and parameters depend on path, copy and seed alone.
    """
    known = default_kernels() if known is None else known
    names = sorted(known) if names is None else names
    copied = images.select("path", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "height", "width", pixels.unpacked(F.col("data")).alias("pixels"))
    done = apply_chain(copied, names, F.concat_ws(":", "path", "copy"), known, seed, probability)
    return done.select("path", "copy", "height", "width", pixels.packed(F.col("pixels")).alias("data"), "applied", "parameters", "error")
