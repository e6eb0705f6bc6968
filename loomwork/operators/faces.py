"""Pixels for models: upright face crops, and normalised channel-first inputs; columns, only eye angles reach Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions import geometry, pixels, warps

# Mean and deviation of the red, green and blue channel that pretrained backbones expect.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_DEVIATION = (0.229, 0.224, 0.225)


def readable(data: Column, height: Column, width: Column) -> Column:
    """Whether the bytes are those of three channels; false for null."""
    return F.coalesce((F.octet_length(data) == height * width * 3) & (height > 0) & (width > 0), F.lit(False))


def _bytes(values: Column) -> Column:
    return F.transform(values, lambda v: pixels._byte(F.rint(v)))


def crop_faces(images: DataFrame, key: str = "path", size: int = 224, threshold: float = 0.9, margin: float = 0.3, swap_channels: bool = False) -> DataFrame:
    """images(key, height, width, data, detections) as (key, data, angle, success, failure_reason); no shuffle.

    The largest good face is chosen; the image is turned by the angle of its eyes, mirrored at its edges, cut to the
    face's box and resized by area to size x size. Rows without a face or with unreadable pixels have a reason and no data.
    """
    found = geometry.align(images, threshold=threshold, margin=margin)
    good = readable(F.col("data"), F.col("height"), F.col("width"))
    cosine, sine = geometry.turn(F.col("angle"))
    ready = found.select(
        F.col(f"`{key}`").alias("_key"), "height", "width", "angle", cosine.alias("_a"), sine.alias("_b"), "crop", "failure_reason", good.alias("_good"),
        F.when(F.col("success") & good, pixels.unpacked(F.col("data"))).alias("_pixels"),
    )
    height, width, crop = F.col("height"), F.col("width"), F.col("crop")
    upright = warps.rotated(F.col("_pixels"), height, width, F.col("angle"), 3, (F.col("_a"), F.col("_b")))
    tall, wide = (crop["y2"] - crop["y1"]), (crop["x2"] - crop["x1"])
    inside = lambda p: warps.each(tall, wide, 3, lambda y, x, c: warps.pixel(p, y + crop["y1"], x + crop["x1"], c, width, 3))
    cut = warps.bound(upright, inside)
    face = warps.bound(cut, lambda p: _bytes(warps.resized(p, tall, wide, size, size, True, 3)))
    if swap_channels:
        face = warps.bound(face, lambda p: warps.each(size, size, 3, lambda y, x, c: warps.pixel(p, y, x, 2 - c, size, 3)))
    made = ready.withColumn("data", F.when(F.col("_pixels").isNotNull(), pixels.packed(face)))
    reason = F.coalesce("failure_reason", F.when(~F.col("_good"), "unreadable image"))
    angle = F.when(F.col("failure_reason").isNull(), F.col("angle"))
    return made.select(F.col("_key").alias(key), "data", angle.alias("angle"), reason.isNull().alias("success"), reason.alias("failure_reason"))


def model_inputs(images: DataFrame, key: str = "path", size: int = 224, flip_share: float = 0.0, seed: int = 0) -> DataFrame:
    """images(key, height, width, data) as (key, values): size x size, channels first, normalised; null if unreadable.

    Larger images are resized by area, others bilinearly. For training, a share of the images is mirrored left to right;
    which ones depends on the key and the seed.
    """
    if size <= 0:
        raise ValueError(f"size must be positive, got {size}")
    named, height, width = F.col(f"`{key}`"), F.col("height"), F.col("width")
    chance = F.pmod(F.xxhash64(F.lit(seed), named), F.lit(1 << 30)) / F.lit(float(1 << 30))
    good = readable(F.col("data"), height, width)
    ready = images.select(named.alias("_key"), "height", "width", (chance < flip_share).alias("_flip"), F.when(good, pixels.unpacked(F.col("data"))).alias("_pixels"))
    small = warps.resized(F.col("_pixels"), height, width, size, size, F.least(height, width) > size, 3)
    share = lambda p, y, x, c: warps.pixel(p, y, x, c, size, 3) / 255.0
    means, deviations = (F.array(*[F.lit(v) for v in row]) for row in (CHANNEL_MEAN, CHANNEL_DEVIATION))

    def value(p: Column, i: Column) -> Column:
        c, y, x = F.floor(i / (size * size)), F.floor(i % (size * size) / size), i % size
        x = F.when(F.col("_flip"), size - 1 - x).otherwise(x)
        of = lambda a: F.element_at(a, (c + 1).cast("int"))
        return ((share(p, y, x, c) - of(means)) / of(deviations)).cast("float")

    values = warps.bound(_bytes(small), lambda p: F.transform(F.sequence(F.lit(0), F.lit(3 * size * size - 1)), lambda i: value(p, i)))
    return ready.select(F.col("_key").alias(key), F.when(F.col("_pixels").isNotNull(), values).alias("values"))
