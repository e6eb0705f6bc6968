"""Attention maps of images cut into tokens: the class token first, then patches row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def head_weights(tokens: DataFrame, heads: int, scale: float = 1.0) -> DataFrame:
    """(image, head, row, col, weight) of tokens(image, token, vector): softmax of scaled products, the vectors cut into heads.

    Each token meets the tokens of its own image alone, of which a model has a fixed number; products stay in the JVM.
    Rows of the result sum to 1 over col.
    """
    if heads < 1:
        raise ValueError(f"heads must be positive, got {heads}")
    cut = F.floor(F.size("vector") / heads).cast("int")
    parts = tokens.select("image", "token", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice("vector", h * cut + 1, cut))).alias("head", "part"))
    left, right = parts.select("image", "head", F.col("token").alias("row"), F.col("part").alias("_q")), parts.select("image", "head", F.col("token").alias("col"), F.col("part").alias("_k"))
    product = F.aggregate(F.zip_with("_q", "_k", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = left.join(right, ["image", "head"]).select("image", "head", "row", "col", (product * scale / F.sqrt(F.size("_q"))).alias("_z"))
    tops = scored.groupBy("image", "head", "row").agg(F.max("_z").alias("_top"), F.array_sort(F.collect_list(F.struct("col", "_z"))).alias("_all"))
    shares = F.transform("_all", lambda c: F.struct(c["col"].alias("col"), F.exp(c["_z"] - F.col("_top")).alias("e")))
    total = F.aggregate("_shares", F.lit(0.0), lambda s, c: s + c["e"])
    summed = tops.select("image", "head", "row", shares.alias("_shares")).withColumn("_total", total)
    return summed.select("image", "head", "row", F.inline("_shares"), "_total").select("image", "head", "row", "col", (F.col("e") / F.col("_total")).alias("weight"))


def mean_maps(weights: DataFrame) -> DataFrame:
    """(image, row, col, weight): weights(image, layer, head, row, col, weight) averaged over heads, then over layers."""
    layers = weights.groupBy("image", "layer", "row", "col").agg(F.avg("weight").alias("weight"))
    return layers.groupBy("image", "row", "col").agg(F.avg("weight").alias("weight"))


def class_grids(maps: DataFrame) -> DataFrame:
    """(image, y, x, weight): what the class token, token 0, pays to each patch, on a square grid.

    Fails at run time for an image whose patches don't fill a square.
    """
    own = maps.where("row = 0 AND col > 0")
    sizes = own.groupBy("image").agg(F.count("*").alias("_n"), F.max("col").alias("_last"))
    side = F.round(F.sqrt("_n")).cast("int")
    square = (side * side == F.col("_n")) & (F.col("_last") == F.col("_n"))
    refused = F.raise_error(F.concat(F.lit("patches don't fill a square: "), F.col("_n").cast("string")))
    known = sizes.select("image", F.when(square, side).otherwise(refused.cast("int")).alias("_side"))
    at = F.col("col") - 1
    return own.join(known, "image").select("image", F.floor(at / F.col("_side")).cast("int").alias("y"), (at % F.col("_side")).cast("int").alias("x"), "weight")
