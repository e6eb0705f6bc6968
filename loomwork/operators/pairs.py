"""Identity pairs, representatives, resumption and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.session import materialise


def unordered_pairs(identities: DataFrame, group: str, identity: str, limit: int | None = None) -> DataFrame:
    """(group, identity_a, identity_b) for all pairs a < b of distinct identities of a group.

    With a limit, only the first pairs in order are made: identity a's pairs start after those of all before
    it, so positions follow from a rank and a count, and identities past the limit join nothing.
    """
    distinct = identities.select(F.col(group).alias("group"), F.col(identity).alias("identity")).where("identity IS NOT NULL").distinct()
    if limit is None:
        left, right = distinct.withColumnRenamed("identity", "identity_a"), distinct.withColumnRenamed("identity", "identity_b")
        return left.join(right, "group").where("identity_a < identity_b").withColumnRenamed("group", group)
    order = Window.partitionBy("group").orderBy("identity")
    ranked = distinct.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("group")))
    first = F.col("i").cast("long")
    start = first * (F.col("n") - 1) - F.floor(first * (first - 1) / 2)
    need = ranked.withColumn("start", start).where(F.col("start") < limit)
    left = need.select("group", F.col("identity").alias("identity_a"), F.col("i").alias("i_a"), "start")
    right = ranked.where(F.col("i") <= limit).select("group", F.col("identity").alias("identity_b"), F.col("i").alias("i_b"))
    joined = left.join(right, "group").where((F.col("i_a") < F.col("i_b")) & (F.col("start") + F.col("i_b") - F.col("i_a") <= limit))
    return joined.select(F.col("group").alias(group), "identity_a", "identity_b")


def representative(items: DataFrame, keys: list[str], item: str, seed: int = 0) -> DataFrame:
    """One item for each key, the one of the least seeded hash; ties to the smaller item. A partial aggregate, no sort."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    return items.groupBy(*keys).agg(F.min_by(item, F.struct(hashed, item)).alias(item))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def skipped(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run need not do again."""
    return wanted.join(done.select(key).distinct(), key, "left_semi")


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(side, key): values missing from actual, and values that were not expected."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    return pending(want, have, key).select(F.lit("missing").alias("side"), key).unionByName(pending(have, want, key).select(F.lit("extra").alias("side"), key))


def keep_last(rows: DataFrame, order: str, k: int, by: list[str]) -> DataFrame:
    """The k rows of each group with the greatest order, such as the newest checkpoints of each run."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= k).drop("_r")


def batches(rows: DataFrame, size: int, order: Column, drop_last: bool = False, bucket_rows: int = 50_000) -> DataFrame:
    """rows with batch_id: numbered by `order`, such as a hash, without a window over all of them.

    Ranges of the order of about bucket_rows rows are numbered inside, a window over their counts offsets them.
    """
    keyed = materialise(rows.withColumn("_h", order), "ordered-rows")
    buckets = max(1, -(-keyed.count() // bucket_rows))
    keyed = keyed.withColumn("_b", F.lit(0))
    if buckets > 1:
        keyed = materialise(keyed.repartitionByRange(buckets, "_h").withColumn("_b", F.spark_partition_id()), "ordered-buckets")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    starts = F.broadcast(starts.drop("_n")) if buckets <= 10_000 else starts.drop("_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1
    numbered = keyed.withColumn("_i", rank).join(starts, "_b").withColumn("_i", F.col("_i") + F.col("_start"))
    kept = numbered.where(F.col("_i") < F.col("_all") - F.col("_all") % size) if drop_last else numbered
    return kept.withColumn("batch_id", F.floor(F.col("_i") / size).cast("long")).drop("_h", "_b", "_i", "_start", "_all")
