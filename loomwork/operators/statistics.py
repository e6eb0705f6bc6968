"""Statistics of splits and of image inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomwork.functions.metrics import ratio
from loomwork.operators.split import BONA_FIDE, MORPH, SPLITS


def split_statistics(assigned: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row per split, empty ones too, and one for all: images, labels, identities, share and class balance.

    class_balance maps each label to its share, in label order. Identities are counted by their
    sets of splits, so one identity's many images are folded before they are shuffled, once for all counts.
    """
    names = assigned.sparkSession.createDataFrame([(s,) for s in (*splits, "overall")], "split string")
    both = F.explode(F.array(F.col("split"), F.lit("overall"))).alias("split")
    rows = assigned.select(both, "label")
    counts = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    shares = counts.groupBy("split").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("label") == BONA_FIDE, F.col("n"))), F.lit(0)).alias("bona_fide_count"),
        F.coalesce(F.sum(F.when(F.col("label") == MORPH, F.col("n"))), F.lit(0)).alias("morph_count"),
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("_labels"),
    )
    identities = (
        assigned.select(F.explode("identities").alias("identity"), "split")
        .groupBy("identity")
        .agg(F.collect_set("split").alias("splits"))
        .select(F.explode(F.array_union("splits", F.array(F.lit("overall")))).alias("split"))
        .groupBy("split")
        .agg(F.count("*").alias("identity_count"))
    )
    return _shared(names, shares, identities)


def member_statistics(members: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """split_statistics of what split_members found, for morphs with both identities: one aggregate over identities, their images are counted already."""
    names = members.sparkSession.createDataFrame([(s,) for s in (*splits, "overall")], "split string")
    found = members.groupBy("split").agg(F.sum("bona_fide").alias("b"), F.sum("morphs").alias("m"), F.count("*").alias("i"))
    both = found.select(F.explode(F.array("split", F.lit("overall"))).alias("split"), "b", "m", "i").groupBy("split")
    sums = both.agg(F.sum("b").alias("bona_fide_count"), F.sum("m").alias("morph_count"), F.sum("i").alias("identity_count"))
    label = lambda name, n: F.struct(F.lit(name).alias("label"), F.col(n).alias("n"))
    labels = F.filter(F.array(label(BONA_FIDE, "bona_fide_count"), label(MORPH, "morph_count")), lambda x: x["n"] > 0)
    counted = sums.select("*", (F.col("bona_fide_count") + F.col("morph_count")).alias("total_count"), labels.alias("_labels"))
    return _shared(names, counted, None)


def _shared(names: DataFrame, shares: DataFrame, identities: DataFrame | None) -> DataFrame:
    """The rows of split_statistics from shares(split, total_count, bona_fide_count, morph_count, _labels) and identities(split, identity_count), or shares that have identity_count too."""
    total = F.max("total_count").over(_everything())
    balance = F.map_from_entries(F.transform("_labels", lambda x: F.struct(x["label"], x["n"] / F.col("total_count"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    known = names.join(shares, "split", "left")
    return (
        (known if identities is None else known.join(identities, "split", "left"))
        .select(
            "split",
            *[zero(c) for c in ("total_count", "bona_fide_count", "morph_count", "identity_count")],
            ratio(100.0 * F.coalesce(F.col("total_count"), F.lit(0)), total, 0.0).alias("percentage_of_dataset"),
            F.coalesce(balance, F.create_map().cast("map<string,double>")).alias("class_balance"),
        )
    )


def _everything():
    return Window.partitionBy(F.lit(0))  # over the four rows of split names


def identity_inventory(images: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Per (dataset_root, identity): image_count, formats, resolutions, corrupted_count.

    images(dataset_root, identity, format, width, height, corrupted); identities lists those that must
    appear even without images.
    """
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height"))
    found = images.groupBy("dataset_root", "identity").agg(
        F.count("*").alias("image_count"),
        F.array_sort(F.collect_set("format")).alias("formats"),
        F.array_sort(F.collect_set(size)).alias("resolutions"),
        F.count_if("corrupted").alias("corrupted_count"),
    )
    if identities is None:
        return found
    none = F.array().cast("array<string>")
    return identities.select("dataset_root", "identity").distinct().join(found, ["dataset_root", "identity"], "left").select(
        "dataset_root",
        "identity",
        F.coalesce("image_count", F.lit(0)).cast("long").alias("image_count"),
        F.coalesce("formats", none).alias("formats"),
        F.coalesce("resolutions", none).alias("resolutions"),
        F.coalesce("corrupted_count", F.lit(0)).cast("long").alias("corrupted_count"),
    )


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """One row over identities: totals, least, most, mean and median images, distinct formats and resolutions; zeros if empty."""
    n = F.col("image_count")
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    values = inventory.select(F.explode("formats").alias("v")).distinct().agg(F.array_sort(F.collect_list("v")).alias("unique_formats"))
    sizes = inventory.select(F.explode("resolutions").alias("v")).distinct().agg(F.array_sort(F.collect_list("v")).alias("unique_resolutions"))
    totals = inventory.agg(
        F.count_distinct("dataset_root").alias("total_datasets"),
        F.count("*").alias("total_identities"),
        number(F.sum(n), "total_images"),
        number(F.sum("corrupted_count"), "total_corrupted"),
        number(F.min(n), "min_images"),
        number(F.max(n), "max_images"),
        F.coalesce(F.round(F.avg(n), 2), F.lit(0.0)).alias("mean_images"),
        F.coalesce(F.round(F.median(n), 2), F.lit(0.0)).alias("median_images"),
    )
    return totals.join(F.broadcast(values)).join(F.broadcast(sizes))  # one row each


def component_counts(placed: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(split, component_count) of placed(identity, component, split), empty splits and all together too."""
    names = placed.sparkSession.createDataFrame([(s,) for s in (*splits, "overall")], "split string")
    distinct = placed.select("component", "split").distinct().select(F.explode(F.array("split", F.lit("overall"))).alias("split"), "component").distinct()
    counts = distinct.groupBy("split").agg(F.count("*").alias("component_count"))
    return names.join(counts, "split", "left").select("split", F.coalesce("component_count", F.lit(0)).cast("long").alias("component_count"))


def statistics_rows(stats: DataFrame) -> DataFrame:
    """split_statistics for a flat file: numbers with four places, class_balance as label:share joined by ;, empty for all splits together."""
    share = lambda x: F.format_string("%.4f", x)
    balance = F.array_join(F.transform(F.array_sort(F.map_entries("class_balance")), lambda e: F.concat_ws(":", e["key"], share(e["value"]))), ";")
    return stats.withColumn("percentage_of_dataset", share(F.col("percentage_of_dataset"))).withColumn("class_balance", F.when(F.col("split") == "overall", "").otherwise(balance))


def run_report(outcomes: DataFrame, status: str = "status", reason: str = "reason", shown: int = 20) -> DataFrame:
    """(status, n, reasons): rows of a run by status, and the commonest reasons of each, with how often each occurs, at most `shown`."""
    counts = outcomes.groupBy(F.col(status).alias("status"), F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n"), "reason")))
    listed = F.array_sort(F.collect_list(F.when((F.col("_r") <= shown) & F.col("reason").isNotNull(), F.struct("_r", "reason", "n"))))
    named = F.transform(listed, lambda x: F.concat_ws(": ", x["reason"], x["n"].cast("string")))
    return ranked.groupBy("status").agg(F.sum("n").alias("n"), named.alias("reasons"))


def run_summary(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """(status, n) of a run's rows."""
    return outcomes.groupBy(status).agg(F.count("*").alias("n"))
