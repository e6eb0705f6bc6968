"""Identity-disjoint train, validation and test splits: whole components, greedily filled."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.operators.graph import components_of_pairs
from loomwork.session import materialise

SPLITS = ("train", "val", "test")
BONA_FIDE, MORPH = "bona_fide", "morph"
#: Components that the exact shuffle takes at most, as it numbers them on the driver.
EXACT_ROWS = 1_000_000


@dataclass(frozen=True)
class SplitRatios:
    """Shares of the three splits, each at least 0 and 1 together."""

    train: float = 0.7
    val: float = 0.15
    test: float = 0.15

    def __post_init__(self):
        if min(self.train, self.val, self.test) < 0:
            raise ValueError("split ratios must not be negative")
        if not math.isclose(self.train + self.val + self.test, 1.0, abs_tol=1e-6):
            raise ValueError(f"split ratios must sum to 1, not {self.train + self.val + self.test}")

    def of(self, split: str) -> float:
        return getattr(self, split)


def counted_components(bona_fide: DataFrame, morphs: DataFrame) -> DataFrame:
    """(identity, component, bona_fide, morphs) from bona_fide(identity, ...) and morphs(identity_a, identity_b, ...).

    Identities without a morph partner, and those only morphed with themselves, are components of their own. component is the
    least identity; bona_fide counts the identity's own images and morphs those that name it first. Rows are summed
    by identity before they meet the components.
    """
    linked = components_of_pairs(morphs.select(F.col("identity_a").alias("a"), F.col("identity_b").alias("b"))).withColumnRenamed("vertex", "identity")
    row = lambda c, own, first: (F.col(c).alias("identity"), F.lit(own).alias("o"), F.lit(first).alias("f"))
    ones = bona_fide.select(*row("identity", 1, 0)).unionByName(morphs.select(*row("identity_a", 0, 1))).unionByName(morphs.select(*row("identity_b", 0, 0)))
    everyone = ones.where("identity IS NOT NULL").groupBy("identity").agg(F.sum("o").alias("bona_fide"), F.sum("f").alias("morphs"))
    return everyone.join(linked, "identity", "left").select("identity", F.coalesce("component", "identity").alias("component"), "bona_fide", "morphs")


def weighted_components(bona_fide: DataFrame, morphs: DataFrame) -> DataFrame:
    """(identity, component, images): counted_components with both kinds of images together."""
    return counted_components(bona_fide, morphs).select("identity", "component", (F.col("bona_fide") + F.col("morphs")).alias("images"))


def components(bona_fide: DataFrame, morphs: DataFrame) -> DataFrame:
    """(identity, component) for every identity of either table."""
    return weighted_components(bona_fide, morphs).select("identity", "component")


def component_sizes(weighted: DataFrame) -> DataFrame:
    """(component, images) of weighted(identity, component, images)."""
    return weighted.groupBy("component").agg(F.sum("images").alias("images"))


def seeded_order(component: Column, seed: int | None) -> Column:
    """Order of components: by hash of the seed, or as they are without one."""
    return component if seed is None else F.xxhash64(F.lit(seed), component)


def shuffled(count: int, seed: int) -> list[int]:
    """The order that Python's own seeded shuffle gives to so many components, for small sets only."""
    order = list(range(count))
    random.Random(seed).shuffle(order)
    return order


def shuffled_sizes(sizes: DataFrame, seed: int) -> DataFrame:
    """sizes with turn: the place of each component in Python's own seeded shuffle of all in ascending order.

    ValueError for more than EXACT_ROWS of them, before any id reaches the driver.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)["component"]
    count = sizes.count()
    if count > EXACT_ROWS:
        raise ValueError(f"the exact shuffle takes at most {EXACT_ROWS:,} components, not {count:,}; leave it out for the order by hash")
    turns = shuffled(count, seed)
    place = [0] * len(turns)
    for turn, k in enumerate(turns):
        place[k] = turn
    numbered = [(row["component"], place[k]) for k, row in enumerate(sizes.select("component").orderBy("component").toLocalIterator())]
    return sizes.join(spark.createDataFrame(numbered, f"component {kind}, turn long"), "component")


def assign(sizes: DataFrame, ratios: SplitRatios, order: Column, block_rows: int = 1_000_000) -> DataFrame:
    """(component, images, split): each component in order goes to the split with the least images per ratio.

    The choice is made before the component's own images count; equal levels go to the first of train, val
    and test; a split of ratio 0 gets nothing. This is one sequence of choices at every size: components are
    cut by their order into blocks of about block_rows, and each block is a job of one bounded task that
    starts from the images that the blocks before it gave to each split.
    """
    shares = [(s, ratios.of(s)) for s in SPLITS if ratios.of(s) > 0]
    keyed = sizes.select("component", "images", order.alias("_order"))
    blocks = max(1, -(-keyed.count() // block_rows))
    kind = dict(sizes.dtypes)["component"]

    def filled(rows: DataFrame, start: dict[str, int]) -> DataFrame:
        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, under = [s for s, _ in shares], [share for _, share in shares]
            used = [start[s] for s in names]
            levels = [u / share for u, share in zip(used, under, strict=True)]
            for batch in batches:
                chosen = []
                for images in batch["images"].tolist():
                    k = levels.index(min(levels))
                    used[k] += images
                    levels[k] = used[k] / under[k]
                    chosen.append(names[k])
                yield pd.DataFrame({"component": batch["component"], "images": batch["images"], "split": chosen})

        return rows.repartition(1).sortWithinPartitions("_order", "component").mapInPandas(fill, f"component {kind}, images long, split string")

    used = dict.fromkeys((s for s, _ in shares), 0)
    if blocks == 1:
        return filled(keyed, used)
    ranged = materialise(keyed.repartitionByRange(blocks, "_order", "component").withColumn("_block", F.spark_partition_id()), "split-blocks")
    done = []
    for row in ranged.select("_block").distinct().orderBy("_block").collect():
        done.append(materialise(filled(ranged.where(F.col("_block") == row["_block"]), used), "split-block"))
        for r in done[-1].groupBy("split").agg(F.sum("images").alias("images")).collect():
            used[r["split"]] += r["images"]
    return reduce(DataFrame.unionByName, done)


def split_members(bona_fide: DataFrame, morphs: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int | None = None) -> DataFrame:
    """(component, identity, bona_fide, morphs, split): each identity's split and numbers of images, without the images' rows."""
    members = materialise(counted_components(bona_fide, morphs), "members")
    sizes = materialise(component_sizes(members.withColumn("images", F.col("bona_fide") + F.col("morphs"))), "component-sizes")
    chosen = assign(sizes, ratios, seeded_order(F.col("component"), seed)).select("component", "split")
    return members.join(chosen, "component").select("component", "identity", "bona_fide", "morphs", "split")


def split_dataset(
    bona_fide: DataFrame, morphs: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int | None = None, exact: bool = False, stored: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(assignments, component_splits): each image with its split, label and identities; each identity with its component and split.

    Members, sizes and places are written once, so that any use of either table starts from there; so are the given tables,
    unless they are `stored`: read from files by narrow steps alone. `exact` gives the order that Python's own shuffle of all
    components in their first order has, instead of one by hash; it numbers the components on the driver and refuses
    more than EXACT_ROWS.
    """
    if not stored:
        bona_fide, morphs = (materialise(x, name) for x, name in ((bona_fide, "bona-fide"), (morphs, "morphs")))
    members = materialise(weighted_components(bona_fide, morphs), "members")
    sizes = materialise(component_sizes(members), "component-sizes")
    order = seeded_order(F.col("component"), seed)
    if exact and seed is not None:
        sizes, order = shuffled_sizes(sizes, seed), F.col("turn")
    chosen = assign(sizes, ratios, order).select("component", "split")
    placed = materialise(members.select("identity", "component").join(chosen, "component"), "placed")
    return assignments(bona_fide, morphs, placed), placed


def assignments(bona_fide: DataFrame, morphs: DataFrame, placed: DataFrame) -> DataFrame:
    """(image_id, split, label, identities); a morph follows its first identity, whose component the second shares."""
    where = placed.select("identity", "split")
    singles = bona_fide.join(where, "identity").select("image_id", "split", F.lit(BONA_FIDE).alias("label"), F.array("identity").alias("identities"))
    pairs = morphs.join(where, F.col("identity_a") == F.col("identity")).select(
        "image_id", "split", F.lit(MORPH).alias("label"), F.array("identity_a", "identity_b").alias("identities")
    )
    return singles.unionByName(pairs)


def split_of(assigned: DataFrame, image_id: str) -> str:
    """The split of one image; KeyError if it has none."""
    row = assigned.where(F.col("image_id") == image_id).select("split").first()
    if row is None:
        raise KeyError(image_id)
    return row["split"]


def rows_of(assigned: DataFrame, name: str) -> DataFrame:
    """The rows of a split by its name; ValueError for a name that is none."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; known are {', '.join(SPLITS)}")
    return assigned.where(F.col("split") == name)


def component_of(members: DataFrame, identity) -> DataFrame:
    """The identities of one identity's component; KeyError if it is unknown."""
    row = members.where(F.col("identity") == F.lit(identity)).select("component").first()
    if row is None:
        raise KeyError(identity)
    return members.where(F.col("component") == F.lit(row["component"])).select("identity")


def check_disjoint(assigned: DataFrame, placed: DataFrame) -> DataFrame:
    """assigned; ValueError naming up to five components that lie in several splits."""
    found = leaks(assigned, placed).orderBy("component").limit(5).collect()
    if found:
        raise ValueError(f"components in several splits: {[r['component'] for r in found]}")
    return assigned


def leaks(assigned: DataFrame, placed: DataFrame) -> DataFrame:
    """Components whose images lie in more than one split; none after split_dataset."""
    seen = assigned.select(F.explode("identities").alias("identity"), "split").join(placed.select("identity", "component"), "identity")
    return seen.groupBy("component").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
