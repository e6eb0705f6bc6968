"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomwork.operators.graph import connected_components
from loomwork.session import materialise


def hashed_shingles(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; words are joined by a space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the 64-bit hashes; 0 without hashes."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, shingle: int, seed: int) -> int:
    """64-bit fingerprint of the text's word shingles, repeats included; 0 without words."""
    return majority_bits(hashed_shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a long; one Arrow pass without a shuffle.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one
    shingle; a text without words, empty or null has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(x.as_py(), shingle, seed) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the bit positions such that any `radius` of them are all left out by some mask.

    Each position gets a nonzero vector of radius + 1 bits, in a fixed order that spreads few positions over
    all bits of the vectors. For each nonzero v there is a mask; it
    keeps the positions whose vector is not orthogonal to v. Any `radius` vectors span less than the whole
    space, so some v is orthogonal to all of them, and its mask leaves their positions out.
    """
    turns = (1 << (radius + 1)) - 1
    step = next(s for s in range(int(0.618 * turns) + 1, 2 * turns) if math.gcd(s, turns) == 1)
    vectors = {p: (i + 1) * step % turns + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, turns + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked_pairs(group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the group's graph of values within radius; all pairs are only compared."""
    near = np.bitwise_count(group[:, None] ^ group[None, :]) <= radius
    out, unseen = [], np.ones(len(group), dtype=bool)
    for root in range(len(group)):
        if not unseen[root]:
            continue
        unseen[root], todo = False, [root]
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero(near[at] & unseen)
            unseen[fresh] = False
            todo += fresh.tolist()
            out += [(at, int(x)) for x in fresh]
    return [(int(group[i]), int(group[j])) for i, j in out]


def near_links(values: DataFrame, radius: int = 3, group_rows: int = 2048) -> DataFrame:
    """(a, b): links between distinct 64-bit values of column fp that differ in at most `radius` bits.

    The links connect exactly the values that all such pairs connect. Every value goes to one group per
    covering mask, under its masked bits; each pair within the radius meets in some group. Inside a group
    all values are compared and a spanning forest is returned, never all pairs. Groups of more than
    group_rows values are not compared: their values are dealt again by a second set of masks over the bits
    that the first left free, and so on. Each level leaves about half of the bits free, so after four
    levels a group can't hold more than a few hundred distinct values; no group is cut or skipped.
    """
    spark = values.sparkSession

    def masks_below(masks: list[int]) -> list[tuple[int, int]]:
        below = []
        for mask in masks:
            free = [p for p in range(64) if not mask >> p & 1]
            below += [(_signed(mask), _signed(mask | more)) for more in set(covering_masks(free, radius))]
        return below

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().cumsum()
            sizes = np.diff(np.concatenate([[0], ends]))
            out: list[tuple[int, int]] = []
            for size in np.unique(sizes):
                starts = ends[sizes == size] - size
                step = max(1, (1 << 21) // int(size * size))
                for at in range(0, len(starts), step):
                    block = flat[starts[at : at + step, None] + np.arange(size)]
                    near = np.bitwise_count(block[:, :, None] ^ block[:, None, :]) <= radius
                    for k in np.flatnonzero(near.sum(axis=(1, 2)) > size):
                        out += _linked_pairs(block[k], radius)
            pairs = np.array(sorted(set(out)), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    masks = covering_masks(list(range(64)), radius)
    first = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small table is not put together into a few tasks before it grows by its masks
    keyed = values.select("fp").distinct().repartition(tasks, "fp").select("fp", first.alias("mask"))
    found = None
    while True:
        dealt = keyed.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        crowded = materialise(
            dealt.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("mask", "bits"), "crowded"
        )
        last = crowded.isEmpty()
        small = dealt if last else dealt.join(crowded, ["mask", "bits"], "left_anti")
        links = (
            small.groupBy("mask", "bits")
            .agg(F.collect_list("fp").alias("fps"))
            .where(F.size("fps") > 1)
            .select("fps")
            .mapInArrow(compare, "a long, b long")
        )
        found = links if found is None else found.unionByName(links)
        if last:
            return found.distinct()
        pairs = masks_below(masks)
        masks = sorted({m & ((1 << 64) - 1) for _, m in pairs})
        deeper = spark.createDataFrame(pairs, "mask long, deeper long")
        keyed = (
            dealt.join(crowded, ["mask", "bits"], "left_semi")
            .join(F.broadcast(deeper), "mask")  # 15, 225, 3,375 or 50,625 rows: fixed by the radius
            .select("fp", F.col("deeper").alias("mask"))
        )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints linked at up to `radius` differing bits, closed transitively.

    component_id is the smallest doc_id that can be reached. Only distinct fingerprints are compared, so
    copies, however many, cost one row. Fingerprints without a link skip the components job.

    Cases: texts without words have fingerprint 0 and are linked like any other; a null id takes part
    without being the smallest (component_id is null if all ids of the component are); repeated rows come
    back each; an empty table gives an empty result; other columns are left out.
    """
    marks = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(classes, radius)
    joined = connected_components(links.select("a", "b")).select(F.col("vertex").alias("fp"), "component")
    rooted = classes.join(joined, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(known, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
