"""Near-duplicate groups at a Jaccard similarity of word shingles: candidates from covering SimHash tables and MinHash bands, each verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomwork.llm.simhash import covering_masks, hashed_shingles, majority_bits
from loomwork.operators.graph import connected_components
from loomwork.session import materialise

#: Bits of a set's parity sketch, and of a second one for sets of over LARGE shingles.
SKETCH_BITS, WIDE_BITS, LARGE = 1024, 16_384, 1_000
#: Keys that are broadcast at most; beyond, the same join goes by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of sets that a hub meets in one part, about.
PART_BYTES = 16 << 20


def shingle_set(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(hashed_shingles(text, shingle, seed))


def set_key(hashes: np.ndarray) -> int:
    """64-bit key of a set, as a signed long."""
    key = xxhash.xxh64_intdigest(hashes.tobytes())
    return key - (1 << 64) if key >> 63 else key


class Tables:
    """Keys of a set in all tables: two sets that share a key are candidates.

    One table per covering mask over the 64-bit fingerprint of the set, so that sets whose fingerprints differ
    in at most `radius` bits always meet; and one per MinHash band of `rows` minima, where sets of similarity s
    meet in some band but for (1 - s ** rows) ** bands of all cases: 4 in 10,000 at 0.8.
    """

    def __init__(self, radius: int = 3, bands: int = 20, rows: int = 5, seed: int = 42):
        rng = np.random.default_rng(seed)
        odd = lambda *shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows
        self.masks = np.array(covering_masks(list(range(64)), radius), dtype=np.uint64)
        self.factors, self.flips = odd(bands * rows), odd(bands * rows)
        self.mix, self.band_marks = odd(bands, rows), odd(bands)
        self.mask_mix, self.mask_marks = odd(len(self.masks)), odd(len(self.masks))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least of each of bands x rows orders of all hashes."""
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 4096):
            least = np.minimum(least, ((hashes[at : at + 4096, None] ^ self.flips) * self.factors).min(axis=0))
        return least

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One key per table, as signed longs; none for the empty set, which is one class anyway."""
        if not len(hashes):
            return np.zeros(0, dtype=np.int64)
        mark = majority_bits(hashes)
        covered = (np.uint64(mark) & self.masks) * self.mask_mix + self.mask_marks
        banded = (self.minima(hashes).reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64) * self.band_marks + self.band_marks
        return np.concatenate([covered, banded]).view(np.int64)


def parity_sketch(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of the numbers of shingles in so many classes: two sketches differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have at least that Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def possible(one: np.ndarray, two: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in so many bits, can be similar; no similar pair is ruled out."""
    one, two = one.astype(np.float64), two.astype(np.float64)
    enough = np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-9
    return enough & (apart <= (1 - similarity) / (1 + similarity) * (one + two) + 1e-9)


def _words(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of `width` 64-bit words each, one row per value."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, group_rows: int, seed: int) -> DataFrame:
    """(doc_id, text_key, group_id) of every row; the steps are told in similar_groups."""
    words = SKETCH_BITS // 64
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(seed=seed)
        for batch in batches:
            nodes, sizes, keys, sketches, wide = [], [], [], [], []
            for value in batch.column(2):
                hashes = shingle_set(value.as_py(), shingle, seed)
                nodes.append(set_key(hashes))
                sizes.append(len(hashes))
                keys.append(tables.keys(hashes))
                sketches.append(parity_sketch(hashes).tobytes())
                wide.append(parity_sketch(hashes, WIDE_BITS).tobytes() if len(hashes) > LARGE else None)
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "node", "size", "keys", "sketch", "wide"])

    rows = materialise(narrow.mapInArrow(run, "doc_id long, text_key long, node long, size int, keys array<long>, sketch binary, wide binary"), "shingle-marks")
    classes = materialise(
        rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("text_key", "size", "keys", "sketch", "wide")]), "classes"
    )
    keyed = classes.select("node", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(counts, "key").select("key", "n", "node"), "table-members")
    marks = classes.select("node", "size", "sketch")

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.bitwise_count(_words(batch.column(4), words) ^ _words(batch.column(5), words)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(possible(one, two, apart, similarity)))

    def stars() -> DataFrame:
        """Each set with the hubs of its tables' groups: the hub of a group is the member that shares most keys with others."""
        known = members.groupBy("node").agg(F.sum("n").alias("shared"))
        hubs = members.join(known, "node").groupBy("key").agg(F.max(F.struct("shared", "node"))["node"].alias("hub"))
        pairs = members.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        one, two = (marks.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))
        both = pairs.join(two, "b").join(one, "a").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
        return both.mapInArrow(ruled, "a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(0):
                flat = cell.values
                nodes, sizes, labels, right = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "label", "right"))
                sketch = _words(flat.field("sketch"), words)
                left, right = np.flatnonzero(~right), np.flatnonzero(right)
                for at in range(0, len(left), 256):
                    i = left[at : at + 256]
                    apart = np.zeros((len(i), len(right)), dtype=np.int32)
                    for w in range(words):
                        apart += np.bitwise_count(sketch[i, w][:, None] ^ sketch[right, w][None, :])
                    may = possible(sizes[i][:, None], sizes[right][None, :], apart, similarity) & (labels[i][:, None] != labels[right][None, :])
                    x, y = np.nonzero(may)
                    found.append(np.sort(np.stack([nodes[i[x]], nodes[right[y]]], axis=1), axis=1))
            yield _pairs(found)

    def apart_yet(labels: DataFrame) -> DataFrame:
        """Candidate pairs with different labels in groups that hold several. Members of a group's commonest label meet
        the others only, in cells of at most about group_rows sets: bounded memory, spread over tasks."""
        labelled = members.join(labels, "node").select("key", "node", "label")
        several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        open_ = materialise(labelled.join(several, "key").select("key", "node", "label"), "open-members")
        each = open_.groupBy("key", "label").agg(F.count("*").alias("n"))
        shape = each.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
        half = group_rows // 2
        cut = lambda n: F.ceil(n / half).cast("int")
        shaped = open_.join(shape.select("key", F.col("most.label").alias("main"), cut(F.col("n") - F.col("most.n")).alias("lefts"), cut(F.col("n")).alias("rights")), "key")
        mine = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        left = shaped.where("label <> main").withColumn("l", mine("lefts")).withColumn("r", every("rights")).withColumn("right", F.lit(False))
        right = shaped.withColumn("r", mine("rights")).withColumn("l", every("lefts")).withColumn("right", F.lit(True))
        names = ["key", "l", "r", "right", "node", "label"]
        cells = left.select(*names).unionByName(right.select(*names)).join(marks, "node")
        lists = cells.groupBy("key", "l", "r").agg(F.collect_list(F.struct("node", "size", "sketch", "label", "right")).alias("members"))
        return lists.select("members").mapInArrow(compare, "a long, b long").distinct()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.bitwise_count(_words(batch.column(4), WIDE_BITS // 64) ^ _words(batch.column(5), WIDE_BITS // 64)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(possible(one, two, apart, similarity)))

    def pruned(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that the second sketches allow too, where both sets have one."""
        pairs = materialise(pairs, f"{name}-pairs")
        ends = classes.where("wide IS NOT NULL").select("node", "size", "wide")
        one, two = (ends.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("wide").alias(f"{c}_wide")) for c in ("a", "b"))
        large = pairs.join(two, "b").join(one, "a").select("a", "b", "a_size", "b_size", "a_wide", "b_wide")
        ruled_out = large.select("a", "b").join(large.mapInArrow(prune, "a long, b long"), ["a", "b"], "left_anti")
        return materialise(pairs.join(ruled_out, ["a", "b"], "left_anti"), f"{name}-pruned")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle, seed) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "hashes"])

    def compare_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, a part's hub before the others: only its set is held while they stream by."""
        hub, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            stars, nodes = (batch.column(k).to_numpy() for k in (0, 2))
            found = []
            for k, (star, node) in enumerate(zip(stars.tolist(), nodes.tolist(), strict=True)):
                whole = np.frombuffer(batch.column(3)[k].as_buffer(), dtype=np.uint64)
                if star == node:
                    hub, own = star, whole.copy()
                elif star == hub and similar(own, whole, similarity):
                    found.append((min(star, node), max(star, node)))
            yield pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar by their whole sets, which are made anew for the texts of pairs alone.

        The end with more pairs is a pair's hub. A hub's others are dealt by hash over parts of about PART_BYTES
        of sets, and its own set goes once to each part, however many pairs it has.
        """
        pairs = pruned(pairs, name)
        degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        ends = materialise(degrees.join(classes.select("node", "size", "text_key"), "node"), f"{name}-ends")
        one, two = (ends.select(F.col("node").alias(c), F.struct("n", "node", "size").alias(f"{c}_end")) for c in ("a", "b"))
        high, low = F.greatest("a_end", "b_end"), F.least("a_end", "b_end")
        stars = materialise(pairs.join(two, "b").join(one, "a").select(high["node"].alias("hub"), low["node"].alias("node"), low["size"].alias("size")), f"{name}-stars")
        shape = stars.groupBy("hub").agg(F.ceil(F.sum("size") * 8 / PART_BYTES).cast("int").alias("parts"))
        others = stars.join(shape, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
        leads = shape.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
        needed = ends.select("text_key").distinct()
        keys = F.broadcast(needed) if ends.count() <= BROADCAST_ROWS else needed
        texts = narrow.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text")
        whole = materialise(texts.mapInArrow(sets, "node long, hashes binary"), f"{name}-sets")
        dealt = others.unionByName(leads).join(whole, "node").select("hub", "part", "node", "hashes").repartition("hub", "part")
        ordered = dealt.sortWithinPartitions("hub", "part", F.col("hub") != F.col("node"))
        return materialise(ordered.mapInArrow(compare_stars, "a long, b long"), f"{name}-links")

    def labels_by(links: DataFrame, name: str) -> DataFrame:
        found = connected_components(links).select(F.col("vertex").alias("node"), "component")
        named = classes.select("node").join(found, "node", "left")
        return materialise(named.select("node", F.coalesce("component", "node").alias("label")), name)

    links = verified(stars(), "star")
    labels = labels_by(links, "star-labels")
    rest = verified(apart_yet(labels), "rest")
    if not rest.isEmpty():
        labels = labels_by(links.unionByName(rest), "labels")
    least = classes.select("node", "least").join(labels, "node").groupBy("label").agg(F.min("least").alias("group_id"))
    known = labels.join(least, "label").select("node", "group_id")
    return rows.select("doc_id", "text_key", "node").join(known, "node").select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"))


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    group_rows: int = 2048,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, group_id): documents whose sets of word shingles are similar, closed transitively; group_id is the least id.

    Texts of equal shingle sets are one class. Classes that share a key of Tables are candidates, and every link
    is verified by the whole sets, so that no pair under the similarity is linked (up to equal 64-bit hashes).
    First each class meets the hubs of its groups, at most one per table, which joins nearly all copies in linear work.
    Then groups that still hold several components compare members of different components; sizes and parity
    sketches rule out pairs that can't be similar, the others are verified too. No group is cut or skipped.

    Cases: texts without words have the empty set and form one group; rows with a null id are groups of their
    own with a null group_id; rows of one id are one document; an empty table gives no rows; other columns are
    left out.
    """
    return _classed(docs, id_col, text_col, shingle, similarity, group_rows, seed).select("doc_id", "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose id is not the least of their text's group; rows with a null id stay.

    An id that occurs with several texts goes only with the texts whose groups have a lesser id.
    """
    options = {"shingle": 5, "similarity": 0.8, "group_rows": 2048, "seed": 42} | options
    groups = _classed(docs, id_col, text_col, **options)
    gone = materialise(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("gone"), "text_key").distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = (F.col(f"_docs.`{id_col}`") == F.col("_groups.gone")) & (F.xxhash64(F.col(f"_docs.`{text_col}`")) == F.col("_groups.text_key"))
    return docs.alias("_docs").join(few.alias("_groups"), same, "left_anti")
