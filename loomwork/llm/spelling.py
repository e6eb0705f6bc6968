"""Spelling variants: words one letter apart, found in a trie of letter-group counts, follow the form that is used most."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.llm.texts import CRC32_SQL, lower_ascii
from loomwork.session import materialise

LETTER = r"[A-Za-zÀ-ÿ]"
#: Levels of the trie: the commonest letters have one each, the others share the rest.
ALONE, SHARED = 12, 4
#: Shards are named by up to so many levels, whose counts are taken as at most 15 there.
SHARD_LEVELS, MOST = 6, 15
#: Entries of the search's stack, queries searched at once, cells compared at once.
BLOCK, QUERIES, CELLS = 1 << 16, 4096, 1 << 22
#: In leaves of more words than this, words are looked up by their halves before they are compared.
LARGE_LEAF = 64


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(_id, run) of every maximal run of letters of at least min_chars in a text, A-Z lower-cased, once an occurrence."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{LETTER}{{{min_chars},}}"), F.lit(0)))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), found.alias("run")).select("_id", lower_ascii(F.col("run")).alias("run"))


def count_words(words: DataFrame, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words of the column word that are long and frequent enough."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Letters:
    """Which level of the trie each letter counts on, the commonest letters first."""

    def __init__(self, letters: list[int], alone: int = ALONE, shared: int = SHARED):
        """letters: code points, commonest first."""
        self.levels = alone + shared
        level = np.array([k if k < alone else alone + (k - alone) % shared for k in range(len(letters))], dtype=np.int64)
        order = np.argsort(np.array(letters, dtype=np.uint32), kind="stable")
        self.known, self.level = np.array(letters, dtype=np.uint32)[order], level[order]

    def counts(self, words: Words) -> np.ndarray:
        """One row a word: how many of its letters count on each level."""
        row = np.repeat(np.arange(len(words.size)), words.size)
        level = self.level[np.searchsorted(self.known, words.codes)] if len(words.codes) else np.zeros(0, dtype=np.int64)
        return np.bincount(row * self.levels + level, minlength=len(words.size) * self.levels).reshape(-1, self.levels)


class Words:
    """Words as one array of code points."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start = np.cumsum(self.size) - self.size


def one_apart(a: Words, i: np.ndarray, b: Words, k: np.ndarray) -> np.ndarray:
    """Whether a[i] becomes b[k] by one letter replaced, or by one inserted where b[k] is longer by one."""
    good = np.zeros(len(i), dtype=bool)
    sizes = a.size[i]
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step, at = max(1, CELLS // (size + 1)), np.arange(size)
        for cut in range(0, len(every), step):
            some = every[cut : cut + step]
            one, two = a.codes[a.start[i[some]][:, None] + at], b.start[k[some]][:, None] + at
            longer = b.size[k[some]] - size
            front = one == b.codes[two]
            same = longer == 0
            good[some[same]] = (~front[same]).sum(axis=1) == 1
            if (grown := np.flatnonzero(longer == 1)).size:
                front = front[grown]
                back = (one[grown] == b.codes[two[grown] + 1])[:, ::-1]
                run = lambda equal: np.where(equal.all(axis=1), size, np.argmin(equal, axis=1))
                good[some[grown]] = run(front) + run(back) >= size
    return good


class Trie:
    """Words sorted by their counts: a node at depth d is a run of words with the same first d counts."""

    def __init__(self, letters: Letters, words: list[str]):
        found = Words(words)
        counts = letters.counts(found)
        self.order = np.lexsort(counts.T[::-1])
        self.letters, counts = letters, counts[self.order]
        self.words = Words([words[k] for k in self.order])
        self.children, node = [], np.zeros(len(words), dtype=np.int64)
        self.width = int(counts.max(initial=0)) + 3
        for level in range(letters.levels):
            key = node * self.width + counts[:, level]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
            self.children.append(key[new])
            node = np.cumsum(new) - 1
        self.first = np.flatnonzero(np.r_[new, True])
        self.leaf, self.halves = node, {}

    def _step(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries whose node has a child of that count, and the children."""
        keys = self.children[level]
        key = node * self.width + count
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = np.flatnonzero((keys[at] == key) & (count >= 0) & (count < self.width))
        return there, at[there]

    def search(self, queries: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) of words one apart, the word's counts not before the query's: each two words in one order only.

        Depth first with a stack of blocks: an entry is a query at a node with what it has spent of its budget.
        0: counts equal so far; 1: one letter more (the first difference is a surplus, as the other order finds the others);
        2: one more and one less. At a leaf that is one letter replaced within a level, inserted, or replaced.
        """
        counts = self.letters.counts(queries)
        begin = np.arange(len(counts))
        stack = [(0, begin, np.zeros_like(begin), np.zeros(len(begin), dtype=np.int8))] if len(self.first) > 1 else []
        while stack:
            level, query, node, spent = stack.pop()
            if level == self.letters.levels:
                yield from self._leaves(queries, query, node, spent)
                continue
            count, grown = counts[query, level], []
            for budget, change, then in ((None, 0, None), (0, 1, 1), (1, -1, 2)):
                some = np.arange(len(query)) if budget is None else np.flatnonzero(spent == budget)
                there, child = self._step(level, node[some], count[some] + change)
                kept = some[there]
                grown.append((query[kept], child, spent[kept] if then is None else np.full(len(kept), then, dtype=np.int8)))
            query, node, spent = (np.concatenate(x) for x in zip(*grown, strict=True))
            for cut in range(0, len(query), BLOCK):
                part = slice(cut, cut + BLOCK)
                stack.append((level + 1, query[part], node[part], spent[part]))

    def _leaves(self, queries: Words, query: np.ndarray, node: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the leaves that are one apart when compared; of two words with equal counts the lesser is the query."""
        first, size = self.first[node], self.first[node + 1] - self.first[node]
        few, many = size <= LARGE_LEAF, size > LARGE_LEAF
        found = [_pieces(query[few], spent[few], first[few], size[few])]
        for grown in (False, True):
            some = many & ((spent == 1) == grown)
            if some.any():
                found += [self._by_half(queries, query[some], node[some], spent[some], grown, side) for side in (0, 1)]
        for pieces in found:
            for i, how, k in pieces:
                good = one_apart(queries, i, self.words, k)
                i, how, k = i[good], how[good], k[good]
                kept = [s != 0 or queries.words[x] < self.words.words[y] for x, s, y in zip(i.tolist(), how.tolist(), k.tolist(), strict=True)]
                yield i[kept], k[kept]

    def _by_half(self, queries: Words, query, node, spent, grown: bool, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of a leaf that share the query's first half (side 0), or the last and not the first (side 1).

        One letter replaced or inserted leaves one half whole; grown tells that the words have one letter more.
        """
        if (grown, side) not in self.halves:
            large = np.flatnonzero((self.first[1:] - self.first[:-1])[self.leaf] > LARGE_LEAF)
            keys = np.array([hash((leaf, half(self.words.words[k], side, grown))) for k, leaf in zip(large.tolist(), self.leaf[large].tolist(), strict=True)], dtype=np.int64)
            order = np.argsort(keys, kind="stable")
            self.halves[grown, side] = keys[order], large[order]
        keys, places = self.halves[grown, side]
        mine = np.array([hash((leaf, half(queries.words[i], side))) for i, leaf in zip(query.tolist(), node.tolist(), strict=True)], dtype=np.int64)
        low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        for i, how, at in _pieces(query, spent, low, high - low):
            k = places[at]
            if side:
                new = [half(queries.words[x], 0) != half(self.words.words[y], 0, grown) for x, y in zip(i.tolist(), k.tolist(), strict=True)]
                i, how, k = i[new], how[new], k[new]
            yield i, how, k


def half(word: str, side: int, grown: bool = False) -> str:
    """The first or the last half of a word; grown: of a length that the word had with one letter less."""
    size = len(word) - grown
    return word[: size // 2] if side == 0 else word[len(word) - (size - size // 2) :]


def _pieces(query: np.ndarray, spent: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, spent, place) for the places from first on, size of them, in pieces of about BLOCK."""
    ends = np.cumsum(size)
    cuts = np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]) if len(ends) else 0, BLOCK), "left")
    for lo, hi in zip(np.r_[0, cuts + 1], np.r_[cuts + 1, len(query)], strict=True):
        times = size[lo:hi]
        place = np.repeat(first[lo:hi] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        yield np.repeat(query[lo:hi], times), np.repeat(spent[lo:hi], times), place


def shard_names(counts: np.ndarray, depth: int) -> list[list[str]]:
    """For each word, the name of its own shard and of those that hold words with its first counts or later ones within the budget."""
    top = counts[:, :depth]
    changes = [np.zeros(depth, dtype=np.int64)]
    for a in range(depth):
        changes.append(np.eye(depth, dtype=np.int64)[a])
        changes += [changes[0] + np.eye(depth, dtype=np.int64)[a] - np.eye(depth, dtype=np.int64)[b] for b in range(a + 1, depth)]
    named = []
    for change in changes:
        made = top + change
        digits = np.clip(made, 0, MOST)
        text = np.ascontiguousarray(np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[digits]).view(f"S{depth}").ravel().astype(str)
        named.append(np.where((made >= 0).all(axis=1), text, ""))
    return [[own, *sorted({x for x in others if x and x != own})] for own, *others in zip(*[x.tolist() for x in named], strict=True)]


def _common_letters(words: DataFrame) -> list[int]:
    """Code points of all letters of the words, commonest first: as many as the alphabet has."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    return [ord(r.letter) for r in letters.orderBy(F.desc("count"), "letter").collect()]


def near_words(words: DataFrame, shard_words: int | None = None) -> DataFrame:
    """(word, near, near_n) for all pairs of words(word, n) that differ by exactly one letter inserted, deleted or replaced.

    The words of a shard have the same first counts, so a shard is a part of the trie below its top. Each word goes
    to its own shard and, as a query, to all that hold words within its budget: with the first difference a surplus,
    so that of two words just one looks for the other. Shards have the fewest levels that leave none with more than
    shard_words words (by default as many as give each partition one); one that is larger even so is dealt into blocks,
    and its queries go to each. A task holds one block's trie and streams the queries through it.

    Cases: repeated words should be counted before; an empty table gives no rows; words of any length are compared whole.
    """
    spark = words.sparkSession
    known = _common_letters(words)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not known:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(known)
        for batch in batches:
            counts = letters.counts(Words(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in shard_names(counts, SHARD_LEVELS)], pa.string())], ["top"])

    tops = words.select("word").mapInArrow(name, "top string").groupBy("top").count()
    sizes = tops.select(F.explode(F.sequence(F.lit(1), F.lit(SHARD_LEVELS))).alias("depth"), "top", "count")
    sizes = materialise(sizes.groupBy("depth", F.substring("top", F.lit(1), F.col("depth")).alias("top")).agg(F.sum("count").alias("n")), "shard-sizes")
    largest = {r.depth: (r.most, r.all) for r in sizes.groupBy("depth").agg(F.max("n").alias("most"), F.sum("n").alias("all")).collect()}
    limit = shard_words or max(2_000, min(100_000, largest[1][1] // parts))
    depth = next((d for d in range(1, SHARD_LEVELS) if largest[d][0] <= limit), SHARD_LEVELS)
    # Only shards over the limit are listed: at most one for so many words.
    blocks = {r.top: -(-r.n // limit) for r in sizes.where((F.col("depth") == depth) & (F.col("n") > limit)).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(known)
        for batch in batches:
            for cut in range(0, batch.num_rows, QUERIES):
                piece = batch.slice(cut, QUERIES)
                told = piece.column(0).to_pylist()
                shard, block, asks, row = [], [], [], []
                for k, (own, *others) in enumerate(shard_names(letters.counts(Words(told)), depth)):
                    shard.append(own)
                    block.append(hash_of(told[k]) % blocks.get(own, 1))
                    asks.append(False)
                    row.append(k)
                    for other in (own, *others):
                        for b in range(blocks.get(other, 1)):
                            shard.append(other)
                            block.append(b)
                            asks.append(True)
                            row.append(k)
                took = piece.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(block, pa.int32()), pa.array(asks, pa.bool_()), *took.columns], ["shard", "block", "asks", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, held, ns, trie = Letters(known), None, [], [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True))
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            for lo, hi in zip([0, *ends], ends):
                rows = batch.slice(lo, hi - lo)
                *key, asks = keys[lo]
                if key != at:
                    at, held, ns, trie = key, [], [], None
                if not asks:
                    held += rows.column(3).to_pylist()
                    ns.append(rows.column(4).to_numpy())
                    continue
                if not held:
                    continue
                if trie is None:
                    trie = Trie(letters, held)
                    counts = np.concatenate(ns)[trie.order]
                for cut in range(0, rows.num_rows, QUERIES):
                    some = rows.slice(cut, QUERIES)
                    asked, n = Words(some.column(3).to_pylist()), some.column(4).to_numpy()
                    for i, k in trie.search(asked):
                        one, two = [asked.words[x] for x in i], [trie.words.words[x] for x in k]
                        yield pa.RecordBatch.from_arrays([pa.array(one + two, pa.string()), pa.array(two + one, pa.string()), pa.array(np.r_[counts[k], n[i]], pa.int64())], ["word", "near", "near_n"])

    dealt = words.select("word", "n").mapInArrow(deal, "shard string, block int, asks boolean, word string, n long")
    placed = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    return placed.mapInArrow(search, "word string, near string, near_n long")


def hash_of(word: str) -> int:
    """A hash that all processes agree on."""
    return zlib.crc32(word.encode())


def group_variants(words: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of words(word, n).

    n_near counts the words one letter apart. form is the one of them used most (ties: the smallest) if it is used at
    least ratio times as often as the word, else null; root is where the forms lead, the word itself if it has none.
    Each form is used ratio times as often as the last, so the longest chain is known from the largest n, and roots are
    found by jumps that double.

    Cases: as in near_words; an empty table gives no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    found = near_words(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = words.join(found, "word", "left")
    used = -F.col("best.less") >= ratio * F.col("n")
    formed = materialise(
        best.select("word", F.when(used, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(used, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    chain = int(math.log(most, ratio)) + 1
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(chain, 1)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = materialise(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    whole = formed.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def struck(run: Column, doc_id: Column) -> Column:
    """The run without one letter, where the checksum of id and run says so: spelling mistakes that are known."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (mark % F.length(run)).cast("int")
    return F.when(mark % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of documents with at least 7 letters and 2 occurrences, with letters struck out by checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = runs(docs, min_chars=7).select(struck(F.col("run"), F.col("_id")).alias("word"))
    return group_variants(count_words(found))


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7
), marked AS (
  SELECT run, count(*) AS c, {CRC32_SQL.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS mark FROM runs GROUP BY doc_id, run
), spelt AS (
  SELECT CASE WHEN mark % 31 = 0 THEN left(run, (mark % length(run))::INT) || substr(run, (mark % length(run) + 2)::INT) ELSE run END AS word, c FROM marked
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), shorter AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, (i + 2)::INT) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), grown AS (
  SELECT DISTINCT s.word AS a, w.word AS b, s.n AS an, w.n AS bn FROM shorter s JOIN words w ON w.word = s.rest
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM grown UNION ALL SELECT b, a, an FROM grown
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), last AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""
