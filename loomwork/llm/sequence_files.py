"""Token-id output: Arrow files of fixed-size-list batches with equal-length sequences and masks."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomwork.session import materialise, scratch_path


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{os.path.abspath(url)}")


#: Letters below U+0130, where a letter's lower case and its composed form are one letter, then punctuation that
#: never joins the letters before it into one pre-token.
PLAIN = "^(?P<core>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)(?P<tail>[.,:;!?|%$#&*]*)$"


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length] one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class WordEncoder:
    """Ids of whole texts, by a tokenizers file that lower-cases, drops white space, marks each pre-token's last id and
    cuts letters from other characters before anything joins across such a border.

    So each run between spaces or newlines has its ids alone, and so have a run's letters and the punctuation
    after them. The runs of many texts are split, made distinct and cut by Arrow's own functions; the library
    encodes each part once, and a process remembers up to `remembered` parts, after which that memory starts
    anew. The result is the same either way.
    """

    def __init__(self, path: str, dtype: str, remembered: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype).newbyteorder("<")
        names = self.tokenizer.get_vocab()
        if max(names.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"{max(names.values())} does not fit {dtype}")
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Slot k of the memory holds pool[starts[k] : starts[k] + lengths[k]]; letters and other parts have slots of their own."""
        self.letters: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.pools: list[np.ndarray] = []
        self.held, self.slots = 0, 0
        self.starts, self.lengths = [], []

    def _remember(self, known: dict[str, int], fresh: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        known.update(zip(fresh, range(self.slots, self.slots + len(fresh)), strict=True))
        self.pools.append(ids.astype(self.dtype))
        self.starts.append(self.held + np.cumsum(lengths) - lengths)
        self.lengths.append(lengths)
        self.held, self.slots = self.held + len(ids), self.slots + len(fresh)

    def _learn_letters(self, fresh: list[str]) -> None:
        """Lower-case letters, many in one text with spaces between: each is one pre-token and ends at a closing id."""
        for at in range(0, len(fresh), 2_000):
            some = fresh[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("this tokenizer does not close pre-tokens")
            self._remember(self.letters, some, ids, np.diff(ends, prepend=0))

    def _learn_others(self, fresh: list[str]) -> None:
        made = [x.ids for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        self._remember(self.others, fresh, np.array([i for ids in made for i in ids], dtype=np.int64), np.array([len(ids) for ids in made], dtype=np.int64))

    def _slots(self, known: dict[str, int], learn, parts: list[str]) -> np.ndarray:
        fresh = [p for p in parts if p not in known]
        if fresh:
            learn(fresh)
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; null is empty."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if self.slots + 2 * len(words) > self.remembered:
            self.forget()
        cut = pc.extract_regex(words, PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        core = pc.utf8_lower(pc.struct_field(cut.drop_null(), "core")).dictionary_encode()
        tail = pc.struct_field(cut.drop_null(), "tail").dictionary_encode()
        mixed = words.filter(pa.array(~plain)).to_pylist()
        # A word is two parts, the second of which is empty unless letters have punctuation after them.
        pair = np.zeros((len(words), 2), dtype=np.int64)
        empty = self._slots(self.others, self._learn_others, [""])[0]
        pair[plain, 0] = self._slots(self.letters, self._learn_letters, core.dictionary.to_pylist())[core.indices.to_numpy()]
        pair[plain, 1] = self._slots(self.others, self._learn_others, tail.dictionary.to_pylist())[tail.indices.to_numpy()]
        pair[~plain, 0] = self._slots(self.others, self._learn_others, mixed)
        pair[~plain, 1] = empty
        self.pools, self.starts, self.lengths = ([np.concatenate(x)] for x in (self.pools, self.starts, self.lengths))
        starts, lengths = self.starts[0], self.lengths[0]
        spelt = gathered(self.pools[0], starts[pair.ravel()], lengths[pair.ravel()])
        each = lengths[pair].sum(axis=1)
        at = coded.indices.to_numpy()
        used = each[at]
        ends = np.concatenate([[0], np.cumsum(used)])[lists.value_lengths().to_numpy().cumsum()]
        return gathered(spelt, (np.cumsum(each) - each)[at], used), np.diff(ends, prepend=0)


@functools.lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> WordEncoder:
    """The process's encoder; what it remembers serves all tasks that run there."""
    return WordEncoder(path, dtype)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run by itself."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class ShardWriter:
    """One Arrow file. Each row is a sequence of `length` ids, a mask of one bit per id (0 is padding; eight to a
    byte, the first id's lowest), and the documents that begin in it: their ids and the places of their first tokens.

    Lists are of fixed size, nothing is compressed and every batch but the last holds batch_rows sequences, so
    sequence k lies at a known place of a memory-mapped file. Only a file's last sequence is padded. The file
    appears under its name when whole.
    """

    def __init__(self, url: str, length: int, dtype: str, batch_rows: int = 512):
        self.length, self.dtype, self.batch_rows = length, np.dtype(dtype).newbyteorder("<"), batch_rows
        self.fs, self.path = filesystem(url)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema(
            [
                ("input_ids", pa.list_(kind, length)),
                ("mask", pa.list_(pa.uint8(), -(-length // 8))),
                ("doc_ids", pa.list_(pa.int64())),
                ("doc_starts", pa.list_(pa.int32())),
            ],
            metadata={"batch_rows": str(batch_rows)},
        )
        self.out = self.fs.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.pending = np.zeros(0, dtype=self.dtype)
        self.docs, self.begun = pa.array([], pa.int64()), np.zeros(0, dtype=np.int64)
        self.tokens = self.done = 0  # ids seen, ids in the file

    def add(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in file order: their ids, their tokens one after another and how many each has, one at least."""
        self.docs = pa.concat_arrays([self.docs, docs.cast(pa.int64())])
        self.begun = np.concatenate([self.begun, self.tokens + np.cumsum(counts) - counts])
        self.pending = np.concatenate([self.pending, ids.astype(self.dtype)])
        self.tokens += len(ids)
        while len(self.pending) >= self.batch_rows * self.length:
            self._flush(self.batch_rows)

    def _flush(self, rows: int) -> None:
        wanted = rows * self.length
        taken, self.pending = self.pending[:wanted], self.pending[wanted:]
        mask = np.packbits((np.arange(wanted) < len(taken)).reshape(rows, self.length), axis=1, bitorder="little").ravel()
        taken = np.concatenate([taken, np.zeros(wanted - len(taken), dtype=self.dtype)])
        now = int(np.searchsorted(self.begun, self.done + wanted))
        at, docs = self.begun[:now] - self.done, self.docs.slice(0, now)
        self.begun, self.docs, self.done = self.begun[now:], self.docs.slice(now), self.done + wanted
        offsets = pa.array(np.searchsorted(at, np.arange(rows + 1) * self.length), pa.int32())
        self.file.write_batch(
            pa.RecordBatch.from_arrays(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(taken), self.length),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), -(-self.length // 8)),
                    pa.ListArray.from_arrays(offsets, pa.concat_arrays([docs])),
                    pa.ListArray.from_arrays(offsets, pa.array(at % self.length, pa.int32())),
                ],
                schema=self.schema,
            )
        )

    def close(self) -> None:
        if len(self.pending):
            self._flush(-(-len(self.pending) // self.length))
        self.file.close()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an earlier attempt at the same shard
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access to a shard's sequences; local files are memory-mapped, and ids and masks are views of them."""

    def __init__(self, url: str):
        self.fs, self.path = filesystem(url)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(self.path) if local else self.fs.open_input_file(self.path))
        self.length = self.file.schema.field("input_ids").type.list_size
        self.batch_rows = int(self.file.schema.metadata[b"batch_rows"])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.file.num_record_batches):
            yield self.file.get_batch(k)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask of sequence k, found by its number alone."""
        number, row = divmod(k, self.batch_rows)
        if k < 0 or number >= self.file.num_record_batches or row >= (batch := self.file.get_batch(number)).num_rows:
            raise IndexError(k)
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=True).reshape(batch.num_rows, -1)[row] for c in (0, 1))
        return ids, mask

    def real(self, mask: np.ndarray) -> np.ndarray:
        """A packed mask as booleans, one per id."""
        return np.unpackbits(mask, count=self.length, bitorder="little").astype(bool)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; a document that runs over a batch's end is put together."""
        doc, parts, begun = None, [], False
        for batch in self.batches():
            mask = batch.column(1).flatten().to_numpy(zero_copy_only=True)
            flat = batch.column(0).flatten().to_numpy()[: int(np.bitwise_count(mask).sum(dtype=np.int64))]
            rows = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            starts = batch.column(3).flatten().to_numpy() + rows * self.length
            at = 0
            for start, ident in zip(starts.tolist(), batch.column(2).flatten().to_pylist(), strict=True):
                if begun:
                    yield doc, np.concatenate([*parts, flat[at:start]])
                doc, parts, begun, at = ident, [], True, start
            if begun:
                parts.append(flat[at:].copy())
        if begun:
            yield doc, np.concatenate(parts)


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    length: int = 2048,
    dtype: str = "uint16",
    shards: int | None = None,
) -> DataFrame:
    """Write docs as Arrow files of equal-length sequences and return (shard, path, n_docs, n_tokens).

    Documents are range-partitioned by id and the beginning of the text and sorted, so shard after shard holds
    them in ascending id order and many rows of one id spread over shards; each shard's ids follow one another without padding but at its end. A task writes one file
    under its shard's number. A repeated or lost task writes the same file again, under another name until
    it is whole. The result has one row per shard and is written to the shared folder.

    Cases: a null or empty text is the end id alone; null ids come first; equal ids are ordered by
    text, and those with equal first 64 characters stand in one shard; very long texts span sequences; an empty table writes no file; other columns are left out.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, count = None, None, 0
        shard = TaskContext.get().partitionId()
        path = f"{out_dir}/shard-{shard:06d}.arrow"
        for batch in batches:
            for some in text_slices(batch, 1):
                if writer is None:
                    encode, writer = encoder(tokenizer, dtype), ShardWriter(path, length, dtype)
                ids, counts = encode(some.column(1))
                writer.add(some.column(0), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
                count += some.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [count], "n_tokens": [writer.tokens]})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ident = F.col("doc_id").asc_nulls_first()
    ordered = narrow.repartitionByRange(shards, ident, F.substring("text", 1, 64)).sortWithinPartitions(ident, "text")
    return materialise(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "sequence-shards")


def read_documents(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of write_sequences.

    One task reads one shard or a few. start counts the ids of all shards before, a running sum over one
    row per shard. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, rows = row["first"], []
                for ident, ids in ShardReader(row["path"]).documents():
                    rows.append((ident, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))

    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    tasks = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "shard").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as sequences and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = write_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "sequences"))
    return read_documents(written)
