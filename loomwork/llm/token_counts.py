"""Token counts: each distinct pre-token is cut into pieces once, documents only look counts up."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomwork.session import materialise

#: One in so many pre-tokens, by CRC, is counted to tell how many distinct ones there are.
SAMPLED = 1024
#: A newline, spaces and what follows them, or spaces at the end.
PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, spaces in front of the word they belong to.

    The library puts a space before the text and writes spaces as U+2581. It merges two symbols only into
    a piece of its vocabulary, and no piece has U+2581 after another character or holds a newline with
    others. So no merge crosses the borders cut here, and each pre-token has its pieces alone.
    """
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class PieceCounter:
    """Pieces of single pre-tokens, from a sentencepiece model."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for k in range(self.model.get_piece_size()):
            if "▁" in (piece := self.model.id_to_piece(k)).lstrip("▁") or "\n" in piece:
                raise ValueError(f"piece {piece!r} could cross a pre-token's border")
        self.front = len(self.model.encode("\n"))

    def __call__(self, tokens: list[str]) -> list[int]:
        """A newline in front ends the library's own leading space, so that only the pre-token's pieces are left."""
        return [len(ids) - self.front for ids in self.model.encode(["\n" + t for t in tokens], num_threads=1)]


def _packed(values: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit, by byte planes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _crcs(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.int64, len(tokens))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of documents, one row each.

    tokens: the block's distinct pre-tokens by their CRC, so that any number of parts are slices of the list. places and
    often: for each document the places of its pre-tokens in that list and how often each occurs; ends: where each
    document's run ends. low: the CRCs below 2**32 / SAMPLED, a sample of pre-tokens that is the same in all blocks.
    """
    columns = {"block": pa.int64(), **dict.fromkeys(("tokens", "places", "often"), pa.binary()), **dict.fromkeys(("ids", "sizes", "lines", "ends", "low"), pa.list_(pa.int64()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = 0, TaskContext.get().partitionId()

        def close():
            words = list(vocabulary)
            crcs = _crcs(words)
            order = np.argsort(crcs, kind="stable")
            place = np.empty(len(words), dtype=np.uint32)
            place[order] = np.arange(len(words))
            listed = zstandard.ZstdCompressor(level=3).compress("\n".join([words[k] for k in order]).encode())
            flat = place[np.concatenate(places)] if places else np.zeros(0, dtype=np.uint32)
            often = np.concatenate(counts) if counts else np.zeros(0, dtype=np.uint32)
            values = [(task << 32) + block, listed if words else None, _packed(flat), _packed(often), ids, sizes, lines, ends, crcs[crcs < (1 << 32) // SAMPLED].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, columns.values(), strict=True)], list(columns))

        def fresh():
            return {}, [], [], [], [], [], [], 0

        vocabulary, places, counts, ids, sizes, lines, ends, held = fresh()
        for batch in batches:
            for ident, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                often = Counter(pre_tokens(text))
                lines.append(often.pop("\n", 0))
                ids.append(ident.as_py())
                sizes.append(len(text.encode()))
                places.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in often), np.uint32, len(often)))
                counts.append(np.fromiter(often.values(), np.uint32, len(often)))
                ends.append((ends[-1] if ends else 0) + len(often))
                held += sizes[-1]
                if held >= block_bytes:
                    yield close()
                    block += 1
                    vocabulary, places, counts, ids, sizes, lines, ends, held = fresh()
        if ids:
            yield close()

    schema = "block long, tokens binary, places binary, often binary, ids array<long>, sizes array<long>, lines array<long>, ends array<long>, low array<long>"
    return docs.mapInArrow(run, schema)


def count_tokens(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    block_bytes: int = 24 << 20,
    part_tokens: int = 500_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) as the sentencepiece model at path `model` counts.

    The first pass writes, for blocks of about block_bytes of text, each document's pre-token frequencies
    and the block's distinct pre-tokens. These are dealt to parts by hash and shuffled: a part
    holds all blocks' uses of its pre-tokens, and cuts each distinct one into pieces once. The numbers go
    back to their blocks by an equi-join and are summed against the frequencies. Ids are never kept. Every
    pre-token is in a block's list once, so the commonest word weighs no more in its part than a rare one
    that all blocks have. There are so many parts that each has about part_tokens distinct pre-tokens by the count of
    the blocks' common sample, at least the session's shuffle partitions; a task holds one part's at a time.

    Cases: a null or empty text has 0 bytes and 0 tokens; special strings in texts are ordinary text; a
    null id is kept; repeated rows come back each; a text longer than a block is a block by itself; an empty
    table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialise(_blocks(narrow, block_bytes), "token-blocks")
    sampled = blocks.select(F.explode("low").alias("crc")).agg(F.approx_count_distinct("crc").alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sampled * SAMPLED // part_tokens))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = unpack.decompress(data).decode().split("\n")
                mine = _crcs(tokens) * parts >> 32
                held = np.unique(mine)
                cuts = [*np.searchsorted(mine, held).tolist(), len(tokens)]
                lists = [pack.compress("\n".join(tokens[a:b]).encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.int64()), pa.array(held, pa.int64()), pa.array(lists, pa.binary())], ["block", "part", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, unpack = PieceCounter(model), zstandard.ZstdDecompressor()
        known, current = {}, None
        for batch in batches:
            made = []
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != current:
                    known, current = {}, part
                tokens = unpack.decompress(data.as_py()).decode().split("\n")
                fresh = [t for t in tokens if t not in known]
                known.update(zip(fresh, counter(fresh), strict=True))
                made.append(_packed(np.fromiter((known[t] for t in tokens), np.uint32, len(tokens))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["block", "part", "pieces"])

    pieces = (
        blocks.where("tokens IS NOT NULL")
        .select("block", "tokens")
        .mapInArrow(deal, "block long, part long, tokens binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(count, "block long, part long, pieces binary")
        .groupBy("block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "pieces"))), lambda x: x["pieces"]).alias("pieces"))
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newline = PieceCounter(model)(["\n"])[0]
        for batch in batches:
            for k in range(batch.num_rows):  # a row is a block; one at a time is unpacked
                row = dict(zip(batch.schema.names, (column[k].as_py() for column in batch.columns), strict=True))
                place, often = _unpacked(row["places"]), _unpacked(row["often"])
                numbers = np.concatenate([_unpacked(x) for x in row["pieces"] or []] or [np.zeros(0, np.uint32)]).astype(np.int64)
                running = np.concatenate([[0], np.cumsum(numbers[place] * often)])
                ends = np.array(row["ends"], dtype=np.int64)
                tokens = running[ends] - running[np.concatenate([[0], ends[:-1]])] + newline * np.array(row["lines"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    frequencies = blocks.select("block", "places", "often", "ids", "sizes", "lines", "ends")
    return (
        frequencies.join(pieces, "block", "left")
        .select("places", "often", "ids", "sizes", "lines", "ends", "pieces")
        .mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of documents by the 32k piece model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
