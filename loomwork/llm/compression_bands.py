"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from loomwork.llm.texts import SPACES

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits on bytes / compressed bytes.

    whole: (from so many bytes, least ratio, greatest ratio), ascending; the last row that a document
    reaches holds. Short texts carry the frame's own bytes and compress little, long ones more, so the
    band moves up with length. Chunks are consecutive runs of chunk_bytes; the rest behind them is a chunk
    too, held to the band of whole documents of its length. A document goes if its own ratio is outside its
    band, or if more than bad_share of its bytes are in chunks outside theirs.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (100, 0.85, 3.0),
        (300, 1.2, 3.5),
        (1_000, 1.4, 4.0),
        (10_000, 1.5, 5.0),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.4, 6.0)
    bad_share: float = 0.3
    level: int = 3


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of `window` (a power of two) words that occur twice or more, first ones included.

    Windows are compared exactly: equal runs of 1, 2, 4, ... words get equal ranks, each made from two
    ranks of half the length. A text whose shorter runs are all different ends early.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    run, kinds = 1, len(seen)
    while run < window:
        values, ranks = np.unique(ranks[:-run] * kinds + ranks[run:], return_inverse=True)
        run, kinds = 2 * run, len(values)
        if kinds == len(ranks):
            return 0
    twice = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line in seen:
            count += 1
        elif line.strip(SPACES):
            seen.add(line)
    return count


def within_bands(data: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of the bytes in chunks outside their band, verdict."""
    if not data:
        return 0.0, 0.0, True
    ratio = len(data) / len(pack.compress(data))
    band = lambda n: next((lo, hi) for least, lo, hi in reversed(bands.whole) if n >= least)
    low, high = band(len(data))
    size, bad = bands.chunk_bytes, 0
    for at in range(0, len(data), size):
        chunk = data[at : at + size]
        part = len(chunk) / len(pack.compress(chunk)) if len(chunk) < len(data) else ratio
        least, most = bands.chunk if len(chunk) == size else band(len(chunk))
        bad += len(chunk) * (not least <= part <= most)
    share = bad / len(data)
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), returned: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, zstd_ratio,
    bad_chunk_share and kept.

    One Arrow pass without a shuffle; all of a document's columns travel along, or those of `returned`. base_failed: fewer than 20
    words, or over 30 % of the words in repeated windows of eight; such documents are not kept. The others
    are kept if their compression ratios are within the bands.

    Cases: a null or empty text has no words and fails the base rules, its ratio is 0; very long texts are
    measured whole, in memory proportional to the text; repeated rows and ties are judged alike; an empty
    table gives an empty result. Columns of docs named like the new ones are replaced.
    """
    fields = [
        ("n_words", pa.int64(), "long"),
        ("word_chars", pa.int64(), "long"),
        ("n_symbols", pa.int64(), "long"),
        ("n_dup_lines", pa.int64(), "long"),
        ("n_repeat_words", pa.int64(), "long"),
        ("base_failed", pa.bool_(), "boolean"),
        ("zstd_ratio", pa.float64(), "double"),
        ("bad_chunk_share", pa.float64(), "double"),
        ("kept", pa.bool_(), "boolean"),
    ]
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for value in batch.column(at):
                text = value.as_py() or ""
                data = text.encode()
                words = data.split()
                repeats, n = repeated_words(words), len(words)
                failed = n < 20 or 100 * repeats > 30 * n
                ratio, share, inside = within_bands(data, bands, pack)
                chars = len(text) - sum(text.count(c) for c in SPACES)
                symbols = sum(data.count(c) for c in SYMBOLS)
                rows.append((n, chars, symbols, duplicate_lines(text), repeats, failed, ratio, share, inside and not failed))
            made = [pa.array([r[k] for r in rows], type=f[1]) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(passed.index(c)) for c in back), *made], [*back, *names])

    back = [c for c in (docs.columns if returned is None else returned) if c not in names]
    passed = [*back, *([text_col] if text_col not in back else [])]
    at = passed.index(text_col)
    held = docs.select(*[F.col(f"`{c}`") for c in passed])
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in back), *(f"{n} {kind}" for n, _, kind in fields)])
    return held.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Verdicts over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, returned=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "bad_chunk_share"
    )
