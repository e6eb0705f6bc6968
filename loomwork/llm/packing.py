"""Packing into optimal length buckets with token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from loomwork.llm.ordering import numbered
from loomwork.llm.texts import word_count
from loomwork.session import materialise


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets over the histogram that minimise padded tokens.

    Dynamic programming over the distinct lengths: best(k, j) = min over i < j of best(k-1, i) plus the
    padded size of lengths i..j-1, all padded to the longest. Padded tokens differ from padding by the
    constant number of real tokens. The best i never falls as j grows, so each layer is filled by divide
    and conquer in O(L log L) vector steps. Of equal costs the least i wins.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)])
    best = total[1:].astype(np.float64) * lengths
    best = np.concatenate([[0.0], best])
    cuts = []
    for _ in range(1, min(buckets, n)):
        fresh, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        fresh[0] = 0.0
        spans = [(1, n, 0, n - 1)]
        while spans:
            lo, hi, first, last = spans.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + (total[j] - total[i]).astype(np.float64) * lengths[j - 1]
            at = int(np.argmin(cost))
            fresh[j], cut[j] = cost[at], i[at]
            spans += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = fresh
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            return ends[::-1]
    ends.append(int(lengths[j - 1]))
    return ends[::-1]


#: Names of full blocks are broadcast up to so many.
BROADCAST_BLOCKS = 50_000


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    max_len: int = 8192,
    buckets: int = 16,
    batch_tokens: int = 65_536,
    block_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, bucket_len, batch_id, slot, batch_size.

    Documents longer than max_len are cut into pieces of max_len tokens and a rest; all pieces stay. The
    global histogram of piece lengths has at most max_len + 1 rows by construction; that is what comes to
    the driver, where dynamic programming chooses the bucket ends. Inside a bucket, pieces in hashed order
    form batches of floor(batch_tokens / bucket_len) pieces (one at least), so that a batch padded to its
    bucket's length keeps to the budget; only the last batch of a bucket may be short.

    A bucket may hold a third of all rows, so its order is never in one task: pieces are dealt into blocks
    of about block_rows by hash, numbered inside their block, and the blocks of a bucket are offset by a
    running sum over block counts. A block that pieces of one repeated or missing id fill is numbered over many tasks
    by ranges of the same order, so batches are the same at every size.

    Cases: a null or negative length is 0; a document of length 0 is one piece of 0 tokens in the first
    bucket; repeated rows are packed each for itself; a null id is kept; an empty table gives no rows.
    Other columns of docs are left out.
    """
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    pieces = docs.select(F.col(id_col).alias("doc_id"), length.alias("_len")).select(
        "doc_id",
        "_len",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_len") / max_len) - 1, F.lit(0)))).alias("piece"),
    )
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece") * max_len).alias("start"),
        F.least(F.lit(max_len).cast("long"), F.col("_len") - F.col("piece") * max_len).alias("n_tokens"),
    )
    pieces = materialise(pieces, "pieces")
    histogram = pieces.groupBy("n_tokens").count().collect()
    lengths = np.array([r["n_tokens"] for r in histogram], dtype=np.int64)
    counts = np.array([r["count"] for r in histogram], dtype=np.int64)
    ends = optimal_boundaries(lengths, counts, buckets) or [max_len]
    blocks = max(1, -(-int(counts.sum()) // block_rows))
    bucket = F.lit(0)
    for k, end in enumerate(ends[:-1]):
        bucket = F.when(F.col("n_tokens") > end, F.lit(k + 1)).otherwise(bucket)
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string")))
    hashed = F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long")
    dealt = pieces.withColumn("bucket", bucket).withColumn("_hash", hashed).withColumn("_block", F.pmod("_hash", F.lit(blocks)))
    lens = F.array(*[F.lit(e).cast("long") for e in ends])
    full = materialise(dealt.groupBy("bucket", "_block").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * block_rows), "full-blocks")
    order = ["_hash", "doc_id", "piece", "n_tokens"]
    before = Window.partitionBy("bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket", "_block").agg(F.count("*").alias("_n")).select("bucket", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = lambda rows: rows.withColumn("_row", F.row_number().over(Window.partitionBy("bucket", "_block").orderBy(*order)) - 1)
    few = full.count()  # at most one in 4 * block_rows pieces
    if few:
        named = full.select("bucket", "_block")
        named = F.broadcast(named) if few <= BROADCAST_BLOCKS else named
        large = dealt.join(named, ["bucket", "_block"], "left_semi").withColumn("_g", F.concat_ws("-", "bucket", "_block"))
        sorted_apart = numbered(large, order, "full-pieces").withColumn("_row", F.col("_i")).drop("_g", "_i")
        numbered_pieces = placed(dealt.join(named, ["bucket", "_block"], "left_anti")).unionByName(sorted_apart)
    else:
        numbered_pieces = placed(dealt)
    ranked = numbered_pieces.join(offsets, ["bucket", "_block"])
    size = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    rank = F.col("_offset") + F.col("_row")
    return (
        ranked.withColumn("bucket_len", F.element_at(lens, F.col("bucket") + 1))
        .withColumn("batch_size", size)
        .select(
            "doc_id",
            "piece",
            "start",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(rank / F.col("batch_size")).cast("long").alias("batch_id"),
            F.pmod(rank, F.col("batch_size")).cast("long").alias("slot"),
            "batch_size",
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Batches over documents, with a document's words as its tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return pack(docs)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents
), pieces AS (
  SELECT doc_id, u.piece::BIGINT AS piece, u.piece * 8192 AS start, least(8192, n - u.piece * 8192) AS n_tokens
  FROM d, LATERAL (SELECT unnest(range(greatest((n + 8191) // 8192, 1))) AS piece) u
), lengths AS (
  SELECT n_tokens AS l, sum(count(*)) OVER (ORDER BY n_tokens)::BIGINT AS total FROM pieces GROUP BY n_tokens
), h AS (
  SELECT list(l ORDER BY l) AS l, list(total ORDER BY l) AS total, count(*)::BIGINT AS n FROM lengths
), layers AS (
  SELECT 1::BIGINT AS k, list_prepend(0::BIGINT, [total[j] * l[j] for j in range(1, n + 1)]) AS best, [0::BIGINT for j in range(n + 1)] AS cut FROM h
  UNION ALL
  SELECT k + 1, [c.cost for c in chosen], [c.cut for c in chosen] FROM (
    SELECT k, [CASE WHEN j = 0 THEN {'cost': 0::BIGINT, 'cut': 0::BIGINT}
               ELSE list_min([{'cost': best[i + 1] + (total[j] - CASE WHEN i = 0 THEN 0 ELSE total[i] END) * l[j], 'cut': i} for i in range(j)]) END
               for j in range(n + 1)] AS chosen
    FROM layers, h WHERE k < least(16, n))
), back AS (
  SELECT least(16, n) AS k, n AS j FROM h
  UNION ALL
  SELECT b.k - 1, x.cut[b.j + 1] FROM back b JOIN layers x ON x.k = b.k WHERE x.cut[b.j + 1] > 0
), ends AS (
  SELECT h.l[j] AS e, row_number() OVER (ORDER BY j) - 1 AS bucket, coalesce(lag(h.l[j]) OVER (ORDER BY j), -1) AS before FROM back, h
), placed AS (
  SELECT p.*, e.bucket::INT AS bucket, e.e AS bucket_len, greatest(65536 // greatest(e.e, 1), 1) AS batch_size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || piece), 1, 15))::BIGINT AS h, (count(*) OVER () + 19999) // 20000 AS blocks
  FROM pieces p JOIN ends e ON p.n_tokens <= e.e AND p.n_tokens > e.before
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h % blocks, h, doc_id, piece, n_tokens) - 1 AS r FROM placed
)
SELECT doc_id, piece, start, n_tokens, bucket, bucket_len, r // batch_size AS batch_id, r % batch_size AS slot, batch_size FROM ranked
"""
