"""Line deduplication: lines that many documents share go, the others stay in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.llm.texts import SPACES, lower_ascii
from loomwork.session import materialise


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key_hashes(line: Column) -> tuple[Column, Column]:
    """128 bits of hash of the normalised line, as two longs from two seeds."""
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _mark, _pos, h1, h2) of every line whose key has min_chars code points or more, written to the shared folder.

    _mark tells texts of one id apart. Lines are split and normalised here alone.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
    h1, h2 = _key_hashes(F.col("_line"))
    kept = lines.where(F.length(F.btrim("_line", F.lit(SPACES))) >= min_chars)
    return materialise(kept.select("_id", "_mark", "_pos", h1.alias("h1"), h2.alias("h2")), "line-keys")


def frequent_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, rows) of every key of line_keys found in at least min_docs documents, with the number of its lines.

    Rows of one id are one document, all rows without an id together another. The rows are first made
    distinct by (key, document), which spreads a line that a third of all documents hold over the
    shuffle; only then are documents counted, with partial sums before the exchange.
    """
    pairs = keys.groupBy("h1", "h2", "_id").agg(F.count("*").alias("_rows"))
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("_docs"), F.sum("_rows").alias("rows"))
    return counted.where(F.col("_docs") >= min_docs).select("h1", "h2", "rows")


def lines_with(keys: DataFrame, frequent: DataFrame, broadcast_keys: int = 10_000) -> DataFrame:
    """The rows of keys whose (h1, h2) is in frequent(h1, h2, rows), whatever the share of one key.

    Keys that hold at least one in broadcast_keys of all frequent lines are broadcast: there can't be more of them
    than broadcast_keys. Their lines are known without a shuffle and take a spread key in the other keys' join.
    """
    frequent = materialise(frequent, "frequent-keys")
    total = frequent.agg(F.sum("rows")).first()[0] or 0
    hot = frequent.where(F.col("rows") * broadcast_keys >= total).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    rest = frequent.where(F.col("rows") * broadcast_keys < total).select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"))
    places = ["_id", "_mark", "_pos"]
    is_hot = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    if rest.isEmpty():
        return keys.join(F.broadcast(hot), is_hot, "left_semi").select(*places)
    marked = keys.join(F.broadcast(hot), is_hot, "left")
    spread = F.when(F.col("_h1").isNotNull(), F.xxhash64(*places)).otherwise(F.col("h1"))
    found = marked.withColumn("_k1", spread).withColumnRenamed("h2", "_k2").join(rest.withColumn("_found", F.lit(True)), ["_k1", "_k2"], "left")
    return found.where(F.col("_h1").isNotNull() | F.col("_found")).select(*places)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """docs with the frequent lines taken out of text_col, and n_lines (before) and n_dropped added.

    Normalised lines are exploded and hashed, documents are counted for each hash, and the lines whose
    hash reaches min_docs are found again by their hash. Positions, not lines, travel back
    to the documents, where the remaining lines are put together in order. The text itself is shuffled
    once, as its lines.

    Cases: a null or empty text is one empty line and becomes ''; lines without characters besides white
    space have keys of no code points and always stay; repeated rows of one id count as one document and
    each come back; all rows without an id count as one document and each come back; an empty table gives
    an empty result. Columns of docs named n_lines or n_dropped are replaced; all others pass through.
    """
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(c) for c in docs.columns if c != text_col])
    keys = line_keys(docs, id_col, text_col, min_chars)
    ident, mark = F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    drops = lines_with(keys, frequent_keys(keys, min_docs)).groupBy("_id", "_mark").agg(F.collect_set("_pos").alias("_drops"))
    whole = docs.select(held.alias("_row"), ident.alias("_id"), mark.alias("_mark"), _lines(F.col(text_col)).alias("_lines"))
    found = whole.alias("w").join(
        drops.alias("d"), F.col("w._id").eqNullSafe(F.col("d._id")) & (F.col("w._mark") == F.col("d._mark")), "left"
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    text = F.when(F.col("_drops").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    )
    made = {
        text_col: text,
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return found.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """Digest of dedup_lines over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs, min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS pos) u
), frequent AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, f.key IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
