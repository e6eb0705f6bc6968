"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.llm.texts import word_count
from loomwork.session import cut_lineage, materialise

#: Sources up to which the table of one row per source is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources in code-point order, null last, take the weights in turn. Together they get share times all
    sizes, each at most ceiling times its own; what a source can't hold is shared again by weight until
    none is above. That end state has a closed form: with sources ordered by size over weight, the first
    ones are full and the others split the rest by weight. One row per source is all that meets in one
    task here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    upto, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level = (
        weighed.withColumn("_turn", F.row_number().over(fill))
        .withColumn("_total", F.sum("source_size").over(all_rows))
        .withColumn("_full_before", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("_w_from", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
        .withColumn("_rate", (F.lit(share) * F.col("_total") - F.lit(ceiling) * F.col("_full_before")) / F.col("_w_from"))
        .withColumn("_full", F.col("_rate") * F.col("_w") >= F.lit(ceiling) * F.col("source_size"))
    )
    rate = F.min(F.when(~F.col("_full"), F.struct(F.col("_turn"), F.col("_rate")))).over(all_rows)
    return level.select(
        "source",
        "source_size",
        F.when(F.col("_full"), F.lit(ceiling) * F.col("source_size")).otherwise(rate["_rate"] * F.col("_w")).alias("target"),
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps and variants, which can't be hashed, count by their JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    plain = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`")
    return F.xxhash64(*[plain(c) for c in docs.columns])


def uniform(ident: Column, seed: int, otherwise: Column | None = None) -> Column:
    """A number in (0, 1) that depends on the id and the seed, and on `otherwise` where there is no id; 52 bits of MD5."""
    named = F.coalesce(ident.cast("string"), F.lit("null") if otherwise is None else F.concat(F.lit("null:"), otherwise.cast("string")))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), named))
    return (F.conv(F.substring(mixed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _copies(keyed: DataFrame, weights: tuple[float, ...], share: float, ceiling: float, bucket_rows: int) -> DataFrame:
    """keyed(_source, _size, _key, _tie, ...) with source_size, target, epochs and copies of each row; told in mix_sources."""
    sums = cut_lineage(keyed.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows")))
    named = sums.select(F.expr("if(_source = '', null, substring(_source, 2))").alias("source"), "source_size")
    targets = source_targets(named, list(weights), share, ceiling)
    plan = (
        targets.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .join(sums.select("_source", "_rows"), "_source")
        .select(
            "_source",
            "source_size",
            "target",
            F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long").alias("epochs"),
            F.ceil(F.col("_rows") / bucket_rows).cast("long").alias("_buckets"),
        )
        .withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    if sums.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    known = keyed.join(plan, "_source").withColumn("_bucket", F.floor(F.log("_key") * F.col("_buckets") / math.e))
    steps = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        known.groupBy("_source", "_bucket")
        .agg(F.sum("_size").alias("_sum"))
        .select("_source", "_bucket", F.coalesce(F.sum("_sum").over(steps), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_source", "_bucket"])
    taken = (F.col("_start") + F.col("_before") + F.col("_size") / 2.0 < F.col("_budget")) & (F.col("_size") > 0)
    return placed.select("_id", "_tie", "source_size", "target", "epochs", (F.col("epochs") + taken.cast("long")).alias("copies"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    quality_col: str | None = None,
    quality: DataFrame | None = None,
    mark_col: str | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    bucket_rows: int = 1_000,
) -> DataFrame:
    """docs with source_size, target, epochs (complete ones) and copies (how often each document is taken).

    Every document is taken once for each complete epoch that its source's target holds. The rest of the
    target is a budget for Efraimidis-Spirakis sampling without replacement: the key -ln(u)/quality, least
    first, sizes summed along that order. A document is taken as long as more than half of it lies within
    the budget, so a source ends within half a document of its target and never takes part of a text.
    Quality comes from quality_col or from a table quality(label_id, quality_weight).

    Only ids, sizes and keys are sorted and summed; documents meet their numbers once, by id and mark, a hash of the row
    or the column mark_col that stands for it. A source may hold a third of all rows, so its order is never in one task:
    keys fall into buckets by their logarithm, which keeps their order; sizes are summed per bucket, a window over
    the few buckets gives each its start, and only the rows of one bucket are sorted together. The logarithm of an
    exponential key has a density of at most 1/e whatever its rate, so a bucket expects bucket_rows rows at
    most however the quality weights are spread.

    Cases: a null source is a source, last in order; null or negative sizes are 0 and such documents are
    never taken beyond the epochs; a null quality is 1; rows without an id have keys by their mark, so that any
    number of them spreads over the buckets; rows of one id have equal keys and are ordered by size, then by mark, so
    that reruns agree; of equal rows as many are taken as the budget holds, no matter which; an empty table gives an
    empty result. Columns of docs named like the new ones are replaced.
    """
    new = ("source_size", "target", "epochs", "copies")
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    own = F.lit(1.0) if quality_col is None else F.coalesce(F.col(quality_col).cast("double"), F.lit(1.0))
    mark = row_hash(docs) if mark_col is None else F.col(mark_col)
    rows = docs.select(F.col(id_col).alias("_id"), mark.alias("_tie"), F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("_source"), size.alias("_size"), own.alias("_own"))
    if quality is not None:
        known = quality.select(F.col("label_id").alias("_id"), F.col("quality_weight").cast("double").alias("_weight"))
        rows = rows.join(known, "_id", "left").withColumn("_own", F.coalesce("_weight", "_own"))
    key = -F.log(uniform(F.col("_id"), seed, F.col("_tie"))) / F.greatest(F.col("_own"), F.lit(1e-9))
    keyed = materialise(rows.select("_id", "_tie", "_source", "_size", key.alias("_key")), "mix-keys")
    each = _copies(keyed, weights, share, ceiling, bucket_rows).groupBy("_id", "_tie").agg(
        *[F.first(c).alias(c) for c in new[:3]], F.min("copies").alias("copies"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("_more")
    )
    each = materialise(each, "mix-copies")
    held = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row")
    marked = docs.select(held, F.col(id_col).alias("_own_id"), mark.alias("_own_tie"))
    met = marked.join(each.hint("merge"), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_tie") == F.col("_tie")))
    names = [*docs.columns, *[c for c in new if c not in docs.columns]]
    shown = lambda df: df.select(*[F.col(c) if c in new else F.col(f"_row.`{c}`") for c in names])
    if each.where("_more > 0").isEmpty():
        return shown(met)
    # Equal rows at the end of a source's budget: one stands for all, and some of them get a copy more.
    group = met.where("_more > 0").groupBy("_id", "_tie").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in (*new, "_more")])
    split = group.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn("copies", F.col("copies") + (F.col("_k") <= F.col("_more")).cast("long"))
    return shown(met.where("_more = 0")).unionByName(shown(split))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(label_id, quality_weight) with one row per labelled id; the best label counts where an id has several."""
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.when(F.max("quality") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("quality_weight"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(materialise(docs, "mix-sizes"), quality=quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
            / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER b, 0)) AS rate
  FROM weighed
  WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN rate * w >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
              ELSE w * first_value(rate) OVER (ORDER BY rate * w >= 2.0::DOUBLE * source_size, source_size / w, source NULLS LAST) END AS target
  FROM levels
), keyed AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
         -ln((('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
           / coalesce(q.weight, 1.0::DOUBLE) AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
             FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = s.doc_id
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM placed
"""
