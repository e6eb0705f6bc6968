"""Merkle manifest of a dataset: a tree of digests for each group of rows, one tree over the groups, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.llm.ordering import group_key, numbered
from loomwork.llm.texts import CRC32_SQL, lower_ascii
from loomwork.session import materialise

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together; parts that are null are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field `-` if null, else its UTF-8 byte count, `:` and its value."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int, name: str, carry: bool = False) -> DataFrame:
    """Parents (_g, _i, c0, c1, ..., h) of nodes (_g, _i, h): conditional aggregates spread the children of each into columns.

    h is the digest of the columns put together; the only node of a group passes its own on and is lone. With carry, the
    column row of each child comes along as r0, r1, ...
    """
    slot = F.expr(f"_i % {fanout}")
    spread = [F.max(F.when(slot == s, F.col(c))).alias(f"{p}{s}") for p, c in [("c", "h")] + [("r", "row")] * carry for s in range(fanout)]
    parents = nodes.groupBy("_g", F.expr(f"_i div {fanout}").alias("_i")).agg(*spread)
    lone = (F.col("_i") == 0) & F.col("c1").isNull()
    return materialise(parents.withColumns({"lone": lone, "h": F.when(lone, F.col("c0")).otherwise(digest(*_slots(fanout)))}), name)


def _levels(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The pivots of all levels from the leaves' parents up; the last has one row a group, whose h is the group's top."""
    levels = [_pivot(nodes, fanout, f"{name}-1", carry=True)]
    top = levels[0].agg(F.max("_i")).first()[0] or 0
    while top > 0:
        levels.append(_pivot(levels[-1].select("_g", "_i", "h"), fanout, f"{name}-{len(levels) + 1}"))
        top //= fanout
    return levels


def _siblings(slot: Column, fanout: int) -> Column:
    """What stands left and right of a child in its run, as an array of one struct; empty for a lone node."""
    children = F.array(*_slots(fanout))
    left = F.concat_ws("", F.slice(children, F.lit(1), slot))
    right = F.concat_ws("", F.slice(children, slot + 2, F.lit(fanout - 1) - slot))
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.when(F.col("lone"), F.slice(step, 1, 0)).otherwise(step)


def _down(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(row, leaf, path, and what above(_g, path, ...) has of each group) of every leaf; path lists its siblings upwards.

    The path of a node is carried down from its parent, one level a join: the parents' table is a fanout smaller than
    the children's, and leaves come out of their parents' columns without a join of their own.
    """
    kept = [c for c in above.columns if c not in ("_g", "path")]
    known = levels[-1].join(above, "_g")
    for level in reversed(levels[:-1]):
        slot = F.expr(f"_child % {fanout}").cast("int")
        own = level.withColumnsRenamed({"_i": "_child"}).withColumn("_i", F.expr(f"_child div {fanout}"))
        upper = known.select("_g", "_i", F.array(*_slots(fanout)).alias("_upper"), "path", F.col("lone").alias("_lone"), *kept)
        both = own.join(upper, ["_g", "_i"])
        unfold = {f"c{s}": F.col("_upper")[s] for s in range(fanout)} | {"lone": F.col("_lone")}
        steps = both.select("_g", "_child", "path", *kept, *[v.alias(k) for k, v in unfold.items()], F.struct(*level.columns[2:]).alias("_own"))
        known = steps.select("_g", F.col("_child").alias("_i"), *kept, "_own.*", F.concat(_siblings(slot, fanout), "path").alias("path"))
    each = [F.struct(F.col(f"r{s}").alias("row"), F.col(f"c{s}").alias("leaf"), F.concat(_siblings(F.lit(s), fanout), "path").alias("path")) for s in range(fanout)]
    leaves = known.select(*kept, F.explode(F.array(*each)).alias("_leaf")).select("_leaf.*", *kept)
    return leaves.where("leaf IS NOT NULL")


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: list[str] | None = None,
    carry: dict[str, Column] | None = None,
    fanout: int = 8,
) -> DataFrame:
    """One row per row of docs: id_col, the columns of carry, leaf, path, subroot, root.

    Within each group rows stand in ascending order of id; every `fanout` consecutive nodes become the digest of
    their digests until one is left, the subroot. Subroots, in the order of their groups (null first, bytewise),
    become the root likewise. path lists (left, right), the digests beside the node at each level up to the root:
    fold(leaf, path) is the root, proof(path) the digest of all of them. Trees grow by one aggregate a level, and only
    leaves and digests are shuffled, never texts.

    Cases: null ids come first, rows of one id stand in the order of their leaves, equal rows have proofs of their own;
    null groups are one group; a null field is told from an empty one; an empty table gives no rows and no root;
    the lone row of a group is its own subroot, the lone group's subroot the root. Other columns are left out,
    whatever their names, unless fields or carry name them.
    """
    fields, carry = fields or FIELDS, carry or {}
    row = F.struct(F.col(f"`{id_col}`").alias(id_col), *[c.alias(k) for k, c in carry.items()])
    leaves = docs.select(group_key(F.col(f"`{group_col}`")).alias("_g"), F.col(f"`{id_col}`").alias("_id"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("h"), row.alias("row"))
    nodes = numbered(materialise(leaves, "merkle-leaves"), ["_id", "h"], "merkle-nodes").select("_g", "_i", "h", "row")
    groups = _levels(nodes, fanout, "merkle")
    tops = groups[-1].select(F.lit("").alias("_g"), F.col("_g").alias("row"), "h")
    upper = _levels(numbered(tops, ["row"], "merkle-tops").select("_g", "_i", "h", "row"), fanout, "merkle-top")
    empty = F.slice(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), 1, 0)
    above = _down(upper, upper[-1].select("_g", F.col("h").alias("root"), empty.alias("path")), fanout)
    known = above.select(F.col("row").alias("_g"), "path", F.col("leaf").alias("subroot"), "root")
    return _down(groups, known, fanout).select("row.*", "leaf", "path", "subroot", "root")


def proof(path: Column) -> Column:
    """Digest of all siblings of a leaf, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to beside these siblings."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents, and the roots that rows lead to once a third of them is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(struck, leaf_digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    made = manifest(docs, carry={"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    checked = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of a tree over {name}0 (g, i, h): {name}p<k> has the children of each node of level k + 1, if its group has several."""
    steps = []
    for k in range(levels):
        steps.append(f"{name}p{k} AS (SELECT g, i // 8 AS i, list(h ORDER BY i) AS hs FROM {name}{k} WHERE g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) > 1) GROUP BY g, i // 8)")
        steps.append(f"{name}{k + 1} AS (SELECT g, i, sha256(array_to_string(hs, '')) AS h FROM {name}p{k})")
    tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) = 1)" for k in range(levels + 1))
    return ", ".join(steps) + f", {name}top AS ({tops})"


def _fold_sql(start: str, name: str, table: str, levels: int) -> str:
    """CTEs {name}1, {name}2, ... that lead (id, g, i, f, proof) of `start` up the tree `table`."""
    steps, last = [], start
    for k in range(levels):
        left, right = "coalesce(array_to_string(p.hs[1:t.i % 8], ''), '')", "coalesce(array_to_string(p.hs[t.i % 8 + 2:], ''), '')"
        steps.append(
            f"{name}{k + 1} AS (SELECT t.rid, t.g, t.i // 8 AS i, CASE WHEN p.g IS NULL THEN t.f ELSE sha256({left} || t.f || {right}) END AS f, "
            f"CASE WHEN p.g IS NULL THEN t.proof ELSE t.proof || {left} || {right} END AS proof FROM {last} t LEFT JOIN {table}p{k} p ON p.g = t.g AND p.i = t.i // 8)"
        )
        last = f"{name}{k + 1}"
    return ", ".join(steps)


def oracle_sql(levels: int = 10) -> str:
    """The manifest of documents in SQL, for up to 8 ** levels rows a group."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:4], text]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
         CASE WHEN {CRC32_SQL.format("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} END AS tampered
  FROM documents
), d AS (
  SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS rid,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM rows_
), t0 AS (SELECT g, i, leaf AS h FROM d), {_tree_sql("t", levels)},
u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS lang FROM ttop), {_tree_sql("u", 3)},
s0 AS (SELECT rid, g, i, coalesce(tampered, leaf) AS f, '' AS proof FROM d), {_fold_sql("s0", "s", "t", levels)},
v0 AS (SELECT s.rid, '' AS g, u.i, s.f, s.proof FROM s{levels} s JOIN u0 u ON u.lang = s.g), {_fold_sql("v0", "v", "u", 3)}
SELECT d.doc_id, d.leaf, ttop.h AS subroot, utop.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = utop.h AS verified
FROM d JOIN v3 v USING (rid) JOIN ttop ON ttop.g = d.g CROSS JOIN utop
"""


ORACLE_SQL = oracle_sql()
