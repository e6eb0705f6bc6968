"""Exact top-k inner products by ball-tree branch and bound in every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.llm.sequence_files import filesystem
from loomwork.session import materialise, scratch_path

#: Cells that are broadcast at most, with their number of shards; beyond, the same join goes by shuffle.
BROADCAST_CELLS = 50_000
LOWEST = -(2**63)


@dataclass
class BallTree:
    """Nodes in arrays: rows[first:last] of the reordered vectors, centre, radius, children (-1 at leaves); node 0 is the root."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def build(vectors: np.ndarray, leaf: int = 64) -> BallTree:
    """Split at the median along the axis of largest variance until `leaf` rows or fewer are left."""
    points = vectors.astype(np.float64)
    order = np.arange(len(points))
    first, last, left, right, centres, radii = [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        mine = points[order[lo:hi]]
        centre = mine.mean(axis=0)
        first.append(lo)
        last.append(hi)
        centres.append(centre)
        radii.append(float(np.sqrt(((mine - centre) ** 2).sum(axis=1).max())))
        left.append(-1)
        right.append(-1)
        return len(first) - 1

    todo = [node(0, len(order))]
    while todo:
        at = todo.pop()
        lo, hi = first[at], last[at]
        if hi - lo <= leaf or radii[at] == 0:
            continue
        mine = points[order[lo:hi]]
        axis = int(mine.var(axis=0).argmax())
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(mine[:, axis], half)]
        left[at], right[at] = node(lo, lo + half), node(lo + half, hi)
        todo += [left[at], right[at]]
    nodes = (np.array(x, dtype=np.int64) for x in (first, last, left, right))
    return BallTree(order, *nodes, np.array(centres), np.array(radii))


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball a number that no inner product with a point of the ball exceeds; rounding is allowed for."""
    real = queries.astype(np.float64)
    norms = np.sqrt((real**2).sum(axis=1))
    reach = np.sqrt((centres**2).sum(axis=1)) + radii
    return real @ centres.T + norms[:, None] * radii[None, :] + 1e-9 * norms[:, None] * reach[None, :] + 1e-6


def search(tree: BallTree, data: np.ndarray, named: np.ndarray, copies: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int):
    """For each query the rows among its k best of this tree that reach its floor: (query, id, score, copies) lists.

    Vectors, ids and numbers of copies are in the tree's order.

    A node's inner products are at most q.centre + |q| * radius. Nodes are visited from the highest bound
    down, and the search ends when no bound reaches the kth score known so far: the floor that other shards
    have shared, or better ones met here. Equal scores stay, so that ties can be settled by id.
    """
    bounds = upper_bounds(queries, tree.centres, tree.radii)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i in range(len(queries)):
        q, own, bound = queries[i], query_ids[i], bounds[i]
        kth, best = floors[i], []
        heap, found_rows, found = [(-bound[0], 0)], [], []
        while heap:
            up, at = heapq.heappop(heap)
            if -up < kth:
                break
            if tree.left[at] >= 0:
                for child in (tree.left[at], tree.right[at]):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            rows = slice(tree.first[at], tree.last[at])
            scores = data[rows] @ q
            good = (scores >= kth) & (named[rows] != own)
            if not good.any():
                continue
            found_rows.append(tree.first[at] + np.flatnonzero(good))
            found.append(scores[good])
            for s in scores[good].tolist():
                if len(best) < k:
                    heapq.heappush(best, s)
                elif s > best[0]:
                    heapq.heapreplace(best, s)
            if len(best) == k:
                kth = max(kth, best[0])
        if found:
            s, rows = np.concatenate(found), np.concatenate(found_rows)
            keep = np.lexsort((named[rows], -s))[:k]
            out[0].extend([own] * len(keep))
            out[1].extend(named[rows[keep]].tolist())
            out[2].extend(s[keep].tolist())
            out[3].extend(copies[rows[keep]].tolist())
    return out


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim, query) with v = floor(scale * x) for each component as a double; query is true or null.

    Rows whose id or vector is null, or whose vector is empty or holds a null or non-finite component, are
    left out.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & finite)
    return kept.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"),
        F.size(vector_col).alias("dim"),
        F.when(is_query, F.lit(True)).alias("query"),
    )


@dataclass
class Cells:
    """Median splits of a sample along the axes of largest variance; the leaves are cells of near vectors."""

    axis: list[int]
    at: list[float]
    below: list[int]  # a node, or -1 - cell
    above: list[int]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector; all are in cell 0 where nothing was split."""
        node = np.zeros(len(vectors), dtype=np.int64) if self.axis else np.full(len(vectors), -1)
        axis, at, below, above = (np.array(x) for x in (self.axis, self.at, self.below, self.above))
        while (inner := np.flatnonzero(node >= 0)).size:
            k = node[inner]
            node[inner] = np.where(vectors[inner, axis[k]] < at[k], below[k], above[k])
        return -1 - node


def fit_cells(sample: np.ndarray, wanted: int, least: int = 32) -> Cells:
    """About `wanted` cells, each with `least` or more vectors of the sample; equal vectors share a cell."""
    cells = Cells([], [], [], [])
    groups, links, leaves = [np.arange(len(sample))], [None], 1
    while leaves < wanted and groups:
        biggest = max(range(len(groups)), key=lambda k: len(groups[k]))
        rows, link = groups.pop(biggest), links.pop(biggest)
        mine = sample[rows]
        axis = int(mine.var(axis=0).argmax()) if len(rows) >= 2 * least else -1
        split = float(np.median(mine[:, axis])) if axis >= 0 else 0.0
        low = mine[:, axis] < split if axis >= 0 else np.zeros(len(rows), dtype=bool)
        if min(low.sum(), (~low).sum()) < least:
            continue  # stays a leaf
        node = len(cells.axis)
        if link is not None:
            (cells.below if link[1] else cells.above)[link[0]] = node
        cells.axis.append(axis)
        cells.at.append(split)
        cells.below.append(-1)
        cells.above.append(-1)
        for side, part in ((True, rows[low]), (False, rows[~low])):
            groups.append(part)
            links.append((node, side))
        leaves += 1
    cell = 0
    for side in (cells.below, cells.above):
        for k, x in enumerate(side):
            if x < 0:
                side[k], cell = -1 - cell, cell + 1
    return cells


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def write_tree(url: str, rows: pa.Table) -> BallTree:
    """Build the ball tree of rows(vec_id, v, copies) and write it, nodes first, then the rows in the tree's order."""
    rows = rows.select(["vec_id", "v", "copies"]).combine_chunks()
    vectors = _matrix(rows.column("v").combine_chunks())
    tree = build(vectors)
    centre = pa.FixedSizeListArray.from_arrays(pa.array(tree.centres.ravel()), vectors.shape[1])
    nodes = pa.table({"first": tree.first, "last": tree.last, "left": tree.left, "right": tree.right, "centre": centre, "radius": tree.radii})
    fs, path = filesystem(url)
    part = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part) as out:
        for table in (nodes, rows.take(pa.array(tree.order))):
            with pa.ipc.new_stream(out, table.schema) as stream:
                stream.write_table(table)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)  # of an earlier attempt at the same shard
    fs.move(part, path)
    return tree


def read_tree(url: str) -> tuple[BallTree, np.ndarray, np.ndarray, np.ndarray]:
    """A tree of write_tree and its rows' vectors, ids and numbers of copies, in the tree's order."""
    fs, path = filesystem(url)
    with fs.open_input_file(path) as file:
        nodes, rows = (pa.ipc.open_stream(file).read_all().combine_chunks() for _ in range(2))
    first, last, left, right, radius = (nodes.column(c).to_numpy() for c in ("first", "last", "left", "right", "radius"))
    tree = BallTree(np.arange(rows.num_rows), first, last, left, right, _matrix(nodes.column("centre").combine_chunks()), radius)
    return tree, _matrix(rows.column("v").combine_chunks()), rows.column("vec_id").to_numpy(), rows.column("copies").to_numpy()


def write_trees(stored: DataFrame, folder: str) -> DataFrame:
    """Build each shard's ball tree, once: (shard, dim, path, centre, radius), one row per shard.

    stored has shard, dim, vec_id, v and copies; the vectors of a shard have one length. A repeated task writes the same
    file again.
    """

    def run(key, rows):
        shard = key[0].as_py()
        path = f"{folder}/{shard}.arrow"
        tree = write_tree(path, rows)
        dim = pa.array([tree.centres.shape[1]], pa.int32())
        return pa.table({"shard": [shard], "dim": dim, "path": [path], "centre": [tree.centres[0].tolist()], "radius": [float(tree.radii[0])]})

    return stored.groupBy("shard").applyInArrow(run, "shard string, dim int, path string, centre array<double>, radius double")


def _sharded(stored: DataFrame, shard_rows: int, sample_rows: int) -> DataFrame:
    """stored with its shard: a cell of near vectors, cut by hash of id into parts of about shard_rows.

    Cells are fitted to a sample of about sample_rows vectors of the commonest length, which tells where they lie and
    nothing else; how many parts each gets is counted over all vectors. Other lengths have one cell each.
    """
    most = stored.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        return stored.withColumn("shard", F.lit(""))
    n, dim = most["n"], most["dim"]
    share = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))
    taken = [r["v"] for r in stored.where((F.col("dim") == dim) & share).select("vec_id", "v").orderBy("vec_id", "v").limit(2 * sample_rows).collect()] if n > shard_rows else []
    cells = fit_cells(np.array(taken, dtype=np.int64).reshape(-1, dim), -(-n // shard_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int64)
            here = np.flatnonzero(batch.column(2).to_numpy() == dim)
            cell[here] = cells.of(_matrix(batch.column(1).take(pa.array(here))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "dim", "copies", "cell"])

    routed = materialise(stored.select("vec_id", "v", "dim", "copies").mapInArrow(route, "vec_id long, v array<long>, dim int, copies long, cell long"), "routed")
    counts = materialise(routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), "cells")
    few = F.broadcast(counts) if counts.count() <= BROADCAST_CELLS else counts
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return routed.join(few, ["dim", "cell"]).withColumn("shard", F.concat_ws("-", "dim", "cell", part)).drop("cell", "parts")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    shard_rows: int = 8192,
    most_shards: int = 65_536,
    query_rows: int = 16_384,
    sample_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products, ties to the smaller id.

    Vectors are dealt to shards of about shard_rows near ones (more, where there would be over most_shards). Each
    shard's ball tree is built once and written to the shared folder; a small table holds the trees' roots. A query
    searches the shards in the order of their roots' upper bounds, in rounds of 1, 2, 4, ... shards: before each
    round its floor is its kth score so far, from whatever shards, and a shard whose bound is below the floor is left
    out before the query travels there; inside a tree, nodes below the floor are never opened. Queries stream through
    a tree that a task has read, at most query_rows of one shard to a partition's key.

    The search is exact: bounds are rounded up and equal scores kept. Scores must stay below 2**63.

    Cases: vectors null or with null or non-finite components take no part, nor do null ids; a query meets
    candidates of its own length only; rows with the query's id are not its candidates; repeated candidate
    rows each take a rank, but are kept once with their number; repeated query rows count once; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    marked = materialise(quantised(vectors, is_query, id_col, vector_col), "vectors")
    stored = materialise(marked.groupBy("vec_id", "v", "dim").agg(F.count("*").alias("copies")), "stored")
    asked = marked.where("query").groupBy(F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), "dim").agg(F.lit(0).alias("_")).drop("_")
    sizes = marked.agg(F.count("*").alias("n"), F.count("query").alias("q")).first()
    blocks = max(1, -(-sizes["q"] // query_rows))
    folder = scratch_path(spark, "ball-trees")
    roots_path = f"{folder}/roots"
    write_trees(_sharded(stored, max(shard_rows, -(-sizes["n"] // most_shards)), sample_rows), f"{folder}/trees").write.parquet(roots_path)
    shards = spark.read.parquet(roots_path).count()

    def choose(turn: int):
        """The shards of one round for each query, by the roots' bounds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, place = filesystem(roots_path)
            roots = pq.read_table(place, filesystem=fs).sort_by("shard")
            kinds = roots.column("dim").to_numpy()
            for batch in batches:
                out: list[pa.RecordBatch] = []
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    balls = roots.filter(pa.array(kinds == dim)).combine_chunks()
                    centres, radii = _matrix(balls.column("centre").combine_chunks()), balls.column("radius").to_numpy()
                    rows = np.flatnonzero(dims == dim)
                    for at in range(0, len(rows), max(1, (1 << 22) // len(radii))):
                        some = batch.take(pa.array(rows[at : at + max(1, (1 << 22) // len(radii))]))
                        bounds = upper_bounds(_matrix(some.column(1)), centres, radii)
                        order = np.argsort(-bounds, axis=1, kind="stable")[:, (1 << turn) - 1 : (2 << turn) - 1]
                        good = np.take_along_axis(bounds, order, axis=1) >= some.column(3).to_numpy()[:, None]
                        i, j = np.nonzero(good)
                        mine, ball = some.take(pa.array(i)), pa.array(order[i, j])
                        columns = [mine.column(0), mine.column(1), mine.column(3), balls.column("shard").take(ball).combine_chunks(), balls.column("path").take(ball).combine_chunks()]
                        out.append(pa.RecordBatch.from_arrays(columns, ["query_id", "asked", "floor", "shard", "path"]))
                yield from out

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            paths = np.array(batch.column(4).to_pylist(), dtype=object)
            edges = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if paths[a] != current:
                    current, held = paths[a], read_tree(paths[a])
                tree, data, ids, copies = held
                some = batch.slice(a, b - a)
                found = search(tree, data, ids, copies, _matrix(some.column(1)), some.column(0).to_numpy(), some.column(2).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score", "copies"])

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long, copies long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(shards.bit_length()):
        floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
        floored = asked.join(floors, "query_id", "left").select("query_id", "asked", "dim", F.coalesce("least", F.lit(LOWEST)).alias("floor"))
        wanted = floored.mapInArrow(choose(turn), "query_id long, asked array<long>, floor long, shard string, path string")
        dealt = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(tasks, "shard", "block").sortWithinPartitions("path")
        hits = dealt.select("query_id", "asked", "floor", "shard", "path").mapInArrow(meet, "query_id long, vec_id long, score long, copies long")
        ranked = best.unionByName(hits).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        best = materialise(ranked.drop("rank"), f"best-{turn}")
    each = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    return each.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Ten best of every hundredth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
