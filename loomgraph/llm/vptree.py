"""Nearest neighbours by vantage-point trees, one tree per shard of vectors.

Shards are cut from the input as it is read, so building moves no vector.
Queries are packed into blocks, and every shard meets every block in one cell
of a grid. A subtree is left out when the triangle inequality puts all of it
farther than the current k-th distance divided by `factor`: a factor of one is
exact search, a larger one prunes more and may miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize


@dataclass(frozen=True)
class Params:
    """`shard_rows` vectors at most make a tree, `block_rows` queries a block; a cell of the grid holds about `per_cell` of either."""

    k: int = 10
    factor: float = 1.0
    shard_rows: int = 4096
    block_rows: int = 1024
    leaf_rows: int = 256
    per_cell: int = 4
    seed: int = 5


INDEX = "shard long, dim int, ids array<long>, vectors binary, nodes binary, ranges binary"
BLOCKS = "block long, dim int, ids array<long>, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed dimension by dimension in double precision."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        total += (points[:, j] - to[..., j]) ** 2
    return np.sqrt(total)


class Tree:
    """Points in node order; nodes (start, end, inner child, outer child) whose first point is the vantage point; the ranges of distances to it in either child."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, ranges: np.ndarray):
        self.ids, self.points, self.nodes, self.ranges = ids, points, nodes, ranges
        self.norms = np.einsum("ij,ij->i", points, points)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf_rows: int, seed: int) -> Tree:
        draw, order = np.random.default_rng(seed), np.arange(len(ids))
        nodes, ranges, todo = [[0, len(ids), -1, -1]], [[0.0] * 4], [0]
        while todo:
            at = todo.pop()
            start, end = nodes[at][:2]
            if end - start <= leaf_rows:
                continue
            pick = start + int(draw.integers(end - start))
            order[[start, pick]] = order[[pick, start]]
            far = _distances(points[order[start + 1 : end]], points[order[start]])
            by = np.argsort(far, kind="stable")
            order[start + 1 : end], far, half = order[start + 1 : end][by], far[by], len(far) // 2
            ranges[at] = [far[0], far[half - 1], far[half], far[-1]]
            for side, (a, b) in enumerate(((start + 1, start + 1 + half), (start + 1 + half, end))):
                nodes[at][2 + side] = len(nodes)
                todo.append(len(nodes))
                nodes.append([a, b, -1, -1])
                ranges.append([0.0] * 4)
        return cls(ids[order], points[order], np.array(nodes, np.int32), np.array(ranges))


class Nearest:
    """The k nearest points so far of each query of a block, by distance and then id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, factor: float):
        self.ids, self.points, self.k, self.factor = ids, points, k, factor
        self.norms, self.twice = np.einsum("ij,ij->i", points, points), -2 * points
        self.far, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.met = self.pairs = 0  # distances worked out at leaves, and pairs that exact search without a tree would compare

    def _offer(self, who: np.ndarray, tree: Tree, start: int, end: int) -> None:
        """Let the queries `who` take from the points start to end."""
        self.met += len(who) * (end - start)
        worst = self.far[who, -1]
        rough = self.twice[who] @ tree.points[start:end].T  # squared distances but for the queries' norms
        rough += tree.norms[start:end]
        limit = worst * worst - self.norms[who] + 1e-9 * (self.norms[who] + tree.norms[start:end].max())
        row, at = np.nonzero(~(rough > limit[:, None]))
        other = self.ids[who[row]] != tree.ids[start + at]
        row, at = row[other], at[other]
        if not len(row):
            return
        far = _distances(self.points[who[row]], tree.points[start + at])
        some = np.flatnonzero(far <= worst[row])
        row, at, far = row[some], at[some], far[some]
        hit = np.unique(row)
        row = np.concatenate([row, np.repeat(hit, self.k)])
        far = np.concatenate([far, self.far[who[hit]].ravel()])
        near = np.concatenate([tree.ids[start + at], self.near[who[hit]].ravel()])
        by = np.lexsort((near, far, row))
        row, far, near = row[by], far[by], near[by]
        firsts = np.searchsorted(row, hit)[:, None] + np.arange(self.k)
        self.far[who[hit]], self.near[who[hit]] = far[firsts], near[firsts]

    def search(self, tree: Tree) -> None:
        self.pairs += len(self.ids) * len(tree.ids)
        every = np.arange(len(self.ids))
        todo = [(0, every, np.zeros(len(every)))]
        while todo:
            at, who, bound = todo.pop()
            who = who[~(bound * self.factor > self.far[who, -1] * (1 + 1e-9))]
            if not len(who):
                continue
            start, end, inner, outer = tree.nodes[at]
            if inner < 0:
                self._offer(who, tree, start, end)
                continue
            self._offer(who, tree, start, start + 1)
            far = _distances(self.points[who], tree.points[start])
            least, middle, beyond, most = tree.ranges[at]
            bounds = np.maximum(least - far, far - middle), np.maximum(beyond - far, far - most)
            first = far <= (middle + beyond) / 2
            for side, own in ((outer, first), (inner, ~first), (inner, first), (outer, ~first)):
                if own.any():
                    todo.append((side, who[own], bounds[int(side == outer)][own]))


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, points) of usable vectors of one dimension, `rows` at most at a time."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[int, int] = {}
    for batch in batches:
        ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector")
        sizes = np.diff(lists.offsets.to_numpy())
        for dim in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero((sizes == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
            points = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim).astype(np.float64)
            good = np.isfinite(points).all(1) & (points != 0).any(1)
            kept.setdefault(dim, []).append((ids[own[good]].astype(np.int64), points[good]))
            held[dim] = held.get(dim, 0) + int(good.sum())
            while held[dim] >= rows:
                a, b = (np.concatenate(x) for x in zip(*kept[dim], strict=True))
                yield a[:rows], b[:rows]
                kept[dim], held[dim] = [(a[rows:], b[rows:])], held[dim] - rows
    for dim, n in held.items():
        if n:
            yield tuple(np.concatenate(x) for x in zip(*kept[dim], strict=True))


def _rows_of(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, vector): rows without an id left out; of rows that share an id the smallest vector counts."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector")).filter("vec_id is not null")
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def build_index(rows: DataFrame, p: Params) -> DataFrame:
    """One row for each shard of (vec_id, vector) rows: its tree, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, points) in enumerate(_batches(batches, p.shard_rows)):
            tree = Tree.build(ids, points, p.leaf_rows, p.seed)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (tree.points, tree.nodes, tree.ranges)]
            yield pa.record_batch([pa.array([(part << 32) | n]), pa.array([points.shape[1]], pa.int32()), pa.array([tree.ids], pa.list_(pa.int64())), *packed], ["shard", "dim", "ids", "vectors", "nodes", "ranges"])

    return rows.mapInArrow(run, INDEX)


def query_blocks(rows: DataFrame, p: Params) -> DataFrame:
    """(vec_id, vector) rows packed into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, points) in enumerate(_batches(batches, p.block_rows)):
            yield pa.record_batch([pa.array([(part << 32) | n]), pa.array([points.shape[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([points.tobytes()], pa.binary())], ["block", "dim", "ids", "vectors"])

    return rows.mapInArrow(run, BLOCKS)


def _grid(index: DataFrame, blocks: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Both sides with their cells (r, c): each shard in one row of the grid, each block in one column."""
    high, wide = (max(1, -(-x.count() // p.per_cell)) for x in (index, blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda name, n: F.pmod(F.xxhash64(name, F.lit(n)), F.lit(n)).cast("int")
    return index.select("*", place("shard", high).alias("r"), every(wide).alias("c")), blocks.select("*", place("block", wide).alias("c"), every(high).alias("r"))


def search(index: DataFrame, blocks: DataFrame, params: Params | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of every query of `blocks` in `index`, by distance and then vec_id, without rows of the query's own id.

    Vectors of another dimension than the query's are no candidates; a query
    with fewer than k candidates gets them all.
    """
    p = params or Params()

    def cell(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        matrix = lambda row: np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        blocks_ = [(row["dim"], Nearest(np.array(row["ids"], np.int64), matrix(row), p.k, p.factor)) for row in queries.to_pylist()]
        for i in range(shards.num_rows if blocks_ else 0):
            row = shards.slice(i, 1).to_pylist()[0]
            tree = Tree(np.array(row["ids"], np.int64), matrix(row), np.frombuffer(row["nodes"], np.int32).reshape(-1, 4), np.frombuffer(row["ranges"]).reshape(-1, 4))
            for dim, nearest in blocks_:
                if dim == row["dim"]:
                    nearest.search(tree)
        for _, nearest in blocks_:
            who, at = np.nonzero(np.isfinite(nearest.far) | (nearest.near < np.iinfo(np.int64).max))  # a place without a point has neither
            out.append(pa.table({"query_id": nearest.ids[who], "vec_id": nearest.near[who, at], "score": nearest.far[who, at]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    shards, queries = _grid(index, blocks, p)
    found = shards.groupBy("r", "c").cogroup(queries.groupBy("r", "c")).applyInArrow(cell, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k)


def nearest_neighbours(vectors: DataFrame, is_query: F.Column, params: Params | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of `vectors` for which `is_query` (on vec_id) holds, against all rows.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part; nor do rows without an id. Rows that share an id are one, with
    the smallest of their vectors. Other columns are ignored, and an empty table
    gives an empty result. Distances are Euclidean, in double precision.
    """
    p = params or Params()
    rows = _rows_of(vectors, id_column, column)
    index = materialize(build_index(rows, p), "shards")
    blocks = materialize(query_blocks(rows.filter(is_query), p), "blocks")
    return search(index, blocks, p).select("query_id", "rank", "vec_id", "score")
