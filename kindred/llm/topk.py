"""Operator 9, exact top-k inner product search with a ball tree per shard.

Vectors become integers, floor(scale * x). Candidates are dealt to shards by a hash of their id. A task builds the ball tree
of its shard once and streams blocks of queries through it: a block descends the tree together, a query leaves a node when the
node's bound, q.c + |q| r, is below its current kth score, and takes the child of the larger bound first. Shards are searched in
waves, one first and then some three times as many each time: after a wave the kth score of all hits so far travels with each query as its
starting bound. Each shard returns its best k, and the best k of all are the answer.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors
of different dimensions don't meet; each row counts, repeated ones too, as query and as candidate; a query doesn't meet rows of
its own id; ties
go to the smaller id; fewer than k candidates give fewer rows. Rows with components too large for exact scores in floating
point are left out of the trees and scored in integers, each with all others; a score that doesn't fit 64 bits is held at
their end. Other columns are ignored. Empty: empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import bounded, cut, drop_table, give_back

LEAF = 128
HIT = "query_id long, q_key long, times int, vec_id long, score long"


@dataclass(frozen=True)
class SearchParams:
    k: int = 20
    scale: int = 64
    shard: tuple[int, int] = (2048, 32768)  # least and most vectors of a shard
    block: int = 8192  # queries of a block
    stream: int = 1 << 20  # queries that one task streams through a tree, about
    growth: int = 3  # shards of a wave, times those before it
    spread: int = 12  # shards wished for, while they hold the least number


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & fine
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


class BallTree:
    """Nodes over rows of `points`; rows are reordered so that a node's rows stand together."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.first: list[int] = []
        self.last: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []

        def build(a: int, b: int) -> int:
            node = len(self.first)
            own = points[self.order[a:b]]
            centre = own.mean(0)
            self.first.append(a)
            self.last.append(b)
            self.children.append(None)
            centres.append(centre)
            radii.append(math.sqrt(float(((own - centre) ** 2).sum(1).max())))
            if b - a > leaf and radii[-1] > 0:
                axis = int(own.var(0).argmax())
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                self.children[node] = (build(a, a + middle), build(a + middle, b))
            return node

        build(0, len(points))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.points = points[self.order]


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
LEAST = -(1 << 63)  # a bound that any score reaches


class Shard:
    """The candidates of a shard, ready for blocks of queries."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.cap = math.isqrt(((1 << 40) - 1) // points.shape[1])  # up to this, scores are below 2^40
        self.points, self.ids, self.tame = points, ids, self._tame(points)
        self.tree = Tree(points[self.tame], ids[self.tame]) if self.tame.any() else None

    def _tame(self, x: np.ndarray) -> np.ndarray:
        return ((x <= self.cap) & (x >= -self.cap)).all(1)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> Hits:
        """(query row, id, score) of the best k candidates of each query that reach its bound."""
        tame = self._tame(queries)
        if self.tree and tame.all() and self.tame.all():
            return self.tree.search(queries, query_ids, bounds, k)
        found: list[Hits] = [(np.zeros(0, np.int64),) * 3]
        q = np.flatnonzero(tame)
        if len(q) and self.tree:
            row, *hits = self.tree.search(queries[q], query_ids[q], bounds[q], k)
            found.append((q[row], *hits))
        for rows, among in ((np.flatnonzero(~tame), np.arange(len(self.points))), (q, np.flatnonzero(~self.tame))):
            if len(rows) and len(among):
                row, *hits = search_whole(queries[rows], query_ids[rows], bounds[rows], self.points[among], self.ids[among], k)
                found.append((rows[row], *hits))
        row, hit, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((hit, -score, row))
        row = row[order]
        first = np.searchsorted(row, row)  # where each query's hits begin
        best = order[np.arange(len(row)) - first < k]
        return tuple(x[best] for x in (np.concatenate([f[0] for f in found]), hit, score))


def search_whole(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Hits:
    """As Shard.search, in whole numbers of any size, over all pairs."""
    by_id = np.argsort(ids, kind="stable")
    points, ids = points[by_id], ids[by_id]
    most = lambda x: max(abs(int(x.max())), abs(int(x.min())))
    end = (1 << 63) - 2
    small = most(queries) * most(points) * points.shape[1] <= end
    across = points.T if small else points.T.astype(object)
    step = max(1, (1 << 22 if small else 1 << 18) // len(points))
    found = []
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        score = q @ across if small else np.clip(q.astype(object) @ across, -end, end).astype(np.int64)
        out = (ids[None, :] == query_ids[a : a + step, None]) | (score < bounds[a : a + step, None])
        rank = np.where(out, end + 1, -score)
        best = np.argsort(rank, axis=1, kind="stable")[:, :k]  # points stand by id
        row, place = np.nonzero(np.take_along_axis(rank, best, 1) <= end)
        at = best[row, place]
        found.append((row + a, ids[at], score[row, at]))
    return tuple(np.concatenate(x) for x in zip(*found))


class Tree:
    """A ball tree over candidates whose scores stay below 2^40."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.balls = ids[by_id], BallTree(points[by_id].astype(np.float64))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> Hits:
        """As Shard.search."""
        tree, ids = self.balls, self.ids
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(1))
        reach = np.array(tree.centres @ q.T) + tree.radii[:, None] * norms + 1e-6 * (1 + norms) * (1 + tree.radii[:, None])
        # one number orders hits: score, then smaller id. ids are ranks here, ranks are below 2^22
        nothing = np.int64(-(1 << 62))
        best = np.full((len(q), k), nothing)
        bounds = bounds.astype(np.float64)
        kth = bounds.copy()
        leaf_rank = tree.order

        def visit(node: int, active: np.ndarray) -> None:
            active = active[reach[node, active] >= kth[active]]
            if not len(active):
                return
            if tree.children[node] is None:
                a, b = tree.first[node], tree.last[node]
                score = np.rint(q[active] @ tree.points[a:b].T).astype(np.int64)
                packed = (score << 22) + ((1 << 22) - 1 - leaf_rank[a:b])
                packed[ids[leaf_rank[a:b]][None, :] == query_ids[active][:, None]] = nothing
                packed[score < bounds[active][:, None]] = nothing
                both = np.concatenate([best[active], packed], 1)
                top = -np.partition(-both, k - 1, axis=1)[:, :k]
                best[active] = top
                least = top.min(1)
                kth[active] = np.where(least > nothing, np.maximum(least >> 22, bounds[active]), bounds[active])
                return
            left, right = tree.children[node]
            first = reach[left, active] >= reach[right, active]
            visit(left, active[first])
            visit(right, active[~first])
            visit(right, active[first])
            visit(left, active[~first])

        visit(0, np.arange(len(q)))
        row, column = np.nonzero(best > nothing)
        packed = best[row, column]
        return row, ids[(1 << 22) - 1 - (packed & ((1 << 22) - 1))], packed >> 22


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


PLACE = ("dim", "shard", "part")
ROW = (*PLACE, "asks", "id", "q_key", "times", "bound", "v")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], bool, pa.RecordBatch]]:
    """The rows of one place and side, batch by batch: (place, whether they ask, rows)."""
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))[: len(keys)])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
            *place, asks = keys[a].tolist()
            yield tuple(place), bool(asks), batch.slice(a, b - a)


def top_k(vectors: DataFrame, is_query: Column, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that `is_query` marks, against all other rows."""
    k = params.k
    ints = vectors.select(F.col("vec_id"), is_query.alias("is_query"), quantised(F.col("embedding"), params.scale).alias("v"))
    ints = ints.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    # repeated rows are one row with a number: more than k of them can't all be among the best k
    ints = ints.groupBy("vec_id", "is_query", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    ints = cut(ints.withColumn("dim", F.size("v")), "quantised")
    total, asked = ints.agg(F.sum("times"), F.count_if("is_query")).first()
    total = total or 0
    size = min(params.shard[1], max(params.shard[0], -(-total // params.spread)))
    shards, parts = max(1, -(-total // size)), max(1, -(-asked // params.stream))
    queries = ints.where("is_query").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("asks"), F.col("vec_id").alias("id"), F.xxhash64("v").alias("q_key"), "times", "v"
    )
    candidates = ints.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "dim", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("q_key"), F.lit(1).alias("times"), F.lit(None).cast("long").alias("bound"), "v"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        here, held, shard = None, [], None
        for place, asks, rows in _pieces(batches):
            if place != here:
                here, held, shard = place, [], None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue  # no candidates of this dimension
            if shard is None:
                own = pa.concat_batches(held)
                shard, held = Shard(_matrix(own.column("v"), place[0]), own.column("id").to_numpy()), [own.slice(0, 1)]
            for at in range(0, rows.num_rows, params.block):
                block = rows.slice(at, params.block)
                names = block.column("id").to_numpy()
                row, ids, score = shard.search(_matrix(block.column("v"), place[0]), names, block.column("bound").fill_null(LEAST).to_numpy(zero_copy_only=False), k)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), block.column("q_key").take(take), block.column("times").take(take), pa.array(ids), pa.array(score)], ["query_id", "q_key", "times", "vec_id", "score"])
        give_back()

    bounded(vectors.sparkSession)
    order = Window.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), "vec_id")
    hits, first, width = None, 0, 1
    while first < shards:
        last = min(shards, first + width)
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        asking = queries
        if hits is not None:
            kth = hits.groupBy("query_id", "q_key").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k)
            asking = queries.join(kth.select(F.col("query_id").alias("id"), "q_key", "bound"), ["id", "q_key"], "left")
        else:
            asking = queries.withColumn("bound", F.lit(None).cast("long"))
        left = asking.withColumn("shard", every(first, last)).select(*ROW)
        right = candidates.where(F.col("shard").between(first, last - 1)).withColumn("part", every(0, parts)).select(*ROW)
        both = left.unionByName(right).repartition(*PLACE).sortWithinPartitions(*PLACE, "asks")
        found = both.mapInArrow(search, HIT)
        new = found if hits is None else hits.unionByName(found)
        new = cut(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "hits")
        if hits is not None:
            drop_table(hits)
        hits, first, width = new, last, width * params.growth
    drop_table(ints)
    # a query that several rows ask has each hit for each of them
    again = hits.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return again.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
