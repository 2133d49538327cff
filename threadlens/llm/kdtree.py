"""Exact top-k by inner product over KD-trees, one per shard.

A shard's tree splits at the median of the dimension with the widest spread until a node has at most ``LEAF`` vectors,
and keeps the tight bounding box of each node. No vector in a box can have a larger inner product with q than
sum_d max(q_d * low_d, q_d * high_d). A query visits the tree's nodes by decreasing bound from a queue and stops at the
first bound below its k-th score so far; nodes that only tie with it are visited, as ties go to the smaller id. The
query's k-th score over a fixed-size sample of the vectors is passed on with each query to all shards, whose searches start with
that bound.

Equal vectors of a shard are stored once, with their k + 1 smallest ids (others cannot be in a top k). A task holds one
shard at a time, through which the queries stream in blocks; each shard yields at most k rows a query.

Defined cases: vectors that are null, empty, hold a null or non-finite component, or have a null id take no part, nor do
vectors whose dimension differs from the first by id; of rows with equal ids the smallest vector takes part; fewer than k candidates give fewer rows; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

LEAF = 256
#: Queries that go through a shard together.
BLOCK = 512
#: Vectors a shard holds, about, and the fewest shards.
SHARD = 16_384
SHARDS = 16
#: Vectors over which each query's first bound is found.
SAMPLE = 1024


@dataclass
class Tree:
    """Nodes in preorder: box corners, children (-1: leaf) and the range of vectors, which are stored in leaf order."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    vectors: np.ndarray
    order: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    order, rows = np.arange(len(x)), []

    def grow(a: int, b: int) -> int:
        own = x[order[a:b]]
        low, high, at = own.min(0), own.max(0), len(rows)
        rows.append([low, high, -1, -1, a, b])
        if b - a > leaf and (high > low).any():
            d = int(np.argmax(high - low))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, d], mid)]
            rows[at][2] = grow(a, a + mid)
            rows[at][3] = grow(a + mid, b)
        return at

    if len(x):
        grow(0, len(x))
    low, high = (np.array([r[i] for r in rows]).reshape(len(rows), x.shape[1]) for i in (0, 1))
    return Tree(low, high, *(np.array([r[i] for r in rows], np.int64) for i in range(2, 6)), x[order], order)


def search(tree: Tree, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query, its best (score, id) in the tree, best first, among those that reach ``least``. ``ids``: of each
    distinct vector; ``own``: the queries' ids."""
    if not len(tree.begin):
        return [[] for _ in queries]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ tree.high.T + down @ tree.low.T  # queries x nodes
    out = []
    for q in range(len(queries)):
        best: list[tuple[int, int]] = []  # (score, -id), smallest first
        kth, queue = least[q], [(-bound[q, 0], 0)]
        while queue:
            negative, node = heapq.heappop(queue)
            if -negative < kth:
                break
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if bound[q, child] >= kth:
                        heapq.heappush(queue, (-bound[q, child], int(child)))
                continue
            a, b = tree.begin[node], tree.end[node]
            score = tree.vectors[a:b] @ queries[q]
            for i in np.flatnonzero(score >= kth):
                if score[i] < kth:
                    continue
                for x in ids[tree.order[a + i]]:
                    if x != own[q]:
                        (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (int(score[i]), -int(x)))
                if len(best) == k:
                    kth = max(kth, best[0][0])
        out.append([(s, -i) for s, i in sorted(best, reverse=True)])
    return out


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v: array<long>) of the vectors that take part."""
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _exact(x: np.ndarray, top: int) -> np.ndarray:
    """As doubles, whose products and sums are exact and fast, where the largest component allows it."""
    return x.astype(np.float64) if x.shape[1] * top * top < 1 << 53 else x


class _Shard:
    """Candidates as they arrive, then the tree over them."""

    def __init__(self, k: int, top: int):
        self.k, self.top, self.ids, self.rows, self.tree = k, top, [], [], None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(x)

    def search(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        if self.tree is None:
            ids, x = (np.concatenate(p) if p else None for p in (self.ids, self.rows))
            if ids is None:
                return [[] for _ in own]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])  # of equal ids, which are neighbours, the first
            ids, x = ids[first], x[first]
            by = np.lexsort((ids, *x.T[::-1]))
            start = np.flatnonzero(np.concatenate([[True], (x[by][1:] != x[by][:-1]).any(1)]))
            self.groups = [g[: self.k + 1] for g in np.split(ids[by], start[1:])]
            self.tree = build(_exact(x[by[start]], self.top))
            self.ids = self.rows = None
        return search(self.tree, self.groups, _exact(q, self.top), own, self.k, kth)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard: int = SHARD, least_shards: int = SHARDS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) for which the column ``is_query``
    holds, against all rows but their own."""
    spark = vectors.sparkSession
    rows = stage(quantise(vectors, scale), "vectors")
    total, dims, top = rows.agg(F.count("*"), F.min_by(F.size("v"), "vec_id"), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == dims)
    shards = max(least_shards, -(-total // shard))
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).toArrow()  # at most ``sample`` vectors
    some_ids, some_x = some["vec_id"].to_numpy(), np.array(some["v"].to_pylist(), np.int64).reshape(-1, dims)
    seen = spark.sparkContext.broadcast((some_ids, _exact(some_x, top)))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dims)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A lower bound of each query's k-th score: the k-th over the sample."""
        ids, x = seen.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                score = _exact(matrix(part.column("v")), top) @ x.T
                own = np.asarray(part.column("vec_id"))
                score = np.where(own[:, None] == ids[None, :], -(2.0**63), score)
                # equal ids in the sample count once for this to stay a bound
                kth = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k and len(set(ids.tolist())) == len(ids) else np.full(len(own), -(2.0**63))
                yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.array(np.maximum(kth, -(2.0**63)).astype(np.int64))], names=["vec_id", "v", "kth"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, last = None, None, None
        for batch in batches:
            number, side, ids = (np.asarray(batch.column(c)) for c in ("shard", "side", "vec_id"))
            cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if number[a] != at:
                    at, held, last = number[a], _Shard(k, top), None
                part = batch.slice(a, b - a)
                x = matrix(part.column("v"))
                if side[a] == 0:
                    held.add(ids[a:b], x)
                    continue
                new = np.concatenate([[ids[a] != last], ids[a + 1 : b] != ids[a : b - 1]])
                last = ids[b - 1]
                own, x, kth = ids[a:b][new], x[new], np.asarray(part.column("kth"))[new]
                out = []
                for i in range(0, len(own), BLOCK):
                    for o, best in zip(own[i : i + BLOCK].tolist(), held.search(own[i : i + BLOCK], x[i : i + BLOCK], kth[i : i + BLOCK])):
                        out += [(o, v, s) for s, v in best]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["query_id", "vec_id", "score"])

    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    candidates = rows.select(home.alias("shard"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0).cast("long").alias("kth"))
    queries = rows.where(is_query).mapInArrow(bounds, "vec_id long, v array<long>, kth long")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "vec_id", "v", "kth")
    dealt = candidates.union(asked).repartition("shard").sortWithinPartitions("shard", "side", "vec_id", "v")
    found = dealt.mapInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
