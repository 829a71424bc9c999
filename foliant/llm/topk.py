"""Exact top-k by inner product: KD-trees per shard, searched best first.

Vectors are quantised to integers, floor(SCALE * x). Candidates fall into shards by a hash of their id;
each shard has a KD-tree by median splits of the widest dimension, down to LEAF rows, with the tight
bounding box and the smallest id of every node. A query visits nodes in order of the highest inner
product that their box allows; it ends when that is below its kth score, or equal with no smaller id
left. The first shard is searched first; each query's kth score there goes with it to all other shards, whose
boxes and rows below it are passed over from the start.

Queries come in blocks of BLOCK rows against shards of SHARD rows: each task holds one block and one
shard at a time, whatever the tables' sizes. Every candidate that could enter a result is scored exactly;
scores are sums of integer products, exact in float64 below 2**53 and in int64 above; beyond 64 bits they are
an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.scratch import materialize

SCALE = 256
LEAF = 256
SHARD = 8_192
BLOCK = 4_096


class Tree:
    """A KD-tree over integer vectors; rows are reordered so that every node is a range."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids,))
        self.begin: list[int] = []
        self.end: list[int] = []
        self.child: list[int] = []
        todo = [(0, len(ids))]
        self.begin, self.end, self.child = [0], [len(ids)], [-1]
        at = 0
        while at < len(todo):
            lo, hi = todo[at]
            rows = order[lo:hi]
            spread = x[rows].max(0) - x[rows].min(0)
            if hi - lo > LEAF and spread.max() > 0:
                mid = (hi - lo) // 2
                d = int(spread.argmax())
                rows = rows[np.argpartition(x[rows, d], mid)]
                order[lo:hi] = rows
                self.child[at] = len(todo)
                for a, b in ((lo, lo + mid), (lo + mid, hi)):
                    todo.append((a, b))
                    self.begin.append(a)
                    self.end.append(b)
                    self.child.append(-1)
            at += 1
        self.ids, self.x = ids[order], x[order]
        for i, c in enumerate(self.child):
            if c < 0:  # ids ascend within a leaf
                lo, hi = self.begin[i], self.end[i]
                inner = np.argsort(self.ids[lo:hi], kind="stable")
                self.ids[lo:hi], self.x[lo:hi] = self.ids[lo:hi][inner], self.x[lo:hi][inner]
        nodes = range(len(todo))
        self.low = np.stack([self.x[self.begin[i] : self.end[i]].min(0) for i in nodes])
        self.high = np.stack([self.x[self.begin[i] : self.end[i]].max(0) for i in nodes])
        self.least = [int(self.ids[self.begin[i] : self.end[i]].min()) for i in nodes]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest inner product that each node's box allows each query."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query_id: int, q: np.ndarray, bounds: np.ndarray, best: list[tuple[float, int]], k: int, least_score: float = -np.inf) -> None:
        """Put this tree's rows of least_score or more into best, a heap of (score, -id) of the k best so far."""
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if -bound < least_score:
                return
            if len(best) == k and (-bound < best[0][0] or (-bound == best[0][0] and least > -best[0][1])):
                if -bound < best[0][0]:
                    return
                continue
            c = self.child[node]
            if c >= 0:
                heapq.heappush(heap, (-bounds[c], self.least[c], c))
                heapq.heappush(heap, (-bounds[c + 1], self.least[c + 1], c + 1))
                continue
            lo, hi = self.begin[node], self.end[node]
            score = self.x[lo:hi] @ q
            if len(best) == k:
                near = np.flatnonzero(score >= best[0][0])
            else:
                near = np.flatnonzero(score >= least_score)
            if len(near) > k + 1:  # ids ascend, so a stable order settles ties
                near = near[np.argsort(-score[near], kind="stable")[: k + 1]]
            for i in near:
                item = (score[i], -int(self.ids[lo + i]))
                if -item[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<bigint>) of the vectors without a null or non-finite component; other rows are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.int64)
    return x


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Both tables are (id long, x array<bigint>), as quantised() gives them. A query's own id is no
    candidate. Vectors of another length than the query's are none either. Fewer candidates than k give
    fewer rows; empty tables give none. Ids are taken to be distinct; of repeated ids each row counts.
    """
    spark = candidates.sparkSession
    n, m = candidates.count(), queries.count()
    shards, blocks = max(1, ceil(n / SHARD)), max(1, ceil(m / BLOCK))

    def part(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count))

    c = candidates.withColumn("shard", part(shards, 1).cast("int")).withColumn("size", F.size("x"))
    q = queries.select(F.col("id").alias("query"), F.col("x").alias("y"), part(blocks, 2).cast("int").alias("block"), F.size("x").alias("size"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right) and left["size"].iloc[0] > 0:
            x, y = _matrix(left["x"]), _matrix(right["y"])
            most = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
            if most >= 2**63:
                raise ValueError("inner products exceed 64 bits")
            kind = np.float64 if most < 2**53 else np.int64
            tree, y = Tree(left["id"].to_numpy(), x.astype(kind)), y.astype(kind)
            bounds = tree.bounds(y)
            for i, (query, row, least) in enumerate(zip(right["query"].tolist(), y, right["least"].tolist(), strict=True)):
                best: list[tuple[float, int]] = []
                tree.search(query, row, bounds[i], best, k, least)
                out += [(query, -b, int(s)) for s, b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["shard", "block", "size"]
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(first: int, last: int, q: DataFrame) -> DataFrame:
        """Of the shards from first to before last: q has the least score that counts for each query."""
        n = last - first
        parts = max(least_parts, min(n * blocks, 100_000))
        own = c.where(F.col("shard").between(first, last - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        q = q.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        return own.repartition(parts, *keys).groupBy(*keys).cogroup(q.repartition(parts, *keys).groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    found = searched(0, 1, q.withColumn("least", F.lit(float("-inf"))))
    if shards > 1:
        found = materialize(found, "first_shard")
        # scores beyond 2**53 lose their last bits here, downwards
        kth = F.when(F.count("*") >= k, F.min("score").cast("double"))
        below = found.groupBy(F.col("query_id").alias("query")).agg(F.when(F.abs(kth) < 2**53, kth).otherwise(kth - F.abs(kth) / 2**52).alias("least"))
        q = q.join(below, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = found.unionByName(searched(1, shards, q))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
