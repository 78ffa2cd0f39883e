"""Exact top-k search by inner product (operator 10): KD-trees per shard.

Candidates are spread over shards by the hash of their id; a shard is built into
one KD-tree: median splits on the widest side, and for every node the tight
bounding box of its vectors.  A query walks a tree best-first: nodes wait in a
heap by the largest inner product their box allows, ``sum(max(q * low, q * high))``,
and the walk ends when that bound falls below the k-th best score so far.

The k-th score is propagated: a pilot round searches every query in one shard
only, and the score of its k-th candidate there goes along as the starting bound
of the other shards.  It is a score that k other rows reach, so a box below it
holds no result; boxes that reach exactly it are still opened (ties).

Scale.  Shards hold about ``shard_rows`` vectors, so their number grows with the
table.  Queries are a stated set against all rows: they are dealt into blocks of about
``query_rows`` by the hash of their id and visit the shards block by block, as a cogroup
by shard and block; a task holds one shard and one block, whatever the table's size.
The price is that a shard's rows travel once per block.  Per shard only the best ``k`` of
a query leave the task; the shards' results meet by query in a grouped top-k with
partial combining.  Vectors are compared as 64-bit
integers (in float64 where every sum is below 2**53, which is exact).

Defined results: vectors that are null, empty, or hold a null or non-finite
component, and rows without an id, take no part, as query or as candidate.
Vectors of different lengths are never compared.  All rows with the query's id
are its own.  Rows that repeat an id and a vector are one row; two different
vectors under one id are both candidates.  Ties go to the smaller id.  An empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
SHARD_ROWS = 20_000
QUERY_ROWS = 20_000
BLOCK = 512          # queries whose box bounds are computed together


def quantised(vec: Column, factor: int = 1024) -> Column:
    """``floor(factor * x)`` of every component as double; null if one is null or not finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vec) > 0) & ~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * factor)))


class Tree:
    """KD-tree over integer vectors, nodes in arrays; leaves own row ranges."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.child, self.span = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = vecs[order[a:b]]
            low, high = rows.min(0), rows.max(0)
            node = len(self.low)
            self.low.append(low), self.high.append(high), self.child.append([-1, -1]), self.span.append((a, b))
            if parent >= 0:
                self.child[parent][side] = node
            if b - a > LEAF and (axis := int(np.argmax(high - low))) >= 0 and high[axis] > low[axis]:
                mid = (b - a) // 2
                part = np.argpartition(rows[:, axis], mid)
                order[a:b] = order[a:b][part]
                todo += [(a + mid, b, node, 1), (a, a + mid, node, 0)]
        self.ids, self.vecs = ids[order], vecs[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.exact_float = bool(len(ids)) and float(np.abs(vecs).max()) * vecs.shape[1] < 2.0**53
        if self.exact_float:
            self.floats = self.vecs.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with a point of each box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        if self.exact_float and float(np.abs(queries).max(initial=0)) * float(np.abs(self.vecs).max(initial=0)) * self.vecs.shape[1] < 2.0**53:
            return (up.astype(float) @ self.high.T.astype(float) + down.astype(float) @ self.low.T.astype(float)).astype(np.int64)
        return up @ self.high.T + down @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The best ``(score, -id)`` of a query that may be among its k highest;
        ``least``: a score that k other rows are known to reach."""
        best: list[tuple[int, int]] = []      # heap: the worst of the best k first
        q = query.astype(np.float64)
        fits = self.exact_float and float(np.abs(q).max()) * float(np.abs(self.vecs).max()) * len(q) < 2.0**53
        heap = [(-int(bound[0]), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -top < floor:
                break
            if self.child[node][0] >= 0:
                for c in self.child[node]:
                    heapq.heappush(heap, (-int(bound[c]), c))
                continue
            a, b = self.span[node]
            scores = (self.floats[a:b] @ q).astype(np.int64) if fits else self.vecs[a:b] @ query
            keep = self.ids[a:b] != query_id
            if floor is not None:
                keep &= scores >= floor
            for s, i in zip(scores[keep].tolist(), self.ids[a:b][keep].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return best


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.values[column.offsets[0].as_py():column.offsets[-1].as_py()].to_numpy(zero_copy_only=False).reshape(len(column), -1)


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _shard(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if rows.num_rows and queries.num_rows:
            tree = Tree(rows["id"].to_numpy(), _matrix(rows["vec"]))
            for at in range(0, queries.num_rows, BLOCK):
                block = queries.slice(at, BLOCK)
                vecs = _matrix(block["vec"])
                bounds = tree.bounds(vecs)
                for j, (qid, least) in enumerate(zip(block["id"].to_pylist(), block["least"].to_pylist(), strict=True)):
                    out += [(qid, -i, s) for s, i in tree.search(qid, vecs[j], bounds[j], k, least)]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_OUT)

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query."""
    ints = (rows.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), quantised(F.col(vec_col)).alias("vec"))
            .where(F.col("vec").isNotNull()).withColumn("dim", F.size("vec")))
    size = rows.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    shards, blocks = max(1, -(-size["rows"] // shard_rows)), max(1, -(-size["queries"] // query_rows))
    ints = ints.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    schema = "query_id long, vec_id long, score long"
    data = ints.select("id", "vec", "dim", "shard").distinct()
    queries = ints.where("is_query").select("id", "vec", "dim").distinct()

    def search(q: DataFrame) -> DataFrame:
        q = q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))
        q = q.select(*[F.col(c).alias(c) for c in ("id", "vec", "dim", "shard", "block", "least")])   # columns of its own
        held = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else data.withColumn("block", F.lit(0))
        by = ["dim", "shard", "block"]
        return held.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(_shard(k), schema)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if shards == 1:
        found = search(queries.withColumn("shard", F.lit(0)).withColumn("least", F.lit(None).cast("long")))
    else:
        home = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")   # the pilot's shard
        pilot = best(search(queries.withColumn("shard", home).withColumn("least", F.lit(None).cast("long"))))
        kth = pilot.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
        others = (queries.join(kth, queries["id"] == kth["query_id"], "left")
                  .select("id", "vec", "dim", F.col("kth").alias("least"),
                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
                  .where(F.col("shard") != home))
        found = search(others).unionByName(pilot.select("query_id", "vec_id", "score"))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
