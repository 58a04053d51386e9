"""Exact top-k by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.vectors import matrices
from rollcall.session import settle_counted

#: rows of a shard, queries of a block, rows of a leaf
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8_192, 1_024, 128
_LAST = np.iinfo(np.int64).max


class KdTree:
    """Median splits of the widest side; every node knows the tight box of its rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            node = len(self.rows)
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            self.rows.append(None)
            if parent >= 0:
                self.kids[parent].append(node)
            side = int(np.argmax(high - low)) if low.size else 0
            if rows.size <= leaf or not low.size or high[side] == low[side]:
                self.rows[node] = rows
                continue
            half = rows.size // 2
            order = np.argpartition(points[rows, side], half)
            todo += [(rows[order[:half]], node), (rows[order[half:]], node)]
        self.points, self.ids = points, ids
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that a row in each node's box could have: (queries, nodes)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor) -> list[tuple]:
        """Best first: the k best (score, -id) among rows that are not the query's own and not below ``floor``."""
        best: list[tuple] = []
        kth = floor
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if kth is not None and -bound < kth:
                break
            rows = self.rows[node]
            if rows is None:
                for kid in self.kids[node]:
                    if kth is None or bounds[kid] >= kth:
                        heapq.heappush(queue, (-bounds[kid], kid))
                continue
            scores = self.points[rows] @ query
            ids = self.ids[rows]
            take = ids != own
            if kth is not None:
                take &= scores >= kth
            for score, name in zip(scores[take].tolist(), ids[take].tolist(), strict=True):
                item = (score, -name)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        return best


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of the usable vectors as whole numbers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, matrix in matrices(part.column(1)):
                whole = np.floor(scale * matrix)
                if whole.size and np.abs(whole).max() >= 2.0**31:
                    raise OverflowError("a scaled component does not fit 32 bits; choose a smaller scale")
                flat = pa.array(whole.astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, whole.size + 1, max(1, whole.shape[1]), dtype=np.int32) if whole.shape[1] else np.zeros(len(at) + 1, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), lists], names=["id", "v"])

    return rows.mapInArrow(work, "id bigint, v array<int>")


def _search_cells(cells: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) of each cell (block, shard): rows with ``row`` are queries, the others the shard."""

    def work(cell: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        out: list[tuple] = []
        column = cell.column("v").combine_chunks()
        rows = np.array([r is not None for r in cell.column("row").to_pylist()])
        ids = cell.column("id").fill_null(_LAST).to_numpy()
        marks, floors = cell.column("row").to_pylist(), cell.column("floor").to_pylist()
        for at, matrix in matrices(column):
            asked = rows[at]
            base, queries = matrix[~asked], matrix[asked]
            if not len(base) or not len(queries):
                continue
            # doubles hold these products exactly unless they are huge
            if matrix.size and float(np.abs(matrix).max()) ** 2 * matrix.shape[1] >= 2.0**53:
                base, queries = base.astype(np.int64), queries.astype(np.int64)
            tree = KdTree(base, ids[at[~asked]])
            bounds = tree.bounds(queries)
            for n, place in enumerate(at[asked].tolist()):
                own = int(ids[place])
                for score, name in tree.search(queries[n], own, bounds[n], k, floors[place]):
                    out.append((marks[place], own, None if -name == _LAST else -name, int(score)))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return cells.groupBy("block", "shard").applyInArrow(work, "query_row bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, scale: float = 1024.0,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id (column ``id``) ``is_query``.

    Scores are inner products of floor(scale * x); ties go to the smaller id, NULL ids last.  Rows with
    the query's id are never its results.  Vectors that are NULL or hold NULL or non-finite
    components take no part; vectors of another length than the query's do not meet it.  Fewer
    than k candidates give fewer rows; a query row that is repeated is answered each time.

    Each block of queries first searches one shard, and its k-th score goes along to all
    other shards: a box that cannot reach it is not opened.
    """
    base, n = settle_counted(scaled(vectors, vec_id, embedding, scale).withColumn("place", F.monotonically_increasing_id()))
    asked, n_asked = settle_counted(base.where(is_query).drop("place").withColumn("row", F.monotonically_increasing_id()))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    base = base.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int"))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    nothing = F.lit(None).cast("long")

    def cells(bounded: DataFrame, first: bool) -> DataFrame:
        every_shard = F.array(home) if first else F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
        every_block = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (F.pmod(b, F.lit(shards)) == F.col("shard")) == F.lit(first))
        return bounded.select("block", F.explode(every_shard).alias("shard"), "row", "id", "v", "floor").unionByName(
            base.select(F.explode(every_block).alias("block"), "shard", nothing.alias("row"), "id", "v", nothing.alias("floor"))
        )

    near, _ = settle_counted(_search_cells(cells(asked.withColumn("floor", nothing), True), k))
    floors = near.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    bounded = asked.join(floors.select(F.col("query_row").alias("row"), "floor"), "row", "left")
    found = near if shards == 1 else near.unionByName(_search_cells(cells(bounded, False), k))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10
"""
