"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, table

K, QUERY_STEP = 5, 50
#: Rows of a block of candidates.
ROWS = 8192
FIRST_DEPTH = 32


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integers, shorter ones with zeros beyond their end."""
    width = column.value_lengths().to_numpy()
    out = np.zeros((len(column), int(width.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < width[:, None]] = column.flatten().to_numpy()
    return out


def threshold_topk(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, order: np.ndarray) -> list[tuple[int, int]]:
    """(score, id) of the k best rows by inner product, ties to the smaller id, without the query's own.

    order holds the rows of each dimension by ascending value. Lists are read from the end that the query's
    sign favours, ever deeper; new rows are scored in full. No unseen row can beat the bound made of the
    values at the current depth, so reading ends when the k-th score is above it.
    """
    n, dims = len(rows), np.flatnonzero(query)
    seen, scored = np.zeros(n, bool), np.zeros(n, bool)
    if not len(dims):
        scored[:] = True
        scores, found = np.zeros(n, np.int64), np.arange(n)
    else:
        lists = [order[:, d] if query[d] < 0 else order[::-1, d] for d in dims]
        scores, found, depth, at = np.zeros(n, np.int64), np.zeros(0, np.int64), FIRST_DEPTH, 0
        while at < n:
            depth = min(depth, n)
            for x in lists:
                seen[x[at:depth]] = True
            new = np.flatnonzero(seen & ~scored)
            scores[new] = rows[new] @ query
            scored |= seen
            found = np.flatnonzero(scored & (ids != own))
            if len(found) >= k:
                bound = sum(int(query[d]) * int(rows[x[depth - 1], d]) for d, x in zip(dims, lists, strict=True))
                if np.partition(scores[found], len(found) - k)[len(found) - k] > bound:
                    break
            at, depth = depth, depth * 2
    found = np.flatnonzero(scored & (ids != own))
    if len(found) > 4 * k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    best = found[np.lexsort((ids[found], -scores[found]))[:k]]
    return [(int(scores[i]), int(ids[i])) for i in best]


class _Block:
    """The rows of a block, sorted once by every dimension, for any number of queries."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v, self.order = ids, v, np.argsort(v, axis=0, kind="stable")
        self.most = float(np.abs(v).max(initial=0))
        self.exact = v.astype(np.float64)

    def best(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        width = max(self.v.shape[1], len(query))
        query = np.pad(query, (0, width - len(query)))
        if width > self.v.shape[1]:
            query = query[: self.v.shape[1]]  # the rows are zero there
        # exact in doubles, and faster, if no sum can be too large for them
        small = self.most * float(np.abs(query).max(initial=0)) * width < 2**52
        v, query = (self.exact, query.astype(np.float64)) if small else (self.v, query)
        return threshold_topk(v, self.ids, query, own, k, self.order)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block b, in it rows (kind 0) before queries (kind 1): a task holds a block's rows and a batch of queries."""
        at, ids, parts, block = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(b) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if b[lo] != at:
                    at, ids, parts, block = b[lo], [], [], None
                some, v = batch.column(2).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(3).slice(lo, hi - lo))
                if kind[lo] == 0:
                    ids.append(some)
                    parts.append(v)
                    continue
                if block is None and parts:
                    width = max(x.shape[1] for x in parts)
                    block = _Block(np.concatenate(ids), np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]))
                if block is not None:
                    for own, x in zip(some.tolist(), v, strict=True):
                        out += [(own, i, s) for s, i in block.best(own, x, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1, 2)], names=["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by step the k best other vectors.

    vectors needs vec_id and embedding. Components are floor(256 * x); vectors that are null or hold null, NaN
    or infinite components take no part, nor do rows with a null vec_id; shorter vectors count as zero beyond
    their end, empty ones score 0. Rows that repeat a vec_id are candidates each, save for queries with that
    id; of a query's own rows the smallest vector asks. Rows are dealt into blocks of about ROWS and stay where they
    are; queries, a small part of the rows, are copied to every block, so what is copied grows with queries times blocks.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    grid = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    grid = cut(grid, "vectors")
    nb = max(1, math.ceil(grid.count() / ROWS))
    rows = grid.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nb)).alias("b"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = grid.filter(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("b"), F.lit(1).alias("kind"), "vec_id", "v")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.union(queries).repartition(parts, "b").sortWithinPartitions("b", "kind")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
