"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm._session import tune

BINS = 256
QUERIES = 4096
BLOCK = 1024
#: Integer products up to this are exact in doubles, which BLAS multiplies.
EXACT = float(1 << 52)
#: Scores of larger size count as this.
LIMIT = 1 << 61


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x) as longs; rows with a null id, and vectors that are null, empty or hold a null or non-finite component, take no part."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by doubles where these hold every sum."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < float(LIMIT):
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LIMIT, LIMIT).astype(np.int64)


class _Batch:
    """A bounded batch of queries, sent to every task."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v


def _blocks(batch: pa.RecordBatch, width: int):
    for i in range(0, batch.num_rows, BLOCK):
        part = batch.slice(i, BLOCK)
        yield part.column(0).to_numpy(), _matrix(part.column(1), width)


def _select(spark, vectors: DataFrame, batch: _Batch, k: int) -> DataFrame:
    """Top k of a batch: bounds, then ever finer histograms of scores, then what reaches the k-th value."""
    held = spark.sparkContext.broadcast(batch)
    n, width = len(batch.ids), batch.v.shape[1]

    def bounds(batches):
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for b in batches:
            for ids, v in _blocks(b, width):
                s = _scores(held.value.v, v)
                own = held.value.ids[:, None] == ids[None, :]
                low = np.minimum(low, np.where(own, np.iinfo(np.int64).max, s).min(1))
                high = np.maximum(high, np.where(own, np.iinfo(np.int64).min, s).max(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(low), pa.array(high)], ["q", "low", "high"])

    got = vectors.mapInArrow(bounds, "q long, low long, high long").where("low <= high").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # a row for each query of the batch
    low, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[got.q], size[got.q] = got.low, got.high - got.low + 1
    above = np.zeros(n, np.int64)  # candidates with scores over the interval that holds the k-th value
    while (size > 1).any():
        step = np.maximum(1, -(-size // BINS))
        now = spark.sparkContext.broadcast((low, step, size))

        def histogram(batches, now=now):
            low, step, size = now.value
            counts = np.zeros((n, BINS), np.int64)
            line = np.arange(n)[:, None] * BINS
            for b in batches:
                for ids, v in _blocks(b, width):
                    s = _scores(held.value.v, v) - low[:, None]
                    fits = (s >= 0) & (s < size[:, None]) & (held.value.ids[:, None] != ids[None, :])
                    at = (np.minimum(s // step[:, None], BINS - 1) + line)[fits]
                    counts += np.bincount(at, minlength=n * BINS).reshape(n, BINS)
            q, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])

        bins = vectors.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        over = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
        need = spark.createDataFrame([(i, int(x)) for i, x in enumerate(above)], "q long, above long")
        total = F.col("above") + F.col("upto")
        chosen = bins.withColumn("upto", over).join(need, "q").groupBy("q").agg(
            F.max(F.when(total >= k, F.struct("bin", (total - F.col("n")).alias("over")))).alias("hit"), F.min(F.struct("bin", (total - F.col("n")).alias("over"))).alias("last")
        ).select("q", F.coalesce("hit", "last").alias("c")).select("q", "c.bin", "c.over").toPandas()  # a row for each query of the batch
        q = chosen.q.to_numpy()
        fine, at = size[q] > 1, chosen.bin.to_numpy()
        low[q], above[q] = low[q] + at * step[q], chosen.over
        size[q] = np.where(fine, np.minimum(step[q], size[q] - at * step[q]), size[q])
        size[np.setdiff1d(np.arange(n), q)] = 0
    cut = spark.sparkContext.broadcast(low)

    def keep(batches):
        floor = cut.value
        have = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
        for b in batches:
            for ids, v in _blocks(b, width):
                s = _scores(held.value.v, v)
                q, c = np.nonzero((s >= floor[:, None]) & (held.value.ids[:, None] != ids[None, :]))
                for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                    if len(part):
                        i = q[part[0]]
                        score, vec = np.append(have[i][0], s[i, c[part]]), np.append(have[i][1], ids[c[part]])
                        best = np.lexsort((vec, -score))[:k]  # of a task's rows no more than k can be among the first k
                        have[i] = score[best], vec[best]
        for i, (score, vec) in enumerate(have):
            if len(vec):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), held.value.ids[i])), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(keep, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, batch: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` highest inner products with rows of other ids, ties to smaller ids.

    ``vectors`` and ``queries`` come from ``quantise``; queries are taken in batches of ``batch``, by id, each a pass over the
    vectors in blocks.  Scores are computed anew in each round, and only histograms (``BINS`` numbers a query and task)
    and intervals of the batch's queries move.  A task passes on k rows a query at most, so rows that tie at the k-th value
    do not gather anywhere.  Fewer than k candidates: all.  Repeated query ids: the first vector by value is asked.
    Repeated candidates count each.  Vectors of another length than a query's are no candidates of it.  Scores beyond
    2**61 in size count as that.  No queries or no vectors: no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    out = None
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    for (width,) in asked.select("width").distinct().orderBy("width").collect():
        mine, after = vectors.where(F.size("v") == width), None
        while True:
            left = asked.where(F.col("width") == width)
            left = left if after is None else left.where(F.col("vec_id") > after)
            rows = left.orderBy("vec_id").limit(batch).collect()
            if not rows:
                break
            after = rows[-1]["vec_id"]
            part = _select(spark, mine, _Batch(np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows], np.int64)), k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    v = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fine),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
