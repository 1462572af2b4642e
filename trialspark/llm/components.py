"""Connected components of a graph too large for one machine, and joins on keys of which some have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import materialize

#: Keys that may be joined by broadcast, at most.
MOST_HOT = 100_000
#: No key of fewer rows is.
LEAST_HOT = 300


def hot_limit(rows: int) -> int:
    """Rows of a key beyond which it is hot; of ``rows`` rows at most ``MOST_HOT`` keys can be."""
    return max(LEAST_HOT, rows // MOST_HOT)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, count: str) -> DataFrame:
    """``left.join(right, key)``, where ``right`` has one row a key and ``left`` has ``rows`` rows, of which any part may share a key.

    The rows of ``right`` that meet over ``hot_limit(rows)`` rows (its column ``count`` says how many it meets; it isn't
    returned) are broadcast, so that these rows of ``left`` stay where they are.  A first job asks whether there are any,
    as the plan without them is far smaller; the plan with them uses ``right`` four times, so it is written first.
    """
    if (right.agg(F.max(count)).first()[0] or 0) <= hot_limit(rows):
        return left.join(right.drop(count), key)
    right = materialize(right, "keys")
    hot, right = right.where(F.col(count) > hot_limit(rows)).select(key, F.lit(True).alias("__hot")), right.drop(count)
    some = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    marked = left.join(F.broadcast(hot), key, "left")
    rest = marked.where("__hot is null").drop("__hot").join(right, key)
    return rest.unionByName(marked.where("__hot").drop("__hot").join(some, key))


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least v of each u."""
    return join_hot(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", rows, "n")


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (of one orderable type) to ``(u, root)``: each node that isn't the least of its component, with the least.

    Alternating large and small stars.  Each round keeps at most as many edges as there were nodes and edges; minima are
    combined before the shuffle, and those of nodes with very many neighbours are broadcast back.  Null ends are dropped
    (an edge needs both); loops and repeated edges have no effect; no edges give no rows.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).withColumn("m", F.least("u", "m")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, 2 * state[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small, "stars")
