"""Queries of the aggregates behind figures, and of pairs of channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import figures, latency, stats
from trialspark.plans.tables import D_SQL, P_SQL, S_SQL, dims, pairs, samples, table
from trialspark.plans.stats_queries import ACC_ALL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL), s AS (SELECT o_orderstatus, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
g AS (SELECT o_orderstatus, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT g.o_orderstatus, g.day, d.value FROM g LEFT JOIN d ON g.o_orderstatus = d.o_orderstatus AND g.day = d.day""")
def sessions_by_date(spark, sf):
    return figures.by_date(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


@query("""WITH x AS (SELECT c_nationkey, c_mktsegment AS day, c_custkey, c_acctbal AS v, unnest(generate_series(1, c_custkey % 3)) AS k FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, day ORDER BY c_custkey, k) AS trial, count(*) OVER (PARTITION BY c_nationkey, day) AS n FROM x),
m AS (SELECT *, avg(v) OVER (PARTITION BY c_nationkey, day ORDER BY trial ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m, avg(v) OVER (PARTITION BY c_nationkey, day) AS whole FROM n)
SELECT a.c_nationkey, a.day, a.trial, round(CASE WHEN a.n < 3 THEN a.whole ELSE b.m END, 4) AS value FROM m a LEFT JOIN m b ON a.c_nationkey = b.c_nationkey AND a.day = b.day AND b.trial = greatest(2, least(a.trial, a.n - 1))""")
def sessions_by_trial(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_mktsegment").alias("day"), "c_custkey", "c_acctbal", (F.col("c_custkey") % 3).alias("n"))
    got = figures.by_trial(c, "c_nationkey", "day", "c_custkey", "c_acctbal", "n", 3)
    return got.select("c_nationkey", "day", F.col("trial").cast("long").alias("trial"), F.round("value", 4).alias("value"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), x AS (SELECT l.l_returnflag, l_extendedprice AS v, q1, med, q3, l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) AS i FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
SELECT l_returnflag, count(*) AS n, round(min(CASE WHEN i THEN v END), 4) AS low, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, round(max(CASE WHEN i THEN v END), 4) AS high, CAST(sum(CASE WHEN i THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM x GROUP BY 1""")
def box_stats(spark, sf):
    b = figures.boxes(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return b.withColumns({c: F.round(c, 4) for c in ("low", "q1", "median", "q3", "high")})


@query(f"""WITH {P_SQL}, b AS (SELECT label, CAST(least(floor(((atan2(y, x) % (2 * pi()) + 2 * pi()) % (2 * pi())) / (2 * pi() / 16)), 15) AS INTEGER) AS bin FROM p), n AS (SELECT label, bin, count(*) AS n FROM b GROUP BY ALL) SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label) / (2 * pi() / 16), 8) AS density FROM n""")
def circular_histogram(spark, sf):
    p = pairs(spark, sf).withColumn("angle", F.atan2("y", "x"))
    return figures.circular_histogram(p, "label", "angle").withColumn("density", F.round("density", 8))


@query(f"""WITH {D_SQL} SELECT label, CAST(k AS BIGINT) AS k, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, count(v) AS n FROM d GROUP BY ALL""")
def mean_waveform(spark, sf):
    m = figures.mean_waveform(dims(spark, sf), "label", "k", "v")
    return m.select("label", F.col("k").cast("long").alias("k"), F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), "n")


@query(f"""WITH {D_SQL}, m AS (SELECT label, k, avg(v) AS v FROM d GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY v) + (count(*) OVER (PARTITION BY label, v) - 1) / 2.0 AS r FROM m),
c AS (SELECT a.label AS a, b.label AS b, abs(corr(a.r, b.r)) AS r FROM r a JOIN r b ON a.k = b.k AND a.label < b.label GROUP BY ALL), {P_SQL}, g AS (SELECT label, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1),
e AS (SELECT r, sqrt((g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y)) AS d FROM c JOIN g ON c.a = g.label JOIN g h ON c.b = h.label)
SELECT CAST(least(floor(d / 0.1), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(r), 6) AS r, (CAST(least(floor(d / 0.1), 9) AS INTEGER) + 0.5::DOUBLE) * 0.1::DOUBLE AS center FROM e WHERE d > 0 AND d <= 1 GROUP BY ALL""")
def correlation_over_distance_all(spark, sf):
    m = dims(spark, sf).groupBy("label", "k").agg(F.avg("v").alias("v")).withColumn("one", F.lit(1))
    places = pairs(spark, sf).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return stats.correlation_over_distance(m, places, "one", "label", "k", "v", 10).drop("one").withColumn("r", F.round("r", 6))


@query(f"""WITH {P_SQL}, g AS (SELECT label, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1) SELECT g.label AS a, h.label AS b, round(sqrt((g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y)), 6) AS distance FROM g JOIN g h ON g.label < h.label""")
def distance_matrix(spark, sf):
    places = pairs(spark, sf).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("one", F.lit(1))
    return stats.distances(places, "one", "label", "x", "y").drop("one").withColumn("distance", F.round("distance", 6))


@query(f"""{ACC_ALL}, h AS (SELECT vec_id, alt, level, min(CASE WHEN accllr >= level THEN k END) AS u, min(CASE WHEN accllr <= -level THEN k END) AS d FROM acc, (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS level) GROUP BY ALL),
s AS (SELECT *, u IS NOT NULL AND (d IS NULL OR u < d) AS up FROM h), gains AS (SELECT level, avg(CASE WHEN alt THEN CAST(up AS DOUBLE) END) - avg(CASE WHEN NOT alt THEN CAST(up AS DOUBLE) END) AS gain FROM s GROUP BY 1), b AS (SELECT level FROM gains ORDER BY gain DESC, level LIMIT 1)
SELECT vec_id, s.level, u / 1000.0::DOUBLE AS latency FROM s JOIN b ON s.level = b.level WHERE alt AND up""")
def accllr_latency_all(spark, sf):
    x = dims(spark, sf).withColumns({"alt": F.col("label") < 5, "channel": F.lit(1)})
    return latency.accllr_latency(x, "channel", "vec_id", "k", "v", "alt", [0.5, 1.0, 2.0, 4.0], 1000.0).drop("channel")


@query(f"""WITH {S_SQL}, r AS (SELECT user_id % 10 AS unit, CAST(event_id % 8 AS DOUBLE) * (pi() / 4) AS dir, value FROM s), m AS (SELECT unit, dir, avg(value) AS mean, stddev_pop(value) AS std FROM r GROUP BY ALL), f AS (SELECT unit, arg_min(mean, dir) AS mean, arg_min(std, dir) AS std, min(dir) AS dir FROM m GROUP BY 1)
SELECT unit, round(dir, 6) AS direction, round(mean, 6) AS mean, round(std, 6) AS std FROM m UNION ALL SELECT unit, round(dir + 2 * pi(), 6), round(mean, 6), round(std, 6) FROM f""")
def direction_curve(spark, sf):
    import math

    s = samples(spark, sf).select((F.col("user_id") % 10).alias("unit"), ((F.col("event_id") % 8).cast("double") * (math.pi / 4)).alias("dir"), "value")
    got = figures.direction_curve(s, "unit", "dir", "value")
    return got.withColumns({c: F.round(c, 6) for c in ("direction", "mean", "std")})
