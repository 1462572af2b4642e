"""Queries over the star schema and the embeddings: statistics, geometry, tuning, latency, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.functions import geometry as geo
from trialspark.operators import behavior, decode, electrodes, latency, quality, signal, spikes, stats
from trialspark.plans.tables import D_SQL, E_SQL, P_SQL, S_SQL, dims, events, pairs, samples, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""SELECT l_returnflag, l_linestatus, round(stddev_pop(l_extendedprice), 4) AS rms, round(sqrt(avg(l_quantity * l_quantity)), 6) AS raw_rms, round(stddev_pop(l_quantity) / sqrt(count(l_quantity)), 8) AS sem FROM lineitem GROUP BY ALL""")
def rms_sem(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.round(stats.rms("l_extendedprice"), 4).alias("rms"), F.round(stats.rms("l_quantity", False), 6).alias("raw_rms"), F.round(stats.sem("l_quantity"), 8).alias("sem"))


@query("""SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1""")
def linear_regression_per_group(spark, sf):
    r = stats.regression(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return r.select("l_suppkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, sum(w) AS w, sum(w * x) AS a, sum(w * y) AS b, sum(w * x * x) AS aa, sum(w * x * y) AS ab, sum(w * y * y) AS bb FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem) GROUP BY 1)
SELECT l_returnflag, n, round((ab - a * b / w) / (aa - a * a / w), 4) AS slope, round((ab - a * b / w) / sqrt((aa - a * a / w) * (bb - b * b / w)), 6) AS r FROM s""")
def weighted_regression(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("w", 1 + F.col("l_tax"))
    r = stats.regression(li, "l_returnflag", "l_quantity", "l_extendedprice", "w")
    return r.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"))


@query(f"""WITH {P_SQL}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, sqrt(var_pop(x) + var_pop(y)) AS r FROM p GROUP BY 1)
SELECT vec_id, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) AS distance, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) < 1.5 * r AS inside FROM p JOIN c ON p.label = c.label""")
def find_outliers(spark, sf):
    return rounded(stats.outliers(pairs(spark, sf), "label", ["x", "y"], 1.5).select("vec_id", "distance", "inside"), "distance")


@query("""WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY 1), h AS (SELECT l.l_returnflag, a, b, CAST(least(floor((l_extendedprice - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin FROM lineitem l JOIN e ON l.l_returnflag = e.l_returnflag)
SELECT l_returnflag, bin, round(a + bin * ((b - a) / 20), 4) AS low, round(a + (bin + 1) * ((b - a) / 20), 4) AS high, count(*) AS n FROM h GROUP BY l_returnflag, a, b, bin""")
def histogram(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", 20), "low", "high", digits=4)


@query(f"""WITH {P_SQL}, b AS (SELECT label, x, CAST(least(floor((sqrt(x * x + y * y) - 0) / 0.05), 9) AS INTEGER) AS bin FROM p WHERE sqrt(x * x + y * y) <= 0.5)
SELECT label, bin, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, (bin + 0.5::DOUBLE) * 0.05::DOUBLE AS center FROM b GROUP BY label, bin""")
def stat_over_distance(spark, sf):
    p = pairs(spark, sf)
    got = stats.binned(p, "label", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "x", 0.0, 0.5, 10)
    return rounded(got, "mean", "std").withColumn("center", F.col("center").cast("double"))


@query(f"""WITH {P_SQL}, b AS (SELECT label, x, CAST(least(floor((atan2(y, x) + pi()) / (2 * pi() / 8)), 7) AS INTEGER) AS bin FROM p)
SELECT label, bin, count(*) AS n, round(avg(x), 6) AS mean FROM b GROUP BY label, bin""")
def stat_over_angle(spark, sf):
    import math

    got = stats.binned(pairs(spark, sf), "label", F.atan2("y", "x"), "x", -math.pi, math.pi, 8)
    return rounded(got.select("label", "bin", "n", "mean"), "mean")


@query("""WITH c AS (SELECT unnest([10.0, 20.0, 30.0, 40.0])::DOUBLE AS center) SELECT l_returnflag, center, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std FROM lineitem JOIN c ON abs(l_quantity - center) <= 6 GROUP BY ALL""")
def sliding_window_stats(spark, sf):
    return rounded(stats.sliding_window(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 12.0, [10.0, 20.0, 30.0, 40.0]), "mean", "std", digits=3)


@query("""WITH g AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, round((max(m) - min(m)) / sqrt(sum(n * v) / sum(n)), 6) AS dprime FROM g GROUP BY 1""")
def dprime(spark, sf):
    return rounded(stats.dprime(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity"), "dprime")


@query("""WITH p AS (SELECT c_nationkey, c_custkey, (c_custkey * 7919 % 10007 + 1) / 10008.0 AS p FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p) AS k, count(*) OVER (PARTITION BY c_nationkey) AS m FROM p)
SELECT c_custkey, round(least(1.0, min(p * m / k) OVER (PARTITION BY c_nationkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adjusted FROM k""")
def fdr_correction(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return rounded(stats.fdr(c, "c_nationkey", "p").select("c_custkey", "p_adjusted"), "p_adjusted", digits=9)


@query("""SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS midrank FROM lineitem""")
def midranks(spark, sf):
    return stats.midranks(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "midrank")


@query("""WITH t AS (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS s FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY s) + (count(*) OVER (PARTITION BY l_linestatus, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_linestatus, y ORDER BY s) + (count(*) OVER (PARTITION BY l_linestatus, y, s) - 1) / 2.0 AS b FROM t),
g AS (SELECT l_linestatus, sum(CASE WHEN y = 1 THEN a - b END) AS s, sum(y) AS m, sum(1 - y) AS n, var_samp(CASE WHEN y = 1 THEN a - b END) AS vm, var_samp(CASE WHEN y = 0 THEN a - b END) AS vn FROM r GROUP BY 1)
SELECT l_linestatus, round(s / m / n, 9) AS auc, round(vm / (n * n) / m + vn / (m * m) / n, 12) AS variance FROM g WHERE m > 0 AND n > 0""")
def delong_auc(spark, sf):
    t = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    got = stats.auc(t, "l_linestatus", "y", "s").where("auc is not null")
    return got.select("l_linestatus", F.round("auc", 9).alias("auc"), F.round("variance", 12).alias("variance"))


@query("""WITH e AS (SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1), h AS (SELECT l.l_returnflag, a, (b - a) / 25 AS w, CAST(least(floor((l_quantity - a) / ((b - a) / 25)), 24) AS INTEGER) AS bin FROM lineitem l JOIN e ON l.l_returnflag = e.l_returnflag),
n AS (SELECT l_returnflag, bin, a + bin * w AS low, a + (bin + 1) * w AS high, count(*) AS n FROM h GROUP BY l_returnflag, bin, a, w), c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) / sum(n) OVER (PARTITION BY l_returnflag) AS c FROM n)
SELECT l_returnflag, round(min(CASE WHEN c >= 0.025 THEN low END), 6) AS low, round(min(CASE WHEN c >= 0.975 THEN high END), 6) AS high FROM c GROUP BY 1""")
def confidence_interval(spark, sf):
    return rounded(stats.confidence_interval(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 25), "low", "high")


@query(f"""WITH {D_SQL}, b AS (SELECT vec_id, avg(v) AS b FROM d WHERE k < 16 GROUP BY 1) SELECT d.vec_id, d.k, round(v - b, 6) AS value FROM d JOIN b ON d.vec_id = b.vec_id""")
def erp_baseline_all(spark, sf):
    return rounded(stats.baseline(dims(spark, sf), "vec_id", "k", "v", 0, 16).select("vec_id", F.col("k").cast("long").alias("k"), "value"), "value")


@query(f"""WITH {D_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, k) AS n FROM d WHERE k >= 16 AND k < 48) SELECT vec_id, round(v, 6) AS peak, k AS at FROM r WHERE n = 1""")
def max_erp(spark, sf):
    m = stats.max_erp(dims(spark, sf), "vec_id", "k", "v", 16, 48)
    return rounded(m.withColumn("at", F.col("at").cast("long")), "peak")


@query(f"""WITH {P_SQL}, g AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM p GROUP BY 1) SELECT vec_id, round((x - m) / s, 6) AS z FROM p JOIN g ON p.label = g.label""")
def zscore(spark, sf):
    return rounded(stats.zscore(pairs(spark, sf), "label", "x").select("vec_id", "z"), "z")


@query(f"""WITH {D_SQL}, m AS (SELECT label, k, avg(v) AS v FROM d GROUP BY ALL) SELECT a.label AS a, b.label AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM m a JOIN m b ON a.k = b.k AND a.label < b.label GROUP BY ALL""")
def spatial_correlation(spark, sf):
    m = dims(spark, sf).groupBy("label", "k").agg(F.avg("v").alias("v")).withColumn("one", F.lit(1))
    return rounded(stats.pair_correlation(m, "one", "label", "k", "v").drop("one"), "r")


@query(f"""WITH {D_SQL}, x AS (SELECT label, vec_id, sum(CASE WHEN k < 32 THEN v ELSE -v END) AS df FROM d GROUP BY ALL), a AS (SELECT label, abs(df) AS a, df > 0 AS up, rank() OVER (PARTITION BY label ORDER BY abs(df)) + (count(*) OVER (PARTITION BY label, abs(df)) - 1) / 2.0 AS r FROM x WHERE df <> 0)
SELECT label, count(*) AS n, sum(CASE WHEN up THEN r ELSE 0 END) AS w, round((sum(CASE WHEN up THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) AS z FROM a GROUP BY 1""")
def signed_rank(spark, sf):
    x = dims(spark, sf).groupBy("label", "vec_id").agg(F.sum(F.when(F.col("k") < 32, F.col("v")).otherwise(-F.col("v"))).alias("df"))
    return rounded(stats.wilcoxon(x, "label", "df").drop("p"), "z")


@query(f"""WITH {D_SQL}, q AS (SELECT label, vec_id, k, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r FROM d WHERE k = 3)
SELECT vec_id, round(least(1.0, 2.0 * least(sum(CASE WHEN n.v <= q.v THEN 1 ELSE 0 END), sum(CASE WHEN n.v >= q.v THEN 1 ELSE 0 END)) / count(*)), 9) AS p FROM q JOIN (SELECT label, v FROM d WHERE k = 5) n ON n.label = q.label GROUP BY vec_id""")
def empirical_pvalue(spark, sf):
    d = dims(spark, sf)
    got = stats.empirical_p(d.where("k = 5"), d.where("k = 3").select("label", "vec_id", F.col("v").alias("x")), "label", "v", "x")
    return rounded(got.select("vec_id", "p"), "p", digits=9)


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, sqrt((value - lag(value) OVER p) * (value - lag(value) OVER p) + (i - lag(i) OVER p) * (i - lag(i) OVER p)) AS d FROM s WINDOW p AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, round(coalesce(sum(d), 0), 5) AS path_length FROM w GROUP BY 1""")
def path_length(spark, sf):
    return rounded(behavior.path_length(samples(spark, sf), "user_id", "i", ["value", "i"]), "path_length", digits=5)


@query(f"""WITH {P_SQL}, e AS (SELECT label, (3.0 * y - 4.0 * x) / 5.0 AS e FROM p) SELECT label, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(sum(e), 5) AS total, round(avg(abs(e)), 6) AS abs_mean, round(min(e), 6) AS lowest, round(max(e), 6) AS highest FROM e GROUP BY 1""")
def movement_stats(spark, sf):
    p = pairs(spark, sf).withColumns({"tx": F.lit(3.0), "ty": F.lit(4.0)})
    m = behavior.movement_stats(p, "label", "x", "y", "tx", "ty").select("label", "mean", "std", "total", "abs_mean", "lowest", "highest")
    return rounded(rounded(m, "mean", "std", "abs_mean", "lowest", "highest"), "total", digits=5)


@query(f"""WITH {S_SQL} SELECT user_id, min(CASE WHEN sqrt(value * value) > 50.0 - 2.0 THEN i END) / 60.0 AS leave_time FROM s GROUP BY 1""")
def cursor_leave_time(spark, sf):
    return behavior.leave_time(samples(spark, sf), "user_id", "i", ["value"], 60.0, 50.0, 2.0)


@query(f"""WITH {D_SQL}, a AS (SELECT vec_id, k, v FROM d) SELECT x.vec_id, round(avg((x.v - y.v) * (x.v - y.v)), 8) AS mse_v FROM a x JOIN a y ON x.vec_id = y.vec_id AND y.k = x.k + 32 GROUP BY 1""")
def tracking_error(spark, sf):
    d = dims(spark, sf).select("vec_id", "k", "v")
    both = d.join(d.select("vec_id", (F.col("k") - 32).alias("k"), F.col("v").alias("t")), ["vec_id", "k"])
    return rounded(behavior.tracking_error(both, "vec_id", ["v"], ["t"]), "mse_v", digits=8)


@query(f"""WITH {D_SQL}, c AS (SELECT label, k, median(v) AS m, stddev_pop(v) AS s FROM d GROUP BY ALL), o AS (SELECT d.label, vec_id, CAST(abs(v - m) > 1.5 * s AS INTEGER) AS o FROM d JOIN c ON d.label = c.label AND d.k = c.k) SELECT label, vec_id, avg(o) > 0.15 AS bad FROM o GROUP BY ALL""")
def bad_trials(spark, sf):
    return quality.bad_trials(dims(spark, sf), "label", "vec_id", "k", "v", 1.5, 0.15)


@query(f"""WITH {D_SQL}, e AS (SELECT label, k, stddev_pop(v) AS std FROM d GROUP BY ALL), a AS (SELECT label, median(std) AS m, stddev_pop(std) AS s, quantile_cont(std, 0.05) AS lo, quantile_cont(std, 0.95) AS hi FROM e GROUP BY 1)
SELECT e.label, k, round(std, 6) AS std, abs(std - m) > 1.5 * s AND (std <= lo OR std >= hi) AS bad FROM e JOIN a ON e.label = a.label""")
def outlier_channels(spark, sf):
    q = quality.outlier_channels(dims(spark, sf), "label", "k", "v", 1.5)
    return rounded(q.withColumn("k", F.col("k").cast("long")), "std")


@query(f"""WITH {D_SQL}, r AS (SELECT label, vec_id, k, v / sqrt(v * v + w * w) AS re, w / sqrt(v * v + w * w) AS im FROM (SELECT d.label, d.vec_id, d.k, d.v, e.v AS w FROM d JOIN d e ON d.vec_id = e.vec_id AND e.k = d.k + 32)) SELECT label, k, round(sqrt(avg(re) * avg(re) + avg(im) * avg(im)), 6) AS itpc FROM r GROUP BY ALL""")
def itpc(spark, sf):
    d = dims(spark, sf)
    both = d.join(d.select("vec_id", (F.col("k") - 32).alias("k"), F.col("v").alias("w")), ["vec_id", "k"])
    return rounded(signal.itpc(both, ["label", "k"], "v", "w").withColumn("k", F.col("k").cast("long")), "itpc")


@query(f"""WITH {D_SQL}, b AS (SELECT label, vec_id, CASE WHEN k >= 4 AND k < 12 THEN 0 END AS b0, CASE WHEN k >= 8 AND k < 30 THEN 1 END AS b1, v FROM d) SELECT label, CAST(band AS INTEGER) AS band, round(avg(v), 6) AS power FROM (SELECT label, b0 AS band, v FROM b WHERE b0 IS NOT NULL UNION ALL SELECT label, b1, v FROM b WHERE b1 IS NOT NULL) GROUP BY ALL""")
def band_mean(spark, sf):
    d = dims(spark, sf).select("label", F.col("k").cast("double").alias("f"), F.col("v").alias("power"))
    return rounded(signal.band_power(d, "label", [(4, 12), (8, 30)]), "power")


@query(f"""WITH {E_SQL}, r AS (SELECT user_id, 45.0 * (event_id % 8) AS deg, avg(value) AS y FROM e GROUP BY ALL), x AS (SELECT user_id, cos(radians(deg)) AS c, sin(radians(deg)) AS s, y FROM r),
m AS (SELECT user_id, count(*) AS n, avg(c) AS c, avg(s) AS s, avg(y) AS y, covar_pop(c, c) AS cc, covar_pop(c, s) AS cs, covar_pop(s, s) AS ss, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy FROM x GROUP BY 1),
b AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS b1, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b2 FROM m)
SELECT user_id, n, round(b1, 5) AS b1, round(b2, 5) AS b2, round(y - b1 * c - b2 * s, 5) AS b3, round(sqrt(b1 * b1 + b2 * b2), 5) AS depth FROM b""")
def tuning_fit(spark, sf):
    r = events(spark, sf).groupBy("user_id", (45.0 * (F.col("event_id") % 8)).alias("deg")).agg(F.avg("value").alias("y"))
    return rounded(decode.tuning_fit(r, "user_id", "deg", "y").drop("preferred"), "b1", "b2", "b3", "depth", digits=5)


@query("""SELECT l_suppkey, l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY ALL""")
def mean_rate_per_condition(spark, sf):
    return rounded(decode.condition_means(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity"), "mean", "std")


@query("""WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM g GROUP BY 1)
SELECT l_suppkey, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f, k - 1 AS between, CAST(n - k AS BIGINT) AS within FROM t""")
def anova(spark, sf):
    return rounded(decode.anova(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity"), "f", digits=5)


@query(f"""WITH {P_SQL} SELECT vec_id, CAST(least(floor((((pi() / 4 - atan2(y, x)) % (2 * pi()) + 2 * pi()) % (2 * pi())) / (2 * pi() / 4)) + 1, 4) AS INTEGER) AS angle_bin, round(((atan2(y, x)) % (2 * pi()) + 2 * pi()) % (2 * pi()), 6) AS angle, round((0.6 * x + 0.8 * y), 6) AS along FROM p""")
def angle_bins(spark, sf):
    p = pairs(spark, sf).withColumn("a", F.array("x", "y"))
    r = geo.rotate("a", [1.0, 0.0], [3.0, 4.0])
    return p.select("vec_id", geo.digitize_by_angle("a").alias("angle_bin"), F.round(geo.vector_angle("a"), 6).alias("angle"), F.round(r[0], 6).alias("along"))


@query("""WITH a AS (SELECT vec_id, embedding[1:len(embedding) // 2] AS a, embedding[len(embedding) // 2 + 1:] AS b FROM embeddings), c AS (SELECT vec_id, list_transform(a, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(b, lambda x: CAST(x AS DOUBLE)) AS b FROM a)
SELECT vec_id, round(acos(greatest(-1.0, least(1.0, list_inner_product(a, b) / sqrt(list_inner_product(a, a)) / sqrt(list_inner_product(b, b))))), 6) AS angle, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance, round(sqrt(list_inner_product(a, a)), 6) AS radius FROM c""")
def vector_geometry_halves(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = e.select("vec_id", F.expr("slice(e, 1, size(e) div 2)").alias("a"), F.expr("slice(e, size(e) div 2 + 1, size(e))").alias("b"))
    return e.select("vec_id", F.round(geo.angle_between("a", "b"), 6).alias("angle"), F.round(geo.distance("a", "b"), 6).alias("distance"), F.round(geo.radial_distance("a"), 6).alias("radius"))


@query("""SELECT c_custkey, round(c_acctbal / (1 + exp(-100.0 * (0.08 - (c_custkey % 20) / 100.0))), 4) AS scaled, CAST(CASE WHEN c_custkey = 0 THEN 1 ELSE ceil(log2(c_custkey)) END AS INTEGER) AS p2 FROM customer""")
def scalar_expressions(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.round(geo.logistic_scale("c_acctbal", (F.col("c_custkey") % 20) / 100.0), 4).alias("scaled"), geo.nextpow2("c_custkey").alias("p2"))


ACC_ALL = f"""WITH {D_SQL}, x AS (SELECT vec_id, k, v, label < 5 AS alt FROM d), c AS (SELECT alt, k, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL),
o AS (SELECT x.*, (s - v) / (n - 1) AS own, v - s / n AS r, (SELECT c2.s / c2.n FROM c c2 WHERE c2.k = x.k AND c2.alt = NOT x.alt) AS other FROM x JOIN c ON x.alt = c.alt AND x.k = c.k), g AS (SELECT stddev_samp(r) AS sg FROM o),
l AS (SELECT vec_id, k, alt, (CASE WHEN alt THEN -(v - own) * (v - own) + (v - other) * (v - other) ELSE -(v - other) * (v - other) + (v - own) * (v - own) END) / (2 * sg * sg) AS llr FROM o, g),
acc AS (SELECT vec_id, k, alt, sum(llr) OVER (PARTITION BY vec_id ORDER BY k) AS accllr FROM l)"""


def _acc_all(spark, sf):
    x = dims(spark, sf).withColumns({"alt": F.col("label") < 5, "channel": F.lit(1)})
    return latency.accllr(x, "channel", "vec_id", "k", "v", "alt")


@query(f"{ACC_ALL} SELECT vec_id, k, alt, round(accllr, 5) AS accllr FROM acc")
def accllr_cumulative_all(spark, sf):
    return _acc_all(spark, sf).select("vec_id", F.col("k").cast("long").alias("k"), "alt", F.round("accllr", 5).alias("accllr"))


@query(f"""{ACC_ALL}, h AS (SELECT vec_id, alt, level, min(CASE WHEN accllr >= level THEN k END) AS u, min(CASE WHEN accllr <= -level THEN k END) AS d FROM acc, (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS level) GROUP BY ALL)
SELECT vec_id, level, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 1 WHEN d IS NOT NULL AND (u IS NULL OR d < u) THEN -1 ELSE 0 END AS side, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN u WHEN d IS NOT NULL AND (u IS NULL OR d < u) THEN d END AS at FROM h""")
def accllr_levels_all(spark, sf):
    got = latency.detect(_acc_all(spark, sf), "channel", "vec_id", "k", "accllr", [0.5, 1.0, 2.0, 4.0])
    return got.select("vec_id", "level", "side", F.col("at").cast("long").alias("at"))


@query(f"""WITH {D_SQL}, b AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM d WHERE label = 0 GROUP BY 1), z AS (SELECT vec_id, d.k, abs(v - m) > 2.0 * s AS o FROM d JOIN b ON d.k = b.k WHERE label <> 0) SELECT vec_id, min(CASE WHEN o THEN k END) AS first FROM z GROUP BY 1""")
def erp_response(spark, sf):
    d = dims(spark, sf)
    got = latency.first_deviation(d.where("label <> 0"), d.where("label = 0"), "k", "vec_id", "k", "v", 1.0, 2.0)
    return got.groupBy("vec_id").agg(F.min("latency").cast("long").alias("first"))


@query(f"""WITH {P_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x) AS n FROM p) SELECT row, "column", round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT CAST(id // 8 AS BIGINT) AS row, CAST(id % 8 AS BIGINT) AS "column", (SELECT arg_min(q.vec_id, sqrt((q.x - (-0.5 + (id % 8) * (1.0 / 7))) ** 2 + (q.y - (-0.5 + (id // 8) * (1.0 / 7))) ** 2)) FROM q WHERE label = 0) AS v FROM range(64) r(id))""")
def nearest_map(spark, sf):
    p = pairs(spark, sf).where("label = 0")
    return electrodes.nearest_map(p, "x", "y", "vec_id", 8, 8, (-0.5, 0.5, -0.5, 0.5))


@query(f"""WITH {P_SQL} SELECT vec_id, round(sqrt((x - 0.1) * (x - 0.1) + (y + 0.1) * (y + 0.1)), 6) AS distance FROM p WHERE sqrt((x - 0.1) * (x - 0.1) + (y + 0.1) * (y + 0.1)) >= 0.1 AND sqrt((x - 0.1) * (x - 0.1) + (y + 0.1) * (y + 0.1)) < 0.3""")
def channels_near_site(spark, sf):
    return rounded(electrodes.near_site(pairs(spark, sf), 0.1, -0.1, (0.1, 0.3)).select("vec_id", "distance"), "distance")


@query("""WITH f AS (SELECT n_nationkey + 1 AS acq, min(n_regionkey) + 1 AS el FROM nation WHERE n_nationkey < 20 GROUP BY 1) SELECT c_custkey, coalesce(el, 0) - 1 AS electrode FROM customer LEFT JOIN f ON c_nationkey + 1 = acq""")
def lookup_electrodes(spark, sf):
    path = table(spark, sf, "nation").where("n_nationkey < 20").select((F.col("n_nationkey") + 1).alias("acq"), (F.col("n_regionkey") + 1).alias("electrode_no"))
    return electrodes.lookup(table(spark, sf, "customer"), path, "c_nationkey", "acq", "electrode_no", "electrode").select("c_custkey", "electrode")


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, l_returnflag, max(m) - min(m) AS a FROM a GROUP BY ALL) SELECT l_suppkey, round(max(a), 3) AS amplitude, max(a) > 5000 AS high FROM s GROUP BY 1""")
def high_amplitude_units(spark, sf):
    return rounded(spikes.amplitudes(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice", 5000.0), "amplitude", digits=3)


@query()
def lda_accuracy(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("entry", F.lit(1))
    return rounded(decode.lda_accuracy(e, "entry", "embedding", "label", order="vec_id"), "accuracy", "std")


@query()
def bootstrap_means(spark, sf):
    return rounded(stats.bootstrap_means(pairs(spark, sf), "label", "vec_id", "x", 10, 20), "mean")


@query()
def multitaper_spectrum(spark, sf):
    return rounded(signal.psd(samples(spark, sf), "user_id", "i", "value", 100.0), "power")


@query()
def butterworth_lowpass(spark, sf):
    from trialspark.functions import dsp

    return rounded(signal.filter_series(samples(spark, sf), "user_id", "i", "value", *dsp.butterworth(None, 10.0, 100.0, 4, "lowpass")), "value")
