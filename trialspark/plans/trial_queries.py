"""Queries of the data of each trial, and of operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.functions import bits
from trialspark.operators import catalog, electrodes, eye, latency, quality, segments, signal, trialdata
from trialspark.plans.events_queries import CUT, END, ORDER, START
from trialspark.plans.tables import D_SQL, S_SQL, dims, events, samples, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _trials(spark, sf):
    return segments.trial_segments(events(spark, sf), "user_id", ORDER, "event_type", START, END, "us").select("user_id", "start_i", "end_i")


@query(f"""WITH {CUT}, r AS (SELECT user_id, start_i, CAST(floor(start_i * 0.5) AS BIGINT) AS a, CAST(floor(end_i * 0.5) AS BIGINT) AS b FROM cut)
SELECT r.user_id, start_i, i // 2 - a AS k, value FROM r JOIN s ON s.user_id = r.user_id AND i % 2 = 0 AND i // 2 >= a AND i // 2 < b""")
def tabulate_task_data(spark, sf):
    got = trialdata.task_data(samples(spark, sf).select("user_id", "i", "value"), _trials(spark, sf), "user_id", "start_i", "end_i", 1.0, 2)
    return got.select("user_id", "start_i", "k", "value")


@query(f"""WITH {CUT}, r AS (SELECT user_id, start_i, CAST(floor(start_i / 3::DOUBLE) AS BIGINT) AS a, CAST(floor(end_i / 3::DOUBLE) AS BIGINT) AS b FROM cut)
SELECT r.user_id, start_i, count(*) AS n, round(avg(value), 6) AS mean FROM r JOIN s ON s.user_id = r.user_id AND i % 3 = 0 AND i // 3 >= a AND i // 3 < b GROUP BY ALL""")
def tabulate_feature_data(spark, sf):
    got = trialdata.feature_data(samples(spark, sf).select("user_id", "i", "value"), _trials(spark, sf), "user_id", "start_i", "end_i", 1.0, 60.0, 0.05)
    return got.groupBy("user_id", "start_i").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {CUT} SELECT cut.user_id, start_i, i - start_i AS k, round(sqrt(value * value + CAST(i % 7 AS DOUBLE) * (i % 7)), 6) AS value FROM cut JOIN s ON s.user_id = cut.user_id AND i >= start_i AND i < end_i""")
def tabulate_kinematic_data(spark, sf):
    s = samples(spark, sf).select("user_id", "i", "value", (F.col("i") % 7).cast("double").alias("y"))
    got = trialdata.kinematic_data(s, _trials(spark, sf), "user_id", "start_i", "end_i", ["value", "y"], 1.0, norm=True)
    return got.select("user_id", "start_i", "k", F.round("value", 6).alias("value"))


ERP = f"""WITH {S_SQL}, z AS (SELECT user_id, max(i) + 1 AS n FROM s GROUP BY 1), t AS (SELECT s.user_id, i AS t, i < n - 3 AS ok FROM s JOIN z ON s.user_id = z.user_id WHERE event_type = 'purchase'),
g AS (SELECT user_id, t, k, CASE WHEN ok THEN t - 2 + k END AS i FROM t, generate_series(0, 4) AS q(k)), x AS (SELECT g.user_id, g.t, g.k, s.value FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.i = g.i),
b AS (SELECT user_id, t, avg(value) AS b FROM x WHERE k < 2 GROUP BY ALL), erp AS (SELECT x.user_id, x.t, k, value - b AS value FROM x JOIN b ON x.user_id = b.user_id AND x.t = b.t)"""


def _triggers(spark, sf):
    s = samples(spark, sf)
    return s.select("user_id", "i", "value"), s.where("event_type = 'purchase'").select("user_id", F.col("i").alias("t"))


@query(f"{ERP} SELECT user_id, t, CAST(k AS BIGINT) AS k, round(value, 6) AS value FROM erp")
def erp(spark, sf):
    got = trialdata.erp(*_triggers(spark, sf), "user_id", "t", "value", 2, 3, 1)
    return got.select("user_id", "t", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


@query(f"""{ERP}, m AS (SELECT user_id, k, avg(value) AS v FROM erp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(v) DESC, k) AS n FROM m WHERE k >= 2 AND k < 5 AND v IS NOT NULL)
SELECT user_id, round(v, 9) AS peak, CAST(k AS BIGINT) AS at FROM r WHERE n = 1""")
def max_erp_of_triggers(spark, sf):
    got = trialdata.max_erp(*_triggers(spark, sf), "user_id", "t", "value", 2, 3, 1)
    return got.select("user_id", F.round("peak", 9).alias("peak"), F.col("at").cast("long").alias("at"))


@query(f"""WITH {D_SQL}, o AS (SELECT label, avg(v) AS o FROM d WHERE k >= 8 AND k < 24 GROUP BY 1), e AS (SELECT label, vec_id, avg(v) AS p FROM d WHERE k >= 32 GROUP BY ALL),
x AS (SELECT e.label, o - p AS d FROM e JOIN o ON e.label = o.label), a AS (SELECT label, d, rank() OVER (PARTITION BY label ORDER BY abs(d)) + (count(*) OVER (PARTITION BY label, abs(d)) - 1) / 2.0 AS r FROM x WHERE d <> 0)
SELECT x.label, round(avg(x.d), 7) AS difference, any_value(w.w) AS w, any_value(w.n) AS n FROM x JOIN (SELECT label, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 3) AS w, count(*) AS n FROM a GROUP BY 1) w ON x.label = w.label GROUP BY 1""")
def tfr_ranktest_sums(spark, sf):
    """The parts of ``tfr_ranktest`` that SQL has: differences and rank sums (p is held against a loop in tests)."""
    from trialspark.operators import stats

    d = dims(spark, sf)
    spectrum = d.select("label", F.col("k").cast("double").alias("f"), F.lit(0.0).alias("t"), F.col("v").alias("power"))
    null = d.where("k >= 32").select("label", "vec_id", (F.col("k") - 24).cast("double").alias("f"), F.lit(0.0).alias("t"), F.col("v").alias("power"))
    got = trialdata.tfr_ranktest(spectrum, null, "label", "vec_id", (8, 24 + 16), alpha=1.0)
    own = signal.tfr_mean(spectrum, "label", (8, 24)).withColumnRenamed("power", "o")
    x = signal.tfr_mean(null, ["label", "vec_id"], (8, 40)).join(own, "label").withColumn("d", F.col("o") - F.col("power"))
    w = stats.wilcoxon(x, "label", "d", "greater").select("label", F.round("w", 3).alias("w"), "n")
    mean = x.groupBy("label").agg(F.round(F.avg("d"), 7).alias("difference"))
    return mean.join(w, "label").join(got.select("label"), "label")


@query("""SELECT c_custkey, n_nationkey AS acq FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40 AND n_regionkey < 3""")
def electrodes_to_channels(spark, sf):
    path = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("electrode"), F.col("n_nationkey").alias("acq"))
    asked = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("electrode"))
    return electrodes.electrodes_to_channels(asked, path, "c_custkey").select("c_custkey", "acq")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS acq FROM customer WHERE c_nationkey % 3 <> 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def connected_channels(spark, sf):
    path = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("acq"))
    return electrodes.connected(path, table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("acq")))


@query("""SELECT l_orderkey, CAST(sum(DISTINCT 1::BIGINT << CAST(l_suppkey % 50 AS BIGINT)) AS BIGINT) AS mask FROM lineitem GROUP BY 1""")
def channels_to_mask(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 50).alias("c"))
    return rows.select("l_orderkey", bits.channels_to_mask(F.col("c")).alias("mask"))


@query("""SELECT c_custkey, c_custkey % 5 <> 0 AS perturbed FROM customer""")
def perturbed_mappings(spark, sf):
    one, x = F.lit(1.0), (F.col("c_custkey") % 5).cast("double")
    rows = table(spark, sf, "customer").select("c_custkey", F.array(F.array(one, F.lit(0.0), x), F.array(F.lit(0.0), one, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), one)).alias("m"))
    return rows.select("c_custkey", catalog.is_perturbed("m").alias("perturbed"))


@query(f"""WITH {D_SQL}, m AS (SELECT k, avg(v) AS m1 FROM d WHERE label < 5 GROUP BY 1), n AS (SELECT k, avg(v) AS m2 FROM d WHERE label >= 5 GROUP BY 1)
SELECT vec_id, CAST(d.k AS BIGINT) AS k, round(ln(0.3 / 0.2) - (v - m1) * (v - m1) / 0.08 + (v - m2) * (v - m2) / 0.18, 5) AS llr FROM d JOIN m ON d.k = m.k JOIN n ON d.k = n.k""")
def likelihood_ratio(spark, sf):
    d = dims(spark, sf)
    mean = d.groupBy("k").agg(F.avg(F.when(F.col("label") < 5, F.col("v"))).alias("m1"), F.avg(F.when(F.col("label") >= 5, F.col("v"))).alias("m2"))
    r = latency.llr(F.col("v"), F.col("m1"), F.col("m2"), F.lit(0.2), F.lit(0.3))
    return d.join(F.broadcast(mean), "k").select("vec_id", F.col("k").cast("long").alias("k"), F.round(r, 5).alias("llr"))  # 64 rows


@query(f"""WITH {S_SQL}, a AS (SELECT user_id, i FROM s WHERE event_type = 'click') SELECT a.user_id, a.i AS onset, p.value AS onset_value, q.value AS offset_value FROM a LEFT JOIN s p ON p.user_id = a.user_id AND p.i = a.i LEFT JOIN s q ON q.user_id = a.user_id AND q.i = a.i + 2""")
def gaze_positions_at(spark, sf):
    s = samples(spark, sf)
    a = s.where("event_type = 'click'").select("user_id", F.col("i").cast("double").alias("onset"), F.lit(2.0).alias("duration"))
    got = eye.positions_at(a, s, "user_id", "i", ["value"], 1.0)
    return got.select("user_id", F.col("onset").cast("long").alias("onset"), "onset_value", "offset_value")


@query(f"""WITH {D_SQL}, c AS (SELECT label, vec_id, median(v) AS m, stddev_pop(v) AS s FROM d GROUP BY ALL), o AS (SELECT d.label, k, CAST(abs(v - m) > 1.5 * s AS INTEGER) AS o FROM d JOIN c ON d.label = c.label AND d.vec_id = c.vec_id)
SELECT label, CAST(k AS BIGINT) AS k, avg(o) > 0.14 AS bad FROM o GROUP BY ALL""")
def bad_timepoints(spark, sf):
    got = quality.bad_timepoints(dims(spark, sf), "label", "k", "vec_id", "v", 1.5, 0.14)
    return got.select("label", F.col("k").cast("long").alias("k"), "bad")


@query(f"""WITH {D_SQL}, c AS (SELECT d.vec_id, f.f, sum(v * cos(2 * pi() * f.f * k / 64)) * 2 / 64 AS re, -sum(v * sin(2 * pi() * f.f * k / 64)) * 2 / 64 AS im FROM d, (SELECT unnest(generate_series(1, 31)) AS f) f GROUP BY ALL)
SELECT vec_id, CAST(f AS BIGINT) AS f, round(sqrt(re * re + im * im), 5) AS amplitude FROM c""")
def fft_amplitudes(spark, sf):
    got = signal.fft_values(dims(spark, sf), "vec_id", "k", "v", 64.0).where("f > 0 and f < 32")
    return got.select("vec_id", F.round("f", 0).cast("long").alias("f"), F.round("amplitude", 5).alias("amplitude"))
