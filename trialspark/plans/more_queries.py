"""Queries of operators that the other modules leave out: behaviour, gaze, units, pulses, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import behavior, catalog, decode, latency, quality, runs, segments, signal, spikes, stats, tabulate, temporal
from trialspark.plans.events_queries import CUT, END, ORDER, START
from trialspark.plans.tables import D_SQL, E_SQL, P_SQL, S_SQL, dims, events, pairs, samples, table

QUERIES, SQL = {}, {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, i, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS st FROM s),
n AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS f FROM w), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY i) AS run FROM n) SELECT user_id, i, NOT (st = 1 AND count(*) OVER (PARTITION BY user_id, run) > 1) AS engaged FROM g""")
def engagement(spark, sf):
    return behavior.engagement(samples(spark, sf), "user_id", "i", ["event_type"], 1.0, 1.0).select("user_id", "i", "engaged")


@query(f"""WITH {S_SQL}, m AS (SELECT *, event_type = 'view' AS a, event_type IN ('purchase', 'error') AS x FROM s), l AS (SELECT *, lead(us) OVER w AS nus, lead(a) OVER w AS na FROM m WHERE a OR x WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, sum(nus - us) AS t FROM l WHERE a AND NOT na GROUP BY 1), z AS (SELECT user_id, max(us) - min(us) AS s FROM s GROUP BY 1) SELECT z.user_id, CAST(coalesce(t, 0) AS DOUBLE) AS in_time, round(CASE WHEN s > 0 THEN coalesce(t, 0) / s END, 9) AS proportion FROM z LEFT JOIN c ON z.user_id = c.user_id""")
def tracking_in_time(spark, sf):
    e = events(spark, sf).withColumn("us", F.col("us").cast("double"))
    got = behavior.tracking_in_time(e, "user_id", ORDER, "event_type", "us", "view", ("purchase", "error"))
    return got.withColumn("proportion", F.round("proportion", 9))


@query(f"""WITH {D_SQL}, b AS (SELECT vec_id, avg(v) + 1.0 * stddev_pop(v) AS thr FROM d WHERE k < 20 GROUP BY 1) SELECT d.vec_id, min(CASE WHEN k >= 24 AND v > thr THEN k END) AS onset FROM d JOIN b ON d.vec_id = b.vec_id GROUP BY 1""")
def movement_onset(spark, sf):
    d = dims(spark, sf).withColumns({"k": F.col("k").cast("long"), "a": F.lit(0), "b": F.lit(20), "c": F.lit(24)})
    return behavior.movement_onset(d, "vec_id", "k", "v", "a", "b", "c", 1.0)


@query(f"""WITH {P_SQL} SELECT vec_id, CAST(CASE WHEN sqrt(x * x + y * y) < 0.1 THEN 0 WHEN sqrt((x - 0.2) ** 2 + y ** 2) < 0.1 THEN 1 WHEN sqrt((x - 0.1) ** 2 + (y - 0.1) ** 2) < 0.1 THEN 2 ELSE -1 END AS INTEGER) AS target FROM p""")
def saccade_target_index(spark, sf):
    return behavior.saccade_target(pairs(spark, sf), [(0.0, 0.0), (0.2, 0.0), (0.1, 0.1)], "x", "y", 0.1).select("vec_id", "target")


@query(f"""WITH {S_SQL}, h AS (SELECT user_id, i, event_id % 3 = 0 AND (event_id // 3) % 4 = user_id % 4 AS ok, value FROM s), r AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) AS n FROM h WHERE ok)
SELECT u.user_id, coalesce(r.i, -1) AS saccade FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN r ON u.user_id = r.user_id AND n = 1""")
def relevant_saccade(spark, sf):
    s = samples(spark, sf).withColumns({"on": F.col("event_id") % 3, "off": F.floor(F.col("event_id") / 3) % 4, "target": F.col("user_id") % 4})
    return behavior.relevant_saccade(s, "user_id", "i", "on", "off", "value", "target")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 7) AS r FROM lineitem GROUP BY 1""")
def eye_calibration(spark, sf):
    c = behavior.eye_calibration(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return c.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 7).alias("r"))


@query(f"""WITH {P_SQL} SELECT vec_id, round(0.6 * y - 0.8 * x, 6) AS error FROM p""")
def movement_error(spark, sf):
    return behavior.movement_error(pairs(spark, sf), ["x", "y"], [3.0, 4.0]).select("vec_id", F.round("error", 6).alias("error"))


@query("""WITH p AS (SELECT l_suppkey, l_linenumber, max(l_quantity) - min(l_quantity) AS p2p FROM lineitem GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY p2p DESC, l_linenumber) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 3""")
def top_channels(spark, sf):
    return spikes.top_channels(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity", 3)


@query("""WITH e AS (SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b, count(*) AS n, CAST(floor((max(l_quantity) - min(l_quantity)) / 2.0) AS INTEGER) + 1 AS k FROM lineitem GROUP BY 1),
h AS (SELECT l.l_returnflag, CAST(floor((l_quantity - a) / 2.0) AS INTEGER) AS i, count(*) AS c FROM lineitem l JOIN e ON l.l_returnflag = e.l_returnflag GROUP BY ALL), g AS (SELECT l_returnflag, k, n, unnest(generate_series(0, k - 1)) AS i FROM e),
x AS (SELECT g.*, coalesce(c, 0) AS c FROM g LEFT JOIN h ON g.l_returnflag = h.l_returnflag AND g.i = h.i), y AS (SELECT l_returnflag, max(n) AS n, avg(CASE WHEN i < greatest(1, floor(k * 0.1)) THEN c END) AS low, avg(CASE WHEN i >= floor(k * 0.75) THEN c END) AS top, stddev_pop(CASE WHEN i >= floor(k * 0.75) THEN c END) AS sd, max(c) AS mx FROM x GROUP BY 1)
SELECT l_returnflag, n, round((low - top) / sd, 5) AS cutoff, round(low / mx, 6) AS ratio, n >= 10 AND (low - top) / sd <= 5.0 AS good FROM y""")
def noise_cutoff(spark, sf):
    got = spikes.noise_cutoff(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 2.0)
    return got.withColumns({"cutoff": F.round("cutoff", 5), "ratio": F.round("ratio", 6)})


@query(f"""WITH {E_SQL}, z AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1), o AS (SELECT event_type, coalesce(sum(n) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM z)
SELECT event_id, arg_max(o.event_type, a) AS entry, CAST(event_id - max(a) AS BIGINT) AS entry_sample FROM e JOIN o ON a <= event_id GROUP BY event_id""")
def split_entries(spark, sf):
    e = events(spark, sf)
    sizes = e.groupBy(F.col("event_type").alias("entry")).agg(F.count("*").alias("n")).withColumn("ord", F.col("entry"))
    return spikes.split_entries(e, sizes, "event_id").select("event_id", "entry", "entry_sample")


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, i, value, value > m + s AS hit FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM s)), h AS (SELECT user_id, i, hit AND NOT lag(hit) OVER (PARTITION BY user_id ORDER BY i) AS up FROM w)
SELECT h.user_id, h.i, count(x.value) AS n, round(sum(x.value), 4) AS total FROM h LEFT JOIN s x ON x.user_id = h.user_id AND x.i BETWEEN h.i - 2 AND h.i + 2 WHERE up GROUP BY ALL""")
def spike_waveforms(spark, sf):
    s = samples(spark, sf)
    hits = spikes.detect(s, spikes.threshold(s, "user_id", "value", multiplier=1.0), "user_id", "i", "value", 1.0)
    got = spikes.waveforms(hits, s, "user_id", "i", "value", 2, 5)
    kept = F.filter("waveform", lambda x: x.isNotNull())
    return got.select("user_id", "i", F.size(kept).cast("long").alias("n"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {E_SQL}, x AS (SELECT user_id, us AS t FROM e WHERE event_type = 'purchase'), a AS (SELECT user_id, CAST(t AS DOUBLE) AS time, 1.0::DOUBLE AS value FROM x UNION ALL SELECT user_id, CAST(t + 1000 AS DOUBLE), 0.0::DOUBLE FROM x UNION ALL SELECT DISTINCT user_id, 0.0::DOUBLE, 0.0::DOUBLE FROM x) SELECT * FROM a""")
def edges_from_onsets(spark, sf):
    e = events(spark, sf).where("event_type = 'purchase'").withColumn("t", F.col("us").cast("double"))
    return runs.edges_from_onsets(e, "user_id", "t", 1000.0)


@query(f"""WITH {S_SQL}, b AS (SELECT user_id, us, event_type = 'view' AS up, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY us) AS n FROM s WHERE event_type IN ('view', 'click')), c AS (SELECT user_id, least(sum(CASE WHEN up THEN 1 ELSE 0 END), sum(CASE WHEN up THEN 0 ELSE 1 END)) AS m FROM b GROUP BY 1)
SELECT b.user_id, CAST(b.n AS INTEGER) AS n, max(CASE WHEN up THEN CAST(us AS DOUBLE) END) AS "on", max(CASE WHEN NOT up THEN CAST(us AS DOUBLE) END) AS off FROM b JOIN c ON b.user_id = c.user_id AND b.n <= c.m GROUP BY b.user_id, b.n""")
def reward_intervals(spark, sf):
    from pyspark.sql import Window

    s = events(spark, sf).where("event_type in ('view', 'click')").select("user_id", F.col("us").cast("double").alias("t"), (F.col("event_type") == "view").alias("up"))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "up").orderBy("t")))
    fewer = s.groupBy("user_id").agg(F.least(F.sum(F.col("up").cast("int")), F.sum((~F.col("up")).cast("int"))).alias("m"))
    return segments.reward_intervals(s.join(fewer, "user_id").where("n <= m").drop("n", "m"), "user_id", "t", "up")


@query(f"""WITH {CUT}, firsts AS (SELECT user_id, min(event_id) AS f FROM e GROUP BY 1), p AS (SELECT firsts.user_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM firsts JOIN e ON e.event_id = firsts.f) SELECT cut.user_id, start_i, k, none FROM cut LEFT JOIN p ON cut.user_id = p.user_id""")
def trial_metadata(spark, sf):
    e = events(spark, sf)
    cut = segments.trial_segments(e, "user_id", ORDER, "event_type", START, END, "us").select("user_id", "start_i")
    sessions = e.groupBy("user_id").agg(F.min_by("props", "event_id").alias("params"))
    return tabulate.with_metadata(cut, sessions, "user_id", ["k", "none"])


@query("""WITH t AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) SELECT label, round(CAST(e[1] AS DOUBLE), 4) AS x, round(CAST(e[3] AS DOUBLE), 4) AS y, round(CAST(e[2] AS DOUBLE), 4) AS z FROM t""")
def target_locations(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("target"))
    got = tabulate.target_locations(e, "vec_id", "label")
    return got.select("label", F.col("target")[0].alias("x"), F.col("target")[1].alias("y"), F.col("target")[2].alias("z"))


@query("""WITH f AS (SELECT c_custkey, list_filter(['emg', 'neuropixel', 'eye_data'], lambda x: (x = 'emg' AND c_custkey % 2 = 0) OR (x = 'neuropixel' AND c_custkey % 3 = 0) OR (x = 'eye_data' AND c_custkey % 5 = 0)) AS f FROM customer)
SELECT c_custkey, concat_ws(',', 'exp', CASE WHEN list_contains(f, 'eye_data') THEN 'eye' END, CASE WHEN list_contains(f, 'emg') THEN 'emg' END, CASE WHEN list_contains(f, 'neuropixel') THEN 'ap,lfp' END) AS sources, list_contains(f, 'emg') AND list_contains(f, 'eye_data') AS "both" FROM f""")
def recording_sources(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.array_compact(F.array(F.when(F.col("c_custkey") % 2 == 0, "emg"), F.when(F.col("c_custkey") % 3 == 0, "neuropixel"), F.when(F.col("c_custkey") % 5 == 0, "eye_data"))).alias("features"))
    return c.select("c_custkey", F.concat_ws(",", catalog.sources()).alias("sources"), catalog.has_features(["emg", "eye_data"]).alias("both"))


@query("""SELECT min(n) AS least FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)""")
def least_trials(spark, sf):
    return decode.least_trials(table(spark, sf, "lineitem"), "l_returnflag")


@query(f"""WITH {D_SQL}, g AS (SELECT label, CAST(k AS DOUBLE) AS f, abs(v) * 10 AS g FROM d), m AS (SELECT label, f, avg(g) AS g FROM g GROUP BY ALL) SELECT label, min(CASE WHEN g < 1 THEN f END) AS crossover FROM m GROUP BY 1""")
def crossover_frequency(spark, sf):
    g = dims(spark, sf).select("label", F.col("k").cast("double").alias("f"), (F.abs("v") * 10).alias("gain"))
    return latency.crossover_frequency(g, "label", "f", "gain")


@query("""WITH s AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, round(greatest(a, m - 3 * s), 6) AS low, round(least(b, m + 3 * s), 6) AS high FROM s""")
def noise_bounds(spark, sf):
    return quality.noise_bounds(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {D_SQL} SELECT label, round(avg(v), 7) AS power FROM d WHERE k >= 8 AND k < 24 GROUP BY 1""")
def tfr_mean_all(spark, sf):
    d = dims(spark, sf).select("label", F.col("k").cast("double").alias("f"), F.col("vec_id").cast("double").alias("t"), F.col("v").alias("power"))
    return signal.tfr_mean(d, "label", (8, 24), (float("-inf"), float("inf"))).withColumn("power", F.round("power", 7))


@query(f"""WITH {P_SQL}, i AS (SELECT label, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p GROUP BY 1) SELECT label, round(greatest(0.0, least(b, d) - greatest(a, c)) / least(b - a, d - c), 6) AS overlap FROM i""")
def interval_overlap(spark, sf):
    i = pairs(spark, sf).groupBy("label").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    return i.select("label", F.round(stats.interval_overlap("a", "b", "c", "d"), 6).alias("overlap"))


@query(f"""WITH {E_SQL}, c AS (SELECT user_id, event_type AS barcode, min(us) AS t FROM e WHERE event_id % 2 = 0 GROUP BY ALL), m AS (SELECT user_id, event_type AS barcode, min(us) AS t FROM e WHERE event_id % 2 = 1 GROUP BY ALL) SELECT c.user_id, c.barcode, c.t AS own, m.t AS main FROM c JOIN m ON c.user_id = m.user_id AND c.barcode = m.barcode""")
def common_barcodes(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.col("event_type").alias("barcode"), F.col("us").alias("t"))
    return temporal.common_barcodes(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id")
