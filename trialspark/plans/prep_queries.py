"""Queries of the preparation operators: clocks, tracking, references, eye movements, maps, electrodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import catalog, electrodes, etl, eye, quality, runs, segments, spatial, stim, temporal
from trialspark.plans.tables import D_SQL, E_SQL, P_SQL, S_SQL, dims, events, pairs, samples, table

QUERIES, SQL = {}, {}
DAY, HOUR = 86_400_000_000, 3_600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {S_SQL}, c AS (SELECT user_id, i, us - min(us) OVER (PARTITION BY user_id) + (SELECT min(b.us) FROM e b WHERE b.user_id = s.user_id AND b.event_type <> 'view') AS a FROM s WHERE event_type = 'view'),
m AS (SELECT *, (SELECT b.us FROM e b WHERE b.user_id = c.user_id AND b.event_type <> 'view' AND abs(b.us - c.a) <= {HOUR} * 6 ORDER BY abs(b.us - c.a), b.us LIMIT 1) AS m FROM c)
SELECT user_id, i, CAST(a AS BIGINT) AS timestamp_internal, CAST(coalesce(m, a) AS BIGINT) AS timestamp_sync, m IS NULL AS sync_missing FROM m""")
def correct_clock(spark, sf):
    s = samples(spark, sf)
    clock = s.where("event_type = 'view'").select("user_id", "i", F.col("us").cast("double").alias("t"))
    sync = s.where("event_type <> 'view'").select("user_id", F.col("us").cast("double").alias("timestamp"))
    got = etl.correct_clock(clock.join(sync.select("user_id").distinct(), "user_id", "left_semi"), "user_id", "i", "t", sync, fps=1.5 / (HOUR * 6))
    return got.select("user_id", "i", F.col("timestamp_internal").cast("long").alias("timestamp_internal"), F.col("timestamp_sync").cast("long").alias("timestamp_sync"), "sync_missing")


@query(f"WITH {S_SQL}, w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS p FROM s) SELECT event_id, CASE WHEN p IS NULL OR p <> event_type THEN value END AS value FROM w")
def blank_frozen(spark, sf):
    return etl.blank_frozen(samples(spark, sf), "user_id", "i", ["event_type"], ["value"]).select("event_id", "value")


@query(f"WITH {D_SQL}, m AS (SELECT label, k, avg(v) AS m FROM d GROUP BY ALL) SELECT vec_id, round(sum(abs(v - m)), 5) AS referenced FROM d JOIN m ON d.label = m.label AND d.k = m.k GROUP BY 1")
def common_reference(spark, sf):
    return etl.common_reference(dims(spark, sf), "label", "vec_id", "k", "v").groupBy("vec_id").agg(F.round(F.sum(F.abs("referenced")), 5).alias("referenced"))


@query(f"""WITH {S_SQL}, c AS (SELECT user_id, i, value, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) // 2 AS DOUBLE) * 15.0::DOUBLE AS a FROM s)
SELECT user_id, i, round(cos(radians(a)) * value - sin(radians(a)) * i, 6) AS value_screen, round(sin(radians(a)) * value + cos(radians(a)) * i, 6) AS i_screen FROM c""")
def rotation_increments(spark, sf):
    s = samples(spark, sf).withColumn("reward", F.col("event_type") == "purchase")
    got = etl.rotate_by_increments(s, "user_id", "i", "reward", "value", "i", 15.0, 2)
    return got.select("user_id", "i", F.round("value_screen", 6).alias("value_screen"), F.round("i_screen", 6).alias("i_screen"))


@query("""WITH f AS (SELECT l_suppkey % 7 AS day, l_suppkey, l_linestatus, corr(l_extendedprice, l_quantity) AS r, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY ALL),
m AS (SELECT day, l_suppkey, avg(abs(r)) AS r FROM f GROUP BY ALL), b AS (SELECT day, l_suppkey, row_number() OVER (PARTITION BY day ORDER BY r DESC, l_suppkey) AS n FROM m WHERE r < 1.0 AND r >= 0.01)
SELECT f.day, e.l_suppkey AS entry, f.l_linestatus, round(f.slope, 4) AS slope FROM b JOIN f ON b.day = f.day AND b.l_suppkey = f.l_suppkey AND n = 1 JOIN (SELECT DISTINCT day, l_suppkey FROM f) e ON e.day = b.day""")
def day_calibration(spark, sf):
    fits = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("day"), F.col("l_suppkey").alias("entry"), "l_linestatus").agg(F.corr("l_extendedprice", "l_quantity").alias("r"), F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))
    return etl.day_calibration(fits, "day", "entry", "r", ["slope"], 0.01).select("day", "entry", "l_linestatus", F.round("slope", 4).alias("slope"))


@query(f"""WITH {S_SQL}, w AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)) AS d FROM s), t AS (SELECT user_id, min(d) * 40 AS thr FROM w WHERE d > 0 GROUP BY 1),
n AS (SELECT w.user_id, i, CASE WHEN d <= coalesce(thr, 0) THEN 0 ELSE 1 END AS f FROM w LEFT JOIN t ON w.user_id = t.user_id), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY i) AS run FROM n) SELECT user_id, i, count(*) OVER (PARTITION BY user_id, run) > 1 AS closed FROM g""")
def closed_eyes(spark, sf):
    return eye.closed(samples(spark, sf), "user_id", "i", "value", 10.0, 40.0, 0.1).select("user_id", "i", "closed")


@query(f"""WITH {S_SQL}, y AS (SELECT user_id, i, value AS y, lag(value) OVER p AS y1, lag(value, 2) OVER p AS y2, lead(value) OVER p AS z1, lead(value, 2) OVER p AS z2 FROM s WINDOW p AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(abs(CASE WHEN y1 IS NULL THEN (-3 * y + 4 * z1 - z2) / 2 WHEN z1 IS NULL THEN (3 * y - 4 * y1 + y2) / 2 ELSE (z1 - y1) / 2 END), 6) AS speed FROM y""")
def eye_speed(spark, sf):
    return eye.speed(samples(spark, sf), "user_id", "i", ["value"]).select("user_id", "i", F.round("speed", 6).alias("speed"))


@query(f"""WITH {E_SQL}, w AS (SELECT event_id, user_id, us, value, 0.01 AS w FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us, value FROM e WHERE event_type = 'click')
SELECT event_id, (SELECT c.us FROM c WHERE c.user_id = w.user_id AND abs(c.us - w.us) <= {HOUR} * 4 ORDER BY abs(c.us - w.us), c.us LIMIT 1) AS sensed_time FROM w""")
def match_stimulation(spark, sf):
    e = events(spark, sf)
    com = e.where("event_type = 'purchase'").select("event_id", "user_id", "us", F.lit(0.01).alias("width"))
    sen = e.where("event_type = 'click'").select("user_id", F.col("us").alias("on"), (F.col("us") + 10).alias("off"))
    return stim.match_pulses(com, sen, "user_id", "us", "width", HOUR * 4, 0.001).select("event_id", "sensed_time")


@query("""SELECT event_id, round(CASE WHEN value / 100 <= 0 THEN 0 WHEN value / 100 < 0.5 THEN (value / 100) * 0.4 WHEN value / 100 < 1 THEN 0.2 + (value / 100 - 0.5) * 1.6 ELSE 1 END * 20.0, 6) AS power FROM events""")
def calibrate_gain(spark, sf):
    g = stim.calibrate_gain(F.col("value") / 100, [(0.0, 0.0), (0.5, 0.2), (1.0, 1.0)], 20.0)
    return events(spark, sf).select("event_id", F.round(g, 6).alias("power"))


@query(f"""WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us, event_id % 5 AS ch FROM e WHERE event_type = 'signup')
SELECT p.event_id, CASE WHEN c.ch > 0 THEN c.ch END AS channel FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us""")
def switch_site(spark, sf):
    e = events(spark, sf)
    sw = e.where("event_type = 'signup'").select("user_id", F.col("us").alias("st"), (F.col("event_id") % 5).alias("channel"))
    return stim.switch_site(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), sw, "user_id", "us", "st", "channel").select("event_id", "channel")


@query(f"""WITH {P_SQL}, r AS (SELECT round(round(x, 1), 9) AS x, round(round(y, 1), 9) AS y, min(vec_id) AS v FROM p GROUP BY ALL), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS c FROM (SELECT DISTINCT x FROM r)), l AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS l FROM (SELECT DISTINCT y FROM r))
SELECT l AS row, c AS "column", r.x, r.y, v AS value FROM r JOIN c ON r.x = c.x JOIN l ON r.y = l.y""")
def data_map(spark, sf):
    p = pairs(spark, sf).groupBy(F.round("x", 1).alias("x"), F.round("y", 1).alias("y")).agg(F.min("vec_id").alias("v"))
    got = electrodes.data_map(p, "x", "y", "v")
    return got.select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "x", "y", "value")


@query(f"""WITH {P_SQL}, n AS (SELECT vec_id AS electrode, x, y FROM p WHERE vec_id % 3 <> 0) SELECT electrode, round(cos(radians(30.0)) * (x - 0.5) - sin(radians(30.0)) * (y - 0.25) + 0.5, 6) AS px, round(sin(radians(30.0)) * (x - 0.5) + cos(radians(30.0)) * (y - 0.25) + 0.25, 6) AS py FROM n""")
def electrode_positions(spark, sf):
    p = pairs(spark, sf)
    path = p.select(F.col("vec_id").alias("electrode"), F.when(F.col("vec_id") % 3 != 0, F.col("vec_id")).alias("acq"))
    layout = p.select(F.col("vec_id").alias("electrode"), F.col("x").alias("topdown_x"), F.col("y").alias("topdown_y"))
    got = electrodes.positions(path, layout, 30.0, (0.5, 0.25))
    return got.select("electrode", F.round("x", 6).alias("px"), F.round("y", 6).alias("py"))


@query(f"""WITH {E_SQL}, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r FROM (SELECT DISTINCT event_type FROM e)) SELECT event_id, CASE WHEN code >= 80 THEN 'high' WHEN code >= 40 THEN 'mid' WHEN code >= 0 THEN 'low' END AS event, code - CASE WHEN code >= 80 THEN 80 WHEN code >= 40 THEN 40 WHEN code >= 0 THEN 0 END AS data FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS code FROM e)""")
def decode_events(spark, sf):
    codes = spark.createDataFrame([("low", 0), ("mid", 40), ("high", 80)], "name string, base long")
    e = events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("code"))
    return segments.decode_events(e, codes).select("event_id", "event", "data")


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, i, value, last_value(CASE WHEN event_type = 'view' THEN true WHEN event_type = 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS on FROM s) SELECT user_id, i, CASE WHEN "on" THEN value END AS shown FROM w""")
def target_events(spark, sf):
    s = samples(spark, sf).withColumn("target", F.col("event_id") % 3)
    return segments.target_events(s, "user_id", "i", "target", F.col("event_type") == "view", F.col("event_type") == "error", "value").select("user_id", "i", "shown")


@query("""SELECT c_custkey FROM customer WHERE c_name LIKE '%1%' AND c_name LIKE '%2%' AND NOT c_name LIKE '%9%'""")
def parse_strings(spark, sf):
    return catalog.parse_strings(table(spark, sf, "customer"), "c_name", ["1", "2"], ["9"]).select("c_custkey")


@query("""SELECT symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '([A-Za-z_]\\w*)', 1)) AS symbol FROM pages WHERE page_id % 1 = 0) GROUP BY 1""")
def count_symbols(spark, sf):
    return catalog.count_symbols(table(spark, sf, "pages"), "html")


@query(f"""WITH {S_SQL}, a AS (SELECT user_id, count(*) AS n, CAST(sum(i * 7 + length(event_type)) AS BIGINT) AS h FROM s GROUP BY 1) SELECT user_id FROM a WHERE user_id % 4 = 1""")
def mismatched_entries(spark, sf):
    s = samples(spark, sf)
    other = s.withColumn("event_type", F.when(F.col("user_id") % 4 == 1, F.upper("event_type")).otherwise(F.col("event_type")))
    return quality.mismatched_entries(s, other, "user_id", "i", "event_type")


@query(f"""WITH {S_SQL}, a AS (SELECT user_id, min(us) AS own0, max(us) AS own1 FROM s GROUP BY 1) SELECT event_id, round((us - own0) * ((own1 * 1.0 - own0) * 2 / (own1 - own0)) + 100, 0) AS synced FROM s JOIN a ON s.user_id = a.user_id WHERE own1 > own0""")
def affine_sync(spark, sf):
    s = samples(spark, sf).withColumn("t", F.col("us").cast("double"))
    first = s.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("b > a")
    anchors = first.select("user_id", F.explode(F.array(F.struct(F.col("a").alias("own"), F.lit(100.0).alias("main")), F.struct(F.col("b").alias("own"), (F.lit(100.0) + 2 * (F.col("b") - F.col("a"))).alias("main")))).alias("p")).select("user_id", "p.*")
    return temporal.affine_sync(s, anchors, "user_id", "t").select("event_id", F.round("synced", 0).alias("synced"))


@query()
def local_map_correlation(spark, sf):
    d = dims(spark, sf)
    m = d.groupBy("label", (F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).alias("column")).agg(F.avg("v").alias("value"))
    other = m.select((F.col("label") - 1).alias("label"), "row", "column", "value")
    return spatial.map_correlation(m, other.where("label >= 0"), "label", (8, 8), 5).withColumn("correlation", F.round("correlation", 6))


@query()
def saccades(spark, sf):
    return eye.saccades(samples(spark, sf), "user_id", "i", ["value"], 100.0, low_cut=None)


@query(f"WITH {S_SQL}, m AS (SELECT user_id, min(value) AS a, max(value) AS b FROM s GROUP BY 1) SELECT s.user_id, i, CASE WHEN b > a THEN (value - a) / (b - a) >= 0.3 ELSE false END AS digital FROM s JOIN m ON s.user_id = m.user_id")
def edges_by_threshold(spark, sf):
    return runs.to_digital(samples(spark, sf), "user_id", "value").select("user_id", "i", "digital")
