"""Queries over the event stream: segmentation, trials, time, runs, spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.functions import bits
from trialspark.operators import behavior, catalog, runs, segments, spikes, tabulate, temporal
from trialspark.plans.tables import E_SQL, S_SQL, events, samples, table

QUERIES, SQL = {}, {}
START, END = ["view"], ["purchase", "error"]
ORDER = ["us", "event_id"]
DAY, HOUR = 86_400_000_000, 3_600_000_000
LAYOUT = tabulate.Layout(start=("view",), end=("purchase", "error"), reward=("purchase",), penalty=("error",), times={"click_us": (("click",), 1), "reward_us": (("purchase",), 1)}, flags={"clicked": ("click",)}, targets={})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


CUT = (
    S_SQL
    + """, m AS (SELECT *, event_type = 'view' AS a, event_type IN ('purchase', 'error') AS x FROM s),
l AS (SELECT *, lead(i) OVER w AS ni, lead(us) OVER w AS nus, lead(event_type) OVER w AS ne, lead(a) OVER w AS na FROM m WHERE a OR x WINDOW w AS (PARTITION BY user_id ORDER BY i)),
cut AS (SELECT user_id, i AS start_i, ni AS end_i, event_type AS start_event, ne AS end_event, us AS start_us, nus AS end_us FROM l WHERE a AND NOT na)"""
)


def _cut(spark, sf):
    return segments.trial_segments(events(spark, sf), "user_id", ORDER, "event_type", START, END, "us").withColumnsRenamed({"start_time": "start_us", "end_time": "end_us"})


@query(f"WITH {CUT} SELECT * FROM cut")
def trial_segments(spark, sf):
    return _cut(spark, sf)


@query(f"""WITH {S_SQL}, n AS (SELECT *, first_value(CASE WHEN event_type IN ('purchase', 'click') THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM s)
SELECT user_id, min(i) AS start_i, e AS end_i FROM n WHERE event_type IN ('view', 'click') AND e IS NOT NULL GROUP BY user_id, e""")
def trial_segments_repeating(spark, sf):
    return segments.trial_segments(events(spark, sf), "user_id", ORDER, "event_type", ["view", "click"], ["purchase", "click"], repeating=True).select("user_id", "start_i", "end_i")


@query(f"""WITH {CUT} SELECT cut.user_id, start_i, end_i, string_agg(s.event_type, ',' ORDER BY s.i) AS contents, CAST(sum(s.us - start_us) AS BIGINT) AS offsets
FROM cut JOIN s ON s.user_id = cut.user_id AND s.i BETWEEN start_i AND end_i GROUP BY ALL""")
def segment_contents(spark, sf):
    got = segments.segment_contents(events(spark, sf), _cut(spark, sf), "user_id", ORDER, "event_type", "us")
    return got.select("user_id", "start_i", "end_i", F.concat_ws(",", "events").alias("contents"), F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t - F.col("start_us")).alias("offsets"))


@query(f"""WITH {CUT}, c AS (SELECT cut.*, min(CASE WHEN s.event_type = 'click' THEN s.us END) AS click_us, min(CASE WHEN s.event_type = 'purchase' THEN s.us END) AS reward_us, count(*) AS n_events
FROM cut JOIN s ON s.user_id = cut.user_id AND s.i BETWEEN start_i AND end_i GROUP BY ALL)
SELECT user_id, start_i, end_i, n_events, start_us AS trial_start_time, end_us AS trial_end_time, end_event = 'purchase' AS reward, end_event = 'error' AS penalty, click_us, reward_us, click_us IS NOT NULL AS clicked,
  CAST(CASE WHEN lag(end_us) OVER w < start_us THEN lag(end_us) OVER w ELSE 0 END AS DOUBLE) AS prev_trial_end_time
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY start_i)""")
def tabulate_trials(spark, sf):
    t = tabulate.tabulate(events(spark, sf), "user_id", ORDER, "event_type", "us", LAYOUT)
    return t.select("user_id", "start_i", "end_i", F.size("events").cast("long").alias("n_events"), "trial_start_time", "trial_end_time", "reward", "penalty", "click_us", "reward_us", "clicked", F.col("prev_trial_end_time").cast("double").alias("prev_trial_end_time"))


@query(f"""WITH {S_SQL} SELECT user_id, i, concat_ws(',', event_type, coalesce(lead(event_type, 1) OVER w, '-'), coalesce(lead(event_type, 2) OVER w, '-'), coalesce(lead(event_type, 3) OVER w, '-')) AS codes
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i) QUALIFY event_type = 'signup'""")
def trial_separate(spark, sf):
    got = segments.trial_separate(events(spark, sf), "user_id", ORDER, "event_type", "us", ["signup"], 4, pad="-")
    return got.select("user_id", "i", F.concat_ws(",", "events").alias("codes"))


@query(f"""WITH {CUT}, c AS (SELECT cut.user_id, start_i, s.us, s.i, min(CASE WHEN s.event_type IN ('purchase', 'error') THEN s.us END) OVER (PARTITION BY cut.user_id, start_i) AS t0
FROM cut JOIN s ON s.user_id = cut.user_id AND s.i BETWEEN start_i AND end_i WHERE end_event = 'purchase')
SELECT user_id, start_i, CAST(sum(us - t0) AS BIGINT) AS total, count(*) AS n FROM c GROUP BY ALL""")
def trial_align_events(spark, sf):
    got = segments.segment_contents(events(spark, sf), _cut(spark, sf).where("end_event = 'purchase'"), "user_id", ORDER, "event_type", "us")
    got = segments.trial_align_events(got, "purchase")
    return got.select("user_id", "start_i", F.aggregate("aligned", F.lit(0.0), lambda a, t: a + t).cast("long").alias("total"), F.size("aligned").cast("long").alias("n"))


@query(f"""WITH {E_SQL}, t AS (SELECT event_id AS trigger_id, user_id, us AS t FROM e WHERE event_type = 'purchase')
SELECT trigger_id, e.user_id, event_id, us - t AS aligned FROM t JOIN e ON t.user_id = e.user_id AND us > t - {HOUR} * 6 AND us <= t + {DAY}""")
def trial_align_times(spark, sf):
    e = events(spark, sf)
    t = e.where("event_type = 'purchase'").select(F.col("event_id").alias("trigger_id"), "user_id", F.col("us").alias("t"))
    return segments.trial_align_times(e.select("event_id", "user_id", "us"), t, "user_id", "us", "t", HOUR * 6, DAY).select("trigger_id", "user_id", "event_id", F.col("aligned").cast("long").alias("aligned"))


@query(f"""WITH {S_SQL}, z AS (SELECT user_id, max(i) + 1 AS n FROM s GROUP BY 1), t AS (SELECT s.user_id, i AS t, i < n - 3 AS ok FROM s JOIN z ON s.user_id = z.user_id WHERE event_type = 'purchase'),
g AS (SELECT user_id, t, k, CASE WHEN ok THEN t - 2 + k END AS i FROM t, generate_series(0, 4) AS q(k))
SELECT g.user_id, g.t, g.k, s.value FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.i = g.i""")
def trial_align_data(spark, sf):
    s = samples(spark, sf)
    t = s.where("event_type = 'purchase'").select("user_id", F.col("i").alias("t"))
    return segments.trial_align_data(s, t, "user_id", "t", "value", 2, 3, 1).select("user_id", "t", F.col("k").cast("long").alias("k"), "value")


@query(f"""WITH {CUT} SELECT cut.user_id, start_i, round(avg(value), 6) AS mean_value, count(*) AS n FROM cut JOIN s ON s.user_id = cut.user_id AND s.i >= start_i AND s.i < end_i GROUP BY ALL""")
def data_segments(spark, sf):
    got = segments.data_segments(samples(spark, sf).select("user_id", "i", "value"), _cut(spark, sf).select("user_id", "start_i", "end_i"), "user_id", "start_i", "end_i", 1.0)
    return got.groupBy("user_id", "start_i").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem), r AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus, l_tax) - 1 AS condition FROM (SELECT l_returnflag, l_linestatus, round(l_tax, 6) AS l_tax FROM c))
SELECT r.condition, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem l JOIN r ON l.l_returnflag = r.l_returnflag AND l.l_linestatus = r.l_linestatus AND round(l.l_tax, 6) = r.l_tax GROUP BY 1""")
def unique_conditions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_quantity")
    got = segments.unique_conditions(li, ["l_returnflag", "l_linestatus", "l_tax"])
    return got.groupBy(F.col("condition").cast("long").alias("condition")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


@query(f"""WITH {CUT} SELECT c.code, cut.user_id, start_i FROM cut, (VALUES ('click'), ('signup')) AS c(code) WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = cut.user_id AND s.i BETWEEN start_i AND end_i AND s.event_type = c.code)""")
def locate_trials_with_event(spark, sf):
    got = segments.segment_contents(events(spark, sf), _cut(spark, sf), "user_id", ORDER, "event_type", "us")
    return segments.locate_trials_with_event(got, ["click", "signup"]).select("code", "user_id", "start_i")


@query(f"""WITH {E_SQL}, f AS (SELECT DISTINCT user_id, CAST(round_even(us / {HOUR}.0, 0) AS BIGINT) AS frame, event_type FROM e)
SELECT user_id, frame, max(CAST(event_type = 'click' AS INTEGER)) AS click, max(CAST(event_type = 'view' AS INTEGER)) AS view FROM f GROUP BY ALL""")
def sample_events(spark, sf):
    f = segments.sample_events(events(spark, sf), "user_id", "us", "event_type", 1 / HOUR)
    return segments.onehot(f, "user_id", "frame", "event_type", ["click", "view"])


@query(f"WITH {CUT} SELECT user_id, round(avg(CAST(end_event = 'purchase' AS DOUBLE)), 9) AS success_percent FROM cut GROUP BY 1")
def success_percent(spark, sf):
    return behavior.success_percent(_cut(spark, sf).withColumn("ok", F.col("end_event") == "purchase"), "user_id", "ok").withColumn("success_percent", F.round("success_percent", 9))


@query(f"WITH {CUT} SELECT user_id, round(sum(CAST(end_event = 'purchase' AS DOUBLE)) / sum((end_us - start_us) / {HOUR}.0), 9) AS success_rate FROM cut GROUP BY 1")
def success_rate(spark, sf):
    c = _cut(spark, sf).withColumns({"ok": F.col("end_event") == "purchase", "hours": (F.col("end_us") - F.col("start_us")) / HOUR})
    return behavior.success_rate(c, "user_id", "ok", "hours").withColumn("success_rate", F.round("success_rate", 9))


ROLL = """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_i) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, CAST(end_event = 'purchase' AS DOUBLE) AS ok FROM cut),
w AS (SELECT *, avg(ok) OVER (PARTITION BY user_id ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, avg(ok) OVER (PARTITION BY user_id) AS whole FROM r)
SELECT a.user_id, a.start_i, round(CASE WHEN a.n < 5 THEN a.whole ELSE b.m END, 9) AS rolling_success FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.j = greatest(2, least(a.j, a.n - 3))"""


@query(f"WITH {CUT}{ROLL}")
def success_rolling(spark, sf):
    c = _cut(spark, sf).withColumn("ok", F.col("end_event") == "purchase")
    return behavior.rolling_success(c, "user_id", "start_i", "ok", 5).select("user_id", "start_i", F.round("rolling_success", 9).alias("rolling_success"))


@query(f"""WITH {E_SQL} SELECT a.event_id, a.user_id, (SELECT b.us FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND abs(b.us - a.us) <= {DAY} ORDER BY abs(b.us - a.us), b.us LIMIT 1) AS match_time
FROM e a WHERE a.event_type = 'purchase'""")
def nearest_click(spark, sf):
    e = events(spark, sf)
    return temporal.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), e.where("event_type = 'click'").select("user_id", "us"), "user_id", "us", "us", DAY).select("event_id", "user_id", "match_time")


@query(f"""WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type <> 'purchase')
SELECT p.event_id, p.user_id, c.event_type AS before, c.us AS match_time FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us""")
def asof_event(spark, sf):
    e = events(spark, sf)
    got = temporal.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), e.where("event_type <> 'purchase'").select("user_id", "us", F.col("event_type").alias("before")), "user_id", "us", "us", ["before"])
    return got.select("event_id", "user_id", "before", "match_time")


@query(f"""WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT * FROM e WHERE event_type = 'error')
SELECT p.event_id, c.us AS match_time, c.value AS next_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us <= c.us""")
def asof_forward(spark, sf):
    e = events(spark, sf)
    got = temporal.asof(e.where("event_type = 'view'").select("event_id", "user_id", "us"), e.where("event_type = 'error'").select("user_id", "us", F.col("value").alias("next_value")), "user_id", "us", "us", ["next_value"], "forward")
    return got.select("event_id", "match_time", "next_value")


HOLES = "CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END"


@query(f"""WITH {S_SQL}, h AS (SELECT user_id, i, {HOLES} AS x FROM s)
SELECT user_id, i, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM h""")
def fill_missing(spark, sf):
    return temporal.fill_missing(samples(spark, sf).withColumn("x", F.expr(HOLES)), "user_id", "i", "x").select("user_id", "i", "filled")


@query(f"""WITH {S_SQL}, h AS (SELECT user_id, i, {HOLES} AS x FROM s),
n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(x IGNORE NULLS) OVER a AS x0, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(x IGNORE NULLS) OVER b AS x1 FROM h
  WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, i, round(coalesce(x, x0 + (x1 - x0) * (i - i0) / (i1 - i0), x0, x1), 6) AS filled FROM n""")
def interp_nans(spark, sf):
    got = temporal.interp_nulls(samples(spark, sf).withColumn("x", F.expr(HOLES)), "user_id", "i", "x")
    return got.select("user_id", "i", F.round("filled", 6).alias("filled"))


@query(f"""WITH {S_SQL}, k AS (SELECT user_id, us AS t, value AS v FROM s), ends AS (SELECT user_id, min(t) AS a, max(t) AS b FROM k GROUP BY 1),
g AS (SELECT user_id, n, a + n * {DAY} AS t FROM (SELECT *, unnest(generate_series(0, CAST(ceil((b - a) / {DAY}.0) AS BIGINT))) AS n FROM ends)),
lo AS (SELECT g.*, k.t AS t0, k.v AS v0 FROM g ASOF LEFT JOIN k ON g.user_id = k.user_id AND g.t >= k.t),
hi AS (SELECT lo.*, k.t AS t1, k.v AS v1 FROM lo ASOF LEFT JOIN k ON lo.user_id = k.user_id AND lo.t <= k.t)
SELECT user_id, n, round(CASE WHEN t0 = t1 THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE coalesce(v0, v1) END, 5) AS value FROM hi""")
def interp_grid(spark, sf):
    got = temporal.sample_grid(samples(spark, sf).select("user_id", F.col("us").cast("double").alias("t"), "value"), "user_id", "t", "value", 1 / DAY, from_zero=False)
    return got.select("user_id", "n", F.round("value", 5).alias("value"))


@query(f"""WITH {S_SQL}, z AS (SELECT user_id, CAST(ceil((max(i) + 1) / 4.0) * 4 AS BIGINT) AS n FROM s GROUP BY 1)
SELECT s.user_id, (i + 2) // 4 AS i, round(avg(value), 6) AS value FROM s JOIN z ON s.user_id = z.user_id WHERE i < n - 2 GROUP BY s.user_id, (i + 2) // 4""")
def downsample_value(spark, sf):
    return temporal.downsample(samples(spark, sf).select("user_id", "i", "value"), "user_id", "value", 4, 1).withColumn("value", F.round("value", 6))


@query(f"""WITH {E_SQL}, b AS (SELECT user_id, least(CAST(floor(value / 5.0) AS INTEGER), 19) AS bin FROM e WHERE value >= 0 AND value <= 100), n AS (SELECT user_id, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT user_id, CAST(bin AS INTEGER) AS bin FROM (SELECT DISTINCT user_id FROM e), generate_series(0, 19) AS q(bin))
SELECT g.user_id, g.bin, CAST((g.bin + 0.5) * 5.0 AS DOUBLE) AS center, coalesce(n.n, 0) AS n, coalesce(n.n, 0) / 5.0 AS rate FROM g LEFT JOIN n ON g.user_id = n.user_id AND g.bin = n.bin""")
def bin_events(spark, sf):
    return temporal.bin_counts(events(spark, sf), "user_id", "value", 0.0, 100.0, 5.0).select("user_id", "bin", F.col("center").cast("double").alias("center"), "n", "rate")


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m, avg(value) OVER (PARTITION BY user_id) AS whole FROM s)
SELECT a.user_id, a.i, round(CASE WHEN a.n < 7 THEN a.whole ELSE b.m END, 6) AS rolled FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.i = greatest(3, least(a.i, a.n - 4))""")
def rolling_average(spark, sf):
    return temporal.rolling_mean(samples(spark, sf), "user_id", "i", "value", 7).select("user_id", "i", F.round("rolled", 6).alias("rolled"))


@query(f"""WITH {S_SQL}, w AS (SELECT user_id, i, value AS y, lag(value) OVER p AS y1, lag(value, 2) OVER p AS y2, lead(value) OVER p AS z1, lead(value, 2) OVER p AS z2 FROM s WINDOW p AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(CASE WHEN y1 IS NULL THEN (-3 * y + 4 * z1 - z2) / 2 WHEN z1 IS NULL THEN (3 * y - 4 * y1 + y2) / 2 ELSE (z1 - y1) / 2 END, 6) AS derivative FROM w""")
def derivative(spark, sf):
    return temporal.derivative(samples(spark, sf), "user_id", "i", "value").select("user_id", "i", F.round("derivative", 6).alias("derivative"))


@query(f"""WITH {S_SQL}, c AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS p FROM s)
SELECT event_id, CASE WHEN abs(p - value) <= 10 THEN value ELSE p END AS corrected, coalesce(abs(p - value) > 10, true) AS replaced FROM c""")
def validate_measurements(spark, sf):
    from pyspark.sql import Window

    s = samples(spark, sf).withColumn("expected", F.lag("value").over(Window.partitionBy("user_id").orderBy("i")))
    return temporal.validate(s, "expected", "value", 10.0).select("event_id", "corrected", "replaced")


ISLANDS = S_SQL + ", c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS f FROM s), g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS run FROM c)"


@query(f"WITH {ISLANDS} SELECT user_id, run, min(i) AS start, count(*) AS n, min(event_type) AS value FROM g GROUP BY user_id, run")
def run_lengths(spark, sf):
    return runs.runs(events(spark, sf), "user_id", ORDER, "event_type")


@query(f"WITH {ISLANDS}, r AS (SELECT user_id, run, count(*) AS n, min(event_type) AS v FROM g GROUP BY ALL) SELECT user_id, coalesce(max(CASE WHEN v = 'view' THEN n END), 0) AS longest FROM r GROUP BY 1")
def longest_run(spark, sf):
    return runs.longest_run(events(spark, sf), "user_id", ORDER, F.col("event_type") == "view")


@query(f"WITH {ISLANDS} SELECT user_id, i, event_type = 'view' AND count(*) OVER (PARTITION BY user_id, run) > 2 AS flag FROM g")
def noisy_runs(spark, sf):
    return runs.long_runs(samples(spark, sf), "user_id", "i", F.col("event_type") == "view", 2).select("user_id", "i", "flag")


@query(f"""WITH {ISLANDS}, x AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY i) AS nx FROM g)
SELECT user_id, run, min(event_type) AS category, count(*) + count(arg_max(nx, i)) AS n FROM (SELECT user_id, run, event_type, i, nx FROM x) GROUP BY user_id, run""".replace("count(*) + count(arg_max(nx, i))", "count(*) + CASE WHEN arg_max(coalesce(nx, -1e9), i) > -1e9 THEN 1 ELSE 0 END"))
def segment_runs(spark, sf):
    got = runs.segment_array(events(spark, sf), "user_id", ORDER, "value", "event_type", True)
    return got.select("user_id", "run", "category", F.size("values").cast("long").alias("n"))


EDGES = S_SQL + """, b AS (SELECT user_id, i, CASE WHEN value > 20 THEN 1 ELSE 0 END AS x, lag(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS p FROM s),
edge AS (SELECT user_id, i, x, x > p AS rising FROM b WHERE x <> p)"""


@query(f"WITH {EDGES} SELECT user_id, i, i / 100.0 AS time, CAST(x AS BIGINT) AS value, rising FROM edge")
def detect_edges(spark, sf):
    s = samples(spark, sf).withColumn("word", F.when(F.col("value") > 20, 1).otherwise(0))
    return runs.detect_edges(s, "user_id", "i", "word", 100.0)


@query(f"""WITH {EDGES}, q AS (SELECT user_id, i / 100.0 AS "on", lead(i) OVER w / 100.0 AS off, rising FROM edge WINDOW w AS (PARTITION BY user_id ORDER BY i)),
o AS (SELECT *, row_number() OVER w AS k, lead("on") OVER w - "on" AS period FROM q WHERE rising AND off IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY "on"))
SELECT o.user_id, round(o."on", 6) AS "on", round(o.off, 6) AS off, round((o.off - o."on") / f.period, 6) AS duty FROM o JOIN (SELECT user_id, period FROM o WHERE k = 1) f ON o.user_id = f.user_id""")
def pulse_duty_cycles(spark, sf):
    s = samples(spark, sf).withColumn("word", F.when(F.col("value") > 20, 1).otherwise(0))
    got = runs.duty_cycles(runs.pulses(runs.detect_edges(s, "user_id", "i", "word", 100.0), "user_id"), "user_id")
    return got.select("user_id", F.round("on", 6).alias("on"), F.round("off", 6).alias("off"), F.round("duty", 6).alias("duty"))


@query(f"""WITH {E_SQL} SELECT event_id, ((user_id >> 1) & 1) | (((user_id >> 3) & 1) << 1) | (((user_id >> 4) & 1) << 2) | (((user_id >> 6) & 1) << 3) AS packed FROM e""")
def extract_bits(spark, sf):
    return events(spark, sf).select("event_id", bits.extract_bits("user_id", bits.mask_of([1, 3, 4, 6])).alias("packed"))


@query("SELECT event_id, user_id AS word FROM events")
def bits_round_trip(spark, sf):
    return events(spark, sf).select("event_id", bits.channels_to_word(bits.word_to_channels(F.col("user_id"))).alias("word"))


@query(f"""WITH {S_SQL}, x AS (SELECT user_id, i, value > 60 AS b, coalesce(lag(value > 60) OVER (PARTITION BY user_id ORDER BY i), false) AS p FROM s)
SELECT user_id, i, max(CAST(b AND NOT p AS INTEGER)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 OR b AS extended FROM x""")
def copy_edges_forwards(spark, sf):
    s = samples(spark, sf).withColumn("b", F.col("value") > 60)
    return runs.copy_edges_forwards(s, "user_id", "i", "b", 3).select("user_id", "i", "extended")


@query(f"WITH {S_SQL} SELECT user_id, coalesce(min(CASE WHEN value > 80 THEN i END), -1) AS first FROM s GROUP BY 1")
def first_nonzero(spark, sf):
    return runs.first_nonzero(samples(spark, sf).withColumn("big", (F.col("value") > 80).cast("int")), "user_id", "i", "big")


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS INTEGER) AS grp FROM d)
SELECT o_custkey, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM g GROUP BY o_custkey, grp HAVING count(*) >= 2""")
def consecutive_days(spark, sf):
    return runs.consecutive_days(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query(f"WITH {E_SQL} SELECT user_id, round(avg(value) + 3.0 * stddev_pop(value), 6) AS threshold FROM e GROUP BY 1")
def spike_threshold(spark, sf):
    return spikes.threshold(events(spark, sf), "user_id", "value").withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {S_SQL}, t AS (SELECT user_id, avg(value) + stddev_pop(value) AS threshold FROM s GROUP BY 1), b AS (SELECT s.user_id, i, value > threshold AS b, lag(value > threshold) OVER (PARTITION BY s.user_id ORDER BY i) AS p FROM s JOIN t ON s.user_id = t.user_id)
SELECT user_id, i, i / 25000.0 AS t FROM b WHERE b AND NOT p""")
def detect_spikes(spark, sf):
    s = samples(spark, sf)
    return spikes.detect(s, spikes.threshold(s, "user_id", "value", multiplier=1.0), "user_id", "i", "value", 25000.0)


@query(f"""WITH {E_SQL}, d AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM e) SELECT event_id, user_id, us FROM d WHERE dt IS NULL OR dt > {HOUR} * 3""")
def refractory_fast(spark, sf):
    return spikes.refractory_fast(events(spark, sf).select("event_id", "user_id", "us"), "user_id", "us", HOUR * 3)


@query(f"""WITH RECURSIVE {E_SQL}, k AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1 UNION ALL SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us > k.us + {HOUR} * 3) AS us FROM k WHERE k.us IS NOT NULL)
SELECT user_id, us FROM k WHERE us IS NOT NULL""")
def refractory_kept(spark, sf):
    return spikes.refractory(events(spark, sf), "user_id", "us", HOUR * 3)


@query(f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM e)
SELECT user_id, CAST(floor(dt / ({HOUR} * 1.0)) AS INTEGER) AS bin, count(*) AS n, (CAST(floor(dt / ({HOUR} * 1.0)) AS INTEGER) + 0.5::DOUBLE) * {HOUR} AS center FROM d WHERE dt >= 0 AND dt < {DAY} GROUP BY ALL""")
def isi_hist(spark, sf):
    return spikes.isi_histogram(events(spark, sf), "user_id", "us", HOUR, DAY).withColumn("center", F.col("center").cast("double"))


@query(f"""WITH {E_SQL}, c AS (SELECT event_type, user_id, CAST(us // {DAY} AS BIGINT) AS day, count(*) FILTER (WHERE value > 30) AS n FROM e GROUP BY ALL), t AS (SELECT event_type, user_id, CAST(max(n) > 0 AS DOUBLE) AS s FROM c GROUP BY ALL)
SELECT event_type, round(avg(s), 9) AS ratio, avg(s) >= 0.9 AS present FROM t GROUP BY 1""")
def presence_ratio(spark, sf):
    c = events(spark, sf).groupBy("event_type", "user_id").agg(F.sum((F.col("value") > 30).cast("int")).alias("n"))
    return spikes.presence_ratio(c, "event_type", "user_id", "n").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH {E_SQL}, d AS (SELECT user_id, CAST(coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {HOUR}, false) AS INTEGER) AS v FROM e)
SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS violations, round(100.0 * sum(v) / count(*), 6) AS violation_percent, 100.0 * sum(v) / count(*) <= 10.0 AS good FROM d GROUP BY 1""")
def refractory_violations(spark, sf):
    return spikes.refractory_violations(events(spark, sf), "user_id", "us", HOUR, 10.0).withColumn("violation_percent", F.round("violation_percent", 6))


@query(f"""WITH {E_SQL}, c AS (SELECT event_type, user_id, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, round(avg(n), 6) AS mean, round(var_pop(n), 6) AS variance FROM c GROUP BY 1""")
def unit_mean_variance(spark, sf):
    c = events(spark, sf).withColumn("n", F.lit(1))
    return spikes.mean_variance(c, "event_type", "user_id", "n").select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"""WITH {S_SQL} SELECT user_id, CAST(i // 5 AS BIGINT) AS bin, round(sum(value) / 0.05, 5) AS rate FROM s GROUP BY ALL""")
def bin_spikes(spark, sf):
    return spikes.bin_spikes(samples(spark, sf), "user_id", "i", "value", 100.0, 0.05).withColumn("rate", F.round("rate", 5))


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), 7) AS missing FROM events""")
def json_param_default(spark, sf):
    return events(spark, sf).select("event_id", catalog.json_param("props", "k", -1, "bigint").alias("k"), catalog.json_param("props", "missing", 7, "bigint").alias("missing"))


@query("""SELECT event_id, CAST(event_type = 'view' AS INTEGER) AS "view", CAST(event_type = 'click' AS INTEGER) AS click, CAST(event_type = 'error' AS INTEGER) AS error FROM events""")
def onehot_sequence(spark, sf):
    return catalog.onehot(events(spark, sf).select("event_id", "event_type"), "event_type", ["view", "click", "error"]).drop("event_type")


@query("""SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY o_custkey""")
def group_entries(spark, sf):
    g = catalog.group_entries(table(spark, sf, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "o_orderkey")
    return g.select("o_custkey", F.col("n").cast("long").alias("n"), F.element_at("entries", 1)["o_orderkey"].alias("first_key"), F.element_at("entries", -1)["o_orderkey"].alias("last_key"))


@query("""SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice) / 60, 1) AS minutes, count(*) AS trials, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS rewards FROM orders GROUP BY ALL""")
def summarize_entries(spark, sf):
    o = table(spark, sf, "orders").withColumns({"one": F.lit(1), "big": (F.col("o_totalprice") > 100000).cast("int")})
    return catalog.summarize(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "one", "big")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT *, min(CASE WHEN b THEN i END) OVER (PARTITION BY o_custkey) AS ib FROM o), g AS (SELECT *, min(CASE WHEN NOT b AND i > ib THEN i END) OVER (PARTITION BY o_custkey) AS ic FROM f)
SELECT o_orderkey, CASE WHEN ib > 1 AND ic IS NOT NULL THEN CASE WHEN i < ib THEN 'a' WHEN i < ic THEN 'b' ELSE 'aprime' END END AS label FROM g""")
def aba_labels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").rlike("^[12]").alias("b"))
    return catalog.aba_labels(o, "o_custkey", "o_orderkey", "b").select("o_orderkey", "label")


@query("SELECT c.c_custkey, n.n_name, coalesce(c.c_acctbal, 0) AS balance FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY')")
def lookup_sessions(spark, sf):
    c = catalog.lookup(table(spark, sf, "customer"), id_col="c_custkey", c_mktsegment=["BUILDING", "MACHINERY"])
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return catalog.update_metadata(c.withColumn("n_name", F.lit(None).cast("string")), n, "c_nationkey", ["n_name"]).select("c_custkey", "n_name", F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@query(f"WITH {CUT} SELECT user_id, CAST(sum(end_us - start_us) AS BIGINT) AS duration, count(*) AS n FROM cut GROUP BY 1")
def segment_duration(spark, sf):
    d = behavior.segment_duration(events(spark, sf), "user_id", ORDER, "event_type", "us", START, END)
    return d.groupBy("user_id").agg(F.sum("duration").alias("duration"), F.count("*").alias("n"))
