"""Results beyond sizes at which an operator changes its way."""

import math
import random

import numpy as np
import pytest

from trialspark.functions import dsp
from pyspark.sql import functions as F

from trialspark.operators import figures, quality, segments, signal, spikes, stats, trialdata


def most_read(spark, df):
    """``df``'s rows and the most records that a stage of it read from shuffles."""
    sc = spark.sparkContext
    store, none, doubles = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {(x := got.apply(i)).stageId(): x.shuffleReadRecords() for got in [store.stageList(none, False, False, doubles, none)] for i in range(got.size())}
    old = stages()
    rows = df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, max(n for i, n in stages().items() if i not in old)


@pytest.mark.parametrize("n", [5, 1500])
def test_codes_beyond_a_literal(spark, n):
    codes = spark.createDataFrame([(f"name{i}", 3 * i + 2) for i in range(n)], "name string, base int")
    events = spark.createDataFrame([(i,) for i in range(0, 3 * n + 5)] + [(7,), (None,)], "code int")
    got = {r.code: (r.event, r.data) for r in segments.decode_events(events, codes).collect()}
    for c in range(3 * n + 5):
        i = min((c - 2) // 3, n - 1)
        assert got[c] == ((f"name{i}", c - 3 * i - 2) if c >= 2 else (None, None))
    assert got[None] == (None, None)


@pytest.mark.parametrize("dense", [1, 40])
def test_refractory_pieces_of_any_length(spark, dense):
    r = random.Random(dense)
    rows = [(k, round(t, 3)) for k in ("a", "b") for t in np.cumsum([r.random() / dense for _ in range(600)]).tolist()] + [("c", 1.0), ("c", 1.0)]
    want = []
    for k in ("a", "b", "c"):
        last = None
        for t in sorted(t for u, t in rows if u == k):
            if last is None or t - last > 0.9:
                want.append((k, t))
                last = t
    got = spikes.refractory(spark.createDataFrame(rows, "k string, t double").repartition(5), "k", "t", 0.9)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_filter_does_not_depend_on_blocks(spark):
    r = np.random.default_rng(1)
    b, a = dsp.butterworth(None, 1.0, 1000.0, 2, "lowpass")  # poles near the circle: the halo is far longer than a block
    x = r.normal(size=9000)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    whole, cut = ({q.i: q.value for q in signal.filter_series(rows, "k", "i", "v", b, a, block=n).collect()} for n in (1 << 20, 500))
    assert whole.keys() == cut.keys() and max(abs(whole[i] - cut[i]) for i in whole) < 1e-9


def test_saturation_converges_however_long_it_takes(spark):
    values = [2.0**-k for k in range(400)]
    got = quality.saturated(spark.createDataFrame([("k", v) for v in values] + [("one", 3.0)], "k string, v double"), "k", "v", tolerance=1e-12).collect()
    thr = sum(values) / len(values)
    while True:
        high, low = [v for v in values if v > thr], [v for v in values if v <= thr]
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - thr) < 1e-12:
            break
        thr = new
    assert sorted(r.v for r in got if r.saturated and r.k == "k") == sorted(v for v in values if v > new)


def test_ranktest_against_loops(spark):
    r = random.Random(3)
    spec = [(c, float(f), 0.0, r.random() + (c == 0)) for c in range(4) for f in range(5)]
    null = [(c, s, float(f), 0.0, r.random()) for c in range(4) for s in range(30) for f in range(5)]
    got = {x.c: (x.difference, x.p) for x in trialdata.tfr_ranktest(spark.createDataFrame(spec, "c int, f double, t double, power double"), spark.createDataFrame(null, "c int, s int, f double, t double, power double"), "c", "s", (1, 4)).collect()}
    mean = lambda rows: sum(rows) / len(rows)
    p, diff = {}, {}
    for c in range(4):
        o = mean([v for a, f, _, v in spec if a == c and 1 <= f < 4])
        d = [o - mean([v for a, b, f, _, v in null if a == c and b == s and 1 <= f < 4]) for s in range(30)]
        rank = {v: i + 1 for i, v in enumerate(sorted(d, key=abs))}
        w, n = sum(rank[v] for v in d if v > 0), len(d)
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        p[c], diff[c] = 0.5 * math.erfc(z / math.sqrt(2)), mean(d)
    order = sorted(p, key=p.get)
    best = 1.0
    for i in range(3, -1, -1):
        c = order[i]
        best = min(best, p[c] * 4 / (i + 1))
        assert got[c][1] == pytest.approx(best, abs=1e-6) and got[c][0] == pytest.approx(diff[c] if best <= 0.05 else 0.0)


def test_erp_window_and_peaks(spark):
    s = spark.createDataFrame([("a", i, float(i * i % 17)) for i in range(40)], "u string, i long, v double")
    t = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 39.0)], "u string, t double")
    got = {(r.t, r.k): r.v for r in trialdata.erp(s, t, "u", "t", "v", 4, 5, 1, window=(1, 3)).collect() if r.v is not None}
    base = {x: ((x - 3) ** 2 % 17 + (x - 2) ** 2 % 17) / 2 for x in (10, 20)}
    assert got == {(float(x), k): (x - 4 + k) ** 2 % 17 - base[x] for x in (10, 20) for k in range(9)}
    peak = {r.t: (r.peak, r.at) for r in trialdata.max_erp(s, t, "u", "t", "v", 4, 5, 1, search=(0, 3), average=False, window=(1, 3)).collect()}
    for x in (10, 20):
        values = [(got[x, k], k) for k in range(4, 7)]
        assert peak[x] == max(values, key=lambda p: (abs(p[0]), -p[1]))
    with pytest.raises(ValueError):
        trialdata.erp(s, t, "u", "t", "v", 0, 5, 1)


def test_mean_peaks_that_tie_but_for_rounding(spark):
    rows, triggers = [], []
    for u in range(60):
        r = random.Random(u)
        a = [r.randrange(1, 9999) for _ in range(7)]
        late = r.sample(a, 7)  # the same responses in another order: equal means at both samples after the trigger
        cents = [x for p, q in zip(a, late) for x in (33, 33, p, q, 0)]
        rows += [(u, i, c / 100) for i, c in enumerate([*cents, 0, 0])]
        triggers += [(u, 5.0 * i + 2) for i in range(7)]
    s = spark.createDataFrame(rows, "u int, i long, v double")
    got = trialdata.max_erp(s, spark.createDataFrame(triggers, "u int, t double"), "u", "t", "v", 2, 3, 1).collect()
    assert [r.at for r in got] == [2] * 60


def test_sums_of_ranks_do_not_sort_rows(spark):
    n = 40000
    x = spark.range(n).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 1000 != 0, (F.hash("id") % 3 == 0).cast("int")).alias("y"), (F.pmod(F.hash("id"), F.lit(40)) - 20.0).alias("s"))
    rows = x.collect()
    got, read = most_read(spark, stats.auc(x, "k", "y", "s"))
    assert read < n / 10 and len(got) == 2
    for r in got:
        mine = [q for q in rows if q.k == r.k]
        places = {}
        for y in (0, 1):
            other = np.sort([q.s for q in mine if q.y != y])  # rows of no class count as others
            own = np.array([q.s for q in mine if q.y == y])
            places[y] = (np.searchsorted(other, own, "left") + np.searchsorted(other, own, "right")) / 2
        m, z = len(places[1]), len(places[0])
        assert r.auc == pytest.approx(places[1].sum() / m / z, abs=1e-12)
        assert r.variance == pytest.approx(places[1].var(ddof=1) / z**2 / m + places[0].var(ddof=1) / m**2 / z, rel=1e-12)
    got, read = most_read(spark, stats.wilcoxon(x, "k", "s"))
    assert read < n / 10
    for r in got:
        d = [q.s for q in rows if q.k == r.k and q.s]
        size = np.sort(np.abs(d))
        assert r.n == len(d) and r.w == sum((np.searchsorted(size, v, "left") + np.searchsorted(size, v, "right") + 1) / 2 for v in d if v > 0)


def test_auc_of_one_class(spark):
    x = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 2.0), ("b", 0, 2.0), (None, 1, 3.0), (None, 0, 1.0)], "k string, y int, s double")
    assert {r.k: (r.auc, r.variance) for r in stats.auc(x, "k", "y", "s").collect()} == {"a": (None, None), "b": (0.5, None), None: (1.0, None)}


def test_running_sums_over_any_values(spark):
    r = random.Random(7)
    some = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [r.gauss(0, 1) * 10.0 ** r.randrange(-12, 12) for _ in range(200)] + [1 + k * 2.0**-52 for k in range(40)] + [-(2.0**-40) - k * 2.0**-92 for k in range(40)]
    rows = [(k, v) for k in ("a", None) for v in some for _ in range(r.randrange(1, 4))]
    place = lambda v: (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v)
    got = stats.placed(spark.createDataFrame(rows, "k string, v double"), "k", "v", n=F.count("*")).collect()
    assert len(got) == len({(k, place(v)) for k, v in rows})
    for x in got:
        mine = [place(v) for k, v in rows if k == x.k]
        assert (x.n, x.n_below, x.n_of) == (mine.count(place(x.v)), sum(p < place(x.v) for p in mine), len(mine))
    for v in ("id % 90 - 40", "cast(id % 90 - 40 as decimal(20,2))", "date_add(date'2000-01-01', cast(id % 90 as int))"):
        got = stats.placed(spark.range(300).select(F.expr(v).alias("v")), [], "v", n=F.count("*")).orderBy("v").collect()
        assert [x.n_below for x in got] == [sum(y.n for y in got[:i]) for i in range(90)]


def test_boxes_do_not_sort_rows(spark):
    n = 400000  # of key 0 three quarters: its quartiles meet its values in five parts
    v = "case when id % 97 = 0 then null when id % 1009 = 0 then 1e4 - id % 5 else pmod(hash(id), 901) / 4.0 - 50 end"
    x = spark.range(n).select(F.expr("if(id % 20 = 1, null, if(id % 4 = 1, 1, 0))").alias("k"), F.expr(v).alias("v"))
    x = x.unionByName(spark.createDataFrame([(2, None), (3, 7.0), (4, 1.0), (4, 2.0)], "k int, v double"))
    got, read = most_read(spark, figures.boxes(x, "k", "v"))
    assert read < n / 10
    got = {r.k: tuple(r)[1:] for r in got}
    assert got.pop(2) == (0, None, None, None, None, None, None)
    assert got.pop(3) == (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)
    assert got.pop(4) == (2, 1.0, 1.25, 1.5, 1.75, 2.0, 0)
    assert set(got) == {0, 1}
    for k, (count, low, q1, median, q3, high, out) in got.items():
        a = np.array([r.v for r in x.where(f"k = {k} and v is not null").collect()])
        quarters = np.percentile(a, [25, 50, 75])
        r = 1.5 * (quarters[2] - quarters[0])
        inside = a[(a >= quarters[0] - r) & (a <= quarters[2] + r)]
        assert (count, low, high, out) == (len(a), inside.min(), inside.max(), len(a) - len(inside)) and out > 0
        assert (q1, median, q3) == pytest.approx(tuple(quarters))


def test_kinematic_data_filters_the_whole_recording(spark):
    s = spark.createDataFrame([("a", i, math.sin(i / 9), math.cos(i / 9)) for i in range(400)], "u string, i long, x double, y double")
    t = spark.createDataFrame([("a", 0.5, 1.5)], "u string, s double, e double")
    plain = trialdata.kinematic_data(s, t, "u", "s", "e", ["x", "y"], 100.0, norm=True).collect()
    assert sorted(r.k for r in plain) == list(range(100)) and all(abs(r.value - 1) < 1e-9 for r in plain)
    smooth = trialdata.kinematic_data(s, t, "u", "s", "e", ["x", "y"], 100.0, norm=True, low_cut=15).collect()
    assert sorted(r.k for r in smooth) == list(range(100)) and all(abs(r.value - 1) < 0.05 for r in smooth)
