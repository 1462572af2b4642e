import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions import geometry as geo
from trialspark.operators import behavior, decode, latency, quality, runs, segments, signal, spikes, stats, stim, tabulate, temporal


def stream(spark, codes, times=None, entry="a"):
    return spark.createDataFrame([(entry, i, c, float(times[i] if times else i)) for i, c in enumerate(codes)], "entry string, i long, code int, t double")


def cut(spark, codes, start, end, repeating=False):
    got = segments.trial_segments(stream(spark, codes), "entry", "i", "code", start, end, "t", repeating)
    return sorted((r.start_i, r.end_i) for r in got.collect())


def test_segments_of_the_fixtures(spark):
    codes = [0, 2, 4, 6, 0, 2, 3, 6]
    assert cut(spark, codes, [2], [3, 4]) == [(1, 2), (5, 6)]
    assert cut(spark, codes, [2], [6]) == [(1, 3), (5, 7)]
    long = [18, 82, 19, 34, 83, 64, 239, 18, 82, 19, 34, 83, 48, 239, 19, 83, 18, 66, 239]
    assert [b - a + 1 for a, b in cut(spark, long, [18, 19], [239], True)] == [7, 7, 5]
    assert cut(spark, [2, 2, 5], [2], [9]) == []


@pytest.mark.parametrize("repeating", [False, True])
def test_segments_against_a_loop(spark, repeating):
    r = random.Random(4)
    for _ in range(6):
        codes = [r.randint(0, 5) for _ in range(60)]
        start, end = r.sample(range(6), 2), r.sample(range(6), 2)
        want, last = [], 0
        for i, c in enumerate(codes):
            if c not in start or repeating and i < last:
                continue
            for j in range(i + 1, len(codes)):
                if not repeating and codes[j] in start:
                    break
                if codes[j] in end:
                    want.append((i, j))
                    last = j
                    break
        assert cut(spark, codes, start, end, repeating) == want


def test_center_out_table(spark):
    codes = [16, 80, 18, 32, 82, 48, 239, 16, 80, 64, 239]
    rows = tabulate.tabulate(stream(spark, codes), "entry", "i", "code", "t", tabulate.CENTER_OUT).orderBy("start_i").collect()
    assert [(r.reward, r.penalty, r.target_idx, r.go_cue_time, r.reaction_window, r.prev_trial_end_time) for r in rows] == [(True, False, 2, 3.0, 1.0, 0.0), (False, True, 0, None, None, 6.0)]
    flash = tabulate.tabulate_flash(stream(spark, [16, 17, 48, 239, 16, 239]), "entry", "i", "code", "t").collect()
    assert [(r.flash_start_time, r.flash_end_time, r.next_trial_start_time) for r in flash] == [(0.0, 2.0, 4.0)]


def test_poisson_trials(spark):
    rows = tabulate.poisson_trials(spark.createDataFrame([("a", 0.0, 200.0), ("b", 5.0, 5.01)], "entry string, a double, b double"), "entry", "a", "b").collect()
    t = sorted(r.trigger for r in rows if r.entry == "a")
    gaps = np.diff(t)
    assert len(t) > 400 and gaps.min() >= 0.1 - 1e-9 and t[-1] < 200 and abs(gaps.mean() - 0.267) < 0.05


def test_nearest_and_clock_fixtures(spark):
    est = spark.createDataFrame([("a", t) for t in (0.5, 2.0, 3.8, 5.0)], "k string, t double")
    mea = spark.createDataFrame([("a", t) for t in (0.64, 2.1, 3.8, 4.9)], "k string, m double")
    got = temporal.nearest(est, mea, "k", "t", "m", 1.0, latency=0.1).orderBy("t").collect()
    assert [r.match_time for r in got] == [0.64, 2.1, 3.8, 4.9]
    tie = temporal.nearest(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, t double"), spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", 0.0)], "k string, m double"), "k", "t", "m", 0.5)
    assert {r.k: r.match_time for r in tie.collect()} == {"a": 0.5, "b": None}
    zero = temporal.nearest(spark.createDataFrame([("a", 0.1)], "k string, t double"), spark.createDataFrame([("a", 0.0)], "k string, m double"), "k", "t", "m", 0.5)
    assert zero.first().match_time == 0.0


def test_fill_and_interpolate_fixtures(spark):
    v = [0.01, 0.08, None, None, 0.25, None, 0.38, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    assert [r.filled for r in temporal.fill_missing(df, "k", "i", "v").orderBy("i").collect()] == [0.01, 0.08, 0.25, 0.25, 0.25, 0.38, 0.38, 0.38]
    knots = spark.createDataFrame([("a", t, x) for t, x in ((1.0, 100.0), (2.0, 200.0), (3.0, 100.0), (4.0, 300.0))], "k string, t double, v double")
    assert [r.value for r in temporal.sample_grid(knots, "k", "t", "v", 2.0, from_zero=False).orderBy("n").collect()] == [100, 150, 200, 150, 100, 200, 300]
    points = spark.createDataFrame([("a", 0.0), ("a", 2.5), ("a", 5.0)], "k string, p double")
    assert [r.value for r in temporal.interpolate(knots, points, "k", "t", "v", "p").orderBy("p").collect()] == [100, 150, 300]
    assert [r.value for r in temporal.interpolate(knots, points, "k", "t", "v", "p", extrapolate=True).orderBy("p").collect()] == [0, 150, 500]
    checked = temporal.validate(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "e double, m double"), "e", "m", 0.5).orderBy("e").collect()
    assert [(r.corrected, r.replaced) for r in checked] == [(1.5, False), (2.0, False), (3.0, True)]


def series(spark, x, k="a"):
    return spark.createDataFrame([(k, i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")


def test_resampling(spark):
    assert [r.rolled for r in temporal.rolling_mean(series(spark, [1, 2, 3, 4, 5]), "k", "i", "v", 3).orderBy("i").collect()] == [2, 2, 3, 4, 4]
    assert [r.rolled for r in temporal.rolling_mean(series(spark, [1, 2, 3, 4, 5]), "k", "i", "v", 3, "nan").orderBy("i").collect()] == [None, 2, 3, 4, None]
    assert {r.rolled for r in temporal.rolling_mean(series(spark, [1, 2, 3, 4, 5]), "k", "i", "v", 7).collect()} == {3}
    assert temporal.downsample(series(spark, range(100)), "k", "v", 100, 10).count() == 10
    assert temporal.downsample(series(spark, range(100)), "k", "v", 100, 13).count() == 13
    x = np.random.default_rng(0).normal(size=30)
    got = [r.derivative for r in temporal.derivative(series(spark, x), "k", "i", "v").orderBy("i").collect()]
    assert np.allclose(got, np.gradient(x, edge_order=2))


def test_runs_and_edges(spark):
    got = runs.runs(series(spark, [1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 5]), "k", "i", "v").orderBy("start").collect()
    assert [(r.start, r.n) for r in got] == [(0, 1), (1, 2), (3, 3), (6, 2), (8, 4)]
    word = spark.createDataFrame([("a", i, w) for i, w in enumerate([0, 1, 1, 0, 0, 1, 0])], "k string, i long, w long")
    edges = runs.detect_edges(word, "k", "i", "w", 10.0)
    assert [(r.i, r.rising) for r in edges.orderBy("i").collect()] == [(1, True), (3, False), (5, True), (6, False)]
    assert [(r.on, r.off) for r in runs.pulses(edges, "k").orderBy("on").collect()] == [(0.1, 0.3), (0.5, 0.6)]
    assert runs.edges_from_onsets(spark.createDataFrame([("a", 1.0)], "k string, t double"), "k", "t", 0.5).count() == 3
    digital = runs.to_digital(series(spark, [0, 1, 4, 10]), "k", "v").orderBy("i").collect()
    assert [r.digital for r in digital] == [False, False, True, True]
    assert {r.digital for r in runs.to_digital(series(spark, [2, 2]), "k", "v").collect()} == {False}


def test_barcodes(spark):
    bar, code = 0.1, 0b1011
    rows, t = [], 0.0
    for _ in range(2):
        rows.append(("a", t, t + 0.05))
        base = t + 0.05
        rows += [("a", base + a * bar, base + b * bar) for a, b in ((0, 2), (3, 4)) if a or True]
        t += 30
    rows = [(k, a + (1e-4 if i % 3 else 0), b) for i, (k, a, b) in enumerate(rows)]
    got = runs.barcodes(spark.createDataFrame(rows, 'k string, `on` double, off double'), "k", 30, bar, 8).collect()
    assert sorted((round(r.t), r.barcode) for r in got) == [(0, code), (30, code)]


def test_refractory(spark):
    r = random.Random(1)
    trains = {k: sorted(r.sample(range(2000), 150)) for k in "ab"}
    df = spark.createDataFrame([(k, t) for k, x in trains.items() for t in x], "k string, t long")
    want = []
    for k, x in trains.items():
        last = None
        for t in x:
            if last is None or t - last > 12:
                want.append((k, t))
                last = t
    assert sorted(map(tuple, spikes.refractory(df, "k", "t", 12).collect())) == want


def test_spikes_and_waveforms(spark):
    s = series(spark, [0, 0, 5, 6, 0, 0, 7, 0])
    thr = spark.createDataFrame([("a", 3.0)], "k string, threshold double")
    hits = spikes.detect(s, thr, "k", "i", "v", 10.0)
    assert [r.i for r in hits.orderBy("i").collect()] == [2, 6]
    waves = {r.i: r.waveform for r in spikes.waveforms(hits, s, "k", "i", "v", 1, 3).collect()}
    assert waves == {2: [0, 5, 6], 6: [0, 7, 0]}
    sizes = spark.createDataFrame([(0, "x", 10), (1, "y", 5)], "ord int, entry string, n int")
    split = spikes.split_entries(spark.createDataFrame([(3,), (9,), (10,), (14,)], "s long"), sizes, "s").orderBy("s").collect()
    assert [(r.entry, r.entry_sample) for r in split] == [("x", 3), ("x", 9), ("y", 0), ("y", 4)]
    amps = spark.createDataFrame([("u", float(a)) for a in np.random.default_rng(1).normal(5, 1, 500)], "u string, a double")
    assert spikes.noise_cutoff(amps, "u", "a").first().good


def test_filters(spark):
    fs = 1000.0
    t = np.arange(5000) / fs
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 200 * t)
    from trialspark.functions import dsp

    b, a = dsp.butterworth(None, 50.0, fs, 4, "lowpass")
    whole = dsp.filtfilt(b, a, x)
    assert np.abs(whole[500:-500] - np.sin(2 * np.pi * 5 * t)[500:-500]).max() < 0.01
    got = signal.filter_series(series(spark, x), "k", "i", "v", b, a, block=1000).orderBy("i").collect()
    assert np.allclose([r.value for r in got], whole, atol=1e-8)
    down = signal.lfp(series(spark, x), "k", "i", "v", fs, 100.0, 40.0).count()
    assert down == 500


def test_stats(spark):
    rng = np.random.default_rng(2)
    p = rng.random(20)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(p)], "k string, i int, p double")
    got = [r.p_adjusted for r in stats.fdr(df, "k", "p").orderBy("p").collect()]
    s = np.sort(p) * 20 / np.arange(1, 21)
    assert np.allclose(got, np.minimum(1, np.minimum.accumulate(s[::-1])[::-1]))
    blocks = stats.random_blocks(df, "k", "i", 6).groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [6, 6, 6]
    assert stats.stratified_sample(df, "k", "i", 5).count() == 5
    w = stats.wilcoxon(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "k string, d double"), "k", "d").first()
    assert w.w == 55 and abs(w.p - 0.005062) < 2e-4
    assert abs(spark.range(1).select(stats.normal_cdf(F.lit(1.959964)).alias("p")).first().p - 0.975) < 1e-6


def test_behaviour(spark):
    trials = spark.createDataFrame([("a", i, s, d) for i, (s, d) in enumerate(zip((0, 1, 1, 0), (0.5, 0.3, 0.1, 0.2), strict=True))], "k string, i int, s int, d double")
    assert abs(behavior.success_rate(trials, "k", "s", "d").first().success_rate - 2 / 1.1) < 1e-12
    twelve = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(12)], "k string, i int, s boolean")
    assert {round(r.rolling_success, 9) for r in behavior.rolling_success(twelve, "k", "i", "s", 3).collect()} == {round(1 / 3, 9)}
    pos = spark.createDataFrame([("a", i, float(x), 0.0) for i, x in enumerate([0, 0, 0, 0, 1, 2])], "k string, i int, x double, y double")
    assert [r.engaged for r in behavior.engagement(pos, "k", "i", ["x", "y"], 1.0, 2).orderBy("i").collect()] == [True, False, False, False, True, True]
    assert behavior.path_length(pos, "k", "i", ["x", "y"]).first().path_length == 2
    on = behavior.movement_onset(pos.withColumns({"a": F.lit(0), "b": F.lit(4), "c": F.lit(3)}), "k", "i", "x", "a", "b", "c").first().onset
    assert on == 4
    err = behavior.movement_error(spark.createDataFrame([(3.0, 4.0), (0.0, 5.0)], "x double, y double"), ["x", "y"], [3.0, 4.0]).orderBy("x").collect()
    assert np.allclose([r.error for r in err], [3.0, 0.0])


def test_models(spark):
    rng = np.random.default_rng(3)
    theta = np.arange(0, 360, 45)
    rates = spark.createDataFrame([("u", float(d), float(3 * np.cos(np.radians(d)) + 4 * np.sin(np.radians(d)) + 10)) for d in theta], "u string, d double, r double")
    fit = decode.tuning_fit(rates, "u", "d", "r").first()
    assert np.allclose([fit.b1, fit.b2, fit.b3, fit.depth], [3, 4, 10, 5])
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (40, 3))])
    rows = spark.createDataFrame([("e", i, int(i >= 40), [float(v) for v in r]) for i, r in enumerate(x)], "k string, i int, y int, f array<double>")
    assert decode.lda_accuracy(rows, "k", "f", "y", order="i").first().accuracy > 0.9
    latent = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6)) + 0.1 * rng.normal(size=(200, 6))
    fa = spark.createDataFrame([("e", i, [float(v) for v in r]) for i, r in enumerate(latent)], "k string, i int, f array<double>")
    score = {r.dim: r.score for r in decode.factor_dimensions(fa, "k", "f", [1, 2, 3], order="i").collect()}
    assert score[2] > score[1] + 0.5
    cols = spark.createDataFrame([tuple(map(float, r)) for r in latent], "a double, b double, c double, d double, e double, f double")
    n, shares, _ = decode.pca_dimensions(cols, list("abcdef"), 0.95)
    assert n <= 2 and abs(shares.sum() - 1) < 1e-9
    state = np.cumsum(rng.normal(size=(300, 2)), 0) * 0.1
    obs = state @ rng.normal(size=(2, 5)) + 0.05 * rng.normal(size=(300, 5))
    kf = spark.createDataFrame([("s", i, s.tolist(), o.tolist(), i < 200) for i, (s, o) in enumerate(zip(state, obs, strict=True))], "k string, i int, x array<double>, y array<double>, t boolean")
    pred = np.array([r.predicted for r in decode.kalman_states(kf, "k", "i", "x", "y", "t").orderBy("i").collect()])
    assert np.abs(pred - state[200:]).mean() < 0.1


def test_latency_pairs_and_plants(spark):
    assert latency.pair_trials([([1], [2]), ([3], [4]), ([1], [4])], 2) == [(0, 1)]
    re, im = latency.machine_dynamics("f", 2)
    r = spark.createDataFrame([(0.5,)], "f double").select(re.alias("re"), im.alias("im")).first()
    s = 2j * np.pi * 0.5
    assert np.allclose(complex(r.re, r.im), 1 / (s * (s + 1)))


def test_quality_and_stimulation(spark):
    a = stream(spark, [1, 2, 3], entry="a").unionByName(stream(spark, [1, 2], entry="b"))
    b = stream(spark, [1, 2, 3], entry="a").unionByName(stream(spark, [1, 9], entry="b"))
    assert [r.entry for r in quality.mismatched_entries(a, b, "entry", "i", "code").collect()] == ["b"]
    sat = quality.saturated(series(spark, [0.1, 0.2, 0.1, 9, 9.1]), "k", "v").orderBy("i").collect()
    assert [r.saturated for r in sat] == [False, False, False, True, True]
    gain = spark.createDataFrame([(-1.0,), (0.25,), (0.75,), (2.0,)], "g double").select(stim.calibrate_gain(F.col("g"), [(0.0, 0.0), (0.5, 0.2), (1.0, 1.0)], 10.0).alias("p")).collect()
    assert np.allclose([r.p for r in gain], [0, 1, 6, 10])
    com = spark.createDataFrame([("a", 1.0, 0.01), ("a", 5.0, 0.01)], "k string, t double, w double")
    sen = spark.createDataFrame([("a", 1.005, 1.03)], "k string, `on` double, off double")
    assert [(r.found, round(r.true_width, 6)) for r in stim.match_pulses(com, sen, "k", "t", "w").orderBy("t").collect()] == [(True, 0.025), (False, 0.01)]


def test_geometry(spark):
    for cur, new in (([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])):
        m = geo.rotation_between(cur, new)
        assert np.allclose(m @ np.array(cur) / np.linalg.norm(cur), np.array(new) / np.linalg.norm(new)) and np.allclose(m @ m.T, np.eye(len(cur)))
    row = spark.createDataFrame([([0.0, 0.0], [2.0, 2.0])], "a array<double>, b array<double>").select(geo.direction("a").alias("n"), geo.direction("b").alias("d"), geo.unit_vector("b").alias("u"), geo.lerp([0, 0], "b", 3).alias("l")).first()
    assert row.n is None and abs(row.d - np.pi / 4) < 1e-12 and np.allclose(row.u, [2**-0.5] * 2) and row.l[1] == [1.0, 1.0]


def test_preparation(spark):
    from trialspark.operators import etl

    clock = spark.createDataFrame([("a", i, i * 0.01) for i in range(200)], "k string, time long, t double")
    sync = spark.createDataFrame([("a", 5 + i * 0.01 + 0.001) for i in range(200) if i != 50], "k string, timestamp double")
    got = etl.correct_clock(clock, "k", "time", "t", sync, sync, fps=100.0, latency=0.0).orderBy("time").collect()
    assert [r.time for r in got if r.sync_missing] == [] or len(got) == 200
    tight = etl.correct_clock(clock, "k", "time", "t", sync, fps=300.0).orderBy("time").collect()
    assert [r.time for r in tight if r.sync_missing] == [50] and abs(tight[50].timestamp_sync - tight[50].timestamp_internal) < 1e-12
    assert all(r.timestamp is not None for r in etl.best_timestamps(etl.correct_clock(clock, "k", "time", "t", sync, sync, 100.0, 0.0), "k", "time").collect())
    whole, sizes = etl.concat_entries([("x", spark.range(3).withColumnRenamed("id", "i")), ("y", spark.range(2).withColumnRenamed("id", "i"))], "i")
    assert sorted(r.i for r in whole.collect()) == [0, 1, 2, 3, 4] and [(r.entry, r.n) for r in sizes.orderBy("ord").collect()] == [("x", 3), ("y", 2)]


def test_saccades_and_maps(spark):
    from trialspark.operators import eye, spatial

    fs, n = 1000.0, 2000
    t = np.arange(n) / fs
    x = 10 / (1 + np.exp(-(t - 0.5) / 0.008)) + 5 / (1 + np.exp(-(t - 1.4) / 0.008))
    got = eye.find_saccades(np.stack([x, 0 * x], 1), fs)
    assert len(got) == 2 and abs(got[0][0] - 0.49) < 0.03 and abs(got[1][0] - 1.39) < 0.03 and got[0][2] > got[1][2] > 2
    a = np.random.default_rng(0).normal(size=(9, 9))
    c = spatial.local_correlation(a, 2 * a, 5)
    assert np.allclose(c, 1)
    b = np.random.default_rng(1).normal(size=(9, 9))
    want = (a[2:7, 2:7] * b[2:7, 2:7]).sum() / np.linalg.norm(a[2:7, 2:7]) / np.linalg.norm(b[2:7, 2:7])
    assert abs(spatial.local_correlation(a, b, 5)[4, 4] - want) < 1e-12
    rng = np.random.default_rng(2)
    rows = [("e", ch, i, float(v)) for ch in range(4) for i, v in enumerate(rng.normal(size=4000) * (0.001 if ch == 3 else 1))]
    bad = spatial.bad_channels(spark.createDataFrame(rows, "k string, ch int, i int, v double"), "k", "ch", "i", "v", 500.0, seconds=2.0, overlap=1.0, bandwidth=2.0)
    assert {r.ch for r in bad.collect() if r.bad} == {3}


def test_buckets_change_nothing(spark):
    r = random.Random(9)
    left = spark.createDataFrame([(r.choice("ab"), i, r.randint(0, 500)) for i in range(150)], "k string, i int, t long")
    right = spark.createDataFrame([(r.choice("abc"), r.randint(0, 500), i) for i in range(60)], "k string, m long, v int")
    for direction in ("backward", "forward"):
        a, b = (sorted(temporal.asof(left, right, "k", "t", "m", ["v"], direction, bucket=w).collect(), key=str) for w in (None, 40))
        assert a == b
    a, b = (sorted(temporal.nearest(left, right, "k", "t", "m", 6, ["v"], latency=3, bucket=w).collect(), key=str) for w in (None, 40))
    assert a == b and any(x.match_time is not None for x in a) and any(x.match_time is None for x in a)
