"""Filters and spectra of long series tables.

A series is the samples of a key (entry and channel).  Where a kernel needs a series as an array it runs in
``applyInPandas`` by key; filters can be run by time blocks with a halo, so that one long recording is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions import dsp
from trialspark.operators.segments import _keys
from trialspark.workers import reachable


def _keyed(rows: DataFrame, keys: list[str], extra: str) -> str:
    return ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [extra])


def per_series(rows: DataFrame, key, order: str, value: str, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """``kernel`` of each series' values in order gives columns; ``schema`` is theirs."""
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pd.DataFrame(kernel(pdf[value].to_numpy(float)))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return reachable(rows).select(*keys, order, value).groupBy(*keys).applyInPandas(run, _keyed(rows, keys, schema))


def filter_series(rows: DataFrame, key, order: str, value: str, b: np.ndarray, a: np.ndarray, block: int = 1 << 16) -> DataFrame:
    """Zero-phase filter of each series, ``(key, order, value)``.

    Series longer than ``block`` samples are cut into blocks with a halo as long as the slowest pole needs to fade to
    1e-14; rows in a halo are sent to both blocks, and blocks are separate tasks. A block is no shorter than its halo.
    """
    keys = _keys(key)
    pole = float(np.max(np.abs(np.roots(a)))) if len(a) > 1 else 0.0
    halo = int(math.ceil(math.log(1e-14) / math.log(pole))) + 1 if 0 < pole < 1 else 8
    block = max(block, halo)
    n = F.floor(F.col(order) / block).cast("long")
    both = rows.select(*keys, order, value, F.explode(F.sequence(F.floor((F.col(order) - halo) / block).cast("long"), F.floor((F.col(order) + halo) / block).cast("long"))).alias("__b"))
    both = both.withColumn("__own", n == F.col("__b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        y = dsp.filtfilt(b, a, x) if len(x) > 1 else x
        own = pdf["__own"].to_numpy(bool)
        out = pdf.loc[own, [*keys, order]].copy()
        out["value"] = y[own]
        return out

    kind = rows.schema[order].dataType.simpleString()
    return reachable(both).groupBy(*keys, "__b").applyInPandas(run, _keyed(rows, keys, f"`{order}` {kind}, value double"))


def lfp(rows: DataFrame, key, order: str, value: str, fs: float, new_fs: float = 1000.0, low_cut: float = 500.0, buttord: int = 4) -> DataFrame:
    """Low-pass, then down to the new rate by block means."""
    from trialspark.operators.temporal import downsample

    b, a = dsp.butterworth(None, low_cut, fs, buttord, "lowpass")
    return downsample(filter_series(rows, key, order, value, b, a), key, "value", int(fs), int(new_fs), order)


def spike_band(rows: DataFrame, key, order: str, value: str, fs: float, low: float = 500, high: float = 7500, buttord: int = 3) -> DataFrame:
    return filter_series(rows, key, order, value, *dsp.butterworth(low, high, fs, buttord, "bandpass"))


def mt_filter(rows: DataFrame, key, order: str, value: str, band: tuple[float, float], seconds: float, fs: float) -> DataFrame:
    """Multitaper band-pass (low-pass for a band from 0): ``(key, n, value)``."""
    f0, w = (0.0, band[1]) if band[0] <= 0 else (sum(band) / 2, (band[1] - band[0]) / 2)
    _, p, k = dsp.taper_parameters(seconds, w)
    return per_series(rows, key, order, value, lambda x: {"n": np.arange(len(x)), "value": dsp.mtfilter(x, seconds, p, k, fs, f0)}, "n long, value double")


def kinematics(rows: DataFrame, key, order: str, value: str, fs: float, low_cut: float = 15, buttord: int = 4, deriv: int = 0, window_ms: float = 50, polyorder: int = 3) -> DataFrame:
    """Low-passed series or its Savitzky-Golay derivative, gaps filled linearly before and restored after."""

    def kernel(x: np.ndarray) -> dict:
        gap = np.isnan(x)
        if gap.all():
            return {"n": np.arange(len(x)), "value": x}
        t = np.arange(len(x))
        y = np.interp(t, t[~gap], x[~gap])
        y = dsp.filtfilt(*dsp.butterworth(None, low_cut, fs, buttord, "lowpass"), y)
        if deriv:
            w = int(window_ms * fs / 1000) | 1
            y = dsp.savgol(y, w, polyorder, deriv, 1 / fs)
        y[gap] = np.nan
        return {"n": t, "value": y}

    return per_series(rows, key, order, value, kernel, "n long, value double")


def gaussian_smooth(rows: DataFrame, key, order: str, value: str, sd: float, fs: float) -> DataFrame:
    return per_series(rows, key, order, value, lambda x: {"n": np.arange(len(x)), "value": dsp.gaussian_smooth(x, sd, fs)}, "n long, value double")


def fft_values(rows: DataFrame, key, order: str, value: str, fs: float) -> DataFrame:
    """``(key, f, re, im, amplitude)`` of the one-sided transform."""

    def kernel(x):
        f, v = dsp.one_sided_fft(x, fs)
        return {"f": f, "re": v.real, "im": v.imag, "amplitude": np.abs(v)}

    return per_series(rows, key, order, value, kernel, "f double, re double, im double, amplitude double")


def _grid(f, t, v) -> dict:
    return {"f": np.repeat(f, len(t)), "t": np.tile(t, len(f)), "power": np.asarray(v).reshape(len(f), -1).ravel()}


def spectrogram(rows: DataFrame, key, order: str, value: str, fs: float, seconds: float, step: float, half_bandwidth: float | None = None, f_max: float | None = None) -> DataFrame:
    """``(key, f, t, power)`` of Tukey windows, or of multitapers if a half bandwidth is given."""
    one = (lambda x: dsp.spectrogram(x, fs, seconds, step, f_max=f_max)) if half_bandwidth is None else (lambda x: dsp.multitaper_spectrogram(x, fs, seconds, half_bandwidth, step, f_max=f_max))
    return per_series(rows, key, order, value, lambda x: _grid(*one(x)), "f double, t double, power double")


def wavelet(rows: DataFrame, key, order: str, value: str, fs: float, freqs: list[float]) -> DataFrame:
    return per_series(rows, key, order, value, lambda x: _grid(np.array(freqs), np.arange(len(x)) / fs, dsp.morlet(x, freqs, fs)), "f double, t double, power double")


def psd(rows: DataFrame, key, order: str, value: str, fs: float, method: str = "multitaper", p: float = 4.0) -> DataFrame:
    def kernel(x):
        f, v = dsp.multitaper_psd(x, fs, p) if method == "multitaper" else dsp.welch_amplitude(x, fs)
        return {"f": f, "power": v}

    return per_series(rows, key, order, value, kernel, "f double, power double")


def band_power(spectra: DataFrame, key, bands: list[tuple[float, float]], log: bool = False, epsilon: float = 1e-9) -> DataFrame:
    """``(key, band, power)``: mean power of [low, high) of each band; bands may overlap."""
    hit = F.filter(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(bands)]), lambda x: (F.col("f") >= x["a"]) & (F.col("f") < x["b"]))
    got = spectra.withColumn("__h", F.explode(hit)).groupBy(*_keys(key), F.col("__h.band").alias("band")).agg(F.avg("power").alias("power"))
    return got.withColumn("power", F.log10(F.col("power") + epsilon)) if log else got


def tfr_mean(spectra: DataFrame, key, band: tuple[float, float] = (0, 1e16), window: tuple[float, float] = (-1e16, 1e16)) -> DataFrame:
    """Mean over a band and a time window, missing values left out."""
    x = spectra.where((F.col("f") >= band[0]) & (F.col("f") < band[1]) & (F.col("t") >= window[0]) & (F.col("t") < window[1]))
    return x.groupBy(*_keys(key)).agg(F.avg(F.when(~F.isnan("power"), F.col("power"))).alias("power"))


def itpc(rows: DataFrame, key, re: str, im: str) -> DataFrame:
    """Length of the mean unit phasor over trials, by key (say channel and time)."""
    m = F.sqrt(F.col(re) ** 2 + F.col(im) ** 2)
    return rows.groupBy(*_keys(key)).agg(F.sqrt(F.avg(F.col(re) / m) ** 2 + F.avg(F.col(im) / m) ** 2).alias("itpc"))


def coherence(rows: DataFrame, pairs: DataFrame, channel: str, trial: str, order: str, value: str, fs: float, seconds: float, half_bandwidth: float, step: float, imaginary: bool = False, f_max: float | None = None) -> DataFrame:
    """``(a, b, f, t, coherence, phase)`` of pairs of channels over their common trials; a task per pair."""
    a = pairs.select("a", "b").join(rows.select(F.col(channel).alias("a"), F.col(trial).alias("trial"), F.col(order).alias("n"), F.col(value).alias("x")), "a")
    both = a.join(rows.select(F.col(channel).alias("b"), F.col(trial).alias("trial"), F.col(order).alias("n"), F.col(value).alias("y")), ["b", "trial", "n"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="trial", columns="n", values="x").dropna().to_numpy()
        y = pdf.pivot(index="trial", columns="n", values="y").dropna().to_numpy()
        f, t, c, ph = dsp.coherence(x, y, fs, seconds, half_bandwidth, step, f_max=f_max, imaginary=imaginary)
        return pd.DataFrame({"a": pdf["a"].iloc[0], "b": pdf["b"].iloc[0], "f": np.repeat(f, len(t)), "t": np.tile(t, len(f)), "coherence": c.ravel(), "phase": ph.ravel()})

    kinds = {k: both.schema[k].dataType.simpleString() for k in "ab"}
    return reachable(both).groupBy("a", "b").applyInPandas(run, f"a {kinds['a']}, b {kinds['b']}, f double, t double, coherence double, phase double")


def matrix_multiply(rows: DataFrame, channels: list[str], matrix: np.ndarray, names: list[str], scale: float = 1.0) -> DataFrame:
    """Each wide sample times a fixed matrix, as column expressions inside one projection."""
    m = np.asarray(matrix) * scale
    return rows.select(*[c for c in rows.columns if c not in channels], *[sum((F.lit(float(w)) * F.col(c) for w, c in zip(line[1:], channels[1:], strict=True)), F.lit(float(line[0])) * F.col(channels[0])).alias(n) for line, n in zip(m, names, strict=True)])
