"""Maps over electrodes: alignment, correlation, local correlation, bad channels by spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions import dsp
from trialspark.operators.segments import _keys
from trialspark.workers import reachable


def _grid(pdf: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[pdf["row"].to_numpy(int), pdf["column"].to_numpy(int)] = pdf["value"].to_numpy(float)
    return out


def local_correlation(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Cosine of the two maps within a square around each cell (holes and outside as 0); NaN at holes of ``a`` and empty squares."""
    x, y = np.nan_to_num(a), np.nan_to_num(b)
    half = size // 2

    def box(m: np.ndarray) -> np.ndarray:
        s = np.pad(np.pad(m, half).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]

    d = np.sqrt(np.maximum(box(x * x), 0) * np.maximum(box(y * y), 0))
    out = np.where(d > 1e-300, box(x * y) / np.where(d > 1e-300, d, 1), np.nan)
    out[np.isnan(a)] = np.nan
    return out


def map_correlation(left: DataFrame, right: DataFrame, key, shape: tuple[int, int], size: int = 15, align: bool = False) -> DataFrame:
    """``(key, row, column, correlation, shift_row, shift_column)`` of pairs of maps ``(key, row, column, value)``; a task per pair."""
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {k: pdf[k].iloc[0] for k in keys}
        x, y = _grid(pdf[pdf["__left"]], shape), _grid(pdf[~pdf["__left"]], shape)
        y, shift = dsp.phase_aligned_shift(x, y) if align else (y, (0, 0))
        c = local_correlation(x, y, size)
        r, k = np.indices(shape)
        return pd.DataFrame({**names, "row": r.ravel(), "column": k.ravel(), "correlation": c.ravel(), "shift_row": shift[0], "shift_column": shift[1]})

    schema = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys) + ", row int, column int, correlation double, shift_row int, shift_column int"
    cols = [*keys, "row", "column", "value"]
    both = left.select(*cols, F.lit(True).alias("__left")).unionByName(right.select(*cols, F.lit(False).alias("__left")))
    return reachable(both).groupBy(*keys).applyInPandas(run, schema)


def bad_channels(samples: DataFrame, key, channel: str, order: str, value: str, fs: float, factor: float = 3.0, low: float = 100.0, seconds: float = 8.0, overlap: float = 4.0, bandwidth: float = 0.5) -> DataFrame:
    """``(key, channel, variance, bad)``: variance over frequencies of the mean low spectrum, normalised over the key's channels; bad if under their mean over ``factor``."""
    from trialspark.operators.signal import spectrogram

    keys = _keys(key)
    if overlap >= seconds:
        raise ValueError("the window is longer than the overlap")
    s = spectrogram(samples, [*keys, channel], order, value, fs, seconds, seconds - overlap, bandwidth, low)
    psd = s.groupBy(*keys, channel, "f").agg(F.avg("power").alias("p"))
    var = psd.groupBy(*keys, channel).agg(F.var_pop("p").alias("variance"))
    whole = var.groupBy(*keys).agg(F.sqrt(F.sum(F.col("variance") ** 2)).alias("__n"), F.avg("variance").alias("__m"))
    return var.join(whole, keys).withColumn("bad", F.col("variance") < F.col("__m") / factor).withColumn("variance", F.try_divide(F.col("variance"), F.col("__n"))).select(*keys, channel, "variance", "bad")


def noisy_windows(samples: DataFrame, key, channel: str, order: str, value: str, fs: float, low: float = 100.0, seconds: float = 8.0, overlap: float = 4.0, bandwidth: float = 0.5, sd: float = 3.0) -> DataFrame:
    """``(key, t, noisy)``: windows in which any channel's power above ``low`` is more than sd deviations over its mean."""
    from trialspark.operators.signal import spectrogram

    keys = _keys(key)
    s = spectrogram(samples, [*keys, channel], order, value, fs, seconds, seconds - overlap, bandwidth).where(F.col("f") > low)
    each = s.groupBy(*keys, channel, "t").agg(F.avg("power").alias("p"))
    base = each.groupBy(*keys, channel).agg(F.avg("p").alias("__m"), F.stddev_pop("p").alias("__s"))
    return each.join(base, [*keys, channel]).groupBy(*keys, "t").agg(F.max(F.col("p") > F.col("__m") + sd * F.col("__s")).alias("noisy"))
