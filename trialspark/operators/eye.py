"""Eye movements: speed, acceleration, saccades, closed eyes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import dsp
from trialspark.operators.segments import _keys
from trialspark.workers import reachable


def speed(points: DataFrame, key, t: str, axes: list[str], name: str = "speed") -> DataFrame:
    """Norm of the derivative of a position."""
    from trialspark.operators.temporal import derivative

    for i, a in enumerate(axes):
        points = derivative(points, key, t, a).withColumnRenamed("derivative", f"__d{i}")
    total = sum((F.col(f"__d{i}") ** 2 for i in range(1, len(axes))), F.col("__d0") ** 2)
    return points.withColumn(name, F.sqrt(total)).drop(*[f"__d{i}" for i in range(len(axes))])


def acceleration(points: DataFrame, key, t: str, axes: list[str]) -> DataFrame:
    """Derivative of the speed."""
    from trialspark.operators.temporal import derivative

    return derivative(speed(points, key, t, axes, "__s"), key, t, "__s").withColumnRenamed("derivative", "acceleration").drop("__s")


def find_saccades(pos: np.ndarray, fs: float, sd: float = 1.5, gap: float | None = None, shortest: float = 0.015, longest: float = 0.16, low_cut: float | None = 30.0, threshold: tuple[float, float] | None = None):
    """Onsets, durations and distances of one recording's saccades: acceleration over a threshold, then deceleration.

    The onset must lie a gap after the saccade before; its offset is the first within the allowed durations.
    """
    if low_cut is not None:
        pos = dsp.filtfilt(*dsp.butterworth(None, low_cut, fs, 4, "lowpass"), pos)
    v = np.linalg.norm(np.gradient(pos, 1 / fs, axis=0, edge_order=2), axis=1)
    a = np.gradient(v, 1 / fs, edge_order=2)
    hi, lo = threshold or (a.mean() + sd * a.std(), -(a.mean() + sd * a.std()))
    up = np.flatnonzero((a[1:] > hi) & ~(a[:-1] > hi)) + 1
    down = np.flatnonzero(~(a[1:] < lo) & (a[:-1] < lo)) + 1
    out, last = [], None
    for i in up:
        if gap and last is not None and i / fs < last + gap:
            continue
        j = np.searchsorted(down, i + shortest * fs - 1e-9)
        if j < len(down) and down[j] < i + longest * fs - 1e-9:
            out.append((i / fs, (down[j] - i) / fs, float(np.linalg.norm(pos[i] - pos[down[j]]))))
            last = down[j] / fs
    return out


def saccades(points: DataFrame, key, order: str, axes: list[str], fs: float, **settings) -> DataFrame:
    """``(key, onset, duration, distance)``; a task per recording (the rule is sequential)."""
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = find_saccades(pdf[axes].to_numpy(float), fs, **settings)
        out = pd.DataFrame(got, columns=["onset", "duration", "distance"], dtype=float)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys) + ", onset double, duration double, distance double"
    return reachable(points).select(*keys, order, *axes).groupBy(*keys).applyInPandas(run, schema)


def closed(samples: DataFrame, key, order: str, value: str, fs: float, factor: float = 3.0, least: float = 0.1) -> DataFrame:
    """``samples`` with ``closed``: in a run of steps within ``factor`` smallest steps that is longer than ``least`` seconds."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(order)
    x = samples.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w)))
    small = x.where("__d > 0").groupBy(*keys).agg((F.min("__d") * factor).alias("__thr"))
    x = x.join(small, keys, "left").withColumn("__new", F.coalesce(F.col("__d") > F.coalesce("__thr", F.lit(0.0)), F.lit(True)).cast("int"))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return x.withColumn("closed", n > int(fs * least)).drop("__d", "__thr", "__new", "__run")


def positions_at(saccades_: DataFrame, points: DataFrame, key, order: str, axes: list[str], fs: float) -> DataFrame:
    """Saccades with the position at their onset and offset samples, by equality joins."""
    keys = _keys(key)
    out = saccades_
    for end, t in (("onset", F.col("onset")), ("offset", F.col("onset") + F.col("duration"))):
        p = points.select(*keys, F.col(order).cast("long").alias("__i"), *[F.col(a).alias(f"{end}_{a}") for a in axes])
        out = out.withColumn("__i", F.bround(t * fs, 0).cast("long")).join(p, [*keys, "__i"], "left").drop("__i")
    return out
