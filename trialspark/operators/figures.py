"""The aggregates that figures draw: by day, by direction, boxes, circular histograms, mean waveforms, channel summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys
from trialspark.operators.stats import placed
from trialspark.operators.temporal import rolling_mean


def by_date(rows: DataFrame, key, day: str, value: str, weight: str | None = None) -> DataFrame:
    """``(key, day, value)`` for every day from a key's first to its last: sums, or weighted means; null on days without rows."""
    keys = _keys(key)
    d = rows.withColumn("day", F.to_date(day))
    agg = F.sum(value) if weight is None else F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    each = d.groupBy(*keys, "day").agg(agg.alias("value"))
    span = d.groupBy(*keys).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    days = span.select(*keys, F.explode(F.sequence("__a", "__b")).alias("day"))
    return days.join(each, [*keys, "day"], "left")


def by_trial(rows: DataFrame, key, day: str, order: str, value: str, trials: str, window: int = 11) -> DataFrame:
    """Each value once for every trial it stands for, smoothed within its day: ``(key, day, trial, value)``."""
    keys = _keys(key)
    x = rows.where(F.col(trials) > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col(trials).cast("int"))))
    x = x.withColumn("trial", F.row_number().over(Window.partitionBy(*keys, day).orderBy(order, "__k")))
    return rolling_mean(x, [*keys, day], "trial", value, window).select(*keys, day, "trial", F.col("rolled").alias("value"))


def boxes(rows: DataFrame, key, value: str, whisker: float = 1.5) -> DataFrame:
    """``(key, n, low, q1, median, q3, high, outliers)``: whiskers are the furthest values within 1.5 quartile ranges.

    Quartiles are found by running counts of the values; they meet the values again by parts of a key, as a key may hold most rows.
    """
    keys = _keys(key)
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    x = placed(rows, keys, value, __n=F.count(value))

    def at(place) -> Column:
        return F.max(F.when((F.col("__n_below") <= place) & (place < F.col("__n_below") + F.col("__n")), F.col(value).cast("double")))

    places = {q: (F.col("__n_of") - 1) * p for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    got = x.groupBy(*keys).agg(F.max("__n_of").alias("__n_of"), *[at(f(p)).alias(f"__{i}_{q}") for q, p in places.items() for i, f in enumerate((F.floor, F.ceil))])
    for q, p in places.items():
        a, b = F.col(f"__0_{q}"), F.col(f"__1_{q}")
        got = got.withColumn(q, F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b))
    parts = F.ceil((F.col("__n_of") + 1) / 2**16).cast("long")
    q = got.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(*keys, "__part", *places)
    x = x.withColumn("__part", F.pmod(F.xxhash64(value), parts)).join(q, [*keys, "__part"])
    r = whisker * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - r) & (F.col(value) <= F.col("q3") + r)
    whisk = lambda f: f(F.when(inside, F.col(value)))
    return x.groupBy(*keys).agg(F.sum("__n").alias("n"), whisk(F.min).alias("low"), *[F.max(c).alias(c) for c in places], whisk(F.max).alias("high"), F.sum((~inside).cast("long") * F.col("__n")).alias("outliers"))


def circular_histogram(rows: DataFrame, key, angle: str, bins: int = 16) -> DataFrame:
    """``(key, bin, n, density)`` of angles wrapped to [0, 2 pi)."""
    keys, width = _keys(key), 2 * math.pi / bins
    b = F.least(F.floor(F.pmod(F.col(angle), F.lit(2 * math.pi)) / width), F.lit(bins - 1)).cast("int")
    n = rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("__t"))
    return n.join(total, keys).withColumn("density", F.col("n") / F.col("__t") / width).drop("__t")


def direction_curve(rows: DataFrame, key, direction: str, value: str) -> DataFrame:
    """``(key, direction, mean, std)`` in order of directions wrapped to [0, 2 pi), the first again a turn later."""
    keys = _keys(key)
    m = rows.groupBy(*keys, F.pmod(F.col(direction), F.lit(2 * math.pi)).alias("direction")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    first = m.groupBy(*keys).agg(F.min_by(F.struct("direction", "mean", "std"), "direction").alias("f"))
    return m.unionByName(first.select(*keys, (F.col("f.direction") + 2 * math.pi).alias("direction"), "f.mean", "f.std"))


def mean_waveform(rows: DataFrame, key, k: str, value: str) -> DataFrame:
    return rows.groupBy(*_keys(key), k).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def decibel_zscore(spectra: DataFrame, key) -> DataFrame:
    """Spectra ``(key, f, t, power)`` in dB, standardised over time at each frequency."""
    from trialspark.operators.stats import zscore

    return zscore(spectra.withColumn("db", 10 * F.log10("power")), [*_keys(key), "f"], "db")
