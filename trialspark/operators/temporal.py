"""Nearest and as-of matching, filling, interpolation and resampling of time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def _both(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, carry: Column) -> DataFrame:
    """Rows of both sides in one table: ``__t``, ``__r`` (the carried struct, null for left rows) and the left row."""
    a = left.select(*keys, F.col(left_t).alias("__t"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(carry).schema[0].dataType).alias("__r"))
    b = right.select(*keys, F.col(right_t).alias("__t"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), carry.alias("__r"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, key, left_t: str, right_t: str, values: list[str], direction: str = "backward", prefix: str = "", bucket: float | None = None) -> DataFrame:
    """``left`` with the values of the last ``right`` row at or before its time (``forward``: the first at or after), null if none.

    One union, one sort within the key and a running last value: linear, where a range join would be quadratic.
    Ties of ``right`` times go to the largest values (``forward``: the least).

    ``bucket``: for keys with more rows than a task should sort.  Times are cut into buckets of this width, each sorted by
    itself; what the buckets before leave comes from a window over one row a bucket.
    """
    keys = _keys(key)
    carry = F.struct(F.col(right_t).alias("t"), *[F.col(v) for v in values])
    both = _both(left, right, keys, left_t, right_t, carry)
    late = F.col("__left").isNotNull().cast("int")
    back = direction == "backward"
    order = [F.col("__t"), late, F.col("__r")] if back else [F.col("__t").desc(), late, F.col("__r").desc()]
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        match = F.last("__r", ignorenulls=True).over(w)
    else:
        both = both.withColumn("__b", F.floor(F.col("__t") / bucket))
        each = both.groupBy(*keys, "__b").agg((F.max if back else F.min)("__r").alias("__e"))
        over = Window.partitionBy(*keys).orderBy(F.col("__b") if back else F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        each = each.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), F.last("__e", ignorenulls=True).over(over).alias("__in"))
        on = F.col("__b") == F.col("__kb")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        both = both.join(each, on)
        w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        match = F.coalesce(F.last("__r", ignorenulls=True).over(w), F.col("__in"))
    got = both.withColumn("__m", match).where("__left is not null")
    return got.select("__left.*", *[F.col(f"__m.{v}").alias(f"{prefix}{v}") for v in values], F.col("__m.t").alias(f"{prefix}match_time"))


def nearest(left: DataFrame, right: DataFrame, key, left_t: str, right_t: str, radius, values: list[str] = (), latency=0, prefix: str = "", bucket: float | None = None) -> DataFrame:
    """``left`` with the nearest ``right`` time to its own plus ``latency``, within ``radius`` (included); ties to the earlier.

    Two as-of passes over one union; no pair of rows is formed.  ``bucket``: as for ``asof``.
    """
    keys = _keys(key)
    values = list(values)
    shifted = left.withColumn("__at", F.col(left_t) + F.lit(latency))
    if bucket is not None:
        got = asof(asof(shifted, right, keys, "__at", right_t, values, "backward", "__p_", bucket), right, keys, "__at", right_t, values, "forward", "__n_", bucket)
        a, b = F.col("__at") - F.col("__p_match_time"), F.col("__n_match_time") - F.col("__at")
        first = b.isNull() | (a <= b)
        pick = lambda v: F.when(F.coalesce(first, F.lit(False)) & (a <= F.lit(radius)), F.col(f"__p_{v}")).when(~F.coalesce(first & a.isNotNull(), F.lit(False)) & (b <= F.lit(radius)), F.col(f"__n_{v}"))
        return got.select(*left.columns, pick("match_time").alias(f"{prefix}match_time"), *[pick(v).alias(f"{prefix}{v}") for v in values])
    carry = F.struct(F.col(right_t).alias("t"), *[F.col(v) for v in values])
    both = _both(shifted, right, keys, "__at", right_t, carry)
    late = F.col("__left").isNotNull().cast("int")
    back = Window.partitionBy(*keys).orderBy("__t", late, "__r").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), late, F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumns({"__p": F.last("__r", ignorenulls=True).over(back), "__n": F.last("__r", ignorenulls=True).over(fore)}).where("__left is not null")
    a, b = F.abs(F.col("__t") - F.col("__p.t")), F.abs(F.col("__n.t") - F.col("__t"))
    pick = F.when(F.col("__n").isNull() | (a <= b), F.col("__p")).otherwise(F.col("__n"))
    got = got.withColumn("__m", pick)
    near = F.abs(F.col("__m.t") - F.col("__t")) <= F.lit(radius)
    return got.select("__left.*", F.when(near, F.col("__m.t")).alias(f"{prefix}match_time"), *[F.when(near, F.col(f"__m.{v}")).alias(f"{prefix}{v}") for v in values]).drop("__at")


def fill_missing(rows: DataFrame, key, order, value: str, name: str = "filled") -> DataFrame:
    """Null values become the next value, those after the last one the previous."""
    keys = _keys(key)
    order = _keys(order)
    fore = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(fore), F.last(value, ignorenulls=True).over(back)))


def validate(rows: DataFrame, expected: str, measured: str, threshold: float) -> DataFrame:
    """``corrected`` (expected where it differs from measured by more than the threshold) and ``replaced``."""
    far = F.coalesce(F.abs(F.col(expected) - F.col(measured)) > threshold, F.lit(True))
    return rows.withColumns({"corrected": F.when(far, F.col(expected)).otherwise(F.col(measured)), "replaced": far})


def knots(rows: DataFrame, key, t: str, value: str) -> DataFrame:
    """Rows with a time and a value that come after their original predecessor in time (one pass, as in the source's order)."""
    keys = _keys(key)
    fine = rows.where(F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return fine.select(*keys, F.col(t).alias("t"), F.col(value).alias("v")).groupBy(*keys, "t").agg(F.min("v").alias("v"))


def interpolate(rows: DataFrame, points: DataFrame, key, t: str, value: str, point: str, name: str = "value", extrapolate: bool = False) -> DataFrame:
    """``points`` with the value of ``rows`` at their time, linear between its neighbours, the end values outside (or the end slopes)."""
    keys = _keys(key)
    k = knots(rows, keys, t, value)
    w = Window.partitionBy(*keys).orderBy("t")
    if extrapolate:
        k = k.withColumns({"first": F.lead("t", 1).over(w), "fv": F.lead("v", 1).over(w), "last": F.lag("t", 1).over(w), "lv": F.lag("v", 1).over(w)})
        carry = ["v", "first", "fv", "last", "lv"]
    else:
        carry = ["v"]
    got = asof(points, k, keys, point, "t", carry, "backward", "__p_")
    got = asof(got, k, keys, point, "t", carry, "forward", "__n_")
    t0, v0, t1, v1, at = F.col("__p_match_time"), F.col("__p_v"), F.col("__n_match_time"), F.col("__n_v"), F.col(point)
    line = lambda a, va, b, vb: va + (vb - va) * (at - a) / (b - a)
    inside = F.when(t0 == t1, v0).when(t0.isNotNull() & t1.isNotNull(), line(t0, v0, t1, v1))
    if extrapolate:
        inside = F.coalesce(inside, F.when(t1.isNull() & F.col("__p_last").isNotNull(), line(F.col("__p_last"), F.col("__p_lv"), t0, v0)), F.when(t0.isNull() & F.col("__n_first").isNotNull(), line(t1, v1, F.col("__n_first"), F.col("__n_fv"))))
    return got.withColumn(name, F.coalesce(inside, v0, v1)).drop(*[c for c in got.columns if c.startswith(("__p_", "__n_"))])


def sample_grid(rows: DataFrame, key, t: str, value: str, samplerate: float, append: float = 0.0, from_zero: bool = True) -> DataFrame:
    """``(key, n, t, value)`` on a regular grid: int((last + append) fs) points from 0, or from the first time to the last."""
    keys = _keys(key)
    fine = rows.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    ends = fine.groupBy(*keys).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    fs = F.lit(float(samplerate))
    if from_zero:
        count, at = ((F.col("__b") + append) * fs).cast("long"), F.col("n") / fs
    else:
        count, at = F.ceil(F.round((F.col("__b") - F.col("__a")) * fs, 6)).cast("long") + 1, F.col("__a") + F.col("n") / fs
    grid = ends.withColumn("__c", count).where("__c > 0").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1))).withColumn("t", at)
    return interpolate(fine, grid.select(*keys, "n", "t"), keys, t, value, "t")


def interp_nulls(rows: DataFrame, key, order: str, value: str, name: str = "filled") -> DataFrame:
    """Null and NaN values by their position between neighbours, the ends by the nearest value."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(order)
    num = rows.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    s = F.when(F.col("__v").isNotNull(), F.struct("__i", "__v"))
    back = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*keys).orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = num.withColumns({"__p": F.last(s, ignorenulls=True).over(back), "__n": F.last(s, ignorenulls=True).over(fore)})
    line = F.col("__p.__v") + (F.col("__n.__v") - F.col("__p.__v")) * (F.col("__i") - F.col("__p.__i")) / (F.col("__n.__i") - F.col("__p.__i"))
    return got.withColumn(name, F.coalesce(F.col("__v"), line, F.col("__p.__v"), F.col("__n.__v"))).drop("__i", "__v", "__p", "__n")


def downsample(samples: DataFrame, key, value: str, old: int, new: int, sample: str = "i") -> DataFrame:
    """``(key, i, value)`` at the new rate: means of blocks of f = old / new samples after a shift of f // 2.

    The first block holds what the shift leaves of it; samples past the last whole block are dropped.  A ratio that isn't
    whole repeats each sample up to the least common multiple first.
    """
    import math

    keys = _keys(key)
    if old % new:
        times = math.lcm(int(old), int(new)) // int(old)
        samples = samples.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(sample, F.col(sample) * times + F.col("__k")).drop("__k")
        old = old * times
    f = int(old) // int(new)
    size = samples.groupBy(*keys).agg((F.ceil((F.max(sample) + 1) / f) * f).alias("__n"))
    rows = samples.join(size, keys).where(F.col(sample) < F.col("__n") - f // 2)
    block = F.floor((F.col(sample) + f // 2) / f)
    return rows.groupBy(*keys, block.alias("i")).agg(F.avg(value).alias(value))


def bin_counts(rows: DataFrame, key, t: str, start: float, stop: float, width: float, empty: bool = True) -> DataFrame:
    """``(key, bin, center, n, rate)`` in bins [a, b), the last closed; empty ones too."""
    import math

    keys = _keys(key)
    n = max(1, math.ceil(round((stop - start) / width, 9)))
    b = F.least(F.floor((F.col(t) - start) / width), F.lit(n - 1))
    got = rows.where((F.col(t) >= start) & (F.col(t) <= start + n * width)).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    if empty:
        grid = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        got = grid.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.withColumns({"center": F.lit(start) + (F.col("bin") + 0.5) * width, "rate": F.col("n") / width})


def rolling_mean(rows: DataFrame, key, order, value: str, window: int, mode: str = "copy", name: str = "rolled") -> DataFrame:
    """Centred mean over an odd number of rows; rows nearer than half to an end have the nearest whole window's mean (or null).

    A window longer than the series gives its mean.
    """
    if window % 2 == 0:
        raise ValueError("the window is odd")
    keys, h = _keys(key), window // 2
    w = Window.partitionBy(*keys).orderBy(*_keys(order))
    rows = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*keys)), "__m": F.avg(value).over(w.rowsBetween(-h, h)), "__all": F.avg(value).over(Window.partitionBy(*keys))})
    edges = Window.partitionBy(*keys)
    rows = rows.withColumns({"__a": F.max(F.when(F.col("__i") == h, F.col("__m"))).over(edges), "__b": F.max(F.when(F.col("__i") == F.col("__n") - 1 - h, F.col("__m"))).over(edges)})
    inner = F.when(F.col("__i") < h, F.col("__a") if mode == "copy" else F.lit(None)).when(F.col("__i") > F.col("__n") - 1 - h, F.col("__b") if mode == "copy" else F.lit(None)).otherwise(F.col("__m"))
    return rows.withColumn(name, F.when(F.col("__n") < window, F.col("__all")).otherwise(inner)).drop("__i", "__n", "__m", "__all", "__a", "__b")


def derivative(rows: DataFrame, key, x: str, y: list[str] | str, norm: bool = True) -> DataFrame:
    """dy/dx by second-order differences with second-order ends for y and first-order ends for x; of the norm of several y."""
    keys, ys = _keys(key), _keys(y)
    w = Window.partitionBy(*keys).orderBy(x)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in ys[1:]), F.col(ys[0]) * F.col(ys[0]))) if norm and len(ys) > 1 else F.col(ys[0])
    rows = rows.withColumn("__y", size)
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    dy = F.when(at("__y", -1).isNull(), (-3 * F.col("__y") + 4 * at("__y", 1) - at("__y", 2)) / 2).when(at("__y", 1).isNull(), (3 * F.col("__y") - 4 * at("__y", -1) + at("__y", -2)) / 2).otherwise((at("__y", 1) - at("__y", -1)) / 2)
    dx = F.when(at(x, -1).isNull(), at(x, 1) - F.col(x)).when(at(x, 1).isNull(), F.col(x) - at(x, -1)).otherwise((at(x, 1) - at(x, -1)) / 2)
    return rows.withColumn("derivative", dy / dx).drop("__y")


def affine_sync(stamps: DataFrame, anchors: DataFrame, key, t: str) -> DataFrame:
    """``synced``: times mapped so that each key's first and last anchors of its clock meet those of the main clock.

    ``anchors(key, own, main)``; also ``scale``.
    """
    keys = _keys(key)
    ends = anchors.groupBy(*keys).agg(F.min("own").alias("__a"), F.max("own").alias("__b"), F.min("main").alias("__c"), F.max("main").alias("__d"))
    got = stamps.join(ends, keys).withColumn("scale", (F.col("__d") - F.col("__c")) / (F.col("__b") - F.col("__a")))
    return got.withColumn("synced", (F.col(t) - F.col("__a")) * F.col("scale") + F.col("__c")).drop("__a", "__b", "__c", "__d")


def common_barcodes(own: DataFrame, main: DataFrame, key, barcode: str = "barcode", t: str = "t") -> DataFrame:
    """``(key, own, main)`` of barcodes that both clocks saw once each in time order."""
    keys = _keys(key)
    a = own.groupBy(*keys, barcode).agg(F.min(t).alias("own"))
    b = main.groupBy(*keys, barcode).agg(F.min(t).alias("main"))
    return a.join(b, [*keys, barcode])


def crop_to_zero(samples: DataFrame, key, t: str, samplerate: float, sample: str = "i") -> DataFrame:
    """Samples at or after time 0, numbered from it; missing ones before the first are null rows."""
    keys = _keys(key)
    kept = samples.where(F.col(t) >= 0).withColumn(sample, F.bround(F.col(t) * samplerate, 0).cast("long"))
    first = kept.groupBy(*keys).agg(F.min(sample).alias("__f")).where("__f > 0")
    pad = first.withColumn(sample, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__f") - 1))).drop("__f").withColumn(t, F.col(sample) / samplerate)
    return kept.unionByName(pad, allowMissingColumns=True)
