"""Runs, edges and pulses: gaps and islands by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def runs(rows: DataFrame, key, order, value: str, threshold: float | None = None) -> DataFrame:
    """``(key, run, start, n, value)``: maximal runs of equal values, or of steps within ``threshold``; ``start`` is a position."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(*_keys(order))
    before = F.lag(value).over(w)
    new = ~F.col(value).eqNullSafe(before) if threshold is None else F.coalesce(F.abs(F.col(value) - before) > threshold, F.lit(True))
    num = rows.withColumns({"__i": (F.row_number().over(w) - 1).cast("long"), "__new": F.when(F.lag(F.lit(1)).over(w).isNull() | new, 1).otherwise(0)})
    num = num.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return num.groupBy(*keys, "run").agg(F.min("__i").alias("start"), F.count("*").alias("n"), F.min_by(value, "__i").alias("value"))


def longest_run(rows: DataFrame, key, order, condition: Column) -> DataFrame:
    """``(key, longest)``: the longest run of rows that meet a condition, 0 if none do."""
    flagged = rows.withColumn("__c", F.coalesce(condition, F.lit(False)))
    got = runs(flagged, key, order, "__c")
    return got.groupBy(*_keys(key)).agg(F.coalesce(F.max(F.when(F.col("value"), F.col("n"))), F.lit(0)).alias("longest"))


def long_runs(rows: DataFrame, key, order, condition: Column, least: int, name: str = "flag") -> DataFrame:
    """``rows`` with a flag on those inside a run of more than ``least`` rows that meet the condition."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(*_keys(order))
    x = rows.withColumn("__c", F.coalesce(condition, F.lit(False)))
    x = x.withColumn("__new", (F.lag("__c").over(w).isNull() | (F.lag("__c").over(w) != F.col("__c"))).cast("int"))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return x.withColumn(name, F.col("__c") & (size > least)).drop("__c", "__new", "__run")


def segment_array(rows: DataFrame, key, order, value: str, category: str, duplicate_endpoints: bool = False) -> DataFrame:
    """``(key, run, category, values)``: lists of consecutive rows of one category, with the next run's first value if asked for."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(*_keys(order))
    x = rows.withColumns({"__i": F.row_number().over(w), "__new": F.when(~F.col(category).eqNullSafe(F.lag(category).over(w)) | F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(0), "__next": F.lead(value).over(w), "__nextcat": F.lead(category).over(w), "__more": F.lead(F.lit(True)).over(w)})
    x = x.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = x.groupBy(*keys, "run").agg(F.min_by(category, "__i").alias("category"), F.sort_array(F.collect_list(F.struct("__i", F.col(value).alias("v")))).alias("__l"), F.max_by(F.struct("__next", "__more"), "__i").alias("__e"))
    values = F.transform("__l", lambda s: s["v"])
    if duplicate_endpoints:
        values = F.when(F.col("__e.__more"), F.concat(values, F.array("__e.__next"))).otherwise(values)
    return got.select(*keys, "run", "category", values.alias("values"))


def to_digital(samples: DataFrame, key, value: str, threshold: float = 0.3, name: str = "digital") -> DataFrame:
    """Values scaled by their key's least and greatest, at or over the threshold; a constant series is low."""
    keys = _keys(key)
    ends = samples.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return samples.join(ends, keys).withColumn(name, F.coalesce(scaled >= threshold, F.lit(threshold <= 0))).drop("__lo", "__hi")


def detect_edges(samples: DataFrame, key, order: str, word: str, samplerate: float, rising: bool = True, falling: bool = True, alternating: bool = True) -> DataFrame:
    """``(key, order, time, value, rising)`` of edges of a digital word; of repeated edges of one kind the last stays.

    Rising: a bit that wasn't set is; falling: one that was isn't.  The first sample is never an edge.
    """
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(order)
    now, before = F.col(word).cast("long"), F.lag(F.col(word).cast("long")).over(w)
    up, down = F.bitwise_not(before).bitwiseAND(now) != 0, before.bitwiseAND(F.bitwise_not(now)) != 0
    x = samples.withColumns({"__up": up, "__down": down}).where((F.col("__up") & F.lit(rising)) | (F.col("__down") & F.lit(falling)))
    x = x.withColumn("rising", F.col("__up") & F.lit(rising))
    if alternating and rising and falling:
        x = x.withColumn("__same", F.lead("rising").over(w) == F.col("rising")).where("not coalesce(__same, false)")
    return x.select(*keys, order, (F.col(order) / samplerate).alias("time"), now.alias("value"), "rising")


def pulses(edges: DataFrame, key, time: str = "time", rising: str = "rising") -> DataFrame:
    """``(key, on, off)`` of each rising edge and the falling one after it."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(time)
    x = edges.withColumns({"off": F.lead(time).over(w), "__down": ~F.lead(rising).over(w)})
    return x.where(F.col(rising) & F.col("__down")).select(*keys, F.col(time).alias("on"), "off")


def duty_cycles(pairs: DataFrame, key) -> DataFrame:
    """``pairs`` with ``duty``: width over the key's first period."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("on")
    first = pairs.withColumns({"__p": F.lead("on").over(w) - F.col("on"), "__n": F.row_number().over(w)}).where("__n = 1").select(*keys, "__p")
    return pairs.join(first, keys).withColumn("duty", (F.col("off") - F.col("on")) / F.col("__p")).drop("__p")


def edges_from_onsets(onsets: DataFrame, key, time: str, width: float) -> DataFrame:
    """``(key, time, value)``: 1 at each onset, 0 a width later, and 0 at time 0."""
    keys = _keys(key)
    both = onsets.select(*keys, F.explode(F.array(F.struct(F.col(time).alias("time"), F.lit(1.0).alias("value")), F.struct((F.col(time) + width).alias("time"), F.lit(0.0).alias("value")))).alias("e")).select(*keys, "e.*")
    zero = onsets.select(*keys).distinct().select(*keys, F.lit(0.0).alias("time"), F.lit(0.0).alias("value"))
    return both.unionByName(zero)


def copy_edges_forwards(samples: DataFrame, key, order: str, value: str, steps: int, truncate: bool = False, name: str = "extended") -> DataFrame:
    """Each rising edge held for ``steps`` samples more; without ``truncate`` also wherever the value itself is set."""
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    x = samples.withColumn("__e", F.col(value).cast("boolean") & ~F.coalesce(F.lag(F.col(value).cast("boolean")).over(w), F.lit(False)))
    held = F.max(F.col("__e").cast("int")).over(w.rowsBetween(-steps, 0)) == 1
    return x.withColumn(name, held if truncate else held | F.col(value).cast("boolean")).drop("__e")


def first_nonzero(samples: DataFrame, key, order: str, value: str, otherwise: int = -1) -> DataFrame:
    return samples.groupBy(*_keys(key)).agg(F.coalesce(F.min(F.when(F.col(value) != 0, F.col(order))), F.lit(otherwise)).alias("first"))


def consecutive_days(rows: DataFrame, key, day: str) -> DataFrame:
    """``(key, first_day, last_day, n)`` of runs of at least two consecutive days."""
    keys = _keys(key)
    days = rows.select(*keys, F.to_date(day).alias("day")).where("day is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    island = days.withColumn("__g", F.date_sub("day", F.row_number().over(w)))
    return island.groupBy(*keys, "__g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).where("n >= 2").drop("__g")


def barcodes(pairs: DataFrame, key, gap: float = 30.0, bar: float = 0.017, nbits: int = 32) -> DataFrame:
    """``(key, t, barcode)`` of barcodes in pulses ``(on, off)``: each starts after a gap, its bits last a bar each.

    A pulse sets the bits its width covers, from the bar its start falls into after the code's start pulse.
    """
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("on")
    x = pairs.withColumn("__new", F.coalesce(F.col("on") - F.lag("on").over(w) > gap / 2, F.lit(True)).cast("int"))
    x = x.withColumn("__code", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("off").over(Window.partitionBy(*keys, "__code"))
    head = F.min("on").over(Window.partitionBy(*keys, "__code"))
    x = x.withColumns({"__off0": start, "__on0": head}).where(F.col("on") >= F.col("__off0"))
    a = F.bround((F.col("on") - F.col("__off0")) / bar, 0).cast("int")
    b = F.bround((F.col("off") - F.col("__off0")) / bar, 0).cast("int")
    bits = x.withColumn("__bit", F.explode(F.sequence(a, F.greatest(a, b - 1)))).where(f"__bit between 0 and {nbits - 1}")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))
    return bits.select(*keys, "__code", "__on0", one.alias("__v")).distinct().groupBy(*keys, "__code").agg(F.min("__on0").alias("t"), F.sum("__v").alias("barcode")).drop("__code")
