"""Spike trains: thresholds, detection, refractory periods, bins and unit quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys
from trialspark.workers import reachable


def threshold(samples: DataFrame, key, value: str, high: bool = True, multiplier: float = 3.0) -> DataFrame:
    """``(key, threshold)``: mean plus (or less) a multiple of the population standard deviation."""
    sign = multiplier if high else -multiplier
    return samples.groupBy(*_keys(key)).agg((F.avg(value) + sign * F.stddev_pop(value)).alias("threshold"))


def detect(samples: DataFrame, thresholds: DataFrame, key, order: str, value: str, samplerate: float, above: bool = True) -> DataFrame:
    """``(key, i, t)``: samples beyond their key's threshold after one that wasn't."""
    keys = _keys(key)
    x = samples.join(thresholds, keys)
    x = x.withColumn("__b", F.col(value) > F.col("threshold") if above else F.col(value) < F.col("threshold"))
    w = Window.partitionBy(*keys).orderBy(order)
    return x.withColumn("__p", F.lag("__b").over(w)).where("__b and not __p").select(*keys, F.col(order).alias("i"), (F.col(order) / samplerate).alias("t"))


def waveforms(spikes: DataFrame, samples: DataFrame, key, order: str, value: str, before: int, length: int) -> DataFrame:
    """``(key, i, waveform)``: ``length`` samples from ``before`` ahead of each spike; null where the recording ends."""
    keys = _keys(key)
    grid = spikes.select(*keys, "i").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("__at", F.col("i") - before + F.col("__k"))
    rows = samples.select(*keys, F.col(order).alias("__at"), F.col(value).alias("__v"))
    got = grid.join(rows, [*keys, "__at"], "left").groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct("__k", "__v"))).alias("__w"))
    return got.select(*keys, "i", F.transform("__w", lambda x: x["__v"]).alias("waveform"))


def refractory_fast(spikes: DataFrame, key, t: str, period) -> DataFrame:
    """Spikes more than a period after the spike before, and the first."""
    w = Window.partitionBy(*_keys(key)).orderBy(t)
    return spikes.withColumn("__d", F.col(t) - F.lag(t).over(w)).where(F.col("__d").isNull() | (F.col("__d") > period)).drop("__d")


def _next(times: np.ndarray, i: int, period) -> int:
    """The first place after i whose time lies over a period later."""
    low, high = i + 1, len(times)
    while low < high:
        mid = (low + high) // 2
        if times[mid] - times[i] > period:
            high = mid
        else:
            low = mid + 1
    return low


#: Spikes of a piece that is folded as an expression; a longer one is walked in an Arrow batch.
SHORT_PIECE = 64


def refractory(spikes: DataFrame, key, t: str, period) -> DataFrame:
    """Spikes more than a period after the last one *kept*: a sequential rule.

    Trains are cut where a gap exceeds the period, since the spike after such a gap is kept whatever came before.  Short
    pieces are folded as expressions; in a long one each kept spike leads to the next by a binary search, so a piece of any
    length costs its number of kept spikes.
    """
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("__t")
    x = spikes.select(*keys, F.col(t).alias("__t"))
    x = x.withColumn("__new", F.coalesce(F.col("__t") - F.lag("__t").over(w) > period, F.lit(True)).cast("int"))
    x = x.withColumn("__piece", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__piece")))
    piece = x.where(F.col("__n") <= SHORT_PIECE).groupBy(*keys, "__piece").agg(F.sort_array(F.collect_list("__t")).alias("__l"))
    kept = F.aggregate("__l", F.slice("__l", 1, 1), lambda acc, v: F.when(v - F.element_at(acc, -1) > period, F.concat(acc, F.array(v))).otherwise(acc))
    short = piece.select(*keys, F.explode(kept).alias(t))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in short.schema.fields)

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        times = table["__t"].to_numpy()
        at, i = [], 0
        while i < len(times):
            at.append(i)
            i = _next(times, i, period)
        return table.take(pa.array(at, pa.int64())).select([*keys, "__t"]).rename_columns([*keys, t])

    long = reachable(x).where(F.col("__n") > SHORT_PIECE).select(*keys, "__piece", "__t").groupBy(*keys, "__piece").applyInArrow(walk, kinds)
    return short.unionByName(long)


def bin_spikes(samples: DataFrame, key, order: str, value: str, samplerate: float, width: float) -> DataFrame:
    """``(key, bin, rate)``: sums of samples by bins of round(fs width) samples over the width; the last may be short."""
    n = round(samplerate * width)
    return samples.groupBy(*_keys(key), F.floor(F.col(order) / n).alias("bin")).agg((F.sum(value) / width).alias("rate"))


def isi_histogram(spikes: DataFrame, key, t: str, width: float, most: float) -> DataFrame:
    """``(key, bin, center, n)`` of intervals between spikes in [0, most); empty bins are left out."""
    w = Window.partitionBy(*_keys(key)).orderBy(t)
    x = spikes.withColumn("__d", F.col(t) - F.lag(t).over(w)).where((F.col("__d") >= 0) & (F.col("__d") < most))
    return x.groupBy(*_keys(key), F.floor(F.col("__d") / width).cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("center", (F.col("bin") + 0.5) * width)


def presence_ratio(counts: DataFrame, unit: str, trial: str, n: str, least: float = 0.9) -> DataFrame:
    """``(unit, ratio, present)``: share of trials with a spike."""
    each = counts.groupBy(unit, trial).agg((F.max(n) > 0).cast("double").alias("__s"))
    return each.groupBy(unit).agg(F.avg("__s").alias("ratio")).withColumn("present", F.col("ratio") >= least)


def refractory_violations(spikes: DataFrame, unit: str, t: str, period, percent: float = 1.0) -> DataFrame:
    """``(unit, n, violations, violation_percent, good)``: intervals under the period over spikes."""
    w = Window.partitionBy(unit).orderBy(t)
    x = spikes.withColumn("__v", F.coalesce(F.col(t) - F.lag(t).over(w) < period, F.lit(False)).cast("int"))
    got = x.groupBy(unit).agg(F.count("*").alias("n"), F.sum("__v").alias("violations"))
    return got.withColumn("violation_percent", 100 * F.col("violations") / F.col("n")).withColumn("good", F.col("violation_percent") <= percent)


def mean_variance(counts: DataFrame, unit: str, trial: str, n: str) -> DataFrame:
    each = counts.groupBy(unit, trial).agg(F.sum(n).alias("__c"))
    return each.groupBy(unit).agg(F.avg("__c").alias("mean"), F.var_pop("__c").alias("variance"))


def amplitudes(waves: DataFrame, unit: str, channel: str, k: str, value: str, least: float = 50.0) -> DataFrame:
    """``(unit, amplitude, high)``: peak to peak of the mean centred waveform on the unit's largest channel."""
    mean = waves.groupBy(unit, channel, k).agg(F.avg(value).alias("__m"))
    size = mean.groupBy(unit, channel).agg((F.max("__m") - F.min("__m")).alias("__a"))
    return size.groupBy(unit).agg(F.max("__a").alias("amplitude")).withColumn("high", F.col("amplitude") > least)


def top_channels(templates: DataFrame, unit: str, channel: str, value: str, n: int = 10) -> DataFrame:
    """The ``n`` channels with the largest peak to peak of each unit's template, with their rank."""
    size = templates.groupBy(unit, channel).agg((F.max(value) - F.min(value)).alias("p2p"))
    return size.withColumn("rank", F.row_number().over(Window.partitionBy(unit).orderBy(F.col("p2p").desc(), channel))).where(F.col("rank") <= n)


def noise_cutoff(amps: DataFrame, unit: str, value: str, width: float = 0.2, low: float = 0.1, std: float = 5.0, least: int = 10) -> DataFrame:
    """``(unit, n, cutoff, ratio, good)``: how far the lowest amplitude bins stand over the spread of the high ones.

    Bins of ``width`` from the least amplitude on, empty ones included; the top quarter of the bins is the reference.
    cutoff = (mean of the lowest ``low`` share of bins - mean of the top quarter) / its standard deviation.
    """
    ends = amps.groupBy(unit).agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.count("*").alias("n")).withColumn("__k", F.floor((F.col("__b") - F.col("__a")) / width).cast("int") + 1)
    hist = amps.join(ends.select(unit, "__a"), unit).groupBy(unit, F.floor((F.col(value) - F.col("__a")) / width).cast("int").alias("__i")).agg(F.count("*").alias("__c"))
    grid = ends.select(unit, "__k", "n", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__i")).join(hist, [unit, "__i"], "left").withColumn("__c", F.coalesce("__c", F.lit(0)))
    top, bottom = F.col("__i") >= F.floor(F.col("__k") * 0.75), F.col("__i") < F.greatest(F.lit(1), F.floor(F.col("__k") * low))
    got = grid.groupBy(unit).agg(F.max("n").alias("n"), F.avg(F.when(bottom, F.col("__c"))).alias("__low"), F.avg(F.when(top, F.col("__c"))).alias("__top"), F.stddev_pop(F.when(top, F.col("__c"))).alias("__sd"), F.max("__c").alias("__max"))
    got = got.withColumns({"cutoff": F.try_divide(F.col("__low") - F.col("__top"), F.col("__sd")), "ratio": F.col("__low") / F.col("__max")})
    return got.withColumn("good", (F.col("n") >= least) & (F.coalesce(F.col("cutoff"), F.lit(0.0)) <= std)).select(unit, "n", "cutoff", "ratio", "good")


def split_entries(spikes: DataFrame, sizes: DataFrame, sample: str, most: int = 10_000) -> DataFrame:
    """Spikes of a concatenated recording back to their entries: ``entry`` and ``entry_sample``.

    ``sizes(entry, ord, n)`` has a row for each entry of the recording, ``most`` at most; it becomes an array literal.
    """
    rows = sizes.select("ord", "entry", "n").orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    at, table = 0, []
    for r in rows:
        table.append(F.struct(F.lit(at).cast("long").alias("offset"), F.lit(r["entry"]).alias("entry")))
        at += r["n"]
    hit = F.element_at(F.filter(F.array(*table), lambda x: x["offset"] <= F.col(sample)), -1)
    return spikes.withColumn("__h", hit).withColumns({"entry": F.col("__h.entry"), "entry_sample": F.col(sample) - F.col("__h.offset")}).drop("__h")
