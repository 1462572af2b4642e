"""Preparation of recordings: clocks, frozen tracking, references, concatenation, eye calibration across a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.runs import longest_run
from trialspark.operators.segments import _keys
from trialspark.operators.temporal import fill_missing, nearest


def correct_clock(clock: DataFrame, key, time: str, internal: str, sync: DataFrame | None = None, measured: DataFrame | None = None, fps: float = 120.0, latency: float = 0.01) -> DataFrame:
    """A clock's cycles ``(key, time)`` with ``timestamp_internal``, ``timestamp_sync`` and ``timestamp_measure``.

    The internal clock is moved to start with the sync clock; each cycle takes the sync pulse within 1.5 cycles of it or, where
    one is missing, the moved internal time.  Measured times are matched after a latency and dropped for keys that miss a
    second of them in a row.  ``sync`` and ``measured`` have columns key and ``timestamp``.
    """
    keys, radius = _keys(key), 1.5 / fps
    first = clock.groupBy(*keys).agg(F.min(internal).alias("__c0"))
    if sync is not None:
        start = sync.groupBy(*keys).agg(F.min("timestamp").alias("__s0"))
        moved = clock.join(first, keys).join(start, keys, "left").withColumn("timestamp_internal", F.col(internal) - F.col("__c0") + F.coalesce("__s0", "__c0"))
        moved = nearest(moved.select(*keys, time, "timestamp_internal"), sync, keys, "timestamp_internal", "timestamp", radius)
        out = moved.withColumnRenamed("match_time", "__m").withColumn("timestamp_sync", F.coalesce("__m", "timestamp_internal")).withColumn("sync_missing", F.col("__m").isNull()).drop("__m")
    else:
        out = clock.select(*keys, time, F.col(internal).alias("timestamp_internal"), F.lit(None).cast("double").alias("timestamp_sync"), F.lit(True).alias("sync_missing"))
    if measured is not None:
        out = nearest(out.withColumn("__a", F.coalesce("timestamp_sync", "timestamp_internal")), measured, keys, "__a", "timestamp", radius, latency=latency)
        gaps = longest_run(out, keys, time, F.col("match_time").isNull())
        out = out.join(gaps, keys).withColumn("timestamp_measure", F.when(F.col("longest") < fps, F.col("match_time"))).drop("match_time", "longest", "__a")
    else:
        out = out.withColumn("timestamp_measure", F.lit(None).cast("double"))
    return out


def event_times(events: DataFrame, clock: DataFrame, key, time: str) -> DataFrame:
    """Events with all timestamps of the clock cycle they name."""
    return events.join(clock, [*_keys(key), time], "left")


def best_timestamps(clock: DataFrame, key, time: str) -> DataFrame:
    """``timestamp``: the measured time, holes filled from the next one; without any, the sync time, then the internal."""
    filled = fill_missing(clock, key, time, "timestamp_measure", "__f")
    return filled.withColumn("timestamp", F.coalesce("__f", "timestamp_sync", "timestamp_internal")).drop("__f")


def blank_frozen(rows: DataFrame, key, order, watched: list[str], blank: list[str]) -> DataFrame:
    """Columns ``blank`` become null where none of ``watched`` changed since the row before."""
    w = Window.partitionBy(*_keys(key)).orderBy(*_keys(order))
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    frozen = same & F.lag(F.lit(True)).over(w).isNotNull()
    return rows.withColumn("__f", frozen).withColumns({c: F.when(~F.col("__f"), F.col(c)) for c in blank}).drop("__f")


def common_reference(samples: DataFrame, key, channel: str, order: str, value: str, by: str = "time") -> DataFrame:
    """``referenced``: values less the mean over channels at their time (or, by ``channel``, over their channel's time)."""
    keys = [*_keys(key), order if by == "time" else channel]
    mean = samples.groupBy(*keys).agg(F.avg(value).alias("__m"))
    return samples.join(mean, keys).withColumn("referenced", F.col(value) - F.col("__m")).drop("__m")


def concat_entries(recordings: list[tuple[str, DataFrame]], sample: str) -> tuple[DataFrame, DataFrame]:
    """Recordings one after another, and their sizes ``(entry, ord, n)``; samples are renumbered over all."""
    spark = recordings[0][1].sparkSession
    sizes, whole, at = [], None, 0
    for i, (entry, df) in enumerate(recordings):
        n = (df.agg(F.max(sample)).first()[0] + 1) if df.take(1) else 0
        part = df.withColumn(sample, F.col(sample) + F.lit(at))
        whole = part if whole is None else whole.unionByName(part)
        sizes.append((entry, i, n))
        at += n
    return whole, spark.createDataFrame(sizes, "entry string, ord int, n long")


def day_calibration(fits: DataFrame, day, entry: str, r: str, coefficients: list[str], least: float = 0.9) -> DataFrame:
    """``(day, entry, coefficients...)``: those of the day's entry with the largest mean absolute correlation, under 1 and at least ``least``, for all of them.

    ``fits`` has a row for each entry and axis; ties go to the first entry.
    """
    keys = _keys(day)
    mean = fits.groupBy(*keys, entry).agg(F.avg(F.abs(r)).alias("__r"))
    best = mean.where((F.col("__r") < 1.0) & (F.col("__r") >= least)).groupBy(*keys).agg(F.max_by(entry, F.struct(F.col("__r"), -F.col(entry))).alias("__best"))
    chosen = fits.join(best, keys).where(F.col(entry) == F.col("__best")).drop(entry, r, "__best")
    return fits.select(*keys, entry).distinct().join(chosen, keys)


def rotate_by_increments(rows: DataFrame, key, order, reward: str, x: str, y: str, degrees: float, per: int = 1) -> DataFrame:
    """Screen coordinates turned by ``degrees`` for every ``per`` rewards so far."""
    w = Window.partitionBy(*_keys(key)).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    a = F.radians(F.floor(F.sum(F.col(reward).cast("int")).over(w) / per) * degrees)
    return rows.withColumn("__a", a).withColumns({f"{x}_screen": F.cos("__a") * F.col(x) - F.sin("__a") * F.col(y), f"{y}_screen": F.sin("__a") * F.col(x) + F.cos("__a") * F.col(y)}).drop("__a")
