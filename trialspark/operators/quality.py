"""Data quality masks for channels, trials and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def bad_trials(rows: DataFrame, key, trial: str, channel: str, value: str, sd: float = 5.0, share: float = 0.5) -> DataFrame:
    """``(key, trial, bad)``: more than a share of the channels go beyond sd standard deviations from the channel's median."""
    keys = _keys(key)
    base = rows.groupBy(*keys, channel).agg(F.median(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    x = rows.join(base, [*keys, channel]).withColumn("__o", F.abs(F.col(value) - F.col("__m")) > sd * F.col("__s"))
    each = x.groupBy(*keys, trial, channel).agg(F.max(F.col("__o").cast("int")).alias("__o"))
    return each.groupBy(*keys, trial).agg((F.avg("__o") > share).alias("bad"))


def bad_timepoints(rows: DataFrame, key, t: str, channel: str, value: str, sd: float = 5.0, share: float = 0.5) -> DataFrame:
    """``(key, t, bad)``: the same by sample."""
    return bad_trials(rows, key, t, channel, value, sd, share)


def outlier_channels(rows: DataFrame, key, channel: str, value: str, sd: float = 5.0, tail: float = 0.05) -> DataFrame:
    """``(key, channel, std, bad)``: the channel's deviation lies in a tail of all and beyond sd of their spread from the median."""
    keys = _keys(key)
    each = rows.groupBy(*keys, channel).agg(F.stddev_pop(value).alias("std"))
    all_ = each.groupBy(*keys).agg(F.median("std").alias("__m"), F.stddev_pop("std").alias("__s"), F.percentile("std", F.lit(tail)).alias("__a"), F.percentile("std", F.lit(1 - tail)).alias("__b"))
    far = F.abs(F.col("std") - F.col("__m")) > sd * F.col("__s")
    return each.join(all_, keys).withColumn("bad", far & ((F.col("std") <= F.col("__a")) | (F.col("std") >= F.col("__b")))).select(*keys, channel, "std", "bad")


def noise_bounds(rows: DataFrame, key, value: str, bins: int = 20) -> DataFrame:
    """``(key, low, high)``: outermost histogram edges inside three standard deviations of the mean."""
    from trialspark.operators.stats import histogram

    keys = _keys(key)
    stat = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    h = histogram(rows, keys, value, bins).groupBy(*keys).agg(F.min("low").alias("__a"), F.max("high").alias("__b"))
    return stat.join(h, keys).select(*keys, F.greatest(F.col("__a"), F.col("__m") - 3 * F.col("__s")).alias("low"), F.least(F.col("__b"), F.col("__m") + 3 * F.col("__s")).alias("high"))


def saturated(rows: DataFrame, key, value: str, tolerance: float = 1e-8) -> DataFrame:
    """``rows`` with ``saturated``: rectified values over a threshold found by iteration, by key.

    The threshold is the mean of the means above and below it, until it moves by less than the tolerance (which it comes to
    after finitely many rounds, as the values it parts are finitely many); each round is one aggregate over the keys.
    """
    keys = _keys(key)
    a = F.abs(F.col(value))
    now = rows.groupBy(*keys).agg(F.avg(a).alias("thr"))
    held = None
    while True:
        both = rows.join(now, keys)
        new = both.groupBy(*keys, "thr").agg(F.avg(F.when(a > F.col("thr"), a)).alias("__h"), F.avg(F.when(a <= F.col("thr"), a)).alias("__l"))
        new = new.withColumn("__n", (F.coalesce("__h", "thr") + F.coalesce("__l", "thr")) / 2)
        new = new.select(*keys, F.col("__n").alias("thr"), (F.abs(F.col("__n") - F.col("thr")) >= tolerance).alias("__moved"))
        new = new.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else new.persist()
        moved = new.where("__moved").limit(1).count()
        if held is not None:
            held.unpersist()
        held, now = new, new.drop("__moved")
        if not moved:
            return rows.join(now, keys).withColumn("saturated", a > F.col("thr")).drop("thr")


def mismatched_entries(left: DataFrame, right: DataFrame, key, order: str, code: str) -> DataFrame:
    """Keys whose ordered codes differ between two tables, or that only one of them has."""
    keys = _keys(key)
    a = left.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(F.xxhash64(order, code).cast("decimal(38,0)")).alias("__h"))
    b = right.groupBy(*keys).agg(F.count("*").alias("__n2"), F.sum(F.xxhash64(order, code).cast("decimal(38,0)")).alias("__h2"))
    return a.join(b, keys, "full_outer").where("not (__n <=> __n2 and __h <=> __h2)").select(*keys)
