"""Chunked signals as streams: nonzero samples, discontinuities with carried state, running counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialspark.workers import reachable


def nonzero(samples: DataFrame) -> DataFrame:
    """Samples that aren't zero: stateless, for batch and streams alike."""
    return samples.where(F.col("value") != 0)


def discontinuities(samples: DataFrame, threshold: float | None = None, multiplier: float = 5.0, percentile: float = 99.0) -> DataFrame:
    """``(channel, t, value, jump)`` where a stream of ``(channel, t, value)`` steps by more than a threshold.

    Without one it is a multiple of the percentile of the steps of each micro-batch, the least over batches so far.  The
    state of a channel is its last sample and threshold, so a step between two batches is found.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_v, thr = state.get if state.exists else (None, None, float("inf"))
        pdf = pd.concat(list(frames)).sort_values("t")
        t, v = pdf["t"].to_numpy(float), pdf["value"].to_numpy(float)
        if last_t is not None:
            t, v = np.append(last_t, t), np.append(last_v, v)
        step = np.abs(np.diff(v))
        if threshold is None:
            thr = min(thr, multiplier * float(np.percentile(step, percentile)) if len(step) else thr)
        else:
            thr = threshold
        state.update((float(t[-1]), float(v[-1]), float(thr)))
        hit = np.flatnonzero(step > thr) + 1
        yield pd.DataFrame({"channel": key[0], "t": t[hit], "value": v[hit], "jump": step[hit - 1]})

    return reachable(samples).select("channel", "t", "value").groupBy("channel").applyInPandasWithState(work, "channel long, t double, value double, jump double", "last_t double, last_v double, thr double", "append", GroupStateTimeout.NoTimeout)


def crossings(samples: DataFrame, threshold: float, above: bool = True, refractory: float = 0.0) -> DataFrame:
    """``(channel, t, value)`` of samples beyond a threshold after one that wasn't, at least ``refractory`` after the last kept.

    The state of a channel is whether its last sample was beyond and when the last crossing was kept, so chunks of any size
    give the same crossings.  A channel's first sample is none.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, last = state.get if state.exists else (True, float("-inf"))
        pdf = pd.concat(list(frames)).sort_values("t")
        t, v = pdf["t"].to_numpy(float), pdf["value"].to_numpy(float)
        beyond = v > threshold if above else v < threshold
        kept = []
        for i in np.flatnonzero(beyond & ~np.append(was, beyond[:-1])):
            if t[i] - last > refractory:
                kept.append(i)
                last = t[i]
        state.update((bool(beyond[-1]), float(last)))
        yield pd.DataFrame({"channel": key[0], "t": t[kept], "value": v[kept]})

    return reachable(samples).select("channel", "t", "value").groupBy("channel").applyInPandasWithState(work, "channel long, t double, value double", "was boolean, last double", "append", GroupStateTimeout.NoTimeout)


def unique_discontinuities(hits: DataFrame, key: str, gap: float) -> DataFrame:
    """``(key, t, channels)``: hits of any channel no more than a gap apart are one, at its first time."""
    w = Window.partitionBy(key).orderBy("t")
    x = hits.withColumn("__new", F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True)).cast("int"))
    x = x.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "__g").agg(F.min("t").alias("t"), F.sort_array(F.collect_set("channel")).alias("channels")).drop("__g")


def event_counts(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window and ``by`` columns; rows later than the watermark are dropped by the stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
