"""The data of each trial: task columns, movement, decoder features and event-related responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import segments, signal, stats
from trialspark.operators.segments import _keys


def task_data(samples: DataFrame, trials: DataFrame, key, start: str, end: str, samplerate: float, step: int = 1, sample: str = "i") -> DataFrame:
    """``trials`` with the samples of each, ``k`` from 0: every ``step``-th of the recording (from its first), at samplerate / step.

    Samples int(start fs) to int(end fs), the last excluded, at the lower rate; trials without a sample give no rows.
    """
    thin = samples.where(F.col(sample) % step == 0).withColumn(sample, F.expr(f"`{sample}` div {step}"))
    return segments.data_segments(thin, trials, key, start, end, samplerate / step, sample)


def feature_data(samples: DataFrame, trials: DataFrame, key, start: str, end: str, samplerate: float, call_rate: float, bin_length: float, sample: str = "i") -> DataFrame:
    """``task_data`` of a decoder's features or states, which change once in int(call rate x bin length) samples."""
    return task_data(samples, trials, key, start, end, samplerate, int(call_rate * bin_length), sample)


def kinematic_data(samples: DataFrame, trials: DataFrame, key, start: str, end: str, axes: list[str], samplerate: float, norm: bool = False, low_cut: float | None = None, deriv: int = 0, sample: str = "i") -> DataFrame:
    """``task_data`` of positions, with ``norm`` their length (``value``); filtered or differentiated first, over the whole recording.

    ``low_cut``: of the low-pass filter in Hz, 15 if only ``deriv`` is given.
    """
    keys = _keys(key)
    rows = samples.select(*keys, sample, *axes)
    if low_cut is not None or deriv:
        done = None
        for a in axes:
            one = signal.kinematics(rows, keys, sample, a, samplerate, low_cut or 15, deriv=deriv).withColumnsRenamed({"n": sample, "value": a})
            done = one if done is None else done.join(one, [*keys, sample])
        rows = done
    if norm:
        rows = rows.select(*keys, sample, F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))).alias("value"))
    return task_data(rows, trials, keys, start, end, samplerate, 1, sample)


def erp(samples: DataFrame, triggers: DataFrame, key, trigger: str, value: str, before: float, after: float, samplerate: float, subtract: bool = True, window: tuple[float, float] | None = None, sample: str = "i") -> DataFrame:
    """Responses to triggers, a row for each sample ``k`` of each, less their mean over ``window`` (seconds from the first sample; default: all before the trigger)."""
    return _erp(samples, triggers, key, trigger, value, before, after, samplerate, subtract, window, sample).drop("__raw")


def _erp(samples, triggers, key, trigger, value, before, after, samplerate, subtract=True, window=None, sample="i") -> DataFrame:
    """``erp`` with the samples as they were (``__raw``)."""
    if subtract and before <= 0:
        raise ValueError("a baseline needs time before the trigger")
    got = segments.trial_align_data(samples, triggers, key, trigger, value, before, after, samplerate, sample).withColumn("__raw", F.col(value))
    if not subtract:
        return got
    a, b = window or (0.0, before)
    if b <= a:
        raise ValueError("the window ends after it starts")
    return stats.baseline(got.withColumn("__s", F.col("k") / F.lit(float(samplerate))), [*_keys(key), trigger], "__s", value, a, b, value).drop("__s")


def max_erp(samples: DataFrame, triggers: DataFrame, key, trigger: str, value: str, before: float, after: float, samplerate: float, search: tuple[float, float] | None = None, average: bool = True, **settings) -> DataFrame:
    """``(key, peak, at)``: the value of largest size (with its sign) of the mean response over triggers, or of each, within ``search`` seconds after the trigger.

    The earliest on ties: a mean is a sum in no fixed order, so sizes that differ by rounding only are one.
    """
    keys = [*_keys(key)] if average else [*_keys(key), trigger]
    rows = _erp(samples, triggers, key, trigger, value, before, after, samplerate, **settings)
    size = F.abs("__raw") + F.abs(F.col("__raw") - F.col(value))  # of the sample and of its baseline
    rows = rows.groupBy(*keys, "k").agg(F.avg(value).alias(value), F.avg(size).alias("__size")) if average else rows.withColumn("__size", size)
    first = int(before * samplerate)
    a, b = search or (0, after)
    return stats.max_erp(rows, keys, "k", value, first + int(a * samplerate), first + int(b * samplerate), "__size")


def tfr_ranktest(spectra: DataFrame, null: DataFrame, key, sample: str, band: tuple[float, float] = (0, 1e16), window: tuple[float, float] = (-1e16, 1e16), alternative: str = "greater", alpha: float = 0.05) -> DataFrame:
    """``(key, difference, p)``: mean power over a band and window against each null spectrum's (numbered by ``sample``).

    Signed rank test by key, p corrected for false discoveries over all keys; differences that are not significant are 0.
    """
    keys = _keys(key)
    own = signal.tfr_mean(spectra, keys, band, window).withColumnRenamed("power", "__o")
    rest = signal.tfr_mean(null, [*keys, sample], band, window)
    rows = rest.join(own, keys).withColumn("__d", F.col("__o") - F.col("power"))
    mean = rows.groupBy(*keys).agg(F.avg("__d").alias("difference"))
    tests = stats.wilcoxon(rows, keys, "__d", alternative).select(*keys, F.col("p").alias("__p")).withColumn("__all", F.lit(1))
    p = stats.fdr(tests, "__all", "__p", "p").select(*keys, "p")
    return mean.join(p, keys, "left").withColumn("p", F.coalesce("p", F.lit(1.0))).withColumn("difference", F.when(F.col("p") > alpha, F.lit(0.0)).otherwise(F.col("difference")))
