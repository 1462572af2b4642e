"""Response latencies: deviation from a null condition and accumulated log-likelihood ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def first_deviation(alt: DataFrame, null: DataFrame, key, trial: str, i: str, value: str, samplerate: float, sd: float = 3.0) -> DataFrame:
    """``(key, trial, latency)``: first sample farther than sd standard deviations from the null's mean, null if none."""
    keys = _keys(key)
    base = null.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    x = alt.join(base, keys).withColumn("__d", F.abs(F.col(value) - F.col("__m")) > sd * F.col("__s"))
    return x.groupBy(*keys, trial).agg((F.min(F.when(F.col("__d"), F.col(i))) / samplerate).alias("latency"))


def llr(x: Column, mean1: Column, mean2: Column, sigma1: Column, sigma2: Column) -> Column:
    """Log-likelihood ratio of two Gaussians at x."""
    return F.log(sigma2 / sigma1) - (x - mean1) ** 2 / (2 * sigma1 * sigma1) + (x - mean2) ** 2 / (2 * sigma2 * sigma2)


def accllr(rows: DataFrame, key, trial: str, i: str, value: str, alt: str, common: bool = True) -> DataFrame:
    """``(key, trial, i, alt, llr, accllr)``: running sums of the ratio of alt over null, each trial against the others' means.

    Means of a trial's own condition leave the trial out; sigma is one number per key (or per condition) over all residuals
    from the condition's means, with one degree less.
    """
    keys = _keys(key)
    cond = rows.groupBy(*keys, alt, i).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    own = rows.join(cond, [*keys, alt, i])
    loo = (F.col("__s") - F.col(value)) / (F.col("__n") - 1)
    other = cond.select(*keys, i, (~F.col(alt)).alias(alt), (F.col("__s") / F.col("__n")).alias("__other"))
    x = own.withColumns({"__own": loo, "__r": F.col(value) - F.col("__s") / F.col("__n")}).join(other, [*keys, alt, i])
    if common:
        sigma = x.groupBy(*keys).agg(F.stddev_samp("__r").alias("__sa")).withColumn("__sn", F.col("__sa"))
    else:
        sigma = x.groupBy(*keys).agg(F.stddev_samp(F.when(F.col(alt), F.col("__r"))).alias("__sa"), F.stddev_samp(F.when(~F.col(alt), F.col("__r"))).alias("__sn"))
    x = x.join(sigma, keys)
    ma, mn = F.when(F.col(alt), F.col("__own")).otherwise(F.col("__other")), F.when(F.col(alt), F.col("__other")).otherwise(F.col("__own"))
    x = x.withColumn("llr", llr(F.col(value), ma, mn, F.col("__sa"), F.col("__sn")))
    w = Window.partitionBy(*keys, alt, trial).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("accllr", F.sum("llr").over(w)).select(*keys, trial, i, alt, "llr", "accllr")


def detect(acc: DataFrame, key, trial: str, i: str, value: str, levels: list[float]) -> DataFrame:
    """``(key, trial, level, side, at)``: which of +level and -level is hit first (0 for neither), for each of a list of levels.

    Both hit at one sample counts as neither.
    """
    keys = _keys(key)
    x = acc.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    hit = x.groupBy(*keys, trial, "level").agg(F.min(F.when(F.col(value) >= F.col("level"), F.col(i))).alias("u"), F.min(F.when(F.col(value) <= -F.col("level"), F.col(i))).alias("d"))
    side = F.when(F.col("u").isNotNull() & (F.col("d").isNull() | (F.col("u") < F.col("d"))), 1).when(F.col("d").isNotNull() & (F.col("u").isNull() | (F.col("d") < F.col("u"))), -1).otherwise(0)
    return hit.withColumn("side", side).select(*keys, trial, "level", "side", F.when(F.col("side") == 1, F.col("u")).when(F.col("side") == -1, F.col("d")).alias("at"))


def best_level(hits: DataFrame, key, alt: str) -> DataFrame:
    """``(key, level, gain)``: level with the largest share of alt trials that hit up less null trials that do, the least on ties."""
    keys = _keys(key)
    each = hits.groupBy(*keys, "level").agg((F.avg(F.when(F.col(alt), (F.col("side") == 1).cast("double"))) - F.avg(F.when(~F.col(alt), (F.col("side") == 1).cast("double")))).alias("gain"))
    return each.groupBy(*keys).agg(F.max_by(F.struct("level", "gain"), F.struct(F.col("gain"), -F.col("level"))).alias("b")).select(*keys, "b.*")


def accllr_latency(rows: DataFrame, key, trial: str, i: str, value: str, alt: str, levels: list[float], samplerate: float) -> DataFrame:
    """``(key, trial, level, latency)`` of alt trials that reach the key's best level upwards; the level is chosen over both conditions."""
    keys = _keys(key)
    acc = accllr(rows, keys, trial, i, value, alt)
    hits = detect(acc, [*keys, alt], trial, i, "accllr", levels)
    best = best_level(hits, keys, alt).select(*keys, "level")
    return hits.join(best, [*keys, "level"]).where(F.col(alt) & (F.col("side") == 1)).select(*keys, trial, "level", (F.col("at") / samplerate).alias("latency"))


def machine_dynamics(f: str, order: int) -> tuple[Column, Column]:
    """Real and imaginary part of the plant 1, 1/s or 1/s(s+1) at s = 2 pi i f."""
    w = F.lit(6.283185307179586) * F.col(f)
    if order == 0:
        return F.lit(1.0), F.lit(0.0)
    if order == 1:
        return F.lit(0.0), -1 / w
    return -1 / (1 + w * w), -1 / (w * (1 + w * w))


def crossover_frequency(gains: DataFrame, key, f: str, gain: str) -> DataFrame:
    """First frequency with a mean loop gain under one."""
    keys = _keys(key)
    return gains.groupBy(*keys, f).agg(F.avg(gain).alias("__g")).groupBy(*keys).agg(F.min(F.when(F.col("__g") < 1, F.col(f))).alias("crossover"))


def pair_trials(trials: list[tuple[list[float], list[float]]], distance: int = 1, most: int = 2) -> list[tuple[int, int]]:
    """Greedy pairs i < j <= i + distance of trials whose reference and disturbance frequencies all differ, at most ``most`` each.

    A sequential rule on one session's list of trials.
    """
    used, out = [0] * len(trials), []
    for i, (r, d) in enumerate(trials):
        for j in range(i + 1, min(len(trials), i + distance + 1)):
            r2, d2 = trials[j]
            if used[i] < most and used[j] < most and all(a != b for a, b in zip(r, r2, strict=False)) and all(a != b for a, b in zip(d, d2, strict=False)):
                out.append((i, j))
                used[i] += 1
                used[j] += 1
    return out
