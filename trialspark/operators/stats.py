"""Descriptive and inferential statistics as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def _value(c) -> Column:
    """A column whose NaN are null: missing values don't count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c)


def rms(value: str, remove_offset: bool = True) -> Column:
    """Root mean square of a group, about its mean or about zero."""
    return F.stddev_pop(value) if remove_offset else F.sqrt(F.avg(F.col(value) * F.col(value)))


def sem(value: str) -> Column:
    """Population standard deviation over the root of the count, missing values left out."""
    return F.stddev_pop(_value(value)) / F.sqrt(F.count(_value(value)))


def regression(rows: DataFrame, key, x: str, y: str, weight: str | None = None) -> DataFrame:
    """``(key, n, slope, intercept, r, r2)`` by least squares; weighted if a weight is named."""
    keys = _keys(key)
    both = rows.where(_value(x).isNotNull() & _value(y).isNotNull())
    if weight is None:
        got = both.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))
        return got.withColumn("r2", F.col("r") * F.col("r"))
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * a * b).alias("ab"), F.sum(w * b * b).alias("bb"))
    va, vb, c = F.col("aa") - F.col("a") ** 2 / F.col("w"), F.col("bb") - F.col("b") ** 2 / F.col("w"), F.col("ab") - F.col("a") * F.col("b") / F.col("w")
    s = s.withColumns({"slope": F.try_divide(c, va), "r": F.try_divide(c, F.sqrt(va * vb))})
    return s.withColumns({"intercept": (F.col("b") - F.col("slope") * F.col("a")) / F.col("w"), "r2": F.col("r") ** 2}).select(*keys, "n", "slope", "intercept", "r", "r2")


def outliers(rows: DataFrame, key, values: list[str], threshold: float) -> DataFrame:
    """``rows`` with ``distance`` to their group's centroid and ``inside``: under a multiple of the root mean square distance."""
    keys = _keys(key)
    center = rows.groupBy(*keys).agg(*[F.avg(v).alias(f"__c{i}") for i, v in enumerate(values)], sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0])).alias("__v"))
    d = F.sqrt(sum(((F.col(v) - F.col(f"__c{i}")) ** 2 for i, v in enumerate(values) if i), (F.col(values[0]) - F.col("__c0")) ** 2))
    got = rows.join(center, keys).withColumn("distance", d).withColumn("inside", d < threshold * F.sqrt("__v"))
    return got.drop(*[c for c in got.columns if c.startswith("__")])


def histogram(rows: DataFrame, key, value: str, bins: int) -> DataFrame:
    """``(key, bin, low, high, n)`` of equal bins between each group's least and greatest, the last closed; empty ones left out."""
    keys = _keys(key)
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    width = (F.col("__b") - F.col("__a")) / bins
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(F.floor((F.col(value) - F.col("__a")) / width), F.lit(bins - 1))).cast("int")
    got = rows.join(ends, keys).withColumn("bin", b).groupBy(*keys, "bin", "__a", "__b").agg(F.count("*").alias("n"))
    return got.withColumns({"low": F.col("__a") + F.col("bin") * width, "high": F.col("__a") + (F.col("bin") + 1) * width}).select(*keys, "bin", "low", "high", "n")


def binned(rows: DataFrame, key, by: Column, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``(key, bin, center, n, mean, std)`` of a value by equal bins of another quantity, the last bin closed."""
    width = (high - low) / bins
    x = rows.withColumn("__x", by).where((F.col("__x") >= low) & (F.col("__x") <= high))
    x = x.withColumn("bin", F.least(F.floor((F.col("__x") - low) / width), F.lit(bins - 1)).cast("int"))
    return x.groupBy(*_keys(key), "bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("center", F.lit(low) + (F.col("bin") + 0.5) * width)


def sliding_window(rows: DataFrame, key, by: str, value: str, window: float, centers: list[float]) -> DataFrame:
    """``(key, center, n, mean, std)`` within half a window of each centre.

    Each row is sent to the centres it is near (a literal list), so the expansion is the overlap and there is no join.
    """
    near = F.filter(F.array(*[F.lit(float(c)) for c in centers]), lambda c: F.abs(F.col(by) - c) <= window / 2)
    x = rows.withColumn("center", F.explode(near))
    return x.groupBy(*_keys(key), "center").agg(F.count(_value(value)).alias("n"), F.avg(_value(value)).alias("mean"), F.stddev_pop(_value(value)).alias("std"))


def dprime(rows: DataFrame, key, group: str, value: str) -> DataFrame:
    """``(key, dprime)``: range of the group means over the pooled population standard deviation."""
    keys = _keys(key)
    each = rows.groupBy(*keys, group).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n"))
    return each.groupBy(*keys).agg(((F.max("m") - F.min("m")) / F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n"))).alias("dprime"))


def fdr(rows: DataFrame, key, p: str, name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: p m / rank, the least from its rank on, at most 1."""
    keys = _keys(key)
    w = Window.partitionBy(*keys)
    x = rows.withColumns({"__k": F.row_number().over(w.orderBy(p)), "__m": F.count(p).over(w)})
    down = w.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k")).over(down))).drop("__k", "__m")


def _whole(keys) -> Column:
    """The keys as one column; structs are equal where their fields are, nulls included."""
    return F.struct(*[F.col(c) for c in keys]) if keys else F.lit(0)


def placed(rows: DataFrame, key, value: str, **sums: Column) -> DataFrame:
    """A row for each value of a key (null: the least) with the named sums, each also over the key's smaller values (``name_below``) and all (``name_of``).

    Running sums go through two levels of blocks by the value's logarithm (2^-10 and 2^-32 of an octave), as a key may hold most rows:
    a task sorts at most 2^22 blocks of a level or the values of one block, some 2^21 doubles. Values that aren't numbers are one block.
    """
    keys, names = _keys(key), list(sums)
    x = F.col(value).cast("double") if any(rows.schema[value].dataType.typeName().startswith(t) for t in ("byte", "short", "int", "long", "float", "double", "decimal")) else F.lit(0.0)
    u = F.signum(x) * F.when(x == 0, 0.0).otherwise(F.least(F.log2(F.abs(x)) + 1100, F.lit(5000.0)))
    u = F.coalesce(F.when(F.isnan(x), F.lit(9000.0)).otherwise(u), F.lit(-9000.0))
    blocks = {"__b1": F.coalesce(F.floor(u * 2.0**10), F.lit(0)), "__b2": F.coalesce(F.floor(u * 2.0**32), F.lit(0))}
    each = rows.groupBy(_whole(keys).alias("__k"), value).agg(*[c.alias(n) for n, c in sums.items()]).withColumns(blocks)
    fine = each.groupBy("__k", "__b1", "__b2").agg(*[F.sum(n).alias(n) for n in names])
    coarse = fine.groupBy("__k", "__b1").agg(*[F.sum(n).alias(n) for n in names])

    def below(level: DataFrame, within: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return level.withColumns({f"{n}_below": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})

    def add(level: DataFrame, upper: DataFrame, on: list[str]) -> DataFrame:
        up = upper.select(*on, *[F.col(f"{n}_below").alias(f"__up_{n}") for n in names], *[f"{n}_of" for n in names])
        return level.join(up, on).withColumns({f"{n}_below": F.col(f"{n}_below") + F.col(f"__up_{n}") for n in names}).drop(*[f"__up_{n}" for n in names])

    top = below(coarse, ["__k"], "__b1").withColumns({f"{n}_of": F.sum(n).over(Window.partitionBy("__k")) for n in names})
    mid = add(below(fine, ["__k", "__b1"], "__b2"), top, ["__k", "__b1"])
    got = add(below(each, ["__k", "__b1", "__b2"], value), mid, ["__k", "__b1", "__b2"])
    return got.select(*[F.col(f"__k.{c}").alias(c) for c in keys], value, *names, *[f"{n}_below" for n in names], *[f"{n}_of" for n in names])


def midranks(rows: DataFrame, key, value: str, name: str = "midrank") -> DataFrame:
    """Average ranks from 1; ties share theirs. A key's rows are sorted in one task; sums of ranks go through ``placed``."""
    keys = _keys(key)
    w = Window.partitionBy(*keys)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def auc(rows: DataFrame, key, truth: str, score: str) -> DataFrame:
    """``(key, auc, variance)`` of a score for a 0/1 truth, DeLong's variance by midranks; null where a class has no row (variance: one row).

    Sums go over the values of the score, not the rows, and are exact integers.
    """
    keys = _keys(key)
    x = placed(rows, keys, score, __a=F.count("*"), **{f"__{k}": F.count(F.when(F.col(truth) == k, 1)) for k in (0, 1)})
    sums = []
    for own in ("__0", "__1"):
        place = 2 * (F.col("__a_below") - F.col(f"{own}_below")) + F.col("__a") - F.col(own)  # twice the rows of others below, ties half
        whole = place.cast("decimal(19,0)")
        s = F.col(own).cast("decimal(19,0)") * whole
        sums += [F.sum(own).alias(own), F.sum(s).alias(f"{own}s"), F.sum(s * whole).alias(f"{own}q")]
    got = x.groupBy(*keys).agg(*sums)

    def variance(own: str) -> Column:
        """Squares about the whole part of the mean, less what that part is off."""
        n, s, q = F.col(own).cast("decimal(19,0)"), F.col(f"{own}s"), F.col(f"{own}q")
        c = F.when(n > 0, F.expr(f"{own}s div {own}")).cast("decimal(19,0)")
        off = s - c * n
        return F.try_divide((q - c * off - c * s).cast("double") - F.try_divide((off * off).cast("double"), n.cast("double")), n.cast("double") - 1) / 4

    n, m = F.col("__0").cast("double"), F.col("__1").cast("double")
    area = F.try_divide(F.try_divide(F.col("__1s").cast("double") / 2, m), n)
    return got.select(*keys, area.alias("auc"), (F.try_divide(F.try_divide(variance("__1"), n * n), m) + F.try_divide(F.try_divide(variance("__0"), m * m), n)).alias("variance"))


def empirical_p(null: DataFrame, samples: DataFrame, key, value: str, sample: str, two_sided: bool = True) -> DataFrame:
    """``samples`` with the share of null values at least as extreme; by ranks in one union, with no pair of rows."""
    keys = _keys(key)
    both = null.select(*keys, F.col(value).alias("__x"), F.lit(True).alias("__null"), F.lit(None).cast("long").alias("__id"))
    mine = samples.withColumn("__id", F.monotonically_increasing_id())
    both = both.unionByName(mine.select(*keys, F.col(sample).alias("__x"), F.lit(False).alias("__null"), "__id"))
    up = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.unboundedPreceding, 0)
    x = both.withColumns({"__le": F.sum(F.col("__null").cast("long")).over(up), "__n": F.sum(F.col("__null").cast("long")).over(Window.partitionBy(*keys))})
    down = Window.partitionBy(*keys).orderBy(F.col("__x").desc()).rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__ge", F.sum(F.col("__null").cast("long")).over(down)).where("not __null")
    tail = F.least(F.lit(1.0), 2 * F.least("__le", "__ge") / F.col("__n")) if two_sided else F.col("__ge") / F.col("__n")
    return mine.join(x.select("__id", tail.alias("p")), "__id").drop("__id")


def confidence_interval(rows: DataFrame, key, value: str, bins: int, alpha: float = 0.025) -> DataFrame:
    """``(key, low, high)``: bin edges where the histogram's distribution function passes alpha and 1 - alpha."""
    keys = _keys(key)
    h = histogram(rows, keys, value, bins)
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy(*keys))
    h = h.withColumn("c", upto)
    return h.groupBy(*keys).agg(F.min(F.when(F.col("c") >= alpha, F.col("low"))).alias("low"), F.min(F.when(F.col("c") >= 1 - alpha, F.col("high"))).alias("high"))


def interval_overlap(low1, high1, low2, high2) -> Column:
    """Overlap of two intervals over the narrower one's width, 0 if they are apart."""
    shared = F.least(F.col(high1), F.col(high2)) - F.greatest(F.col(low1), F.col(low2))
    return F.greatest(F.lit(0.0), shared) / F.least(F.col(high1) - F.col(low1), F.col(high2) - F.col(low2))


def baseline(rows: DataFrame, key, t: str, value: str, t0: float, t1: float, name: str = "value") -> DataFrame:
    """A value less its group's mean over [t0, t1)."""
    keys = _keys(key)
    mean = rows.where((F.col(t) >= t0) & (F.col(t) < t1)).groupBy(*keys).agg(F.avg(value).alias("__b"))
    return rows.join(mean, keys, "left").withColumn(name, F.col(value) - F.col("__b")).drop("__b")


def max_erp(rows: DataFrame, key, t: str, value: str, t0: float, t1: float, scale: str | None = None) -> DataFrame:
    """``(key, peak, at)``: the signed value of largest size within [t0, t1), the earliest on ties.

    ``scale``: a column with the size of what went into a computed value; sizes closer than 1e-12 of it are ties, as they differ by rounding only.
    """
    x = rows.where((F.col(t) >= t0) & (F.col(t) < t1) & _value(value).isNotNull())
    size = F.abs(F.col(value))
    if scale is not None:
        w = Window.partitionBy(*_keys(key))
        x = x.withColumns({"__m": F.max(size).over(w), "__e": F.max(scale).over(w)})
        size = F.when(size >= F.col("__m") - 1e-12 * F.col("__e"), F.col("__m")).otherwise(size)
    best = F.max_by(F.struct(F.col(value).alias("peak"), F.col(t).alias("at")), F.struct(size, -F.col(t)))
    return x.groupBy(*_keys(key)).agg(best.alias("b")).select(*_keys(key), "b.*")


def zscore(rows: DataFrame, key, value: str, name: str = "z") -> DataFrame:
    keys = _keys(key)
    stat = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(stat, keys).withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def hash_uniform(*parts, seed: int = 0) -> Column:
    """A repeatable number in (0, 1) from the parts: the same for every run and any partitioning."""
    h = F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def random_blocks(trials: DataFrame, key, trial: str, n: int, seed: int = 0) -> DataFrame:
    """``trials`` with ``block``: disjoint random groups of ``n`` trials by key; what is left over has none."""
    keys = _keys(key)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_uniform(*keys, trial, seed=seed), trial))
    x = trials.withColumns({"__r": order - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    return x.withColumn("block", F.floor(F.col("__r") / n)).where(F.col("block") < F.floor(F.col("__n") / n)).drop("__r", "__n")


def bootstrap_means(trials: DataFrame, key, trial: str, value: str, n: int, rounds: int, seed: int = 0) -> DataFrame:
    """``(key, round, block, mean)`` of random blocks in each of a fixed number of rounds."""
    keys = _keys(key)
    x = trials.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return random_blocks(x, [*keys, "round"], trial, n, seed).groupBy(*keys, "round", "block").agg(F.avg(value).alias("mean"))


def stratified_sample(trials: DataFrame, key, trial: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` trials of each group, without replacement, in a repeatable random order; groups with fewer give all."""
    keys = _keys(key)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_uniform(*keys, trial, seed=seed), trial))
    return trials.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def pair_correlation(rows: DataFrame, key, item: str, at: str, value: str, weights: bool = False) -> DataFrame:
    """``(key, a, b, n, r)`` for all pairs of items a < b of a key, over the places both have.

    Pairs meet at equal places, so the join is as large as the result's sums; items are channels, maps or trials of one entry.
    """
    keys = _keys(key)
    x = rows.where(_value(value).isNotNull()).select(*keys, at, F.col(item).alias("a"), F.col(value).alias("x"))
    y = x.select(*keys, at, F.col("a").alias("b"), F.col("x").alias("y"))
    both = x.join(y, [*keys, at]).where("a < b")
    return both.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def ranked(rows: DataFrame, key, value: str) -> DataFrame:
    """``rows`` with the value replaced by its average rank within the key: Spearman's correlations are Pearson's of these."""
    return midranks(rows, key, value, "__rank").withColumn(value, F.col("__rank")).drop("__rank")


def correlation_over_distance(rows: DataFrame, places: DataFrame, key, item: str, at: str, value: str, bins: int = 20, most: float = 1.0, spearman: bool = True) -> DataFrame:
    """``(key, bin, center, n, r)``: mean absolute correlation of pairs of items by equal bins of their distance in (0, most].

    ``places(item, x, y)``; pairs at distance 0 are left out.
    """
    keys = _keys(key)
    r = pair_correlation(ranked(rows, [*keys, item], value) if spearman else rows, keys, item, at, value)
    a = places.select(F.col(item).alias("a"), F.col("x").alias("__ax"), F.col("y").alias("__ay"))
    b = places.select(F.col(item).alias("b"), F.col("x").alias("__bx"), F.col("y").alias("__by"))
    d = r.join(a, "a").join(b, "b").withColumn("__d", F.sqrt((F.col("__ax") - F.col("__bx")) ** 2 + (F.col("__ay") - F.col("__by")) ** 2))
    width = most / bins
    x = d.where((F.col("__d") > 0) & (F.col("__d") <= most)).withColumn("bin", F.least(F.floor(F.col("__d") / width), F.lit(bins - 1)).cast("int"))
    return x.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(F.abs("r")).alias("r")).withColumn("center", (F.col("bin") + 0.5) * width)


def random_timestamps(spark, n: int, start: float, end: float, samplerate: float | None = None, seed: int = 0) -> DataFrame:
    """``n`` repeatable uniform times in [start, end), or as many different samples of a grid, in order."""
    if samplerate is None:
        return spark.range(n).select((F.lit(start) + hash_uniform("id", seed=seed) * (end - start)).alias("t")).orderBy("t")
    grid = spark.range(int((end - start) * samplerate)).select((F.lit(start) + F.col("id") / samplerate).alias("t"), hash_uniform("id", seed=seed).alias("u"))
    return grid.orderBy("u").limit(n).select("t").orderBy("t")


def distances(points: DataFrame, key, item: str, x: str, y: str) -> DataFrame:
    """``(key, a, b, distance)`` of all pairs a < b of a key's points (the channels of one array)."""
    keys = _keys(key)
    a = points.select(*keys, F.col(item).alias("a"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    b = points.select(*keys, F.col(item).alias("b"), F.col(x).alias("__u"), F.col(y).alias("__v"))
    d = F.sqrt((F.col("__x") - F.col("__u")) ** 2 + (F.col("__y") - F.col("__v")) ** 2)
    return a.join(b, keys).where("a < b").select(*keys, "a", "b", d.alias("distance"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to 7 places (Abramowitz and Stegun 7.1.26)."""
    # Fixed values of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    erf = 1 - (((((a[4] * t + a[3]) * t) + a[2]) * t + a[1]) * t + a[0]) * t * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def wilcoxon(rows: DataFrame, key, difference: str, alternative: str = "two-sided") -> DataFrame:
    """``(key, n, w, z, p)``: signed rank test with the normal approximation, zeros left out, ties corrected."""
    keys = _keys(key)
    x = rows.where((F.col(difference) != 0) & _value(difference).isNotNull()).withColumn("__a", F.abs(difference))
    ties = placed(x, keys, "__a", __t=F.count("*"), __up=F.count(F.when(F.col(difference) > 0, 1)))
    ties = ties.withColumn("__w", F.col("__up") * (F.col("__t_below") + 1 + (F.col("__t") - 1) / 2.0))
    s = ties.groupBy(*keys).agg(F.sum("__t").alias("n"), F.sum("__w").alias("w"), F.sum(F.pow("__t", F.lit(3)) - F.col("__t")).alias("__c"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__c") / 48)
    s = s.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, sd))
    p = {"two-sided": 2 * normal_cdf(-F.abs(F.col("z"))), "greater": normal_cdf(-F.col("z")), "less": normal_cdf(F.col("z"))}[alternative]
    return s.withColumn("p", F.least(F.lit(1.0), F.coalesce(p, F.lit(1.0)))).select(*keys, "n", "w", "z", "p")
