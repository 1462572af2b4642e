"""Tuning curves, decoders and dimensionality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions import models
from trialspark.functions.geometry import TAU
from trialspark.operators.segments import _keys
from trialspark.workers import reachable


def modulation_depth(b1: Column, b2: Column) -> Column:
    return F.sqrt(b1 * b1 + b2 * b2)


def preferred_direction(b1: Column, b2: Column) -> Column:
    """Angle in [0, 2 pi) of the signed squares of the two coefficients (the reference's own rule)."""
    return F.pmod(F.atan2(F.signum(b2) * b2 * b2, F.signum(b1) * b1 * b1), F.lit(TAU))


def condition_means(rows: DataFrame, key, condition: str, value: str) -> DataFrame:
    """``(key, condition, n, mean, std)`` of all samples."""
    return rows.groupBy(*_keys(key), condition).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def anova(rows: DataFrame, key, condition: str, value: str) -> DataFrame:
    """``(key, f, between, within)``: one-way F by sums, and its degrees of freedom."""
    keys = _keys(key)
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, condition).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = F.col("b") - F.col("s") ** 2 / F.col("n")
    within = F.col("q") - F.col("b")
    return t.select(*keys, F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("between"), (F.col("n") - F.col("k")).alias("within"))


def tuning_fit(rates: DataFrame, key, degrees: str, rate: str, least: int = 3) -> DataFrame:
    """``(key, n, b1, b2, b3, depth, preferred)``: rate = b1 cos + b2 sin + b3 by least squares, from sums alone.

    Null coefficients with fewer than ``least`` conditions or none that tell the three apart.
    """
    keys = _keys(key)
    t = F.radians(degrees)
    x = rates.where(F.col(rate).isNotNull() & F.col(degrees).isNotNull()).withColumns({"c": F.cos(t), "s": F.sin(t), "y": F.col(rate)})
    m = x.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("cc", "cs", "ss", "cy", "sy")], *[F.sum(a).alias(a) for a in "csy"])
    n = F.col("n").cast("double")
    a, b, d = F.col("cc") - F.col("c") ** 2 / n, F.col("cs") - F.col("c") * F.col("s") / n, F.col("ss") - F.col("s") ** 2 / n
    p, q = F.col("cy") - F.col("c") * F.col("y") / n, F.col("sy") - F.col("s") * F.col("y") / n
    det = a * d - b * b
    ok = (n >= least) & (F.abs(det) > 1e-12)
    m = m.withColumns({"b1": F.when(ok, (p * d - q * b) / det), "b2": F.when(ok, (q * a - p * b) / det)})
    m = m.withColumn("b3", (F.col("y") - F.col("b1") * F.col("c") - F.col("b2") * F.col("s")) / n)
    return m.select(*keys, "n", "b1", "b2", "b3", modulation_depth(F.col("b1"), F.col("b2")).alias("depth"), preferred_direction(F.col("b1"), F.col("b2")).alias("preferred"))


def least_trials(trials: DataFrame, target: str) -> DataFrame:
    return trials.groupBy(target).count().agg(F.min("count").alias("least"))


def covariance(rows: DataFrame, key, columns: list[str]) -> tuple[list[dict], list[str]]:
    """Counts, means and covariances (population) of columns by key in one aggregate; as many rows as keys."""
    keys = _keys(key) if key else []
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return agg, pairs


def pca_dimensions(rows: DataFrame, columns: list[str], share: float = 0.9) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of components for a share of the variance, the shares and the components (rows); from one aggregate."""
    agg, pairs = covariance(rows, None, columns)
    r = agg.first()
    c = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
    value, vector = np.linalg.eigh(c)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
    shares = value / max(value.sum(), 1e-300)
    return int(np.searchsorted(np.cumsum(shares), share - 1e-12) + 1), shares, vector


def project(rows: DataFrame, columns: list[str], components: np.ndarray, means: list[float], names: list[str]) -> DataFrame:
    """Columns less their means on components, as expressions."""
    return rows.withColumns({n: sum((F.lit(float(w)) * (F.col(c) - float(m)) for w, c, m in zip(v[1:], columns[1:], means[1:], strict=True)), F.lit(float(v[0])) * (F.col(columns[0]) - float(means[0]))) for n, v in zip(names, components, strict=False)})


def task_relevant_dims(rows: DataFrame, neural: list[str], kinematic: list[str]) -> np.ndarray:
    """Regression of the neural columns on the kinematic ones and a constant (neural x kinematic), from one aggregate of products."""
    x = [*kinematic]
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j] + [F.sum(a).alias(f"x{i}_k") for i, a in enumerate(x)] + [F.count("*").alias("n")]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"y{i}_{j}") for i, a in enumerate(neural) for j, b in enumerate(x)] + [F.sum(a).alias(f"y{i}_k") for i, a in enumerate(neural)]
    r, k = rows.agg(*aggs).first(), len(x)
    m = np.zeros((k + 1, k + 1))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"x{i}_{j}"]
        m[i, k] = m[k, i] = r[f"x{i}_k"]
    m[k, k] = r["n"]
    y = np.array([[*[r[f"y{i}_{j}"] for j in range(k)], r[f"y{i}_k"]] for i in range(len(neural))])
    return (y @ np.linalg.pinv(m))[:, :k]


def lda_accuracy(rows: DataFrame, key, features: str, label: str, folds: int = 5, repeats: int = 3, seed: int = 1, shrink: float | str = "auto", order: str | None = None) -> DataFrame:
    """``(key, n, accuracy, std)``: repeated stratified cross-validation of a discriminant on array features; a task per key.

    A key is one entry, unit set or window: its trials fit a task.  ``order`` makes the folds repeatable.
    """
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order or label, kind="stable")
        acc = models.lda_cross_validate(np.stack(pdf[features].to_numpy()).astype(float), pdf[label].to_numpy(), folds, repeats, seed, shrink)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(pdf)], "accuracy": [float(np.mean(acc)) if acc else float("nan")], "std": [float(np.std(acc)) if acc else float("nan")]})

    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["n long, accuracy double, std double"])
    cols = list(dict.fromkeys([*keys, features, label, *([order] if order else [])]))
    return reachable(rows).select(*cols).groupBy(*keys).applyInPandas(run, schema)


def windowed_lda(samples: DataFrame, key, trial: str, t: str, channel: str, value: str, label: str, lags: int = 3, folds: int = 5, seed: int = 1) -> DataFrame:
    """``lda_accuracy`` of each sliding window of ``lags`` samples over all channels."""
    keys = _keys(key)
    x = samples.withColumn("window", F.explode(F.sequence(F.col(t) - lags + 1, F.col(t)))).where("window >= 0")
    last = samples.groupBy(*keys).agg(F.max(t).alias("__last"))
    x = x.join(last, keys).where(F.col("window") <= F.col("__last") - lags + 1)
    f = x.groupBy(*keys, "window", trial, label).agg(F.transform(F.sort_array(F.collect_list(F.struct(t, channel, value))), lambda s: s[value]).alias("features"))
    return lda_accuracy(f, [*keys, "window"], "features", label, folds, 1, seed, order=trial)


def factor_dimensions(rows: DataFrame, key, features: str, dims: list[int], folds: int = 5, order: str | None = None) -> DataFrame:
    """``(key, dim, score)``: cross-validated log-likelihood of factor models; a task per key and dimension."""
    keys = _keys(key)
    x = rows.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if order:
            pdf = pdf.sort_values(order)
        data, k = np.stack(pdf[features].to_numpy()).astype(float), int(pdf["dim"].iloc[0])
        fold = np.arange(len(data)) % folds
        score = [models.factor_score(data[fold == f], *models.factor_fit(data[fold != f], k)) for f in range(folds)]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "dim": [k], "score": [float(np.mean(score))]})

    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["dim int, score double"])
    return reachable(x).groupBy(*keys, "dim").applyInPandas(run, schema)


def cell_types(waves: DataFrame, key, unit: str, waveform: str, fs: float, seed: int = 0) -> DataFrame:
    """``(key, unit, width, kind)``: trough to peak of each unit's mean waveform and its class of two by a mixture; a task per key."""
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = pdf.groupby(unit)[waveform].apply(lambda w: np.stack(w.to_numpy()).mean(0))
        width = np.array([np.subtract(*models.trough_peak(w)[::-1]) / fs for w in mean])
        kind = models.mixture_fit(width[:, None] / max(width.std(), 1e-12), 2, seed=seed) if len(width) > 2 else np.zeros(len(width), int)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(mean) for k in keys}, unit: mean.index, "width": width, "kind": kind})

    schema = ", ".join(f"`{k}` {waves.schema[k].dataType.simpleString()}" for k in [*keys, unit]) + ", width double, kind int"
    return reachable(waves).select(*keys, unit, waveform).groupBy(*keys).applyInPandas(run, schema)


def kalman_states(rows: DataFrame, key, order: str, states: str, observations: str, train: str) -> DataFrame:
    """``(key, order, predicted)``: a filter fitted on a key's training rows runs over its other rows in sequence; a task per key."""
    keys = _keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = np.stack(pdf[states].to_numpy()).astype(float), np.stack(pdf[observations].to_numpy()).astype(float)
        t = pdf[train].to_numpy(bool)
        out = models.kalman_predict(models.kalman_fit(x[t], y[t]), y[~t], x[~t][0]) if (~t).any() and t.sum() > 2 else np.zeros((0, x.shape[1]))
        rest = pdf.loc[~t, [*keys, order]].iloc[: len(out)].copy()
        rest["predicted"] = list(out)
        return rest

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, order]) + ", predicted array<double>"
    return reachable(rows).select(*keys, order, states, observations, train).groupBy(*keys).applyInPandas(run, schema)
