"""Behaviour metrics: success, movement, tracking, gaze."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.geometry import rotation_between
from trialspark.operators.segments import _keys, trial_segments
from trialspark.operators.temporal import rolling_mean


def success_percent(trials: DataFrame, key, success: str) -> DataFrame:
    return trials.groupBy(*_keys(key)).agg(F.avg(F.col(success).cast("double")).alias("success_percent"))


def success_rate(trials: DataFrame, key, success: str, duration: str) -> DataFrame:
    """Successes over the summed time of the trials."""
    return trials.groupBy(*_keys(key)).agg((F.sum(F.col(success).cast("double")) / F.sum(duration)).alias("success_rate"))


def rolling_success(trials: DataFrame, key, order, success: str, window: int, duration: str | None = None) -> DataFrame:
    """Rolling share of successes, or with a duration the ratio of the rolling means."""
    x = trials.withColumn("__s", F.col(success).cast("double"))
    x = rolling_mean(x, key, order, "__s", window, name="rolling_success")
    if duration:
        x = rolling_mean(x, key, order, duration, window, name="__d").withColumn("rolling_success", F.col("rolling_success") / F.col("__d")).drop("__d")
    return x.drop("__s")


def segment_duration(events: DataFrame, key, order, event: str, time: str, start, end) -> DataFrame:
    return trial_segments(events, key, order, event, start, end, time).withColumn("duration", F.col("end_time") - F.col("start_time"))


def tracking_in_time(events: DataFrame, key, order, code: str, time: str, enter=80, leave=(81, 239, 48, 65)) -> DataFrame:
    """``(key, in_time, proportion)``: time from entering to leaving the target, and its share of the recording."""
    keys = _keys(key)
    seg = segment_duration(events, keys, order, code, time, [enter], list(leave)).groupBy(*keys).agg(F.sum("duration").alias("in_time"))
    span = events.groupBy(*keys).agg((F.max(time) - F.min(time)).alias("__s"))
    return span.join(seg, keys, "left").select(*keys, F.coalesce("in_time", F.lit(0.0)).alias("in_time"), F.try_divide(F.coalesce("in_time", F.lit(0.0)), F.col("__s")).alias("proportion"))


def path_length(points: DataFrame, key, order: str, axes: list[str]) -> DataFrame:
    """Sum of the steps' lengths of each trajectory."""
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) ** 2))
    return points.withColumn("__d", step).groupBy(*_keys(key)).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("path_length"))


def movement_stats(points: DataFrame, key, x: str, y: str, target_x: str, target_y: str) -> DataFrame:
    """Error of a trajectory across the line from the origin to its target: mean, spread and sum, signed and absolute."""
    size = F.sqrt(F.col(target_x) ** 2 + F.col(target_y) ** 2)
    off = (F.col(target_x) * F.col(y) - F.col(target_y) * F.col(x)) / size
    p = points.withColumn("__e", off)
    return p.groupBy(*_keys(key)).agg(F.avg("__e").alias("mean"), F.stddev_pop("__e").alias("std"), F.sum("__e").alias("total"), F.avg(F.abs("__e")).alias("abs_mean"), F.stddev_pop(F.abs("__e")).alias("abs_std"), F.sum(F.abs("__e")).alias("abs_total"), F.min("__e").alias("lowest"), F.max("__e").alias("highest"))


def movement_error(points: DataFrame, position: list[str], target: list[float], rotation=(1.0, 0.0), axis: int = 1, name: str = "error") -> DataFrame:
    """A component of positions after the rotation that takes the target's direction to ``rotation``."""
    m = rotation_between(target, rotation)
    return points.withColumn(name, sum((F.lit(float(m[axis][k])) * F.col(p) for k, p in enumerate(position) if k), F.lit(float(m[axis][0])) * F.col(position[0])))


def leave_time(points: DataFrame, key, i: str, axes: list[str], samplerate: float, target_radius: float, cursor_radius: float = 0.0) -> DataFrame:
    """First time farther from the origin than the target's radius less the cursor's; null if never."""
    r = F.sqrt(sum((F.col(a) ** 2 for a in axes[1:]), F.col(axes[0]) ** 2))
    return points.groupBy(*_keys(key)).agg((F.min(F.when(r > target_radius - cursor_radius, F.col(i))) / samplerate).alias("leave_time"))


def movement_onset(speed: DataFrame, key, t: str, value: str, base_from: str, base_to: str, search_from: str, sd: float = 3.0) -> DataFrame:
    """``(key, onset)``: first time from ``search_from`` on at which the speed is over mean + sd of its own trial's baseline."""
    keys = _keys(key)
    base = speed.where((F.col(t) >= F.col(base_from)) & (F.col(t) < F.col(base_to))).groupBy(*keys).agg((F.avg(value) + sd * F.stddev_pop(value)).alias("__thr"))
    return speed.join(base, keys).groupBy(*keys).agg(F.min(F.when((F.col(t) >= F.col(search_from)) & (F.col(value) > F.col("__thr")), F.col(t))).alias("onset"))


def tracking_error(points: DataFrame, key, user: list[str], target: list[str]) -> DataFrame:
    """Mean squared error of each axis."""
    return points.groupBy(*_keys(key)).agg(*[F.avg((F.col(u) - F.col(g)) ** 2).alias(f"mse_{u}") for u, g in zip(user, target, strict=True)])


def engagement(points: DataFrame, key, order: str, axes: list[str], samplerate: float, inactive: float = 1.0) -> DataFrame:
    """``points`` with ``engaged``: not within a still run of more than ``inactive`` seconds."""
    from trialspark.operators.runs import long_runs

    w = Window.partitionBy(*_keys(key)).orderBy(order)
    still = F.lit(True)
    for a in axes:
        still = still & (F.col(a) == F.lag(a).over(w))
    x = long_runs(points.withColumn("__still", still), key, order, F.col("__still"), int(inactive * samplerate), "__idle")
    return x.withColumn("engaged", ~F.col("__idle")).drop("__idle", "__still")


def saccade_target(saccades: DataFrame, targets: list[tuple[float, float]], x: str, y: str, radius: float, name: str = "target") -> DataFrame:
    """Index of the first of a list of targets within the radius, -1 if none."""
    col = F.lit(-1)
    for k in reversed(range(len(targets))):
        tx, ty = targets[k]
        col = F.when(F.sqrt((F.col(x) - tx) ** 2 + (F.col(y) - ty) ** 2) < radius, F.lit(k)).otherwise(col)
    return saccades.withColumn(name, col)


def relevant_saccade(saccades: DataFrame, key, idx: str, onset: str, offset: str, dist: str, target: str) -> DataFrame:
    """``(key, saccade)``: the largest saccade from the centre (0) to the trial's target, -1 if none."""
    hit = (F.col(onset) == 0) & (F.col(offset) == F.col(target))
    return saccades.groupBy(*_keys(key)).agg(F.coalesce(F.max_by(F.when(hit, F.col(idx)), F.when(hit, F.struct(F.col(dist), -F.col(idx)))), F.lit(-1)).alias("saccade"))


def eye_calibration(rows: DataFrame, key, eye: str, cursor: str) -> DataFrame:
    """``(key, slope, intercept, r)`` of the cursor on the eye at the samples given."""
    from trialspark.operators.stats import regression

    return regression(rows, key, eye, cursor).drop("n", "r2")
