"""Stimulation pulses: gains, sensors, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys
from trialspark.operators.temporal import asof, nearest


def calibrate_gain(gain: Column, table: list[tuple[float, float]], peak: Column | float) -> Column:
    """Power of a gain: linear between a calibration table's points (gain, share of peak), clamped at the ends."""
    table = sorted(table)
    out = F.lit(float(table[-1][1]))
    for (g0, p0), (g1, p1) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(gain < g1, F.lit(float(p0)) + (gain - g0) * ((p1 - p0) / (g1 - g0))).otherwise(out)
    return F.when(gain <= table[0][0], F.lit(float(table[0][1]))).otherwise(out) * peak


def calibrate_sensor(volts: Column, slope: float, offset: float) -> Column:
    return volts * slope + offset


def match_pulses(commanded: DataFrame, sensed: DataFrame, key, t: str, width: str, radius: float = 0.015, width_tolerance: float = 0.001) -> DataFrame:
    """Commanded pulses with their sensed onset within the radius; its width replaces theirs if they differ by more than the tolerance."""
    got = nearest(commanded, sensed.withColumnRenamed("on", "__on").withColumn("__w", F.col("off") - F.col("__on")), key, t, "__on", radius, ["__w"])
    far = F.abs(F.col("__w") - F.col(width)) > width_tolerance
    return got.withColumns({"found": F.col("match_time").isNotNull(), "sensed_time": F.col("match_time"), "true_width": F.when(far, F.col("__w")).otherwise(F.col(width))}).drop("__w", "match_time")


def switch_site(triggers: DataFrame, switches: DataFrame, key, t: str, switch_t: str, channel: str) -> DataFrame:
    """Channel of the optical switch at each trigger, null where it is off (0 or less) or unset."""
    got = asof(triggers, switches, _keys(key), t, switch_t, [channel]).drop("match_time")
    return got.withColumn(channel, F.when(F.col(channel) > 0, F.col(channel)))
