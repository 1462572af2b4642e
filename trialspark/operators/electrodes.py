"""Channel and electrode maps: joins with layout tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, path: DataFrame, column: str, source: str, target: str, name: str, zero_index: bool = True) -> DataFrame:
    """``rows`` with the layout's target for their (zero-based) source; -1 where there is none."""
    first = path.groupBy(F.col(source).alias("__s")).agg(F.min(target).alias("__t"))
    shift = 1 if zero_index else 0
    got = rows.join(first, F.col(column) + shift == F.col("__s"), "left")
    return got.withColumn(name, F.coalesce("__t", F.lit(0)) - shift).drop("__s", "__t")


def connected(path: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Rows of the signal path with a channel, of the given ``channels(acq)`` if any."""
    got = path.where("acq is not null")
    return got.join(channels.select("acq").distinct(), "acq", "left_semi") if channels is not None else got


def electrodes_to_channels(electrodes: DataFrame, path: DataFrame, order: str) -> DataFrame:
    """Electrodes in their own order with their channel, null if unconnected."""
    return electrodes.join(path.select("electrode", "acq"), "electrode", "left").orderBy(order)


def positions(path: DataFrame, layout: DataFrame, theta: float = 0.0, offset=(0.0, 0.0), x: str = "topdown_x", y: str = "topdown_y") -> DataFrame:
    """Connected channels with their electrode's place, rotated by theta degrees about the offset."""
    c, s = math.cos(math.radians(theta)), math.sin(math.radians(theta))
    u, v = F.col(x) - offset[0], F.col(y) - offset[1]
    return connected(path).join(layout, "electrode").withColumns({"x": c * u - s * v + offset[0], "y": s * u + c * v + offset[1]})


def near_site(channels: DataFrame, site_x: float, site_y: float, radius: float | tuple[float, float]) -> DataFrame:
    """Channels closer to a site than a radius, or within [low, high)."""
    d = F.sqrt((F.col("x") - site_x) ** 2 + (F.col("y") - site_y) ** 2)
    inside = (d >= radius[0]) & (d < radius[1]) if isinstance(radius, tuple) else d < radius
    return channels.withColumn("distance", d).where(inside)


def data_map(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """``(row, column, x, y, value)``: places as cells of the grid of their distinct coordinates, holes left out."""
    r = rows.select(F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.col(value).alias("value")).groupBy("x", "y").agg(F.first("value").alias("value"))
    cols = r.select("x").distinct().withColumn("column", F.row_number().over(Window.orderBy("x")) - 1)
    lines = r.select("y").distinct().withColumn("row", F.row_number().over(Window.orderBy("y")) - 1)
    return r.join(cols, "x").join(lines, "y").select("row", "column", "x", "y", "value")


def nearest_map(rows: DataFrame, x: str, y: str, value: str, width: int, height: int, extent: tuple[float, float, float, float], most: float | None = None, limit: int = 100_000) -> DataFrame:
    """``(row, column, value)`` on a regular grid: the value at the nearest place, null beyond ``most`` from any.

    The places of one array, ``limit`` at most, become one literal list; the grid is distributed.
    """
    got = rows.select(x, y, value).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} places")
    spark = rows.sparkSession
    x0, x1, y0, y1 = extent
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("column"))
    gx = F.lit(x0) + F.col("column") * ((x1 - x0) / max(1, width - 1))
    gy = F.lit(y0) + F.col("row") * ((y1 - y0) / max(1, height - 1))
    places = F.array(*[F.struct(F.lit(float(r[0])).alias("x"), F.lit(float(r[1])).alias("y"), F.lit(float(r[2])).alias("v")) for r in got])
    best = F.array_min(F.transform(places, lambda p: F.struct(F.sqrt((p["x"] - gx) ** 2 + (p["y"] - gy) ** 2).alias("d"), p["v"].alias("v"))))
    return grid.withColumn("__b", best).select("row", "column", (F.when(F.col("__b.d") <= most, F.col("__b.v")) if most is not None else F.col("__b.v")).alias("value"))
