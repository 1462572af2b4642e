"""The driver's tables as the engine's: event streams, samples, trials, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, user_id, us, event_type, value, props``; ``us``: microseconds since 1970, whatever the session's time zone."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if dict(e.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")
    return e.select("event_id", "user_id", us.alias("us"), "event_type", "value", "props")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, i, us, event_type, value``: each user's events as a regular series by position."""
    from trialspark.operators.segments import numbered

    return numbered(events(spark, sf), "user_id", ["us", "event_id"]).withColumn("i", F.col("i").cast("long"))


def dims(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, label, k, v``: embeddings as trials of 64 samples."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).select("vec_id", "label", "k", F.col("x").cast("double").alias("v"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, label, x, y``: the first two components."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: SQL of the same views.
E_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value, props FROM events)"
S_SQL = E_SQL + ", s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM e)"
D_SQL = "d AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
P_SQL = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
