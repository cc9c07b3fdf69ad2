"""Telemetry views of the driver's tables, and the same views as SQL.

A user is a recording, its events are the samples; purchases are sync offsets, sign-ups keyframes and views
lens rows.  Time constants are scaled to events that lie hours apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = lambda x: F.when(F.col("event_type") != "error", x)
    return e.select(
        F.col("user_id").alias("recording_id"), F.col("event_id").alias("seq"), micros("ts").alias("ts_us"),
        g(F.col("value")).alias("gx"), g(F.col("value") * 0.5 - F.col("event_id") % 17).alias("gy"), g((F.col("event_id") % 29 - 14).cast("double")).alias("gz"),
        (F.col("event_id") % 7 - 3).cast("double").alias("ax"), (F.col("event_id") % 5 - 2).cast("double").alias("ay"), F.lit(9.81).alias("az"),
    )


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("recording_id"), micros("ts").alias("ts_us"), F.col("event_id").alias("seq"), "value")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "purchase").select("recording_id", "ts_us", (F.col("seq") % 11 - 5).cast("double").alias("offset_ms"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("seq") % 2 == 0, "Fov").otherwise("ZoomingSpeed")
    easing = F.get(F.array(*(F.lit(x) for x in ("NoEasing", "EaseIn", "EaseOut", "EaseInOut"))), (F.col("seq") % 4).cast("int"))
    return _kind(spark, sf_dir, "signup").select("recording_id", "ts_us", kind.alias("type"), "value", easing.alias("easing"))


def lens_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "view").select("recording_id", "ts_us", F.col("value").alias("focal_length"))


def quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit quaternions from vectors: 50 a recording, 20 ms apart."""
    e = table(spark, sf_dir, "embeddings")
    x = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2] + x[3] * x[3])
    return e.select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("recording_id"), ((F.col("vec_id") % 50) * 20_000).alias("ts_us"),
        F.struct(*((v / n).alias(c) for v, c in zip(x, "wxyz", strict=True))).alias("q"),
    )


IMU_SQL = """imu AS (SELECT user_id AS recording_id, event_id AS seq, epoch_us(ts) AS ts_us,
  CASE WHEN event_type <> 'error' THEN value END AS gx, CASE WHEN event_type <> 'error' THEN value * 0.5::DOUBLE - event_id % 17 END AS gy,
  CASE WHEN event_type <> 'error' THEN (event_id % 29 - 14)::DOUBLE END AS gz,
  (event_id % 7 - 3)::DOUBLE AS ax, (event_id % 5 - 2)::DOUBLE AS ay, 9.81::DOUBLE AS az FROM events)"""
OFFSETS_SQL = "offsets AS (SELECT user_id AS recording_id, epoch_us(ts) AS ts_us, (event_id % 11 - 5)::DOUBLE AS offset_ms FROM events WHERE event_type = 'purchase')"
KEYFRAMES_SQL = """keyframes AS (SELECT user_id AS recording_id, epoch_us(ts) AS ts_us, CASE WHEN event_id % 2 = 0 THEN 'Fov' ELSE 'ZoomingSpeed' END AS type,
  value, (['NoEasing', 'EaseIn', 'EaseOut', 'EaseInOut'])[event_id % 4 + 1] AS easing FROM events WHERE event_type = 'signup')"""
LENS_SQL = "lens AS (SELECT user_id AS recording_id, epoch_us(ts) AS ts_us, value AS focal_length FROM events WHERE event_type = 'view')"
QUATS_SQL = """raw AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
quats AS (SELECT vec_id // 50 AS recording_id, (vec_id % 50) * 20000 AS ts_us, a / n AS w, b / n AS x, c / n AS y, d / n AS z
  FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM raw))"""
