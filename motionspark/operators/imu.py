"""Projections of IMU samples: bias, axes, rotation, frames and timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BY = ("recording_id",)


def add_bias(df: DataFrame, columns: Sequence[str], bias: Sequence[float]) -> DataFrame:
    return df.withColumns({c: F.col(c) + b for c, b in zip(columns, bias, strict=True)})


def remap_axes(df: DataFrame, columns: Sequence[str], code: str) -> DataFrame:
    """A letter for each axis names its source; lower case negates it."""
    source = dict(zip("XYZ", columns, strict=True))
    new = [F.col(source[c.upper()]) * (1 if c.isupper() else -1) for c in code]
    return df.withColumns(dict(zip(columns, new, strict=True)))


def rotate(df: DataFrame, columns: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    new = [sum((F.col(c) * m for c, m in zip(columns[1:], row[1:], strict=True)), F.col(columns[0]) * row[0]) for row in matrix]
    return df.withColumns(dict(zip(columns, new, strict=True)))


def transform_imu(df: DataFrame, bias=None, code: str | None = None, matrix=None, acc_matrix=None, gyro=("gx", "gy", "gz"), acc=("ax", "ay", "az")) -> DataFrame:
    """Bias, then axes, then rotation, of both sensors; steps that are not set are left out of the plan."""
    for columns, m in ((gyro, matrix), (acc, acc_matrix or matrix)):
        df = add_bias(df, columns, bias) if bias else df
        df = remap_axes(df, columns, code) if code and code != "XYZ" else df
        df = rotate(df, columns, m) if m else df
    return df


def frame_to_ms(frame: Column, fps: Column) -> Column:
    return frame * 1000.0 / fps


def ms_to_frame(ms: Column, fps: Column) -> Column:
    """Rounds half away from zero."""
    return F.round(ms * fps / 1000.0).cast("long")


def readout(ms: Column) -> tuple[Column, Column]:
    """(direction, milliseconds): the sign and a shift of 10000 encode four directions; 0 is an unknown time."""
    sideways = F.abs(ms) > 10_000
    size = F.when(sideways, F.abs(ms) - 10_000).when(ms != 0, F.abs(ms))
    way = F.when(sideways & (ms < 0), "RightToLeft").when(sideways, "LeftToRight").when(ms < 0, "BottomToTop").otherwise("TopToBottom")
    return way, size


def output_size(width: Column, height: Column, wanted_width: Column, wanted_height: Column, rotation: Column) -> Column:
    """struct<w, h>: the wanted size as large as fits into the recorded one, even; the recorded sides swap at quarter turns."""
    turned = F.abs(rotation).isin(90, 270)
    own_w, own_h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    scale = F.least(own_w / wanted_width, own_h / wanted_height)
    even = lambda v: (F.floor(F.round(v * scale) / 2) * 2).cast("int")
    return F.when((wanted_width > 0) & (wanted_height > 0), F.struct(even(wanted_width).alias("w"), even(wanted_height).alias("h")))


def diagonal_fov(width: Column, height: Column, fy: Column) -> Column:
    """Degrees."""
    return F.degrees(2 * F.atan(F.sqrt(width * width + height * height) / (2 * fy)))


def map_range(x: Column, in_lo: float, in_hi: float, out_lo: float, out_hi: float) -> Column:
    return (x - in_lo) / (in_hi - in_lo) * (out_hi - out_lo) + out_lo


def sample_rate(df: DataFrame, on: str = "ts_us") -> DataFrame:
    """(recording_id, n, rate): samples a second, the last one counted as long as the others; null for up to two."""
    n, span = F.count(F.lit(1)), (F.max(on) - F.min(on)) / F.lit(1e6)
    rate = F.when((n > 2) & (span > 0), n / F.when(span > 0, span * (n + 1) / n))
    return df.groupBy(*BY).agg(n.alias("n"), rate.alias("rate"))


def repaired_duration(df: DataFrame, known_ms: str, on: str = "ts_us") -> DataFrame:
    """The samples' own duration where it is positive and differs from the known one by more than 0.01 ms."""
    n = F.count(F.lit(1))
    own = (F.max(on) - F.min(on)) / F.lit(1e3) * (n + 1) / n
    got = df.groupBy(*BY).agg(own.alias("_own"), F.first(known_ms).alias("_known"))
    return got.select(*BY, F.when((F.abs(F.col("_own") - F.col("_known")) > 0.01) & (F.col("_own") > 0), F.col("_own")).otherwise(F.col("_known")).alias("duration_ms"))


def find_bias(df: DataFrame, from_us: int, to_us: int, columns=("gx", "gy", "gz"), on: str = "ts_us") -> DataFrame:
    """Minus the mean inside the open range; 0 without samples."""
    inside = df.where((F.col(on) > from_us) & (F.col(on) < to_us))
    means = inside.groupBy(*BY).agg(*((-F.avg(c)).alias(f"bias_{c}") for c in columns))
    return df.select(*BY).distinct().join(means, list(BY), "left").na.fill(0.0)


def last_writer(df: DataFrame, on: str = "ts_us", order: str = "seq") -> DataFrame:
    """One row per key: the last written."""
    w = Window.partitionBy(*BY, on).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scaled_time(fps: Column, duration_ms: Column, scale: Column) -> tuple[Column, Column]:
    """(frames a second, duration) of footage shown at another speed; no scale leaves both."""
    by = F.coalesce(scale, F.lit(1.0))
    return fps * by, duration_ms / F.when(by != 0, by)


def effective_fov(scale: Column, fov: Column, last: Column, count: Column, width: Column, output_width: Column) -> Column:
    """FOV of a frame: its own, else the last one of several, else 1, times the scale, at least 0.001, by how much of the width the output has."""
    own = F.coalesce(fov, F.when(count > 1, last), F.lit(1.0))
    return F.greatest(own * scale, F.lit(0.001)) * width / F.greatest(output_width, F.lit(1))
