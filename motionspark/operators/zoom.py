"""Adaptive zoom: frame FOVs to a smooth zoom curve."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.operators import series

BY = ("recording_id",)


def outside_takes_max(frames: DataFrame, ranges: Sequence[tuple[float, float]], fov: str = "fov") -> DataFrame:
    """Frames outside all ranges (shares of the frame count, rounded outwards) get the largest FOV."""
    if not ranges:
        return frames
    p = Window.partitionBy(*BY)
    last = F.count(F.lit(1)).over(p) - 1
    inside = reduce(lambda a, b: a | b, [F.col("frame").between(F.floor(last * F.lit(float(lo))), F.ceil(last * F.lit(float(hi)))) for lo, hi in ranges])
    return frames.withColumn(fov, F.when(inside, F.col(fov)).otherwise(F.max(fov).over(p)))


def follow_envelope(x: np.ndarray, alpha: float) -> np.ndarray:
    """min(x, x a + q (1 - a)) backwards, then forwards."""
    for step in (-1, 1):
        y, q = x[::step].copy(), x[::step][0]
        for i, v in enumerate(y):
            q = min(v, v * alpha + q * (1 - alpha))
            y[i] = q
        x = y[::step]
    return x


def envelope_zoom(frames: DataFrame, fps: float, window_s: float, second_s: float = 0.2, fov: str = "fov") -> DataFrame:
    """(recording_id, frame, zoom): never above the frame's FOV; one recording is one ordered recurrence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = pdf[fov].to_numpy(float)
        for tau in (window_s, second_s):
            x = follow_envelope(x, 1 - math.exp(-(1 / fps) / tau))
        return pdf[["recording_id", "frame"]].assign(zoom=x)

    return frames.select("recording_id", "frame", fov).groupBy(*BY).applyInPandas(run, "recording_id long, frame long, zoom double")


def zoom_curve(frames: DataFrame, fps: float, window_s: float, method: str = "envelope", fov: str = "fov") -> DataFrame:
    """Below -0.9 s one zoom for all frames; above 0.0001 s a moving one; else none."""
    if window_s < -0.9:
        return frames.select(*BY, "frame", F.min(fov).over(Window.partitionBy(*BY)).alias("zoom"))
    if window_s <= 1e-4:
        return frames.select(*BY, "frame", F.lit(1.0).alias("zoom"))
    if method == "envelope":
        return envelope_zoom(frames, fps, window_s, fov=fov)
    n = int(round(window_s * fps)) | 1
    m = series.rolling_min(frames.select(*BY, "frame", fov), fov, n)
    return series.convolve(m, "rolling_min", series.gaussian(n, n / 6), out="zoom").select(*BY, "frame", "zoom")
