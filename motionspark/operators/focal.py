"""Focal lengths of a zooming lens: taken from its rows, freed of steps, smoothed, and what that asks of the field of view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.operators import asof, series
from motionspark.operators import recurrence as R

BY = ("recording_id",)
# How near a lens row must be; the window against steps in seconds and its least rows; what a strength of 0 to 1 stands for.
NEAR_US, STEPS_S, LEAST_ROWS = 100_000, 0.5, 5


def constants(strength: float) -> tuple[float, float, float]:
    """(longest, shortest time constant in seconds, velocity at which the shortest holds)."""
    s = min(1.0, max(0.0, strength))
    return 0.1 * 300.0**s, 0.05 + 0.35 * s * s, 0.3 + 7.7 * s**1.5


def smooth_focal_lengths(frames: DataFrame, lens: DataFrame, fps: float, strength: float) -> DataFrame:
    """(recording_id, frame, focal_length, even, smoothed, compensation) of frames (recording_id, frame, ts_us).

    ``lens`` has (recording_id, ts_us, focal_length).  A frame has the focal length of the lens row nearest to it; ``even``
    is that without steps, ``smoothed`` follows it slowly.  The field of view grows by ``compensation``, 1 where nothing is known.
    """
    own = asof.nearest(frames.select(*BY, "frame", "ts_us"), lens.select(*BY, "ts_us", "focal_length"), "focal_length", NEAR_US)
    window = max(int(fps * STEPS_S + 0.5), LEAST_ROWS)
    even = series.gaussian_over_known(own, "focal_length", window, 1.0, out="even")
    run = lambda c: {"smoothed": R.adaptive_ema(c["even"].astype(float), fps, *constants(strength))}
    smoothed = R.per_recording(even, ["even"], run, ["smoothed"], on="frame").withColumn("smoothed", F.nanvl("smoothed", F.lit(None).cast("double")))
    known = (F.col("even") > 0) & (F.col("smoothed") > 0)
    ratio = F.coalesce(F.when(known, F.col("even") / F.when(known, F.col("smoothed"))), F.lit(1.0))
    return even.join(smoothed, [*BY, "frame"]).select(*BY, "frame", "focal_length", "even", "smoothed", ratio.alias("compensation"))
