"""The horizon held by gravity, and its tilt into turns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import recurrence as R

BY = ("recording_id",)


@dataclass
class Tilt:
    """Rates below ``threshold`` (degrees a second) do not tilt; others do by ``multiplier`` seconds of them, ``limit`` degrees a second at most."""

    threshold: float = 5.0
    smoothing_ms: float = 500.0
    multiplier: float = 1.0
    limit: float = float("inf")


def _share(dt: float, tau: float) -> float:
    return 1.0 if tau <= 0 else min(1.0, max(0.0, dt / (tau + dt)))


def turn_rates(heading: np.ndarray, t: np.ndarray, tau: float) -> np.ndarray:
    """Smoothed rate of the heading (radians at microseconds) in degrees a second; nan where no step of less than a second leads."""
    out, state = np.full(len(t), np.nan), None
    for i in range(1, len(t)):
        dt = (t[i] - t[i - 1]) / 1e6
        if 0 < dt < 1:
            step = np.degrees(heading[i] - heading[i - 1])
            rate = (step - 360 * np.ceil((step - 180) / 360) if abs(step) > 180 else step) / dt
            state = rate if state is None else state + (rate - state) * (1.0 if tau <= 0 else dt / (tau + dt))
            out[i] = state
    return out


def tilts(rates: np.ndarray, t: np.ndarray, tilt: Tilt) -> np.ndarray:
    """Degrees by which the horizon leans, from one sample to the next."""
    target = np.where(np.abs(np.nan_to_num(rates)) > tilt.threshold, np.nan_to_num(rates) * tilt.multiplier, 0.0)
    out, state = np.empty(len(t)), None
    for i, goal in enumerate(target):
        if state is None:
            state = goal
        else:
            dt = (t[i] - t[i - 1]) / 1e6
            change = (goal - state) * _share(dt, tilt.smoothing_ms / 1000)
            state += float(np.clip(change, -tilt.limit * dt, tilt.limit * dt)) if dt > 0 and np.isfinite(tilt.limit) else change
        out[i] = state
    return out


def dynamic_tilt(df: DataFrame, tilt: Tilt) -> DataFrame:
    """(recording_id, ts_us, tilt_deg) of the orientations ``q``."""
    heading = df.select(*BY, "ts_us", F.col("q"), Q.to_euler(F.col("q"))["yaw"].alias("heading"))
    run = lambda c: {"tilt_deg": tilts(turn_rates(c["heading"].astype(float), c["ts_us"], tilt.smoothing_ms / 1000), c["ts_us"], tilt)}
    return R.per_recording(heading, ["heading"], run, ["tilt_deg"])


def lock_to_gravity(df: DataFrame, percent: float, roll_deg: float = 0.0) -> DataFrame:
    """``q`` (smoothed) turned about its z axis until the horizon of ``original`` is level by ``gravity`` struct<x, y, z>, blended in by ``percent``.

    Without gravity the camera stands upright.
    """

    def locked(v):
        c = Q.multiply(Q.conjugate(v["o"]), v["q"])

        def about(c):
            lean = F.atan2(2 * (c["w"] * c["z"] - c["x"] * c["y"]), 1 - 2 * (c["y"] * c["y"] + c["z"] * c["z"]))
            gravity = F.coalesce(F.atan2(v["g"]["x"], v["g"]["y"]), F.lit(0.0))
            return Q.slerp(Q.multiply(v["q"], Q.from_axis_angle("z", gravity - lean + F.radians(F.lit(roll_deg)))), v["q"], F.lit(1 - percent / 100))

        return Q.let(c, about)

    return df.withColumn("q", Q.let(F.struct(F.col("q").alias("q"), F.col("original").alias("o"), F.col("gravity").alias("g")), locked))
