"""Smoothing of orientations: plain, velocity-dampened, fixed, horizon lock."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import recurrence as R

BY = ("recording_id",)
FASTEST = 500.0  # degrees a second at smoothness 1


def max_angles(raw: DataFrame, smooth: DataFrame, where=None) -> DataFrame:
    """(recording_id, pitch, yaw, roll): largest Euler angles of the correction, in degrees."""
    both = raw.select(*BY, "ts_us", F.col("q").alias("a")).join(smooth.select(*BY, "ts_us", F.col("q").alias("b")), [*BY, "ts_us"])
    both = both.where(where) if where is not None else both
    e = both.select(*BY, Q.to_euler(Q.multiply(Q.conjugate(F.col("a")), F.col("b"))).alias("e"))
    return e.groupBy(*BY).agg(*(F.max(F.abs(F.degrees(F.col(f"e.{c}")))).alias(c) for c in ("pitch", "yaw", "roll")))


def quaternions(df: DataFrame, f: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], extra: Sequence[str] = (), on: str = "ts_us") -> DataFrame:
    """(recording_id, key, q) with ``f`` of each recording's ordered quaternions and extra columns."""
    flat = df.select(*BY, on, *(F.col(f"q.{c}").alias(c) for c in "wxyz"), *extra)

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        q = f(np.column_stack([c[k] for k in "wxyz"]).astype(float), c)
        return dict(zip("wxyz", q.T, strict=True))

    out = R.per_recording(flat, [*"wxyz", *extra], run, list("wxyz"), on)
    return out.select(*BY, on, F.struct(*"wxyz").alias("q"))


def smooth_plain(df: DataFrame, time_constant_s: float, rate: float) -> DataFrame:
    """Spherical exponential average in both directions."""
    a = R.alpha(time_constant_s, rate) if time_constant_s > 0 else 1.0
    return quaternions(df, lambda q, _: R.slerp_ema(q, a))


def dampened(q: np.ndarray, rate: float, smoothness: float = 0.5, longest_s: float = 1.0, shortest_s: float = 0.1, fov_ratio: float = 1.0, second_pass: bool = True) -> np.ndarray:
    """Smooths still stretches more than moving ones.

    The time constant falls from ``longest_s`` to ``shortest_s`` as the smoothed velocity rises to the
    fastest that the smoothness allows.  A second pass takes it down where the first one went far from the
    original; a series without any distance keeps the first pass (there the ratio has no value).
    """
    slow, fast = R.alpha(longest_s, rate), R.alpha(shortest_s, rate)
    top = FASTEST * smoothness * fov_ratio * (0.5 if second_pass else 1.0)
    velocity = np.concatenate([[0.0], np.degrees(R.turn(R.product(R.inverse(q[:-1]), q[1:]))) * rate])
    ratio = R.ema(velocity, fast) / top
    once = R.slerp_ema(q, slow * (1 - ratio) + fast * ratio)
    if not second_pass:
        return once
    distance = R.turn(R.product(R.inverse(q), once))
    if not distance.max() > 0:
        return once
    distance = distance / distance.max()
    distance = R.ema(np.where(distance < 0.5, 0.0, distance), fast)
    if distance.max() > 0:
        distance = distance / distance.max()
    ratio = ratio * (distance + 1) / 2
    return R.slerp_ema(q, slow * (1 - ratio) + fast * ratio)


def smooth_dampened(df: DataFrame, rate: float, allowance: str | None = None, **params: float) -> DataFrame:
    """``allowance`` names a column of each sample's share of the velocity that the smoothness allows."""
    if allowance is None:
        return quaternions(df, lambda q, _: dampened(q, rate, **params))
    return quaternions(df, lambda q, c: dampened(q, rate, **params | {"fov_ratio": params.get("fov_ratio", 1.0) * c[allowance].astype(float)}), [allowance])


def _turn(axis: str, degrees: float):
    return Q.from_axis_angle(axis, F.radians(F.lit(float(degrees))))


def _chain(*turns):
    out = turns[0]
    for t in turns[1:]:
        out = Q.let(F.struct(out.alias("a"), t.alias("b")), lambda v: Q.multiply(v["a"], v["b"]))
    return out


def fixed_orientation(roll: float, pitch: float, yaw: float):
    """Pan, then tilt, then roll of the body, from a camera that looks ahead."""
    return _chain(_turn("z", yaw), _turn("x", pitch), _turn("y", roll + 90), _turn("z", 90), _turn("y", 90))


def smooth_fixed(df: DataFrame, roll: float, pitch: float, yaw: float) -> DataFrame:
    """A camera that looks one way; angles in degrees."""
    return df.withColumn("q", fixed_orientation(roll, pitch, yaw))


def lock_horizon(df: DataFrame, percent: float, roll_deg: float = 0.0, pitch_deg: float | None = None) -> DataFrame:
    """Rebuilds each orientation from where its z axis points, with the given roll, blended in by ``percent``.

    With ``pitch_deg`` the pitch is locked to it as well.
    """

    def level(q):
        ahead = Q.rotate(q, F.lit(0.0), F.lit(0.0), F.lit(1.0))

        def built(v):
            pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -v["z"]))) if pitch_deg is None else F.radians(F.lit(float(pitch_deg)))
            return _chain(_turn("y", 90), _turn("z", 90), Q.from_axis_angle("y", F.atan2(v["y"], v["x"])), Q.from_axis_angle("x", pitch), _turn("z", roll_deg))

        return Q.let(F.struct(q.alias("q"), Q.let(ahead, built).alias("l")), lambda v: Q.slerp(v["l"], v["q"], F.lit(1 - percent / 100.0)))

    return df.withColumn("q", level(F.col("q")))


def correction(raw: DataFrame, smooth: DataFrame) -> DataFrame:
    """smooth^-1 raw at each key."""
    both = raw.join(smooth.select(*BY, "ts_us", F.col("q").alias("_s")), [*BY, "ts_us"])
    return both.withColumn("q", Q.multiply(Q.conjugate(F.col("_s")), F.col("q"))).drop("_s")


def with_rotation(df: DataFrame, x=0.0, y=0.0, z=0.0) -> DataFrame:
    """Each orientation turned further by angles in degrees, columns or numbers: yaw ``x``, pitch ``y`` and roll ``z`` of the view."""
    a, b, c = (F.radians(v if isinstance(v, Column) else F.lit(float(v))) for v in (x, y, z))
    return df.withColumn("q", Q.let(F.struct(F.col("q").alias("q"), Q.from_euler(b, a, c).alias("e")), lambda v: Q.multiply(v["q"], v["e"])))


def stabilise(raw: DataFrame, algorithm: str, rate: float, rotation=(0.0, 0.0, 0.0), lock: Callable[[DataFrame], DataFrame] | None = None, **params) -> DataFrame:
    """(recording_id, ts_us, q, smoothed): the correction that takes each orientation to its smoothed one.

    The view's own rotation comes first, then the horizon's lock, then the smoothing.
    """
    turned = with_rotation(raw.select(*BY, "ts_us", "q"), *rotation)
    smoothed = smooth(lock(turned) if lock else turned, algorithm, rate, **params).select(*BY, "ts_us", F.col("q").alias("smoothed"))
    both = raw.select(*BY, "ts_us", "q").join(smoothed, [*BY, "ts_us"])
    return both.withColumn("q", Q.multiply(Q.conjugate(F.col("smoothed")), F.col("q")))


# name -> (DataFrame, rate) -> DataFrame; others can be added.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "none": lambda df, rate: df,
    "plain": lambda df, rate, time_constant_s=0.25: smooth_plain(df, time_constant_s, rate),
    "dampened": smooth_dampened,
    "fixed": lambda df, rate, roll=0.0, pitch=0.0, yaw=0.0: smooth_fixed(df, roll, pitch, yaw),
}


def smooth(df: DataFrame, algorithm: str, rate: float, **params) -> DataFrame:
    return ALGORITHMS.get(algorithm, ALGORITHMS["none"])(df, rate, **params)


def lowpass_quats(df: DataFrame, cut_hz: float, rate: float) -> DataFrame:
    """Butterworth low-pass of the components, unit length restored after each direction."""
    k = R.biquad_lowpass(cut_hz, rate)

    def run(q: np.ndarray, _: dict) -> np.ndarray:
        for step in (1, -1):
            q = R.normalised(np.column_stack([R.biquad(q[::step, i], k) for i in range(4)]))[::step]
        return q

    return quaternions(df, run)
