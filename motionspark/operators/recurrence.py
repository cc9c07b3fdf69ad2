"""Recursive filters over ordered series, one recording at a time.

A recurrence needs its rows in order in one place; the unit of work is a recording.  Short series (up to a
few thousand rows) can also run as a fold inside the JVM, see ``ema_fold``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ("recording_id",)


def per_recording(df: DataFrame, columns: Sequence[str], f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outs: Sequence[str], on: str = "ts_us") -> DataFrame:
    """``f`` of the ordered columns of each recording; rows keep recording_id and their key."""
    keep = list(dict.fromkeys([*BY, on, *columns]))
    kind = df.schema[on].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on, kind="stable")
        got = f({c: pdf[c].to_numpy() for c in dict.fromkeys([on, *columns])})
        return pdf[[*BY, on]].assign(**got)

    schema = ", ".join(["recording_id long", f"`{on}` {kind}", *(f"{c} double" for c in outs)])
    return df.select(*keep).groupBy(*BY).applyInPandas(run, schema)


def alpha(tau_s: float, rate: float) -> float:
    """The share of the new value in a step of an exponential average."""
    return 1 - math.exp(-(1 / rate) / tau_s)


def ema(x: np.ndarray, a: float | np.ndarray, both: bool = True) -> np.ndarray:
    """Exponential average forwards, then backwards over the result; both start at the first value they meet."""
    a = np.broadcast_to(a, x.shape)
    for step in (1, -1) if both else (1,):
        y, w, q = x[::step].astype(float), a[::step], float(x[::step][0])
        for i in range(1, len(y)):
            q = q * (1 - w[i]) + y[i] * w[i]
            y[i] = q
        x = y[::step]
    return x


def ema_series(df: DataFrame, value: str, a: float, on: str = "ts_us", out: str = "ema") -> DataFrame:
    return per_recording(df, [value], lambda c: {out: ema(c[value].astype(float), a)}, [out], on)


def ema_fold(df: DataFrame, value: str, a: float, on: str = "ts_us", out: str = "ema") -> DataFrame:
    """The same as a fold over a sorted array, for short series: each step copies what is done so far."""

    def run(rows):
        start = F.array().cast("array<struct<k:bigint,v:double>>")
        step = lambda acc, r: F.concat(acc, F.array(F.struct(r["k"].alias("k"), F.when(F.size(acc) == 0, r["v"]).otherwise(F.get(acc, F.size(acc) - 1)["v"] * (1 - a) + r["v"] * a).alias("v"))))
        return F.aggregate(rows, start, step)

    rows = df.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(F.col(on).cast("long").alias("k"), F.col(value).cast("double").alias("v")))).alias("r"))
    done = rows.select(*BY, F.reverse(run(F.reverse(run(F.col("r"))))).alias("r"))
    return done.select(*BY, F.explode("r").alias("r")).select(*BY, F.col("r.k").alias(on), F.col("r.v").alias(out))


def adaptive_ema(x: np.ndarray, fps: float, longest: float, shortest: float, top_velocity: float) -> np.ndarray:
    """Average in both directions whose share of new values grows from a long to a short time constant with the relative velocity.

    The velocity is an average itself.  Unknown values hold the state, which stands in their place; before the
    first known value nothing does.
    """
    known = np.flatnonzero(~np.isnan(x))
    if len(x) < 2 or fps <= 0 or not len(known):
        return x
    slow, fast = alpha(max(longest, 1e-3), fps), alpha(max(shortest, 1e-3), fps)
    with np.errstate(invalid="ignore", divide="ignore"):
        v = np.where(x[:-1] > 0, np.abs((x[1:] - x[:-1]) * fps / x[:-1]), 0.0)
    v = np.nan_to_num(v)
    v = ema(np.concatenate([v[:1], v]), fast)
    share = np.minimum(v / top_velocity, 1) if top_velocity > 1e-6 else np.ones(len(x))
    a = slow * (1 - share) + fast * share
    out, state, first = np.full(len(x), np.nan), x[known[0]], known[0]
    for i in range(first, len(x)):
        state = state if np.isnan(x[i]) else state * (1 - a[i]) + x[i] * a[i]
        out[i] = state
    for i in range(len(x) - 1, first - 1, -1):
        state = state * (1 - a[i]) + out[i] * a[i]
        out[i] = state
    return out


def biquad_lowpass(cut_hz: float, rate: float) -> tuple[float, ...]:
    """Second-order Butterworth (b0, b1, b2, a1, a2), normalised."""
    w = 2 * math.pi * cut_hz / rate
    c, s = math.cos(w), math.sin(w) / math.sqrt(2)
    return (1 - c) / 2 / (1 + s), (1 - c) / (1 + s), (1 - c) / 2 / (1 + s), -2 * c / (1 + s), (1 - s) / (1 + s)


def biquad(x: np.ndarray, k: tuple[float, ...]) -> np.ndarray:
    """One pass in transposed direct form II from a zero state."""
    b0, b1, b2, a1, a2 = k
    s1 = s2 = 0.0
    out = np.empty(len(x))
    for i, v in enumerate(x):
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[i] = y
    return out


def smoothed(values: np.ndarray, cut_hz: float, rate: float) -> np.ndarray:
    """Low-pass of each column in both directions over its known values."""
    k, out = biquad_lowpass(cut_hz, rate), values.astype(float)
    for c in range(values.shape[1]):
        known = ~np.isnan(out[:, c])
        out[known, c] = biquad(biquad(out[known, c], k)[::-1], k)[::-1]
    return out


def lowpass(df: DataFrame, columns: Sequence[str], cut_hz: float, rate: float, on: str = "ts_us") -> DataFrame:
    """Forward and backward over each column; unknown values are passed over and stay unknown.  The cut must lie below half the rate."""
    if not 0 < cut_hz < rate / 2:
        raise ValueError("the cut-off frequency must be positive and below half the sample rate")
    out = per_recording(df, columns, lambda c: {n: smoothed(c[n].astype(float)[:, None], cut_hz, rate)[:, 0] for n in columns}, columns, on)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


# Quaternions as rows of (w, x, y, z).


def normalised(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(np.linalg.norm(q, axis=-1, keepdims=True), 1e-300)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w1, x1, y1, z1 = np.moveaxis(a, -1, 0)
    w2, x2, y2, z2 = np.moveaxis(b, -1, 0)
    return np.stack([w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2], -1)


def inverse(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def exp_map(v: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(v, axis=-1, keepdims=True)
    s = np.where(a > 1e-12, np.sin(a / 2) / np.where(a > 1e-12, a, 1), 0.5)
    return np.concatenate([np.cos(a / 2), v * s], -1)


def log_map(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    w = q[..., :1]
    k = np.where(n > 1e-12, 2 * np.arctan2(n, np.abs(w)) / np.where(n > 1e-12, n, 1), 0) * np.where(w < 0, -1, 1)
    return q[..., 1:] * k


def turn(q: np.ndarray) -> np.ndarray:
    """Rotation angle in radians."""
    return 2 * np.arctan2(np.linalg.norm(q[..., 1:], axis=-1), np.abs(q[..., 0]))


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    c = float(a @ b)
    if c < 0:
        b, c = -b, -c
    theta = math.acos(min(c, 1.0))
    s = math.sin(theta)
    q = a * (1 - t) + b * t if s < 1e-9 else a * (math.sin((1 - t) * theta) / s) + b * (math.sin(t * theta) / s)
    return q / np.linalg.norm(q)


def slerp_ema(q: np.ndarray, a: float | np.ndarray) -> np.ndarray:
    """Spherical exponential average forwards, then backwards; shares beyond 1 count as 1."""
    a = np.minimum(np.broadcast_to(a, len(q)), 1.0)
    for step in (1, -1):
        out, w, state = q[::step].copy(), a[::step], q[::step][0]
        for i in range(len(out)):
            state = slerp(state, out[i], w[i])
            out[i] = state
        q = out[::step]
    return q
