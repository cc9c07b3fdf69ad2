"""Lens models: from the ideal image plane to the recorded one and back, as vectorised functions of columns.

Most models bend a point along its radius.  They are one polynomial each, without a constant term: of the angle
of the ray (``ANGLE``) or of its radius (``LENGTH``).  The way out evaluates it, the way back solves it by
Newton's method for all points of a batch at once; points for which that fails have no place and give null.
Coordinates are in units of the focal length, digital models' in pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 12  # coefficients of a profile, missing ones 0
POINT = "x double, y double"


def _powers(order: tuple[int | None, ...], constant: int | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Coefficients of powers 1, 2, ... from a profile's: ``order`` has the place of each, None for 0; ``constant`` is the power that has 1."""

    def of(k: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(k)) if i == constant else np.zeros(len(k)) if c is None else k[:, c] for i, c in enumerate(order)]
        return np.stack(columns, 1)

    return of


ANGLE = {
    "opencv_fisheye": _powers((None, None, 0, None, 1, None, 2, None, 3), constant=0),
    "sony": _powers((0, 1, 2, 3, 4, 5)),
    "generic_polynomial": _powers(tuple(range(12))),
}
LENGTH = {
    "poly3": _powers((None, None, 0), constant=0),
    "poly5": _powers((None, None, 0, None, 1), constant=0),
    "ptlens": _powers((None, 2, 1, 0), constant=0),
}
# A profile without any of its first coefficients leaves points as they are; how far one step goes; largest radius.
PLAIN = {"opencv_fisheye": 4, "sony": 4, "generic_polynomial": 12}
LONGEST_STEP, WIDEST = {"opencv_fisheye": 0.9}, {"opencv_fisheye": math.pi}
ANGLE_STEPS, ANGLE_EPS, LENGTH_STEPS, LENGTH_EPS = 10, 1e-6, 6, 1e-5
STANDARD_STEPS, SPHERE_STEPS, SPHERE_EPS = 20, 200, 1e-6
STEEPEST = 1.5533  # radians, about 89 degrees: the radius goes on straight from here
DIGITAL_STEPS, DIGITAL_EPS, DIGITAL_MISS, OUTSIDE = 12, 1e-6, 0.02, -99999.0


def _value(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros_like(t)
    for i in range(c.shape[1] - 1, -1, -1):
        out = (out + c[:, i]) * t
    return out


def _slope(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros_like(t)
    for i in range(c.shape[1] - 1, -1, -1):
        out = out * t + (i + 1) * c[:, i]
    return out


def _scaled(x: np.ndarray, y: np.ndarray, to: np.ndarray, radius: np.ndarray, at_centre: float) -> tuple[np.ndarray, np.ndarray]:
    s = np.where(radius > 0, to / np.where(radius > 0, radius, 1), at_centre)
    return x * s, y * s


def _radial_out(model: str, x, y, k):
    r = np.hypot(x, y)
    if model in LENGTH:
        return _scaled(x, y, _value(LENGTH[model](k), r), r, 1.0)
    out = _scaled(x, y, _value(ANGLE[model](k), np.arctan(r)), r, 1.0)
    plain = ~k[:, : PLAIN[model]].any(axis=1)
    return tuple(np.where(plain, a, b) for a, b in zip((x, y), out, strict=True))


def _angle_back(model: str, x, y, k):
    c, r = ANGLE[model](k), np.hypot(x, y)
    want = np.minimum(r, WIDEST.get(model, np.inf))
    t, done = np.zeros_like(want), want <= ANGLE_EPS
    for _ in range(ANGLE_STEPS):
        step = np.clip((_value(c, t) - want) / _slope(c, t), -LONGEST_STEP.get(model, np.inf), LONGEST_STEP.get(model, np.inf))
        t = np.where(done, t, t - step)
        done |= np.abs(step) < ANGLE_EPS
    tiny = want <= ANGLE_EPS
    good = done & (tiny | (t >= 0))
    out = _scaled(x, y, np.tan(t) * np.where(want > 0, r / np.where(want > 0, want, 1), 1), r, 0.0)
    out = tuple(np.where(tiny, 0.0, v) for v in out)
    plain = ~k[:, : PLAIN[model]].any(axis=1)
    return tuple(np.where(plain, a, np.where(good, b, np.nan)) for a, b in zip((x, y), out, strict=True))


def _length_back(model: str, x, y, k):
    c, r = LENGTH[model](k), np.hypot(x, y)
    unit = np.abs(k[:, 0]) if model == "poly3" else 1.0  # that model is solved divided by its coefficient
    t = r.copy()
    for _ in range(LENGTH_STEPS):
        miss = _value(c, t) - r
        t = np.where(np.abs(miss) < LENGTH_EPS * unit, t, t - miss / _slope(c, t))
    good = (np.abs(_value(c, t) - r) < LENGTH_EPS * unit) & (t >= 0) & (r > 0)
    return tuple(np.where(good, v, np.nan) for v in _scaled(x, y, t, r, 0.0))


def _standard_parts(x, y, k):
    """Factor of the radius and shift of each coordinate: radial, tangential and thin prism terms."""
    r2 = x * x + y * y
    ratio = (1 + r2 * (k[:, 0] + r2 * (k[:, 1] + r2 * k[:, 4]))) / (1 + r2 * (k[:, 5] + r2 * (k[:, 6] + r2 * k[:, 7])))
    dx = 2 * k[:, 2] * x * y + k[:, 3] * (r2 + 2 * x * x) + r2 * (k[:, 8] + r2 * k[:, 9])
    dy = k[:, 2] * (r2 + 2 * y * y) + 2 * k[:, 3] * x * y + r2 * (k[:, 10] + r2 * k[:, 11])
    return ratio, dx, dy


def _standard_out(x, y, k):
    ratio, dx, dy = _standard_parts(x, y, k)
    return x * ratio + dx, y * ratio + dy


def _standard_back(x, y, k):
    u, v, bad = x, y, np.zeros(len(x), bool)
    for _ in range(STANDARD_STEPS):
        ratio, dx, dy = _standard_parts(u, v, k)
        bad |= ratio < 0
        u, v = (x - dx) / ratio, (y - dy) / ratio
    return np.where(bad, np.nan, u), np.where(bad, np.nan, v)


def _sphere_out(x, y, k, z=1.0):
    """Onto a sphere, from a centre moved by k[5] to the plane, then radial and tangential terms."""
    n = np.sqrt(x * x + y * y + z * z)
    depth = z / n + k[:, 5]
    x, y = x / n / depth, y / n / depth
    r2 = x * x + y * y
    radial = 1 + r2 * (k[:, 0] + r2 * (k[:, 1] + r2 * k[:, 2]))
    return x * radial + 2 * k[:, 3] * x * y + k[:, 4] * (r2 + 2 * x * x), y * radial + 2 * k[:, 4] * x * y + k[:, 3] * (r2 + 2 * y * y)


def _sphere_back(x, y, k):
    u, v = x.copy(), y.copy()
    for _ in range(SPHERE_STEPS):
        du, dv = (a - b for a, b in zip(_sphere_out(u, v, k), (x, y), strict=True))
        far = (np.abs(du) >= SPHERE_EPS) | (np.abs(dv) >= SPHERE_EPS)
        if not far.any():
            break
        u, v = np.where(far, u - du, u), np.where(far, v - dv, v)
    return u, v


def _gopro_out(x, y, k):
    """The radius' share p of k[1] by its angle, which is a polynomial of p."""
    r, edge = np.hypot(x, y), math.tan(STEEPEST)
    angle = np.where(r < edge, np.arctan(r), STEEPEST + (r - edge) / (1 + edge * edge))
    none = k[:, 1] == 0
    c = k[:, 1:7]
    p = (angle - k[:, 0]) / np.where(none, 1, k[:, 1])
    for _ in range(ANGLE_STEPS):
        d = _slope(c, p)
        p = p - np.where(np.abs(d) < 1e-12, 0, (k[:, 0] + _value(c, p) - angle) / np.where(np.abs(d) < 1e-12, 1, d))
    out = _scaled(x, y, k[:, 1] * p, np.where(r < 1e-9, 0, r), 1.0)
    return tuple(np.where(none, a, b) for a, b in zip((x, y), out, strict=True))


def _gopro_back(x, y, k):
    r, edge = np.hypot(x, y), math.tan(STEEPEST)
    none = (k[:, 1] == 0) | (r < 1e-9)
    angle = k[:, 0] + _value(k[:, 1:7], r / np.where(k[:, 1] == 0, 1, k[:, 1]))
    to = np.where(angle < STEEPEST, np.tan(np.minimum(angle, STEEPEST)), edge + (angle - STEEPEST) * (1 + edge * edge))
    return tuple(np.where(none, a, b) for a, b in zip((x, y), _scaled(x, y, to, r, 1.0), strict=True))


OUT: dict[str, Callable] = {m: (lambda x, y, k, m=m: _radial_out(m, x, y, k)) for m in (*ANGLE, *LENGTH)}
OUT |= {"opencv_standard": _standard_out, "insta360": _sphere_out, "gopro": _gopro_out}
BACK: dict[str, Callable] = {m: (lambda x, y, k, m=m: _angle_back(m, x, y, k)) for m in ANGLE}
BACK |= {m: (lambda x, y, k, m=m: _length_back(m, x, y, k)) for m in LENGTH}
BACK |= {"opencv_standard": _standard_back, "insta360": _sphere_back, "gopro": _gopro_back}


def _gopro6_superview(x, y, k):
    x = x * (1 - 0.48 * np.abs(x))  # Fixed values.
    return x * 0.943396 * (1 + 0.157895 * np.abs(x)), y * 0.943396 * (1 + 0.06 * np.abs(2 * y))


def _superview(x, y, k):
    a, b = x * x, y * y
    # Fixed values.
    return x * (1.2100393 + a * (-1.2758402 + a * 1.7751845)), y * (0.9364505 + (0.4465308 - 0.7683315 * b) * b + (-0.3574087 + 1.1584653 * b + 0.3529348 * a) * a)


HYPERVIEW_X = (1.5805143, -8.1668825, 74.5198746, -451.5002441, 1551.2922363, -2735.5422363, 1923.1572266)  # Fixed values.


def _hyperview(x, y, k):
    a, b = x * x, y * y
    along = np.polynomial.polynomial.polyval(a, HYPERVIEW_X) - 0.1086027 * b
    return x * along, y * (1.0238225 - 0.1025671 * b + a * (-0.2639930 + a * 0.2979266))


def _warp(x, y, k):
    """A profile's own map of the recorded frame, going on straight outside it."""
    u, v = np.clip(x, -0.5, 0.5), np.clip(y, -0.5, 0.5)
    a, b = u * u, v * v
    along = sum(k[:, i] * a**i for i in range(7)) + k[:, 7] * b
    across = k[:, 8] + k[:, 9] * b + k[:, 10] * b * b + a * (k[:, 11] + k[:, 12] * b + k[:, 13] * a)
    return u * along + (x - u), v * across + (y - v)


def _stretch_of(k: np.ndarray) -> np.ndarray:
    return np.where(k[:, 14] != 0, k[:, 14], 1.0)


# model -> (map of the unit frame around its centre, by how much wider the wide frame is)
DIGITAL = {
    "gopro6_superview": (_gopro6_superview, 1.0),
    "gopro_superview": (_superview, 1.333333333),
    "gopro_hyperview": (_hyperview, 1.555555555),
    "gopro_warp": (_warp, None),
}


def digital_back(model: str, x, y, k, width, height):
    """From the recorded frame to the wide one; pixels."""
    if model == "digital_stretch":
        return x / k[:, 0], y / k[:, 1]
    bend, wide = DIGITAL[model]
    u, v = bend(x / width - 0.5, y / height - 0.5, k)
    return (u / (_stretch_of(k) if wide is None else wide) + 0.5) * width, (v + 0.5) * height


def digital_out(model: str, x, y, k, width, height):
    """From the wide frame to the recorded one, by steps against the miss; a map without an answer gives a place outside."""
    if model == "digital_stretch":
        return x * k[:, 0], y * k[:, 1]
    bend, wide = DIGITAL[model]
    u, v = x / width - 0.5, y / height - 0.5
    want = u * (_stretch_of(k) if wide is None else wide), v
    p, q = (u, v) if wide is None else want
    for _ in range(DIGITAL_STEPS):
        dp, dq = (a - b for a, b in zip(bend(p, q, k), want, strict=True))
        far = (np.abs(dp) >= DIGITAL_EPS) | (np.abs(dq) >= DIGITAL_EPS)
        p, q = np.where(far, p - dp, p), np.where(far, q - dq, q)
    out = (p + 0.5) * width, (q + 0.5) * height
    if wide is None:
        miss = [np.abs(a - b) > DIGITAL_MISS for a, b in zip(bend(p, q, k), want, strict=True)]
        out = tuple(np.where(miss[0] | miss[1], OUTSIDE, v) for v in out)
    return out


def coefficients(k: pd.Series, n: int = K) -> np.ndarray:
    """Rows of n coefficients; null and short profiles are filled with 0."""
    out = np.zeros((len(k), n))
    for i, row in enumerate(k):
        if row is not None:
            out[i, : min(n, len(row))] = np.nan_to_num(np.asarray(row[:n], float))
    return out


def _points(f: Callable, x: pd.Series, y: pd.Series, *rest) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        u, v = f(x.to_numpy(float), y.to_numpy(float), *rest)
    known = np.isfinite(u) & np.isfinite(v)
    return pd.DataFrame({"x": np.where(known, u, np.nan), "y": np.where(known, v, np.nan)})  # nan becomes null


def distorted(model: str, x: Column, y: Column, k: Column) -> Column:
    """struct<x, y>: where the lens puts the point of the ideal plane; both null where it has no place."""
    return F.pandas_udf(lambda x, y, k: _points(OUT[model], x, y, coefficients(k)), POINT)(x, y, k)


def undistorted(model: str, x: Column, y: Column, k: Column) -> Column:
    """struct<x, y>: the point of the ideal plane that the lens puts there; both null where there is none."""
    return F.pandas_udf(lambda x, y, k: _points(BACK[model], x, y, coefficients(k)), POINT)(x, y, k)


def digital(model: str, x: Column, y: Column, k: Column, width: Column, height: Column, back: bool) -> Column:
    f = digital_back if back else digital_out
    run = lambda x, y, k, w, h: _points(lambda a, b, *rest: f(model, a, b, *rest), x, y, coefficients(k, 16), w.to_numpy(float), h.to_numpy(float))
    return F.pandas_udf(run, POINT)(x, y, k, width, height)


def slope_of(model: str, k: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """What decides how far a model is valid; none for models without such a limit."""
    if model in ANGLE or model in ("poly5", "ptlens"):
        return _slope((ANGLE | LENGTH)[model](k), t)
    if model == "poly3":
        return 3 * t * t + 1 / k[:, 0]
    if model == "opencv_standard":
        return 1 / _standard_parts(t, np.zeros_like(t), np.where(np.isin(np.arange(K), (0, 1, 4, 5, 6, 7)), k, 0))[0]
    if model == "gopro":
        c, p = k[:, 1:7], (t - k[:, 0]) / k[:, 1]
        for _ in range(ANGLE_STEPS):
            p = p - (k[:, 0] + _value(c, p) - t) / _slope(c, p)
        return k[:, 1] * _slope(c, p)
    return None


def radial_limit(model: str, k: Column) -> Column:
    """Largest radius up to which the model grows, by bisection of its slope over the angles; null without a limit."""

    def find(k: pd.Series) -> pd.Series:
        c = coefficients(k)
        lo, hi = np.zeros(len(c)), np.full(len(c), math.pi / 2)
        with np.errstate(all="ignore"):
            if slope_of(model, c, lo) is None:
                return pd.Series([None] * len(c), dtype="float64")
            while (hi - lo).max(initial=0) > 1e-4:
                mid = (lo + hi) / 2
                up = slope_of(model, c, mid) > 0
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        angle = (lo + hi) / 2
        return pd.Series(np.where(np.abs(angle - math.pi / 2) > 1e-3, np.tan(angle), np.nan)).astype("object").where(lambda s: s.notna(), None).astype("float64")

    return F.nanvl(F.pandas_udf(find, "double")(k), F.lit(None).cast("double"))


def undistort_points(df: DataFrame, model: str, camera: tuple[float, float, float, float], view: tuple[float, float, float, float], q: str | None = None) -> DataFrame:
    """Adds ``place`` struct<x, y>: pixels (px, py) of a camera (fx, fy, cx, cy) through its lens (k), turned by ``q``, as pixels of ``view``.

    Points without a place in the ideal plane, or behind the view after the turn, are null.
    """
    from motionspark.functions import quat as Q

    fx, fy, cx, cy = camera
    gx, gy, hx, hy = view
    ideal = undistorted(model, (F.col("px") - cx) / fx, (F.col("py") - cy) / fy, F.col("k"))
    df = df.withColumn("_ideal", ideal)
    ray = F.struct(F.col("_ideal.x").alias("x"), F.col("_ideal.y").alias("y"), F.lit(1.0).alias("z"))
    turned = Q.rotate(F.col(q), ray["x"], ray["y"], ray["z"]) if q else ray
    at = Q.let(turned, lambda v: F.when(v["z"] > 0, F.struct((v["x"] / v["z"] * gx + hx).alias("x"), (v["y"] / v["z"] * gy + hy).alias("y"))))
    return df.withColumn("place", at).drop("_ideal")
