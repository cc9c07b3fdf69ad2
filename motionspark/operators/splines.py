"""Natural cubic splines over even knots, surfaces of them, and meshes of a lens that bend a frame, there and back.

Between even knots the curvatures of a natural spline are a fixed linear function of its values, so one small matrix,
solved once for each number of knots, serves all rows of a batch.  Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEWTON_STEPS, CLOSE = 60, 1e-12  # of the way back, in units of the frame's size
POINT = "x double, y double"


@cache
def curvatures(n: int) -> np.ndarray:
    """(n, n): half the second derivatives at the knots, per square of their distance, from the values; none at both ends."""
    left = np.eye(n)
    right = np.zeros((n, n))
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2] = 1, 4, 1
        right[i, i - 1 : i + 2] = 3, -6, 3
    return np.linalg.solve(left, right)


def pieces(values: np.ndarray) -> np.ndarray:
    """(4, rows, n - 1): coefficients of each stretch's powers, from ``values`` (rows, n); a stretch is one long."""
    c = values @ curvatures(values.shape[1]).T
    a, after, c0, c1 = values[:, :-1], values[:, 1:], c[:, :-1], c[:, 1:]
    return np.stack([a, after - a - (c1 + 2 * c0) / 3, c0, (c1 - c0) / 3])


def along(values: np.ndarray, t: np.ndarray, straight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at t, counted in knots.  Beyond the ends the line goes on straight, or the last stretch as it bends."""
    n = values.shape[1]
    inside = np.clip(t, 0, n - 1) if straight else t
    i = np.clip(np.nan_to_num(inside), 0, n - 2).astype(int)
    d = inside - i
    p, q, r, s = pieces(values)[:, np.arange(len(t)), i]
    slope = q + d * (2 * r + d * 3 * s)
    return p + d * (q + d * (r + d * s)) + slope * (t - inside), slope


def surface(mesh: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(3, rows): value of each mesh (rows, ny, nx) at x and y, counted in knots, and its slopes along x and y.

    Each line of the mesh is a spline along x, which bends on beyond the ends; their values are one along y, which goes on straight.
    """
    rows, ny, nx = mesh.shape
    value, slope = (v.reshape(rows, ny) for v in along(mesh.reshape(-1, nx), np.repeat(x, ny), False))
    at, down = along(value, y, True)
    return np.stack([at, along(slope, y, True)[0], down])


def meshed(mesh: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, rows) and (2, 2, rows): where meshes (rows, 2, ny, nx) put points, and how that changes along x and y."""
    both = np.stack([surface(mesh[:, i], x, y) for i in (0, 1)])
    return both[:, 0], both[:, 1:]


def unmeshed(mesh: np.ndarray, u: np.ndarray, v: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points that meshes put at u and v, from there by Newton's steps, each halved until it comes closer; nan where none is found.

    ``size`` (2, rows) is the frame's in pixels, as are all points.
    """
    knots = np.array([mesh.shape[3] - 1, mesh.shape[2] - 1])[:, None] / size
    want, at = np.stack([u, v]), np.stack([u, v]).astype(float)
    with np.errstate(all="ignore"):
        miss = lambda p: meshed(mesh, *(p * knots))[0] - want
        far = miss(at)
        for _ in range(NEWTON_STEPS):
            if not (np.abs(far / size).max(0, initial=0) > CLOSE).any():
                break
            (a, b), (c, d) = meshed(mesh, *(at * knots))[1]
            a, c, b, d = a * knots[0], c * knots[0], b * knots[1], d * knots[1]
            step = np.stack([d * far[0] - b * far[1], a * far[1] - c * far[0]]) / (a * d - b * c)
            share = np.ones(len(u))
            for _ in range(12):
                worse = ~((miss(at - share * step) ** 2).sum(0) < (far**2).sum(0))
                if not worse.any():
                    break
                share = np.where(worse, share / 2, share)
            better = (miss(at - share * step) ** 2).sum(0) < (far**2).sum(0)
            at = np.where(better, at - share * step, at)
            far = miss(at)
            if not better.any():
                break
        found = (np.abs(far / size) < 1e-9).all(0)
    return np.where(found, at[0], np.nan), np.where(found, at[1], np.nan)


def _by_length(arrays: pd.Series, fits: Callable[[int], bool], f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """(width, rows): ``f(rows' numbers, their places)`` for the rows of each length that fits; nan for the others and where a number is unknown."""
    length = np.array([-1 if a is None else len(a) for a in arrays])
    out = np.full((width, len(arrays)), np.nan)
    for n in set(length.tolist()):
        if n >= 0 and fits(n):
            at = np.flatnonzero(length == n)
            out[:, at] = f(np.array([np.asarray(a, float) for a in arrays.iloc[at]]), at)
    return np.where(np.isfinite(out), out, np.nan)


def spline_at(values: Column, x: Column, size: Column) -> Column:
    """Value at x of the natural spline through ``values``, evenly spread from 0 to ``size``; straight beyond the ends.

    Null with fewer than two values, with an unknown one, and where the size is not above 0.
    """

    def run(values: pd.Series, x: pd.Series, size: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            t = np.where(size > 0, x.to_numpy(float) / size.to_numpy(float), np.nan)
            return pd.Series(_by_length(values, lambda n: n > 1, lambda v, at: along(v, t[at] * (v.shape[1] - 1), True)[:1], 1)[0])

    return F.nanvl(F.pandas_udf(run, "double")(values, x, size), F.lit(None).cast("double"))


def _mesh(f: Callable, mesh: Column, columns: int, x: Column, y: Column, width: Column, height: Column) -> Column:
    def run(mesh: pd.Series, x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        size = np.stack([width.to_numpy(float), height.to_numpy(float)])
        p = np.stack([x.to_numpy(float), y.to_numpy(float)])
        ok = ((size > 0) & np.isfinite(size) & np.isfinite(p)).all(0)
        one = lambda v, at: np.where(ok[at], f(v.reshape(len(v), 2, -1, columns), np.where(ok, p, 0)[:, at], np.where(ok, size, 1)[:, at]), np.nan)
        out = _by_length(mesh, lambda n: n % (2 * columns) == 0 and n >= 4 * columns, one, 2)
        out = np.where(np.isfinite(out).all(0), out, np.nan)
        return pd.DataFrame({"x": out[0], "y": out[1]})

    got = F.pandas_udf(run, POINT)(mesh, *(c.cast("double") for c in (x, y, width, height)))
    return F.when(got["x"].isNotNull() & ~F.isnan(got["x"]), got).otherwise(F.lit(None).cast("struct<x: double, y: double>"))


def mesh_place(mesh: Column, columns: int, x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct<x, y>: where a mesh puts a point of a frame.  ``mesh`` is the places of its knots, first all x, then all y, line by line.

    Null for a mesh of another shape, with fewer than two lines or an unknown knot, and for unknown points.
    """
    return _mesh(lambda m, p, size: meshed(m, *(p * np.array([m.shape[3] - 1, m.shape[2] - 1])[:, None] / size))[0], mesh, columns, x, y, width, height)


def mesh_source(mesh: Column, columns: int, x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct<x, y>: the point that the mesh puts there; null where none is found."""

    def back(m: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        known = np.isfinite(m).all((1, 2, 3))
        return np.where(known, np.stack(unmeshed(np.where(known[:, None, None, None], m, 0), p[0], p[1], size)), np.nan)

    return _mesh(back, mesh, columns, x, y, width, height)
