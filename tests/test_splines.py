"""Splines and meshes against a plain elimination, and the way back by round trips."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.operators import splines


def plain(values, t, straight):
    """The tridiagonal system by elimination, one spline and one place at a time."""
    n = len(values)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1], b[i] = 1 / 6, 2 / 3, 1 / 6, values[i - 1] - 2 * values[i] + values[i + 1]
    for i in range(1, n):
        f = a[i, i - 1] / a[i - 1, i - 1]
        a[i] -= f * a[i - 1]
        b[i] -= f * b[i - 1]
    m = np.zeros(n)
    for i in range(n - 1, -1, -1):
        m[i] = (b[i] - (a[i, i + 1] * m[i + 1] if i + 1 < n else 0)) / a[i, i]

    def at(t, i):
        s = t - i
        return (1 - s) * values[i] + s * values[i + 1] + (((1 - s) ** 3 - (1 - s)) * m[i] + (s**3 - s) * m[i + 1]) / 6

    i = min(max(int(np.floor(t)), 0), n - 2)
    if straight and not 0 <= t <= n - 1:
        edge = 0.0 if t < 0 else n - 1.0
        eps = 1e-6 if t < 0 else -1e-6
        return values[0 if t < 0 else -1] + (at(edge + eps, i) - at(edge, i)) / eps * (t - edge)
    return at(t, i)


@pytest.mark.parametrize("n", [2, 3, 4, 9, 30])
def test_spline_is_the_eliminated_one(n):
    r = np.random.default_rng(n)
    v, t = r.normal(size=(40, n)), r.uniform(-1.5, n + 0.5, 40)
    t[:3] = 0, n - 1, 1
    for straight in (True, False):
        got = splines.along(v, t, straight)[0]
        assert got == pytest.approx([plain(v[i], t[i], straight) for i in range(40)], abs=1e-4 if straight else 1e-9)
    e = 1e-6
    slope = (splines.along(v, t + e, False)[0] - splines.along(v, t - e, False)[0]) / (2 * e)
    inner = np.abs(t - np.round(t)) > 1e-3
    assert splines.along(v, t, False)[1][inner] == pytest.approx(slope[inner], abs=1e-4)


def test_surface_is_splines_of_splines():
    r = np.random.default_rng(1)
    mesh, x, y = r.normal(size=(25, 4, 6)), r.uniform(-0.5, 5.5, 25), r.uniform(-0.5, 3.5, 25)
    want = [plain([plain(line, x[i], False) for line in mesh[i]], y[i], True) for i in range(25)]
    assert splines.surface(mesh, x, y)[0] == pytest.approx(want, abs=1e-4)


def bent(rows, ny, nx, size, seed, by=0.25):
    r = np.random.default_rng(seed)
    gx, gy = np.meshgrid(np.linspace(0, size[0], nx), np.linspace(0, size[1], ny))
    still = np.stack([gx, gy])
    return still + r.uniform(-by, by, (rows, 2, ny, nx)) * np.array([size[0] / (nx - 1), size[1] / (ny - 1)])[:, None, None]


@pytest.mark.parametrize("shape", [(9, 9), (2, 3), (5, 4)])
def test_there_and_back(shape):
    size = np.array([[1920.0] * 300, [1080.0] * 300])
    mesh = bent(300, *shape, (1920, 1080), 3, 0.15)
    r = np.random.default_rng(4)
    x, y = r.uniform(0, 1920, 300), r.uniform(0, 1080, 300)
    knots = np.array([shape[1] - 1, shape[0] - 1])[:, None] / size
    u, v = splines.meshed(mesh, *(np.stack([x, y]) * knots))[0]
    bx, by = splines.unmeshed(mesh, u, v, size)
    assert np.abs(bx - x).max() < 1e-6 and np.abs(by - y).max() < 1e-6


def test_mesh_columns(spark):
    size = (100.0, 50.0)
    flat = bent(1, 3, 4, size, 0, 0.0)[0].ravel().tolist()
    wavy = bent(1, 3, 4, size, 5, 0.2)[0].ravel().tolist()
    away = [0.0] * 24  # all knots in one place
    rows = [(0, flat, 30.0, 20.0), (1, wavy, 30.0, 20.0), (2, None, 1.0, 1.0), (3, flat[:-1], 1.0, 1.0), (4, flat[:8], 1.0, 1.0), (5, [None, *flat[1:]], 1.0, 1.0), (6, flat, None, 1.0), (7, away, 7.0, 8.0), (8, [], 1.0, 1.0), (9, flat, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, mesh array<double>, x double, y double").coalesce(1)
    there = splines.mesh_place(F.col("mesh"), 4, F.col("x"), F.col("y"), F.lit(size[0]), F.lit(size[1]))
    got = {r["id"]: (r["there"], r["back"]) for r in df.withColumn("there", there).withColumn("back", splines.mesh_source(F.col("mesh"), 4, F.col("there.x"), F.col("there.y"), F.lit(size[0]), F.lit(size[1]))).collect()}
    assert tuple(got[0][0]) == pytest.approx((30, 20)) and tuple(got[1][0]) != pytest.approx((30, 20), abs=0.1)
    for k in (0, 1):
        assert got[k][1] is not None and tuple(got[k][1]) == pytest.approx((30, 20), abs=1e-6)
    for k in (2, 3, 4, 5, 6, 8, 9):
        assert got[k] == (None, None), k
    assert tuple(got[7][0]) == (0, 0)
    assert df.where("id = 7").select(splines.mesh_source(F.col("mesh"), 4, F.lit(7.0), F.lit(8.0), F.lit(size[0]), F.lit(size[1])).alias("p")).first()["p"] is None
    v = spark.createDataFrame([(0, [1.0, 2.0], 5.0), (1, [1.0], 5.0), (2, None, 5.0), (3, [1.0, None, 2.0], 5.0), (4, [1.0, 2.0, 3.0], None), (5, [1.0, 3.0], -5.0)], "id long, v array<double>, x double")
    one = {r["id"]: (r["a"], r["b"]) for r in v.select("id", splines.spline_at(F.col("v"), F.col("x"), F.lit(10.0)).alias("a"), splines.spline_at(F.col("v"), F.col("x"), F.lit(0.0)).alias("b")).collect()}
    assert one[0] == (1.5, None) and one[5] == (0.0, None) and all(one[k] == (None, None) for k in (1, 2, 3, 4))
