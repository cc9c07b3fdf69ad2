"""Rolling shutters, the way there and back, zoom from the perimeter, and the loop that limits it."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark import session
from motionspark.operators import warp, zoomlimit
from motionspark.plans import warp as warp_plans

QUAT = "struct<w: double, x: double, y: double, z: double>"


def axis(x, y, z, angle):
    n = math.sqrt(x * x + y * y + z * z)
    return (math.cos(angle / 2), *(v / n * math.sin(angle / 2) for v in (x, y, z)))


def lens_frame(swing=0.3, **more):
    camera = warp.DEFAULTS | {"model": "opencv_fisheye", "k": [0.05, -0.01, 0.004, -0.001], "fx": 900.0, "fy": 880.0, "cx": 950.0, "cy": 545.0, "width": 1920, "height": 1080, "out_width": 1920, "out_height": 1080}
    times = [t * 2000 for t in range(30)]
    quats = [v for t in times for v in axis(0.2, 1, -0.4, swing * math.sin(t / 15000))]
    row = {"camera": camera | more.pop("camera", {}), "times": times, "quats": quats, "smooth": dict(zip("wxyz", axis(0, 0, 1, 0.05), strict=True)), "ts_us": 29_000, "fov": 1.1}
    return warp.Frame(row | more)


def by_hand(f, line):
    """Rotation of one line, with plain matrices."""
    readout = f.readout_ms * 1000 * (-1 if f.reversed else 1)
    at = f.row["ts_us"] - readout / 2 + readout * line / (f.width if f.horizontal else f.height)

    def look(t):
        k = max(i for i, x in enumerate(f.row["times"]) if x <= t)
        a, b, s = f.quats[k], f.quats[k + 1], (t - f.row["times"][k]) / 2000
        turn = 2 * math.acos(min(1.0, abs(float(a @ b))))
        rel = warp.hamilton(a * [1, -1, -1, -1], b)
        rel = rel if rel[0] >= 0 else -rel
        return warp.hamilton(a, np.array(axis(*rel[1:], turn * s)) if turn > 1e-12 else np.array([1.0, 0, 0, 0]))

    def turned(q, v):
        w, u = q[0], q[1:]
        return v + 2 * np.cross(u, np.cross(u, v) + w * v)

    q = warp.hamilton(warp.hamilton(f.smooth, look(f.row["ts_us"]) * [1, -1, -1, -1]), look(at))
    r = np.stack([turned(q, e) for e in np.eye(3)], 1)
    return np.diag([1, -1, -1]) @ r @ np.diag([1, -1, -1])


@pytest.mark.parametrize("camera", [{"readout_ms": 20.0}, {"readout_ms": 20.0, "reversed": True}, {"readout_ms": 12.5, "horizontal": True}])
def test_rows_have_orientations_of_their_own(camera):
    f = lens_frame(camera=camera)
    m = f.matrices()
    assert len(m) == (1920 if camera.get("horizontal") else 1080)
    for line in (0, 1, 333, len(m) - 1):
        assert np.allclose(m[line] @ f.view(1.1) @ by_hand(f, line), np.eye(3), atol=1e-9)
        assert np.allclose(f.rotations(np.array([float(line)]), False)[0], by_hand(f, line), atol=1e-12)


def test_one_matrix_without_a_rolling_shutter():
    f = lens_frame()
    assert f.rows == 1 and np.allclose(f.matrices()[0] @ f.view(1.1) @ by_hand(f, 0), np.eye(3), atol=1e-9)
    a, b = (lens_frame(camera={"readout_ms": 8.0, "upside_down": u}) for u in (False, True))
    assert np.allclose(a.rotations(np.arange(5.0), False), b.rotations(np.arange(5.0), False)) and not np.allclose(a.matrices(), b.matrices())


@pytest.mark.parametrize("camera", [{}, {"readout_ms": 16.0}, {"readout_ms": 16.0, "horizontal": True}, {"refraction": 1.33}, {"rotation_deg": 30.0, "model": "gopro", "k": [0.0, 0.9, 0.05, -0.02, 0.01]}])
def test_there_and_back(camera):
    """A pixel's row is looked up through the middle row, so with a moving shutter the way back strays by what the rows between turn."""
    f = lens_frame(0.01, camera=camera)
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(300, 1600, 9), np.linspace(200, 880, 7)))
    u, v = f.sources(x, y)
    inside = (u > 0) & (u < 1920) & (v > 0) & (v < 1080)
    assert inside.sum() > 30
    bx, by = f.seen(u[inside], v[inside], 1.1)
    slack = 0.2 if camera.get("readout_ms") else 1e-6
    assert np.abs(bx - x[inside]).max() < slack and np.abs(by - y[inside]).max() < slack


def test_what_the_lens_cannot_see():
    behind = lens_frame(smooth=dict(zip("wxyz", axis(0, 1, 0, math.pi), strict=True)), times=[], quats=[])
    assert np.isnan(behind.sources(np.array([960.0]), np.array([540.0]))[0]).all()
    near = lens_frame(camera={"r_limit": 0.3}, smooth=None, times=[], quats=[], fov=1.0)
    u, _ = near.sources(np.array([960.0, 1900.0]), np.array([540.0, 540.0]))
    assert np.isfinite(u[0]) and np.isnan(u[1])
    none = lens_frame(camera={"model": "poly3", "k": [-3.0]})
    assert none.seen(np.array([1900.0]), np.array([1000.0]))[0][0] == warp.NOWHERE
    short = lens_frame(camera={"k": None, "readout_ms": None, "refraction": None})
    assert short.k.tolist() == [[0.0] * 12] and short.rows == 1


def dense(f, n=20_000):
    """The widest view by a ring of very many points."""
    x, y = f.seen(*warp.perimeter(f.width, f.height, divisions=n + 1).T)
    return np.maximum(np.abs(x - f.width / 2), np.abs(y - f.height / 2) / (f.out_height / f.out_width)).min() * 2 / f.width


@pytest.mark.parametrize("camera", [{}, {"readout_ms": 16.0}, {"out_width": 1080, "out_height": 1920}, {"rotation_deg": 20.0, "out_height": 810}])
def test_fov_is_that_of_a_dense_ring(camera):
    f = lens_frame(camera=camera)
    assert warp.smallest_fov(f) == pytest.approx(dense(f), rel=2e-3) and warp.smallest_fov(f) >= dense(f) - 1e-9


def test_fov_of_a_still_camera():
    """Without turn and bend, the view is the frame."""
    f = lens_frame(camera={"k": [], "cx": 960.0, "cy": 540.0}, smooth=None, times=[], quats=[])
    assert warp.smallest_fov(f) == pytest.approx(1.0, abs=1e-12)
    assert warp.smallest_fov(f, centre=(0.1, 0.0)) == pytest.approx(0.8, abs=1e-12) and warp.smallest_fov(f, margin=96) == pytest.approx(1 - 2 * 96 / 1080, abs=1e-12)
    ring = warp.perimeter(30, 60)
    assert len(ring) == 120 and ring[0].tolist() == [0, 0] and ring[30].tolist() == [30, 0] and ring[60].tolist() == [30, 60] and ring[90].tolist() == [0, 60]


def test_frames_get_the_samples_around_them(spark):
    q = lambda k: axis(0, 0, 1, 0.01 * k)
    samples = spark.createDataFrame([(1, k * 1000, q(k)) for k in range(400)] + [(2, 5_000_000, q(1)), (2, 90_000_000, q(2))], f"recording_id long, ts_us long, q {QUAT}")
    frames = spark.createDataFrame([(1, 0, 150_500, 16.0), (1, 1, 399_000, 16.0), (1, 2, 1000, 0.0), (2, 0, 60_000_000, 16.0), (3, 0, 5, 16.0)], "recording_id long, frame long, ts_us long, readout double")
    camera = warp.camera({"model": "opencv_fisheye", "k": F.array(F.lit(0.1)), "fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0, "width": 4, "height": 6, "readout_ms": F.col("readout")})
    at = warp.posed(frames.withColumns({"camera": camera, "fov": F.lit(1.0)}), samples, samples)
    got = {(r["recording_id"], r["frame"]): (r["times"], r["smooth"]["z"]) for r in at.collect()}
    assert got[1, 0][0] == [k * 1000 for k in range(142, 160)] and got[1, 0][1] == pytest.approx(math.sin(0.7525))
    assert got[1, 1][0] == [k * 1000 for k in range(391, 400)] and got[1, 2][0] == [1000]
    assert got[2, 0][0] == [5_000_000, 90_000_000] and got[3, 0] == (None, 0.0)
    rows = warp.row_matrices(at).groupBy("recording_id", "frame").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {(1, 0): 6, (1, 1): 6, (1, 2): 1, (2, 0): 6, (3, 0): 6}
    assert warp.frame_fovs(at.limit(0)).count() == 0


def test_zoom_limit_by_hand(spark):
    """FOV is 1 - 0.5 a for the allowance a; at least 0.7, 0.55 and 0.2 for three recordings."""
    frames = spark.createDataFrame([(1, 0, 0.7), (1, 1, 0.2), (2, 0, 0.55), (3, 0, 0.2)], "recording_id long, frame long, least double")
    asked = []

    def fovs_of(allowances):
        asked.append({(r[0], r[1]): round(r[2], 9) for r in allowances.collect()})
        return allowances.select("recording_id", "frame", (1 - 0.5 * F.col("allowance")).alias("fov"))

    got = {(r[0], r[1]): tuple(round(x, 9) for x in r[2:]) for r in zoomlimit.limit_zoom(frames, fovs_of, F.col("least")).collect()}
    first = 0.5 / 0.7  # less than 0.95
    assert asked[0] == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (3, 0): 1}
    assert asked[1] == {(1, 0): round(first, 9), (1, 1): 1, (2, 0): round(0.5 / 0.55, 9)}
    second = first * min((1 - 0.5 * first) / 0.7, 0.9)
    assert asked[2] == {(1, 0): round(second, 9), (1, 1): 1, (2, 0): round(0.5 / 0.55 * 0.9, 9)}
    assert got[3, 0] == (0.5, 1, 0) and got[1, 1][:2] == (0.5, 1) and got[1, 0][0] >= 0.7 and got[1, 0][2] == len(asked) - 1
    assert zoomlimit.limit_zoom(frames, fovs_of, F.col("least"), rounds=1).where("recording_id = 1 AND frame = 0").first()["fov"] < 0.7


def test_narrowest(spark):
    one = spark.range(1).select(zoomlimit.narrowest(130.0, 1.5).alias("a"), zoomlimit.narrowest(130.0, 1.5, 3.0).alias("b"), zoomlimit.narrowest(F.lit(130.0), 1.5, 9.0).alias("c")).first()
    assert [round(1 / x, 9) for x in one] == [1.95, 2.925, 3.51]


def test_zoom_limit_sends_no_table_through_the_driver(spark, monkeypatch):
    """Frames, parts and samples grow with the input, so no round may broadcast one of them."""
    plans, write = [], session.kept

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(zoomlimit, "kept", noted)
    monkeypatch.setattr(warp_plans, "kept", noted, raising=False)
    warp_plans.zom05(spark, "/root/testdata/sf0.001").count()
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    assert sum("part.parquet" in p for p in plans) == 1
