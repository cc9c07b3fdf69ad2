"""Turns between frames: planted ones with wrong matches among them, with and without movement of the camera."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.operators import pose, warp
from motionspark.operators.lens import OUT

LENS = {"model": "opencv_fisheye", "k": [0.05, -0.01, 0.004, -0.001], "fx": 900.0, "fy": 880.0, "cx": 950.0, "cy": 545.0, "width": 1920, "height": 1080}
PAIRS = "recording_id long, ts_us long, next_ts_us long, lines array<struct<x1: double, y1: double, x2: double, y2: double>>"


def turn(v):
    """Rotation matrix by its power series."""
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    out, term = np.eye(3), np.eye(3)
    for i in range(1, 25):
        term = term @ k / i
        out = out + term
    return out


def scene(n, seed, axis, moved=(0.0, 0.0, 0.0), wrong=0.4, noise=0.0):
    """Points seen before and after a turn and a move, in the ideal plane; the first ``wrong`` of them mismatched."""
    r = np.random.default_rng(seed)
    a = np.concatenate([r.uniform(-0.7, 0.7, (n, 1)), r.uniform(-0.4, 0.4, (n, 1)), np.ones((n, 1))], 1)
    b = (a * r.uniform(2, 9, (n, 1))) @ turn(axis).T + moved
    b = b[:, :2] / b[:, 2:] + r.normal(0, noise, (n, 2))
    k = int(n * wrong)
    b[:k] = r.uniform(-0.6, 0.6, (k, 2))
    return a[:, :2], b


def unit(p):
    v = np.concatenate([p, np.ones((len(p), 1))], 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def error_deg(r, axis):
    return np.degrees(np.linalg.norm(r - turn(axis)) / np.sqrt(2))


AXIS = np.array([0.02, -0.035, 0.015])


@pytest.mark.parametrize("seed", range(5))
def test_planted_turn_with_wrong_matches(seed):
    a, b = scene(120, seed, AXIS)
    r, n = pose.rotation(unit(a), unit(b), (3, seed))
    assert error_deg(r, AXIS) < 1e-6 and n >= 72
    for method in (pose.essential, pose.eight_point):
        a, b = scene(150, seed, AXIS, moved=(0.4, -0.2, 0.1))
        r, n = method(unit(a), unit(b), (3, seed))
        assert error_deg(r, AXIS) < 1e-5 and n >= 90
        a, b = scene(150, seed, AXIS, wrong=0.2)  # only turned: the direction of the move is free, the turn is not
        assert error_deg(method(unit(a), unit(b), (3, seed))[0], AXIS) < 1e-5


def test_noise_of_matches():
    """A third of a pixel at a focal length of 900."""
    a, b = scene(400, 1, AXIS, noise=4e-4)
    assert error_deg(pose.rotation(unit(a), unit(b), (1, 1))[0], AXIS) < 0.02
    a, b = scene(400, 2, AXIS, moved=(0.4, -0.2, 0.1), noise=1e-4)
    assert error_deg(pose.essential(unit(a), unit(b), (1, 1))[0], AXIS) < 0.1


def test_consensus_by_hand():
    """Of few matches the samples are nearly all there are: no triple of matches is agreed with by more of them."""
    a, b = scene(9, 5, AXIS, wrong=0.34)
    a, b = unit(a), unit(b)
    within = lambda r: int((np.degrees(2 * np.arcsin(np.linalg.norm(a @ r.T - b, axis=1) / 2)) <= 0.05).sum())
    most = max(within(pose.turn_between(a[list(t)], b[list(t)])) for t in itertools.combinations(range(9), 3))
    assert pose.rotation(a, b, (0, 0))[1] == most == 6
    at = pose.draws((1, 2), 9, 500, 8)
    assert at.min() == 0 and at.max() == 8 and all(len(set(x)) == 8 for x in at.tolist()) and len({tuple(sorted(x)) for x in at.tolist()}) == 9
    assert (at == pose.draws((1, 2), 9, 500, 8)).all() and (at != pose.draws((1, 3), 9, 500, 8)).any()


def test_orthogonal_fit_is_a_rotation():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 50, 3, 3))
    fits = pose.turn_between(a, b)
    assert np.allclose(np.linalg.det(fits), 1) and np.allclose(fits @ np.swapaxes(fits, 1, 2), np.eye(3))
    e = pose.epipolar(*(unit(v) for v in scene(30, 3, AXIS, moved=(0, 0.3, 0), wrong=0)))
    s = np.linalg.svd(e)[1]
    assert s[2] < 1e-12 and abs(s[0] - s[1]) < 1e-12


def pixels(p):
    with np.errstate(all="ignore"):
        u, v = OUT["opencv_fisheye"](p[:, 0], p[:, 1], np.repeat([LENS["k"] + [0.0] * 8], len(p), 0))
    return u * LENS["fx"] + LENS["cx"], v * LENS["fy"] + LENS["cy"]


def lines(a, b):
    return list(zip(*(v.tolist() for v in (*pixels(a), *pixels(b))), strict=True))


def camera():
    k = F.array(*(F.lit(x) for x in LENS["k"]))
    return warp.camera(LENS | {"k": k})


def test_frame_pairs_in_pixels(spark):
    good = lines(*scene(100, 1, AXIS))
    rows = [
        (1, 0, 40_000, good), (1, 40_000, 80_000, good + [None, (None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 2.0, 3.0)]), (1, 80_000, 80_000, good[:2]),
        (2, 0, 40_000, []), (2, 40_000, 80_000, None), (3, 0, 40_000, [good[-1]] * 40),
    ]
    pairs = spark.createDataFrame(rows, PAIRS).withColumn("camera", camera())
    got = {(r["recording_id"], r["ts_us"]): r for r in pose.estimate_poses(pairs).collect()}
    assert len(got) == 6
    q = got[1, 0]["q"]
    assert 2 * np.array([q["x"], q["y"], q["z"]]) == pytest.approx(AXIS, abs=2e-5) and (got[1, 0]["lines"], got[1, 40_000]["lines"]) == (100, 100)
    assert got[1, 40_000]["inliers"] == got[1, 0]["inliers"] >= 60
    for key in ((1, 80_000), (2, 0), (2, 40_000)):
        assert got[key]["q"].asDict() == {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0} and got[key]["inliers"] == 0
    assert got[3, 0]["inliers"] == 40
    for method in ("essential", "eight_point"):
        other = {(r["recording_id"], r["ts_us"]): r["q"] for r in pose.estimate_poses(pairs, method).collect()}
        assert other[2, 0] is None and other[1, 80_000] is None and other[1, 0] is not None
    rates = {(r["recording_id"], r["ts_us"]): r["gx"] for r in pose.rates(pose.estimate_poses(pairs)).collect()}
    assert rates[1, 0] == pytest.approx(AXIS[0] * 25, abs=1e-4) and rates[1, 80_000] is None and rates[2, 0] == 0
    assert pose.estimate_poses(pairs.limit(0)).count() == 0
    again = pose.estimate_poses(pairs.repartition(7).withColumn("q", F.lit(1))).collect()
    assert {(r["recording_id"], r["ts_us"]): r for r in again} == got


def test_estimated_rates_where_nothing_was_recorded(spark):
    from motionspark.operators import sync

    schema = "recording_id long, ts_us long, gx double, gy double, gz double"
    recorded = spark.createDataFrame([(1, 0, None, None, None), (1, 5, 1.0, 2.0, 3.0), (2, 0, 1.0, None, 3.0), (3, 0, None, None, None)], schema)
    estimated = spark.createDataFrame([(1, 7, 9.0, 9.0, 9.0), (2, 7, 8.0, 8.0, 8.0), (4, 7, None, None, None)], schema)
    got = sorted(((r["recording_id"], r["ts_us"], r["gx"]) for r in sync.or_estimated(recorded, estimated).collect()), key=str)
    assert got == [(1, 0, None), (1, 5, 1.0), (2, 7, 8.0), (4, 7, None)]
    assert sync.or_estimated(recorded.limit(0), estimated).count() == 3 and sync.or_estimated(recorded, estimated.limit(0)).count() == 2


def test_points_of_the_query_are_worked_out_once(spark):
    """The lens' angle stands in the plan once for each end of the matches, not once for each of its uses."""
    from motionspark.plans import pose as plan
    from tests.conftest import SF

    assert plan.pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower().count("atan(") == 2


def test_frames_of_several_lenses_together():
    cameras = [LENS | {"model": m, "fx": 700.0 + 50 * i} for i, m in enumerate(("opencv_fisheye", "gopro", "opencv_fisheye", "poly3"))]
    frames = [warp.Frame({"camera": warp.DEFAULTS | c, "times": None, "quats": None, "smooth": None}) for c in cameras]
    pixels = [np.random.default_rng(i).uniform(0, 1080, (n, 2)) for i, n in enumerate((5, 0, 3, 7))]
    for got, f, xy in zip(pose.rays(frames, pixels), frames, pixels, strict=True):
        assert got == pytest.approx(pose.rays([f], [xy])[0], nan_ok=True) and got.shape == (len(xy), 3)
