"""Offsets and readout times by points: planted ones, and costs against a plain loop over the frame's own way."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import pointsync, warp
from motionspark.operators.lens import OUT
from tests.test_warp import axis

LENS = {"model": "opencv_fisheye", "k": [0.05, -0.01, 0.004, -0.001], "fx": 900.0, "fy": 880.0, "cx": 950.0, "cy": 545.0, "width": 1920, "height": 1080}
QUAT = "struct<w: double, x: double, y: double, z: double>"
PAIRS = "recording_id long, range long, from_us long, to_us long, ts_us long, next_ts_us long, lines array<struct<x1: double, y1: double, x2: double, y2: double>>"


def held(t_us):
    """Orientation of a shaken camera."""
    t = t_us / 1e6
    return np.array(axis(0.3, 1, -0.2, 0.12 * math.sin(19 * t) + 0.05 * math.sin(43 * t + 1)))


TIMES = np.arange(-60_000, 700_000, 1000.0)
HELD = np.array([held(t) for t in TIMES])


def points_at(ts_us, world, offset_ms, readout_ms):
    """Pixels at which rays of the world are recorded: a row is read at its own time."""
    row = np.full(len(world), 540.0)
    for _ in range(30):
        when = ts_us - offset_ms * 1000 + readout_ms * 1000 * (row / 1080 - 0.5)
        r = warp.rotation_matrix(np.array([held(t) for t in when])) * (np.array([1, -1, -1])[:, None] * np.array([1, -1, -1]))
        ray = (np.swapaxes(r, 1, 2) @ world[..., None])[..., 0]
        u, v = OUT[LENS["model"]](ray[:, 0] / ray[:, 2], ray[:, 1] / ray[:, 2], np.repeat([LENS["k"] + [0.0] * 8], len(ray), 0))
        x, row = u * LENS["fx"] + LENS["cx"], v * LENS["fy"] + LENS["cy"]
    return x, row


def lines(a_us, b_us, offset_ms, readout_ms, seed, n=60):
    r = np.random.default_rng(seed)
    world = np.stack([r.uniform(-0.6, 0.6, n), r.uniform(-0.35, 0.35, n), np.ones(n)], 1)
    a, b = (points_at(t, world, offset_ms, readout_ms) for t in (a_us, b_us))
    b[0][:5] += 300  # wrong matches: less than a tenth
    return list(zip(*(v.tolist() for v in (*a, *b)), strict=True))


def tables(spark, rows, readout_ms):
    camera = warp.camera(LENS | {"k": F.array(*(F.lit(x) for x in LENS["k"])), "readout_ms": readout_ms})
    q = [(1, t * 1000, held(t * 1000).tolist()) for t in range(-60, 700)]
    return spark.createDataFrame(rows, PAIRS).withColumn("camera", camera), spark.createDataFrame(q, f"recording_id long, ts_us long, q {QUAT}")


def plain(rows, readouts, offsets, smooth):
    """Costs by one ``Frame`` for each frame, place and readout time."""
    out = []
    for readout, offset in zip(readouts, offsets, strict=True):
        total = 0
        for _, _, lo, hi, ts, after, match in rows:
            if not lo <= ts < hi:
                continue
            ends = []
            for t, i in ((ts, 0), (after, 2)):
                at = t - offset * 1000
                f = warp.Frame({"camera": warp.DEFAULTS | LENS | {"out_width": 1920, "out_height": 1080, "readout_ms": readout}, "times": TIMES.tolist(), "quats": HELD.ravel().tolist(), "smooth": dict(zip("wxyz", smooth(at), strict=True)), "ts_us": at})
                ends.append(f.seen(np.array([m[i] for m in match]), np.array([m[i + 1] for m in match]), 1.0))
            far = sorted(
                math.floor((u - x) ** 2 + (v - y) ** 2)
                for x, y, u, v in zip(*ends[0], *ends[1], strict=True)
                if all(0 < p < 1920 for p in (x, u)) and all(0 < p < 1080 for p in (y, v))
            )
            total += sum(far[: int(len(far) * 0.9)])
        out.append(total)
    return out


def last_least(costs):
    return max(i for i, c in enumerate(costs) if c == min(costs))


def sampled(at):
    """The shaken camera between its samples, a millisecond apart."""
    return warp.between(np.array([at]), TIMES, HELD)[0]


def test_planted_offset(spark):
    rows = [(1, 7, 100_000, 220_000, t, t + 40_000, lines(t, t + 40_000, 3.37, 16.0, t)) for t in (100_000, 140_000, 180_000, 220_000)]
    rows += [(1, 8, 300_000, 400_000, 320_000, 360_000, []), (1, 9, 500_000, 510_000, 520_000, 560_000, rows[0][-1])]
    pairs, q = tables(spark, rows, 16.0)
    got = {r["range"]: r for r in pointsync.offsets_by_points(pairs, q, q, 1.0, 20.0).collect()}
    assert set(got) == {7, 8} and got[7]["middle_ms"] == 160.0
    assert got[7]["offset_ms"] == pytest.approx(3.37, abs=0.3)  # distances below a pixel cost nothing, and the last such offset counts
    coarse = [1.0 - 10 + i for i in range(20)]
    best = coarse[last_least(plain(rows[:4], [16.0] * 20, coarse, sampled))]
    fine = [best - 1 + i * 0.01 for i in range(0, 200)]
    costs = plain(rows[:4], [16.0] * 200, fine, sampled)
    assert got[7]["offset_ms"] == pytest.approx(fine[last_least(costs)], abs=1e-9) and got[7]["cost"] == min(costs)
    # Nothing to go by: the last offset of each search, 10 and then 0.99 beyond it.
    assert got[8]["offset_ms"] == pytest.approx(10.99) and got[8]["cost"] == 0


def test_rim_of_the_search(spark):
    rows = [(1, 7, 100_000, 220_000, t, t + 40_000, lines(t, t + 40_000, 30.0, 0.0, t)) for t in (100_000, 140_000)]
    pairs, q = tables(spark, rows, 0.0)
    found = pointsync.offsets_by_points(pairs, q, q, 0.0, 2.0).collect()
    assert all(abs(r["offset_ms"]) < 1.8 for r in found)
    with pytest.raises(ValueError):
        pointsync.offsets_by_points(pairs, q, q, 0.0, 0.5)
    assert pointsync.offsets_by_points(pairs.limit(0), q, q, 0.0, 20.0).count() == 0


def test_planted_readout(spark):
    rows = [(1, 7, 100_000, 400_000, t, t + 60_000, lines(t, t + 60_000, 0.0, 12.3, t)) for t in range(100_000, 400_000, 50_000)]
    pairs, q = tables(spark, rows, None)
    (got,) = pointsync.readouts_by_points(pairs, q, q, 30.0).collect()
    assert abs(got["readout_ms"]) == pytest.approx(12.3, abs=0.7)
    coarse = list(range(-33, 33))
    best = coarse[last_least(plain(rows, [abs(v) for v in coarse], [0.0] * 66, sampled))]
    fine = [best - 1 + i * 0.01 for i in range(200)]
    costs = plain(rows, [abs(v) for v in fine], [0.0] * 200, sampled)
    assert got["readout_ms"] == pytest.approx(fine[last_least(costs)], abs=1e-9) and got["cost"] == min(costs)


def test_costs_with_a_smoothed_way_null_lines_and_a_missing_recording(spark):
    """Lines that are null or end nowhere do not count; without samples nothing turns; rows that repeat count twice."""
    match = lines(100_000, 140_000, 0.0, 16.0, 1)
    odd = [*match, None, (None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 2.0, 3.0)]
    rows = [(1, 0, 0, 10**6, 100_000, 140_000, odd), (1, 1, 0, 10**6, 100_000, 140_000, match), (1, 1, 0, 10**6, 100_000, 140_000, match), (2, 0, 0, 10**6, 100_000, 140_000, match), (1, 2, 0, 10**6, 100_000, 140_000, None)]
    pairs, q = tables(spark, rows, 16.0)
    ready = pointsync.with_orientations(pairs.withColumn("q", F.lit(1)), q, q.withColumn("q", Q.conjugate(F.col("q"))), 5000).collect()
    costs = {}
    for r in ready:
        costs.setdefault((r["recording_id"], r["range"]), []).append(pointsync.Pair(r.asDict(True)).costs(np.array([0.0, 1000.0]), np.array([16.0, 16.0])).tolist())
    assert costs[1, 0] == [costs[1, 1][0]] and len(costs[1, 1]) == 2 and costs[1, 2] == [[0, 0]]
    assert costs[2, 0][0][0] == costs[2, 0][0][1] != costs[1, 0][0][0]
    want = plain([rows[1]], [16.0, 16.0], [0.0, 1.0], lambda at: sampled(at) * [1, -1, -1, -1])
    assert costs[1, 1][0] == want


def test_pairs_are_spread_over_tasks(spark):
    """A few bytes, but much work: adaptive execution must not put the pairs into one task."""
    from motionspark.plans import pose as plan
    from tests.conftest import SF

    made, q = plan.matched(spark, SF)
    costs = pointsync._summed(pointsync.with_orientations(made, q, q, 12_000), F.array(F.lit(0.0), F.lit(1.0)), False)
    text = costs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text.split("MapInArrow")[1]


def test_readouts_of_the_query_are_tried_up_to_the_time_of_a_frame(spark):
    """Of every readout time in whole milliseconds between two frames, none costs less than the one that the query finds."""
    from motionspark.plans import pose as plan
    from tests.conftest import SF

    made, q = plan.matched(spark, SF)
    ready = pointsync.with_orientations(made.where("ts_us < to_us"), q, q, 42_000).collect()
    assert {r["next_ts_us"] - r["ts_us"] for r in ready} == {40_000}
    at, costs = np.arange(-40.0, 40.0), {}
    for r in ready:
        key = r["recording_id"], r["range"]
        costs[key] = costs.get(key, 0) + pointsync.Pair(r.asDict(True)).costs(np.zeros(len(at)), at)
    found = {(r["recording_id"], r["range"]): r for r in plan.syn06(spark, SF).collect()}
    assert set(found) == set(costs)
    for key, r in found.items():
        assert r["cost"] <= costs[key].min() and abs(r["readout_ms"] - at[last_least(costs[key].tolist())]) <= 1
