"""Nulls, ties, repeated keys, empty tables and hand-made cases of the core operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.functions import text as X
from motionspark.operators import asof, axisguess, horizon, imu, lens, orient, profiles, ranks, recurrence, series, smooth, sync, syncpoints

Q_TYPE = "recording_id long, ts_us long, q struct<w:double,x:double,y:double,z:double>"
IMU = "recording_id long, ts_us long, gx double, gy double, gz double, ax double, ay double, az double"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_nearest_ties_edges_and_empty_sides(spark):
    left = spark.createDataFrame([(1, 150), (1, 90), (1, 201), (1, 5000), (2, 150)], "recording_id long, ts_us long")
    right = spark.createDataFrame([(1, 100, 1.0), (1, 200, 2.0)], "recording_id long, ts_us long, v double")
    got = dict(((r.recording_id, r.ts_us), r.v) for r in asof.nearest(left, right, "v", 100).collect())
    assert got == {(1, 150): None, (1, 90): 1.0, (1, 201): 2.0, (1, 5000): None, (2, 150): None}
    assert asof.nearest(left.limit(0), right, "v", 100).count() == 0
    assert {r.v for r in asof.nearest(left, right.limit(0), "v", 100).collect()} == {None}


def test_gaps_at_the_limit(spark):
    at = [0, 99_999, 199_999, 300_000, 500_000]
    df = spark.createDataFrame([(1, t) for t in at] + [(2, 7)], "recording_id long, ts_us long")
    assert rows(series.gap_ranges(df), "recording_id", "from_us", "to_us") == [(1, 0, 199_999)]
    assert series.gap_ranges(df.limit(0)).count() == 0


def one_after_another(names):
    """The names as a list takes them up, one by one."""
    shown, used = [], set()
    for name, author in names:
        new = name
        if new in used:
            for k, x in enumerate(shown):
                if x == new:
                    used.discard(x)
                    shown[k] = f"{x} by {names[k][1]}"
                    used.add(shown[k])
                    break
            new = name = f"{name} by {author}"
        i = 2
        while new in used:
            new, i = f"{name} - {i}", i + 1
        used.add(new)
        shown.append(new)
    return shown


def test_unique_names_as_taken_one_by_one(spark):
    rng = np.random.default_rng(2)
    names = [(f"lens {rng.integers(0, 4)}", f"author {rng.integers(0, 3)}") for _ in range(60)]
    df = spark.createDataFrame([(k, n, a) for k, (n, a) in enumerate(names)], "id long, name string, author string")
    assert [r.shown for r in profiles.unique_names(df).orderBy("id").collect()] == one_after_another(names)
    assert profiles.unique_names(df.limit(0)).count() == 0
    assert profiles.unique_names(spark.createDataFrame([(1, "x", None), (2, "x", None)], df.schema)).count() == 2


def test_texts(spark):
    one = spark.createDataFrame([("RED RAW", "V", None, "35mm", 29.97), ("Sony", "", "L", "i", 25.0), (None, "m", "l", "i", 25.0)], "b string, m string, l string, i string, f double")
    got = one.select(X.camera_identifier(F.col("b"), F.col("m"), F.col("l"), F.col("i"), F.lit(10), F.lit(5), F.col("f"), F.lit("x y")).alias("c")).collect()
    assert [r.c for r in got] == ["redraw-v-35mm-10x5@0-xy", "", ""]
    assert one.limit(1).select(X.safe_name(F.lit("a/b\\c:d+e'f\"g h")).alias("c")).first().c == "a-b-c-d-e-f-g-h"
    assert one.limit(1).select(X.keyframe_text(F.lit("Nothing"), F.lit(1.0)).alias("c")).first().c is None


def test_readout_and_size(spark):
    r = spark.createDataFrame([(0.0,), (10_000.0,), (-10_000.5,), (None,)], "r double")
    way, size = imu.readout(F.col("r"))
    assert [tuple(x) for x in r.select(way, size).collect()][:3] == [("TopToBottom", None), ("TopToBottom", 10_000.0), ("RightToLeft", 0.5)]
    fit = imu.output_size(F.lit(1920.0), F.lit(1080.0), F.lit(0.0), F.lit(10.0), F.lit(0))
    assert r.limit(1).select(fit.alias("s")).first().s is None


def test_gaussian_clamps_at_the_ends(spark):
    v = [1.0, None, 4.0, 8.0]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "recording_id long, frame long, v double")
    got = {r.frame: r.smoothed for r in series.gaussian_over_known(df, "v", 4, 1.0).collect()}
    sigma = 5 / 6 * 3
    for i, x in enumerate(v):
        near = [(v[min(max(i + k, 0), 3)], math.exp(-k * k / (2 * sigma * sigma))) for k in range(-2, 3)]
        want = None if x is None else sum(a * g for a, g in near if a is not None) / sum(g for a, g in near if a is not None)
        assert got[i] == (want if want is None else pytest.approx(want))


def test_lowpass_passes_over_unknown_values(spark):
    v = [1.0, None, 2.0, 5.0, None, 3.0]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "recording_id long, ts_us long, v double")
    got = {r.ts_us: r.v for r in recurrence.lowpass(df, ["v"], 10.0, 100.0).collect()}
    k = recurrence.biquad_lowpass(10.0, 100.0)
    want = recurrence.biquad(recurrence.biquad(np.array([x for x in v if x is not None]), k)[::-1], k)[::-1]
    assert [got[i] for i, x in enumerate(v) if x is None] == [None, None]
    assert [got[i] for i, x in enumerate(v) if x is not None] == pytest.approx(list(want))


def test_choice_of_sign(spark):
    cases = {1: ([1.0], [1.0]), 2: ([1.0], [2.0]), 3: ([1.0, 2.0], [9.0]), 4: ([9.0], [1.0, 1.0])}
    df = spark.createDataFrame([(k, neg, c) for k, sides in cases.items() for neg, cs in zip((False, True), sides, strict=True) for c in cs], "recording_id long, negative boolean, cost double")
    assert rows(sync.choose_sign(df), "recording_id", "negative", "n") == [(1, True, 1), (2, False, 1), (4, True, 2)]


def test_robust_line_finds_the_line_among_outliers(spark):
    points = [(1, k * 1_000_000, 0.002 * k * 1000 + 1) for k in range(8)] + [(1, 500_000, 90.0), (2, 0, 1.0)]
    got = sync.robust_line(spark.createDataFrame(points, "recording_id long, ts_us long, offset_ms double")).collect()
    assert [(r.recording_id, r.inliers) for r in got] == [(1, 8)] and got[0].slope == pytest.approx(0.002) and got[0].intercept == pytest.approx(1)


def test_planted_offset(spark):
    t = np.arange(0, 4000, 5.0)
    wave = lambda t: (40 * np.sin(t / 70), 30 * np.cos(t / 110), 20 * np.sin(t / 45 + 1))
    table = lambda t, late: spark.createDataFrame([(1, int(round((a + late) * 1000)), *map(float, v)) for a, v in zip(t, zip(*wave(t), strict=True), strict=True)], "recording_id long, ts_us long, x double, y double, z double")
    found = sync.find_offsets(table(t[100:400:3], 0.0), table(t, -12.34), sync.Grid(0.0, 30.0)).collect()
    # Offsets that find the same samples cost the same, and of these the last counts: up to the next sample, 5 ms later.
    assert len(found) == 1 and abs(found[0].offset_ms - (12.34 + 4.65)) < 0.02
    dense = np.arange(0, 4000, 0.01)
    found = sync.find_offsets(table(t[100:400:3], 0.0), table(dense[48_000:201_000], -12.74), sync.Grid(0.0, 30.0)).collect()
    assert len(found) == 1 and abs(found[0].offset_ms - 12.74) < 0.02
    assert sync.find_offsets(table(t[100:400:3], 0.0), table(t, -29.0), sync.Grid(0.0, 30.0)).count() == 0  # at the rim
    assert sync.find_offsets(table(t[:0], 0.0), table(t, 0.0), sync.Grid(0.0, 30.0)).count() == 0


def test_horizon_is_level_after_the_lock(spark):
    """Turned by the lock, the camera's side stands level: its roll is what was asked for, wherever it looks."""
    rng = np.random.default_rng(5)
    q = rng.standard_normal((40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, k, tuple(map(float, v))) for k, v in enumerate(q)], Q_TYPE)
    half = smooth.lock_horizon(df, 50.0).select("ts_us", F.col("q").alias("half"))
    full = smooth.lock_horizon(df, 100.0).select("ts_us", F.col("q").alias("full"))
    near = df.join(half, "ts_us").join(full, "ts_us").select(Q.angle(Q.multiply(Q.conjugate(F.col("q")), F.col("half"))).alias("a"), Q.angle(Q.multiply(Q.conjugate(F.col("half")), F.col("full"))).alias("b"))
    assert all(r.a == pytest.approx(r.b, abs=1e-6) for r in near.collect())
    assert smooth.lock_horizon(df.limit(0), 100.0).count() == 0


def test_tilt_without_turns_or_rows(spark):
    still = spark.createDataFrame([(1, k * 20_000, (1.0, 0.0, 0.0, 0.0)) for k in range(5)], Q_TYPE)
    assert {r.tilt_deg for r in horizon.dynamic_tilt(still, horizon.Tilt()).collect()} == {0.0}
    assert horizon.dynamic_tilt(still.limit(0), horizon.Tilt()).count() == 0


def test_integration_starts_a_step_before_the_first_sample(spark):
    samples = [(1, 1_000_000 + k * 10_000, 0.0, 90.0, 0.0, 0.0, 0.0, 9.81) for k in range(3)] + [(1, 1_030_000, None, None, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(samples, IMU)
    q = {r.ts_us: r.q for r in orient.integrate(df, 3, duration_ms=80.0).collect()}
    assert set(q) == {1_000_000, 1_010_000, 1_020_000}
    first = recurrence.product(orient.START, recurrence.exp_map(np.radians([-90.0, 0.0, 0.0]) * 0.02))  # 80 ms over four samples
    assert list(q[1_000_000]) == pytest.approx(list(first))
    for method in orient.INTEGRATORS:
        assert orient.integrate(df.limit(0), method).count() == 0
        assert orient.integrate(df, method).where("q.w is null or isnan(q.w)").count() == 0


@pytest.mark.parametrize("model", sorted(lens.OUT))
def test_lens_points_without_a_place(spark, model):
    df = spark.createDataFrame([(0.1, 0.2, [0.1, 0.9]), (None, 0.1, [0.1]), (0.1, 0.1, None), (0.0, 0.0, [0.05, 0.9]), (1e6, 1e6, [-5.0, 0.9])], "x double, y double, k array<double>")
    for f in (lens.distorted, lens.undistorted):
        got = df.select(f(model, F.col("x"), F.col("y"), F.col("k")).alias("p")).select("p.x", "p.y").collect()
        assert got[1].x is None and all((r.x is None) == (r.y is None) and (r.x is None or math.isfinite(r.x)) for r in got)
    assert df.limit(0).select(lens.radial_limit(model, F.col("k"))).count() == 0


def test_splines_and_ranks_of_windows(spark):
    knots = spark.createDataFrame([(1, k * 10, float(k * k)) for k in range(5)], "recording_id long, ts_us long, v double")
    left = spark.createDataFrame([(1, -1), (1, 0), (1, 15), (1, 39), (1, 40), (2, 5)], "recording_id long, ts_us long")
    got = {(r.recording_id, r.ts_us): r.v for r in series.catmull_rom(left, knots, "v").collect()}
    assert got[1, 15] == pytest.approx(2.25) and got[1, 0] == 0.0
    assert [got[k] for k in ((1, -1), (1, 40), (2, 5))] == [None, None, None]
    short = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0), (1, 1000, 1.0, 1.0, 1.0)], "recording_id long, ts_us long, gx double, gy double, gz double")
    assert syncpoints.sync_ranks(short).count() == 0


def test_places_in_one_order(spark):
    df = spark.createDataFrame([(k, f"n{k % 37:03d}") for k in range(500)] + [(500, None)], "id long, name string")
    got = [r.id for r in ranks.ranked(df, "name", "place", "id").orderBy("place").collect()]
    assert got == [500] + [r[1] for r in sorted((f"n{k % 37:03d}", k) for k in range(500))]
    assert sorted(r.place for r in ranks.ranked(df, "name", "place", "id").collect()) == list(range(1, 502))
    assert ranks.ranked(df.limit(0), "name", "place", "id").count() == 0


def test_best_profile(spark):
    r = spark.createDataFrame([(1, "c", "a", 1920, 1080, 30.0), (2, "c", "", 1920, 1080, 30.0), (3, "c", "zz", 1280, 720, 50.0), (4, "d", "a", 1, 1, 1.0), (5, None, "a", 1920, 1080, 30.0)], "recording_id long, camera string, identifier string, width int, height int, fps double")
    p = spark.createDataFrame([(10, "c", "", 1920, 1080, 25.0), (11, "c", "a", 640, 480, 30.0), (12, "c", "b", 1920, 1080, 30.0), (13, "c", "q", 3840, 2160, 50.0)], "id long, camera string, identifier string, width int, height int, fps double")
    assert rows(profiles.match_profiles(r, p), "recording_id", "id") == [(1, 11), (2, 12), (3, 10)]


def test_best_profile_never_pairs_a_camera(spark):
    """One camera of 40,000 recordings and 40,000 profiles: keys are looked up, 1.6 billion pairs are not."""
    side = lambda name, n: spark.range(n).select(F.col("id").alias(name), F.lit("c").alias("camera"), F.concat(F.lit("n"), F.col("id") % 50_000).alias("identifier"), (F.col("id") % 500 + 1).alias("width"), (F.col("id") % 7 + 1).alias("height"), F.lit(30.0).alias("fps"))
    got = profiles.match_profiles(side("recording_id", 40_000), side("id", 40_000))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 4 and all("Aggregate" in plan.split(j)[1] for j in joins)
    assert got.where("id != recording_id").count() == 0 and got.count() == 40_000


def test_samples_of_one_time_in_any_order(spark):
    """Which of them is met does not hang on the order in which the rows arrive."""
    seen = [(1, t * 1000, float(t % 7 * 9), 5.0, float(t % 3)) for t in range(60)]
    gyro = [(1, t * 1000, *v) for t in range(60) for v in ((float(t % 7 * 9) + 1, 5.0, float(t % 3)), (float(t % 7 * 9), 8.0, 2.0))]
    schema = "recording_id long, ts_us long, x double, y double, z double"
    a = spark.createDataFrame(seen, schema)
    for search in (sync.find_offsets, axisguess.orientation_costs):
        one, other = (sorted(map(tuple, search(a, spark.createDataFrame(g, schema).coalesce(1), sync.Grid(0.0, 10.0)).collect())) for g in (gyro, gyro[::-1]))
        assert one == other and one


def test_adaptive_average_step_by_step():
    x = np.array([np.nan, 10.0, 10.5, np.nan, 12.0, 30.0, 30.0, np.nan])
    fps, top = 30.0, 5.0
    slow, fast = (1 - math.exp(-(1 / fps) / t) for t in (1.0, 0.1))
    v = [0.0] * len(x)
    for i in range(1, len(x)):
        if not math.isnan(x[i]) and not math.isnan(x[i - 1]):
            v[i] = abs((x[i] - x[i - 1]) * fps / x[i - 1])
    v[0] = v[1]
    for i in range(1, len(x)):
        v[i] = v[i - 1] * (1 - fast) + v[i] * fast
    for i in range(len(x) - 2, -1, -1):
        v[i] = v[i + 1] * (1 - fast) + v[i] * fast
    a = [slow * (1 - min(y / top, 1)) + fast * min(y / top, 1) for y in v]
    want, state = [math.nan] * len(x), 10.0
    for i in range(1, len(x)):
        state = state if math.isnan(x[i]) else state * (1 - a[i]) + x[i] * a[i]
        want[i] = state
    for i in range(len(x) - 1, 0, -1):
        state = state * (1 - a[i]) + want[i] * a[i]
        want[i] = state
    assert recurrence.adaptive_ema(x, fps, 1.0, 0.1, top) == pytest.approx(want, nan_ok=True)
    assert np.isnan(recurrence.adaptive_ema(np.full(3, np.nan), fps, 1.0, 0.1, top)).all()


def test_focal_lengths_step_by_step(spark):
    """Rows near the frames, steps smoothed over seven rows, then the average; a frame without a lens row asks for nothing."""
    from motionspark.operators import focal

    lens_rows = [(1, k * 40_000 + 3, 24.0 + (k // 4)) for k in range(20) if k not in (5, 6)]
    frames = spark.createDataFrame([(1, k, k * 40_000) for k in range(20)] + [(2, 0, 0)], "recording_id long, frame long, ts_us long")
    rows = spark.createDataFrame(lens_rows, "recording_id long, ts_us long, focal_length double")
    got = {(r.recording_id, r.frame): r for r in focal.smooth_focal_lengths(frames, rows, 12.0, 0.4).collect()}
    assert len(got) == 21 and got[2, 0].compensation == 1.0 and got[2, 0].even is None
    even = np.array([got[1, k].even if got[1, k].even is not None else math.nan for k in range(20)])
    want = recurrence.adaptive_ema(even, 12.0, *focal.constants(0.4))
    assert [got[1, k].smoothed for k in range(20)] == pytest.approx(list(want))
    assert got[1, 10].compensation == pytest.approx(even[10] / want[10])
    assert focal.constants(0.0) == pytest.approx((0.1, 0.05, 0.3)) and focal.constants(2.0) == pytest.approx((30.0, 0.4, 8.0))
