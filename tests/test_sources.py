"""Logs, exports and streams against the files and batches that they come from."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.operators import recurrence, series
from motionspark.sources import exports, logs
from motionspark.streaming import frames, samples


def log(path, times, scale="0.001", first="CAMERA IMU LOG"):
    path.write_text("\n".join([first, "version,1.3", *([f"tscale,{scale}"] if scale else []), "t,gx,gy,gz,ax,ay,az", *(f"{t},1,2,3,0.5,x,9.8" for t in times), "", "end"]) + "\n")


def test_logs_of_clocks_that_start_anew(spark, tmp_path):
    log(tmp_path / "clip10.gcsv", [0, 10, 20], None)
    log(tmp_path / "clip9.gcsv", [5, 15, 25, 35], None)
    log(tmp_path / "other.gcsv", [1, 2], first="something else")
    got = logs.read_logs(spark, str(tmp_path))
    assert got.count() == 7 and {(r.scale, r.ay) for r in got.collect()} == {(0.001, None)}
    merged = logs.merge_logs(got)
    assert sorted((r.part, r.t) for r in merged.collect()) == [(1, 5.0), (1, 15.0), (1, 25.0), (1, 35.0), (2, 45.0), (2, 55.0), (2, 65.0)]
    assert sorted(r.point_ms for r in logs.seam_points(got).collect()) == pytest.approx([-455.0, 545.0, 1045.0, 2045.0, 2545.0])
    assert logs.merge_logs(got.limit(0)).count() == 0


def test_logs_of_one_clock(spark, tmp_path):
    log(tmp_path / "a1.gcsv", [0, 10], "1")
    log(tmp_path / "a2.gcsv", [20, 30], "1")
    got = logs.merge_logs(logs.read_logs(spark, str(tmp_path)))
    assert sorted(r.t for r in got.collect()) == [0.0, 10.0, 20.0, 30.0]


def test_camera_export_round_trip(spark, tmp_path):
    q = "struct<w:double,x:double,y:double,z:double>"
    df = spark.createDataFrame([(1, 0, 0, (1.0, 0.0, 0.0, 0.0), None, 24.0, 1.0), (1, 1, 20_000, (0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), None, 1.5)], f"recording_id long, frame long, ts_us long, raw {q}, smooth {q}, focal_length double, fov double")
    rows = exports.camera_rows(df)
    assert [(r.focal_length, r.smooth_yaw) for r in rows.orderBy("frame").collect()] == [(24.0, None), (24.0, 0.0)]
    for kind in ("csv", "json"):
        exports.write_cameras(rows, str(tmp_path / kind), kind, ["frame", "raw_roll", "fov"])
        back = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert sorted((int(r.frame), float(r.raw_roll), float(r.fov), r.recording_id) for r in back.collect()) == [(0, 0.0, 1.0, 1), (1, 180.0, 1.5, 1)]
    with pytest.raises(ValueError):
        exports.write_cameras(rows, str(tmp_path / "x"), "exr")


def moments(spark, at):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, start + datetime.timedelta(microseconds=t), v) for r, t, v in at], "recording_id long, ts timestamp, v double")


def streamed(spark, tmp_path, batches, query, name):
    path = str(tmp_path / "in")
    for k, b in enumerate(batches):
        moments(spark, b).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = spark.readStream.schema("recording_id long, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    running = query(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    return spark.table(name)


def test_gap_ranges_of_a_stream(spark, tmp_path):
    first = [(1, t, 1.0) for t in (0, 99_999, 199_999, 300_000, 500_000)] + [(2, 40, 1.0), (2, 40_000, 1.0)]
    batches = [first[1::2], first[::2], [(1, 60_000_000, 1.0), (2, 60_000_000, 1.0)], [(1, 90_000_000, 1.0)]]
    got = streamed(spark, tmp_path, batches, lambda s: samples.gap_ranges_stream(s), "gaps")
    base = moments(spark, first).select("recording_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    want = series.gap_ranges(base)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("recording_id", "from_us", "to_us").collect()))


def test_average_of_a_stream(spark, tmp_path):
    values = [(r, k * 1000 + r, float((k * 7) % 5)) for r in (1, 2) for k in range(12)]
    batches = [[v for v in values if v[1] < 5000][::-1], [v for v in values if v[1] >= 5000] + [(1, 10, 99.0)]]  # the last one is too old
    got = streamed(spark, tmp_path, batches, lambda s: samples.ema_stream(s, "v", 0.25), "averages")
    for r in (1, 2):
        want = recurrence.ema(np.array([v for a, _, v in values if a == r]), 0.25, both=False)
        assert [x.ema for x in got.where(f"recording_id = {r}").orderBy("ts").collect()] == pytest.approx(list(want))


def test_frames_in_any_order_pair_up_at_once(spark, tmp_path):
    """Neighbours across batches, repeated frames, a number left out, one too far off; the state forgets what the watermark has passed."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda ms: start + datetime.timedelta(milliseconds=ms)
    schema = "recording_id long, frame long, ts timestamp, tag string"
    feed = [(r, n, at(n * 40), f"{r}-{n}") for r in (1, 2) for n in range(30) if n != 17] + [(3, 0, at(0), "a"), (3, 1, at(1400), "b"), (3, 2, at(1300), "before"), (None, 0, at(0), "n"), (None, 1, at(40), "n")]
    shuffled = sorted(feed, key=lambda v: hash((v[0] or 0, v[1] * 7919 % 31)))
    batches = [shuffled[k::4] for k in range(4)]
    batches[2] = batches[2] + batches[0][:9] + [(1, 3, at(120), "again")]  # frames that are there already
    batches += [[(9, 0, at(60_000 + k * 30_000), "later")] for k in range(3)] + [[(1, 0, at(0), "too late")]]
    path = str(tmp_path / "in")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    running = frames.frame_pairs(stream).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(180)
    columns = ["recording_id", "frame", "ts", "next_ts"]
    got = sorted(tuple(r) for r in spark.table("pairs").select(*columns).collect())
    want = sorted((r, n, at(n * 40), at(n * 40 + 40)) for r in (1, 2) for n in range(29) if n not in (16, 17))
    assert got == want
    table = frames.frame_pairs(spark.createDataFrame(feed + batches[0][:9], schema))
    assert sorted(tuple(r) for r in table.select(*columns).collect()) == want
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in running.recentProgress if p["stateOperators"]]
    assert max(kept) > 100 and kept[-1] <= 10
    assert frames.frame_pairs(spark.createDataFrame(feed, schema), apart="2 seconds").where("recording_id = 3").count() == 1
    assert frames.frame_pairs(spark.createDataFrame([], schema)).count() == 0


def test_turns_of_a_feed(spark, tmp_path):
    """A stream of frames with their lines gives the turns that a table of them gives."""
    from tests.test_pose import camera, lines, scene

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, n, start + datetime.timedelta(milliseconds=40 * n), lines(*scene(40, n, np.array([0.01 * n, 0.02, -0.01])))) for n in (3, 0, 2, 1)]
    schema = "recording_id long, frame long, ts timestamp, lines array<struct<x1: double, y1: double, x2: double, y2: double>>"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumn("camera", camera())
    running = frames.pose_feed(stream).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(180)
    got = sorted(spark.table("turns").collect())
    assert got == sorted(frames.pose_feed(spark.createDataFrame(rows, schema).withColumn("camera", camera())).collect()) and len(got) == 3
    assert [round(2 * r["q"]["x"], 4) for r in got] == [0.0, 0.01, 0.02]
