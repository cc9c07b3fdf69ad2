"""Orientations outside trim ranges, by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from motionspark.operators import trim

QUAT = "struct<w: double, x: double, y: double, z: double>"


def about_z(degrees):
    return (math.cos(math.radians(degrees / 2)), 0.0, 0.0, math.sin(math.radians(degrees / 2)))


def test_held_and_turned(spark):
    """A sample each 10 us, turned by its own number of degrees."""
    samples = spark.createDataFrame([(r, t, about_z(t), "kept") for r in (1, 2, 3, 4, 5) for t in range(0, 130, 10)] + [(None, 0, about_z(5), "kept")], f"recording_id long, ts_us long, q {QUAT}, next string")
    trims = spark.createDataFrame(
        [(1, 15, 30), (1, 75, 90), (1, 75, 90), (1, 50, 40), (1, None, 3), (2, 500, 600), (3, 41, 44), (3, 45, 48), (3, 80, 80), (4, -50, -10), (None, 0, 1)], "recording_id long, from_us long, to_us long"
    )
    out = trim.hold_outside(samples, trims)
    assert out.columns == samples.columns and {r["next"] for r in out.collect()} == {"kept"}
    got = {(r["recording_id"], r["ts_us"]): round(math.degrees(2 * math.atan2(r["q"]["z"], r["q"]["w"])), 6) for r in out.collect()}
    line = lambda r: [got[r, t] for t in range(0, 130, 10)]
    # Before: the first sample in the range, 20.  Between: from 40, the first behind it, to 80.  Behind: 80, the last before 90.
    assert line(1) == pytest.approx([20, 20, 20, 30, 40, 50, 60, 70, 80, 90, 80, 80, 80])
    assert line(2) == pytest.approx(list(range(0, 130, 10)))  # no sample from its start on
    # Ranges without a sample of their own: 50 is first in or behind the first, and the gap from there leads to 80; the last sample before 80 is 70.
    assert line(3) == pytest.approx([50, 50, 50, 50, 50, 50, 60, 70, 80, 70, 70, 70, 70])
    assert line(4) == line(5) == pytest.approx(list(range(0, 130, 10)))  # nothing before its end; no ranges
    assert trim.hold_outside(samples, trims.limit(0)).exceptAll(samples).count() == 0
    assert trim.hold_outside(samples.limit(0), trims).count() == 0
    assert out.where(F.col("recording_id").isNull()).count() == 1


def test_samples_without_an_edge_may_go(spark):
    """A range that starts behind the recording, one that ends before it, and a recording without ranges."""
    samples = spark.createDataFrame([(r, t, about_z(t)) for r in (1, 2, 3, 4) for t in range(0, 40, 10)], f"recording_id long, ts_us long, q {QUAT}")
    trims = spark.createDataFrame([(1, 500, 600), (2, -50, -10), (4, 10, 20)], "recording_id long, from_us long, to_us long")
    kept = trim.hold_outside(samples, trims, missing="drop")
    assert {r["recording_id"]: r["count"] for r in kept.groupBy("recording_id").count().collect()} == {3: 4, 4: 4}
    assert trim.hold_outside(samples, trims).count() == 16
