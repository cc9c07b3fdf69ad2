"""The gyro's axes: planted codes, and costs of all codes against a gyro that was really turned."""

from __future__ import annotations

import numpy as np
import pytest

from motionspark.operators import axisguess, sync
from motionspark.operators.profiles import AXIS_CODES


def turned(code, v):
    return np.stack([v[:, "xyz".index(c.lower())] * (1 if c.isupper() else -1) for c in code], 1)


def test_costs_are_those_of_turned_gyros():
    r = np.random.default_rng(0)
    est_ms, est, t, g = np.sort(r.uniform(0, 900, 40)), r.normal(0, 20, (40, 3)), np.arange(0.0, 10**6, 5000), r.normal(0, 20, (200, 3))
    g[::17] = np.nan
    offsets = np.array([-30.0, 0.0, 12.5, 800.0])
    got = axisguess.code_costs(est_ms, est, t, g, offsets)
    assert len(set(AXIS_CODES)) == 48
    for k, code in enumerate(AXIS_CODES):
        assert got[:, k] == pytest.approx(sync.alignment_costs(est_ms, est, t, turned(code, g), offsets))


def test_planted_codes(spark):
    """Two ranges of a recording, one that stands still, one without a gyro."""
    t = np.arange(0, 2000, 5.0)
    way = lambda t: np.stack([40 * np.sin(t / 90), 25 * np.cos(t / 41), 30 * np.sin(t / 23 + 1)], 1)
    seen, gyro = [], []
    for rec, code in ((1, "zXy"), (2, "XYZ"), (3, "yxZ")):
        for part in (0, 1):
            at = t[part * 150 : part * 150 + 100]
            seen += [(rec, part, int(x * 1000), *map(float, v)) for x, v in zip(at, turned(code, way(at)) * (0 if rec == 3 else 1), strict=True)]
            gyro += [(rec, part, int((x - 3) * 1000), *map(float, v)) for x, v in zip(t, way(t), strict=True)]
    seen += [(4, 0, 0, 9.0, 9.0, 9.0), (1, 0, 5, None, 1.0, 2.0), (None, 0, 5, 9.0, 1.0, 2.0)]
    schema = "recording_id long, range long, ts_us long, x double, y double, z double"
    a, b = spark.createDataFrame(seen, schema), spark.createDataFrame(gyro, schema)
    costs = axisguess.orientation_costs(a, b, sync.Grid(0.0, 10.0), ["recording_id", "range"])
    assert {(r["recording_id"], r["code"]) for r in axisguess.guess_orientation(costs).collect()} == {(1, "zXy"), (2, "XYZ")}
    assert costs.count() == 96
    tie = spark.createDataFrame([(1, "XYZ", 1.0), (1, "zXy", 1.0), (1, "yxZ", 2.0)], "recording_id long, code string, cost double")
    assert axisguess.guess_orientation(tie).first()["code"] == "zXy"
    assert axisguess.orientation_costs(a.limit(0), b, sync.Grid(0.0, 10.0)).count() == 0


def test_costs_do_not_hang_on_the_order_of_rows():
    """A large distance swallows small ones that are added to it one by one."""
    n = 2001
    t = np.arange(n) + 100.0
    g = np.ones((n, 3)) * [1.0, 0.0, 0.0]
    g[0, 0] = 1e8
    want = float(70 * 10**16 + 70 * (n - 1)) / n
    for rows in (g, g[::-1]):
        assert sync.alignment_costs(t, np.zeros((n, 3)), t * 1000, rows, np.array([0.0])).tolist() == [want]


def test_costs_are_rounded_as_the_sql_rounds_them(spark, monkeypatch):
    """DuckDB rounds ten thousand times the cost: 14547.677749999999 becomes 14547.6778."""
    from motionspark.plans import sync as plan
    from tests.conftest import SF

    cost = 14547.677749999999
    found = lambda *_: spark.createDataFrame([(1, 2.0, 3.5, cost)], "recording_id long, middle_ms double, offset_ms double, cost double")
    monkeypatch.setattr(sync, "find_offsets", found)
    assert plan.syn04(spark, SF).first()["cost"] == 14547.6778
