"""Which way the gyro is built in: of the 48 axis codes the one under which its rates fit those seen in the video best."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.operators.profiles import AXIS_CODES
from motionspark.operators.sync import LEAST_RATE, WEIGHTS, Grid

AXES = ("x", "y", "z")
PLACE = np.array([["xyz".index(c.lower()) for c in code] for code in AXIS_CODES])
SIGN = np.array([[1.0 if c.isupper() else -1.0 for c in code] for code in AXIS_CODES])


def code_costs(est_ms: np.ndarray, est: np.ndarray, gyro_us: np.ndarray, gyro: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(offsets, 48): what ``sync.alignment_costs`` would give for the gyro under each code.

    A code moves and turns columns, so the squares of both sides and the nine products of their columns tell the costs of all codes.
    """
    known = np.isfinite(gyro).all(axis=1)
    out = np.full((len(offsets), len(AXIS_CODES)), np.inf)
    axes = np.arange(3)
    for i, o in enumerate(offsets):
        at = np.searchsorted(gyro_us, np.maximum(np.trunc((est_ms - o) * 1000), 0))
        hit = at < len(gyro_us)
        at, own = at[hit], est[hit]
        own, at = own[known[at]], at[known[at]]
        if len(at) > len(est_ms) // 2:
            own_squares, squares, products = (own**2).sum(0), (gyro[at] ** 2).sum(0), own.T @ gyro[at]
            out[i] = np.maximum((own_squares - 2 * SIGN * products[axes, PLACE] + squares[PLACE]) @ WEIGHTS / len(at), 0)
    return out


def orientation_costs(estimated: DataFrame, gyro: DataFrame, grid: Grid, by: Sequence[str] = ("recording_id",)) -> DataFrame:
    """(recording_id, code, cost): the least costs of the grid's offsets, added up over the keys ``by`` (a recording's sync ranges).

    Rows are (*by, ts_us, x, y, z); a key whose video does not move, or meets no gyro, adds nothing; of
    samples of one time the first by its rates counts.  The unit of work is a key, on arrays.
    """
    by = list(by)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"recording_id": [], "code": pd.Series([], dtype=object), "cost": []})
        if not len(a) or not len(b):
            return none
        a, b = a.sort_values(["ts_us", *AXES]), b.sort_values(["g_ts_us", *(f"g_{c}" for c in AXES)])
        est_ms, est = a["ts_us"].to_numpy(float) / 1000, a[list(AXES)].to_numpy(float)
        if not np.nanmax(np.abs(est), initial=0) >= LEAST_RATE:
            return none
        t = b["g_ts_us"].to_numpy(float) / 1000
        near = (t + grid.initial >= est_ms[0] - grid.search) & (t + grid.initial <= est_ms[-1] + grid.search)
        costs = code_costs(est_ms, est, np.trunc(t[near] * 1000), b[[f"g_{c}" for c in AXES]].to_numpy(float)[near], grid.coarse())
        best = costs.min(axis=0, initial=np.inf)
        if not np.isfinite(best).all():
            return none
        return pd.DataFrame({"recording_id": a["recording_id"].iloc[0], "code": pd.Series(AXIS_CODES, dtype=object), "cost": best})

    left = estimated.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(*by, "ts_us", *AXES).groupBy(*by)
    right = gyro.select(*by, *(F.col(c).alias(f"g_{c}") for c in ("ts_us", *AXES))).groupBy(*by)
    each = left.cogroup(right).applyInPandas(run, "recording_id long, code string, cost double")
    return each.groupBy("recording_id", "code").agg(F.sum("cost").alias("cost"))


def guess_orientation(costs: DataFrame) -> DataFrame:
    """(recording_id, code, cost): the code of least cost, the last by name of equal ones."""
    best = costs.groupBy("recording_id").agg(F.min("cost").alias("_least"))
    tied = costs.join(best, "recording_id").where("cost = _least")
    return tied.groupBy("recording_id").agg(F.max("code").alias("code"), F.first("_least").alias("cost"))
