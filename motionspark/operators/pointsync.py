"""Offsets between video and gyro, and readout times, from points matched in two frames: what is still in the world
should stand still once the frames are stabilised.

A frame pair is a row (recording_id, range, ts_us, next_ts_us, camera, lines).  ``with_orientations`` gives it the samples that
any offset may ask for; then a pair knows its costs of all offsets, and the costs of a range are sums over its pairs.
So pairs are the unit of work, and what is shuffled is one number for each offset of a pair, added up before the
exchange.  Costs are sums of whole numbers: their order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.operators import warp
from motionspark.operators.lens import BACK

BY = ("recording_id", "range")
# Share of the matches that count, the closest; share of the search in which an offset is believed; steps of the fine search.
COUNTED, BELIEVED, FINE, FINE_MS = 0.9, 0.9, 200, 0.01
BLOCK = 200_000  # points times offsets held at a time


def with_orientations(pairs: DataFrame, samples: DataFrame, smoothed: DataFrame, reach_us: int) -> DataFrame:
    """Adds ``times``, ``quats``, ``smooth_times`` and ``smooth_quats``: samples (recording_id, ts_us, q) of each kind from ``reach_us``
    before the earlier frame and its readout to as much after the later one, with the ones around.  A pair without a recording gets none."""
    keyed = pairs.withColumn("frame", F.xxhash64("ts_us", "next_ts_us", "camera.readout_ms"))
    half = (F.col("next_ts_us") - F.col("ts_us") + F.abs(F.coalesce("camera.readout_ms", F.lit(0.0))) * 1000) / 2000 + reach_us / 1000.0
    spans = keyed.select("recording_id", "frame", F.floor((F.col("ts_us") + F.col("next_ts_us")) / 2).alias("ts_us"), F.struct((half * 2).alias("readout_ms")).alias("camera")).distinct()
    a = warp.covered(spans, samples).select("recording_id", "frame", "times", "quats")
    b = warp.covered(spans, smoothed).select("recording_id", "frame", F.col("times").alias("smooth_times"), F.col("quats").alias("smooth_quats"))
    return keyed.join(a, ["recording_id", "frame"], "left").join(b, ["recording_id", "frame"], "left").drop("frame")


class Pair:
    """One frame pair: its rays once, its cost for any offsets and readout times."""

    def __init__(self, row: dict):
        self.frame = f = warp.Frame(row | {"smooth": None})
        self.smooth = np.array(row["smooth_times"] or [], np.float64), np.array(row["smooth_quats"] or [], np.float64).reshape(-1, 4)
        at = np.array([[v[c] for c in ("x1", "y1", "x2", "y2")] for v in row["lines"] or [] if v is not None], np.float64).reshape(-1, 4)
        at = at[np.isfinite(at).all(1)]
        self.ends = [(row[ts], *self._rays(at[:, i], at[:, i + 1])) for ts, i in (("ts_us", 0), ("next_ts_us", 2))]
        a = np.radians(f.rotation_deg)
        self.tilt = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        self.size = len(at)

    def _rays(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = self.frame
        u, v = f.lens(BACK, (x - f.cx) / f.fx, (y - f.cy) / f.fy)
        known = np.isfinite(u) & np.isfinite(v)
        grown = f.refracted(np.hypot(np.where(known, u, 0), np.where(known, v, 0)), False)
        line = x / f.width if f.horizontal else y / f.height
        return np.stack([u * grown, v * grown, np.ones_like(u)], 1), line

    def places(self, end: int, shift_us: np.ndarray, readout_ms: np.ndarray) -> np.ndarray:
        """(offsets, points, 2): where the points of a frame stand in the stabilised view, for each offset and readout time."""
        ts, rays, line = self.ends[end]
        f = self.frame
        at = ts - shift_us
        now = warp.hamilton(warp.between(at, *self.smooth), warp.between(at, f.times, f.quats) * [1, -1, -1, -1])
        readout = np.abs(readout_ms) * 1000 * (-1 if f.reversed else 1)
        when = at[:, None] + readout[:, None] * (line - 0.5)
        turns = warp.hamilton(now[:, None], warp.between(when.ravel(), f.times, f.quats).reshape(*when.shape, 4))
        flip = np.array([1.0, -1, -1])
        r = (self.tilt @ warp.rotation_matrix(turns)) * (flip[:, None] * flip)
        p = f.view(1.0) @ (r @ rays[..., None])
        with np.errstate(all="ignore"):
            return p[..., :2, 0] / p[..., 2:, 0]

    def costs(self, shift_us: np.ndarray, readout_ms: np.ndarray) -> np.ndarray:
        """Sum of the smaller squared distances, in whole square pixels, between the two ends of each match inside the view."""
        out, step = np.zeros(len(shift_us), np.int64), max(1, BLOCK // max(self.size, 1))
        size = np.array([self.frame.width, self.frame.height])
        for i in range(0, len(out), step) if self.size else ():
            a, b = (self.places(end, shift_us[i : i + step], readout_ms[i : i + step]) for end in (0, 1))
            inside = ((a > 0) & (a < size) & (b > 0) & (b < size)).all(-1)
            off = np.sort(np.where(inside, np.floor(((b - a) ** 2).sum(-1)), np.inf), axis=1)
            counted = (inside.sum(1) * COUNTED).astype(int)
            out[i : i + step] = np.where(np.arange(off.shape[1]) < counted[:, None], off, 0).sum(1)
        return out


def _summed(pairs: DataFrame, grid: Column, readout: bool) -> DataFrame:
    """(recording_id, range, at, cost): of each range the cost of each place of its ``grid``, an array of milliseconds."""
    wanted = ["recording_id", "range", "ts_us", "next_ts_us", "camera", "lines", "times", "quats", "smooth_times", "smooth_quats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                costs = []
                for row in part.to_pylist():
                    at = np.array(row["grid"], np.float64)
                    pair = Pair(row)
                    still = np.full(len(at), float(pair.frame.readout_ms))
                    costs.append(pair.costs(np.zeros(len(at)), at) if readout else pair.costs(at * 1000, still))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*BY, "grid")), pa.array(costs, pa.list_(pa.int64()))], [*BY, "grid", "costs"])

    # Pairs are few bytes and much work: without a fixed number adaptive execution would put them into a few tasks.
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    spread = pairs.select(*wanted, grid.alias("grid")).repartition(tasks, *BY, "ts_us")
    each = spread.mapInArrow(run, "recording_id long, range long, grid array<double>, costs array<long>")
    nth = each.select(*BY, F.posexplode(F.arrays_zip("grid", "costs")).alias("n", "v"))
    return nth.groupBy(*BY, "n").agg(F.first("v.grid").alias("at"), F.sum("v.costs").alias("cost"))


def _least(costs: DataFrame) -> DataFrame:
    """(recording_id, range, at, cost): the place of least cost, the last of equal ones."""
    best = costs.groupBy(*BY).agg(F.min(F.struct(F.col("cost"), (-F.col("n")).alias("n"), F.col("at"))).alias("b"))
    return best.select(*BY, F.col("b.at").alias("at"), F.col("b.cost").alias("cost"))


def _search(pairs: DataFrame, coarse: Sequence[float], readout: bool) -> DataFrame:
    """The least of whole milliseconds, then of hundredths from one before it to one after."""
    first = _least(_summed(pairs, F.array(*(F.lit(float(v)) for v in coarse)), readout)).select(*BY, F.col("at").alias("rough"))
    fine = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.col("rough") - 1.0 + i.cast("double") * F.lit(FINE_MS))
    return _least(_summed(pairs.join(first, list(BY)), fine, readout))


def offsets_by_points(pairs: DataFrame, samples: DataFrame, smoothed: DataFrame, initial_ms: float, search_ms: float) -> DataFrame:
    """(recording_id, range, middle_ms, offset_ms, cost): of each sync range the offset at which its stabilised matches move least.

    ``pairs`` has ``from_us`` and ``to_us`` of its range and takes part if its earlier frame lies in it.  Offsets are tried from half of ``search_ms``
    before ``initial_ms``; a range whose best one is 0.9 of the search away has no row, nor has one without pairs.  A pair without
    matches costs nothing, wherever it is put: a range of such pairs gets the last offset tried.
    """
    coarse = [initial_ms - search_ms / 2 + i for i in range(int(search_ms))]
    if not coarse:
        raise ValueError("the search covers less than a millisecond")
    inside = pairs.where((F.col("ts_us") >= F.col("from_us")) & (F.col("ts_us") < F.col("to_us")))
    reach = int((max(abs(coarse[0]), abs(coarse[-1])) + 2) * 1000)
    ready = with_orientations(inside, samples, smoothed, reach)
    middle = pairs.groupBy(*BY).agg(F.first("from_us").alias("from_us"), F.first("to_us").alias("to_us"))
    found = _search(ready, coarse, False).where(F.abs(F.col("at") - initial_ms) < BELIEVED * search_ms).join(middle, list(BY))
    return found.select(*BY, ((F.col("from_us") + F.col("to_us")) / 2000.0).alias("middle_ms"), F.col("at").alias("offset_ms"), F.col("cost").cast("double").alias("cost"))


def readouts_by_points(pairs: DataFrame, samples: DataFrame, smoothed: DataFrame, fps: float) -> DataFrame:
    """(recording_id, range, readout_ms, cost): the readout time at which the stabilised matches move least; pairs and samples share a clock.

    Times of both signs up to that of a frame are tried, but it is the camera that says in which direction it reads: only
    their size counts.
    """
    steps = int(1000.0 / fps)
    inside = pairs.where((F.col("ts_us") >= F.col("from_us")) & (F.col("ts_us") < F.col("to_us")))
    ready = with_orientations(inside, samples, smoothed, int(1e6 / fps) + 2000)
    return _search(ready, range(-steps, steps), True).select(*BY, F.col("at").alias("readout_ms"), F.col("cost").cast("double").alias("cost"))
