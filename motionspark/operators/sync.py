"""Sync points, offset search and offset maps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.operators import asof
from motionspark.operators import recurrence as R

BY = ("recording_id",)


def in_ranges(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Inside any closed range; without ranges everywhere."""
    return reduce(lambda a, b: a | b, [value.between(lo, hi) for lo, hi in ranges]) if ranges else F.lit(True)


def zero_out(ranks: DataFrame, ratio_s: float, trims_s: Sequence[tuple[float, float]], least: float = 50.0, edge_s: float = 2.0, long_s: float = 12.0) -> DataFrame:
    """Ranks below ``least``, outside the trims, and at both ends of longer recordings become 0."""
    time = F.col("idx") * F.lit(ratio_s)
    total = F.count(F.lit(1)).over(Window.partitionBy(*BY)) * F.lit(ratio_s)
    ends = (total > long_s) & ((time < edge_s) | (time >= total - edge_s))
    keep = (F.col("rank") >= least) & in_ranges(time, trims_s) & ~ends
    return ranks.withColumn("rank", F.when(keep, F.col("rank")).otherwise(F.lit(0.0)))


def midpoint_rates(rates: DataFrame, on: str = "ts_us") -> DataFrame:
    """Rates between two frames belong to the time in their middle; x and y swapped, in degrees."""
    after = F.lead(on).over(Window.partitionBy(*BY).orderBy(on))
    mid = F.coalesce((F.col(on) + after) / F.lit(2), F.col(on)).cast("double")
    return rates.select("*", mid.alias("mid_us"), F.degrees("gy").alias("x"), F.degrees("gx").alias("y"), F.degrees("gz").alias("z"))


def or_estimated(imu: DataFrame, estimated: DataFrame) -> DataFrame:
    """(recording_id, ts_us, gx, gy, gz): the samples of recordings whose gyro was recorded, the estimated rates of all others.

    A recording counts as recorded if any of its samples has a whole rate; its unknown samples stay.  Without either there is no row.
    """
    columns = [*BY, "ts_us", "gx", "gy", "gz"]
    whole = F.col("gx").isNotNull() & F.col("gy").isNotNull() & F.col("gz").isNotNull()
    moving = imu.where(whole).select(*BY).distinct()
    return imu.select(columns).join(moving, list(BY), "left_semi").unionByName(estimated.select(columns).join(moving, list(BY), "left_anti"))


@dataclass
class Grid:
    """Offsets to try, in milliseconds: around ``initial``, first in whole steps, then in hundredths of them up to two steps before the best."""

    initial: float
    search: float
    step: float = 1.0

    def coarse(self) -> np.ndarray:
        return self.initial - self.search + np.arange(int(self.search / self.step) * 2) * self.step

    def fine(self, best: float) -> np.ndarray:
        return best + (-2 * self.step + np.arange(200) * (self.step / 100))


# Weights of the axes, least rate of a recording that moves, share of the search range in which an offset is believed.
WEIGHTS, LEAST_RATE, BELIEVED = np.array([70.0, 70.0, 100.0]), 3.0, 0.9


def alignment_costs(est_ms: np.ndarray, est: np.ndarray, gyro_us: np.ndarray, gyro: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean weighted square distance of the estimated rates, moved by each offset, to the gyro's first row at or after them.

    Infinite unless more than half of the rows meet one with rates.  Sums are exact until they are rounded, so offsets that meet
    the same distances cost the same.
    """
    known = np.isfinite(gyro).all(axis=1)
    out = np.full(len(offsets), np.inf)
    for i, o in enumerate(offsets):
        at = np.searchsorted(gyro_us, np.maximum(np.trunc((est_ms - o) * 1000), 0))
        hit = at < len(gyro_us)
        at, own = at[hit], est[hit]
        own, at = own[known[at]], at[known[at]]
        if len(at) > len(est_ms) // 2:
            x, y, z = (((gyro[at] - own) ** 2) * WEIGHTS).T
            out[i] = math.fsum(x + y + z) / len(at)
    return out


def last_least(costs: np.ndarray) -> int:
    """Place of the smallest cost, the last of equal ones."""
    return len(costs) - 1 - int(np.argmin(costs[::-1]))


def find_offsets(estimated: DataFrame, gyro: DataFrame, grid: Grid, lowpass_hz: float | None = None, fps: float = 30.0, rate: float = 200.0) -> DataFrame:
    """(recording_id, middle_ms, offset_ms, cost) from rates (recording_id, ts_us, x, y, z) seen in the video and measured by the gyro.

    A recording without movement, or whose best offset lies at the rim of the search, has no row; of equal costs
    the last offset counts, of samples of one time the first by its rates.  The unit of work is a sync range of a recording, on arrays in one group.
    """
    columns = ["x", "y", "z"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"recording_id": [], "middle_ms": [], "offset_ms": [], "cost": []})
        if not len(a) or not len(b):
            return none
        a = a.sort_values(["ts_us", *columns])
        est_ms, est = a["ts_us"].to_numpy(float) / 1000, a[columns].to_numpy(float)
        if np.abs(est).max() < LEAST_RATE:
            return none
        b = b.rename(columns={f"g_{c}": c for c in ("ts_us", *columns)}).sort_values(["ts_us", *columns])
        t = b["ts_us"].to_numpy(float) / 1000
        near = (t + grid.initial >= est_ms[0] - grid.search) & (t + grid.initial <= est_ms[-1] + grid.search)
        gyro_us, g = np.trunc(t[near] * 1000), b[columns].to_numpy(float)[near]
        if lowpass_hz:
            est, g = R.smoothed(est, lowpass_hz, fps), R.smoothed(g, lowpass_hz, rate)
        first = grid.coarse()
        if not len(first):
            return none
        best = first[last_least(alignment_costs(est_ms, est, gyro_us, g, first))]
        fine = grid.fine(best)
        costs = alignment_costs(est_ms, est, gyro_us, g, fine)
        k = last_least(costs)
        if not np.isfinite(costs[k]) or not abs(fine[k] - grid.initial) < BELIEVED * grid.search:
            return none
        return pd.DataFrame({"recording_id": [a["recording_id"].iloc[0]], "middle_ms": [(est_ms[0] + est_ms[-1]) / 2], "offset_ms": [fine[k]], "cost": [costs[k]]})

    left = estimated.select(*BY, "ts_us", *columns).groupBy(*BY)
    right = gyro.select(*BY, *(F.col(c).alias(f"g_{c}") for c in ("ts_us", *columns))).groupBy(*BY)  # own names, should both sides be of one table
    return left.cogroup(right).applyInPandas(run, "recording_id long, middle_ms double, offset_ms double, cost double")


def line_fit(points: DataFrame, x: str = "ts_us", y: str = "offset_ms") -> DataFrame:
    """(slope, intercept, ssr) by least squares on centred keys; at least two distinct keys."""
    w = Window.partitionBy(*BY)
    c = points.select(*BY, F.col(x).cast("double").alias("x"), F.col(y).alias("y"), F.avg(F.col(x).cast("double")).over(w).alias("mx"), F.avg(y).over(w).alias("my"))
    c = c.withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    s = c.groupBy(*BY).agg(F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dy") * F.col("dy")).alias("syy"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    slope = F.col("sxy") / F.when(F.col("sxx") > 0, F.col("sxx"))
    return s.where("sxx > 0").select(*BY, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)).alias("ssr"))


def robust_line(points: DataFrame, tolerance_ms: float = 5.0, steepest: float = 0.1) -> DataFrame:
    """(slope, intercept, inliers, ssr): of the lines through two sync points the one with most points within the
    tolerance, then the least squared distance of those, then the earliest pair.  Slopes are per millisecond.

    A row for each two points of a recording, which is held against the recording's points in place: sync
    points are placed by hand or by the dozen, and a recording's must fit into a row.
    """
    p = points.select(*BY, (F.col("ts_us") / 1000.0).alias("x"), F.col("offset_ms").alias("y"))
    every = p.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    lines = every.select(*BY, "points", F.explode("points").alias("a")).select(*BY, "points", "a", F.explode(F.filter("points", lambda b: b["x"] > F.col("a.x"))).alias("b"))
    lines = lines.select(*BY, "points", F.col("a.x").alias("x1"), F.col("b.x").alias("x2"), F.col("a.y").alias("y1"), ((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"))
    lines = lines.where(F.abs("slope") < steepest).withColumn("intercept", F.col("y1") - F.col("slope") * F.col("x1"))
    far = F.transform("points", lambda v: F.abs(F.col("slope") * v["x"] + F.col("intercept") - v["y"]))
    near = lines.withColumn("near", F.filter(far, lambda r: r < tolerance_ms)).drop("points")
    fit = near.withColumns({"inliers": F.size("near").cast("long"), "ssr": F.aggregate("near", F.lit(0.0), lambda s, r: s + r * r)}).drop("near")
    best = fit.groupBy(*BY).agg(F.min(F.struct((-F.col("inliers")).alias("o"), F.round("ssr", 9).alias("s"), "x1", "x2", "slope", "intercept", "inliers", "ssr")).alias("b"))
    return best.select(*BY, "b.slope", "b.intercept", "b.inliers", "b.ssr")


def choose_sign(offsets: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(negative, n, cost) of the search around the negative rough offset or the positive one, from (negative, cost) rows.

    More offsets win; of as many the smaller sum of costs, the negative side where these are equal.  Where the
    negative side has fewer there is no answer, as with no offsets at all.
    """
    side = lambda neg, x: F.sum(F.when(F.col("negative") == neg, x).otherwise(0))
    s = offsets.groupBy(*by).agg(side(False, 1).alias("n0"), side(True, 1).alias("n1"), side(False, F.col("cost")).alias("c0"), side(True, F.col("cost")).alias("c1"))
    positive = (F.col("n0") == F.col("n1")) & (F.col("c0") < F.col("c1"))
    s = s.where("n1 >= n0").withColumn("negative", ~positive)
    return s.select(*by, "negative", F.when(positive, F.col("n0")).otherwise(F.col("n1")).alias("n"), F.when(positive, F.col("c0")).otherwise(F.col("c1")).alias("cost"))


def trim_ratio(trims: DataFrame) -> DataFrame:
    """(recording_id, ratio): share of each recording inside its trim ranges (a, b), which are shares themselves."""
    return trims.groupBy(*BY).agg(F.sum(F.col("b") - F.col("a")).alias("ratio"))


def sync_ranges(points: DataFrame, window_us: int, duration_us: str = "duration_us") -> DataFrame:
    """Half a window on either side of each sync point, within the recording."""
    half = window_us // 2
    return points.select("*", F.greatest(F.col("ts_us") - half, F.lit(0)).alias("from_us"), F.least(F.col("ts_us") + half, F.col(duration_us)).alias("to_us"))


def even_points(recordings: DataFrame, k: int, duration_us: str = "duration_us") -> DataFrame:
    """k sync points in the middle of k equal parts."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(F.col(duration_us) * (i + 0.5) / k).cast("long"))
    return recordings.select(*BY, F.explode(at).alias("ts_us"))


def apply_offsets(known: DataFrame, new: DataFrame, radius_us: int = 100_000) -> DataFrame:
    """New offsets, keyed by gyro time, replace the known ones less than ``radius_us`` before or after them.

    A known key is replaced in [new - radius, new + radius); of equal new keys the last by value wins.
    """
    n = new.select(*BY, F.expr("cast((ts_us / 1000D - offset_ms) * 1000 as bigint)").alias("ts_us"), "offset_ms")
    n = n.groupBy(*BY, "ts_us").agg(F.max("offset_ms").alias("offset_ms"))
    a = asof.neighbours(known.select(*BY, "ts_us", "offset_ms"), n.select(*BY, "ts_us", "offset_ms"), ["offset_ms"])
    after = F.when(F.col("prev.k").isNotNull(), F.col("ts_us") < F.col("prev.k") + radius_us)
    before = F.when(F.col("next.k").isNotNull(), F.col("ts_us") >= F.col("next.k") - radius_us)
    left = a.where(~F.coalesce(after, F.lit(False)) & ~F.coalesce(before, F.lit(False))).drop("prev", "next")
    return left.unionByName(n)


def passes_rank(offsets: DataFrame, ranks: DataFrame, ratio_s: float, least: float = 13.0) -> DataFrame:
    """``offsets`` (recording_id, ts_ms, offset_ms, ...) whose window has a rank of ``least`` or more; those without a window stay."""
    at = F.round((F.col("ts_ms") - F.col("offset_ms")) / F.lit(ratio_s * 1000)).cast("long")
    ranked = ranks.select(*BY, F.col("idx").alias("_idx"), F.col("rank").alias("_rank"))
    joined = offsets.withColumn("_idx", at).join(ranked, [*BY, "_idx"], "left")
    return joined.where(F.col("_rank").isNull() | (F.col("_rank") >= least)).drop("_idx", "_rank")


def along_the_flow(lines: Column, degrees: float = 30.0) -> Column:
    """The lines (x1, y1, x2, y2) whose direction is less than ``degrees`` from the mean of all; the mean is of plain numbers, without regard to the turn."""
    angle = lambda p: F.atan2(p["y2"] - p["y1"], p["x2"] - p["x1"])
    mean = F.aggregate(lines, F.lit(0.0), lambda s, p: s + angle(p)) / F.when(F.size(lines) > 0, F.size(lines))
    return F.filter(lines, lambda p: F.abs(angle(p) - mean) < math.radians(degrees))


def syncs_itself(offsets: Column, accurate: Column, url: Column, asked: Column) -> Column:
    """No offsets yet, no clock to trust, and the profile asks for it; raw files of one kind are never trusted."""
    trusted = F.coalesce(accurate, F.lit(False)) & ~F.endswith(F.lower(url), F.lit(".braw"))  # Fixed value.
    return (offsets == 0) & ~trusted & F.coalesce(asked, F.lit(False))


def can_sync(duration_ms: Column, frames: Column, window_ms: Column, search_ms: Column) -> Column:
    return (duration_ms >= 10) & (frames >= 2) & (window_ms >= 10) & (search_ms >= 10)  # Fixed values.


def blackman(n: int) -> list[float]:
    """The window of the exact Blackman coefficients."""
    # Fixed values.
    a0, a1, a2 = 7938 / 18608, 9240 / 18608, 1430 / 18608
    return [a0 - a1 * math.cos(2 * math.pi * i / (n - 1)) + a2 * math.cos(4 * math.pi * i / (n - 1)) for i in range(n)]
