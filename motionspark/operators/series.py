"""Windows over ordered series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from motionspark.functions import quat as Q
from motionspark.operators import asof

BY = ("recording_id",)


def ordered(by: Sequence[str] = BY, on: str = "ts_us") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(on)


def rotation_velocity(df: DataFrame, q: str = "q", rate: float = 1.0, out: str = "velocity") -> DataFrame:
    """Degrees per second between neighbours at a fixed sample rate; the first row has 0."""
    prev = F.lag(q).over(ordered())
    turn = F.degrees(Q.let(Q.multiply(Q.conjugate(prev), F.col(q)), Q.angle)) * F.lit(rate)
    return df.withColumn(out, F.coalesce(F.when(prev.isNotNull(), turn), F.lit(0.0)))


def angular_velocity(df: DataFrame, q: str = "q", on: str = "ts_us", out: str = "omega") -> DataFrame:
    """struct<x, y, z>: scaled axis of q2 q1^-1 per second in degrees; 0 in the first row and where time stands still."""
    w = ordered(on=on)
    prev, dt = F.lag(q).over(w), (F.col(on) - F.lag(on).over(w)) / F.lit(1e6)
    df = df.withColumns({"_prev": prev, "_dt": dt})
    df = df.withColumn("_axis", Q.let(Q.multiply(F.col(q), Q.conjugate(F.col("_prev"))), Q.scaled_axis))
    rate = lambda c: F.coalesce(F.when(F.col("_dt") > 0, F.degrees(F.col(f"_axis.{c}")) / F.when(F.col("_dt") > 0, F.col("_dt")).otherwise(1.0)), F.lit(0.0)).alias(c)
    return df.withColumn(out, F.struct(*(rate(c) for c in "xyz"))).drop("_prev", "_dt", "_axis")


def unwrapped(a: Column) -> Column:
    """A difference of angles in degrees, taken the short way round."""
    return F.when(a > 180, a - 360).when(a < -180, a + 360).otherwise(a)


def roll_rate(df: DataFrame, roll_deg: str, on: str = "ts_us", longest_s: float = 1.0, out: str = "roll_rate") -> DataFrame:
    w = ordered(on=on)
    dt = (F.col(on) - F.lag(on).over(w)) / F.lit(1e6)
    step = unwrapped(F.col(roll_deg) - F.lag(roll_deg).over(w))
    return df.withColumn(out, F.coalesce(F.when((dt > 0) & (dt < longest_s), step / F.when(dt > 0, dt).otherwise(1.0)), F.lit(0.0)))


def relative_velocity(df: DataFrame, value: str, fps: float, on: str = "ts_us", out: str = "zoom_velocity") -> DataFrame:
    """|change| per second relative to the previous value; 0 where either is unknown or the previous is 0."""
    prev = F.lag(value).over(ordered(on=on))
    return df.withColumn(out, F.coalesce(F.when(prev != 0, F.abs(F.col(value) - prev) * fps / F.when(prev != 0, prev)), F.lit(0.0)))


def moving_average(df: DataFrame, value: str, window: int, on: str = "ts_us", out: str = "average") -> DataFrame:
    """Centred over an odd number of rows, shrinking at the ends."""
    h = window // 2
    return df.withColumn(out, F.avg(value).over(ordered(on=on).rowsBetween(-h, h)) if window >= 1 else F.col(value))


def rolling_max(df: DataFrame, value: str, seconds: float, on: str = "ts_us", out: str = "rolling_max") -> DataFrame:
    """Largest value within half the window on either side, by time."""
    half = int(seconds * 1e6 / 2)
    return df.withColumn(out, F.max(value).over(ordered(on=on).rangeBetween(-half, half)))


def rolling_min(df: DataFrame, value: str, frames: int, on: str = "frame", out: str = "rolling_min") -> DataFrame:
    """Smallest value over an odd number of frames; padding with end values changes no minimum."""
    h = (frames | 1) // 2
    return df.withColumn(out, F.min(value).over(ordered(on=on).rowsBetween(-h, h)))


def gaussian(frames: int, sigma: float) -> list[float]:
    h = frames // 2
    w = [math.exp(-((i - h) ** 2) / (2 * sigma * sigma)) for i in range(frames)]
    return [x / sum(w) for x in w]


def convolve(df: DataFrame, value: str, kernel: list[float], on: str = "frame", out: str = "smoothed") -> DataFrame:
    """Centred convolution; beyond the ends the end values repeat."""
    h = len(kernel) // 2
    whole = Window.partitionBy(*BY)
    w = ordered(on=on)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max_by(value, on).over(whole)
    df = df.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(whole), "_first": first, "_last": last})

    def at(k: int) -> Column:
        there = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        return F.when(F.col("_n") + k < 1, F.col("_first")).when(F.col("_n") + k > F.col("_all"), F.col("_last")).otherwise(there)

    terms = [at(k) * F.lit(c) for k, c in zip(range(-h, h + 1), kernel, strict=True)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total).drop("_n", "_all", "_first", "_last")


def gaussian_over_known(df: DataFrame, value: str, window: int, strength: float, on: str = "frame", out: str = "smoothed") -> DataFrame:
    """Gaussian mean of the known values around a row, blended with the value itself by ``strength``; unknown stays unknown.

    The window is odd; beyond the ends the first and the last row, known or not, stand again.
    """
    if strength <= 0:
        return df.withColumn(out, F.col(value))
    window |= 1
    h, sigma = window // 2, (window / 6) * (1 + 2 * strength)
    w = ordered(on=on)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy(*BY)), "_first": F.first(value).over(whole), "_last": F.last(value).over(whole)})

    def at(k: int) -> Column:
        there = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        return F.when(F.col("_n") + k < 1, F.col("_first")).when(F.col("_n") + k > F.col("_all"), F.col("_last")).otherwise(there)

    df = df.withColumns({f"_v{k + h}": at(k) for k in range(-h, h + 1)})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k in range(-h, h + 1):
        v, g = F.col(f"_v{k + h}"), math.exp(-(k * k) / (2 * sigma * sigma))
        top, bottom = top + F.coalesce(v * F.lit(g), F.lit(0.0)), bottom + F.when(v.isNotNull(), g).otherwise(0.0)
    mean = F.col(value) * (1 - strength) + strength * top / F.when(bottom > 0, bottom)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), mean)).drop("_n", "_all", "_first", "_last", *(f"_v{k}" for k in range(window)))


def median_trailing(df: DataFrame, value: str, size: int, on: str = "ts_us", out: str = "median") -> DataFrame:
    """Median of the last ``size`` rows forward, then the same backward over the result; short windows at the ends."""
    up, down = ordered(on=on), Window.partitionBy(*BY).orderBy(F.desc(on))

    def middle(values: Column) -> Column:
        n = F.size(values)
        return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2

    def over(c: str, w: WindowSpec) -> Column:
        return middle(F.array_sort(F.collect_list(c).over(w.rowsBetween(-(size - 1), 0))))

    return df.withColumn("_m", over(value, up)).withColumn(out, over("_m", down)).drop("_m")


def gap_ranges(df: DataFrame, gap_us: int = 100_000, on: str = "ts_us") -> DataFrame:
    """(from_us, to_us) of runs without a gap longer than ``gap_us``; runs of one instant are left out."""
    w = ordered(on=on)
    start = F.when(F.coalesce(F.col(on) - F.lag(on).over(w) > gap_us, F.lit(False)), 1).otherwise(0)
    runs = df.withColumn("_new", start).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*BY, "_run").agg(F.min(on).alias("from_us"), F.max(on).alias("to_us"))
    return out.where("from_us <> to_us").drop("_run")


def merge_flags(df: DataFrame, gap_us: int, on: str = "ts_us") -> DataFrame:
    """(lo, hi, n) of flagged rows that lie no more than ``gap_us`` apart; one alone is a range too."""
    w = ordered(on=on)
    start = F.when(F.coalesce(F.col(on) - F.lag(on).over(w) > gap_us, F.lit(False)), 1).otherwise(0)
    runs = df.withColumn("_new", start).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*BY, "_run").agg(F.min(on).alias("lo"), F.max(on).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_run")


def resample(df: DataFrame, value: str, step_us: int, on: str = "ts_us") -> DataFrame:
    """Values at even steps from the first to the last key, on straight lines."""
    ends = df.groupBy(*BY).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    grid = ends.select(*BY, F.explode(F.sequence("_a", "_b", F.lit(step_us))).alias(on))
    return asof.interpolate(grid, df.select(*BY, on, value), value, edge="hold", on=on)


def merge_intervals(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Overlapping or adjacent whole-number intervals become one."""
    w = Window.partitionBy(*BY).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.coalesce(F.col(lo) <= before + 1, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*BY, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def suppress_non_maxima(df: DataFrame, value: str, radius: int, on: str = "idx", out: str = "kept") -> DataFrame:
    """0 where a larger value stands in the r-1 rows before or the r rows after; the last row is never suppressed.

    Row j is in reach of row i from j - r + 1 to j + r, and i's reach ends before the last row.
    """
    w = ordered(on=on)
    best = F.max(value).over(w.rowsBetween(-(radius - 1), radius))
    is_last = F.lead(value).over(w).isNull()
    return df.withColumn(out, F.when(~is_last & (best > F.col(value)), F.lit(0.0)).otherwise(F.col(value)))


def segment_tops(df: DataFrame, value: str, segments: int, least: float = 0.1, on: str = "idx") -> DataFrame:
    """Of each of ``segments`` equal runs of rows the largest value, the later one of equals, if it reaches ``least``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*BY))
    size = F.floor((n + segments - 1) / segments)
    cut = df.withColumn("segment", F.floor(F.col(on) / size).cast("int"))
    best = cut.groupBy(*BY, "segment").agg(F.max(F.struct(F.col(value), F.col(on))).alias("_b"))
    return best.select(*BY, "segment", F.col(f"_b.{on}").alias(on), F.col(f"_b.{value}").alias(value)).where(F.col(value) >= least)


def speed_ramp(df: DataFrame, speed: str, on: str = "ts_us", inverse: bool = False, out: str = "ramped_us") -> DataFrame:
    """Running sum of time steps divided by the speed (times it, if inverse)."""
    w = ordered(on=on)
    step = F.coalesce(F.col(on) - F.lag(on).over(w), F.lit(0)).cast("double")
    scaled = step * F.col(speed) if inverse else step / F.when(F.col(speed) != 0, F.col(speed))
    return df.withColumn("_step", F.coalesce(scaled, F.lit(0.0))).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def fill_gaps(df: DataFrame, value: str, on: str = "ts_us", out: str = "filled") -> DataFrame:
    """Unknown values between known ones by straight lines over the rows' numbers; outside them unknown stays."""
    w = ordered(on=on)
    numbered = df.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    numbered = numbered.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(*BY).orderBy(F.desc(on)).rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("_q", F.last(known, ignorenulls=True).over(down))
    span = F.col("_q.n") - F.col("_p.n")
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * ((F.col("_n") - F.col("_p.n")) / F.when(span > 0, span).otherwise(1))
    return numbered.withColumn(out, F.coalesce(F.col(value), line)).drop("_n", "_p", "_q")


def every_nth(df: DataFrame, step: int, on: str = "ts_us") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(ordered(on=on)) - 1).where(F.col("_n") % step == 0).drop("_n")


def normalise_by_max(df: DataFrame, columns: Sequence[str], shared: bool = False) -> DataFrame:
    """Each column divided by its largest magnitude in the recording, or all by the largest of them."""
    w = Window.partitionBy(*BY)
    tops = {c: F.max(F.abs(c)).over(w) for c in columns}
    top = F.greatest(*tops.values()) if shared and len(columns) > 1 else None
    return df.withColumns({c: F.try_divide(F.col(c), tops[c] if top is None else top) for c in columns})


def moving_pace(df: DataFrame, seconds: float, on: str = "ts_us", out: str = "frame_s") -> DataFrame:
    """Seconds per row over the last ``seconds``, for an estimate of the time left."""
    w = ordered(on=on).rangeBetween(-int(seconds * 1e6), 0)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.when(n > 1, (F.max(on).over(w) - F.min(on).over(w)) / F.lit(1e6) / F.when(n > 1, n - 1)))


def chart_series(df: DataFrame, groups: Sequence[Sequence[str]], on: str = "ts_us") -> DataFrame:
    """(recording_id, key, series, value): a row for each known value, by the largest size in its group of columns and recording."""
    whole = Window.partitionBy(*BY)
    shares = []
    for columns in groups:
        top = F.max(F.greatest(*(F.abs(c) for c in columns))).over(whole)
        shares += [F.struct(F.lit(c).alias("series"), (F.col(c) / F.when(top > 0, top)).alias("value")) for c in columns]
    lines = df.select(*BY, on, F.array(*shares).alias("_all")).select(*BY, on, F.explode("_all").alias("_p"))
    return lines.select(*BY, on, "_p.series", "_p.value").where("value is not null")


def catmull_rom(left: DataFrame, knots: DataFrame, value: str, on: str = "ts_us", out: str | None = None) -> DataFrame:
    """Value of the spline through the knots at each left key: straight tangents at both ends, null before the first and from the last knot on."""
    w = ordered(on=on)
    around = {"_next": F.lead(value).over(w), "_after": F.lead(value, 2).over(w), "_before": F.lag(value).over(w), "_k": F.lead(on).over(w)}
    n = asof.neighbours(left, knots.withColumns(around), [value, *around], on=on)
    p = lambda c: F.col(f"prev.{c}")
    a, b = p(value), p("_next")
    x, y = F.coalesce(p("_before"), 2 * a - b), F.coalesce(p("_after"), 2 * b - a)
    t = (F.col(on) - p("k")) / (p("_k") - p("k"))
    curve = a + t * ((b - x) * 0.5 + t * ((x - 2.5 * a + 2 * b - 0.5 * y) + t * (0.5 * (3 * (a - b) + y - x))))
    return n.withColumn(out or value, F.when(p("_k").isNotNull(), curve)).drop("prev", "next")


def turn_speed(df: DataFrame, frames: int, fps: float, original: str = "original", smooth: str = "q", on: str = "ts_us", out: str = "turn_speed") -> DataFrame:
    """Degrees a second by which the correction has turned over the last ``frames`` frames; null before there are so many."""
    df = df.withColumn("_yaw", F.degrees(Q.let(Q.multiply(F.col(original), Q.conjugate(F.col(smooth))), Q.to_euler)["yaw"]))
    step = F.col("_yaw") - F.lag("_yaw", frames).over(ordered(on=on))
    return df.withColumn(out, unwrapped(step) / (frames / fps)).drop("_yaw")
