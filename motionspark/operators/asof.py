"""As-of, nearest and bracketing joins on one primitive.

Both sides go into one sorted run per key: a left row sees the last right row at or before it in ascending
order and at or after it in descending order.  That is one shuffle by key and two sorts, without a
non-equi join.  Right rows carry their own neighbours, which gives the end segments for extrapolation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BY = ("recording_id",)


def neighbours(left: DataFrame, right: DataFrame, value: Sequence[str], on: str = "ts_us", by: Sequence[str] = BY) -> DataFrame:
    """``left`` plus ``prev`` and ``next``: structs of the nearest right rows with key <= and >= the left one.

    Each holds the key as ``k``, the value columns, and the right row before (``b_k``, ...) or after it
    (``a_k``, ...).  Right keys must be unique within ``by``.
    """
    w = Window.partitionBy(*by).orderBy(on)
    around = [c.alias(f"{p}_{n}") for p, f in (("b", F.lag), ("a", F.lead)) for n, c in (("k", f(on).over(w)), *((v, f(v).over(w)) for v in value))]
    r = right.select(*by, F.col(on), F.struct(F.col(on).alias("k"), *value, *around).alias("_r"))
    rows = left.select(*by, F.col(on), F.lit(0).alias("_side"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_l"))
    both = rows.unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    up = Window.partitionBy(*by).orderBy(F.asc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("prev", F.last("_r", ignorenulls=True).over(up)).withColumn("next", F.last("_r", ignorenulls=True).over(down))
    return seen.where("_side = 0").select("_l.*", "prev", "next")


def nearest(left: DataFrame, right: DataFrame, value: str, tolerance: int, on: str = "ts_us", by: Sequence[str] = BY, out: str | None = None) -> DataFrame:
    """Value of the right row with the same key, else of the nearest one less than ``tolerance`` away; two equally near give null."""
    n = neighbours(left, right, [value], on, by)
    before, after = F.col(on) - F.col("prev.k"), F.col("next.k") - F.col(on)
    far = F.lit(2**62)
    b, a = F.coalesce(before, far), F.coalesce(after, far)
    picked = (
        F.when(b == 0, F.col(f"prev.{value}"))
        .when((b < a) & (b < tolerance), F.col(f"prev.{value}"))
        .when((a < b) & (a < tolerance), F.col(f"next.{value}"))
    )
    return n.withColumn(out or value, picked).drop("prev", "next")


def forward(left: DataFrame, right: DataFrame, value: str, default: Column | None = None, on: str = "ts_us", by: Sequence[str] = BY, out: str | None = None) -> DataFrame:
    """Value of the first right row at or after the left one, else the default."""
    n = neighbours(left, right, [value], on, by)
    picked = F.col(f"next.{value}")
    return n.withColumn(out or value, picked if default is None else F.coalesce(picked, default)).drop("prev", "next")


def _blend(edge: str, value: str, mix: Callable[[Column, Column, Column], Column], at: Column) -> Column:
    def part(s: str, p: str) -> tuple[Column, Column]:
        return F.col(f"{s}.{p}k"), F.col(f"{s}.{p}{value}")

    def segment(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        width = (b[0] - a[0]).cast("double")
        return mix(a[1], b[1], (at - a[0]).cast("double") / F.when(width == 0, 1.0).otherwise(width))

    prev, nxt = part("prev", ""), part("next", "")
    before, after = part("prev", "b_"), part("next", "a_")
    if edge == "extrapolate":
        left = F.when(after[0].isNull(), nxt[1]).otherwise(segment(nxt, after))
        right = F.when(before[0].isNull(), prev[1]).otherwise(segment(before, prev))
    else:
        left, right = nxt[1], prev[1]
    inside = F.when(prev[0] == nxt[0], prev[1]).otherwise(segment(prev, nxt))
    return F.when(prev[0].isNull() & nxt[0].isNull(), None).when(prev[0].isNull(), left).when(nxt[0].isNull(), right).otherwise(inside)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def interpolate(
    left: DataFrame, right: DataFrame, value: str, edge: str = "extrapolate", default: Column | None = None,
    on: str = "ts_us", by: Sequence[str] = BY, out: str | None = None, mix: Callable[[Column, Column, Column], Column] = lerp,
) -> DataFrame:
    """Value between the bracketing right rows; beyond the ends the end segment's line (``extrapolate``) or the end value (``hold``).

    One right row is a constant; without right rows the default.
    """
    n = neighbours(left, right, [value], on, by)
    picked = _blend(edge, value, mix, F.col(on))
    return n.withColumn(out or value, picked if default is None else F.coalesce(picked, default)).drop("prev", "next")


def carry(df: DataFrame, columns: Sequence[str], on: str = "ts_us", by: Sequence[str] = BY) -> DataFrame:
    """Each column keeps its last known value."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
