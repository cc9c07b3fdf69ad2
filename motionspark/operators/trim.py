"""Orientations outside trim ranges: held before the first and behind the last, turned evenly from one to the next between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import asof

BY = ("recording_id",)


def hold_outside(samples: DataFrame, trims: DataFrame, missing: str = "keep") -> DataFrame:
    """``samples`` (recording_id, ts_us, q, ...) with ``q`` replaced outside the ranges of ``trims`` (recording_id, from_us, to_us).

    A range holds both its ends.  Before the first range stands the first sample in or behind it, behind the last one
    the last sample before its end.  A gap between ranges turns from the first sample behind the one to the first sample
    from the start of the next on.  Samples stay as they are in recordings without ranges.  Where a range's edge asks for a sample
    that the recording does not have, they stay as well, or go with ``missing="drop"``.
    Ranges of a recording do not overlap (see ``series.merge_ranges``); null or empty ones (to before from) do not count.
    """
    ranges = trims.where("from_us <= to_us").select(*BY, "from_us", "to_us").distinct()
    at = lambda name, us: F.struct(F.lit(name).alias("name"), us.alias("ts_us"))
    # Of each range the samples at its edges, each by one look-up.
    edges = ranges.select("*", F.explode(F.array(at("enter", F.col("from_us")), at("leave", F.col("to_us") + 1), at("last", F.col("to_us") - 1))).alias("e"))
    found = asof.neighbours(edges.select(*BY, "from_us", "to_us", "e.*"), samples.select(*BY, "ts_us", "q"), ["q"])
    found = found.withColumn("s", F.when(F.col("name") == "last", F.struct("prev.k", "prev.q")).otherwise(F.struct("next.k", "next.q")))
    edge = lambda name: F.max(F.when(F.col("name") == name, F.col("s"))).alias(name)
    placed = found.groupBy(*BY, "from_us", "to_us").agg(*(edge(n) for n in ("enter", "leave", "last"))).withColumn("ts_us", F.col("from_us"))
    own = samples.select(*BY, "ts_us", "q", F.struct(*(F.col(f"`{c}`") for c in samples.columns)).alias("_own"))
    around = asof.neighbours(own, placed.drop("from_us"), ["to_us", "enter", "leave", "last"])
    a, b = F.col("prev.leave"), F.col("next.enter")
    share = F.when(b["k"] > a["k"], (F.col("ts_us") - a["k"]) / (b["k"] - a["k"])).otherwise(F.lit(0.0))
    between = F.when(a["k"].isNotNull() & b["k"].isNotNull(), F.when(share == 0, a["q"]).otherwise(Q.slerp(a["q"], b["q"], share)))
    outside = (
        F.when(F.col("prev.k").isNull(), F.when(F.col("next.k").isNotNull(), b["q"]))
        .when(F.col("ts_us") <= F.col("prev.to_us"), F.col("q"))
        .when(F.col("next.k").isNull(), F.col("prev.last.q"))
        .otherwise(between)
    )
    if missing == "drop":
        ranged = F.col("prev.k").isNotNull() | F.col("next.k").isNotNull()
        around = around.where(~ranged | outside.isNotNull())
    kept = around.withColumn("q", F.coalesce(outside, F.col("q")))
    return kept.select(*(F.col("q") if c == "q" else F.col(f"_own.`{c}`") for c in samples.columns))
