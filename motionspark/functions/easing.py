"""Keyframe easing in single precision, as keyframe curves are drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(a: Column, b: Column) -> Column:
    """The curve between two keyframes from the easing of its ends."""
    leaves = a.isin("EaseOut", "EaseInOut")
    arrives = b.isin("EaseIn", "EaseInOut")
    return F.when(leaves & arrives, "EaseInOut").when(arrives, "EaseOut").when(leaves, "EaseIn").otherwise("NoEasing")


def apply(curve: Column, x: Column) -> Column:
    """Progress in 0..1 along the curve."""
    f = x.cast("float")
    half = F.lit(math.pi / 2).cast("float")
    return (
        F.when(curve == "EaseIn", (1 - F.cos(f * half)).cast("float").cast("double"))
        .when(curve == "EaseOut", F.sin(f * half).cast("float").cast("double"))
        .when(curve == "EaseInOut", (-(F.cos(F.lit(math.pi).cast("float") * f) - 1) / 2).cast("float").cast("double"))
        .otherwise(x)
    )
