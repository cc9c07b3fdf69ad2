"""Quaternion algebra on struct<w, x, y, z> columns (Hamilton product, rotation of v by q v q^-1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quat(w, x, y, z) -> Column:
    """w, x, y, z as columns or numbers."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(c) for v, c in zip((w, x, y, z), "wxyz", strict=True)))


IDENTITY = (1.0, 0.0, 0.0, 0.0)


def identity() -> Column:
    return quat(*IDENTITY)


def multiply(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def conjugate(q: Column) -> Column:
    """The inverse of a unit quaternion."""
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def normalise(q: Column) -> Column:
    def scaled(q: Column) -> Column:
        return let(F.sqrt(dot(q, q)), lambda n: F.when(n > 0, quat(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n)).otherwise(identity()))

    return let(q, scaled)


def from_scaled_axis(x: Column, y: Column, z: Column) -> Column:
    """exp: rotation by |v| radians about v."""
    angle = F.sqrt(x * x + y * y + z * z)
    s = F.when(angle > EPS, F.sin(angle / 2) / angle).otherwise(F.lit(0.5))
    return quat(F.cos(angle / 2), x * s, y * s, z * s)


def angle(q: Column) -> Column:
    return 2 * F.atan2(F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]), F.abs(q["w"]))


def scaled_axis(q: Column) -> Column:
    """log: struct<x, y, z>, the shorter of the two rotation vectors."""
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    k = F.when(n > EPS, 2 * F.atan2(n, F.abs(q["w"])) / n).otherwise(F.lit(0.0)) * F.when(q["w"] < 0, -1.0).otherwise(1.0)
    return F.struct((q["x"] * k).alias("x"), (q["y"] * k).alias("y"), (q["z"] * k).alias("z"))


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Roll about x, then pitch about y, then yaw about z."""
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return quat(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def to_euler(q: Column) -> Column:
    """struct<roll, pitch, yaw> in radians."""
    w, x, y, z = (q[c] for c in "wxyz")
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.struct(
        F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)).alias("roll"), F.asin(sine).alias("pitch"), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)).alias("yaw")
    )


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc; ends that are opposite give ``a``."""

    def mixed(v: Column) -> Column:
        near = v["s"] < 1e-9
        s = F.when(near, 1.0).otherwise(v["s"])
        wa = F.when(near, 1 - v["t"]).otherwise(F.sin((1 - v["t"]) * v["theta"]) / s)
        wb = F.when(near, v["t"]).otherwise(F.sin(v["t"] * v["theta"]) / s) * v["sign"]
        return let(
            F.struct(wa.alias("a"), wb.alias("b")), lambda k: normalise(quat(*(v["a"][c] * k["a"] + v["b"][c] * k["b"] for c in "wxyz")))
        )

    def arc(v: Column) -> Column:
        theta = F.acos(F.least(F.abs(v["c"]), F.lit(1.0)))
        sign = F.when(v["c"] < 0, -1.0).otherwise(1.0)
        return let(
            F.struct(v["a"], v["b"], v["t"], sign.alias("sign"), theta.alias("theta")),
            lambda u: let(F.struct(u["a"], u["b"], u["t"], u["sign"], u["theta"], F.sin(u["theta"]).alias("s")), mixed),
        )

    ends = F.struct(a.alias("a"), b.alias("b"), t.cast("double").alias("t"))
    return let(ends, lambda v: let(F.struct(v["a"], v["b"], v["t"], dot(v["a"], v["b"]).alias("c")), arc))


def rotate(q: Column, x: Column, y: Column, z: Column) -> Column:
    """struct<x, y, z> = q v q^-1."""
    tx, ty, tz = (2 * (q["y"] * z - q["z"] * y), 2 * (q["z"] * x - q["x"] * z), 2 * (q["x"] * y - q["y"] * x))
    return F.struct(
        (x + q["w"] * tx + q["y"] * tz - q["z"] * ty).alias("x"), (y + q["w"] * ty + q["z"] * tx - q["x"] * tz).alias("y"), (z + q["w"] * tz + q["x"] * ty - q["y"] * tx).alias("z")
    )


def from_axis_angle(axis: str, a: Column) -> Column:
    half = a / 2
    return quat(F.cos(half), *(F.sin(half) if c == axis else F.lit(0.0) for c in "xyz"))
