"""LNS, MTH10 and WRP queries: points through lens models, out and back again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.operators import lens
from motionspark.plans.registry import query
from motionspark.plans.telemetry import table

# Points of the ideal plane, one a part.
POINTS_SQL = """p AS (SELECT p_partkey, ((p_partkey * 7) % 19 - 9) * 0.05::DOUBLE AS x, ((p_partkey * 5) % 17 - 8) * 0.05::DOUBLE AS y FROM part),
r AS (SELECT *, sqrt(x * x + y * y) AS r FROM p)"""
COEFFICIENTS = {
    "opencv_fisheye": (0.05, -0.01, 0.004, -0.001),
    "opencv_standard": (-0.1, 0.03, 0.001, -0.002, 0.005, 0.02, 0.01, 0.001, 0.001, 0.0005, -0.001, 0.0003),
    "poly3": (0.1037,),
    "poly5": (0.08, 0.02),
    "ptlens": (0.01, -0.03, 0.02),
    "insta360": (0.1, -0.05, 0.01, 0.001, -0.001, 0.8),
    "sony": (1.02, 0.01, -0.03, 0.01, 0.002, -0.001),
    "generic_polynomial": (1.01, 0.02, -0.05, 0.01, 0.003, -0.002, 0.001, 0.0005, -0.0002, 0.0001, -0.00005, 0.00002),
    "gopro": (0.0, 0.9, 0.05, -0.02, 0.01, 0.002, -0.001),
}


def points(spark: SparkSession, d: str) -> DataFrame:
    at = lambda a, n, h: ((F.col("p_partkey") * a) % n - h) * 0.05
    return table(spark, d, "part").select("p_partkey", at(7, 19, 9).alias("x"), at(5, 17, 8).alias("y"))


def _sum(t: str, powers: dict[int, float]) -> str:
    return " + ".join(f"({c!r})::DOUBLE * pow({t}, {n})" for n, c in powers.items())


def _out_sql(model: str) -> tuple[str, str]:
    """What the lens does, as SQL of x, y and r."""
    k = COEFFICIENTS[model]
    along = {
        "opencv_fisheye": lambda: _sum("atan(r)", {1: 1.0, **{3 + 2 * i: c for i, c in enumerate(k)}}),
        "sony": lambda: _sum("atan(r)", {1 + i: c for i, c in enumerate(k)}),
        "generic_polynomial": lambda: _sum("atan(r)", {1 + i: c for i, c in enumerate(k)}),
        "poly3": lambda: _sum("r", {1: 1.0, 3: k[0]}),
        "poly5": lambda: _sum("r", {1: 1.0, 3: k[0], 5: k[1]}),
        "ptlens": lambda: _sum("r", {1: 1.0, 2: k[2], 3: k[1], 4: k[0]}),
    }
    if model in along:
        s = f"CASE WHEN r > 0 THEN ({along[model]()}) / r ELSE 1 END"
        return f"x * {s}", f"y * {s}"
    d = [f"({c!r})::DOUBLE" for c in k]
    if model == "opencv_standard":
        q = "(r * r)"
        ratio = f"(1 + {d[0]} * {q} + {d[1]} * pow(r, 4) + {d[4]} * pow(r, 6)) / (1 + {d[5]} * {q} + {d[6]} * pow(r, 4) + {d[7]} * pow(r, 6))"
        return (
            f"x * {ratio} + {d[2]} * 2 * x * y + {d[3]} * ({q} + 2 * x * x) + {d[8]} * {q} + {d[9]} * pow(r, 4)",
            f"y * {ratio} + {d[2]} * ({q} + 2 * y * y) + {d[3]} * 2 * x * y + {d[10]} * {q} + {d[11]} * pow(r, 4)",
        )
    n = f"(sqrt(1 + r * r) * (1 / sqrt(1 + r * r) + {d[5]}))"  # insta360
    x, y, q = f"(x / {n})", f"(y / {n})", f"(r * r / ({n} * {n}))"
    radial = f"(1 + {d[0]} * {q} + {d[1]} * {q} * {q} + {d[2]} * {q} * {q} * {q})"
    return f"{x} * {radial} + 2 * {d[3]} * {x} * {y} + {d[4]} * ({q} + 2 * {x} * {x})", f"{y} * {radial} + 2 * {d[4]} * {x} * {y} + {d[3]} * ({q} + 2 * {y} * {y})"


def _there_and_back(model: str) -> None:
    """The lens' image of each point, and the point that the image comes from: the same one, where the model has an answer."""
    number = 1 + ("opencv_fisheye", "opencv_standard", "poly3", "poly5", "ptlens", "insta360", "sony", "generic_polynomial", "gopro").index(model)
    if model == "gopro":  # its way back is the one with a closed form
        powers = {i: c for i, c in enumerate(COEFFICIENTS[model]) if i}
        s = f"CASE WHEN r > 1e-9 THEN tan({_sum('(r / 0.9::DOUBLE)', powers)}) / r ELSE 1 END"
        u, v, first, second = f"x * {s}", f"y * {s}", lens.undistorted, lens.distorted
        again = "round(x, 4) + 0 AS back_x, round(y, 4) + 0 AS back_y"
    else:
        (u, v), first, second = _out_sql(model), lens.distorted, lens.undistorted
        centre = "r > 0" if model in lens.LENGTH else "true"  # these models have no way back from the centre
        again = f"CASE WHEN {centre} THEN round(x, 4) + 0 END AS back_x, CASE WHEN {centre} THEN round(y, 4) + 0 END AS back_y"

    @query(f"lns{number:02d}_{model}", f"WITH {POINTS_SQL} SELECT p_partkey, round({u}, 6) + 0 AS x, round({v}, 6) + 0 AS y, {again} FROM r")
    def run(spark: SparkSession, d: str) -> DataFrame:
        k = F.array(*(F.lit(float(c)) for c in COEFFICIENTS[model]))
        out = points(spark, d).withColumn("o", first(model, F.col("x"), F.col("y"), k))
        out = out.withColumn("b", second(model, F.col("o.x"), F.col("o.y"), k))
        r = lambda c, n: F.round(c, n) + 0
        return out.select("p_partkey", r("o.x", 6).alias("x"), r("o.y", 6).alias("y"), r("b.x", 4).alias("back_x"), r("b.y", 4).alias("back_y"))


for _model in COEFFICIENTS:
    _there_and_back(_model)

WIDTH, HEIGHT = 1920.0, 1080.0
WARP = (1.21, -1.28, 1.78, 0.05, 0.02, 0.01, 0.0, 0.03, 0.94, 0.45, -0.77, -0.36, 1.16, 0.35, 1.3, 0.0)
DIGITAL_K = {"digital_stretch": (1.25, 0.9), "gopro_warp": WARP}
# The maps of the unit frame around its centre, as SQL of u and v, and the stretch of the wide frame.
DIGITAL_SQL = {
    "gopro_superview": ("u * (1.2100393 + u * u * (-1.2758402 + u * u * 1.7751845))", "v * (0.9364505 + 0.4465308 * v * v - 0.7683315 * pow(v, 4) + u * u * (-0.3574087 + 1.1584653 * v * v + 0.3529348 * u * u))", 1.333333333),
    "gopro6_superview": ("u * (1 - 0.48 * abs(u)) * 0.943396 * (1 + 0.157895 * abs(u) * (1 - 0.48 * abs(u)))", "v * 0.943396 * (1 + 0.12 * abs(v))", 1.0),
    "gopro_hyperview": (
        f"u * ({' + '.join(f'({c!r}) * pow(u, {2 * i})' for i, c in enumerate(lens.HYPERVIEW_X))} - 0.1086027 * v * v)", "v * (1.0238225 - 0.1025671 * v * v - 0.2639930 * u * u + 0.2979266 * pow(u, 4))", 1.555555555,
    ),
    "gopro_warp": (
        f"u * ({' + '.join(f'({c!r}) * pow(u, {2 * i})' for i, c in enumerate(WARP[:7]))} + {WARP[7]} * v * v)",
        f"v * ({WARP[8]} + {WARP[9]} * v * v + ({WARP[10]}) * pow(v, 4) + u * u * ({WARP[11]} + {WARP[12]} * v * v + {WARP[13]} * u * u))", 1.3,
    ),
}


def _digital(number: int, model: str) -> None:
    """Pixels of the recorded frame in the wide one, and from there back."""
    pixel = "SELECT p_partkey, (560 + p_partkey * 37 % 801)::DOUBLE AS px, (240 + p_partkey * 23 % 601)::DOUBLE AS py FROM part"
    if model == "digital_stretch":
        u, v = "px / 1.25::DOUBLE", "py / 0.9::DOUBLE"
    else:
        a, b, wide = DIGITAL_SQL[model]
        u, v = f"(({a})::DOUBLE / {wide}::DOUBLE + 0.5) * {WIDTH}", f"(({b})::DOUBLE + 0.5) * {HEIGHT}"
    sql = f"WITH q AS ({pixel}), r AS (SELECT *, px / {WIDTH}::DOUBLE - 0.5::DOUBLE AS u, py / {HEIGHT}::DOUBLE - 0.5::DOUBLE AS v FROM q)"

    @query(f"lns{number}_{model}", f"{sql} SELECT p_partkey, round({u}, 4) + 0 AS x, round({v}, 4) + 0 AS y, round(px, 1) AS back_x, round(py, 1) AS back_y FROM r")
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "part").select("p_partkey", (560 + F.col("p_partkey") * 37 % 801).cast("double").alias("px"), (240 + F.col("p_partkey") * 23 % 601).cast("double").alias("py"))
        k, size = F.array(*(F.lit(float(c)) for c in DIGITAL_K.get(model, (0.0,)))), (F.lit(WIDTH), F.lit(HEIGHT))
        out = p.withColumn("o", lens.digital(model, F.col("px"), F.col("py"), k, *size, back=True))
        out = out.withColumn("b", lens.digital(model, F.col("o.x"), F.col("o.y"), k, *size, back=False))
        r = lambda c, n: F.round(c, n) + 0
        return out.select("p_partkey", r("o.x", 4).alias("x"), r("o.y", 4).alias("y"), r("b.x", 1).alias("back_x"), r("b.y", 1).alias("back_y"))


for _number, _model in enumerate(("gopro_superview", "gopro6_superview", "gopro_hyperview", "gopro_warp", "digital_stretch"), 10):
    _digital(_number, _model)


@query("mth10_radial_limit", """WITH RECURSIVE k AS (SELECT p_partkey, (p_size % 13 - 9) * 0.04::DOUBLE AS a, (p_size % 5 - 2) * 0.01::DOUBLE AS b FROM part),
s AS (SELECT p_partkey, a, b, 0.0::DOUBLE AS lo, pi() / 2 AS hi FROM k UNION ALL
  SELECT p_partkey, a, b, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, 1 + 3 * a * pow((lo + hi) / 2, 2) + 5 * b * pow((lo + hi) / 2, 4) > 0 AS up FROM s WHERE hi - lo > 1e-4::DOUBLE))
SELECT p_partkey, CASE WHEN abs((lo + hi) / 2 - pi() / 2) > 1e-3::DOUBLE THEN round(tan((lo + hi) / 2), 6) END AS limit_radius FROM s WHERE hi - lo <= 1e-4::DOUBLE""")
def mth10(spark: SparkSession, d: str) -> DataFrame:
    k = F.array((F.col("p_size") % 13 - 9) * 0.04, (F.col("p_size") % 5 - 2) * 0.01)
    return table(spark, d, "part").select("p_partkey", F.round(lens.radial_limit("opencv_fisheye", k), 6).alias("limit_radius"))


HALF = math.radians(10.0)  # half of the turn about y of the view
CAMERA, VIEW = (900.0, 880.0, 960.0, 540.0), (800.0, 800.0, 640.0, 360.0)


@query("wrp03_undistort_points", f"""WITH q AS (SELECT p_partkey, ((560 + p_partkey * 37 % 801) - {CAMERA[2]}::DOUBLE) / {CAMERA[0]} AS x, ((240 + p_partkey * 23 % 601) - {CAMERA[3]}::DOUBLE) / {CAMERA[1]} AS y FROM part),
r AS (SELECT *, sqrt(x * x + y * y) AS r FROM q),
i AS (SELECT p_partkey, x * s AS x, y * s AS y FROM (SELECT *, CASE WHEN r > 1e-9 THEN tan({_sum('(r / 0.9::DOUBLE)', {i: c for i, c in enumerate(COEFFICIENTS['gopro']) if i})}) / r ELSE 1 END AS s FROM r)),
t AS (SELECT p_partkey, x * cos({2 * HALF!r}::DOUBLE) + sin({2 * HALF!r}::DOUBLE) AS x, y, cos({2 * HALF!r}::DOUBLE) - x * sin({2 * HALF!r}::DOUBLE) AS z FROM i)
SELECT p_partkey, round(x / z * {VIEW[0]} + {VIEW[2]}, 4) + 0 AS x, round(y / z * {VIEW[1]} + {VIEW[3]}, 4) + 0 AS y FROM t""")
def wrp03(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.functions import quat as Q

    p = table(spark, d, "part").select(
        "p_partkey", (560 + F.col("p_partkey") * 37 % 801).cast("double").alias("px"), (240 + F.col("p_partkey") * 23 % 601).cast("double").alias("py"),
        F.array(*(F.lit(c) for c in COEFFICIENTS["gopro"])).alias("k"), Q.quat(math.cos(HALF), 0.0, math.sin(HALF), 0.0).alias("q"),
    )
    out = lens.undistort_points(p, "gopro", CAMERA, VIEW, "q")
    return out.select("p_partkey", (F.round("place.x", 4) + 0).alias("x"), (F.round("place.y", 4) + 0).alias("y"))
