"""WRP01, WRP02, WRP04, ZOM01 and ZOM05 queries: frames of rolling shutters, the way there and back, and their zoom.

Recordings are the vectors' quaternions, a camera each from ``part``: its size sets focal lengths, lens and zoom.  The
smoothed orientation is the inverse of the recorded one, so that the turn between the two is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import smooth, warp, zoomlimit
from motionspark.plans.registry import query
from motionspark.plans.telemetry import QUATS_SQL, quats, table
from motionspark.session import kept

GOPRO, FISHEYE = (0.0, 0.9, 0.05, -0.02, 0.01, 0.002, -0.001), (0.05, -0.01, 0.004, -0.001)


def frames(spark: SparkSession, d: str, model: str, k: tuple[float, ...], height: int = 1080) -> DataFrame:
    """Five frames a recording, each with its camera."""
    size = F.col("p_size").cast("double")
    camera = warp.camera({
        "model": model, "k": F.array(*(F.lit(c) * (1 + size * 0.002) for c in k)), "fx": 800 + 5 * size, "fy": 810 + 5 * size, "cx": 955.0, "cy": height / 2 + 5.0,
        "width": 1920, "height": height, "out_width": 1280, "out_height": 720, "readout_ms": 16.0, "rotation_deg": 5.0,
    })
    sizes = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("recording_id"), "p_size")
    made = quats(spark, d).select("recording_id").distinct().join(sizes.hint("merge"), "recording_id")  # parts grow with the input: none through the driver
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    made = made.select("recording_id", "p_size", nth.alias("frame"))
    return made.select("recording_id", "frame", camera.alias("camera"), (1 + F.col("p_size") % 5 * 0.1).alias("fov"), (103_000 + F.col("frame") * 200_000).alias("ts_us"))


def posed(spark: SparkSession, d: str, given: DataFrame) -> DataFrame:
    q = quats(spark, d)
    return warp.posed(given, q, q.withColumn("q", Q.conjugate(F.col("q"))))


def frames_sql(height: int = 1080) -> str:
    return f"""{QUATS_SQL}, qn AS (SELECT *, lead(ts_us) OVER v AS t2, lead(w) OVER v AS w2, lead(x) OVER v AS x2, lead(y) OVER v AS y2, lead(z) OVER v AS z2
  FROM quats WINDOW v AS (PARTITION BY recording_id ORDER BY ts_us)),
cam AS (SELECT p_partkey - 1 AS recording_id, 800 + 5 * p_size AS fx, 810 + 5 * p_size AS fy, 955.0::DOUBLE AS cx, {height / 2 + 5.0}::DOUBLE AS cy,
  1 + p_size % 5 * 0.1::DOUBLE AS fov, 1 + p_size * 0.002::DOUBLE AS more FROM part),
fr0 AS (SELECT c.*, n AS frame, 103000 + n * 200000 AS ts_us, (103000 + n * 200000)::DOUBLE AS at_us
  FROM cam c JOIN (SELECT DISTINCT recording_id FROM quats) USING (recording_id), range(5) AS r(n)),
{slerp_sql("fr", "fr0", "o")}"""


def slerp_sql(name: str, source: str, out: str) -> str:
    """``source`` with ``out``w to ``out``z: the orientation at at_us."""
    four = lambda f: ", ".join(f(c) for c in "wxyz")
    return f"""{name}_1 AS (SELECT l.*, q.t2, q.ts_us AS t1, {four(lambda c: f"q.{c} AS a{c}, coalesce(q.{c}2, q.{c}) AS g{c}")} FROM {source} l ASOF JOIN qn q ON l.recording_id = q.recording_id AND l.at_us >= q.ts_us),
{name}_2 AS (SELECT *, CASE WHEN t2 IS NULL THEN 0.0::DOUBLE ELSE (at_us - t1) / (t2 - t1) END AS t, aw * gw + ax * gx + ay * gy + az * gz AS dt FROM {name}_1),
{name}_3 AS (SELECT *, acos(least(abs(dt), 1.0::DOUBLE)) AS th, CASE WHEN dt < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN sin(th) < 1e-9::DOUBLE THEN 1 - t ELSE sin((1 - t) * th) / sin(th) END AS ka, sg * (CASE WHEN sin(th) < 1e-9::DOUBLE THEN t ELSE sin(t * th) / sin(th) END) AS kb FROM {name}_3),
{name}_5 AS (SELECT *, {four(lambda c: f"ka * a{c} + kb * g{c} AS m{c}")} FROM {name}_4),
{name}_6 AS (SELECT *, sqrt(mw * mw + mx * mx + my * my + mz * mz) AS len FROM {name}_5),
{name} AS (SELECT * EXCLUDE (t2, t1, t, dt, th, sg, ka, kb, len, {four(lambda c: f"a{c}, g{c}, m{c}")}), {four(lambda c: f"m{c} / len AS {out}{c}")} FROM {name}_6)"""


def product_sql(a: str, b: str, out: str, sa: str = "+") -> str:
    """Quaternion product of columns ``a``? and ``b``?; ``sa`` '-' takes the inverse of the first."""
    s = sa
    return (
        f"{a}w * {b}w - ({s}({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)) AS {out}w, {a}w * {b}x {s} ({a}x * {b}w + {a}y * {b}z - {a}z * {b}y) AS {out}x, "
        f"{a}w * {b}y {s} ({a}y * {b}w + {a}z * {b}x - {a}x * {b}z) AS {out}y, {a}w * {b}z {s} ({a}z * {b}w + {a}x * {b}y - {a}y * {b}x) AS {out}z"
    )


ROTATION_SQL = {
    "00": "1 - 2 * (qy * qy + qz * qz)", "01": "2 * (qx * qy - qw * qz)", "02": "2 * (qx * qz + qw * qy)", "10": "2 * (qx * qy + qw * qz)", "11": "1 - 2 * (qx * qx + qz * qz)",
    "12": "2 * (qy * qz - qw * qx)", "20": "2 * (qx * qz - qw * qy)", "21": "2 * (qy * qz + qw * qx)", "22": "1 - 2 * (qx * qx + qy * qy)",
}


def turned_sql(name: str, source: str, lines: int) -> str:
    """``source`` (a frame's columns and ``line``) with r00 to r22: the rotation of each line into the view."""
    turn = {f"0{j}": f"cos(radians(5.0::DOUBLE)) * e0{j} - sin(radians(5.0::DOUBLE)) * e1{j}" for j in range(3)}
    turn |= {f"1{j}": f"sin(radians(5.0::DOUBLE)) * e0{j} + cos(radians(5.0::DOUBLE)) * e1{j}" for j in range(3)} | {f"2{j}": f"e2{j}" for j in range(3)}
    sign = lambda ij: "-" if ij in ("01", "02", "10", "20") else ""
    return f"""{name}_a AS (SELECT * EXCLUDE (at_us), ts_us - 8000.0::DOUBLE + 16000.0::DOUBLE / {lines} * line AS at_us FROM {source}),
{slerp_sql(f"{name}_b", f"{name}_a", "n")},
{name}_c AS (SELECT *, {product_sql("o", "n", "d", "-")} FROM {name}_b), {name}_d AS (SELECT *, {product_sql("o", "d", "q", "-")} FROM {name}_c),
{name}_e AS (SELECT *, {", ".join(f"{v} AS e{k}" for k, v in ROTATION_SQL.items())} FROM {name}_d),
{name} AS (SELECT *, {", ".join(f"{sign(k)}({v}) AS r{k}" for k, v in turn.items())} FROM {name}_e)"""


INVERSE_SQL = [f"round({x}, 9) + 0" for i in range(3) for x in (f"r0{i} / nfx", f"r1{i} / nfy", f"r2{i} - r0{i} * 640 / nfx - r1{i} * 360 / nfy")]
VIEW_SQL = "fx / (greatest(fov, 0.001::DOUBLE) * 1.5::DOUBLE) AS nfx, fy / (greatest(fov, 0.001::DOUBLE) * 1.5::DOUBLE) AS nfy"


def _nine(c: str = "m") -> list[F.Column]:
    return [(F.round(F.get(c, F.lit(i)), 9) + 0).alias(f"m{i}") for i in range(9)]


@query("wrp01_row_matrices", f"""WITH {frames_sql()}, l AS (SELECT *, n AS line FROM fr, range(1080) AS r(n)), {turned_sql("tr", "l", 1080)}
SELECT recording_id, frame, line, {", ".join(f"{x} AS m{i}" for i, x in enumerate(INVERSE_SQL))} FROM (SELECT *, {VIEW_SQL} FROM tr)""")
def wrp01(spark: SparkSession, d: str) -> DataFrame:
    return warp.row_matrices(posed(spark, d, frames(spark, d, "gopro", GOPRO))).select("recording_id", "frame", "line", *_nine())


def _grid(columns: int = 7, rows: int = 5, width: int = 1920, height: int = 1080) -> dict[str, F.Column]:
    """Points over the frame as arrays px and py."""
    step = lambda n, size: [size * (i + 0.5) / n for i in range(n)]
    at = [(x, y) for y in step(rows, height) for x in step(columns, width)]
    return {name: F.array(*(F.lit(p[i]) for p in at)) for i, name in enumerate(("px", "py"))}


GRID_SQL = "SELECT *, r * 7 + c AS nth, {w} * (c + 0.5::DOUBLE) / 7 AS px, {h} * (r + 0.5::DOUBLE) / 5 AS py, {h} * (r + 0.5::DOUBLE) / 5 AS line FROM fr, range(7) AS a(c), range(5) AS b(r)"


@query("wrp02_point_matrices", f"""WITH {frames_sql()}, l AS ({GRID_SQL.format(w=1920, h=1080)}), {turned_sql("tr", "l", 1080)}
SELECT recording_id, frame, nth, {", ".join(f"round({x}, 6) + 0 AS m{i}" for i, x in enumerate([f"{f} * r{i}{j} + {c} * r2{j}" for i, f, c in ((0, "nfx", 640), (1, "nfy", 360)) for j in range(3)] + ["r20", "r21", "r22"]))}
FROM (SELECT *, {VIEW_SQL} FROM tr)""")
def wrp02(spark: SparkSession, d: str) -> DataFrame:
    at = posed(spark, d, frames(spark, d, "gopro", GOPRO)).withColumns(_grid())
    return warp.point_matrices(at).select("recording_id", "frame", "nth", *(F.round(F.get("m", F.lit(i)), 6).alias(f"m{i}") + 0 for i in range(9))).toDF("recording_id", "frame", "nth", *(f"m{i}" for i in range(9)))


def _place_sql(name: str, source: str) -> str:
    """``source`` (turned) with sx and sy: through a fisheye lens to the recorded frame; null behind it."""
    ray = [f"r0{i} * (px - 640) / nfx + r1{i} * (py - 360) / nfy + r2{i}" for i in range(3)]
    angle = "atan(rad)"
    bent = " + ".join(f"({c!r}::DOUBLE * more) * pow({angle}, {3 + 2 * i})" for i, c in enumerate(FISHEYE))
    return f"""{name}_p AS (SELECT *, {", ".join(f"{x} AS v{i}" for i, x in enumerate(ray))} FROM (SELECT *, {VIEW_SQL} FROM {source})),
{name}_q AS (SELECT *, sqrt(v0 * v0 + v1 * v1) / v2 AS rad FROM {name}_p),
{name} AS (SELECT *, CASE WHEN v2 > 0 THEN v0 / v2 * (CASE WHEN rad > 0 THEN ({angle} + {bent}) / rad ELSE 1 END) * fx + cx END AS sx,
  CASE WHEN v2 > 0 THEN v1 / v2 * (CASE WHEN rad > 0 THEN ({angle} + {bent}) / rad ELSE 1 END) * fy + cy END AS sy FROM {name}_q)"""


KEPT_SQL = "recording_id, frame, fx, fy, cx, cy, fov, more, ts_us, at_us, ow, ox, oy, oz, nth, px, py"


@query("wrp04_pixel_sources", f"""WITH {frames_sql()}, l AS ({GRID_SQL.format(w=1280, h=720).replace("720 * (r + 0.5::DOUBLE) / 5 AS line", "540 AS line")}), {turned_sql("tr", "l", 1080)}, {_place_sql("one", "tr")},
l2 AS (SELECT {KEPT_SQL}, least(greatest(least(floor(coalesce(sy, py) + 0.5::DOUBLE), 1080), 0), 1079) AS line FROM one), {turned_sql("tr2", "l2", 1080)}, {_place_sql("two", "tr2")}
SELECT recording_id, frame, nth, round(sx, 5) + 0 AS x, round(sy, 5) + 0 AS y FROM two""")
def wrp04(spark: SparkSession, d: str) -> DataFrame:
    at = posed(spark, d, frames(spark, d, "opencv_fisheye", FISHEYE)).withColumns(_grid(width=1280, height=720))
    return warp.pixel_sources(at).select("recording_id", "frame", "nth", (F.round("x", 5) + 0).alias("x"), (F.round("y", 5) + 0).alias("y"))


def _reach_sql(name: str, source: str) -> str:
    """``source`` (px, py, line and a frame's columns) with far: how wide a view the point allows, through the gopro lens."""
    powers = " + ".join(f"({c!r}::DOUBLE * more) * pow(rad / (0.9::DOUBLE * more), {i})" for i, c in enumerate(GOPRO) if i)
    return f"""{turned_sql(f"{name}_t", source, 1080)},
{name}_u AS (SELECT *, (px - cx) / fx AS u, (py - cy) / fy AS v, sqrt(pow((px - cx) / fx, 2) + pow((py - cy) / fy, 2)) AS rad FROM {name}_t),
{name}_v AS (SELECT *, CASE WHEN rad < 1e-9::DOUBLE THEN 1 WHEN {powers} < 1.5533::DOUBLE THEN tan({powers}) / rad
  ELSE (tan(1.5533::DOUBLE) + ({powers} - 1.5533::DOUBLE) * (1 + pow(tan(1.5533::DOUBLE), 2))) / rad END AS s FROM {name}_u),
{name}_w AS (SELECT *, {", ".join(f"r{i}0 * u * s + r{i}1 * v * s + r{i}2 AS v{i}" for i in range(3))} FROM {name}_v),
{name} AS (SELECT *, greatest(abs(fx * v0 / v2), abs(fy * v1 / v2) / 0.5625::DOUBLE) AS far FROM {name}_w)"""


RING_SQL = """SELECT i, CASE WHEN i < 30 THEN i / 30.0::DOUBLE WHEN i < 60 THEN 1 WHEN i < 90 THEN 1 - (i - 60) / 30.0::DOUBLE ELSE 0 END * 1920 AS px,
  CASE WHEN i < 30 THEN 0 WHEN i < 60 THEN (i - 30) / 30.0::DOUBLE WHEN i < 90 THEN 1 ELSE 1 - (i - 90) / 30.0::DOUBLE END * 1080 AS py FROM range(120) AS r(i)"""


@query("zom01_frame_fovs", f"""WITH {frames_sql()}, ring AS ({RING_SQL}), l AS (SELECT fr.*, ring.*, py AS line FROM fr, ring), {_reach_sql("one", "l")},
best AS (SELECT recording_id, frame, min(far) AS far, arg_min(i, (far, i)) AS i FROM one GROUP BY 1, 2),
closer AS (SELECT fr.*, b.far AS bound, CASE WHEN s <= 30 THEN p.px + s / 31.0::DOUBLE * (h.px - p.px) WHEN s < 62 THEN h.px + (s - 31) / 31.0::DOUBLE * (n.px - h.px) ELSE n.px END AS px,
    CASE WHEN s <= 30 THEN p.py + s / 31.0::DOUBLE * (h.py - p.py) WHEN s < 62 THEN h.py + (s - 31) / 31.0::DOUBLE * (n.py - h.py) ELSE n.py END AS py
  FROM fr JOIN best b USING (recording_id, frame) JOIN ring p ON p.i = CASE WHEN b.i = 0 THEN 15 ELSE b.i - 1 END JOIN ring h ON h.i = b.i JOIN ring n ON n.i = (b.i + 1) % 120, range(63) AS r(s)),
l2 AS (SELECT *, py AS line FROM closer), {_reach_sql("two", "l2")}
SELECT recording_id, frame, round(least(min(bound), min(far)) / 960, 7) AS fov FROM two GROUP BY 1, 2""")
def zom01(spark: SparkSession, d: str) -> DataFrame:
    found = warp.frame_fovs(posed(spark, d, frames(spark, d, "gopro", GOPRO)))
    return found.select("recording_id", "frame", F.round("fov", 7).alias("fov"))


@query("zom05_zoom_limit")
def zom05(spark: SparkSession, d: str) -> DataFrame:
    """Smoothing, FOVs and a moving zoom again and again until no frame is zoomed in by more than 90 percent of the frame, five times at most."""
    rate, q = 50.0, quats(spark, d)
    # Orientations close to one another, as a held camera has them: a tenth of each turn.
    calm = q.withColumn("q", Q.slerp(Q.identity(), F.col("q"), F.lit(0.1)))
    given = kept(frames(spark, d, "gopro", GOPRO), "cameras")  # read in every round

    def fovs_of(allowances: DataFrame) -> DataFrame:
        per_sample = calm.join(allowances.select("recording_id", "frame", "allowance").hint("merge"), (calm.recording_id == allowances.recording_id) & (F.floor((F.col("ts_us") + 97_000) / 200_000) == F.col("frame")), "left")
        chosen = calm.join(allowances.select("recording_id").distinct().hint("merge"), "recording_id", "left_semi")
        chosen = chosen.join(per_sample.select(calm.recording_id, "ts_us", "allowance").hint("merge"), ["recording_id", "ts_us"]).withColumn("allowance", F.coalesce("allowance", F.lit(1.0)))
        smoothed = smooth.smooth_dampened(chosen, rate, allowance="allowance")
        some = given.join(allowances.select("recording_id", "frame").hint("merge"), ["recording_id", "frame"], "left_semi")
        return warp.frame_fovs(warp.posed(some, calm, smoothed.select("recording_id", "ts_us", "q")))

    out = zoomlimit.limit_zoom(given, fovs_of, zoomlimit.narrowest(90.0, 1.0), rounds=5)
    return out.select("recording_id", "frame", F.round("fov", 6).alias("fov"), F.round("allowance", 6).alias("allowance"), "rounds")
