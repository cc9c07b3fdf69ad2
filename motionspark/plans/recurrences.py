"""W11-W18, INT, SMO and ZOM queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import quat as Q
from motionspark.operators import glitches, orient, smooth, zoom
from motionspark.operators import recurrence as R
from motionspark.plans.registry import query
from motionspark.plans.telemetry import IMU_SQL, LENS_SQL, QUATS_SQL, imu, lens_rows, quats

W = "PARTITION BY recording_id ORDER BY ts_us"
A = 0.25
NUMBERED = f"n AS MATERIALIZED (SELECT recording_id, ts_us, ax AS v, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY recording_id) AS c FROM imu)"
EMA_SQL = f"""WITH RECURSIVE {IMU_SQL}, {NUMBERED},
f AS (SELECT recording_id, i, v AS y FROM n WHERE i = 1 UNION ALL SELECT n.recording_id, n.i, f.y * (1 - {A}::DOUBLE) + n.v * {A}::DOUBLE FROM f JOIN n ON n.recording_id = f.recording_id AND n.i = f.i + 1),
m AS MATERIALIZED (SELECT f.recording_id, f.i, f.y, n.c, n.ts_us FROM f JOIN n ON n.recording_id = f.recording_id AND n.i = f.i),
b AS (SELECT recording_id, i, y FROM m WHERE i = c UNION ALL SELECT m.recording_id, m.i, b.y * (1 - {A}::DOUBLE) + m.y * {A}::DOUBLE FROM b JOIN m ON m.recording_id = b.recording_id AND m.i = b.i - 1)
SELECT m.recording_id, m.ts_us, round(b.y, 6) + 0 AS ema FROM b JOIN m ON m.recording_id = b.recording_id AND m.i = b.i"""


def r6(c: str):
    return (F.round(c, 6) + 0).alias(c)


def q6(df: DataFrame) -> DataFrame:
    return df.select("recording_id", "ts_us", *((F.round(F.col(f"q.{c}"), 6) + 0).alias(c) for c in "wxyz"))


@query("w11_ema_both_ways", EMA_SQL)
def w11(spark: SparkSession, d: str) -> DataFrame:
    return R.ema_series(imu(spark, d), "ax", A).select("recording_id", "ts_us", r6("ema"))


@query("w11_ema_fold", EMA_SQL)
def w11_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.ema_fold(imu(spark, d), "ax", A).select("recording_id", "ts_us", r6("ema"))


@query("w12_adaptive_ema")
def w12(spark: SparkSession, d: str) -> DataFrame:
    f = R.per_recording(imu(spark, d), ["gx"], lambda c: {"smoothed": R.adaptive_ema(c["gx"].astype(float), 30.0, 1.0, 0.1, 5.0)}, ["smoothed"])
    return f.select("recording_id", "ts_us", F.nanvl(F.round("smoothed", 6), F.lit(None)).alias("smoothed"))


FRAMES = f"{LENS_SQL}, n AS MATERIALIZED (SELECT recording_id, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY recording_id) - 1 AS c, focal_length AS x FROM lens)"


def _follow(source: str, name: str, a: float) -> str:
    k = f"{a!r}::DOUBLE"
    step = f"least(s.x, s.x * {k} + p.q * (1 - {k}))"
    return f"""{name}b AS (SELECT recording_id, i, least(x, x * {k} + x * (1 - {k})) AS q FROM {source} WHERE i = c UNION ALL SELECT s.recording_id, s.i, {step} FROM {name}b p JOIN {source} s ON s.recording_id = p.recording_id AND s.i = p.i - 1),
{name}m AS MATERIALIZED (SELECT p.recording_id, p.i, p.q AS x, s.c FROM {name}b p JOIN {source} s ON s.recording_id = p.recording_id AND s.i = p.i),
{name}f AS (SELECT recording_id, i, least(x, x * {k} + x * (1 - {k})) AS q FROM {name}m WHERE i = 0 UNION ALL SELECT s.recording_id, s.i, {step} FROM {name}f p JOIN {name}m s ON s.recording_id = p.recording_id AND s.i = p.i + 1),
{name} AS MATERIALIZED (SELECT p.recording_id, p.i, p.q AS x, s.c FROM {name}f p JOIN {name}m s ON s.recording_id = p.recording_id AND s.i = p.i)"""


@query("w13_zom04_envelope_zoom", f"""WITH RECURSIVE {FRAMES}, {_follow('n', 'a', 1 - math.exp(-(1 / 30.0) / 4.0))}, {_follow('a', 'z', 1 - math.exp(-(1 / 30.0) / 0.2))}
SELECT recording_id, i AS frame, round(x, 6) + 0 AS zoom FROM z""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    f = lens_rows(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("focal_length").alias("fov"))
    return zoom.zoom_curve(f, fps=30.0, window_s=4.0).select("recording_id", "frame", r6("zoom"))


@query("zom02_static_zoom", f"WITH {LENS_SQL} SELECT recording_id, row_number() OVER ({W}) - 1 AS frame, min(focal_length) OVER (PARTITION BY recording_id) AS zoom FROM lens")
def zom02(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    f = lens_rows(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("focal_length").alias("fov"))
    return zoom.zoom_curve(f, fps=30.0, window_s=-1.0)


B0, B1, B2, A1, A2 = R.biquad_lowpass(10.0, 100.0)


def _biquad(source: str, name: str, first: str, following: str) -> str:
    y = f"({B0!r}::DOUBLE * n.v + p.s1)"
    return f"""{name} AS (SELECT recording_id, i, {B0!r}::DOUBLE * v + 0.0::DOUBLE AS y, {B1!r}::DOUBLE * v - {A1!r}::DOUBLE * ({B0!r}::DOUBLE * v) AS s1, {B2!r}::DOUBLE * v - {A2!r}::DOUBLE * ({B0!r}::DOUBLE * v) AS s2 FROM {source} WHERE {first}
  UNION ALL SELECT n.recording_id, n.i, {y}, {B1!r}::DOUBLE * n.v - {A1!r}::DOUBLE * {y} + p.s2, {B2!r}::DOUBLE * n.v - {A2!r}::DOUBLE * {y} FROM {name} p JOIN {source} n ON n.recording_id = p.recording_id AND n.i = p.i {following})"""


@query("w14_butterworth_lowpass", f"""WITH RECURSIVE {IMU_SQL}, {NUMBERED.replace('ax AS v', 'gx AS v').replace('FROM imu', 'FROM imu WHERE gx IS NOT NULL')}, {_biquad('n', 'f', 'i = 1', '+ 1')},
m AS MATERIALIZED (SELECT f.recording_id, f.i, f.y AS v, n.c, n.ts_us FROM f JOIN n ON n.recording_id = f.recording_id AND n.i = f.i), {_biquad('m', 'b', 'i = c', '- 1')},
o AS (SELECT m.recording_id, m.ts_us, b.y FROM b JOIN m ON m.recording_id = b.recording_id AND m.i = b.i)
SELECT recording_id, ts_us, round(o.y, 6) + 0 AS gx FROM imu LEFT JOIN o USING (recording_id, ts_us)""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the samples has no rates."""
    return R.lowpass(imu(spark, d), ["gx"], 10.0, 100.0).select("recording_id", "ts_us", r6("gx"))


@query("w15_quaternion_lowpass")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.lowpass_quats(quats(spark, d), 5.0, 50.0))


def _slerps(source: str, name: str, share: str, first: str, following: str) -> str:
    """A recursive CTE (recording_id, i, w, x, y, z): each state is a share of the way from the one before to the row of ``source``."""
    own = ", ".join(f"p.{c} AS p{c}, n.{c} AS n{c}" for c in "wxyz")
    start = f"SELECT n.recording_id, n.i, {own}, p.w * n.w + p.x * n.x + p.y * n.y + p.z * n.z AS c FROM {name} p JOIN {source} n ON n.recording_id = p.recording_id AND n.i = p.i {following}"
    arc = f"SELECT *, acos(least(abs(c), 1)) AS th, CASE WHEN c < 0 THEN -1 ELSE 1 END AS sg FROM ({start})"
    parts = f"SELECT *, CASE WHEN sin(th) < 1e-9 THEN 1 - {share} ELSE sin((1 - {share}) * th) / sin(th) END AS ka, CASE WHEN sin(th) < 1e-9 THEN {share} ELSE sin({share} * th) / sin(th) END * sg AS kb FROM ({arc})"
    mixed = f"SELECT *, sqrt({' + '.join(f'(p{c} * ka + n{c} * kb) * (p{c} * ka + n{c} * kb)' for c in 'wxyz')}) AS l FROM ({parts})"
    return f"{name} AS (SELECT recording_id, i, w, x, y, z FROM {source} WHERE {first} UNION ALL SELECT recording_id, i, {', '.join(f'(p{c} * ka + n{c} * kb) / l AS {c}' for c in 'wxyz')} FROM ({mixed}))"


PLAIN = f"{R.alpha(0.1, 50.0)!r}::DOUBLE"
ROWS = f"n AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY recording_id) AS c FROM quats)"
SHOWN = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in "wxyz")


@query("w17_smo02_plain_smoothing", f"""WITH RECURSIVE {QUATS_SQL}, {ROWS}, {_slerps('n', 'f', PLAIN, 'i = 1', '+ 1')}, m AS MATERIALIZED (SELECT f.*, n.c, n.ts_us FROM f JOIN n USING (recording_id, i)),
{_slerps('m', 'b', PLAIN, 'i = c', '- 1')} SELECT recording_id, ts_us, {SHOWN.replace('round(', 'round(b.')} FROM b JOIN (SELECT recording_id, i, ts_us FROM n) t USING (recording_id, i)""")
def w17(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.smooth(quats(spark, d), "plain", 50.0, time_constant_s=0.1))


@query("w18_smo01_dampened_smoothing")
def w18(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.smooth(quats(spark, d), "dampened", 50.0))


@query("w24_glitch_repair")
def w24(spark: SparkSession, d: str) -> DataFrame:
    return q6(glitches.repair_glitches(quats(spark, d)))


@query("w38_anchor_to_integrated", f"""WITH RECURSIVE {QUATS_SQL}, {ROWS}, t AS (SELECT *, coalesce(lead(w) OVER v, 1) AS tw, coalesce(lead(x) OVER v, 0) AS tx, coalesce(lead(y) OVER v, 0) AS ty, coalesce(lead(z) OVER v, 0) AS tz FROM n WINDOW v AS ({W})),
k AS MATERIALIZED (SELECT recording_id, i, tw * w + tx * x + ty * y + tz * z AS w, -tw * x + tx * w - ty * z + tz * y AS x, -tw * y + tx * z + ty * w - tz * x AS y, -tw * z - tx * y + ty * x + tz * w AS z FROM t), {_slerps('k', 'f', '0.005::DOUBLE', 'i = 1', '+ 1')},
o AS (SELECT f.recording_id, n.ts_us, f.w * n.w - f.x * n.x - f.y * n.y - f.z * n.z AS w, f.w * n.x + f.x * n.w + f.y * n.z - f.z * n.y AS x, f.w * n.y - f.x * n.z + f.y * n.w + f.z * n.x AS y, f.w * n.z + f.x * n.y - f.y * n.x + f.z * n.w AS z FROM f JOIN n USING (recording_id, i))
SELECT recording_id, ts_us, {SHOWN} FROM o""")
def w38(spark: SparkSession, d: str) -> DataFrame:
    """The next sample's orientation, a little before its time, as the integrated one; the last sample has none."""
    q = quats(spark, d)
    return q6(orient.anchor(q, q.withColumn("ts_us", F.col("ts_us") - 5000)))


@query("smo00_none", f"WITH {QUATS_SQL} SELECT recording_id, ts_us, round(w, 6) + 0 AS w, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z FROM quats")
def smo00(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.smooth(quats(spark, d), "none", 50.0))


def _turn(axis: str, angle: str) -> tuple[str, ...]:
    return (f"cos(({angle}) / 2)", *(f"sin(({angle}) / 2)" if c == axis else "0.0::DOUBLE" for c in "xyz"))


def _chained(source: str, turns: list[tuple[str, str]], shown: str | None = None) -> str:
    """CTEs c1, c2, ...: products of turns about axes, from left to right, beside the columns of ``source``; the last one as it is or as ``shown``."""
    steps = []
    for n, (axis, angle) in enumerate(turns):
        b = _turn(axis, angle)
        if n == 0:
            steps.append(f"c0 AS (SELECT *, {', '.join(f'{v} AS r{c}' for v, c in zip(b, 'wxyz', strict=True))} FROM {source})")
            continue
        w, x, y, z = ("p.rw", "p.rx", "p.ry", "p.rz")
        product = (
            f"{w} * {b[0]} - {x} * {b[1]} - {y} * {b[2]} - {z} * {b[3]}", f"{w} * {b[1]} + {x} * {b[0]} + {y} * {b[3]} - {z} * {b[2]}",
            f"{w} * {b[2]} - {x} * {b[3]} + {y} * {b[0]} + {z} * {b[1]}", f"{w} * {b[3]} + {x} * {b[2]} - {y} * {b[1]} + {z} * {b[0]}",
        )
        steps.append(f"c{n} AS (SELECT p.* EXCLUDE (rw, rx, ry, rz), {', '.join(f'{v} AS r{c}' for v, c in zip(product, 'wxyz', strict=True))} FROM c{n - 1} p)")
    shown = shown or ", ".join(f"round(r{c}, 6) + 0 AS {c}" for c in "wxyz")
    return f"{', '.join(steps)} SELECT recording_id, ts_us, {shown} FROM c{len(turns) - 1}"


FIXED_SQL = _chained("quats", [("z", "radians(30.0::DOUBLE)"), ("x", "radians(-12.0::DOUBLE)"), ("y", "radians(97.0::DOUBLE)"), ("z", "pi() / 2"), ("y", "pi() / 2")])
AHEAD_SQL = "v AS (SELECT *, 2 * (x * z + w * y) AS vx, 2 * (y * z - w * x) AS vy, w * w - x * x - y * y + z * z AS vz FROM quats)"
LEVEL_SQL = _chained("v", [("y", "pi() / 2"), ("z", "pi() / 2"), ("y", "atan2(vy, vx)"), ("x", "asin(greatest(-1, least(1, -vz)))"), ("z", "radians(5.0::DOUBLE)")])


@query("smo03_fixed_camera", f"WITH {QUATS_SQL}, {FIXED_SQL}")
def smo03(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.smooth(quats(spark, d), "fixed", 50.0, yaw=30.0, pitch=-12.0, roll=7.0))


@query("smo04_horizon_lock", f"WITH {QUATS_SQL}, {AHEAD_SQL}, {LEVEL_SQL}")
def smo04(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.lock_horizon(quats(spark, d), 100.0, roll_deg=5.0))


@query("smo04_pitch_lock", f"WITH {QUATS_SQL}, {AHEAD_SQL}, {LEVEL_SQL.replace('asin(greatest(-1, least(1, -vz)))', 'radians(8.0::DOUBLE)')}")
def smo04_pitch(spark: SparkSession, d: str) -> DataFrame:
    return q6(smooth.lock_horizon(quats(spark, d), 100.0, roll_deg=5.0, pitch_deg=8.0))


TURNED_SQL = """e AS (SELECT cos(a) * cos(b) * cos(g) + sin(a) * sin(b) * sin(g) AS ew, sin(a) * cos(b) * cos(g) - cos(a) * sin(b) * sin(g) AS ex, cos(a) * sin(b) * cos(g) + sin(a) * cos(b) * sin(g) AS ey, cos(a) * cos(b) * sin(g) - sin(a) * sin(b) * cos(g) AS ez
  FROM (SELECT radians(-2.0::DOUBLE) / 2 AS a, radians(3.0::DOUBLE) / 2 AS b, radians(4.0::DOUBLE) / 2 AS g)),
t AS (SELECT recording_id, ts_us, w AS ow, x AS ox, y AS oy, z AS oz, w * ew - x * ex - y * ey - z * ez AS w, w * ex + x * ew + y * ez - z * ey AS x, w * ey - x * ez + y * ew + z * ex AS y, w * ez + x * ey - y * ex + z * ew AS z FROM quats, e)"""
CORRECTED = """round(rw * ow + rx * ox + ry * oy + rz * oz, 6) + 0 AS w, round(rw * ox - rx * ow - ry * oz + rz * oy, 6) + 0 AS x, round(rw * oy + rx * oz - ry * ow - rz * ox, 6) + 0 AS y, round(rw * oz - rx * oy + ry * ox - rz * ow, 6) + 0 AS z"""
LOCKED = [("y", "pi() / 2"), ("z", "pi() / 2"), ("y", "atan2(vy, vx)"), ("x", "asin(greatest(-1, least(1, -vz)))"), ("z", "radians(5.0::DOUBLE)")]


@query("smo06_whole_step", f"WITH {QUATS_SQL}, {TURNED_SQL}, {AHEAD_SQL.replace('FROM quats', 'FROM t')}, {_chained('v', LOCKED, CORRECTED)}")
def smo06(spark: SparkSession, d: str) -> DataFrame:
    """The view's rotation, the horizon's lock, no smoothing, and the correction from there."""
    lock = lambda q: smooth.lock_horizon(q, 100.0, roll_deg=5.0)
    return q6(smooth.stabilise(quats(spark, d), "none", 50.0, (3.0, -2.0, 4.0), lock))


@query("smo07_focal_lengths")
def smo07(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.focal import smooth_focal_lengths

    w = Window.partitionBy("recording_id").orderBy("ts_us")
    frames = imu(spark, d).select("recording_id", "ts_us", (F.row_number().over(w) - 1).cast("long").alias("frame"))
    out = smooth_focal_lengths(frames, lens_rows(spark, d), 12.0, 0.4)
    return out.select("recording_id", "frame", "focal_length", r6("even"), r6("smoothed"), r6("compensation"))


@query("int03_gyro_only", f"""WITH RECURSIVE {IMU_SQL}, g AS (SELECT recording_id, min(ts_us) AS t0, (max(ts_us) - min(ts_us)) * (count(*) + 1) / count(*)::DOUBLE / count(*) AS step FROM imu GROUP BY 1),
t AS (SELECT recording_id, ts_us, -gy AS a, gx AS b, gz AS c, row_number() OVER ({W}) AS i, (ts_us - coalesce(lag(ts_us) OVER ({W}), t0 - step)) / 1e6 AS dt FROM imu JOIN g USING (recording_id) WHERE gx IS NOT NULL),
v AS (SELECT recording_id, ts_us, i, radians(a) * k AS a, radians(b) * k AS b, radians(c) * k AS c FROM (SELECT *, dt * 1e-6 AS k FROM t)),
e AS MATERIALIZED (SELECT recording_id, ts_us, i, cos(n / 2) AS w, a * s AS x, b * s AS y, c * s AS z FROM (SELECT *, CASE WHEN n > 1e-12::DOUBLE THEN sin(n / 2) / n ELSE 0.5 END AS s FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM v))),
q AS (SELECT recording_id, i, w * c0 - x * s0 AS w, w * s0 + x * c0 AS x, y * c0 - z * s0 AS y, y * s0 + z * c0 AS z FROM e, (SELECT cos(pi() / 4) AS c0, sin(pi() / 4) AS s0) WHERE i = 1
  UNION ALL SELECT e.recording_id, e.i, p.w * e.w - p.x * e.x - p.y * e.y - p.z * e.z, p.w * e.x + p.x * e.w + p.y * e.z - p.z * e.y, p.w * e.y - p.x * e.z + p.y * e.w + p.z * e.x, p.w * e.z + p.x * e.y - p.y * e.x + p.z * e.w
  FROM q p JOIN e ON e.recording_id = p.recording_id AND e.i = p.i + 1)
SELECT q.recording_id, e.ts_us, round(q.w, 5) + 0 AS w, round(q.x, 5) + 0 AS x, round(q.y, 5) + 0 AS y, round(q.z, 5) + 0 AS z FROM q JOIN e ON e.recording_id = q.recording_id AND e.i = q.i""")
def int03(spark: SparkSession, d: str) -> DataFrame:
    """Rates a million times slower than written, as samples lie hours apart."""
    slow = imu(spark, d).withColumns({c: F.col(c) * 1e-6 for c in ("gx", "gy", "gz")})
    q = orient.integrate(slow, method=3)
    return q.select("recording_id", "ts_us", *((F.round(F.col(f"q.{c}"), 5) + 0).alias(c) for c in "wxyz"))


def _integrated(method: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        slow = imu(spark, d).withColumn("ts_us", F.floor(F.col("ts_us") / 1_000_000))
        return q6(orient.integrate(slow, method=method))

    return run


for _method, _name in ((1, "complementary"), (2, "fused_both_ways"), (4, "gyro_accel"), (5, "mahony"), (6, "madgwick")):
    query(f"int0{_method}_{_name}")(_integrated(_method))
