"""STM02, SYN03, SYN05, SYN06 and SYN11 queries: frame pairs, turns, offsets and readout times from points matched in two frames.

For the turns each vector is a frame pair: its numbers are 32 points of the ideal plane, its first three the turn to the later frame.
A lens puts both ends into pixels; every third match is wrong.  The SQL knows the turn and never sees a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import pointsync, pose, sync, warp
from motionspark.plans.registry import query
from motionspark.plans.telemetry import QUATS_SQL, quats, table
from motionspark.plans.warp import GOPRO, slerp_sql

LENS = (0.05, -0.01, 0.004, -0.001)
PAIRS_SQL = """t AS (SELECT vec_id // 50 AS recording_id, vec_id % 50 * 20000 AS ts_us, embedding[1]::DOUBLE / 10 AS x, embedding[2]::DOUBLE / 10 AS y, embedding[3]::DOUBLE / 10 AS z FROM embeddings),
p AS (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM t)"""


def _through_the_lens(points: Column) -> Column:
    """Pixels of an array of points (x, y, f) of the ideal plane, through a fisheye lens; each step is worked out once for a point."""
    r = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["f"].alias("f"), F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]).alias("r")))
    t = F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["f"].alias("f"), p["r"].alias("r"), F.atan(p["r"]).alias("t")))
    bent = lambda t: t + sum(F.lit(k) * F.pow(t, F.lit(3.0 + 2 * i)) for i, k in enumerate(LENS))
    s = F.transform(t, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["f"].alias("f"), F.when(p["r"] > 0, bent(p["t"]) / p["r"]).otherwise(F.lit(1.0)).alias("s")))
    return F.transform(s, lambda p: F.struct((p["x"] * p["s"] * p["f"] + 955.0).alias("x"), (p["y"] * p["s"] * p["f"] + 545.0).alias("y")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    f = 800.0 + F.floor(F.col("vec_id") / 50) % 40 * 5
    v = [F.get("embedding", F.lit(i)).cast("double") / 10 for i in range(3)]
    turned = e.select(F.floor(F.col("vec_id") / 50).cast("long").alias("recording_id"), (F.col("vec_id") % 50 * 20_000).alias("ts_us"), "embedding", f.alias("f"), Q.from_scaled_axis(*v).alias("turn"))

    n = F.sequence(F.lit(0), F.lit(31))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.col("f"))
    first = F.transform(n, lambda i: point(*(F.get("embedding", 2 * i + k).cast("double") for k in (0, 1))))
    seen = F.transform(first, lambda p, i: F.struct(i.alias("i"), Q.rotate(F.col("turn"), p["x"], p["y"], F.lit(1.0)).alias("v")))
    wrong = lambda i: F.when(i % 3 == 2, F.lit(0.1) + i * 0.01).otherwise(F.lit(0.0))
    second = F.transform(seen, lambda p: point(p["v"]["x"] / p["v"]["z"] + wrong(p["i"]), p["v"]["y"] / p["v"]["z"] - wrong(p["i"]) * wrong(p["i"])))
    lines = F.zip_with(_through_the_lens(first), _through_the_lens(second), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    camera = warp.camera({"model": "opencv_fisheye", "k": F.array(*(F.lit(k) for k in LENS)), "fx": F.col("f"), "fy": F.col("f"), "cx": 955.0, "cy": 545.0, "width": 1920, "height": 1080})
    return turned.select("recording_id", "ts_us", (F.col("ts_us") + 20_000).alias("next_ts_us"), camera.alias("camera"), lines.alias("lines"))


@query("syn11_poses", f"""WITH {PAIRS_SQL} SELECT recording_id, ts_us, 32 AS lines, 22 AS inliers, round(cos(a / 2), 6) + 0 AS w,
  {", ".join(f"round({c} * CASE WHEN a > 0 THEN sin(a / 2) / a ELSE 0.5 END, 6) + 0 AS {c}" for c in "xyz")} FROM p""")
def syn11(spark: SparkSession, d: str) -> DataFrame:
    q = pose.estimate_poses(pairs(spark, d))
    return q.select("recording_id", "ts_us", F.col("lines").cast("int"), F.col("inliers").cast("int"), *((F.round(f"q.{c}", 6) + 0).alias(c) for c in "wxyz"))


@query("syn11_essential_poses", f"""WITH {PAIRS_SQL} SELECT recording_id, ts_us, round(cos(a / 2), 4) + 0 AS w,
  {", ".join(f"round({c} * CASE WHEN a > 0 THEN sin(a / 2) / a ELSE 0.5 END, 4) + 0 AS {c}" for c in "xyz")} FROM p""")
def syn11_essential(spark: SparkSession, d: str) -> DataFrame:
    q = pose.estimate_poses(pairs(spark, d), "essential")
    return q.select("recording_id", "ts_us", *((F.round(f"q.{c}", 4) + 0).alias(c) for c in "wxyz"))


@query("syn03_estimated_rates", f"""WITH {PAIRS_SQL} SELECT recording_id, ts_us, ts_us + CASE WHEN lead(ts_us) OVER w IS NULL THEN 0 ELSE (lead(ts_us) OVER w - ts_us) / 2 END AS mid_us,
  round(degrees(y * 50), 4) + 0 AS x, round(degrees(x * 50), 4) + 0 AS y, round(degrees(z * 50), 4) + 0 AS z FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY ts_us)""")
def syn03(spark: SparkSession, d: str) -> DataFrame:
    """Poses as rates in degrees a second, between their frames."""
    r = sync.midpoint_rates(pose.rates(pose.estimate_poses(pairs(spark, d))))
    return r.select("recording_id", "ts_us", "mid_us", *((F.round(c, 4) + 0).alias(c) for c in "xyz"))


@query("syn13_estimated_as_raw", f"""WITH {PAIRS_SQL}, i AS (SELECT user_id AS recording_id, epoch_us(ts) AS ts_us, CASE WHEN user_id % 3 > 0 AND event_type <> 'error' THEN value END AS g FROM events)
SELECT recording_id, ts_us, g AS gx, g AS gy, g AS gz FROM i WHERE recording_id IN (SELECT recording_id FROM i WHERE g IS NOT NULL)
UNION ALL SELECT recording_id, ts_us, round(degrees(y * 50), 4) + 0 AS gx, round(degrees(x * 50), 4) + 0 AS gy, round(degrees(z * 50), 4) + 0 AS gz FROM p WHERE recording_id NOT IN (SELECT recording_id FROM i WHERE g IS NOT NULL)""")
def syn13(spark: SparkSession, d: str) -> DataFrame:
    """A third of the recordings has lost its gyro."""
    r = sync.midpoint_rates(pose.rates(pose.estimate_poses(pairs(spark, d)))).select("recording_id", "ts_us", *((F.round(c, 4) + 0).alias(f"g{c}") for c in "xyz"))
    e = table(spark, d, "events")
    g = F.when((F.col("user_id") % 3 > 0) & (F.col("event_type") != "error"), F.col("value"))
    recorded = e.select(F.col("user_id").alias("recording_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), *(g.alias(f"g{c}") for c in "xyz"))
    return sync.or_estimated(recorded, r)


# Two ranges of five frame pairs a recording, and one pair behind each; a calm camera: a tenth of each turn.
CALM_SQL = f"""{QUATS_SQL}, c0 AS (SELECT recording_id, ts_us, acos(least(abs(w), 1.0::DOUBLE)) AS th, CASE WHEN w < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, w, x, y, z FROM quats),
c1 AS (SELECT *, CASE WHEN sin(th) < 1e-9::DOUBLE THEN 0.9::DOUBLE ELSE sin(0.9::DOUBLE * th) / sin(th) END AS ka, CASE WHEN sin(th) < 1e-9::DOUBLE THEN 0.1::DOUBLE ELSE sin(0.1::DOUBLE * th) / sin(th) END * sg AS kb FROM c0),
calm AS (SELECT recording_id, ts_us, ka + kb * w AS w, kb * x AS x, kb * y AS y, kb * z AS z FROM c1),
qn AS (SELECT *, lead(ts_us) OVER v AS t2, lead(w) OVER v AS w2, lead(x) OVER v AS x2, lead(y) OVER v AS y2, lead(z) OVER v AS z2 FROM calm WINDOW v AS (PARTITION BY recording_id ORDER BY ts_us)),
rg AS (SELECT recording_id, g AS range, 100000 + g * 400000 AS from_us, 300000 + g * 400000 AS to_us FROM (SELECT DISTINCT recording_id FROM quats), range(2) AS r(g)),
ln AS (SELECT recording_id, range, ts_us, r * 7 + c AS nth, e AS ending, ts_us + e * 40000 AS t_us, 800 + recording_id % 40 * 5 AS f, 1920 * (c + 0.5::DOUBLE) / 7 + e * 2 * c AS px, 1080 * (r + 0.5::DOUBLE) / 5 - e * r AS py
  FROM (SELECT *, from_us + k * 40000 AS ts_us FROM rg, range(5) AS p(k)), range(7) AS a(c), range(5) AS b(r), range(2) AS d(e))"""


def _costs_sql(name: str, grid: str, at_us: str) -> str:
    """(recording_id, range, n, o, cost) of the places ``o`` of ``grid``; ``at_us`` is when a point was seen."""
    powers = " + ".join(f"{c!r}::DOUBLE * pow(rad / 0.9::DOUBLE, {i})" for i, c in enumerate(GOPRO) if i)
    ray = ["(1 - 2 * (ny * ny + nz * nz)) * u * s - 2 * (nx * ny - nw * nz) * v * s - 2 * (nx * nz + nw * ny)", "-2 * (nx * ny + nw * nz) * u * s + (1 - 2 * (nx * nx + nz * nz)) * v * s + 2 * (ny * nz - nw * nx)",
           "-2 * (nx * nz - nw * ny) * u * s + 2 * (ny * nz + nw * nx) * v * s + (1 - 2 * (nx * nx + ny * ny))"]
    return f"""{name}_l AS (SELECT ln.*, n, o, {at_us} AS at_us FROM ln JOIN {grid} USING (recording_id, range)), {slerp_sql(f"{name}_s", f"{name}_l", "n")},
{name}_u AS (SELECT *, (px - 955) / f AS u, (py - 545) / f AS v, sqrt(pow((px - 955) / f, 2) + pow((py - 545) / f, 2)) AS rad FROM {name}_s),
{name}_v AS (SELECT *, CASE WHEN rad < 1e-9::DOUBLE THEN 1 WHEN {powers} < 1.5533::DOUBLE THEN tan({powers}) / rad ELSE (tan(1.5533::DOUBLE) + ({powers} - 1.5533::DOUBLE) * (1 + pow(tan(1.5533::DOUBLE), 2))) / rad END AS s FROM {name}_u),
{name}_w AS (SELECT *, {", ".join(f"{x} AS v{i}" for i, x in enumerate(ray))} FROM {name}_v),
{name}_x AS (SELECT recording_id, range, ts_us, nth, ending, n, o, f / 1.5::DOUBLE * v0 / v2 + 640 AS x, f / 1.5::DOUBLE * v1 / v2 + 360 AS y FROM {name}_w),
{name}_d AS (SELECT recording_id, range, ts_us, n, o, floor(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d FROM (SELECT * FROM {name}_x WHERE ending = 0) a JOIN (SELECT * FROM {name}_x WHERE ending = 1) b USING (recording_id, range, ts_us, n, o, nth)
  WHERE a.x > 0 AND a.x < 1920 AND a.y > 0 AND a.y < 1080 AND b.x > 0 AND b.x < 1920 AND b.y > 0 AND b.y < 1080),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, range, ts_us, n ORDER BY d) AS place, count(*) OVER (PARTITION BY recording_id, range, ts_us, n) AS c FROM {name}_d),
{name} AS (SELECT recording_id, range, n, o, coalesce(sum(d), 0) AS cost FROM {grid} LEFT JOIN (SELECT * FROM {name}_o WHERE place <= trunc(c * 0.9::DOUBLE)) USING (recording_id, range, n, o) GROUP BY ALL)"""


def _search_sql(coarse: str, at_us: str, steps: int = 20) -> str:
    """``best`` (recording_id, range, o, cost): the least of ``steps`` ``coarse`` places, refined."""
    least = "arg_min(o, (cost, -n)) AS o, min(cost) AS cost"
    return f"""{CALM_SQL}, g0 AS (SELECT recording_id, range, n, {coarse} AS o FROM rg, range({steps}) AS r(n)), {_costs_sql("k0", "g0", at_us)},
g1 AS (SELECT recording_id, range, r.n, o - 1.0::DOUBLE + r.n * 0.01::DOUBLE AS o FROM (SELECT recording_id, range, {least} FROM k0 GROUP BY ALL), range(200) AS r(n)), {_costs_sql("k1", "g1", at_us)},
best AS (SELECT recording_id, range, {least} FROM k1 GROUP BY ALL)"""


def matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frame pairs of sync ranges, with a grid of points that moves apart, and the recordings' orientations."""
    q = quats(spark, d)
    f = (800 + F.col("recording_id") % 40 * 5).cast("double")
    camera = warp.camera({
        "model": "gopro", "k": F.array(*(F.lit(k) for k in GOPRO)), "fx": f, "fy": f, "cx": 955.0, "cy": 545.0, "width": 1920, "height": 1080, "out_width": 1280, "out_height": 720, "readout_ms": 16.0,
    })
    at = [(1920 * (c + 0.5) / 7, 1080 * (r + 0.5) / 5, 2 * c, r) for r in range(5) for c in range(7)]
    lines = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in ((x, "x1"), (y, "y1"), (x + u, "x2"), (y - v, "y2")))) for x, y, u, v in at))
    ranges = q.select("recording_id").distinct().select("recording_id", F.explode(F.array(*(F.lit(g).cast("long") for g in (0, 1)))).alias("range"))
    start = 100_000 + F.col("range") * 400_000
    pairs = ranges.select("*", start.alias("from_us"), (start + 200_000).alias("to_us"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    ts = F.col("from_us") + F.col("k") * 40_000
    made = pairs.select("recording_id", "range", "from_us", "to_us", ts.alias("ts_us"), (ts + 40_000).alias("next_ts_us"), camera.alias("camera"), lines.alias("lines"))
    return made, q.withColumn("q", Q.slerp(Q.identity(), F.col("q"), F.lit(0.1)))


@query("syn05_offsets_by_points", f"""WITH {_search_sql("-10.0::DOUBLE + n", "t_us - o * 1000 + 16000.0::DOUBLE * (py / 1080 - 0.5::DOUBLE)")}
SELECT recording_id, range, (from_us + to_us) / 2000.0::DOUBLE AS middle_ms, round(o, 2) + 0 AS offset_ms, cost FROM best JOIN rg USING (recording_id, range) WHERE abs(o) < 18""")
def syn05(spark: SparkSession, d: str) -> DataFrame:
    pairs, q = matched(spark, d)
    return pointsync.offsets_by_points(pairs, q, q, 0.0, 20.0).withColumn("offset_ms", F.round("offset_ms", 2) + 0)


@query("syn06_readouts_by_points", f"""WITH {_search_sql("-40.0::DOUBLE + n", "t_us + abs(o) * 1000 * (py / 1080 - 0.5::DOUBLE)", 80)} SELECT recording_id, range, round(o, 2) + 0 AS readout_ms, cost FROM best""")
def syn06(spark: SparkSession, d: str) -> DataFrame:
    """The frames are 40 ms apart, so readout times up to that are tried."""
    pairs, q = matched(spark, d)
    return pointsync.readouts_by_points(pairs, q, q, 25.0).withColumn("readout_ms", F.round("readout_ms", 2) + 0)


@query("stm02_frame_pairs", """WITH f AS (SELECT DISTINCT l_orderkey AS recording_id, l_linenumber::BIGINT AS frame, epoch_us(l_shipdate) + l_linenumber * 1000000 AS ts_us FROM lineitem)
SELECT a.recording_id, a.frame, a.ts_us, b.ts_us AS next_ts_us FROM f a JOIN f b ON b.recording_id = a.recording_id AND b.frame = a.frame + 1 AND b.ts_us BETWEEN a.ts_us AND a.ts_us + 2592000000000""")
def stm02(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as frames of a recording, at the times at which they ship: in any order, and up to 30 days apart."""
    from motionspark.streaming import frames

    ts = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1_000_000)
    given = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").cast("long").alias("frame"), ts.alias("ts"))
    pairs = frames.frame_pairs(given, apart="30 days")
    return pairs.select("recording_id", "frame", F.unix_micros("ts").alias("ts_us"), F.unix_micros("next_ts").alias("next_ts_us"))
