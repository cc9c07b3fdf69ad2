"""SYN, SMO05, W33, W37 and MTH03 queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import quat as Q
from motionspark.operators import horizon, series, sync, syncpoints
from motionspark.plans.registry import query
from motionspark.plans.telemetry import IMU_SQL, LENS_SQL, QUATS_SQL, imu, lens_rows, quats

W = "PARTITION BY recording_id ORDER BY ts_us"
HOUR = 3_600_000  # an hour of events counts as a millisecond, in microseconds of events to a microsecond
SHIFT = 4_370  # microseconds by which the gyro is late


def r6(c: str):
    return (F.round(c, 6) + 0).alias(c)


@query("syn04_offset_search", f"""WITH {IMU_SQL}, t AS (SELECT recording_id, seq, (ts_us - 1704067200000000) / {HOUR}::DOUBLE AS us, gx AS x, gy AS y, gz AS z FROM imu WHERE gx IS NOT NULL),
e AS (SELECT recording_id, us::BIGINT / 1000.0::DOUBLE AS t, x, y, z FROM t WHERE seq % 3 = 0), s AS (SELECT recording_id, min(t) AS a, max(t) AS b, count(*) AS n, max(greatest(abs(x), abs(y), abs(z))) AS m FROM e GROUP BY 1),
h AS (SELECT recording_id, (us::BIGINT - {SHIFT}) / 1000.0::DOUBLE AS t, x, y, z FROM t),
g AS (SELECT h.recording_id, trunc(h.t * 1000)::BIGINT AS k, h.x AS gx, h.y AS gy, h.z AS gz FROM h JOIN s USING (recording_id) WHERE h.t >= s.a - 10 AND h.t <= s.b + 10),
c0 AS (SELECT recording_id, -10.0::DOUBLE + i AS o FROM s, range(20) r(i) WHERE m >= 3),
m0 AS (SELECT e.*, o, greatest(trunc((t - o) * 1000), 0)::BIGINT AS k FROM e JOIN c0 USING (recording_id)),
j0 AS (SELECT m0.recording_id, m0.o, (g.gx - x) * (g.gx - x) * 70 + (g.gy - y) * (g.gy - y) * 70 + (g.gz - z) * (g.gz - z) * 100 AS d FROM m0 ASOF JOIN g ON m0.recording_id = g.recording_id AND m0.k <= g.k),
b0 AS (SELECT recording_id, arg_min(o, (cost, -o)) AS o FROM (SELECT recording_id, o, sum(d) / count(*) AS cost, count(*) AS n FROM j0 GROUP BY ALL) q JOIN (SELECT recording_id, n AS every FROM s) USING (recording_id) WHERE n > every // 2 GROUP BY 1),
c1 AS (SELECT recording_id, o + (-2.0::DOUBLE + i * 0.01::DOUBLE) AS o FROM b0, range(200) r(i)),
m1 AS (SELECT e.*, o, greatest(trunc((t - o) * 1000), 0)::BIGINT AS k FROM e JOIN c1 USING (recording_id)),
j1 AS (SELECT m1.recording_id, m1.o, (g.gx - x) * (g.gx - x) * 70 + (g.gy - y) * (g.gy - y) * 70 + (g.gz - z) * (g.gz - z) * 100 AS d FROM m1 ASOF JOIN g ON m1.recording_id = g.recording_id AND m1.k <= g.k),
b1 AS (SELECT recording_id, arg_min(o, (cost, -o)) AS o, min(cost) AS cost FROM (SELECT recording_id, o, sum(d) / count(*) AS cost, count(*) AS n FROM j1 GROUP BY ALL) q JOIN (SELECT recording_id, n AS every FROM s) USING (recording_id) WHERE n > every // 2 GROUP BY 1)
SELECT recording_id, round(o, 2) + 0 AS offset_ms, round(cost, 4) + 0 AS cost FROM b1 WHERE abs(o) < 9""")
def syn04(spark: SparkSession, d: str) -> DataFrame:
    """Every third sample as the video's, all of them, earlier, as the gyro's."""
    known = imu(spark, d).where("gx is not null")
    us = ((F.col("ts_us") - 1704067200000000) / HOUR).cast("double")
    s = known.select("recording_id", "seq", F.round(us).cast("long").alias("ts_us"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))
    found = sync.find_offsets(s.where("seq % 3 = 0"), s.withColumn("ts_us", F.col("ts_us") - SHIFT), sync.Grid(0.0, 10.0))
    cost = F.round(F.col("cost") * 10_000) / 10_000 + 0  # halves as the SQL rounds them: of the product, not of the decimal digits
    return found.select("recording_id", (F.round("offset_ms", 2) + 0).alias("offset_ms"), cost.alias("cost"))


@query("syn09_apply_offsets", f"""WITH {LENS_SQL}, o AS (SELECT user_id AS recording_id, epoch_us(ts) AS ts_us, (event_id % 11 - 5)::DOUBLE AS offset_ms FROM events WHERE event_type = 'purchase'),
n AS (SELECT recording_id, trunc((ts_us / 1000.0::DOUBLE - offset_ms) * 1000)::BIGINT AS ts_us, max(offset_ms) AS offset_ms FROM (SELECT recording_id, ts_us, round(focal_length)::DOUBLE AS offset_ms FROM lens) GROUP BY 1, 2)
SELECT recording_id, ts_us, offset_ms FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.recording_id = o.recording_id AND o.ts_us >= n.ts_us - {6 * 3600000000} AND o.ts_us < n.ts_us + {6 * 3600000000}) UNION ALL SELECT * FROM n""")
def syn09(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.plans.telemetry import offsets

    new = lens_rows(spark, d).select("recording_id", "ts_us", F.round("focal_length").cast("double").alias("offset_ms"))
    return sync.apply_offsets(offsets(spark, d), new, radius_us=6 * 3_600_000_000)


FFT, STEP_MS = 17, 60.0  # samples 60 ms apart: some 17 a second in recordings of this length
WINDOW = sync.blackman(FFT)
DFT = f"""w AS (SELECT unnest(range({FFT})) AS j, unnest([{', '.join(f'{v!r}::DOUBLE' for v in WINDOW)}]) AS win),
f AS (SELECT b.k, w.j, win * (cos(2 * pi() * j * b.k / {FFT}) + cos(2 * pi() * j * ({FFT - 1} - b.k) / {FFT})) AS re, -win * (sin(2 * pi() * j * b.k / {FFT}) + sin(2 * pi() * j * ({FFT - 1} - b.k) / {FFT})) AS im FROM w, (SELECT unnest(range({FFT // 2})) AS k) b)"""
EVEN_SQL = f"""s AS (SELECT recording_id, row_number() OVER ({W}) - 1 AS n, coalesce(gx, 0) AS x, coalesce(gy, 0) AS y, coalesce(gz, 0) AS z FROM imu),
c AS (SELECT recording_id, count(*) / ((count(*) - 1) * {STEP_MS}::DOUBLE) * 1000 AS rate, (count(*) - 1) * {STEP_MS}::DOUBLE AS dur FROM s GROUP BY 1),
e AS (SELECT recording_id, i, i * 1000 / rate / {STEP_MS}::DOUBLE AS p FROM (SELECT recording_id, rate, unnest(range(trunc(dur * rate / 1000)::BIGINT)) AS i FROM c)),
i AS (SELECT e.recording_id, e.i AS n, a.x + (b.x - a.x) * (p - floor(p)) AS gx, a.y + (b.y - a.y) * (p - floor(p)) AS gy, a.z + (b.z - a.z) * (p - floor(p)) AS gz, count(*) OVER (PARTITION BY e.recording_id) AS c
  FROM e JOIN s a ON a.recording_id = e.recording_id AND a.n = floor(p) JOIN s b ON b.recording_id = e.recording_id AND b.n = floor(p) + 1)"""


@query("syn01_sync_ranks", f"""WITH {IMU_SQL}, {DFT}, {EVEN_SQL},
s2 AS (SELECT i.recording_id, v.idx, f.k, sum(gx * re) AS xr, sum(gx * im) AS xi, sum(gy * re) AS yr, sum(gy * im) AS yi, sum(gz * re) AS zr, sum(gz * im) AS zi
  FROM i JOIN (SELECT unnest(range(16)) AS idx) v ON i.n BETWEEN v.idx * 16 AND v.idx * 16 + {FFT - 1} AND v.idx * 16 + {FFT} <= i.c JOIN f ON f.j = i.n - v.idx * 16 GROUP BY 1, 2, 3),
m AS (SELECT recording_id, idx, k, (sqrt(xr * xr + xi * xi) + sqrt(yr * yr + yi * yi) + sqrt(zr * zr + zi * zi)) * sqrt(1 / {FFT}.0::DOUBLE) / {FFT} * 256 AS size FROM s2),
b AS (SELECT recording_id, idx, coalesce(sum(size) FILTER (k < 2), 0) AS lo, coalesce(sum(size) FILTER (k >= 2 AND k < 7), 0) AS mid FROM m GROUP BY 1, 2),
t AS (SELECT *, max(mid) OVER (PARTITION BY recording_id) < 50 AS still FROM b)
SELECT recording_id, idx, round(CASE WHEN still THEN lo + mid ELSE mid / (1 + CASE WHEN lo < 650 THEN 0 ELSE lo - 650 END * 0.003::DOUBLE) END, 6) AS rank FROM t""")
def syn01(spark: SparkSession, d: str) -> DataFrame:
    """Unknown rates are 0 here and count as samples."""
    n = (F.row_number().over(Window.partitionBy("recording_id").orderBy("ts_us")) - 1).cast("double")
    even = imu(spark, d).select("recording_id", (n * STEP_MS * 1000).alias("ts_us"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gx", "gy", "gz")))
    return syncpoints.sync_ranks(even).select("recording_id", "idx", F.round("rank", 6).alias("rank"))


GRAVITY_SQL = f"""{QUATS_SQL}, p AS (SELECT *, lag(w, 1, w) OVER v AS ow, lag(x, 1, x) OVER v AS ox, lag(y, 1, y) OVER v AS oy, lag(z, 1, z) OVER v AS oz FROM quats WINDOW v AS ({W})),
c AS (SELECT *, ow * w + ox * x + oy * y + oz * z AS cw, ow * x - ox * w - oy * z + oz * y AS cx, ow * y + ox * z - oy * w - oz * x AS cy, ow * z - ox * y + oy * x - oz * w AS cz FROM p),
a AS (SELECT *, (atan2(x + 0.1::DOUBLE, y) - atan2(2 * (cw * cz - cx * cy), 1 - 2 * (cy * cy + cz * cz)) + radians(5.0::DOUBLE)) / 2 AS h FROM c)"""


@query("smo05_gravity_lock", f"""WITH {GRAVITY_SQL} SELECT recording_id, ts_us, round(w * cos(h) - z * sin(h), 6) + 0 AS w, round(x * cos(h) + y * sin(h), 6) + 0 AS x, round(y * cos(h) - x * sin(h), 6) + 0 AS y, round(w * sin(h) + z * cos(h), 6) + 0 AS z FROM a""")
def smo05(spark: SparkSession, d: str) -> DataFrame:
    """The orientation before as the unsmoothed one, and gravity from the orientation's own numbers."""
    before = F.coalesce(F.lag("q").over(Window.partitionBy("recording_id").orderBy("ts_us")), F.col("q"))
    g = F.struct((F.col("q.x") + 0.1).alias("x"), F.col("q.y").alias("y"), F.col("q.z").alias("z"))
    out = horizon.lock_to_gravity(quats(spark, d).withColumn("original", before).withColumn("gravity", g), 100.0, roll_deg=5.0)
    return out.select("recording_id", "ts_us", *((F.round(F.col(f"q.{c}"), 6) + 0).alias(c) for c in "wxyz"))


A = 0.02 / (0.5 + 0.02)


@query("w37_dynamic_tilt", f"""WITH RECURSIVE {QUATS_SQL}, n AS MATERIALIZED (SELECT recording_id, ts_us, degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))) AS a, row_number() OVER ({W}) AS i FROM quats),
s AS MATERIALIZED (SELECT recording_id, ts_us, i, (CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END) / 0.02::DOUBLE AS rate FROM (SELECT *, a - lag(a) OVER (PARTITION BY recording_id ORDER BY i) AS d FROM n)),
r AS (SELECT recording_id, i, NULL::DOUBLE AS f, 0.0::DOUBLE AS tilt FROM s WHERE i = 1
  UNION ALL SELECT recording_id, i, f, tilt + greatest(-{400 * 0.02!r}::DOUBLE, least({400 * 0.02!r}::DOUBLE, (CASE WHEN abs(f) > 40 THEN f * 0.5::DOUBLE ELSE 0 END - tilt) * {A!r}::DOUBLE))
  FROM (SELECT s.recording_id, s.i, p.tilt, CASE WHEN p.f IS NULL THEN s.rate ELSE p.f + (s.rate - p.f) * {A!r}::DOUBLE END AS f FROM r p JOIN s ON s.recording_id = p.recording_id AND s.i = p.i + 1))
SELECT recording_id, ts_us, round(tilt, 5) + 0 AS tilt_deg FROM r JOIN s USING (recording_id, i)""")
def w37(spark: SparkSession, d: str) -> DataFrame:
    t = horizon.dynamic_tilt(quats(spark, d), horizon.Tilt(threshold=40.0, multiplier=0.5, limit=400.0))
    return t.select("recording_id", "ts_us", (F.round("tilt_deg", 5) + 0).alias("tilt_deg"))


@query("mth03_catmull_rom", f"""WITH {IMU_SQL}, k AS (SELECT recording_id, ts_us, ax AS a, lag(ax) OVER ({W}) AS x, lead(ax) OVER ({W}) AS b, lead(ax, 2) OVER ({W}) AS y, lead(ts_us) OVER ({W}) AS nt FROM imu),
l AS (SELECT recording_id, ts_us + 1800000000 * (seq % 5) AS ts_us FROM imu), j AS (SELECT l.recording_id, l.ts_us, k.a, coalesce(k.x, 2 * k.a - k.b) AS x, k.b, coalesce(k.y, 2 * k.b - k.a) AS y, nt, (l.ts_us - k.ts_us)::DOUBLE / (nt - k.ts_us) AS t
  FROM l ASOF JOIN k ON l.recording_id = k.recording_id AND l.ts_us >= k.ts_us)
SELECT recording_id, ts_us, CASE WHEN nt IS NOT NULL THEN round(0.5::DOUBLE * (2 * a + (b - x) * t + (2 * x - 5 * a + 4 * b - y) * t * t + (3 * a - x - 3 * b + y) * t * t * t), 6) + 0 END AS ax FROM j""")
def mth03(spark: SparkSession, d: str) -> DataFrame:
    i = imu(spark, d)
    left = i.select("recording_id", (F.col("ts_us") + F.lit(1_800_000_000) * (F.col("seq") % 5)).alias("ts_us"))
    return series.catmull_rom(left, i.select("recording_id", "ts_us", "ax"), "ax").select("recording_id", "ts_us", r6("ax"))


PARTS_SQL = f"""p AS (SELECT recording_id, 'part' || (ts_us // {120 * 3_600_000_000} - 3945) AS file, ts_us // {120 * 3_600_000_000} AS k, (ts_us % {120 * 3_600_000_000}) / 1000000.0::DOUBLE AS t, ax FROM imu),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id, k ORDER BY t) AS step FROM p),
e AS (SELECT recording_id, k, min(t) AS first, max(t) AS last, arg_max(step, t) AS step FROM s GROUP BY 1, 2),
l AS (SELECT *, lag(last) OVER (PARTITION BY recording_id ORDER BY k) AS before, row_number() OVER (PARTITION BY recording_id ORDER BY k) AS part FROM e),
f AS (SELECT recording_id, k, part, CASE WHEN bool_or(coalesce(first < before, false)) OVER (PARTITION BY recording_id)
  THEN coalesce(sum(last + coalesce(step, last - coalesce(before, 0))) OVER (PARTITION BY recording_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS shift FROM l)"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    five_days = 120 * 3_600_000_000
    k = F.floor(F.col("ts_us") / five_days)
    file = F.concat(F.lit("part"), (k - 3945).cast("string"))
    return imu(spark, d).select("recording_id", file.alias("file"), ((F.col("ts_us") % five_days) / 1e6).alias("t"), F.lit(1.0).alias("scale"), "ax")


@query("src05_merge_logs", f"WITH {IMU_SQL}, {PARTS_SQL} SELECT recording_id, part, round(t + shift, 3) + 0 AS t, ax FROM p JOIN f USING (recording_id, k)")
def src05(spark: SparkSession, d: str) -> DataFrame:
    """A log for each five days of a recording, each with a clock of its own."""
    from motionspark.sources.logs import merge_logs

    return merge_logs(_logs(spark, d), ["recording_id"]).select("recording_id", "part", (F.round("t", 3) + 0).alias("t"), "ax")


@query("src05_seam_points", f"WITH {IMU_SQL}, {PARTS_SQL} SELECT recording_id, part, round((shift + s) * 1000, 3) + 0 AS point_ms FROM f, (SELECT unnest([-0.5, 0.5, 1.0, 2.0, 2.5])::DOUBLE AS s) WHERE part > 1")
def src05_seams(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.sources.logs import seam_points

    return seam_points(_logs(spark, d), ["recording_id"]).select("recording_id", "part", (F.round("point_ms", 3) + 0).alias("point_ms"))


def _degrees_sql(p: str) -> str:
    w, x, y, z = (f"{p}{c}" for c in "wxyz")
    return f"""round(degrees(asin(greatest(-1, least(1, 2 * ({w} * {y} - {z} * {x}))))), 6) + 0 AS {p}pitch, round(degrees(atan2(2 * ({w} * {z} + {x} * {y}), 1 - 2 * ({y} * {y} + {z} * {z}))), 6) + 0 AS {p}yaw,
  round(degrees(atan2(2 * ({w} * {x} + {y} * {z}), 1 - 2 * ({x} * {x} + {y} * {y}))), 6) + 0 AS {p}roll"""


@query("src17_camera_rows", f"""WITH {QUATS_SQL}, n AS (SELECT recording_id, ts_us, row_number() OVER ({W}) - 1 AS frame, w AS raw_w, x AS raw_x, y AS raw_y, z AS raw_z, lag(w, 1, w) OVER v AS smooth_w, lag(x, 1, x) OVER v AS smooth_x, lag(y, 1, y) OVER v AS smooth_y,
  lag(z, 1, z) OVER v AS smooth_z, CASE WHEN ts_us // 20000 % 3 = 1 THEN 20 + w END AS f, 1 + abs(x) AS fov FROM quats WINDOW v AS ({W}))
SELECT recording_id, frame, round(ts_us / 1000.0::DOUBLE, 3) + 0 AS timestamp_ms, {_degrees_sql('raw_')}, {_degrees_sql('smooth_')}, {', '.join(f'round({p}_{c}, 6) + 0 AS {p}_{c}' for p in ('raw', 'smooth') for c in 'wxyz')},
  round(last_value(f IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 3) + 0 AS focal_length, round(fov, 3) + 0 AS fov FROM n""")
def src17(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.sources.exports import camera_rows

    w = Window.partitionBy("recording_id").orderBy("ts_us")
    focal = F.when(F.floor(F.col("ts_us") / 20_000) % 3 == 1, 20 + F.col("q.w"))
    q = quats(spark, d).select(
        "recording_id", "ts_us", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("q").alias("raw"), F.coalesce(F.lag("q").over(w), F.col("q")).alias("smooth"),
        focal.alias("focal_length"), (1 + F.abs("q.x")).alias("fov"),
    )
    return camera_rows(q)
