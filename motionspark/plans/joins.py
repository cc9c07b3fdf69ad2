"""J queries: as-of, nearest, bracketing, positional and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import easing
from motionspark.functions import quat as Q
from motionspark.operators import asof
from motionspark.plans.registry import query
from motionspark.plans.telemetry import HOUR, IMU_SQL, KEYFRAMES_SQL, LENS_SQL, OFFSETS_SQL, QUATS_SQL, imu, keyframes, lens_rows, offsets, quats, table

# Left rows with the nearest right key on either side, and those keys' own neighbours.
def bracket_sql(left: str, right: str, value: str, condition: str = "true") -> str:
    return f"""r AS (SELECT recording_id, ts_us AS k, {value} AS v, lag(ts_us) OVER w AS bk, lag({value}) OVER w AS bv, lead(ts_us) OVER w AS ak, lead({value}) OVER w AS av
  FROM {right} WHERE {condition} WINDOW w AS (PARTITION BY recording_id ORDER BY ts_us)),
b AS (SELECT l.*, p.k AS pk, p.v AS pv, p.bk, p.bv, n.k AS nk, n.v AS nv, n.ak, n.av FROM {left} l
  ASOF LEFT JOIN r p ON l.recording_id = p.recording_id AND l.ts_us >= p.k ASOF LEFT JOIN r n ON l.recording_id = n.recording_id AND l.ts_us <= n.k)"""


LINE = """CASE WHEN pk IS NULL AND nk IS NULL THEN NULL
  WHEN pk IS NULL THEN CASE WHEN ak IS NULL THEN nv ELSE nv + (av - nv) * ((ts_us - nk)::DOUBLE / (ak - nk)) END
  WHEN nk IS NULL THEN CASE WHEN bk IS NULL THEN pv ELSE bv + (pv - bv) * ((ts_us - bk)::DOUBLE / (pk - bk)) END
  WHEN pk = nk THEN pv ELSE pv + (nv - pv) * ((ts_us - pk)::DOUBLE / (nk - pk)) END"""
HOLD = """CASE WHEN pk IS NULL THEN nv WHEN nk IS NULL THEN pv WHEN pk = nk THEN pv ELSE pv + (nv - pv) * ((ts_us - pk)::DOUBLE / (nk - pk)) END"""


def _left(spark, d):
    return imu(spark, d).select("recording_id", "ts_us", "seq")


@query("j01_nearest", f"""WITH {IMU_SQL}, {LENS_SQL}, {bracket_sql("imu", "lens", "focal_length")}
SELECT recording_id, ts_us, seq, CASE WHEN pk = ts_us THEN pv
  WHEN coalesce(ts_us - pk, 4611686018427387904) < coalesce(nk - ts_us, 4611686018427387904) AND ts_us - pk < {6 * HOUR} THEN pv
  WHEN coalesce(nk - ts_us, 4611686018427387904) < coalesce(ts_us - pk, 4611686018427387904) AND nk - ts_us < {6 * HOUR} THEN nv END AS focal_length FROM b""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return asof.nearest(_left(spark, d), lens_rows(spark, d), "focal_length", 6 * HOUR)


@query("j02_forward_asof", f"""WITH {IMU_SQL}, {LENS_SQL}, {bracket_sql("imu", "lens", "focal_length")}
SELECT recording_id, ts_us, seq, coalesce(nv, 1.0::DOUBLE) AS focal_length FROM b""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return asof.forward(_left(spark, d), lens_rows(spark, d), "focal_length", F.lit(1.0))


SLERP_SQL = """
s AS (SELECT *, abs(c) AS ac, CASE WHEN c < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM (SELECT *, w * w2 + x * x2 + y * y2 + z * z2 AS c FROM p)),
a AS (SELECT *, acos(least(ac, 1.0::DOUBLE)) AS th FROM s),
k AS (SELECT *, CASE WHEN sin(th) < 1e-9::DOUBLE THEN 1 - t ELSE sin((1 - t) * th) / sin(th) END AS wa, (CASE WHEN sin(th) < 1e-9::DOUBLE THEN t ELSE sin(t * th) / sin(th) END) * sg AS wb FROM a),
m AS (SELECT *, w * wa + w2 * wb AS ow, x * wa + x2 * wb AS ox, y * wa + y2 * wb AS oy, z * wa + z2 * wb AS oz FROM k),
n AS (SELECT *, sqrt(ow * ow + ox * ox + oy * oy + oz * oz) AS len FROM m)"""


@query("j03_bracket_slerp", f"""WITH {QUATS_SQL},
l AS (SELECT recording_id, ts_us + 7000 AS at_us FROM quats),
q AS (SELECT *, lead(ts_us) OVER v AS t2, lead(w) OVER v AS w2, lead(x) OVER v AS x2, lead(y) OVER v AS y2, lead(z) OVER v AS z2 FROM quats WINDOW v AS (PARTITION BY recording_id ORDER BY ts_us)),
p AS (SELECT l.recording_id, l.at_us, w, x, y, z, coalesce(w2, w) AS w2, coalesce(x2, x) AS x2, coalesce(y2, y) AS y2, coalesce(z2, z) AS z2,
  CASE WHEN t2 IS NULL THEN 0.0::DOUBLE ELSE (at_us - ts_us)::DOUBLE / (t2 - ts_us) END AS t FROM l ASOF JOIN q ON l.recording_id = q.recording_id AND l.at_us >= q.ts_us),{SLERP_SQL}
SELECT recording_id, at_us, round(ow / len, 6) + 0 AS w, round(ox / len, 6) + 0 AS x, round(oy / len, 6) + 0 AS y, round(oz / len, 6) + 0 AS z FROM n""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    q = quats(spark, d)
    left = q.select("recording_id", (F.col("ts_us") + 7000).alias("ts_us"))
    at = asof.interpolate(left, q, "q", edge="hold", mix=Q.slerp)
    return at.select("recording_id", F.col("ts_us").alias("at_us"), *((F.round(F.col(f"q.{c}"), 6) + 0).alias(c) for c in "wxyz"))


@query("j04_bracket_extrapolate", f"""WITH {IMU_SQL}, {OFFSETS_SQL}, {bracket_sql("imu", "offsets", "offset_ms")}
SELECT recording_id, ts_us, seq, round(coalesce({LINE}, 0.0::DOUBLE), 6) + 0 AS offset_ms FROM b""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    at = asof.interpolate(_left(spark, d), offsets(spark, d), "offset_ms", default=F.lit(0.0))
    return at.withColumn("offset_ms", F.round("offset_ms", 6) + 0)


@query("j05_bracket_hold", f"""WITH {IMU_SQL}, {LENS_SQL}, {bracket_sql("imu", "lens", "focal_length")}
SELECT recording_id, ts_us, seq, round({HOLD}, 6) + 0 AS focal_length FROM b""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    at = asof.interpolate(_left(spark, d), lens_rows(spark, d), "focal_length", edge="hold")
    return at.withColumn("focal_length", F.round("focal_length", 6) + 0)


def keyframe_value(left: DataFrame, frames: DataFrame, kind: str, on: str = "ts_us") -> DataFrame:
    """Adds ``value``: the eased value of the keyframes of one type; ends hold, no keyframes give null."""
    right = frames.where(F.col("type") == kind).select("recording_id", F.col("ts_us").alias(on), F.struct("value", "easing").alias("kf"))

    def mix(a, b, t):
        x = easing.apply(easing.between(a["easing"], b["easing"]), t)
        return F.struct((a["value"] * (1 - x) + b["value"] * x).alias("value"), a["easing"].alias("easing"))

    at = asof.interpolate(left, right, "kf", edge="hold", on=on, mix=mix)
    return at.withColumn("value", F.col("kf.value")).drop("kf")


EASED = """b2 AS (SELECT *, CASE WHEN pe IN ('EaseOut', 'EaseInOut') AND ne IN ('EaseIn', 'EaseInOut') THEN 'EaseInOut' WHEN ne IN ('EaseIn', 'EaseInOut') THEN 'EaseOut'
    WHEN pe IN ('EaseOut', 'EaseInOut') THEN 'EaseIn' ELSE 'NoEasing' END AS curve, (ts_us - pk)::DOUBLE / nullif(nk - pk, 0) AS t FROM b),
b3 AS (SELECT *, CASE curve WHEN 'EaseIn' THEN (1 - cos((t::FLOAT * 1.5707963267948966::FLOAT)::DOUBLE))::FLOAT::DOUBLE WHEN 'EaseOut' THEN sin((t::FLOAT * 1.5707963267948966::FLOAT)::DOUBLE)::FLOAT::DOUBLE
    WHEN 'EaseInOut' THEN (-(cos((3.141592653589793::FLOAT * t::FLOAT)::DOUBLE) - 1) / 2)::FLOAT::DOUBLE ELSE t END AS x FROM b2)"""
KEYFRAME_AT = f"""r AS (SELECT recording_id, ts_us AS k, value AS v, easing AS e FROM keyframes WHERE type = 'Fov'),
b AS (SELECT l.*, p.k AS pk, p.v AS pv, p.e AS pe, n.k AS nk, n.v AS nv, n.e AS ne FROM lft l
  ASOF LEFT JOIN r p ON l.recording_id = p.recording_id AND l.ts_us >= p.k ASOF LEFT JOIN r n ON l.recording_id = n.recording_id AND l.ts_us <= n.k), {EASED}"""
KEYFRAME_VALUE = "CASE WHEN pk IS NULL THEN nv WHEN nk IS NULL OR pk = nk THEN pv ELSE pv * (1 - x) + nv * x END"


@query("j06_keyframe_value", f"""WITH {IMU_SQL}, {KEYFRAMES_SQL}, lft AS (SELECT recording_id, ts_us, seq FROM imu), {KEYFRAME_AT}
SELECT recording_id, ts_us, seq, round({KEYFRAME_VALUE}, 4) + 0 AS value FROM b3""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return keyframe_value(_left(spark, d), keyframes(spark, d), "Fov").withColumn("value", F.round("value", 4) + 0)


@query("j07_keyframe_at_gyro_time", f"""WITH {IMU_SQL}, {OFFSETS_SQL}, {KEYFRAMES_SQL},
o AS (WITH {bracket_sql("imu", "offsets", "offset_ms")} SELECT recording_id, ts_us, seq, coalesce({LINE}, 0.0::DOUBLE) AS off FROM b),
lft AS (SELECT recording_id, ts_us AS gyro_us, ts_us + round(off * 1000)::BIGINT AS ts_us, seq FROM o), {KEYFRAME_AT}
SELECT recording_id, gyro_us AS ts_us, seq, round({KEYFRAME_VALUE}, 4) + 0 AS value FROM b3""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    at = asof.interpolate(_left(spark, d), offsets(spark, d), "offset_ms", default=F.lit(0.0))
    video = at.select("recording_id", F.col("ts_us").alias("gyro_us"), (F.col("ts_us") + F.round(F.col("offset_ms") * 1000).cast("long")).alias("ts_us"), "seq")
    got = keyframe_value(video, keyframes(spark, d), "Fov")
    return got.select("recording_id", F.col("gyro_us").alias("ts_us"), "seq", (F.round("value", 4) + 0).alias("value"))


@query("j08_ramp_lookup", f"""WITH {IMU_SQL}, {LENS_SQL},
ramp AS (SELECT recording_id, ts_us, sum(step) OVER (PARTITION BY recording_id ORDER BY ts_us) AS mapped FROM (SELECT *, coalesce((ts_us - lag(ts_us) OVER (PARTITION BY recording_id ORDER BY ts_us)) / (1 + focal_length / 100), 0)::DOUBLE AS step FROM lens)),
{bracket_sql("imu", "ramp", "mapped")} SELECT recording_id, ts_us, seq, round({LINE})::BIGINT AS mapped_us FROM b""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.series import speed_ramp

    ramp = speed_ramp(lens_rows(spark, d).withColumn("speed", 1 + F.col("focal_length") / 100), "speed", out="mapped")
    at = asof.interpolate(_left(spark, d), ramp.select("recording_id", "ts_us", "mapped"), "mapped")
    return at.select("recording_id", "ts_us", "seq", F.round("mapped").cast("long").alias("mapped_us"))


@query("j10_equi_left_identity", f"""WITH {IMU_SQL}, {OFFSETS_SQL}
SELECT i.recording_id, i.ts_us, coalesce(o.offset_ms, 0.0::DOUBLE) AS offset_ms FROM imu i LEFT JOIN offsets o ON i.recording_id = o.recording_id AND i.ts_us = o.ts_us""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    j = imu(spark, d).select("recording_id", "ts_us").join(offsets(spark, d), ["recording_id", "ts_us"], "left")
    return j.withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0.0)))


def zip_join(left: DataFrame, right: DataFrame, on: str = "ts_us") -> DataFrame:
    """Rows of both sides by their place in the recording, as far as the shorter side goes."""
    w = Window.partitionBy("recording_id").orderBy(on)
    a = left.withColumn("place", F.row_number().over(w))
    b = right.withColumn("place", F.row_number().over(w)).withColumnRenamed(on, f"right_{on}")
    return a.join(b, ["recording_id", "place"])


@query("j11_positional_zip", f"""WITH {OFFSETS_SQL}, {LENS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ts_us) AS place FROM offsets), b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ts_us) AS place FROM lens)
SELECT a.recording_id, a.place, a.ts_us, a.offset_ms, b.ts_us AS right_ts_us, b.focal_length FROM a JOIN b ON a.recording_id = b.recording_id AND a.place = b.place""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return zip_join(offsets(spark, d), lens_rows(spark, d))


@query("j12_frame_lookup_default", f"""WITH {IMU_SQL}, {LENS_SQL},
f AS (SELECT recording_id, seq, row_number() OVER (PARTITION BY recording_id ORDER BY ts_us) - 1 AS frame FROM imu),
v AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ts_us) - 1 AS frame, focal_length AS fov FROM lens),
e AS (SELECT recording_id, arg_max(fov, frame) AS last_fov FROM v GROUP BY 1)
SELECT f.recording_id, f.seq, f.frame, coalesce(v.fov, e.last_fov, 1.0::DOUBLE) AS fov FROM f LEFT JOIN v ON v.recording_id = f.recording_id AND v.frame = f.frame LEFT JOIN e ON e.recording_id = f.recording_id""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    f = imu(spark, d).select("recording_id", "seq", (F.row_number().over(w) - 1).cast("long").alias("frame"))
    v = lens_rows(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("focal_length").alias("fov"))
    end = v.groupBy("recording_id").agg(F.max_by("fov", "frame").alias("last_fov"))
    j = f.join(v, ["recording_id", "frame"], "left").join(end, "recording_id", "left")
    return j.select("recording_id", "seq", "frame", F.coalesce("fov", "last_fov", F.lit(1.0)).alias("fov"))


@query("j13_adjacent_rows", """SELECT a.conv_id, a.turn, d.d, b.turn AS next_turn, length(b.text) AS next_chars FROM conversations a, (SELECT unnest([1, 2, 3]) AS d) d
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + d.d""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    ahead = F.array(*(F.struct(F.lit(k).alias("d"), F.lead("turn", k).over(w).alias("t"), F.lead("chars", k).over(w).alias("c")) for k in (1, 2, 3)))
    out = rows.withColumn("a", ahead).select("conv_id", "turn", F.explode("a").alias("a")).where("a.t = turn + a.d")
    return out.select("conv_id", "turn", F.col("a.d").alias("d"), F.col("a.t").alias("next_turn"), F.col("a.c").cast("long").alias("next_chars"))


@query("j16_key_or_path", """SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey")


@query("j17_rating_overwrite", """SELECT c_custkey, r.rating FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice)::DECIMAL(18, 4)::DOUBLE AS rating FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON c_custkey = o_custkey""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.avg("o_totalprice").cast("decimal(18,4)").cast("double").alias("rating"))
    return table(spark, d, "customer").join(r, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "rating")


@query("j20_range_join", f"""WITH {IMU_SQL}, {OFFSETS_SQL}
SELECT i.recording_id, i.seq, o.ts_us AS range_us FROM imu i JOIN offsets o ON i.recording_id = o.recording_id AND i.ts_us >= o.ts_us - {4 * HOUR} AND i.ts_us < o.ts_us + {4 * HOUR}""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """Samples in half-open ranges around sync points, matched through slices as long as a range."""
    span = 8 * HOUR
    cut = lambda c: F.floor(c / span).cast("long")
    i = imu(spark, d).select("recording_id", "seq", "ts_us").withColumn("slice", cut(F.col("ts_us")))
    o = offsets(spark, d).select("recording_id", F.col("ts_us").alias("range_us"))
    o = o.withColumn("slice", F.explode(F.array_distinct(F.array(cut(F.col("range_us") - 4 * HOUR), cut(F.col("range_us") + 4 * HOUR - 1)))))
    j = i.join(o, ["recording_id", "slice"]).where((F.col("ts_us") >= F.col("range_us") - 4 * HOUR) & (F.col("ts_us") < F.col("range_us") + 4 * HOUR))
    return j.select("recording_id", "seq", "range_us")


@query("j21_next_prev_keyframe", f"""WITH {IMU_SQL}, {KEYFRAMES_SQL}
SELECT i.recording_id, i.seq, (SELECT min(k.ts_us) FROM keyframes k WHERE k.recording_id = i.recording_id AND k.ts_us > i.ts_us) AS next_us,
  (SELECT max(k.ts_us) FROM keyframes k WHERE k.recording_id = i.recording_id AND k.ts_us < i.ts_us) AS prev_us FROM imu i""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    n = asof.neighbours(_left(spark, d), keyframes(spark, d), ["type"])
    here = lambda s, beyond: F.when(F.col(f"{s}.k") == F.col("ts_us"), F.col(f"{s}.{beyond}_k")).otherwise(F.col(f"{s}.k"))
    return n.select("recording_id", "seq", here("next", "a").alias("next_us"), here("prev", "b").alias("prev_us"))
