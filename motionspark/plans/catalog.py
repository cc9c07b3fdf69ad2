"""Further SRC, PRJ, FLT, J, SRT, STR and W queries: files, profiles, gates and derived settings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import text as X
from motionspark.operators import imu as I
from motionspark.operators import profiles, ranks, series, sync
from motionspark.plans.registry import query
from motionspark.plans.telemetry import IMU_SQL, LENS_SQL, OFFSETS_SQL, QUATS_SQL, imu, lens_rows, offsets, quats, table

W = "PARTITION BY recording_id ORDER BY ts_us"


@query("src07_mergeable", "SELECT p_name, count(DISTINCT (p_size % 3, p_size % 2, round(29.97::DOUBLE * 100), 0)) = 1 AS mergeable FROM part GROUP BY 1")
def src07(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_name", (F.col("p_size") % 3).alias("width"), (F.col("p_size") % 2).alias("height"), F.lit(29.97).alias("fps"), F.lit(0).alias("rotation"))
    return profiles.same_shape(p, "p_name")


@query("src23_duplicate_profiles", "SELECT p_type, p_size, list(p_name ORDER BY lower(trim(p_name)), p_name) AS names FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def src23(spark: SparkSession, d: str) -> DataFrame:
    return profiles.duplicates(table(spark, d, "part"), ["p_type", "p_size"], "p_name")


@query("src24_input_kind", f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'lens' WHEN page_id % 4 = 1 AND page_id % 3 > 0 THEN 'preset' ELSE 'video' END AS kind FROM pages""")
def src24(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.col("url"), F.when(k % 4 == 0, ".json").when(k % 4 == 1, X.PROJECT_ENDING).otherwise(".mp4"))
    video = F.when(k % 3 == 0, "a.mp4").when(k % 3 == 1, "")
    return table(spark, d, "pages").select("page_id", X.input_kind(url, video).alias("kind"))


@query("prj10_scaled_time", "SELECT p_partkey, round(25 * coalesce(s, 1), 6) AS fps, round(p_retailprice / coalesce(s, 1), 6) AS duration_ms FROM (SELECT *, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 0.5::DOUBLE END AS s FROM part)")
def prj10(spark: SparkSession, d: str) -> DataFrame:
    scale = F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4 * 0.5)
    fps, duration = I.scaled_time(F.lit(25.0), F.col("p_retailprice"), scale)
    return table(spark, d, "part").select("p_partkey", F.round(fps, 6).alias("fps"), F.round(duration, 6).alias("duration_ms"))


@query("prj17_effective_fov", f"""WITH {LENS_SQL}, n AS (SELECT recording_id, ts_us, CASE WHEN ts_us % 3 > 0 THEN focal_length / 100 END AS fov, last_value(focal_length / 100) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  count(*) OVER (PARTITION BY recording_id) AS n FROM lens) SELECT recording_id, ts_us, round(greatest(coalesce(fov, CASE WHEN n > 1 THEN last END, 1) * 1.2::DOUBLE, 0.001) * 3840 / 1920, 6) AS fov FROM n""")
def prj17(spark: SparkSession, d: str) -> DataFrame:
    whole = Window.partitionBy("recording_id").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = lens_rows(spark, d).select("recording_id", "ts_us", F.when(F.col("ts_us") % 3 > 0, F.col("focal_length") / 100).alias("f"), F.last(F.col("focal_length") / 100).over(whole).alias("last"), F.count(F.lit(1)).over(whole).alias("n"))
    fov = I.effective_fov(F.lit(1.2), F.col("f"), F.col("last"), F.col("n"), F.lit(3840), F.lit(1920))
    return f.select("recording_id", "ts_us", F.round(fov, 6).alias("fov"))


@query("flt07_rank_gate", f"""WITH {IMU_SQL}, {OFFSETS_SQL}, r AS (SELECT recording_id, row_number() OVER ({W}) - 1 AS idx, (seq * 31 % 101)::DOUBLE AS rank FROM imu),
o AS (SELECT recording_id, ts_us, offset_ms, round((((ts_us - 1704067200000000) / 36000000.0::DOUBLE) - offset_ms) / 1000)::BIGINT AS idx FROM offsets)
SELECT recording_id, ts_us, offset_ms FROM o LEFT JOIN r USING (recording_id, idx) WHERE rank IS NULL OR rank >= 13""")
def flt07(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    r = imu(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("seq") * 31 % 101).cast("double").alias("rank"))
    o = offsets(spark, d).withColumn("ts_ms", (F.col("ts_us") - 1704067200000000) / 36000000.0)
    return sync.passes_rank(o, r, 1.0).select("recording_id", "ts_us", "offset_ms")


@query("flt08_flow_direction", f"""WITH l AS (SELECT vec_id, i, embedding[4 * i + 1]::DOUBLE AS x1, embedding[4 * i + 2]::DOUBLE AS y1, embedding[4 * i + 3]::DOUBLE AS x2, embedding[4 * i + 4]::DOUBLE AS y2 FROM embeddings, range(16) r(i)),
a AS (SELECT *, atan2(y2 - y1, x2 - x1) AS a FROM l), m AS (SELECT *, avg(a) OVER (PARTITION BY vec_id) AS m FROM a)
SELECT vec_id, count(*) FILTER (abs(a - m) < {math.radians(30)!r}::DOUBLE) AS kept, round(coalesce(sum(x1) FILTER (abs(a - m) < {math.radians(30)!r}::DOUBLE), 0), 6) + 0 AS sum_x FROM m GROUP BY 1""")
def flt08(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i, k: F.get("embedding", F.lit(4 * i + k)).cast("double")
    lines = F.array(*(F.struct(at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(i, 2).alias("x2"), at(i, 3).alias("y2")) for i in range(16)))
    kept = table(spark, d, "embeddings").select("vec_id", lines.alias("l")).select("vec_id", sync.along_the_flow(F.col("l")).alias("l"))
    return kept.select("vec_id", F.size("l").cast("long").alias("kept"), (F.round(F.aggregate("l", F.lit(0.0), lambda s, p: s + p["x1"]), 6) + 0).alias("sum_x"))


@query("flt14_flt15_sync_gates", """SELECT o_orderkey, o_orderkey % 3 = 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 > 0) AND coalesce(CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END, false) AS itself,
  o_orderkey % 50 >= 10 AND o_orderkey % 4 >= 2 AND o_orderkey % 30 >= 10 AND o_orderkey % 20 >= 10 AS possible FROM orders""")
def flt14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.when(k % 5 == 0, "a.BRAW").otherwise("a.mp4")
    itself = sync.syncs_itself(k % 3, k % 2 == 0, url, F.when(k % 7 > 0, k % 7 > 1))
    return table(spark, d, "orders").select("o_orderkey", itself.alias("itself"), sync.can_sync(k % 50, k % 4, k % 30, k % 20).alias("possible"))


@query("j09_lens_by_focus", """WITH k AS (SELECT p_size AS id, (p_partkey * 10)::BIGINT AS key, p_retailprice AS fx, (p_partkey % 97 * 20 + 640)::DOUBLE AS width FROM part), l AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 + 1 AS id, (l_suppkey * 37 + l_linenumber)::BIGINT AS key FROM lineitem),
a AS (SELECT *, lead(key) OVER w AS nk, lead(fx) OVER w AS nfx, lead(width) OVER w AS nw, lag(key) OVER w AS bk, lag(fx) OVER w AS bfx, lag(width) OVER w AS bw FROM k WINDOW w AS (PARTITION BY id ORDER BY key)),
f AS (SELECT id, min(key) AS first FROM k GROUP BY 1),
p AS (SELECT l.*, a.key AS k0, a.fx AS v0, a.width AS w0, a.nk AS k1, a.nfx AS v1, a.nw AS w1, a.bk, a.bfx, a.bw FROM l JOIN f ON f.id = l.id ASOF JOIN a ON a.id = l.id AND a.key <= greatest(l.key, f.first)),
s AS (SELECT l_orderkey, l_linenumber, key, CASE WHEN k1 IS NULL AND bk IS NOT NULL AND key <> k0 THEN bk ELSE k0 END AS k0, CASE WHEN k1 IS NULL AND bk IS NOT NULL AND key <> k0 THEN bfx ELSE v0 END AS v0, CASE WHEN k1 IS NULL AND bk IS NOT NULL AND key <> k0 THEN bw ELSE w0 END AS w0,
  CASE WHEN k1 IS NULL THEN k0 ELSE k1 END AS k1, CASE WHEN k1 IS NULL THEN v0 ELSE v1 END AS v1, CASE WHEN k1 IS NULL THEN w0 ELSE w1 END AS w1 FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN k0 = k1 THEN v0 ELSE v0 * (1 - (key - k0)::DOUBLE / (k1 - k0)) + v1 * ((key - k0)::DOUBLE / (k1 - k0)) END, 4) + 0 AS fx,
  round(CASE WHEN k0 = k1 THEN w0 ELSE w0 * (1 - (key - k0)::DOUBLE / (k1 - k0)) + w1 * ((key - k0)::DOUBLE / (k1 - k0)) END, 0) + 0 AS width FROM s""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """Focal positions of line items between those of a lens' parts."""
    knots = table(spark, d, "part").select(F.col("p_size").cast("long").alias("id"), (F.col("p_partkey") * 10 / 1_000_000).alias("focal"), F.col("p_retailprice").alias("fx"), (F.col("p_partkey") % 97 * 20 + 640).alias("width"))
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50 + 1).alias("id"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber")) / 1_000_000).alias("focal"))
    known = left.join(F.broadcast(knots.select("id").distinct()), "id", "left_semi")  # 50 lenses
    got = profiles.interpolated(known, knots, ["fx", "width"])
    return got.select("l_orderkey", "l_linenumber", (F.round("fx", 4) + 0).alias("fx"), (F.col("width") + 0).alias("width"))


@query("srt02_name_order", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def srt02(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return ranks.ranked(names, "name", "place", "p_partkey").select("p_partkey", "place")


SHAPES_SQL = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS name, {a} / {b}.0::DOUBLE AS r" for i, (n, a, b) in enumerate((("1:1", 1, 1), ("3:2", 3, 2), ("2:3", 2, 3), ("4:3", 4, 3), ("3:4", 3, 4), ("8:7", 8, 7), ("7:8", 7, 8), ("16:9", 16, 9), ("9:16", 9, 16))))
ASPECT_SQL = f"""s AS ({SHAPES_SQL}), d AS (SELECT p_partkey, p_brand, p_type, p_name, (p_partkey % 41 * 8)::BIGINT AS w, (p_size * 4)::BIGINT AS h FROM part),
n AS (SELECT p_partkey, arg_min(name, (abs(r - w / h::DOUBLE), i)) AS name, min(abs(r - w / h::DOUBLE)) AS far FROM d, s GROUP BY 1),
r AS (SELECT d.*, CASE WHEN w = 0 THEN '' WHEN far < 0.05 THEN name WHEN w // gcd(w, h) >= 20 OR h // gcd(w, h) >= 20 THEN printf('%.2f', w / h::DOUBLE) || ':1' ELSE (w // gcd(w, h)) || ':' || (h // gcd(w, h)) END AS aspect FROM d JOIN n USING (p_partkey))"""


@query("srt04_aspect", f"WITH {ASPECT_SQL} SELECT p_partkey, aspect FROM r")
def srt04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.aspect_ratio((F.col("p_partkey") % 41 * 8).cast("long"), (F.col("p_size") * 4).cast("long")).alias("aspect"))


@query("str06_profile_name", f"""WITH {ASPECT_SQL} SELECT p_partkey, p_brand || '_' || p_type || '__' || CASE WHEN p_partkey % 2 = 0 THEN 'wide' ELSE p_name END || '__' || replace(aspect, ':', 'by') || '_' || w || 'x' || h || '-29.97fps' AS name FROM r""")
def str06(spark: SparkSession, d: str) -> DataFrame:
    w, h = (F.col("p_partkey") % 41 * 8).cast("long"), (F.col("p_size") * 4).cast("long")
    setting = F.when(F.col("p_partkey") % 2 == 0, "wide").otherwise("")
    return table(spark, d, "part").select("p_partkey", X.profile_name(F.col("p_brand"), F.col("p_type"), F.lit(None), setting, F.col("p_name"), w, h, F.lit(29.97)).alias("name"))


@query("w33_turn_speed", f"""WITH {QUATS_SQL}, p AS (SELECT *, lag(w, 1, w) OVER v AS sw, lag(x, 1, x) OVER v AS sx, lag(y, 1, y) OVER v AS sy, lag(z, 1, z) OVER v AS sz FROM quats WINDOW v AS ({W})),
c AS (SELECT recording_id, ts_us, w * sw + x * sx + y * sy + z * sz AS cw, -w * sx + x * sw - y * sz + z * sy AS cx, -w * sy + x * sz + y * sw - z * sx AS cy, -w * sz - x * sy + y * sx + z * sw AS cz FROM p),
a AS (SELECT recording_id, ts_us, degrees(atan2(2 * (cw * cz + cx * cy), 1 - 2 * (cy * cy + cz * cz))) AS a FROM c), d AS (SELECT *, a - lag(a, 6) OVER ({W}) AS d FROM a)
SELECT recording_id, ts_us, round(CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END / (6 / 50.0::DOUBLE), 4) + 0 AS turn_speed FROM d""")
def w33(spark: SparkSession, d: str) -> DataFrame:
    before = F.coalesce(F.lag("q").over(Window.partitionBy("recording_id").orderBy("ts_us")), F.col("q"))
    q = quats(spark, d).select("recording_id", "ts_us", F.col("q").alias("original"), before.alias("q"))
    return series.turn_speed(q, 6, 50.0).select("recording_id", "ts_us", (F.round("turn_speed", 4) + 0).alias("turn_speed"))
