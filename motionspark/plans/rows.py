"""PRJ, FLT, AGG, SRT, SET and STR queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import quat as Q
from motionspark.functions import text as X
from motionspark.operators import imu as I
from motionspark.operators import sync
from motionspark.plans.registry import query
from motionspark.plans.telemetry import DAY, HOUR, IMU_SQL, KEYFRAMES_SQL, LENS_SQL, OFFSETS_SQL, QUATS_SQL, imu, keyframes, lens_rows, offsets, quats, table

W = "PARTITION BY recording_id ORDER BY ts_us"
START = 1_704_067_200_000_000  # the first event's midnight


def r6(c: str):
    return (F.round(c, 6) + 0).alias(c)


@query("prj01_carry_forward", f"WITH {IMU_SQL} SELECT recording_id, seq, {', '.join(f'last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {c}' for c in ('gx', 'gy', 'gz'))} FROM imu")
def prj01(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.asof import carry

    return carry(imu(spark, d), ["gx", "gy", "gz"]).select("recording_id", "seq", "gx", "gy", "gz")


MATRIX = ((0.0, -1.0, 0.0), (0.6, 0.0, 0.8), (-0.8, 0.0, 0.6))


@query("prj06_transform_imu", f"""WITH {IMU_SQL}, b AS (SELECT recording_id, seq, gx + 0.25::DOUBLE AS gx, gy - 0.5::DOUBLE AS gy, gz + 1.0::DOUBLE AS gz FROM imu),
o AS (SELECT recording_id, seq, -gy AS a, gx AS b, gz AS c FROM b) SELECT recording_id, seq, round(a * 0.0::DOUBLE + b * -1.0::DOUBLE + c * 0.0::DOUBLE, 6) + 0 AS gx, round(a * 0.6::DOUBLE + b * 0.0::DOUBLE + c * 0.8::DOUBLE, 6) + 0 AS gy, round(a * -0.8::DOUBLE + b * 0.0::DOUBLE + c * 0.6::DOUBLE, 6) + 0 AS gz FROM o""")
def prj06(spark: SparkSession, d: str) -> DataFrame:
    t = I.transform_imu(imu(spark, d), bias=(0.25, -0.5, 1.0), code="yXZ", matrix=MATRIX)
    return t.select("recording_id", "seq", r6("gx"), r6("gy"), r6("gz"))


@query("prj08_frame_time", f"WITH {IMU_SQL} SELECT recording_id, seq, round((ts_us - {START}) / 1000.0::DOUBLE * 29.97::DOUBLE / 1000.0::DOUBLE)::BIGINT AS frame, round(seq * 1000.0::DOUBLE / 29.97::DOUBLE, 6) AS ms FROM imu")
def prj08(spark: SparkSession, d: str) -> DataFrame:
    fps = F.lit(29.97)
    return imu(spark, d).select("recording_id", "seq", I.ms_to_frame((F.col("ts_us") - START) / 1000.0, fps).alias("frame"), F.round(I.frame_to_ms(F.col("seq"), fps), 6).alias("ms"))


@query("prj09_readout_direction", """SELECT event_id, CASE WHEN abs(r) > 10000 AND r < 0 THEN 'RightToLeft' WHEN abs(r) > 10000 THEN 'LeftToRight' WHEN r < 0 THEN 'BottomToTop' ELSE 'TopToBottom' END AS direction,
  CASE WHEN r = 0 THEN NULL WHEN abs(r) > 10000 THEN abs(r) - 10000 ELSE abs(r) END AS readout_ms FROM (SELECT event_id, (event_id % 31 - 15 + (event_id % 3 - 1) * 10015)::DOUBLE AS r FROM events)""")
def prj09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 31 - 15 + (F.col("event_id") % 3 - 1) * 10015).cast("double").alias("r"))
    way, size = I.readout(F.col("r"))
    return e.select("event_id", way.alias("direction"), size.alias("readout_ms"))


@query("prj11_output_size", """SELECT p_partkey, (round(w * s)::INT - round(w * s)::INT % 2)::INT AS w, (round(h * s)::INT - round(h * s)::INT % 2)::INT AS h
FROM (SELECT *, least(CASE WHEN turned THEN 1080 ELSE 1920 END / w, CASE WHEN turned THEN 1920 ELSE 1080 END / h) AS s FROM
  (SELECT p_partkey, (640 + p_size * 71)::DOUBLE AS w, (480 + p_size * 37)::DOUBLE AS h, p_partkey % 4 IN (1, 3) AS turned FROM part))""")
def prj11(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    fit = I.output_size(F.lit(1920.0), F.lit(1080.0), (640 + F.col("p_size") * 71).cast("double"), (480 + F.col("p_size") * 37).cast("double"), F.col("p_partkey") % 4 * 90)
    return p.select("p_partkey", fit.alias("s")).select("p_partkey", "s.w", "s.h")


@query("prj13_correction", f"""WITH {QUATS_SQL}, s AS (SELECT *, lag(w, 1, w) OVER v AS sw, lag(x, 1, x) OVER v AS sx, lag(y, 1, y) OVER v AS sy, lag(z, 1, z) OVER v AS sz FROM quats WINDOW v AS ({W}))
SELECT recording_id, ts_us, round(sw * w + sx * x + sy * y + sz * z, 6) + 0 AS w, round(sw * x - sx * w - sy * z + sz * y, 6) + 0 AS x, round(sw * y + sx * z - sy * w - sz * x, 6) + 0 AS y, round(sw * z - sx * y + sy * x - sz * w, 6) + 0 AS z FROM s""")
def prj13(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce(F.lag("q").over(Window.partitionBy("recording_id").orderBy("ts_us")), F.col("q"))
    c = quats(spark, d).withColumn("c", Q.multiply(Q.conjugate(s), F.col("q")))
    return c.select("recording_id", "ts_us", *((F.round(F.col(f"c.{k}"), 6) + 0).alias(k) for k in "wxyz"))


@query("prj15_diagonal_fov", "SELECT p_partkey, round(degrees(2 * atan(sqrt(3840.0::DOUBLE * 3840 + 2160.0::DOUBLE * 2160) / (2 * (p_retailprice + 500)))), 6) AS fov FROM part")
def prj15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(I.diagonal_fov(F.lit(3840.0), F.lit(2160.0), F.col("p_retailprice") + 500), 6).alias("fov"))


@query("prj22_expand_profiles", "SELECT p_partkey, k AS setting, round(p_retailprice * (1 + k * 0.5::DOUBLE), 4) AS fx, p_size * (k + 1) AS width FROM part, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR k <= p_partkey % 3")
def prj22(spark: SparkSession, d: str) -> DataFrame:
    """The profile itself and a scaled row for each of its compatible settings."""
    p = table(spark, d, "part").withColumn("setting", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))))
    return p.select("p_partkey", "setting", F.round(F.col("p_retailprice") * (1 + F.col("setting") * 0.5), 4).alias("fx"), (F.col("p_size") * (F.col("setting") + 1)).alias("width"))


@query("prj24_map_range", "SELECT event_id, round((value - 0.0::DOUBLE) / 100.0::DOUBLE * 20.0::DOUBLE + -10.0::DOUBLE, 6) + 0 AS mapped FROM events")
def prj24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.round(I.map_range(F.col("value"), 0.0, 100.0, -10.0, 10.0), 6) + 0).alias("mapped"))


TRIMS = [(0.1, 0.3), (0.5, 0.9)]


@query("flt01_trim_ranges", f"""WITH {IMU_SQL}, f AS (SELECT recording_id, seq, (ts_us - min(ts_us) OVER p) / (max(ts_us) OVER p - min(ts_us) OVER p)::DOUBLE AS pos FROM imu WINDOW p AS (PARTITION BY recording_id))
SELECT recording_id, seq FROM f WHERE pos BETWEEN 0.1 AND 0.3 OR pos BETWEEN 0.5 AND 0.9""")
def flt01(spark: SparkSession, d: str) -> DataFrame:
    p = Window.partitionBy("recording_id")
    at = (F.col("ts_us") - F.min("ts_us").over(p)) / (F.max("ts_us").over(p) - F.min("ts_us").over(p))
    return imu(spark, d).withColumn("at", at).where(sync.in_ranges(F.col("at"), TRIMS)).select("recording_id", "seq")


@query("flt02_outside_takes_max_fov", f"""WITH {LENS_SQL}, n AS (SELECT recording_id, ts_us, focal_length AS fov, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY recording_id) - 1 AS l, max(focal_length) OVER (PARTITION BY recording_id) AS m FROM lens)
SELECT recording_id, ts_us, CASE WHEN i BETWEEN floor(l * 0.1::DOUBLE) AND ceil(l * 0.3::DOUBLE) OR i BETWEEN floor(l * 0.5::DOUBLE) AND ceil(l * 0.9::DOUBLE) THEN fov ELSE m END AS fov FROM n""")
def flt02(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.zoom import outside_takes_max

    w = Window.partitionBy("recording_id").orderBy("ts_us")
    f = lens_rows(spark, d).select("recording_id", "ts_us", (F.row_number().over(w) - 1).alias("frame"), F.col("focal_length").alias("fov"))
    return outside_takes_max(f, TRIMS).select("recording_id", "ts_us", "fov")


@query("flt04_remove_offsets", f"""WITH {OFFSETS_SQL}, {LENS_SQL} SELECT * FROM offsets o WHERE NOT EXISTS (SELECT 1 FROM lens l WHERE l.recording_id = o.recording_id AND o.ts_us >= l.ts_us - {3 * HOUR} AND o.ts_us < l.ts_us + {3 * HOUR})""")
def flt04(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.asof import neighbours

    n = neighbours(offsets(spark, d), lens_rows(spark, d), ["focal_length"])
    after = F.coalesce(F.col("ts_us") < F.col("prev.k") + 3 * HOUR, F.lit(False))
    before = F.coalesce(F.col("ts_us") >= F.col("next.k") - 3 * HOUR, F.lit(False))
    return n.where(~after & ~before).drop("prev", "next")


@query("flt05_movement_gate", f"WITH {IMU_SQL} SELECT recording_id, max(abs(gz)) AS top FROM imu GROUP BY 1 HAVING max(abs(gz)) >= 14")
def flt05(spark: SparkSession, d: str) -> DataFrame:
    return imu(spark, d).groupBy("recording_id").agg(F.max(F.abs("gz")).alias("top")).where("top >= 14")


@query("flt10_word_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')) ")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.where(X.matches_words(X.search_words(F.lit("Red;  bolt")), F.col("p_name"), F.col("p_brand"))).select("p_partkey")


@query("flt12_flt13_in_range_every_nth", f"WITH {IMU_SQL} SELECT recording_id, seq FROM imu WHERE seq % 3 = 0 AND ts_us BETWEEN {START + 3 * DAY} AND {START + 9 * DAY}")
def flt12(spark: SparkSession, d: str) -> DataFrame:
    return imu(spark, d).where((F.col("seq") % 3 == 0) & sync.in_ranges(F.col("ts_us"), [(START + 3 * DAY, START + 9 * DAY)])).select("recording_id", "seq")


@query("agg01_sample_rate", f"WITH {IMU_SQL} SELECT recording_id, count(*) AS n, round(CASE WHEN count(*) > 2 THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6 * (count(*) + 1) / count(*)) END, 9) AS rate FROM imu GROUP BY 1")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return I.sample_rate(imu(spark, d)).select("recording_id", "n", F.round("rate", 9).alias("rate"))


@query("agg02_duration_repair", f"WITH {IMU_SQL} SELECT recording_id, round((max(ts_us) - min(ts_us)) / 1e3 * (count(*) + 1) / count(*), 3) AS duration_ms FROM imu GROUP BY 1")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    r = I.repaired_duration(imu(spark, d).withColumn("known", F.lit(1000.0)), "known")
    return r.select("recording_id", F.round("duration_ms", 3).alias("duration_ms"))


@query("agg03_gyro_bias", f"""WITH {IMU_SQL}, m AS (SELECT recording_id, {', '.join(f'-avg({c}) AS bias_{c}' for c in ('gx', 'gy', 'gz'))} FROM imu WHERE ts_us > {START + 5 * DAY} AND ts_us < {START + 6 * DAY} GROUP BY 1)
SELECT r.recording_id, {', '.join(f'round(coalesce(bias_{c}, 0), 6) + 0 AS bias_{c}' for c in ('gx', 'gy', 'gz'))} FROM (SELECT DISTINCT recording_id FROM imu) r LEFT JOIN m ON m.recording_id = r.recording_id""")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    return I.find_bias(imu(spark, d), START + 5 * DAY, START + 6 * DAY).select("recording_id", r6("bias_gx"), r6("bias_gy"), r6("bias_gz"))


@query("agg04_max_angles", f"""WITH {QUATS_SQL} SELECT recording_id, round(max(abs(degrees(asin(greatest(-1, least(1, 2 * (w * y - z * x))))))), 6) AS pitch,
  round(max(abs(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))))), 6) AS yaw, round(max(abs(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))))), 6) AS roll FROM quats GROUP BY 1""")
def agg04(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.smooth import max_angles

    q = quats(spark, d)
    a = max_angles(q.withColumn("q", Q.identity()), q)
    return a.select("recording_id", *(F.round(c, 6).alias(c) for c in ("pitch", "yaw", "roll")))


@query("agg06_argmin", f"WITH {IMU_SQL} SELECT recording_id, arg_min(seq, (cost, -seq)) AS seq, min(cost) AS cost FROM (SELECT recording_id, seq, abs(az - ax * ay) AS cost FROM imu) GROUP BY 1")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    """Of equal costs the last one."""
    c = imu(spark, d).select("recording_id", F.struct(F.abs(F.col("az") - F.col("ax") * F.col("ay")).alias("cost"), (-F.col("seq")).alias("back")).alias("c"))
    return c.groupBy("recording_id").agg(F.min("c").alias("c")).select("recording_id", (-F.col("c.back")).alias("seq"), "c.cost")


@query("agg07_line_fit", f"""WITH {OFFSETS_SQL}, c AS (SELECT recording_id, ts_us::DOUBLE AS x, offset_ms AS y, ts_us::DOUBLE - avg(ts_us::DOUBLE) OVER p AS dx, offset_ms - avg(offset_ms) OVER p AS dy FROM offsets WINDOW p AS (PARTITION BY recording_id)),
s AS (SELECT recording_id, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM c GROUP BY 1) SELECT recording_id, round(sxy / sxx * 1e9, 6) + 0 AS slope_e9, round(greatest(syy - sxy / sxx * sxy, 0), 4) AS ssr FROM s WHERE sxx > 0""")
def agg07(spark: SparkSession, d: str) -> DataFrame:
    f = sync.line_fit(offsets(spark, d))
    return f.select("recording_id", (F.round(F.col("slope") * 1e9, 6) + 0).alias("slope_e9"), F.round("ssr", 4).alias("ssr"))


@query("agg08_robust_line", f"""WITH {OFFSETS_SQL}, p AS (SELECT recording_id, ts_us / 1000.0::DOUBLE AS x, offset_ms AS y FROM offsets),
l AS (SELECT a.recording_id, a.x AS x1, b.x AS x2, (b.y - a.y) / (b.x - a.x) AS k, a.y AS y1 FROM p a JOIN p b ON a.recording_id = b.recording_id AND a.x < b.x),
f AS (SELECT l.recording_id, x1, x2, k, abs(k * p.x + (y1 - k * x1) - p.y) AS r FROM l JOIN p ON p.recording_id = l.recording_id WHERE abs(k) < 0.1),
g AS (SELECT recording_id, x1, x2, k, count(*) FILTER (r < 2) AS inliers, round(coalesce(sum(r * r) FILTER (r < 2), 0), 9) AS ssr FROM f GROUP BY ALL)
SELECT recording_id, inliers, round(ssr, 4) AS ssr FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY inliers DESC, ssr, x1, x2) AS n FROM g) WHERE n = 1""")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    return sync.robust_line(offsets(spark, d), tolerance_ms=2.0).select("recording_id", "inliers", F.round("ssr", 4).alias("ssr"))


@query("agg09_agg10_percentile_median", f"WITH {IMU_SQL} SELECT recording_id, round(quantile_cont(gx, 0.99), 6) AS p99, round(median(gx), 6) AS median FROM imu GROUP BY 1")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    return imu(spark, d).groupBy("recording_id").agg(F.round(F.percentile("gx", 0.99), 6).alias("p99"), F.round(F.median("gx"), 6).alias("median"))


@query("agg11_trimmed_sum", f"""WITH {IMU_SQL}, s AS (SELECT recording_id, trunc(gx)::BIGINT AS v, row_number() OVER (PARTITION BY recording_id ORDER BY trunc(gx)) AS n, count(*) OVER (PARTITION BY recording_id) AS c FROM imu WHERE gx IS NOT NULL)
SELECT recording_id, sum(v)::BIGINT AS total FROM s WHERE n <= floor(c * 0.9::DOUBLE) GROUP BY 1""")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    """Whole parts of the lowest 90 % added up, by rank within the recording."""
    v = imu(spark, d).where("gx is not null").select("recording_id", F.col("gx").cast("long").alias("v"))
    n = v.withColumn("n", F.row_number().over(Window.partitionBy("recording_id").orderBy("v"))).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("recording_id")))
    return n.where(F.col("n") <= F.floor(F.col("c") * 0.9)).groupBy("recording_id").agg(F.sum("v").alias("total"))


@query("agg12_agg13_min_fov_bbox", f"WITH {IMU_SQL} SELECT recording_id, min(gx) AS min_fov, least(0, min(gy)) AS lo, greatest(0, max(gy)) AS hi FROM imu GROUP BY 1")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    return imu(spark, d).groupBy("recording_id").agg(F.min("gx").alias("min_fov"), F.least(F.lit(0.0), F.min("gy")).alias("lo"), F.greatest(F.lit(0.0), F.max("gy")).alias("hi"))


@query("agg15_agg16_distinct_duplicates", "SELECT p_name, count(DISTINCT p_size) AS sizes, count(*) AS n, CASE WHEN count(DISTINCT p_size) = 1 THEN p_name || ' ' || any_value(p_size) ELSE p_name END AS shown FROM part GROUP BY p_name HAVING count(*) > 1")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_size").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("p_size").alias("s")).where("n > 1")
    return g.select("p_name", "sizes", "n", F.when(F.col("sizes") == 1, F.concat_ws(" ", "p_name", "s")).otherwise(F.col("p_name")).alias("shown"))


@query("agg18_trim_ratio", f"""WITH {LENS_SQL} SELECT recording_id, round(sum(b - a), 6) AS ratio FROM
  (SELECT recording_id, focal_length / 1000 AS a, focal_length / 1000 + (ts_us % 7)::DOUBLE / 100 AS b FROM lens) GROUP BY 1""")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    """Share of each recording that its trim ranges keep."""
    a = F.col("focal_length") / 1000
    trims = lens_rows(spark, d).select("recording_id", a.alias("a"), (a + (F.col("ts_us") % 7).cast("double") / 100).alias("b"))
    return sync.trim_ratio(trims).select("recording_id", F.round("ratio", 6).alias("ratio"))


@query("agg19_queue_totals", "SELECT o_orderstatus AS status, count(*) AS jobs, sum(floor(o_totalprice))::BIGINT AS frames FROM orders GROUP BY 1")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.floor("o_totalprice")).alias("frames"))


@query("agg22_choose_sign", """WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1,
  coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) AS c0, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS c1 FROM orders GROUP BY 1)
SELECT o_custkey, true AS negative, n1 AS n, round(c1, 2) AS cost FROM s WHERE n1 > n0 OR (n1 = n0 AND NOT c0 < c1)
UNION ALL SELECT o_custkey, false, n0, round(c0, 2) FROM s WHERE n1 = n0 AND c0 < c1""")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("negative"), F.col("o_totalprice").alias("cost"))
    return sync.choose_sign(o, ["o_custkey"]).select("o_custkey", "negative", "n", F.round("cost", 2).alias("cost"))


@query("srt01_lens_search", """SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, p_brand = 'Brand#2' AS fav, p_size % 8 = 3 AS asp, p_size % 8 = 5 AS swp FROM part WHERE contains(lower(p_name), 'ring'))
ORDER BY fav DESC, asp DESC, swp DESC, p_name, p_partkey LIMIT 200""")
def srt01(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.profiles import search_profiles

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("author"), (F.col("p_brand") == "Brand#2").alias("favourite"), (F.col("p_size") % 8).alias("aspect"))
    return search_profiles(p, "RING,", aspect=3, swapped=5).select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name"))


@query("srt03_unique_names", """WITH n AS (SELECT p_partkey, p_name AS name, p_brand AS author, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_name) AS c FROM part),
f AS (SELECT *, min(k) OVER (PARTITION BY name, author) % 2 + count(*) FILTER (k % 2 = 0) OVER (PARTITION BY name, author ORDER BY k) AS place FROM n)
SELECT p_partkey, CASE WHEN k % 2 = 1 AND k = c THEN name WHEN k % 2 = 0 AND place > 1 THEN name || ' by ' || author || ' - ' || place ELSE name || ' by ' || author END AS shown FROM f""")
def srt03(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.profiles import unique_names

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("author"))
    return unique_names(p).select(F.col("id").alias("p_partkey"), "shown")


@query("srt06_natural_order", "SELECT c_custkey, row_number() OVER (ORDER BY regexp_extract(c_name, '#0*([0-9]+)', 1)::BIGINT) AS place FROM customer")
def srt06(spark: SparkSession, d: str) -> DataFrame:
    """Names by the value of their digits, all of them in one list."""
    from motionspark.operators.ranks import ranked

    names = table(spark, d, "customer").select("c_custkey", X.natural_key(F.col("c_name")).alias("name"))
    return ranked(names, "name", "place", "c_custkey").select("c_custkey", "place")


@query("set01_upsert", f"""WITH {IMU_SQL}, k AS (SELECT recording_id, ts_us // {6 * HOUR} AS k, seq, gx FROM imu) SELECT recording_id, k, arg_max(seq, seq) AS seq FROM k GROUP BY ALL""")
def set01(spark: SparkSession, d: str) -> DataFrame:
    k = imu(spark, d).select("recording_id", F.floor(F.col("ts_us") / (6 * HOUR)).alias("k"), "seq")
    return I.last_writer(k, on="k")


@query("set02_first_source_wins", "SELECT p_name, min((src, p_partkey)).src AS src, min((src, p_partkey)).p_partkey AS p_partkey FROM (SELECT p_name, p_partkey, p_size % 2 AS src FROM part) GROUP BY 1".replace("min((src, p_partkey)).src", "min(src)").replace("min((src, p_partkey)).p_partkey", "arg_min(p_partkey, (src, p_partkey))"))
def set02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_name", (F.col("p_size") % 2).alias("src"), "p_partkey")
    return p.groupBy("p_name").agg(F.min(F.struct("src", "p_partkey")).alias("b")).select("p_name", "b.src", "b.p_partkey")


@query("set04_axis_codes", """WITH l AS (SELECT unnest(['X', 'Y', 'Z', 'x', 'y', 'z']) AS c)
SELECT recording_id, a.c || b.c || d.c AS code FROM (SELECT DISTINCT user_id AS recording_id FROM events), l a, l b, l d WHERE lower(a.c) <> lower(b.c) AND lower(b.c) <> lower(d.c) AND lower(a.c) <> lower(d.c)""")
def set04(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each recording."""
    from motionspark.operators.profiles import AXIS_CODES

    codes = F.explode(F.array(*(F.lit(c) for c in AXIS_CODES))).alias("code")
    return table(spark, d, "events").select(F.col("user_id").alias("recording_id")).distinct().select("recording_id", codes)


@query("str01_search_aliases", """SELECT p_partkey, list_filter(string_split(replace(replace(lower(p_name || ';' || 'A7S3,GoPro 10'), 'gopro 10', 'hero10 black'), 'a7s3', 'a7siii').replace(',', ' ').replace(';', ' '), ' '), lambda w: w <> '') AS words FROM part""")
def str01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.search_words(F.concat_ws(";", "p_name", F.lit("A7S3,GoPro 10"))).alias("words"))


@query("str02_camera_identifier", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(trim(replace(replace(replace(
  CASE WHEN p_partkey % 7 = 0 THEN 'RED' ELSE p_brand END || '-' || p_name || '-' || '- ' || '-' || p_type || '-' || (p_size * 100) || 'x' || (p_size * 50) || '@' || CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 29970 END || '-'
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'HDR' END, ' ', ''), '--', '-'), '--', '-'), '- ')) END AS identifier FROM part""")
def str02(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 7 == 0, "RED").otherwise(F.col("p_brand"))
    info = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type"))
    more = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise("HDR")
    i = X.camera_identifier(brand, F.col("p_name"), F.lit("- "), info, F.col("p_size") * 100, F.col("p_size") * 50, F.lit(29.97), more)
    return table(spark, d, "part").select("p_partkey", i.alias("identifier"))


@query("str03_autoload_identifier", """SELECT p_partkey, replace(replace(replace('hero' || (10 + p_partkey % 5) || 'blackmini-' || p_brand, 'hero12', 'hero11'), 'hero13', 'hero11'), 'hero11blackmini', 'hero11black') AS identifier FROM part""")
def str03(spark: SparkSession, d: str) -> DataFrame:
    i = F.concat(F.lit("hero"), (10 + F.col("p_partkey") % 5).cast("string"), F.lit("blackmini-"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.autoload_identifier(i).alias("identifier"))


@query("str05_size_label", """SELECT p_partkey, CASE WHEN w >= 8000 THEN '8k' WHEN w >= 6000 THEN '6k' WHEN w >= 5000 THEN '5k' WHEN w > 4000 THEN 'C4k' WHEN w >= 3840 THEN '4k' WHEN w >= 2700 THEN '2.7k' WHEN w >= 2500 THEN '2.5k' WHEN w >= 2000 THEN '2k'
  WHEN w = 1920 AND h = 1440 THEN '1440p' WHEN w >= 1920 THEN '1080p' WHEN w >= 1280 THEN '720p' WHEN w >= 640 THEN '480p' ELSE '' END AS label
FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 1920 WHEN p_partkey % 9 = 1 THEN 4000 ELSE p_partkey * 37 % 8600 END AS w, CASE WHEN p_partkey % 2 = 0 THEN 1440 ELSE 1080 END AS h FROM part)""")
def str05(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    w = F.when(k % 9 == 0, 1920).when(k % 9 == 1, 4000).otherwise(k * 37 % 8600)
    return table(spark, d, "part").select("p_partkey", X.size_label(w, F.when(k % 2 == 0, 1440).otherwise(1080)).alias("label"))


FORMATS_SQL = " ".join(f"WHEN '{name}' THEN printf('%.{n}f', v * {factor}) || '{unit}'" for name, n, unit, factor in (
    ("Fov", 2, "", 1), ("VideoRotation", 1, "°", 1), ("ZoomingSpeed", 2, "s", 1), ("ZoomingCenterX", 0, "%", 100), ("MaxZoom", 0, "%", 1), ("AdditionalRotationY", 2, "°", 1),
    ("AdditionalTranslationZ", 0, "px", 1), ("BackgroundFeather", 0, "%", 1), ("LockHorizonAmount", 0, "%", 1), ("LockHorizonRoll", 1, "°", 1), ("LensCorrectionStrength", 0, "%", 100),
    ("LightRefractionCoeff", 3, "", 1), ("SmoothingParamPitch", 2, "", 1), ("VideoSpeed", 1, "%", 100)))
KINDS = ("Fov", "VideoRotation", "ZoomingSpeed", "ZoomingCenterX", "MaxZoom", "AdditionalRotationY", "AdditionalTranslationZ", "BackgroundFeather", "LockHorizonAmount", "LockHorizonRoll", "LockHorizonPitchEnabled",
         "LensCorrectionStrength", "LightRefractionCoeff", "SmoothingParamPitch", "VideoSpeed")


@query("str08_keyframe_text", f"""SELECT p_partkey, kind, CASE kind WHEN 'LockHorizonPitchEnabled' THEN CASE WHEN v <> 0 THEN 'On' ELSE 'Off' END {FORMATS_SQL} END AS shown
FROM (SELECT p_partkey, ([{', '.join(repr(k) for k in KINDS)}])[p_partkey % {len(KINDS)} + 1] AS kind, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 97 * 0.37::DOUBLE + 0.0123::DOUBLE END AS v FROM part)""")
def str08(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, KINDS)), (k % len(KINDS)).cast("int")).alias("kind"), F.when(k % 4 == 0, 0.0).otherwise(k % 97 * 0.37 + 0.0123).alias("v"))
    return p.select("p_partkey", "kind", X.keyframe_text(F.col("kind"), F.col("v")).alias("shown"))


@query("str07_durations", "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN event_id % 900 WHEN 1 THEN event_id % 90 * 1000 ELSE event_id % 300 * 1000 / 25.0 END::DOUBLE, 6) AS ms FROM events")
def str07(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("event_id"), F.col("event_id") % 3
    t = F.when(k == 0, F.concat((n % 900).cast("string"), F.lit("ms"))).when(k == 1, F.concat((n % 90).cast("string"), F.lit("s"))).otherwise((n % 300).cast("string"))
    return table(spark, d, "events").select("event_id", F.round(X.duration_ms(t, F.lit(25.0)), 6).alias("ms"))


@query("str09_safe_names", """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(url, '/', '-'), chr(92), '-'), ':', '-'), '+', '-'), chr(39), '-'), chr(34), '-'), ' ', '-') AS safe, regexp_extract(url, '([^/\\\\]*)$', 1) AS file,
  regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[.][^.]*$', '') || '_stabilized' || CASE page_id % 4 WHEN 0 THEN '.mov' WHEN 1 THEN '_%05d.png' WHEN 2 THEN CASE WHEN page_id % 8 = 2 THEN '.mov' ELSE '.mp4' END ELSE '_%05d.exr' END AS output FROM pages""")
def str09(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    codec = F.get(F.array(*map(F.lit, ("ProRes", "PNG Sequence", "H.264/AVC", "EXR Sequence"))), (k % 4).cast("int"))
    out = X.output_name(F.col("url"), F.lit("_stabilized"), codec, k % 8 == 2)
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("safe"), X.file_name(F.col("url")).alias("file"), out.alias("output"))


@query("syn02_sync_ranges", f"""WITH {OFFSETS_SQL} SELECT recording_id, ts_us, greatest(ts_us - {START} - {HOUR}, 0) AS from_us, least(ts_us - {START} + {HOUR}, {20 * DAY}) AS to_us FROM offsets""")
def syn02(spark: SparkSession, d: str) -> DataFrame:
    p = offsets(spark, d).select("recording_id", (F.col("ts_us") - START).alias("ts_us"), F.lit(20 * DAY).alias("duration_us"))
    return sync.sync_ranges(p, 2 * HOUR).select("recording_id", (F.col("ts_us") + START).alias("ts_us"), "from_us", "to_us")


@query("syn10_even_points", f"WITH {IMU_SQL} SELECT recording_id, round((max(ts_us) - min(ts_us)) * (k + 0.5::DOUBLE) / 5)::BIGINT AS ts_us FROM imu, range(5) r(k) GROUP BY recording_id, k")
def syn10(spark: SparkSession, d: str) -> DataFrame:
    r = imu(spark, d).groupBy("recording_id").agg((F.max("ts_us") - F.min("ts_us")).alias("duration_us"))
    return sync.even_points(r, 5)


@query("cht01_chart_series", f"""WITH {IMU_SQL}, {KEYFRAMES_SQL}, g AS (SELECT recording_id, max(greatest(abs(gx), abs(gy), abs(gz))) AS g, max(greatest(abs(ax), abs(ay), abs(az))) AS a FROM imu GROUP BY 1),
u AS ({' UNION ALL '.join(f"SELECT recording_id, ts_us, '{c}' AS series, round({c} / g.{c[0]}, 6) + 0 AS value FROM imu JOIN g USING (recording_id) WHERE {c} IS NOT NULL" for c in ('gx', 'gy', 'gz')).replace('g.g', 'g.g')}
  UNION ALL {' UNION ALL '.join(f"SELECT recording_id, ts_us, '{c}', round({c} / g.a, 6) + 0 FROM imu JOIN g USING (recording_id) WHERE {c} IS NOT NULL" for c in ('ax', 'ay', 'az'))}
  UNION ALL SELECT recording_id, ts_us, type, round(value, 6) + 0 FROM keyframes) SELECT * FROM u""")
def cht01(spark: SparkSession, d: str) -> DataFrame:
    """A row for each point of each line: sensors by the largest value of their three axes, keyframes as they are."""
    from motionspark.operators.series import chart_series

    lines = chart_series(imu(spark, d), [("gx", "gy", "gz"), ("ax", "ay", "az")])
    marks = keyframes(spark, d).select("recording_id", "ts_us", F.col("type").alias("series"), "value")
    return lines.unionByName(marks).select("recording_id", "ts_us", "series", r6("value"))


@query("j18_best_profile", """WITH r AS (SELECT s_suppkey AS recording_id, 'Brand#' || (s_suppkey % 5 + 1) AS camera, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'id' || (s_suppkey % 40) END AS identifier, (s_suppkey % 11 + 1) * 320 AS width, (s_suppkey % 7 + 1) * 240 AS height, 25 + s_suppkey % 3 AS fps FROM supplier),
p AS (SELECT p_partkey AS id, p_brand AS camera, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'id' || (p_partkey % 700) END AS identifier, (p_partkey % 13 + 1) * 320 AS width, (p_size % 9 + 1) * 240 AS height, 25 + p_size % 4 AS fps FROM part),
m AS (SELECT recording_id, id, CASE WHEN r.identifier <> '' AND r.identifier = p.identifier THEN 1 WHEN r.width = p.width AND r.height = p.height AND r.fps = p.fps THEN 2 WHEN r.width = p.width AND r.height = p.height THEN 3
  WHEN round(r.width * 100 / r.height::DOUBLE) = round(p.width * 100 / p.height::DOUBLE) THEN 4 END AS rank FROM r JOIN p USING (camera))
SELECT recording_id, arg_min(id, (rank, id)) AS id FROM m WHERE rank IS NOT NULL GROUP BY 1""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.profiles import match_profiles

    named = lambda k, none, n: F.when(k % none == 0, "").otherwise(F.concat(F.lit("id"), (k % n).cast("string")))
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    r = table(spark, d, "supplier").select(
        k.alias("recording_id"), F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string")).alias("camera"), named(k, 6, 40).alias("identifier"),
        ((k % 11 + 1) * 320).alias("width"), ((k % 7 + 1) * 240).alias("height"), (25 + k % 3).alias("fps"),
    )
    f = table(spark, d, "part").select(
        p.alias("id"), F.col("p_brand").alias("camera"), named(p, 9, 700).alias("identifier"), ((p % 13 + 1) * 320).alias("width"), ((F.col("p_size") % 9 + 1) * 240).alias("height"), (25 + F.col("p_size") % 4).alias("fps")
    )
    return match_profiles(r, f)


@query("prj23_swap_portrait", "SELECT p_partkey, p_size * 50 AS width, p_size * 100 AS height, p_retailprice AS fx, p_retailprice + 1 AS fy, 7.0::DOUBLE AS cx, 9.0::DOUBLE AS cy FROM part")
def prj23(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.profiles import swap_portrait

    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 50).alias("height"), (F.col("p_retailprice") + 1).alias("fx"), F.col("p_retailprice").alias("fy"), F.lit(9.0).alias("cx"), F.lit(7.0).alias("cy")
    )
    return swap_portrait(p)
