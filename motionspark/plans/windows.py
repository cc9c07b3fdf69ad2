"""W queries: windows and sessions over ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.operators import asof, series
from motionspark.plans.registry import query
from motionspark.plans.telemetry import HOUR, IMU_SQL, LENS_SQL, QUATS_SQL, imu, lens_rows, quats

W = "PARTITION BY recording_id ORDER BY ts_us"


def r6(c: str):
    return (F.round(c, 6) + 0).alias(c)


def samples(spark, d):
    return imu(spark, d).select("recording_id", "seq", "ts_us", "gx", "gy", "gz")


def frames(spark, d):
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    return lens_rows(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("focal_length").alias("fov"))


FRAMES_SQL = f"{LENS_SQL}, frames AS (SELECT recording_id, row_number() OVER ({W}) - 1 AS frame, focal_length AS fov FROM lens)"
# q2 q1^-1 of neighbours
TURN_SQL = f"""{QUATS_SQL},
n AS (SELECT *, lag(w) OVER v AS pw, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(z) OVER v AS pz, lag(ts_us) OVER v AS pt FROM quats WINDOW v AS ({W})),
t AS (SELECT recording_id, ts_us, pt, w * pw + x * px + y * py + z * pz AS tw, -w * px + x * pw - y * pz + z * py AS tx, -w * py + x * pz + y * pw - z * px AS ty, -w * pz - x * py + y * px + z * pw AS tz FROM n),
v AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS s FROM t)"""


@query("w01_rotation_velocity", f"WITH {TURN_SQL} SELECT recording_id, ts_us, round(coalesce(degrees(2 * atan2(s, abs(tw))) * 50, 0), 6) + 0 AS velocity FROM v")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return series.rotation_velocity(quats(spark, d), rate=50.0).select("recording_id", "ts_us", r6("velocity"))


@query("w02_angular_velocity", f"""WITH {TURN_SQL}, k AS (SELECT *, CASE WHEN s > 1e-12::DOUBLE THEN 2 * atan2(s, abs(tw)) / s ELSE 0 END * CASE WHEN tw < 0 THEN -1 ELSE 1 END / 0.02::DOUBLE AS k FROM v)
SELECT recording_id, ts_us, round(coalesce(degrees(tx * k), 0), 6) + 0 AS x, round(coalesce(degrees(ty * k), 0), 6) + 0 AS y, round(coalesce(degrees(tz * k), 0), 6) + 0 AS z FROM k""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    o = series.angular_velocity(quats(spark, d)).select("recording_id", "ts_us", "omega.*")
    return o.select("recording_id", "ts_us", r6("x"), r6("y"), r6("z"))


@query("w03_roll_rate", f"""WITH {IMU_SQL}, s AS (SELECT recording_id, seq, ts_us, (seq * 37 % 360 - 180)::DOUBLE AS roll FROM imu),
p AS (SELECT *, roll - lag(roll) OVER w AS dr, (ts_us - lag(ts_us) OVER w) / 1e6 AS dt FROM s WINDOW w AS ({W}))
SELECT recording_id, seq, round(coalesce(CASE WHEN dt > 0 AND dt < 36000 THEN (CASE WHEN dr > 180 THEN dr - 360 WHEN dr < -180 THEN dr + 360 ELSE dr END) / dt END, 0), 6) + 0 AS roll_rate FROM p""")
def w03(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("roll", (F.col("seq") * 37 % 360 - 180).cast("double"))
    return series.roll_rate(s, "roll", longest_s=36000.0).select("recording_id", "seq", r6("roll_rate"))


@query("w04_zoom_velocity", f"""WITH {IMU_SQL}, p AS (SELECT recording_id, seq, gx, lag(gx) OVER ({W}) AS q FROM imu)
SELECT recording_id, seq, round(coalesce(CASE WHEN q <> 0 THEN abs(gx - q) * 30 / q END, 0), 6) + 0 AS zoom_velocity FROM p""")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return series.relative_velocity(samples(spark, d), "gx", 30.0).select("recording_id", "seq", r6("zoom_velocity"))


@query("w05_moving_average", f"WITH {IMU_SQL} SELECT recording_id, seq, round(avg(ax) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0 AS average FROM imu")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return series.moving_average(imu(spark, d), "ax", 7).select("recording_id", "seq", r6("average"))


@query("w06_rolling_max", f"WITH {IMU_SQL} SELECT recording_id, seq, max(gx) OVER ({W} RANGE BETWEEN {12 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING) AS rolling_max FROM imu")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_max(samples(spark, d), "gx", 24 * 3600.0).select("recording_id", "seq", "rolling_max")


@query("w07_rolling_min", f"WITH {FRAMES_SQL} SELECT recording_id, frame, min(fov) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rolling_min FROM frames")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_min(frames(spark, d), "fov", 5).select("recording_id", "frame", "rolling_min")


KERNEL = series.gaussian(5, 5 / 6)


def convolve_sql(source: str, value: str = "fov") -> str:
    taps = " + ".join(f"({k!r}::DOUBLE) * list[greatest(1, least(len(list), frame + 1 + {i - 2}))]" for i, k in enumerate(KERNEL))
    return f"SELECT recording_id, frame, {taps} AS smoothed FROM (SELECT recording_id, frame, list({value}) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS list FROM {source})"


@query("w08_gaussian_convolution", f"WITH {FRAMES_SQL}, c AS ({convolve_sql('frames')}) SELECT recording_id, frame, round(smoothed, 6) + 0 AS smoothed FROM c")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return series.convolve(frames(spark, d), "fov", KERNEL).select("recording_id", "frame", r6("smoothed"))


@query("w09_zom03_gaussian_zoom", f"""WITH {FRAMES_SQL}, m AS (SELECT recording_id, frame, min(fov) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS fov FROM frames),
c AS ({convolve_sql('m')}) SELECT recording_id, frame, round(smoothed, 6) + 0 AS smoothed FROM c""")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """A constant window whether or not it is keyframed: rolling minimum, then Gaussian."""
    m = series.rolling_min(frames(spark, d), "fov", 5).drop("fov").withColumnRenamed("rolling_min", "fov")
    return series.convolve(m, "fov", KERNEL).select("recording_id", "frame", r6("smoothed"))


@query("w10_gaussian_over_known", f"""WITH {IMU_SQL}, f AS (SELECT recording_id, row_number() OVER ({W}) - 1 AS frame, count(*) OVER (PARTITION BY recording_id) AS n, gx FROM imu),
s AS (SELECT a.recording_id, a.frame, sum(b.gx * exp(-(k * k) / (2 * pow(7 / 3.0::DOUBLE, 2)))) / sum(exp(-(k * k) / (2 * pow(7 / 3.0::DOUBLE, 2)))) AS m
  FROM f a CROSS JOIN (SELECT unnest(range(-3, 4)) AS k) JOIN f b ON a.recording_id = b.recording_id AND b.frame = least(greatest(a.frame + k, 0), a.n - 1) AND b.gx IS NOT NULL WHERE a.gx IS NOT NULL GROUP BY ALL)
SELECT f.recording_id, f.frame, round(f.gx * 0.5::DOUBLE + 0.5::DOUBLE * m, 6) + 0 AS smoothed FROM f LEFT JOIN s USING (recording_id, frame)""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """A window of six rows is one of seven; sigma is a sixth of it, doubled at half strength."""
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    f = samples(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), "gx")
    return series.gaussian_over_known(f, "gx", 6, 0.5).select("recording_id", "frame", r6("smoothed"))


@query("w16_median_filter", f"""WITH {IMU_SQL}, a AS (SELECT recording_id, seq, ts_us, median(ax) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM imu)
SELECT recording_id, seq, median(m) OVER (PARTITION BY recording_id ORDER BY ts_us DESC ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS median FROM a""")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return series.median_trailing(imu(spark, d), "ax", 5).select("recording_id", "seq", "median")


@query("w19_gap_ranges", f"""WITH {IMU_SQL}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER ({W}) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM imu),
r AS (SELECT *, sum(new) OVER ({W}) AS run FROM g) SELECT recording_id, min(ts_us) AS from_us, max(ts_us) AS to_us FROM r GROUP BY recording_id, run HAVING min(ts_us) <> max(ts_us)""")
def w19(spark: SparkSession, d: str) -> DataFrame:
    return series.gap_ranges(samples(spark, d), 12 * HOUR)


@query("w20_flag_merge", f"""WITH {IMU_SQL}, f AS (SELECT * FROM imu WHERE gx > 40), g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER ({W}) > {24 * HOUR} THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT *, sum(new) OVER ({W}) AS run FROM g) SELECT recording_id, min(ts_us) AS lo, max(ts_us) AS hi, count(*) AS n FROM r GROUP BY recording_id, run""")
def w20(spark: SparkSession, d: str) -> DataFrame:
    return series.merge_flags(samples(spark, d).where("gx > 40"), 24 * HOUR)


@query("w22_interval_merge", f"""WITH {LENS_SQL}, i AS (SELECT recording_id, ts_us // {HOUR} AS lo, ts_us // {HOUR} + 9 AS hi FROM lens),
g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY recording_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM i),
r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT recording_id, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY recording_id, run""")
def w22(spark: SparkSession, d: str) -> DataFrame:
    i = lens_rows(spark, d).select("recording_id", F.floor(F.col("ts_us") / HOUR).alias("lo"), (F.floor(F.col("ts_us") / HOUR) + 9).alias("hi"))
    return series.merge_intervals(i)


RANKED = f"k AS (SELECT recording_id, row_number() OVER ({W}) - 1 AS idx, (seq * 31 % 101)::DOUBLE AS rank FROM imu)"


def ranked(spark, d):
    w = Window.partitionBy("recording_id").orderBy("ts_us")
    return samples(spark, d).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("seq") * 31 % 101).cast("double").alias("rank"))


@query("w25_non_max_suppression", f"""WITH {IMU_SQL}, {RANKED}, m AS (SELECT *, max(rank) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS best,
  lead(idx) OVER (PARTITION BY recording_id ORDER BY idx) IS NULL AS is_last FROM k) SELECT recording_id, idx, CASE WHEN NOT is_last AND best > rank THEN 0::DOUBLE ELSE rank END AS kept FROM m""")
def w25(spark: SparkSession, d: str) -> DataFrame:
    return series.suppress_non_maxima(ranked(spark, d), "rank", 4).select("recording_id", "idx", "kept")


@query("w26_segment_tops", f"""WITH {IMU_SQL}, {RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM k),
s AS (SELECT *, idx // ((n + 2) // 3) AS segment FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, segment ORDER BY rank DESC, idx DESC) AS p FROM s)
SELECT recording_id, segment::INT AS segment, idx, rank FROM o WHERE p = 1 AND rank >= 0.1""")
def w26(spark: SparkSession, d: str) -> DataFrame:
    return series.segment_tops(ranked(spark, d), "rank", 3)


@query("w27_zero_out", f"""WITH {IMU_SQL}, {RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY recording_id) * 0.25::DOUBLE AS total, idx * 0.25::DOUBLE AS t FROM k)
SELECT recording_id, idx, CASE WHEN rank < 50 OR NOT (t BETWEEN 1 AND 12) OR (total > 12 AND (t < 2 OR t >= total - 2)) THEN 0::DOUBLE ELSE rank END AS rank FROM n""")
def w27(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.sync import zero_out

    return zero_out(ranked(spark, d), ratio_s=0.25, trims_s=[(1.0, 12.0)])


@query("w28_speed_ramp", f"""WITH {LENS_SQL}, s AS (SELECT *, coalesce((ts_us - lag(ts_us) OVER ({W})) / (1 + focal_length / 100), 0)::DOUBLE AS step FROM lens)
SELECT recording_id, ts_us, round(sum(step) OVER ({W}), 0) + 0 AS ramped_us FROM s""")
def w28(spark: SparkSession, d: str) -> DataFrame:
    s = lens_rows(spark, d).withColumn("speed", 1 + F.col("focal_length") / 100)
    return series.speed_ramp(s, "speed").select("recording_id", "ts_us", (F.round("ramped_us", 0) + 0).alias("ramped_us"))


@query("w29_forward_fill", f"WITH {IMU_SQL} SELECT recording_id, seq, last_value(gx IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS gx FROM imu")
def w29(spark: SparkSession, d: str) -> DataFrame:
    return asof.carry(samples(spark, d), ["gx"]).select("recording_id", "seq", "gx")


@query("w30_fill_gaps", f"""WITH {IMU_SQL}, n AS (SELECT recording_id, seq, ts_us, gx, row_number() OVER ({W}) AS n FROM imu),
p AS (SELECT *, last_value(CASE WHEN gx IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS pn, last_value(gx IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS pv,
 first_value(CASE WHEN gx IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nn, first_value(gx IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM n)
SELECT recording_id, seq, round(coalesce(gx, pv + (nv - pv) * ((n - pn)::DOUBLE / (nn - pn))), 6) + 0 AS filled FROM p""")
def w30(spark: SparkSession, d: str) -> DataFrame:
    return series.fill_gaps(samples(spark, d), "gx").select("recording_id", "seq", r6("filled"))


@query("w31_midpoints", f"""WITH {IMU_SQL}, n AS (SELECT *, lead(ts_us) OVER ({W}) AS nt FROM imu)
SELECT recording_id, seq, coalesce((ts_us + nt) / 2, ts_us)::DOUBLE AS mid_us, round(degrees(gy), 6) + 0 AS x, round(degrees(gx), 6) + 0 AS y, round(degrees(gz), 6) + 0 AS z FROM n""")
def w31(spark: SparkSession, d: str) -> DataFrame:
    from motionspark.operators.sync import midpoint_rates

    m = midpoint_rates(samples(spark, d))
    return m.select("recording_id", "seq", "mid_us", r6("x"), r6("y"), r6("z"))


@query("w34_decimation", f"WITH {IMU_SQL}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS n FROM imu) SELECT recording_id, seq, gx FROM n WHERE n % 5 = 0")
def w34(spark: SparkSession, d: str) -> DataFrame:
    return series.every_nth(samples(spark, d), 5).select("recording_id", "seq", "gx")


@query("w35_resample", f"""WITH {IMU_SQL}, e AS (SELECT recording_id, min(ts_us) AS a, max(ts_us) AS b FROM imu GROUP BY 1), l AS (SELECT recording_id, unnest(generate_series(a, b, {12 * HOUR})) AS ts_us FROM e),
r AS (SELECT recording_id, ts_us AS k, ax AS v FROM imu), q AS (SELECT l.*, p.k AS pk, p.v AS pv, n.k AS nk, n.v AS nv FROM l ASOF LEFT JOIN r p ON l.recording_id = p.recording_id AND l.ts_us >= p.k ASOF LEFT JOIN r n ON l.recording_id = n.recording_id AND l.ts_us <= n.k)
SELECT recording_id, ts_us, round(CASE WHEN pk = nk THEN pv ELSE pv + (nv - pv) * ((ts_us - pk)::DOUBLE / (nk - pk)) END, 6) + 0 AS ax FROM q""")
def w35(spark: SparkSession, d: str) -> DataFrame:
    return series.resample(imu(spark, d), "ax", 12 * HOUR).select("recording_id", "ts_us", r6("ax"))


@query("w39_moving_pace", f"""WITH {IMU_SQL}, p AS (SELECT recording_id, seq, count(*) OVER w AS n, max(ts_us) OVER w AS b, min(ts_us) OVER w AS a FROM imu WINDOW w AS ({W} RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW))
SELECT recording_id, seq, round(CASE WHEN n > 1 THEN (b - a) / 1e6 / (n - 1) END, 3) + 0 AS frame_s FROM p""")
def w39(spark: SparkSession, d: str) -> DataFrame:
    return series.moving_pace(samples(spark, d), 48 * 3600.0).select("recording_id", "seq", (F.round("frame_s", 3) + 0).alias("frame_s"))


@query("agg14_max_normalisation", f"WITH {IMU_SQL} SELECT recording_id, seq, round(gx / max(abs(gx)) OVER (PARTITION BY recording_id), 6) + 0 AS gx, round(gy / max(abs(gy)) OVER (PARTITION BY recording_id), 6) + 0 AS gy FROM imu")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return series.normalise_by_max(samples(spark, d), ["gx", "gy"]).select("recording_id", "seq", r6("gx"), r6("gy"))
