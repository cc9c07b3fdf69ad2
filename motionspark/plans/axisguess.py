"""AGG21 and SYN08 queries: costs of the 48 axis codes, and the code that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.operators import axisguess, sync
from motionspark.plans.registry import query
from motionspark.plans.sync import HOUR, SHIFT
from motionspark.plans.telemetry import IMU_SQL, imu

AXIS = "CASE {c} WHEN 'X' THEN gx WHEN 'Y' THEN gy WHEN 'Z' THEN gz WHEN 'x' THEN -gx WHEN 'y' THEN -gy ELSE -gz END"
COSTS_SQL = f"""{IMU_SQL}, t AS (SELECT recording_id, seq, (ts_us - 1704067200000000) / {HOUR}::DOUBLE AS us, gx AS x, gy AS y, gz AS z FROM imu WHERE gx IS NOT NULL),
l AS (SELECT unnest(['X', 'Y', 'Z', 'x', 'y', 'z']) AS c), codes AS (SELECT a.c AS c1, b.c AS c2, d.c AS c3 FROM l a, l b, l d WHERE lower(a.c) <> lower(b.c) AND lower(b.c) <> lower(d.c) AND lower(a.c) <> lower(d.c)),
e AS (SELECT recording_id, us::BIGINT / 1000.0::DOUBLE AS t, -z AS x, x AS y, y AS z FROM t WHERE seq % 3 = 0), s AS (SELECT recording_id, min(t) AS a, max(t) AS b, count(*) AS n, max(greatest(abs(x), abs(y), abs(z))) AS m FROM e GROUP BY 1),
g AS (SELECT h.recording_id, trunc(h.t * 1000)::BIGINT AS k, h.x AS gx, h.y AS gy, h.z AS gz FROM (SELECT recording_id, (us::BIGINT - {SHIFT}) / 1000.0::DOUBLE AS t, x, y, z FROM t) h JOIN s USING (recording_id) WHERE h.t >= s.a - 10 AND h.t <= s.b + 10),
m AS (SELECT e.*, o, greatest(trunc((t - o) * 1000), 0)::BIGINT AS k FROM e JOIN (SELECT recording_id, -10.0::DOUBLE + i AS o FROM s, range(20) r(i) WHERE m >= 3) USING (recording_id)),
j AS (SELECT m.recording_id, m.o, m.x, m.y, m.z, g.gx, g.gy, g.gz FROM m ASOF JOIN g ON m.recording_id = g.recording_id AND m.k <= g.k),
f AS (SELECT recording_id, o, c1 || c2 || c3 AS code, sum(70 * pow({AXIS.format(c="c1")} - x, 2) + 70 * pow({AXIS.format(c="c2")} - y, 2) + 100 * pow({AXIS.format(c="c3")} - z, 2)) / count(*) AS cost, count(*) AS n FROM j, codes GROUP BY ALL),
costs AS (SELECT f.recording_id, code, min(cost) AS cost FROM f JOIN (SELECT recording_id, n AS every FROM s) USING (recording_id) WHERE n > every // 2 GROUP BY ALL)"""


def costs(spark: SparkSession, d: str) -> DataFrame:
    """Every third sample, turned to (-z, x, y), as the video's; all of them, earlier, as the gyro's."""
    known = imu(spark, d).where("gx is not null")
    us = F.round(((F.col("ts_us") - 1704067200000000) / HOUR).cast("double")).cast("long")
    s = known.select("recording_id", "seq", us.alias("ts_us"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))
    seen = s.where("seq % 3 = 0").select("recording_id", "ts_us", (-F.col("z")).alias("x"), F.col("x").alias("y"), F.col("y").alias("z"))
    return axisguess.orientation_costs(seen, s.withColumn("ts_us", F.col("ts_us") - SHIFT), sync.Grid(0.0, 10.0))


@query("agg21_orientation_costs", f"WITH {COSTS_SQL} SELECT recording_id, code, round(sqrt(cost), 3) + 0 AS distance FROM costs")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """Roots of the costs."""
    return costs(spark, d).select("recording_id", "code", (F.round(F.sqrt("cost"), 3) + 0).alias("distance"))


@query("syn08_guess_orientation", f"WITH {COSTS_SQL} SELECT recording_id, arg_min(code, cost) AS code FROM costs GROUP BY 1")
def syn08(spark: SparkSession, d: str) -> DataFrame:
    return axisguess.guess_orientation(costs(spark, d)).select("recording_id", "code")
