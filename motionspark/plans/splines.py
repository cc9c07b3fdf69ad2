"""MTH04 and MTH05 queries: each vector's first numbers are knots of a spline, or of a mesh that bends a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.operators import splines
from motionspark.plans.registry import query
from motionspark.plans.telemetry import table

KNOTS_SQL = """v AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS a FROM embeddings, range(9) AS r(i)),
al AS (SELECT *, 3 * (lead(a) OVER w - 2 * a + lag(a) OVER w) AS alpha FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
fw AS (SELECT vec_id, 0 AS i, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS z FROM v WHERE i = 0
  UNION ALL SELECT al.vec_id, al.i, 1 / (4 - fw.mu), (al.alpha - fw.z) / (4 - fw.mu) FROM fw JOIN al ON al.vec_id = fw.vec_id AND al.i = fw.i + 1 WHERE al.i < 8),
bw AS (SELECT vec_id, 8 AS i, 0.0::DOUBLE AS c FROM v WHERE i = 8
  UNION ALL SELECT fw.vec_id, fw.i, fw.z - fw.mu * bw.c FROM bw JOIN fw ON fw.vec_id = bw.vec_id AND fw.i = bw.i - 1),
p AS (SELECT v.vec_id, v.i, v.a, n.a - v.a - (d.c + 2 * c.c) / 3 AS b, c.c, (d.c - c.c) / 3 AS d FROM v JOIN v n ON n.vec_id = v.vec_id AND n.i = v.i + 1 JOIN bw c ON c.vec_id = v.vec_id AND c.i = v.i JOIN bw d ON d.vec_id = v.vec_id AND d.i = v.i + 1)"""


@query("mth04_natural_spline", f"""WITH RECURSIVE {KNOTS_SQL}, x AS (SELECT vec_id, nth, (nth * 150 - 200 + 300 * embedding[nth + 11]::DOUBLE) AS x FROM embeddings, range(10) AS r(nth)),
t AS (SELECT *, x / 135 AS t, least(greatest(x / 135, 0), 8) AS s, least(greatest(floor(x / 135), 0), 7)::INT AS i FROM x)
SELECT vec_id, nth, round(a + b * (s - i) + c * pow(s - i, 2) + d * pow(s - i, 3) + (t - s) * (b + 2 * c * (s - i) + 3 * d * pow(s - i, 2)), 7) + 0 AS value FROM t JOIN p USING (vec_id, i)""")
def mth04(spark: SparkSession, d: str) -> DataFrame:
    """Nine knots over 1080 rows, looked up at ten places from before the first to behind the last."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("nth"))
    x = F.col("nth") * 150 - 200 + 300 * F.get("embedding", F.col("nth") + 10).cast("double")
    knots = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    value = splines.spline_at(knots, x, F.lit(1080.0))
    return e.select("vec_id", F.col("nth").cast("long"), (F.round(value, 7) + 0).alias("value"))


@query("mth05_mesh_and_back", """SELECT vec_id, nth, (160 + 320 * (nth % 6))::DOUBLE AS x, (135 + 270 * (nth // 6))::DOUBLE AS y, true AS moved FROM embeddings, range(24) AS r(nth)""")
def mth05(spark: SparkSession, d: str) -> DataFrame:
    """Points of a frame through a mesh of five by five knots and back: they are the ones that went in, and the mesh does move them."""
    e = table(spark, d, "embeddings")
    knot = lambda i: F.when(i < 25, 480.0 * (i % 5) + 100 * F.get("embedding", i).cast("double")).otherwise(270.0 * F.floor((i - 25) / 5) + 60 * F.get("embedding", i).cast("double"))
    e = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(49)), knot).alias("mesh"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("nth"))
    e = e.select("vec_id", "mesh", F.col("nth").cast("long").alias("nth"), (160.0 + 320 * (F.col("nth") % 6)).alias("px"), (135.0 + 270 * F.floor(F.col("nth") / 6)).alias("py"))
    size = F.lit(1920.0), F.lit(1080.0)
    e = e.withColumn("there", splines.mesh_place(F.col("mesh"), 5, F.col("px"), F.col("py"), *size))
    e = e.withColumn("back", splines.mesh_source(F.col("mesh"), 5, F.col("there.x"), F.col("there.y"), *size))
    moved = F.abs(F.col("there.x") - F.col("px")) + F.abs(F.col("there.y") - F.col("py")) > 1e-3
    return e.select("vec_id", "nth", (F.round("back.x", 6) + 0).alias("x"), (F.round("back.y", 6) + 0).alias("y"), moved.alias("moved"))
