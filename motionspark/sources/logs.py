"""Text logs of IMU samples: reading, and joining the parts of one recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import text as X

COLUMNS = ("gx", "gy", "gz", "ax", "ay", "az")
# What a log's first line holds, the scale of times without one, seconds around a seam at which to look for an offset.
MAGIC, SCALE, SEAM_S = " IMU LOG", 0.001, (-0.5, 0.5, 1.0, 2.0, 2.5)


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, t, scale, gx, gy, gz, ax, ay, az) of each data line of the logs below ``path``; t in the log's own units, ``scale`` seconds each.

    Files without the log's mark give no rows.  Missing and malformed numbers are null; lines without a time are
    left out.  Header lines come from one count a file, so a log may be split among tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    fields = F.split("line", ",")
    number = lambda i: F.trim(F.get(fields, F.lit(i))).try_cast("double")
    scale = F.when(F.get(fields, F.lit(0)) == "tscale", number(1))
    heads = lines.groupBy("file").agg(F.max(F.contains("line", F.lit(MAGIC))).alias("known"), F.coalesce(F.max(scale), F.lit(SCALE)).alias("scale"))
    data = lines.where(F.size(fields) > 1).select("file", number(0).alias("t"), *(number(i + 1).alias(c) for i, c in enumerate(COLUMNS))).where("t is not null")
    return data.join(heads.where("known").select("file", "scale"), "file").select("file", "t", "scale", *COLUMNS)


def _parts(logs: DataFrame, by: list[str]) -> DataFrame:
    """Of each file its first and last time, and what to add to its times: the ends of the files before it, if any clock starts anew."""
    order = Window.partitionBy(*by, "file").orderBy("t")
    step = F.col("t") - F.lag("t").over(order)
    ends = logs.select(*by, "file", "t", "scale", step.alias("step")).groupBy(*by, "file")
    ends = ends.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("step", "t").alias("step"), F.first("scale").alias("scale"))
    files = Window.partitionBy(*by).orderBy(X.natural_key(F.col("file")), "file")
    whole = Window.partitionBy(*by)
    before = F.lag("last").over(files)
    step = F.coalesce("step", F.col("last") - F.coalesce(before, F.lit(0.0)))  # a file of one line goes on from the one before
    ends = ends.withColumns({"back": F.coalesce(F.col("first") < before, F.lit(False)), "length": F.col("last") + step, "part": F.row_number().over(files)})
    shift = F.coalesce(F.sum("length").over(files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ends.withColumn("shift", F.when(F.max("back").over(whole), shift).otherwise(F.lit(0.0))).drop("back", "length")


def merge_logs(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``logs`` (file, t, scale, ...) with ``t`` as on one clock, and ``part``, the file's place by the numbers in its name.

    Each file goes on where the one before it ends, but only if some file's clock starts anew.  Rows of a file
    are in the order of their times.  With ``by``, each group of files is a recording.
    """
    by = by or []
    parts = _parts(logs, by).select(*by, "file", "part", "shift")
    return logs.join(F.broadcast(parts), [*by, "file"]).withColumn("t", F.col("t") + F.col("shift")).drop("shift")  # a row for each file


def seam_points(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(part, point_ms): the times around the start of each file but the first at which offsets are to be looked for."""
    by = by or []
    at = F.explode(F.array(*(F.lit(s) for s in SEAM_S)))
    return _parts(logs, by).where("part > 1").select(*by, "part", F.col("shift"), "scale", at.alias("s")).select(*by, "part", ((F.col("shift") * F.col("scale") + F.col("s")) * 1000).alias("point_ms"))
