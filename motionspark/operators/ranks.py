"""Places in one long order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE, RANGES = 20_000, 1_000  # keys looked at to choose the cuts, and ranges between them; both reach the driver


def ranked(df: DataFrame, key: str, out: str, ties: str) -> DataFrame:
    """Adds ``out``, the place from 1 on in the order of ``key``, then ``ties``.

    Keys of least hash cut the order into ranges, the same ones whenever this runs; a row's place is the number
    of rows in earlier ranges and its place in its own.  A key that many rows share is in one range.
    """
    sample = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLE)
    keys = sorted(r[0] for r in sample.collect())
    cuts = keys[:: max(1, len(keys) // RANGES)]
    kind = df.schema[key].dataType.simpleString()
    bounds = F.broadcast(df.sparkSession.createDataFrame([(cuts,)], f"_cuts array<{kind}>"))  # one row
    df = df.crossJoin(bounds).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(key))), F.lit(-1))).drop("_cuts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = df.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key, ties))
    return df.join(F.broadcast(counts), "_range").withColumn(out, (F.col("_before") + own).cast("long")).drop("_range", "_before")
