"""Tables in the shared folder, exact ranks without one large sort, and connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOCAL_SHARED = "/tmp/checkpoints"  # used only where spark.checkpoint.dir is unset and the master is local, as in tests
# While a table is written: its shuffle files go when it ends, and Python workers get small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a cluster that names none has no shared folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def keep(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    The files survive lost executors.  The shuffle files of the write go when it ends; ``forget`` deletes the
    table, and what is not forgotten the folder's owner clears as with checkpoints.  ``batch`` rows go to a Python worker at once, where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motionspark/{label}-{uuid.uuid4().hex}"
    writing = WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in writing}
    for k, v in writing.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` has returned and that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not use, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slots(df: DataFrame, groups: list[str], key: str, out: str, bits: int = 10, ties: list[Column] | None = None) -> DataFrame:
    """Adds the gapless 0-based rank of each row within its group, in the order of a uniform 64-bit ``key``.

    The key's top ``bits`` bits cut each group into ranges; a row's rank is the count of the rows in
    earlier ranges plus its rank in its own range.  No task holds more than one range of one group.
    """
    cut, before, n = (free_name(df, x) for x in ("slot_range", "slot_before", "slot_n"))
    df = df.withColumn(cut, F.shiftright(F.col(key), 64 - bits).cast("int"))
    w = Window.partitionBy(*groups).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        df.groupBy(*groups, cut)
        .agg(F.count(F.lit(1)).alias(n))
        .select(*groups, cut, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    )
    own = F.row_number().over(Window.partitionBy(*groups, cut).orderBy(key, *(ties or []))) - 1
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in (*groups, cut)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    ranked = df.withColumn(out, own.cast("long"))
    return ranked.alias("l").join(counts.alias("r"), condition).select(
        *(F.col(f"l.`{c}`") for c in df.columns if c != cut), (F.col(f"l.`{out}`") + F.col(f"r.`{before}`")).alias(out)
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) edges of longs -> (node, component), the component being its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each round's edges are
    a table in the shared folder.  Nodes without an edge are not returned.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = keep(e, label)
    old = state(e)
    while old[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        forget(last)
        new = state(e)
        if new == old:
            break
        old = new
    named = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    named = keep(named, label)
    forget(e)
    return named
