"""Tables between the rounds of driver-steered loops."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

LOCAL_SHARED = "/tmp/checkpoints"  # used only where spark.checkpoint.dir is unset and the master is local, as in tests


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder that the cluster names in spark.checkpoint.dir and read back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(path or LOCAL_SHARED).rstrip('/')}/motionspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
