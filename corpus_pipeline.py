"""From documents to training shards: toxicity, near duplicates, benchmark leaks, source mixing, sharding.

Every stage takes all that its predecessor kept; the last one adds each row's shard and slot.  The mixing stage
hands its order on as that of the part files, and the slots of each shard follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.decontamination import without_leaks
from motionspark.llm.jaccard_join import one_of_each_group
from motionspark.llm.mixing import TARGET_WEIGHTS, mix_sources
from motionspark.llm.sharding import shard_in_order
from motionspark.llm.toxicity import TOXIC_FROM, score_toxicity

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
BLOCK = 16
SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional language models reject go; each row by its own text, whatever its doc_id."""
    row = F.xxhash64("doc_id", "text")
    scored = score_toxicity(docs.select("doc_id", "text", row.alias("row")), spark.read.parquet(f"{sf_dir}/labels.parquet"), also=("row",))
    rejected = scored.where(F.col("score") >= TOXIC_FROM).select(F.col("row").alias("rejected")).distinct()
    return docs.join(rejected, row == rejected.rejected, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity the one of the smallest doc_id stays."""
    return one_of_each_group(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the Pfair schedule to the target weights, part file by part file."""
    mixed = mix_sources(docs, TARGET_WEIGHTS, block=BLOCK)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uniform draws of shards whose sizes differ by at most one row; in each shard the mixed order stays."""
    return shard_in_order(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("sharding", sharding),
]

# Language models, the latent space and random draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
