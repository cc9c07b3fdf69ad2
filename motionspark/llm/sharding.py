"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in ``parts`` source partitions by a hash of their content, so that a task that runs again finds
the same rows.  With n_i rows in partition i and exact shard sizes m_j, the matrix a_ij of rows that go from
i to j has the law that a uniform permutation would give it: row by row a multivariate hypergeometric draw
from what the shards still lack.  Each partition permutes its rows and cuts them at the running sums of its
matrix row; each shard permutes what it receives.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.llm import shared

PARTS, PART_ROWS = 1024, 1_000_000  # source partitions: so many, more where they would hold more rows


def range_bits(rows: int, groups: int) -> int:
    """Bits of the key that cut each group into ranges of no more than about PART_ROWS rows."""
    return min(24, max(10, (rows // max(1, groups * PART_ROWS)).bit_length()))


def shard_sizes(n: int, shards: int) -> list[int]:
    """n rows in counts at most one apart."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement; numpy's sampler refuses populations from 10^9 on."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    # From the mode outwards, until the uniform number is used up.
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            if (u := u - pr) <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            if (u := u - pl) <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """A draw of the matrix with these row and column sums that a uniform permutation induces."""
    rng, lacking, out = np.random.default_rng(seed), list(columns), np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(lacking)
        for j, m in enumerate(list(lacking)):
            rest -= m
            x = hypergeometric(rng, m, rest, n)
            out[i, j] = x
            lacking[j] -= x
            n -= x
    return out


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 7, parts: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``shard`` int and ``slot`` long, slots gapless from 0 in each shard.

    Every row is placed, nulls and repeated rows too; equal texts are placed independently, as a uniform
    shuffle must.  Columns of the input named shard or slot are replaced.  Only ``parts`` counts reach the
    driver; without a number given, there is one part for a million rows, and PARTS at least.  An empty table
    gives no rows.
    """
    docs = docs.drop("shard", "slot")
    parts = parts or max(PARTS, docs.count() // PART_ROWS)
    part, key, again, cut = (shared.free_name(docs, x) for x in ("shard_part", "shard_key", "shard_again", "shard_cut"))
    content = [F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))]
    keyed = docs.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(parts)).cast("int"))
    keyed = keyed.withColumn(key, F.xxhash64(F.lit(seed + 1), *content)).withColumn(again, F.xxhash64(F.lit(seed + 2), *content))
    counts = dict(keyed.groupBy(part).count().collect())
    rows = [counts.get(i, 0) for i in range(parts)]
    ends = np.cumsum(communication_matrix(rows, shard_sizes(sum(rows), shards), seed), axis=1)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, [int(x) for x in ends[i]]) for i in range(parts)], f"`{part}` int, `{cut}` array<long>")
    ties = [F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"))]  # rows alike in all columns may change places
    rank = F.row_number().over(Window.partitionBy(part).orderBy(key, *ties)) - 1
    placed = keyed.withColumn("slot", rank).join(F.broadcast(table), part)  # parts x shards numbers
    placed = placed.withColumn("shard", F.size(F.filter(F.col(cut), lambda e: e <= F.col("slot")))).drop("slot", part, key, cut)
    return shared.slots(placed, ["shard"], again, "slot", bits=range_bits(sum(rows), shards), ties=ties).drop(again)


def file_order(docs: DataFrame, out: str) -> DataFrame:
    """Adds the gapless 0-based rank of each row in the part files that ``docs`` is read from, file by file.

    Part files come in the order of their numbers and before others, whatever their number and sizes, so a
    table that was written in order has its ranks back.  ``docs`` must be read from parquet files as they are.
    One count a file reaches the driver.
    """
    path, row, base = (shared.free_name(docs, x) for x in ("order_path", "order_row", "order_base"))
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))

    def number(name: str) -> tuple:
        m = re.search(r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$", name)
        return (0, int(m[1]), int(m[2] or 0), name) if m else (1, 0, 0, name)

    counts = sorted(placed.groupBy(path).count().collect(), key=lambda r: number(r[0]))
    starts, at = [], 0
    for r in counts:
        starts.append((r[0], at))
        at += r[1]
    table = docs.sparkSession.createDataFrame(starts, f"`{path}` string, `{base}` long")
    placed = placed.join(F.broadcast(table), path)  # a row for each file
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), (F.col(base) + F.col(row)).alias(out))


def shard_in_order(docs: DataFrame, shards: int = 8, seed: int = 7, parts: int | None = None) -> DataFrame:
    """``docs``, as read from part files, with ``shard`` and ``slot`` as in ``shard_rows``; the files' order stays in each shard.

    The source partitions are runs of consecutive rows.  Each permutes its rows and cuts them at the running
    sums of its row of the communication matrix, so every set of rows of a shard's size is as likely; the
    slots of a shard follow the order of the files.  Every row is placed, repeated rows too.
    """
    docs = docs.drop("shard", "slot")
    part, key, at, cut, base = (shared.free_name(docs, x) for x in ("shard_part", "shard_key", "shard_at", "shard_cut", "shard_base"))
    n = docs.count()
    parts = parts or max(PARTS, n // PART_ROWS)
    run = max(1, -(-n // parts))
    rows = [max(0, min(run, n - i * run)) for i in range(parts)]
    matrix = communication_matrix(rows, shard_sizes(n, shards), seed)
    ends, bases = np.cumsum(matrix, axis=1).tolist(), (np.cumsum(matrix, axis=0) - matrix).tolist()
    table = docs.sparkSession.createDataFrame([(i, ends[i], bases[i]) for i in range(parts)], f"`{part}` int, `{cut}` array<long>, `{base}` array<long>")
    placed = file_order(docs, at).withColumn(part, F.floor(F.col(at) / run).cast("int"))
    placed = placed.withColumn(key, F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), at))
    placed = placed.withColumn("slot", F.row_number().over(Window.partitionBy(part).orderBy(key, at)) - 1)
    placed = placed.join(F.broadcast(table), part)  # parts x shards numbers, twice
    placed = placed.withColumn("shard", F.size(F.filter(F.col(cut), lambda e: e <= F.col("slot"))))
    own = F.row_number().over(Window.partitionBy(part, "shard").orderBy(at)) - 1
    placed = placed.withColumn("slot", (F.get(F.col(base), F.col("shard")) + own).cast("long"))
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), "shard", "slot")
