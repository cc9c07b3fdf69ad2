"""Interleaving sources to target weights by Pfair scheduling.

Each source's rows, in a random but fixed order, form blocks of ``block`` rows.  A source with the share w of
all slots releases its block number i at slot floor(i / w) and must place it before slot ceil((i + 1) / w).
Earliest deadline first among the released blocks meets every deadline, so at any slot a source is less than
one block from its weight.  Weights are fractions: brought to whole numbers without a common divisor they are
the quotas of a period after which every source is exactly where it should be.  Hence the order within one
period, drawn up once, gives the slot of every block by arithmetic, without any error that grows.

A source that has run out leaves its later slots empty: the others keep their order and their weights among
themselves, and no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.sharding import range_bits

LARGEST_PERIOD = 1_000_000
BROADCAST_SLOTS = 100_000  # a longer period is joined without broadcasting it
TARGET_WEIGHTS = {"src0": 6.0, "src1": 3.0, "src2": 2.0}  # of op8 and the pipeline; every other source has 1


def quotas(weights: dict, largest: int = LARGEST_PERIOD) -> dict:
    """The weights as whole numbers without a common divisor; a period has their sum of slots.

    Weights of other sources than fractions with a denominator up to 10^6 are rounded to such.  Where the sum
    is above ``largest`` they are whole numbers of that sum, at least 1 each, by largest remainders, and these
    are then the target weights.
    """
    names = sorted(weights, key=str)
    exact = {s: Fraction(weights[s]).limit_denominator(1_000_000) for s in names}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    whole = {s: q // common for s, q in whole.items()}
    total, largest = sum(whole.values()), max(largest, len(names))
    if total <= largest:
        return whole
    out = {s: max(1, q * largest // total) for s, q in whole.items()}
    order = sorted(names, key=lambda s: (Fraction(out[s] * total - whole[s] * largest), s is None, str(s)))
    for s in order[: max(0, largest - sum(out.values()))]:
        out[s] += 1
    return out


def pfair_period(quota: dict) -> list:
    """The sources in the order of one period's slots: earliest deadline first among released blocks."""
    p, names = sum(quota.values()), sorted(quota, key=str)
    coming = [(0, k, 0) for k, s in enumerate(names) if quota[s]]
    heapq.heapify(coming)
    ready, out = [], []
    for slot in range(p):
        while coming and coming[0][0] <= slot:
            _, k, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * p // quota[names[k]]), k, i))
        deadline, k, i = heapq.heappop(ready)
        assert slot < deadline
        out.append(names[k])
        if i + 1 < quota[names[k]]:
            heapq.heappush(coming, ((i + 1) * p // quota[names[k]], k, i + 1))
    return out


def mix_sources(docs: DataFrame, weights: dict | None = None, block: int = 64, seed: int = 8) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``block`` and ``block_slot`` longs and ``mix_position`` long.

    Weights are by source, above 0; sources without one, null among them, get 1, and no weights at all means
    equal shares.  mix_position orders all rows: it is block_slot * block size + the row's place in its block,
    with gaps where a source has run out or has a last, shorter block.  Repeated rows stay.  Columns of the
    input with those names are replaced.  One count a source and the period's order, LARGEST_PERIOD slots at
    most or one a source, reach the driver.  An empty table gives no rows.
    """
    docs = docs.drop("block", "block_slot", "mix_position")
    spark = docs.sparkSession
    key, rank, plan = (shared.free_name(docs, x) for x in ("mix_key", "mix_rank", "mix_plan"))
    counts = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    quota = quotas({s: (weights or {}).get(s, 1) for s in counts}) if counts else {}
    places: dict = {s: [] for s in quota}
    for slot, s in enumerate(pfair_period(quota)):
        places[s].append(slot)
    kind = docs.schema["source"].dataType.simpleString()
    table = spark.createDataFrame([(s, at) for s, at in places.items()], f"src {kind}, places array<long>").select(F.struct("*").alias(plan))
    table = F.broadcast(table) if sum(quota.values()) <= BROADCAST_SLOTS else table

    ties = [F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"))]  # rows alike in all columns may change places
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    ranked = shared.slots(keyed, ["source"], key, rank, bits=range_bits(max(counts.values(), default=0), 1), ties=ties)
    ranked = ranked.withColumn("block", F.floor(F.col(rank) / block).cast("long"))
    at = ranked.join(table, F.col("source").eqNullSafe(F.col(f"{plan}.src")))  # a row for each source
    own = F.size(F.col(f"{plan}.places"))
    slot = F.floor(F.col("block") / own) * F.lit(sum(quota.values())) + F.get(F.col(f"{plan}.places"), (F.col("block") % own).cast("int"))
    at = at.withColumn("block_slot", slot.cast("long")).withColumn("mix_position", F.col("block_slot") * block + F.col(rank) % block)
    return at.select(*(F.col(f"`{c}`") for c in docs.columns), "block", "block_slot", "mix_position")
