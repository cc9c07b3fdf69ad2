"""Pfair mixing and hypergeometric sharding: exact counts, bounds and the law of the draws."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motionspark.llm import mixing, sharding
from motionspark.llm.queries import QUERIES
from tests.llm.conftest import same_rows


@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_pfair_is_within_one_block(shares):
    quota = {f"s{k}": q for k, q in enumerate(shares)}
    order, total = mixing.pfair_period(quota), sum(shares)
    assert Counter(order) == quota
    seen = Counter()
    for slot, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] * total - slot * q) < total for x, q in quota.items())


@pytest.mark.parametrize(
    "weights",
    [{"a": 1, "b": 1, "c": 1}, {"a": 1 / 3, "b": 1 / 7, "c": 1 - 1 / 3 - 1 / 7}, mixing.TARGET_WEIGHTS | {f"s{k}": 1 for k in range(17)}, {"a": 0.1, "b": 0.25, "c": 0.65}, {"a": 1e-3, "b": 7.77, None: 2}],
)
def test_schedule_follows_the_weights_without_end(weights):
    """Against the weights themselves, over 10^5 slots: less than one block."""
    order = mixing.pfair_period(mixing.quotas(weights))
    slots, total = np.arange(1, 100_001), sum(weights.values())
    for s, w in weights.items():
        seen = np.cumsum(np.resize(np.array([x == s for x in order]), len(slots)))
        assert np.abs(seen - slots * (w / total)).max() < 1


def test_quotas_of_odd_weights():
    rng = np.random.default_rng(3)
    weights = {f"s{k}": float(w) for k, w in enumerate(rng.random(9) + 0.01)}
    quota = mixing.quotas(weights, 5000)
    assert sum(quota.values()) == 5000 and all(abs(q - 5000 * weights[s] / sum(weights.values())) < 1 for s, q in quota.items())
    assert mixing.quotas({"a": 2.0, "b": 4}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        mixing.quotas({"a": 0})


def test_mixing(spark, docs, rows, clashing, none):
    out = mixing.mix_sources(docs, {"hot": 3.0, "mid": 1.0}, block=2).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    at = sorted((r["mix_position"], r["source"]) for r in out)
    assert len({p for p, _ in at}) == len(out)
    blocks = sorted({(r["block_slot"], r["source"]) for r in out}, key=lambda x: x[0])
    assert len({b for b, _ in blocks}) == len(blocks)
    want = {"hot": 0.5, "mid": 1 / 6, "rare": 1 / 6, None: 1 / 6}
    seen = Counter()
    total = Counter(s for _, s in blocks)
    first_end = min(max(b for b, x in blocks if x == s) for s in want)
    assert [b for b, _ in blocks if b <= first_end] == list(range(first_end + 1))
    for k, (b, s) in enumerate(blocks, 1):
        seen[s] += 1
        assert b > first_end or all(abs(seen[x] - k * w) < 1 for x, w in want.items())
    assert seen == total and first_end > 10
    for s in want:  # a source's blocks are full but for its last
        sizes = Counter(r["block"] for r in out if r["source"] == s)
        assert all(sizes[b] == 2 for b in range(len(sizes) - 1))
    assert mixing.mix_sources(none).count() == 0
    plain = mixing.mix_sources(docs, block=4).select("doc_id", "source", "mix_position")
    assert same_rows(plain, mixing.mix_sources(clashing, block=4))
    assert plain.count() == mixing.mix_sources(docs.unionByName(docs), block=4).count() / 2


def test_matrix_has_exact_sums_and_the_uniform_law():
    rows, columns = [5, 3, 0, 4], [6, 6]
    draws = [sharding.communication_matrix(rows, columns, seed) for seed in range(3000)]
    assert all((d.sum(axis=1) == rows).all() and (d.sum(axis=0) == columns).all() for d in draws)
    found = Counter(int(d[0, 0]) for d in draws)
    from math import comb

    for x in range(6):
        p = comb(6, x) * comb(6, 5 - x) / comb(12, 5)
        assert abs(found[x] / 3000 - p) < 4 * (p * (1 - p) / 3000) ** 0.5 + 1e-9


def test_large_populations_draw_alike():
    rng = np.random.default_rng(1)
    got = [sharding.hypergeometric(rng, 600_000_000, 900_000_000, 1000) for _ in range(2000)]
    assert abs(np.mean(got) - 400) < 4 * (240 / 2000) ** 0.5
    assert 0.85 < np.var(got) / 240 < 1.15


def test_sharding(spark, docs, rows, clashing, none, sf_dir):
    out = QUERIES["op7_hypergeometric_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))
    for r in out:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sharding.shard_rows(none, 8).count() == 0
    assert same_rows(sharding.shard_rows(docs, 5).select("doc_id", "shard", "slot"), sharding.shard_rows(clashing, 5))
    twice = Counter(r["shard"] for r in sharding.shard_rows(docs.unionByName(docs), 4).collect())
    assert max(twice.values()) - min(twice.values()) <= 1 and sum(twice.values()) == 2 * len(rows)


def test_neighbours_part(spark):
    """A uniform shuffle: places of consecutive ids are unrelated, shards are even over them."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text")
    out = sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(docs, 8).collect())
    shard, slot = np.array([r[1] for r in out]), np.array([r[2] for r in out], float)
    assert abs(np.corrcoef(slot[:-1], slot[1:])[0, 1]) < 0.05
    assert np.bincount(shard[:2000], minlength=8).std() < 30


def test_sharding_in_order(spark, tmp_path):
    """Files' order back over many files; shards even over it and over neighbours."""
    path = str(tmp_path / "ordered")
    spark.range(0, 8000, numPartitions=13).selectExpr("id AS doc_id", "'t' AS text", "0 AS shard_at").write.option("maxRecordsPerFile", 200).parquet(path)
    docs = spark.read.parquet(path)
    assert all(r["doc_id"] == r["at"] for r in sharding.file_order(docs, "at").collect())
    for parts in (None, 3):
        out = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_in_order(docs, 8, parts=parts).collect())
        assert [(s, k) for s, k, _ in out] == [(s, k) for s in range(8) for k in range(1000)]
        assert sorted(d for *_, d in out) == list(range(8000)) and out == sorted(out, key=lambda r: (r[0], r[2]))
        of = np.array([s for s, _, _ in sorted(out, key=lambda r: r[2])])
        assert np.bincount(of[:2000], minlength=8).std() < 30
        assert abs((of[1:] == of[:-1]).mean() - 1 / 8) < 0.02
    assert sharding.shard_in_order(docs.where("doc_id < 0"), 8).count() == 0


def test_mixing_query_has_unequal_weights(spark, tmp_path):
    """While every source has blocks left, each is within a block of its weight's share."""
    docs = spark.range(9600).selectExpr("id AS doc_id", "'t' AS text", "concat('src', id % 6) AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op8_pfair_mixing"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(9600))
    want = {f"src{k}": w / 14 for k, w in enumerate((6, 3, 2, 1, 1, 1))}
    blocks, seen = sorted({(r["block_slot"], r["source"]) for r in out}), Counter()
    for k, (_, s) in enumerate(blocks, 1):
        seen[s] += 1
        assert all(abs(seen[x] - k * w) < 1 for x, w in want.items())
        if seen[s] == 100:
            break
    assert seen["src0"] == 100 and seen["src5"] < 20
