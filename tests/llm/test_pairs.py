"""Line dedup and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.llm import jaccard_join, line_dedup, shared
from motionspark.llm.jaccard_join import ngram_jaccard_join, one_of_each_group
from tests.llm.conftest import SCHEMA, same_rows


def shingle_sets(rows, width):
    out = {}
    for doc_id, text, *_ in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        n = min(width, len(words))
        out[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    return out


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_join(rows, width, percent):
    sets = shingle_sets(rows, width)
    full = [d for d, s in sets.items() if s]
    links = [(a, b) for a, b in combinations(full, 2) if 100 * len(i := sets[a] & sets[b]) >= percent * (len(sets[a]) + len(sets[b]) - len(i))]
    found = components(sets, links)
    return sorted((d, len(sets[d]), found[d]) for d in sets)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_join_is_exact(docs, rows, width, percent):
    assert sorted(map(tuple, ngram_jaccard_join(docs, width, percent).collect())) == brute_join(rows, width, percent)


def test_small_sets_of_every_boundary(spark):
    """Short texts around the light/heavy boundary, one word apart each."""
    rng = np.random.default_rng(5)
    rows = []
    for size in range(1, 45):
        words = [f"w{x}" for x in rng.integers(0, 60, size)]
        for k in range(4):
            w = list(words)
            if k:
                w[int(rng.integers(0, size))] = f"z{k}"
            rows.append((len(rows), " ".join(w), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    for width, percent in ((1, 80), (3, 90)):
        assert sorted(map(tuple, ngram_jaccard_join(docs, width, percent).collect())) == brute_join(rows, width, percent)


def test_chain_of_links(spark):
    """Neighbours link, ends do not: the component is transitive."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 2 : k * 2 + 120]), None, None, 0) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ngram_jaccard_join(docs, 3, 90).collect())) == brute_join(rows, 3, 90)


def test_join_edge_cases(spark, docs, clashing, none):
    assert ngram_jaccard_join(none).count() == 0
    assert same_rows(ngram_jaccard_join(docs), ngram_jaccard_join(clashing))
    odd = spark.createDataFrame([(None, "a b c", None, None, 0), (7, "a b c", None, None, 0), (7, "a b c", None, None, 0), (3, "a b c", None, None, 0), (9, None, None, None, 0)], SCHEMA)
    got = sorted(map(tuple, ngram_jaccard_join(odd).collect()), key=repr)
    assert got == sorted([(None, 1, None), (7, 1, 3), (7, 1, 3), (3, 1, 3), (9, 0, 9)], key=repr)


def test_one_of_each_group(docs, rows, clashing):
    want = sorted(d for d, _, c in brute_join(rows, 5, 80) if d == c)
    kept = one_of_each_group(clashing, 5, 80)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == want
    assert kept.columns == clashing.columns


def test_one_of_each_group_with_repeated_rows(spark):
    rows = [(4, "a b c d e f", "x", None, 0), (4, "a b c d e f", "y", None, 0), (7, "a b c d e f", "x", None, 0), (None, "q r", None, None, 0), (None, "q r", None, None, 1), (None, None, None, None, 0)]
    kept = one_of_each_group(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(4, "a b c d e f"), (None, "q r"), (None, None)], key=repr)


def test_subset_sizes_cover_every_feasible_pair():
    for percent in (60, 80, 90):
        for s in range(1, 32):
            for t in range(s, jaccard_join.largest(s, percent) + 1):
                c = jaccard_join.overlap(s, t, percent)
                assert 100 * c >= percent * (s + t - c) and 100 * (c - 1) < percent * (s + t - c + 1)
                assert c in jaccard_join.subset_sizes(s, percent) and c in jaccard_join.subset_sizes(t, percent)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(5, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))
        apart, n, both = len(np.setxor1d(a, b)), np.array([len(a), len(b)]), np.concatenate([a, b])
        at, flat = jaccard_join.sketches_of(n, both)
        assert jaccard_join.parts_apart(flat[: at[1]], flat[at[1] :]) <= apart
        odd = jaccard_join.parities_of(n, both)
        assert sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64)) <= apart


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    found = components({x for e in links for x in e}, links)
    got = shared.components(spark.createDataFrame(links, "u long, v long"))
    alone = {a for a, b in links if a == b} - {x for e in links if e[0] != e[1] for x in e}
    assert dict(map(tuple, got.collect())) == {k: v for k, v in found.items() if k not in alone}


def edit_at_most_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b


def brute_lines(rows, near_chars=20):
    firsts: dict[str, bool] = {}
    out = []
    for doc_id, text, *_ in sorted(rows):
        if text is None:
            out.append((doc_id, None, 0, 0, 0))
            continue
        kept, counts = [], [0, 0, 0]
        for line in text.split("\n"):
            if not line.strip(" \t\r\x0b\x0c"):
                kept.append(line)
                continue
            counts[0] += 1
            if line in firsts:
                counts[1 + firsts[line]] += 1
                continue
            near = len(line) >= near_chars and any(len(x) >= near_chars and edit_at_most_one(line, x) for x in firsts)
            firsts[line] = near
            if near:
                counts[2] += 1
            else:
                kept.append(line)
        out.append((doc_id, "\n".join(kept), *counts))
    return out


def test_line_dedup_is_exact(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdé🙂 "), rng.integers(1, 70))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(int(rng.integers(0, 8))):
            s = list(base[int(rng.integers(0, len(base)))])
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(s) + 1))
                match int(rng.integers(0, 3)):
                    case 0:
                        s.insert(at, "z")
                    case 1 if at < len(s):
                        s[at] = "y"
                    case 2 if at < len(s):
                        del s[at]
            lines.append("".join(s))
        rows.append((k, "\n".join(lines) if k % 20 else None, None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_exact", "n_near")
    assert sorted(map(tuple, got.collect())) == brute_lines(rows)


def test_line_dedup_edge_cases(docs, clashing, none):
    assert line_dedup.dedup_lines(none).count() == 0
    plain, wide = line_dedup.dedup_lines(docs), line_dedup.dedup_lines(clashing)
    assert same_rows(plain, wide)
    assert wide.where(F.col("gone_id") != "x").count() == 0


def test_lines_of_every_length(spark):
    """Around the lengths at which the cuts change: an edit at every place of a line, and of one that is a character longer."""
    rng = np.random.default_rng(11)
    rows, pairs = [], 0
    for n in (20, 23, 24, 25, 31, 32, 33, 47, 48, 63, 64, 65, 100, 128, 129):
        base = "".join(rng.choice(list("abcdefghij"), n))
        lines = [base] + [base[:k] + "#" + base[k + 1 :] for k in range(0, n, 3)] + [base[:k] + base[k + 1 :] for k in range(1, n, 4)]
        order = rng.permutation(len(lines)).tolist()
        for k in order:
            rows.append((len(rows), lines[k], None, None, 0))
        pairs += len(lines)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "n_lines", "n_exact", "n_near")
    assert sorted(map(tuple, got.collect())) == brute_lines(rows)


def test_very_long_lines(spark):
    rng = np.random.default_rng(12)
    long = "".join(rng.choice(list("abcdefghij "), 120_000))
    rows = [(1, long, None, None, 0), (2, long[:70_000] + "#" + long[70_000:], None, None, 0), (3, long[:-1], None, None, 0), (4, long[:-2], None, None, 0)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_near").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 1), (3, 1), (4, 1)]


def test_variants():
    v, own = line_dedup.variants("abc")
    assert [int(x) for x in v] == [int(line_dedup.variants(s)[1]) for s in ("bc", "ac", "ab")]
    assert int(own) not in [int(x) for x in v]


def test_lines_of_repeated_doc_ids(spark):
    """Each text has a verdict of its own, in any order of the rows."""
    a, b = "one line of more than twenty characters", "another line that stands nowhere else at all"
    c = a.replace("twenty", "twentx")
    got = lambda rows: sorted(tuple(r)[:2] + tuple(r)[-3:] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    rows = [(1, a), (1, b), (2, c)]
    assert got(rows) == got(rows[::-1]) == [(1, b, 1, 0, 0), (1, a, 1, 0, 0), (2, "", 1, 0, 1)]
    rows = [(0, a), (1, a), (1, b), (1, b), (3, b)]
    assert got(rows) == got(rows[::-1]) == [(0, a, 1, 0, 0), (1, "", 1, 1, 0), (1, b, 1, 0, 0), (1, b, 1, 0, 0), (3, "", 1, 1, 0)]


def test_last_round_takes_a_pair_from_lists_of_its_first_common_element(spark, monkeypatch):
    """Texts of passages from one pool share many lists far down their orders; none of those pairs is a candidate."""
    rng = random.Random(8)
    pool = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(60)]
    rows = [(k, " ".join(rng.sample(pool, 12))) for k in range(200)]
    base = rng.sample(pool, 12)
    rows += [(900 + k, " ".join([*base, *(f"n{k}y{i}" for i in range(k))])) for k in range(8)]
    asked, first = [], jaccard_join._close

    def noted(pairs, sketches, percent):
        asked.append(pairs.count())
        return first(pairs, sketches, percent)

    monkeypatch.setattr(jaccard_join, "_close", noted)
    monkeypatch.setattr(jaccard_join, "_few_odd", lambda a, b, percent: F.lit(True))
    got = jaccard_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    want = brute_join(rows, 3, 80)
    assert sorted(map(tuple, got)) == sorted(want) and len({r[2] for r in want}) < len(rows)
    assert asked[-1] < 200
