"""Archives, hard negatives and spelling variants: round trips, damaged input and brute force."""

from __future__ import annotations

import gzip
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from motionspark.llm import hard_negatives, spelling, warc
from tests.llm.conftest import messy_pages, messy_vectors

PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- archives


@pytest.mark.parametrize("segment_bytes", [200, 8192])
def test_payloads_come_back(spark, tmp_path, segment_bytes):
    pages = [p for p in messy_pages() if segment_bytes > 200 or len(p[2] or "") < 20_000]
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(4), str(tmp_path / "a"), segment_bytes)
    got = warc.read_archives(spark, str(tmp_path / "a"))
    whole = warc.page_records(got).join(got.where("payload is not null").selectExpr("payload_sha1", "payload").distinct(), warc.F.col("payload_digest") == warc.F.col("payload_sha1"))
    rows = whole.select("page_id", "payload", "intact", "payload_bytes").collect()
    assert all(r["intact"] and r["payload_bytes"] == len(r["payload"]) for r in rows)
    assert Counter((r["page_id"], bytes(r["payload"])) for r in rows) == Counter((p[0], (p[2] or "").encode()) for p in pages)
    kinds = {r["t"] for r in got.selectExpr("headers['warc-segment-number'] IS NOT NULL AS t").collect()}
    assert kinds == {True, False}


def test_archives_are_warc_files(spark, tmp_path):
    """Every record in every file: version, head, a block of the stated length, two line ends."""
    pages = [p for p in messy_pages() if len(p[2] or "") < 5000]
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), str(tmp_path / "a"), 300)
    n, ids = 0, Counter()
    for f in (tmp_path / "a").glob("part-*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            found = dict(x.split(": ", 1) for x in lines[1:])
            length = int(found["Content-Length"])
            assert lines[0] == "WARC/1.1" and rest[length : length + 4] == b"\r\n\r\n" and length <= 300
            assert (found["WARC-Type"] == "continuation") == ("WARC-Segment-Origin-ID" in found)
            ids[found["WARC-Record-ID"]] += found["WARC-Type"] != "continuation"
            data, n = rest[length + 4 :], n + 1
    assert sum(ids.values()) == len(pages) < n


def written(path, *records: bytes) -> str:
    path.mkdir()
    (path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    return str(path)


def record(block: bytes, *lines: str, length: int | None = None, version: str = "1.0") -> bytes:
    head = [f"WARC/{version}", *lines, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    chunks = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5;x=y\r\nhello\r\nA\r\n 1234\r\n678\r\n0\r\n\r\n"
    seg = lambda n, b, *more, origin="<o>": record(b, "WARC-Type: continuation", f"WARC-Record-ID: <c{n}>", f"WARC-Segment-Origin-ID: {origin}", f"WARC-Segment-Number: {n}", *more)
    path = written(
        tmp_path / "f",
        record(b"software: x\r\n", "WARC-Type: warcinfo", "WARC-Record-ID: <w>"),
        record(b"whole \xff\x00", "warc-type: resource", "WARC-Record-ID: <r>", version="1.1"),
        record(chunks, "WARC-Type: response", "WARC-Record-ID: <k>"),
        record(chunks[:-10], "WARC-Type: response", "WARC-Record-ID: <broken>"),
        record(b"sum", "WARC-Type: resource", "WARC-Record-ID: <digest>", "WARC-Payload-Digest: sha1:" + "0" * 40),
        seg(3, b"ef", "WARC-Segment-Total-Length: 6"),
        seg(2, b"cd"),
        record(b"ab", "WARC-Type: resource", "WARC-Record-ID: <o>", "WARC-Segment-Number: 1"),
        record(b"ab", "WARC-Type: resource", "WARC-Record-ID: <p>", "WARC-Segment-Number: 1"),
        seg(3, b"ef", "WARC-Segment-Total-Length: 6", origin="<p>"),
        seg(2, b"zz", "WARC-Segment-Total-Length: 2", origin="<q>"),
        record(b"WARC/1.0 WARC/1.1\r\nx", "WARC-Type: resource", "WARC-Record-ID: <m>"),
        record(b"end", "WARC-Type: resource", "WARC-Record-ID: <short>", length=400),
    )
    got = {r["record_id"]: (bytes(r["payload"]), r["intact"]) for r in warc.read_archives(spark, path).collect()}
    assert got == {
        "<w>": (b"software: x\r\n", True), "<r>": (b"whole \xff\x00", True), "<k>": (b"hello 1234\r\n678", True), "<broken>": (b"hello 1234\r\n", False), "<digest>": (b"sum", False),
        "<o>": (b"abcdef", True), "<p>": (b"abef", False), "<q>": (b"zz", False), "<m>": (b"WARC/1.0 WARC/1.1\r\nx", True), "<short>": (b"end\r\n\r\n", False),
    }


def test_empty_and_clashing_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write_archives(none, str(tmp_path / "none"))
    assert warc.page_records(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0
    more = spark.createDataFrame(messy_pages()[:20], PAGES).selectExpr("*", *(f"'x' AS {c}" for c in ("payload", "first", "same", "block", "k", "last", "id", "original", "value", "sha1")))
    warc.write_archives(more, str(tmp_path / "more"))
    assert warc.page_records(warc.read_archives(spark, str(tmp_path / "more"))).count() == 20


# --- hard negatives


def mined(rows, every=50, positives=5, negatives=3):
    """Row by row, with Python's integers."""
    held = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    last = lambda x: (x is None, x or 0)
    out = Counter()
    for a, (aid, alabel, av) in enumerate(held):
        if aid is None or aid % every:
            continue
        scored = [(sum(p * q for p, q in zip(av, v)), i, lab) for k, (i, lab, v) in enumerate(held) if k != a]  # noqa: B905
        order = lambda x: (-x[0], last(x[1]))
        for p, pid, _ in sorted((x for x in scored if x[2] == alabel), key=order)[:positives]:
            low = sorted((x for x in scored if x[2] != alabel and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:negatives]
            out.update((aid, pid, k, nid, p, n) for k, (n, nid, _) in enumerate(low, 1))
    return out


def mine(df, **more):
    return Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(df, warc.F.col("vec_id") % 50 == 0, **more).collect())


@pytest.mark.parametrize("sizes", [(1024, 256, 32), (16, 3, 2)])
def test_hard_negatives_of_messy_vectors(spark, monkeypatch, sizes):
    """Also with small tiles, and with vectors of different lengths."""
    for name, size in zip(("ROWS", "ANCHORS", "CHUNK_DIMS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(3)
    rows = messy_vectors() + [(1000 + k, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 3, 9, 20]))], rng.choice([0, 1])) for k in range(80)]
    want = mined(rows)
    assert len(want) > 100
    assert mine(spark.createDataFrame(rows, VECTORS).repartition(4)) == want


def test_hard_negatives_of_one_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-0.4, 0.4) for _ in range(8)], 0 if k % 20 else k % 3) for k in range(600)]
    assert mine(spark.createDataFrame(rows, VECTORS), positives=3, negatives=2) == mined(rows, positives=3, negatives=2)


def test_hard_negatives_without_rows(spark):
    assert not mine(spark.createDataFrame([], VECTORS))
    assert not mine(spark.createDataFrame([(1, [0.5], 0), (2, [0.5], 1)], VECTORS))
    assert not mine(spark.createDataFrame([(50, [0.5], 0), (2, None, 1), (3, [3e38], 1)], VECTORS))


def test_hard_negatives_shuffle_neither_panels_nor_scores(spark, monkeypatch):
    """Four times the rows make sixteen times the tiles, but no more than about four times the shuffled bytes."""
    for name, size in (("ROWS", 16), ("ANCHORS", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(5)
    every = [(k, [rng.uniform(-0.4, 0.4) for _ in range(64)], k % 3) for k in range(1600)]

    def shuffled(rows):
        written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
        before = written()
        assert mine(spark.createDataFrame(rows, VECTORS)) == mined(rows)
        return written() - before

    small = shuffled(every[:400])
    assert 0 < shuffled(every) < 6 * small


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (100, 2**28):
        a, b = rng.integers(-most, most, (7, 5)), rng.integers(-most, most, (9, 8))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]  # noqa: B905
        assert hard_negatives.product(a, b).tolist() == want


# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(docs, least_length=5, least_count=3, thinned=97):
    words = Counter()
    for doc_id, text in docs:
        for run in warc_runs(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % thinned == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def warc_runs(text):
    import re

    return re.findall("[A-Za-zÀ-ÿ]+", text)


def noisy(n=300, seed=2):
    rng = random.Random(seed)
    letters = "abcdeéèÿÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(40)] + ["aaaaaa", "aaaaa", "ababab", "bababa", "Straße", "x" * 70, "y" * 64, "z" * 65]

    def word():
        w = list(rng.choice(base))
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = rng.choice(["", rng.choice(letters)])
        return "".join(w).capitalize() if rng.random() < 0.2 else "".join(w)

    docs = [(k, " ".join(word() for _ in range(60)) + ".42é×") for k in range(n)]
    return docs + [(None, "Aaaaaa " * 5), (None, None), (7, ""), (8, "  1 2 3"), (9, docs[0][1]), (9, docs[0][1])]


@pytest.mark.parametrize("thinned", [97, 3])
def test_spelling_variants(spark, thinned):
    docs = noisy()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in spelling.group_spellings(df, thinned=thinned).collect()}
    want = grouped(docs, thinned=thinned)
    assert got == want and any(r[2] != r[1] for r in want if r[1]) and any(len(r[0]) > 64 and r[1] for r in want)


def test_long_ways_and_long_words(spark):
    """A chain of forms, and words of 30 000 letters that differ in one."""
    chain = ["abcdefgh"[:k] + "zzzzz" + "q" * 3 for k in range(1, 8)]
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    other = long[:12_345] + "x" + long[12_346:]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 3**k)) + f" {long}" * 3 + f" {other}" * 7
    got = {r["word"]: r for r in spelling.group_spellings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {got[w]["root"] for w in chain} == {chain[-1]} and got[chain[0]]["form"] == chain[1]
    assert got[long]["form"] == got[long]["root"] == other and got[other]["n_near"] == 1


def test_keys_and_words_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Keys are many times the words that they come from, and files of words are compressed: neither is broadcast, nor are long words that are not few."""
    words = spark.createDataFrame([(k, f"word{'abcdefgh'[k % 8]}{k}", 5) for k in range(50)] + [(50, "z" * 70, 9), (51, "z" * 71, 3)], "word_id long, word string, n long")
    formed = spark.createDataFrame([("abcde", "abcdf"), ("abcdf", "abcdg"), ("abcdg", None)], "word string, form string")
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near, rooted = spelling.near_words(words), spelling.with_roots(formed)
    keys = lambda text: [k for k in text.splitlines() if "Join" in k and "[key#" in k]
    assert len(keys(plans(near))) == 1 and "SortMergeJoin" in keys(plans(near))[0]
    assert "Broadcast" not in plans(rooted) and {r["root"] for r in rooted.collect()} == {"abcdg"}
    monkeypatch.setattr(spelling, "FEW_BYTES", 0)
    assert "Broadcast" not in plans(spelling.near_words(words))
    found = {(r["word_id"], r["other"]) for r in spelling.near_words(words).collect()}
    assert found == {(r["word_id"], r["other"]) for r in near.collect()} and (50, "z" * 71) in found and (51, "z" * 70) in found


def test_words_of_no_text(spark):
    schema = "doc_id long, text string, word string, n long, key long, run string"
    assert spelling.group_spellings(spark.createDataFrame([], schema)).count() == 0
    assert spelling.group_spellings(spark.createDataFrame([(1, None, "a", 1, 2, "b"), (2, "one Two", "a", 1, 2, "b")], schema), 3, 1).count() == 2


def test_hashes_of_deletions():
    words = ["", "a", "aa", "abc", "éé", "abcabc", "aabb", "cab"]
    of, keys = spelling.deletion_hashes(words)
    strings = [[w, *sorted({w[:k] + w[k + 1 :] for k in range(len(w))})] for w in words]
    assert Counter(of.tolist()) == Counter({k: len(s) for k, s in enumerate(strings)})
    named = {}
    for k, s in enumerate(strings):
        mine = set(keys[of == k].tolist())
        assert len(mine) == len(s)
        for j, t in enumerate(strings):
            named[k, j] = len(mine & set(keys[of == j].tolist())) == len(set(s) & set(t))
    assert all(named.values())
