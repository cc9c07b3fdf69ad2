"""Secret scan, token store and fertility rules against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionspark.llm import fertility, secret_scan, token_store
from motionspark.llm.queries import QUERIES
from motionspark.llm.wavelet import WaveletMatrix
from tests.llm.conftest import SCHEMA, same_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile("[\x20\x09-\x0d]+")


def base_spans(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def all_spans(text):
    spans = base_spans(text)
    for k, c in enumerate(secret_scan.CLASSES, 3):
        more = []
        for m in re.finditer(c.pattern, text):
            s = m[0]
            if not all(re.search(p, s) for p in c.needs) or any(re.search(p, s) for p in secret_scan.ALLOWED):
                continue
            t = s.lower() if c.fold else s
            high = []
            for i in range(len(t) - c.window + 1):
                total = sum(round(n * math.log2(n) * 1e6) for n in Counter(t[i : i + c.window]).values())
                if total <= c.limit:
                    high.append(i)
            if high:
                more.append((m.start() + high[0], k, m.start() + high[-1] + c.window))
        spans += [x for x in more if not any(t[0] < x[2] and x[0] < t[2] for t in spans)]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secret_scan_is_exact(spark, sf_dir, rows):
    out = {r[0]: r for r in QUERIES["op2_secret_scan"](spark, sf_dir).collect()}
    assert len(out) == len(rows)
    assert sum(bool(r["spans"]) for r in out.values()) >= 2
    for doc_id, text, *_ in rows:
        spans, r = base_spans(text or ""), out[doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert r["spans"] == joined(all_spans(text or ""))


def test_secret_scan_edge_cases(spark, docs, clashing, none):
    assert secret_scan.scan_secrets(none).count() == 0
    assert same_rows(secret_scan.scan_secrets(docs).select("doc_id", "secrets"), secret_scan.scan_secrets(clashing).select("doc_id", "secrets"))
    tricky = ["token=abc token=abcdefghijkl", "AKIA" * 8, "🙂 secret: '" + "a1" * 10, "ff" * 40_000, "Aa0" * 3000, "password=" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)] + [(9, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in secret_scan.scan_secrets(df).select("doc_id", secret_scan.spans_text(F.col("secrets"))).collect()}
    assert got == {**{i: joined(all_spans(t)) for i, t in enumerate(tricky)}, 9: ""}


@given(st.lists(st.integers(0, 1 << 17), max_size=700))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    m = WaveletMatrix.build(a, 18)
    assert m.decode(np.uint32).tolist() == ids
    for i in range(0, len(ids), 37):
        assert m.access(i) == ids[i]
        assert m.rank(ids[i], i) == ids[:i].count(ids[i])
        assert m.select(ids[i], ids[:i].count(ids[i])) == i
    assert m.rank(1 << 20, len(ids)) == 0


@pytest.fixture(scope="module")
def truth(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return {d: [*t.encode(text or "", add_special_tokens=False).ids, 2] for d, text, *_ in rows}


@pytest.fixture(scope="module")
def store(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "tokens")
    token_store.write_token_store(docs, path, VOCABULARY, tasks=5)
    return token_store.open_token_store(spark, path)


def test_token_store_round_trip(store, truth):
    want, at = [], 0
    for d in sorted(truth):
        ids = np.array(truth[d], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.document_digests(store).collect())) == want
    assert store.count() > 1


def test_token_store_lookup(store, truth):
    flat = [t for d in sorted(truth) for t in truth[d]]
    owner = [d for d in sorted(truth) for _ in truth[d]]
    rare = Counter(flat).most_common()[len(set(flat)) // 2][0]
    tokens = [2, rare, 49_999]
    assert dict(map(tuple, token_store.count_tokens(store, tokens).collect())) == {t: flat.count(t) for t in tokens}
    assert sorted(map(tuple, token_store.find_token(store, rare).collect())) == [(i, owner[i]) for i, t in enumerate(flat) if t == rare]


def test_token_store_without_doc_ids(spark, tmp_path):
    rows = [(None, "a b", None, None, 3), (5, "c", None, None, 1), (None, None, None, None, 0), (5, "c", None, None, 1), (-2, "d e", None, None, 3)]
    token_store.write_token_store(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "some"), VOCABULARY)
    store = token_store.open_token_store(spark, str(tmp_path / "some"))
    got = sorted(map(tuple, token_store.document_digests(store).select("start", "doc_id").collect()))
    assert [d for _, d in got] == [None, None, -2, 5, 5]
    assert {d for _, d in token_store.find_token(store, 2).collect()} == {None, -2, 5}


def test_token_store_edge_cases(spark, none, clashing, truth, tmp_path):
    token_store.write_token_store(none, str(tmp_path / "none"), VOCABULARY)
    assert token_store.document_digests(token_store.open_token_store(spark, str(tmp_path / "none"))).count() == 0
    token_store.write_token_store(clashing, str(tmp_path / "clash"), VOCABULARY)
    got = token_store.document_digests(token_store.open_token_store(spark, str(tmp_path / "clash")))
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {d: len(i) for d, i in truth.items()}


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 1\n\t\x85\x1c\u2028'.,é🙂 　 'sll")), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    coder = token_store.encoder(VOCABULARY)
    plain = Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(texts, coder.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def brute_base(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_rules_base_is_exact(spark, sf_dir, rows):
    out = {r["doc_id"]: r for r in QUERIES["op10_fertility_rules"](spark, sf_dir).collect()}
    assert len(out) == len(rows)
    for doc_id, text, *_ in rows:
        r = out[doc_id]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_base(text)
        assert not (r["base_failed"] and r["kept"])


def test_fertility_measures(spark, sf_dir, rows):
    import base64

    import sentencepiece
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in QUERIES["op10_fertility_rules"](spark, sf_dir).collect()}
    for doc_id, text, *_ in rows[:60]:
        words = [w for w in SPACE.split(text or "") if w]
        if not words or len(words) > 2000 or len(words[0]) > 1000:
            continue
        ids = [i for w in words for i in bpe.encode_ordinary(" " + w)]
        p = np.array(list(Counter(ids).values())) / len(ids)
        parts = [x for w in words for x in pieces.encode(w)]
        r = out[doc_id]
        assert r["chars_per_token"] == pytest.approx(sum(map(len, words)) / len(ids), abs=1e-5)
        assert r["byte_share"] == pytest.approx(np.mean([pieces.is_byte(x) for x in parts]), abs=1e-5)
        assert r["token_entropy"] == pytest.approx(float(-(p * np.log2(p)).sum()) / math.log2(len(ids)) if len(ids) > 1 else 0, abs=1e-5)


def brute_bands(rows):
    """(low, high) of each measure for each (language, power of two of words), from rows that pass the base rules."""

    def quartiles(values):
        bins = sorted(math.floor(v / fertility.BIN) for v in values)
        n = len(bins)
        return bins[-(-n // 4) - 1] * fertility.BIN, (bins[-(-3 * n // 4) - 1] + 1) * fertility.BIN

    out, k = {}, fertility.PRIOR
    size = lambda r: math.floor(math.log2(max(1, r["n_words"])))
    for lang, length in {(r["lang"], size(r)) for r in rows}:
        groups = [[r for r in rows if r["lang"] == lang and size(r) == length], [r for r in rows if r["lang"] == lang], rows]
        for m in fertility.MEASURES:
            own, wide, every = (quartiles([r[m] for r in g]) for g in groups)
            drawn = [(len(groups[0]) * a + k * ((len(groups[1]) * b + k * c) / (len(groups[1]) + k))) / (len(groups[0]) + k) for a, b, c in zip(own, wide, every, strict=True)]
            slack = max(fertility.REACH * (drawn[1] - drawn[0]), fertility.LEAST_REACH)
            out[lang, length, m] = drawn[0] - slack, drawn[1] + slack
    return out, size


def test_verdict_is_that_of_the_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r.asDict() | {"lang": langs[r["doc_id"]]} for r in fertility.quality_rules(docs, *p).collect()]
    found, size = brute_bands([r for r in rows if not r["base_failed"]])
    edge = lambda x, b: min(abs(x - b[0]), abs(x - b[1])) < 1e-9
    rejected = 0
    for r in rows:
        limits = [] if r["base_failed"] else [(r[m], found[r["lang"], size(r), m]) for m in fertility.MEASURES]
        if not any(edge(*x) for x in limits):
            assert r["kept"] == (not r["base_failed"] and all(b[0] <= x <= b[1] for x, b in limits))
            rejected += not r["base_failed"] and not r["kept"]
    assert 0 < rejected < len(rows) / 10


def test_fertility_rejects_noise_and_keeps_prose(spark, none, docs, clashing):
    p = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    words = "the and of that this water paper light house where could about other people would their there which".split()
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(200)), "en", "s", 0) for k in range(150)]
    rows.append((999, " ".join("".join(chr(int(c)) for c in rng.integers(0x13000, 0x13400, 5)) for _ in range(200)), "en", "s", 0))
    out = fertility.quality_rules(spark.createDataFrame(rows, SCHEMA), *p)
    kept = {r["doc_id"]: r["kept"] for r in out.where("not base_failed").collect()}
    assert kept.pop(999) is False
    assert all(kept.values())
    assert fertility.quality_rules(none, *p).count() == 0
    assert same_rows(fertility.quality_rules(docs, *p), fertility.quality_rules(clashing, *p))
    assert fertility.quality_rules(docs.drop("lang"), *p).count() == docs.count()
