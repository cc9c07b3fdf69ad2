"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages.  Terms are the benchmark's own words without edge punctuation and
case; TF-IDF weights them, with document frequencies over all passages and very frequent terms left out.
A randomised SVD of the matrix of all passages, with the benchmark items stacked below at equal total
weight, gives the latent space: tasks sum up Y = A^T A Omega for a random Omega over their passages, and the
small matrices Omega^T Y and Y hold a Nystroem decomposition of A^T A.  Its rank is the least one that keeps
``ENERGY`` of the decomposition's energy and of the mean item, all that was drawn if none does.

Passages and items go through that space, and a passage is a candidate for an item if the cosine of their
latent vectors is high.  Candidates are checked by the longest common subsequence of words: nearly the whole
item, or much of it together with its answer, in order within a stretch around the passage, is a leak.

A space serves a block of ``ITEMS`` items.  The words of the documents become numbers of terms once for each
``BLOCKS`` of them, and the further passes read these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.text import slices, word_codes

WINDOW, STRIDE = 64, 32
ITEMS, BLOCKS = 240, 20  # items of a latent space, spaces that a task holds at a time
EXTRA = 64  # columns drawn beyond the number of items
ENERGY = 0.95
MAX_SHARE = 0.002  # terms in a larger share of the passages are left out
LEAST_TERMS = 12  # unless an item would keep fewer
COSINE = 0.4
WHOLE, PART, ANSWER = 0.8, 0.6, 0.8
EDGE = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"
ROWS = 1000  # passages taken through a space together


def words(data: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGE) for x in data.lower().split()) if w]


@dataclass
class Items:
    """Items of a block.  ``terms`` numbers the words of all blocks of a pass, ``local`` gives a word's number in this block or -1."""

    ids: list[int]
    terms: dict[bytes, int]
    codes: list[list[int]]
    answers: list[list[int]]
    local: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @property
    def size(self) -> int:
        return int(self.local.max(initial=-1)) + 1

    @classmethod
    def of(cls, rows: list[tuple], terms: dict[bytes, int] | None = None) -> Items:
        terms = {} if terms is None else terms
        ids, codes, answers = [], [], []
        for item_id, text, answer in rows:
            w = words((text or "").encode())
            if w:
                ids.append(item_id)
                codes.append([terms.setdefault(x, len(terms)) for x in w])
                a = words((answer or _last_sentence(text)).encode())
                answers.append([terms.setdefault(x, len(terms)) for x in a])
        return cls(ids, terms, codes, answers)

    def number(self) -> Items:
        """With the block's own numbers, once all blocks' words are known."""
        used = np.unique([t for part in (self.codes, self.answers) for c in part for t in c]).astype(np.int64)
        local = np.full(len(self.terms), -1, np.int32)
        local[used] = np.arange(len(used))
        renamed = [[local[c].tolist() for c in part] for part in (self.codes, self.answers)]
        return Items(self.ids, {}, *renamed, local)


def _last_sentence(text: str) -> str:
    parts = [s for s in text.replace("\n", " ").replace("!", ".").replace("?", ".").split(".") if s.strip()]
    return parts[-1] if parts else ""


class _Terms(dict):
    """Raw word -> term or -1; words of punctuation only are -2."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        w = word.strip(EDGE)
        self[word] = value = self.terms.get(w, -1) if w else -2
        return value


def _coded(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, codes): the words of each text as terms or -1, four bytes each, in a table that all passes read."""
    shared_in = docs.sparkSession.sparkContext.broadcast(terms)

    def code(batches):
        cache = _Terms(shared_in.value)
        for b in slices(batches, 1):
            offsets, codes, found = word_codes(b.column(1))
            term = np.fromiter(map(cache.__getitem__, found), np.int32, len(found))
            flat = term[codes] if len(codes) else codes.astype(np.int32)
            full = flat > -2
            ends, flat = np.concatenate([[0], np.cumsum(full)])[offsets], flat[full]
            data = [flat[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "codes"])

    return shared.keep(docs.mapInArrow(code, "doc_id long, codes binary"), "terms")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, terms of each document)."""
    for b in slices(batches, 1):
        yield b.column(0).to_pylist(), [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]


def _passages(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """Sparse counts of known terms: (passage, term, ...) pairs in order with their count, the number of
    passages, and of each passage its document and start."""
    n = np.array([len(c) for c in codes], np.int64)
    per_doc = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(codes)), n)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    known = np.flatnonzero(flat >= 0)
    doc, at, term = doc[known], at[known], flat[known].astype(np.int64)
    near = at // STRIDE
    passage = [np.minimum(near - k, per_doc[doc] - 1) for k in range(WINDOW // STRIDE)]
    inside = [(near >= k) & (near - k <= per_doc[doc] - 1) for k in range(WINDOW // STRIDE)]
    keys = np.concatenate([(first[doc] + p)[ok] << 32 | term[ok] for p, ok in zip(passage, inside, strict=True)]) if len(known) else np.zeros(0, np.int64)
    keys, tf = np.unique(keys, return_counts=True)
    total = int(first[-1])
    owner = np.repeat(np.arange(len(codes)), per_doc)
    return keys, tf, total, owner, (np.arange(total) - first[owner]) * STRIDE if total else np.zeros(0, np.int64)


def _in_block(codes: list[np.ndarray], items: Items) -> list[np.ndarray]:
    """The texts' words by their numbers in a block."""
    own = np.append(items.local, -1)  # the last is for words of no block
    return [own[c] for c in codes]


def _frequencies(docs: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages that hold each of the terms, and all passages."""

    def count(batches):
        seen, passages = np.zeros(terms, np.int64), 0
        for _, codes in _batches(batches):
            keys, _, total, _, _ = _passages(codes)
            seen += np.bincount(keys & 0xFFFFFFFF, minlength=len(seen))
            passages += total
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], passages))], ["term", "n"])

    got = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(terms, np.int64), 0
    for t, n in zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True):
        if t < 0:
            total = n
        else:
            out[t] = n
    return out, total


def _weights(items: Items, df: np.ndarray, passages: int) -> np.ndarray:
    """IDF of each term, 0 for those left out."""
    kept = df <= max(MAX_SHARE * passages, 1)
    for codes in items.codes:
        own = np.unique(codes)
        if kept[own].sum() < LEAST_TERMS:
            kept[own[np.argsort(df[own], kind="stable")[:LEAST_TERMS]]] = True
    return np.where(kept, np.log((1 + passages) / (1 + df)) + 1, 0).astype(np.float32)


def _rows(keys: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows: (passage of each row, start of each row, term, weight)."""
    term = keys & 0xFFFFFFFF
    use = idf[term] > 0
    keys, term, weight = keys[use], term[use], (1 + np.log(tf[use])).astype(np.float32) * idf[term[use]]
    passage = keys >> 32
    start = np.flatnonzero(np.diff(passage, prepend=-1))
    if len(start):
        weight = weight / np.repeat(np.sqrt(np.add.reduceat(weight**2, start)), np.diff(start, append=len(passage)))
    return passage[start], start, term, weight


def _item_matrix(items: Items, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.ids), len(idf)), np.float32)
    for i, codes in enumerate(items.codes):
        t, n = np.unique(codes, return_counts=True)
        out[i, t] = (1 + np.log(n)) * idf[t]
        out[i] /= max(1e-9, float(np.linalg.norm(out[i])))
    return out


def _project(a: int, start: np.ndarray, term: np.ndarray, weight: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(terms, weights, rows through the space, end of the terms) of up to ROWS rows from row ``a`` on."""
    lo, hi = start[a], start[a + ROWS] if a + ROWS < len(start) else len(term)
    own, w = term[lo:hi], weight[lo:hi, None]
    return own, w, np.add.reduceat(w * space[own], start[a : a + ROWS] - lo, axis=0), hi


def _latent(docs: DataFrame, blocks: list[Items], idfs: list[np.ndarray], seed: int = 9) -> list[np.ndarray]:
    """For each block orthonormal right singular vectors (terms x rank) of the passages stacked with its items."""
    draw = lambda x: np.random.default_rng(seed).standard_normal((x.size, min(x.size, len(x.ids) + EXTRA))).astype(np.float32)
    omegas = [draw(x) for x in blocks]
    shared_in = docs.sparkSession.sparkContext.broadcast((blocks, idfs, omegas))

    def project(batches):
        blocks, idfs, omegas = shared_in.value
        ys, norms = [np.zeros(o.shape, np.float32) for o in omegas], [0] * len(blocks)
        for _, codes in _batches(batches):
            for k, (items, idf, omega, y) in enumerate(zip(blocks, idfs, omegas, ys, strict=True)):
                keys, tf, _, _, _ = _passages(_in_block(codes, items))
                owners, start, term, weight = _rows(keys, tf, idf)
                for a in range(0, len(start), ROWS):
                    own, w, row, hi = _project(a, start, term, weight, omega)
                    back = w * np.repeat(row, np.diff(start[a : a + ROWS], append=hi), axis=0)
                    order = np.argsort(own, kind="stable")
                    cut = np.flatnonzero(np.diff(own[order], prepend=-1))
                    y[own[order][cut]] += np.add.reduceat(back[order], cut, axis=0)
                norms[k] += len(owners)
        for k, (y, norm) in enumerate(zip(ys, norms, strict=True)):
            some = np.flatnonzero(np.abs(y).sum(axis=1))
            data = [*(r.tobytes() for r in y[some]), np.full(y.shape[1], norm, np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), k, np.int32)), pa.array(np.append(some, -1)), pa.array(data, pa.binary())], ["block", "term", "y"])

    def add(batches):
        """Sums rows of a term over all tasks."""
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                v, key = np.frombuffer(data, np.float32), tuple(key)
                sums[key] = sums[key] + v if key in sums else v.astype(np.float64)
        ks, ts = zip(*sums, strict=True) if sums else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ts, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["block", "term", "y"])

    kind = "block int, term long, y binary"
    parts = docs.mapInArrow(project, kind).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "term")
    got = parts.mapInArrow(add, kind).toArrow()
    ys, passages = [np.zeros(o.shape) for o in omegas], [0.0] * len(blocks)
    for k, t, data in zip(*(got.column(c).to_pylist() for c in ("block", "term", "y")), strict=True):
        v = np.frombuffer(data, np.float32)
        if t < 0:
            passages[k] = float(v[0])
        else:
            ys[k][t] = v
    return [_space(_item_matrix(x, idf).astype(np.float64), y, o, n) for x, idf, y, o, n in zip(blocks, idfs, ys, omegas, passages, strict=True)]


def _space(items: np.ndarray, y: np.ndarray, omega: np.ndarray, passages: float) -> np.ndarray:
    """Nystroem decomposition of A^T A from Y = A^T A Omega, with a shift that keeps the factor definite."""
    y = y + max(1.0, passages / max(1, len(items))) * (items.T @ (items @ omega))
    shift = 1e-7 * max(1e-12, float(np.linalg.norm(y)))
    y = y + shift * omega
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    use = values > 1e-12 * max(1e-300, values[-1])
    u, s, _ = np.linalg.svd((y @ vectors[:, use]) / np.sqrt(values[use]), full_matrices=False)
    drawn = np.cumsum(s**2) / max(1e-300, float((s**2).sum()))
    kept = np.cumsum((items @ u) ** 2, axis=1).mean(axis=0) if len(items) else drawn
    enough = np.flatnonzero((drawn >= ENERGY) & (kept >= ENERGY))
    return u[:, : int(enough[0]) + 1 if len(enough) else len(s)].astype(np.float32)


def lcs(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the pattern."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << m) - 1
    v = full
    for c in text:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return m - v.bit_count()


FOUND = "doc_id long, item long, cosine double, overlap double, answer double"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))


def _own(items: Items) -> np.ndarray:
    """Of each item the terms that it holds; the last place is for all other words."""
    out = np.zeros((len(items.ids), items.size + 1), bool)
    for i, c in enumerate(items.codes):
        out[i, c] = True
    return out


def _search(docs: DataFrame, blocks: list[Items], idfs: list[np.ndarray], spaces: list[np.ndarray]) -> DataFrame:
    latents = [_unit(_item_matrix(x, idf) @ space).astype(np.float32) for x, idf, space in zip(blocks, idfs, spaces, strict=True)]
    shared_in = docs.sparkSession.sparkContext.broadcast((blocks, idfs, spaces, latents))

    def leaks(items, own, idf, space, latent, codes):
        """{(text, item): (overlap, answer, cosine)} of the best candidates that hold."""
        keys, tf, _, owner, begin = _passages(codes)
        passage, start, term, weight = _rows(keys, tf, idf)
        lengths = [len(c) for c in items.codes]
        best: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(start), ROWS):
            score = _unit(_project(a, start, term, weight, space)[2]) @ latent.T
            for r, i in zip(*np.nonzero(score >= COSINE), strict=True):
                p = passage[a + r]
                d, m = int(owner[p]), lengths[i]
                text = codes[d][max(0, begin[p] - m) : begin[p] + WINDOW + m]
                if np.count_nonzero(own[i][text]) < PART * m:  # no subsequence is longer than the words in common
                    continue
                text = text.tolist()
                whole = lcs(items.codes[i], text) / m
                if whole >= PART:
                    answer = lcs(items.answers[i], text) / max(1, len(items.answers[i]))
                    if whole >= WHOLE or answer >= ANSWER:
                        found = (whole, answer, float(score[r, i]))
                        best[d, int(i)] = max(found, best.get((d, int(i)), found))
        return best

    def search(batches):
        blocks, *rest = shared_in.value
        words_of = [_own(x) for x in blocks]
        for ids, codes in _batches(batches):
            out = []
            for items, *of in zip(blocks, words_of, *rest, strict=True):
                best = leaks(items, *of, _in_block(codes, items))
                out += [(ids[d], items.ids[i], c, w, x) for (d, i), (w, x, c) in sorted(best.items())]
            if out:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], FOUND.replace(",", " ").split()[::2])

    return docs.mapInArrow(search, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer): documents of ``docs`` (doc_id, text, ...) that hold an item of
    ``benchmark`` (item_id, text, optional answer; without one the last sentence).

    overlap is the share of the item's words found in order, answer that of its answer's words.  Null and
    empty texts and items match nothing.  Repeated rows of docs give repeated rows.  A null doc_id stays
    null.  Other columns are not read.  Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    n = max(1, -(-listed.count() // ITEMS))
    out = spark.createDataFrame([], FOUND)
    listed = shared.keep(listed.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")
    for k in range(0, n, BLOCKS):
        # A pass has BLOCKS * ITEMS items on average; only these reach the driver.
        given = listed.where(F.col("block").between(k, k + BLOCKS - 1)).orderBy("item_id", "text").toLocalIterator()
        rows: dict[int, list] = {}
        for *item, block in given:
            rows.setdefault(block, []).append(tuple(item))
        terms: dict[bytes, int] = {}
        blocks = [x for x in [Items.of(rows[i], terms) for i in sorted(rows)] if x.ids]
        if blocks:
            blocks = [x.number() for x in blocks]
            coded = _coded(docs, terms)
            df, passages = _frequencies(coded, len(terms))
            idfs = [_weights(x, df[x.local >= 0], passages) for x in blocks]
            out = out.unionByName(shared.keep(_search(coded, blocks, idfs, _latent(coded, blocks, idfs)), "found"))
            shared.forget(coded)
    return out.withColumnRenamed("item", "item_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; every column stays.

    Each row is judged by its own text, also where a doc_id is null or repeated.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    leaked = shared.keep(find_leaks(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    return docs.join(leaked, row == leaked.leaked, "left_anti")
