"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary texts, with absolute discounting:

    P_k(w | v) = (1 - lambda(v)) max(c_k(v w) - D, 0) / Z_k(v) + lambda(v) P_k(w)
    P_k(w)     = (1 - gamma)     max(N_k(. w) - D, 0) / Z_k    + gamma     P_0(w)

c_k counts pairs in the labelled texts of class k and N_k(. w) the distinct words before w there; the Z are
the sums of the discounted counts.  What both back off to is shared and comes from the whole corpus, labelled
or not: P_0 is its unigram law, gamma the share of its words that the discount takes away, and lambda(v) the
share of v's followers that it takes away, from the number of distinct ones.  An expression seen up to D times
in a class counts there as unseen, so a word rare in both says nothing, and the class with fewer texts has no
bias from its larger share of unseen words.

Words count under their full 64-bit hash, in a table with a row for each word of the corpus.  In a text's
ratio P_0(w) cancels unless a discounted count of w is left in a class, and lambda(v) unless one of a pair
after v is.  So followers are told apart for such v alone, under 40 bits of their hash beside the whole of v,
and of the words' table tasks receive the rows of such words: their number is bounded by the labelled texts,
and the ratios are those of the whole table.
A text's features are length-normalised log-likelihood ratios: of the whole text, and of its best windows
of a few lengths, since a long text may be toxic in one place only.  A logistic curve over them, fitted on
labelled texts that the counts have not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from motionspark.llm import shared
from motionspark.llm.text import MULTIPLIERS, hashes, mix, slices, word_codes

WINDOWS = (1, 3, 8, 24, 64)
DISCOUNT = 3.0  # estimated from counts of ones and twos it is 0.85: held-out AUC 0.93 in place of 0.995
TOXIC_FROM = 0.7
BLOCK = 1_500_000  # words or pairs that a task counts together
PARTS = 4  # of the labelled texts' pairs, counted one after the other, so that a quarter of them is on disk at a time
EDGE = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"
START = np.uint64(0)  # stands before the first word
ORDINARY, TOXIC = 1, 2
FOLLOWER_BITS = 40


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``word_codes`` without punctuation at the words' ends; several codes may stand for one word."""
    offsets, codes, words = word_codes(column)
    return offsets, codes, [w.strip(EDGE) for w in words]


def _before(offsets: np.ndarray, w: np.ndarray, start) -> np.ndarray:
    """What stands before each word; ``start`` before the first of a text."""
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[offsets[:-1][np.diff(offsets) > 0]] = start
    return v


def _pairs(texts: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(kind, v, w, n) of (kind, text): how often w follows v; of ``parts`` parts of all w the one numbered ``part``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            offsets, codes, words = _words(b.column(1))
            if not len(codes):
                continue
            w = hashes(words)[codes]
            v, kind = _before(offsets, w, START), np.repeat(b.column(0).to_numpy(), np.diff(offsets))
            if parts > 1:
                mine = w % np.uint64(parts) == part
                v, w, kind = v[mine], w[mine], kind[mine]
            _, first, n = np.unique(mix(v * MULTIPLIERS[0] + w * MULTIPLIERS[1] + kind.astype(np.uint64)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind[first].astype(np.int32), v[first].view(np.int64), w[first].view(np.int64), n.astype(np.int64))], ["kind", "v", "w", "n"])

    return texts.mapInArrow(count, "kind int, v long, w long, n long").groupBy("kind", "v", "w").agg(F.sum("n").alias("n"))


def corpus_words(docs: DataFrame) -> DataFrame:
    """(key, n): how often each word of the corpus stands in it; START once for each text with a word."""

    def count(batches):
        found, size = [], 0

        def flush():
            keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, back = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, n).astype(np.int64))], ["key", "n"])

        for b in slices(batches, 0):
            offsets, codes, words = _words(b.column(0))
            keys, n = np.append(hashes(words), START), np.append(np.bincount(codes, minlength=len(words)), np.count_nonzero(np.diff(offsets)))
            found.append((keys[n > 0], n[n > 0]))
            size += len(keys)
            if size >= BLOCK:
                yield flush()
                found, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, wanted: np.ndarray, other: int) -> np.ndarray:
    """Places of hashes among sorted keys; ``other`` for those that are not there."""
    if not len(keys):
        return np.full(len(wanted), other, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, other).astype(np.int64)


def corpus_followers(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """(context, m): how many distinct words follow each of the contexts (hashes) in the corpus; contexts by their place."""
    shared_in = docs.sparkSession.sparkContext.broadcast(contexts)

    def find(batches):
        places = shared_in.value
        start, found, size = _found(places, np.array([START]), -1)[0], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["pair"])
        for b in slices(batches, 0):
            offsets, codes, words = _words(b.column(0))
            if not len(codes):
                continue
            h = hashes(words)
            place = _found(places, h, -1)
            v = _before(offsets, place[codes], start)
            w = (h & np.uint64((1 << FOLLOWER_BITS) - 1)).astype(np.int64)[codes]
            found.append(np.unique(v[v >= 0] << FOLLOWER_BITS | w[v >= 0]))
            size += len(found[-1])
            if size >= BLOCK:
                yield flush()
                found, size = [], 0
        if found:
            yield flush()

    pairs = docs.select("text").mapInArrow(find, "pair long").distinct()
    return pairs.groupBy(F.shiftright("pair", FOLLOWER_BITS).alias("context")).agg(F.count(F.lit(1)).alias("m"))


@dataclass
class Models:
    """Of the words that tell the classes apart, one more row for all others, and of each class (ordinary, toxic):
    P_k(w), the sums Z_k(v) and the discounted pair counts; of both: lambda(v)."""

    keys: np.ndarray
    word: list[np.ndarray]
    total: list[np.ndarray]
    backoff: np.ndarray
    pair_keys: np.ndarray
    pair: list[np.ndarray]

    def probability(self, k: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P_k(w | v) by the places of v and w, for k 0 (ordinary) and 1 (toxic); of all other words together at the last place."""
        key = v * len(self.backoff) + w
        at = np.searchsorted(self.pair_keys, key)
        at[self.pair_keys[at] != key] = len(self.pair_keys) - 1
        unigram, total, back = self.word[k][w], self.total[k][v], self.backoff[v]
        direct = np.where(total > 0, self.pair[k][at] / np.maximum(total, 1e-6), unigram)
        return (1 - back) * direct + back * unigram

    def log_ratio(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log P_toxic(w | v) - log P_ordinary(w | v)."""
        return np.log(self.probability(1, v, w)) - np.log(self.probability(0, v, w))


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys, wanted.view(np.uint64))


def _seen(counts: DataFrame, discount: float) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Of class pairs (kind, v, w, n), with all those before a w or none: words (key, o, t) by their distinct words before, pairs
    (v, w, o, t) by their counts, where a discounted one is left, and the sums of the words' o and t."""
    d = F.lit(discount)
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0)).cast("double")
    over = lambda c: F.greatest(F.col(c) - d, F.lit(0.0))
    before = counts.groupBy(F.col("w").alias("key")).agg(of(ORDINARY, 1).alias("o"), of(TOXIC, 1).alias("t")).select("key", over("o").alias("o"), over("t").alias("t"))
    before = before.where("o > 0 OR t > 0").toArrow()
    often = counts.where(F.col("n") > d).groupBy("v", "w").agg(of(ORDINARY, over("n")).alias("o"), of(TOXIC, over("n")).alias("t")).toArrow()
    return before, often, np.array([before.column(c).to_numpy().sum() for c in ("o", "t")])


def fit_models(docs: DataFrame, words: DataFrame, counts: DataFrame | list[DataFrame], discount: float) -> Models:
    """From the corpus, its words (key, n) and the class pairs (kind, v, w, n), or parts of them by w, each of which is counted on its own."""
    d = F.lit(discount)
    parts = []
    for c in counts if isinstance(counts, list) else [counts]:
        ngrams = shared.keep(c, "ngrams")
        parts.append(_seen(ngrams, discount))
        shared.forget(ngrams)
    before, often = (pa.concat_tables([p[i] for p in parts]) for i in (0, 1))
    z = sum(p[2] for p in parts)
    v, w = (often.column(c).to_numpy() for c in ("v", "w"))
    keys = np.unique(np.concatenate([before.column("key").to_numpy(), v, w]).view(np.uint64))
    size = len(keys) + 1

    is_word = F.col("key") != int(START)
    mass = words.where(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.sum(F.least(F.col("n"), d))).first()
    gamma = float(min(0.99, max(0.01, (mass[2] or 0) / max(1, mass[0]))))
    own = words.sparkSession.createDataFrame(pa.table({"key": keys.view(np.int64)}))
    found = words.join(own, "key").select("key", "n").toArrow()
    n, m = np.zeros(size), np.zeros(size)
    n[_places(keys, found.column("key").to_numpy())] = found.column("n").to_numpy()
    contexts = np.unique(v.view(np.uint64))
    if len(contexts):
        met = corpus_followers(docs, contexts).toArrow()
        m[_places(keys, contexts[met.column("context").to_numpy()])] = met.column("m").to_numpy()

    total_words = mass[0] + mass[1] + 1
    base = np.where(np.append(keys, START) == START, 0.0, (n + 1) / total_words)
    base[-1] = max(0.0, 1 - base[:-1].sum())  # of all other words together; the same in both classes, so it cancels
    backoff = np.where((m > 0) & (n > 0), np.minimum(1, discount * m / np.maximum(n, 1)), 1)
    word, total, pair = [], [], []
    order = np.argsort(pair_keys := _places(keys, v) * size + _places(keys, w))
    for c, sum_of in (("o", z[0]), ("t", z[1])):
        seen = np.zeros(size)
        seen[_places(keys, before.column("key").to_numpy())] = before.column(c).to_numpy()
        word.append((1 - gamma) * (seen / sum_of if sum_of else base) + gamma * base)
        left = often.column(c).to_numpy()
        total.append(np.bincount(_places(keys, v), left, size))
        pair.append(np.append(left[order], 0.0))
    return Models(keys, word, total, backoff, np.append(pair_keys[order], size * size), pair)


def _features(model):
    """(..., text) -> (..., f)"""

    def score(batches):
        models = model.value
        other = len(models.keys)
        start = _found(models.keys, np.array([START]), other)[0]
        for b in slices(batches, -1):
            offsets, codes, words = _words(b.column(-1))
            w = _found(models.keys, hashes(words), other)[codes] if len(codes) else codes
            ratio = models.log_ratio(_before(offsets, w, start), w) if len(w) else np.zeros(0)
            out = np.zeros((b.num_rows, 2 + len(WINDOWS)))
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if n := hi - lo:
                    sums = np.concatenate([[0.0], np.cumsum(ratio[lo:hi])])
                    out[i, 0] = sums[-1] / n
                    out[i, 1] = np.log1p(n)
                    for k, width in enumerate(WINDOWS):
                        out[i, 2 + k] = (sums[width:] - sums[:-width]).max() / width if n >= width else sums[-1] / n
            f = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], f], [*b.schema.names[:-1], "f"])

    return score


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, deviations) by Newton steps on standardised columns."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 1e-9, std, 1.0)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, std


def fit_logistic_on(rows: DataFrame, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_logistic`` of (f, y), whose sums are taken in the tasks; the driver gets a few numbers of each."""

    def summed(work) -> np.ndarray:
        def part(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    out = work(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy().astype(np.float64))
                    total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

        return np.sum([r[0] for r in rows.select("f", "y").mapInArrow(part, "s array<double>").collect()], axis=0)

    first = summed(lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]))
    mean = first[1:] / first[0]
    std = np.sqrt(summed(lambda x, y: ((x - mean) ** 2).sum(axis=0)) / first[0])
    std = np.where(std > 1e-9, std, 1.0)
    k = len(mean) + 1
    w, penalty = np.zeros(k), np.diag([ridge] * (k - 1) + [1e-3])
    for _ in range(30):

        def slopes(x, y, w=w):
            z = np.column_stack([(x - mean) / std, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (y - p)])

        sums = summed(slopes)
        step = np.linalg.solve(sums[: k * k].reshape(k, k) + penalty, sums[k * k :] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, std


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, discount: float = DISCOUNT, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *also, score) for each row of ``docs`` (doc_id, text, ...), from ``labels`` (doc_id, toxic).

    ``also`` names columns of ``docs``, other than f and score, that are handed on.

    Labels of held-out doc_ids are never read.  All others fit the models: two thirds of these texts, by hash, are counted
    and one third fits the logistic curve.  The corpus
    counts cover every word of every text.  Null and empty texts get a score from a zero ratio.  A doc_id labelled more
    than once is toxic if one of its labels says so.  Without labels of both classes the score is the share
    of toxic labels, or 0 without any.  Other columns are not read.  An empty table gives no rows.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").cast("string").alias("text"))
    docs = every.select("doc_id", "text")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = shared.keep(known.withColumn("fits", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(3)) == 0), "labelled")

    seen = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fits")).alias("fits")).collect()
    total = sum(r["n"] for r in seen)
    share = sum(r["n"] for r in seen if r["toxic"] == 1) / total if total else 0.0
    if len(seen) < 2 or any(r["fits"] == 0 or r["fits"] == r["n"] for r in seen):
        return every.select("doc_id", *also, F.lit(share).alias("score"))

    words = shared.keep(corpus_words(docs), "words")
    # The planner broadcasts the labels while they are few.
    counted = docs.join(known.where("not fits"), F.col("doc_id") == F.col("id"))
    counted = shared.keep(counted.select(F.when(F.col("toxic") == 1, TOXIC).otherwise(ORDINARY).alias("kind"), "text"), "counted")
    models = fit_models(docs, words, [_pairs(counted, k, PARTS) for k in range(PARTS)], discount)
    shared.forget(words, counted)
    model = docs.sparkSession.sparkContext.broadcast(models)

    features = shared.keep(every.mapInArrow(_features(model), StructType([*every.schema.fields[:-1], StructField("f", ArrayType(DoubleType()))])), "ratios")
    fit = shared.keep(features.join(known.where("fits"), F.col("doc_id") == F.col("id")).select("f", F.col("toxic").cast("double").alias("y")), "fit")
    if fit.isEmpty():
        return every.select("doc_id", *also, F.lit(share).alias("score"))
    w, mean, std = fit_logistic_on(fit)
    shared.forget(fit)
    z = F.lit(float(w[-1]))
    for i in range(len(mean)):
        z = z + F.lit(float(w[i] / std[i])) * (F.get("f", F.lit(i)) - F.lit(float(mean[i])))
    return features.select("doc_id", *also, (1 / (1 + F.exp(-z))).alias("score"))
