"""Spelling variants: words one edit apart, found by a symmetric-delete join, grouped under the most frequent form.

Every word emits the hash of itself and of its distinct single deletions.  Two words that differ by one inserted,
deleted or replaced code point share such a string, and exactly one: the shorter word itself, or what is left of both
without the replaced place.  An equi-join on the hashes finds them, the words themselves decide.

The hash of a deletion is taken from sums over the parts before and after it, so a word costs its length, not its square,
and only words of at most CARRIED code points travel with their keys; longer ones are fetched for the pairs found.
The words of a key differ in one place, so there are no more than letters times places of them, however large the corpus.

Cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash that marks runs; repeated rows count
again; of forms of equal n the first in code-point order counts.  Further columns are not read, and an empty table has
no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.text import mix

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CARRIED = 64
BASE = 0x9E3779B97F4A7C15 | 1
KEYS = "key long, word_id long, carried string, n long"
# Joins of what grows with the words are merges: Spark takes keys for as large as the words that they come from, and words for as
# large as their compressed files, and would gather both on the driver.
MERGE = "merge"
FEW_BYTES = 4 << 20  # of long words, up to which every worker receives them


def ascii_lower(run: Column) -> Column:
    """Lower-cases A-Z alone; runs of ASCII letters take the short way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words_of(docs: DataFrame, thinned: int | None = None) -> DataFrame:
    """(doc_id, text) -> (word): the lower-cased runs of letters.

    With ``thinned``, runs whose crc32 of ``<doc_id>:<run>`` it divides lose one code point, as a typing error would.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("d", ascii_lower(F.col("run")).alias("run"))
    if thinned is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % thinned == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word_id, word, n) of the distinct words; counts are summed in each task before they are shuffled."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    return shared.keep(counted.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"), "vocabulary")


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, hash) of every word and of its distinct single deletions."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - start[of]
    power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, BASE, np.uint64), out=power[1:])
    term = mix(codes + np.uint64(1)) * power[at]
    total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    whole = total[start[1:]] - total[start[:-1]]
    before = total[:-1] - total[start[of]]
    after = total[start[of + 1]] - total[1:]
    deleted = before + after * np.uint64(pow(BASE, -1, 1 << 64))
    # In a run of one letter every deletion leaves the same string.
    distinct = (at == 0) | (codes != np.roll(codes, 1))
    length = size.astype(np.uint64) << np.uint64(40)
    spread = lambda h, n: mix(h ^ n)
    keys = np.concatenate([spread(whole, length), spread(deleted, (length - (np.uint64(1) << np.uint64(40)))[of])[distinct]])
    return np.concatenate([np.arange(len(words)), of[distinct]]), keys


BATCH_CODES = 500_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word_id, word, n) -> KEYS, in batches of a bounded number of keys, a single long word aside."""
    for b in batches:
        words = b.column(1).to_pylist()
        ends, at = np.cumsum([len(w) + 1 for w in words]), 0
        while at < len(words):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BATCH_CODES, side="right")))
            held = words[at:end]
            of, keys = deletion_hashes(held)
            part, take = b.slice(at, end - at), pa.array(of)
            carried = pa.array([w if len(w) <= CARRIED else None for w in held], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(take), carried.take(take), part.column(2).take(take)], ["key", "word_id", "carried", "n"])
            at = end


def near_words(words: DataFrame) -> DataFrame:
    """(word_id, word, n) -> (word_id, other, other_n): every ordered pair of words exactly one edit apart."""
    keys = words.select("word_id", "word", "n").mapInArrow(_keys, KEYS)
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("word_id", "carried", "n"))) for s in "ab")
    pairs = a.join(b.hint(MERGE), "key").where("word_id_a <> word_id_b")
    long = shared.keep(words.where(F.length("word") > CARRIED).select("word_id", "word"), "long_words")
    few = (long.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= FEW_BYTES
    for s in "ab":
        fetched = long.select(F.col("word_id").alias(f"long_{s}"), F.col("word").alias(f"word_{s}")).hint("broadcast" if few else MERGE)
        pairs = pairs.join(fetched, F.col(f"word_id_{s}") == F.col(f"long_{s}"), "left")
    left, right = (F.coalesce(f"carried_{s}", f"word_{s}") for s in "ab")
    one = pairs.where(F.levenshtein(left, right, 1) == 1)
    return one.select(F.col("word_id_a").alias("word_id"), right.alias("other"), F.col("n_b").alias("other_n"))


def with_forms(words: DataFrame, times: int = 2) -> DataFrame:
    """Adds n_near and, where the most frequent near word is ``times`` as frequent, form and form_n."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word_id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select(F.col("word_id").alias("of"), "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    taken = F.col("other_n") >= times * F.col("n")
    return words.join(near.hint(MERGE), F.col("word_id") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("other")).alias("form"), F.when(taken, F.col("other_n")).alias("form_n")
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds root: the end of the way from form to form.  ``formed`` is read more than once.

    Each round joins every pointer with the pointer of its end, so ways halve; n at least doubles at each step, so they are short.
    """
    pointers = shared.keep(formed.where("form IS NOT NULL").select("word", F.col("form").alias("end")), "roots")
    while True:
        onward = pointers.select(F.col("word").alias("at"), F.col("end").alias("next"))
        moved = pointers.join(onward.hint(MERGE), F.col("end") == F.col("at"), "left").select("word", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved"))
        moved = shared.keep(moved, "roots")
        shared.forget(pointers)
        pointers = moved.select("word", "end")
        pointers.kept_path = moved.kept_path
        if moved.where("moved").isEmpty():
            break
    roots = pointers.select(F.col("word").alias("from"), F.col("end").alias("root"))
    return formed.join(roots.hint(MERGE), F.col("word") == F.col("from"), "left").select(*formed.columns, F.coalesce("root", "word").alias("root"))


def group_spellings(docs: DataFrame, least_length: int = 5, least_count: int = 3, thinned: int | None = None) -> DataFrame:
    """Words of ``docs`` with their near words counted, the form that each stands for and the root of that form."""
    words = vocabulary(words_of(docs, thinned), least_length, least_count)
    formed = shared.keep(with_forms(words), "forms")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
