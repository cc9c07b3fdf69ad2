"""Near-duplicate lines by a deletion-neighbourhood join; the earliest line stays.

Two lines are within one edit if they share a variant: one is the other without a character, or both are
equal without the character at one place.  Every variant is a hashed key, so equal lines are found by
grouping, and in each group only the earliest line matters: of lines equal but for the character at one
place all are within one edit of the first, and a line that is another's variant is compared with the first
of those.  No pairs are formed before one candidate for each line is verified by its edit distance.

A line of n characters has n variants, so those that cannot meet another line's are left out before.  Cut a
line into segments: one edit lies in one of them, and all that stands before and after that segment is as it
was.  Two segments, then about sqrt(n) of them, give a key each of what stands around; a line emits the
variants of those segments only whose key it shares with another line.  Segments begin at multiples of a
width from the line's start and end at fixed distances from its end, both by the length rounded down to
``STEP``, so that lines whose lengths differ by one have the same cuts; where the rounding parts them, the
longer one has the keys of the shorter one's cuts as well.

Lines are told apart by 128 bits of their content, documents by their doc_id and a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.text import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = 8  # cuts depend on a line's length rounded down to a multiple of this
NEAR_CHARS = 20  # shorter lines are compared for equality only: one edit changes most of what they say
SLICE_CHARS = 2_000_000  # characters whose variants a task holds at a time, a single longer line aside


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial hash; entry i is that of the first i characters."""
    codes = mix(codes + np.uint64(1))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(codes) - 1), BASE, np.uint64)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(codes * powers, dtype=np.uint64)])


def _salt(n: int) -> np.uint64:
    return np.uint64(n * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)


def variants(line: str, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the line without each of its characters from ``lo`` up to ``hi``, in order, and of the line itself; O(length)."""
    sums = _sums(_codes(line))
    n = len(sums) - 1
    hi = n if hi is None else min(hi, n)
    without = sums[lo:hi] + (sums[-1] - sums[lo + 1 : hi + 1]) * INVERSE
    return mix(without ^ _salt(n - 1)), mix(np.array([sums[-1] ^ _salt(n)]))[0]


def segments(n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the segments of a line of ``length`` characters under the cuts for the length ``n``."""
    width = max(STEP, int(n**0.5))
    begins = np.arange(0, max(n, 1), width)
    return begins, length - np.maximum(0, n - begins - width)


def around(line: str) -> list[tuple[int, int, int]]:
    """(key, begin, end) of the line's segments: keys are hashes of what stands before and after a segment."""
    digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
    out, length = [], len(line)
    sums = _sums(_codes(line))
    n = length // STEP * STEP
    for rounded in {n, n - STEP} if length == n else {n}:
        begins, ends = segments(rounded, length)
        # What stands after is summed from the line's end: shift it to a place that does not depend on the length.
        after = (sums[-1] - sums[ends]) * _powers(-ends)
        for b, e, x, y in zip(begins.tolist(), ends.tolist(), sums[begins].tolist(), after.tolist(), strict=True):
            out.append((digest(b"%d,%d,%d,%d" % (rounded, b, x, y)), b, e))
    return out


def _powers(exponents: np.ndarray) -> np.ndarray:
    """BASE to powers of zero and below."""
    table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(-exponents.min(initial=0)), INVERSE, np.uint64)]), dtype=np.uint64)
    return table[-exponents]


def text_key() -> Column:
    """Tells rows apart that repeat a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.trim("line", F.lit(" \t\r\x0b\x0c")) != "")


def _pieces(b: pa.RecordBatch, line: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of up to SLICE_CHARS characters of its lines."""
    size = np.cumsum([len(x) for x in b.column(line).to_pylist()])
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, side="right")))
        yield b.slice(at, end - at)
        at = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, begin, end, h) of each segment of each line (h, line)."""
    for whole in batches:
        for b in _pieces(whole, 1):
            found = [(around(line), h) for h, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            flat = [(*x, h) for xs, h in found for x in xs]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "begin", "end", "h"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, place, h, first) of each line (h, first, line, spans) in its spans; the line itself has place -1."""
    names = ["variant", "place", "h", "first"]
    for whole in batches:
        for piece in _pieces(whole, 2):
            keys, places, counts = [], [], []
            for line, spans in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                v, own = variants(line)
                use = np.zeros(len(v), bool)
                for x in spans:
                    use[x["begin"] : x["end"]] = True
                at = np.flatnonzero(use).astype(np.int32)
                keys += [v[at], np.array([own], np.uint64)]
                places += [at, np.array([-1], np.int32)]
                counts.append(len(at) + 1)
            owner = pa.array(np.repeat(np.arange(piece.num_rows), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), *(piece.column(i).take(owner) for i in range(2))], names)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The keys that two different lines of (key, h) have."""
    h = F.xxhash64("h")
    return keyed.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("key")


def duplicate_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, text_key, exact, near): the numbers of the lines of each document that an earlier line makes redundant.

    Earlier means in the order of doc_id, then ``text_key``, then line.  Documents without such lines are not returned.
    """
    lines = _lines(docs)
    h = F.unhex(F.md5(F.col("line").cast("binary")))
    n = F.length("line")

    def parts(length):
        q = F.floor(length / (2 * STEP)).cast("int") * STEP
        part = lambda s, side: F.xxhash64(F.lit(side), q, s)
        return [part(F.substring("line", F.lit(1), q), "head"), part(F.right("line", q), "tail")]

    edge = F.floor(n / (2 * STEP)) != F.floor((n - 1) / (2 * STEP))  # the partner that is one shorter has shorter parts
    keys = F.when(n < near_chars, F.array().cast("array<bigint>")).when(edge, F.array(*parts(n), *parts(n - 1))).otherwise(F.array(*parts(n)))
    place = F.struct("doc_id", "text_key", "line_no")
    firsts = lines.select(h.alias("h"), place.alias("p"), keys.alias("keys")).groupBy("h")
    firsts = shared.keep(firsts.agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "lines")

    keyed = firsts.select(F.explode("keys").alias("key"), "h", "first")
    several = shared_keys(keyed)
    some = keyed.join(several, "key").select("h", "first").distinct()
    some = some.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "h")).alias("wanted"))
    texts = docs.withColumn("text_key", text_key()).join(some, ["doc_id", "text_key"]).select("doc_id", "text_key", "wanted", F.split("text", "\n", -1).alias("all"))
    texts = texts.select("doc_id", "text_key", F.explode("wanted").alias("w"), "all")
    texts = texts.select(F.col("w.h").alias("h"), F.struct("doc_id", "text_key", F.col("w.line_no").alias("line_no")).alias("first"), F.get("all", F.col("w.line_no")).alias("line"))
    texts = shared.keep(texts.dropDuplicates(["h"]), "near-lines")

    # Of these lines, the segments around which another one is equal.
    cut = texts.select("h", "line").mapInArrow(_cut, "key long, begin int, end int, h binary")
    spans = cut.join(shared_keys(cut), "key", "left_semi").groupBy("h").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # a line has about sqrt(n)
    open_lines = texts.join(spans, "h").select("h", "first", "line", "spans")
    v = open_lines.mapInArrow(_emit, "variant long, place int, h binary, first struct<doc_id: long, text_key: long, line_no: int>")
    v = v_kept = shared.keep(v, "variants")
    v = v.select("variant", "place", F.struct("first", "h").alias("me"))
    here = v.groupBy("variant", "place").agg(F.min("me").alias("first_here"), F.count(F.lit(1)).alias("m"))
    ends = here.groupBy("variant").agg(
        F.min(F.when(F.col("place") < 0, F.col("first_here"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first_here"))).alias("shortened"), F.sum("m").alias("all")
    )
    both = here.join(ends.where("all > 1"), "variant").where("m > 1 or whole is not null")
    met = v.join(both.drop("m", "all"), ["variant", "place"])
    earlier = F.when(F.col("place") < 0, F.col("shortened")).otherwise(F.least("first_here", F.coalesce("whole", "first_here")))
    met = met.select("me", earlier.alias("earlier")).where("earlier < me")
    pairs = met.groupBy("me").agg(F.min("earlier").alias("earlier")).select(F.col("me.h").alias("h"), F.col("earlier.h").alias("other"))
    near = pairs.join(texts.select("h", "line"), "h").join(texts.select(F.col("h").alias("other"), F.col("line").alias("kept")), "other")
    near = shared.keep(near.where(F.levenshtein("line", "kept", 1).between(0, 1)).select("h"), "near")
    shared.forget(v_kept, texts)

    rows = lines.select(h.alias("h"), "doc_id", "text_key", "line_no")
    known = firsts.select("h", "first", "copies").join(near.select("h", F.lit(True).alias("near")), "h", "left").where("copies > 1 or near")
    found = rows.join(known, "h").where((F.col("first") != place) | F.col("near"))
    is_near = F.coalesce("near", F.lit(False))
    return found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.when(~is_near, F.col("line_no")))).alias("exact"), F.array_sort(F.collect_list(F.when(is_near, F.col("line_no")))).alias("near")
    )


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with redundant lines taken out of ``text``, and n_lines, n_exact, n_near longs.

    A line goes if an equal one, or for lines of ``near_chars`` characters or more one within one edit,
    stands earlier in the order of doc_id, then line, whether or not that one stays itself.  Blank lines stay
    and are not counted.  A null or empty text stays as it is, and so does a text without a doc_id.  Rows that repeat a
    doc_id with different texts are different documents, in the order of a hash of the text; rows alike in both are
    one document, whose lines are not redundant among each other's copies.  Columns of the input named n_lines,
    n_exact or n_near are replaced.  An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    gone_id, gone_key, gone_exact, gone_near = (shared.free_name(docs, x) for x in ("gone_id", "gone_key", "gone_exact", "gone_near"))
    gone = duplicate_lines(narrow, near_chars).toDF(gone_id, gone_key, gone_exact, gone_near)
    joined = docs.join(gone, (docs.doc_id == gone[gone_id]) & (text_key() == gone[gone_key]), "left")
    drop = F.concat(gone_exact, gone_near)
    all_lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(all_lines, lambda x, i: F.when(~F.array_contains(drop, i), x)), lambda x: x.isNotNull())
    filled = F.size(F.filter(all_lines, lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) != ""))
    changed = F.col(gone_id).isNotNull()
    count = lambda c: F.when(changed, F.size(c)).otherwise(0).cast("long")
    return joined.select(
        *(F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNotNull(), filled).otherwise(0).cast("long").alias("n_lines"),
        count(gone_exact).alias("n_exact"),
        count(gone_near).alias("n_near"),
    )
