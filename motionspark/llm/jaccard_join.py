"""Exact n-gram Jaccard join as a size-aware heavy-light join.

Every text becomes the set of its distinct ``width``-word shingles (64-bit hashes).  Texts with equal sets
collapse into one row first, so copies never meet each other again.

*Light* sets (fewer shingles than the boundary) enumerate subsets: two sets of sizes s and t that reach the
threshold share at least c(s, t) shingles, so each emits one key per c-subset for every c that a feasible
partner can ask for.  Equal keys are links where the
sizes ask for no more than c.  *Heavy* sets are looked up in inverted lists: under one total
order of shingles, two sets with c shingles in common share one within their first |S| - c + 1.  The order
puts shingles that are frequent somewhere last; it steers cost only, any order gives the same links.  Light
sets large enough to link with a heavy one enter the lists too.  The boundary is the one of least estimated
cost over the histogram of set sizes.

Candidates of lists are compared in three rounds: each set with the one smallest head of its lists, then with
the other heads, then with everyone.  Links found join into components after each round, and the next one
looks only at lists and pairs that hold different components.  A large group of near copies thus never
expands into all its pairs, while no link between different components is lost.

Before texts are fetched, sketches bound each pair: elements fall into parts by hash, and sets that differ in
more parts than the threshold allows differing elements cannot be linked.  The join of the last round itself
takes a pair only from lists that can be those of its first common element, by the places in the total order, and
compares the parities of the counts in 256 parts, the rest of the pairs one byte for each of more parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.text import MASK, WordHash, hashes, mix, shingle_sets, shingles, slices, word_codes

MAX_LIGHT = 32  # sets below this size are stored whole, so that the boundary can lie anywhere up to it
HOT_LIMIT = 1_500_000  # most frequent shingles that the order knows of: 13.5 MB broadcast at most
BLOCK = 4_000_000  # shingles counted together within a task
LOCAL_HOT = 2  # a shingle in this many sets of one block counts as frequent


def overlap(s: int, t: int, percent: int) -> int:
    """Fewest common shingles with which sets of sizes s and t reach the threshold: 100 I >= percent U."""
    return -(-percent * (s + t) // (100 + percent))


def largest(s: int, percent: int) -> int:
    return 100 * s // percent


def smallest(s: int, percent: int) -> int:
    return -(-percent * s // 100)


def prefix_length(s: int, percent: int) -> int:
    return s - smallest(s, percent) + 1


def subset_sizes(s: int, percent: int) -> list[int]:
    return sorted({overlap(s, t, percent) for t in range(smallest(s, percent), largest(s, percent) + 1)} & set(range(1, s + 1)))


def sketches_of(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of sets of n elements that lie in s: a byte for each of a power of two of parts, the sum of a byte of each element in it."""
    parts = np.left_shift(1, np.maximum(4, np.frexp(n // 4)[1])).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(parts)])
    place = np.repeat(at[:-1], n) + (s & np.repeat(parts - 1, n).astype(np.uint64)).astype(np.int64)
    total = np.bincount(place, weights=(s >> np.uint64(40) & np.uint64(255)).astype(np.float64), minlength=at[-1])
    return at, total.astype(np.int64).astype(np.uint8)


def parities_of(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """256 bits in four longs for each set: whether the number of elements in each of 256 parts is odd."""
    place = np.repeat(np.arange(len(n)), n) * 256 + (s >> np.uint64(20) & np.uint64(255)).astype(np.int64)
    odd = np.bincount(place, minlength=256 * len(n)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, 4)


def parts_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Parts in which two sketches differ, at most the number of elements in which their sets do."""
    n = min(len(a), len(b))
    a, b = (x.reshape(-1, n).sum(axis=0, dtype=np.uint8) for x in (a, b))
    return int(np.count_nonzero(a != b))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, offsets, shingles) of pieces of (doc_id, text)."""
    for b in slices(batches, 1):
        offsets, codes, words = word_codes(b.column(1))
        yield b.column(0), *shingle_sets(offsets, hashes(words)[codes], width)


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes frequent in some block with the logarithm of their count, as a sorted bounded table.

    A shingle in a given share of all sets has that share in at least one block, so blocks find every
    frequent one; rarer ones cost no shuffle.
    """

    def count(batches):
        def flush(found):
            h, n = np.unique(np.concatenate(found), return_counts=True)
            hot = n >= LOCAL_HOT
            return pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(n[hot].astype(np.int64))], ["h", "n"])

        found, size = [], 0
        for _, _, s in _sets(batches, width):
            found.append(s)
            size += len(s)
            if size >= BLOCK:
                yield flush(found)
                found, size = [], 0
        if found:
            yield flush(found)

    counts = docs.select("doc_id", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(HOT_LIMIT).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    level = np.minimum(255, np.ceil(4 * np.log2(top.column("n").to_numpy().astype(np.float64) + 1))).astype(np.uint8)
    order = np.argsort(h)
    return h[order], level[order]


def _ragged(kind: pa.DataType, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A column of lists or of byte strings that lie one after the other."""
    at = pa.array(offsets.astype(np.int32), pa.int32())
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, at.buffers()[1], pa.py_buffer(values.tobytes())])
    return pa.ListArray.from_arrays(at, pa.array(values))


def _signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sketch, p0-p3, elements): the whole set below MAX_LIGHT, else its prefix; both in order."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def sign(batches):
        import xxhash

        hot, level = frequent.value
        for ids, ends, s in _sets(batches, width):
            n = np.diff(ends)
            cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            at, sketches = sketches_of(n, s)
            rank = np.zeros(len(s), np.uint8)
            if len(hot) and len(s):
                place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                rank = np.where(hot[place] == s, level[place], 0).astype(np.uint8)
            size = np.where(n < MAX_LIGHT, n, n - -(-percent * n // 100) + 1)
            keep = [a + np.argsort(rank[a:b], kind="stable")[:k] for (a, b), k in zip(cuts, size.tolist(), strict=True)]  # equal ranks stay in the order of their hashes
            elements = s[np.concatenate(keep)] if keep else s
            signs = [xxhash.xxh3_128_digest(s[a:b].tobytes()) for a, b in cuts]
            odd = parities_of(n, s)
            arrays = [ids, pa.array(n.astype(np.int32)), pa.array(signs, pa.binary()), _ragged(pa.binary(), at, sketches), *(pa.array(odd[:, i].copy()) for i in range(4))]
            arrays.append(_ragged(pa.list_(pa.int64()), np.concatenate([[0], np.cumsum(size)]), elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_hash", "sketch", "p0", "p1", "p2", "p3", "elements"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles int, set_hash binary, sketch binary, p0 long, p1 long, p2 long, p3 long, elements array<long>")


def boundary(histogram: dict[int, int], mean_list: float, percent: int) -> int:
    """The size below which enumerating subsets costs less than scanning lists, in keys plus list members read."""

    def light(s):
        return sum(comb(s, c) for c in subset_sizes(s, percent))

    def heavy(s):
        return prefix_length(s, percent) * (1 + mean_list)

    sizes = range(1, MAX_LIGHT + 1)
    cost = {
        x: sum(n * (light(s) if s < x else heavy(s)) + n * (heavy(s) if smallest(x, percent) <= s < x else 0) for s, n in histogram.items() if s < MAX_LIGHT)
        for x in sizes
    }
    return min(sizes, key=lambda x: (cost[x], -x))


def _keys(sets: DataFrame, x: int, percent: int) -> DataFrame:
    """(key, light, doc_id, n_shingles, at): a subset of ``at`` elements of a light set, or a list in which the set stands at ``at``."""

    def subsets(e: np.ndarray, c: int) -> np.ndarray:
        """Keys of all c-subsets: what is left of the sum of mixed elements without those taken out."""
        m, drop = mix(e), len(e) - c
        total = np.add.reduce(m)
        if drop == 0:
            out = np.array([total], np.uint64)
        elif drop == 1:
            out = total - m
        else:
            i = np.array(list(combinations(range(len(e)), drop)))
            out = total - m[i].sum(axis=1, dtype=np.uint64)
        return mix(out + np.uint64(c * 0x9E3779B97F4A7C15 & MASK))

    def emit(batches):
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            parts = b.column(2)
            at, flat = parts.offsets.to_numpy(), parts.values.to_numpy().view(np.uint64)
            out = [[], [], [], [], []]
            for k, (doc_id, n) in enumerate(zip(ids, sizes, strict=True)):
                e = flat[at[k] : at[k + 1]]
                found = []
                if n < x:
                    found += [(keys, True, np.full(len(keys), c, np.int32)) for c in subset_sizes(n, percent) for keys in (subsets(e, c),)]
                if n >= smallest(x, percent):
                    p = prefix_length(n, percent)
                    found.append((e[:p], False, np.arange(p, dtype=np.int32)))
                for keys, light, place in found:
                    out[0].append(keys.view(np.int64))
                    out[1].append(np.full(len(keys), light))
                    out[2].append(np.full(len(keys), doc_id, np.int64))
                    out[3].append(np.full(len(keys), n, np.int32))
                    out[4].append(place)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "light", "doc_id", "n", "at"])

    return sets.select("doc_id", "n_shingles", "elements").mapInArrow(emit, "key long, light boolean, doc_id long, n int, at int")


def _possible(a: str, b: str, percent: int):
    """Sizes agree, and the shared subset, or what can still follow the shared list, reaches the threshold."""
    small, big = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    need = F.ceil(F.lit(percent) * (small + big) / F.lit(100 + percent))
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return (small * 100 >= big * percent) & F.when(F.col(f"{a}.light"), need <= F.col(f"{a}.at")).otherwise((rest >= 1) & (need <= small))


def _first_in_common(a: str, b: str, percent: int):
    """The shared list can be that of the first common element: enough elements follow in both sets, the shared one included."""
    need = F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + percent))
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")) >= need


def _few_odd(a: str, b: str, percent: int):
    """Parities differ in no more parts than linked sets may differ in elements."""
    need = F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + percent))
    apart = [F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(4)]
    return apart[0] + apart[1] + apart[2] + apart[3] <= F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * need


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs that their sketches do not rule out."""

    def check(batches):
        for b in batches:
            us, vs, nu, nv = (b.column(i).to_pylist() for i in range(4))
            su, sv = (b.column(i) for i in (4, 5))
            keep = []
            for i in range(len(us)):
                apart = parts_apart(np.frombuffer(su[i].as_buffer(), np.uint8), np.frombuffer(sv[i].as_buffer(), np.uint8))
                if apart <= nu[i] + nv[i] - 2 * overlap(nu[i], nv[i], percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (us, vs)], ["u", "v"])

    left = sketches.select(F.col("doc_id").alias("u"), F.col("n_shingles").alias("nu"), F.col("sketch").alias("su"))
    right = sketches.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("nv"), F.col("sketch").alias("sv"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "su", "sv")
    return both.mapInArrow(check, "u long, v long")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) pairs whose whole sets reach the threshold, by the texts themselves."""

    def check(batches):
        cache = WordHash()
        last, kept = None, None
        for b in batches:
            us, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
            left, right = (b.column(i).cast(pa.binary()) for i in (2, 3))
            good = []
            for k in range(len(us)):
                if us[k] != last:
                    last, kept = us[k], np.unique(shingles(cache.of(left[k].as_py().lower().split()), width))
                other = np.unique(shingles(cache.of(right[k].as_py().lower().split()), width))
                common = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * common >= percent * (len(kept) + len(other) - common))
            keep = [i for i, g in enumerate(good) if g]
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], ["u", "v"])

    t = docs.select("doc_id", "text")
    both = pairs.join(t.withColumnsRenamed({"doc_id": "v", "text": "tv"}), "v").join(t.withColumnsRenamed({"doc_id": "u", "text": "tu"}), "u")
    return both.select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long")


def ngram_jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no shingles, are linked with nothing and are their own component.  Rows that
    repeat a doc_id are one document as far as links go and keep one output row each.  A null doc_id has a
    null component.  Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = shared.keep(_signatures(docs, width, percent), "signatures")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    sets = shared.keep(whole.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "sets")
    reps = whole.join(sets.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"]).dropDuplicates(["set_hash"]).drop("set_hash")
    reps = shared.keep(reps, "representatives")
    named = shared.keep(signed.select("doc_id", "n_shingles", "set_hash"), "named")
    repeated = _repeats(signed)
    shared.forget(signed)
    histogram = {r[0]: r[1] for r in reps.where(f"n_shingles < {MAX_LIGHT}").groupBy("n_shingles").count().collect()}

    x = 1
    if histogram:
        probe = _keys(reps.where(f"n_shingles < {MAX_LIGHT}"), 1, percent).groupBy("key").count()
        mean = probe.agg(F.coalesce(F.sum(F.col("count") * F.col("count")) / F.sum("count"), F.lit(0.0))).first()[0]
        x = boundary(histogram, float(mean), percent)
    keys = _keys(reps, x, percent)
    if not histogram:
        keys = keys.where("not light")
    # Most prefixes' shingles are in one set only; no list of one member goes on.
    several = keys.groupBy("key", "light").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "light")
    # Bands of sizes that can link; at 100 percent, each size.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    lists = shared.keep(keys.join(several, ["key", "light"], "left_semi").withColumn("band", F.when(F.col("light"), 0).otherwise(step)), "lists")
    # If two sets with a subset in common are linked, so is each of them with the smallest set that has it.
    head = F.struct(F.when(F.col("light"), F.col("n")).otherwise(0).alias("size"), "doc_id", "n", "light", "at")
    first = lists.groupBy("key", "light", "band").agg(F.min(head).alias("h"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    first = first.where("lo < hi").select("key", "light", "band", "h")
    star = lists.join(first, ["key", "light", "band"]).where("doc_id <> h.doc_id").alias("e")
    star = star.withColumn("e", F.struct("n", "light", "at")).where(_possible("h", "e", percent))
    star = star.groupBy(F.col("h.doc_id").alias("u"), F.col("doc_id").alias("v")).agg(F.max("light").alias("light"))
    star = shared.keep(star, "star")

    texts = docs.where("doc_id is not null")
    texts = texts.dropDuplicates(["doc_id"]) if repeated else texts
    sketches = reps.select("doc_id", "n_shingles", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        close = shared.keep(_close(pairs, sketches, percent), "close")
        found = shared.keep(_verify(close, texts, width, percent), "links")
        shared.forget(close)
        return found

    heads = star.where("not light")
    nearest = shared.keep(heads.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "nearest")
    near = linked(nearest)
    early = shared.components(star.where("light").select("u", "v").unionByName(near))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        cu = early.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        cv = early.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        both = pairs.join(cu, "u", "left").join(cv, "v", "left")
        return both.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    far = linked(apart(heads.select("u", "v").join(nearest, ["u", "v"], "left_anti")))
    joined = shared.components(early.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(far))
    shared.forget(nearest, near, far, early)

    # The last round: sets of one list that are still apart.  A group is a key and a band, with the sets of that
    # band and of the next one, since sets that can link are at most one band apart.
    member = lists.where("not light").join(joined, F.col("doc_id") == F.col("node"), "left")
    member = member.select("key", "light", "doc_id", "n", "at", "band", F.coalesce("component", "doc_id").alias("comp"))
    member = member.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("above")).withColumn("band", F.col("band") - F.col("above"))
    mixed = member.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("above").alias("above"))
    mixed = mixed.where("lo < hi and above = 0").select("key", "band")
    rest = member.join(mixed, ["key", "band"], "left_semi").join(reps.select("doc_id", "p0", "p1", "p2", "p3"), "doc_id")
    rest = shared.keep(rest, "rest")
    a, b = rest.where("above = 0").alias("a"), rest.alias("b")
    once = (F.col("b.above") == 1) | (F.col("a.doc_id") < F.col("b.doc_id"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band"))
    pairs = a.join(b, same & once & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b", percent) & _first_in_common("a", "b", percent) & _few_odd("a", "b", percent))
    pairs = pairs.select(F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).distinct()
    more = linked(pairs.join(star.select("u", "v"), ["u", "v"], "left_anti"))
    shared.forget(lists, rest, star, reps)
    if not more.isEmpty():
        last = joined
        joined = shared.components(last.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(more))
        shared.forget(last)
    shared.forget(more)

    classes = sets.join(joined, sets.rep == joined.node, "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = named.where("n_shingles > 0").join(classes, "set_hash", "left")
    out = out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = named.where("n_shingles = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _repeats(signed: DataFrame) -> bool:
    n, distinct = signed.where("doc_id is not null").agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    return n != distinct


def one_of_each_group(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest doc_id; every column stays.

    Of rows that repeat that doc_id one stays.  Rows without a doc_id have no component: of those with equal
    texts one stays.
    """
    grouped = shared.keep(ngram_jaccard_join(docs, width, percent), "grouped")
    best = grouped.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = docs.join(best.select("kept_id"), docs.doc_id == best.kept_id, "left_semi")
    if not best.where("kept_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    if not grouped.where("doc_id is null").isEmpty():
        kept = kept.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
    return kept
