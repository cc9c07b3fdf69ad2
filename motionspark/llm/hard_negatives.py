"""Hard negatives by a block matrix multiply: score tiles from shards of rows and of dimensions.

Vectors become integers.  Rows fall into blocks of about ROWS, anchors into blocks of about ANCHORS; a block is a row of a table
and holds a panel for each chunk of dimensions.  A tile is a pair of blocks: it stays where it is made, and the
products of its panels are added to it one chunk after the other.  Blocks are paired by a Cartesian product that reads
both tables from the shared folder, so neither panels nor scores are shuffled, and disk grows with the input, not with its square.
A task goes through the tiles of some row blocks and at most HELD anchor blocks and keeps the top-k per anchor, or per
anchor-positive window; only those are shuffled.

Two products are made: of anchors with the blocks that hold rows of their label, for the positives, and of anchors with all rows, for
the negatives in the window of each positive's score.  A task holds one tile, whatever the number of rows; a label with
many rows has blocks of its own, the others share blocks.

Cases: rows with a null label or vector, or with a null or non-finite component, take no part; nor do those whose
scores may not fit a long (quantised components whose sizes sum up to more than 2^31).  An empty vector has the score 0 with all
others; a vector shorter than another counts as if it went on with zeros.  A row without an id is no anchor and comes
last in ties.  Every row counts by itself: of rows that repeat an id each is another row and, as an anchor, has its own results.
Further columns are not read.  Without rows or anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.llm import shared

ROWS, ANCHORS = 1024, 512  # of a tile: 4 MB of scores
CELLS = 2**20  # of a block at most, where it has more than one row
CHUNK_DIMS, CHUNKS = 32, 4  # dimensions of a panel, more where a vector would have more than so many chunks
HELD, LONGEST, BATCH = 4, 256, 16  # anchor blocks and row blocks of a task at most; tiles that go to a Python worker at once
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """(uid, id, label, anchor, q) of the rows that take part, as a table: row identities must not change later."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.abs(F.floor(x).cast("double")))
    large = F.exists(scaled, lambda x: F.abs(x) > 2.0**31)
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad).where(~large).where(total <= 2.0**31)
    q = F.transform(scaled, lambda x: F.floor(x).cast("long"))
    return shared.keep(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "anchor", q.alias("q")), "vectors")


def matrix(part: pa.ChunkedArray) -> np.ndarray:
    """Lists of different lengths as the rows of a matrix, filled up with zeros."""
    part = part.combine_chunks()
    n = np.diff(part.offsets.to_numpy())
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
    return out


def exact(a: list[np.ndarray], b: list[np.ndarray]) -> type:
    """The numbers in which the products of panels can be added: floating point where every partial sum stays below 2^24 or 2^53."""
    most = float(sum(np.abs(x.astype(np.int64)).sum(1) for x in a).max(initial=0)) * max(float(np.abs(x.astype(np.int64)).max(initial=0)) for x in b) if a and b else 0.0
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64


def product(a: np.ndarray, b: np.ndarray, kind: type | None = None) -> np.ndarray:
    """a @ b.T, exactly; what one side lacks in width is zero."""
    width, kind = min(a.shape[1], b.shape[1]), kind or exact([a], [b])
    return a[:, :width].astype(kind) @ b[:, :width].astype(kind).T


# uids, ids, labels and unnamed, whether a row has no id, are longs.
BLOCK = "low long, high long, kind string, uids binary, ids binary, labels binary, unnamed binary, panels array<binary>, windows array<array<long>>"
NAMES = ("uids", "ids", "labels", "unnamed")
LONGS = pa.list_(pa.int64())


def packed(step: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a block -> one row with their panels, each ``step`` dimensions wide, in the smallest integers that hold them."""

    def pack(t: pa.Table) -> pa.Table:
        q, labels = matrix(t.column("q")), t.column("label").to_numpy()
        kind = next(k for k in ("<i2", "<i4", "<i8") if not q.size or (np.iinfo(k).min <= q.min() and q.max() <= np.iinfo(k).max))
        panels = [q[:, c : c + step].astype(kind).tobytes() for c in range(0, q.shape[1], step)]
        columns = {"low": pa.array([labels.min()]), "high": pa.array([labels.max()]), "kind": pa.array([kind])}
        named = t.column("uid"), t.column("id").fill_null(NO_ID), t.column("label"), t.column("id").is_null().cast(pa.int64())
        columns |= {c: pa.array([v.to_numpy().tobytes()], pa.binary()) for c, v in zip(NAMES, named, strict=True)}
        return pa.table(columns | {"panels": pa.array([panels], pa.list_(pa.binary())), "windows": pa.array([t.column("windows").to_pylist()], pa.list_(LONGS))})

    return pack


def blocks(rows: DataFrame, size: int, step: int, label: str) -> DataFrame:
    """(uid, id, label, q, windows) in blocks of about ``size`` rows, as a table.  A label with fewer than half as many rows shares its blocks with others."""
    counted = shared.keep(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size / 2).select(F.col("label").alias("own"), "n"), "labels")
    shared_n = rows.count() - (counted.agg(F.sum("n")).first()[0] or 0)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(max(shared_n, 1))) / size).cast("int")
    placed = rows.join(counted, F.col("label") == F.col("own"), "left").withColumn("part", F.pmod(F.xxhash64("uid"), parts))
    out = shared.keep(placed.select("own", "part", "uid", "id", "label", "q", "windows").groupBy("own", "part").applyInArrow(packed(step), BLOCK), label)
    shared.forget(counted)
    return out


class Block:
    """A row of ``blocks``, read from a struct column."""

    def __init__(self, column: pa.StructArray, k: int):
        self.fields, self.k = dict(zip((f.name for f in column.type), column.flatten(), strict=True)), k
        self.uids, self.ids, self.labels, self.unnamed = (np.frombuffer(self.fields[c][k].as_buffer(), np.int64) for c in NAMES)

    def panels(self) -> list[np.ndarray]:
        kind = self.fields["kind"][self.k].as_py()
        return [np.frombuffer(p.as_buffer(), kind).reshape(len(self.uids), -1) for p in self.fields["panels"][self.k]]

    def windows(self) -> list[list[int]]:
        return self.fields["windows"][self.k].as_py()


def tile_of(anchors: Block, rows: Block) -> np.ndarray:
    """Scores of two blocks, added up over the chunks of dimensions."""
    a, r = anchors.panels(), rows.panels()
    kind = exact(a, r)
    scores = np.zeros((len(anchors.uids), len(rows.uids)), kind)
    for x, y in zip(a, r):  # noqa: B905  what one side lacks is zero
        scores += product(x, y, kind)
    return scores


class Best:
    """Of an anchor block the first k rows of each anchor and window seen so far: higher scores first, then smaller ids."""

    def __init__(self, anchors: Block, k: int, bounds: tuple[int, int] | None):
        self.k, self.uids, self.ids, self.unnamed = k, anchors.uids, anchors.ids, anchors.unnamed
        windows = anchors.windows() if bounds else [[0]] * len(self.uids)
        n = max(map(len, windows), default=0)
        low, high = bounds or (0, 0)
        each = [[(None if len(x) <= w else x[w]) for x in windows] for w in range(n)]
        # low*p <= 100*score <= high*p; without bounds any score.
        self.low = np.array([[NO_ID if p is None else -((-low * p) // 100) if bounds else LEAST for p in x] for x in each], np.int64).reshape(n, -1)
        self.high = np.array([[LEAST if p is None else high * p // 100 if bounds else NO_ID for p in x] for x in each], np.int64).reshape(n, -1)
        self.low[self.low > self.high] = NO_ID
        self.held = [[np.zeros(0, np.int64)] * 4 for _ in range(n)]  # place of the anchor, score, whether the row has no id, id

    def add(self, allowed: np.ndarray, scores: np.ndarray, rows: Block) -> None:
        if not self.held:
            return
        # As numbers of the scores' kind: beyond what these hold exactly there are no scores.
        inside = scores >= self.low.min(0).astype(scores.dtype)[:, None]
        inside &= allowed
        some = np.flatnonzero(inside.any(1))
        a, r = np.nonzero(inside[some])
        a = some[a]
        score = scores[a, r].astype(np.int64)
        for w, held in enumerate(self.held):
            hit = (score >= self.low[w, a]) & (score <= self.high[w, a])
            if not hit.any():
                continue
            found = a[hit], score[hit], rows.unnamed[r[hit]], rows.ids[r[hit]]
            every = [np.concatenate(x) for x in zip(held, found, strict=True)]
            order = np.lexsort((every[3], every[2], -every[1], every[0]))
            every = [x[order] for x in every]
            rank = np.arange(len(order)) - np.searchsorted(every[0], every[0])
            self.held[w] = [x[rank < self.k] for x in every]
            # No row below the k-th of an anchor can be among its first k any more.
            full = rank == self.k - 1
            self.low[w, every[0][full]] = every[1][full]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for w, (a, score, unnamed, ids) in enumerate(self.held, 1):
            anchor = pa.array(self.uids[a]), pa.array(self.ids[a], mask=self.unnamed[a].astype(bool))
            found = pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(score, pa.int64())
            yield pa.RecordBatch.from_arrays([*anchor, pa.array(np.full(len(a), w), pa.int32()), *found], ["anchor_uid", "anchor_id", "window", "other_id", "score"])


FOUND = "anchor_uid long, anchor_id long, window int, other_id long, score long"


def top_rows(k: int, bounds: tuple[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks -> the first k rows of each anchor: of its own label, or with ``bounds`` of other labels in each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, rows = (Block(batch.column(side), i) for side in ("anchors", "rows"))
                if (key := int(anchors.uids[0])) not in seen:
                    seen[key] = Best(anchors, k, bounds)
                same = rows.labels == anchors.labels[:, None]
                allowed = ~same if bounds else same & (rows.uids != anchors.uids[:, None])
                seen[key].add(allowed, tile_of(anchors, rows), rows)
        for best in seen.values():
            yield from best.rows()

    return run


def dealt(blocks_of: DataFrame, parts: int) -> DataFrame:
    return blocks_of.select(F.struct(*blocks_of.columns).alias("block")).repartition(parts)


def score_tiles(rows: DataFrame, anchors: DataFrame, k: int, bounds: tuple[int, int] | None) -> DataFrame:
    """FOUND of every tile; without ``bounds`` only of tiles in which a label may be on both sides.

    Tasks grow in number with the pairs of blocks; while these are few, there is work for every core.
    """
    spark = rows.sparkSession
    n, m = max(1, rows.count()), max(1, anchors.count())
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    across = -(-m // HELD)
    down = min(n, max(-(-wanted // across), -(-n // LONGEST)))
    left, right = dealt(rows, down).withColumnRenamed("block", "rows"), dealt(anchors, across).withColumnRenamed("block", "anchors")
    meet = F.lit(True) if bounds else (F.col("rows.low") <= F.col("anchors.high")) & (F.col("anchors.low") <= F.col("rows.high"))
    return left.join(right.hint("shuffle_replicate_nl"), meet).mapInArrow(top_rows(k, bounds), FOUND)


def first(rows: DataFrame, groups: list[str], k: int, rank: str) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before it shuffles."""
    w = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors.  ``low`` and ``high`` bound a negative's score in percent of the positive's.
    """
    rows = quantised(vectors, anchor, scale)
    dims = rows.agg(F.max(F.size("q"))).first()[0] or 1
    step = max(CHUNK_DIMS, -(-dims // CHUNKS))
    size, anchor_size = (max(1, min(x, CELLS // max(dims, 1))) for x in (ROWS, ANCHORS))
    none = F.lit(None).cast("array<bigint>").alias("windows")
    columns = ["uid", "id", "label", "q"]
    every = blocks(rows.select(*columns, none), size, step, "blocks")
    anchors = blocks(rows.where("anchor").select(*columns, none), anchor_size, step, "anchors")
    # At most ``positives`` rows an anchor; read for the windows and for the result.
    found = score_tiles(every, anchors, positives, None)
    kept = shared.keep(first(found, ["anchor_uid"], positives, "nth"), "positives", BATCH)
    shared.forget(anchors)
    windows = kept.groupBy("anchor_uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("windows"))
    searching = shared.keep(rows.where("anchor").join(windows.hint("merge"), F.col("uid") == F.col("anchor_uid")).select(*columns, "windows"), "windows")
    anchors = blocks(searching, anchor_size, step, "anchors")
    shared.forget(rows, searching)
    below = score_tiles(every, anchors, negatives, (low, high))
    hard = shared.keep(first(below, ["anchor_uid", "window"], negatives, "rank"), "negatives", BATCH)
    shared.forget(every, anchors)
    same = (F.col("h.anchor_uid") == F.col("p.anchor_uid")) & (F.col("h.window") == F.col("p.nth"))
    return hard.alias("h").join(kept.alias("p").hint("merge"), same).select(
        F.col("p.anchor_id").alias("anchor_id"),
        F.col("p.other_id").alias("positive_id"),
        F.col("h.rank").cast("int").alias("rank"),
        F.col("h.other_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("h.score").alias("negative_score"),
    )
