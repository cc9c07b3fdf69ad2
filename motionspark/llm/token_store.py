"""Token ids of whole texts in files of wavelet matrices.

``write_token_store`` deals the documents by ranges of doc_id, encodes them in that order and writes one
zstd-compressed Parquet file per task through Spark's own writer, so that a lost executor leaves no half
files and any store that Spark writes to will do.  A row of a file is a shard: the wavelet matrix of up to
``SHARD_TOKENS`` ids (a single longer document makes a longer shard), with the doc_ids and the end of each
document.  Reading needs no shuffle of ids: a shard is one row.

The tokenizer's cuts never cross a single space or line feed between two other characters, so the ids of
a text are those of its units: each word with the space or line feed before it.  The ids of units are
remembered within a task; a new one is cut by the vocabulary's pattern, and the library's model encodes what
has not been met before.  Texts with other white space are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.llm.text import binary, slices
from motionspark.llm.wavelet import WaveletMatrix

SHARD_TOKENS = 4_000_000
SLICE_ROWS, SLICE_BYTES = 10_000, 12_000_000  # texts whose units are told apart together
REMEMBERED = 1_000_000  # units that a Python worker knows the ids of, also from one task to the next
SCHEMA = "part int, seq int, n_tokens long, width int, nulls int, doc_ids binary, ends binary, zeros array<long>, planes array<binary>, ranks array<binary>"


class Encoder:
    """Texts -> ids as little-endian bytes, 2 a token where the vocabulary allows it."""

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        largest = max(self.tokenizer.get_vocab().values())
        self.dtype = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
        self._forget()
        self.cut = regex.compile(PATTERN).findall
        self.letters = self._letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.space = self.letters[32]
        self.line = np.frombuffer(self._whole(["\n"])[0], self.dtype).tolist()

    @staticmethod
    def _letters(byte_level) -> dict[int, str]:
        """The letter that stands for each byte of UTF-8 in a byte-level vocabulary, as the library gives it."""
        of = lambda data: byte_level.pre_tokenize_str(data.decode())[0][0]
        out = {b: of(bytes([b])) for b in range(0x80)}
        out |= {b: of(bytes([0xC2, b]))[1] for b in range(0x80, 0xC0)}
        for lead in range(0xC2, 0xF5):
            rest = {0xE0: b"\xa0\x80", 0xF0: b"\x90\x80\x80"}.get(lead, b"\x80" * (1 + (lead >= 0xE0) + (lead >= 0xF0)))
            out[lead] = of(bytes([lead]) + rest)[0]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.ids, self.start, self.count = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tokens(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _piece(self, piece: str) -> list[int]:
        """Ids of what the pattern cuts out, by the library's model."""
        found = self.pieces.get(piece)
        if found is None:
            self.pieces[piece] = found = self._tokens(piece.encode().decode("latin-1").translate(self.letters))
        return found

    def _unit(self, unit: bytes) -> list[int]:
        if unit[0] == 10:
            return self.line + (self._unit(unit[1:]) if len(unit) > 1 else [])
        bare = unit[1:] if unit[0] == 32 else unit
        if bare.isalpha():  # letters of ASCII
            return self._tokens(self.space + bare.decode() if unit[0] == 32 else bare.decode())
        text = unit.decode()
        if text.lstrip(" ").isalpha():
            return self._tokens(unit.decode("latin-1").translate(self.letters))
        return [i for p in self.cut(text) for i in self._piece(p)]

    def _places(self, units: list[bytes]) -> np.ndarray:
        """Where the units stand in the table of ids; unknown ones are encoded first."""
        if len(self.place) > REMEMBERED:
            self._forget()
        if len(self.pieces) > REMEMBERED // 4:
            self.pieces = {}
        new = [u for u in units if u not in self.place]
        if new:
            ids = [self._unit(u) for u in new]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.count = np.concatenate([self.count, n])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.dtype, n.sum())])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        texts = binary(column)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        gap = (raw == 32) | (raw == 10)
        odd = odd_space(raw)
        odd[1:] |= gap[1:] & gap[:-1]
        full = at[:-1][np.diff(at) > 0]
        ends = at[1:][np.diff(at) > 0] - 1
        odd[full] |= gap[full]
        odd[ends] |= gap[ends]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(at, np.flatnonzero(odd), side="right") - 1] = True  # a text whose white space meets an edge or other white space
        gap[full] = True
        starts = np.flatnonzero(gap)
        offsets = pa.array(np.append(starts, len(raw)).astype(np.int32))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(data)])
        owner = np.searchsorted(at, starts, side="right") - 1
        if whole.any():
            units, owner = units.filter(pa.array(~whole[owner])), owner[~whole[owner]]
        coded = units.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        n = self.count[place]
        ids = self.ids[np.arange(n.sum()) + np.repeat(self.start[place] - (np.cumsum(n) - n), n)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, n, minlength=len(texts)))]).astype(np.int64) * self.dtype.itemsize
        rest = iter(self._whole([texts[i].decode() for i in np.flatnonzero(whole)]))
        return [next(rest) if w else ids[a:b] for w, a, b in zip(whole.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def odd_space(raw: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether white space other than space and line feed begins there."""
    out = ((raw >= 9) & (raw <= 13) & (raw != 10)) | ((raw >= 0x1C) & (raw <= 0x1F))
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    if len(lead):
        end = np.append(raw, [0, 0])
        a, b, c = raw[lead], end[lead + 1], end[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        quad = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[lead] = two | quad | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _shards(vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        width = 8 * coder.dtype.itemsize if coder.dtype.itemsize == 2 else 18
        end = np.array([end_id], coder.dtype).tobytes()

        def flush():
            ids = np.frombuffer(b"".join(codes), coder.dtype)
            w = max(width, int(ids.max()).bit_length())
            m = WaveletMatrix.build(ids, w)
            row = {
                "part": part, "seq": seq, "n_tokens": len(ids), "width": w,
                "nulls": docs.count(None), "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
                "ends": np.cumsum([len(c) // coder.dtype.itemsize for c in codes], dtype="<u4").tobytes(), "zeros": m.zeros,
                "planes": [p.tobytes() for p in m.planes], "ranks": [r.astype("<u4").tobytes() for r in m.ranks],
            }
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        docs, codes, size = [], [], 0
        for piece in slices(batches, 1, SLICE_ROWS, SLICE_BYTES):
            for doc_id, code in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1)), strict=True):
                if docs and size + len(code) > SHARD_TOKENS * coder.dtype.itemsize:
                    yield flush()
                    seq, docs, codes, size = seq + 1, [], [], 0
                docs.append(doc_id)
                codes.append(code + end)
                size += len(code) + len(end)
        if docs:
            yield flush()

    return write


def write_token_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, tasks: int | None = None) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text, ...), each ended by ``end_id``, in ascending doc_id order.

    There is a file for each of ``tasks`` ranges of doc_id; without a number as many as the input has partitions.

    A null text is empty: its ids are the end id alone.  Rows that repeat a doc_id are documents of their
    own, ordered by text.  Rows without a doc_id come first.  An empty table gives a store without shards.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange(tasks or max(1, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(vocabulary, end_id), SCHEMA).write.option("compression", "zstd").parquet(path)


def matrix(row: dict) -> WaveletMatrix:
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    return WaveletMatrix(row["n_tokens"], list(row["zeros"]), planes, [np.frombuffer(r, "<u4") for r in row["ranks"]])


def _doc_ids(row: dict) -> pa.Array:
    ids = np.frombuffer(row["doc_ids"], "<i8")
    return pa.array(ids, mask=np.arange(len(ids)) < row["nulls"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def open_token_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def token_starts(store: DataFrame) -> DataFrame:
    """(part, seq, before): ids of all shards before each one; one narrow row a shard."""
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return store.select("part", "seq", "n_tokens").select("part", "seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("before"))


def document_digests(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for row in _rows(batches):
            ids = memoryview(matrix(row).decode(np.uint16 if row["width"] <= 16 else np.uint32).astype("<u4")).cast("B")
            ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(ends)
            arrays = [np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), _doc_ids(row), starts, ends - starts, np.array(crc, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = store.mapInArrow(read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(token_starts(store), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(store: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences in all shards, by rank."""

    def count(batches):
        for row in _rows(batches):
            m = matrix(row)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.rank(t, m.n) for t in tokens], pa.int64())], ["token", "n"])

    return store.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(store: DataFrame, token: int) -> DataFrame:
    """(position, doc_id) of every occurrence of one token, by select within each shard."""

    def find(batches):
        for row in _rows(batches):
            m = matrix(row)
            at = np.array([m.select(token, k) for k in range(m.rank(token, m.n))], np.int64)
            doc = _doc_ids(row).take(pa.array(np.searchsorted(np.frombuffer(row["ends"], "<u4"), at, side="right")))
            part, seq = (np.full(len(at), row[c], np.int32) for c in ("part", "seq"))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, seq, at, doc)], ["part", "seq", "at", "doc_id"])

    found = store.mapInArrow(find, "part int, seq int, at long, doc_id long")
    return found.join(token_starts(store), ["part", "seq"]).select((F.col("before") + F.col("at")).alias("position"), "doc_id")
