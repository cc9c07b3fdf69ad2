"""Words and hashes of texts, for use inside tasks.

A text reaches these functions as UTF-8 bytes.  ``bytes.split()`` cuts at exactly
space and \\x09-\\x0D, and ``bytes.lower()`` changes only A-Z, which is the word
rule used by the operators of this subpackage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MASK = (1 << 64) - 1
# Odd multipliers for combining the hashes of neighbouring words.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15 * pow(0xC2B2AE3D27D4EB4F, i, 1 << 64) & MASK for i in range(64)], dtype=np.uint64
)


class WordHash(dict):
    """word -> 64-bit hash; forgets everything once it holds ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows in order; the whole sequence if it is shorter; none without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    w = min(width, n)
    total = np.full(n - w + 1, w, dtype=np.uint64)
    for i in range(w):
        total = total + word_hashes[i : n - w + 1 + i] * MULTIPLIERS[i]
    return mix(total)


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of (id, ..., text as bytes); the text is the last column."""
    for b in batches:
        head = [b.column(i).to_pylist() for i in range(b.num_columns - 1)]
        yield from zip(*head, binary(b.column(b.num_columns - 1)), strict=True)


SLICE_ROWS, SLICE_BYTES = 2000, 4_000_000


def slices(batches: Iterable[pa.RecordBatch], text: int, rows: int = SLICE_ROWS, size_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows and, a single long text aside, of bytes in column ``text``."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(size, before + size_bytes, side="right"))))
            yield b.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # a worker goes on to other tasks


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(offsets, codes, words) of a string column: the words of text i are words[codes[offsets[i] : offsets[i + 1]]].

    Null texts have no words.
    """
    texts = pc.fill_null(texts, "")  # no cast: lower() misreads slices that have been cast to other offsets
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if b"" in words:  # white space at an end of a text
        full = codes != words.index(b"")
        ends, codes = np.concatenate([[0], np.cumsum(full)])[ends], codes[full]
    return ends, codes, words


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_sets(offsets: np.ndarray, word_hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, shingles): the sorted distinct shingles of each text, as ``shingles`` makes them."""
    n = np.diff(offsets)
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    total = len(word_hashes) - width + 1
    if total > 0:
        whole = np.full(total, width, np.uint64)
        for i in range(width):
            whole += word_hashes[i : i + total] * MULTIPLIERS[i]
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1] - offsets[:-1], size)
        flat = mix(whole[np.minimum(inside, total - 1)])
    else:
        flat = np.zeros(ends[-1], np.uint64)
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        flat[ends[i]] = shingles(word_hashes[offsets[i] : offsets[i + 1]], width)[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        flat[a:b].sort()
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[ends[:-1][size > 0]] = True
    return np.concatenate([[0], np.cumsum(first)])[ends], flat[first]
