"""Quality rules from tokeniser fertility.

Public vocabularies show how far a text is from ordinary language: characters per token and the entropy of
its tokens with a byte-level BPE, and the share of byte fallback among the pieces of a vocabulary that
spells unknown characters in bytes.  Each word is measured as it stands after a space, once per task and
word.  Entropy is relative to the highest that a text of so many tokens can have.

The measures vary with a text's length, so a band is of one language and one power of two of words.  It comes
from all its documents that pass the base rules: from the lower quartile less ``REACH`` interquartile ranges
to the upper quartile plus as many.  A band leans on its language's, and that on the band of all, the more the
fewer documents it has.  A document outside one of its bands is rejected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.llm import shared
from motionspark.llm.text import MULTIPLIERS, binary, mix, slices, word_codes

SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
REACH = 2.0
LEAST_REACH = 0.02  # a band goes at least so far beyond the quartiles
PRIOR = 100.0  # documents' worth by which a band leans on the wider one
BIN = 0.001
BROADCAST_ROWS = 50_000
REMEMBERED = 400_000
SCHEMA = "doc_id long, band_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double"


class Fertility:
    """Words -> ids of the byte-level BPE, pieces and byte pieces of the other vocabulary, each word measured once."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start, self.n_ids, self.n_pieces, self.n_bytes = (np.zeros(0, np.int64) for _ in range(4))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the words stand in the tables."""
        if len(self.place) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.place]
        if new:
            texts = [w.decode("utf-8", "replace") for w in new]
            ids = [self.bpe.encode_ordinary(" " + t) for t in texts]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            pieces = self.pieces.encode(texts, num_threads=1)
            n_pieces = np.fromiter(map(len, pieces), np.int64, len(pieces))
            byte = np.concatenate([[0], np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, n_pieces.sum())])])
            ends = np.cumsum(n_pieces)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, n.sum())])
            self.n_ids, self.n_pieces = np.concatenate([self.n_ids, n]), np.concatenate([self.n_pieces, n_pieces])
            self.n_bytes = np.concatenate([self.n_bytes, byte[ends] - byte[ends - n_pieces]])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def measure(self, offsets: np.ndarray, codes: np.ndarray, words: list[bytes], chars: np.ndarray) -> list[np.ndarray]:
        """The three measures of each text of a piece, from its words as ``word_codes`` gives them and its characters in words."""
        at = self.places(words)[codes] if len(codes) else codes
        per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        n = self.n_ids[at]
        tokens, pieces, byte = per_text(n), per_text(self.n_pieces[at]), per_text(self.n_bytes[at])
        ids = self.ids[np.arange(n.sum()) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)].astype(np.int64)
        keys = np.sort(np.repeat(np.arange(len(tokens)), tokens) << 32 | ids)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        text, count = keys[first] >> 32, np.diff(np.concatenate([first, [len(keys)]]))
        p = count / np.maximum(1, tokens)[text]
        entropy = np.bincount(text, -p * np.log2(p), minlength=len(tokens))
        entropy = np.where(tokens > 1, entropy / np.log2(np.maximum(2, tokens)), 0.0)
        return [np.where(tokens > 0, chars / np.maximum(1, tokens), 0.0), byte / np.maximum(1, pieces), entropy]


@lru_cache(maxsize=1)
def fertility(ranks: str, pattern: str, pieces: str) -> Fertility:
    return Fertility(ranks, pattern, pieces)


def repeated_words(offsets: np.ndarray, codes: np.ndarray, width: int = 3) -> np.ndarray:
    """Of each text the words inside a window of ``width`` words that is found twice or more in it."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:n] == text[width - 1 :]
    key = text[:n].astype(np.uint64) * MULTIPLIERS[width]
    for i in range(width):
        key = key + codes[i : i + n].astype(np.uint64) * MULTIPLIERS[i]
    key = mix(mix(key))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again &= inside
    covered = np.zeros(len(codes), bool)
    for i in range(width):
        covered[i : i + n] |= again
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[offsets])


def measure_texts(docs: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """The base counts and the three measures of each row of (doc_id, band_key, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fertility(ranks, pattern, pieces)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in slices(batches, 2):
            offsets, codes, words = word_codes(b.column(2), lower=False)
            length = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
            chars = np.diff(np.concatenate([[0], np.cumsum(length[codes] if len(codes) else codes)])[offsets])
            symbols, again = [], []
            for t in binary(b.column(2)):
                symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
                lines = [x for x in t.split(b"\n") if x.strip()]
                again.append(len(lines) - len(set(lines)))
            counts = (np.diff(offsets), chars, symbols, again, repeated_words(offsets, codes))
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(c, pa.float64()) for c in f.measure(offsets, codes, words, chars)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return docs.mapInArrow(measure, SCHEMA)


def bands(passed: DataFrame, reach: float) -> DataFrame:
    """(band_key, band_length, low and high of each measure) from the measures of (band_key, band_length, ...).

    Quartiles come from counts in bins of ``BIN``, so they do not depend on how the rows are dealt.  Those of a
    band are drawn towards the language's, and these towards those of all, as if ``PRIOR`` further documents
    stood there: few documents weigh little, at every size.
    """
    binned = F.array(*(F.struct(F.lit(i).alias("m"), F.floor(F.col(c) / F.lit(BIN)).cast("long").alias("bin")) for i, c in enumerate(MEASURES)))
    counts = passed.select("band_key", "band_length", F.explode(binned).alias("x")).groupBy("band_key", "band_length", "x.m", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    counts = shared.keep(counts, "fertility-bins")

    def quartiles(name: str, *keys: str) -> DataFrame:
        whole = Window.partitionBy(*keys, "m")
        found = counts.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        found = found.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
        at = lambda i, q: F.min(F.when((F.col("m") == i) & (F.col("upto") * 4 >= F.col("all") * q), F.col("bin"))) * F.lit(BIN)
        cuts = [x for i, c in enumerate(MEASURES) for x in (at(i, 1).alias(f"{name}_low_{c}"), (at(i, 3) + BIN).alias(f"{name}_high_{c}"))]
        return found.groupBy(*keys).agg(F.max("all").alias(f"{name}_n"), *cuts)

    joined = quartiles("own", "band_key", "band_length").join(quartiles("lang", "band_key"), "band_key").crossJoin(quartiles("all"))  # the last has one row

    def drawn(c: str, side: str):
        mixed = lambda n, near, far: (F.col(n) * F.col(near) + F.lit(PRIOR) * far) / (F.col(n) + F.lit(PRIOR))
        return mixed("own_n", f"own_{side}_{c}", mixed("lang_n", f"lang_{side}_{c}", F.col(f"all_{side}_{c}")))

    out = []
    for c in MEASURES:
        low, high = drawn(c, "low"), drawn(c, "high")
        slack = F.greatest(F.lit(reach) * (high - low), F.lit(LEAST_REACH))
        out += [(low - slack).alias(f"low_{c}"), (high + slack).alias(f"high_{c}")]
    return shared.keep(joined.select("band_key", "band_length", *out), "fertility-bands")


def quality_rules(docs: DataFrame, ranks: str, pattern: str, pieces: str, language: str = "lang", reach: float = REACH) -> DataFrame:
    """(doc_id, base counts, measures, base_failed, kept) for each row of ``docs`` (doc_id, text, lang, ...).

    Null and empty texts have no words and fail the base rules.  A null language, or a table without that
    column, counts as one language of its own.  Repeated rows are judged alike.  Other columns are not read.
    An empty table gives no rows.
    """
    key = F.coalesce(F.col(language).cast("string"), F.lit("")) if language in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("band_key"), F.col("text").cast("string").alias("text"))
    m = shared.keep(measure_texts(docs, ranks, pattern, pieces), "fertility")
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    m = m.withColumn("band_length", F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))).cast("int"))

    found = bands(m.where("not base_failed"), reach)
    # A band holds a document at least; more of them than a task should hold are not broadcast.
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = m.join(found, ["band_key", "band_length"], "left")
    verdict = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")) for c in MEASURES])
    return joined.select(*m.columns, (~F.col("base_failed") & F.coalesce(verdict, F.lit(False))).alias("kept")).drop("band_key", "band_length")
