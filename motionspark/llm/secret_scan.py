"""Secret spans in whole texts, with DataFrame functions only.

Three patterns give the base spans.  On top, the scan slides a window over every candidate string of a
character class and keeps what its windows of high Shannon entropy cover.  A window's entropy is
log2(W) - S / W with S = sum of c * log2(c) over its symbols' counts c; moving the window by one symbol
changes two counts, so S follows from two table look-ups.  The table holds c * log2(c) in millionths of a
bit as integers, which makes thresholds exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match of [A-Z0-9]+ or [0-9a-f]+ runs to the end of its run, so those below the least length can be
# left out of the pattern itself; shorter "assign" matches take text from later ones and are dropped after.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12

# Added spans never come from strings that match one of these.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted",
    r"(?i)0123456789|abcdefgh|xxxxxx",
    r"^[0-9]+$",
    r"^[A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``pattern``; ``alphabet`` are the symbols told apart."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]
    fold: bool = False

    @property
    def limit(self) -> int:
        return math.floor((math.log2(self.window) - self.bits) * self.window * 1e6)


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 2.9, ("[0-9]", "[A-Fa-f]"), fold=True),
    CharClass(
        "entropy_base64", r"[A-Za-z0-9+/_=-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.7, ("[0-9]", "[A-Z]", "[a-z]"),
    ),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches, in code points: the pieces between matches tell where each one starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("spans"))
    placed = F.aggregate(
        F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g)).alias("g")),
        none,
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(a["spans"], F.array(_span(kind, a["at"] + x["g"], a["at"] + x["g"] + x["m"]))).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return F.when(F.size(found) > 0, placed).otherwise(none["spans"])


def _high(candidate: Column, c: CharClass) -> Column:
    """struct<first, last>: what the windows of high entropy cover, 0-based with the end excluded; first is null without any."""
    table = F.array(*(F.lit(0 if n < 2 else round(n * math.log2(n) * 1e6)) for n in range(c.window + 2)))
    # What enters and what leaves at each step is laid out before: an expression inside the fold is computed again at each step.
    symbols = F.filter(F.split(F.lower(candidate) if c.fold else candidate, ""), lambda s: s != "")
    codes = F.transform(symbols, lambda s: F.instr(F.lit(c.alphabet), s) - 1)
    leaving = F.concat(F.array_repeat(F.lit(-1), c.window), codes)
    moves = F.filter(F.arrays_zip(codes.alias("new"), leaving.alias("old")), lambda m: m["new"].isNotNull())
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).alias("s"), F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(a: Column, m: Column) -> Column:
        new, old = m["new"], m["old"]
        n_in = F.get(a["counts"], new)
        up = a["s"] + F.get(table, n_in + 1) - F.get(table, n_in)
        n_out = F.get(a["counts"], old) + F.when(old == new, 1).otherwise(0)
        s = F.when(old < 0, up).otherwise(up + F.get(table, n_out - 1) - F.get(table, n_out))
        counts = F.transform(a["counts"], lambda n, k: F.when(k == new, n + F.when(k == old, 0).otherwise(1)).when(k == old, n - 1).otherwise(n))
        high = (a["i"] >= c.window - 1) & (s <= c.limit)
        return F.struct(
            counts.alias("counts"), s.alias("s"), (a["i"] + 1).alias("i"),
            F.when(a["first"].isNull() & high, a["i"] - (c.window - 1)).otherwise(a["first"]).alias("first"),
            F.when(high, a["i"] + 1).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(moves, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _added(text: Column, c: CharClass, taken: Column, allowed: tuple[str, ...]) -> Column:
    """Entropy spans of one class that overlap no span found before."""
    kept = lambda s: reduce(lambda x, y: x & y, [*(s.rlike(p) for p in c.needs), *(~s.rlike(p) for p in allowed)])
    candidates = F.filter(
        F.transform(_matches(text, c.pattern, c.kind), lambda m: F.struct(m.alias("m"), F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("s"))),
        lambda x: kept(x["s"]),
    )
    scored = F.filter(F.transform(candidates, lambda x: F.struct(x["m"].alias("m"), _high(x["s"], c).alias("h"))), lambda x: x["h"]["first"].isNotNull())
    spans = F.transform(scored, lambda x: _span(c.kind, x["m"]["start"] + x["h"]["first"], x["m"]["start"] + x["h"]["last"]))
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Adds ``out``: array<struct<start, rank, end>> ordered by start, then by the kind's place in KINDS.

    Null and empty texts have no spans.  Repeated rows are scanned each on its own; other columns pass
    through, except one already named ``out``, which is replaced.  The base kinds are always kept; an added
    span overlaps none of them and none of an earlier class.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = F.arrays_zip(
        _matches(t, ASSIGN, "assign").alias("m"), F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v)).alias("n")
    )
    spans = F.concat(
        F.transform(F.filter(long_enough, lambda x: x["n"] >= ASSIGN_LENGTH), lambda x: x["m"]),
        _matches(t, ACCESS, "access"),
        _matches(t, HEX, "hex"),
    )
    df = df.withColumn(out, spans)
    for c in CLASSES:
        more = F.when(t.rlike(c.pattern), _added(t, c, F.col(out), allowed)).otherwise(F.slice(F.col(out), 1, 0))
        df = df.withColumn(out, F.concat(F.col(out), more))
    return df.withColumn(out, F.array_sort(F.col(out)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
