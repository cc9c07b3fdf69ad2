"""Quality scores by co-training a text classifier and a page-metadata classifier.

The text view sees the letters: hashed byte pairs and a few shares of characters and words.  The metadata view
sees language, source and length; neither has what the other one has.  Each starts from the labelled rows alone; over rounds, each labels
unlabelled rows it is sure of for the other one.  On labelled rows kept apart, a logistic curve
calibrates each view, and another one over both calibrated views gives the score of every document.

At most ``LABELLED`` labelled rows, chosen by hash, are fitted on; every other row of the corpus is unlabelled and
takes part in each round.  Its views are a table that tasks pass over: once a round for the rows to teach with and
once for each Newton step, of which only sums of the size of a Hessian reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm import shared
from motionspark.llm.text import binary
from motionspark.llm.toxicity import fit_logistic

LABELLED = 12_000
ROUNDS, STEPS, RIDGE = 5, 12, 5.0
SURE, BINS = 0.95, 4096
LEAST = float(np.log(SURE / (1 - SURE)))
SUMS = 8
PAIRS = 256
SOURCES, LANGUAGES, LENGTHS = 64, 16, 40
KEPT_FROM = 0.5
LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(256)])
KINDS = [np.array([chr(i) in s for i in range(256)]) for s in ("#*$%&|<>", "|", "0123456789", ".,;:!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\r\n\x0b\x0c", "\n")]


def text_view(data: bytes) -> np.ndarray:
    """What a text is made of, in shares that do not tell its length."""
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(PAIRS + len(KINDS) + 3)
    if len(b):
        once = np.bincount(b, minlength=256)
        pair = (b[:-1].astype(np.int64) * 31 + b[1:]) % PAIRS
        out[:PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(b))
        out[PAIRS : PAIRS + len(KINDS)] = [once[k].sum() / len(b) for k in KINDS]
        words = data.split()
        n = max(1, len(words))
        out[-3:] = once[LETTER].sum() / len(b), len(b) / n / 10, len(set(words)) / n
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int) -> np.ndarray:
    """Language, source and length, the length also by powers of two."""
    out = np.zeros(LANGUAGES + SOURCES + LENGTHS + 1)
    out[zlib.crc32((lang or "").encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[LANGUAGES + SOURCES + min(LENGTHS - 1, int(n_chars).bit_length())] = 1
    out[-1] = np.log1p(n_chars)
    return out


TEXT = len(text_view(b""))  # columns of the text view, which come first


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, text view, metadata view) of rows (doc_id, lang, source, n_chars, text)."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            piece = b.slice(at, 500)
            ids, langs, sources, chars = (piece.column(i).to_pylist() for i in range(4))
            texts = binary(piece.column(4))
            if texts:
                meta = [metadata_view(*x) for x in zip(langs, sources, chars, strict=True)]
                yield ids, np.array([text_view(t) for t in texts]), np.array(meta)


@dataclass
class View:
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.std) @ self.weights[:-1] + self.weights[-1], -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.offset


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _bin(sure: np.ndarray) -> np.ndarray:
    """Bin of a logit from that of SURE on; -1 below."""
    return np.where(sure >= LEAST, np.minimum(BINS - 1, (sure - LEAST) / (30 - LEAST) * BINS), -1).astype(np.int64)


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :TEXT], x[:, TEXT:]]


def _taught(views: list[np.ndarray], rounds: list[tuple]) -> list[np.ndarray]:
    """What each view's classifier has been taught of these rows in the rounds so far (their models and cuts); nan is nothing."""
    taught = [np.full(len(views[0]), np.nan), np.full(len(views[0]), np.nan)]
    for models, cuts in rounds:
        for k, z in enumerate([m.logit(x) for m, x in zip(models, views, strict=True)]):
            open_rows = np.isnan(taught[1 - k])
            taught[1 - k][open_rows & (_bin(z) >= cuts[k][0])] = 1.0
            taught[1 - k][open_rows & (_bin(-z) >= cuts[k][1])] = 0.0
    return taught


def _newton(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rows' loss (less log-likelihood), its gradient downwards and its Hessian's upper triangle, as one vector."""
    at = z @ w
    p = _probability(np.clip(at, -30, 30))
    loss = (np.logaddexp(0, at) - y * at).sum()
    hessian = (z * (p * (1 - p))[:, None]).T @ z
    return np.concatenate([[loss], z.T @ (y - p), hessian[np.triu_indices(len(w))]])


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | float:
    """Sum of ``work`` over blocks of the rows' views, added up in each task, in SUMS tasks and on the driver; 0 without rows."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                out = work(np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64))
                total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["s"])

    def add(batches):
        total = None
        for b in batches:
            for s in b.column(0).to_pylist():
                total = np.frombuffer(s) if total is None else total + np.frombuffer(s)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    sums = rows.select("x").mapInArrow(part, "s binary").repartition(SUMS).mapInArrow(add, "s binary").toArrow()
    return sum((np.frombuffer(s) for s in sums.column(0).to_pylist()), 0.0)


def _fit(models: list[View], views: list[np.ndarray], y: np.ndarray, rows: DataFrame | None, rounds: list[tuple]) -> list[View]:
    """Newton steps, shorter where one goes too far, from the models given, both views at once, over the labelled rows and all that the rounds have taught."""
    mean, std = [m.mean for m in models], [m.std for m in models]
    design = lambda k, x: np.column_stack([(x - mean[k]) / std[k], np.ones(len(x))])
    own, w = [design(k, v) for k, v in enumerate(views)], [m.weights.copy() for m in models]
    penalty = [np.append(np.full(len(x) - 1, RIDGE), 1e-3) for x in w]
    best = [(np.inf, x, x) for x in w]  # loss, weights, step from there
    for _ in range(STEPS):

        def work(x, w=tuple(w)):
            views = _split(x)
            parts = []
            for k, t in enumerate(_taught(views, rounds)):
                known = ~np.isnan(t)
                parts.append(_newton(design(k, views[k][known]), t[known], w[k]))
            return np.concatenate(parts)

        total = np.concatenate([_newton(z, y, x) for z, x in zip(own, w, strict=True)]) + (0.0 if rows is None else _summed(rows, work))
        at, largest = 0, 0.0
        for k, p in enumerate(penalty):
            n = len(p)
            loss, gradient, upper = total[at] + (p * w[k] ** 2).sum() / 2, total[at + 1 : at + 1 + n], total[at + 1 + n : at + 1 + n + n * (n + 1) // 2]
            at += 1 + n + n * (n + 1) // 2
            if loss <= best[k][0]:
                hessian = np.zeros((n, n))
                hessian[np.triu_indices(n)] = upper
                hessian = hessian + np.triu(hessian, 1).T + np.diag(p)
                step = np.linalg.solve(hessian, gradient - p * w[k])
                best[k] = loss, w[k], step
            else:  # too far
                best[k] = (*best[k][:2], best[k][2] / 4)
            w[k] = best[k][1] + best[k][2]
            largest = max(largest, np.abs(best[k][2]).max())
        if largest < 1e-2:
            break
    w = [b[1] for b in best]
    return [View(x, m, s) for x, m, s in zip(w, mean, std, strict=True)]


def co_train(views: list[np.ndarray], y: np.ndarray, rows: DataFrame, rounds: int = ROUNDS) -> list[View]:
    """A classifier of each view; in each round the rows that one is surest of, among all unlabelled ``rows`` (x), teach the other.

    A round takes as many rows as each class's share of its intake, down to a cut found by a histogram over all
    rows; a row's labels follow from the models and cuts of the rounds.
    """
    sums = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    mine = np.hstack(views)
    sums = sums + np.concatenate([[len(mine)], mine.sum(axis=0), (mine * mine).sum(axis=0)])
    size, n = mine.shape[1], sums[0]
    mean = sums[1 : 1 + size] / n
    std = np.sqrt(np.maximum(sums[1 + size :] / n - mean**2, 0))
    std = np.where(std > 1e-6, std, 1.0)
    models = [View(np.zeros(m.size + 1), m, s) for m, s in ((mean[:TEXT], std[:TEXT]), (mean[TEXT:], std[TEXT:]))]
    models, done, share = _fit(models, views, y, None, []), [], y.mean()
    for _ in range(rounds):

        def found(x, models=models, done=tuple(done)):
            views = _split(x)
            taught, out = _taught(views, list(done)), np.zeros((2, 2, BINS))
            for k in (0, 1):
                z = models[k].logit(views[k])[np.isnan(taught[1 - k])]
                for c, sure in enumerate((z, -z)):
                    b = _bin(sure)
                    out[k, c] = np.bincount(b[b >= 0], minlength=BINS)
            return out.ravel()

        counts = np.reshape(_summed(rows, found) + np.zeros(4 * BINS), (2, 2, BINS))
        if not counts.any():
            break
        most = [max(1, int(part * (n - len(y)) / (2 * rounds))) for part in (share, 1 - share)]
        # The lowest bin from which on no more rows lie than a round takes; at least the highest one that has any.
        cuts = [[_cut(counts[k, c], most[c]) for c in (0, 1)] for k in (0, 1)]
        done.append((models, cuts))
        models = _fit(models, views, y, rows, list(done))
    return models


def _cut(counts: np.ndarray, most: int) -> int:
    above = np.cumsum(counts[::-1])[::-1]
    fits = np.flatnonzero(above <= most)
    first = int(fits[0]) if len(fits) else BINS
    highest = int(np.flatnonzero(counts)[-1]) if counts.any() else BINS
    return min(first, highest)


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text, lang, source, n_chars, ...), from ``labels`` (doc_id, quality).

    The score is the calibrated probability of quality 1.  Null and empty texts have empty views and are
    scored too; a null or absent lang or source is a value of its own, a null or absent n_chars the text's
    length.  A doc_id labelled more than once is of low quality if one of its labels says so.  Without labels
    of both classes, among those to fit and those to calibrate, the score is the share of quality 1, or 0.5
    without any labels.  Other columns are not read.  An empty table gives no rows.
    """
    given = {c.lower() for c in docs.columns}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    column = lambda c, kind: F.col(c).cast(kind) if c in given else F.lit(None).cast(kind)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), column("lang", "string").alias("lang"), column("source", "string").alias("source"),
        F.greatest(F.coalesce(column("n_chars", "long"), F.length(text).cast("long")), F.lit(0)).alias("n_chars"), text.alias("text"),
    )
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("id", F.lit(4))).orderBy("h", "id").limit(labelled)
    chosen = shared.keep(known.select("id", "y", "h"), "chosen")

    def features(batches):
        for b in batches:
            at = 0
            for ids, t, m in _views([b.select(range(5))]):
                n = len(t)
                data = [x.tobytes() for x in np.hstack([t, m]).astype(np.float32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(b.column(i).slice(at, n) for i in (5, 6)), pa.array(data, pa.binary())], ["doc_id", "y", "h", "x"]
                )
                at += n

    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left").select("doc_id", "lang", "source", "n_chars", "text", "y", "h")
    rows = shared.keep(rows.mapInArrow(features, "doc_id long, y int, h long, x binary"), "views")
    got = rows.where("y is not null").select("y", "h", "x").toArrow()
    y, h = got.column("y").to_numpy(), got.column("h").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), TEXT + len(metadata_view(None, None, 0))).astype(np.float64)
    order = np.lexsort((x.sum(axis=1) if len(x) else h, h))
    y, h, x = y[order], h[order], x[order]
    views = _split(x)
    fits, checks = h % 4 != 0, h % 4 == 0
    if any(len(set(y[part])) < 2 for part in (fits, checks)):
        share = float(y.mean()) if len(y) else 0.5
        return docs.select("doc_id", F.lit(share).alias("score"))

    models = co_train([v[fits] for v in views], y[fits].astype(np.float64), rows.where("y is null"))
    truth = y[checks].astype(np.float64)
    for model, v in zip(models, views, strict=True):
        w, mean, std = fit_logistic(model.logit(v[checks])[:, None], truth)
        model.slope, model.offset = float(w[0] / std[0]), float(w[1] - w[0] * mean[0] / std[0])
    both = np.column_stack([m.calibrated(v[checks]) for m, v in zip(models, views, strict=True)])
    final = View(*fit_logistic(both, truth))
    model = docs.sparkSession.sparkContext.broadcast((models, final))

    def score(batches):
        (text_model, meta_model), final = model.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64)
            z = final.logit(np.column_stack([m.calibrated(v) for m, v in zip((text_model, meta_model), _split(x), strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_probability(z))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
