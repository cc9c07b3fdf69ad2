"""How the camera turned between two frames, from points matched in both: consensus over seeded samples.

A frame pair is a row with its ``camera`` (see ``warp.camera``) and ``lines``, an array of (x1, y1, x2, y2) in pixels.  The
lens is undone first, so that a point is a unit ray; the answer is the turn R for which rays of the later frame are
R times those of the earlier one.  Frame pairs are independent of one another: nothing is shuffled.

Three methods, named in METHODS:

* ``rotation``: rays only turn.  Samples of three matches give 200 turns by orthogonal fit; the one with most rays within
  0.05 degrees is fitted again on those.  Fewer than three of them give no turn at all: the identity.
* ``essential``: the camera may move as well.  Of 512 epipolar fits to eight matches the one with the least median distance counts.
* ``eight_point``: the same fits, held against three bounds of the distance in turn, the closest first; the first bound which
  twice the sample's matches keep decides.

The epipolar methods have no answer (null) with fewer than ten matches in front of both cameras.  Lines with null,
non-finite or unseen ends do not take part.  Samples are drawn from the pair's recording and time, so that a row has one answer
wherever it is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators.lens import BACK
from motionspark.operators.warp import Frame

# Samples and angle of the turning rays; matches that must lie in front; bounds of the squared sines.
SAMPLES, WITHIN_DEG, LEAST_IN_FRONT, BOUNDS = 200, 0.05, 10, (1e-10, 1e-8, 1e-6)
EPIPOLAR_SAMPLES = 512
PARALLEL = 1e-4  # rays with less parallax meet at infinity, in front
BLOCK = 1_000_000  # distances held at a time

Answer = tuple[np.ndarray | None, int]


def rays(frames: Sequence[Frame], pixels: Sequence[np.ndarray]) -> list[np.ndarray]:
    """(n, 3) for the pixels (n, 2) of each frame: unit rays, nan where the lens sees none.  Frames of one lens model go through it together."""
    out = [np.empty((0, 3))] * len(frames)
    for model in {f.model for f in frames}:
        own = [i for i, f in enumerate(frames) if f.model == model]
        n = [len(pixels[i]) for i in own]
        spread = lambda c: np.repeat([getattr(frames[i], c) for i in own], n)  # noqa: B023, E731
        x, y = np.concatenate([pixels[i] for i in own]).T
        with np.errstate(all="ignore"):
            u, v = BACK[model]((x - spread("cx")) / spread("fx"), (y - spread("cy")) / spread("fy"), np.repeat(np.concatenate([frames[i].k for i in own]), n, 0))
            r = np.stack([u, v, np.ones_like(u)], 1)
            r = r / np.linalg.norm(r, axis=1, keepdims=True)
        for i, part in zip(own, np.split(r, np.cumsum(n)[:-1]), strict=True):
            out[i] = part
    return out


def draws(seed: tuple[int, int], n: int, times: int, size: int) -> np.ndarray:
    """(times, size) places below n, different within a row."""
    random = np.random.Generator(np.random.Philox(key=[v & 0xFFFFFFFFFFFFFFFF for v in seed]))
    out = np.empty((times, 0), np.int64)
    for j in range(size):
        v = np.floor(random.random(times) * (n - j)).astype(np.int64)
        for taken in np.sort(out, axis=1).T:
            v += v >= taken
        out = np.concatenate([out, v[:, None]], 1)
    return out


def turn_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., 3, 3): rotations that take the rays ``a`` (..., n, 3) closest to ``b``."""
    u, _, v = np.linalg.svd(np.swapaxes(b, -1, -2) @ a)
    u = u * np.stack([np.ones(u.shape[:-2]), np.ones(u.shape[:-2]), np.linalg.det(u @ v)], -1)[..., None, :]
    return u @ v


def _blocks(fits: np.ndarray, n: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // max(n, 1))
    return (fits[i : i + step] for i in range(0, len(fits), step))


def rotation(a: np.ndarray, b: np.ndarray, seed: tuple[int, int]) -> Answer:
    least = 2 * np.sin(np.radians(WITHIN_DEG) / 2)
    still = np.eye(3), 0
    if len(a) < 3:
        return still
    at = draws(seed, len(a), SAMPLES, 3)
    fits = turn_between(a[at], b[at])
    near = lambda r: ((a @ np.swapaxes(r, -1, -2) - b) ** 2).sum(-1) <= least * least
    counts = np.concatenate([near(block).sum(1) for block in _blocks(fits, len(a))])
    best = near(fits[int(np.argmax(counts))])
    if best.sum() < 3:
        return still
    r = turn_between(a[best], b[best])
    return r, int(near(r).sum())


def epipolar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., 3, 3): matrices E with b E a = 0, of matches (..., n, 3); their two sizes are made equal."""
    design = (b[..., :, None] * a[..., None, :]).reshape(*a.shape[:-1], 9)
    if design.shape[-2] == 8:
        least = np.linalg.qr(np.swapaxes(design, -1, -2), mode="complete")[0][..., -1]  # stands on all eight
    else:
        least = np.linalg.svd(design, full_matrices=False)[2][..., -1, :]
    u, _, v = np.linalg.svd(least.reshape(*a.shape[:-2], 3, 3))
    return u @ (np.array([1.0, 1.0, 0.0])[:, None] * v)


def distances(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared sines of the angles between rays and the planes that their matches leave them, the larger of the two."""
    there, back = a @ np.swapaxes(e, -1, -2), b @ e
    off = (there * b).sum(-1) ** 2
    return off / np.maximum(np.minimum((there * there).sum(-1), (back * back).sum(-1)), 1e-300)


def turn_of(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> Answer:
    """Of the turns and directions that make up ``e`` the one that has most matches in front; the smaller turn of equal ones."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    quarter = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    found = []
    for r in (u @ quarter @ v, u @ quarter.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            turned = a @ r.T
            c, p, q = (turned * b).sum(1), turned @ t, b @ t
            front = (c * q - p > -PARALLEL) & (q - c * p > -PARALLEL)
            found.append((int(front.sum()), float(np.trace(r)), r))
    n, _, r = max(found, key=lambda x: x[:2])
    return (r, n) if n >= LEAST_IN_FRONT else (None, n)


def _epipolar_fits(a: np.ndarray, b: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    at = draws(seed, len(a), EPIPOLAR_SAMPLES, 8)
    return epipolar(a[at], b[at])


def essential(a: np.ndarray, b: np.ndarray, seed: tuple[int, int]) -> Answer:
    n = len(a)
    if n < LEAST_IN_FRONT:
        return None, 0
    fits = _epipolar_fits(a, b, seed)
    medians = np.concatenate([np.median(distances(block, a, b), axis=1) for block in _blocks(fits, n)])
    best = int(np.argmin(medians))
    # The spread of the good half, as of a normal distribution, with the usual correction for few matches.
    bound = max((2.5 * 1.4826 * (1 + 5 / max(n - 8, 1))) ** 2 * medians[best], 1e-14)
    near = distances(fits[best], a, b) <= bound
    if near.sum() < LEAST_IN_FRONT:
        return None, int(near.sum())
    return turn_of(epipolar(a[near], b[near]), a[near], b[near])


def eight_point(a: np.ndarray, b: np.ndarray, seed: tuple[int, int]) -> Answer:
    if len(a) < 16:
        return None, 0
    fits = _epipolar_fits(a, b, seed)
    counts = np.concatenate([np.stack([(distances(block, a, b) <= v).sum(1) for v in BOUNDS], 1) for block in _blocks(fits, len(a))])
    for i, bound in enumerate(BOUNDS):
        best = int(np.argmax(counts[:, i]))
        if counts[best, i] >= 16:
            near = distances(fits[best], a, b) <= bound
            return turn_of(epipolar(a[near], b[near]), a[near], b[near])
    return None, 0


METHODS: dict[str, Callable[..., Answer]] = {"rotation": rotation, "essential": essential, "eight_point": eight_point}


def quaternion(r: np.ndarray) -> np.ndarray:
    """Of a rotation matrix, with w of 0 or more."""
    (a, b, c), (d, e, f), (g, h, i) = r
    k = np.array([[a - e - i, b + d, c + g, h - f], [b + d, e - a - i, f + h, c - g], [c + g, f + h, i - a - e, d - b], [h - f, c - g, d - b, a + e + i]])
    x, y, z, w = np.linalg.eigh(k)[1][:, -1]
    q = np.array([w, x, y, z])
    return -q if w < 0 else q


def estimate_poses(pairs: DataFrame, method: str = "rotation") -> DataFrame:
    """(recording_id, ts_us, next_ts_us, q, lines, inliers) of frame pairs (recording_id, ts_us, next_ts_us, camera, lines).

    ``q`` is null where there is no answer; ``lines`` counts the matches that took part, ``inliers`` those that agree.
    """
    solve = METHODS[method]

    def one(seed: tuple[int, int], a: np.ndarray, b: np.ndarray) -> tuple:
        known = np.isfinite(a).all(1) & np.isfinite(b).all(1)
        r, n = solve(a[known], b[known], seed)
        q = None if r is None else dict(zip("wxyz", quaternion(r).tolist(), strict=True))
        return q, int(known.sum()), n

    def some(part: pa.RecordBatch) -> list[tuple]:
        frames = [Frame({"camera": c, "times": None, "quats": None, "smooth": None}) for c in part.column("camera").to_pylist()]
        ends = part.column("lines").flatten()
        at = np.column_stack([np.asarray(v.to_numpy(zero_copy_only=False), np.float64) for v in (pc.struct_field(ends, c) for c in ("x1", "y1", "x2", "y2"))])  # null ends are nan
        cuts = np.cumsum(pc.fill_null(pc.list_value_length(part.column("lines")), 0).to_numpy(zero_copy_only=False))[:-1]
        both = [rays(frames, np.split(at[:, i : i + 2], cuts)) for i in (0, 2)]
        seeds = zip(*([v or 0 for v in part.column(c).to_pylist()] for c in ("recording_id", "ts_us")), strict=True)
        return [one(*x) for x in zip(seeds, *both, strict=True)]

    turn = pa.struct([(c, pa.float64()) for c in "wxyz"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                q, lines, inliers = zip(*some(part), strict=True)
                head = [part.column(c) for c in ("recording_id", "ts_us", "next_ts_us")]
                rest = [pa.array(q, turn), pa.array(lines, pa.int64()), pa.array(inliers, pa.int64())]
                yield pa.RecordBatch.from_arrays(head + rest, ["recording_id", "ts_us", "next_ts_us", "q", "lines", "inliers"])

    given = pairs.select(F.col("recording_id").cast("long"), F.col("ts_us").cast("long"), F.col("next_ts_us").cast("long"), "camera", "lines")
    schema = "recording_id long, ts_us long, next_ts_us long, q struct<w: double, x: double, y: double, z: double>, lines long, inliers long"
    return given.mapInArrow(run, schema)


def rates(poses: DataFrame) -> DataFrame:
    """(recording_id, ts_us, next_ts_us, gx, gy, gz): the turn of each pair as radians a second, null where it is not known."""
    v = Q.scaled_axis(F.col("q"))
    seconds = (F.col("next_ts_us") - F.col("ts_us")) / F.lit(1e6)
    rate = F.when(seconds > 0, F.struct(*((v[c] / seconds).alias(f"g{c}") for c in "xyz")))
    return poses.withColumn("_rate", rate).select("recording_id", "ts_us", "next_ts_us", *(F.col(f"_rate.g{c}").alias(f"g{c}") for c in "xyz"))
