"""Rolling shutter: where every row of a frame looks, the way from an output pixel to its source, and the way back.

A row of a frame is read at a time of its own, so it has an orientation of its own, between the samples around that
time.  ``covered`` gives each frame the samples that its readout spans, by slices of time and as-of joins at its two
ends; all that follows happens in the frame, on arrays over its rows or points.

Frames come with ``camera``, a struct of the fields of CAMERA, and ``fov``.  Coordinates are pixels, times microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q
from motionspark.operators import asof
from motionspark.operators.lens import BACK, K, OUT

BY = ("recording_id", "frame")
SLICE_US = 100_000
# readout_ms: 0 for a global shutter; horizontal: columns are read, not rows; reversed: from the last one; upside_down: a
# frame buffer that begins below; refraction: of the medium, 1 for none; r_limit: radius up to which the lens is valid, 0 for any.
CAMERA = {
    "model": "string", "k": "array<double>", "fx": "double", "fy": "double", "cx": "double", "cy": "double", "width": "int", "height": "int", "out_width": "int", "out_height": "int",
    "readout_ms": "double", "horizontal": "boolean", "reversed": "boolean", "upside_down": "boolean", "rotation_deg": "double", "refraction": "double", "r_limit": "double",
}
DEFAULTS = {"readout_ms": 0.0, "horizontal": False, "reversed": False, "upside_down": False, "rotation_deg": 0.0, "refraction": 1.0, "r_limit": 0.0}
NOWHERE = -1e6  # a point that the lens cannot have seen


def camera(columns: dict) -> F.Column:
    """The struct of CAMERA from columns or literals by name; those left out take DEFAULTS, output sizes the frame's."""
    columns = DEFAULTS | {"out_width": columns.get("width"), "out_height": columns.get("height")} | columns
    as_column = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    return F.struct(*(as_column(columns[name]).cast(kind).alias(name) for name, kind in CAMERA.items()))


def covered(frames: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds ``times`` and ``quats``: the samples (recording_id, ts_us, q) inside each frame's readout and the ones around it, in order."""
    half = F.abs(F.coalesce(F.col("camera.readout_ms"), F.lit(0.0))) * 500
    spans = frames.select(*BY, F.floor(F.col("ts_us") - half).alias("lo"), F.ceil(F.col("ts_us") + half).alias("hi"))
    ends = spans.select(*BY, F.explode(F.array(F.struct(F.col("lo").alias("ts_us"), F.lit(True).alias("first")), F.struct(F.col("hi").alias("ts_us"), F.lit(False).alias("first")))).alias("e"))
    around = asof.neighbours(ends.select(*BY, "e.*"), samples, ["q"])
    edge = F.when(F.col("first"), F.struct("prev.k", "prev.q")).otherwise(F.struct("next.k", "next.q"))
    outer = around.select(*BY, edge.alias("s")).select(*BY, F.col("s.k").alias("ts_us"), F.col("s.q").alias("q"))
    slices = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") / SLICE_US), F.floor(F.col("hi") / SLICE_US))).alias("slice"))
    inner = slices.join(samples.select("recording_id", "ts_us", "q", F.floor(F.col("ts_us") / SLICE_US).alias("slice")).hint("merge"), ["recording_id", "slice"])
    inner = inner.where("ts_us BETWEEN lo AND hi").select(*BY, "ts_us", "q")
    found = outer.unionByName(inner).where("ts_us IS NOT NULL").groupBy(*BY).agg(F.sort_array(F.collect_set(F.struct("ts_us", "q"))).alias("s"))
    found = found.select(*BY, F.transform("s", lambda x: x["ts_us"]).alias("times"), F.flatten(F.transform("s", lambda x: F.array(*(x["q"][c] for c in "wxyz")))).alias("quats"))
    return frames.join(found.hint("merge"), list(BY), "left")  # a row a frame: not broadcast


def posed(frames: DataFrame, samples: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Adds what the rows of each frame need: ``times`` and ``quats`` of ``samples``, and ``smooth``, the smoothed orientation at its time."""
    at = asof.interpolate(frames, smoothed, "q", edge="hold", default=Q.identity(), out="smooth", mix=Q.slerp)
    return covered(at, samples)


def hamilton(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(a, -1, 0)
    p, q, r, s = np.moveaxis(b, -1, 0)
    return np.stack([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p], -1)


def rotation_matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def between(at: np.ndarray, times: np.ndarray, quats: np.ndarray) -> np.ndarray:
    """Orientations at times, along the shorter arcs between samples; held beyond the ends, no turn without samples."""
    if len(times) < 2:
        return np.broadcast_to(quats[0] if len(times) else np.array([1.0, 0, 0, 0]), (len(at), 4))
    i = np.clip(np.searchsorted(times, at, side="right") - 1, 0, len(times) - 2)
    t = np.clip((at - times[i]) / (times[i + 1] - times[i]), 0, 1)
    a, b = quats[i], quats[i + 1]
    dot = (a * b).sum(-1)
    b, angle = np.where(dot[:, None] < 0, -b, b), np.arccos(np.minimum(np.abs(dot), 1))
    near = np.sin(angle) < 1e-9
    s = np.where(near, 1, np.sin(angle))
    q = np.where(near, 1 - t, np.sin((1 - t) * angle) / s)[:, None] * a + np.where(near, t, np.sin(t * angle) / s)[:, None] * b
    return q / np.linalg.norm(q, axis=1, keepdims=True)


@dataclass
class Frame:
    """One frame of ``posed`` with its camera's numbers."""

    row: dict

    def __post_init__(self):
        c = {n: DEFAULTS.get(n) if v is None else v for n, v in self.row["camera"].items()}
        self.__dict__.update(c)
        self.k = np.zeros((1, K))
        given = [0.0 if x is None else x for x in (c["k"] or [])][:K]
        self.k[0, : len(given)] = given
        self.times = np.array(self.row["times"] or [], np.float64)
        self.quats = np.array(self.row["quats"] or [], np.float64).reshape(-1, 4)
        smooth = self.row["smooth"]
        self.smooth = np.array([smooth[c] for c in "wxyz"] if smooth else [1.0, 0, 0, 0])

    @property
    def rows(self) -> int:
        """How many rows, or columns, have a time of their own; one without a rolling shutter."""
        return (self.width if self.horizontal else self.height) if self.readout_ms else 1

    def rotations(self, line: np.ndarray, for_rows: bool) -> np.ndarray:
        """What turns rays of each line (row or column, in pixels) into the view; an upside-down buffer counts for whole rows only."""
        below = for_rows and self.upside_down
        readout = abs(self.readout_ms) * 1000 * (-1 if below and not self.horizontal else 1) * (-1 if self.reversed else 1)
        at = self.row["ts_us"] - readout / 2 + readout / (self.width if self.horizontal else self.height) * line
        now = between(np.array([float(self.row["ts_us"])]), self.times, self.quats)[0]
        q = hamilton(hamilton(self.smooth, now * [1, -1, -1, -1]), between(at, self.times, self.quats))
        a = np.radians(self.rotation_deg)
        r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ rotation_matrix(q)
        flip = np.array([1.0, 1, -1] if below else [1.0, -1, -1])
        return r * (flip[:, None] * flip)

    def view(self, fov: float | None = None) -> np.ndarray:
        """Camera matrix of the output; ``fov`` None is that of a frame as large as the input, before any zoom."""
        size = (self.width, self.height) if fov is None else (self.out_width, self.out_height)
        zoom = 1.0 if fov is None else max(fov, 0.001) * self.width / max(self.out_width, 1)
        return np.array([[self.fx / zoom, 0, size[0] / 2], [0, self.fy / zoom, size[1] / 2], [0, 0, 1]])

    def matrices(self) -> np.ndarray:
        """(rows, 3, 3): from output pixels to rays of the lens."""
        turned = self.view(self.row["fov"]) @ self.rotations(np.arange(self.rows, dtype=np.float64), True)
        u, s, v = np.linalg.svd(turned)
        inverse = np.where(s > 1e-6, 1 / np.where(s > 1e-6, s, 1), 0)
        return np.swapaxes(v, -1, -2) @ (inverse[..., None] * np.swapaxes(u, -1, -2))

    def lens(self, f: dict[str, Callable], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            return f[self.model](x, y, np.repeat(self.k, len(x), 0))

    def refracted(self, r: np.ndarray, into: bool) -> np.ndarray:
        """By how much a ray of radius r is longer after the change of medium."""
        if self.refraction == 1 or self.refraction <= 0:
            return np.ones_like(r)
        with np.errstate(all="ignore"):
            sine = r / np.sqrt(1 + r * r) * (self.refraction if into else 1 / self.refraction)
            return np.where(r > 0, sine / np.sqrt(1 - sine * sine) / np.where(r > 0, r, 1), 1.0)

    def sources(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the recorded frame output pixels come from; nan where the lens did not look."""
        m = self.matrices()
        top = self.width if self.horizontal else self.height

        def place(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            px, py, pw = np.moveaxis((m[line] @ np.stack([x, y, np.ones_like(x)], -1)[..., None])[..., 0], -1, 0)
            seen = (pw > 0) & ((self.r_limit <= 0) | (px * px + py * py <= self.r_limit**2 * pw))
            w = np.where(seen, pw, 1.0)
            grown = self.refracted(np.hypot(px, py) / w, True)
            u, v = self.lens(OUT, px / w * grown, py / w * grown)
            return np.where(seen, u * self.fx + self.cx, np.nan), np.where(seen, v * self.fy + self.cy, np.nan)

        line = np.clip(np.floor((x if self.horizontal else y) + 0.5), 0, top)
        if len(m) > 1:
            u, v = place(np.full(len(x), len(m) // 2))
            found = u if self.horizontal else v
            line = np.where(np.isnan(found), line, np.clip(np.floor(np.nan_to_num(found) + 0.5), 0, top))
        return place(np.minimum(line.astype(int), len(m) - 1))

    def seen(self, x: np.ndarray, y: np.ndarray, fov: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where points of the recorded frame stand in the view; NOWHERE for those that the lens cannot have seen."""
        u, v = self.lens(BACK, (x - self.cx) / self.fx, (y - self.cy) / self.fy)
        known = np.isfinite(u) & np.isfinite(v)
        u, v = np.where(known, u, 0), np.where(known, v, 0)
        grown = self.refracted(np.hypot(u, v), False)
        line = (x if self.horizontal else y) if self.readout_ms else np.zeros(1)
        turned = self.view(fov) @ self.rotations(line, False)
        px, py, pw = np.moveaxis((turned @ np.stack([u * grown, v * grown, np.ones_like(u)], -1)[..., None])[..., 0], -1, 0)
        with np.errstate(all="ignore"):
            return np.where(known, px / pw, NOWHERE), np.where(known, py / pw, NOWHERE)


def each_frame(frames: DataFrame, f: Callable[[Frame], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(recording_id, frame, ...) of ``frames`` from ``posed``: the arrays that ``f`` gives for a frame become rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = f(Frame(row))
                n = len(got[names[0]])
                head = [pa.array(np.full(n, row[c], np.int64)) for c in BY]
                rest = [pa.array(list(got[c])) if got[c].ndim > 1 else pa.array(got[c], from_pandas=True) for c in names]
                yield pa.RecordBatch.from_arrays(head + rest, [*BY, *names])

    return frames.mapInArrow(run, f"recording_id long, frame long, {schema}")


def row_matrices(frames: DataFrame) -> DataFrame:
    """(recording_id, frame, line, m): of each row of a frame the 3x3 matrix from output pixels to rays, row by row."""
    return each_frame(frames, lambda f: {"line": np.arange(f.rows), "m": f.matrices().reshape(-1, 9)}, "line long, m array<double>")


def point_matrices(frames: DataFrame) -> DataFrame:
    """(recording_id, frame, nth, m): of each point (px, py: arrays of the frame) the matrix from its ray to the view."""

    def run(f: Frame) -> dict[str, np.ndarray]:
        x, y = (np.array(f.row[c], np.float64) for c in ("px", "py"))
        line = (x if f.horizontal else y) if f.readout_ms else np.zeros(len(x))
        return {"nth": np.arange(len(x)), "m": (f.view(f.row["fov"]) @ f.rotations(line, False)).reshape(-1, 9)}

    return each_frame(frames, run, "nth long, m array<double>")


def pixel_sources(frames: DataFrame) -> DataFrame:
    """(recording_id, frame, nth, x, y): where output pixels (px, py: arrays of the frame) come from; null where the lens did not look."""

    def run(f: Frame) -> dict[str, np.ndarray]:
        x, y = f.sources(*(np.array(f.row[c], np.float64) for c in ("px", "py")))
        return {"nth": np.arange(len(x)), "x": x, "y": y}

    return each_frame(frames, run, "nth long, x double, y double")


def undistorted_points(frames: DataFrame, zoomed: bool = True) -> DataFrame:
    """(recording_id, frame, nth, x, y): where points of the recorded frame (px, py: arrays) stand in the view, each by its own row."""

    def run(f: Frame) -> dict[str, np.ndarray]:
        x, y = f.seen(*(np.array(f.row[c], np.float64) for c in ("px", "py")), f.row["fov"] if zoomed else None)
        return {"nth": np.arange(len(x)), "x": x, "y": y}

    return each_frame(frames, run, "nth long, x double, y double")


DIVISIONS, STEPS = 31, 30  # Fixed values: points along each side of the frame, steps between two of them


def perimeter(width: float, height: float, margin: float = 0.0, divisions: int = DIVISIONS) -> np.ndarray:
    """Points around the frame in order, from its first corner; (4 * (divisions - 1), 2)."""
    n = divisions - 1
    t, one = np.arange(n) / n, np.ones(n)
    unit = np.concatenate([np.stack(s, 1) for s in ((t, 0 * one), (one, t), (1 - t, one), (0 * one, 1 - t))])
    return unit * [width - 2 * margin, height - 2 * margin] + margin


def smallest_fov(f: Frame, centre: tuple[float, float] = (0.0, 0.0), margin: float = 0.0) -> float:
    """Width, as a share of the frame's, of the largest view around the centre that holds no point from outside the recorded frame.

    The nearest point of the undistorted perimeter bounds the view; the stretches beside it are then looked at more
    closely.  Before the first point lies, in the numbering of the ring, its place 2^64 - 1.
    """
    ring, aspect = perimeter(f.width, f.height, margin), f.out_height / f.out_width

    def reach(points: np.ndarray) -> tuple[int, float]:
        x, y = f.seen(points[:, 0], points[:, 1])
        far = np.maximum(np.abs(x - centre[0] * f.width - f.width / 2), np.abs(y - centre[1] * f.height - f.height / 2) / aspect)
        far = np.where(np.isnan(far), np.inf, far)
        return int(np.argmin(far)), float(far.min())

    at, bound = reach(ring)
    if not bound < 1e6:
        return 1e6 * 2 / f.width
    before, here, after = (ring[i % len(ring)] for i in ((at - 1) % 2**64, at, at + 1))
    t = (np.arange(STEPS + 1) / (STEPS + 1))[:, None]
    closer = np.concatenate([before + t * (here - before), here + t * (after - here), after[None]])
    return min(bound, reach(closer)[1]) * 2 / f.width


def frame_fovs(frames: DataFrame, centre: tuple[float, float] = (0.0, 0.0), margin: float = 0.0) -> DataFrame:
    """(recording_id, frame, fov) of ``frames`` from ``posed``; their own ``fov`` is not read."""
    return each_frame(frames, lambda f: {"fov": np.array([smallest_fov(f, centre, margin)])}, "fov double")
