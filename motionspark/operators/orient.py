"""Orientation from IMU samples: a registry of integrators, each a recurrence over the samples of a pack of recordings.

Samples are turned into the axes [-y, x, z] of the camera; rates are degrees a second.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import quat as Q
from motionspark.operators import asof, fusion
from motionspark.operators import recurrence as R
from motionspark.operators.fusion import Pack

BY = ("recording_id",)
START = R.exp_map(np.array([math.pi / 2, 0.0, 0.0]))


def _camera(v: np.ndarray) -> np.ndarray:
    return np.stack([-v[:, 1], v[:, 0], v[:, 2]], 1)


@dataclass
class Samples:
    """Of a recording: rates (degrees a second), accelerations and times (microseconds) of its samples, the time from which the first step goes, and seconds in all."""

    gyro: np.ndarray
    acc: np.ndarray
    t: np.ndarray
    start_us: float
    duration_s: float = 0.0

    @property
    def steps(self) -> np.ndarray:
        """Seconds of each sample's step."""
        return np.diff(self.t.astype(float), prepend=self.start_us) / 1e6


def _stepped(p: Pack, turned: Callable[[np.ndarray, int, int], np.ndarray]) -> list[np.ndarray]:
    """The orientations of a pack from a camera that looks level: ``turned`` gives the next ones of the first r recordings from those before sample i."""
    out, q = np.empty((*p.dt.shape, 4)), np.tile(START, (len(p.n), 1))
    for i, r in enumerate(p.running()):
        q[:r] = R.normalised(turned(q[:r], i, r))
        out[:r, i] = q[:r]
    return p.unpacked(out)


def _change(q: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """By how much orientations change in a second."""
    return 0.5 * R.product(q, np.concatenate([np.zeros((len(rate), 1)), rate], 1))


def gyro_only(recordings: list[Samples]) -> list[np.ndarray]:
    """Product of the turns of all samples."""
    p = Pack.of(recordings)
    turns = R.exp_map(p.gyro * p.dt[..., None])
    return _stepped(p, lambda q, i, r: R.product(q, turns[:r, i]))


def gyro_accel(recordings: list[Samples], early_ms: float = 15_000.0) -> list[np.ndarray]:
    """Turns by the gyro, then towards the measured direction of gravity; faster in the first ``early_ms``."""
    p = Pack.of(recordings)
    down, gain = fusion.unit(p.acc), np.full((*p.dt.shape, 1), 0.6)
    for i, k in enumerate(p.order.tolist()):
        early = recordings[k].t - recordings[k].start_us < early_ms * 1000
        gain[i, : len(early), 0][early] = 10.0

    def turned(q: np.ndarray, i: int, r: int) -> np.ndarray:
        up = R.product(R.product(R.inverse(q), np.array([0.0, 0.0, 0.0, 1.0])), q)[:, 1:]
        rate = p.gyro[:r, i] + fusion.cross(down[:r, i], up) * gain[:r, i]
        return R.product(q, R.exp_map(rate * p.dt[:r, i, None]))

    return _stepped(p, turned)


def mahony(recordings: list[Samples], kp: float = 0.5, ki: float = 0.0) -> list[np.ndarray]:
    """Complementary filter on the rotation group: proportional and integral feedback of the gravity error (Mahony 2008)."""
    p = Pack.of(recordings)
    down, bias = fusion.unit(p.acc), np.zeros((len(p.n), 3))

    def turned(q: np.ndarray, i: int, r: int) -> np.ndarray:
        w, x, y, z = q.T
        dt, a = p.dt[:r, i, None], down[:r, i]
        error = fusion.cross(a, np.stack([2 * (x * z - w * y), 2 * (w * x + y * z), w * w - x * x - y * y + z * z], 1))
        bias[:r] += ki * error * dt
        return q + dt * _change(q, p.gyro[:r, i] + np.where(a.any(1, keepdims=True), kp * error + bias[:r], 0))

    return _stepped(p, turned)


def madgwick(recordings: list[Samples], beta: float = 0.02) -> list[np.ndarray]:
    """Gradient descent on the gravity error (Madgwick 2010)."""
    p = Pack.of(recordings)
    down = fusion.unit(p.acc)

    def turned(q: np.ndarray, i: int, r: int) -> np.ndarray:
        w, x, y, z = q.T
        a = down[:r, i]
        f, g, h = 2 * (x * z - w * y) - a[:, 0], 2 * (w * x + y * z) - a[:, 1], 1 - 2 * (x * x + y * y) - a[:, 2]
        step = np.stack([2 * (x * g - y * f), 2 * (z * f + w * g) - 4 * x * h, 2 * (z * g - w * f) - 4 * y * h, 2 * (x * f + y * g)], 1)
        return q + (_change(q, p.gyro[:r, i]) - beta * np.where(a.any(1, keepdims=True), fusion.unit(step), 0)) * p.dt[:r, i, None]

    return _stepped(p, turned)


# Method numbers of recordings' settings; each steps many recordings at once.
TOGETHER: dict[int, Callable[[list[Samples]], list[np.ndarray]]] = {1: fusion.complementary, 2: fusion.fused, 3: gyro_only, 4: gyro_accel, 5: mahony, 6: madgwick}
INTEGRATORS: dict[int, Callable[[Samples], np.ndarray]] = {method: lambda s, f=f: f([s])[0] for method, f in TOGETHER.items()}
PACK_CELLS = 200_000  # samples of a pack, those that fill up shorter recordings included; one longer recording is a pack
# Fixed values.
ZERO_FILLED = (2,)  # other methods leave samples without gyro out
NEVER_ZERO, LEAST = (1, 5, 6), 1e-7  # these methods take an acceleration of 0 as one along x
SHORT_START = (5, 6)  # the first step of these methods is a thousandth of the others'


def integrate(imu: DataFrame, method: int = 3, duration_ms: float | None = None) -> DataFrame:
    """(recording_id, ts_us, q) from (recording_id, ts_us, gx, gy, gz, ax, ay, az).

    Samples without gyro are left out, or count as no motion for method 2; without acceleration it is zero.
    The first step goes back from the first sample by the duration over the number of samples; without a
    duration it is that of the samples, the last one counted as long as the others.  One row a key: the caller
    removes repeated keys.
    """
    columns = ["gx", "gy", "gz", "ax", "ay", "az"]
    own = Window.partitionBy(*BY)
    n, first, span = F.count(F.lit(1)).over(own), F.min("ts_us").over(own), (F.max("ts_us").over(own) - F.min("ts_us").over(own))
    whole = F.lit(duration_ms * 1000) if duration_ms is not None else span * (n + 1) / n
    df = imu.withColumn("_start", first - whole / n / (1000 if method in SHORT_START else 1)).withColumn("_whole", whole / 1e6)
    df = df if method in ZERO_FILLED else df.where("gx is not null and gy is not null and gz is not null")

    def samples(c: dict[str, np.ndarray]) -> Samples:
        v = np.nan_to_num(np.column_stack([c[k].astype(float) for k in columns]))
        if method in NEVER_ZERO:
            v[~v[:, 3:].any(axis=1), 3] = LEAST
        return Samples(_camera(v[:, :3]), _camera(v[:, 3:]), c["ts_us"].astype(np.int64), float(c["_start"][0]), float(c["_whole"][0]))

    df = df.select(*BY, "ts_us", *columns, "_start", "_whole")
    out = _together(df, samples, TOGETHER[method])
    return out.select(*BY, "ts_us", F.struct(*"wxyz").alias("q"))


def _together(df: DataFrame, samples: Callable[[dict[str, np.ndarray]], Samples], f: Callable[[list[Samples]], list[np.ndarray]]) -> DataFrame:
    """``f`` of packs of recordings that lie in one partition, each recording whole and in order."""

    def solved(pack: list[pd.DataFrame]) -> pd.DataFrame:
        held = [samples({c: x[c].to_numpy() for c in x.columns}) for x in pack]
        return pd.concat(pack, ignore_index=True)[[*BY, "ts_us"]].assign(**dict(zip("wxyz", np.concatenate(f(held)).T, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack: list[pd.DataFrame] = []
        for whole in _whole_recordings(batches):
            longest = max([len(whole), *map(len, pack)])
            if pack and longest * (len(pack) + 1) > PACK_CELLS:
                yield solved(pack)
                pack = []
            pack.append(whole)
        if pack:
            yield solved(pack)

    at = df.repartition(*BY).sortWithinPartitions(*BY, "ts_us")
    return at.mapInPandas(run, "recording_id long, ts_us long, w double, x double, y double, z double")


def _whole_recordings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a sorted partition, cut by recording."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        ids = b["recording_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0]["recording_id"].iloc[0] != ids[lo]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(b.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


def anchor(camera: DataFrame, integrated: DataFrame, share: float = 0.005) -> DataFrame:
    """The camera's own orientations, turned towards the integrated ones by a steady share; the first turn is taken over whole.

    Each row of the camera meets the first integrated one at or after it, else no rotation.
    """
    left = asof.forward(camera.select(*BY, "ts_us", "q"), integrated.select(*BY, "ts_us", F.col("q").alias("c")), "c", Q.identity())
    flat = left.select(*BY, "ts_us", *(F.col(f"q.{k}").alias(k) for k in "wxyz"), *(F.col(f"c.{k}").alias(f"c{k}") for k in "wxyz"))

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        q, target = (np.column_stack([c[p + k] for k in "wxyz"]) for p in ("", "c"))
        turns, out, fix = R.product(target, R.inverse(q)), np.empty_like(q), None
        for i, wanted in enumerate(turns):
            fix = wanted if fix is None else R.slerp(fix, wanted, share)
            out[i] = fix
        return dict(zip("wxyz", R.normalised(R.product(out, q)).T, strict=True))

    out = R.per_recording(flat, [*"wxyz", *(f"c{k}" for k in "wxyz")], run, list("wxyz"))
    return out.select(*BY, "ts_us", F.struct(*"wxyz").alias("q"))
