"""Orientation filters that step many recordings at once.

A filter is a recurrence over a recording's samples, but recordings do not depend on one another: the filters here hold one
state for each recording of a pack, as rows of arrays, and go through the samples of all of them together.  A pack is
sorted by length, so those that still have samples are its first rows.

``complementary``: gyro steps, pulled towards the measured gravity by a gain that rises while the camera rests and falls
while it is shaken; the gyro's bias and the length of gravity are learnt in rest.

``fused``: VQF (Laidig and Seel 2023) without a magnetometer, offline.  A Kalman filter with rest detection follows the gyro's
bias forwards and another one backwards; both are joined by their information, the gyro is integrated without that
bias, and the inclination follows the acceleration, low-passed in both directions in the frame of the integrated gyro.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from motionspark.operators import recurrence as R

EPS = np.finfo(float).eps


class Recording(Protocol):
    """Rates in degrees a second, accelerations, microseconds of the samples and of the one before the first, seconds in all."""

    gyro: np.ndarray
    acc: np.ndarray
    t: np.ndarray
    start_us: float
    duration_s: float


@dataclass
class Pack:
    """Recordings beside one another, longest first: radians a second, accelerations, seconds of each step; ``order`` undoes the sorting."""

    gyro: np.ndarray
    acc: np.ndarray
    dt: np.ndarray
    n: np.ndarray
    step: np.ndarray
    duration: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, recordings: list[Recording]) -> Pack:
        order = np.argsort([-len(r.t) for r in recordings], kind="stable")
        held = [recordings[i] for i in order]
        n = np.array([len(r.t) for r in held], int)
        gyro, acc, dt = np.zeros((len(n), n.max(initial=0), 3)), np.zeros((len(n), n.max(initial=0), 3)), np.zeros((len(n), n.max(initial=0)))
        for i, r in enumerate(held):
            gyro[i, : n[i]], acc[i, : n[i]] = np.radians(r.gyro), r.acc
            dt[i, : n[i]] = np.diff(r.t.astype(float), prepend=r.start_us) / 1e6
        duration = np.array([r.duration_s for r in held], float)
        return cls(gyro, acc, dt, n, duration / np.maximum(n, 1), duration, order)

    def running(self) -> list[int]:
        """Of each step, how many recordings still have a sample."""
        return np.searchsorted(-self.n, -np.arange(self.gyro.shape[1]), side="left").tolist()

    def unpacked(self, x: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [x[0]] * len(self.n)
        for i, k in enumerate(self.order.tolist()):
            out[k] = x[i, : self.n[i]]
        return out

    def backwards(self, x: np.ndarray) -> np.ndarray:
        """Each recording's samples from its last to its first."""
        i = np.arange(x.shape[1])
        at = np.where(i < self.n[:, None], self.n[:, None] - 1 - i, i)
        return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), 1)


NEXT, AFTER = [1, 2, 0], [2, 0, 1]


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., NEXT] * b[..., AFTER] - a[..., AFTER] * b[..., NEXT]


def rotated(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u = q[..., 1:]
    return v + 2 * cross(u, cross(u, v) + q[..., :1] * v)


def matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, 1).reshape(-1, 3, 3)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


def upright(a: np.ndarray) -> np.ndarray:
    """The shortest turn that takes unit vectors to straight up; half a turn about x from straight down."""
    w = np.sqrt(np.maximum((a[:, 2] + 1) / 2, 0))
    over = w <= 1e-6
    s = np.where(over, 1, w)
    return np.where(over[:, None], [0.0, 1, 0, 0], np.stack([w, 0.5 * a[:, 1] / s, -0.5 * a[:, 0] / s, 0 * w], 1))


# Fixed values of the complementary filter: gains, thresholds in metres a second squared and radians a second, seconds.
GAIN, BIAS_GAIN, GRAVITY_GAIN, GRAVITY = 0.0004, 0.001, 0.005, 9.81
STILL_RATE, STILL_LENGTH, STILL_RATE_CHANGE, STILL_CHANGE, NEAR_GRAVITY = 0.01, 0.1, 0.01, 0.05, 1.0
SMOOTH_S, GAIN_S, WAIT_S, SETTLE_SHARE, SETTLE_S = 0.1, 0.15, 0.2, 0.05, 2.0


def complementary_pack(p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """(orientations, gyro biases) of a pack."""
    size = len(p.n)
    out, biases = np.zeros((*p.dt.shape, 4)), np.zeros((*p.dt.shape, 3))
    q, smooth, last, rate = np.tile([1.0, 0, 0, 0], (size, 1)), np.zeros((size, 3)), np.zeros((size, 3)), np.zeros((size, 3))
    bias, gravity, gain, since, rest = np.zeros((size, 3)), np.full(size, GRAVITY), np.zeros(size), np.zeros(size), np.zeros(size)
    settle = np.minimum(p.duration * SETTLE_SHARE, SETTLE_S)
    near = lambda a, b, most: (np.abs(a - b) < most).any(1)  # noqa: E731  one axis is enough
    for i, r in enumerate(p.running()):
        acc, gyro, dt = p.acc[:r, i], p.gyro[:r, i], p.dt[:r, i]
        if i == 0:
            a = unit(acc)
            down = np.sqrt(np.maximum((1 - a[:, 2]) / 2, 1e-300))
            flipped = np.stack([-a[:, 1] / (2 * down), -down, 0 * down, -a[:, 0] / (2 * down)], 1)
            q[:r] = np.where(a[:, 2:] >= 0, upright(a), flipped)
            smooth[:r] = last[:r] = acc
            out[:r, 0] = q[:r]
            continue
        k = (1 - np.exp(-dt / SMOOTH_S))[:, None]
        smooth[:r] = k * acc + (1 - k) * smooth[:r]
        calm = near(acc, smooth[:r], STILL_CHANGE) & near(acc, last[:r], STILL_CHANGE) & near(gyro, rate[:r], STILL_RATE_CHANGE) & near(gyro, bias[:r], STILL_RATE)
        still = calm & (np.abs(np.linalg.norm(acc, axis=1) - gravity[:r]) < STILL_LENGTH)
        rate[:r], last[:r] = gyro, acc
        rest[:r] = np.where(still, rest[:r] + dt, 0)
        resting = rest[:r] > WAIT_S
        bias[:r] += np.where(resting[:, None], BIAS_GAIN * (gyro - bias[:r]), 0)
        length = np.linalg.norm(smooth[:r], axis=1)
        gravity[:r] += np.where(calm & (np.abs(length - GRAVITY) < NEAR_GRAVITY), GRAVITY_GAIN * (length - gravity[:r]), 0)
        ahead = R.product(q[:r], np.concatenate([np.zeros((r, 1)), gyro - bias[:r]], 1))
        ahead = R.normalised(q[:r] + 0.5 * dt[:, None] * ahead)
        early = np.where(since[:r] < settle[:r], np.maximum(15 - since[:r] / np.where(settle[:r] > 0, settle[:r], 1) * 14, 8), 1)
        shaken = np.exp(-40 * np.abs(length - gravity[:r]) / gravity[:r] - np.linalg.norm(gyro, axis=1))
        wanted = GAIN * np.where(resting, 8, shaken * early)
        k = 1 - np.exp(-dt / GAIN_S)
        gain[:r] = np.where(wanted < gain[:r], wanted, k * wanted + (1 - k) * gain[:r])
        turn = upright(unit(rotated(ahead, unit(smooth[:r]))))
        part = R.normalised(np.array([1.0, 0, 0, 0]) * (1 - gain[:r, None]) + gain[:r, None] * turn)
        q[:r] = R.normalised(R.product(part, ahead))
        since[:r] += dt
        out[:r, i], biases[:r, i] = q[:r], bias[:r]
    return out, biases


# Fixed values of the offline fusion: seconds, degrees a second, metres a second squared.
TAU_ACC, TAU_REST, REST_S, REST_RATE, REST_ACC, CLIP = 40.0, 0.5, 1.5, 2.0, 0.5, 2.0
SIGMA_START, SIGMA_MOTION, SIGMA_REST, FORGET_S, FORGET_VERTICAL = 0.5, 0.1, 0.03, 100.0, 0.0001


class LowPass:
    """Second-order Butterworth filters of (recordings, values), begun by the mean of the first ``tau`` seconds."""

    def __init__(self, tau: float, step: np.ndarray, values: int):
        c = np.tan(math.pi * (math.sqrt(2) / (2 * math.pi)) / tau * step)[:, None]
        d = c * c + math.sqrt(2) * c + 1
        self.b, self.a1, self.a2 = c * c / d, 2 * (c * c - 1) / d, (1 - math.sqrt(2) * c + c * c) / d
        self.needed = tau / step
        self.s1, self.s2, self.sum = (np.zeros((len(step), values)) for _ in range(3))
        self.count, self.ready, self.all_ready = np.zeros(len(step)), np.zeros(len(step), bool), False

    def begin(self, x: np.ndarray, which: np.ndarray) -> None:
        """As if the values had been ``x`` for ever."""
        r = len(x)
        self.s1[:r] = np.where(which[:, None], x * (1 - self.b[:r]), self.s1[:r])
        self.s2[:r] = np.where(which[:, None], x * (self.b[:r] - self.a2[:r]), self.s2[:r])
        self.ready[:r] |= which
        self.all_ready = bool(self.ready.all())

    def step(self, x: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
        """Filtered ``x`` of the first rows; rows out of ``use`` keep their state."""
        r = len(x)
        bx = self.b[:r] * x
        y = bx + self.s1[:r]
        if self.all_ready and (use is None or use.all()):
            self.s1[:r] = 2 * bx - self.a1[:r] * y + self.s2[:r]
            self.s2[:r] = bx - self.a2[:r] * y
            return y
        use = np.ones(r, bool) if use is None else use
        ready = self.ready[:r].copy()
        go = (use & ready)[:, None]
        self.s1[:r] = np.where(go, 2 * bx - self.a1[:r] * y + self.s2[:r], self.s1[:r])
        self.s2[:r] = np.where(go, bx - self.a2[:r] * y, self.s2[:r])
        first = use & ~ready
        self.count[:r] += first
        self.sum[:r] += np.where(first[:, None], x, 0)
        mean = self.sum[:r] / np.maximum(self.count[:r], 1)[:, None]
        self.begin(mean, first & (self.count[:r] >= self.needed[:r]))
        return np.where(ready[:, None], y, mean)


def inverse3(m: np.ndarray) -> np.ndarray:
    """Inverses of 3x3 matrices, 0 for those without one."""
    bad = np.abs(np.linalg.det(m)) <= EPS
    out = np.linalg.inv(np.where(bad[:, None, None], np.eye(3), m))
    out[bad] = 0
    return out


def bias_run(gyro: np.ndarray, acc: np.ndarray, p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """(biases, information matrices) after each sample; covariances in hundredths of degrees a second, squared."""
    size, ts = len(p.n), p.step
    biases, infos = np.zeros(gyro.shape), np.zeros((*gyro.shape, 3))
    start, noise = (SIGMA_START * 100) ** 2, (0.1 * 100) ** 2 * ts / FORGET_S
    weight = lambda sigma: (sigma * 100) ** 4 / noise + (sigma * 100) ** 2
    moving, resting = weight(SIGMA_MOTION), weight(SIGMA_REST)
    spread = np.stack([moving, moving, moving / FORGET_VERTICAL], 1)
    clip, q, lean = math.radians(CLIP), np.tile([1.0, 0, 0, 0], (size, 1)), np.tile([1.0, 0, 0, 0], (size, 1))
    bias, cov, rest_s, rest = np.zeros((size, 3)), np.tile(np.eye(3) * start, (size, 1, 1)), np.zeros(size), np.zeros(size, bool)
    calm_gyro, calm_acc, earth, turned = LowPass(TAU_REST, ts, 3), LowPass(TAU_REST, ts, 3), LowPass(TAU_ACC, ts, 3), LowPass(TAU_ACC, ts, 11)
    for i, r in enumerate(p.running()):
        g, a, dt = gyro[:r, i], acc[:r, i], ts[:r]
        mean = calm_gyro.step(g)
        loud = (((g - mean) ** 2).sum(1) >= math.radians(REST_RATE) ** 2) | (np.abs(mean) > clip).any(1)
        rest_s[:r], rest[:r] = np.where(loud, 0, rest_s[:r]), rest[:r] & ~loud
        rate = g - bias[:r]
        moves = np.linalg.norm(rate, axis=1) > EPS
        q[:r] = np.where(moves[:, None], R.normalised(R.product(q[:r], R.exp_map(rate * dt[:, None]))), q[:r])

        use = a.any(1)  # a sample without acceleration says nothing
        quiet = ((a - calm_acc.step(a, use)) ** 2).sum(1) < REST_ACC**2
        rest_s[:r] = np.where(use, np.where(quiet, rest_s[:r] + dt, 0), rest_s[:r])
        rest[:r] = np.where(use, quiet & (rest[:r] | (rest_s[:r] >= REST_S)), rest[:r])
        up = unit(rotated(lean[:r], earth.step(rotated(q[:r], a), use)))
        lean[:r] = np.where(use[:, None], R.normalised(R.product(upright(up), lean[:r])), lean[:r])
        whole = R.product(lean[:r], q[:r])
        m = matrices(whole)
        slow = turned.step(np.concatenate([m.reshape(r, 9), (m @ bias[:r, :, None])[:, :2, 0]], 1), use)  # the camera's turn, and what it makes of the bias
        low, shifted = slow[:, :9].reshape(r, 3, 3), slow[:, 9:]

        error = -(low @ bias[:r, :, None])[..., 0]
        error[:, 0] += -up[:, 1] / dt + shifted[:, 0]
        error[:, 1] += up[:, 0] / dt + shifted[:, 1]
        still = rest[:r, None]
        error = np.clip(np.where(still, mean - bias[:r], error), -clip, clip)
        view = np.where(still[..., None], np.eye(3), low)
        doubt = np.where(still, resting[:r, None], spread[:r])
        diagonal = np.einsum("rii->ri", cov[:r])
        grown = cov[:r] + np.eye(3) * np.where(diagonal < start, noise[:r, None], 0)[:, None, :]
        back = grown @ np.swapaxes(view, 1, 2)
        gain = back @ inverse3(view @ back + np.eye(3) * doubt[:, None, :])
        found = np.clip(bias[:r] + (gain @ error[..., None])[..., 0], -clip, clip)
        bias[:r] = np.where(use[:, None], found, bias[:r])
        cov[:r] = np.where(use[:, None, None], grown - gain @ view @ grown, cov[:r])
        biases[:r, i], infos[:r, i] = bias[:r], cov[:r]
    return biases, inverse3(infos.reshape(-1, 3, 3)).reshape(infos.shape)


def fused_pack(p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """(orientations, gyro biases) of a pack."""
    ahead, info = bias_run(p.gyro, p.acc, p)
    back, info_back = (p.backwards(x) for x in bias_run(-p.backwards(p.gyro), p.backwards(p.acc), p))
    joined = np.einsum("rnij,rnj->rni", info, ahead) - np.einsum("rnij,rnj->rni", info_back, back)
    bias = np.einsum("rnij,rnj->rni", inverse3((info + info_back).reshape(-1, 3, 3)).reshape(info.shape), joined)

    turns = R.exp_map((p.gyro - bias) * p.step[:, None, None])
    q, lean = np.tile([1.0, 0, 0, 0], (len(p.n), 1)), np.tile([1.0, 0, 0, 0], (len(p.n), 1))
    drift, low, out = np.zeros((*p.dt.shape, 4)), np.zeros(p.gyro.shape), np.zeros((*p.dt.shape, 4))
    forwards, again = LowPass(TAU_ACC, p.step, 3), LowPass(TAU_ACC, p.step, 3)
    for i, r in enumerate(p.running()):
        q[:r] = R.normalised(R.product(q[:r], turns[:r, i]))
        drift[:r, i], low[:r, i] = q[:r], forwards.step(rotated(q[:r], p.acc[:r, i]))
    low = p.backwards(low)
    again.begin(low[:, 0], np.ones(len(p.n), bool))
    for i, r in enumerate(p.running()):
        low[:r, i] = again.step(low[:r, i])
    low = p.backwards(low)
    for i, r in enumerate(p.running()):
        lean[:r] = R.normalised(R.product(upright(unit(rotated(lean[:r], low[:r, i]))), lean[:r]))
        out[:r, i] = R.product(lean[:r], drift[:r, i])
    return out, bias


def complementary(recordings: list[Recording]) -> list[np.ndarray]:
    p = Pack.of(recordings)
    return p.unpacked(complementary_pack(p)[0])


def fused(recordings: list[Recording]) -> list[np.ndarray]:
    p = Pack.of(recordings)
    return p.unpacked(fused_pack(p)[0])
