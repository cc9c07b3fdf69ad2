"""Filters over many recordings at once: planted biases, one recording at a time, and sample by sample in plain steps."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pytest

from motionspark.operators import fusion, orient
from motionspark.operators import recurrence as R


def recording(seconds=60.0, rate=100.0, bias=(0.5, -0.3, 0.2), rest=(10.0, 20.0), seed=0, shake=0.0, gravity=9.81, noise=0.0):
    """Turns but for a rest; the acceleration is gravity in the camera's axes, and the gyro has a bias (degrees a second)."""
    rng = np.random.default_rng(seed)
    t = np.arange(round(seconds * rate))
    s = t / rate
    moving = ~((s >= rest[0]) & (s < rest[1]))
    omega = np.stack([20 * np.sin(s * 0.9 + seed), 15 * np.cos(s * 0.7), 25 * np.sin(s * 0.4)], 1) * moving[:, None]
    q, out = np.array([1.0, 0, 0, 0]), []
    for w in omega:
        q = R.normalised(R.product(q, R.exp_map(np.radians(w) / rate)))
        out.append(q)
    true = np.array(out)
    acc = fusion.rotated(R.inverse(true), np.array([0, 0, gravity])) + rng.normal(0, 1, (len(t), 3)) * (shake * (moving & (t > 0))[:, None] + noise)
    return SimpleNamespace(gyro=omega + np.array(bias), acc=acc, t=(t * 1e6 / rate).astype(np.int64), start_us=-1e6 / rate, duration_s=seconds, true=true)


def tilt(a, b):
    """Angle between what two orientations take to be up, in degrees."""
    up = np.array([0, 0, 1.0])
    c = (fusion.rotated(R.inverse(a), up) * fusion.rotated(R.inverse(b), up)).sum(1)
    return np.degrees(np.arccos(np.clip(c, -1, 1)))


@pytest.mark.parametrize("bias", [(0.5, -0.3, 0.2), (-1.2, 0.8, 1.5)])
def test_fusion_finds_a_planted_bias(bias):
    r = recording(bias=bias, shake=0.5)
    p = fusion.Pack.of([r])
    q, found = fusion.fused_pack(p)
    assert np.abs(np.degrees(found[0]) - bias).max() < 0.1  # of a degree a second
    assert tilt(q[0], r.true).max() < 3
    drift = R.product(R.inverse(q[0][:-1]), q[0][1:])
    turned = R.product(R.inverse(r.true[:-1]), r.true[1:])
    assert np.degrees(np.abs(R.turn(R.product(R.inverse(turned), drift)))).max() < 0.1  # no sample is turned out of place


def test_bias_of_a_moving_camera():
    """Without a rest the bias comes from the inclination alone, and what it says of the vertical is little."""
    r = recording(seconds=200.0, rate=12.0, rest=(0.0, 0.0), bias=(0.3, 0.3, -0.3))
    _, found = fusion.fused_pack(fusion.Pack.of([r]))
    assert np.abs(np.degrees(found[0, 100:]) - (0.3, 0.3, -0.3)).mean() < 0.1


def test_complementary_learns_bias_and_gravity_in_rest():
    r = recording(seconds=90.0, rate=100.0, rest=(2.0, 85.0), bias=(0.3, -0.2, 0.1), gravity=9.83)
    q, bias = fusion.complementary_pack(fusion.Pack.of([r]))
    assert np.abs(np.degrees(bias[0, 8_400]) - (0.3, -0.2, 0.1)).max() < 0.02
    assert np.degrees(np.abs(bias[0, :200])).max() < 0.2  # not before
    assert tilt(q[0], r.true)[200:].max() < 3


def test_complementary_leans_less_on_a_shaken_accelerometer():
    calm, shaken = (recording(seconds=30.0, rest=(0, 0), bias=(0, 0, 0), shake=s, seed=2) for s in (0.0, 6.0))
    q = [fusion.complementary([r])[0] for r in (calm, shaken)]
    assert tilt(q[0], calm.true).max() < 0.5 and tilt(q[1], shaken.true)[1:].max() < 12
    level = np.degrees(np.arccos(np.clip(fusion.unit(shaken.acc) @ [0, 0, 1.0], -1, 1)))
    assert level.max() > 60  # what the accelerometer alone says is far off


def mixed_pack():
    rng = np.random.default_rng(5)
    held = [recording(seconds=s, rate=r, seed=k, noise=0.02) for k, (s, r) in enumerate([(6.0, 50.0), (2.0, 100.0), (9.0, 20.0), (0.1, 50.0), (4.0, 50.0)])]
    held[1].acc[20:60] = 0
    held[2].gyro += rng.normal(0, 3, held[2].gyro.shape)
    held[4].acc[:] *= -1
    held[3] = SimpleNamespace(gyro=held[3].gyro[:1], acc=held[3].acc[:1], t=held[3].t[:1], start_us=-20_000.0, duration_s=0.02)
    return held


@pytest.mark.parametrize("f", [fusion.complementary, fusion.fused])
def test_a_pack_is_each_recording_alone(f):
    held = mixed_pack()
    for together, r in zip(f(held), held, strict=True):
        alone = f([r])[0]
        assert together.shape == (len(r.t), 4) and np.allclose(together, alone, atol=1e-12) and np.isfinite(alone).all()


class Filter:
    """A filter of one vector, in scalars."""

    def __init__(self, tau, ts):
        c = math.tan(math.sqrt(2) / 2 / tau * ts)
        d = c * c + math.sqrt(2) * c + 1
        self.b, self.a, self.tau, self.ts, self.seen, self.state = c * c / d, (2 * (c * c - 1) / d, (1 - math.sqrt(2) * c + c * c) / d), tau, ts, [], None

    def start(self, x):
        self.state = [np.array(x) * (1 - self.b), np.array(x) * (self.b - self.a[1])]

    def __call__(self, x):
        x = np.array(x)
        if self.state is None:
            self.seen.append(x)
            mean = sum(self.seen) / len(self.seen)
            if len(self.seen) * self.ts >= self.tau:
                self.start(mean)
            return mean
        y = self.b * x + self.state[0]
        self.state = [2 * self.b * x - self.a[0] * y + self.state[1], self.b * x - self.a[1] * y]
        return y


def matrix(q):
    return np.stack([fusion.rotated(q, e) for e in np.eye(3)], 1)


def shortest(a):
    """Turn from ``a`` to straight up by axis and angle."""
    axis, sine = np.cross(a, [0, 0, 1.0]), np.linalg.norm(np.cross(a, [0, 0, 1.0]))
    return R.exp_map(axis / sine * math.atan2(sine, a[2])) if sine > 1e-12 else np.array([1.0, 0, 0, 0]) if a[2] > 0 else np.array([0.0, 1, 0, 0])


def plain_bias(gyro, acc, ts):
    deg = math.pi / 180
    p0, v = 2500.0, 100 * ts / 100
    noise = {True: np.eye(3) * (9.0**2 / v + 9), False: np.diag([1.0, 1, 1e4]) * (100.0**2 / v + 100)}
    fg, fa, fe, fr, fb = Filter(0.5, ts), Filter(0.5, ts), Filter(40, ts), Filter(40, ts), Filter(40, ts)
    q = lean = np.array([1.0, 0, 0, 0])
    b, p, timer, rest, out = np.zeros(3), np.eye(3) * p0, 0.0, False, []
    for g, a in zip(gyro, acc, strict=True):
        slow = fg(g)
        if np.sum((g - slow) ** 2) >= (2 * deg) ** 2 or np.any(np.abs(slow) > 2 * deg):
            timer, rest = 0.0, False
        q = R.normalised(R.product(q, R.exp_map((g - b) * ts)))
        if np.any(a != 0):
            if np.sum((a - fa(a)) ** 2) >= 0.25:
                timer, rest = 0.0, False
            else:
                timer += ts
                rest = rest or timer >= 1.5
            up = matrix(lean) @ fe(matrix(q) @ a)
            up = up / np.linalg.norm(up)
            lean = R.normalised(R.product(shortest(up), lean))
            m = matrix(R.product(lean, q))
            low, seen = fr(m), fb((m @ b)[:2])
            view, e = (np.eye(3), slow - b) if rest else (low, np.array([-up[1] / ts + seen[0], up[0] / ts + seen[1], 0.0]) - low @ b)
            p = p + np.diag([v if x < p0 else 0.0 for x in np.diag(p)])
            k = p @ view.T @ np.linalg.inv(view @ p @ view.T + noise[rest])
            b = np.clip(b + k @ np.clip(e, -2 * deg, 2 * deg), -2 * deg, 2 * deg)
            p = p - k @ view @ p
        out.append((b, np.linalg.inv(p)))
    return out


def plain_fusion(r):
    gyro, ts = np.radians(r.gyro), r.duration_s / len(r.t)
    there, back = plain_bias(gyro, r.acc, ts), plain_bias(-gyro[::-1], r.acc[::-1], ts)[::-1]
    q, low, first = np.array([1.0, 0, 0, 0]), [], Filter(40, ts)
    turned = []
    for g, a, (b1, i1), (b2, i2) in zip(gyro, r.acc, there, back, strict=True):
        q = R.normalised(R.product(q, R.exp_map((g - np.linalg.inv(i1 + i2) @ (i1 @ b1 - i2 @ b2)) * ts)))
        turned.append(q)
        low.append(first(matrix(q) @ a))
    again = Filter(40, ts)
    again.start(low[-1])
    low = [again(x) for x in low[::-1]][::-1]
    lean, out = np.array([1.0, 0, 0, 0]), []
    for q, a in zip(turned, low, strict=True):
        up = matrix(lean) @ a
        lean = R.normalised(R.product(shortest(up / np.linalg.norm(up)), lean))
        out.append(R.product(lean, q))
    return np.array(out)


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_fusion_equals_plain_steps(k):
    r = mixed_pack()[k]
    assert np.allclose(fusion.fused([r])[0], plain_fusion(r), atol=1e-9)


def test_fusion_equals_plain_steps_beyond_the_first_mean():
    r = recording(seconds=90.0, rate=10.0, noise=0.1)
    assert np.allclose(fusion.fused([r])[0], plain_fusion(r), atol=1e-8)


def plain_complementary(r):
    gyro, acc, dt = np.radians(r.gyro), r.acc, np.diff(r.t.astype(float), prepend=r.start_us) / 1e6
    a = acc[0] / np.linalg.norm(acc[0])
    if a[2] >= 0:
        q = shortest(a)
    else:
        x = math.sqrt((1 - a[2]) / 2)
        q = np.array([-a[1] / (2 * x), -x, 0, -a[0] / (2 * x)])
    out, smooth, last, rate, bias, gravity, gain, since, rest = [q], acc[0], acc[0], np.zeros(3), np.zeros(3), 9.81, 0.0, 0.0, 0.0
    settle = min(r.duration_s * 0.05, 2.0)
    for w, a, h in list(zip(gyro, acc, dt, strict=True))[1:]:
        k = 1 - math.exp(-h / 0.1)
        smooth = smooth + k * (a - smooth)
        one = lambda u, v, most: min(abs(u - v)) < most
        calm = one(a, smooth, 0.05) and one(a, last, 0.05) and one(w, rate, 0.01) and one(w, bias, 0.01)
        rest = rest + h if calm and abs(np.linalg.norm(a) - gravity) < 0.1 else 0.0
        rate, last, length = w, a, np.linalg.norm(smooth)
        if rest > 0.2:
            bias = bias + 0.001 * (w - bias)
        if calm and abs(length - 9.81) < 1:
            gravity += 0.005 * (length - gravity)
        q = R.normalised(q + 0.5 * h * R.product(q, np.array([0.0, *(w - bias)])))
        early = max(15 - since / settle * 14, 8) if since < settle else 1
        wanted = 0.0032 if rest > 0.2 else 0.0004 * early * math.exp(-40 * abs(length - gravity) / gravity - np.linalg.norm(w))
        k = 1 - math.exp(-h / 0.15)
        gain = wanted if wanted < gain else gain + k * (wanted - gain)
        up = matrix(q) @ smooth
        part = shortest(up / np.linalg.norm(up)) if np.linalg.norm(up) else np.array([math.sqrt(0.5), 0, 0, 0])
        q = R.normalised(R.product(R.normalised((1 - gain) * np.array([1.0, 0, 0, 0]) + gain * part), q))
        since += h
        out.append(q)
    return np.array(out)


@pytest.mark.parametrize("k", [0, 2, 4])
def test_complementary_equals_plain_steps(k):
    r = mixed_pack()[k]
    assert np.allclose(fusion.complementary([r])[0], plain_complementary(r), atol=1e-9)


@pytest.mark.parametrize("method", [1, 2])
def test_recordings_stay_whole_in_packs(spark, monkeypatch, method):
    """Small packs and small batches give what each recording gives alone; samples without gyro are out or count as still."""
    monkeypatch.setattr(orient, "PACK_CELLS", 500)
    held = {k: recording(seconds=1.0 + k % 4, rate=50.0, seed=k) for k in range(9)}
    rows = [(k, int(t), *(None if (k, i) == (3, 5) else x for x in map(float, g)), *map(float, a)) for k, r in held.items() for i, (t, g, a) in enumerate(zip(r.t, r.gyro, r.acc, strict=True))]
    df = spark.createDataFrame(rows, "recording_id long, ts_us long, gx double, gy double, gz double, ax double, ay double, az double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    got = {(r["recording_id"], r["ts_us"]): r["q"] for r in orient.integrate(df, method).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) - (method == 1)
    for k, r in held.items():
        gyro, use = r.gyro.copy(), np.ones(len(r.t), bool)
        if k == 3:
            gyro[5], use[5] = 0, method != 1
        n, span = len(r.t), r.t[-1] / 1e6
        own = orient.Samples(orient._camera(gyro)[use], orient._camera(r.acc)[use], r.t[use], -span * (n + 1) / n / n * 1e6, span * (n + 1) / n)
        want = orient.INTEGRATORS[method](own)
        assert np.allclose([[got[k, t][c] for c in "wxyz"] for t in r.t[use].tolist()], want, atol=1e-9)


def plain_steps(method, s):
    """Methods 3 to 6 on one recording, sample by sample."""
    norm, out, q = np.linalg.norm(s.acc, axis=1), [], orient.START
    for i, dt in enumerate(np.diff(s.t.astype(float), prepend=s.start_us) / 1e6):
        rate = np.radians(s.gyro[i])
        w, x, y, z = q
        a = s.acc[i] / norm[i] if norm[i] > 0 else None
        up = np.array([2 * (x * z - w * y), 2 * (w * x + y * z), w * w - x * x - y * y + z * z])
        if method == 4 and a is not None:
            rate = rate + np.cross(a, up) * (10.0 if s.t[i] - s.start_us < 15e6 else 0.6)
        if method == 5 and a is not None:
            rate = rate + 0.5 * np.cross(a, up)
        change = 0.5 * R.product(q, np.array([0.0, *rate]))
        if method == 6 and a is not None:
            f = np.array([2 * (x * z - w * y) - a[0], 2 * (w * x + y * z) - a[1], 1 - 2 * (x * x + y * y) - a[2]])
            step = np.array([[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [0.0, -4 * x, -4 * y, 0.0]]).T @ f
            change = change - 0.02 * step / np.linalg.norm(step)
        q = q + change * dt if method > 4 else R.product(q, R.exp_map(rate * dt))
        q = q / np.linalg.norm(q)
        out.append(q)
    return np.array(out)


@pytest.mark.parametrize("method", [3, 4, 5, 6])
def test_packs_step_as_single_recordings_do(method):
    """Recordings of several lengths, one of a single sample, one with samples without acceleration, one beyond the early seconds."""
    held = [*mixed_pack(), recording(seconds=40.0, rate=20.0, seed=9, noise=0.05)]
    for got, s in zip(orient.TOGETHER[method](held), held, strict=True):
        assert got == pytest.approx(plain_steps(method, s), abs=1e-9)
