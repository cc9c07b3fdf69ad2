"""Where a recording moves so that its video can be aligned with it: energies of bands of frequencies, and points from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.operators import series
from motionspark.operators.sync import blackman, zero_out

BY = ("recording_id",)
# Samples between windows; bands in hertz; where energies of the high and low band begin to count against a window, and how much.
HOP, BANDS = 16, ((0.0, 2.0), (2.0, 30.0), (30.0, 2000.0))
HIGH_FROM, LOW_FROM, AGAINST, STILL = 450.0, 650.0, 0.003, 50.0
RADIUS_S = 4.0
WINDOWS = 512  # transformed together


def even_samples(t_ms: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """(values, rate) at even times from 0 on, between the samples by straight lines."""
    span = t_ms[-1] - t_ms[0] if len(t_ms) else 0.0
    if span <= 0:
        return v[:0], 0.0
    rate = np.isfinite(v).all(axis=1).sum() / span * 1000
    at = np.arange(int(span * rate / 1000)) * 1000 / rate if rate > 0 else np.zeros(0)
    filled = np.nan_to_num(v)
    return np.column_stack([np.interp(at, t_ms, filled[:, k]) for k in range(v.shape[1])]) if len(at) else v[:0], rate


def window_ranks(values: np.ndarray, rate: float) -> np.ndarray:
    """How fit each window of a second is: its middle band's energy, less where the low and high bands are strong."""
    n = round(rate)
    if n < 2 or len(values) < n:
        return np.zeros(0)
    windows, shape = np.lib.stride_tricks.sliding_window_view(values, n, axis=0)[::HOP], np.array(blackman(n))
    place = lambda hz: int(min(max(np.floor(n / rate * hz + 0.5), 0), n // 2 - 1))
    energies = []
    for at in range(0, len(windows), WINDOWS):
        spectrum = np.fft.fft(windows[at : at + WINDOWS] * shape, axis=2)
        size = np.abs(spectrum + spectrum[:, :, ::-1])[:, :, : n // 2].sum(axis=1) * (1 / n) ** 0.5 / n * 256
        energies.append(np.stack([size[:, place(a) : place(b)].sum(axis=1) for a, b in BANDS]))
    low, mid, high = np.concatenate(energies, axis=1)
    beyond = lambda x, start: 1 + np.where(x < start, 0, x - start) * AGAINST
    if mid.max() < STILL:
        return (low + mid) / beyond(high, HIGH_FROM)
    return mid / beyond(high, HIGH_FROM) / beyond(low, LOW_FROM)


def sync_ranks(imu: DataFrame, columns=("gx", "gy", "gz"), on: str = "ts_us") -> DataFrame:
    """(recording_id, idx, rank, rate): the rank of each window of a second, HOP samples apart.

    Times count from the recording's start; samples without rates are 0.  Recordings of less than a second
    have no window.  The unit of work is a recording.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on, kind="stable")
        values, rate = even_samples(pdf[on].to_numpy(float) / 1000, pdf[list(columns)].to_numpy(float))
        ranks = window_ranks(values, rate)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "idx": np.arange(len(ranks)), "rank": ranks, "rate": rate})

    return imu.select(*BY, on, *columns).groupBy(*BY).applyInPandas(run, "recording_id long, idx long, rank double, rate double")


def sync_points(ranks: DataFrame, k: int, trims_s, rate: float) -> DataFrame:
    """(recording_id, point_ms): up to ``k`` windows' middles, the best one of each of k parts, of recordings with one rate."""
    kept = zero_out(ranks, ratio_s=HOP / rate, trims_s=trims_s)
    apart = series.suppress_non_maxima(kept, "rank", int(rate / HOP * RADIUS_S)).drop("rank").withColumnRenamed("kept", "rank")
    tops = series.segment_tops(apart, "rank", k)
    return tops.select(*BY, ((F.col("idx") * HOP + round(rate) / 2) / rate * 1000).alias("point_ms"))
