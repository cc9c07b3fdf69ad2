"""Structured Streaming over samples (recording_id, ts timestamp, ...): ranges between gaps, and filters that only look back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ("recording_id",)


def gap_ranges_stream(samples: DataFrame, gap_us: int = 100_000, late: str = "10 seconds") -> DataFrame:
    """(recording_id, from_us, to_us) of runs without a gap longer than ``gap_us``, each once the watermark has passed it.

    Samples may arrive out of order by up to ``late``; later ones are not counted.  Runs of one instant are left out.
    """
    session = F.session_window("ts", f"{gap_us} microseconds")  # a gap of gap_us itself still joins
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    runs = samples.withWatermark("ts", late).groupBy(*BY, session).agg(F.min(us).alias("from_us"), F.max(us).alias("to_us"))
    return runs.where("from_us <> to_us").select(*BY, "from_us", "to_us")


def ema_stream(samples: DataFrame, value: str, share: float, late: str = "10 seconds") -> DataFrame:
    """(recording_id, ts, ema): the forward exponential average of each recording, its state kept from batch to batch.

    Samples of a batch are taken in order of time; one that is older than the state is passed over, as the
    filter cannot go back.  Unknown values hold the state and give no row.
    """
    out = "recording_id long, ts timestamp, ema double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, y = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values("ts", kind="stable")
        done = []
        for ts, v in zip(rows["ts"], rows[value].astype(float), strict=True):
            us = ts.value // 1000
            if last is None or us > last:
                y, last = v if y is None else y * (1 - share) + v * share, us
                done.append((key[0], ts, y))
        if last is not None:
            state.update((last, y))
        yield pd.DataFrame(done, columns=["recording_id", "ts", "ema"])

    kept = samples.withWatermark("ts", late).select(*BY, F.col("ts").cast("timestamp").alias("ts"), value)
    return kept.groupBy(*BY).applyInPandasWithState(step, out, "last long, y double", "append", "NoTimeout")
