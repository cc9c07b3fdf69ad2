"""Tables of a recording's cameras for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.functions import quat as Q

PLACES = 6  # Fixed value: decimals of angles and quaternions; focal lengths and FOVs have half as many


def camera_rows(frames: DataFrame) -> DataFrame:
    """The exported columns from (recording_id, frame, ts_us, raw, smooth, focal_length, fov) with quaternions ``raw`` and ``smooth``.

    A frame without a focal length has the last known one.  Null orientations give null angles.
    """
    from motionspark.operators.asof import carry

    df = carry(frames, ["focal_length"])
    r = lambda c, n=PLACES: F.round(c, n) + 0

    def angles(q: str) -> list[Column]:
        e = Q.to_euler(F.col(q))
        return [r(F.degrees(e[a])).alias(f"{q}_{a}") for a in ("pitch", "yaw", "roll")]

    parts = [r(F.col(f"{q}.{c}")).alias(f"{q}_{c}") for q in ("raw", "smooth") for c in "wxyz"]
    return df.select(
        "recording_id", "frame", r(F.col("ts_us") / 1000, PLACES // 2).alias("timestamp_ms"), *angles("raw"), *angles("smooth"), *parts,
        r("focal_length", PLACES // 2).alias("focal_length"), r("fov", PLACES // 2).alias("fov"),
    )


def write_cameras(rows: DataFrame, path: str, kind: str = "csv", columns: list[str] | None = None) -> None:
    """Writes the chosen columns as ``csv`` with a header, or ``json``, a folder for each recording."""
    chosen = rows.select("recording_id", *(columns or [c for c in rows.columns if c != "recording_id"]))
    writer = chosen.repartition("recording_id").sortWithinPartitions("recording_id", *(c for c in ("frame",) if c in chosen.columns)).write.partitionBy("recording_id")
    if kind not in ("csv", "json"):
        raise ValueError(f"no writer for {kind}")
    writer.option("header", kind == "csv").format(kind).save(path)
