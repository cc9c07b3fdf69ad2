"""A feed of analysed frames: pairs of neighbours as soon as both are there, in whatever order they come, and their turns.

Frames (recording_id, frame, ts, ...) come by their own time; the watermark says how late one may be.  The same
functions take a table, which has no late frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.operators import pose

KEY = ("recording_id", "ts")


def known_once(frames: DataFrame, late: str) -> DataFrame:
    """One frame for each recording and time: the first that came, of a table any; those that repeat it within ``late`` are ignored."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    if not frames.isStreaming:
        return timed.dropDuplicates(list(KEY))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(KEY))


def frame_pairs(frames: DataFrame, late: str = "10 seconds", apart: str = "1 second") -> DataFrame:
    """Frames with ``next_ts`` of the one numbered next, at the same time or up to ``apart`` later.

    A pair comes out in the batch in which its second frame arrives, whichever that is.  The state holds the frames of the last
    ``late`` and ``apart``, by recording and number, so that one long recording is spread like many.  A frame without
    a neighbour gives no row; of a number that stands at several times each is a neighbour.
    """
    once = known_once(frames, late)
    after = known_once(frames.select(*KEY, "frame"), late).select(F.col("recording_id").alias("_recording"), (F.col("frame") - 1).alias("_frame"), F.col("ts").alias("next_ts"))
    near = (F.col("next_ts") >= F.col("ts")) & (F.col("next_ts") <= F.col("ts") + F.expr(f"INTERVAL {apart}"))
    joined = once.join(after, (F.col("recording_id") == F.col("_recording")) & (F.col("frame") == F.col("_frame")) & near)
    return joined.drop("_recording", "_frame")


def pose_feed(frames: DataFrame, method: str = "rotation", late: str = "10 seconds", apart: str = "1 second") -> DataFrame:
    """Turns of ``pose.estimate_poses`` for frames that bring ``camera`` and the ``lines`` to their next neighbour, once that is there."""
    micros = lambda c: F.unix_micros(c).alias(c if c.endswith("_us") else f"{c}_us")
    pairs = frame_pairs(frames, late, apart).select("recording_id", micros("ts"), micros("next_ts"), "camera", "lines")
    return pose.estimate_poses(pairs, method)
