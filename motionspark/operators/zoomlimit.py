"""A limit on the zoom: smooth less where the view would become too narrow, until it does not."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.session import kept

BY = ("recording_id",)
STRICTER = (0.95, 0.9, 0.85, 0.8)  # Fixed values: the most that is left of a frame's allowance, round by round; the last one stays


def narrowest(max_zoom_percent: Column | float, scale: Column | float = 1.0, speed: Column | float = 1.0) -> Column:
    """The FOV below which a frame is zoomed in too much; a faster playback may zoom in more.  ``scale`` is input by output width."""
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    faster = F.least(1 + (F.abs(value(speed)) - 1) / 4, F.lit(1.8))
    return 1 / (value(max_zoom_percent) / 100 * faster * value(scale))


def limit_zoom(frames: DataFrame, fovs_of: Callable[[DataFrame], DataFrame], least_fov: Column, rounds: int = 5, stricter: Sequence[float] = STRICTER) -> DataFrame:
    """(recording_id, frame, fov, allowance, rounds) of ``frames`` (recording_id, frame, and what ``least_fov`` reads).

    ``fovs_of`` gives the FOVs (recording_id, frame, fov) that follow from allowances (recording_id, frame, allowance), by which
    each frame's smoothing is cut.  As long as a frame of a recording is below ``least_fov``, the allowances of such frames are
    made smaller and that recording is worked out again; the others are left as they are.  State goes through the shared folder; no table is
    broadcast, as each has a row a frame or recording.
    """
    state = kept(frames.select(*BY, "frame", least_fov.alias("least"), F.lit(1.0).alias("allowance"), F.lit(0).alias("rounds")), "allowances")
    state = kept(_with_fovs(state, fovs_of(state.select(*BY, "frame", "allowance"))), "fovs")
    for n in range(rounds):
        below = F.col("fov") < F.col("least")
        narrow = state.where(below).select(*BY).distinct()
        if narrow.isEmpty():
            break
        cut = F.col("allowance") * F.least(F.col("fov") / F.col("least"), F.lit(float(stricter[min(n, len(stricter) - 1)])))
        again = state.join(narrow.hint("merge"), list(BY), "left_semi").withColumns({"allowance": F.when(below, cut).otherwise(F.col("allowance")), "rounds": F.col("rounds") + 1})
        again = kept(again.drop("fov"), "allowances")
        done = state.join(narrow.hint("merge"), list(BY), "left_anti")
        state = kept(done.unionByName(_with_fovs(again, fovs_of(again.select(*BY, "frame", "allowance")))), "fovs")
    return state.select(*BY, "frame", "fov", "allowance", "rounds")


def _with_fovs(state: DataFrame, fovs: DataFrame) -> DataFrame:
    return state.join(fovs.select(*BY, "frame", "fov").hint("merge"), [*BY, "frame"])
