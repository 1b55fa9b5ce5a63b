"""Live bout segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_time(frame: str, fps: float):
    """Event time of a frame, counted from the epoch."""
    return F.timestamp_micros((F.col(frame) * (1_000_000 / fps)).cast("long"))


def live_bouts(
    frames: DataFrame, keys: Sequence[str], frame: str, flag: str, *, fps: float, max_gap: int = 2, min_duration: int = 3, lateness: str = "10 seconds"
) -> DataFrame:
    """Runs of flagged frames that bridge up to ``max_gap`` unflagged ones, as sessions in time.

    Works on streams (append mode: a bout appears once the watermark passes its gap) and on
    batches, where it equals the batch segmentation on the same frames.
    """
    step = 1_000_000 / fps
    # A session absorbs the next event when it starts before the current one's gap ends.
    gap = f"{int((max_gap + 1) * step + step / 2)} microseconds"
    hits = frames.where(F.col(flag)).withColumn("_ts", frame_time(frame, fps)).withWatermark("_ts", lateness)
    g = hits.groupBy(F.session_window("_ts", gap), *keys).agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))
    n = F.col("end_frame") - F.col("start_frame") + 1
    return g.select(*keys, "start_frame", "end_frame", n.alias("n_frames")).where(F.col("n_frames") >= min_duration)
