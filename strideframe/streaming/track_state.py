"""Live track state: last good position and how long it has been carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strideframe.streaming.bouts import frame_time

OUTPUT = "recording string, fly int, frame long, age long, carried double, source string"
STATE = "frame long, pos double"
#: the state store that value states and timers need; set it as spark.sql.streaming.stateStore.providerClass
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrackState(StatefulProcessor):
    """The last good read of one animal, forgotten ``keep`` frames after it.

    What is older than ``keep`` frames is treated as never seen whether or not its timer has
    fired yet, so the output doesn't depend on when batches end. The timer bounds the state: it
    holds the animals of the last ``keep`` frames only.
    """

    def __init__(self, fps: float, max_reuse: int, keep: int):
        self.fps, self.max_reuse, self.keep = fps, max_reuse, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        frame, pos = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("frame", "pos"))
        order = np.argsort(frame, kind="stable")
        frame, pos = frame[order], pos[order].astype(float)
        last = self.last.get()
        frame0, pos0 = (np.nan, np.nan) if last is None else last
        # The state before each row is the last good row before it.
        good = ~np.isnan(pos)
        before = np.maximum.accumulate(np.where(good, np.arange(len(pos)), -1))
        before = np.concatenate([[-1], before[:-1]])
        at, carried = np.where(before >= 0, frame[before], frame0), np.where(before >= 0, pos[before], pos0)
        age = frame - at - 1
        known = age < self.keep
        live = known & (age < self.max_reuse)
        source = np.full(len(pos), None, object)
        source[live] = np.where(age[live] > 0, "reused", "track")
        ages = pd.arrays.IntegerArray(np.where(known, age, 0).astype("int64"), ~known)
        if good.any():
            i = np.flatnonzero(good)[-1]
            self.last.update((int(frame[i]), float(pos[i])))
            if last is not None:
                self.handle.deleteTimer(self._timer(frame0))
            self.handle.registerTimer(self._timer(frame[i]))
        yield pd.DataFrame(
            {"recording": key[0], "fly": key[1], "frame": frame.astype("int64"), "age": ages, "carried": np.where(live, carried, np.nan), "source": source}
        )

    def _timer(self, frame) -> int:
        """When the state left by a frame is forgotten; an animal has no other timer."""
        return int((int(frame) + self.keep + 1) / self.fps * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"recording": pd.Series([], dtype=str), "fly": pd.Series([], dtype=int), "frame": pd.Series([], dtype=int), "age": pd.Series([], dtype="Int64"), "carried": pd.Series([], dtype=float), "source": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


def live_track_state(frames: DataFrame, *, fps: float, max_reuse: int = 8, keep: int = 8000, lateness: str = "10 seconds") -> DataFrame:
    """State before every frame of a stream of ``(recording, fly, frame, pos)``, ``pos`` null on a miss.

    Frames of one animal must arrive in order from batch to batch (inside a batch any order), and no more
    than ``lateness`` of recording time behind the newest frame of the stream. The session needs the state store ``STORE``.
    """
    # a frame ends one step after it began: frame 0 mustn't fall on the watermark's own start
    timed = frames.withColumn("_end", F.col("frame") + 1).withColumn("_ts", frame_time("_end", fps)).withWatermark("_ts", lateness)
    return timed.groupBy("recording", "fly").transformWithStateInPandas(TrackState(fps, max_reuse, keep), OUTPUT, "append", "EventTime")
