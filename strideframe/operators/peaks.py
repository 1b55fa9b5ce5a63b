"""Peaks of smooth signals: detection per track and pairing between signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import vectors as V


def pair_peaks(peaks: DataFrame, keys: Sequence[str], signal: str, a: str, b: str, order: str) -> DataFrame:
    """The most prominent peak of each of two signals per key (earliest on ties): phase
    difference a - b and the direction half way between them."""
    best = F.struct("prominence", (-F.col(order)).alias("o"))
    p = peaks.groupBy(*keys).agg(
        F.max_by(F.when(F.col(signal) == a, F.col("phase")), F.when(F.col(signal) == a, best)).alias("_a"),
        F.max_by(F.when(F.col(signal) == b, F.col("phase")), F.when(F.col(signal) == b, best)).alias("_b"),
    ).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    mid = F.atan2(F.sin("_a") + F.sin("_b"), F.cos("_a") + F.cos("_b"))
    return p.select(*keys, V.wrap(F.col("_a") - F.col("_b")).alias("dphi"), mid.alias("mid"))
