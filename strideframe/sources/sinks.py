"""Written data sets: pooled clips, scorecards, provenance, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import block_of, number_rows
from strideframe.operators.quantiles import attach
from strideframe.session import cut_lineage

# Columns of a scorecard row, in order.
SCORECARD_COLUMNS = [
    "bout", "fly", "sex", "status", "n_frames", "missing_fraction", "max_gap", "worst_keypoint", "fitted_px", "measured_px", "reproj_ratio",
    "worst_cv_invariant", "n_collapsed", "eye_cv", "pitch_p95_deg", "n_pitched", "n_flagged",
]


def _field(name: str):
    return lambda s: s[name].cast("float")


def clip_arrays(rows: DataFrame, clip: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """One row per clip with an array per column in frame order, and its length.

    A clip is one bout of one animal, so its arrays are as long as the bout.
    """
    packed = rows.groupBy(*clip).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_a"))
    return packed.select(*clip, F.size("_a").cast("long").alias("clip_length"), *[F.transform("_a", _field(c)).alias(c) for c in cols])


def clip_chunks(rows: DataFrame, clip: Sequence[str], order: str, cols: Sequence[str], *, chunk: int = 4096) -> DataFrame:
    """``(clip, chunk, clip_length, n, cols...)``: each clip as arrays of up to ``chunk`` rows in frame order.

    The length comes from counts, so a clip of any length is many rows and no array grows with it. Frames
    needn't be dense or begin at 0; missing values stay null.
    """
    d = number_rows(rows.select(*clip, order, *cols), clip, [order], block_of(order, chunk), "_i")
    d = cut_lineage(d.select(*clip, F.floor(F.col("_i") / chunk).alias("chunk"), "_i", *cols))
    packed = d.groupBy(*clip, "chunk").agg(F.array_sort(F.collect_list(F.struct("_i", *cols))).alias("_a"))
    sizes = packed.groupBy(*clip).agg(F.sum(F.size("_a")).alias("clip_length"))
    out = packed.join(sizes, list(clip))
    return out.select(*clip, "chunk", "clip_length", F.size("_a").cast("long").alias("n"), *[F.transform("_a", _field(c)).alias(c) for c in cols])


def padded_chunks(chunks: DataFrame, clip: Sequence[str], cols: Sequence[str], *, chunk: int = 4096) -> DataFrame:
    """Chunks of all clips up to the longest one, filled with zeros past a clip's end (``n`` stays the number of real rows)."""
    top = chunks.agg(F.max("clip_length").alias("_t"))
    sizes = attach(chunks.groupBy(*clip).agg(F.max("clip_length").alias("clip_length")), top, [])
    every = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t") - 1) / chunk).cast("long"))))
    d = every.join(chunks.drop("clip_length"), [*clip, "chunk"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    width = F.least(F.lit(chunk).cast("long"), F.col("_t") - F.col("chunk") * chunk)
    pad = lambda c: F.concat(F.coalesce(F.col(c), F.array().cast("array<float>")), F.array_repeat(F.lit(0.0).cast("float"), (width - F.col("n")).cast("int")))
    return d.select(*clip, "chunk", "clip_length", "n", *[pad(c).alias(c) for c in cols])


def padded_clips(clips: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Arrays padded with zeros to the longest clip; missing values become zero-length-safe nulls."""
    top = clips.agg(F.max("clip_length").alias("_t"))
    d = attach(clips, top, [])
    pad = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0.0).cast("float"), (F.col("_t") - F.col("clip_length")).cast("int")))
    return d.select(*[pad(c).alias(c) if c in cols else F.col(c) for c in clips.columns])


def write_combined(clips: DataFrame, path: str, *, by: str = "assay") -> None:
    """Pooled clips as Parquet by assay; an empty pool is refused."""
    if clips.isEmpty():
        raise ValueError("no clips to write")
    clips.write.mode("overwrite").partitionBy(by).parquet(path)


def write_scorecard(rows: DataFrame, path: str) -> None:
    """Scorecard rows as JSON lines, in files ordered by bout and animal."""
    have = [c for c in SCORECARD_COLUMNS if c in rows.columns]
    order = [c for c in ("bout", "fly") if c in have]
    rows = rows.select(*have)
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.mode("overwrite").json(path)


def clip_ranges(clips: DataFrame, recording: str) -> DataFrame:
    """Clip index range ``[clip_start, clip_stop)`` of every recording, recordings in name order."""
    n = cut_lineage(clips.groupBy(recording).agg(F.count(F.lit(1)).alias("n_clips")))
    # One row per recording is ranked here.
    w = Window.partitionBy(F.lit(1)).orderBy(recording).rowsBetween(Window.unboundedPreceding, 0)
    d = n.withColumn("clip_stop", F.sum("n_clips").over(w))
    return d.withColumn("clip_start", F.col("clip_stop") - F.col("n_clips")).withColumn("session", F.split(recording, "/")[0])


def range_findings(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """The counted and the pooled number of clips when they disagree."""
    a = ranges.agg(F.coalesce(F.sum("n_clips"), F.lit(0)).alias("counted"))
    return a.crossJoin(F.broadcast(clips.agg(F.count(F.lit(1)).alias("pooled")))).where(F.col("counted") != F.col("pooled"))


def write_checksums(sums: DataFrame, path: str) -> None:
    """``sha256  name`` lines sorted by name."""
    sums.repartitionByRange("name").sortWithinPartitions("name").select(F.concat_ws("  ", "sha256", "name").alias("value")).write.mode("overwrite").text(path)
