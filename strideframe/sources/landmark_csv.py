"""CSV layouts of 3-D and 2-D landmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.vectors import missing_to_null
from strideframe.operators.joins import interval_join
from strideframe.operators.ordered import number_rows

# Column block of one landmark, marker of an unassigned 2-D point.
COORDS = ["x", "y", "z", "confidence"]
NOT_ASSIGNED = 1e6


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines ``(path, line, text)`` with their 0-based number in the file.

    Large files are read in splits; a line's number is its rank inside the split plus the
    lines of the file's earlier splits, so no file passes through one task.
    """
    t = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text")
    )
    return number_rows(t, ["path"], ["_row"], F.col("_start"), name="line").select("path", "line", "text")


def recording_of(path_col: str = "path"):
    """File name without extension."""
    return F.regexp_replace(F.element_at(F.split(path_col, "/"), -1), r"\.[^.]*$", "")


def folder_of(path_col: str = "path"):
    """Name of the file's folder, for layouts with one file name in every session folder."""
    return F.element_at(F.split(path_col, "/"), -2)


def read_kp3d(spark: SparkSession, path: str | Sequence[str], recording: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``parse_kp3d`` of files."""
    return parse_kp3d(read_lines(spark, path), recording)


def parse_kp3d(lines: DataFrame, recording: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines ``(path, line, text)`` of wide 3-D CSV files (two header rows, four columns per
    landmark) as long landmarks.

    Returns ``(recording, frame, pos, kp, x, y, z, conf)`` and header findings
    ``(recording, code)``; a recording with a finding gives no landmarks.  ``recording`` names it
    by the path, by default after the file; a name of two paths is a finding.
    """
    name = recording_of() if recording is None else recording
    cells = F.transform(F.split("text", ","), lambda c: F.trim(c))
    head = lines.where(F.col("line") < 2).groupBy("path").agg(
        F.max(F.when(F.col("line") == 0, cells)).alias("names"), F.max(F.when(F.col("line") == 1, cells)).alias("coords"), F.count(F.lit(1)).alias("_n")
    )
    n = F.size("names")
    blocks = F.sequence(F.lit(0), (n / 4 - 1).cast("int"))
    want = F.array(*[F.lit(c) for c in COORDS])
    bad_coords = F.exists(blocks, lambda i: F.slice("coords", i * 4 + 1, 4) != want)
    mixed = F.exists(blocks, lambda i: F.size(F.array_distinct(F.slice("names", i * 4 + 1, 4))) != 1)
    code = (
        F.when(F.col("_n") < 2, "missing_header").when(n != F.size("coords"), "header_rows_disagree").when((n % 4 != 0) | (n == 0), "column_count")
        .when(bad_coords, "coordinate_order").when(mixed, "mixed_names")
    )
    head = head.withColumn("code", code).withColumn("recording", name)
    shared = head.groupBy("recording").agg(F.count(F.lit(1)).alias("_paths")).where(F.col("_paths") > 1)
    head = head.join(shared, "recording", "left").withColumn("code", F.when(F.col("_paths").isNotNull(), "recording_in_two_files").otherwise(F.col("code")))
    order = head.where(F.col("code").isNull()).select("path", "recording", F.transform(blocks, lambda i: F.element_at("names", i * 4 + 1)).alias("kps"))
    # One header row per file.
    d = lines.where(F.col("line") >= 2).join(order, "path").select("recording", (F.col("line") - 2).alias("frame"), F.split("text", ",").alias("c"), F.posexplode("kps").alias("pos", "kp"))
    val = [missing_to_null(F.element_at("c", F.col("pos") * 4 + i).try_cast("double")) for i in range(1, 5)]
    kps = d.select("recording", "frame", "pos", "kp", *[v.alias(c) for v, c in zip(val, ("x", "y", "z", "conf"))])
    return kps, head.where(F.col("code").isNotNull()).select("recording", "code").distinct()


def bout_landmarks(kps: DataFrame, bouts: DataFrame, *, width: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Landmarks of the requested bouts, and bouts the file is too short for.

    ``bouts(recording, bout, start_frame, end_frame)``.
    """
    j = interval_join(kps, bouts, ["recording"], "frame", "start_frame", "end_frame", width=width)
    got = j.groupBy("recording", "bout").agg(F.count_distinct("frame").alias("n_rows"))
    want = bouts.withColumn("n_want", F.col("end_frame") - F.col("start_frame") + 1)
    short = want.join(got, ["recording", "bout"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).where(F.col("n_rows") != F.col("n_want"))
    return j, short.select("recording", "bout", "n_want", "n_rows")


def read_kp2d(spark: SparkSession, path: str | Sequence[str], recording: Column | None = None, *, threshold: float = NOT_ASSIGNED) -> DataFrame:
    """``parse_kp2d`` of files."""
    return parse_kp2d(read_lines(spark, path), recording, threshold=threshold)


def parse_kp2d(lines: DataFrame, recording: Column | None = None, *, threshold: float = NOT_ASSIGNED) -> DataFrame:
    """Lines of 2-D CSV files: a skeleton line, then ``frame,(id,x,y)*``; far coordinates are missing
    and ids outside the row's range are ignored.  Returns ``(recording, frame, kid, u, v)``; files
    that would share a name are named by their path instead."""
    named = lines.withColumn("recording", recording_of() if recording is None else recording)
    shared = named.where(F.col("line") == 0).groupBy("recording").agg(F.count(F.lit(1)).alias("_paths")).where(F.col("_paths") > 1)
    named = named.join(shared, "recording", "left").withColumn("recording", F.when(F.col("_paths").isNotNull(), F.col("path")).otherwise(F.col("recording")))
    c = named.where((F.col("line") > 0) & (F.trim("text") != "")).select("recording", F.split("text", ",").alias("c"))
    n = ((F.size("c") - 1) / 3).cast("int")
    pts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.element_at("c", i * 3 + 2).try_cast("int").alias("kid"), F.element_at("c", i * 3 + 3).try_cast("double").alias("u"), F.element_at("c", i * 3 + 4).try_cast("double").alias("v")
        ),
    )
    d = c.select("recording", F.element_at("c", 1).try_cast("long").alias("frame"), n.alias("_n"), F.inline(pts))
    ok = (F.abs("u") < threshold) & (F.abs("v") < threshold)
    return d.where((F.col("kid") >= 0) & (F.col("kid") < F.col("_n"))).select("recording", "frame", "kid", *[F.when(ok, missing_to_null(F.col(x))).alias(x) for x in ("u", "v")])
