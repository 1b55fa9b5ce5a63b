"""Bout tables, cohort index, calibrations, labelled roots, mask sidecars, bout artifacts."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.names import session_matches
from strideframe.operators.curate import SOURCE_KINDS

# Column order of a bout table, names of the bout column, sex labels.
BOUT_COLUMNS = ["idx", "start_frame", "end_frame", "n_frames", "source"]
BOUT_ALIASES = ("bout", "bout_idx", "idx")
SEX_LABELS = {"f": "female", "m": "male", "female": "female", "male": "male"}


def read_bout_summary(spark: SparkSession, path: str, *, session_tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A hand-made bout table with case-insensitive columns, and rows whose length disagrees."""
    return parse_bout_summary(spark.read.csv(path, header=True), session_tag=session_tag)


def parse_bout_summary(raw: DataFrame, *, session_tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of such a table, as text or numbers."""
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    idx = next((a for a in BOUT_ALIASES if a in raw.columns), None)
    if idx is None:
        raise ValueError(f"no bout column ({', '.join(BOUT_ALIASES)}) among {raw.columns}")
    if session_tag is not None and "fly_id" in raw.columns:
        raw = raw.where(session_matches(F.col("fly_id"), session_tag))
    n = F.col("end_frame") - F.col("start_frame") + 1
    given = F.col("n_frames").cast("long") if "n_frames" in raw.columns else F.lit(None).cast("long")
    d = raw.select(F.col(idx).cast("int").alias("idx"), F.col("start_frame").cast("long"), F.col("end_frame").cast("long"), given.alias("_given"))
    bad = d.where(F.col("_given").isNotNull() & (F.col("_given") != n)).select("idx", F.col("_given").alias("n_frames"), n.alias("expected"))
    return d.select("idx", "start_frame", "end_frame", n.alias("n_frames"), F.lit("summary").alias("source")), bad


def write_bouts(bouts: DataFrame, path: str) -> None:
    bouts.select(*BOUT_COLUMNS).write.mode("overwrite").csv(path, header=True)


def read_bouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int, start_frame long, end_frame long, n_frames long, source string").csv(path, header=True)


def cohort_sex(spark: SparkSession, path: str, recordings: DataFrame) -> DataFrame:
    """Sex of each recording from a cohort index whose recording column is unnamed: the row that
    holds the name in any cell, read at the named sex column (or its first sex-like cell). The
    first such row decides, also when it has no label."""
    raw = spark.read.csv(path, header=True)
    return sex_of_first_row(raw, F.monotonically_increasing_id(), raw.columns, recordings)


def sex_of_first_row(raw: DataFrame, line: Column, columns: Sequence[str], recordings: DataFrame) -> DataFrame:
    """``cohort_sex`` of rows whose order is that of ``line``; ``columns`` are those of the index."""
    cells = F.transform(F.array(*[F.trim(F.col(f"`{c}`")) for c in columns]), lambda c: F.coalesce(c, F.lit("")))
    named = next((c for c in columns if c.strip().lower() == "sex"), None)
    label = F.create_map(*[F.lit(x) for kv in SEX_LABELS.items() for x in kv])
    if named is not None:
        sex = F.element_at(label, F.lower(F.trim(F.col(f"`{named}`"))))
    else:
        sex = F.element_at(F.filter(F.transform(cells, lambda c: F.element_at(label, F.lower(c))), lambda s: s.isNotNull()), 1)
    flat = raw.select(line.alias("_line"), cells.alias("_cells"), sex.alias("sex")).select("_line", "sex", F.explode(F.array_distinct("_cells")).alias("recording"))
    first = flat.groupBy("recording").agg(F.min_by("sex", "_line").alias("sex"))
    return recordings.join(first, "recording", "left").withColumn("sex", F.coalesce("sex", F.lit("unknown")))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_calibrations(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(calib_group, camera, p)`` from ``<group>/Cam*.yaml`` files, and unreadable files."""
    return parse_calibrations(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def parse_calibrations(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of ``(path, text)`` rows, one per file."""
    parts = F.split("path", "/")
    node = F.regexp_extract("text", r"(?s)projectionMatrix:.*?data:\s*\[(.*?)\]", 1)
    nums = F.transform(F.regexp_extract_all(node, F.lit(f"({_NUMBER})"), F.lit(1)), lambda c: c.cast("double"))
    d = t.select(F.element_at(parts, -2).alias("calib_group"), F.regexp_replace(F.element_at(parts, -1), r"\.ya?ml$", "").alias("camera"), nums.alias("p"))
    ok = F.size("p") == 12
    return d.where(ok), d.where(~ok).select("calib_group", "camera", F.lit("calibration_unreadable").alias("code"))


def read_dlt(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(camera, c)`` from ``<camera>_dlt.csv`` files with 11 coefficients, and other files."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    nums = F.transform(F.regexp_extract_all("text", F.lit(f"({_NUMBER})"), F.lit(1)), lambda c: c.cast("double"))
    d = t.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"_dlt\.csv$", "").alias("camera"), nums.alias("c"))
    return d.where(F.size("c") == 11), d.where(F.size("c") != 11).select("camera", F.size("c").alias("n"))


_INSTANCES = (
    "keypoint_names array<string>,"
    " images array<struct<id: bigint, width: int, height: int, recording: string, file_name: string>>,"
    " annotations array<struct<id: bigint, image_id: bigint, bbox: array<double>, keypoints: array<double>, num_keypoints: int, fly_id: int, sex: string, subset: string>>,"
    " framesets map<string, struct<recording: string, fly_id: int, frames: array<bigint>, ann_ids: array<bigint>, source_id: string, source: string, weight: double,"
    " role: string, calib_group: string, behavior: string, center3D: array<double>, partners: map<string, bigint>>>"
)


def read_instances(spark: SparkSession, root: str, split: str) -> dict[str, DataFrame]:
    """Images, annotations, framesets and landmark names of one split file."""
    return split_members(spark.read.schema(_INSTANCES).json(f"{root}/annotations/instances_{split}.json", multiLine=True).withColumn("split", F.lit(split)))


def parse_instances(texts: DataFrame) -> dict[str, DataFrame]:
    """The same of ``(split, text)`` rows, one per file."""
    return split_members(texts.select("split", F.from_json("text", _INSTANCES).alias("j")).select("split", "j.*"))


def split_members(j: DataFrame) -> dict[str, DataFrame]:
    s = F.col("split")
    return {
        "images": j.select(s, F.inline("images")),
        "annotations": j.select(s, F.inline("annotations")),
        "framesets": j.select(s, F.explode("framesets").alias("key", "v")).select("split", "key", "v.*"),
        "keypoints": j.select(s, F.posexplode("keypoint_names").alias("pos", "kp")),
    }


_MANIFEST = (
    "version string,"
    " sources map<string, struct<kind: string, weight: double, origin: string, checkpoint: string, gates: map<string, string>, review: map<string, string>, n_framesets: bigint>>,"
    " calib_groups array<string>,"
    " recordings map<string, struct<calib_group: string, calib_groups: array<string>, split: string, sex: string, n_flies: int, fly_sex: map<string, string>>>"
)


def read_manifest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Sources (weight 1.0 unless given), recordings, and sources of an unknown kind."""
    return manifest_members(spark.read.schema(_MANIFEST).json(f"{root}/manifest.json", multiLine=True))


def parse_manifest(texts: DataFrame) -> dict[str, DataFrame]:
    """The same of rows with a manifest's ``text``."""
    return manifest_members(texts.select(F.from_json("text", _MANIFEST).alias("j")).select("j.*"))


def manifest_members(m: DataFrame) -> dict[str, DataFrame]:
    src = m.select(F.explode("sources").alias("source_id", "v")).select("source_id", "v.*").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return {
        "sources": src.where(F.col("kind").isin(*SOURCE_KINDS)),
        "recordings": m.select(F.explode("recordings").alias("recording", "v")).select("recording", "v.*"),
        "invalid": src.where(~F.coalesce(F.col("kind").isin(*SOURCE_KINDS), F.lit(False))).select("source_id", "kind"),
    }


def mask_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Mask sidecars ``(recording, camera, frame)`` by path, and files that do not fit the layout."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Frame_*.npz").load(root).select("path")
    rel = F.regexp_replace("path", rf"^.*?{root.rstrip('/').split('/')[-1]}/", "")
    ok = rel.rlike(r"^[^/]+/[^/]+/Frame_\d+\.npz$")
    d = f.withColumn("rel", rel)
    good = d.where(ok).select(
        "path", F.split("rel", "/")[0].alias("recording"), F.split("rel", "/")[1].alias("camera"), F.regexp_extract("rel", r"Frame_(\d+)\.npz$", 1).cast("long").alias("frame")
    )
    return good, d.where(~ok).select("rel")


def mask_index(files: DataFrame, n_expected: int) -> DataFrame:
    """File count, recordings and the share of expected images covered."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_set("recording")).alias("recordings")).withColumn("coverage", F.col("n_files") / F.lit(n_expected) if n_expected else F.lit(0.0))


def read_mask_rows(spark: SparkSession, root: str) -> DataFrame:
    """``(path, ann_id, height, width, matched, mask)`` rows of every sidecar; a file whose
    arrays differ in length gives one row with ``ann_id`` null."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Frame_*.npz").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content)) as z:
                    ids, masks = z["ann_ids"], z["masks"]
                    hit = z["matched"] if "matched" in z.files else np.ones(len(ids), bool)
                    if len(ids) != len(masks):
                        rows.append((path, None, 0, 0, False, b""))
                    for i, m, k in zip(ids, masks, hit) if len(ids) == len(masks) else ():
                        rows.append((path, int(i), m.shape[0], m.shape[1], bool(k), np.packbits(m.astype(bool)).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "ann_id", "height", "width", "matched", "mask"]).astype({"ann_id": "Int64"})

    return f.mapInPandas(run, "path string, ann_id long, height int, width int, matched boolean, mask binary")


def read_artifacts(spark: SparkSession, path: str, *, array: str = "kp3d", conf: str = "conf3d") -> DataFrame:
    """Bout artifacts (named dense arrays) as long landmarks with their order stamp.

    Files without landmark names or stamp give one row with ``kp`` null, to be refused.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "order_sha", "frame", "pos", "kp", "x", "y", "z", "conf"]
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if not {"kp_names", "order_sha", array} <= set(z.files):
                        yield pd.DataFrame([(p, None, -1, -1, None, None, None, None, None)], columns=cols)
                        continue
                    names, xyz = [str(n) for n in z["kp_names"]], np.asarray(z[array], float)
                    c = np.asarray(z[conf], float) if conf in z.files else np.full(xyz.shape[:2], np.nan)
                    frame, pos = np.divmod(np.arange(xyz.shape[0] * xyz.shape[1]), xyz.shape[1])
                    flat = xyz.reshape(-1, 3)
                    yield pd.DataFrame(
                        {"path": p, "order_sha": str(z["order_sha"]), "frame": frame, "pos": pos, "kp": [names[i] for i in pos], "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2], "conf": c.ravel()}
                    )[cols]

    d = f.mapInPandas(run, "path string, order_sha string, frame long, pos int, kp string, x double, y double, z double, conf double")
    miss = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return d.select("path", "order_sha", "frame", "pos", "kp", *[miss(c) for c in ("x", "y", "z", "conf")])


def recording_findings(recordings: DataFrame) -> DataFrame:
    """Recordings without a positive frame rate or without a declared rig."""
    rate = recordings.where(~F.coalesce(F.col("fps") > 0, F.lit(False))).select("name", F.lit("fps_required").alias("code"))
    return rate.unionByName(recordings.where(F.col("has_rig").isNull()).select("name", F.lit("calib_dir_undeclared").alias("code")))
