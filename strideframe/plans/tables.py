"""How the standard tables stand in for tracks, landmarks, cameras and labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.ordered import number_rows
from strideframe.operators.quantiles import balanced_blocks

# Landmark names given to the 21 points of one embedding row.
LANDMARKS = [
    "Antenna_Base", "EyeL", "EyeR", "Scutellum", "Abd_tip",
    "WingL_base", "WingL_V12", "WingL_V13", "WingR_base", "WingR_V12", "WingR_V13",
    "T1L_ThxCx", "T1L_FeTi", "T1L_TaTip", "T1R_ThxCx", "T1R_FeTi", "T1R_TaTip",
    "T3L_ThxCx", "T3L_TaTip", "T3R_ThxCx", "T3R_TaTip",
]

# Bones checked between those landmarks.
BONES = [
    ("EyeL", "Antenna_Base"), ("EyeR", "Antenna_Base"), ("EyeL", "EyeR"), ("Antenna_Base", "Scutellum"),
    ("Scutellum", "WingL_base"), ("WingL_base", "WingL_V12"), ("WingL_V12", "WingL_V13"),
    ("Scutellum", "WingR_base"), ("WingR_base", "WingR_V12"), ("WingR_V12", "WingR_V13"), ("Scutellum", "Abd_tip"),
    ("T1L_ThxCx", "T1L_FeTi"), ("T1L_FeTi", "T1L_TaTip"), ("T1R_ThxCx", "T1R_FeTi"), ("T1R_FeTi", "T1R_TaTip"),
    ("T3L_ThxCx", "T3L_TaTip"), ("T3R_ThxCx", "T3R_TaTip"),
]

# Four projective cameras (row-major 3x4).
CAMERAS = {
    "Cam01": [100.0, 0.0, 20.0, 320.0, 0.0, 100.0, 10.0, 240.0, 0.0, 0.0, 0.125, 4.0],
    "Cam02": [80.0, 30.0, 0.0, 300.0, 0.0, 90.0, 40.0, 250.0, 0.125, 0.0, 0.0, 4.0],
    "Cam03": [0.0, 100.0, 30.0, 310.0, 90.0, 0.0, 20.0, 230.0, 0.0, 0.125, 0.0, 4.0],
    "Cam04": [60.0, -60.0, 10.0, 330.0, 20.0, 50.0, 80.0, 245.0, 0.0625, 0.0625, 0.0, 4.0],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """``(track, frame, event_id, v, conf, label)``: one signal per user, frame = time order."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("track"),
        "ts",
        "event_id",
        F.col("value").alias("v"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("conf"),
        F.col("event_type").alias("label"),
    )
    ev = ev.withColumn("_sec", F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).cast("double"))
    ev = balanced_blocks(ev, "_sec", "_tb")
    return number_rows(ev, ["track"], ["ts", "event_id"], F.col("_tb")).drop("ts", "_sec", "_tb")


TRACKS_CTE = """t AS (
 SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
        event_id, value AS v, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 AS conf, event_type AS label
 FROM events)"""


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """``(track, frame, vec_id, e)``: one row per animal-frame with the flat coordinates."""
    em = table(spark, sf, "embeddings").select(
        F.col("label").alias("track"), "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    return number_rows(em, ["track"], ["vec_id"], F.floor(F.col("vec_id") / 4096))


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Long landmarks ``(track, frame, vec_id, pos, kp, x, y, z, conf)``."""
    names = F.array(*[F.lit(n) for n in LANDMARKS])
    return (
        poses(spark, sf)
        .select("track", "frame", "vec_id", "e", F.posexplode(names).alias("pos", "kp"))
        .select(
            "track",
            "frame",
            "vec_id",
            "pos",
            "kp",
            *[F.element_at("e", F.col("pos") * 3 + 1 + i).alias(c) for i, c in enumerate("xyz")],
            (F.pmod(F.col("vec_id") * 7 + F.col("pos") * 13, F.lit(100)) / 100).alias("conf"),
        )
    )


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in LANDMARKS) + "]"
POSES_CTE = """pose AS (
 SELECT label AS track, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e
 FROM embeddings)"""
KEYPOINTS_CTE = f"""{POSES_CTE}, kps AS (
 SELECT track, frame, vec_id, p.pos AS pos, ({_NAMES_SQL})[p.pos + 1] AS kp,
        CAST(e[p.pos * 3 + 1] AS DOUBLE) AS x, CAST(e[p.pos * 3 + 2] AS DOUBLE) AS y, CAST(e[p.pos * 3 + 3] AS DOUBLE) AS z,
        CAST((vec_id * 7 + p.pos * 13) % 100 AS DOUBLE) / 100 AS conf
 FROM pose, (SELECT unnest(range(21)) AS pos) p)"""


def pairs_of_names(spark: SparkSession, pairs) -> DataFrame:
    """A small literal table of named pairs."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + " AS t(a, b)")


BONES_CTE = "bones AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in BONES) + ") AS b(a, b))"


def cameras(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', array({', '.join(f'{v}D' for v in p)}))" for c, p in CAMERAS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(camera, p)")


CAMERAS_CTE = (
    "cams AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', {p})" for c, p in CAMERAS.items())
    + ") AS c(camera, p))"
)


def observed(df: DataFrame, floor: float = 0.1) -> DataFrame:
    """Landmarks with coordinates missing where the confidence is below ``floor``."""
    keep = F.col("conf") >= floor
    for c in "xyz":
        df = df.withColumn(c, F.when(keep, F.col(c)))
    return df


OBSERVED_CTE = f"""{KEYPOINTS_CTE}, obs AS (
 SELECT track, frame, vec_id, pos, kp, conf, CASE WHEN conf >= 0.1 THEN x END AS x,
        CASE WHEN conf >= 0.1 THEN y END AS y, CASE WHEN conf >= 0.1 THEN z END AS z FROM kps)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """2-D detections ``(track, frame, pos, kp, camera, u, v, conf)``: projections with a small offset."""
    from strideframe.operators.geometry import project

    cam = F.substring("camera", 5, 1).cast("long")
    p = project(keypoints(spark, sf), cameras(spark))
    return p.select(
        "track", "frame", "pos", "kp", "camera",
        (F.col("u") + F.pmod(F.col("vec_id") * 31 + F.col("pos") * 17 + cam * 7, F.lit(97)) / 100.0).alias("u"),
        (F.col("v") - F.pmod(F.col("vec_id") * 13 + F.col("pos") * 29 + cam * 5, F.lit(89)) / 100.0).alias("v"),
        (F.pmod(F.col("vec_id") * 3 + F.col("pos") * 7 + cam * 11, F.lit(100)) / 100).alias("conf"),
    )


_R = [f"(p[{4 * r + 1}] * x + p[{4 * r + 2}] * y + p[{4 * r + 3}] * z + p[{4 * r + 4}])" for r in range(3)]
OBSERVATIONS_CTE = f"""{KEYPOINTS_CTE}, {CAMERAS_CTE}, det AS (SELECT track, frame, pos, kp, camera, p,
 {_R[0]} / {_R[2]} + ((vec_id * 31 + pos * 17 + CAST(camera[5] AS BIGINT) * 7) % 97) / 100.0 AS u,
 {_R[1]} / {_R[2]} - ((vec_id * 13 + pos * 29 + CAST(camera[5] AS BIGINT) * 5) % 89) / 100.0 AS v,
 ((vec_id * 3 + pos * 7 + CAST(camera[5] AS BIGINT) * 11) % 100) / 100.0 AS conf FROM kps, cams)"""
