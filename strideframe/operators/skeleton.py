"""Which named segments a landmark table can measure."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Leg names, joints from body to tip, and the body segments checked for length.
LEGS = ("T1L", "T2L", "T3L", "T1R", "T2R", "T3R")
LEG_JOINTS = ("ThxCx", "Tro", "FeTi", "TiTa", "TaT1", "TaT3", "TaTip")
BODY_SEGMENTS = (
    ("EyeL", "Antenna_Base"), ("EyeR", "Antenna_Base"), ("Antenna_Base", "Scutellum"),
    ("Scutellum", "WingL_base"), ("WingL_base", "WingL_V12"), ("WingL_V12", "WingL_V13"),
    ("Scutellum", "WingR_base"), ("WingR_base", "WingR_V12"), ("WingR_V12", "WingR_V13"),
    ("Scutellum", "Abd_A4"), ("Abd_A4", "Abd_tip"),
)


def edge_table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "a string, b string")


def present_edges(kps: DataFrame, edges: DataFrame, name: str = "kp") -> DataFrame:
    """Edges whose two landmarks both occur."""
    have = kps.select(F.col(name)).distinct()
    for side in ("a", "b"):
        edges = edges.join(have.withColumnRenamed(name, side), side, "left_semi")
    return edges.select("a", "b").distinct()


def skeleton_edges(kps: DataFrame, name: str = "kp") -> DataFrame:
    """Edges ``(a, b)`` of the landmarks that occur: the body segments, and along each leg every
    landmark with the one before it, starting from the scutellum.  Absent ones are skipped over;
    a null name and repeated rows add nothing."""
    spark = kps.sparkSession
    places = [(leg, i, part) for leg in LEGS for i, part in enumerate(("Scutellum", *(f"{leg}_{joint}" for joint in LEG_JOINTS)))]
    chain = spark.createDataFrame(places, "leg string, place int, b string")
    chain = chain.join(kps.select(F.col(name).alias("b")).distinct(), "b", "left_semi")
    before = F.lag("b").over(Window.partitionBy("leg").orderBy("place"))
    legs = chain.select(before.alias("a"), "b").where("a is not null")
    return present_edges(kps, edge_table(spark, BODY_SEGMENTS), name).unionByName(legs)
