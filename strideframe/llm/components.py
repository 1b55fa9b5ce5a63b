"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component's name is its least node.

    ``edges`` has long columns u and v. Rounds of large and small stars go on until the edges
    stay the same, which takes about the logarithm of the longest path. Each round is written
    to the shared folder; nothing of the graph reaches the driver but a count and a checksum.
    An edge table without rows gives no rows; loops and repeated edges don't matter.
    """
    state = None
    current = edges.select("u", "v").where("u <> v").distinct()
    while True:
        current = written(_small_star(_large_star(current)).where("u <> v").distinct(), "stars")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
