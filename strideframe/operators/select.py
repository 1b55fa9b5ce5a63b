"""Stratified samples, ordered selection, set operations and report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.names import natural_key
from strideframe.operators.quantiles import attach, median_and_mad
from strideframe.session import cut_lineage

# Fixed value: MAD to Gaussian sigma.
MAD_TO_SIGMA = 1.4826


def hash_digits(seed: int, *keys: Column) -> Column:
    """The twelve hex digits behind ``hash_uniform``; they sort as the numbers do."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 12)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Repeatable number in [0, 1) from a seed and key columns, independent of partitioning."""
    return F.conv(hash_digits(seed, *keys), 16, 10).cast("double") / float(16**12)


def gate_frames(frames: DataFrame, *, min_conf: float, mad_k: float | None = None) -> DataFrame:
    """Frames (``finite``, ``min_conf``, optional ``scale``) with the gate each one fails, if any."""
    ok = F.col("finite") & F.coalesce(F.col("min_conf") >= min_conf, F.lit(False))
    gate = F.when(~F.col("finite"), "nonfinite").when(~ok, "low_conf")
    d = frames.withColumn("gate", gate)
    if mad_k is None:
        return d
    d = cut_lineage(d)
    s = median_and_mad(d.where(F.col("gate").isNull()), [], "scale", med="_m", mad="_d", n="_n")
    d = attach(d, s, [])
    bad = (F.col("_d") > 0) & (F.abs(F.col("scale") - F.col("_m")) > mad_k * MAD_TO_SIGMA * F.col("_d"))
    late = F.when(F.col("scale").isNull() | F.isnan("scale"), "scale_unknown").when(bad, "scale_outlier")
    return d.withColumn("gate", F.coalesce("gate", late)).drop("_m", "_d", "_n")


def round_robin_sample(frames: DataFrame, bout: str, frame: str, conf: str, n: int) -> DataFrame:
    """Draw ``n`` frames taking each bout's best in turn (confidence, then frame).

    Only the first ``n`` of a bout can be drawn, so the ranking filter is limited per bout
    before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(bout).orderBy(F.col(conf).desc(), F.col(frame)))
    top = frames.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.orderBy("rank", bout).limit(n)


def pick_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows in the order of ``ids(pos, <key>)`` and the ids that do not exist."""
    return df.join(ids, key), ids.join(df.select(key).distinct(), key, "left_anti")


def worst_per_group(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), *tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def natural_order(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(key)), key)


def report_order(findings: DataFrame) -> DataFrame:
    """Findings with errors first, then warnings, then the rest."""
    level = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    return findings.withColumn("level_rank", level).orderBy("level_rank", "code", "subject")


def level_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def pool(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def concat_chunks(chunks: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """One row per key from overlapping chunks, the earliest chunk winning."""
    cols = [c for c in chunks.columns if c not in keys and c != chunk]
    return chunks.groupBy(*keys).agg(*[F.min_by(c, chunk).alias(c) for c in cols])
