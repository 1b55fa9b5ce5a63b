"""Exact percentiles of groups of any size.

``percentile`` gathers every distinct value of a group in one task.  For groups that grow
with the data (a recording, a condition, the whole table) the functions below rank the
values in value ranges instead: equal values are first collapsed to counts, the ranges
come from an approximate quantile sketch of the whole column (a bounded list of split
points, as many as the volume asks for), so no (group, range) pair holds more than about
``ROWS_PER_RANGE`` distinct values however skewed the groups are, and the ranks across
ranges come from per-range counts.  The split points decide only the balance; the result is exact for any of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.session import cut_lineage

# Distinct values ranked by one task, and the most ranges a sketch is asked for.
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 1 << 14


def value_range(df: DataFrame, col: str, name: str, ranges: int) -> DataFrame:
    """Add an order-preserving range number of ``col`` with about equal row counts."""
    if ranges <= 1:
        return df.withColumn(name, F.lit(0.0))
    probs = [i / ranges for i in range(1, ranges)]
    points = sorted(set(df.approxQuantile(col, probs, 0.5 / ranges) or []))
    if not points:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *points, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=name, handleInvalid="error").transform(df)


def balanced_blocks(df: DataFrame, col: str, name: str, *, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Add an order-preserving block number of a numeric column with about ``rows`` rows each.

    A table that fits one block needs no sketch; a key can never hold more of a block than
    the block has rows, however skewed the keys are.
    """
    return value_range(df, col, name, min(-(-df.count() // rows), MAX_RANGES))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, ``_v``, ``_cnt``): equal values of a group collapsed to a count, nulls left out.

    The result is written once, so that the split points, the range totals and the ranks all
    read it instead of recomputing the input.
    """
    w = F.lit(1) if weight is None else weight
    vals = df.select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return cut_lineage(vals.groupBy(*keys, "_v").agg(F.sum("_w").alias("_cnt")))


def rank_values(distinct: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """Ranks of collapsed values: rows with ``_lo``/``_hi`` (first and one past last 0-based rank),
    ``_n`` (group size) and ``_rng``; and the (keys, ``_rng``) table of occupied ranges."""
    # Groups that fit a task are ranked whole; a sketch of the column pays off for larger ones only.
    most = distinct.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if most <= rows:
        at = Window.partitionBy(*keys)
        ranked = distinct.select(
            "*", F.lit(0.0).alias("_rng"), F.sum("_cnt").over(at.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_hi"), F.sum("_cnt").over(at).alias("_n")
        ).withColumn("_lo", F.col("_hi") - F.col("_cnt"))
        return ranked, distinct.select(*keys).distinct().withColumn("_rng", F.lit(0.0))
    binned = balanced_blocks(distinct, "_v", "_rng", rows=rows)
    local = Window.partitionBy(*keys, "_rng").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    totals = binned.groupBy(*keys, "_rng").agg(F.sum("_cnt").alias("_t"))
    totals = totals.select(
        *keys,
        "_rng",
        F.coalesce(F.sum("_t").over(whole.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_t").over(whole).alias("_n"),
    )
    ranked = (
        binned.withColumn("_hi", F.sum("_cnt").over(local))
        .join(totals, [*keys, "_rng"])
        .withColumn("_hi", F.col("_hi") + F.col("_before"))
        .withColumn("_lo", F.col("_hi") - F.col("_cnt"))
        .drop("_before")
    )
    return ranked, totals.select(*keys, "_rng")


def _pick(ranked: DataFrame, keys: Sequence[str], probs: Mapping[str, float], n: str | None) -> DataFrame:
    aggs: list[Column] = []
    for i, p in enumerate(probs.values()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for tag, rank in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            hit = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        out = out.withColumn(name, F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * frac)
    if n:
        out = out.withColumn(n, F.col("_n"))
    return out.select(*keys, *probs, *([n] if n else []))


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, n: str | None = None, weight: Column | None = None, rows: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per key with a linearly interpolated percentile per entry of ``probs``.

    Keys whose values are all null give no row; left-join where they must stay.
    """
    work, gk = _grouped(df, keys)
    ranked, _ = rank_values(distinct_values(work, gk, value, weight), gk, rows)
    out = _pick(ranked, gk, probs, n)
    return out if keys else out.drop("_all")


def quantiles_of_counts(distinct: DataFrame, keys: Sequence[str], probs: Mapping[str, float], *, n: str | None = None, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """The same of values that :func:`distinct_values` has collapsed by ``keys`` (one key at least)."""
    return _pick(rank_values(distinct, keys, rows)[0], keys, probs, n)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **kw) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, **kw)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str, *, med: str = "med", mad: str = "mad", n: str = "n") -> DataFrame:
    """Group median, median absolute deviation from it, and the number of values."""
    work, gk = _grouped(df, keys)
    distinct = distinct_values(work, gk, value)
    ranked, ranges = rank_values(distinct, gk)
    m = cut_lineage(_pick(ranked, gk, {med: 0.5}, n))
    # The median reaches the values range by range, so a large group is not one task.
    dev = ranked.join(ranges.join(m, gk), [*gk, "_rng"]).select(*gk, F.abs(F.col("_v") - F.col(med)).alias("_dev"), "_cnt")
    out = m.join(exact_quantiles(dev, gk, "_dev", {mad: 0.5}, weight=F.col("_cnt")), gk)
    return out if keys else out.drop("_all")


SALTS = 32


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row of group statistics back to every row of the group.

    Rows are salted by a hash of their values and the statistics copied to every salt, so a
    group with a large share of all rows is joined by many tasks.  Statistics without keys
    are a single row, which is safe to broadcast.  The copies come from a join with the salts:
    Spark counts the rows that a join adds but not those of an ``explode``, and would broadcast
    through the driver what is ``SALTS`` times as large as it takes it for.
    """
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("byte"))
    # one byte a salt, so that the estimate is SALTS times that of the statistics
    salts = df.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({i}Y)" for i in range(SALTS)) + " AS t(_salt)")
    copies = stats.crossJoin(F.broadcast(salts))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
