"""Ordered-series primitives that never put a whole track into one task.

A plain ``Window.partitionBy(track)`` sorts a track inside a single task, so one long
recording that holds a third of all rows becomes a straggler.  Every operator here
instead works on *blocks*: contiguous ranges of the order column.  Work inside a block
is an ordinary window over ``(keys, block)``; what crosses a block border is carried by
a per-block summary table (one row per key and block, pre-aggregated) whose running
total or last value is joined back.  The join keys are the window keys, so the big side
is shuffled once.

Bounded frames (``lag``, rolling statistics) need no summary: ``halo`` copies the few
rows around each border into the neighbouring block and drops the copies afterwards.

Keys and order columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strideframe.session import cut_lineage

BLOCK = 1 << 14

_UNB = Window.unboundedPreceding


def block_of(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def _before_block(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_blk").rowsBetween(_UNB, -1)


def _after_block(keys: Sequence[str]) -> WindowSpec:
    """The later blocks, seen from the end: a frame that runs to the end of a partition is built anew for
    every row, which takes the square of the rows; the same frame in descending order only grows."""
    return Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(_UNB, -1)


def read_once(df: DataFrame) -> DataFrame:
    """The frame, cut from its lineage where that reads more than one table or file set.

    An operator below reads its input twice, for the rows and for the summary of their blocks. Without
    the cut, n of them in a row would read the source 2^n times.
    """
    if df.isStreaming or df._jdf.queryExecution().analyzed().collectLeaves().size() < 2:
        return df
    return cut_lineage(df)


def number_rows(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], block: Column, name: str = "frame"
) -> DataFrame:
    """Dense 0-based position of each row inside its key.

    ``block`` must be non-decreasing along ``order_by`` (a day or hour bucket of the time
    column, an id range).  Rows are ranked inside ``(keys, block)`` and shifted by the row
    count of the earlier blocks.
    """
    b = read_once(df).withColumn("_blk", block)
    local = Window.partitionBy(*keys, "_blk").orderBy(*order_by)
    sizes = b.groupBy(*keys, "_blk").count()
    shift = sizes.select(*keys, "_blk", F.coalesce(F.sum("count").over(_before_block(keys)), F.lit(0)).alias("_off"))
    return (
        b.withColumn("_rn", F.row_number().over(local))
        .join(shift, [*keys, "_blk"])
        .withColumn(name, (F.col("_rn") - 1 + F.col("_off")).cast("long"))
        .drop("_blk", "_rn", "_off")
    )


def halo_rows(df: DataFrame, order: str, *, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows with their block as ``_blk``, rows near a border also with the block that reaches for them."""
    lo = F.floor((F.col(order) - F.lit(after)) / F.lit(size))
    hi = F.floor((F.col(order) + F.lit(before)) / F.lit(size))
    return df.withColumn("_blk", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


def halo(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    size: int = BLOCK,
) -> DataFrame:
    """Add window columns whose frame reaches at most ``before``/``after`` order steps away.

    ``build`` receives the ordered window over ``(keys, block)``.  ``order`` must be an
    integer that is unique inside a key; a frame of ``rowsBetween(-r, r)`` is exact when
    the order is dense, a ``rangeBetween(-r, r)`` frame always.
    """
    spread = halo_rows(df, order, before=before, after=after, size=size)
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    cols = build(w)
    return (
        spread.select("*", *[c.alias(n) for n, c in cols.items()])
        .where(F.col("_blk") == block_of(order, size))
        .drop("_blk")
    )


def lag_lead(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    lags: Mapping[str, str | Column] | None = None,
    leads: Mapping[str, str | Column] | None = None,
    n: int = 1,
    size: int = BLOCK,
) -> DataFrame:
    """``lag``/``lead`` by ``n`` over a dense order column."""
    lags, leads = lags or {}, leads or {}

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {name: F.lag(c, n).over(w) for name, c in lags.items()}
        out.update({name: F.lead(c, n).over(w) for name, c in leads.items()})
        return out

    return halo(df, keys, order, build, before=n if lags else 0, after=n if leads else 0, size=size)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    bounds: tuple[str, str] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Any number of whole-track scans along a unique integer order in one pass.

    ``sums`` and ``maxes`` are inclusive running aggregates, ``max_before`` leaves out the row
    itself; ``last``/``next`` are the nearest non-null value at or before / at or after the
    row, ``before``/``after`` the same without the row; ``bounds`` names columns for the first
    and last order value of the key.  Asking for several results at once costs one summary
    join, so operators should collect what they need here instead of chaining scans.
    """
    jobs = [
        (n, c, kind)
        for kind, group in (
            ("sum", sums), ("max", maxes), ("maxb", max_before), ("last", last), ("next", next), ("before", before), ("after", after),
        )
        for n, c in (group or {}).items()
    ]
    b = read_once(df).withColumn("_blk", block_of(order, size)).select("*", *[c.alias(f"_sx{i}") for i, (_, c, _) in enumerate(jobs)])
    base = Window.partitionBy(*keys, "_blk").orderBy(order)
    upto, prior = base.rowsBetween(_UNB, 0), base.rowsBetween(_UNB, -1)
    # in descending order, see _after_block
    back = Window.partitionBy(*keys, "_blk").orderBy(F.desc(order))
    onward, later = back.rowsBetween(_UNB, 0), back.rowsBetween(_UNB, -1)
    prev_blocks, next_blocks = _before_block(keys), _after_block(keys)
    aggs, edges, local = [], [], []
    for i, (_, _, kind) in enumerate(jobs):
        x, t = F.col(f"_sx{i}"), F.col(f"_st{i}")
        at = F.when(x.isNotNull(), F.col(order))
        if kind == "sum":
            aggs.append(F.sum(x).alias(f"_st{i}"))
            edges.append(F.coalesce(F.sum(t).over(prev_blocks), F.lit(0)).alias(f"_sp{i}"))
            local.append(F.coalesce(F.sum(x).over(upto), F.lit(0)).alias(f"_sc{i}"))
        elif kind in ("max", "maxb"):
            aggs.append(F.max(x).alias(f"_st{i}"))
            edges.append(F.max(t).over(prev_blocks).alias(f"_sp{i}"))
            local.append(F.max(x).over(upto if kind == "max" else prior).alias(f"_sc{i}"))
        elif kind in ("last", "before"):
            aggs.append(F.max_by(x, at).alias(f"_st{i}"))
            edges.append(F.last(t, ignorenulls=True).over(prev_blocks).alias(f"_sp{i}"))
            local.append(F.last(x, ignorenulls=True).over(upto if kind == "last" else prior).alias(f"_sc{i}"))
        else:
            aggs.append(F.min_by(x, at).alias(f"_st{i}"))
            edges.append(F.last(t, ignorenulls=True).over(next_blocks).alias(f"_sp{i}"))
            local.append(F.last(x, ignorenulls=True).over(onward if kind == "next" else later).alias(f"_sc{i}"))
    if bounds:
        whole = Window.partitionBy(*keys)
        aggs += [F.min(order).alias("_o0"), F.max(order).alias("_o1")]
        edges += [F.min("_o0").over(whole).alias(bounds[0]), F.max("_o1").over(whole).alias(bounds[1])]
    summary = b.groupBy(*keys, "_blk").agg(*aggs).select(*keys, "_blk", *edges)
    out = b.select("*", *local).join(summary, [*keys, "_blk"])
    made = []
    for i, (n, _, kind) in enumerate(jobs):
        c, p = F.col(f"_sc{i}"), F.col(f"_sp{i}")
        made.append((c + p if kind == "sum" else F.greatest(c, p) if kind in ("max", "maxb") else F.coalesce(c, p)).alias(n))
    names = {n for n, _, _ in jobs}
    keep = [F.col(c) for c in df.columns if c not in names]
    return out.select(*keep, *made, *(bounds or ()))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column], *, size: int = BLOCK) -> DataFrame:
    """Inclusive running sums along ``order`` (any unique integer order)."""
    return scan(df, keys, order, sums=sums, size=size)


def run_length(df: DataFrame, keys: Sequence[str], order: str, flag: str, *, name: str, first_run: str | None = None, size: int = BLOCK) -> DataFrame:
    """Length of the maximal run of equal boolean ``flag`` around each row of a dense track.

    The run reaches from the nearest row with the other value on one side to the nearest on
    the other, so no run is grouped.  ``first_run`` marks the run that opens the track.
    """
    on, pos = F.col(flag), F.col(order)
    at_t, at_f = F.when(on, pos), F.when(~on, pos)
    d = scan(
        df, keys, order, last={"_lt": at_t, "_lf": at_f}, next={"_nt": at_t, "_nf": at_f}, bounds=("_lo", "_hi"), size=size
    )
    left = F.when(on, F.col("_lf")).otherwise(F.col("_lt"))
    right = F.when(on, F.col("_nf")).otherwise(F.col("_nt"))
    d = d.withColumn(name, F.coalesce(right, F.col("_hi") + 1) - F.coalesce(left, F.col("_lo") - 1) - 1)
    if first_run:
        d = d.withColumn(first_run, left.isNull())
    return d.drop("_lt", "_lf", "_nt", "_nf", "_lo", "_hi")


def spread(df: DataFrame, keys: Sequence[str], order: str, stats: DataFrame, *, size: int = BLOCK) -> DataFrame:
    """Left-join one row of statistics per key to every row of the key.

    The statistics are first copied to the blocks of their key, so the wide side is joined on
    ``(keys, block)`` and a key with very many rows is not sent to one task.
    """
    b = read_once(df).withColumn("_blk", block_of(order, size))
    per_block = b.select(*keys, "_blk").distinct().join(stats, list(keys))
    return b.join(per_block, [*keys, "_blk"], "left").drop("_blk")
