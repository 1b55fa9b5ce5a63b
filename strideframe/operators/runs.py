"""Runs, gaps, hysteresis and episode operators over dense ordered tracks.

All of them use the block primitives of ``ordered``, so neither a long track nor a long
run is gathered into one task: a run is only ever a group key of a combinable aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import BLOCK, halo, lag_lead, run_length, running_sum, scan
from strideframe.session import cut_lineage


def label_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, *, name: str = "run", size: int = BLOCK) -> DataFrame:
    """Number the maximal runs of equal ``value`` along a dense order, from 1."""
    df = lag_lead(df, keys, order, lags={"_pv": F.struct(F.col(value).alias("v"))}, size=size)
    start = F.col("_pv").isNull() | ~F.col("_pv.v").eqNullSafe(F.col(value))
    return running_sum(df, keys, order, {name: start.cast("long")}, size=size).drop("_pv")


def run_table(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    *,
    aggs: Mapping[str, Column] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """One row per maximal run: its value, inclusive ``start``/``end``, length ``n`` and ``aggs``."""
    labelled = label_runs(df, keys, order, value, size=size)
    return labelled.groupBy(*keys, "run").agg(
        F.max(value).alias(value),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(n) for n, c in (aggs or {}).items()],
    )


def true_runs(df: DataFrame, keys: Sequence[str], order: str, flag: str, *, min_len: int = 1, size: int = BLOCK) -> DataFrame:
    """Inclusive ``start, end, n`` of every maximal run of true rows (null counts as false)."""
    d = df.select(*keys, order, F.coalesce(F.col(flag), F.lit(False)).alias(flag))
    return run_table(d, keys, order, flag, size=size).where(F.col(flag) & (F.col("n") >= min_len)).drop(flag, "run")


def bridged_runs(
    df: DataFrame, keys: Sequence[str], order: str, flag: str, *, min_duration: int = 3, max_gap: int = 2, size: int = BLOCK
) -> DataFrame:
    """Runs of true rows that bridge up to ``max_gap`` false rows, numbered from 1 per key
    after runs shorter than ``min_duration`` are dropped."""
    hits = df.where(F.col(flag)).select(*keys, order)
    hits = scan(hits, keys, order, before={"_prev": F.col(order)}, size=size)
    new = F.col("_prev").isNull() | (F.col(order) - F.col("_prev") - 1 > max_gap)
    runs = (
        running_sum(hits, keys, order, {"_run": new.cast("long")}, size=size)
        .groupBy(*keys, "_run")
        .agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"))
        .withColumn("n_frames", F.col("end_frame") - F.col("start_frame") + 1)
        .where(F.col("n_frames") >= min_duration)
    )
    kept = running_sum(runs, keys, "_run", {"bout": F.lit(1).cast("long")}, size=size)
    return kept.drop("_run")


def dilate(df: DataFrame, keys: Sequence[str], order: str, flag: str, radius: int, *, name: str, size: int = BLOCK) -> DataFrame:
    """True within ``radius`` rows of a true row."""
    return halo(
        df, keys, order, lambda w: {name: F.max(F.col(flag)).over(w.rowsBetween(-radius, radius))},
        before=radius, after=radius, size=size,
    )


def hysteresis(
    df: DataFrame, keys: Sequence[str], order: str, set_when: Column, reset_when: Column, *, name: str, size: int = BLOCK
) -> DataFrame:
    """Latch: on from the last set, off from the last reset, off before either."""
    ev = F.when(set_when, F.lit(True)).when(reset_when, F.lit(False))
    return scan(df, keys, order, last={name: ev}, size=size).withColumn(name, F.coalesce(name, F.lit(False)))


def absorb_short_runs(df: DataFrame, keys: Sequence[str], order: str, flag: str, min_run: int, *, name: str, size: int = BLOCK) -> DataFrame:
    """Give runs of a boolean state shorter than ``min_run`` the state before them; the first
    run of a track stays.

    A left-to-right pass hands the absorbed state on to the next short run, so the new state
    is the value of the last run that was long enough (or the first).
    """
    d = run_length(cut_lineage(df), keys, order, flag, name="_len", first_run="_first", size=size)
    keep = F.when((F.col("_len") >= min_run) | F.col("_first"), F.col(flag))
    return scan(d, keys, order, last={name: keep}, size=size).drop("_len", "_first")


def merge_short_segments(df: DataFrame, keys: Sequence[str], order: str, value: str, min_len: int, *, name: str, size: int = BLOCK) -> DataFrame:
    """Relabel segments shorter than ``min_len`` with the label to their left; a short first
    segment takes the label to its right."""
    lab = cut_lineage(label_runs(df, keys, order, value, size=size))
    segs = lab.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_val"))
    segs = lag_lead(segs, keys, "run", leads={"_right": "_val"}, size=size)
    keep = F.when(F.col("_n") >= min_len, F.col("_val")).when(F.col("run") == 1, F.coalesce("_right", "_val"))
    segs = scan(segs, keys, "run", last={name: keep}, size=size).select(*keys, "run", name)
    return lab.join(segs, [*keys, "run"]).drop("run")


def bridge_and_drop(
    df: DataFrame, keys: Sequence[str], order: str, flag: str, *, max_gap: int, min_len: int, name: str, size: int = BLOCK
) -> DataFrame:
    """Fill interior false runs of at most ``max_gap`` rows, then clear true runs shorter
    than ``min_len``."""
    at = F.when(F.col(flag), F.col(order))
    d = scan(df, keys, order, last={"_a": at}, next={"_b": at}, size=size)
    d = d.withColumn(name, F.col(flag) | F.coalesce(F.col("_b") - F.col("_a") - 1 <= max_gap, F.lit(False))).drop("_a", "_b")
    return clear_short(d, keys, order, name, min_len, on=True, size=size)


def clear_short(df: DataFrame, keys: Sequence[str], order: str, flag: str, min_len: int, *, on: bool, size: int = BLOCK) -> DataFrame:
    """Flip runs of ``flag == on`` that are shorter than ``min_len`` rows."""
    d = run_length(df, keys, order, flag, name="_len", size=size)
    flip = (F.col(flag) == F.lit(on)) & (F.col("_len") < min_len)
    return d.withColumn(flag, F.when(flip, ~F.col(flag)).otherwise(F.col(flag))).drop("_len")


def linked_events(df: DataFrame, keys: Sequence[str], order: str, marks: Mapping[str, str], link: int, *, size: int = BLOCK) -> DataFrame:
    """For each ``name: flag`` mark every row from one rising edge of the flag to the next when
    the two are at most ``link`` rows apart."""
    d = lag_lead(df, keys, order, lags={f"_p{i}": f for i, f in enumerate(marks.values())}, size=size)
    for i, f in enumerate(marks.values()):
        d = d.withColumn(f"_e{i}", F.when(F.col(f) & ~F.coalesce(F.col(f"_p{i}"), F.lit(False)), F.col(order)))
    rng = range(len(marks))
    d = scan(
        d, keys, order,
        last={f"_l{i}": F.col(f"_e{i}") for i in rng}, before={f"_b{i}": F.col(f"_e{i}") for i in rng},
        after={f"_a{i}": F.col(f"_e{i}") for i in rng}, size=size,
    )
    for i, n in enumerate(marks):
        e, l, b, a = (F.col(f"_{t}{i}") for t in "elba")
        linked = F.coalesce(a - l <= link, F.lit(False)) | F.coalesce(e - b <= link, F.lit(False))
        d = d.withColumn(n, linked)
    return d.drop(*[f"_{t}{i}" for t in "pelba" for i in rng])


def run_windows(df: DataFrame, keys: Sequence[str], order: str, flag: str, window: int, overlap: int, *, size: int = BLOCK) -> DataFrame:
    """Overlapping windows of ``window`` rows inside each run of true rows.

    Returns ``keys, start, n, win, win_start, win_end, own_start, own_end`` (inclusive rows);
    the owned ranges of one run tile it, ownership changing in the middle of an overlap.
    """
    runs = true_runs(df, keys, order, flag, size=size).withColumnRenamed("n", "run_n")
    step = window - overlap
    full = F.floor((F.col("run_n") - window) / F.lit(step))
    n_win = F.when(F.col("run_n") <= window, F.lit(1)).otherwise(
        full + 1 + F.when(F.pmod(F.col("run_n") - window, F.lit(step)) > 0, 1).otherwise(0)
    )

    def offset(k: Column) -> Column:
        return F.when(F.col("run_n") <= window, F.lit(0)).otherwise(F.least(k * step, F.col("run_n") - window))

    w = runs.withColumn("_nw", n_win.cast("long")).withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nw") - 1)))
    k = F.col("win")
    switch_in = F.when(k == 0, F.lit(0)).otherwise(F.floor((offset(k) + offset(k - 1) + window) / F.lit(2)))
    switch_out = F.when(k == F.col("_nw") - 1, F.col("run_n")).otherwise(F.floor((offset(k + 1) + offset(k) + window) / F.lit(2)))
    begin = F.col("start")
    return w.select(
        *keys,
        F.col("start").alias("run_start"),
        "run_n",
        "win",
        (begin + offset(k)).cast("long").alias("win_start"),
        (begin + F.least(offset(k) + window, F.col("run_n")) - 1).cast("long").alias("win_end"),
        (begin + switch_in).cast("long").alias("own_start"),
        (begin + switch_out - 1).cast("long").alias("own_end"),
    )


def interval_union(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", *, size: int = BLOCK) -> DataFrame:
    """Merge overlapping or touching (``start <= running end``) intervals per key.

    Equal starts are collapsed first, so the start column is a valid block order.
    """
    one = df.groupBy(*keys, F.col(start).cast("long").alias("_s")).agg(F.max(end).cast("long").alias("_e"))
    m = scan(one, keys, "_s", max_before={"_reach": F.col("_e")}, size=size)
    new = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach"))
    g = running_sum(m, keys, "_s", {"_g": new.cast("long")}, size=size)
    return g.groupBy(*keys, "_g").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_g")


def gap_report(df: DataFrame, keys: Sequence[str], order: str, present: str, *, size: int = BLOCK) -> DataFrame:
    """Every maximal run of absent rows."""
    d = df.withColumn("_absent", ~F.coalesce(F.col(present), F.lit(False)))
    return true_runs(d, keys, order, "_absent", size=size)

