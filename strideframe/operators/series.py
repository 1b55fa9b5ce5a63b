"""Filters, derivatives and fills along dense ordered tracks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import BLOCK, halo, lag_lead, running_sum, scan
from strideframe.operators.quantiles import exact_median  # noqa: F401  (re-exported for series summaries)
from strideframe.operators.runs import dilate, linked_events


def rolling(
    df: DataFrame, keys: Sequence[str], order: str, value: str, *, before: int, after: int, how: str | float, name: str,
    min_periods: int = 1, size: int = BLOCK,
) -> DataFrame:
    """Rolling median, percentile (a number in 0..1), mean, minimum or maximum; nulls are skipped and
    a frame with fewer than ``min_periods`` values gives null."""
    x = F.col(value)
    agg = {"median": lambda c: F.percentile(c, 0.5), "mean": F.avg, "min": F.min, "max": F.max}[how](x) if isinstance(how, str) else F.percentile(x, float(how))

    def build(w):
        f = w.rowsBetween(-before, after)
        return {name: F.when(F.count(x).over(f) >= min_periods, agg.over(f))}

    return halo(df, keys, order, build, before=before, after=after, size=size)


def pad_edges(df: DataFrame, keys: Sequence[str], order: str, radius: int, edge: str, *, size: int = BLOCK) -> DataFrame:
    """Add ``radius`` rows outside each end of a dense track, copied from the rows inside.

    ``reflect`` repeats the border row (d c b a | a b c d), ``mirror`` does not,
    ``nearest`` repeats the border row only.  Padded rows carry ``_pad = true``.
    A track shorter than the radius is reflected again until the padding is full.
    """
    b = scan(df, keys, order, bounds=("_lo", "_hi"), size=size)
    n = F.col("_hi") - F.col("_lo") + 1
    pos = F.col(order) - F.col("_lo")
    # Offsets in 1..radius outside either end whose source is this row.
    offs = F.sequence(F.lit(1), F.lit(radius))

    def source(q: Column) -> Column:
        # q: virtual position, may be < 0 or >= n
        if edge == "nearest":
            return F.least(F.greatest(q, F.lit(0)), n - 1)
        if edge == "reflect":
            m = F.pmod(q, 2 * n)
            return F.when(m < n, m).otherwise(2 * n - 1 - m)
        period = F.greatest(2 * n - 2, F.lit(1))
        m = F.pmod(q, period)
        return F.when(m < n, m).otherwise(period - m)

    near = (pos < radius) | (n - 1 - pos < radius) | (n <= radius)
    virtual = F.concat(F.transform(offs, lambda o: -o.cast("long")), F.transform(offs, lambda o: n - 1 + o.cast("long")))
    pads = (
        b.where(near)
        .withColumn("_q", F.explode(F.filter(virtual, lambda q: source(q) == pos)))
        .withColumn(order, F.col("_lo") + F.col("_q"))
        .withColumn("_pad", F.lit(True))
        .drop("_q")
    )
    return b.withColumn("_pad", F.lit(False)).unionByName(pads).drop("_lo", "_hi")


def fir(
    df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, str | Column], taps: Sequence[float], *, edge: str = "reflect",
    first: int | None = None, null_aware: bool = False, size: int = BLOCK,
) -> DataFrame:
    """Weighted sum over ``len(taps)`` rows starting ``first`` rows from the current one
    (centred by default).  ``null_aware`` divides by the weight of the non-null rows and keeps
    null where the row itself is null."""
    lo = -(len(taps) // 2) if first is None else first
    hi = lo + len(taps) - 1
    radius = max(abs(lo), abs(hi))
    d = df
    for i, c in enumerate(cols.values()):
        d = d.withColumn(f"_f{i}", F.col(c) if isinstance(c, str) else c)
    d = pad_edges(d, keys, order, radius, edge, size=size)

    def build(w):
        out = {}
        for i, n in enumerate(cols):
            x = F.col(f"_f{i}")

            def shifted(c: Column, k: int) -> Column:
                return F.lag(c, -k).over(w) if k else c

            if null_aware:
                num = sum((F.coalesce(shifted(x, lo + j), F.lit(0.0)) * t for j, t in enumerate(taps)), F.lit(0.0))
                den = sum((shifted(x.isNotNull().cast("double"), lo + j) * t for j, t in enumerate(taps)), F.lit(0.0))
                out[f"_o{i}"] = F.when(x.isNotNull() & (den > 0), num / den)
            else:
                out[f"_o{i}"] = sum((shifted(x, lo + j) * t for j, t in enumerate(taps)), F.lit(0.0))
        return out

    out = halo(d, keys, order, build, before=radius, after=radius, size=size)
    out = out.where(~F.col("_pad"))
    for i, n in enumerate(cols):
        out = out.withColumn(n, F.col(f"_o{i}"))
    return out.drop("_pad", *[f"_{t}{i}" for t in "fo" for i in range(len(cols))])


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * float(sigma) + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]


def gaussian_smooth(df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, str | Column], sigma: float, *, null_aware: bool = True, size: int = BLOCK) -> DataFrame:
    """Gaussian smoothing with reflected ends; missing rows stay missing and add no weight."""
    return fir(df, keys, order, cols, gaussian_taps(sigma), edge="reflect", null_aware=null_aware, size=size)


def step_change(df: DataFrame, keys: Sequence[str], order: str, value: str, *, fps: float, name: str, size: int = BLOCK) -> DataFrame:
    """|difference to the previous row| per second, 0 on the first row."""
    d = lag_lead(df, keys, order, lags={"_p": value}, size=size)
    return d.withColumn(name, F.abs(F.col(value) - F.coalesce(F.col("_p"), F.col(value))) * fps).drop("_p")


def gradient(df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, str], *, scale: float = 1.0, size: int = BLOCK) -> DataFrame:
    """Central differences, one-sided at the two ends of a track."""
    one = F.struct(F.lit(1).alias("o"))
    lags = {f"_l{i}": c for i, c in enumerate(cols.values())} | {"_lp": one}
    leads = {f"_r{i}": c for i, c in enumerate(cols.values())} | {"_rp": one}
    d = lag_lead(df, keys, order, lags=lags, leads=leads, size=size)
    for i, (n, c) in enumerate(cols.items()):
        l, x, r = F.col(f"_l{i}"), F.col(c), F.col(f"_r{i}")
        g = F.when(F.col("_lp").isNull(), r - x).when(F.col("_rp").isNull(), x - l).otherwise((r - l) / 2)
        d = d.withColumn(n, g * scale)
    return d.drop("_lp", "_rp", *[f"_{s}{i}" for s in "lr" for i in range(len(cols))])


def unwrap(df: DataFrame, keys: Sequence[str], order: str, angle: str, *, name: str, size: int = BLOCK) -> DataFrame:
    """Remove 2*pi jumps of a dense, null-free angle."""
    d = lag_lead(df, keys, order, lags={"_p": angle}, size=size)
    step = F.col(angle) - F.col("_p")
    turns = (
        F.when(step > math.pi, -F.ceil((step - math.pi) / (2 * math.pi)))
        .when(step < -math.pi, F.ceil((-step - math.pi) / (2 * math.pi)))
        .otherwise(0)
    )
    d = running_sum(d, keys, order, {"_k": turns.cast("long")}, size=size)
    return d.withColumn(name, F.col(angle) + 2 * math.pi * F.col("_k")).drop("_p", "_k")


def linear_phase(df: DataFrame, keys: Sequence[str], order: str, onset: Column, *, name: str, size: int = BLOCK) -> DataFrame:
    """-pi at an onset rising linearly to +pi at the next; null outside the first and last onset."""
    at = F.when(onset, F.col(order))
    d = scan(df, keys, order, last={"_f0": at}, after={"_f1": at}, size=size)
    return d.withColumn(name, -math.pi + 2 * math.pi * (F.col(order) - F.col("_f0")) / (F.col("_f1") - F.col("_f0"))).drop("_f0", "_f1")


def fill_short_gaps(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], *, max_gap: int = 10, size: int = BLOCK) -> DataFrame:
    """Linear blend across interior runs of at most ``max_gap`` bad rows, where a row is bad
    when any column is missing; a bad row inside such a run is overwritten whole."""
    good = F.lit(True)
    for c in cols:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pack = F.when(good, F.struct(F.col(order).alias("f"), *[F.col(c).alias(c) for c in cols]))
    d = scan(df.withColumn("_good", good), keys, order, last={"_a": pack}, next={"_b": pack}, size=size)
    gap = F.col("_b.f") - F.col("_a.f")
    fill = ~F.col("_good") & F.coalesce(gap - 1 <= max_gap, F.lit(False))
    w = (F.col(order) - F.col("_a.f")) / gap
    for c in cols:
        d = d.withColumn(c, F.when(fill, F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * w).otherwise(F.col(c)))
    return d.withColumn("filled", fill).drop("_a", "_b", "_good")


def detrend_baseline(df: DataFrame, keys: Sequence[str], order: str, value: str, *, window: int, name: str, size: int = BLOCK) -> DataFrame:
    """Value minus its moving average; an even window reaches one row further back, ends repeat."""
    d = fir(df, keys, order, {"_base": value}, [1.0 / window] * window, edge="nearest", first=-(window // 2), size=size)
    return d.withColumn(name, F.col(value) - F.col("_base")).drop("_base")


def minus_group_mean(df: DataFrame, keys: Sequence[str], value: str, *, name: str) -> DataFrame:
    """Value minus the mean of its group, through a pre-aggregated join rather than a group window."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(means, list(keys)).withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def classify_behaviour(df: DataFrame, keys: Sequence[str], order: str, *, link: int, sync: int, size: int = BLOCK) -> DataFrame:
    """Grooming classes from the per-frame flags ``cross, near_l, near_r, leg, roll, near_antenna``.

    Two consecutive crossings (or two-sided touches) at most ``link`` frames apart label the
    span between them; a touch is two-sided when the other side is near within ``sync``
    frames.  Rolling overrides episodes and leg rubbing overrides everything.
    """
    d = dilate(df, keys, order, "near_l", sync, name="_wl", size=size)
    d = dilate(d, keys, order, "near_r", sync, name="_wr", size=size)
    d = d.withColumn("_both", (F.col("near_l") & F.col("_wr")) | (F.col("near_r") & F.col("_wl")))
    d = linked_events(d, keys, order, {"_ant": "cross", "_eye": "_both"}, link, size=size)
    cls = (
        F.when(F.col("leg"), "leg rubbing")
        .when(F.col("roll"), "proboscis/ocelli")
        .when(F.col("_eye"), "eye cleaning")
        .when(F.col("_ant"), "antennal")
        .when(F.col("near_antenna"), "antennal")
        .otherwise("unclassified")
    )
    return d.withColumn("behaviour", cls).drop("_wl", "_wr", "_both", "_ant", "_eye")
