"""Cleaning of landmark tracks: masks, outliers, spikes, gap interpolation, smoothing.

Landmarks are long rows ``(keys..., kp, frame, x, y, z, conf)``.  A landmark with any
missing coordinate counts as missing as a whole.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import names as N
from strideframe.operators.geometry import segment_lengths
from strideframe.operators.ordered import BLOCK, halo, lag_lead, running_sum, scan, spread
from strideframe.operators.quantiles import exact_quantiles, median_and_mad
from strideframe.operators.series import pad_edges
from strideframe.session import cut_lineage

XYZ = ("x", "y", "z")

# MAD to Gaussian sigma, smallest usable spread and smallest usable step.
MAD_SIGMA = 0.6745
MIN_SIGMA = 1e-8
MIN_STEP = 1e-12


def valid(cols: Sequence[str] = XYZ) -> Column:
    """All coordinates present and finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


def usable_frames(kps: DataFrame, keys: Sequence[str], *, min_keypoints: int | None = None, required: Sequence[str] = ()) -> DataFrame:
    """One ``ok`` flag per frame: every landmark valid, or at least ``min_keypoints`` of them
    together with all ``required`` names."""
    v = valid()
    if min_keypoints is None:
        return kps.groupBy(*keys).agg(F.bool_and(v).alias("ok"))
    ok = F.count_if(v) >= min_keypoints
    for n in required:
        ok = ok & F.coalesce(F.bool_or(F.when(F.col("kp") == n, v)), F.lit(False))
    return kps.groupBy(*keys).agg(ok.alias("ok"))


def mask_low_confidence(kps: DataFrame, threshold: float, exclude: Sequence[str] = ()) -> DataFrame:
    """Blank landmarks below the confidence threshold; names that contain an excluded pattern
    keep their values and are flagged ``conf_excluded`` instead."""
    low = F.coalesce(F.col("conf") < threshold, F.lit(False))
    skip = N.contains_any(F.col("kp"), exclude)
    d = kps.withColumn("conf_masked", low & ~skip).withColumn("conf_excluded", low & skip)
    return blank(d, F.col("conf_masked"))


def blank(df: DataFrame, when: Column, cols: Sequence[str] = XYZ) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(~when, F.col(c)))
    return df


def bone_outliers(kps: DataFrame, track: Sequence[str], frame: str, edges: DataFrame, *, threshold: float, exclude: Sequence[str] = ()) -> DataFrame:
    """Bones whose length is a robust-sigma outlier of their track: ``(track, frame, a, b)``."""
    e = edges.where(~N.contains_any(F.col("a"), exclude) & ~N.contains_any(F.col("b"), exclude))
    lengths = segment_lengths(kps.where(valid()), [*track, frame], e)
    stats = median_and_mad(lengths, [*track, "a", "b"], "length")
    sigma = F.col("mad") / MAD_SIGMA
    bad = (F.col("n") >= 5) & (sigma >= MIN_SIGMA) & (F.abs(F.col("length") - F.col("med")) > threshold * sigma)
    return spread(lengths, [*track, "a", "b"], frame, stats).where(bad).select(*track, frame, "a", "b")


def mask_bone_outliers(kps: DataFrame, track: Sequence[str], frame: str, edges: DataFrame, *, threshold: float = 3.0, exclude: Sequence[str] = ()) -> DataFrame:
    """Blank both ends of every outlier bone and flag them ``bone_flagged``."""
    bad = bone_outliers(kps, track, frame, edges, threshold=threshold, exclude=exclude)
    ends = bad.select(*track, frame, F.explode(F.array("a", "b")).alias("kp")).distinct().withColumn("bone_flagged", F.lit(True))
    d = kps.join(ends, [*track, frame, "kp"], "left").withColumn("bone_flagged", F.coalesce("bone_flagged", F.lit(False)))
    return blank(d, F.col("bone_flagged"))


def step_medians(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], *, size: int = BLOCK) -> DataFrame:
    """Median absolute step ``_m_<col>`` and number of steps ``_n_<col>`` per series.

    All columns are ranked together, the column being part of the key.
    """
    d = lag_lead(df.select(*keys, order, *cols), keys, order, lags={f"_p_{c}": c for c in cols}, size=size)
    steps = F.array(*[F.struct(F.lit(c).alias("_c"), F.abs(F.col(c) - F.col(f"_p_{c}")).alias("_s")) for c in cols])
    m = exact_quantiles(d.select(*keys, F.inline(steps)), [*keys, "_c"], "_s", {"_m": 0.5}, n="_n")
    pick = lambda v, c: F.max(F.when(F.col("_c") == c, F.col(v))).alias(f"{v}_{c}")
    return m.groupBy(*keys).agg(*[pick(v, c) for c in cols for v in ("_m", "_n")])


# Older repairs weigh 2**-distance, so rows further back than this no longer reach a double.
_REACH = 64


def despike(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], *, factor: float = 10.0, max_iterations: int = 1, size: int = BLOCK
) -> DataFrame:
    """Repair single-row reversals: both steps above ``factor`` times the series' median step.

    A repaired row is the mean of its neighbours, where the left one may itself have been
    repaired in the same pass; adjacent spikes therefore follow a halving recurrence along
    their run, evaluated from the spike rows before it.  Adds ``<col>_fixed`` counters.
    """
    scale = step_medians(df, keys, order, cols, size=size)
    d = spread(df, keys, order, scale, size=size)
    for c in cols:
        d = d.withColumn(f"{c}_fixed", F.lit(0))
    for i in range(max_iterations):
        d = _despike_pass(cut_lineage(d) if i else d, keys, order, cols, factor, size)
    return d.drop(*[f"_{t}_{c}" for c in cols for t in "mn"])


def _despike_pass(d: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], factor: float, size: int) -> DataFrame:
    d = lag_lead(d, keys, order, lags={f"_l_{c}": c for c in cols}, leads={f"_r_{c}": c for c in cols}, size=size)
    for c in cols:
        into, out = F.col(c) - F.col(f"_l_{c}"), F.col(f"_r_{c}") - F.col(c)
        thr = factor * F.col(f"_m_{c}")
        usable = (F.col(f"_n_{c}") >= 3) & (F.col(f"_m_{c}") >= MIN_STEP)
        spike = usable & (F.abs(into) > thr) & (F.abs(out) > thr) & (into * out < 0)
        d = d.withColumn(f"_k_{c}", F.coalesce(spike, F.lit(False)))

    def build(w):
        near = w.rangeBetween(-_REACH, 0)
        return {
            f"_h_{c}": F.collect_list(F.when(F.col(f"_k_{c}"), F.struct(F.col(order).alias("f"), F.col(f"_l_{c}").alias("l"), F.col(f"_r_{c}").alias("r")))).over(near)
            for c in cols
        }

    any_spike = F.lit(False)
    for c in cols:
        any_spike = any_spike | F.col(f"_k_{c}")
    hits = halo(
        d.where(any_spike).select(*keys, order, *[f"_{t}_{c}" for c in cols for t in "klr"]), keys, order, build, before=_REACH, size=size
    )
    fixes = hits.select(*keys, order, *[_halving(F.col(f"_h_{c}"), F.col(f"_k_{c}")).alias(f"_y_{c}") for c in cols])
    d = d.join(fixes, [*keys, order], "left")
    for c in cols:
        d = d.withColumn(f"{c}_fixed", F.col(f"{c}_fixed") + F.col(f"_k_{c}").cast("int")).withColumn(c, F.coalesce(f"_y_{c}", c))
    return d.drop(*[f"_{t}_{c}" for c in cols for t in "lrky"])


def _halving(history: Column, spike: Column) -> Column:
    """Value of the last spike row from its run of consecutive spike rows, oldest first."""
    start = F.struct(F.lit(None).cast("long").alias("f"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, row: Column) -> Column:
        left = F.when(row["f"] == acc["f"] + 1, acc["y"]).otherwise(row["l"])
        return F.struct(row["f"].cast("long").alias("f"), ((left + row["r"]) / 2).alias("y"))

    return F.when(spike, F.aggregate(history, start, step)["y"])


def median_despike(
    df: DataFrame, keys: Sequence[str], order: str, col: str, *, kernel: int = 7, factor: float = 10.0, max_fraction: float = 0.1, size: int = BLOCK
) -> DataFrame:
    """Replace rows far from the running median (zero-padded ends) unless ``max_fraction`` or
    more of the series would change.  Expects no missing values."""
    r = kernel // 2
    p = pad_edges(df, keys, order, r, "nearest", size=size)
    p = p.withColumn("_z", F.when(F.col("_pad"), F.lit(0.0)).otherwise(F.col(col)))
    p = halo(p, keys, order, lambda w: {"_med": F.percentile("_z", 0.5).over(w.rowsBetween(-r, r))}, before=r, after=r, size=size)
    p = p.where(~F.col("_pad")).drop("_pad", "_z")
    p = spread(p, keys, order, step_medians(df, keys, order, [col], size=size), size=size)
    far = F.coalesce(F.abs(F.col(col) - F.col("_med")) > factor * F.col(f"_m_{col}"), F.lit(False))
    p = cut_lineage(p.withColumn("_far", far & (F.col(f"_n_{col}") >= 5) & (F.col(f"_m_{col}") >= MIN_STEP)))
    share = p.groupBy(*keys).agg(F.count_if("_far").alias("_bad"), F.count(F.lit(1)).alias("_all"))
    p = spread(p, keys, order, share, size=size)
    use = F.col("_far") & (F.col("_bad") < F.col("_all") * max_fraction) & (F.col("_all") >= kernel)
    return p.withColumn("replaced", use).withColumn(col, F.when(use, F.col("_med")).otherwise(F.col(col))).drop(
        "_med", "_far", "_bad", "_all", f"_m_{col}", f"_n_{col}"
    )


def interpolate_gaps(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str] = XYZ, *, spline: bool = True, max_edge: int = 0, edge_fit: int = 5, size: int = BLOCK
) -> DataFrame:
    """Fill interior gaps with monotone cubic pieces (or straight lines) and up to ``max_edge``
    rows beyond either end with a line through the nearest ``edge_fit`` samples.

    Series with fewer than four or less than half of their samples stay as they are.  Adds
    ``interpolated`` and ``edge_gap`` (outside the first and last sample, filled or not).
    A cubic piece needs the samples next to the gap and their slopes, and a slope needs one
    neighbour on each side (two at a series end), so four samples around a gap decide it.
    """
    df = cut_lineage(df)
    good = df.where(valid(cols)).select(*keys, order, *cols)
    good = running_sum(good, keys, order, {"_i": F.lit(1).cast("long")}, size=size)

    def build(w):
        row = F.struct(F.col(order).alias("f"), *cols)
        return {"_b1": F.lag(row, 1).over(w), "_b2": F.lag(row, 2).over(w), "_a1": F.lead(row, 1).over(w), "_a2": F.lead(row, 2).over(w)}

    # "_i" is dense over the samples, so two rows either side are two samples.
    good = halo(good, keys, "_i", build, before=2, after=2, size=size)
    slopes = good.select(*keys, order, "_i", *[_pchip_slope(order, c).alias(f"_d_{c}") for c in cols])
    counts = df.groupBy(*keys).agg(F.count_if(valid(cols)).alias("_n"), F.count(F.lit(1)).alias("_t"))
    fit = _edge_lines(good, keys, order, cols, counts, edge_fit) if max_edge else None
    d = df.join(slopes, [*keys, order], "left").withColumn("_ok", F.col("_i").isNotNull())
    sample = F.when(F.col("_ok"), F.struct(F.col(order).alias("f"), *cols, *[f"_d_{c}" for c in cols]))
    d = scan(d, keys, order, last={"_p": sample}, next={"_q": sample}, bounds=("_lo", "_hi"), size=size)
    d = spread(d, keys, order, counts if fit is None else counts.join(fit, list(keys), "left"), size=size)
    enough = (F.col("_n") >= 4) & (F.col("_n") * 2 >= F.col("_t"))
    inside = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    lead_gap, tail_gap = F.col("_p").isNull(), F.col("_q").isNull()
    near_edge = (lead_gap & (F.col("_q.f") - F.col(order) <= max_edge)) | (tail_gap & (F.col(order) - F.col("_p.f") <= max_edge))
    fill = ~F.col("_ok") & enough & (inside | (F.lit(bool(max_edge)) & near_edge))
    h = F.col("_q.f") - F.col("_p.f")
    s = (F.col(order) - F.col("_p.f")) / h
    for c in cols:
        a, b = F.col(f"_p.{c}"), F.col(f"_q.{c}")
        if spline:
            m0, m1 = F.col(f"_p._d_{c}") * h, F.col(f"_q._d_{c}") * h
            piece = a * (1 + 2 * s) * (1 - s) * (1 - s) + m0 * s * (1 - s) * (1 - s) + b * s * s * (3 - 2 * s) + m1 * s * s * (s - 1)
        else:
            piece = a + (b - a) * s
        if max_edge:
            line = F.when(lead_gap, F.col(f"_s0_{c}") * F.col(order) + F.col(f"_k0_{c}")).otherwise(F.col(f"_s1_{c}") * F.col(order) + F.col(f"_k1_{c}"))
            piece = F.when(inside, piece).otherwise(line)
        d = d.withColumn(c, F.when(fill, piece).otherwise(F.col(c)))
    return d.select(*df.columns, fill.alias("interpolated"), (lead_gap | tail_gap).alias("edge_gap"))


def _pchip_slope(order: str, c: str) -> Column:
    x, f = F.col(c), F.col(order)
    h0, h1 = f - F.col("_b1.f"), F.col("_a1.f") - f
    d0, d1 = (x - F.col(f"_b1.{c}")) / h0, (F.col(f"_a1.{c}") - x) / h1
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 > 0, (w0 + w1) / (w0 / F.when(d0 != 0, d0) + w1 / F.when(d1 != 0, d1))).otherwise(0.0)

    def end(near: Column, far: Column, hn: Column, hf: Column) -> Column:
        e = ((2 * hn + hf) * near - hn * far) / (hn + hf)
        return F.when(F.signum(e) != F.signum(near), 0.0).when((F.signum(near) != F.signum(far)) & (F.abs(e) > 3 * F.abs(near)), 3 * near).otherwise(e)

    hf = F.col("_a2.f") - F.col("_a1.f")
    first = end(d1, (F.col(f"_a2.{c}") - F.col(f"_a1.{c}")) / hf, h1, hf)
    hb = F.col("_b1.f") - F.col("_b2.f")
    last = end(d0, (F.col(f"_b1.{c}") - F.col(f"_b2.{c}")) / hb, h0, hb)
    return (
        F.when(F.col("_b1").isNull() & F.col("_a1").isNull(), F.lit(0.0))
        .when(F.col("_b1").isNull(), F.when(F.col("_a2").isNull(), d1).otherwise(first))
        .when(F.col("_a1").isNull(), F.when(F.col("_b2").isNull(), d0).otherwise(last))
        .otherwise(inner)
    )


def _edge_lines(good: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], counts: DataFrame, k: int) -> DataFrame:
    ends = counts.select(*keys, F.col("_n").alias("_cnt"))
    g = good.join(ends, list(keys)).where((F.col("_i") <= k) | (F.col("_i") > F.col("_cnt") - k))
    aggs = []
    for c in cols:
        for tag, pick in (("0", F.col("_i") <= k), ("1", F.col("_i") > F.col("_cnt") - k)):
            y, x = F.when(pick, F.col(c)), F.when(pick, F.col(order).cast("double"))
            aggs += [F.regr_slope(y, x).alias(f"_s{tag}_{c}"), F.regr_intercept(y, x).alias(f"_k{tag}_{c}")]
    return g.groupBy(*keys).agg(*aggs)


def savgol_weights(window: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> list[list[float]]:
    """Row ``p`` gives the least-squares value (or derivative) at position ``p`` of a window."""
    x = np.arange(window, dtype=float)
    fit = np.linalg.pinv(np.vander(x, polyorder + 1, increasing=True))
    rows = []
    for p in range(window):
        powers = np.zeros(polyorder + 1)
        for k in range(deriv, polyorder + 1):
            coef = np.prod(np.arange(k, k - deriv, -1)) if deriv else 1.0
            powers[k] = coef * float(p) ** (k - deriv)
        rows.append([float(v) for v in powers @ fit / delta**deriv])
    return rows


def savgol(
    df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, str], *, window: int = 11, polyorder: int = 3, deriv: int = 0,
    delta: float = 1.0, size: int = BLOCK,
) -> DataFrame:
    """Savitzky-Golay over a dense series: fixed weights inside, the border window's polynomial
    at the ends.  A series with a missing value is returned as it is; one shorter than the
    window uses the longest odd window that fits."""
    window += window % 2 == 0
    have = F.lit(True)
    for c in cols.values():
        have = have & F.col(c).isNotNull()
    gaps = df.groupBy(*keys).agg(F.bool_and(have).alias("_full"), F.count(F.lit(1)).alias("_t"))
    d = scan(df, keys, order, bounds=("_lo", "_hi"), size=size)
    d = spread(d, keys, order, gaps, size=size)
    pos, n = F.col(order) - F.col("_lo"), F.col("_t")
    reach = window - 1
    near = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols.values())])
    d = halo(d, keys, order, lambda w: {"_near": F.collect_list(near).over(w.rowsBetween(-reach, reach))}, before=reach, after=reach, size=size)
    picked, weights = F.lit(None), F.lit(None)
    for size_w in range(3, window + 1, 2):
        if size_w <= polyorder:
            continue
        half, rows = size_w // 2, savgol_weights(size_w, polyorder, deriv, delta)
        table = F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])
        tail = n - 1 - pos
        # The list starts at the first row within reach, so the row itself stands at min(pos, reach) + 1.
        first = F.when(pos < half, F.lit(1)).when(tail < half, F.size("_near") - size_w + 1).otherwise(F.least(pos, F.lit(reach)) - half + 1)
        row = F.when(pos < half, pos).when(tail < half, size_w - 1 - tail).otherwise(half)
        fits = F.col("_full") & (n >= window if size_w == window else (n >= size_w) & (n < size_w + 2))
        picked = F.when(fits, F.slice("_near", first.cast("int"), size_w)).otherwise(picked)
        weights = F.when(fits, F.element_at(table, (row + 1).cast("int"))).otherwise(weights)
    d = d.withColumn("_near", picked).withColumn("_wt", weights)

    def smoothed(i: int, c: str) -> Column:
        total = F.aggregate(F.zip_with(F.col("_near")[f"c{i}"], F.col("_wt"), lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.col("_wt").isNotNull(), total).otherwise(F.col(c) if deriv == 0 else F.lit(None).cast("double"))

    d = d.withColumns({f"_out_{name}": smoothed(i, c) for i, (name, c) in enumerate(cols.items())})
    d = d.withColumns({name: F.col(f"_out_{name}") for name in cols})
    return d.drop("_lo", "_hi", "_full", "_t", "_near", "_wt", *[f"_out_{n}" for n in cols])


def reinstate_raw(filtered: DataFrame, raw: DataFrame, keys: Sequence[str], keep_patterns: Sequence[str] = ()) -> DataFrame:
    """Give back raw landmarks that filtering lost, and raw values for kept name patterns."""
    r = raw.where(valid()).select(*keys, "kp", F.struct(*XYZ).alias("_raw"))
    d = filtered.join(r, [*keys, "kp"], "left")
    take = F.col("_raw").isNotNull() & (~valid() | N.contains_any(F.col("kp"), keep_patterns))
    d = d.withColumn("reinstated", take)
    for c in XYZ:
        d = d.withColumn(c, F.when(F.col("reinstated"), F.col(f"_raw.{c}")).otherwise(F.col(c)))
    return d.drop("_raw")


# The shipped filter settings.
FILTER_DEFAULTS = {
    "enabled": True,
    "confidence": {"enabled": True, "threshold": 0.3, "exclude_keypoint_patterns": ["Wing"]},
    "bone_length": {"enabled": True, "threshold_std": 5.0, "exclude_keypoint_patterns": ["Wing"]},
    "isolated_spike": {"enabled": True, "threshold_factor": 10.0, "max_iterations": 1},
    "interpolation": {"enabled": True, "use_spline": True, "max_edge_extrap_frames": 5, "edge_fit_window": 5},
    "savgol": {"enabled": True, "window_length": 7, "polyorder": 2},
    "preserve_raw_patterns": ["Wing"],
}


def filter_config(changes: Mapping | None = None) -> dict:
    """Defaults with ``changes`` applied; an unknown key is refused with the closest known one."""
    cfg = {k: dict(v) if isinstance(v, dict) else v for k, v in FILTER_DEFAULTS.items()}
    for key, value in (changes or {}).items():
        if key not in cfg:
            raise KeyError(_unknown(key, cfg))
        if isinstance(cfg[key], dict):
            for sub, sv in value.items():
                if sub not in cfg[key]:
                    raise KeyError(_unknown(f"{key}.{sub}", [f"{key}.{k}" for k in cfg[key]]))
                cfg[key][sub] = sv
        else:
            cfg[key] = value
    return cfg


def _unknown(key: str, known) -> str:
    close = difflib.get_close_matches(key, list(known), 1)
    return f"unknown setting {key!r}" + (f"; did you mean {close[0]!r}?" if close else "")


def filter_chain(kps: DataFrame, track: Sequence[str], frame: str, edges: DataFrame, cfg: Mapping | None = None, *, size: int = BLOCK) -> DataFrame:
    """Confidence mask, bone lengths, spikes, gaps, smoothing, raw values back, in that order.

    Every stage leaves its flag column, so ``filter_report`` is a single aggregate.
    """
    c = filter_config(cfg)
    series = [*track, "kp"]
    base = kps.select(*track, frame, "kp", *XYZ, "conf")
    d = base
    if not c["enabled"]:
        return _with_flags(d)
    if (s := c["confidence"])["enabled"]:
        d = mask_low_confidence(d, s["threshold"], s["exclude_keypoint_patterns"])
    if (s := c["bone_length"])["enabled"]:
        d = mask_bone_outliers(cut_lineage(d), track, frame, edges, threshold=s["threshold_std"], exclude=s["exclude_keypoint_patterns"])
    if (s := c["isolated_spike"])["enabled"]:
        d = despike(cut_lineage(d), series, frame, XYZ, factor=s["threshold_factor"], max_iterations=s["max_iterations"], size=size)
    if (s := c["interpolation"])["enabled"]:
        d = interpolate_gaps(
            d, series, frame, XYZ, spline=s["use_spline"], max_edge=s["max_edge_extrap_frames"], edge_fit=s["edge_fit_window"], size=size
        )
    if (s := c["savgol"])["enabled"]:
        d = savgol(cut_lineage(d), series, frame, {a: a for a in XYZ}, window=s["window_length"], polyorder=s["polyorder"], size=size)
    d = reinstate_raw(d, base, [*track, frame], c["preserve_raw_patterns"])
    return _with_flags(d)


_FLAGS = {"conf_masked": False, "conf_excluded": False, "bone_flagged": False, "x_fixed": 0, "y_fixed": 0, "z_fixed": 0, "interpolated": False, "edge_gap": False}


def _with_flags(d: DataFrame) -> DataFrame:
    for n, v in _FLAGS.items():
        if n not in d.columns:
            d = d.withColumn(n, F.lit(v))
    return d


def filter_report(filtered: DataFrame, track: Sequence[str], frame: str) -> DataFrame:
    """Counts per track of what each stage changed; an edge frame counts once for all landmarks."""
    by_frame = filtered.groupBy(*track, frame).agg(
        F.count_if("conf_masked").alias("_cm"),
        F.count_if("conf_excluded").alias("_ce"),
        F.count_if("bone_flagged").alias("_bf"),
        F.sum(F.col("x_fixed") + F.col("y_fixed") + F.col("z_fixed")).alias("_sp"),
        F.count_if("interpolated").alias("_in"),
        F.bool_or("edge_gap").alias("_eg"),
    )
    return by_frame.groupBy(*track).agg(
        F.sum("_cm").alias("n_confidence_masked"),
        F.sum("_ce").alias("n_excluded"),
        F.sum("_bf").alias("n_bone_flagged"),
        F.sum("_sp").alias("n_spikes_fixed"),
        F.sum(F.col("_in") * 3).alias("n_interp_values"),
        F.count_if("_eg").alias("n_edge_frames"),
    )
