"""Leg phase, step cycles, episodes and contact rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions import vectors as V
from strideframe.functions.terrain import Stairs
from strideframe.operators.ordered import BLOCK, block_of, lag_lead, running_sum, scan, spread
from strideframe.operators.quantiles import attach, exact_median, exact_quantiles
from strideframe.operators.recursive import Rows, by_group
from strideframe.operators.runs import label_runs, run_table
from strideframe.operators.series import unwrap
from strideframe.session import cut_lineage


def relative_phase(df: DataFrame, keys: Sequence[str], leg: str, phase: str, reference) -> DataFrame:
    """Each leg's phase minus the reference leg's in the same frame, wrapped to [-pi, pi]."""
    ref = df.where(F.col(leg) == F.lit(reference)).select(*keys, F.col(phase).alias("_ref"))
    return df.join(ref, list(keys)).withColumn("rel_phase", V.wrap(F.col(phase) - F.col("_ref"))).drop("_ref")


def stance_from_phase(df: DataFrame, phase: str, name: str = "stance") -> DataFrame:
    """Stance where |phase| >= pi/2, swing below, null where the phase is missing."""
    return df.withColumn(name, F.abs(F.col(phase)) >= math.pi / 2)


def legs_in_stance(df: DataFrame, keys: Sequence[str], stance: str = "stance") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(stance)).alias("n_legs_stance"))


def phase_crossings(df: DataFrame, keys: Sequence[str], order: str, phase: str, level: float, *, min_samples: int = 4, size: int = BLOCK) -> DataFrame:
    """Rows just before the unwrapped phase passes ``level`` (mod 2 pi) upwards.

    Missing phases are skipped; a series with fewer than ``min_samples`` phases has no events.
    -pi/2 is liftoff, +pi/2 landing and 0 mid-swing.
    """
    d = df.where(F.col(phase).isNotNull() & ~F.isnan(phase)).select(*keys, order, F.col(phase).alias("_ph"))
    d = running_sum(d, keys, order, {"_i": F.lit(1).cast("long")}, size=size)
    d = unwrap(cut_lineage(d), keys, "_i", "_ph", name="_u", size=size)
    d = d.withColumn("_turn", F.floor((F.col("_u") - level) / V.TAU))
    d = scan(d.drop("_u", "_ph"), keys, "_i", after={"_nt": F.col("_turn")}, bounds=("_lo", "_hi"), size=size)
    return d.where((F.col("_nt") > F.col("_turn")) & (F.col("_hi") >= min_samples)).select(*keys, order)


def liftoffs(df: DataFrame, keys: Sequence[str], order: str, phase: str, **kw) -> DataFrame:
    return phase_crossings(df, keys, order, phase, -math.pi / 2, **kw)


def landings(df: DataFrame, keys: Sequence[str], order: str, phase: str, **kw) -> DataFrame:
    return phase_crossings(df, keys, order, phase, math.pi / 2, **kw)


def step_cycles(
    frames: DataFrame, onsets: DataFrame, track: Sequence[str], order: str, leg: str, speed: str, *, fps: float, min_ms: float, min_speed: float,
    size: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Step cycles of every track and its frames with their cycle.

    The leg with the earliest liftoff (first by name on ties) defines the cycles, each one
    from a liftoff of that leg to its next; short and slow cycles are dropped and the rest
    numbered from 0.  Returns ``cycles(track, cycle, start, end, leg, mean_speed)`` with
    ``end`` exclusive, and ``frames`` with ``cycle`` and ``mean_speed`` (null outside).
    """
    first = onsets.groupBy(*track, leg).agg(F.min(order).alias("_f"))
    ref = first.groupBy(*track).agg(F.min(F.struct("_f", leg))[leg].alias(leg))
    marks = onsets.join(ref, [*track, leg]).select(*track, order, F.col(leg).alias("_leg"))
    marks = scan(marks, track, order, after={"_end": F.col(order)}, size=size)
    d = cut_lineage(frames.join(marks, [*track, order], "left"))
    at = F.when(F.col("_leg").isNotNull(), F.struct(F.col(order).alias("f"), F.col("_leg").alias("leg"), F.col("_end").alias("end")))
    d = scan(d, track, order, last={"_on": at}, size=size)
    whole = d.where(F.col(order) < F.col("_on.end"))
    per = whole.groupBy(*track, F.col("_on.f").alias("start")).agg(F.max("_on.end").alias("end"), F.max("_on.leg").alias("leg"), F.avg(speed).alias("mean_speed"))
    kept = per.where(((F.col("end") - F.col("start")) / fps * 1000.0 >= min_ms) & (F.col("mean_speed") >= min_speed))
    cycles = running_sum(kept, track, "start", {"_k": F.lit(1).cast("long")}, size=size).withColumn("cycle", F.col("_k") - 1).drop("_k")
    cycles = cut_lineage(cycles)
    tag = cycles.select(*track, F.col("start").alias("_start"), "cycle", "mean_speed")
    marked = d.withColumn("_start", F.when(F.col(order) < F.col("_on.end"), F.col("_on.f"))).drop("_leg", "_end", "_on")
    return cycles, marked.join(tag, [*track, "_start"], "left").drop("_start")


def cycle_completeness(onsets: DataFrame, frames: DataFrame, cycle_keys: Sequence[str], track: Sequence[str], order: str, leg: str, n_legs: int, *, exactly_one: bool = False) -> DataFrame:
    """Liftoffs per leg and cycle: how many legs swing, and whether every leg does (or swings once)."""
    j = frames.where(F.col(cycle_keys[-1]).isNotNull()).select(*cycle_keys, order).join(onsets, [*track, order], "left")
    per = j.groupBy(*cycle_keys, leg).agg(F.count(leg).alias("_n"))
    good = (F.col("_n") == 1) if exactly_one else (F.col("_n") >= 1)
    hit = F.col(leg).isNotNull()
    return per.groupBy(*cycle_keys).agg(
        F.count_if(hit & (F.col("_n") >= 1)).alias("n_legs_swinging"), (F.count_if(hit & good) == n_legs).alias("complete")
    )


def cycle_table(
    frames: DataFrame, track: Sequence[str], order: str, cycle: str, *, speed: str, x: str, y: str, stance: str, joints: Sequence[str], phase: str,
    fps: float, min_frames: int = 8, size: int = BLOCK,
) -> DataFrame:
    """One row per step cycle: size, speed, duration, stride, loop area and length, duty, joint
    ranges and circular mean phase.  Only combinable sums, extremes and border values."""
    d = lag_lead(frames, track, order, leads={"_nc": cycle, "_nx": x, "_ny": y}, size=size).where(F.col(cycle).isNotNull())
    inside = F.col("_nc") == F.col(cycle)
    turn = F.when(inside, F.col(x) * F.col("_ny") - F.col("_nx") * F.col(y))
    step = F.when(inside, F.hypot(F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)))
    a = d.groupBy(*track, cycle).agg(
        F.count(F.lit(1)).alias("n"), F.max(speed).alias("speed"), F.sum(turn).alias("_turn"), F.sum(step).alias("loop_perimeter"),
        F.min_by(F.struct(x, y), order).alias("_a"), F.max_by(F.struct(x, y), order).alias("_b"), F.avg(F.col(stance).cast("double")).alias("duty"),
        *[(F.max(j) - F.min(j)).alias(f"rom_{j}") for j in joints],
        F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase))).alias("mean_phase"),
    ).where(F.col("n") >= min_frames)
    close = F.col("_b")[x] * F.col("_a")[y] - F.col("_a")[x] * F.col("_b")[y]
    dur = F.col("n") / fps * 1000.0
    return a.select(
        *track, cycle, "n", "speed", dur.alias("duration_ms"), (1000.0 / dur).alias("frequency_hz"), (F.col("speed") * dur / 1000.0).alias("stride"),
        (F.abs(F.coalesce("_turn", F.lit(0.0)) + close) / 2).alias("loop_area"), F.coalesce("loop_perimeter", F.lit(0.0)).alias("loop_perimeter"), "duty",
        *[f"rom_{j}" for j in joints], "mean_phase",
    )


def trim_tail(frames: DataFrame, cycles: DataFrame, trims: DataFrame, track: Sequence[str], order: str, cycle: str, stance: str) -> DataFrame:
    """Drop the last ``n_trim`` cycles of the listed tracks and end them on the last stance row.

    A track with no more cycles than that is left alone.  The bounds are one row per track.
    """
    last = cycles.groupBy(*track).agg(F.max(cycle).alias("_top"), F.count_distinct(cycle).alias("_nc")).join(trims, list(track))
    last = last.where(F.col("_nc") > F.col("n_trim")).select(*track, (F.col("_top") - F.col("n_trim")).alias("_keep_to"))
    d = attach(frames, last, track)
    inside = F.col("_keep_to").isNull() | F.coalesce(F.col(cycle) <= F.col("_keep_to"), F.lit(False))
    d = d.where(inside)
    foot = d.where(F.col("_keep_to").isNotNull()).groupBy(*track).agg(F.max(F.when(F.coalesce(F.col(stance), F.lit(False)), F.col(order))).alias("_end"))
    d = attach(d, foot, track)
    return d.where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_keep_to", "_end")


def episodes(df: DataFrame, track: Sequence[str], order: str, stance: str, z: str, clearance: str, *, fps: float, min_samples: int = 3, size: int = BLOCK) -> DataFrame:
    """One row per swing or stance run with its height range, clearance and flags."""
    t = run_table(
        df, track, order, stance, size=size,
        aggs={
            "z_min": F.min(z), "z_max": F.max(z), "clear_min": F.min(clearance), "clear_max": F.max(clearance),
            "abs_clear_min": F.min(F.abs(clearance)), "_k": F.count(z),
        },
    )
    t = t.where(F.col("_k") >= min_samples).drop("_k")
    return t.withColumn("kind", F.when(F.col(stance), "stance").otherwise("swing")).withColumn("dur_ms", F.col("n") / fps * 1000).withColumn(
        "amplitude", F.col("z_max") - F.col("z_min")
    )


def _turns(v: np.ndarray) -> np.ndarray:
    """Ends and turning points of a series; what lies between two of them only moves one way."""
    if len(v) < 3:
        return v
    v = v[np.append(True, v[1:] != v[:-1])]
    step = np.diff(v) > 0
    return v[np.concatenate([[True], step[1:] != step[:-1], [True]])] if len(v) > 2 else v


def _zigzag(values: Sequence[float], least: float, state: tuple[bool, float], n: int = 0) -> tuple[tuple[bool, float], int]:
    """Runs (rising, extreme so far) over the values; a peak counts once the series fell by ``least`` below it."""
    up, at = state
    for v in values:
        if up:
            if v > at:
                at = v
            elif at - v >= least:
                up, at, n = False, v, n + 1
        elif v < at:
            at = v
        elif v - at >= least:
            up, at = True, v
    return (up, at), n


def _skeleton(v: np.ndarray, least: float) -> tuple[list[float], int, bool, float, bool]:
    """What a stretch does to any state before it: a few values to run through, then, if ``fixed``, peaks and the state.

    After two swings of at least ``least`` inside the stretch, the state no longer depends on what came before.
    """
    v = _turns(v)
    low, high = np.minimum.accumulate(v), np.maximum.accumulate(v)
    wide = high - low >= least
    if not wide.any():
        i, j = sorted((int(v.argmin()), int(v.argmax())))
        return [float(v[i]), float(v[j])], 0, False, 0.0, False
    first = int(wide.argmax())
    head = v[:first]
    i, j = sorted((int(head.argmin()), int(head.argmax())))
    lead = [float(head[i]), float(head[j])]
    rest = v[first:] if v[first] > head.max() else -v[first:]
    sign = 1.0 if v[first] > head.max() else -1.0
    drop = np.maximum.accumulate(rest) - rest >= least
    if not drop.any():
        top = int(rest.argmax())
        return [*lead, sign * float(rest[top]), sign * float(rest[top:].min())], 0, False, 0.0, False
    second = int(drop.argmax())
    lead += [sign * float(rest[: second + 1].max()), sign * float(rest[second])]
    (up, at), n = _zigzag(v[first + second + 1 :].tolist(), least, (sign < 0, lead[-1]))
    return lead, n, up, at, True


def episode_peaks(df: DataFrame, track: Sequence[str], order: str, stance: str, z: str, *, fraction: float, floor: float, size: int = BLOCK) -> DataFrame:
    """Number of peaks of ``z`` in each swing and stance: ``(track, start, end, kind, n_peaks, double_peak)``.

    A peak is a maximum from which the series falls, on both sides and before a higher one, by at least
    ``fraction`` of the episode's height range and ``floor``; equal maxima without such a fall between them count once. Missing values
    stand at the episode's lowest. An episode is read block by block: each block is reduced to the few values that matter
    for what came before and what it does after them, and the reduced blocks are joined in order.
    """
    if floor <= 0:
        raise ValueError("the floor must be above 0")
    d = label_runs(df.select(*track, order, F.col(stance).alias("_s"), F.col(z).cast("double").alias("_z")), track, order, "_s", size=size)
    d = cut_lineage(d.select(*track, "run", order, "_s", "_z"))
    keys = [*track, "run"]
    ep = d.groupBy(*keys).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.max("_s").alias("_s"), F.min("_z").alias("_lo"), (F.max("_z") - F.min("_z")).alias("_amp")).where("_lo is not null")
    ep = cut_lineage(ep.withColumn("_least", F.greatest(F.col("_amp") * fraction, F.lit(float(floor)))))
    rows = spread(d, keys, order, ep.select(*keys, "_lo", "_least"), size=size).where("_least is not null")
    rows = rows.select(*keys, block_of(order, size).alias("_blk"), order, F.coalesce("_z", "_lo").alias("_z"), "_least")

    def reduce(g: Rows) -> Rows:
        lead, n, up, at, fixed = _skeleton(g["_z"], float(g["_least"][0]))
        values = np.empty(1, object)
        values[0] = np.array(lead)
        return {"_lead": values, "_n": np.array([n]), "_up": np.array([up]), "_at": np.array([at]), "_fixed": np.array([fixed]), "_least": g["_least"][:1]}

    def join(g: Rows) -> Rows:
        state, n = (False, float(g["_lead"][0][0])), 0
        for lead, more, up, at, fixed, least in zip(g["_lead"], g["_n"], g["_up"], g["_at"], g["_fixed"], g["_least"], strict=True):
            state, n = _zigzag(list(lead), float(least), state, n)
            if fixed:
                state, n = (bool(up), float(at)), n + int(more)
        return {"n_peaks": np.array([n])}

    fields = [f for f in rows.schema.fields if f.name in keys]
    part = T.StructType([*fields, T.StructField("_blk", T.LongType()), T.StructField("_lead", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType()), T.StructField("_up", T.BooleanType()), T.StructField("_at", T.DoubleType()), T.StructField("_fixed", T.BooleanType()), T.StructField("_least", T.DoubleType())])
    parts = by_group(rows, [*keys, "_blk"], order, part, reduce)
    counts = by_group(parts, keys, "_blk", T.StructType([*fields, T.StructField("n_peaks", T.LongType())]), join)
    kind = F.when(F.col("_s"), "stance").otherwise("swing")
    return ep.join(counts, keys).select(*track, "start", "end", kind.alias("kind"), "n_peaks", (~F.col("_s") & (F.col("n_peaks") >= 2)).alias("double_peak"))


def flag_episodes(ep: DataFrame, *, contact_tol: float, min_stance_ms: float) -> DataFrame:
    st = F.col("kind") == "stance"
    return ep.withColumn("no_contact", st & F.coalesce(F.col("clear_min") > contact_tol, F.lit(False))).withColumn("too_short", st & (F.col("dur_ms") < min_stance_ms))


def double_swings(ep: DataFrame, track: Sequence[str], *, size: int = BLOCK) -> DataFrame:
    """Swing, unreal stance, swing: the foot never really came down in between."""
    d = running_sum(ep, track, "start", {"_i": F.lit(1).cast("long")}, size=size)
    d = lag_lead(cut_lineage(d), track, "_i", lags={"_pk": "kind", "_ps": "start"}, leads={"_nk": "kind", "_ne": "end"}, size=size)
    hit = (F.col("kind") == "stance") & (F.col("no_contact") | F.col("too_short")) & (F.col("_pk") == "swing") & (F.col("_nk") == "swing")
    return d.where(hit).select(
        *track, F.col("_ps").alias("start"), F.col("_ne").alias("end"), F.col("dur_ms").alias("gap_ms"), F.when(F.col("too_short"), "short").otherwise("no contact").alias("reason")
    )


def _flip_runs(d: DataFrame, track: Sequence[str], order: str, flag: str, aggs: dict, flip, *, size: int) -> DataFrame:
    lab = cut_lineage(label_runs(d, track, order, flag, size=size))
    info = lab.groupBy(*track, "run").agg(F.max(flag).alias("_on"), F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in aggs.items()])
    info = info.select(*track, "run", F.when(F.coalesce(flip, F.lit(False)), ~F.col("_on")).otherwise(F.col("_on")).alias("_new"))
    return lab.join(info, [*track, "run"]).withColumn(flag, F.col("_new")).drop("run", "_new")


def correct_contact(df: DataFrame, track: Sequence[str], order: str, contact: str, clearance: str, *, lift: float, band: float, passes: int = 3, size: int = BLOCK) -> DataFrame:
    """Flip swings that never lift, then stances that never land, ``passes`` times.

    Passes after the labels stop changing do nothing, so running all of them is exact.
    """
    d = df
    for _ in range(passes):
        d = _flip_runs(d, track, order, contact, {"_m": F.max(clearance)}, ~F.col("_on") & (F.col("_m") < lift), size=size)
        d = _flip_runs(d, track, order, contact, {"_m": F.min(F.abs(clearance))}, F.col("_on") & (F.col("_m") > band), size=size)
    return d


def surface_contact(df: DataFrame, track: Sequence[str], order: str, dist: str, speed: str, *, contact: float, split: float, lift: float, min_len: int, name: str, size: int = BLOCK) -> DataFrame:
    """Stance from surface distance, refused where the run is fast, filled where the foot never
    lifts, and dropped where the run is too short."""
    d = df.withColumn(name, F.coalesce(F.col(dist) <= contact, F.lit(False)))
    lab = cut_lineage(label_runs(d, track, order, name, size=size))
    med = exact_median(lab.where(F.col(name)), [*track, "run"], speed, "_med")
    d = lab.join(med, [*track, "run"], "left").withColumn(name, F.col(name) & ~F.coalesce(F.col("_med") > split, F.lit(False))).drop("run", "_med")
    d = _flip_runs(d, track, order, name, {"_m": F.max(dist)}, ~F.col("_on") & (F.col("_m") < lift), size=size)
    return _flip_runs(d, track, order, name, {"_m": F.lit(0)}, F.col("_on") & (F.col("_n") < min_len), size=size)


def contact_quality(frames: DataFrame, keys: Sequence[str], leg: str, stance: str, front: Sequence, hind: Sequence) -> DataFrame:
    """Duty and the share of frames with no front leg, no hind leg or fewer than three legs down."""
    on = F.coalesce(F.col(stance), F.lit(False))
    per = frames.groupBy(*keys).agg(
        F.count_if(on).alias("_on"), F.count(F.lit(1)).alias("_all"), F.count_if(on & F.col(leg).isin(*front)).alias("_f"), F.count_if(on & F.col(leg).isin(*hind)).alias("_h")
    )
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return per.agg(
        (F.sum("_on") / F.sum("_all")).alias("duty"), share(F.col("_f") == 0).alias("no_front"), share(F.col("_h") == 0).alias("no_hind"), share(F.col("_on") < 3).alias("under_three")
    )


def episode_quality(ep: DataFrame, *, lift: float, band: float, min_swing: int = 3) -> DataFrame:
    """Swings that lift and stances that touch, with the median swing duration."""
    sw = ep.where((F.col("kind") == "swing") & (F.col("n") >= min_swing))
    a = sw.agg(F.count(F.lit(1)).alias("n_swings"), F.avg(F.when(F.col("clear_max") >= lift, 1.0).otherwise(0.0)).alias("lifting"))
    b = ep.where(F.col("kind") == "stance").agg(F.count(F.lit(1)).alias("n_stances"), F.avg(F.when(F.col("abs_clear_min") <= band, 1.0).otherwise(0.0)).alias("touching"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(exact_quantiles(sw, [], "dur_ms", {"median_swing_ms": 0.5})))


def stance_edges(df: DataFrame, track: Sequence[str], order: str, stance: str, z: str, *, rule: str, percentile: float = 0.5, size: int = BLOCK) -> DataFrame:
    """Stance refined by height: ``first_minimum`` moves each onset to the first dip of the
    descent, ``threshold`` widens both edges while the foot is at its typical stance height.

    Swing and stance runs alternate, so each rule only looks at a stance run and its two
    neighbours; all of it is group keys and running extremes inside a run.
    """
    lab = cut_lineage(label_runs(df.withColumn("_on", F.coalesce(F.col(stance), F.lit(False))), track, order, "_on", size=size))
    if rule == "threshold":
        return _widen(lab, track, order, z, percentile, stance)
    return _first_minimum(lab, track, order, z, stance, size)


def _widen(lab: DataFrame, track: Sequence[str], order: str, z: str, percentile: float, stance: str) -> DataFrame:
    thr = exact_quantiles(lab.where("_on"), [*track, "run"], z, {"_thr": percentile})
    ends = lab.where("_on").groupBy(*track, "run").agg(F.min(order).alias("_s"), F.max_by(z, order).alias("_zl"), F.min_by(z, order).alias("_zs"))
    st = cut_lineage(thr.join(ends, [*track, "run"]))
    swing = lab.where(~F.col("_on"))
    after = st.select(*track, (F.col("run") - 1).alias("run"), F.col("_thr").alias("_ta"), F.col("_s").alias("_sa"), F.col("_zs").alias("_za"))
    before = st.select(*track, (F.col("run") + 1).alias("run"), F.col("_thr").alias("_tb"))
    # First row of the highest z; a following stance start that is higher still wins.
    apex = swing.groupBy(*track, "run").agg(F.min(F.struct(-F.col(z), F.col(order).alias("f")))["f"].alias("_apex"), F.max(z).alias("_zmax"))
    j = swing.join(apex, [*track, "run"]).join(after, [*track, "run"], "left").join(before, [*track, "run"], "left")
    down_from = F.when(F.col("_za") > F.col("_zmax"), F.col("_sa")).otherwise(F.col("_apex"))
    edge = j.groupBy(*track, "run").agg(
        F.min(F.when((F.col(order) >= down_from) & (F.col(z) <= F.col("_ta")), F.col(order))).alias("_new_s"),
        F.min(F.when((F.col(order) <= F.col("_apex")) & (F.col(z) > F.col("_tb")), F.col(order))).alias("_new_e"),
        F.min(order).alias("_first"), F.max("_apex").alias("_ap"), F.count("_tb").alias("_has_b"),
    )
    d = lab.join(edge.select(*track, "run", "_new_s", "_new_e", "_first", "_ap", "_has_b"), [*track, "run"], "left")
    early = F.coalesce(F.col(order) >= F.col("_new_s"), F.lit(False))
    late = (F.col("_has_b") > 0) & (F.col("_ap") > F.col("_first")) & F.coalesce(F.col(order) < F.col("_new_e"), F.lit(False))
    out = F.when(F.col(stance).isNotNull(), F.col("_on") | early | late)
    return d.withColumn("refined", out).drop("_on", "run", "_new_s", "_new_e", "_first", "_ap", "_has_b")


def _first_minimum(lab: DataFrame, track: Sequence[str], order: str, z: str, stance: str, size: int) -> DataFrame:
    # A unit is a stance run with the swing before it.
    unit = F.when(F.col("_on"), F.col("run")).otherwise(F.col("run") + 1)
    d = lag_lead(lab.withColumn("_unit", unit), track, order, lags={"_zp": z}, leads={"_zn": z}, size=size)
    g = [*track, "_unit"]
    start = d.groupBy(*g).agg(F.min(F.when(F.col("_on"), F.col(order))).alias("_s"), F.max(F.when(F.col("_on"), F.col(order))).alias("_b"))
    d = cut_lineage(d.join(start, g))
    apex = d.where(F.col(order) <= F.col("_s")).groupBy(*g).agg(F.min(F.struct(-F.col(z), F.col(order).alias("f")))["f"].alias("_a"))
    d = d.join(apex, g, "left")
    seg = F.col(order).between(F.col("_a"), F.col("_b"))
    dip = (F.col(order) > F.col("_a")) & (F.col(order) < F.col("_b")) & (F.col(z) < F.col("_zp")) & (F.col(z) <= F.col("_zn"))
    new = d.where(seg).groupBy(*g).agg(
        F.min(F.when(dip, F.col(order))).alias("_dip"), F.min(F.struct(F.col(z).alias("z"), F.col(order).alias("f")))["f"].alias("_low"),
        (F.max("_b") - F.max("_a") >= 2).alias("_long"),
    )
    d = d.join(new.select(*g, "_long", F.coalesce("_dip", "_low").alias("_new")), g, "left")
    moved = F.coalesce(F.col("_long"), F.lit(False))
    out = F.when(moved, F.col(order).between(F.col("_new"), F.col("_b"))).otherwise(F.col("_on"))
    return d.withColumn("refined", F.when(F.col(stance).isNotNull(), out)).drop("_on", "run", "_unit", "_zp", "_zn", "_s", "_b", "_a", "_long", "_new")


def bout_summary(frames: DataFrame, bout: Sequence[str], order: str, *, speed: str, height: str, edge: int = 20, min_frames: int = 40) -> DataFrame:
    """Frame range, median speed and the height change between the first and last ``edge`` rows."""
    span = frames.groupBy(*bout).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    d = attach(frames, span, bout)
    rise = d.groupBy(*bout).agg(
        (F.avg(F.when(F.col(order) > F.col("last") - edge, F.col(height))) - F.avg(F.when(F.col(order) < F.col("first") + edge, F.col(height)))).alias("_rise"),
        (F.max(height) - F.min(height)).alias("height_range"),
    )
    med = exact_quantiles(frames, bout, speed, {"speed_median": 0.5, "speed_p10": 0.1, "speed_p90": 0.9})
    return span.join(rise, list(bout)).join(med, list(bout)).withColumn("rise", F.when(F.col("n") > min_frames, F.col("_rise"))).drop("_rise")


def register_surface(points: DataFrame, stairs: Stairs, x: str, z: str, *, step: float) -> DataFrame:
    """Offset ``x0, z0`` of a periodic surface with the smallest median residual.

    Every grid offset needs two medians over all points; the levels under a point are
    constant within a tread, so the points are first collapsed to (tread position, z)
    counts and each offset reads those counts.
    """
    n = int(round(stairs.period / step))
    offs = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    base = cut_lineage(points.groupBy(F.col(x).alias("_x"), F.col(z).alias("_z")).agg(F.count(F.lit(1)).alias("_w")))
    g = base.select("_x", "_z", "_w", offs).withColumn("_x0", F.col("_k") * step)
    level = stairs.level(F.col("_x") - F.col("_x0") + stairs.x0)
    g = g.select("_k", "_w", (F.col("_z") - stairs.step * level).alias("_d"))
    med = exact_quantiles(g, ["_k"], "_d", {"z0": 0.5}, weight=F.col("_w"))
    res = attach(g, med, ["_k"]).withColumn("_r", F.abs(F.col("_d") - F.col("z0")))
    rmed = exact_quantiles(res, ["_k"], "_r", {"residual": 0.5}, weight=F.col("_w"))
    best = rmed.join(med, "_k").agg(F.min(F.struct("residual", "_k", "z0")).alias("b"))
    return best.select((F.col("b._k") * step).alias("x0"), F.col("b.z0").alias("z0"), F.col("b.residual").alias("residual"))
