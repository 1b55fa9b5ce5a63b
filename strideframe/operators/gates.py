"""Frame, pair, bout and recording gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import BLOCK, lag_lead
from strideframe.operators.quantiles import attach, exact_quantiles
from strideframe.operators.runs import dilate

# Gate thresholds.
EXIST_MIN = 0.5
MIN_CAMS = 3
SEP_MIN_PX = 15.0
WING_ANGLE_MIN = 30.0
PROXIMITY_MAX = 30.0
MALE_SLOT = 1
COLLAPSE_FRACTION = 0.2


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def apply_gates(
    coarse: DataFrame, frame_keys: Sequence[str], *, num_animals: int, wing_angle_min: float = WING_ANGLE_MIN, proximity_max: float = PROXIMITY_MAX,
    exist_min: float = EXIST_MIN, min_cams: int = MIN_CAMS, sep_min_px: float = SEP_MIN_PX, male_slot: int = MALE_SLOT,
) -> DataFrame:
    """``in_bout`` per frame from per-animal signals; a missing signal never passes.

    Two animals: both trackable, separated in the image, and the male's wing out or the two
    close.  One animal: trackability alone.
    """
    trackable = _yes((F.col("exist") >= exist_min) & (F.col("n_valid_cams") >= min_cams))
    ok = F.bool_and(trackable) & (F.count(F.lit(1)) >= num_animals)
    if num_animals >= 2:
        wing = _yes(F.max(F.when(F.col("fly") == male_slot, F.col("wing_angle_deg"))) >= wing_angle_min)
        near = _yes(F.max("sep3d") <= proximity_max)
        ok = ok & _yes(F.max("sep2d_med") >= sep_min_px) & (wing | near)
    return coarse.groupBy(*frame_keys).agg(ok.alias("in_bout"))


def pair_validity(
    pairs: DataFrame, bout: Sequence[str], frame: str, *, epsilon: float, percentile: float = 0.05, guard: int = 5, min_separation: float = 0.0,
    size: int = BLOCK,
) -> DataFrame:
    """Validity of each animal of a pair per frame and the two-bit ``pair_state``.

    Needs ``finite0/1`` (critical landmarks present), ``ground_z0/1`` (lowest ground
    landmark), ``swap`` (identity relink state) and ``separation``.
    """
    floors = exact_quantiles(pairs, bout, "ground_z0", {"floor0": percentile}).join(exact_quantiles(pairs, bout, "ground_z1", {"floor1": percentile}), list(bout))
    d = lag_lead(pairs, bout, frame, lags={"_ps": "swap"}, size=size)
    d = d.withColumn("_toggle", _yes(F.col("swap") != F.col("_ps")))
    d = dilate(d, bout, frame, "_toggle", guard, name="_unsure", size=size)
    d = attach(d, floors, bout)
    apart = ~_yes(F.col("separation") < min_separation) if min_separation > 0 else F.lit(True)
    for i in "01":
        grounded = _yes(F.col(f"ground_z{i}") <= F.col(f"floor{i}") + epsilon)
        d = d.withColumn(f"valid{i}", _yes(F.col(f"finite{i}")) & grounded & ~F.col("_unsure") & apart)
    state = F.col("valid0").cast("int") + 2 * F.col("valid1").cast("int")
    return d.withColumn("pair_state", state).drop("_ps", "_toggle", "_unsure")


def classify_bouts(pairs: DataFrame, bout: Sequence[str], *, min_paired: int = 30, min_solo: int = 30) -> DataFrame:
    """``paired``, ``mixed``, ``fly0_only``, ``fly1_only`` or ``empty`` from valid frame counts."""
    c = pairs.groupBy(*bout).agg(
        F.count_if(F.col("valid0") & F.col("valid1")).alias("n_both"), F.count_if("valid0").alias("n_fly0"), F.count_if("valid1").alias("n_fly1")
    )
    paired = F.col("n_both") >= min_paired
    one0, one1 = F.col("n_fly0") >= min_solo, F.col("n_fly1") >= min_solo
    solo_left = (F.col("n_fly0") - F.col("n_both") >= min_solo) | (F.col("n_fly1") - F.col("n_both") >= min_solo)
    cls = (
        F.when(paired & solo_left, "mixed").when(paired, "paired").when(one0 & one1, "mixed").when(one0, "fly0_only").when(one1, "fly1_only").otherwise("empty")
    )
    return c.withColumn("bout_class", cls)


def outside_arena(kps: DataFrame, recording: Sequence[str], frame: str) -> DataFrame:
    """Frames with a landmark outside the recording's p1-p99 of y or above its p99 of z."""
    env = exact_quantiles(kps, recording, "y", {"y_lo": 0.01, "y_hi": 0.99}).join(exact_quantiles(kps, recording, "z", {"z_hi": 0.99}), list(recording))
    out = (F.col("y") < F.col("y_lo")) | (F.col("y") > F.col("y_hi")) | (F.col("z") > F.col("z_hi"))
    return attach(kps, env, recording).groupBy(*recording, frame).agg(F.bool_or(_yes(out)).alias("outside"))


def structural_findings(lengths: DataFrame, bout: Sequence[str], *, collapse: float = COLLAPSE_FRACTION) -> DataFrame:
    """Segments that are missing throughout or far shorter than the bout's typical segment."""
    named = lengths.withColumn("segment", F.concat_ws("--", "a", "b"))
    med = exact_quantiles(named, [*bout, "segment"], "length", {"med": 0.5})
    every = named.select(*bout, "segment").distinct().join(med, [*bout, "segment"], "left")
    # A bout has as many rows here as it has segments.
    ref = every.where(F.col("med") > 0).groupBy(*bout).agg(F.median("med").alias("ref"))
    code = F.when(F.col("med").isNull(), "missing").when(F.col("med") < collapse * F.col("ref"), "collapsed")
    return every.join(ref, list(bout), "left").withColumn("code", code).where(F.col("code").isNotNull()).select(*bout, "segment", "code")


def rename_invariant_findings(before: DataFrame, after: DataFrame, keys: Sequence[str], *, tolerance: float = 1e-4) -> DataFrame:
    """Frames whose rigid pair distance changed although only names were permuted."""
    j = before.select(*keys, F.col("length").alias("_a")).join(after.select(*keys, F.col("length").alias("_b")), list(keys))
    return j.where(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) > tolerance).select(*keys)


def exclusion_reason(has_outputs: str, n_solved: str, any_bridge: str, costs_finite: str) -> Column:
    """First reason that keeps a bout out of a dataset, null when it may enter."""
    return (
        F.when(~_yes(F.col(has_outputs)), "no_outputs_h5")
        .when(F.coalesce(F.col(n_solved), F.lit(0)) == 0, "no_solved_frames")
        .when(~_yes(F.col(any_bridge)), "no_bridge")
        .when(~F.coalesce(F.col(costs_finite), F.lit(True)), "nan_cost")
    )


def song_pair_filter(
    df: DataFrame, pair: Sequence[str], side: str, frame: str, z: str, *, fps: float, min_frames: int = 100, min_p95: float = 12.0, size: int = BLOCK
) -> DataFrame:
    """One row per pair with the p95 of the faster wing's speed and why it is dropped, if it is."""
    d = lag_lead(df, [*pair, side], frame, lags={"_p": z}, size=size)
    d = d.withColumn("_dz", F.abs(F.col(z) - F.coalesce(F.col("_p"), F.col(z))) * fps)
    both = d.groupBy(*pair, frame).agg(F.max("_dz").alias("_dz"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == 2)
    s = exact_quantiles(both, pair, "_dz", {"p95": 0.95}, n="n")
    return s.withColumn("dropped", F.when(F.col("n") < min_frames, "short").when(F.col("p95") < min_p95, "quiet"))


def shared_support(df: DataFrame, group: str, value: str, *, how: str = "common", fixed: tuple[float, float] | None = None) -> DataFrame:
    """Rows inside the value range every group covers: full range, p1-p99, or a fixed window."""
    if how == "fixed":
        return df.where(F.col(value).between(*fixed))
    if how == "common":
        per = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    else:
        per = exact_quantiles(df, [group], value, {"_lo": 0.01, "_hi": 0.99})
    span = per.agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    return attach(df, span, []).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
