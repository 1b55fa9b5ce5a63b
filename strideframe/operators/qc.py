"""Quality-control reports over landmark tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators.filters import valid
from strideframe.operators.geometry import project, rig_keys
from strideframe.operators.ordered import BLOCK
from strideframe.operators.quantiles import attach, distinct_values, exact_median, exact_quantiles, rank_values
from strideframe.operators.runs import gap_report
from strideframe.session import cut_lineage

# Report thresholds.
OBSERVED_CONF = 0.3
COLLAPSE_FRACTION = 0.2
PITCH_DEG = 45.0
RESIDUAL_MULT = 3.0
SPARSE_MISSING = 0.5


def view_confidence(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median confidence of a view's landmarks (one row per landmark, so the group is small)."""
    return obs.groupBy(*keys, "camera").agg(F.median("conf").alias("median_conf"))


def reprojection_errors(points: DataFrame, obs: DataFrame, cameras: DataFrame, keys: Sequence[str], *, conf_thresh: float = 0.3) -> DataFrame:
    """Pixel error of every confident observation of a landmark."""
    rig = [c for c in rig_keys(points, cameras) if c not in keys]
    at = [*keys, *rig]
    seen = obs.where(F.col("conf") >= conf_thresh).select(*at, "camera", F.col("u").alias("ou"), F.col("v").alias("ov"))
    j = project(points.where(valid()).select(*at, "x", "y", "z"), cameras).join(seen, [*at, "camera"])
    return j.select(*keys, "camera", F.hypot(F.col("u") - F.col("ou"), F.col("v") - F.col("ov")).alias("err")).where(F.col("err").isNotNull())


def reprojection_report(errors: DataFrame, frame_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Medians per camera and over all (``all``), and medians per frame (a frame is small)."""
    errors = cut_lineage(errors)
    per = exact_quantiles(errors, ["camera"], "err", {"median_px": 0.5}, n="n")
    total = exact_quantiles(errors, [], "err", {"median_px": 0.5}, n="n").withColumn("camera", F.lit("all"))
    return per.unionByName(total), errors.groupBy(*frame_keys).agg(F.median("err").alias("median_px"))


def fit_ratio(fitted: DataFrame, measured: DataFrame, frame_keys: Sequence[str], track: Sequence[str] = ()) -> DataFrame:
    """Fitted against measured median error over the frames where both exist, in all or for each track."""
    f = fitted.join(measured.select(*frame_keys).distinct(), list(frame_keys), "left_semi")
    m = measured.join(fitted.select(*frame_keys).distinct(), list(frame_keys), "left_semi")
    a = exact_quantiles(f, track, "err", {"fitted_px": 0.5}, n="n_fitted")
    b = exact_quantiles(m, track, "err", {"measured_px": 0.5}, n="n_measured")
    px = F.col("measured_px")
    both = a.join(b, list(track)) if track else a.crossJoin(F.broadcast(b))
    return both.select(*track, "fitted_px", "measured_px", (F.col("fitted_px") / F.when(px > 0, px)).alias("ratio"), F.least("n_fitted", "n_measured").alias("n"))


def coverage_report(kps: DataFrame, track: Sequence[str], frame: str, *, conf_thresh: float = OBSERVED_CONF, size: int = BLOCK) -> DataFrame:
    """Missing fraction, gap-run statistics and the worst landmark (lowest ``pos`` on ties) per track."""
    seen = F.coalesce(F.col("conf") >= conf_thresh, F.lit(False)) & valid()
    d = cut_lineage(kps.select(*track, frame, "kp", "pos", seen.alias("seen")))
    per_kp = d.groupBy(*track, "kp", "pos").agg(F.count_if(~F.col("seen")).alias("_miss"), F.count(F.lit(1)).alias("_n"))
    frac = F.col("_miss") / F.col("_n")
    whole = per_kp.groupBy(*track).agg(
        (F.sum("_miss") / F.sum("_n")).alias("missing_fraction"),
        F.max("_n").alias("n_frames"),
        F.max_by("kp", F.struct(frac, -F.col("pos"))).alias("_worst"),
        F.max(frac).alias("_top"),
    )
    gaps = cut_lineage(gap_report(d, [*track, "kp"], frame, "seen", size=size))
    runs = gaps.groupBy(*track).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("n").alias("max_gap"))
    med = exact_median(gaps, track, "n", "median_gap")
    out = whole.join(runs, list(track), "left").join(med, list(track), "left")
    return out.select(
        *track, "missing_fraction", "n_frames", F.when(F.col("_top") > 0, F.col("_worst")).alias("worst_keypoint"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gaps", "max_gap")], F.coalesce("median_gap", F.lit(0.0)).alias("median_gap"),
    )


def invariant_report(lengths: DataFrame, track: Sequence[str]) -> DataFrame:
    """Median, spread and collapse flag of every segment of a track."""
    d = cut_lineage(lengths.select(*track, "a", "b", "length"))
    med = exact_quantiles(d, [*track, "a", "b"], "length", {"median": 0.5}, n="n")
    cv = d.groupBy(*track, "a", "b").agg((F.stddev_pop("length") / F.when(F.avg("length") > 0, F.avg("length"))).alias("cv"))
    seg = cut_lineage(med.join(cv, [*track, "a", "b"]))
    # One row per segment of the skeleton: the second median is over a small group.
    ref = seg.where(F.col("median") > 0).groupBy(*track).agg(F.median("median").alias("_ref"))
    return seg.join(ref, list(track), "left").withColumn("collapsed", F.coalesce(F.col("median") < COLLAPSE_FRACTION * F.col("_ref"), F.lit(False))).drop("_ref")


def posture_report(frames: DataFrame, track: Sequence[str]) -> DataFrame:
    """Pitch and height distribution per track and the number of pitched frames that also misfit.

    ``frames`` has ``pitch``, ``height`` and ``residual`` per frame.
    """
    f = cut_lineage(frames)
    p = exact_quantiles(f, track, "pitch", {"pitch_median": 0.5, "pitch_p95": 0.95, "pitch_max": 1.0})
    h = exact_quantiles(f, track, "height", {"height_median": 0.5, "height_p95": 0.95, "height_max": 1.0})
    flags = posture_flags(f, track)
    n = flags.groupBy(*track).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("pitched").alias("n_pitched"), F.count_if("flagged").alias("n_flagged"))
    return n.join(p, list(track), "left").join(h, list(track), "left")


def posture_flags(frames: DataFrame, track: Sequence[str]) -> DataFrame:
    """Per frame: ``pitched``, and ``flagged`` when the residual is also far above the track's median."""
    base = exact_quantiles(frames, track, "residual", {"_base": 0.5})
    d = attach(frames, base, track)
    pitched = F.coalesce(F.col("pitch") > PITCH_DEG, F.lit(False))
    misfit = F.coalesce(F.col("residual") > RESIDUAL_MULT * F.col("_base"), F.lit(False))
    return d.withColumn("pitched", pitched).withColumn("flagged", pitched & misfit).drop("_base")


def axis_pitch(post: V.Vec, ante: V.Vec, up: V.Vec) -> Column:
    return V.elevation_deg(V.sub(ante, post), up)


def status_text(excluded: Column, has_qc: Column, missing: Column) -> Column:
    """``ok`` or the joined reasons a row is not: excluded, not fitted, sparse."""
    notes = F.concat_ws(
        ";",
        F.when(excluded.isNotNull(), F.concat(F.lit("excluded:"), excluded)),
        F.when(~has_qc, F.lit("not_fit:no qc.json (ik produced no solve)")),
        F.when(has_qc & (missing >= SPARSE_MISSING), F.concat(F.lit("sparse:"), F.format_string("%.0f", F.rint(missing * 100)), F.lit("% missing"))),
    )
    return F.when(notes == "", F.lit("ok")).otherwise(notes)


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The value at rank ``n // 2`` of the sorted group (no interpolation)."""
    ranked, _ = rank_values(distinct_values(df, keys, value), keys)
    rank = F.floor(F.col("_n") / 2)
    hit = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
    return ranked.groupBy(*keys).agg(F.max(F.when(hit, F.col("_v"))).alias(name), F.max("_n").alias("n_median_over"))


def scorecard_by_sex(rows: DataFrame) -> DataFrame:
    """Row counts per sex and the upper median reprojection ratio over ``ok`` rows."""
    counts = rows.groupBy("sex").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("reproj_ratio").alias("n_scored"),
        F.count_if(F.col("status").contains("sparse")).alias("n_sparse"),
        F.count_if(F.col("status").contains("not_fit")).alias("n_not_fit"),
        F.coalesce(F.sum("n_flagged"), F.lit(0)).alias("n_flagged"),
    )
    med = upper_median(rows.where(F.col("status") == "ok"), ["sex"], "reproj_ratio", "median_reproj_ratio")
    return counts.join(med, "sex", "left").withColumn("n_median_over", F.coalesce("n_median_over", F.lit(0)))


def dataset_counts(clips: DataFrame, excluded: DataFrame) -> DataFrame:
    a = clips.agg(F.count(F.lit(1)).alias("n_clips"), F.count_if(F.col("sex") == "male").alias("n_male"), F.count_if(F.col("sex") == "female").alias("n_female"))
    return a.crossJoin(F.broadcast(excluded.agg(F.count(F.lit(1)).alias("n_excluded")))).withColumn("n_unknown", F.col("n_clips") - F.col("n_male") - F.col("n_female"))


def pool_findings(headers: DataFrame) -> DataFrame:
    """Reasons why runs cannot be pooled: missing output, several rates or anatomies, repeated ids."""
    miss = headers.where(F.col("missing")).select(F.lit("missing_output").alias("code"), F.col("fly_id").alias("detail"))
    have = headers.where(~F.col("missing"))
    out = miss
    for col, code in (("source_hz", "rate_differs"), ("anatomy", "anatomy_differs")):
        vals = have.select(F.col(col).cast("string").alias("detail")).distinct()
        many = vals.agg(F.count(F.lit(1)).alias("_k"))
        out = out.unionByName(vals.crossJoin(F.broadcast(many)).where(F.col("_k") > 1).select(F.lit(code).alias("code"), "detail"))
    dup = have.groupBy("fly_id").count().where(F.col("count") > 1).select(F.lit("duplicate_id").alias("code"), F.col("fly_id").alias("detail"))
    return out.unionByName(dup)


def rigidity_change(raw: DataFrame, filtered: DataFrame, track: Sequence[str], frame: str) -> DataFrame:
    """Segment spread before and after filtering, with the number of frames whose length changed."""
    keys = [*track, "a", "b"]
    j = raw.select(*keys, frame, F.col("length").alias("_r")).join(filtered.select(*keys, frame, F.col("length").alias("_f")), [*keys, frame], "full")
    cv = lambda c: F.stddev_pop(c) / F.when(F.avg(c) > 0, F.avg(c))
    changed = ~F.col("_r").eqNullSafe(F.col("_f"))
    return j.groupBy(*keys).agg(cv("_r").alias("cv_raw"), cv("_f").alias("cv_filtered"), F.count_if(changed).alias("n_altered"), F.count(F.lit(1)).alias("n"))


def parity_report(run_a: DataFrame, run_b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Median distance of two runs' landmarks, grouped by ``by``; rows of one run only are counted."""
    pa = run_a.where(valid()).select(*keys, F.struct("x", "y", "z").alias("_a"))
    pb = run_b.where(valid()).select(*keys, F.struct("x", "y", "z").alias("_b"))
    j = cut_lineage(pa.join(pb, list(keys), "full").withColumn("_d", V.distance(V.vec("_a"), V.vec("_b"))))
    one = j.groupBy(*by).agg(F.count_if(F.col("_d").isNull()).alias("n_one_sided"), F.max("_d").alias("max_diff"))
    return one.join(exact_median(j, by, "_d", "median_diff"), list(by), "left")


def worst(df: DataFrame, value: str, tie: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows with the largest value, ties by name."""
    return df.orderBy(F.col(value).desc_nulls_last(), *tie).limit(k)


def _invariant_block(seg: DataFrame, track: Sequence[str]) -> DataFrame:
    """The segments of a track in one row; a skeleton bounds their number."""
    name = F.concat_ws("-", "a", "b")
    return seg.groupBy(*track).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("collapsed").alias("n_collapsed"), F.max("cv").alias("max_cv"), F.max_by(name, F.struct("cv", name)).alias("loosest"),
        F.array_sort(F.collect_list(F.when(F.col("collapsed"), name))).alias("collapsed"),
        F.array_sort(F.collect_list(F.struct("a", "b", "median", "n", "cv"))).alias("segments"),
    )


def _loo_block(errors: DataFrame, track: Sequence[str]) -> DataFrame:
    """Held-out error of a track and of each of its cameras; a rig bounds their number."""
    e = cut_lineage(errors.select(*track, "camera", "err"))
    per = exact_quantiles(e, [*track, "camera"], "err", {"median_px": 0.5}, n="n")
    cams = per.groupBy(*track).agg(F.array_sort(F.collect_list(F.struct("camera", "median_px", "n"))).alias("cameras"))
    return exact_quantiles(e, track, "err", {"median_px": 0.5}, n="n").join(cams, list(track))


def qc_documents(
    kps: DataFrame, fitted: DataFrame, lengths: DataFrame, posture: DataFrame, track: Sequence[str], frame: str, *,
    fitted_errors: DataFrame | None = None, measured_errors: DataFrame | None = None, held_out: DataFrame | None = None, conf_thresh: float = OBSERVED_CONF, size: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """All reports of a track in one document, and the tracks refused one with the reason.

    ``kps`` and ``lengths`` are measured landmarks and segment lengths, ``fitted`` the fitted landmarks,
    ``posture`` their pitch and height per frame. Pixel errors (fitted, measured, held out) exist for tracks
    with calibrated cameras only; another track has no ``reproj`` and no ``loo`` block and no residual, so
    none of its frames is flagged.

    A track without a fitted pose (``no_pose``) or with a collapsed segment (``collapsed:a-b,...``) is
    refused: a collapsed pair moves less than a real one, so every other measure would praise it.
    """
    invariants = cut_lineage(_invariant_block(invariant_report(lengths, track), track))
    posed = fitted.where(valid()).select(*track).distinct()
    state = kps.select(*track).distinct().join(posed.withColumn("_posed", F.lit(True)), list(track), "left").join(invariants.select(*track, "collapsed"), list(track), "left")
    broken = F.concat(F.lit("collapsed:"), F.array_join("collapsed", ","))
    state = cut_lineage(state.select(*track, F.when(F.col("_posed").isNull(), "no_pose").when(F.size("collapsed") > 0, broken).alias("reason")))
    frames = posture.select(*track, frame, "pitch", "height")
    blocks: dict[str, DataFrame] = {}
    if fitted_errors is None:
        frames = frames.withColumn("residual", F.lit(None).cast("double"))
    else:
        e = cut_lineage(fitted_errors)
        residual = e.groupBy(*track, frame).agg(F.median("err").alias("residual"))
        frames = frames.join(residual, [*track, frame], "left")
        if measured_errors is not None:
            blocks["reproj"] = fit_ratio(e, cut_lineage(measured_errors), [*track, frame], track)
    if held_out is not None:
        blocks["loo"] = _loo_block(held_out, track)
    blocks["invariants"] = invariants.drop("collapsed")
    blocks["coverage"] = coverage_report(kps, track, frame, conf_thresh=conf_thresh, size=size)
    blocks["posture"] = posture_report(frames, track)
    sound = state.where(F.col("reason").isNull()).select(*track)
    documents = sound.join(merge_reports(track, blocks), list(track), "left")
    return documents.withColumn("structural_ok", F.lit(True)), state.where(F.col("reason").isNotNull())


def merge_reports(keys: Sequence[str], blocks: dict[str, DataFrame]) -> DataFrame:
    """One document per key: a struct per report, plus ``blocks`` naming the reports that ran.

    A report that was not run is a missing block, not a block of nulls.
    """
    out, present = None, []
    for name, df in blocks.items():
        cols = [c for c in df.columns if c not in keys]
        d = df.select(*keys, F.struct(*cols).alias(name))
        out = d if out is None else out.join(d, list(keys), "full")
        present.append(F.when(F.col(name).isNotNull(), F.lit(name)))
    return out.withColumn("blocks", F.array_compact(F.array(*present)))
