"""Body scale: implied lengths, per-segment and pooled robust scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.geometry import small_table
from strideframe.operators.quantiles import attach, distinct_values, exact_quantiles, median_and_mad, quantiles_of_counts
from strideframe.session import cut_lineage

# One world unit in mm and the plausible body length range in mm.
WORLD_UNIT_MM = 0.1
BODY_LENGTH_MM = (2.0, 3.0)


def implied_length_mm(model_length: Column, scale: Column) -> Column:
    """Body length implied by a world-to-model scale; null for a scale that is not positive."""
    return model_length / F.when(scale > 0, scale) * WORLD_UNIT_MM


def plausible_length(mm: Column) -> Column:
    return F.coalesce(mm.between(*BODY_LENGTH_MM), F.lit(False))


def segment_scale(lengths: DataFrame, rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per segment: model rest length over the median observed length, and the observed spread."""
    d = cut_lineage(lengths.join(small_table(rest), ["a", "b"]).where(F.col("rest") > 0))
    med = exact_quantiles(d, [*keys, "a", "b"], "length", {"_med": 0.5})
    cv = d.groupBy(*keys, "a", "b", "rest").agg((F.stddev_pop("length") / F.when(F.avg("length") > 0, F.avg("length"))).alias("within_cv"))
    return med.join(cv, [*keys, "a", "b"]).where(F.col("_med") > 0).select(*keys, "a", "b", (F.col("rest") / F.col("_med")).alias("scale"), "within_cv")


def scale_summary(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median scale over the segments of a bout (a small group) with its two spreads."""
    return segments.groupBy(*keys).agg(
        F.median("scale").alias("scale"), F.avg("within_cv").alias("within_bone_cv"), (F.stddev_pop("scale") / F.avg("scale")).alias("across_bone_cv"),
        F.count(F.lit(1)).alias("n_pairs_used"),
    )


def robust_scale(samples: DataFrame, fly: Sequence[str], bout: str, value: str, *, mad_k: float = 3.0) -> DataFrame:
    """Pooled median scale per animal after rejecting outlier bouts (never all of them)."""
    s = distinct_values(samples.where(F.col(value) > 0), [*fly, bout], value)
    per = cut_lineage(quantiles_of_counts(s, [*fly, bout], {"_bm": 0.5}, n="_n"))
    pooled = exact_quantiles(s, fly, "_v", {"_pooled": 0.5}, weight=F.col("_cnt"))
    meds = median_and_mad(per, fly, "_bm", med="_mm", mad="_mad", n="_nb").join(exact_quantiles(per, fly, "_bm", {"_p10": 0.1, "_p90": 0.9}), list(fly))
    stats = per.groupBy(*fly).agg(F.stddev_pop("_bm").alias("_sd"), F.avg("_bm").alias("_avg"), F.sum("_n").alias("n_samples"))
    ref = cut_lineage(meds.join(pooled, list(fly)).join(stats, list(fly)))
    out = (F.col("_mad") > 0) & (F.abs(F.col("_bm") - F.col("_pooled")) > mad_k * F.col("_mad"))
    flagged = attach(per, ref.select(*fly, "_mad", "_pooled"), fly).withColumn("_out", out)
    tally = flagged.groupBy(*fly).agg(F.count_if("_out").alias("_k"))
    kept = cut_lineage(attach(flagged, tally.join(ref.select(*fly, "_nb"), list(fly)), fly).withColumn("_keep", ~F.col("_out") | (F.col("_k") == F.col("_nb"))))
    final = exact_quantiles(s.join(kept.where("_keep").select(*fly, bout), [*fly, bout], "left_semi"), fly, "_v", {"scale": 0.5}, weight=F.col("_cnt"))
    many = F.col("_nb") > 1
    return (
        final.join(ref, list(fly))
        .join(kept.groupBy(*fly).agg(F.count_if(~F.col("_keep")).alias("n_rejected")), list(fly))
        .select(
            *fly, "scale", F.col("_nb").alias("n_bouts"), "n_samples", "n_rejected",
            F.when(many & (F.col("_mm") != 0), (F.col("_p90") - F.col("_p10")) / F.col("_mm") * 100).otherwise(0.0).alias("spread_pct"),
            F.when(many & (F.col("_avg") != 0), F.col("_sd") / F.col("_avg")).otherwise(0.0).alias("cv_across_bouts"),
        )
    )
