"""Kernels on bounded series and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import gait as G
from strideframe.operators import kernels as N
from strideframe.operators import song as S
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.tables import TRACKS_CTE, keypoints, tracks
from strideframe.plans.walking import click_cycles

BLK = BLOCK


@query()
def g10_analytic_phase(spark, sf):
    k = keypoints(spark, sf).where(F.col("kp").endswith("TaTip"))
    p = N.analytic_phase(k, ["track", "kp"], "frame", ["x", "y", "z"], fps=800.0, sigma=2.0)
    return p.select("track", "kp", "frame", F.round("phase", 4).alias("phase"))


@query()
def g10_liftoffs_from_phase(spark, sf):
    k = keypoints(spark, sf).where(F.col("kp").endswith("TaTip"))
    p = N.analytic_phase(k, ["track", "kp"], "frame", ["x", "y", "z"], fps=800.0, sigma=2.0)
    return G.liftoffs(p, ["track", "kp"], "frame", "phase", size=BLK)


# A peak's base on either side ends at the next higher sample.
@query(f"""WITH {TRACKS_CTE}, p AS (SELECT * FROM (SELECT track, frame, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM t WINDOW w AS (PARTITION BY track ORDER BY frame)) WHERE v > l AND v > r),
 b AS (SELECT p.track, p.frame, p.v, coalesce((SELECT max(frame) FROM t WHERE t.track = p.track AND t.frame < p.frame AND t.v > p.v), -1) AS lf, coalesce((SELECT min(frame) FROM t WHERE t.track = p.track AND t.frame > p.frame AND t.v > p.v), 1000000000) AS rf FROM p),
 m AS (SELECT b.track, b.frame, any_value(b.v) AS v, min(t.v) FILTER (t.frame <= b.frame) AS ml, min(t.v) FILTER (t.frame >= b.frame) AS mr FROM b JOIN t ON t.track = b.track AND t.frame > lf AND t.frame < rf GROUP BY b.track, b.frame),
 q AS (SELECT track, frame, v, v - greatest(ml, mr) AS prom FROM m)
SELECT track, frame, round(v, 6) AS height, round(prom, 6) AS prominence FROM q WHERE prom >= 40""")
def g14_peaks(spark, sf):
    # Equal neighbouring values would make plateaus; the twin expects strict peaks.
    p = N.find_peaks(tracks(spark, sf), ["track"], "frame", "v", prominence=40.0)
    return p.select("track", "frame", F.round("height", 6).alias("height"), F.round("prominence", 6).alias("prominence"))


@query()
def g14_peaks_in_cycles(spark, sf):
    c = click_cycles(spark, sf)
    p = N.find_peaks(c, ["track"], "frame", "v", prominence=20.0, distance=3, sigma=1.0)
    return N.peaks_in_cycles(p, c, ["track"], "frame", "cycle").select("track", "cycle", "frame", "peak_rank", "n_in_cycle", F.round("height", 4).alias("height"))


# Pulse candidates: frames with a high value.
_PK = f"""{TRACKS_CTE}, pk AS (SELECT track, frame FROM t WHERE v > 70)"""
_TRAIN = f"""{_PK}, n0 AS (SELECT *, frame - lag(frame) OVER w AS dp, lead(frame) OVER w - frame AS dn FROM pk WINDOW w AS (PARTITION BY track ORDER BY frame)),
 n1 AS (SELECT track, frame FROM n0 WHERE dp <= 6 OR dn <= 6), n2 AS (SELECT *, frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) AS d FROM n1),
 n3 AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS train FROM n2), k AS (SELECT track, train FROM n3 GROUP BY track, train HAVING count(*) >= 2 AND median(CASE WHEN d <= 6 THEN d END) <= 3),
 kept AS (SELECT n3.track, n3.frame FROM n3 JOIN k USING (track, train))"""


def pulses(spark, sf):
    p = tracks(spark, sf).where(F.col("v") > 70).select("track", "frame")
    return S.pulse_trains(p, ["track"], "frame", isolation=6, max_median_interval=3.0, size=BLK)


@query(f"WITH {_TRAIN} SELECT track, frame FROM kept")
def g15_pulse_trains(spark, sf):
    return pulses(spark, sf).select("track", "frame")


@query(f"""WITH {_TRAIN}, f AS (SELECT t.track, t.frame, max(k.frame) OVER (PARTITION BY t.track ORDER BY t.frame) AS l, min(k.frame) OVER (PARTITION BY t.track ORDER BY t.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM t LEFT JOIN kept k ON k.track = t.track AND k.frame = t.frame)
SELECT track, frame, coalesce(frame - l <= 1, false) OR coalesce(n - frame <= 1, false) OR coalesce(n - l <= 6, false) AS pulse FROM f""")
def g15_pulse_mask(spark, sf):
    return S.pulse_mask(tracks(spark, sf).select("track", "frame"), pulses(spark, sf), ["track"], "frame", half=1, bridge=6, name="pulse", size=BLK)


@query()
def g15_derivative_pulses(spark, sf):
    t = tracks(spark, sf).select("track", "frame", F.col("v").alias("zl"), (F.col("conf") * 50).alias("zr"))
    p = S.derivative_pulses(t, ["track"], "frame", "zl", "zr", fps=1.0, height=40.0, prominence=20.0, distance=2, baseline=6, exclude=1, ratio=1.5, size=BLK)
    return p.select("track", "frame", F.round("height", 4).alias("height"))
