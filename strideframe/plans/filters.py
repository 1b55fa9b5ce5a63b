"""Landmark cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import filters as L
from strideframe.operators import gates as T
from strideframe.operators.series import gaussian_smooth, gaussian_taps
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.tables import BONES, BONES_CTE, KEYPOINTS_CTE, OBSERVED_CTE, TRACKS_CTE, keypoints, observed, pairs_of_names, tracks

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
KF = ["track", "frame"]


@query(f"WITH {OBSERVED_CTE} SELECT kp, count(x + y + z) AS n_valid, count(*) AS n FROM obs GROUP BY kp")
def d1_landmark_validity(spark, sf):
    k = observed(keypoints(spark, sf))
    return k.groupBy("kp").agg(F.count_if(L.valid()).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBSERVED_CTE} SELECT track, frame, count(x) >= 19 AND bool_or(kp = 'Scutellum' AND x IS NOT NULL) AND bool_or(kp = 'EyeL' AND x IS NOT NULL) AS ok,
 count(x) = count(*) AS all_ok FROM obs GROUP BY track, frame""")
def d2_usable_frames(spark, sf):
    k = observed(keypoints(spark, sf))
    some = L.usable_frames(k, KF, min_keypoints=19, required=["Scutellum", "EyeL"])
    return some.join(L.usable_frames(k, KF).withColumnRenamed("ok", "all_ok"), KF)


@query(f"""WITH {KEYPOINTS_CTE} SELECT track, kp, CAST(sum(CASE WHEN conf < 0.3 AND NOT contains(kp, 'Wing') THEN 1 ELSE 0 END) AS BIGINT) AS masked,
 CAST(sum(CASE WHEN conf < 0.3 AND contains(kp, 'Wing') THEN 1 ELSE 0 END) AS BIGINT) AS excluded,
 round(sum(CASE WHEN conf >= 0.3 OR contains(kp, 'Wing') THEN x END), 6) AS sum_x FROM kps GROUP BY track, kp""")
def d3_confidence_mask(spark, sf):
    m = L.mask_low_confidence(keypoints(spark, sf), 0.3, ["Wing"])
    return m.groupBy("track", "kp").agg(F.count_if("conf_masked").alias("masked"), F.count_if("conf_excluded").alias("excluded"), F.round(F.sum("x"), 6).alias("sum_x"))


_BONE = f"""WITH {OBSERVED_CTE}, {BONES_CTE}, len AS (SELECT p.track, p.frame, a, b, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS l
  FROM bones JOIN obs p ON p.kp = a JOIN obs r ON r.kp = b AND r.track = p.track AND r.frame = p.frame WHERE p.x IS NOT NULL AND r.x IS NOT NULL AND NOT contains(a || b, 'Wing')),
 m AS (SELECT track, a, b, median(l) AS med, count(*) AS n FROM len GROUP BY ALL), d AS (SELECT len.*, med, n, abs(l - med) AS dev FROM len JOIN m USING (track, a, b)),
 s AS (SELECT track, a, b, median(dev) / 0.6745 AS sigma FROM d GROUP BY ALL),
 bad AS (SELECT d.track, d.frame, d.a, d.b FROM d JOIN s USING (track, a, b) WHERE n >= 5 AND sigma >= 1e-8 AND dev > 2.0 * sigma)"""


@query(f"""{_BONE}, ends AS (SELECT track, frame, a AS kp FROM bad UNION SELECT track, frame, b FROM bad)
SELECT o.track, o.frame, o.kp, e.kp IS NOT NULL AS bone_flagged, round(CASE WHEN e.kp IS NULL THEN o.x END, 6) AS x FROM obs o LEFT JOIN ends e USING (track, frame, kp)""")
def d4_bone_length_mask(spark, sf):
    k = observed(keypoints(spark, sf))
    m = L.mask_bone_outliers(k, ["track"], "frame", pairs_of_names(spark, BONES), threshold=2.0, exclude=["Wing"])
    return m.select(*KF, "kp", "bone_flagged", F.round("x", 6).alias("x"))


_SPIKE = f"""WITH {TRACKS_CTE.replace('value AS v', 'value / 7.3 AS v')}, d AS (SELECT track, frame, v, lag(v) OVER w AS l, lead(v) OVER w AS r, abs(v - lag(v) OVER w) AS st FROM t WINDOW w AS (PARTITION BY track ORDER BY frame)),
 m AS (SELECT track, median(st) AS med, count(st) AS n FROM d GROUP BY track),
 k AS (SELECT d.*, coalesce(n >= 3 AND med >= 1e-12 AND abs(v - l) > 1.0 * med AND abs(r - v) > 1.0 * med AND (v - l) * (r - v) < 0, false) AS spike FROM d JOIN m USING (track)),
 g AS (SELECT *, sum(CASE WHEN spike THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY frame) AS grp FROM k),
 s AS (SELECT *, min(frame) OVER (PARTITION BY track, grp) AS a, first(l) OVER (PARTITION BY track, grp ORDER BY frame) AS l0 FROM g WHERE spike)"""


@query(f"""{_SPIKE}, y AS (SELECT t.track, t.frame, any_value(t.l0) / 2 ** any_value(t.frame - t.a + 1) + sum(p.r / 2 ** (t.frame - p.frame + 1)) AS y
  FROM s t JOIN s p ON p.track = t.track AND p.grp = t.grp AND p.frame <= t.frame GROUP BY t.track, t.frame)
SELECT k.track, k.frame, k.spike AS fixed, round(coalesce(y.y, k.v), 6) AS v FROM k LEFT JOIN y USING (track, frame)""")
def d5_spike_repair(spark, sf):
    out = L.despike(tracks(spark, sf).select(*KF, (F.col("v") / 7.3).alias("v")), ["track"], "frame", ["v"], factor=1.0, size=BLK)
    return out.select(*KF, (F.col("v_fixed") == 1).alias("fixed"), F.round("v", 6).alias("v"))


@query(f"""WITH {TRACKS_CTE}, d AS (SELECT track, frame, v, abs(v - lag(v) OVER (PARTITION BY track ORDER BY frame)) AS st FROM t),
 m AS (SELECT track, median(st) AS med, count(*) AS n FROM d GROUP BY track),
 w AS (SELECT a.track, a.frame, a.v, median(coalesce(b.v, 0)) AS mf FROM d a CROSS JOIN (SELECT unnest(range(-3, 4)) AS k) o LEFT JOIN d b ON b.track = a.track AND b.frame = a.frame + k GROUP BY ALL),
 f AS (SELECT w.*, n, abs(v - mf) > 3.0 * med AS far FROM w JOIN m USING (track)),
 c AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY track) AS bad FROM f)
SELECT track, frame, far AND bad < n * 0.1 AS replaced, round(CASE WHEN far AND bad < n * 0.1 THEN mf ELSE v END, 6) AS v FROM c""")
def d6_median_despike(spark, sf):
    out = L.median_despike(tracks(spark, sf).select(*KF, "v"), ["track"], "frame", "v", kernel=7, factor=3.0, max_fraction=0.1, size=BLK)
    return out.select(*KF, "replaced", F.round("v", 6).alias("v"))


@query(f"""{_BONE}, ends AS (SELECT track, frame, a AS kp FROM bad UNION SELECT track, frame, b FROM bad)
SELECT o.track, o.kp, count(*) FILTER (o.x IS NOT NULL AND (e.kp IS NOT NULL OR contains(o.kp, 'Wing'))) AS reinstated, round(sum(o.x), 6) AS sum_x
FROM obs o LEFT JOIN ends e USING (track, frame, kp) GROUP BY ALL""")
def d7_reinstate_raw(spark, sf):
    k = observed(keypoints(spark, sf))
    m = L.mask_bone_outliers(k, ["track"], "frame", pairs_of_names(spark, BONES), threshold=2.0, exclude=["Wing"])
    out = L.reinstate_raw(m, k, KF, ["Wing"])
    return out.groupBy("track", "kp").agg(F.count_if("reinstated").alias("reinstated"), F.round(F.sum("x"), 6).alias("sum_x"))


@query()
def d8_filter_chain(spark, sf):
    k = keypoints(spark, sf)
    f = L.filter_chain(k, ["track"], "frame", pairs_of_names(spark, BONES), size=BLK)
    return f.select(*KF, "kp", *[F.round(c, 6).alias(c) for c in "xyz"], "conf_masked", "bone_flagged", "interpolated")


@query()
def d8_filter_report(spark, sf):
    f = L.filter_chain(keypoints(spark, sf), ["track"], "frame", pairs_of_names(spark, BONES), {"savgol": {"enabled": False}}, size=BLK)
    return L.filter_report(f, ["track"], "frame")


_LIN = f"""WITH {TRACKS_CTE.replace('value AS v', 'value / 7.3 AS v')}, s AS (SELECT track, frame, CASE WHEN conf >= 0.3 THEN v END AS x FROM t),
 f AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS f0,
  min(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM s),
 n AS (SELECT track, count(x) AS n, count(*) AS tot FROM s GROUP BY track)"""


@query(f"""{_LIN}, good AS (SELECT track, frame, x, row_number() OVER (PARTITION BY track ORDER BY frame) AS i, count(*) OVER (PARTITION BY track) AS c FROM s WHERE x IS NOT NULL),
 e AS (SELECT track, regr_slope(x, frame) FILTER (i <= 5) AS s0, regr_intercept(x, frame) FILTER (i <= 5) AS k0, regr_slope(x, frame) FILTER (i > c - 5) AS s1, regr_intercept(x, frame) FILTER (i > c - 5) AS k1 FROM good GROUP BY track)
SELECT f.track, f.frame, f0 IS NULL OR f1 IS NULL AS edge_gap, round(CASE WHEN f.x IS NOT NULL THEN f.x WHEN n < 4 OR n * 2 < tot THEN NULL
 WHEN f0 IS NOT NULL AND f1 IS NOT NULL THEN a.x + (b.x - a.x) * (f.frame - f0) / (f1 - f0)
 WHEN f0 IS NULL AND f1 - f.frame <= 2 THEN s0 * f.frame + k0 WHEN f1 IS NULL AND f.frame - f0 <= 2 THEN s1 * f.frame + k1 END, 6) AS x
FROM f JOIN n USING (track) JOIN e USING (track) LEFT JOIN s a ON a.track = f.track AND a.frame = f0 LEFT JOIN s b ON b.track = f.track AND b.frame = f1""")
def g3_linear_gaps(spark, sf):
    s = tracks(spark, sf).select(*KF, F.when(F.col("conf") >= 0.3, F.col("v") / 7.3).alias("x"))
    out = L.interpolate_gaps(s, ["track"], "frame", ["x"], spline=False, max_edge=2, size=BLK)
    return out.select(*KF, "edge_gap", F.round("x", 6).alias("x"))


@query(f"""{_LIN}, g0 AS (SELECT track, frame, x, lag(frame) OVER w AS fb, lag(x) OVER w AS xb, lead(frame) OVER w AS fa, lead(x) OVER w AS xa,
   lead(frame, 2) OVER w AS fa2, lead(x, 2) OVER w AS xa2, lag(frame, 2) OVER w AS fb2, lag(x, 2) OVER w AS xb2 FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY frame)),
 g1 AS (SELECT *, (x - xb) / (frame - fb) AS d0, (xa - x) / (fa - frame) AS d1, (xa2 - xa) / (fa2 - fa) AS dn, (xb - xb2) / (fb - fb2) AS dp, frame - fb AS h0, fa - frame AS h1, fa2 - fa AS hn, fb - fb2 AS hp FROM g0),
 g2 AS (SELECT *, ((2 * h1 + hn) * d1 - h1 * dn) / (h1 + hn) AS e0, ((2 * h0 + hp) * d0 - h0 * dp) / (h0 + hp) AS e1 FROM g1),
 g AS (SELECT track, frame, x, CASE WHEN fb IS NULL THEN CASE WHEN sign(e0) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(dn) AND abs(e0) > 3 * abs(d1) THEN 3 * d1 ELSE e0 END
   WHEN fa IS NULL THEN CASE WHEN sign(e1) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(dp) AND abs(e1) > 3 * abs(d0) THEN 3 * d0 ELSE e1 END
   WHEN d0 * d1 > 0 THEN (3 * h0 + 3 * h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) ELSE 0 END AS d FROM g2),
 j AS (SELECT f.*, n, tot, a.x AS xa, a.d AS da, b.x AS xb, b.d AS db, f1 - f0 AS h, (f.frame - f0) / (f1 - f0) AS u FROM f JOIN n USING (track)
   LEFT JOIN g a ON a.track = f.track AND a.frame = f0 LEFT JOIN g b ON b.track = f.track AND b.frame = f1)
SELECT track, frame, round(CASE WHEN x IS NOT NULL THEN x WHEN n >= 4 AND n * 2 >= tot AND h > 0
 THEN xa * (1 + 2 * u) * (1 - u) ** 2 + h * da * u * (1 - u) ** 2 + xb * u * u * (3 - 2 * u) + h * db * u * u * (u - 1) END, 6) AS x FROM j""")
def g3_spline_gaps(spark, sf):
    s = tracks(spark, sf).select(*KF, F.when(F.col("conf") >= 0.3, F.col("v") / 7.3).alias("x"))
    return L.interpolate_gaps(s, ["track"], "frame", ["x"], size=BLK).select(*KF, F.round("x", 6).alias("x"))


def _savgol_sql(window: int, poly: int, deriv: int = 0, delta: float = 1.0) -> str:
    rows = L.savgol_weights(window, poly, deriv, delta)
    h = window // 2
    vals = ", ".join(f"({p}, {j}, {rows[p][j]!r})" for p in range(window) for j in range(window))
    return f"""WITH {TRACKS_CTE}, wt AS (SELECT * FROM (VALUES {vals}) AS w(p, j, c)), n AS (SELECT track, count(*) AS n FROM t GROUP BY track),
 q AS (SELECT t.track, t.frame, CASE WHEN t.frame < {h} THEN t.frame WHEN n - 1 - t.frame < {h} THEN {window} - (n - t.frame) ELSE {h} END AS p FROM t JOIN n USING (track))
SELECT q.track, q.frame, round(sum(wt.c * s.v), 6) AS x FROM q JOIN wt USING (p) JOIN t s ON s.track = q.track AND s.frame = q.frame - q.p + wt.j GROUP BY ALL"""


@query(_savgol_sql(7, 2))
def g5_savgol(spark, sf):
    return L.savgol(tracks(spark, sf), ["track"], "frame", {"x": "v"}, window=7, polyorder=2, size=BLK).select(*KF, F.round("x", 6).alias("x"))


@query(_savgol_sql(5, 2, 1, 1 / 800))
def g5_savgol_derivative(spark, sf):
    out = L.savgol(tracks(spark, sf), ["track"], "frame", {"x": "v"}, window=5, polyorder=2, deriv=1, delta=1 / 800, size=BLK)
    return out.select(*KF, F.round("x", 6).alias("x"))


_TAPS = "[" + ", ".join(repr(v) for v in gaussian_taps(1.0)) + "]"


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT track, frame, CASE WHEN conf >= 0.3 THEN v END AS x FROM t), e AS (SELECT track, count(*) AS n FROM t GROUP BY track),
 w AS (SELECT s.track, s.frame, s.x, o.k, CASE WHEN s.frame + k < 0 THEN -(s.frame + k) - 1 WHEN s.frame + k >= n THEN 2 * n - 1 - (s.frame + k) ELSE s.frame + k END AS src FROM s JOIN e USING (track), (SELECT unnest(range(-4, 5)) AS k) o)
SELECT w.track, w.frame, round(CASE WHEN any_value(w.x) IS NOT NULL THEN sum(coalesce(b.x, 0) * ({_TAPS})[k + 5]) / sum(CASE WHEN b.x IS NULL THEN 0 ELSE ({_TAPS})[k + 5] END) END, 6) AS x
FROM w JOIN s b ON b.track = w.track AND b.frame = w.src GROUP BY w.track, w.frame""")
def g6_gaussian_smooth(spark, sf):
    s = tracks(spark, sf).select(*KF, F.when(F.col("conf") >= 0.3, F.col("v")).alias("x"))
    return gaussian_smooth(s, ["track"], "frame", {"x": "x"}, 1.0, size=BLK).select(*KF, F.round("x", 6).alias("x"))


_COARSE = f"""WITH {TRACKS_CTE}, c AS (SELECT track // 2 AS recording, track % 2 AS fly, frame, conf AS exist, event_id % 8 AS n_valid_cams, CASE WHEN v >= 5 THEN v END AS wing_angle_deg,
  CASE WHEN track % 2 = 0 THEN conf * 60 END AS sep2d_med, CASE WHEN track % 2 = 0 AND v > 10 THEN v END AS sep3d FROM t)"""


def coarse(spark, sf):
    t = tracks(spark, sf)
    even = F.col("track") % 2 == 0
    return t.select(
        F.floor(F.col("track") / 2).alias("recording"), (F.col("track") % 2).alias("fly"), "frame", F.col("conf").alias("exist"), (F.col("event_id") % 8).alias("n_valid_cams"),
        F.when(F.col("v") >= 5, F.col("v")).alias("wing_angle_deg"), F.when(even, F.col("conf") * 60).alias("sep2d_med"), F.when(even & (F.col("v") > 10), F.col("v")).alias("sep3d"),
    )


@query(f"""{_COARSE} SELECT recording, frame, bool_and(exist >= 0.5 AND n_valid_cams >= 3) AND count(*) >= 2 AND coalesce(max(sep2d_med) >= 15, false)
 AND (coalesce(max(CASE WHEN fly = 1 THEN wing_angle_deg END) >= 30, false) OR coalesce(max(sep3d) <= 30, false)) AS in_bout FROM c GROUP BY recording, frame""")
def d9_behaviour_gate(spark, sf):
    return T.apply_gates(coarse(spark, sf), ["recording", "frame"], num_animals=2)


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT a.track // 2 AS bout, a.frame, a.v AS z0, b.v AS z1, a.conf >= 0.2 AS f0, b.conf >= 0.2 AS f1, a.label = 'error' AS swap FROM t a JOIN t b ON b.track = a.track + 1 AND b.frame = a.frame WHERE a.track % 2 = 0),
 fl AS (SELECT bout, quantile_cont(z0, 0.05) AS q0, quantile_cont(z1, 0.05) AS q1 FROM p GROUP BY bout),
 tg AS (SELECT p.*, coalesce(swap <> lag(swap) OVER (PARTITION BY bout ORDER BY frame), false) AS tog FROM p),
 v AS (SELECT tg.*, NOT max(tog) OVER (PARTITION BY bout ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS idv, abs(z0 - z1) < 5 AS colo FROM tg)
SELECT v.bout, v.frame, CAST(CASE WHEN f0 AND z0 <= q0 + 30 AND idv AND NOT colo THEN 1 ELSE 0 END + CASE WHEN f1 AND z1 <= q1 + 30 AND idv AND NOT colo THEN 2 ELSE 0 END AS INT) AS pair_state FROM v JOIN fl USING (bout)""")
def d10_pair_state(spark, sf):
    return T.pair_validity(pair_table(spark, sf), ["bout"], "frame", epsilon=30.0, guard=1, min_separation=5.0, size=BLK).select("bout", "frame", "pair_state")


def pair_table(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 2))
    a = t.where(F.col("track") % 2 == 0).select("bout", "frame", F.col("v").alias("ground_z0"), (F.col("conf") >= 0.2).alias("finite0"), (F.col("label") == "error").alias("swap"))
    b = t.where(F.col("track") % 2 == 1).select("bout", "frame", F.col("v").alias("ground_z1"), (F.col("conf") >= 0.2).alias("finite1"))
    return a.join(b, ["bout", "frame"]).withColumn("separation", F.abs(F.col("ground_z0") - F.col("ground_z1")))


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT a.track // 2 AS bout, CASE WHEN a.conf >= 0.5 THEN 1 ELSE 0 END AS v0, CASE WHEN b.conf >= 0.4 THEN 1 ELSE 0 END AS v1 FROM t a JOIN t b ON b.track = a.track + 1 AND b.frame = a.frame WHERE a.track % 2 = 0),
 c AS (SELECT bout, sum(v0 * v1) AS nb, sum(v0) AS n0, sum(v1) AS n1 FROM p GROUP BY bout)
SELECT bout, CASE WHEN nb >= 20 AND (n0 - nb >= 16 OR n1 - nb >= 16) THEN 'mixed' WHEN nb >= 20 THEN 'paired' WHEN n0 >= 16 AND n1 < 16 THEN 'fly0_only'
 WHEN n1 >= 16 AND n0 < 16 THEN 'fly1_only' WHEN n0 >= 16 AND n1 >= 16 THEN 'mixed' ELSE 'empty' END AS bout_class FROM c""")
def d10_bout_class(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 2))
    a = t.where(F.col("track") % 2 == 0).select("bout", "frame", (F.col("conf") >= 0.5).alias("valid0"))
    b = t.where(F.col("track") % 2 == 1).select("bout", "frame", (F.col("conf") >= 0.4).alias("valid1"))
    return T.classify_bouts(a.join(b, ["bout", "frame"]), ["bout"], min_paired=20, min_solo=16).select("bout", "bout_class")


@query(f"""WITH {KEYPOINTS_CTE}, e AS (SELECT track, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1, quantile_cont(z, 0.99) AS z1 FROM kps GROUP BY track)
SELECT k.track, k.frame, bool_or(y < y0 OR y > y1 OR z > z1) AS outside FROM kps k JOIN e USING (track) GROUP BY k.track, k.frame""")
def d11_arena_envelope(spark, sf):
    k = keypoints(spark, sf)
    return T.outside_arena(k, ["track"], "frame")


@query(f"""WITH {KEYPOINTS_CTE}, {BONES_CTE}, len AS (SELECT p.track, a, b, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) * CASE WHEN a = 'EyeL' THEN 0.05 ELSE 1 END AS length
  FROM bones JOIN kps p ON p.kp = a JOIN kps r ON r.kp = b AND r.track = p.track AND r.frame = p.frame), m AS (SELECT track, a, b, median(length) AS med FROM len GROUP BY ALL),
 r AS (SELECT track, median(med) AS ref FROM m GROUP BY track)
SELECT m.track, a || '--' || b AS segment, 'collapsed' AS code FROM m JOIN r USING (track) WHERE med < 0.2 * ref""")
def d12_structural_guard(spark, sf):
    from strideframe.operators.geometry import segment_lengths

    s = segment_lengths(keypoints(spark, sf), KF, pairs_of_names(spark, BONES))
    s = s.withColumn("length", F.col("length") * F.when(F.col("a") == "EyeL", 0.05).otherwise(1.0))
    return T.structural_findings(s, ["track"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no_outputs_h5' WHEN n = 0 THEN 'no_solved_frames' WHEN NOT any_ok THEN 'no_bridge' WHEN o_totalprice > 400000 THEN 'nan_cost' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'A') AS any_ok FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey
WHERE CASE WHEN o_orderstatus = 'P' THEN true WHEN coalesce(n, 0) = 0 THEN false ELSE true END""")
def d13_exclusion_reasons(spark, sf):
    from strideframe.plans.tables import table

    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") > 10).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_solved"), F.bool_or(F.col("l_returnflag") == "A").alias("any_bridge")
    )
    j = o.join(li, "o_orderkey", "left").where((F.col("o_orderstatus") == "P") | (F.coalesce("n_solved", F.lit(0)) > 0))
    j = j.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("has_outputs"), "n_solved", "any_bridge", (F.col("o_totalprice") <= 400000).alias("costs_finite"))
    return j.select("o_orderkey", T.exclusion_reason("has_outputs", "n_solved", "any_bridge", "costs_finite").alias("reason"))


@query(f"""WITH {TRACKS_CTE}, d AS (SELECT track // 2 AS pair, track % 2 AS side, frame, abs(v - coalesce(lag(v) OVER (PARTITION BY track ORDER BY frame), v)) * 0.2 AS dz FROM t),
 m AS (SELECT pair, frame, max(dz) AS dz, count(*) AS c FROM d GROUP BY pair, frame HAVING count(*) = 2), s AS (SELECT pair, count(*) AS n, quantile_cont(dz, 0.95) AS p95 FROM m GROUP BY pair)
SELECT pair, n, round(p95, 6) AS p95, CASE WHEN n < 55 THEN 'short' WHEN p95 < 25 THEN 'quiet' END AS dropped FROM s""")
def d14_song_pair_filter(spark, sf):
    t = tracks(spark, sf).select(F.floor(F.col("track") / 2).alias("pair"), (F.col("track") % 2).alias("side"), "frame", "v")
    out = T.song_pair_filter(t, ["pair"], "side", "frame", "v", fps=0.2, min_frames=55, min_p95=25.0, size=BLK)
    return out.select("pair", "n", F.round("p95", 6).alias("p95"), "dropped")


@query("""WITH c AS (SELECT l_returnflag AS cond, l_orderkey AS bout, l_linenumber AS cycle, l_extendedprice / l_quantity AS speed FROM lineitem),
 b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT cond, quantile_cont(speed, 0.01) AS lo, quantile_cont(speed, 0.99) AS hi FROM c GROUP BY cond))
SELECT cond, count(*) AS n, round(avg(speed), 6) AS mean_speed FROM c, b WHERE speed BETWEEN lo AND hi GROUP BY cond""")
def d15_shared_support(spark, sf):
    from strideframe.plans.tables import table

    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cond"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("speed"))
    return T.shared_support(c, "cond", "speed", how="robust").groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed"), 6).alias("mean_speed"))
