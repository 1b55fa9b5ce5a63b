"""Fits, scales and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators import filters as L
from strideframe.operators import fits
from strideframe.operators import geometry as G
from strideframe.operators import qc
from strideframe.operators import scale as SC
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.tables import (
    BONES, BONES_CTE, CAMERAS, KEYPOINTS_CTE, OBSERVATIONS_CTE, OBSERVED_CTE, cameras, keypoints, observations, observed, pairs_of_names, table,
)

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
KF = ["track", "frame"]
KFP = ["track", "frame", "kp"]


@query()
def f1_triangulate(spark, sf):
    t = fits.triangulate(observations(spark, sf), cameras(spark), KFP, conf_thresh=0.3)
    return t.select(*KFP, "n_views", *[F.round(c, 4).alias(c) for c in "xyz"], F.round("conf", 6).alias("conf"))


_C11 = {c: [v / p[11] for v in p[:11]] for c, p in CAMERAS.items()}
_C11_SQL = "dlt AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {v})" for c, v in _C11.items()) + ") AS d(camera, c))"
_A = [[f"(c[{4 * r + 1 + k}] - {w} * c[{9 + k}])" for k in range(3)] for r, w in ((0, "u"), (1, "v"))]
_RHS = ["(u - c[4])", "(v - c[8])"]
_NEQ = ", ".join(f"sum({_A[0][i]} * {_A[0][k]} + {_A[1][i]} * {_A[1][k]}) AS n{i}{k}" for i in range(3) for k in range(i, 3))
_NRH = ", ".join(f"sum({_A[0][i]} * {_RHS[0]} + {_A[1][i]} * {_RHS[1]}) AS b{i}" for i in range(3))


def _det(cols):
    a, b, c = cols
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


_N = [[f"n{min(i, k)}{max(i, k)}" for i in range(3)] for k in range(3)]
_SOL = ", ".join(f"round({_det([['b0', 'b1', 'b2'] if k == i else _N[k] for k in range(3)])} / {_det(_N)}, 6) AS {'xyz'[i]}" for i in range(3))


@query(f"""WITH {OBSERVATIONS_CTE}, {_C11_SQL}, s AS (SELECT track, frame, kp, count(*) AS n_views, {_NEQ}, {_NRH} FROM det JOIN dlt USING (camera) WHERE conf >= 0.3 GROUP BY track, frame, kp)
SELECT track, frame, kp, n_views, {_SOL} FROM s WHERE n_views >= 2""")
def f1_triangulate_lsq(spark, sf):
    rows = ", ".join(f"('{c}', array({', '.join(f'{v!r}D' for v in vals)}))" for c, vals in _C11.items())
    coeffs = spark.sql(f"SELECT * FROM VALUES {rows} AS t(camera, c)")
    t = fits.triangulate_lsq(observations(spark, sf).where(F.col("conf") >= 0.3), coeffs, KFP)
    return t.select(*KFP, "n_views", *[F.round(c, 6).alias(c) for c in "xyz"])


@query()
def f2_leave_one_out(spark, sf):
    rep = fits.leave_one_out_report(fits.leave_one_out(observations(spark, sf), cameras(spark), KFP))
    return rep.select("camera", F.round("median_px", 4).alias("median_px"), "n")


@query(f"WITH {OBSERVATIONS_CTE} SELECT track, frame, camera, round(median(conf), 6) AS median_conf FROM det GROUP BY ALL")
def f3_view_confidence(spark, sf):
    v = qc.view_confidence(observations(spark, sf), KF)
    return v.select(*KF, "camera", F.round("median_conf", 6).alias("median_conf"))


_ERR = f"""{OBSERVATIONS_CTE}, er AS (SELECT d.track, d.frame, d.kp, d.camera,
  sqrt(((p[1] * (x + sh) + p[2] * y + p[3] * z + p[4]) / (p[9] * (x + sh) + p[10] * y + p[11] * z + p[12]) - u) ** 2
     + ((p[5] * (x + sh) + p[6] * y + p[7] * z + p[8]) / (p[9] * (x + sh) + p[10] * y + p[11] * z + p[12]) - v) ** 2) AS err, sh
  FROM det d JOIN kps k ON k.track = d.track AND k.frame = d.frame AND k.kp = d.kp, (SELECT unnest([0.0, 0.01]) AS sh) s WHERE d.conf >= 0.3)"""


@query(f"""WITH {_ERR} SELECT 'camera ' || camera AS scope, round(median(err), 6) AS median_px FROM er WHERE sh = 0 GROUP BY camera
UNION ALL SELECT 'all', round(median(err), 6) FROM er WHERE sh = 0
UNION ALL SELECT 'frame ' || track || '/' || frame, round(median(err), 6) FROM er WHERE sh = 0 GROUP BY track, frame""")
def f4_reprojection(spark, sf):
    e = qc.reprojection_errors(keypoints(spark, sf), observations(spark, sf), cameras(spark), KFP)
    per, frames = qc.reprojection_report(e, KF)
    a = per.select(F.when(F.col("camera") == "all", "all").otherwise(F.concat(F.lit("camera "), "camera")).alias("scope"), F.round("median_px", 6).alias("median_px"))
    return a.unionByName(frames.select(F.concat(F.lit("frame "), "track", F.lit("/"), "frame").alias("scope"), F.round("median_px", 6).alias("median_px")))


@query(f"""WITH {_ERR} SELECT round(median(err) FILTER (sh > 0), 6) AS fitted_px, round(median(err) FILTER (sh = 0), 6) AS measured_px,
 round(median(err) FILTER (sh > 0) / median(err) FILTER (sh = 0), 6) AS ratio, count(*) FILTER (sh = 0) AS n FROM er""")
def f4_fit_ratio(spark, sf):
    k, o, c = keypoints(spark, sf), observations(spark, sf), cameras(spark)
    fitted = qc.reprojection_errors(k.withColumn("x", F.col("x") + 0.01), o, c, KFP)
    r = qc.fit_ratio(fitted, qc.reprojection_errors(k, o, c, KFP), KF)
    return r.select(*[F.round(x, 6).alias(x) for x in ("fitted_px", "measured_px", "ratio")], "n")


@query(f"""WITH {OBSERVED_CTE}, o AS (SELECT track, frame, kp, pos, x IS NOT NULL AND conf >= 0.3 AS seen FROM obs),
 k AS (SELECT track, kp, pos, avg(CASE WHEN seen THEN 0.0 ELSE 1.0 END) AS f FROM o GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY track, kp ORDER BY frame) - row_number() OVER (PARTITION BY track, kp, seen ORDER BY frame) AS grp FROM o),
 r AS (SELECT track, kp, grp, count(*) AS n FROM g WHERE NOT seen GROUP BY track, kp, grp),
 rs AS (SELECT track, count(*) AS n_gaps, max(n) AS max_gap, median(n) AS median_gap FROM r GROUP BY track),
 w AS (SELECT track, arg_max(kp, (f, -pos)) AS worst_keypoint FROM k GROUP BY track)
SELECT o.track, round(avg(CASE WHEN seen THEN 0.0 ELSE 1.0 END), 6) AS missing_fraction, count(DISTINCT frame) AS n_frames, any_value(worst_keypoint) AS worst_keypoint,
 any_value(n_gaps) AS n_gaps, any_value(max_gap) AS max_gap, any_value(median_gap) AS median_gap FROM o JOIN rs USING (track) JOIN w USING (track) GROUP BY o.track""")
def f5_coverage(spark, sf):
    r = qc.coverage_report(observed(keypoints(spark, sf)), ["track"], "frame", size=BLK)
    return r.withColumn("missing_fraction", F.round("missing_fraction", 6))


_LEN = f"""{OBSERVED_CTE}, {BONES_CTE}, len AS (SELECT p.track, p.frame, a, b, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS length
  FROM bones JOIN obs p ON p.kp = a JOIN obs r ON r.kp = b AND r.track = p.track AND r.frame = p.frame WHERE p.x IS NOT NULL AND r.x IS NOT NULL)"""


def lengths(spark, sf):
    return G.segment_lengths(observed(keypoints(spark, sf)).where(L.valid()), KF, pairs_of_names(spark, BONES))


@query(f"""WITH {_LEN}, m AS (SELECT track, a, b, median(length) AS median, count(*) AS n, stddev_pop(length) / avg(length) AS cv FROM len GROUP BY ALL),
 r AS (SELECT track, median(median) AS ref FROM m GROUP BY track)
SELECT track, a, b, round(median, 6) AS median, n, round(cv, 6) AS cv, median < 0.2 * ref AS collapsed FROM m JOIN r USING (track)""")
def f6_rigid_invariants(spark, sf):
    r = qc.invariant_report(lengths(spark, sf), ["track"])
    return r.select("track", "a", "b", F.round("median", 6).alias("median"), "n", F.round("cv", 6).alias("cv"), "collapsed")


_POST = f"""{KEYPOINTS_CTE}, w AS (SELECT track, frame, any_value(vec_id) AS vec_id, max(CASE WHEN kp = 'Antenna_Base' THEN z END) - max(CASE WHEN kp = 'Scutellum' THEN z END) AS dz,
  sqrt((max(CASE WHEN kp = 'Antenna_Base' THEN x END) - max(CASE WHEN kp = 'Scutellum' THEN x END)) ** 2 + (max(CASE WHEN kp = 'Antenna_Base' THEN y END) - max(CASE WHEN kp = 'Scutellum' THEN y END)) ** 2
   + (max(CASE WHEN kp = 'Antenna_Base' THEN z END) - max(CASE WHEN kp = 'Scutellum' THEN z END)) ** 2) AS nrm, avg(z) AS height FROM kps GROUP BY track, frame),
 f AS (SELECT track, frame, degrees(asin(greatest(least(dz / nrm, 1), -1))) AS pitch, height, CAST((vec_id * 37) % 101 AS DOUBLE) ** 2 AS residual FROM w),
 b AS (SELECT track, median(residual) AS base FROM f GROUP BY track)"""


@query(f"""WITH {_POST} SELECT f.track, count(*) AS n_frames, count(*) FILTER (pitch > 45) AS n_pitched, count(*) FILTER (pitch > 45 AND residual > 3 * base) AS n_flagged,
 round(median(pitch), 6) AS pitch_median, round(quantile_cont(pitch, 0.95), 6) AS pitch_p95, round(max(pitch), 6) AS pitch_max,
 round(median(height), 6) AS height_median, round(quantile_cont(height, 0.95), 6) AS height_p95, round(max(height), 6) AS height_max FROM f JOIN b USING (track) GROUP BY f.track""")
def f7_posture(spark, sf):
    k = keypoints(spark, sf)
    w = G.wide(k, KF, ["Antenna_Base", "Scutellum"]).join(k.groupBy(*KF).agg(F.avg("z").alias("height"), F.max("vec_id").alias("vec_id")), KF)
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    f = w.select(*KF, qc.axis_pitch(V.vec("Scutellum"), V.vec("Antenna_Base"), up).alias("pitch"), "height", F.pow((F.col("vec_id") * 37 % 101).cast("double"), 2).alias("residual"))
    r = qc.posture_report(f, ["track"])
    return r.select("track", "n_frames", "n_pitched", "n_flagged", *[F.round(f"{a}_{b}", 6).alias(f"{a}_{b}") for a in ("pitch", "height") for b in ("median", "p95", "max")])


@query()
def f8_floor_fit(spark, sf):
    cen = keypoints(spark, sf).groupBy(*KF).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return fits.fit_floor(cen, ["track"], ["frame"], up_hint=(0.0, 0.0, 1.0)).select("track", *[F.round(c, 4).alias(c) for c in ("nx", "ny", "nz", "offset")], "n")


_REST = "rest AS (SELECT a, b, 0.5 + length(a) / 10.0 AS rest FROM bones WHERE NOT contains(a, 'Eye'))"


def rest_lengths(spark):
    e = pairs_of_names(spark, BONES)
    return e.where(~F.col("a").contains("Eye")).withColumn("rest", 0.5 + F.length("a") / 10.0)


@query(f"""WITH {_LEN}, {_REST}, m AS (SELECT track, a, b, any_value(rest) / median(length) AS scale, stddev_pop(length) / avg(length) AS cv FROM len JOIN rest USING (a, b) GROUP BY ALL)
SELECT track, round(median(scale), 6) AS scale, round(avg(cv), 6) AS within_bone_cv, round(stddev_pop(scale) / avg(scale), 6) AS across_bone_cv, count(*) AS n_pairs_used FROM m GROUP BY track""")
def f9_segment_scale(spark, sf):
    r = SC.scale_summary(SC.segment_scale(lengths(spark, sf), rest_lengths(spark), ["track"]), ["track"])
    return r.select("track", *[F.round(c, 6).alias(c) for c in ("scale", "within_bone_cv", "across_bone_cv")], "n_pairs_used")


TRUNK = ["Scutellum", "Abd_tip", "WingL_base", "WingR_base", "Antenna_Base"]
_TRUNK_SQL = ", ".join(f"'{n}'" for n in TRUNK)


def trunk_pairs(spark, sf):
    """Observed trunk landmarks next to a model whose coordinates follow from the name."""
    k = observed(keypoints(spark, sf)).where(F.col("kp").isin(*TRUNK) & L.valid())
    return k.select(
        *KF, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"),
        (F.col("pos") * 0.5).alias("dx"), (F.length("kp") * 0.25).alias("dy"), (F.col("pos") % 3).cast("double").alias("dz"),
    )


@query(f"""WITH {OBSERVED_CTE}, s AS (SELECT track, frame, count(*) AS n, var_pop(x) + var_pop(y) + var_pop(z) AS vs, var_pop(pos * 0.5) + var_pop(length(kp) * 0.25) + var_pop(pos % 3) AS vd
  FROM obs WHERE kp IN ({_TRUNK_SQL}) AND x IS NOT NULL GROUP BY track, frame)
SELECT track, frame, round(sqrt(vd / vs), 6) AS scale FROM s WHERE n = {len(TRUNK)}""")
def f10_norm_ratio_scale(spark, sf):
    r = fits.frame_scales(trunk_pairs(spark, sf), KF, n_required=len(TRUNK), estimator="norm_ratio")
    return r.select(*KF, F.round("scale", 6).alias("scale"))


def _similarity_sql(pairs):
    """Scale of the best similarity of each frame's pairs: singular values of the 3x3 covariance in closed form, from the eigenvalues of its square."""
    cov = ", ".join(f"covar_pop(d{a}, s{b}) AS c{i}{k}" for i, a in enumerate("xyz") for k, b in enumerate("xyz"))
    square = ", ".join(f"c0{i} * c0{k} + c1{i} * c1{k} + c2{i} * c2{k} AS b{i}{k}" for i in range(3) for k in range(i, 3))
    whole = _det([[f"c{i}{k}" for i in range(3)] for k in range(3)])
    shifted = [[f"(b{i}{i} - q)" if i == k else f"b{min(i, k)}{max(i, k)}" for i in range(3)] for k in range(3)]
    return f"""pr AS ({pairs}), mo AS (SELECT track, frame, count(*) AS n, var_pop(sx) + var_pop(sy) + var_pop(sz) AS var, {cov} FROM pr GROUP BY track, frame),
 sq AS (SELECT track, frame, n, var, {whole} AS cdet, {square} FROM mo), tr AS (SELECT *, (b00 + b11 + b22) / 3 AS q FROM sq),
 pp AS (SELECT *, sqrt(((b00 - q) ** 2 + (b11 - q) ** 2 + (b22 - q) ** 2 + 2 * (b01 ** 2 + b02 ** 2 + b12 ** 2)) / 6) AS p, {_det(shifted)} AS sdet FROM tr),
 ph AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, sdet / (2 * p ** 3)))) / 3 ELSE 0 END AS phi FROM pp),
 ev AS (SELECT *, q + 2 * p * cos(phi) AS e0, q + 2 * p * cos(phi + 2 * pi() / 3) AS e2 FROM ph),
 fit AS (SELECT track, frame, n, (sqrt(greatest(e0, 0)) + sqrt(greatest(3 * q - e0 - e2, 0)) + CASE WHEN cdet < 0 THEN -1 ELSE 1 END * sqrt(greatest(e2, 0))) / CASE WHEN var > 0 THEN var END AS s FROM ev)"""


@query(f"""WITH {OBSERVED_CTE}, {_similarity_sql(f"SELECT track, frame, x AS sx, y AS sy, z AS sz, pos * 0.5 AS dx, length(kp) * 0.25 AS dy, CAST(pos % 3 AS DOUBLE) AS dz FROM obs WHERE kp IN ({_TRUNK_SQL}) AND x IS NOT NULL")}
SELECT track, frame, round(s, 4) AS scale FROM fit WHERE n = {len(TRUNK)}""")
def f10_umeyama_scale(spark, sf):
    return fits.frame_scales(trunk_pairs(spark, sf), KF, n_required=len(TRUNK)).select(*KF, F.round("scale", 4).alias("scale"))


@query("""WITH s AS (SELECT l_suppkey AS fly, l_linenumber AS bout, l_extendedprice / l_quantity * (1 + l_linenumber * l_linenumber / 100.0) AS v FROM lineitem),
 b AS (SELECT fly, bout, median(v) AS bm, count(*) AS n FROM s GROUP BY fly, bout), p AS (SELECT fly, median(v) AS pooled FROM s GROUP BY fly),
 m AS (SELECT fly, median(bm) AS mm, quantile_cont(bm, 0.1) AS p10, quantile_cont(bm, 0.9) AS p90, stddev_pop(bm) AS sd, avg(bm) AS av, count(*) AS nb, sum(n) AS ns FROM b GROUP BY fly),
 d AS (SELECT fly, median(abs(bm - mm)) AS mad FROM b JOIN m USING (fly) GROUP BY fly),
 o AS (SELECT b.fly, bout, mad > 0 AND abs(bm - pooled) > 1.5 * mad AS isout FROM b JOIN p USING (fly) JOIN d USING (fly)),
 k AS (SELECT fly, bout, NOT isout OR count(*) FILTER (isout) OVER (PARTITION BY fly) = count(*) OVER (PARTITION BY fly) AS keep FROM o)
SELECT s.fly, round(median(v), 6) AS scale, any_value(nb) AS n_bouts, CAST(any_value(ns) AS BIGINT) AS n_samples, any_value(rej) AS n_rejected, round(any_value((p90 - p10) / mm * 100), 6) AS spread_pct, round(any_value(sd / av), 6) AS cv_across_bouts
FROM s JOIN k ON k.fly = s.fly AND k.bout = s.bout AND keep JOIN m ON m.fly = s.fly JOIN (SELECT fly, count(*) FILTER (NOT keep) AS rej FROM k GROUP BY fly) r ON r.fly = s.fly GROUP BY s.fly""")
def f11_robust_scale(spark, sf):
    v = F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_linenumber") * F.col("l_linenumber") / 100.0)
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fly"), F.col("l_linenumber").alias("bout"), v.alias("v"))
    r = SC.robust_scale(s, ["fly"], "bout", "v", mad_k=1.5)
    return r.select("fly", F.round("scale", 6).alias("scale"), "n_bouts", "n_samples", "n_rejected", F.round("spread_pct", 6).alias("spread_pct"), F.round("cv_across_bouts", 6).alias("cv_across_bouts"))


@query(f"""WITH {OBSERVED_CTE}, {_similarity_sql("SELECT track, frame, pos * 0.5 AS sx, length(kp) * 0.25 AS sy, CAST(pos % 3 AS DOUBLE) AS sz, x AS dx, y AS dy, z AS dz FROM obs WHERE x IS NOT NULL")}
SELECT track, frame, n, n >= 3 AND s IS NOT NULL AS ok, round(CASE WHEN n >= 3 AND s IS NOT NULL THEN s ELSE 10.0 END, 4) AS s FROM fit""")
def f12_rigid_fit(spark, sf):
    k = observed(keypoints(spark, sf)).where(L.valid())
    pairs = k.select(
        *KF, (F.col("pos") * 0.5).alias("sx"), (F.length("kp") * 0.25).alias("sy"), (F.col("pos") % 3).cast("double").alias("sz"), *[F.col(c).alias(f"d{c}") for c in "xyz"]
    )
    return fits.rigid_fit(pairs, KF, kp_scale=0.1).select(*KF, "n", "ok", F.round("s", 4).alias("s"))


@query(f"WITH {OBSERVED_CTE} SELECT track, frame, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM obs GROUP BY track, frame")
def f13_centroid(spark, sf):
    return observed(keypoints(spark, sf)).groupBy(*KF).agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


_SCORE = """WITH r AS (SELECT o_orderkey AS bout, CASE o_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS sex, CASE WHEN o_orderpriority = '1-URGENT' THEN 'nan_cost' END AS excl,
  o_orderstatus <> 'P' AS has_qc, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 100) / 100.0 END AS missing_fraction, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 100000 END AS reproj_ratio, o_orderkey % 3 AS n_flagged FROM orders),
 st AS (SELECT *, coalesce(nullif(concat_ws(';', 'excluded:' || excl, CASE WHEN NOT has_qc THEN 'not_fit:no qc.json (ik produced no solve)' END,
   CASE WHEN has_qc AND missing_fraction >= 0.5 THEN 'sparse:' || CAST(round_even(missing_fraction * 100, 0) AS BIGINT) || '% missing' END), ''), 'ok') AS status FROM r)"""


def score_rows(spark, sf):
    o = table(spark, sf, "orders")
    sex = F.when(F.col("o_custkey") % 3 == 0, "female").when(F.col("o_custkey") % 3 == 1, "male").otherwise("unknown")
    has = F.col("o_orderstatus") != "P"
    d = o.select(
        F.col("o_orderkey").alias("bout"), sex.alias("sex"), F.when(F.col("o_orderpriority") == "1-URGENT", "nan_cost").alias("excl"), has.alias("has_qc"),
        F.when(has, F.col("o_orderkey") % 100 / 100.0).alias("missing_fraction"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 100000).alias("reproj_ratio"),
        (F.col("o_orderkey") % 3).alias("n_flagged"),
    )
    return d.withColumn("status", qc.status_text(F.col("excl"), F.col("has_qc"), F.col("missing_fraction")))


@query(f"{_SCORE} SELECT bout, sex, status, round(missing_fraction, 6) AS missing_fraction FROM st")
def f14_scorecard_rows(spark, sf):
    return score_rows(spark, sf).select("bout", "sex", "status", F.round("missing_fraction", 6).alias("missing_fraction"))


@query(f"""{_SCORE}, ok AS (SELECT sex, reproj_ratio AS r, row_number() OVER (PARTITION BY sex ORDER BY reproj_ratio) - 1 AS i, count(*) OVER (PARTITION BY sex) AS n FROM st WHERE status = 'ok' AND reproj_ratio IS NOT NULL)
SELECT st.sex, count(*) AS n_rows, count(reproj_ratio) AS n_scored, count(*) FILTER (contains(status, 'sparse')) AS n_sparse, count(*) FILTER (contains(status, 'not_fit')) AS n_not_fit,
 CAST(sum(n_flagged) AS BIGINT) AS n_flagged, round(any_value(m.r), 6) AS median_reproj_ratio, any_value(m.n) AS n_median_over FROM st LEFT JOIN (SELECT sex, r, n FROM ok WHERE i = n // 2) m USING (sex) GROUP BY st.sex""")
def f14_scorecard_by_sex(spark, sf):
    return qc.scorecard_by_sex(score_rows(spark, sf)).withColumn("median_reproj_ratio", F.round("median_reproj_ratio", 6))


@query(f"{_SCORE} SELECT count(*) FILTER (excl IS NULL) AS n_clips, count(*) FILTER (excl IS NULL AND sex = 'male') AS n_male, count(*) FILTER (excl IS NULL AND sex = 'female') AS n_female, count(excl) AS n_excluded, count(*) FILTER (excl IS NULL AND sex = 'unknown') AS n_unknown FROM st")
def f15_dataset_counts(spark, sf):
    r = score_rows(spark, sf)
    return qc.dataset_counts(r.where(F.col("excl").isNull()), r.where(F.col("excl").isNotNull()))


@query("""WITH h AS (SELECT CASE WHEN s_suppkey % 40 = 0 THEN 'S1' ELSE s_name END AS fly_id, CASE WHEN s_nationkey = 3 THEN 400 ELSE 800 END AS hz, s_acctbal < -500 AS missing FROM supplier)
SELECT 'missing_output' AS code, fly_id AS detail FROM h WHERE missing
UNION ALL SELECT 'rate_differs', CAST(hz AS VARCHAR) FROM (SELECT DISTINCT hz FROM h WHERE NOT missing) WHERE (SELECT count(DISTINCT hz) FROM h WHERE NOT missing) > 1
UNION ALL SELECT 'duplicate_id', fly_id FROM h WHERE NOT missing GROUP BY fly_id HAVING count(*) > 1""")
def f16_pool_compatibility(spark, sf):
    s = table(spark, sf, "supplier")
    h = s.select(
        F.when(F.col("s_suppkey") % 40 == 0, "S1").otherwise(F.col("s_name")).alias("fly_id"), F.when(F.col("s_nationkey") == 3, 400).otherwise(800).alias("source_hz"),
        F.lit("v1").alias("anatomy"), (F.col("s_acctbal") < -500).alias("missing"),
    )
    return qc.pool_findings(h)


@query(f"""WITH {_LEN}, fl AS (SELECT track, a, b, frame, length, CASE WHEN length <= 2.2 THEN length END AS f FROM len)
SELECT track, a, b, round(stddev_pop(length) / avg(length), 6) AS cv_raw, round(stddev_pop(f) / avg(f), 6) AS cv_filtered, count(*) FILTER (f IS NULL) AS n_altered, count(*) AS n FROM fl GROUP BY track, a, b""")
def f42_rigidity_change(spark, sf):
    raw = lengths(spark, sf)
    r = qc.rigidity_change(raw, raw.where(F.col("length") <= 2.2), ["track"], "frame")
    return r.select("track", "a", "b", F.round("cv_raw", 6).alias("cv_raw"), F.round("cv_filtered", 6).alias("cv_filtered"), "n_altered", "n")


@query(f"""WITH {OBSERVED_CTE}, d AS (SELECT kp, CASE WHEN conf >= 0.2 THEN sqrt((x * 0.1) ** 2 + 0.0004) END AS d FROM obs WHERE x IS NOT NULL)
SELECT kp, count(*) FILTER (d IS NULL) AS n_one_sided, round(max(d), 6) AS max_diff, round(median(d), 6) AS median_diff FROM d GROUP BY kp""")
def f42_run_parity(spark, sf):
    a = observed(keypoints(spark, sf))
    b = a.where(F.col("conf") >= 0.2).withColumn("x", F.col("x") * 1.1).withColumn("y", F.col("y") + 0.02)
    r = qc.parity_report(a, b, KFP, ["kp"])
    return r.select("kp", "n_one_sided", F.round("max_diff", 6).alias("max_diff"), F.round("median_diff", 6).alias("median_diff"))


# Tracks of even number have cameras; the first segment of every ninth is squeezed to nothing, every eleventh has no fitted pose.
_FITTED = "fitted AS (SELECT track, frame, kp, x + 0.01 AS x, y, z FROM kps WHERE track % 11 <> 5)"
_QC = f"""{_ERR}, {_FITTED}, obs AS (SELECT track, frame, pos, kp, conf, CASE WHEN conf >= 0.1 THEN x END AS x, CASE WHEN conf >= 0.1 THEN y END AS y, CASE WHEN conf >= 0.1 THEN z END AS z FROM kps),
 {BONES_CTE}, len AS (SELECT p.track, p.frame, a, b, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) * CASE WHEN p.track % 9 = 4 AND a = '{BONES[0][0]}' AND b = '{BONES[0][1]}' THEN 0.001 ELSE 1 END AS length
  FROM bones JOIN obs p ON p.kp = a JOIN obs r ON r.kp = b AND r.track = p.track AND r.frame = p.frame WHERE p.x IS NOT NULL AND r.x IS NOT NULL),
 seg AS (SELECT track, a || '-' || b AS name, median(length) AS med, stddev_pop(length) / avg(length) AS cv FROM len GROUP BY track, a, b),
 ref AS (SELECT track, median(med) AS ref FROM seg WHERE med > 0 GROUP BY track),
 inv AS (SELECT track, count(*) AS n_segments, round(max(cv), 6) AS max_cv, arg_max(name, (cv, name)) AS loosest, string_agg(name, ',' ORDER BY name) FILTER (med < 0.2 * ref) AS broken FROM seg JOIN ref USING (track) GROUP BY track),
 st AS (SELECT k.track, CASE WHEN f.track IS NULL THEN 'no_pose' WHEN broken IS NOT NULL THEN 'collapsed:' || broken END AS reason FROM (SELECT DISTINCT track FROM kps) k LEFT JOIN (SELECT DISTINCT track FROM fitted) f USING (track) LEFT JOIN inv USING (track)),
 e AS (SELECT * FROM er WHERE track % 2 = 0),
 fe AS (SELECT * FROM e WHERE sh > 0 AND track % 11 <> 5),
 rp AS (SELECT f.track, round(f.px, 6) AS fitted_px, round(m.px, 6) AS measured_px, round(f.px / m.px, 6) AS ratio FROM (SELECT track, median(err) AS px FROM fe GROUP BY track) f JOIN (SELECT track, median(err) AS px FROM e WHERE sh = 0 GROUP BY track) m USING (track)),
 seen AS (SELECT track, frame, kp, x IS NOT NULL AND conf >= 0.3 AS seen FROM obs),
 gp AS (SELECT *, row_number() OVER (PARTITION BY track, kp ORDER BY frame) - row_number() OVER (PARTITION BY track, kp, seen ORDER BY frame) AS grp FROM seen),
 gr AS (SELECT track, kp, grp, count(*) AS n FROM gp WHERE NOT seen GROUP BY track, kp, grp),
 cv AS (SELECT s.track, round(s.f, 6) AS missing_fraction, coalesce(n_gaps, 0) AS n_gaps, coalesce(max_gap, 0) AS max_gap FROM (SELECT track, avg(CASE WHEN seen THEN 0.0 ELSE 1.0 END) AS f FROM seen GROUP BY track) s LEFT JOIN (SELECT track, count(*) AS n_gaps, max(n) AS max_gap FROM gr GROUP BY track) USING (track)),
 ax AS (SELECT track, frame, max(CASE WHEN kp = 'Antenna_Base' THEN x END) - max(CASE WHEN kp = 'Scutellum' THEN x END) AS dx, max(CASE WHEN kp = 'Antenna_Base' THEN y END) - max(CASE WHEN kp = 'Scutellum' THEN y END) AS dy,
   max(CASE WHEN kp = 'Antenna_Base' THEN z END) - max(CASE WHEN kp = 'Scutellum' THEN z END) AS dz, avg(z) AS height FROM fitted GROUP BY track, frame),
 rs AS (SELECT track, frame, median(err) AS residual FROM fe GROUP BY track, frame), bs AS (SELECT track, median(residual) AS base FROM rs GROUP BY track),
 po AS (SELECT track, count(*) AS n_frames, count(*) FILTER (pitch > 45) AS n_pitched, count(*) FILTER (pitch > 45 AND coalesce(residual > 3 * base, FALSE)) AS n_flagged, round(median(pitch), 6) AS pitch_median, round(quantile_cont(height, 0.95), 6) AS height_p95
   FROM (SELECT track, frame, degrees(asin(greatest(least(dz / sqrt(dx * dx + dy * dy + dz * dz), 1), -1))) AS pitch, height FROM ax) LEFT JOIN rs USING (track, frame) LEFT JOIN bs USING (track) GROUP BY track)"""


def qc_reports(spark, sf, held_out=False):
    k, o, c = keypoints(spark, sf), observations(spark, sf), cameras(spark)
    fitted = k.where(F.col("track") % 11 != 5).withColumn("x", F.col("x") + 0.01)
    with_rig = o.where(F.col("track") % 2 == 0)
    squeezed = (F.col("track") % 9 == 4) & (F.col("a") == BONES[0][0]) & (F.col("b") == BONES[0][1])
    seg = lengths(spark, sf).withColumn("length", F.col("length") * F.when(squeezed, 0.001).otherwise(1.0))
    w = G.wide(fitted, KF, ["Antenna_Base", "Scutellum"]).join(fitted.groupBy(*KF).agg(F.avg("z").alias("height")), KF)
    body = w.select(*KF, qc.axis_pitch(V.vec("Scutellum"), V.vec("Antenna_Base"), (F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("pitch"), "height")
    errors = [qc.reprojection_errors(x, with_rig, c, KFP) for x in (fitted, k)]
    loo = fits.leave_one_out(with_rig, c, KFP) if held_out else None
    return qc.qc_documents(observed(k), fitted, seg, body, ["track"], "frame", fitted_errors=errors[0], measured_errors=errors[1], held_out=loo, size=BLK)


@query(f"""WITH {_QC} SELECT st.track, n_segments, max_cv, loosest, fitted_px, measured_px, ratio, missing_fraction, n_gaps, max_gap, n_frames, n_pitched, n_flagged, pitch_median, height_p95,
 CASE WHEN rp.track IS NULL THEN '' ELSE 'reproj,' END || 'invariants,coverage,posture' AS blocks, TRUE AS structural_ok
FROM st LEFT JOIN inv USING (track) LEFT JOIN rp ON rp.track = st.track LEFT JOIN cv ON cv.track = st.track LEFT JOIN po ON po.track = st.track WHERE reason IS NULL""")
def f47_qc_document(spark, sf):
    d, _ = qc_reports(spark, sf)
    r = lambda block, *cs: [F.round(f"{block}.{c}", 6).alias(c) for c in cs]
    return d.select(
        "track", "invariants.n_segments", *r("invariants", "max_cv"), "invariants.loosest", *r("reproj", "fitted_px", "measured_px", "ratio"), *r("coverage", "missing_fraction"), "coverage.n_gaps", "coverage.max_gap",
        "posture.n_frames", "posture.n_pitched", "posture.n_flagged", *r("posture", "pitch_median", "height_p95"), F.array_join("blocks", ",").alias("blocks"), "structural_ok",
    )


@query(f"WITH {_QC} SELECT track, reason FROM st WHERE reason IS NOT NULL")
def f47_qc_refused(spark, sf):
    return qc_reports(spark, sf)[1]


@query(f"""WITH {_LEN} SELECT track, a, b, round(stddev_pop(length) / avg(length), 6) AS cv FROM len GROUP BY track, a, b ORDER BY cv DESC, track, a, b LIMIT 5""")
def h3_worst_bones(spark, sf):
    cv = lengths(spark, sf).groupBy("track", "a", "b").agg(F.round(F.stddev_pop("length") / F.avg("length"), 6).alias("cv"))
    return qc.worst(cv, "cv", ["track", "a", "b"], 5)


