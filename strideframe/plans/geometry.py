"""Names, ids and geometry queries over landmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import names as N
from strideframe.functions import vectors as V
from strideframe.functions.terrain import LabelledStairs, Stairs
from strideframe.operators import geometry as G
from strideframe.plans import sqlvec as q
from strideframe.plans.registry import query
from strideframe.plans.tables import (
    BONES, BONES_CTE, CAMERAS_CTE, KEYPOINTS_CTE, LANDMARKS, POSES_CTE, TRACKS_CTE, cameras, keypoints, pairs_of_names, poses, table, tracks,
)

KF = ["track", "frame"]
WINGS = ["Scutellum", "Antenna_Base", "WingL_base", "WingL_V12", "WingL_V13", "WingR_base", "WingR_V12", "WingR_V13"]
BODY = ["Scutellum", "T1L_ThxCx", "T1R_ThxCx", "WingL_base", "WingR_base", "EyeL", "EyeR", "Antenna_Base", "T1L_TaTip", "T1R_TaTip", "T3L_TaTip", "T3R_TaTip"]


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


EXPECTED = ["click", "error", "logout", "view"]


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT track, list_sort(list(DISTINCT label)) AS present FROM t GROUP BY track)
SELECT track, array_to_string(list_sort(list_filter(['click', 'error', 'logout', 'view'], lambda e: NOT list_contains(present, e))), ',') AS missing,
 array_to_string(list_sort(list_filter(present, lambda e: NOT list_contains(['click', 'error', 'logout', 'view'], e))), ',') AS extra FROM s""")
def b1_name_conformance(spark, sf):
    sets = tracks(spark, sf).groupBy("track").agg(F.collect_set("label").alias("present"))
    miss, extra = N.name_findings(F.col("present"), F.array(*[F.lit(e) for e in EXPECTED]))
    return sets.select("track", F.array_join(miss, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT track, string_agg(DISTINCT label, chr(10) ORDER BY label) AS names FROM t GROUP BY track)
SELECT track, substr(sha256(names), 1, 16) AS sha FROM s""")
def b2_order_digest(spark, sf):
    sets = tracks(spark, sf).groupBy("track").agg(F.array_sort(F.collect_set("label")).alias("names"))
    return sets.select("track", N.order_digest(F.col("names")).alias("sha"))


@query(f"""WITH {KEYPOINTS_CTE} SELECT kp, contains(kp, 'Wing') OR contains(kp, 'Abd') AS excluded,
 kp LIKE '%\\_ThxCx' ESCAPE '\\' OR kp LIKE '%\\_FeTi' ESCAPE '\\' OR kp = 'Scutellum' AS critical, count(*) AS n FROM kps GROUP BY ALL""")
def b5_pattern_selection(spark, sf):
    k = keypoints(spark, sf)
    return k.groupBy("kp").agg(F.count(F.lit(1)).alias("n")).select(
        "kp", N.contains_any(F.col("kp"), ["Wing", "Abd"]).alias("excluded"), N.glob_any(F.col("kp"), ["Scutellum", "*_ThxCx", "*_FeTi"]).alias("critical"), "n"
    )


@query(f"""WITH {KEYPOINTS_CTE} SELECT CASE WHEN kp LIKE 'Antenna%' OR kp LIKE 'Eye%' THEN 'head' WHEN kp LIKE 'Scut%' THEN 'thorax' WHEN kp LIKE 'Abd%' THEN 'abdomen'
 WHEN kp LIKE 'Wing%' THEN 'wing' WHEN regexp_matches(kp, '^T[123][LR]') THEN 'leg' ELSE 'other' END AS part, count(*) AS n, round(avg(conf), 6) AS conf FROM kps GROUP BY 1""")
def b6_body_parts(spark, sf):
    k = keypoints(spark, sf)
    return k.groupBy(N.body_part(F.col("kp")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@query("""WITH ids AS (SELECT doc_id, 'S' || (doc_id % 7) || '_x/' || source || '/Frame_' || n_chars || '/fly' || (doc_id % 2) AS key FROM documents)
SELECT doc_id, regexp_matches(key, '(^|/)src1($|_|/)') AS in_session, regexp_extract(key, '^(.*)/Frame_([0-9]+)/fly([0-9]+)$', 1) AS recording,
 CAST(regexp_extract(key, '^(.*)/Frame_([0-9]+)/fly([0-9]+)$', 2) AS BIGINT) AS frame, CAST(regexp_extract(key, '^(.*)/Frame_([0-9]+)/fly([0-9]+)$', 3) AS INT) AS fly FROM ids""")
def b7_id_parsing(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("S"), F.col("doc_id") % 7, F.lit("_x/"), "source", F.lit("/Frame_"), "n_chars", F.lit("/fly"), F.col("doc_id") % 2).alias("key")
    )
    rec, frame, fly = N.frameset_parts(F.col("key"))
    return d.select("doc_id", N.session_matches(F.col("key"), "src1").alias("in_session"), rec.alias("recording"), frame.alias("frame"), fly.alias("fly"))


@query(f"""WITH {KEYPOINTS_CTE}, m AS (SELECT track, frame, kp, x, CASE WHEN split_part(kp, '_', 1) LIKE '%L' THEN regexp_replace(kp, '^([^_]*)L', '\\1R')
  WHEN split_part(kp, '_', 1) LIKE '%R' THEN regexp_replace(kp, '^([^_]*)R', '\\1L') ELSE kp END AS mirror FROM kps)
SELECT a.track, a.kp, a.mirror, round(avg(a.x + b.x), 6) AS asymmetry FROM m a JOIN m b ON a.track = b.track AND a.frame = b.frame AND a.mirror = b.kp GROUP BY ALL""")
def b8_mirror_names(spark, sf):
    from strideframe.operators.curate import mirror_table

    k = keypoints(spark, sf).select("track", "frame", "kp", "x")
    pairs = mirror_table(k.select("kp").distinct(), "kp")
    other = k.select("track", "frame", F.col("kp").alias("mirror"), F.col("x").alias("mx"))
    j = k.join(G.small_table(pairs), "kp").join(other, ["track", "frame", "mirror"])
    return j.groupBy("track", "kp", "mirror").agg(F.round(F.avg(F.col("x") + F.col("mx")), 6).alias("asymmetry"))


_CAM = [f"p[{i + 1}]" for i in range(12)]
_ROW = [f"({_CAM[4 * r]} * x + {_CAM[4 * r + 1]} * y + {_CAM[4 * r + 2]} * z + {_CAM[4 * r + 3]})" for r in range(3)]
PROJECT_SQL = f"{_ROW[0]} / nullif({_ROW[2]}, 0) AS u, {_ROW[1]} / nullif({_ROW[2]}, 0) AS v"


@query(f"""WITH {KEYPOINTS_CTE}, {CAMERAS_CTE}, pr AS (SELECT track, frame, kp, camera, {PROJECT_SQL} FROM kps, cams)
SELECT track, frame, kp, camera, round(u, 6) AS u, round(v, 6) AS v FROM pr""")
def c1_project(spark, sf):
    p = G.project(keypoints(spark, sf), cameras(spark))
    return p.select("track", "frame", "kp", "camera", *r6("u", "v"))


# One row per bone straight from the flat coordinates of a frame.
_BONE_POS = "(VALUES " + ", ".join(f"('{a}', '{b}', {LANDMARKS.index(a)}, {LANDMARKS.index(b)})" for a, b in BONES) + ") AS b(a, b, i, j)"
_BONE_D = " + ".join(f"pow(CAST(e[i * 3 + {k}] AS DOUBLE) - CAST(e[j * 3 + {k}] AS DOUBLE), 2)" for k in (1, 2, 3))


@query(f"WITH {POSES_CTE} SELECT track, frame, a, b, round(sqrt({_BONE_D}), 6) AS length FROM pose, {_BONE_POS}")
def c2_segment_lengths(spark, sf):
    out = G.segment_lengths(keypoints(spark, sf), KF, pairs_of_names(spark, BONES))
    return out.select(*KF, "a", "b", F.round("length", 6).alias("length"))


@query(f"""WITH {KEYPOINTS_CTE}, w AS ({q.pivot(WINGS)}) SELECT track, frame, round({q.angle(q.sub(q.v('Antenna_Base'), q.v('Scutellum')), q.sub(q.v('WingL_V13'), q.v('WingR_V13')))}, 6) AS angle FROM w""")
def c3_vector_angle(spark, sf):
    w = G.wide(keypoints(spark, sf), KF, WINGS)
    a = V.angle_deg(V.sub(V.vec("Antenna_Base"), V.vec("Scutellum")), V.sub(V.vec("WingL_V13"), V.vec("WingR_V13")))
    return w.select(*KF, F.round(a, 6).alias("angle"))


def _ext(s):
    return q.angle(q.sub(q.v("Antenna_Base"), q.v("Scutellum")), q.sub(q.mid(q.v(f"Wing{s}_V12"), q.v(f"Wing{s}_V13")), q.v(f"Wing{s}_base")))


def _hor(s):
    flat = q.v(f"flat{s}")
    return f"degrees(atan2(abs({q.dot(flat, q.v('lat'))}), abs({q.dot(flat, q.v('fwd'))})))"


def _flat(s):
    return q.named(q.reject(q.sub(q.mid(q.v(f"Wing{s}_V12"), q.v(f"Wing{s}_V13")), q.v(f"Wing{s}_base")), q.v("dor")), f"flat{s}")


@query(f"""WITH {KEYPOINTS_CTE}, w AS ({q.pivot(WINGS)}),
 f AS (SELECT *, {q.named(q.unit(q.sub(q.v('Antenna_Base'), q.v('Scutellum'))), 'fwd')} FROM w),
 d AS (SELECT *, {q.named(q.unit(q.cross(q.v('fwd'), q.sub(q.v('WingR_base'), q.v('WingL_base')))), 'dor')} FROM f),
 l AS (SELECT *, {q.named(q.unit(q.cross(q.v('dor'), q.v('fwd'))), 'lat')}, {_flat('L')}, {_flat('R')} FROM d)
SELECT track, frame, round({_ext('L')}, 6) AS ext_l, round({_ext('R')}, 6) AS ext_r, round({_hor('L')}, 6) AS hor_l, round({_hor('R')}, 6) AS hor_r FROM l""")
def c4_wing_angles(spark, sf):
    w = G.wing_horizontal(G.wing_extension(G.wide(keypoints(spark, sf), KF, WINGS)))
    return w.select(*KF, *r6("ext_l", "ext_r", "hor_l", "hor_r"))


_QN = "sqrt(CAST(e[61] AS DOUBLE) * e[61] + CAST(e[62] AS DOUBLE) * e[62] + CAST(e[63] AS DOUBLE) * e[63] + CAST(e[64] AS DOUBLE) * e[64])"
QUAT_CTE = f"""{POSES_CTE}, quat AS (SELECT track, frame, CAST(e[10] AS DOUBLE) AS bx0, CAST(e[11] AS DOUBLE) AS by0, CAST(e[12] AS DOUBLE) AS bz0,
 {', '.join(f'e[{61 + i}] / {_QN} AS q{c}' for i, c in enumerate('wxyz'))} FROM pose)"""


def body_poses(spark, sf):
    p = poses(spark, sf)
    e = [F.element_at("e", i) for i in range(61, 65)]
    n = F.sqrt(sum((c * c for c in e[1:]), e[0] * e[0]))
    return p.select(*KF, *[F.element_at("e", 10 + i).alias(c) for i, c in enumerate(("bx0", "by0", "bz0"))], *[(c / n).alias(f"q{a}") for c, a in zip(e, "wxyz")])


@query(f"""WITH {KEYPOINTS_CTE}, w AS ({q.pivot(WINGS + ['Abd_tip'])}),
 qq AS (SELECT track, frame, {', '.join(f'e[{61 + i}] / {_QN} AS q{c}' for i, c in enumerate('wxyz'))} FROM pose)
SELECT w.track, w.frame, round(degrees(asin({q.clip(f'{q.sub(q.v("Antenna_Base"), q.v("Scutellum"))[2]} / nullif({q.dist(q.v("Antenna_Base"), q.v("Scutellum"))}, 0)')})), 6) AS axis_pitch,
 round(degrees(asin({q.clip('2.0 * (qx * qz - qw * qy)')})), 6) AS quat_pitch,
 round({q.angle(q.sub(q.v('Antenna_Base'), q.v('Scutellum')), q.sub(q.v('Scutellum'), q.v('Abd_tip')))}, 6) AS abdomen_angle FROM w JOIN qq USING (track, frame)""")
def c5_pitch(spark, sf):
    w = G.wide(keypoints(spark, sf), KF, [*WINGS, "Abd_tip"]).join(body_poses(spark, sf), KF)
    axis = V.sub(V.vec("Antenna_Base"), V.vec("Scutellum"))
    return w.select(
        *KF,
        F.round(V.elevation_deg(axis), 6).alias("axis_pitch"),
        F.round(G.quat_pitch_deg(*[F.col(f"q{c}") for c in "wxyz"]), 6).alias("quat_pitch"),
        F.round(V.angle_deg(axis, V.sub(V.vec("Scutellum"), V.vec("Abd_tip"))), 6).alias("abdomen_angle"),
    )


_D = ("(x - bx0)", "(y - by0)", "(z - bz0)")
_RT = [
    ("(1 - 2 * (qy * qy + qz * qz))", "(2 * (qx * qy + qw * qz))", "(2 * (qx * qz - qw * qy))"),
    ("(2 * (qx * qy - qw * qz))", "(1 - 2 * (qx * qx + qz * qz))", "(2 * (qy * qz + qw * qx))"),
    ("(2 * (qx * qz + qw * qy))", "(2 * (qy * qz - qw * qx))", "(1 - 2 * (qx * qx + qy * qy))"),
]
_KQ = KEYPOINTS_CTE + QUAT_CTE.replace(POSES_CTE, "")


@query(f"WITH {_KQ} SELECT track, frame, kp, round({q.dot(_RT[0], _D)}, 6) AS ex, round({q.dot(_RT[1], _D)}, 6) AS ey, round({q.dot(_RT[2], _D)}, 6) AS ez FROM kps JOIN quat USING (track, frame)")
def c6_egocentric(spark, sf):
    e = G.egocentric(keypoints(spark, sf), body_poses(spark, sf), KF)
    return e.select(*KF, "kp", *r6("ex", "ey", "ez"))


@query(f"""WITH {_KQ}, f AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS fx, 2 * (qx * qy + qw * qz) AS fy, 2 * (qx * qz - qw * qy) AS fz FROM kps JOIN quat USING (track, frame))
SELECT track, frame, kp, round(degrees(asin({q.clip('-fz')})), 6) AS pitch, round(((x - bx0) * fx + (y - by0) * fy) / sqrt(fx * fx + fy * fy), 6) AS anterior,
 round((-(x - bx0) * fy + (y - by0) * fx) / sqrt(fx * fx + fy * fy), 6) AS lateral FROM f""")
def c7_levelled(spark, sf):
    out = G.levelled(keypoints(spark, sf), body_poses(spark, sf), KF)
    return out.select(*KF, "kp", *r6("pitch", "anterior", "lateral"))


def _local(n):
    rel = q.sub(q.v(n), q.v("Scutellum"))
    return ", ".join(f'{q.dot(rel, q.v(a))} AS "l{n}_{c}"' for a, c in zip(("bx", "by", "bz"), "xyz"))


_FRAMES_SQL = f"""w AS ({q.pivot(BODY)}),
 a AS (SELECT *, {q.named(q.unit(q.sub(q.mid(q.v('T1L_ThxCx'), q.v('T1R_ThxCx')), q.v('Scutellum'))), 'bx')}, {q.named(q.unit(q.sub(q.v('EyeL'), q.v('EyeR'))), 'hy')} FROM w),
 b0 AS (SELECT *, {q.named(q.reject(q.sub(q.v('WingL_base'), q.v('WingR_base')), q.v('bx')), 'br')},
   {q.named(q.reject(q.sub(q.v('Antenna_Base'), q.mid(q.v('EyeL'), q.v('EyeR'))), q.v('hy')), 'hr')} FROM a),
 b1 AS (SELECT *, {q.named(q.unit(q.v('br')), 'by')}, {q.named(q.unit(q.v('hr')), 'hx')} FROM b0),
 b2 AS (SELECT *, {q.named(q.cross(q.v('bx'), q.v('by')), 'bz')}, {q.named(q.cross(q.v('hx'), q.v('hy')), 'hz')} FROM b1)"""
_ROLL = f"degrees(atan2({q.dot(q.v('hy'), q.v('bz'))}, {q.dot(q.v('hz'), q.v('bz'))}))"


@query(f"""WITH {KEYPOINTS_CTE}, {_FRAMES_SQL} SELECT track, frame, round(degrees(-asin({q.clip(q.dot(q.v('hx'), q.v('bz')))})), 6) AS head_pitch,
 round(degrees(atan2({q.dot(q.v('hx'), q.v('by'))}, {q.dot(q.v('hx'), q.v('bx'))})), 6) AS head_yaw, round({_ROLL}, 6) AS head_roll,
 round({q.dot(q.sub(q.v('T3L_TaTip'), q.v('Scutellum')), q.v('bx'))}, 6) AS hind_l_x, round({q.dot(q.sub(q.v('T3L_TaTip'), q.v('Scutellum')), q.v('by'))}, 6) AS hind_l_y FROM b2""")
def c8_landmark_features(spark, sf):
    w = G.body_local(G.head_angles(G.body_frame(G.wide(keypoints(spark, sf), KF, BODY))), ["T3L_TaTip"])
    return w.select(*KF, *r6("head_pitch", "head_yaw", "head_roll"), F.round("T3L_TaTip_x", 6).alias("hind_l_x"), F.round("T3L_TaTip_y", 6).alias("hind_l_y"))


@query(f"""WITH {KEYPOINTS_CTE}, {_FRAMES_SQL}, c AS (SELECT *, {_local('Antenna_Base')}, {_local('EyeL')}, {_local('EyeR')}, {_local('T1L_TaTip')}, {_local('T1R_TaTip')} FROM b2)
SELECT track, frame, round("lT1L_TaTip_y", 6) AS y_l, round({q.dist(q.v('lT1L_TaTip'), q.v('lEyeL'))}, 6) AS d_ll, round({q.dist(q.v('lT1R_TaTip'), q.v('lEyeR'))}, 6) AS d_rr,
 round(least({q.dist(q.v('lT1L_TaTip'), q.v('lAntenna_Base'))}, {q.dist(q.v('lT1R_TaTip'), q.v('lAntenna_Base'))}), 6) AS d_ant,
 round("lT1R_TaTip_z" - "lAntenna_Base_z", 6) AS dz_r, round(sqrt(("lT1L_TaTip_x" - "lT1R_TaTip_x") ** 2 + ("lT1L_TaTip_y" - "lT1R_TaTip_y") ** 2), 6) AS gap_xy, round({_ROLL}, 6) AS roll FROM c""")
def c8_event_features(spark, sf):
    w = G.grooming_quantities(G.body_frame(G.wide(keypoints(spark, sf), KF, BODY)))
    return w.select(*KF, *r6("y_l", "d_ll", "d_rr", "d_ant", "dz_r", "gap_xy", "roll"))


@query(f"""WITH {_KQ}, s AS (SELECT track, frame, kp, x, y, z, bx0, by0, bz0, 1 + abs(qw) AS s, cos(qx) AS c, sin(qx) AS n FROM kps JOIN quat USING (track, frame)),
 w AS (SELECT *, s * (c * x - n * y) + bx0 AS wx, s * (n * x + c * y) + by0 AS wy, s * z + bz0 AS wz FROM s)
SELECT track, frame, kp, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, round(x, 6) AS mx, round(y, 6) AS my, round(z, 6) AS mz FROM w""")
def c9_similarity_round_trip(spark, sf):
    j = keypoints(spark, sf).join(body_poses(spark, sf), KF)
    s, c, n, zero, one = 1 + F.abs("qw"), F.cos("qx"), F.sin("qx"), F.lit(0.0), F.lit(1.0)
    rot, t = [c, -n, zero, n, c, zero, zero, zero, one], (F.col("bx0"), F.col("by0"), F.col("bz0"))
    world = G.apply_similarity((F.col("x"), F.col("y"), F.col("z")), s, rot, t)
    j = j.select("*", *[a.alias(b) for a, b in zip(world, ("wx", "wy", "wz"))])
    back = G.invert_similarity((F.col("wx"), F.col("wy"), F.col("wz")), s, rot, t)
    j = j.select("*", *[a.alias(b) for a, b in zip(back, ("mx", "my", "mz"))])
    return j.select(*KF, "kp", *r6("wx", "wy", "wz", "mx", "my", "mz"))


@query(f"""WITH {KEYPOINTS_CTE}, h AS (SELECT track, frame, kp, 0.36 * x + 0.48 * y + 0.8 * z + 0.25 AS h FROM kps),
 f AS (SELECT track, quantile_cont(z, 0.05) AS floor_z FROM kps WHERE kp LIKE '%TaTip' GROUP BY track)
SELECT h.track, h.frame, h.kp, round(h.h, 6) AS height, round(k.z - floor_z, 6) AS above_floor FROM h JOIN kps k USING (track, frame, kp) JOIN f ON f.track = h.track""")
def c10_plane_height(spark, sf):
    from strideframe.operators.quantiles import exact_quantiles

    k = keypoints(spark, sf)
    floor = exact_quantiles(k.where(N.glob_any(F.col("kp"), ["*TaTip"])), ["track"], "z", {"floor_z": 0.05})
    h = G.plane_height((F.col("x"), F.col("y"), F.col("z")), (F.lit(0.36), F.lit(0.48), F.lit(0.8)), F.lit(0.25))
    return k.join(floor, "track").select(*KF, "kp", F.round(h, 6).alias("height"), F.round(F.col("z") - F.col("floor_z"), 6).alias("above_floor"))


CO = ["Scutellum", "Abd_tip", "WingL_base", "WingL_V13", "WingR_base", "WingR_V13"]


def pose_features(spark, sf):
    k = keypoints(spark, sf)
    cen = k.groupBy(*KF).agg(F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("centroid"))
    return G.wide(k, KF, CO).join(cen, KF)


def _wing(s):
    return q.angle(q.sub(q.v("Abd_tip"), q.v("Scutellum")), q.sub(q.v(f"Wing{s}_V13"), q.v(f"Wing{s}_base")))


_CO_CTE = f"""w0 AS ({q.pivot(CO)}), cen AS (SELECT track, frame, avg(x) AS "c_x", avg(y) AS "c_y", avg(z) AS "c_z" FROM kps GROUP BY track, frame),
 w AS (SELECT * FROM w0 JOIN cen USING (track, frame))"""


@query(f"""WITH {KEYPOINTS_CTE}, {_CO_CTE}, p AS (SELECT *, lag(c_x) OVER o AS "p_x", lag(c_y) OVER o AS "p_y", lag(c_z) OVER o AS "p_z" FROM w WINDOW o AS (PARTITION BY track ORDER BY frame))
SELECT track, frame, round(greatest({_wing('L')}, {_wing('R')}), 6) AS wing_angle_deg, round(c_z + 0.5, 6) AS height, round({q.dist(q.v('c'), q.v('p'))}, 6) AS speed FROM p""")
def c11_behaviour_features(spark, sf):
    out = G.coarse_features(pose_features(spark, sf), ["track"], "frame", floor_normal=(0, 0, 1), floor_offset=0.5, size=16)
    return out.select(*KF, *r6("wing_angle_deg", "height", "speed"))


@query(f"""WITH {KEYPOINTS_CTE}, {_CO_CTE} SELECT a.track // 2 AS bout, a.frame, round({q.dist(('a.c_x', 'a.c_y', 'a.c_z'), ('b.c_x', 'b.c_y', 'b.c_z'))}, 6) AS dist,
 round({q.angle(tuple(f'(b."Scutellum_{c}" - b."Abd_tip_{c}")' for c in 'xyz'), tuple(f'(a.c_{c} - b.c_{c})' for c in 'xyz'))}, 6) AS heading_deg
FROM w a JOIN w b ON b.track = a.track + 1 AND b.frame = a.frame WHERE a.track % 2 = 0""")
def c11_pair_features(spark, sf):
    w = pose_features(spark, sf).withColumn("bout", F.floor(F.col("track") / 2)).withColumn("fly", F.col("track") % 2)
    return G.pair_features(w, ["bout"], "fly", "frame").select("bout", "frame", *r6("dist", "heading_deg"))


@query("SELECT p_partkey, round(p_retailprice / 900.0 / (p_size / 20.0) * 0.1, 6) AS implied_mm, (p_retailprice / 900.0 / (p_size / 20.0) * 0.1) BETWEEN 0.1 AND 0.3 AS plausible FROM part")
def c12_unit_scale(spark, sf):
    from strideframe.operators.scale import implied_length_mm

    p = table(spark, sf, "part")
    mm = implied_length_mm(F.col("p_retailprice") / 900.0, F.col("p_size") / 20.0)
    return p.select("p_partkey", F.round(mm, 6).alias("implied_mm"), mm.between(0.1, 0.3).alias("plausible"))


_ST = Stairs(period=8.0, step=0.5, levels=(0, 1, 2, 1), x0=0.25, z0=-0.5)
_LST = LabelledStairs(period=8.0, bounds=(0.0, 1.75, 2.25, 3.75, 4.25, 5.75, 6.25, 7.5), levels=(-0.5, 0.0, 0.5, 0.0), x0=0.25)


def _lev(i):
    return f"([0, 1, 2, 1])[CAST((({i}) % 4 + 4) % 4 AS INT) + 1]"


def _near(z, lo, hi):
    return f"least(greatest({z}, {lo}), {hi})"


def _surf():
    out = []
    for d in range(-2, 3):
        k, e = f"(k0 + {d})", f"(0.25 + (k0 + {d}) * 2.0)"
        zk, zp = f"(-0.5 + 0.5 * {_lev(k)})", f"(-0.5 + 0.5 * {_lev(f'{k} - 1')})"
        out.append(f"sqrt(greatest({e} - fx, fx - ({e} + 2.0), 0) ** 2 + (fz - {zk}) ** 2)")
        out.append(f"sqrt((fx - {e}) ** 2 + (fz - {_near('fz', f'least({zp}, {zk})', f'greatest({zp}, {zk})')}) ** 2)")
    return f"least({', '.join(out)})"


def _lsurf():
    out = []
    for t in (-1, 0, 1):
        qx = f"(ph * 8.0 + {t * 8.0})"
        for i in range(4):
            a, b = _LST.bounds[2 * i], _LST.bounds[2 * i + 1]
            out.append(f"sqrt(greatest({a} - {qx}, {qx} - {b}, 0) ** 2 + (fz - {_LST.levels[i]}) ** 2)")
            riser = (b + (_LST.bounds[2 * i + 2] if i < 3 else 8.0)) / 2
            lo, hi = sorted((_LST.levels[i], _LST.levels[(i + 1) % 4]))
            out.append(f"sqrt(({qx} - {riser}) ** 2 + (fz - {_near('fz', lo, hi)}) ** 2)")
    return f"least({', '.join(out)})"


def _over(o):
    return f"(fz - (-0.5 + 0.5 * {_lev(f'qi + {o}')}))"


@query(f"""WITH {TRACKS_CTE}, f AS (SELECT track, frame, v / 7.3 AS fx, conf * 1.9 - 1.0 AS fz FROM t),
 g AS (SELECT *, (((fx - 0.25) % 8.0 + 8.0) % 8.0) / 8.0 AS ph, floor((fx - 0.25) / 2.0) AS k0 FROM f),
 h AS (SELECT *, floor(ph * 4) AS qi, least((ph * 4) % 1, 1 - (ph * 4) % 1) * 2.0 AS edge FROM g)
SELECT track, frame, round(ph, 6) AS phase, {_lev('qi')} AS level, round(-0.5 + 0.5 * {_lev('qi')}, 6) AS surface_z, round(edge, 6) AS edge_dist,
 round(CASE WHEN edge > 0.18 THEN {_over(0)} WHEN abs({_over(-1)}) <= abs({_over(0)}) AND abs({_over(-1)}) <= abs({_over(1)}) THEN {_over(-1)}
   WHEN abs({_over(0)}) <= abs({_over(1)}) THEN {_over(0)} ELSE {_over(1)} END, 6) AS clearance, round({_surf()}, 6) AS surf_dist, round({_lsurf()}, 6) AS labelled_dist FROM h""")
def c13_terrain(spark, sf):
    t = tracks(spark, sf).select("track", "frame", (F.col("v") / 7.3).alias("fx"), (F.col("conf") * 1.9 - 1.0).alias("fz"))
    x, z = F.col("fx"), F.col("fz")
    cols = {
        "phase": _ST.phase(x), "level": _ST.level(x), "surface_z": _ST.height(x), "edge_dist": _ST.edge_distance(x),
        "clearance": _ST.clearance(x, z, 0.18), "surf_dist": _ST.surface_distance(x, z), "labelled_dist": _LST.surface_distance(x, z),
    }
    return t.select("track", "frame", *[(c if n == "level" else F.round(c, 6)).alias(n) for n, c in cols.items()])


@query(f"""WITH {TRACKS_CTE} SELECT a.frame, a.track, round(atan2(sin((a.v - b.v) / 20.0), cos((a.v - b.v) / 20.0)), 6) AS rel_phase
FROM t a JOIN t b ON b.track = a.track - a.track % 6 AND b.frame = a.frame""")
def c14_relative_phase(spark, sf):
    from strideframe.operators.gait import relative_phase

    t = tracks(spark, sf).select(F.floor(F.col("track") / 6).alias("animal"), (F.col("track") % 6).alias("leg"), "track", "frame", (F.col("v") / 20.0).alias("phase"))
    out = relative_phase(t, ["animal", "frame"], "leg", "phase", reference=0)
    return out.select("track", "frame", F.round("rel_phase", 6).alias("rel_phase"))


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT track // 6 AS animal, frame, abs(atan2(sin(v / 20.0), cos(v / 20.0))) >= pi() / 2 AS stance FROM t)
SELECT animal, frame, CAST(sum(CASE WHEN stance THEN 1 ELSE 0 END) AS BIGINT) AS n_legs_stance FROM p GROUP BY ALL""")
def c15_stance_count(spark, sf):
    from strideframe.operators.gait import legs_in_stance, stance_from_phase

    t = tracks(spark, sf).select(F.floor(F.col("track") / 6).alias("animal"), "frame", V.wrap(F.col("v") / 20.0).alias("phase"))
    return legs_in_stance(stance_from_phase(t, "phase"), ["animal", "frame"])


@query(f"""WITH {KEYPOINTS_CTE}, {BONES_CTE} SELECT DISTINCT a, b FROM bones WHERE a IN (SELECT kp FROM kps) AND b IN (SELECT kp FROM kps)""")
def e8_skeleton_edges(spark, sf):
    from strideframe.operators.skeleton import present_edges

    return present_edges(keypoints(spark, sf), pairs_of_names(spark, BONES))


@query(f"""WITH {KEYPOINTS_CTE}, {CAMERAS_CTE}, pr AS (SELECT camera, {PROJECT_SQL} FROM kps, cams)
SELECT camera, count(*) AS n, round(min(u), 6) AS u_min, round(max(u), 6) AS u_max, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max FROM pr GROUP BY camera""")
def e2_camera_extent(spark, sf):
    p = G.project(keypoints(spark, sf), cameras(spark))
    return p.groupBy("camera").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(f(c), 6).alias(f"{c}_{t}") for c in "uv" for f, t in ((F.min, "min"), (F.max, "max"))]
    )


