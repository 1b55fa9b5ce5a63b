"""Pose-series, song and augmentation queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from strideframe.operators import geometry as G
from strideframe.operators import motion as M
from strideframe.operators.select import hash_uniform
from strideframe.plans.geometry import _QN, body_poses
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.statistics import _hash_sql
from strideframe.plans.tables import KEYPOINTS_CTE, POSES_CTE, TRACKS_CTE, keypoints, poses, table, tracks
from strideframe.plans.walking import _CY, click_cycles

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
K = ["track"]
KF = ["track", "frame"]


def r6(df, *plain):
    return df.select(*[c if c in plain else F.round(c, 6).alias(c) for c in df.columns])


_QS = f"""{POSES_CTE}, qs AS (SELECT track, frame, CAST(e[10] AS DOUBLE) AS x, {', '.join(f'e[{61 + i}] / {_QN} AS q{c}' for i, c in enumerate('wxyz'))} FROM pose)"""


@query(f"""WITH {_QS}, n AS (SELECT *, {', '.join(f'coalesce(lead({c}) OVER w, {c}) AS n{c}' for c in ('x', 'qw', 'qx', 'qy', 'qz'))} FROM qs WINDOW w AS (PARTITION BY track ORDER BY frame)),
 d0 AS (SELECT *, qw * nqw + qx * nqx + qy * nqy + qz * nqz AS dw, qw * nqx - qx * nqw - qy * nqz + qz * nqy AS dx, qw * nqy + qx * nqz - qy * nqw - qz * nqx AS dy, qw * nqz - qx * nqy + qy * nqx - qz * nqw AS dz FROM n),
 d1 AS (SELECT track, frame, (nx - x) / 0.5 AS vx, {', '.join(f'd{c} / sqrt(dw * dw + dx * dx + dy * dy + dz * dz) AS u{c}' for c in 'wxyz')} FROM d0),
 a AS (SELECT *, ((2 * acos(greatest(least(uw, 1.0), -1.0)) + pi()) % (2 * pi())) - pi() AS ang, sqrt(greatest(1 - uw * uw, 0)) AS sh FROM d1)
SELECT track, frame, round(vx, 6) AS vx, {', '.join(f'round(CASE WHEN sh > 1e-7 THEN u{c} / sh * ang / 0.5 ELSE 0 END, 6) AS w{c}' for c in 'xyz')} FROM a""")
def g9_pose_velocity(spark, sf):
    b = body_poses(spark, sf).withColumnsRenamed({"bx0": "x", "by0": "y", "bz0": "z"})
    v = M.pose_velocity(b, K, "frame", dt=0.5, size=BLK)
    return r6(v.drop("vy", "vz"), *KF)


@query(f"""WITH {TRACKS_CTE}, n AS (SELECT track, count(*) AS n, greatest(CAST(round_even(count(*) * 0.4, 0) AS BIGINT), 1) AS m FROM t GROUP BY track),
 p AS (SELECT track, unnest(range(m)) AS j, n, m FROM n), q AS (SELECT *, CASE WHEN m = 1 THEN 0 ELSE j * (n - 1) / (m - 1) END AS pos FROM p)
SELECT q.track, q.j, round(a.v / 7.3 + coalesce(b.v - a.v, 0) / 7.3 * (pos - floor(pos + 1e-9)), 6) AS x FROM q JOIN t a ON a.track = q.track AND a.frame = CAST(floor(pos + 1e-9) AS BIGINT) LEFT JOIN t b ON b.track = q.track AND b.frame = CAST(floor(pos + 1e-9) AS BIGINT) + 1""")
def g25_resample(spark, sf):
    t = tracks(spark, sf).withColumn("x", F.col("v") / 7.3)
    return r6(M.resample(t, K, "frame", ["x"], ratio=0.4, size=BLK), "track", "j")


_Q4 = ("qw", "qx", "qy", "qz")
_MIX = {c: f"(a.{c} + coalesce(b.{c} - a.{c}, 0) * w)" for c in _Q4}
_MIXN = "sqrt(" + " + ".join(f"{m} * {m}" for m in _MIX.values()) + ")"


@query(f"""WITH {_QS}, g AS (SELECT *, {' + '.join(f'{c} * lag({c}) OVER w' for c in _Q4)} AS d FROM qs WINDOW w AS (PARTITION BY track ORDER BY frame)),
 k AS (SELECT track, frame, {', '.join(_Q4)}, CASE WHEN sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) % 2 = 1 THEN -1 ELSE 1 END AS sg FROM g),
 q AS (SELECT track, frame, {', '.join(f'{c} * sg AS {c}' for c in _Q4)} FROM k), n AS (SELECT track, count(*) AS n, greatest(CAST(round_even(count(*) * 1.7, 0) AS BIGINT), 1) AS m FROM q GROUP BY track),
 p AS (SELECT track, unnest(range(m)) AS j, n, m FROM n), r AS (SELECT track, j, j * (n - 1) / (m - 1) AS pos FROM p), f AS (SELECT track, j, CAST(floor(pos + 1e-9) AS BIGINT) AS f, pos - floor(pos + 1e-9) AS w FROM r)
SELECT f.track, f.j, {', '.join(f'round({_MIX[c]} / {_MIXN}, 6) AS {c}' for c in _Q4)} FROM f JOIN q a ON a.track = f.track AND a.frame = f.f LEFT JOIN q b ON b.track = f.track AND b.frame = f.f + 1""")
def g25_resample_quaternion(spark, sf):
    b = body_poses(spark, sf)
    return r6(M.resample(b, K, "frame", ["qw", "qx", "qy", "qz"], ratio=1.7, quaternion=True, size=BLK), "track", "j")


_PAIR = f"""{TRACKS_CTE}, p AS (SELECT a.track // 2 AS bout, a.frame, a.v AS va, b.v AS vb FROM t a JOIN t b ON b.track = a.track + 1 AND b.frame = a.frame WHERE a.track % 2 = 0)"""


@query(f"""WITH {_PAIR}, f AS (SELECT *, abs(va - lag(va) OVER w) + abs(vb - lag(vb) OVER w) - abs(vb - lag(va) OVER w) - abs(va - lag(vb) OVER w) > 1.0 AS flip FROM p WINDOW w AS (PARTITION BY bout ORDER BY frame)),
 k AS (SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY bout ORDER BY frame) AS k FROM f), r AS (SELECT *, k % 2 = 1 AS odd, count(*) OVER (PARTITION BY bout, k) AS len FROM k),
 n AS (SELECT bout, count(*) FILTER (odd AND len <= 2) AS n1, count(*) FILTER (NOT odd AND len <= 2) AS n0, max(k) AS mk FROM r GROUP BY bout)
SELECT r.bout, r.frame, CASE WHEN mk > 0 AND len <= 2 AND odd = (n1 >= n0) THEN vb ELSE va END AS a, CAST(mk > 0 AND len <= 2 AND odd = (n1 >= n0) AS INT) AS swaps FROM r JOIN n USING (bout)""")
def g23_swap_repair(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 2))
    pt = lambda n: F.struct(F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias(n)
    p = t.where(F.col("track") % 2 == 0).select("bout", "frame", pt("a")).join(t.where(F.col("track") % 2 == 1).select("bout", "frame", pt("b")), ["bout", "frame"])
    out = M.repair_swaps(p, ["bout"], "frame", "a", "b", gain=1.0, max_run=2, passes=1, size=BLK)
    return out.select("bout", "frame", F.col("a.x").alias("a"), "swaps")


_WAVE = f"""{TRACKS_CTE}, w0 AS (SELECT p.track, p.frame, o.k, s.v FROM t p, (SELECT unnest(range(-3, 4)) AS k) o, t s WHERE p.conf > 0.85 AND s.track = p.track AND s.frame = p.frame + k),
 w1 AS (SELECT track, frame, avg(v) AS m, sum(v * k) / 28.0 AS s FROM w0 GROUP BY ALL HAVING count(*) = 7), w2 AS (SELECT w0.track, w0.frame, k, v - m - s * k AS r FROM w0 JOIN w1 USING (track, frame)),
 w3 AS (SELECT track, frame, sqrt(sum(r * r) / 7) AS sd, sum(CASE WHEN k = 0 THEN r END) AS c FROM w2 GROUP BY ALL),
 wv AS (SELECT w2.track, w2.frame, k, r / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END * CASE WHEN c < 0 THEN -1 ELSE 1 END AS x FROM w2 JOIN w3 USING (track, frame))"""


def waves(spark, sf):
    return M.waveforms(tracks(spark, sf).withColumn("hit", F.col("conf") > 0.85), K, "frame", "v", "hit", 3, size=BLK)


@query(f"WITH {_WAVE} SELECT track, frame, k + 3 AS i, round(x, 6) AS x FROM wv")
def g26_waveforms(spark, sf):
    return waves(spark, sf).select("track", "frame", F.posexplode("wave").alias("i", "x")).withColumn("x", F.round("x", 6))


_DFT = ", ".join(f"sqrt(sum(x * cos(2 * pi() * {k} * (k + 3) / 7)) ** 2 + sum(x * sin(2 * pi() * {k} * (k + 3) / 7)) ** 2) AS m{k}" for k in range(4))
_TOP = "greatest(m0, m1, m2, m3) * 0.3679"


@query(f"""WITH {_WAVE}, s AS (SELECT a.track, a.frame, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS sym FROM wv a JOIN wv b ON b.track = a.track AND b.frame = a.frame AND b.k = -a.k WHERE a.k < 0 GROUP BY ALL),
 d AS (SELECT track, frame, {_DFT} FROM wv GROUP BY ALL), i AS (SELECT track, frame, frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) AS ipi FROM d)
SELECT d.track, d.frame, round(sym, 6) AS symmetry, round(({' + '.join(f'CASE WHEN m{k} >= {_TOP} THEN m{k} * {k * 800 / 7!r} ELSE 0 END' for k in range(4))}) / ({' + '.join(f'CASE WHEN m{k} >= {_TOP} THEN m{k} ELSE 0 END' for k in range(4))}), 6) AS carrier_hz,
 round(ipi / 0.8, 6) AS ipi_ms FROM d JOIN s USING (track, frame) JOIN i USING (track, frame)""")
def f37_pulse_features(spark, sf):
    from strideframe.operators.ordered import scan

    w = waves(spark, sf)
    w = scan(w, K, "frame", before={"_p": F.col("frame")}, size=BLK)
    return w.select(
        *KF, F.round(M.wave_symmetry(F.col("wave"), 7), 6).alias("symmetry"), F.round(M.wave_centre_hz(F.col("wave"), 7, 800.0), 6).alias("carrier_hz"), F.round((F.col("frame") - F.col("_p")) / 0.8, 6).alias("ipi_ms")
    )


@query(f"""WITH {TRACKS_CTE}, a AS (SELECT track, frame, conf, avg(abs(CASE WHEN conf >= 0.1 THEN v - 60 END)) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM t)
SELECT track, frame, round(m, 6) AS wing_angle FROM a WHERE conf > 0.85""")
def f37_wing_angle(spark, sf):
    t = tracks(spark, sf).withColumn("angle", F.when(F.col("conf") >= 0.1, F.col("v") - 60))
    return r6(M.pulse_wing_angle(t, t.where(F.col("conf") > 0.85).select(*KF), K, "frame", "angle", half=10, size=BLK), *KF)


@query(f"""WITH {_CY}, d AS (SELECT track, cycle, frame, v / 7.3 AS x, conf * 3.1 AS y FROM cyc WHERE cycle IS NOT NULL), s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM d WINDOW w AS (PARTITION BY track, cycle ORDER BY frame)),
 l AS (SELECT *, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS len FROM s), c AS (SELECT *, sum(len) OVER (PARTITION BY track, cycle ORDER BY frame) AS b, sum(len) OVER (PARTITION BY track, cycle) AS tot FROM l),
 p AS (SELECT c.*, i FROM c, (SELECT unnest(range(8)) AS i) WHERE tot > 0 AND len > 0 AND i >= (b - len) * 8 / tot - 1e-9 AND i < b * 8 / tot - 1e-9)
SELECT track, cycle, i, round(x + (nx - x) * greatest(least((i * tot / 8 - (b - len)) / len, 1), 0), 6) AS x, round(y + (ny - y) * greatest(least((i * tot / 8 - (b - len)) / len, 1), 0), 6) AS y FROM p""")
def g27_loop_resample(spark, sf):
    d = click_cycles(spark, sf).where(F.col("cycle").isNotNull()).select("track", "cycle", "frame", (F.col("v") / 7.3).alias("x"), (F.col("conf") * 3.1).alias("y"))
    return r6(M.resample_loop(d, ["track", "cycle"], "frame", "x", "y", 8, size=BLK), "track", "cycle", "i")


@query(f"""WITH {TRACKS_CTE}, l AS (SELECT *, max(CASE WHEN conf >= 0.7 THEN frame END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM t)
SELECT l.track, l.frame, l.frame - lf - 1 AS age, CASE WHEN l.frame - lf - 1 < 4 THEN g.v END AS carried, CASE WHEN l.frame - lf - 1 = 0 THEN 'track' WHEN l.frame - lf - 1 < 4 THEN 'reused' END AS source FROM l LEFT JOIN t g ON g.track = l.track AND g.frame = lf""")
def g30_carried_positions(spark, sf):
    t = tracks(spark, sf).withColumn("p", F.when(F.col("conf") >= 0.7, F.col("v")))
    return M.carried_positions(t, K, "frame", "p", max_reuse=4, size=BLK).select(*KF, "age", "carried", "source")


@query(f"""WITH {TRACKS_CTE}, d AS (SELECT track // 4 AS rec, frame, track, v AS x, conf * 20 AS y FROM t WHERE track % 4 < 2), a AS (SELECT track // 4 AS rec, frame, v AS x, conf * 20 AS y FROM t WHERE track % 4 >= 2)
SELECT rec, frame, track FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rec = d.rec AND a.frame = d.frame AND sqrt((a.x - d.x) ** 2 + (a.y - d.y) ** 2) < 30)""")
def e20_redetections(spark, sf):
    t = tracks(spark, sf).select(F.floor(F.col("track") / 4).alias("rec"), "frame", "track", F.col("v").alias("x"), (F.col("conf") * 20).alias("y"), F.lit(0.0).alias("z"))
    return M.drop_redetections(t.where(F.col("track") % 4 < 2), t.where(F.col("track") % 4 >= 2), ["rec", "frame"]).select("rec", "frame", "track")


def candidates(spark, sf):
    """Three candidates per frame with a cost and a one-number pose."""
    t = tracks(spark, sf)
    cost = F.array(F.col("v"), F.col("conf") * 100, F.lit(45.0))
    pose = F.array(F.array(F.col("conf") * 4), F.array(F.col("v") / 25), F.array(F.lit(2.0)))
    return t.select(*KF, cost.alias("costs"), pose.alias("poses"))


@query(f"WITH {TRACKS_CTE} SELECT track, frame, CASE WHEN v <= conf * 100 AND v <= 45 THEN 0 WHEN conf * 100 <= 45 THEN 1 ELSE 2 END AS choice FROM t")
def g29_cheapest_candidate(spark, sf):
    c = candidates(spark, sf).select(*KF, F.posexplode("costs").alias("cand", "cost"))
    return M.cheapest_candidate(c, KF, "cand", "cost")


_JUMP = ", ".join(f"f.s{j} + 5 * (c.p{i} - f.p{j}) ** 2 AS d{i}{j}" for i in range(3) for j in range(3))
_STEP = ", ".join(f"u{i} + least(d{i}0, d{i}1, d{i}2) AS s{i}, p{i}, CASE WHEN d{i}0 <= d{i}1 AND d{i}0 <= d{i}2 THEN 0 WHEN d{i}1 <= d{i}2 THEN 1 ELSE 2 END AS b{i}" for i in range(3))
_BEST = "CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE {TRACKS_CTE}, c AS MATERIALIZED (SELECT track, frame, v AS u0, conf * 100 AS u1, 45.0::DOUBLE AS u2, conf * 4 AS p0, v / 25 AS p1, 2.0::DOUBLE AS p2 FROM t),
f AS (SELECT track, frame, {', '.join(f'u{i} AS s{i}, p{i}, -1 AS b{i}' for i in range(3))} FROM c WHERE frame = 0
 UNION ALL SELECT track, frame, {_STEP} FROM (SELECT c.*, {_JUMP} FROM f JOIN c ON c.track = f.track AND c.frame = f.frame + 1)),
m AS MATERIALIZED (SELECT * FROM f),
g AS (SELECT track, frame, {_BEST} AS choice FROM m WHERE (track, frame) IN (SELECT (track, max(frame)) FROM c GROUP BY track)
 UNION ALL SELECT g.track, g.frame - 1, CASE g.choice WHEN 0 THEN m.b0 WHEN 1 THEN m.b1 ELSE m.b2 END FROM g JOIN m ON m.track = g.track AND m.frame = g.frame WHERE g.frame > 0)
SELECT track, frame, choice FROM g""")
def g29_best_path(spark, sf):
    return M.best_path(candidates(spark, sf), K, "frame", "costs", "poses", switch_weight=5.0, n_candidates=3, size=BLK)


def _elev(a, b):
    dx, dy, dz = (f"({a}{c} - {b}{c})" for c in "xyz")
    return f"degrees(asin(greatest(least({dz} / nullif(sqrt({dx} ** 2 + {dy} ** 2 + {dz} ** 2), 0), 1), -1)))"


_PA = f"""{KEYPOINTS_CTE}, w AS (SELECT track, frame, {', '.join(f"max(CASE WHEN kp = '{n}' THEN {c} END) AS {p}{c}" for n, p in (('Antenna_Base', 'h'), ('Scutellum', 's')) for c in 'xyz')} FROM kps GROUP BY track, frame),
 c AS (SELECT track, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM kps GROUP BY track, frame)"""


@query(f"""WITH {_PA}, j AS (SELECT w.track // 2 AS bout, abs({_elev('h', 's')} - {_elev('c', 's')}) AS d FROM w JOIN c ON c.track = w.track - 1 AND c.frame = w.frame WHERE w.track % 2 = 1)
SELECT bout, round(median(d), 6) AS median_abs_deg, count(d) AS n FROM j GROUP BY bout""")
def f45_pitch_alignment(spark, sf):
    k = keypoints(spark, sf).withColumn("bout", F.floor(F.col("track") / 2))
    male = G.wide(k.where(F.col("track") % 2 == 1), ["bout", "frame"], ["Antenna_Base", "Scutellum"])
    com = k.where(F.col("track") % 2 == 0).groupBy("bout", "frame").agg(F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("com"))
    return r6(M.pitch_alignment(male.join(com, ["bout", "frame"]), ["bout"], "Antenna_Base", "Scutellum", "com"), "bout", "n")


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT track, avg(CASE WHEN label IN ('click', 'view') THEN 1.0 ELSE 0.0 END) AS song, median(v) AS len FROM t GROUP BY track),
 p AS (SELECT a.track // 2 AS bout, a.song AS s0, b.song AS s1, a.len AS l0, b.len AS l1 FROM s a JOIN s b ON b.track = a.track + 1 WHERE a.track % 2 = 0),
 q AS (SELECT *, (s0 < 0.3 AND s1 < 0.3) OR abs(s0 - s1) < 0.05 AS quiet, CASE WHEN l0 < l1 THEN 0 ELSE 1 END AS bl FROM p), m AS (SELECT *, CASE WHEN NOT quiet THEN CASE WHEN s0 > s1 THEN 0 ELSE 1 END WHEN l0 <> l1 THEN bl ELSE 0 END AS male FROM q)
SELECT bout, male, CASE WHEN quiet THEN 'body_length' ELSE 'song_fraction' END AS criterion, round(CASE WHEN NOT quiet THEN least(abs(s0 - s1) / greatest(s0, s1, 1e-6), 1) WHEN l0 <> l1 THEN least(abs(l0 - l1) / greatest(l0, l1) * 5, 1) ELSE 0 END, 6) AS confidence, NOT quiet AND bl <> male AS disagree FROM m""")
def f24_sex_assignment(spark, sf):
    from strideframe.operators.joins import pair_rows
    from strideframe.operators.quantiles import exact_median

    t = tracks(spark, sf)
    s = t.groupBy("track").agg(F.avg(F.when(F.col("label").isin("click", "view"), 1.0).otherwise(0.0)).alias("song")).join(exact_median(t, K, "v", "len"), "track")
    p = pair_rows(s.withColumn("bout", F.floor(F.col("track") / 2)).withColumn("fly", F.col("track") % 2), ["bout"], "fly", ["song", "len"])
    p = p.withColumnsRenamed({"song_0": "song0", "song_1": "song1", "len_0": "len0", "len_1": "len1"})
    return M.assign_sex(p, min_gap=0.05, silence=0.3).select("bout", "male", "criterion", F.round("confidence", 6).alias("confidence"), "disagree")


@query(f"""WITH {_PAIR}, s AS (SELECT bout, frame // 20 AS seg, va / 20.0 - vb / 20.0 AS d FROM p) SELECT bout, seg, round(atan2(avg(sin(d)), avg(cos(d))), 6) AS "offset", count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 16""")
def f36_wing_phase_offset(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 2)).withColumn("ph", F.col("v") / 20.0)
    p = t.where(F.col("track") % 2 == 0).select("bout", "frame", F.col("ph").alias("l")).join(t.where(F.col("track") % 2 == 1).select("bout", "frame", F.col("ph").alias("r")), ["bout", "frame"])
    return r6(M.segment_phase_offset(p.withColumn("seg", F.floor(F.col("frame") / 20)), ["bout", "seg"], "l", "r"), "bout", "seg", "n")


_ROT = f"""{KEYPOINTS_CTE}, m AS (SELECT track, frame, vec_id, {_hash_sql("'7'", "'mirror'", 'vec_id')} < 0.5 AS mir, {_hash_sql("'7'", "'yaw'", 'vec_id')} * 2 * pi() AS yaw, radians(({_hash_sql("'7'", "'tilt'", 'vec_id')} * 2 - 1) * 10) AS tilt FROM pose),
 a AS (SELECT k.track, k.frame, CASE WHEN NOT mir THEN kp WHEN split_part(kp, '_', 1) LIKE '%L' THEN regexp_replace(kp, '^([^_]*)L', '\\1R') WHEN split_part(kp, '_', 1) LIKE '%R' THEN regexp_replace(kp, '^([^_]*)R', '\\1L') ELSE kp END AS kp,
   CASE WHEN mir THEN -x ELSE x END AS x, cos(tilt) * y - sin(tilt) * z AS y1, sin(tilt) * y + cos(tilt) * z AS z1, yaw FROM kps k JOIN m USING (vec_id))"""


@query(f"WITH {_ROT} SELECT track, frame, kp, round(cos(yaw) * x - sin(yaw) * y1, 6) AS x, round(sin(yaw) * x + cos(yaw) * y1, 6) AS y, round(z1, 6) AS z FROM a")
def c16_mirror_and_rotate(spark, sf):
    k = keypoints(spark, sf)
    k = M.mirror_labels(k, ["vec_id"], seed=7, prob=0.5, uniform=hash_uniform)
    k = M.rotate_labels(k, ["vec_id"], seed=7, tilt_deg=10.0, uniform=hash_uniform)
    return k.select(*KF, "kp", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"""WITH c AS (SELECT vec_id, 'Cam0' || c AS camera, {_hash_sql("'7'", "'cam'", 'vec_id', "'Cam0'")} AS z, c FROM embeddings, (SELECT unnest(range(6)) AS c)),
 r AS (SELECT vec_id, camera, row_number() OVER (PARTITION BY vec_id ORDER BY {_hash_sql("'7'", "'cam'", 'vec_id', 'camera')}, camera) AS r FROM c),
 d AS (SELECT vec_id, least(CASE WHEN {_hash_sql("'7'", "'drop'", 'vec_id')} < 0.6 THEN floor({_hash_sql("'7'", "'count'", 'vec_id')} * 4) + 1 ELSE 0 END, 3) AS n FROM embeddings)
SELECT r.vec_id, r.camera FROM r JOIN d USING (vec_id) WHERE r > n""")
def c16_camera_dropout(spark, sf):
    cams = F.explode(F.array(*[F.lit(f"Cam0{i}") for i in range(6)])).alias("camera")
    return M.drop_cameras(table(spark, sf, "embeddings").select("vec_id", cams), ["vec_id"], seed=7, prob=0.6, max_drop=4, uniform=hash_uniform)


@query()
def f39_standardised_pca(spark, sf):
    from strideframe.operators.learning import fit_space, project

    p = poses(spark, sf)
    space = fit_space(p.where(F.col("track") % 2 == 0), "e", k=4)
    return project(space, p, "e").select("track", "frame", *[F.round(F.element_at("pc", i + 1), 4).alias(f"pc{i + 1}") for i in range(4)])


@query()
def f38_pulse_types(spark, sf):
    from strideframe.operators.learning import classify_pulses

    w = waves(spark, sf)
    w = w.withColumn("symmetry", M.wave_symmetry(F.col("wave"), 7))
    return classify_pulses(w, "wave", "symmetry", k=3, seed=1).groupBy("pulse_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("symmetry"), 4).alias("symmetry"))


@query(f"WITH {TRACKS_CTE} SELECT track, frame, round(v / 7.3 - max(v / 7.3) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS centred FROM t")
def u1_track_callback(spark, sf):
    def below_peak(g):
        g = g.sort_values("frame")
        return g[["frame"]].assign(centred=g["v"] - g["v"].cummax())

    out = M.track_map(tracks(spark, sf).select("track", "frame", (F.col("v") / 7.3).alias("v")), K, below_peak, "frame long, centred double")
    return out.select("track", "frame", F.round("centred", 6).alias("centred"))


@query(f"WITH {TRACKS_CTE} SELECT track, frame, round(CASE WHEN conf >= 0.25 THEN v * 0.5 END, 6) AS v FROM t")
def u2_stage_chain(spark, sf):
    stages = [
        ("mask", lambda d, threshold: d.withColumn("v", F.when(F.col("conf") >= threshold, F.col("v"))), {"threshold": 0.5}),
        ("scale", lambda d, factor: d.withColumn("v", F.col("v") * factor), {"factor": 0.5}),
        ("shift", lambda d, by: d.withColumn("v", F.col("v") + by), {"by": 1.0}),
    ]
    out = M.apply_stages(tracks(spark, sf), stages, {"mask": {"threshold": 0.25}, "shift": {"enabled": False}})
    return out.select("track", "frame", F.round("v", 6).alias("v"))




_VOTE = f"""{TRACKS_CTE}, r AS (SELECT track // 2 AS bout, track % 2 AS fly, label, greatest(least(conf, 0.999), 0.001) AS q, conf AS p FROM t),
 per AS (SELECT bout, label, fly, sum(ln(q / (1 - q))) AS lo, sum(p) AS p, count(*) AS n FROM r GROUP BY ALL), v AS (SELECT *, CASE WHEN abs(p / n - 0.5) >= 0.03 THEN lo END AS vote FROM per),
 s AS (SELECT bout, label, sum(p) FILTER (fly = 0) AS p0, sum(p) FILTER (fly = 1) AS p1, sum(n) FILTER (fly = 0) AS n0, sum(n) FILTER (fly = 1) AS n1, sum(vote) FILTER (fly = 0) AS v0, sum(vote) FILTER (fly = 1) AS v1 FROM v GROUP BY ALL),
 g AS (SELECT bout, sum(p0) / sum(n0) AS prob0, sum(p1) / sum(n1) AS prob1, sum(v0) AS vote0, sum(v1) AS vote1, count(v0 - v1) AS n_sources, count(*) FILTER (v0 > v1) AS f0, count(*) FILTER (v0 < v1) AS f1 FROM s GROUP BY bout),
 w AS (SELECT *, coalesce(vote0, 0) - coalesce(vote1, 0) AS gap FROM g)"""


@query(f"""WITH {_VOTE} SELECT bout, round(prob0, 6) AS prob0, round(prob1, 6) AS prob1, round(vote0, 6) AS vote0, round(vote1, 6) AS vote1, CASE WHEN gap > 0 THEN 1 WHEN gap < 0 THEN 0 END AS male,
 CASE WHEN (gap > 0 AND prob0 > 0.5 AND prob1 < 0.5) OR (gap < 0 AND prob1 > 0.5 AND prob0 < 0.5) THEN 'high' ELSE 'low' END AS confidence, n_sources, round(CASE WHEN n_sources > 0 THEN CASE WHEN gap > 0 THEN f0 WHEN gap < 0 THEN f1 END / n_sources END, 6) AS agree FROM w""")
def f24_sex_vote(spark, sf):
    t = tracks(spark, sf).select(F.floor(F.col("track") / 2).alias("bout"), (F.col("track") % 2).alias("fly"), "label", F.col("conf").alias("p"))
    v = M.sex_vote(t, ["bout"], "fly", "p", "label", margin=0.03)
    return v.select("bout", *[F.round(c, 6).alias(c) for c in ("prob0", "prob1", "vote0", "vote1", "agree")], "male", "confidence", "n_sources")


@query(f"""WITH {TRACKS_CTE}, r AS (SELECT track // 2 AS bout, label, CASE WHEN avg(v) FILTER (track % 2 = 0) > 1.2 * avg(v) FILTER (track % 2 = 1) THEN 0 WHEN avg(v) FILTER (track % 2 = 1) > 1.2 * avg(v) FILTER (track % 2 = 0) THEN 1 END AS slot FROM t GROUP BY ALL),
 g AS (SELECT bout, count(DISTINCT slot) AS k, any_value(slot) FILTER (label IN ('purchase', 'click', 'view')) AS x, count(DISTINCT slot) FILTER (label IN ('purchase', 'click', 'view')) AS kk, count(slot) FILTER (label = 'purchase') AS a, count(slot) FILTER (label = 'click') AS b, count(slot) FILTER (label = 'view') AS c FROM r GROUP BY bout)
SELECT bout, CASE WHEN kk > 1 THEN NULL ELSE coalesce(x, 1) END AS male, CASE WHEN kk > 1 THEN NULL ELSE 1 - coalesce(x, 1) END AS female, CASE WHEN a > 0 THEN 'purchase' WHEN b > 0 THEN 'click' WHEN c > 0 THEN 'view' END AS authority, kk > 1 AS conflict FROM g""")
def f24_resolved_slots(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 2))
    side = lambda i: F.avg(F.when(F.col("track") % 2 == i, F.col("v")))
    r = t.groupBy("bout", "label").agg(side(0).alias("a"), side(1).alias("b")).withColumn("slot", F.when(F.col("a") > 1.2 * F.col("b"), 0).when(F.col("b") > 1.2 * F.col("a"), 1))
    return M.resolve_male(r, ["bout"], "label", "slot", order=["purchase", "click", "view"])


# Windows of a recording's frame: animals and detections of four users that share a frame number.
_WIN = f"""{TRACKS_CTE}, w AS (SELECT track // 6 AS rec, frame, track AS id, v / 4 AS x, conf * 40 AS y, 0.0 AS z, CASE track % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'reused' ELSE 'detection' END AS source FROM t)"""


@query(f"""WITH RECURSIVE {_WIN}, c AS (SELECT rec, frame, id, id AS g, 0 AS k FROM w UNION ALL SELECT c.rec, c.frame, c.id, min(n.g), c.k + 1 FROM c JOIN w a ON a.rec = c.rec AND a.frame = c.frame AND a.id = c.id JOIN w b ON b.rec = a.rec AND b.frame = a.frame
  AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 15 JOIN c n ON n.rec = b.rec AND n.frame = b.frame AND n.id = b.id WHERE c.k < 6 GROUP BY c.rec, c.frame, c.id, c.k),
 m AS (SELECT w.*, c.g FROM w JOIN c USING (rec, frame, id) WHERE c.k = 6), a AS (SELECT rec, frame, g, avg(x) AS x, avg(y) AS y, min(CASE source WHEN 'track' THEN 1 WHEN 'reused' THEN 2 ELSE 3 END) AS r, list(id ORDER BY id) AS members FROM m GROUP BY ALL)
SELECT rec, frame, row_number() OVER (PARTITION BY rec, frame ORDER BY g) - 1 AS "window", round(x, 6) AS x, round(y, 6) AS y, ['track', 'reused', 'detection'][r] AS source, array_to_string(members, ',') AS members FROM a""")
def e20_merged_windows(spark, sf):
    from strideframe.operators.lifting import merge_windows

    source = F.element_at(F.array(F.lit("track"), F.lit("reused"), F.lit("detection")), (F.col("track") % 3 + 1).cast("int"))
    w = tracks(spark, sf).select(F.floor(F.col("track") / 6).alias("rec"), "frame", F.col("track").alias("id"), (F.col("v") / 4).alias("x"), (F.col("conf") * 40).alias("y"), F.lit(0.0).alias("z"), source.alias("source"))
    m = merge_windows(w, ["rec", "frame"], "id", radius=15.0)
    return m.select("rec", "frame", "window", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "source", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
