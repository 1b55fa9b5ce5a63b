"""Gait queries: crossings, cycles, episodes, contact rules."""

from __future__ import annotations


from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.functions.terrain import Stairs
from strideframe.operators import gait as G
from strideframe.operators.ordered import BLOCK, running_sum
from strideframe.plans.registry import query
from strideframe.plans.tables import TRACKS_CTE, tracks

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
K = ["track"]
KF = ["track", "frame"]

# Phase: a wrapped drifting angle, missing where the confidence is low.
PH = f"""{TRACKS_CTE}, ph AS (SELECT *, CASE WHEN conf >= 0.1 THEN atan2(sin(frame * 0.9 + v / 40.0), cos(frame * 0.9 + v / 40.0)) END AS phase FROM t)"""
_CROSS = """u0 AS (SELECT *, phase - lag(phase) OVER (PARTITION BY {k} ORDER BY frame) AS dd FROM ph WHERE phase IS NOT NULL),
 u1 AS (SELECT *, phase + 2 * pi() * sum(CASE WHEN dd > pi() THEN -ceil((dd - pi()) / (2 * pi())) WHEN dd < -pi() THEN ceil((-dd - pi()) / (2 * pi())) ELSE 0 END) OVER (PARTITION BY {k} ORDER BY frame) AS u FROM u0),
 u2 AS (SELECT *, floor((u - ({lev})) / (2 * pi())) AS turn, count(*) OVER (PARTITION BY {k}) AS cnt FROM u1),
 on_ AS (SELECT * FROM (SELECT *, lead(turn) OVER (PARTITION BY {k} ORDER BY frame) AS nt FROM u2) WHERE nt > turn AND cnt >= 4)"""


def phases(spark, sf):
    ang = F.col("frame") * 0.9 + F.col("v") / 40.0
    return tracks(spark, sf).withColumn("phase", F.when(F.col("conf") >= 0.1, V.wrap(ang)))


@query(f"WITH {PH}, {_CROSS.format(k='track', lev='-pi() / 2')} SELECT track, frame FROM on_")
def g11_liftoffs(spark, sf):
    return G.liftoffs(phases(spark, sf), K, "frame", "phase", size=BLK)


@query(f"WITH {PH}, {_CROSS.format(k='track', lev='pi() / 2')} SELECT track, frame FROM on_")
def g11_landings(spark, sf):
    return G.landings(phases(spark, sf), K, "frame", "phase", size=BLK)


# Two front legs per animal: even and odd tracks.
_CYC = f"""{PH.replace('SELECT *, CASE', 'SELECT *, track // 2 AS animal, track % 2 AS leg, CASE')}, {_CROSS.format(k='track', lev='-pi() / 2')},
 fst AS (SELECT animal, arg_min(leg, frame * 10 + leg) AS leg FROM on_ GROUP BY animal),
 rf AS (SELECT o.animal, o.leg, o.frame AS start, lead(o.frame) OVER (PARTITION BY o.animal ORDER BY o.frame) AS "end" FROM on_ o JOIN fst ON fst.animal = o.animal AND fst.leg = o.leg),
 fr AS (SELECT track // 2 AS animal, frame, v AS speed FROM t WHERE track % 2 = 0),
 cy AS (SELECT r.animal, r.start, r."end", r.leg, avg(f.speed) AS ms FROM rf r JOIN fr f ON f.animal = r.animal AND f.frame >= r.start AND f.frame < r."end" GROUP BY ALL),
 kept AS (SELECT *, row_number() OVER (PARTITION BY animal ORDER BY start) - 1 AS cycle FROM cy WHERE ("end" - start) / 800.0 * 1000 >= 5 AND ms >= 40)"""


def animal_cycles(spark, sf):
    p = phases(spark, sf).withColumn("animal", F.floor(F.col("track") / 2)).withColumn("leg", F.col("track") % 2)
    on = G.liftoffs(p, ["animal", "leg"], "frame", "phase", size=BLK)
    fr = p.where(F.col("leg") == 0).select("animal", "frame", F.col("v").alias("speed"), "conf", "label")
    return G.step_cycles(fr, on, ["animal"], "frame", "leg", "speed", fps=800.0, min_ms=5.0, min_speed=40.0, size=BLK)


@query(f'WITH {_CYC} SELECT animal, cycle, start, "end", leg, round(ms, 6) AS mean_speed FROM kept')
def g12_step_cycles(spark, sf):
    c, _ = animal_cycles(spark, sf)
    return c.select("animal", "cycle", "start", "end", "leg", F.round("mean_speed", 6).alias("mean_speed"))


@query(f'WITH {_CYC} SELECT f.animal, f.frame, k.cycle, round(k.ms, 6) AS mean_speed FROM fr f LEFT JOIN kept k ON k.animal = f.animal AND f.frame >= k.start AND f.frame < k."end"')
def g12_frame_cycles(spark, sf):
    _, f = animal_cycles(spark, sf)
    return f.select("animal", "frame", "cycle", F.round("mean_speed", 6).alias("mean_speed"))


_CY = f"""{TRACKS_CTE}, cyc0 AS (SELECT *, sum(CASE WHEN label = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS c FROM t), cyc AS (SELECT *, CASE WHEN c > 0 THEN c END AS cycle FROM cyc0)"""


def click_cycles(spark, sf):
    t = running_sum(tracks(spark, sf), K, "frame", {"c": (F.col("label") == "click").cast("long")}, size=BLK)
    return t.withColumn("cycle", F.when(F.col("c") > 0, F.col("c")))


@query(f"""WITH {_CY}, o AS (SELECT track // 2 AS animal, track % 2 AS leg, frame FROM t WHERE label = 'error'), f AS (SELECT track // 2 AS animal, frame, cycle FROM cyc WHERE track % 2 = 0 AND cycle IS NOT NULL),
 n AS (SELECT f.animal, f.cycle, o.leg, count(o.leg) AS n FROM f LEFT JOIN o ON o.animal = f.animal AND o.frame = f.frame GROUP BY ALL)
SELECT animal, cycle, count(leg) AS n_legs_swinging, count(leg) = 2 AS complete FROM n GROUP BY ALL""")
def d16_cycle_completeness(spark, sf):
    c = click_cycles(spark, sf)
    on = c.where(F.col("label") == "error").select(F.floor(F.col("track") / 2).alias("animal"), (F.col("track") % 2).alias("leg"), "frame")
    f = c.where(F.col("track") % 2 == 0).select(F.floor(F.col("track") / 2).alias("animal"), "frame", "cycle")
    return G.cycle_completeness(on, f, ["animal", "cycle"], ["animal"], "frame", "leg", 2)


@query(f"""WITH {_CY}, d AS (SELECT *, v / 7.3 AS x, conf * 3.1 AS y, atan2(sin(v / 20.0), cos(v / 20.0)) AS ph FROM cyc WHERE cycle IS NOT NULL),
 w AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny, first(x) OVER o AS fx, first(y) OVER o AS fy FROM d WINDOW o AS (PARTITION BY track, cycle ORDER BY frame))
SELECT track, cycle, count(*) AS n, round(max(x), 6) AS speed, round(count(*) / 0.8, 6) AS duration_ms, round(800.0 / count(*), 6) AS frequency_hz, round(max(x) * count(*) / 800.0, 6) AS stride,
 round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6) AS loop_area, round(coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 0), 6) AS loop_perimeter,
 round(avg(CASE WHEN conf >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS duty, round(max(conf) - min(conf), 6) AS rom_conf, round(atan2(avg(sin(ph)), avg(cos(ph))), 6) AS mean_phase FROM w GROUP BY track, cycle HAVING count(*) >= 4""")
def f25_cycle_table(spark, sf):
    d = click_cycles(spark, sf).withColumn("x", F.col("v") / 7.3).withColumn("y", F.col("conf") * 3.1).withColumn("ph", V.wrap(F.col("v") / 20.0)).withColumn("st", F.col("conf") >= 0.5)
    c = G.cycle_table(d, K, "frame", "cycle", speed="x", x="x", y="y", stance="st", joints=["conf"], phase="ph", fps=800.0, min_frames=4, size=BLK)
    ints = ("track", "cycle", "n")
    return c.select(*ints, *[F.round(x, 6).alias(x) for x in c.columns if x not in ints])


@query(f"""WITH {_CY}, m AS (SELECT track, max(cycle) AS top, count(DISTINCT cycle) AS nc FROM cyc GROUP BY track), k AS (SELECT track, top - 2 AS keep FROM m WHERE nc > 2 AND track % 3 = 0),
 d AS (SELECT c.*, keep FROM cyc c LEFT JOIN k USING (track) WHERE keep IS NULL OR cycle <= keep), e AS (SELECT track, max(CASE WHEN conf >= 0.5 THEN frame END) AS last FROM d WHERE keep IS NOT NULL GROUP BY track)
SELECT track, frame FROM d LEFT JOIN e USING (track) WHERE last IS NULL OR frame <= last""")
def d18_tail_trim(spark, sf):
    c = click_cycles(spark, sf).withColumn("st", F.col("conf") >= 0.5)
    trims = c.where(F.col("track") % 3 == 0).select("track").distinct().withColumn("n_trim", F.lit(2))
    return G.trim_tail(c, c.where(F.col("cycle").isNotNull()), trims, K, "frame", "cycle", "st").select("track", "frame")


_EP = f"""{TRACKS_CTE}, s AS (SELECT *, conf >= 0.4 AS st, v / 7.3 AS z, v / 100.0 - 0.3 AS clr FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) - row_number() OVER (PARTITION BY track, st ORDER BY frame) AS grp FROM s),
 ep AS (SELECT track, min(frame) AS start, max(frame) AS "end", CASE WHEN st THEN 'stance' ELSE 'swing' END AS kind, count(*) AS n, count(*) / 0.8 AS dur_ms, max(z) - min(z) AS amplitude, min(clr) AS clear_min, max(clr) AS clear_max, min(abs(clr)) AS abs_clear_min
   FROM r GROUP BY track, st, grp HAVING count(*) >= 2),
 fl AS (SELECT *, kind = 'stance' AND clear_min > -0.1 AS no_contact, kind = 'stance' AND dur_ms < 3 AS too_short FROM ep)"""


def feet(spark, sf):
    return tracks(spark, sf).withColumn("st", F.col("conf") >= 0.4).withColumn("z", F.col("v") / 7.3).withColumn("clr", F.col("v") / 100.0 - 0.3)


def foot_episodes(spark, sf):
    return G.flag_episodes(G.episodes(feet(spark, sf), K, "frame", "st", "z", "clr", fps=800.0, min_samples=2, size=BLK), contact_tol=-0.1, min_stance_ms=3.0)


@query(f"""WITH {_EP} SELECT track, start, "end", kind, n, round(dur_ms, 6) AS dur_ms, round(amplitude, 6) AS amplitude, round(clear_min, 6) AS clear_min, no_contact, too_short FROM fl""")
def g22_episodes(spark, sf):
    e = foot_episodes(spark, sf)
    return e.select("track", "start", "end", "kind", "n", *[F.round(c, 6).alias(c) for c in ("dur_ms", "amplitude", "clear_min")], "no_contact", "too_short")


# The twin reads a track frame by frame and keeps direction, extreme and count of the open episode.
_PEAKS = f"""{_EP.replace("r AS (SELECT *", "r AS MATERIALIZED (SELECT *")}, em AS (SELECT track, st, grp, min(z) AS lo, greatest(0.2 * (max(z) - min(z)), 0.5) AS least FROM r GROUP BY ALL),
 q AS MATERIALIZED (SELECT r.track, r.frame, r.st, r.grp, coalesce(r.z, lo) AS z, least, lag(r.st) OVER w IS DISTINCT FROM r.st AS fresh, lead(r.st) OVER w IS DISTINCT FROM r.st AS done FROM r JOIN em USING (track, st, grp) WINDOW w AS (PARTITION BY r.track ORDER BY r.frame)),
 zz AS (SELECT track, frame, st, grp, done, false AS up, z AS ext, 0 AS n FROM q WHERE frame = 0 UNION ALL
  SELECT track, frame, st, grp, done, CASE WHEN fresh THEN false WHEN up AND ext - z >= least THEN false WHEN NOT up AND z - ext >= least THEN true ELSE up END,
   CASE WHEN fresh THEN z WHEN up THEN CASE WHEN ext - z >= least THEN z ELSE greatest(ext, z) END WHEN z - ext >= least THEN z ELSE least(ext, z) END,
   CASE WHEN fresh THEN 0 WHEN up AND ext - z >= least THEN n + 1 ELSE n END
  FROM (SELECT q.*, zz.up, zz.ext, zz.n FROM zz JOIN q ON q.track = zz.track AND q.frame = zz.frame + 1)),
 ends AS (SELECT track, st, grp, n FROM zz WHERE done), se AS (SELECT track, st, grp, min(frame) AS start, max(frame) AS "end" FROM r GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_PEAKS} SELECT track, start, "end", CASE WHEN st THEN 'stance' ELSE 'swing' END AS kind, CAST(n AS BIGINT) AS n_peaks, NOT st AND n >= 2 AS double_peak FROM ends JOIN se USING (track, st, grp)""")
def g22_episode_peaks(spark, sf):
    return G.episode_peaks(feet(spark, sf), K, "frame", "st", "z", fraction=0.2, floor=0.5, size=BLK)


@query(f"""WITH {_EP}, w AS (SELECT *, lag(kind) OVER o AS pk, lead(kind) OVER o AS nk, lag(start) OVER o AS ps, lead("end") OVER o AS ne FROM fl WINDOW o AS (PARTITION BY track ORDER BY start))
SELECT track, ps AS start, ne AS "end", round(dur_ms, 6) AS gap_ms, CASE WHEN too_short THEN 'short' ELSE 'no contact' END AS reason FROM w WHERE kind = 'stance' AND (no_contact OR too_short) AND pk = 'swing' AND nk = 'swing'""")
def g22_double_swings(spark, sf):
    return G.double_swings(foot_episodes(spark, sf), K, size=BLK).withColumn("gap_ms", F.round("gap_ms", 6))


@query(f"""WITH {_EP} SELECT count(*) FILTER (kind = 'swing') AS n_swings, round(avg(CASE WHEN clear_max >= 0.2 THEN 1.0 ELSE 0.0 END) FILTER (kind = 'swing'), 6) AS lifting,
 count(*) FILTER (kind = 'stance') AS n_stances, round(avg(CASE WHEN abs_clear_min <= 0.05 THEN 1.0 ELSE 0.0 END) FILTER (kind = 'stance'), 6) AS touching, round(median(dur_ms) FILTER (kind = 'swing'), 6) AS median_swing_ms FROM ep""")
def f43_episode_quality(spark, sf):
    q = G.episode_quality(foot_episodes(spark, sf), lift=0.2, band=0.05, min_swing=2)
    return q.select("n_swings", "n_stances", *[F.round(c, 6).alias(c) for c in ("lifting", "touching", "median_swing_ms")])


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT track // 6 AS animal, frame, sum(CASE WHEN conf >= 0.4 THEN 1 ELSE 0 END) AS n, count(*) AS c, sum(CASE WHEN conf >= 0.4 AND track % 6 IN (0, 1) THEN 1 ELSE 0 END) AS f,
  sum(CASE WHEN conf >= 0.4 AND track % 6 IN (4, 5) THEN 1 ELSE 0 END) AS h FROM t GROUP BY ALL)
SELECT round(sum(n) / sum(c), 6) AS duty, round(avg(CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_front, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_hind, round(avg(CASE WHEN n < 3 THEN 1.0 ELSE 0.0 END), 6) AS under_three FROM p""")
def f43_contact_quality(spark, sf):
    t = tracks(spark, sf).select(F.floor(F.col("track") / 6).alias("animal"), (F.col("track") % 6).alias("leg"), "frame", (F.col("conf") >= 0.4).alias("st"))
    q = G.contact_quality(t, ["animal", "frame"], "leg", "st", [0, 1], [4, 5])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def _flip_sql(src, cond, agg, out):
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) - row_number() OVER (PARTITION BY track, ct ORDER BY frame) AS grp FROM {src}),
 {out} AS (SELECT track, frame, clr, v, CASE WHEN {cond} THEN NOT ct ELSE ct END AS ct FROM (SELECT *, {agg} OVER (PARTITION BY track, ct, grp) AS m, count(*) OVER (PARTITION BY track, ct, grp) AS n FROM {out}_r))"""


_P = ", ".join(_flip_sql(f"s{2 * i}", "NOT ct AND m < 0.3", "max(clr)", f"s{2 * i + 1}") + ", " + _flip_sql(f"s{2 * i + 1}", "ct AND m > 0.2", "min(abs(clr))", f"s{2 * i + 2}") for i in range(3))


@query(f"WITH {TRACKS_CTE}, s0 AS (SELECT track, frame, v, v / 100.0 - 0.3 AS clr, conf >= 0.4 AS ct FROM t), {_P} SELECT track, frame, ct AS contact FROM s6")
def g21_contact_correction(spark, sf):
    d = feet(spark, sf).select("track", "frame", "clr", F.col("st").alias("contact"))
    return G.correct_contact(d, K, "frame", "contact", "clr", lift=0.3, band=0.2, passes=3, size=BLK).select("track", "frame", "contact")


@query(f"""WITH {TRACKS_CTE}, s0 AS (SELECT track, frame, v, conf AS clr, conf <= 0.6 AS ct FROM t), {_flip_sql('s0', 'ct AND m > 45', 'median(v)', 's1')}, {_flip_sql('s1', 'NOT ct AND m < 0.7', 'max(clr)', 's2')}, {_flip_sql('s2', 'ct AND n < 3', 'max(clr)', 's3')}
SELECT track, frame, ct AS contact FROM s3""")
def g21_surface_contact(spark, sf):
    d = tracks(spark, sf).select("track", "frame", "v", "conf")
    return G.surface_contact(d, K, "frame", "conf", "v", contact=0.6, split=45.0, lift=0.7, min_len=3, name="contact", size=BLK).select("track", "frame", "contact")


_STANCE = f"""{TRACKS_CTE}, ft AS (SELECT track, frame, conf >= 0.4 AS st, coalesce(conf >= 0.4, FALSE) AS stand, v / 7.3 AS z FROM t),
 ch AS (SELECT *, coalesce(stand <> lag(stand) OVER w, TRUE) AS new, lag(z) OVER w AS zp, lead(z) OVER w AS zn FROM ft WINDOW w AS (PARTITION BY track ORDER BY frame)),
 lab AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS run FROM ch)"""


@query(f"""WITH {_STANCE}, u AS (SELECT *, CASE WHEN stand THEN run ELSE run + 1 END AS unit FROM lab),
 s AS (SELECT *, min(frame) FILTER (stand) OVER g AS s, max(frame) FILTER (stand) OVER g AS b FROM u WINDOW g AS (PARTITION BY track, unit)),
 ap AS (SELECT track, unit, arg_min(frame, (-z, frame)) AS a FROM s WHERE frame <= s GROUP BY track, unit),
 nw AS (SELECT track, unit, coalesce(min(frame) FILTER (frame > a AND frame < b AND z < zp AND z <= zn), arg_min(frame, (z, frame))) AS nf, max(b) - max(a) >= 2 AS wide FROM s JOIN ap USING (track, unit) WHERE frame BETWEEN a AND b GROUP BY track, unit)
SELECT s.track, frame, CASE WHEN st IS NOT NULL THEN CASE WHEN coalesce(wide, FALSE) THEN frame BETWEEN nf AND b ELSE stand END END AS refined FROM s LEFT JOIN nw ON nw.track = s.track AND nw.unit = s.unit""")
def g20_stance_first_minimum(spark, sf):
    return G.stance_edges(feet(spark, sf), K, "frame", "st", "z", rule="first_minimum", size=BLK).select("track", "frame", "refined")


@query(f"""WITH {_STANCE}, so AS (SELECT track, run, median(z) AS thr, min(frame) AS s, arg_min(z, frame) AS zs FROM lab WHERE stand GROUP BY track, run),
 sw AS (SELECT track, run, min(frame) AS first, arg_min(frame, (-z, frame)) AS apex, max(z) AS top FROM lab WHERE NOT stand GROUP BY track, run),
 ed AS (SELECT l.track, l.run, min(l.frame) FILTER (l.frame >= CASE WHEN n.zs > top THEN n.s ELSE apex END AND l.z <= n.thr) AS ns, min(l.frame) FILTER (l.frame <= apex AND l.z > p.thr) AS ne, any_value(first) AS first, any_value(apex) AS apex, count(p.thr) > 0 AS follows
   FROM lab l JOIN sw ON sw.track = l.track AND sw.run = l.run LEFT JOIN so n ON n.track = l.track AND n.run = l.run + 1 LEFT JOIN so p ON p.track = l.track AND p.run = l.run - 1 WHERE NOT l.stand GROUP BY l.track, l.run)
SELECT lab.track, frame, CASE WHEN st IS NOT NULL THEN stand OR coalesce(frame >= ns, FALSE) OR coalesce(follows AND apex > first AND frame < ne, FALSE) END AS refined FROM lab LEFT JOIN ed ON ed.track = lab.track AND ed.run = lab.run""")
def g20_stance_threshold(spark, sf):
    return G.stance_edges(feet(spark, sf), K, "frame", "st", "z", rule="threshold", size=BLK).select("track", "frame", "refined")


@query(f"""WITH {TRACKS_CTE}, b AS (SELECT track, min(frame) AS first, max(frame) AS last, count(*) AS n FROM t GROUP BY track)
SELECT t.track, any_value(first) AS first, any_value(last) AS last, any_value(n) AS n, round(median(v), 6) AS speed_median, round(quantile_cont(v, 0.1), 6) AS speed_p10, round(quantile_cont(v, 0.9), 6) AS speed_p90,
 round(max(conf) - min(conf), 6) AS height_range, round(CASE WHEN any_value(n) > 40 THEN avg(conf) FILTER (frame > last - 20) - avg(conf) FILTER (frame < first + 20) END, 6) AS rise FROM t JOIN b USING (track) GROUP BY t.track""")
def f48_bout_summary(spark, sf):
    s = G.bout_summary(tracks(spark, sf), K, "frame", speed="v", height="conf")
    return s.select("track", "first", "last", "n", *[F.round(c, 6).alias(c) for c in ("speed_median", "speed_p10", "speed_p90", "height_range", "rise")])


_LEV = "([0, 1, 2, 1])[CAST(floor(((x - k * 0.5) % 8.0 + 8.0) % 8.0 / 2.0) AS INT) % 4 + 1]"


@query(f"""WITH {TRACKS_CTE}, g AS (SELECT k, conf * 2.37 - 0.5 * {_LEV} AS d FROM (SELECT conf, v / 7.3 AS x FROM t), (SELECT unnest(range(16)) AS k)),
 m AS (SELECT k, median(d) AS z0 FROM g GROUP BY k), r AS (SELECT k, any_value(z0) AS z0, median(abs(d - z0)) AS res FROM g JOIN m USING (k) GROUP BY k)
SELECT round(k * 0.5, 6) AS x0, round(z0, 6) AS z0, round(res, 6) AS residual FROM r ORDER BY res, k LIMIT 1""")
def f46_surface_registration(spark, sf):
    p = tracks(spark, sf).select((F.col("v") / 7.3).alias("x"), (F.col("conf") * 2.37).alias("z"))
    r = G.register_surface(p, Stairs(period=8.0, step=0.5, levels=(0, 1, 2, 1)), "x", "z", step=0.5)
    return r.select(*[F.round(c, 6).alias(c) for c in ("x0", "z0", "residual")])


