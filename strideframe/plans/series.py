"""Ordered-series queries: runs, gaps, rolling statistics, latches, resets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import runs as R
from strideframe.operators import series as S
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.tables import TRACKS_CTE, table, tracks

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
K = ["track"]

_GATED = f"""WITH {TRACKS_CTE}, g AS (SELECT *, conf >= 0.5 AS ok FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) - row_number() OVER (PARTITION BY track, ok ORDER BY frame) AS grp FROM g)"""


@query(f"""{_GATED}
SELECT track, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM r WHERE ok GROUP BY track, grp HAVING count(*) >= 3""")
def g1_true_runs(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5)
    return R.true_runs(t, K, "frame", "ok", min_len=3, size=BLK)


@query(f"""{_GATED}
SELECT track, max(n) AS max_gap, count(*) AS n_gaps, round(median(n), 6) AS median_gap FROM
 (SELECT track, grp, count(*) AS n FROM r WHERE NOT ok GROUP BY track, grp) GROUP BY track""")
def g1_gap_lengths(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5)
    gaps = R.gap_report(t, K, "frame", "ok", size=BLK)
    med = S.exact_median(gaps, K, "n", "median_gap")
    tops = gaps.groupBy("track").agg(F.max("n").alias("max_gap"), F.count(F.lit(1)).alias("n_gaps"))
    return tops.join(med, K).withColumn("median_gap", F.round("median_gap", 6))


@query(f"""WITH {TRACKS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame)
  - row_number() OVER (PARTITION BY track, label ORDER BY frame) AS grp FROM t)
SELECT track, label AS type, min(frame) AS start, max(frame) AS "end", count(*) AS n_frames, round(count(*) / 800.0, 6) AS duration_s
FROM r GROUP BY track, label, grp""")
def g1_label_segments(spark, sf):
    seg = R.run_table(tracks(spark, sf), K, "frame", "label", size=BLK)
    return seg.select("track", F.col("label").alias("type"), "start", "end", F.col("n").alias("n_frames"), F.round(F.col("n") / 800.0, 6).alias("duration_s"))


_BOUTS = f"""WITH {TRACKS_CTE}, hit AS (SELECT track, frame, lag(frame) OVER (PARTITION BY track ORDER BY frame) AS prev FROM t WHERE conf >= 0.5),
 m AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame - prev - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS run FROM hit),
 b AS (SELECT track, run, min(frame) AS start_frame, max(frame) AS end_frame, max(frame) - min(frame) + 1 AS n_frames FROM m GROUP BY track, run),
 bouts AS (SELECT track, start_frame, end_frame, n_frames, row_number() OVER (PARTITION BY track ORDER BY run) AS bout FROM b WHERE n_frames >= 3)"""


def gate_bouts(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5)
    return R.bridged_runs(t, K, "frame", "ok", min_duration=3, max_gap=2, size=BLK)


@query(f"{_BOUTS} SELECT track, bout, start_frame, end_frame, n_frames FROM bouts")
def g2_bridged_bouts(spark, sf):
    return gate_bouts(spark, sf)


@query(f"""{_BOUTS} SELECT b.track, b.bout, b.start_frame, b.end_frame, b.n_frames,
 round(1 - avg(CASE WHEN t.conf >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction,
 CASE WHEN avg(CASE WHEN t.conf >= 0.3 THEN 1.0 ELSE 0.0 END) <= 0.5 THEN 'sparse' ELSE 'ok' END AS status
FROM bouts b JOIN t ON t.track = b.track AND t.frame BETWEEN b.start_frame AND b.end_frame GROUP BY ALL""")
def bout_scorecard(spark, sf):
    from strideframe.operators.joins import interval_join

    bouts = gate_bouts(spark, sf)
    hit = interval_join(tracks(spark, sf), bouts, K, "frame", "start_frame", "end_frame", width=64)
    seen = F.avg(F.when(F.col("conf") >= 0.3, 1.0).otherwise(0.0))
    return hit.groupBy("track", "bout", "start_frame", "end_frame", "n_frames").agg(
        F.round(1 - seen, 6).alias("missing_fraction"), F.when(seen <= 0.5, "sparse").otherwise("ok").alias("status")
    )


# Value missing where the confidence is low.
_MISS = f"""WITH {TRACKS_CTE}, s AS (SELECT *, CASE WHEN conf >= 0.3 THEN v END AS x FROM t)"""


def missing(spark, sf):
    return tracks(spark, sf).withColumn("x", F.when(F.col("conf") >= 0.3, F.col("v")))


_FILL = f"""{_MISS}, f AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS f0,
  min(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM s)"""


@query(f"""{_FILL} SELECT f.track, f.frame, round(CASE WHEN f.x IS NOT NULL THEN f.x WHEN f1 - f0 - 1 <= 2
  THEN a.x + (b.x - a.x) * (f.frame - f0) / (f1 - f0) END, 6) AS filled, coalesce(f.x IS NULL AND f1 - f0 - 1 <= 2, false) AS was_filled
FROM f LEFT JOIN s a ON a.track = f.track AND a.frame = f0 LEFT JOIN s b ON b.track = f.track AND b.frame = f1""")
def g4_short_gap_fill(spark, sf):
    out = S.fill_short_gaps(missing(spark, sf), K, "frame", ["x"], max_gap=2, size=BLK)
    return out.select("track", "frame", F.round("x", 6).alias("filled"), F.col("filled").alias("was_filled"))


@query(f"""{_MISS} SELECT track, frame, CASE WHEN count(x) OVER w >= 5 THEN round(median(x) OVER w, 6) END AS med
FROM s WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def g7_rolling_median(spark, sf):
    out = S.rolling(missing(spark, sf), K, "frame", "x", before=4, after=4, how="median", min_periods=5, name="med", size=BLK)
    return out.select("track", "frame", F.round("med", 6).alias("med"))


@query(f"""{_MISS} SELECT track, frame, CASE WHEN count(x) OVER w >= 3 THEN round(quantile_cont(x, 0.05) OVER w, 6) END AS floor_v
FROM s WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def g7_rolling_floor(spark, sf):
    out = S.rolling(missing(spark, sf), K, "frame", "x", before=5, after=5, how=0.05, min_periods=3, name="floor_v", size=BLK)
    return out.select("track", "frame", F.round("floor_v", 6).alias("floor_v"))


@query(f"""WITH {TRACKS_CTE}, d AS (SELECT *, abs(v - coalesce(lag(v) OVER (PARTITION BY track ORDER BY frame), v)) * 800 AS dz FROM t),
 e AS (SELECT track, min(frame) AS lo, max(frame) AS hi FROM t GROUP BY track)
SELECT d.track, d.frame, round(avg(n.dz), 6) AS activity FROM d JOIN e USING (track), (SELECT unnest(range(-2, 3)) AS k) o, d n
WHERE n.track = d.track AND n.frame = CASE WHEN d.frame + k < lo THEN lo - (d.frame + k) - 1 WHEN d.frame + k > hi THEN 2 * hi - (d.frame + k) + 1 ELSE d.frame + k END
GROUP BY d.track, d.frame""")
def g7_moving_activity(spark, sf):
    d = S.step_change(tracks(spark, sf), K, "frame", "v", fps=800.0, name="dz", size=BLK)
    out = S.fir(d, K, "frame", {"activity": "dz"}, [0.2] * 5, edge="reflect", size=BLK)
    return out.select("track", "frame", F.round("activity", 6).alias("activity"))


@query(f"""WITH {TRACKS_CTE} SELECT track, frame, round(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v
  WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END * 800, 6) AS rate
FROM t WINDOW w AS (PARTITION BY track ORDER BY frame)""")
def g8_gradient(spark, sf):
    out = S.gradient(tracks(spark, sf), K, "frame", {"rate": "v"}, scale=800.0, size=BLK)
    return out.select("track", "frame", F.round("rate", 6).alias("rate"))


_ANGLE = "(v / 100.0 * 7 - 3)"


@query(f"""WITH {TRACKS_CTE}, a AS (SELECT track, frame, atan2(sin({_ANGLE}), cos({_ANGLE})) AS th FROM t),
 d AS (SELECT *, th - lag(th) OVER (PARTITION BY track ORDER BY frame) AS dd FROM a),
 c AS (SELECT *, CASE WHEN dd > pi() THEN -ceil((dd - pi()) / (2 * pi())) WHEN dd < -pi() THEN ceil((-dd - pi()) / (2 * pi())) ELSE 0 END AS k FROM d)
SELECT track, frame, round(th + 2 * pi() * sum(k) OVER (PARTITION BY track ORDER BY frame), 6) AS unwrapped FROM c""")
def g8_unwrap(spark, sf):
    ang = F.col("v") / 100.0 * 7 - 3
    t = tracks(spark, sf).withColumn("th", F.atan2(F.sin(ang), F.cos(ang)))
    return S.unwrap(t, K, "frame", "th", name="unwrapped", size=BLK).select("track", "frame", F.round("unwrapped", 6).alias("unwrapped"))


@query(f"""WITH {TRACKS_CTE}, e AS (SELECT *, max(CASE WHEN label = 'click' THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS f0,
 min(CASE WHEN label = 'click' THEN frame END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f1 FROM t)
SELECT track, frame, round(-pi() + 2 * pi() * (frame - f0) / (f1 - f0), 6) AS phase FROM e WHERE f0 IS NOT NULL AND f1 IS NOT NULL""")
def g13_linear_phase(spark, sf):
    out = S.linear_phase(tracks(spark, sf), K, "frame", F.col("label") == "click", name="phase", size=BLK)
    return out.where(F.col("phase").isNotNull()).select("track", "frame", F.round("phase", 6).alias("phase"))


_LATCH = f"""WITH {TRACKS_CTE}, e AS (SELECT *, CASE WHEN v > 60 THEN 1 WHEN v < 20 THEN 0 END AS ev FROM t),
 h AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS st FROM e)"""


def latched(spark, sf):
    return R.hysteresis(tracks(spark, sf), K, "frame", F.col("v") > 60, F.col("v") < 20, name="walking", size=BLK)


@query(f"{_LATCH} SELECT track, frame, st = 1 AS walking FROM h")
def g17_hysteresis(spark, sf):
    return latched(spark, sf).select("track", "frame", "walking")


_RUNS_OF_ST = f"""{_LATCH}, c AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY track ORDER BY frame) THEN 1 ELSE 0 END AS chg FROM h),
 r AS (SELECT *, sum(chg) OVER (PARTITION BY track ORDER BY frame) AS run FROM c),
 n AS (SELECT track, run, count(*) AS n, max(st) AS st FROM r GROUP BY track, run)"""


@query(f"""{_RUNS_OF_ST}, k AS (SELECT track, run, last_value(CASE WHEN n >= 4 OR run = 1 THEN st END IGNORE NULLS)
  OVER (PARTITION BY track ORDER BY run ROWS UNBOUNDED PRECEDING) AS st2 FROM n)
SELECT r.track, r.frame, CASE WHEN st2 = 1 THEN 'walking' ELSE 'stopped' END AS state FROM r JOIN k USING (track, run)""")
def g18_minimum_run(spark, sf):
    out = R.absorb_short_runs(latched(spark, sf), K, "frame", "walking", 4, name="st2", size=BLK)
    return out.select("track", "frame", F.when(F.col("st2"), "walking").otherwise("stopped").alias("state"))


@query(f"""WITH {TRACKS_CTE}, h AS (SELECT track, frame, CASE WHEN v > 50 THEN 1 ELSE 0 END AS st FROM t),
 c AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY track ORDER BY frame) THEN 1 ELSE 0 END AS chg FROM h),
 r AS (SELECT *, sum(chg) OVER (PARTITION BY track ORDER BY frame) AS run FROM c),
 n AS (SELECT track, run, count(*) AS n, max(st) AS st FROM r GROUP BY track, run),
 m AS (SELECT *, lag(st) OVER (PARTITION BY track ORDER BY run) AS b, lead(st) OVER (PARTITION BY track ORDER BY run) AS a FROM n),
 g AS (SELECT r.track, r.frame, CASE WHEN m.st = 1 OR (m.st = 0 AND b = 1 AND a = 1 AND n <= 2) THEN 1 ELSE 0 END AS st FROM r JOIN m USING (track, run)),
 c2 AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER (PARTITION BY track ORDER BY frame) THEN 1 ELSE 0 END AS chg FROM g),
 r2 AS (SELECT *, sum(chg) OVER (PARTITION BY track ORDER BY frame) AS run FROM c2),
 n2 AS (SELECT track, run, count(*) AS n FROM r2 GROUP BY track, run)
SELECT track, frame, st = 1 AND n >= 5 AS singing FROM r2 JOIN n2 USING (track, run)""")
def g18_bridge_and_drop(spark, sf):
    t = tracks(spark, sf).withColumn("hot", F.col("v") > 50)
    return R.bridge_and_drop(t, K, "frame", "hot", max_gap=2, min_len=5, name="singing", size=BLK).select("track", "frame", "singing")


@query(f"""WITH {TRACKS_CTE}, r AS (SELECT track, frame, label = 'error' AND NOT coalesce(lag(label) OVER (PARTITION BY track ORDER BY frame) = 'error', false) AS rise FROM t),
 e AS (SELECT track, frame AS a, lead(frame) OVER (PARTITION BY track ORDER BY frame) AS b FROM r WHERE rise)
SELECT t.track, t.frame, EXISTS (SELECT 1 FROM e WHERE e.track = t.track AND e.b - e.a <= 6 AND t.frame BETWEEN e.a AND e.b) AS episode FROM t""")
def g19_linked_events(spark, sf):
    t = tracks(spark, sf).withColumn("err", F.col("label") == "error")
    return R.linked_events(t, K, "frame", {"episode": "err"}, 6, size=BLK).select("track", "frame", "episode")


@query(f"""WITH {TRACKS_CTE}, q AS (SELECT *, label = 'error' AND NOT coalesce(lag(label) OVER (PARTITION BY track ORDER BY frame) = 'error', false) AS rise,
  v < 25 AS near_l, v > 75 AS near_r FROM t),
 s AS (SELECT *, (near_l AND max(near_r) OVER w) OR (near_r AND max(near_l) OVER w) AS both_near FROM q
       WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 e AS (SELECT track, frame AS a, lead(frame) OVER (PARTITION BY track ORDER BY frame) AS b FROM q WHERE rise),
 br AS (SELECT track, frame, both_near AND NOT coalesce(lag(both_near) OVER (PARTITION BY track ORDER BY frame), false) AS rise FROM s),
 e2 AS (SELECT track, frame AS a, lead(frame) OVER (PARTITION BY track ORDER BY frame) AS b FROM br WHERE rise)
SELECT s.track, s.frame, CASE WHEN s.label = 'purchase' THEN 'leg rubbing' WHEN s.conf > 0.9 THEN 'proboscis/ocelli'
 WHEN EXISTS (SELECT 1 FROM e2 WHERE e2.track = s.track AND e2.b - e2.a <= 6 AND s.frame BETWEEN e2.a AND e2.b) THEN 'eye cleaning'
 WHEN EXISTS (SELECT 1 FROM e WHERE e.track = s.track AND e.b - e.a <= 6 AND s.frame BETWEEN e.a AND e.b) THEN 'antennal'
 WHEN s.v < 10 THEN 'antennal' ELSE 'unclassified' END AS behaviour FROM s""")
def g19_behaviour_classes(spark, sf):
    t = tracks(spark, sf)
    t = t.select("track", "frame", (F.col("label") == "error").alias("cross"), (F.col("v") < 25).alias("near_l"), (F.col("v") > 75).alias("near_r"),
                 (F.col("label") == "purchase").alias("leg"), (F.col("conf") > 0.9).alias("roll"), (F.col("v") < 10).alias("near_antenna"))
    return S.classify_behaviour(t, K, "frame", link=6, sync=2, size=BLK).select("track", "frame", "behaviour")


@query(f"""WITH {TRACKS_CTE} SELECT track, frame, max(label = 'signup') OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS guarded FROM t""")
def g24_dilate(spark, sf):
    t = tracks(spark, sf).withColumn("hit", F.col("label") == "signup")
    return R.dilate(t, K, "frame", "hit", 2, name="guarded", size=BLK).select("track", "frame", "guarded")


@query(f"""WITH {TRACKS_CTE}, e AS (SELECT track, min(frame) AS lo, max(frame) AS hi FROM t GROUP BY track)
SELECT d.track, d.frame, round(d.v - sum(n.v) / 10.0, 6) AS detrended FROM t d JOIN e USING (track), (SELECT unnest(range(-5, 5)) AS k) o, t n
WHERE n.track = d.track AND n.frame = least(greatest(d.frame + k, lo), hi) GROUP BY d.track, d.frame, d.v""")
def g28_baseline_detrend(spark, sf):
    out = S.detrend_baseline(tracks(spark, sf), K, "frame", "v", window=10, name="detrended", size=BLK)
    return out.select("track", "frame", F.round("detrended", 6).alias("detrended"))


@query(f"""WITH {TRACKS_CTE}, c AS (SELECT *, sum(CASE WHEN label = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS cyc FROM t)
SELECT track, frame, round(v - avg(v) OVER (PARTITION BY track, cyc), 6) AS osc FROM c""")
def g28_cycle_oscillation(spark, sf):
    from strideframe.operators.ordered import running_sum

    t = running_sum(tracks(spark, sf), K, "frame", {"cyc": (F.col("label") == "click").cast("long")}, size=BLK)
    return S.minus_group_mean(t, [*K, "cyc"], "v", name="osc").select("track", "frame", F.round("osc", 6).alias("osc"))


@query(f"""{_GATED}, runs AS (SELECT track, min(frame) AS s, count(*) AS n FROM r WHERE ok GROUP BY track, grp),
 st AS (SELECT track, s, n, 0 AS a FROM runs WHERE n <= 4 UNION SELECT track, s, n, k * 2 AS a FROM runs, (SELECT unnest(range(100)) AS k) WHERE n > 4 AND k * 2 <= n - 4
        UNION SELECT track, s, n, n - 4 AS a FROM runs WHERE n > 4),
 w AS (SELECT *, row_number() OVER (PARTITION BY track, s ORDER BY a) - 1 AS win, lag(a) OVER (PARTITION BY track, s ORDER BY a) AS pa, lead(a) OVER (PARTITION BY track, s ORDER BY a) AS na FROM st)
SELECT track, s AS run_start, n AS run_n, win, s + a AS win_start, s + least(a + 4, n) - 1 AS win_end,
 s + CASE WHEN pa IS NULL THEN 0 ELSE (a + pa + 4) // 2 END AS own_start, s + CASE WHEN na IS NULL THEN n ELSE (na + a + 4) // 2 END - 1 AS own_end FROM w""")
def g31_run_windows(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5)
    return R.run_windows(t, K, "frame", "ok", 4, 2, size=BLK)


@query("""WITH iv AS (SELECT l_suppkey AS k, l_returnflag AS type, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity / 10 AS BIGINT) AS e FROM lineitem),
 m AS (SELECT *, max(e) OVER (PARTITION BY k, type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k, type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT k, type, min(s) AS start, max(e) AS "end" FROM g GROUP BY k, type, grp""")
def i4_interval_union(spark, sf):
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01")).cast("long")
    iv = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("type"), day.alias("start"), F.rint(day + F.col("l_quantity") / 10).cast("long").alias("end")
    )
    return R.interval_union(iv, ["k", "type"], size=256)
