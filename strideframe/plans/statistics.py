"""Statistics queries over cycles, conditions and angles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators import stats as S
from strideframe.plans.registry import query
from strideframe.plans.tables import TRACKS_CTE, table, tracks
from strideframe.plans.walking import _CY, click_cycles

K = ["track"]


def r6(df, *plain):
    return df.select(*[c if c in plain else F.round(c, 6).alias(c) for c in df.columns])


@query(f"""WITH {_CY}, m AS (SELECT track, cycle, avg(v) AS mv FROM cyc WHERE cycle IS NOT NULL GROUP BY ALL)
SELECT c.track, c.cycle, round(sqrt(avg((conf - 0.5) ** 2)), 6) AS h_rms, round(sqrt(avg((v - mv) ** 2)), 6) AS s_rms FROM cyc c JOIN m USING (track, cycle) GROUP BY ALL""")
def f26_cycle_amplitude(spark, sf):
    from strideframe.operators.series import minus_group_mean

    d = click_cycles(spark, sf).where(F.col("cycle").isNotNull())
    d = minus_group_mean(d, ["track", "cycle"], "v", name="s").withColumn("h", F.col("conf") - 0.5)
    return r6(S.rms(d, ["track", "cycle"], ["h", "s"]), "track", "cycle")


_BIN = "CAST(least(greatest(floor((atan2(sin(v / 20.0), cos(v / 20.0)) + pi()) / (2 * pi()) * 48), 0), 47) AS BIGINT)"


@query(f"WITH {TRACKS_CTE} SELECT {_BIN} AS bin, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, count(*) AS n FROM t GROUP BY 1")
def f27_phase_profile(spark, sf):
    d = tracks(spark, sf).withColumn("bin", S.phase_bin(V.wrap(F.col("v") / 20.0)))
    return r6(S.profile(d, ["bin"], "conf"), "bin", "n")


def _poisson_sql(u: str) -> str:
    p, total, out = math.exp(-1.0), 0.0, []
    for k in range(13):
        total += p
        out.append(f"CASE WHEN {u} >= {total!r} THEN 1 ELSE 0 END")
        p /= k + 1
    return "(" + " + ".join(out) + ")"


def _hash_sql(*parts) -> str:
    text = " || '|' || ".join(str(p) for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / {float(16**12)!r})"


@query(f"""WITH {_CY}, cells AS (SELECT track, cycle, {_BIN} // 12 AS bin, avg(conf) AS x FROM cyc WHERE cycle IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, CAST(floor({_hash_sql("'42'", "'a'", 'track', 'cycle')} * 2147483647) AS BIGINT) AS s, CAST(floor({_hash_sql("'42'", "'b'", 'track', 'cycle')} * 2147483646) AS BIGINT) + 1 AS t FROM cells),
 r AS (SELECT bin, rep, {_poisson_sql('u')} AS w, x FROM (SELECT *, ((s + rep * t) % 2147483647) / 2147483647.0 AS u FROM k, (SELECT unnest(range(1000)) AS rep))),
 m AS (SELECT bin, rep, sum(w * x) / nullif(sum(w), 0) AS m FROM r GROUP BY bin, rep), b AS (SELECT bin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY bin)
SELECT c.bin, round(avg(x), 6) AS mean, count(*) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM cells c JOIN b USING (bin) GROUP BY c.bin""")
def f28_cluster_bootstrap(spark, sf):
    d = click_cycles(spark, sf).where(F.col("cycle").isNotNull())
    d = d.withColumn("bin", F.floor(S.phase_bin(V.wrap(F.col("v") / 20.0)) / 12))
    cells = d.groupBy("track", "cycle", "bin").agg(F.avg("conf").alias("x"))
    return r6(S.cluster_bootstrap(cells, [], ["track", "cycle"], "bin", "x", n_boot=1000, seed=42), "bin", "n")


def _p_sql(at: str, density: str, steps: int = 2000) -> str:
    """1 - 2 times the integral of an even density from 0 to ``at`` by Simpson's rule (``x`` is the variable)."""
    return f"(1 - 2 * (SELECT sum(w * {density}) * any_value(h) / 3 FROM (SELECT least({at}, 40) / {steps} AS h, i * least({at}, 40) / {steps} AS x, CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range({steps + 1}) r(i))))"


_LI = "li AS (SELECT l_orderkey, l_linenumber, l_returnflag AS cond, l_extendedprice / l_quantity AS speed, l_discount * 7.3 + l_tax AS amp FROM lineitem)"


def conditions(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("cond"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("speed"),
        (F.col("l_discount") * 7.3 + F.col("l_tax")).alias("amp"),
    )


@query(f"""WITH {_LI}, q AS (SELECT quantile_cont(speed, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM li)
SELECT 1 + len(list_filter(e, lambda b: speed > b)) AS bin, count(*) AS n, round(avg(amp), 6) AS mean, round(stddev_samp(amp), 6) AS sd, round(avg(speed), 6) AS mean_speed FROM li, q GROUP BY 1""")
def f29_quantile_bins(spark, sf):
    d = S.quantile_bin(conditions(spark, sf), "speed", 8, name="bin")
    a = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("amp").alias("mean"), F.stddev_samp("amp").alias("sd"), F.avg("speed").alias("mean_speed"))
    return r6(a, "bin", "n")


@query(f"""WITH {_LI}, q AS (SELECT quantile_cont(speed, 0.01) AS s0, quantile_cont(speed, 0.99) AS s1, quantile_cont(amp, 0.01) AS a0, quantile_cont(amp, 0.99) AS a1 FROM li)
SELECT cond, round(regr_slope(amp, speed), 9) AS slope, round(regr_intercept(amp, speed), 6) AS intercept, round(corr(amp, speed), 6) AS r, count(*) AS n FROM li, q WHERE speed BETWEEN s0 AND s1 AND amp BETWEEN a0 AND a1 GROUP BY cond""")
def f30_regression(spark, sf):
    d = S.clip_percentiles(conditions(spark, sf), ["speed", "amp"])
    r = S.regression(d, ["cond"], "speed", "amp")
    return r.select("cond", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r", 6).alias("r"), "n")


@query(f"""WITH {_LI}, s AS (SELECT cond, corr(amp, speed) AS r, CAST(count(*) - 2 AS DOUBLE) AS df FROM li GROUP BY cond), t AS (SELECT cond, r, df, abs(r) * sqrt(df / (1 - r * r)) AS tt FROM s)
SELECT cond, round(r, 6) AS r, round(greatest({_p_sql("tt", "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2)")}, 0), 6) AS p FROM t""")
def f30_regression_p(spark, sf):
    return S.regression(conditions(spark, sf), ["cond"], "speed", "amp").select("cond", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query(f"""WITH {_LI}, v AS (SELECT speed, count(*) FILTER (cond = 'A') AS a, count(*) FILTER (cond = 'R') AS b FROM li WHERE cond IN ('A', 'R') GROUP BY speed),
 c AS (SELECT sum(a) OVER (ORDER BY speed) / (SELECT sum(a) FROM v) AS fa, sum(b) OVER (ORDER BY speed) / (SELECT sum(b) FROM v) AS fb FROM v), d AS (SELECT max(abs(fa - fb)) AS ks, (SELECT CAST(sum(a) AS DOUBLE) FROM v) AS n1, (SELECT CAST(sum(b) AS DOUBLE) FROM v) AS n2 FROM c),
 l AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * ks AS t FROM d)
SELECT round(ks, 6) AS ks, round(CASE WHEN t < 0.04 THEN 1 ELSE least(greatest(2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * t * t)) FROM range(1, 101) r(k)), 0), 1) END, 6) AS p FROM l""")
def f35_kolmogorov_p(spark, sf):
    k = S.kolmogorov_smirnov(conditions(spark, sf), "cond", "speed", "A", "R")
    return k.select(F.round("ks", 6).alias("ks"), F.round(S.kolmogorov_p(F.col("ks"), F.col("n_a"), F.col("n_b")), 6).alias("p"))


@query(f"""WITH {TRACKS_CTE}, a AS (SELECT track, atan2(sin(v / 20.0), cos(v / 20.0)) AS x FROM t), c AS (SELECT track, avg(cos(x)) AS c, avg(sin(x)) AS s, count(*) AS n FROM a GROUP BY track),
 d AS (SELECT p.track, p.x, round(sum(pi() - abs(pi() - abs(p.x - q.x))), 9) AS cost FROM (SELECT DISTINCT track, x FROM a) p JOIN a q USING (track) GROUP BY p.track, p.x),
 m AS (SELECT track, x, row_number() OVER (PARTITION BY track ORDER BY cost, x) AS rn FROM d)
SELECT c.track, round(atan2(s, c), 6) AS mean_dir, round(sqrt(c * c + s * s), 6) AS resultant, n, round(x, 6) AS median_dir FROM c JOIN m ON m.track = c.track AND rn = 1""")
def f31_circular_statistics(spark, sf):
    a = tracks(spark, sf).select("track", V.wrap(F.col("v") / 20.0).alias("x"))
    return r6(S.circular_mean(a, K, "x").join(S.circular_median(a, K, "x", size=32), K), "track", "n")


@query(f"""WITH {_LI}, b AS (SELECT cond, bin, count(l.amp) AS count FROM (SELECT DISTINCT cond FROM li) c CROSS JOIN (SELECT unnest(range(10)) AS bin) k
  LEFT JOIN (SELECT cond, amp, CAST(least(floor(amp / 0.09), 9) AS BIGINT) AS bin FROM li WHERE amp BETWEEN 0 AND 0.9) l USING (cond, bin) GROUP BY ALL)
SELECT cond, bin, count, round(count / sum(count) OVER (PARTITION BY cond), 6) AS share FROM b""")
def f32_histogram(spark, sf):
    return r6(S.histogram(conditions(spark, sf), ["cond"], "amp", [0.09 * i for i in range(11)]), "cond", "bin", "count")


@query(f"""WITH {_CY}, d AS (SELECT track, cycle, conf FROM cyc WHERE cycle IS NOT NULL), n AS (SELECT track, cycle, count(*) AS n, count(*) FILTER (conf * 1.01 <= 1) AS m FROM d GROUP BY ALL HAVING count(*) >= 2),
 h AS (SELECT track, cycle, k.bin, count(d.conf) AS c, any_value(m) AS m FROM n CROSS JOIN (SELECT unnest(range(5)) AS bin) k LEFT JOIN (SELECT *, CAST(least(floor(conf * 1.01 / 0.2), 4) AS BIGINT) AS bin FROM d WHERE conf * 1.01 <= 1) d USING (track, cycle, bin) GROUP BY ALL)
SELECT bin, round(avg(CASE WHEN m > 0 THEN c / m ELSE 0 END / 0.2), 6) AS density, count(*) AS n_clusters FROM h GROUP BY bin""")
def f32_mean_density(spark, sf):
    d = click_cycles(spark, sf).where(F.col("cycle").isNotNull()).withColumn("x", F.col("conf") * 1.01)
    return r6(S.mean_density(d, [], ["track", "cycle"], "x", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), "bin", "n_clusters")


@query(f"WITH {_LI} SELECT cond, round(median(speed) - avg(speed), 6) AS median, round(quantile_cont(speed, 0.95) - quantile_cont(speed, 0.05), 6) AS rom FROM li GROUP BY cond")
def f32_range_of_motion(spark, sf):
    return r6(S.range_of_motion(conditions(spark, sf), ["cond"], "speed"), "cond")


_GRID = [5.0 * i for i in range(24)]


@query(f"""WITH {TRACKS_CTE}, b AS (SELECT 1.06 * stddev_samp(v) * pow(count(*), -0.2) AS bw, count(*) AS n FROM t)
SELECT CAST(x AS DOUBLE) AS x, round(sum(exp(-0.5 * ((x - v) / bw) ** 2)) / sqrt(2 * pi()) / any_value(n * bw), 9) AS density FROM t, b, (SELECT unnest({_GRID}) AS x) GROUP BY x""")
def f33_kde_1d(spark, sf):
    return S.kde_1d(tracks(spark, sf), "v", _GRID).select("x", F.round("density", 9).alias("density"))


_GX, _GY = [2.0 * i - 1.0 for i in range(12)], [0.125 * i - 0.1 for i in range(12)]


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT track % 2 AS cond, v / 7.3 AS x, conf AS y FROM t),
 s AS (SELECT cond, var_samp(x) * pow(count(*), -1.0 / 3) AS vx, var_samp(y) * pow(count(*), -1.0 / 3) AS vy, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS vxy FROM p GROUP BY cond),
 g AS (SELECT cond, i, j, sum(exp(-0.5 * (vy * (gx - x) ** 2 - 2 * vxy * (gx - x) * (gy - y) + vx * (gy - y) ** 2) / (vx * vy - vxy * vxy))) AS d FROM p JOIN s USING (cond),
   (SELECT i, {_GX}[i + 1] AS gx FROM (SELECT unnest(range(12)) AS i)), (SELECT j, {_GY}[j + 1] AS gy FROM (SELECT unnest(range(12)) AS j)) GROUP BY cond, i, j),
 n AS (SELECT cond, i, j, d / (sum(d) OVER (PARTITION BY cond) * 0.25) AS d FROM g),
 c AS (SELECT *, sum(d) OVER (PARTITION BY cond ORDER BY d DESC, i, j ROWS UNBOUNDED PRECEDING) * 0.25 AS mass FROM n),
 l AS (SELECT cond, f AS fraction, max(d) AS level FROM c, (SELECT unnest([0.5, 0.9]) AS f) WHERE mass >= f GROUP BY cond, f)
SELECT l.cond, fraction, round(level, 6) AS level, round(count(*) * 0.25, 6) AS area FROM l JOIN n ON n.cond = l.cond AND n.d >= level GROUP BY ALL""")
def f33_density_regions(spark, sf):
    p = tracks(spark, sf).select((F.col("track") % 2).alias("cond"), (F.col("v") / 7.3).alias("x"), F.col("conf").alias("y"))
    d = S.kde_2d(p, ["cond"], "x", "y", _GX, _GY)
    return r6(S.density_regions(d, ["cond"], 0.25, [0.5, 0.9]), "cond", "fraction")


@query(f"""WITH {_LI}, c AS (SELECT cond, var_samp(speed / 1000) AS a, var_samp(amp) AS c, covar_samp(speed / 1000, amp) AS b, var_pop(speed / 1000) + var_pop(amp) AS p, count(*) AS n FROM li GROUP BY cond)
SELECT cond, n, round(1.177 * sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)), 6) AS semi_major, round(1.177 * sqrt((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b)), 6) AS semi_minor,
 round(degrees(atan2(2 * b, a - c) / 2), 6) AS angle_deg, round(pi() * 5.991 * sqrt(a * c - b * b), 6) AS area95, round(sqrt(p), 6) AS dispersion FROM c""")
def f34_ellipse(spark, sf):
    d = conditions(spark, sf).withColumn("x", F.col("speed") / 1000)
    return r6(S.ellipse(d, ["cond"], "x", "amp"), "cond", "n")


@query(f"""WITH {_LI}, s AS (SELECT avg(speed) FILTER (cond = 'A') AS ma, avg(speed) FILTER (cond = 'R') AS mb, var_samp(speed) FILTER (cond = 'A') AS va, var_samp(speed) FILTER (cond = 'R') AS vb,
  count(*) FILTER (cond = 'A') AS na, count(*) FILTER (cond = 'R') AS nb FROM li)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d, na AS n_a, nb AS n_b FROM s""")
def f35_cohen_d(spark, sf):
    return r6(S.cohen_d(conditions(spark, sf), "cond", "speed", "A", "R"), "n_a", "n_b")


@query(f"""WITH {_LI}, r AS (SELECT cond, amp, rank() OVER (ORDER BY amp) + (count(*) OVER (PARTITION BY amp) - 1) / 2.0 AS rk FROM li WHERE cond IN ('A', 'R')),
 t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY amp)), s AS (SELECT sum(rk) FILTER (cond = 'A') AS ra, CAST(count(*) FILTER (cond = 'A') AS DOUBLE) AS n1, CAST(count(*) FILTER (cond = 'R') AS DOUBLE) AS n2 FROM r),
 u AS (SELECT ra - n1 * (n1 + 1) / 2 AS u, n1, n2, n1 + n2 AS n, ties FROM s, t)
SELECT round(u, 6) AS u, round(z, 6) AS z, CAST(n1 AS BIGINT) AS n_a, CAST(n2 AS BIGINT) AS n_b, round(greatest({_p_sql("z", "exp(-x * x / 2) / sqrt(2 * pi())")}, 0), 6) AS p FROM (SELECT *, greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM u)""")
def f35_mann_whitney(spark, sf):
    return r6(S.mann_whitney(conditions(spark, sf), "cond", "amp", "A", "R"), "n_a", "n_b")


@query(f"""WITH {_LI}, v AS (SELECT amp, count(*) FILTER (cond = 'A') AS a, count(*) FILTER (cond = 'R') AS b FROM li WHERE cond IN ('A', 'R') GROUP BY amp),
 c AS (SELECT sum(a) OVER (ORDER BY amp) / (SELECT sum(a) FROM v) AS fa, sum(b) OVER (ORDER BY amp) / (SELECT sum(b) FROM v) AS fb FROM v)
SELECT round(max(abs(fa - fb)), 6) AS ks, (SELECT CAST(sum(a) AS BIGINT) FROM v) AS n_a, (SELECT CAST(sum(b) AS BIGINT) FROM v) AS n_b FROM c""")
def f35_kolmogorov_smirnov(spark, sf):
    return r6(S.kolmogorov_smirnov(conditions(spark, sf), "cond", "amp", "A", "R"), "n_a", "n_b")


_N_PERM = 20000


def _t2_sql(n1, n2):
    def cov(t, n, i, k):
        return f"({t}{i}{k} - {t}{i} * {t}{k} / {n})"

    sxx, sxy, syy = (f"(({cov('a', n1, i, k)} + {cov('b', n2, i, k)}) / ({n1} + {n2} - 2))" for i, k in (("x", "x"), ("x", "y"), ("y", "y")))
    dx, dy = f"(ax / {n1} - bx / {n2})", f"(ay / {n1} - by_ / {n2})"
    out = f"{n1} * {n2} / ({n1} + {n2}) * ({syy} * {dx} * {dx} - 2 * {sxy} * {dx} * {dy} + {sxx} * {dy} * {dy}) / ({sxx} * {syy} - {sxy} * {sxy})"
    return out.replace(" by *", " by_ *").replace("* by /", "* by_ /").replace("(by_ *", "(by_ *")


@query(f"""WITH {TRACKS_CTE}, un AS (SELECT track AS unit, track % 3 = 0 AS a, median(v) AS x, median(conf) AS y FROM t GROUP BY track),
 r AS (SELECT unit, x, y, rep, CASE WHEN rep = 0 THEN CASE WHEN a THEN 0.25 ELSE 0.75 END ELSE {_hash_sql("'0'", 'rep', 'unit', "CASE WHEN a THEN 'true' ELSE 'false' END")} END AS u FROM un, (SELECT unnest(range({_N_PERM} + 1)) AS rep)),
 f AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY u, unit) <= (SELECT count(*) FROM un WHERE a) AS g FROM r),
 s AS (SELECT rep, {', '.join(f"sum(CASE WHEN {'g' if t == 'a' else 'NOT g'} THEN {e} ELSE 0 END) AS {t}{n}{'_' if t + n == 'by' else ''}" for t in 'ab' for n, e in (('x', 'x'), ('y', 'y'), ('xx', 'x * x'), ('xy', 'x * y'), ('yy', 'y * y')))},
   CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2 FROM f GROUP BY rep), q AS (SELECT rep, {_t2_sql('n1', 'n2')} AS t2 FROM s)
SELECT round(any_value(o.t2), 6) AS t2, round((count(*) FILTER (q.rep > 0 AND q.t2 >= o.t2) + 1) / {_N_PERM + 1.0}, 6) AS p FROM q, (SELECT t2 FROM q WHERE rep = 0) o""")
def f35_hotelling_permutation(spark, sf):
    t = tracks(spark, sf)
    # A unit is one track; the medians are small per unit in the test tables.
    from strideframe.operators.quantiles import exact_median

    un = exact_median(t, K, "v", "x").join(exact_median(t, K, "conf", "y"), K)
    un = un.select(F.col("track").alias("unit"), (F.col("track") % 3 == 0).alias("grp"), "x", "y")
    return r6(S.hotelling_permutation(un, "grp", "x", "y", "unit", True, False, n_perm=_N_PERM))


@query("""WITH p AS (SELECT l_returnflag || l_linestatus AS test, count(*) / 400000.0 AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS n FROM p)
SELECT test, round(p, 6) AS p, round(least(max((n - i + 1) * p) OVER (ORDER BY i), 1), 6) AS p_holm FROM r""")
def f35_holm(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("test")).agg((F.count(F.lit(1)) / 400000.0).alias("p"))
    return r6(S.holm(p, "p"), "test")


@query(f"""WITH {_LI}, r AS (SELECT l_orderkey * 8 + l_linenumber AS id, speed, floor((speed - 1000) / 100) AS bin FROM li WHERE cond = 'N' AND speed >= 1000), d AS (SELECT * FROM r),
 g AS (SELECT floor((speed - 1000) / 100) AS bin, count(*) AS nt FROM li WHERE cond = 'R' AND speed >= 1000 GROUP BY 1), n AS (SELECT bin, nt, nr FROM g JOIN (SELECT bin, count(*) AS nr FROM d GROUP BY bin) USING (bin)),
 f AS (SELECT bin, round_even(nt * (SELECT min(nr / nt) FROM n), 0) AS want FROM n), k AS (SELECT d.id, d.speed, row_number() OVER (PARTITION BY bin ORDER BY {_hash_sql("'0'", 'd.id')}, d.id, d.speed) AS i, want FROM d JOIN f USING (bin))
SELECT id, round(speed, 6) AS speed FROM k WHERE i <= want""")
def e19_histogram_match(spark, sf):
    c = conditions(spark, sf).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    ref = c.where((F.col("cond") == "N") & (F.col("speed") >= 1000))
    kept, _ = S.histogram_match(ref, c.where(F.col("cond") == "R"), "speed", "id", width=100.0, floor=1000.0)
    return kept.select("id", F.round("speed", 6).alias("speed"))


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT track, frame, CASE WHEN label IN ('click', 'view') THEN 'height' ELSE 'speed' END AS signal, CASE WHEN conf < 0.5 THEN 'early' ELSE 'late' END AS lobe, frame // 10 AS cycle,
   atan2(sin(v / 20.0), cos(v / 20.0)) AS phase, v AS prom FROM t),
 b AS (SELECT track, cycle, lobe, signal, arg_max(phase, (prom, -frame)) AS phase FROM p GROUP BY ALL),
 j AS (SELECT h.track, h.cycle, h.lobe, h.phase AS h, s.phase AS s FROM b h JOIN b s ON s.track = h.track AND s.cycle = h.cycle AND s.lobe = h.lobe AND h.signal = 'height' AND s.signal = 'speed')
SELECT track, cycle, lobe, round(atan2(sin(h - s), cos(h - s)), 6) AS dphi, round(atan2(sin(h) + sin(s), cos(h) + cos(s)), 6) AS mid FROM j""")
def e21_peak_pairs(spark, sf):
    from strideframe.operators.peaks import pair_peaks

    t = tracks(spark, sf).select(
        "track", "frame", F.when(F.col("label").isin("click", "view"), "height").otherwise("speed").alias("signal"), F.when(F.col("conf") < 0.5, "early").otherwise("late").alias("lobe"),
        F.floor(F.col("frame") / 10).alias("cycle"), V.wrap(F.col("v") / 20.0).alias("phase"), F.col("v").alias("prominence"),
    )
    return r6(pair_peaks(t, ["track", "cycle", "lobe"], "signal", "height", "speed", "frame"), "track", "cycle", "lobe")


@query(f"""WITH {TRACKS_CTE} SELECT track, count(*) AS n_frames, round(avg(CASE WHEN label = 'click' THEN 1.0 ELSE 0.0 END), 6) AS frac_click, round(avg(CASE WHEN label = 'view' THEN 1.0 ELSE 0.0 END), 6) AS frac_view FROM t WHERE conf >= 0.2 GROUP BY track""")
def f23_label_shares(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.2)
    return r6(S.label_summary(t, K, "label", ["click", "view"], "ok"), "track", "n_frames")


@query(f"WITH {TRACKS_CTE} SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM t WHERE conf >= 0.2 GROUP BY label")
def f23_metric_by_label(spark, sf):
    return r6(S.profile(tracks(spark, sf).where(F.col("conf") >= 0.2), ["label"], "v"), "label", "n")


_CL = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH {TRACKS_CTE}, w AS (SELECT track, frame AS a, frame + 3 AS b, label AS truth FROM t WHERE conf > 0.95), j AS (SELECT truth, label FROM t JOIN w ON w.track = t.track AND t.frame BETWEEN a AND b)
SELECT truth, {', '.join(f"count(*) FILTER (label = '{c}') AS {c}" for c in _CL)}, round(avg(CASE WHEN label = truth THEN 1.0 ELSE 0.0 END), 6) AS recall FROM j GROUP BY truth""")
def f44_behaviour_confusion(spark, sf):
    from strideframe.operators.joins import interval_join

    t = tracks(spark, sf).select("track", "frame", "label", "conf")
    w = t.where(F.col("conf") > 0.95).select("track", F.col("frame").alias("a"), (F.col("frame") + 3).alias("b"), F.col("label").alias("truth"))
    j = interval_join(t, w, K, "frame", "a", "b", width=16)
    return r6(S.confusion(j, "truth", "label", _CL), "truth", *_CL)


@query(f"WITH {TRACKS_CTE} SELECT track // 10 AS bout, label, round(count(*) / sum(count(*)) OVER (PARTITION BY track // 10), 6) AS share FROM t GROUP BY 1, 2")
def f44_composition(spark, sf):
    t = tracks(spark, sf).withColumn("bout", F.floor(F.col("track") / 10))
    per = t.groupBy("bout", "label").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("bout").agg(F.sum("n").alias("t"))
    return per.join(tot, "bout").select("bout", "label", F.round(F.col("n") / F.col("t"), 6).alias("share"))
