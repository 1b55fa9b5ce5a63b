"""Song: envelopes by zero-phase filters, and tone windows, with SQL twins that filter row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators import recursive as R
from strideframe.operators import song as S
from strideframe.operators.ordered import BLOCK
from strideframe.plans.registry import query
from strideframe.plans.tables import TRACKS_CTE, tracks

FPS = 800.0
HALF = 24
BAND, LOW, SINE = (200.0, 380.0), 60.0, (80.0, 200.0)
ORDER = 2


def _lists(*rows) -> str:
    return ", ".join("(" + ", ".join(repr(float(x)) if isinstance(x, float | np.floating) else str(x) for x in r) + ")" for r in rows)


def zero_phase_sql(src: str, value: str, out: str, b, a) -> str:
    """CTEs that end in ``out(track, frame, y)``: the filter run forward, then backward, one row at a time."""
    kernel = R.Kernel.of(b, a)
    a, b = np.asarray(a) / a[0], np.asarray(b) / a[0]
    n, reach = kernel.order, 3 * max(len(a), len(b))
    rest = ", ".join(f"{x!r} * u" for x in map(float, kernel.rest()))
    step = ", ".join(f"{f'x[{i + 1}] + ' if i < n else ''}{float(b[i])!r} * u - ({float(a[i])!r}) * y" for i in range(1, n + 1))

    def run(name: str, rows: str, by: int) -> str:
        edge = "min" if by > 0 else "max"
        first = f"SELECT p.track, p.o, p.u, [{rest}] AS x FROM {rows} p JOIN (SELECT track, {edge}(o) AS o FROM {rows} GROUP BY track) e ON e.track = p.track AND e.o = p.o"
        out = f"SELECT track, o, y, [{step}] AS x FROM (SELECT track, o, u, x, {float(b[0])!r} * u + x[1] AS y FROM"
        return f"{name} AS ({out} ({first})) UNION ALL {out} (SELECT p.track, p.o, p.u, q.x FROM {name} q JOIN {rows} p ON p.track = q.track AND p.o = q.o + {by})))"

    return f"""{out}_s AS (SELECT track, frame, {value} AS v FROM {src}), {out}_e AS (SELECT track, max(frame) AS hi, arg_min(v, frame) AS v0, arg_max(v, frame) AS v1 FROM {out}_s GROUP BY track),
 {out}_p AS MATERIALIZED (SELECT track, frame AS o, v AS u FROM {out}_s UNION ALL SELECT s.track, -frame, 2 * v0 - v FROM {out}_s s JOIN {out}_e e ON e.track = s.track WHERE frame BETWEEN 1 AND {reach}
  UNION ALL SELECT s.track, 2 * hi - frame, 2 * v1 - v FROM {out}_s s JOIN {out}_e e ON e.track = s.track WHERE hi - frame BETWEEN 1 AND {reach}),
 {run(f"{out}_f", f"{out}_p", 1)}, {out}_q AS MATERIALIZED (SELECT track, o, y AS u FROM {out}_f), {run(f"{out}_b", f"{out}_q", -1)},
 {out} AS MATERIALIZED (SELECT b.track, b.o AS frame, b.y FROM {out}_b b JOIN {out}_s s ON s.track = b.track AND s.frame = b.o)"""


def _envelope_sql(tag: str, band) -> str:
    taps = R.quadrature_weights(HALF)
    both = [zero_phase_sql("w", v, f"{tag}{v}", *R.butterworth(ORDER, band, FPS)) for v in ("zl", "zr")]
    parts = [
        f"(SELECT x.track, x.frame, any_value(x.y) AS y, sum(n.y * h.h) AS q FROM {tag}{v} x JOIN h ON true JOIN {tag}{v} n ON n.track = x.track AND n.frame = x.frame - h.k GROUP BY x.track, x.frame) {v}"
        for v in ("zl", "zr")
    ]
    return f"""{both[0]}, {both[1]}, h AS (SELECT * FROM (VALUES {_lists(*zip(range(-HALF, HALF + 1), taps, strict=True))}) AS h(k, h)),
 {tag}env AS MATERIALIZED (SELECT zl.track, zl.frame, greatest(sqrt(zl.y * zl.y + zl.q * zl.q), sqrt(zr.y * zr.y + zr.q * zr.q)) AS env, greatest(abs(zl.y), abs(zr.y)) AS bp_max
  FROM {parts[0]} JOIN {parts[1]} ON zr.track = zl.track AND zr.frame = zl.frame)"""


# Two wings: the signal itself (missing where its confidence is low), and a shifted mix of both columns.
_WINGS = f"""{TRACKS_CTE}, w0 AS (SELECT track, frame, CASE WHEN conf >= 0.1 THEN v END AS v, conf * 100 + v % 7 AS zr FROM t),
 w1 AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS a, min(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY track ORDER BY frame DESC) AS b FROM w0),
 w AS MATERIALIZED (SELECT o.track, o.frame, o.zr, CASE WHEN o.v IS NOT NULL THEN o.v ELSE coalesce(p.v + (n.v - p.v) * ((o.frame - o.a) / (o.b - o.a)), p.v, n.v, 0) END AS zl
  FROM w1 o LEFT JOIN w0 p ON p.track = o.track AND p.frame = o.a LEFT JOIN w0 n ON n.track = o.track AND n.frame = o.b)"""


def wings(spark, sf):
    t = tracks(spark, sf)
    return t.select("track", "frame", F.when(F.col("conf") >= 0.1, F.col("v")).alias("zl"), (F.col("conf") * 100 + F.col("v") % 7).alias("zr"))


_SHAPE = {"filter_order": ORDER, "half": HALF, "size": BLOCK}
_LP = zero_phase_sql("penv", "env", "lp", *R.butterworth(ORDER, LOW, FPS))
_ENV = f"WITH RECURSIVE {_WINGS}, {_envelope_sql('p', BAND)}, {_LP}"


@query(f"{_ENV} SELECT e.track, e.frame, round(e.env, 5) AS env, round(lp.y, 5) AS env_lp, round(e.bp_max, 5) AS bp_max FROM penv e JOIN lp USING (track, frame)")
def g15_envelope(spark, sf):
    e = S.pulse_envelope(wings(spark, sf), ["track"], "frame", "zl", "zr", fps=FPS, band=BAND, lowpass=LOW, **_SHAPE)
    return e.select("track", "frame", *[F.round(c, 5).alias(c) for c in ("env", "env_lp", "bp_max")])


def _thinned_sql(src: str, out: str, distance: int) -> str:
    return f"""{out}_r AS MATERIALIZED (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY height DESC, frame DESC) AS k FROM {src}),
 {out}_n AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM {src} UNION ALL SELECT n.track, r.k, CASE WHEN len(list_filter(n.kept, lambda x: abs(x - r.frame) < {distance})) > 0 THEN n.kept ELSE list_append(n.kept, r.frame) END
  FROM {out}_n n JOIN {out}_r r ON r.track = n.track AND r.k = n.k + 1),
 {out} AS MATERIALIZED (SELECT s.* FROM {src} s JOIN (SELECT track, unnest(arg_max(kept, k)) AS frame FROM {out}_n GROUP BY track) u ON u.track = s.track AND u.frame = s.frame)"""


_PEAKS = f"""{_ENV}, floors AS (SELECT track, quantile_cont(bp_max, 0.5) AS floor FROM penv GROUP BY track),
 c0 AS MATERIALIZED (SELECT l.track, l.frame, l.y AS height FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM lp WINDOW w AS (PARTITION BY track ORDER BY frame)) l JOIN floors f ON f.track = l.track WHERE y > a AND y > b AND y >= 1.2 * floor),
 {_thinned_sql("c0", "c1", 4)}, {_thinned_sql("c1", "c2", 7)}, {_envelope_sql("q", SINE).replace("h AS (SELECT * FROM (VALUES", "h2 AS (SELECT * FROM (VALUES").replace("JOIN h ON", "JOIN h2 h ON")},
 m AS (SELECT p.track, p.frame, avg(p.env) OVER w AS p, avg(q.env) OVER w AS q FROM penv p JOIN qenv q ON q.track = p.track AND q.frame = p.frame WINDOW w AS (PARTITION BY p.track ORDER BY p.frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query(f"{_PEAKS} SELECT c2.track, c2.frame, round(c2.height, 5) AS height FROM c2 JOIN m USING (track, frame) WHERE m.q <= 0 OR m.p >= 0.5 * m.q")
def g15_envelope_peaks(spark, sf):
    p = S.envelope_peaks(wings(spark, sf), ["track"], "frame", "zl", "zr", fps=FPS, band=BAND, sine_band=SINE, lowpass=LOW, threshold=1.2, min_distance=4, dedupe=6, mask_half=3, ratio=0.5, **_SHAPE)
    return p.select("track", "frame", F.round("height", 5).alias("height"))


# Tones: windows of 16 rows every 4, three tapers, the bins from 100 to 350.
_W, _HOP, _K, _NW = 16, 4, 3, 2.0
_TONE = {"fps": FPS, "band": (80.0, 350.0), "filter_order": ORDER, "window": _W, "hop": _HOP, "test_band": (100.0, 350.0), "bandwidth": _NW, "tapers": _K, "p_max": 0.2, "size": BLOCK}
_TAPER = R.slepian(_W, _NW, _K)
_E = float((_TAPER.sum(1) ** 2).sum())
_SINE = f"""WITH RECURSIVE {_WINGS}, g0 AS (SELECT track, frame, CASE WHEN zr % 11 < 2 THEN 1.0 ELSE 0.0 END AS pulse, zl FROM w),
 g1 AS (SELECT *, max(CASE WHEN pulse = 0 THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS a, min(CASE WHEN pulse = 0 THEN frame END) OVER (PARTITION BY track ORDER BY frame DESC) AS b FROM g0),
 g AS MATERIALIZED (SELECT o.track, o.frame, o.pulse, CASE WHEN o.pulse = 0 THEN o.zl ELSE coalesce(p.zl + (n.zl - p.zl) * ((o.frame - o.a) / (o.b - o.a)), p.zl, n.zl, 0) END AS z
  FROM g1 o LEFT JOIN g0 p ON p.track = o.track AND p.frame = o.a LEFT JOIN g0 n ON n.track = o.track AND n.frame = o.b),
 {zero_phase_sql("g", "z", "bp", *R.butterworth(ORDER, (80.0, 350.0), FPS))},
 tap AS (SELECT * FROM (VALUES {_lists(*[(k, i, _TAPER[k, i]) for k in range(_K) for i in range(_W)])}) AS t(k, i, h)), u AS (SELECT k, sum(h) AS u FROM tap GROUP BY k),
 fr AS (SELECT i * {FPS / _W} AS f FROM range({_W // 2 + 1}) r(i) WHERE i * {FPS / _W} BETWEEN 100 AND 350),
 ws AS (SELECT b.track, b.frame AS start FROM bp b JOIN bp_e e ON e.track = b.track WHERE b.frame % {_HOP} = 0 AND b.frame + {_W} - 1 <= e.hi),
 x AS MATERIALIZED (SELECT s.track, s.start, b.frame - s.start AS i, b.y, g.pulse FROM ws s JOIN bp b ON b.track = s.track AND b.frame BETWEEN s.start AND s.start + {_W - 1} JOIN g ON g.track = b.track AND g.frame = b.frame),
 sp AS (SELECT x.track, x.start, k, f, sum(y * h * cos(2 * pi() * f * x.i / {FPS})) AS re, -sum(y * h * sin(2 * pi() * f * x.i / {FPS})) AS im FROM x JOIN tap ON tap.i = x.i, fr GROUP BY x.track, x.start, k, f),
 ln AS (SELECT track, start, f, sum(re * u) / {_E!r} AS lr, sum(im * u) / {_E!r} AS li FROM sp JOIN u USING (k) GROUP BY track, start, f),
 fs AS (SELECT sp.track, sp.start, sp.f, any_value({_K - 1} * (lr * lr + li * li) * {_E!r}) / sum((re - lr * u) * (re - lr * u) + (im - li * u) * (im - li * u)) AS f_stat
  FROM sp JOIN u USING (k) JOIN ln ON ln.track = sp.track AND ln.start = sp.start AND ln.f = sp.f GROUP BY sp.track, sp.start, sp.f),
 top AS (SELECT track, start, arg_max(f, f_stat) AS freq, max(f_stat) AS f_stat FROM fs GROUP BY track, start),
 pw AS (SELECT track, start, avg(y * y) AS power, avg(pulse) AS pulse_share FROM x GROUP BY track, start), fl AS (SELECT track, quantile_cont(power, 0.25) AS floor FROM pw WHERE power > 0 GROUP BY track),
 win AS MATERIALIZED (SELECT top.track, CAST(top.start / {_HOP} AS BIGINT) AS win, top.start, freq, f_stat, pow(1 + f_stat / {_K - 1}, -{_K - 1}) AS p, power, pulse_share,
  pow(1 + f_stat / {_K - 1}, -{_K - 1}) < 0.2 AND pulse_share <= 0.5 AND power >= 0.5 * coalesce(floor, 0) AS sine FROM top JOIN pw USING (track, start) LEFT JOIN fl USING (track))"""


def _tones(spark, sf):
    t = wings(spark, sf).withColumn("pulse", F.col("zr") % 11 < 2)
    return S.sine_windows(t, ["track"], "frame", "zl", "pulse", **_TONE)


@query(f"{_SINE} SELECT track, win, start, round(freq, 4) AS freq, round(f_stat, 4) AS f_stat, round(p, 5) AS p, round(power, 4) AS power, round(pulse_share, 4) AS pulse_share, sine FROM win")
def g16_sine_windows(spark, sf):
    w = _tones(spark, sf)
    return w.select("track", "win", "start", *[F.round(c, n).alias(c) for c, n in (("freq", 4), ("f_stat", 4), ("p", 5), ("power", 4), ("pulse_share", 4))], "sine")


_CHAIN = f"""{_SINE}, rk AS MATERIALIZED (SELECT track, win, start, freq, row_number() OVER (PARTITION BY track ORDER BY win) AS k FROM win WHERE sine),
 ch AS (SELECT track, k, win AS last, start, start + {_W} AS stop, [freq] AS fs, CAST([] AS STRUCT(a BIGINT, b BIGINT, f DOUBLE, n BIGINT)[]) AS done FROM rk WHERE k = 1 UNION ALL
  SELECT track, k, CASE WHEN gap OR near THEN win ELSE last END, CASE WHEN gap THEN now ELSE start END, CASE WHEN gap OR near THEN now + {_W} ELSE stop END,
   CASE WHEN gap THEN [freq] WHEN near THEN list_append(fs, freq) ELSE fs END, CASE WHEN gap THEN list_append(done, {{'a': start, 'b': stop, 'f': list_median(fs), 'n': len(fs)}}) ELSE done END
  FROM (SELECT c.*EXCLUDE (k), r.k, r.win, r.start AS now, r.freq, r.win - c.last > 2 AS gap, abs(r.freq - list_median(c.fs)) <= 0.3 * list_median(c.fs) AS near FROM ch c JOIN rk r ON r.track = c.track AND r.k = c.k + 1)),
 fin AS (SELECT track, unnest(list_append(arg_max(done, k), {{'a': arg_max(start, k), 'b': arg_max(stop, k), 'f': list_median(arg_max(fs, k)), 'n': len(arg_max(fs, k))}})) AS s FROM ch GROUP BY track),
 seg AS MATERIALIZED (SELECT track, s.a AS start, s.b AS stop, s.f AS freq, s.n AS n_windows FROM fin WHERE s.b - s.a >= 20 AND s.n >= 5)"""


def _segments(spark, sf):
    return S.sine_segments(_tones(spark, sf), ["track"], window=_W, hop=_HOP, tolerance=0.3, max_gap=2, min_rows=20, size=BLOCK)


@query(f"{_CHAIN} SELECT track, start, stop, round(freq, 4) AS freq, n_windows FROM seg")
def g16_sine_segments(spark, sf):
    return _segments(spark, sf).withColumn("freq", F.round("freq", 4))


@query(f"""{_CHAIN} SELECT g.track, g.frame, CASE WHEN g.pulse = 1 THEN 'pulse' WHEN EXISTS (SELECT 1 FROM seg WHERE seg.track = g.track AND g.frame >= seg.start AND g.frame < seg.stop) THEN 'sine' ELSE 'quiet' END AS song FROM g""")
def g16_song_labels(spark, sf):
    frames = wings(spark, sf).select("track", "frame", (F.col("zr") % 11 < 2).alias("pulse"))
    return S.song_labels(frames, _segments(spark, sf), ["track"], "frame", "pulse").select("track", "frame", "song")
