"""Cleaning operators against NumPy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import filters as L


def frame(spark, series, col="x"):
    pdf = pd.concat([pd.DataFrame({"k": k, "f": np.arange(len(s)), col: s}) for k, s in enumerate(series)], ignore_index=True)
    d = spark.createDataFrame(pdf).repartition(3)
    return d.withColumn(col, F.when(~F.isnan(col), F.col(col)))


def ordered(df, col="x"):
    p = df.toPandas().sort_values(["k", "f"])
    return [g[col].astype(float).to_numpy() for _, g in p.groupby("k")]


def hermite(x, y, at):
    """Monotone cubic through (x, y): Fritsch-Butland slopes, three-point ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])

    def end(h0, h1, d0, d1):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if np.sign(e) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0) else e

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    s = (at - x[i]) / h[i]
    return y[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2 + y[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1)


@pytest.mark.parametrize("size", [4, 1000])
def test_interpolation(spark, size):
    rng = np.random.default_rng(4)
    series = []
    for n in (30, 12, 9, 5, 40):
        s = rng.normal(size=n)
        s[rng.random(n) < 0.3] = np.nan
        series.append(s)
    series.append(np.array([np.nan] * 7))
    series.append(np.r_[[np.nan] * 3, np.arange(10.0), [np.nan] * 4])
    out = L.interpolate_gaps(frame(spark, series), ["k"], "f", ["x"], max_edge=2, edge_fit=5, size=size)
    flags = ordered(out.withColumn("e", F.col("edge_gap").cast("double")), "e")
    for s, got, edge in zip(series, ordered(out), flags):
        ok = np.flatnonzero(~np.isnan(s))
        want = s.copy()
        if len(ok) >= 4 and len(ok) * 2 >= len(s):
            gap = np.array([i for i in range(ok[0], ok[-1]) if np.isnan(s[i])], int)
            if len(gap):
                want[gap] = hermite(ok.astype(float), s[ok], gap.astype(float))
            for idx, fit in ((range(max(ok[0] - 2, 0), ok[0]), ok[:5]), (range(ok[-1] + 1, min(ok[-1] + 3, len(s))), ok[-5:])):
                for i in idx:
                    want[i] = np.polyval(np.polyfit(fit, s[fit], 1), i)
        np.testing.assert_allclose(got, want, atol=1e-9)
        outside = np.ones(len(s), bool)
        if len(ok):
            outside[ok[0] : ok[-1] + 1] = False
        assert (edge.astype(bool) == outside).all()


@pytest.mark.parametrize("iterations", [1, 3])
def test_despike_runs_of_spikes(spark, iterations):
    rng = np.random.default_rng(6)
    a = rng.normal(scale=0.1, size=60)
    a[[10, 30, 31, 32, 33, 50]] += [9, 9, -9, 9, -9, 7]
    b = np.array([0.0, 5.0, 0.0])
    c = a.copy()
    c[29] = np.nan
    out = ordered(L.despike(frame(spark, [a, b, c]), ["k"], "f", ["x"], factor=10.0, max_iterations=iterations, size=7))
    for s, got in zip((a, b, c), out):
        y, step = s.copy(), np.abs(np.diff(s))
        step = step[np.isfinite(step)]
        for _ in range(iterations if len(step) >= 3 else 0):
            v = np.diff(y)
            hit = [t for t in range(1, len(y) - 1) if min(abs(v[t - 1]), abs(v[t])) > 10 * np.median(step) and v[t - 1] * v[t] < 0]
            for t in hit:
                y[t] = 0.5 * (y[t - 1] + y[t + 1])
        np.testing.assert_allclose(got, y, atol=1e-12)


def test_savgol_edges_and_short_series(spark):
    rng = np.random.default_rng(8)
    series = [rng.normal(size=n) for n in (20, 7, 6, 4, 3, 1)] + [np.r_[rng.normal(size=9), np.nan]]
    out = ordered(L.savgol(frame(spark, series), ["k"], "f", {"x": "x"}, window=7, polyorder=2, size=5))
    for s, got in zip(series, out):
        n = len(s)
        w = min(7, n if n % 2 else n - 1)
        want = s.copy()
        if w > 2 and not np.isnan(s).any():
            for i in range(n):
                lo = min(max(i - w // 2, 0), n - w)
                want[i] = np.polyval(np.polyfit(np.arange(w), s[lo : lo + w], 2), i - lo)
        np.testing.assert_allclose(got, want, atol=1e-9)


def kps(spark, data):
    return spark.createDataFrame([(0, f, k, *map(float, p), c) for f, k, p, c in data], "track int, frame long, kp string, x double, y double, z double, conf double")


def test_filter_chain_keeps_wings_and_reports(spark):
    rng = np.random.default_rng(9)
    data = []
    for f in range(40):
        base = rng.normal(scale=0.01, size=3)
        for k, off in (("EyeL", (0, 0, 0)), ("EyeR", (1, 0, 0)), ("WingL_base", (0, 2, 0))):
            p = base + np.array(off) + rng.normal(scale=0.002, size=3)
            if f == 20 and k == "EyeR":
                p = p + 5
            data.append((f, k, p, 0.1 if f == 7 else 0.9))
    edges = spark.sql("SELECT * FROM VALUES ('EyeL', 'EyeR') AS t(a, b)")
    d = kps(spark, data)
    out = L.filter_chain(d, ["track"], "frame", edges, size=16).cache()
    assert out.count() == len(data)
    p = out.toPandas().set_index(["frame", "kp"])
    raw = {(f, k): v for f, k, v, _ in data}
    np.testing.assert_allclose(p.loc[(7, "WingL_base"), ["x", "y", "z"]].astype(float), raw[(7, "WingL_base")])
    assert p.loc[(20, "EyeR"), "bone_flagged"] and abs(p.loc[(20, "EyeR"), "x"] - 1) < 0.1
    rep = L.filter_report(out, ["track"], "frame").first()
    assert rep.n_confidence_masked == 2 and rep.n_excluded == 1 and rep.n_bone_flagged == 2


def test_filter_settings_refuse_unknown_keys():
    with pytest.raises(KeyError, match="confidence"):
        L.filter_config({"confidense": {}})
    with pytest.raises(KeyError, match="threshold"):
        L.filter_config({"confidence": {"treshold": 1}})
    assert L.filter_config({"savgol": {"enabled": False}})["savgol"] == {"enabled": False, "window_length": 7, "polyorder": 2}
