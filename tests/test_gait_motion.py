"""Gait, path and resampling operators against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import gait as G
from strideframe.operators import motion as M


def spans(on):
    edge = np.flatnonzero(np.diff(np.r_[0, np.asarray(on, int), 0]))
    return list(zip(edge[::2], edge[1::2]))


@pytest.mark.parametrize("rule", ["first_minimum", "threshold"])
@pytest.mark.parametrize("size", [5, 1000])
def test_stance_edges(spark, rule, size):
    rng = np.random.default_rng(1)
    n = 160
    z = np.round(np.sin(np.arange(n) / 4) + rng.normal(scale=0.2, size=n), 3)
    on = np.sin(np.arange(n) / 4 + 0.6) < 0.1
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "f": np.arange(n), "z": z, "on": on})).repartition(3)
    got = G.stance_edges(d, ["k"], "f", "on", "z", rule=rule, size=size).toPandas().sort_values("f").refined.to_numpy()
    want, runs = on.copy(), spans(on)
    for i, (s, e) in enumerate(runs):
        before = runs[i - 1][1] if i else 0
        after = runs[i + 1][0] if i + 1 < len(runs) else n
        if rule == "first_minimum":
            top = before + int(np.argmax(z[before : s + 1]))
            if e - 1 - top < 2:
                continue
            cand = [t for t in range(top + 1, e - 1) if z[t] < z[t - 1] and z[t] <= z[t + 1]]
            new = cand[0] if cand else top + int(np.argmin(z[top:e]))
            want[before:e] = False
            want[new:e] = True
        else:
            thr = np.median(z[s:e])
            top = before + int(np.argmax(z[before : s + 1])) if s > before else s
            low = [t for t in range(top, s + 1) if z[t] <= thr] if top < s else []
            if low:
                want[low[0] : s] = True
            if after > e:
                peak = e + int(np.argmax(z[e:after]))
                high = [t for t in range(e, peak + 1) if z[t] > thr] if peak > e else []
                if high:
                    want[e : high[0]] = True
    assert (got == want).all()


@pytest.mark.parametrize("size", [1, 3, 100])
def test_best_path_is_the_cheapest_of_all(spark, size):
    rng = np.random.default_rng(2)
    n, s, weight = 7, 3, 0.8
    cost, pose = np.round(rng.random((n, s)), 3), np.round(rng.random((n, s, 2)), 3)
    cost[3, 1] = np.inf
    rows = [(0, t, [float(c) for c in cost[t]], [[float(v) for v in p] for p in pose[t]]) for t in range(n)]
    d = spark.createDataFrame(rows, "k int, f long, c array<double>, p array<array<double>>").repartition(2)
    got = M.best_path(d, ["k"], "f", "c", "p", switch_weight=weight, n_candidates=s, size=size).toPandas().sort_values("f").choice.tolist()

    def total(path):
        jump = sum(((pose[t, path[t]] - pose[t - 1, path[t - 1]]) ** 2).sum() for t in range(1, n))
        return sum(cost[t, path[t]] for t in range(n)) + weight * jump

    assert total(got) == pytest.approx(min(total(p) for p in itertools.product(range(s), repeat=n)))


@pytest.mark.parametrize("ratio", [0.3, 1.0, 1.7, 0.01])
def test_resample(spark, ratio):
    rng = np.random.default_rng(3)
    parts = [pd.DataFrame({"k": k, "f": np.arange(n), "x": rng.normal(size=n)}) for k, n in enumerate((1, 2, 9, 50))]
    got = M.resample(spark.createDataFrame(pd.concat(parts)), ["k"], "f", ["x"], ratio=ratio, size=4).toPandas().sort_values(["k", "j"])
    for k, p in enumerate(parts):
        n = len(p)
        m = max(1, int(np.rint(n * ratio)))
        want = np.interp(np.linspace(0, 1, m), np.linspace(0, 1, n), p.x)
        np.testing.assert_allclose(got[got.k == k].x, want, atol=1e-9)


def test_resample_quaternion_is_continuous_and_unit(spark):
    ang = np.linspace(0, 6, 30)
    q = np.c_[np.cos(ang / 2), np.zeros(30), np.zeros(30), np.sin(ang / 2)] * np.where(np.arange(30) % 3 == 0, -1, 1)[:, None]
    pdf = pd.DataFrame(q, columns=["w", "x", "y", "z"]).assign(k=0, f=np.arange(30))
    got = M.resample(spark.createDataFrame(pdf), ["k"], "f", ["w", "x", "y", "z"], ratio=2.0, quaternion=True, size=7).toPandas().sort_values("j")
    v = got[["w", "x", "y", "z"]].to_numpy()
    np.testing.assert_allclose(np.linalg.norm(v, axis=1), 1, atol=1e-12)
    assert (np.sum(v[1:] * v[:-1], axis=1) > 0.9).all()


def test_swap_repair_undoes_short_exchanges(spark):
    n = 60
    a, b = np.c_[np.arange(n) * 0.01, np.zeros(n), np.zeros(n)], np.c_[np.arange(n) * 0.01, np.ones(n), np.zeros(n)]
    x, y = a.copy(), b.copy()
    for s, e in ((10, 14), (30, 31)):
        x[s:e], y[s:e] = b[s:e], a[s:e]
    rows = [(0, t, tuple(map(float, x[t])), tuple(map(float, y[t]))) for t in range(n)]
    pt = "struct<x: double, y: double, z: double>"
    d = spark.createDataFrame(rows, f"k int, f long, a {pt}, b {pt}")
    got = M.repair_swaps(d, ["k"], "f", "a", "b", gain=0.1, max_run=5, size=8).toPandas().sort_values("f")
    assert [r["y"] for r in got.a] == [0.0] * n and got.swaps.sum() == 5


def test_contact_correction_flips_whole_episodes(spark):
    on = [1, 1, 0, 0, 1, 1, 0, 0, 0, 1]
    clear = [0, 0, 0.05, 0.02, 0.5, 0.6, 0.4, 0.9, 0.3, 0]
    pdf = pd.DataFrame({"k": 0, "f": range(10), "on": [bool(v) for v in on], "c": clear})
    got = G.correct_contact(spark.createDataFrame(pdf), ["k"], "f", "on", "c", lift=0.15, band=0.2, passes=3, size=4).toPandas().sort_values("f")
    # The low swing joins its neighbours first, so the long stance has a touch and stays.
    assert [int(v) for v in got.on] == [1] * 6 + [0, 0, 0, 1]


def test_step_cycles_follow_the_leading_leg(spark):
    frames = spark.range(40).select(F.lit(0).alias("t"), F.col("id").alias("f"), F.lit(10.0).alias("v"))
    on = spark.createDataFrame([(0, "b", 2), (0, "a", 5), (0, "b", 12), (0, "b", 13), (0, "b", 25), (0, "a", 30)], "t int, leg string, f long")
    cycles, tagged = G.step_cycles(frames, on, ["t"], "f", "leg", "v", fps=1000.0, min_ms=5.0, min_speed=1.0, size=6)
    assert sorted((r.cycle, r.start, r.end, r.leg) for r in cycles.collect()) == [(0, 2, 12, "b"), (1, 13, 25, "b")]
    assert {r.f for r in tagged.where("cycle = 1").collect()} == set(range(13, 25))
