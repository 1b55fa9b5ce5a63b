"""Statistics and evaluation rules on small or constructed inputs."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import curate as C
from strideframe.operators import evaluation as E
from strideframe.operators import geometry as G
from strideframe.operators import joins as J
from strideframe.operators import motion as M
from strideframe.operators import stats as S
from strideframe.operators.gates import rename_invariant_findings
from strideframe.operators.joins import closest_reference, match_length
from strideframe.operators.learning import explained_variance, fit_space, project, segment_type
from strideframe.operators.scale import plausible_length
from strideframe.operators.skeleton import edge_table, present_edges, skeleton_edges


def test_regression_p_values(spark):
    # t distribution with 1 and 2 degrees of freedom has closed tails.
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0), ("b", 1.0, 0.0), ("b", 2.0, 2.0), ("b", 3.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in S.regression(d, ["k"], "x", "y").collect()}
    t1 = got["a"].r * math.sqrt(1 / (1 - got["a"].r ** 2))
    assert got["a"].p == pytest.approx(1 - 2 / math.pi * math.atan(t1), abs=1e-10)
    t2 = got["b"].r * math.sqrt(2 / (1 - got["b"].r ** 2))
    assert got["b"].p == pytest.approx(1 - t2 / math.sqrt(2 + t2 * t2), abs=1e-10)
    assert S.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_temperature_recovers_the_generating_value(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(scale=3, size=20000)
    pdf = pd.DataFrame({"logit": z * 2.5, "target": (rng.random(20000) < 1 / (1 + np.exp(-z))).astype(int)})
    r = E.fit_temperature(spark.createDataFrame(pdf), "logit", "target").first()
    assert r.temperature == pytest.approx(2.5, rel=0.05) and not r.saturated
    sep = spark.createDataFrame([(1.0, 1), (-1.0, 0)], "logit double, target int")
    assert E.fit_temperature(sep, "logit", "target").first().saturated


def test_mix_weights_reach_the_target_and_sum_to_one(spark):
    rows = [(i, "h" if i < 60 else "p" if i < 90 else "n", "b", i % 7 == 0) for i in range(100)]
    w = E.mix_weights(
        spark.createDataFrame(rows, "id int, source_id string, behavior string, is_female boolean"),
        spark.createDataFrame([("h", "human"), ("p", "pseudo"), ("n", "negative")], "source_id string, kind string"),
        alpha=0.5, female_weight=2.0, female_target=0.4, negatives_fraction=0.1,
    ).toPandas()
    assert w.weight.sum() == pytest.approx(1)
    mass = w.groupby("source_id").weight.sum()
    assert mass["n"] == pytest.approx(0.1) and mass["h"] == pytest.approx(0.6) and mass["p"] == pytest.approx(0.3)
    for s, g in w.groupby("source_id"):
        assert g[g.is_female].weight.sum() / g.weight.sum() == pytest.approx(0.4), s


def test_weighted_draw_covers_every_draw(spark):
    items = spark.range(50).select("id", (F.col("id") + 1.0).alias("w"))
    d = E.weighted_draw(items, "id", "w", 5000, seed=1, buckets=16)
    assert d.count() == 5000 == d.select("draw").distinct().count()
    share = d.where("id >= 25").count() / 5000
    assert share == pytest.approx(sum(range(26, 51)) / sum(range(1, 51)), abs=0.03)


def test_slots(spark):
    rows = [(1, 0, 0, True, False), (1, 1, 0, True, False), (2, 0, -1, True, False), (2, 1, -1, True, False), (3, 0, 1, True, True), (3, 1, 1, True, True), (4, 0, 1, False, False), (4, 1, 0, True, False)]
    got = {r.window: (r.slot0, r.slot1) for r in E.assign_slots(spark.createDataFrame(rows, "window int, fly int, sex int, valid boolean, prompt_on boolean")).collect()}
    assert got == {1: (1, 3), 2: (3, -1), 3: (0, 2), 4: (-1, 1)}


def test_circular_median_of_a_wrapped_cluster(spark):
    x = [3.1, -3.1, 3.0, -3.05, 0.2]
    got = S.circular_median(spark.createDataFrame([(0, v) for v in x], "k int, a double"), ["k"], "a").first().median_dir
    arc = [sum(math.pi - abs(math.pi - abs(p - q)) for q in x) for p in x]
    assert got == min(zip(np.round(arc, 9), x))[1]


def test_feature_space_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, e array<double>")
    m = fit_space(d, "e", k=3)
    got = np.array([r.pc for r in project(m, d, "e").orderBy("i").collect()])
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for j in range(3):
        axis = vt[j] * (1 if vt[j][np.abs(vt[j]).argmax()] >= 0 else -1)
        np.testing.assert_allclose(got[:, j], z @ axis, atol=1e-8)
    np.testing.assert_allclose(explained_variance(m), (s**2 / (s**2).sum())[:3], atol=1e-10)


def test_segment_majority(spark):
    d = spark.createDataFrame([(1, "Pslow"), (1, "Pslow"), (1, "Pfast"), (2, "Pslow"), (2, "Pfast")], "s int, pulse_type string")
    assert {r.s: r.segment_type for r in segment_type(d, ["s"]).collect()} == {1: "Pslow", 2: "Pfast"}


def test_mirror_names_are_an_involution(spark):
    names = spark.createDataFrame([(n,) for n in ("EyeL", "EyeR", "T1L_FeTi", "T1R_FeTi", "Scutellum", "WingL_base")], "kp string")
    t = {r.kp: r.mirror for r in C.mirror_table(names).collect()}
    assert all(t[t[k]] == k for k in t) and t["EyeL"] == "EyeR" and t["WingL_base"] == "WingL_base"
    assert [r.kp for r in C.mirror_findings(names, C.mirror_table(names)).collect()] == ["WingL_base"]


def test_tier_findings(spark):
    tiers = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "tier string, tier_pos int")
    kp = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x"])], "tier string, names array<string>")
    img = spark.createDataFrame([("a", "train", "r/c/F_1.jpg"), ("a", "val", "r/c/F_1.png"), ("b", "train", "r/c/F_1.jpg")], "tier string, split string, file_name string")
    assert sorted(map(tuple, C.tier_findings(tiers, kp, img).collect())) == [("duplicate_tier", "b"), ("image_in_two_splits", "a/r/c/F_1"), ("keypoints_differ", "b")]


def test_skeleton_edges_skip_absent_joints(spark):
    def edges(*names):
        return sorted(map(tuple, skeleton_edges(spark.createDataFrame([(n,) for n in names], "kp string")).collect()))

    assert edges("EyeL", "Antenna_Base", "Scutellum", "T1L_ThxCx", "T1L_FeTi", "T1L_TaTip", "EyeL", None) == sorted(
        [("EyeL", "Antenna_Base"), ("Antenna_Base", "Scutellum"), ("T1L_ThxCx", "T1L_FeTi"), ("T1L_FeTi", "T1L_TaTip"), ("Scutellum", "T1L_ThxCx")]
    )
    assert edges("T2R_Tro", "T2R_TaT1", "EyeR") == [("T2R_Tro", "T2R_TaT1")]
    assert edges() == []
    kps = spark.createDataFrame([("EyeL",), ("Antenna_Base",)], "kp string")
    assert present_edges(kps, edge_table(spark, [("EyeL", "Antenna_Base"), ("EyeL", "Scutellum")])).count() == 1


def test_length_match_and_reference_fallback(spark):
    clips = spark.createDataFrame([("r", 1, 10), ("r", 2, 20), ("r", 3, 40)], "rec string, clip int, clip_len int")
    bouts = spark.createDataFrame([("r", 7, 11), ("r", 8, 19), ("r", 9, 21)], "rec string, bout int, n_frames int")
    assert sorted((r.clip, r.n_matches, r.bout) for r in match_length(clips, bouts, ["rec"]).collect()) == [(1, 1, 7), (2, 2, None), (3, 0, None)]
    t = spark.createDataFrame([(1, 5, 1.0), (2, 5, -1.0)], "id int, n int, sign double")
    c = spark.createDataFrame([(10, 4, 1.0), (11, 9, 1.0), (12, 0, -1.0)], "id int, n int, sign double")
    assert {r.id: r.match for r in closest_reference(t, c).collect()} == {1: 11, 2: 11}


def test_rename_invariant_and_body_length(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "f int, length double")
    b = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.5)], "f int, length double")
    assert [r.f for r in rename_invariant_findings(a, b, ["f"]).collect()] == [2]
    d = spark.createDataFrame([(2.5,), (3.5,), (None,)], "mm double")
    assert [r.ok for r in d.select(plausible_length(F.col("mm")).alias("ok")).collect()] == [True, False, False]


def test_track_map_checks_its_contract(spark):
    d = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0)], "k int, f int, v double")
    ok = M.track_map(d, ["k"], lambda g: g[["f"]].assign(w=g.v / 2), "f int, w double")
    assert sorted(map(tuple, ok.collect())) == [(1, 0, 1.0), (1, 1, 2.0)]
    with pytest.raises(ValueError, match="repeats key"):
        M.track_map(d, ["k"], lambda g: g, "k int")
    with pytest.raises(ValueError, match="not all columns"):
        M.track_map(d, ["nope"], lambda g: g, "w double")
    with pytest.raises(Exception, match="returned 1 rows for a group of 2"):
        M.track_map(d, ["k"], lambda g: g[["f"]].head(1), "f int").collect()
    with pytest.raises(KeyError, match="did you mean 'scale'"):
        M.apply_stages(d, [("scale", lambda x, by: x, {"by": 1})], {"scal": {}})


def test_dlt_projection_equals_matrix_projection(spark):
    from strideframe.plans.tables import CAMERAS, cameras

    pts = spark.createDataFrame([(1, 0.2, -0.4, 0.3)], "i int, x double, y double, z double")
    c = spark.createDataFrame([(n, [v / p[11] for v in p[:11]]) for n, p in CAMERAS.items()], "camera string, c array<double>")
    a = {r.camera: (r.u, r.v) for r in G.project(pts, cameras(spark)).collect()}
    b = {r.camera: (r.u, r.v) for r in G.project_dlt(pts, c).collect()}
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-12)


def test_closest_reference_is_that_of_brute_force(spark):
    rng = np.random.default_rng(8)
    for n_cand in (0, 1, 25):
        signs = rng.choice([-1.0, 0.0, 1.0] if n_cand > 1 else [1.0], n_cand)
        cand = [(i, int(rng.integers(0, 9)), float(g)) for i, g in enumerate(signs)]
        want, targets = {}, [(100 + i, int(rng.integers(0, 12)), float(rng.choice([-1.0, -0.0, 1.0]))) for i in range(40)]
        for t, n, g in targets:
            best = min(((g2 != g, n2 < n, abs(n2 - n), i) for i, n2, g2 in cand if n2 > 0), default=None)
            want[t] = best and best[3]
        kind = "id int, n int, sign double"
        got = closest_reference(spark.createDataFrame(targets, kind), spark.createDataFrame(cand, kind), size=3).collect()
        assert {r.id: r.match for r in got} == want and len(got) == 40


@pytest.mark.parametrize("sd", [0.0, 2.5])
def test_permutations_rank_only_units_near_the_border(spark, monkeypatch, sd):
    monkeypatch.setattr(S, "RANKED_SD", sd)
    rng = np.random.default_rng(4)
    units = [(i, i % 3 == 0, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]

    def t2(first):
        a, b = (np.array([u[2:] for u in units if (u[0] in first) == on]) for on in (True, False))
        s = ((len(a) - 1) * np.cov(a.T) + (len(b) - 1) * np.cov(b.T)) / (len(units) - 2)
        d = a.mean(0) - b.mean(0)
        return len(a) * len(b) / len(units) * d @ np.linalg.solve(s, d)

    digits = lambda rep, u: (hashlib.md5(f"3|{rep}|{u[0]}|{str(u[1]).lower()}".encode()).hexdigest()[:12], u[0])
    want = t2({u[0] for u in units if u[1]})
    reached = sum(t2({u[0] for u in sorted(units, key=lambda u: digits(rep, u))[:100]}) >= want for rep in range(1, 41))
    got = S.hotelling_permutation(spark.createDataFrame(units, "unit long, grp boolean, x double, y double"), "grp", "x", "y", "unit", True, False, n_perm=40, seed=3).first()
    assert got.t2 == pytest.approx(want) and got.p == pytest.approx((reached + 1) / 41)


def test_duplicate_keys_are_dealt_to_as_many_tasks_as_the_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_TASK", 10)
    left = spark.createDataFrame([(i % 90, "a") for i in range(100)] + [(None, "a"), (None, "a"), (7, None)], "k long, s string")
    right = left.distinct()
    assert J.dealt(left, ["k", "s"]).rdd.getNumPartitions() == 11
    got = J.one_to_one(left, right, ["k", "s"])[1].collect()
    assert sorted((-1 if r.k is None else r.k, r.s, r.side, r["count"]) for r in got) == [(-1, "a", "left", 2)] + [(i, "a", "left", 2) for i in range(10)]
