"""Least-squares fits against NumPy on the same points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import fits, geometry
from strideframe.plans.tables import CAMERAS, cameras

P = {c: np.array(p).reshape(3, 4) for c, p in CAMERAS.items()}


def views(noise=0.3, n=25, seed=0):
    rng = np.random.default_rng(seed)
    pts = rng.normal(size=(n, 3))
    rows = []
    for i, x in enumerate(pts):
        for c, m in P.items():
            h = m @ np.r_[x, 1]
            uv = h[:2] / h[2] + rng.normal(scale=noise, size=2)
            rows.append((i, c, uv[0], uv[1], float(rng.random())))
    return pts, pd.DataFrame(rows, columns=["frame", "camera", "u", "v", "conf"])


def solve(obs):
    a = np.vstack([np.outer([r.u, r.v], P[r.camera][2]) - P[r.camera][:2] for r in obs.itertuples()])
    h = np.linalg.svd(a)[2][-1]
    return h[:3] / h[3]


def test_triangulation(spark):
    pts, obs = views()
    got = fits.triangulate(spark.createDataFrame(obs), cameras(spark), ["frame"], conf_thresh=0.3).toPandas().set_index("frame")
    for f, g in obs[obs.conf >= 0.3].groupby("frame"):
        if len(g) < 2:
            assert f not in got.index
            continue
        np.testing.assert_allclose(got.loc[f, ["x", "y", "z"]].astype(float), solve(g), atol=1e-6)
        assert got.loc[f, "n_views"] == len(g)
    exact = fits.triangulate(spark.createDataFrame(views(noise=0)[1]), cameras(spark), ["frame"], conf_thresh=0.0).toPandas().sort_values("frame")
    np.testing.assert_allclose(exact[["x", "y", "z"]], pts, atol=1e-7)


def test_leave_one_out(spark):
    _, obs = views(seed=3)
    got = fits.leave_one_out(spark.createDataFrame(obs), cameras(spark), ["frame"]).toPandas().set_index(["frame", "camera"]).err
    n = 0
    for f, g in obs[obs.conf >= 0.3].groupby("frame"):
        for r in g.itertuples():
            rest = g[g.camera != r.camera]
            if len(rest) < 2:
                assert (f, r.camera) not in got.index
                continue
            h = P[r.camera] @ np.r_[solve(rest), 1]
            np.testing.assert_allclose(got[(f, r.camera)], np.hypot(*(h[:2] / h[2] - [r.u, r.v])), rtol=1e-5, atol=1e-6)
            n += 1
    assert n == len(got)


def test_rigid_fit_recovers_similarity_and_refuses_few_points(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for f in range(6):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q = q * np.sign(np.linalg.det(q))
        s, t = float(rng.uniform(0.5, 3)), rng.normal(size=3)
        truth[f] = (s, q, t)
        for _ in range(2 if f == 5 else 8):
            a = rng.normal(size=3)
            rows.append((f, *map(float, a), *map(float, s * q @ a + t)))
    d = spark.createDataFrame(rows, "frame int, sx double, sy double, sz double, dx double, dy double, dz double")
    got = {r.frame: r for r in fits.rigid_fit(d, ["frame"], kp_scale=0.1).collect()}
    for f, (s, q, t) in truth.items():
        if f == 5:
            assert not got[f].ok and got[f].s == pytest.approx(10.0)
            continue
        assert got[f].ok and got[f].s == pytest.approx(s, rel=1e-9)
        np.testing.assert_allclose(np.array(got[f].r).reshape(3, 3), q, atol=1e-8)
        np.testing.assert_allclose(got[f].t, t, atol=1e-8)
    inv = d.select("frame", *[F.col(f"d{c}").alias(f"s{c}") for c in "xyz"], *[F.col(f"s{c}").alias(f"d{c}") for c in "xyz"])
    for est in ("umeyama", "norm_ratio"):
        sc = {r.frame: r.scale for r in fits.frame_scales(inv, ["frame"], n_required=8, estimator=est).collect()}
        assert set(sc) == set(range(5))
        for f in sc:
            assert sc[f] == pytest.approx(1 / truth[f][0], rel=1e-9)


def test_floor_fit_finds_the_plane_under_walls(spark):
    rng = np.random.default_rng(7)
    up = np.array([0.1, -0.2, 1.0])
    up /= np.linalg.norm(up)
    u = np.linalg.svd(up[None])[2][1:]
    floor = rng.uniform(-10, 10, (400, 2)) @ u + np.outer(np.abs(rng.normal(scale=0.05, size=400)), up)
    wall = np.c_[np.full(60, 10.0), rng.uniform(-10, 10, 60)] @ u + np.outer(rng.uniform(0, 2, 60), up)
    pdf = pd.DataFrame(np.vstack([floor, wall]), columns=list("xyz")).sample(frac=1, random_state=0).reset_index(drop=True)
    pdf["rec"], pdf["frame"] = "r", np.arange(len(pdf))
    for hint in ((0, 0, 1.0), None):
        r = fits.fit_floor(spark.createDataFrame(pdf), ["rec"], ["frame"], up_hint=hint).first()
        assert np.dot([r.nx, r.ny, r.nz], up) > 0.999
        h = pdf[["x", "y", "z"]].to_numpy() @ [r.nx, r.ny, r.nz] + r.offset
        assert np.percentile(h, 3) == pytest.approx(0, abs=1e-6)


def test_floor_skips_missing_points_before_it_counts(spark):
    rng = np.random.default_rng(4)
    rows = [("r", i, None, None, None) for i in range(20)] + [("r", 20 + i, float(x), float(y), 0.01 * i) for i, (x, y) in enumerate(rng.normal(size=(40, 2)))]
    points = spark.createDataFrame(rows, "rec string, frame long, x double, y double, z double")
    for n_fit, n in ((None, 40), (20, 20)):
        assert fits.fit_floor(points, ["rec"], ["frame"], n_fit=n_fit, up_hint=(0, 0, 1.0)).first().n == n


def test_rigs_with_equal_camera_names_stay_apart(spark):
    cams = [(g, c, [v * k for v in p] if c == "Cam02" else [v + (k - 1) * (i == 3) for i, v in enumerate(p)]) for g, k in (("A", 1.0), ("B", 2.0)) for c, p in list(CAMERAS.items())[:3]]
    rigs = spark.createDataFrame(cams, "calib_group string, camera string, p array<double>")
    points = spark.createDataFrame([("A", 0, 1.0, 2.0, 3.0), ("B", 1, 2.0, 1.0, 0.5)], "calib_group string, frame int, x double, y double, z double")
    seen = geometry.project(points, rigs).withColumn("conf", F.lit(1.0))
    assert seen.count() == 6
    got = {r.frame: r for r in fits.triangulate(seen.drop("x", "y", "z"), rigs, ["frame"]).collect()}
    assert [got[0].n_views, got[1].n_views] == [3, 3]
    assert [got[1].x, got[1].y, got[1].z] == pytest.approx([2.0, 1.0, 0.5]) and [got[0].x, got[0].y, got[0].z] == pytest.approx([1.0, 2.0, 3.0])
    errors = fits.leave_one_out(seen.drop("x", "y", "z"), rigs, ["frame"]).collect()
    assert len(errors) == 6 and max(r.err for r in errors) < 1e-6
    with pytest.raises(ValueError, match="calib_group"):
        geometry.project(points.drop("calib_group"), rigs)


def test_a_reference_table_beyond_its_bound_is_refused(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        geometry.each_with(spark.range(2).toDF("a"), spark.range(4).toDF("b"), 3)
    assert geometry.each_with(spark.range(2).toDF("a"), spark.range(0).toDF("b"), 3).count() == 0
