"""Least-squares fits as combinable sums plus a small per-group solve.

Every view, landmark or point adds a fixed number of products to its group, so the
aggregation is partial on the map side and a group of any size costs one row of sums.  The
solve (an eigenvector or a 3x3 SVD) runs batched over those rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions import vectors as V
from strideframe.operators.geometry import rig_keys, small_table
from strideframe.operators.quantiles import attach, exact_median, exact_quantiles

_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def view_grams(obs: DataFrame, cameras: DataFrame, *, conf_thresh: float = 0.3) -> DataFrame:
    """Usable observations with the ten products ``g0..g9`` of their two projection rows; cameras of
    several rigs are told apart by ``calib_group``."""
    j = obs.where(F.coalesce(F.col("conf") >= conf_thresh, F.lit(False)) & F.col("u").isNotNull() & F.col("v").isNotNull())
    j = j.join(small_table(cameras), [*rig_keys(obs, cameras), "camera"])
    p = [F.element_at("p", i + 1) for i in range(12)]
    r0 = [F.col("u") * p[8 + k] - p[k] for k in range(4)]
    r1 = [F.col("v") * p[8 + k] - p[4 + k] for k in range(4)]
    return j.select("*", *[(r0[a] * r0[b] + r1[a] * r1[b]).alias(f"g{i}") for i, (a, b) in enumerate(_PAIRS)])


def _solve_homogeneous(g: np.ndarray) -> np.ndarray:
    """(N, 10) sums -> (N, 3) points from the eigenvector of the smallest eigenvalue."""
    m = np.zeros((len(g), 4, 4))
    for i, (a, b) in enumerate(_PAIRS):
        m[:, a, b] = m[:, b, a] = g[:, i]
    if not len(g):
        return np.zeros((0, 3))
    h = np.linalg.eigh(m)[1][:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return h[:, :3] / h[:, 3:4]


def _points_schema(df: DataFrame, drop: Sequence[str]) -> T.StructType:
    keep = [f for f in df.schema.fields if f.name not in drop]
    return T.StructType([*keep, *[T.StructField(c, T.DoubleType()) for c in "xyz"]])


def _solve_rows(df: DataFrame) -> DataFrame:
    cols = [f"g{i}" for i in range(10)]
    schema = _points_schema(df, cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns=cols)
            xyz = _solve_homogeneous(b[cols].to_numpy(float))
            for i, c in enumerate("xyz"):
                out[c] = xyz[:, i]
            yield out

    return df.mapInPandas(run, schema)


def triangulate(obs: DataFrame, cameras: DataFrame, keys: Sequence[str], *, conf_thresh: float = 0.3, min_views: int = 2) -> DataFrame:
    """One 3-D point per key from its views: ``x, y, z``, view count and mean confidence.

    Keys with fewer than ``min_views`` (at least two) usable views give no row.
    """
    g = view_grams(obs, cameras, conf_thresh=conf_thresh)
    sums = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_views"), F.avg("conf").alias("conf"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(10)])
    return _solve_rows(sums.where(F.col("n_views") >= max(min_views, 2)))


def triangulate_lsq(obs: DataFrame, coeffs: DataFrame, keys: Sequence[str], *, min_views: int = 2) -> DataFrame:
    """Least-squares point from 11-coefficient cameras, by Cramer's rule on the 3x3 normal equations."""
    j = obs.where(F.col("u").isNotNull() & F.col("v").isNotNull()).join(small_table(coeffs), [*rig_keys(obs, coeffs), "camera"])
    c = [F.element_at("c", i + 1) for i in range(11)]
    rows = [
        ([c[0] - F.col("u") * c[8], c[1] - F.col("u") * c[9], c[2] - F.col("u") * c[10]], F.col("u") - c[3]),
        ([c[4] - F.col("v") * c[8], c[5] - F.col("v") * c[9], c[6] - F.col("v") * c[10]], F.col("v") - c[7]),
    ]
    six = [(i, k) for i in range(3) for k in range(i, 3)]
    aggs = [F.sum(rows[0][0][i] * rows[0][0][k] + rows[1][0][i] * rows[1][0][k]).alias(f"n{i}{k}") for i, k in six]
    aggs += [F.sum(rows[0][0][i] * rows[0][1] + rows[1][0][i] * rows[1][1]).alias(f"b{i}") for i in range(3)]
    s = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_views"), *aggs).where(F.col("n_views") >= min_views)

    def m(i: int, k: int) -> Column:
        return F.col(f"n{min(i, k)}{max(i, k)}")

    def det(cols: list[list[Column]]) -> Column:
        a, b, d = cols
        return V.dot(tuple(a), V.cross(tuple(b), tuple(d)))

    normal = [[m(i, k) for i in range(3)] for k in range(3)]
    rhs = [F.col(f"b{i}") for i in range(3)]
    whole = det(normal)
    whole = F.when(whole != 0, whole)
    pts = [(det([rhs if k == i else normal[k] for k in range(3)]) / whole).alias("xyz"[i]) for i in range(3)]
    return s.select(*keys, "n_views", *pts)


def leave_one_out(obs: DataFrame, cameras: DataFrame, keys: Sequence[str], *, conf_thresh: float = 0.3) -> DataFrame:
    """Pixel error of every usable observation against the point solved from the other views.

    All held-out solves come from one total per key: total minus the view's own products.
    A key has one row per camera, so the window below is as small as the rig.
    """
    g = view_grams(obs, cameras, conf_thresh=conf_thresh)
    w = Window.partitionBy(*keys)
    rest = g.select(
        *keys, "camera", "u", "v", "p", (F.count(F.lit(1)).over(w) - 1).alias("n_other"), *[(F.sum(f"g{i}").over(w) - F.col(f"g{i}")).alias(f"g{i}") for i in range(10)]
    ).where(F.col("n_other") >= 2)
    pts = _solve_rows(rest)
    p = [F.element_at("p", i + 1) for i in range(12)]
    row = [p[4 * r] * F.col("x") + p[4 * r + 1] * F.col("y") + p[4 * r + 2] * F.col("z") + p[4 * r + 3] for r in range(3)]
    err = F.hypot(row[0] / row[2] - F.col("u"), row[1] / row[2] - F.col("v"))
    return pts.select(*keys, "camera", err.alias("err")).where(F.col("err").isNotNull() & ~F.isnan("err"))


def leave_one_out_report(errors: DataFrame) -> DataFrame:
    """Median error per camera and over all cameras (``camera`` = ``all``)."""
    per = exact_quantiles(errors, ["camera"], "err", {"median_px": 0.5}, n="n")
    return per.unionByName(exact_quantiles(errors, [], "err", {"median_px": 0.5}, n="n").withColumn("camera", F.lit("all")))


_CROSS = [f"{a}{b}" for a in "xyz" for b in "uvw"]


def _rigid_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of matched points (``sx, sy, sz`` -> ``dx, dy, dz``) that a similarity fit needs."""
    src, dst = [F.col(f"s{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"a{i}") for i, c in enumerate(src)] + [F.sum(c).alias(f"b{i}") for i, c in enumerate(dst)]
    aggs += [F.sum(d * s).alias(f"c{i}{k}") for i, d in enumerate(dst) for k, s in enumerate(src)]
    aggs += [F.sum(V.dot(tuple(src), tuple(src))).alias("qs"), F.sum(V.dot(tuple(dst), tuple(dst))).alias("qd")]
    return pairs.groupBy(*keys).agg(*aggs)


def _moments(b: pd.DataFrame):
    n = b["n"].to_numpy(float)
    ms = b[["a0", "a1", "a2"]].to_numpy(float) / n[:, None]
    md = b[["b0", "b1", "b2"]].to_numpy(float) / n[:, None]
    cov = b[[f"c{i}{k}" for i in range(3) for k in range(3)]].to_numpy(float).reshape(-1, 3, 3) / n[:, None, None]
    cov = cov - md[:, :, None] * ms[:, None, :]
    return n, ms, md, cov, b["qs"].to_numpy(float) / n - (ms**2).sum(1), b["qd"].to_numpy(float) / n - (md**2).sum(1)


def rigid_fit(pairs: DataFrame, keys: Sequence[str], *, kp_scale: float, min_keypoints: int = 3) -> DataFrame:
    """Similarity (``s``, row-major ``r``, ``t``) from model sites to observed landmarks per key.

    ``ok`` is false, with placeholder values, where fewer than ``min_keypoints`` pairs remain.
    """
    sums = _rigid_sums(pairs, keys)
    drop = [f.name for f in sums.schema.fields if f.name not in (*keys, "n")]
    keep = [f for f in sums.schema.fields if f.name in keys or f.name == "n"]
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*keep, T.StructField("s", T.DoubleType()), T.StructField("r", arr), T.StructField("t", arr), T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, ms, md, cov, var, _ = _moments(b)
            u, d, vt = np.linalg.svd(cov)
            flip = np.ones((len(b), 3))
            flip[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            rot = (u * flip[:, None, :]) @ vt
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (d * flip).sum(1) / var
            t = md - s[:, None] * np.einsum("nij,nj->ni", rot, ms)
            ok = (n >= min_keypoints) & np.isfinite(s) & np.isfinite(rot).all((1, 2)) & np.isfinite(t).all(1)
            out = b.drop(columns=drop)
            out["s"] = np.where(ok, s, 1.0 / kp_scale)
            out["r"] = [list(map(float, (m if o else np.eye(3)).ravel())) for m, o in zip(rot, ok)]
            out["t"] = [list(map(float, v if o else np.zeros(3))) for v, o in zip(t, ok)]
            out["ok"] = ok
            yield out

    return sums.mapInPandas(run, schema)


def frame_scales(pairs: DataFrame, keys: Sequence[str], *, n_required: int, estimator: str = "umeyama") -> DataFrame:
    """Scale from observed (``s*``) to model (``d*``) landmarks per frame with all of them present."""
    sums = _rigid_sums(pairs, keys).where(F.col("n") == n_required)
    if estimator == "norm_ratio":
        def spread(q: str, m: str) -> Column:
            return F.col(q) - sum((F.col(f"{m}{i}") * F.col(f"{m}{i}") for i in range(3)), F.lit(0.0)) / F.col("n")

        obs = spread("qs", "a")
        return sums.select(*keys, F.sqrt(spread("qd", "b") / F.when(obs > 0, obs)).alias("scale"))
    if estimator != "umeyama":
        raise ValueError(f"unknown estimator {estimator!r}")
    keep = [f for f in sums.schema.fields if f.name in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, _, _, cov, var, _ = _moments(b)
            d = np.linalg.svd(cov, compute_uv=False)
            sign = np.where(np.linalg.det(cov) < 0, -1.0, 1.0)
            out = b[[f.name for f in keep]].copy()
            out["scale"] = (d[:, 0] + d[:, 1] + sign * d[:, 2]) / np.maximum(var, 1e-12)
            yield out

    return sums.mapInPandas(run, T.StructType([*keep, T.StructField("scale", T.DoubleType())]))


def _normals(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit least-variance direction ``nx, ny, nz`` per key from nine moment sums."""
    c = [F.col(a) for a in "xyz"]
    six = [(i, k) for i in range(3) for k in range(i, 3)]
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"m{i}") for i, a in enumerate(c)], *[F.sum(c[i] * c[k]).alias(f"q{i}{k}") for i, k in six])
    keep = [f for f in sums.schema.fields if f.name in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            mu = b[["m0", "m1", "m2"]].to_numpy(float) / n[:, None]
            cov = np.zeros((len(b), 3, 3))
            for i, k in six:
                cov[:, i, k] = cov[:, k, i] = b[f"q{i}{k}"].to_numpy(float) / n - mu[:, i] * mu[:, k]
            v = np.linalg.eigh(cov)[1][:, :, 0] if len(b) else np.zeros((0, 3))
            # The first large component is made positive so the direction is repeatable.
            lead = v[np.arange(len(v)), np.abs(v).argmax(1)] if len(v) else np.zeros(0)
            v = v * np.where(lead < 0, -1.0, 1.0)[:, None]
            out = b[[f.name for f in keep]].copy()
            for i, c_ in enumerate(("nx", "ny", "nz")):
                out[c_] = v[:, i]
            yield out

    return sums.mapInPandas(run, T.StructType([*keep, *[T.StructField(c_, T.DoubleType()) for c_ in ("nx", "ny", "nz")]]))


def fit_floor(
    points: DataFrame, keys: Sequence[str], order_by: Sequence[str], *, n_fit: int | None = None, floor_pct: float = 3.0, up_hint: Sequence[float] | None = None
) -> DataFrame:
    """Floor plane per recording: ``nx, ny, nz`` pointing up, ``offset`` and ``skew``.

    Uses all points with three coordinates, or the first ``n_fit`` of those; the normal is refitted on the lower half and oriented by
    the hint or, without one, so that the heights are bottom-heavy.
    """
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull()
    pts = points.where(finite).select(*keys, *order_by, "x", "y", "z")
    if n_fit is not None:
        pts = pts.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col("_rn") <= n_fit).drop("_rn")
    h = V.dot((F.col("x"), F.col("y"), F.col("z")), (F.col("nx"), F.col("ny"), F.col("nz")))

    def oriented(p: DataFrame, normals: DataFrame, like: DataFrame | None = None) -> DataFrame:
        if like is not None:
            normals = normals.join(like.select(*keys, *[F.col(c).alias(f"o{c}") for c in ("nx", "ny", "nz")]), list(keys))
            same = sum((F.col(c) * F.col(f"o{c}") for c in ("ny", "nz")), F.col("nx") * F.col("onx")) >= 0
            normals = normals.select(*keys, *[(F.when(same, F.col(c)).otherwise(-F.col(c))).alias(c) for c in ("nx", "ny", "nz")])
        s = attach(p, normals, keys, "inner").withColumn("_h", h)
        if up_hint is None:
            mean = s.groupBy(*keys, "nx", "ny", "nz").agg(F.avg("_h").alias("_mean"))
            s = mean.join(exact_median(s, keys, "_h", "_med"), list(keys))
        else:
            s = normals
        if up_hint is not None:
            up = F.col("nx") * up_hint[0] + F.col("ny") * up_hint[1] + F.col("nz") * up_hint[2] >= 0
        else:
            up = F.col("_mean") >= F.col("_med")
        return s.select(*keys, *[F.when(up, F.col(c)).otherwise(-F.col(c)).alias(c) for c in ("nx", "ny", "nz")])

    first = oriented(pts, _normals(pts, keys))
    with_h = attach(pts, first, keys, "inner").withColumn("_h", h)
    half = exact_median(with_h, keys, "_h", "_mid")
    low = attach(with_h, half, keys, "inner").where(F.col("_h") <= F.col("_mid")).select(*keys, "x", "y", "z")
    final = oriented(pts, _normals(low, keys), like=first)
    heights = attach(pts, final, keys, "inner").withColumn("_h", h)
    ranks = exact_quantiles(heights, keys, "_h", {"_floor": floor_pct / 100, "_med": 0.5})
    stats = heights.groupBy(*keys, "nx", "ny", "nz").agg(F.avg("_h").alias("_mean"), F.stddev_pop("_h").alias("_sd"), F.count(F.lit(1)).alias("n")).join(ranks, list(keys))
    stats = stats.select(*keys, "nx", "ny", "nz", (-F.col("_floor")).alias("offset"), ((F.col("_mean") - F.col("_med")) / (F.col("_sd") + 1e-9)).alias("skew"), "n")
    return stats.where(F.col("n") >= 3)
