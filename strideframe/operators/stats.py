"""Group statistics: profiles, bootstrap, binning, densities, circular and two-sample tests.

Statistics that need ranks go through ``quantiles.rank_values``, so a condition with most of
the rows is ranked by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators.ordered import BLOCK, number_rows, running_sum, scan
from strideframe.operators.quantiles import attach, distinct_values, exact_quantiles, rank_values
from strideframe.operators.select import hash_digits, hash_uniform
from strideframe.session import cut_lineage


def phase_bin(phase: Column, bins: int = 48) -> Column:
    """Bin of a phase in [-pi, pi], the borders clipped into the first and last bin."""
    return F.least(F.greatest(F.floor((phase + math.pi) / (2 * math.pi) * bins), F.lit(0)), F.lit(bins - 1))


def profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def rms(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_rms") for c in cols])


def poisson1(u: Column) -> Column:
    """Poisson(1) count from a uniform number (inverse distribution, tail beyond 12 negligible at 1e-10)."""
    p, total, out = math.exp(-1.0), 0.0, F.lit(0)
    for k in range(13):
        total += p
        out = out + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    return out


#: modulus of the replicates' walks
PRIME = (1 << 31) - 1


def cluster_bootstrap(cells: DataFrame, group: Sequence[str], cluster: Sequence[str], bin_col: str, value: str, *, n_boot: int = 1000, ci: float = 95.0, seed: int = 42) -> DataFrame:
    """Mean and percentile interval per bin, resampling whole clusters.

    ``cells`` has one value per (cluster, bin).  Each replicate weights a cluster with a
    Poisson(1) count: two hashes of (seed, cluster) are the start and the step of a walk modulo a
    prime, which gives weights that are independent between clusters and pairwise independent
    between replicates. They need no shuffle, and the replicate sums combine on the map side, so only
    replicates x bins rows move.
    """
    of = [F.col(c) for c in cluster]
    start, step = F.floor(hash_uniform(seed, F.lit("a"), *of) * PRIME), F.floor(hash_uniform(seed, F.lit("b"), *of) * (PRIME - 1)) + 1
    u = ((F.col("_s") + F.col("_rep") * F.col("_t")) % PRIME) / float(PRIME)
    # clusters of weight 0 go before their bins are unfolded
    whole = cells.where(F.col(value).isNotNull()).groupBy(*group, *cluster).agg(F.collect_list(F.struct(bin_col, value)).alias("_c"))
    whole = whole.select(*group, "_c", start.alias("_s"), step.alias("_t"))
    reps = whole.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("_w", poisson1(u)).where("_w > 0").select(*group, "_rep", "_w", F.inline("_c"))
    sums = reps.groupBy(*group, bin_col, "_rep").agg(F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum("_w").alias("_n"))
    mean = F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))
    half = (100.0 - ci) / 200.0
    # One row per replicate in every (group, bin): the percentile is over n_boot values.
    band = sums.groupBy(*group, bin_col).agg(F.percentile(mean, half).alias("lo"), F.percentile(mean, 1 - half).alias("hi"))
    point = cells.groupBy(*group, bin_col).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return point.join(band, [*group, bin_col])


def quantile_bin(df: DataFrame, value: str, q: int, *, name: str) -> DataFrame:
    """Quantile bins 1..q with right-closed edges (equal values share a bin)."""
    edges = exact_quantiles(df, [], value, {f"_q{i}": i / q for i in range(1, q)})
    d = attach(df, edges, [])
    b = F.lit(1)
    for i in range(1, q):
        b = b + F.when(F.col(value) > F.col(f"_q{i}"), 1).otherwise(0)
    return d.withColumn(name, F.when(F.col(value).isNotNull(), b)).drop(*[f"_q{i}" for i in range(1, q)])


def clip_percentiles(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows inside the given percentiles of every column."""
    d = df
    for c in cols:
        d = attach(d, exact_quantiles(df, [], c, {f"_lo_{c}": lo, f"_hi_{c}": hi}), [])
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    return d.where(ok).drop(*[f"_{t}_{c}" for c in cols for t in ("lo", "hi")])


def regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r and the two-sided p of the slope."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"))
    return s.mapInPandas(_add_p, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields) + ", p double")


def _add_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        df = b["n"].to_numpy(float) - 2
        r = np.clip(b["r"].to_numpy(float), -1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(df > 0, 1 - r * r, np.nan)  # df / (df + t^2)
        yield b.assign(p=[incomplete_beta(d / 2, 0.5, v) if d > 0 and np.isfinite(v) else float("nan") for d, v in zip(df, x)])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or 1e-300)
            c = 1.0 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def circular_mean(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """Mean direction and resultant length."""
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return df.groupBy(*keys).agg(F.atan2(s, c).alias("mean_dir"), F.hypot(s, c).alias("resultant"), F.count(angle).alias("n"))


def circular_median(df: DataFrame, keys: Sequence[str], angle: str, *, size: int = BLOCK) -> DataFrame:
    """The sample with the smallest summed arc distance to all others (smallest angle on ties).

    The sum for a candidate a splits at a and at a +- pi into pieces where the distance is
    linear, so running counts and sums along the sorted circle give every candidate's sum:
    sorting work, no pairs.
    """
    vals = distinct_values(df, keys, angle).select(*keys, F.col("_v").alias("x"), F.col("_cnt").cast("double").alias("w"))
    pi = F.lit(math.pi)
    probes = vals.select(*keys, "x", F.lit(0.0).alias("w"), F.lit(1).alias("kind"), F.when(F.col("x") <= 0, F.col("x") + pi).otherwise(F.col("x") - pi).alias("at"))
    both = vals.select(*keys, "x", "w", F.lit(0).alias("kind"), F.col("x").alias("at")).unionByName(probes)
    # Arc position in 1/4096 steps is non-decreasing along the order.
    ranked = number_rows(both, keys, ["at", "kind", "x"], F.floor((F.col("at") + math.pi) * (4096 / (2 * math.pi))), name="_i")
    run = cut_lineage(running_sum(ranked, keys, "_i", {"n": F.col("w"), "s": F.col("w") * F.col("at")}, size=size))
    total = run.groupBy(*keys).agg(F.max("n").alias("N"), F.sum(F.col("w") * F.col("at")).alias("S"))
    own = run.where(F.col("kind") == 0).select(*keys, "x", F.col("n").alias("na"), F.col("s").alias("sa"))
    far = run.where(F.col("kind") == 1).select(*keys, "x", F.col("n").alias("nf"), F.col("s").alias("sf"))
    j = attach(own.join(far, [*keys, "x"]), total, keys)
    x = F.col("x")
    below = x * F.col("na") - F.col("sa")
    above = (F.col("S") - F.col("sa")) - x * (F.col("N") - F.col("na"))
    # Points further than pi count 2*pi - d instead of d.
    hi_n, hi_s = F.col("N") - F.col("nf"), F.col("S") - F.col("sf")
    fix_hi = hi_n * V.TAU - 2 * (hi_s - x * hi_n)
    fix_lo = F.col("nf") * V.TAU - 2 * (x * F.col("nf") - F.col("sf"))
    cost = below + above + F.when(x <= 0, fix_hi).otherwise(fix_lo)
    return j.groupBy(*keys).agg(F.min(F.struct(F.round(cost, 9).alias("c"), x.alias("x")))["x"].alias("median_dir"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per fixed-width bin (last edge included) and their share of the group, empty bins kept."""
    n, lo, hi = len(edges) - 1, edges[0], edges[-1]
    width = (hi - lo) / n
    v = F.col(value)
    b = F.least(F.floor((v - lo) / width), F.lit(n - 1)).cast("int")
    hit = df.where((v >= lo) & (v <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    frame = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = frame.join(hit, [*keys, "bin"], "left").withColumn("count", F.coalesce("_c", F.lit(0)))
    tot = hit.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    d = d.join(tot, list(keys), "left")
    return d.select(*keys, "bin", "count", F.coalesce(F.col("count") / F.col("_t"), F.lit(0.0)).alias("share"))


def mean_density(df: DataFrame, group: Sequence[str], cluster: Sequence[str], value: str, edges: Sequence[float], *, min_values: int = 2) -> DataFrame:
    """Density of each cluster on a fixed grid, averaged over the clusters of a group."""
    width = (edges[-1] - edges[0]) / (len(edges) - 1)
    enough = df.groupBy(*group, *cluster).agg(F.count(value).alias("_k")).where(F.col("_k") >= min_values)
    d = df.join(enough.select(*group, *cluster), [*group, *cluster], "left_semi")
    h = histogram(d, [*group, *cluster], value, edges)
    return h.groupBy(*group, "bin").agg(F.avg(F.col("share") / width).alias("density"), F.count(F.lit(1)).alias("n_clusters"))


def range_of_motion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and p5-p95 range of values centred on the group mean."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    q = exact_quantiles(df, keys, value, {"_p5": 0.05, "_p50": 0.5, "_p95": 0.95})
    return q.join(mean, list(keys)).select(*keys, (F.col("_p50") - F.col("_mean")).alias("median"), (F.col("_p95") - F.col("_p5")).alias("rom"))


def kde_1d(df: DataFrame, value: str, grid: Sequence[float]) -> DataFrame:
    """Gaussian kernel density on a grid, Silverman's bandwidth.

    Every grid point is one sum over the values, so a single combinable aggregate with as
    many columns as the grid yields the whole curve.
    """
    s = df.agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    bw = s.select((1.06 * F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))).alias("_bw"), "_n")
    d = attach(df.where(F.col(value).isNotNull()).select(value), bw, [])
    zs = [(F.lit(float(g)) - F.col(value)) / F.col("_bw") for g in grid]
    sums = d.groupBy("_bw", "_n").agg(*[F.sum(F.exp(-0.5 * z * z)).alias(f"g{i}") for i, z in enumerate(zs)])
    pairs = F.array(*[F.struct(F.lit(float(g)).alias("x"), F.col(f"g{i}").alias("s")) for i, g in enumerate(grid)])
    out = sums.select("_bw", "_n", F.explode(pairs).alias("p"))
    return out.select(F.col("p.x").alias("x"), (F.col("p.s") / math.sqrt(2 * math.pi) / (F.col("_n") * F.col("_bw"))).alias("density"))


def kde_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, gx: Sequence[float], gy: Sequence[float], *, bw: float | None = None) -> DataFrame:
    """2-D Gaussian density per group on a grid, covariance-scaled (Scott's factor unless given),
    normalised over the grid.

    Each row contributes to one grid column at a time: the kernel's sums over ``gx`` are
    columns of the aggregate and ``gy`` is expanded before the map-side combine.
    """
    stat = df.groupBy(*keys).agg(
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_vxy"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    f2 = F.pow(F.col("_n"), F.lit(-1.0 / 3.0)) if bw is None else F.lit(bw * bw)
    stat = stat.select(*keys, *[(F.col(c) * f2).alias(c) for c in ("_vx", "_vy", "_vxy")], "_n")
    d = attach(df.select(*keys, x, y), stat, keys).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(gy) - 1))))
    det = F.col("_vx") * F.col("_vy") - F.col("_vxy") * F.col("_vxy")
    dy = F.element_at(F.array(*[F.lit(float(v)) for v in gy]), F.col("j") + 1) - F.col(y)
    aggs = []
    for i, g in enumerate(gx):
        dx = F.lit(float(g)) - F.col(x)
        e = (F.col("_vy") * dx * dx - 2 * F.col("_vxy") * dx * dy + F.col("_vx") * dy * dy) / det
        aggs.append(F.sum(F.exp(-0.5 * e)).alias(f"g{i}"))
    sums = d.groupBy(*keys, "j").agg(*aggs)
    cells = sums.select(*keys, "j", F.posexplode(F.array(*[F.col(f"g{i}") for i in range(len(gx))])).alias("i", "s"))
    cell = (gx[1] - gx[0]) * (gy[1] - gy[0])
    tot = cells.groupBy(*keys).agg(F.sum("s").alias("_t"))
    return cells.join(tot, list(keys)).select(*keys, "i", "j", (F.col("s") / (F.col("_t") * cell)).alias("density"))


def density_regions(density: DataFrame, keys: Sequence[str], cell: float, fractions: Sequence[float]) -> DataFrame:
    """Level and area of the smallest grid region that holds each share of the mass (a grid is small)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col("density").desc(), "i", "j").rowsBetween(Window.unboundedPreceding, 0)
    d = density.withColumn("_mass", F.sum("density").over(w) * cell).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    lev = d.where(F.col("_mass") >= F.col("fraction")).groupBy(*keys, "fraction").agg(F.max("density").alias("level"))
    area = density.join(lev, list(keys)).where(F.col("density") >= F.col("level")).groupBy(*keys, "fraction", "level").agg((F.count(F.lit(1)) * cell).alias("area"))
    return area


def ellipse(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Covariance ellipse: semi-axes and angle at 50 % coverage, area at 95 %, mean dispersion."""
    a = df.groupBy(*keys).agg(
        F.var_samp(x).alias("_a"), F.var_samp(y).alias("_c"), F.covar_samp(x, y).alias("_b"), F.var_pop(x).alias("_px"), F.var_pop(y).alias("_py"), F.count(F.lit(1)).alias("n")
    )
    half = (F.col("_a") + F.col("_c")) / 2
    root = F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, 2) + F.col("_b") * F.col("_b"))
    det = F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b")
    return a.select(
        *keys, "n", (1.177 * F.sqrt(F.greatest(half + root, F.lit(0.0)))).alias("semi_major"), (1.177 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("semi_minor"),
        F.degrees(F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c")) / 2).alias("angle_deg"), (math.pi * 5.991 * F.sqrt(F.greatest(det, F.lit(0.0)))).alias("area95"),
        F.sqrt(F.col("_px") + F.col("_py")).alias("dispersion"),
    )


def cohen_d(df: DataFrame, group: str, value: str, a, b, keys: Sequence[str] = ()) -> DataFrame:
    """Standardised mean difference with the pooled sample deviation."""
    def part(g, f):
        return f(F.when(F.col(group) == g, F.col(value)))

    s = df.groupBy(*keys).agg(*[part(g, f).alias(f"_{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("_n0") - 1) * F.col("_v0") + (F.col("_n1") - 1) * F.col("_v1")) / (F.col("_n0") + F.col("_n1") - 2)
    return s.select(*keys, ((F.col("_m0") - F.col("_m1")) / F.sqrt(F.when(pooled > 0, pooled))).alias("cohen_d"), F.col("_n0").alias("n_a"), F.col("_n1").alias("n_b"))


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """U of the first group and its normal approximation (ties and continuity corrected), with the two-sided p."""
    d = df.where(F.col(group).isin(a, b)).select(F.lit(1).alias("_all"), F.col(group).alias("_g"), F.col(value).cast("double").alias("_val"))
    ranked, _ = rank_values(distinct_values(d, ["_all"], "_val"), ["_all"])
    in_a = d.where(F.col("_g") == a).groupBy(F.col("_val").alias("_v")).agg(F.count(F.lit(1)).alias("_ka"))
    r = ranked.join(in_a, "_v", "left")
    mid = (F.col("_lo") + F.col("_hi") + 1) / 2.0
    t = F.col("_cnt").cast("double")
    s = r.agg(F.sum(mid * F.coalesce("_ka", F.lit(0))).alias("_ra"), F.sum(F.coalesce("_ka", F.lit(0))).cast("double").alias("n_a"), F.sum(t).alias("_n"), F.sum(t * t * t - t).alias("_ties"))
    n1, n = F.col("n_a"), F.col("_n")
    n2 = n - n1
    u = F.col("_ra") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = (F.abs(u - n1 * n2 / 2) - 0.5) / sd
    out = s.select(u.alias("u"), F.greatest(z, F.lit(0.0)).alias("z"), n1.cast("long").alias("n_a"), n2.cast("long").alias("n_b"))
    return out.mapInPandas(_normal_p, "u double, z double, n_a long, n_b long, p double")  # one row


def _normal_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(p=[normal_two_sided(z) for z in b["z"]])


def kolmogorov_p(ks: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided p of a distance between two large samples: the limit distribution's alternating series."""
    t = F.sqrt(n1 * n2 / (n1 + n2)) * ks
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * t * t) for k in range(2, terms + 1)), F.exp(-2.0 * t * t))
    return F.when(t < 0.04, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_smirnov(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Largest distance of the two empirical distributions."""
    d = df.where(F.col(group).isin(a, b)).select(F.lit(1).alias("_all"), F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ranked, _ = rank_values(distinct_values(d, ["_all"], "_v"), ["_all"])
    in_a = d.where(F.col("_g") == a).select("_all", F.col("_v").alias("_va"))
    ra, _ = rank_values(distinct_values(in_a, ["_all"], "_va"), ["_all"])
    j = ranked.select("_all", "_v", "_hi", "_n", "_lo").join(ra.select(F.col("_v"), F.col("_hi").alias("_ha"), F.col("_n").alias("_na")), "_v", "left")
    na = ra.agg(F.max("_n").alias("_Na"))
    # Where the value does not occur in the first group its count carries over from below.
    d2 = scan(j.select("_all", F.col("_hi").alias("_o"), "_n", "_ha"), ["_all"], "_o", last={"_ca": F.col("_ha")})
    d2 = attach(d2, na, [])
    fa = F.coalesce("_ca", F.lit(0)) / F.col("_Na")
    fb = (F.col("_o") - F.coalesce("_ca", F.lit(0))) / (F.col("_n") - F.col("_Na"))
    return d2.agg(F.max(F.abs(fa - fb)).alias("ks"), F.max("_Na").alias("n_a"), (F.max("_n") - F.max("_Na")).alias("n_b"))


def holm(tests: DataFrame, p: str, name: str = "p_holm") -> DataFrame:
    """Holm-adjusted p values of one family of tests (a short list)."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(1)).orderBy(p, *[c for c in tests.columns if c != p])
    d = tests.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    d = d.withColumn("_a", (F.col("_n") - F.col("_r") + 1) * F.col(p))
    return d.withColumn(name, F.least(F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_r", "_n", "_a")


def _t2(n1: Column, n2: Column, s: dict[str, Column]) -> Column:
    """Hotelling's T squared of two 2-D samples from their sums."""
    def cov(tag: str, n: Column, i: str, k: str) -> Column:
        return s[f"{tag}{i}{k}"] - s[f"{tag}{i}"] * s[f"{tag}{k}"] / n

    dof = n1 + n2 - 2
    sxx, sxy, syy = ((cov("a", n1, i, k) + cov("b", n2, i, k)) / dof for i, k in (("x", "x"), ("x", "y"), ("y", "y")))
    dx, dy = s["ax"] / n1 - s["bx"] / n2, s["ay"] / n1 - s["by"] / n2
    det = sxx * syy - sxy * sxy
    return n1 * n2 / (n1 + n2) * (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / F.when(det != 0, det)


#: half width, in standard deviations of the rank, of the stretch of hash values whose rows are ranked
RANKED_SD = 2.5


def hotelling_permutation(df: DataFrame, group: str, x: str, y: str, unit: str, a, b, *, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """Observed T squared and its permutation p: each permutation relabels the units by the
    order of a hash and only its ten sums are kept.

    The hash is uniform, so the value that parts the groups of a permutation lies near the share of
    the first group. Units clearly below or above are only added up, on the map side; those in a narrow stretch around
    it, a number that grows with the root of the units, are ranked. A permutation parted outside the stretch is done again with a wider one.
    """
    from pyspark.sql import Window

    units = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull() & F.col(y).isNotNull()).select(unit, (F.col(group) == a).alias("_a"), x, y)
    # A short table would be one task, and each unit stands for many rows.
    units = cut_lineage(units.repartition(2 * df.sparkSession.sparkContext.defaultParallelism))
    na, nt = units.agg(F.count_if("_a"), F.count(F.lit(1))).first()
    terms = {"x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y), "yy": F.col(y) * F.col(y)}

    def sums(first: Column, second: Column) -> list[Column]:
        return [F.sum(F.when(on, e).otherwise(0.0)).alias(f"{t}{n}") for t, on in (("a", first), ("b", second)) for n, e in terms.items()]

    names = [f"{t}{n}" for t in "ab" for n in terms]
    # Replicate 0 is the observed labelling.
    per = units.groupBy(F.lit(0).alias("_rep")).agg(*sums(F.col("_a"), ~F.col("_a")))
    share = na / max(nt, 1)
    half = (RANKED_SD * math.sqrt(share * (1 - share) * nt) + 8) / max(nt, 1)
    todo = F.sequence(F.lit(1), F.lit(n_perm))
    while n_perm > 0:
        # "g" lies past all digits
        lo, hi = (f"{max(math.ceil(at * 16**12), 0):012x}" if at < 1 else "g" for at in (share - half, share + half))
        u = hash_digits(seed, F.col("_rep"), F.col(unit), F.col("_a"))
        reps = units.select("*", F.explode(todo).alias("_rep")).withColumn("_u", u)
        below, above = F.col("_u") < lo, F.col("_u") >= hi
        outer = cut_lineage(reps.groupBy("_rep").agg(*sums(below, above), F.count_if(below).alias("_below"), F.count_if(~above).alias("_upto")))
        parted = (F.col("_below") <= na) & (F.col("_upto") >= na)
        near = reps.where(~below & ~above).join(F.broadcast(outer.where(parted).select("_rep", "_below")), "_rep")
        first = F.row_number().over(Window.partitionBy("_rep").orderBy("_u", unit)) <= na - F.col("_below")
        inner = near.withColumn("_first", first).groupBy("_rep").agg(*sums(F.col("_first"), ~F.col("_first")))
        inner = inner.select("_rep", *[F.col(n).alias(f"_{n}") for n in names])
        done = outer.where(parted).join(inner, "_rep", "left").select("_rep", *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0.0))).alias(n) for n in names])
        per = cut_lineage(per.unionByName(done))
        left = [r[0] for r in outer.where(~parted).select("_rep").collect()]  # at most the permutations
        if not left:
            break
        todo, half = F.lit(left), half * 4
    s = {n: F.col(n) for n in names}
    n1, n2 = F.lit(float(na)), F.lit(float(nt - na))
    per = cut_lineage(per.select("_rep", _t2(n1, n2, s).alias("t2")))
    obs = per.where(F.col("_rep") == 0).select(F.col("t2").alias("_obs"))
    j = attach(per, obs, [])
    # A permutation that repeats the observed groups is a tie in whatever order its sums were added up.
    reached = F.col("t2") >= F.col("_obs") * (1 - 1e-12)
    return j.groupBy(F.col("_obs").alias("t2")).agg(((F.count_if((F.col("_rep") > 0) & reached) + 1) / F.lit(n_perm + 1.0)).alias("p"))


def histogram_match(ref: DataFrame, tgt: DataFrame, value: str, ident: str, *, width: float, floor: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Subsample ``ref`` so that its histogram has the shape of ``tgt``'s.

    Every bin gives ``rint(R * target count)`` rows, R being the largest factor all shared
    bins can supply; rows are taken in hash order of ``ident`` (ties: the smaller value).  Returns the kept reference rows and the
    target rows of shared bins.
    """
    b = F.floor((F.col(value) - floor) / width)
    r = ref.where(F.col(value) >= floor).withColumn("_bin", b)
    t = tgt.where(F.col(value) >= floor).withColumn("_bin", b)
    n = r.groupBy("_bin").agg(F.count(F.lit(1)).alias("_nr")).join(t.groupBy("_bin").agg(F.count(F.lit(1)).alias("_nt")), "_bin")
    n = cut_lineage(n)
    factor = n.agg(F.min(F.col("_nr") / F.col("_nt")).alias("_R"))
    want = attach(n, factor, []).select("_bin", F.rint(F.col("_R") * F.col("_nt")).cast("long").alias("_want"))
    d = attach(r, want, ["_bin"], "inner").withColumn("_u", hash_uniform(seed, F.col(ident)))
    ranked = number_rows(d, ["_bin"], ["_u", ident, value], F.floor(F.col("_u") * 1024), name="_i")
    return ranked.where(F.col("_i") < F.col("_want")).drop("_bin", "_u", "_i", "_want"), attach(t, n.select("_bin"), ["_bin"], "left_semi").drop("_bin")


def label_summary(df: DataFrame, keys: Sequence[str], label: str, names: Sequence[str], valid: str) -> DataFrame:
    """Share of each label over valid frames."""
    d = df.where(F.col(valid))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), *[F.avg(F.when(F.col(label) == n, 1.0).otherwise(0.0)).alias(f"frac_{n}") for n in names])


def confusion(df: DataFrame, truth: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Rows per true class and predicted class with the recall of the class."""
    d = df.where(F.col(truth).isNotNull()).groupBy(truth).pivot(label, list(classes)).agg(F.count(F.lit(1)))
    d = d.select(truth, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in classes])
    hits = sum((F.when(F.col(truth) == c, F.col(f"`{c}`")).otherwise(0) for c in classes), F.lit(0))
    total = sum((F.col(f"`{c}`") for c in classes), F.lit(0))
    return d.withColumn("recall", hits / total)
