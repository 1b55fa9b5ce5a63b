"""Centres of animals in space from unlabelled peaks of several cameras.

A frame holds a few peaks per camera, and nothing says which belong together. Every pair of peaks from two
cameras proposes a point; a camera agrees with it if one of its peaks lies near its projection. The point with most
agreeing cameras (then the highest summed score to nine digits, then the first pair) becomes a centre, solved
again from all agreeing peaks, which are taken out before the next round.

All of it happens inside one row per frame (its peaks by camera) with array functions, so a
frame is shuffled once to be put together, and a row is as large as the peaks of a frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators.geometry import rig_keys, small_table
from strideframe.session import cut_lineage

_SIX = [(i, k) for i in range(3) for k in range(i, 3)]


def _equations(c: Column, u: Column, v: Column) -> list[Column]:
    """The nine products of a view's two linear equations: six of the normal matrix, three of the right side."""
    a = [[c[0] - u * c[8], c[1] - u * c[9], c[2] - u * c[10]], [c[4] - v * c[8], c[5] - v * c[9], c[6] - v * c[10]]]
    b = [u - c[3], v - c[7]]
    return [a[0][i] * a[0][k] + a[1][i] * a[1][k] for i, k in _SIX] + [a[0][i] * b[0] + a[1][i] * b[1] for i in range(3)]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _point(sums: Column) -> Column:
    """Solution of the summed equations; null where they leave a direction open."""
    return _let(sums, _solution)


def _solution(s: Column) -> Column:
    m = lambda i, k: s[_SIX.index((min(i, k), max(i, k)))]
    n = [[m(i, k) for i in range(3)] for k in range(3)]
    rhs = [s[6 + i] for i in range(3)]
    det = lambda x: V.dot(tuple(x[0]), V.cross(tuple(x[1]), tuple(x[2])))
    whole = F.when(det(n) != 0, det(n))
    return F.struct(*[(det([rhs if k == i else n[k] for k in range(3)]) / whole).alias("xyz"[i]) for i in range(3)])


def _project(c: Column, p: Column) -> tuple[Column, Column]:
    row = lambda r: c[4 * r] * p["x"] + c[4 * r + 1] * p["y"] + c[4 * r + 2] * p["z"]
    depth = row(2) + 1.0
    return (row(0) + c[3]) / depth, (row(1) + c[7]) / depth


def _agreeing(cams: Column, p: Column, reach: float) -> Column:
    """The nearest peak of each camera, where it lies within reach of the point's projection."""

    def nearest(c: Column) -> Column:
        u, v = _project(c["c"], p)

        def ranked(at: Column) -> Column:
            rank = lambda q: F.struct(F.hypot(q["u"] - at["u"], q["v"] - at["v"]).alias("d"), q["slot"].alias("slot"), q["score"].alias("score"), q["eq"].alias("eq"), c["camera"].alias("camera"))
            return F.array_min(F.transform(c["peaks"], rank))

        return _let(F.struct(u.alias("u"), v.alias("v")), ranked)

    return F.filter(F.transform(cams, nearest), lambda x: x["d"] <= reach)


def frame_peaks(peaks: DataFrame, coeffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``cams``): one row per frame; a peak without coordinates is left out."""
    j = peaks.where("u is not null and v is not null and not isnan(u) and not isnan(v)").join(small_table(coeffs), [*rig_keys(peaks, coeffs), "camera"])
    score = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0))).cast("double")
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    j = j.select(*keys, "camera", "c", F.struct("slot", u.alias("u"), v.alias("v"), score.alias("score"), F.array(*_equations(F.col("c"), u, v)).alias("eq")).alias("q"))
    per = j.groupBy(*keys, "camera").agg(F.any_value("c").alias("c"), F.array_sort(F.collect_list("q")).alias("peaks"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("camera", "c", "peaks"))).alias("cams"))


def lift_centres(peaks: DataFrame, coeffs: DataFrame, keys: Sequence[str], *, min_views: int = 3, reach: float = 25.0, max_animals: int = 2) -> DataFrame:
    """Centres ``(keys, rank, x, y, z, n_views, score)`` from peaks ``(keys, camera, slot, u, v, score)``.

    ``coeffs`` has the eleven coefficients ``c`` of each camera. Ranks start at 0; a frame's search ends
    once fewer than ``min_views`` cameras agree.
    """
    d = frame_peaks(peaks, coeffs, keys)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array(*[F.lit(0.0)] * 9)
    found: DataFrame | None = None
    out = []
    for rank in range(max_animals):
        pairs = F.flatten(F.transform("cams", lambda a: F.flatten(F.transform(
            F.filter("cams", lambda b: b["camera"] > a["camera"]), lambda b: F.flatten(F.transform(a["peaks"], lambda p: F.transform(b["peaks"], lambda q: F.struct(
                a["camera"].alias("a"), b["camera"].alias("b"), p["slot"].alias("p"), q["slot"].alias("q"), _point(plus(p["eq"], q["eq"])).alias("at"))))))
        )))
        tried = F.transform(F.filter(pairs, lambda x: x["at"]["x"].isNotNull()), lambda x: F.struct(x.alias("pair"), _agreeing(F.col("cams"), x["at"], reach).alias("by")))
        ranked = F.transform(tried, lambda x: F.struct((-F.size(x["by"])).alias("n"), (-F.round(F.aggregate(x["by"], F.lit(0.0), lambda s, y: s + y["score"]), 9)).alias("s"), x["pair"].alias("pair"), x["by"].alias("by")))
        d = cut_lineage(d.withColumn("_best", F.array_min(ranked)))
        d = d.where(-F.col("_best.n") >= min_views).withColumn("_sum", F.aggregate("_best.by", zero, lambda s, y: plus(s, y["eq"])))
        out.append(F.struct(F.lit(rank).alias("rank"), _point(F.col("_sum")).alias("at"), F.size("_best.by").cast("long").alias("n_views"), (-F.col("_best.s")).alias("score")))
        now = d.select(*keys, out[-1].alias("o"))
        found = now if found is None else found.unionByName(now)
        taken = lambda c, q: F.exists(F.col("_best.by"), lambda y: (y["camera"] == c["camera"]) & (y["slot"] == q["slot"]))
        left = F.transform("cams", lambda c: F.struct(c["camera"].alias("camera"), c["c"].alias("c"), F.filter(c["peaks"], lambda q: ~taken(c, q)).alias("peaks")))
        d = d.select(*keys, F.filter(left, lambda c: F.size(c["peaks"]) > 0).alias("cams"))
    return found.select(*keys, "o.rank", "o.at.x", "o.at.y", "o.at.z", "o.n_views", "o.score")


def merge_centres(centres: DataFrame, keys: Sequence[str], *, least: float = 15.0) -> DataFrame:
    """Centres of a frame with the closest pair below ``least`` replaced by its middle, until none is left.

    Adds ``n_merged``. A frame holds a handful of centres; each pass merges one pair of every frame that has one, inside its row.
    """
    at = F.struct("x", "y", "z", F.lit(1).alias("n_merged"))
    d = centres.where("x is not null and y is not null and z is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("_c"))
    dist = lambda a, b: V.distance((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"]))

    def step(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(c))
        pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(dist(F.element_at(c, i), F.element_at(c, j)).alias("d"), i.alias("i"), j.alias("j")))))
        best = F.array_min(F.filter(pairs, lambda x: x["d"] < least))
        a, b = F.element_at(c, best["i"]), F.element_at(c, best["j"])
        middle = F.struct(*[((a[k] + b[k]) / 2).alias(k) for k in "xyz"], (a["n_merged"] + b["n_merged"]).alias("n_merged"))
        rest = F.transform(F.filter(places, lambda i: (i != best["i"]) & (i != best["j"])), lambda i: F.element_at(c, i))
        return F.when(best.isNull(), c).otherwise(F.concat(rest, F.array(middle)))

    # a frame of n centres needs at most n - 1 merges: the fold runs that often inside the row
    turns = F.sequence(F.lit(1), F.size("_c"))
    d = d.withColumn("_c", F.aggregate(turns, F.col("_c"), lambda c, _: step(c)))
    return d.select(*keys, F.posexplode("_c").alias("slot", "c")).select(*keys, "slot", "c.x", "c.y", "c.z", "c.n_merged")


def merge_windows(windows: DataFrame, keys: Sequence[str], ident: str, *, radius: float = 30.0, precedence: Sequence[str] = ("track", "reused", "detection")) -> DataFrame:
    """Windows of a frame that hang together within ``radius`` as one: mean centre, best ``source``, their ids.

    The components are found inside the frame's row: every window takes the least number among its
    neighbours until nothing can change, which a handful of windows reaches in as many steps.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("source")).cast("int")
    d = windows.where("x is not null and y is not null and z is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), "x", "y", "z", rank.alias("r")))).alias("_w"))
    near = lambda a, b: V.distance((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"])) <= radius
    places = F.sequence(F.lit(1), F.size("_w"))
    links = F.transform("_w", lambda a: F.filter(places, lambda j: near(a, F.element_at("_w", j))))
    d = d.withColumn("_l", links).withColumn("_g", F.aggregate(places, places, lambda g, _: F.transform(F.col("_l"), lambda l: F.array_min(F.transform(l, lambda j: F.element_at(g, j))))))
    e = d.select(*keys, F.explode(F.arrays_zip("_w", "_g")).alias("e")).select(*keys, F.col("e._g").alias("_g"), "e._w.*")
    g = e.groupBy(*keys, "_g").agg(*[F.avg(c).alias(c) for c in "xyz"], F.min("r").alias("_r"), F.sort_array(F.collect_list("id")).alias("members"))
    window = F.row_number().over(Window.partitionBy(*keys).orderBy("_g")) - 1
    return g.select(*keys, window.cast("long").alias("window"), *"xyz", F.element_at(F.array(*[F.lit(p) for p in precedence]), F.col("_r")).alias("source"), "members")
