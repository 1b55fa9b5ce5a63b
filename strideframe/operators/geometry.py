"""Landmark geometry: pivots, projections, angles, egocentric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import vectors as V
from strideframe.operators.ordered import BLOCK, lag_lead


MAX_SMALL = 10_000


def small_table(df: DataFrame, max_rows: int = MAX_SMALL) -> DataFrame:
    """Broadcast a reference table after checking that it is small; otherwise leave the join
    strategy to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def each_with(df: DataFrame, table: DataFrame, max_rows: int = MAX_SMALL) -> DataFrame:
    """Every row with every row of a small reference table, which is refused beyond ``max_rows``."""
    if table.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a reference table of more than {max_rows} rows: {table.columns}")
    return df.crossJoin(F.broadcast(table))


def rig_keys(points: DataFrame, cameras: DataFrame) -> list[str]:
    """The rig's column where cameras carry it; camera names are unique inside a rig only."""
    if "calib_group" not in cameras.columns:
        return []
    if "calib_group" not in points.columns:
        raise ValueError("cameras of several rigs need points with calib_group")
    return ["calib_group"]


def frame_maps(kps: DataFrame, keys: Sequence[str], name: str = "kp") -> DataFrame:
    """One row per frame with ``m``: landmark name -> (x, y, z).

    A frame holds one row per landmark, so the collected list is as long as the skeleton.
    """
    return kps.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.struct("x", "y", "z")))).alias("m"))


def wide(kps: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "kp") -> DataFrame:
    """One row per frame with a struct column per named landmark."""
    some = kps.where(F.col(name).isin(*names))
    return some.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.struct("x", "y", "z"))).alias(n) for n in names])


def project(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixel position of every point in every camera of its rig (``calib_group`` in both tables;
    without it the cameras are one rig)."""
    rig = rig_keys(points, cameras)
    j = points.join(small_table(cameras), rig) if rig else each_with(points, cameras)
    p = [F.element_at("p", i + 1) for i in range(12)]
    row = [p[4 * r] * F.col("x") + p[4 * r + 1] * F.col("y") + p[4 * r + 2] * F.col("z") + p[4 * r + 3] for r in range(3)]
    w = F.when(row[2] != 0, row[2])
    return j.withColumn("u", row[0] / w).withColumn("v", row[1] / w).drop("p")


def project_dlt(points: DataFrame, coeffs: DataFrame, col: str = "c") -> DataFrame:
    """Projection with 11 coefficients per camera."""
    rig = rig_keys(points, coeffs)
    j = points.join(small_table(coeffs), rig) if rig else each_with(points, coeffs)
    c = [F.element_at(col, i + 1) for i in range(11)]
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    w = c[8] * x + c[9] * y + c[10] * z + 1
    w = F.when(w != 0, w)
    return j.withColumn("u", (c[0] * x + c[1] * y + c[2] * z + c[3]) / w).withColumn("v", (c[4] * x + c[5] * y + c[6] * z + c[7]) / w).drop(col)


def segment_lengths(kps: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """Length of every named edge per frame; edges with an absent name give no row.

    ``edges(a, b)`` is the skeleton table.
    """
    j = each_with(frame_maps(kps, keys), edges)
    pa, pb = F.col("m")[F.col("a")], F.col("m")[F.col("b")]
    return (
        j.where(F.map_contains_key("m", F.col("a")) & F.map_contains_key("m", F.col("b")))
        .select(*keys, "a", "b", V.distance(V.vec(pa), V.vec(pb)).alias("length"))
    )


def wing_extension(w: DataFrame) -> DataFrame:
    """Left/right angle between body axis and wing, from the eight wing and body landmarks."""
    axis = V.sub(V.vec("Antenna_Base"), V.vec("Scutellum"))

    def side(s: str) -> Column:
        tip = V.mid(V.vec(f"Wing{s}_V12"), V.vec(f"Wing{s}_V13"))
        return V.angle_deg(axis, V.sub(tip, V.vec(f"Wing{s}_base")))

    return w.withColumn("ext_l", side("L")).withColumn("ext_r", side("R"))


def wing_horizontal(w: DataFrame) -> DataFrame:
    """Wing angle in the body's horizontal plane (folded into 0..90 degrees)."""
    fwd = V.unit(V.sub(V.vec("Antenna_Base"), V.vec("Scutellum")))
    w = w.withColumn("_f", V.pack(fwd))
    fwd = V.vec("_f")
    w = w.withColumn("_d", V.pack(V.unit(V.cross(fwd, V.sub(V.vec("WingR_base"), V.vec("WingL_base"))))))
    dorsal = V.vec("_d")
    w = w.withColumn("_l", V.pack(V.unit(V.cross(dorsal, fwd))))
    lat = V.vec("_l")

    def side(s: str) -> Column:
        flat = V.reject(V.sub(V.mid(V.vec(f"Wing{s}_V12"), V.vec(f"Wing{s}_V13")), V.vec(f"Wing{s}_base")), dorsal)
        return F.degrees(F.atan2(F.abs(V.dot(flat, lat)), F.abs(V.dot(flat, fwd))))

    return w.withColumn("hor_l", side("L")).withColumn("hor_r", side("R")).drop("_f", "_d", "_l")


def body_frame(w: DataFrame) -> DataFrame:
    """Orthogonal body axes ``bx, by, bz`` and head axes ``hx, hy, hz`` (Gram-Schmidt)."""
    sc = V.vec("Scutellum")
    w = w.withColumn("bx", V.pack(V.unit(V.sub(V.mid(V.vec("T1L_ThxCx"), V.vec("T1R_ThxCx")), sc))))
    w = w.withColumn("by", V.pack(V.unit(V.reject(V.sub(V.vec("WingL_base"), V.vec("WingR_base")), V.vec("bx")))))
    w = w.withColumn("bz", V.pack(V.cross(V.vec("bx"), V.vec("by"))))
    w = w.withColumn("hy", V.pack(V.unit(V.sub(V.vec("EyeL"), V.vec("EyeR")))))
    eye = V.mid(V.vec("EyeL"), V.vec("EyeR"))
    w = w.withColumn("hx", V.pack(V.unit(V.reject(V.sub(V.vec("Antenna_Base"), eye), V.vec("hy")))))
    return w.withColumn("hz", V.pack(V.cross(V.vec("hx"), V.vec("hy"))))


def head_angles(w: DataFrame) -> DataFrame:
    """Head pitch, yaw and roll in the body frame (needs ``body_frame``)."""
    bx, by, bz, hx, hy, hz = (V.vec(c) for c in ("bx", "by", "bz", "hx", "hy", "hz"))
    return (
        w.withColumn("head_pitch", F.degrees(-F.asin(V.clip(V.dot(hx, bz), -1.0, 1.0))))
        .withColumn("head_yaw", F.degrees(F.atan2(V.dot(hx, by), V.dot(hx, bx))))
        .withColumn("head_roll", F.degrees(F.atan2(V.dot(hy, bz), V.dot(hz, bz))))
    )


def body_local(w: DataFrame, points: Sequence[str], origin: str = "Scutellum") -> DataFrame:
    """Each named landmark in the body frame as ``<name>_x/_y/_z``."""
    axes = [V.vec(c) for c in ("bx", "by", "bz")]
    for n in points:
        rel = V.sub(V.vec(n), V.vec(origin))
        for c, axis in zip("xyz", axes):
            w = w.withColumn(f"{n}_{c}", V.dot(rel, axis))
    return w


def grooming_quantities(w: DataFrame, leg: str = "TaTip") -> DataFrame:
    """Distances of the front feet to eyes and antenna, lateral and vertical offsets, roll."""
    w = body_local(w, ["Antenna_Base", "EyeL", "EyeR", f"T1L_{leg}", f"T1R_{leg}"])

    def at(n: str) -> V.Vec:
        return F.col(f"{n}_x"), F.col(f"{n}_y"), F.col(f"{n}_z")

    tl, tr, ant = at(f"T1L_{leg}"), at(f"T1R_{leg}"), at("Antenna_Base")
    out = {
        "y_l": tl[1],
        "y_r": tr[1],
        "d_ll": V.distance(tl, at("EyeL")),
        "d_rr": V.distance(tr, at("EyeR")),
        "d_ant": F.least(V.distance(tl, ant), V.distance(tr, ant)),
        "dz_l": tl[2] - ant[2],
        "dz_r": tr[2] - ant[2],
        "gap_xy": F.hypot(tl[0] - tr[0], tl[1] - tr[1]),
        "roll": F.degrees(F.atan2(V.dot(V.vec("hy"), V.vec("bz")), V.dot(V.vec("hz"), V.vec("bz")))),
    }
    for n, c in out.items():
        w = w.withColumn(n, c)
    return w


def egocentric(points: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """World points in the body frame of the pose of the same frame.

    ``poses`` has ``bx0, by0, bz0`` (origin) and ``qw, qx, qy, qz``.
    """
    j = points.join(poses, list(keys))
    rel = V.sub((F.col("x"), F.col("y"), F.col("z")), (F.col("bx0"), F.col("by0"), F.col("bz0")))
    e = V.rotate_inverse(tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")), rel)
    return j.select(*points.columns, *[c.alias(n) for c, n in zip(e, ("ex", "ey", "ez"))])


def levelled(points: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fore-aft and lateral offsets in a frame that keeps the body's yaw but takes the
    vertical from gravity, with the body pitch (nose up positive)."""
    j = points.join(poses, list(keys))
    fwd = V.body_forward(tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    flat = V.unit((fwd[0], fwd[1], F.lit(0.0)))
    dx, dy = F.col("x") - F.col("bx0"), F.col("y") - F.col("by0")
    return j.select(
        *points.columns,
        F.degrees(F.asin(V.clip(-fwd[2], -1.0, 1.0))).alias("pitch"),
        (dx * flat[0] + dy * flat[1]).alias("anterior"),
        (-dx * flat[1] + dy * flat[0]).alias("lateral"),
    )


def quat_pitch_deg(qw, qx, qy, qz) -> Column:
    """Elevation of the body axis from its quaternion."""
    return F.degrees(F.asin(V.clip(2.0 * (qx * qz - qw * qy), -1.0, 1.0)))


def apply_similarity(p: V.Vec, s: Column, r: Sequence[Column], t: V.Vec) -> V.Vec:
    """s R p + t with a row-major rotation."""
    return tuple(s * (r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2]) + t[i] for i in range(3))


def invert_similarity(p: V.Vec, s: Column, r: Sequence[Column], t: V.Vec) -> V.Vec:
    d = V.sub(p, t)
    return tuple((r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2]) / s for i in range(3))


def plane_height(p: V.Vec, normal: V.Vec, offset: Column) -> Column:
    return V.dot(normal, p) + offset


def coarse_features(w: DataFrame, keys: Sequence[str], order: str, *, floor_normal: Sequence[float], floor_offset: float, size: int = BLOCK) -> DataFrame:
    """Per animal-frame wing angle, height and speed from wide landmarks with ``centroid``."""
    axis = V.sub(V.vec("Abd_tip"), V.vec("Scutellum"))
    wings = [V.angle_deg(axis, V.sub(V.vec(f"Wing{s}_V13"), V.vec(f"Wing{s}_base"))) for s in "LR"]
    n = tuple(F.lit(float(v)) for v in floor_normal)
    d = lag_lead(w, keys, order, lags={"_pc": "centroid"}, size=size)
    return (
        d.withColumn("wing_angle_deg", F.greatest(*wings))
        .withColumn("height", plane_height(V.vec("centroid"), n, F.lit(floor_offset)))
        .withColumn("speed", V.distance(V.vec("centroid"), V.vec("_pc")))
        .drop("_pc")
    )


def pair_features(w: DataFrame, bout: Sequence[str], fly: str, order: str) -> DataFrame:
    """Distance of the two animals and the heading of animal 1 towards animal 0, per frame."""
    cols = ["centroid", "Scutellum", "Abd_tip"]
    a = w.where(F.col(fly) == 0).select(*bout, order, F.col("centroid").alias("_c0"))
    b = w.where(F.col(fly) == 1).select(*bout, order, *[F.col(c).alias(f"_{c}") for c in cols])
    j = a.join(b, [*bout, order])
    to_other = V.sub(V.vec("_c0"), V.vec("_centroid"))
    fwd = V.sub(V.vec("_Scutellum"), V.vec("_Abd_tip"))
    return j.select(*bout, order, V.norm(to_other).alias("dist"), V.angle_deg(fwd, to_other).alias("heading_deg"))
