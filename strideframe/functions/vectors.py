"""Three-component vector algebra on columns (all JVM-side expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(c: str | Column) -> Vec:
    """Components of a struct column with fields x, y, z."""
    col = F.col(c) if isinstance(c, str) else c
    return col["x"], col["y"], col["z"]


def pack(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def mid(a: Vec, b: Vec) -> Vec:
    return scale(add(a, b), 0.5)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, eps: float = 1e-9) -> Vec:
    """Unit vector, null where the length is not above ``eps``."""
    n = norm(a)
    n = F.when(n > eps, n)
    return tuple(p / n for p in a)


def reject(a: Vec, axis: Vec) -> Vec:
    """Part of ``a`` orthogonal to the unit vector ``axis``."""
    return sub(a, scale(axis, dot(a, axis)))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp, null staying null (``greatest``/``least`` skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def angle_deg(a: Vec, b: Vec) -> Column:
    """Angle between two vectors; null when either has no length."""
    n = norm(a) * norm(b)
    return F.degrees(F.acos(clip(dot(a, b) / F.when(n > 0, n), -1.0, 1.0)))


def elevation_deg(a: Vec, up: Vec | None = None) -> Column:
    """Elevation of ``a`` over the plane with unit normal ``up`` (z by default)."""
    n = norm(a)
    rise = a[2] if up is None else dot(a, up)
    return F.degrees(F.asin(clip(rise / F.when(n > 0, n), -1.0, 1.0)))


def wrap(angle: Column) -> Column:
    """Angle in [-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def missing_to_null(c: Column) -> Column:
    """NaN becomes null, the single missing marker used past ingest."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def rotate_inverse(q: tuple[Column, Column, Column, Column], v: Vec) -> Vec:
    """Rotate a world vector into the body frame of quaternion ``q`` (w, x, y, z)."""
    w, x, y, z = q
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    )
    return tuple(dot(r, v) for r in rows)


def body_forward(q: tuple[Column, Column, Column, Column]) -> Vec:
    """Body x axis in the world."""
    w, x, y, z = q
    return 1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)


def quat_delta(a, b):
    """conj(a) * b of two (w, x, y, z) quaternions."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw + ax * bx + ay * by + az * bz,
        aw * bx - ax * bw - ay * bz + az * by,
        aw * by + ax * bz - ay * bw - az * bx,
        aw * bz - ax * by + ay * bx - az * bw,
    )


TAU = 2 * math.pi
