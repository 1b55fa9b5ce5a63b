"""Vector expressions as SQL text, for the SQL twins."""

from __future__ import annotations


def v(name: str):
    return f'"{name}_x"', f'"{name}_y"', f'"{name}_z"'


def sub(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def mid(a, b):
    return tuple(f"(({p} + {q}) * 0.5)" for p, q in zip(a, b))


def dot(a, b):
    return f"({a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]})"


def cross(a, b):
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a):
    return f"sqrt({dot(a, a)})"


def dist(a, b):
    return norm(sub(a, b))


def clip(x):
    return f"greatest(least({x}, 1.0), -1.0)"


def angle(a, b):
    return f"degrees(acos({clip(f'{dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0)')}))"


def named(a, name):
    return ", ".join(f'{e} AS "{name}_{c}"' for e, c in zip(a, "xyz"))


def unit(a):
    n = norm(a)
    return tuple(f"({p} / nullif({n}, 0))" for p in a)


def reject(a, u):
    return tuple(f"({p} - {dot(a, u)} * {q})" for p, q in zip(a, u))


def pivot(names, source="kps", keys="track, frame"):
    cols = ", ".join(f"max(CASE WHEN kp = '{n}' THEN {c} END) AS \"{n}_{c}\"" for n in names for c in "xyz")
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"
