"""Recursive (IIR) filters over tracks of any length.

A recursive filter is an affine map of a small state per row, and maps compose: a block of rows as a
whole maps the state before it to the state after it. So blocks are filtered on their own from rest,
which gives each block's map; the states at the block borders follow from the maps alone (one small
row a block, and one a thousand blocks); then every block is filtered once more from its true state.
The result is that of one pass over the track, while no task holds more than a block.

Orders must be dense and unique inside a key (0, 1, 2, ...), values must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.ordered import BLOCK, block_of, halo_rows, read_once
from strideframe.session import cut_lineage

#: blocks whose maps one task joins up
GROUP = 1024
_STRIDE = 64


def _poly(roots: np.ndarray) -> np.ndarray:
    return np.real(np.poly(roots))


def butterworth(order: int, edges: float | tuple[float, float], fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a low-pass (one edge) or band-pass (two edges) Butterworth filter.

    The analog prototype's poles are moved to the warped edges and mapped by the bilinear
    transform. Edges are in the unit of ``fps``.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    nyquist = fps / 2
    if np.ndim(edges) == 0:
        w = 4 * np.tan(np.pi * min(float(edges) / nyquist, 0.999) / 2)
        zeros, poles, gain = np.zeros(0), poles * w, w**order
    else:
        low, high = max(edges[0] / nyquist, 1e-4), min(edges[1] / nyquist, 0.999)
        w1, w2 = (4 * np.tan(np.pi * f / 2) for f in (low, high))
        width, middle = w2 - w1, w1 * w2
        half = poles * width / 2
        root = np.sqrt(half**2 - middle)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    more = len(poles) - len(zeros)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(more)])
    return gain * _poly(z), _poly((4 + poles) / (4 - poles))


@dataclass
class Kernel:
    """State-space form (transposed direct form II): y = c x + d u, x' = A x + b u."""

    A: np.ndarray
    b: np.ndarray
    d: float

    @classmethod
    def of(cls, b: Sequence[float], a: Sequence[float]) -> Kernel:
        n = max(len(a), len(b))
        b, a = (np.concatenate([np.asarray(x, float), np.zeros(n - len(x))]) / a[0] for x in (b, a))
        A = np.eye(n - 1, k=1)
        A[:, 0] -= a[1:]
        return cls(A, b[1:] - a[1:] * b[0], float(b[0]))

    @property
    def order(self) -> int:
        return len(self.b)

    def rest(self) -> np.ndarray:
        """State that a constant input of 1 leads to."""
        return np.linalg.solve(np.eye(self.order) - self.A, self.b)

    @cached_property
    def stretch(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a stretch of rows: outputs by the state before it and by its inputs, the state after it by the same two."""
        powers = [np.eye(self.order)]
        for _ in range(_STRIDE):
            powers.append(self.A @ powers[-1])
        seen = np.stack([p[0] for p in powers[:-1]])  # output of the state after k rows
        into = np.stack([p @ self.b for p in powers[:-1]])  # state left by an input k rows ago
        lag = np.subtract.outer(np.arange(_STRIDE), np.arange(_STRIDE))
        answer = np.where(lag > 0, into[:, 0][np.maximum(lag - 1, 0)], 0.0) + self.d * np.eye(_STRIDE)
        return seen.T, answer.T, powers[-1].T, into[::-1]

    def states_after(self, u: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The state that each group ``u[start:stop]`` leads to from rest; all groups take their next stretch together."""
        _, _, carry, pushed = self.stretch
        x = np.zeros((len(starts), self.order))
        at = stops - -(-(stops - starts) // _STRIDE) * _STRIDE  # zeros before the first row leave it at rest
        live = np.flatnonzero(at < stops)
        while len(live):
            i = at[live, None] + np.arange(_STRIDE)
            x[live] = x[live] @ carry + np.where(i >= starts[live, None], u[np.maximum(i, 0)], 0.0) @ pushed
            at[live] += _STRIDE
            live = live[at[live] < stops[live]]
        return x

    def outputs(self, u: np.ndarray, starts: np.ndarray, stops: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Outputs of the groups ``u[start:stop]``, each from its row of ``x``, in place of the inputs."""
        seen, answer, carry, pushed = self.stretch
        x, y, at = x.copy(), np.zeros(len(u)), starts.copy()
        live = np.flatnonzero(at < stops)
        while len(live):
            i = at[live, None] + np.arange(_STRIDE)
            own = i < stops[live, None]
            part = np.where(own, u[np.minimum(i, len(u) - 1)], 0.0)
            y[i[own]] = (part @ answer + x[live] @ seen)[own]
            x[live] = x[live] @ carry + part @ pushed
            at[live] += _STRIDE
            live = live[at[live] < stops[live]]
        return y


Rows = dict[str, np.ndarray]


def by_group(df: DataFrame, by: Sequence[str], order: str, schema: T.StructType, run: Callable[[Rows], Rows | None]) -> DataFrame:
    """``run`` on the columns of each group, in order; groups follow each other in a partition, so small ones cost little.

    ``run`` gives the columns of ``schema`` but for ``by``, which are filled in (shorter columns aren't stretched). A group must fit a task.
    """

    def each(values: Rows, starts: np.ndarray, stops: np.ndarray) -> tuple[Rows, np.ndarray] | None:
        parts = [run({c: v[a:b] for c, v in values.items()}) for a, b in zip(starts, stops, strict=True)]
        counts = np.array([0 if p is None else len(next(iter(p.values()))) for p in parts])
        made = [p for p in parts if p is not None]
        return ({n: np.concatenate([p[n] for p in made]) for n in made[0]}, counts) if made else None

    return by_groups(df, by, order, schema, each)


def by_groups(
    df: DataFrame, by: Sequence[str], order: str, schema: T.StructType, run: Callable[[Rows, np.ndarray, np.ndarray], tuple[Rows, np.ndarray] | None]
) -> DataFrame:
    """The same for many whole groups at once: ``run`` sees their columns one after the other with the first and the next
    row of each group, and gives columns with the number of rows of each group."""
    names, columns = schema.fieldNames(), df.columns

    def groups(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        values = {c: g[c].to_numpy() for c in columns}
        made = run(values, starts, np.append(starts[1:], len(g)))
        if made is None:
            return None
        rows, counts = made
        rows = {**{k: np.repeat(values[k][starts], counts) for k in by if k in names}, **rows}
        return pd.DataFrame({n: rows[n] for n in names})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for g in batches:
            g = g if rest is None else pd.concat([rest, g], ignore_index=True)
            if not len(g):
                continue
            new = np.zeros(len(g), bool)
            new[0] = True
            for k in by:
                v = g[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            rest = g.iloc[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1 and (out := groups(g.iloc[: starts[-1]], starts[:-1])) is not None:
                yield out
        if rest is not None and (out := groups(rest, np.zeros(1, int))) is not None:
            yield out

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(stream, schema)


def _objects(rows: Sequence) -> np.ndarray:
    out = np.empty(len(rows), object)
    out[:] = list(rows)
    return out


_DOUBLES = T.ArrayType(T.DoubleType())


def _typed(*fields: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in fields]


def _states(blocks: DataFrame, keys: Sequence[str], kernel: Kernel, series: int) -> DataFrame:
    """(keys, ``_blk``, ``_x``): the states of all series before each block, from (keys, ``_blk``, ``_len``, ``_first``, ``_end``)."""
    p, rest = kernel.order, kernel.rest()
    names = list(keys)
    fields = [f for f in blocks.schema.fields if f.name in names]

    powers: dict[int, np.ndarray] = {}  # of the lengths that blocks have

    def compose(g: Rows) -> Rows:
        """The map from the group's start to each of its blocks, and last the whole group's (block -1)."""
        M, v, maps = np.eye(p), np.zeros((series, p)), []
        for n, end in zip(g["_len"].tolist(), g["_end"], strict=True):
            maps.append((M, v))
            if n not in powers:
                powers[n] = np.linalg.matrix_power(kernel.A, n)
            M, v = powers[n] @ M, v @ powers[n].T + np.asarray(end).reshape(series, p)
        maps.append((M, v))
        return {
            "_blk": np.append(g["_blk"], -1), "_last": np.arange(len(maps)) == len(maps) - 1, "_map": _objects([m.ravel() for m, _ in maps]), "_add": _objects([x.ravel() for _, x in maps]),
            "_first": _objects([g["_first"][0]] * len(maps)),
        }

    def follow(g: Rows) -> Rows:
        x, rows = np.outer(g["_first"][0], rest), []
        for M, v in zip(g["_map"], g["_add"], strict=True):
            rows.append(x.ravel())
            x = x @ np.asarray(M).reshape(p, p).T + np.asarray(v).reshape(series, p)
        return {"_grp": g["_grp"], "_x0": _objects(rows)}

    group = T.StructField("_grp", T.LongType())
    maps = blocks.withColumn("_grp", F.floor(F.col("_blk") / GROUP))
    out = _typed(("_blk", T.LongType()), ("_last", T.BooleanType()), ("_map", _DOUBLES), ("_add", _DOUBLES), ("_first", _DOUBLES))
    maps = cut_lineage(by_group(maps, [*names, "_grp"], "_blk", T.StructType([*fields, group, *out]), compose))
    heads = by_group(maps.where("_last"), names, "_grp", T.StructType([*fields, group, T.StructField("_x0", _DOUBLES)]), follow)
    at = maps.where("not _last").join(heads, [*names, "_grp"])
    row = lambda k, i: F.aggregate(F.zip_with(F.slice("_map", i * p + 1, p), F.slice("_x0", k * p + 1, p), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) + F.col("_add")[k * p + i]
    return at.select(*names, "_blk", F.array(*[row(k, i) for k in range(series) for i in range(p)]).alias("_x"))


def _listed(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def recursive_filter(
    df: DataFrame, keys: Sequence[str], order: str, value: str | Sequence[str], kernel: Kernel, *, name: str | Sequence[str], size: int = BLOCK
) -> DataFrame:
    """(keys, order, ``name``): the filtered series; each key starts as if its first value had always been there.

    Several series of the same rows, with a name each, pass in one go.
    """
    names, values, results = list(keys), _listed(value), _listed(name)
    by, p = [*names, "_blk"], kernel.order
    us = [f"_u{k}" for k in range(len(values))]
    fields = [f for f in df.schema.fields if f.name in names]
    b = df.select(*names, block_of(order, size).alias("_blk"), F.col(order).cast("long").alias(order), *[F.col(v).cast("double").alias(u) for v, u in zip(values, us, strict=True)])

    def ends(g: Rows, starts: np.ndarray, stops: np.ndarray) -> tuple[Rows, np.ndarray]:
        after = np.concatenate([kernel.states_after(g[u], starts, stops) for u in us], 1)
        return {"_len": stops - starts, "_first": _objects(np.stack([g[u][starts] for u in us], 1)), "_end": _objects(after)}, np.ones(len(starts), int)

    def filtered(g: Rows, starts: np.ndarray, stops: np.ndarray) -> tuple[Rows, np.ndarray]:
        """The first row of a block brings its states."""
        x = np.stack([np.asarray(x, float) for x in g["_x"][starts]])
        own = np.ones(len(g[order]), bool)
        own[starts] = False
        made = {n: kernel.outputs(g[u], starts + 1, stops, x[:, k * p : (k + 1) * p])[own] for k, (n, u) in enumerate(zip(results, us, strict=True))}
        return {order: g[order][own].astype("int64"), **made}, stops - starts - 1

    block = T.StructField("_blk", T.LongType())
    summary = by_groups(b, by, order, T.StructType([*fields, block, *_typed(("_len", T.LongType()), ("_first", _DOUBLES), ("_end", _DOUBLES))]), ends)
    states = _states(cut_lineage(summary), names, kernel, len(values))
    # nulls sort first
    empty = [F.lit(None).cast("long").alias(order), *[F.lit(None).cast("double").alias(u) for u in us]]
    rows = states.select(*by, *empty, "_x").unionByName(b.withColumn("_x", F.lit(None).cast("array<double>")))
    out = T.StructType([*fields, block, *_typed((order, T.LongType()), *[(n, T.DoubleType()) for n in results])])
    return by_groups(rows, by, order, out, filtered).drop("_blk")


def zero_phase(
    df: DataFrame, keys: Sequence[str], order: str, value: str | Sequence[str], b: Sequence[float], a: Sequence[float], *, name: str | Sequence[str], size: int = BLOCK
) -> DataFrame:
    """Filter forward and backward; both ends are first continued by their point reflection.

    Adds ``name`` (one for each series). The reflection takes three times the filter's length, or what the track has. A track's
    two ends reach its rows as one row a block.
    """
    kernel = Kernel.of(b, a)
    reach = 3 * max(len(a), len(b))
    names, values = list(keys), _listed(value)
    by, us = [*names, "_blk"], [f"_u{k}" for k in range(len(values))]
    df = read_once(df)
    o = F.col(order)
    d = df.select(*names, block_of(order, size).alias("_blk"), o.cast("long").alias(order), *[F.col(v).cast("double").alias(u) for v, u in zip(values, us, strict=True)])
    edges = [c for u in us for c in (F.min_by(u, o).alias(f"_a{u}"), F.max_by(u, o).alias(f"_z{u}"))]
    blocks = d.groupBy(*by).agg(F.min(order).alias("_a"), F.max(order).alias("_z"), *edges)
    track = Window.partitionBy(*names)
    whole = {"_lo": F.min("_a"), "_hi": F.max("_z")} | {f"_lo{u}": F.min_by(f"_a{u}", "_a") for u in us} | {f"_hi{u}": F.max_by(f"_z{u}", "_z") for u in us}
    d = d.join(blocks.select(*by, *[c.over(track).alias(n) for n, c in whole.items()]), by, "left")
    mirrored = lambda end: F.struct((2 * F.col(end) - o).alias(order), *[(2 * F.col(f"{end}{u}") - F.col(u)).alias(u) for u in us])
    head = F.when((o - F.col("_lo")).between(1, reach), mirrored("_lo"))
    tail = F.when((F.col("_hi") - o).between(1, reach), mirrored("_hi"))
    padded = cut_lineage(d.select(*names, F.inline(F.array_compact(F.array(F.struct(order, *us), head, tail)))))
    there = cut_lineage(recursive_filter(padded, names, order, us, kernel, name=us, size=size).withColumn(order, -o))
    back = recursive_filter(there, names, order, us, kernel, name=_listed(name), size=size).withColumn(order, -o)
    return df.join(back, [*names, order])


def quadrature_weights(half: int, beta: float = 8.0) -> np.ndarray:
    """Taps of a windowed quadrature (Hilbert) filter of ``2 * half + 1`` rows."""
    k = np.arange(-half, half + 1)
    ideal = np.where(k % 2 != 0, 2 / (np.pi * np.where(k == 0, 1, k)), 0.0)
    return ideal * np.i0(beta * np.sqrt(1 - (k / (half + 1)) ** 2)) / np.i0(beta)


def block_map(df: DataFrame, keys: Sequence[str], order: str, schema: T.StructType, run: Callable[[Rows, np.ndarray], Rows | None], *, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """``run`` on the sorted rows of each block together with the ``before``/``after`` rows around it.

    Its second argument marks the rows that belong to the block itself; ``schema`` begins with the keys.
    """
    apply = lambda g: run(g, g[order] // size == g["_blk"][0])
    return by_group(halo_rows(df, order, before=before, after=after, size=size), [*keys, "_blk"], order, schema, apply)


def envelope(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], *, name: str, half: int = 128, size: int = BLOCK) -> DataFrame:
    """Largest magnitude of the analytic signals of band-limited series, as column ``name``.

    The quadrature part is a filter of bounded reach, not a transform of the whole track, so it
    has no wrap-around; rows outside of the track count as 0.
    """
    taps = quadrature_weights(half)
    fields = [f for f in df.schema.fields if f.name in keys]

    def run(g: Rows, own: np.ndarray) -> Rows:
        best = np.zeros(len(own))
        for v in values:
            best = np.maximum(best, np.hypot(g[v], np.convolve(g[v], taps)[half : half + len(own)]))
        return {order: g[order][own], name: best[own]}

    schema = T.StructType([*fields, *_typed((order, T.LongType()), (name, T.DoubleType()))])
    return df.join(block_map(df.select(*keys, order, *values), keys, order, schema, run, before=half, after=half, size=size), [*keys, order])


def slepian(rows: int, bandwidth: float, count: int) -> np.ndarray:
    """The first ``count`` discrete prolate tapers of unit energy, from the commuting tridiagonal matrix."""
    k = np.arange(rows)
    m = np.diag(((rows - 1 - 2 * k) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / rows))
    off = (k[1:] * (rows - k[1:])) / 2
    vectors = np.linalg.eigh(m + np.diag(off, 1) + np.diag(off, -1))[1]
    return vectors[:, ::-1].T[:count]


def batches_in_order(df: DataFrame, keys: Sequence[str], order: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """Rows of each key as a stream in order: ``run`` sees batches, and keys follow each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
