"""NumPy kernels of one bout at a time, run by Spark on keyed groups.

Each works on a whole bounded series (an analytic phase needs all of it), so the keys must
bound the series: a bout and a leg, never a recording.  Everything after the kernel
(crossings, cycles, ranks) is native again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.motion import track_map
from strideframe.operators.series import gaussian_taps


def fill_linear(v: np.ndarray) -> np.ndarray:
    """Missing samples on the line between their neighbours, border samples held."""
    ok = np.isfinite(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok]) if ok.any() and not ok.all() else v


def smooth(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    taps = np.array(gaussian_taps(sigma))
    r = len(taps) // 2
    at = np.arange(-r, len(v) + r) % (2 * len(v))
    return np.convolve(v[np.where(at < len(v), at, 2 * len(v) - 1 - at)], taps, "valid")


def analytic(v: np.ndarray) -> np.ndarray:
    """Analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(v)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(v) * gain)


def analytic_phase(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], *, fps: float, sigma: float, min_rows: int = 10, edge: int = 2) -> DataFrame:
    """Phase of the smoothed, mean-centred speed of a point: 0 at peak speed, +-pi at rest.

    The ``edge`` rows at either end, and series shorter than ``min_rows``, have no phase.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        phase = np.full(len(g), np.nan)
        if len(g) >= min_rows:
            pts = np.stack([fill_linear(g[c].to_numpy(float)) for c in cols])
            speed = smooth(np.sqrt((np.gradient(pts, axis=1) ** 2).sum(0)) * fps, sigma)
            phase = np.angle(analytic(speed - np.nanmean(speed)))
            phase[:edge] = phase[len(g) - edge :] = np.nan
        return pd.DataFrame({order: g[order].to_numpy(), "phase": phase})

    out = track_map(df.select(*keys, order, *cols), keys, run, f"{order} long, phase double")
    return out.withColumn("phase", F.when(~F.isnan("phase"), F.col("phase")))


def local_maxima(v: np.ndarray) -> np.ndarray:
    """Middles of the plateaus that are higher than both neighbours; borders never count."""
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    stop = np.r_[start[1:], len(v)] - 1
    level = v[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (start[top] + stop[top]) // 2


def thin(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Highest peaks first, dropping those closer than ``distance`` to a kept one."""
    alive = np.ones(len(peaks), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if alive[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            alive &= ~near
    return peaks[alive]


def prominences(v: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points before a higher sample (or the end)."""
    out = np.empty(len(peaks))
    for n, p in enumerate(peaks):
        above = v > v[p]
        left = np.flatnonzero(above[:p])
        right = np.flatnonzero(above[p:])
        lo = v[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = v[p : (p + right[0] if len(right) else len(v))].min()
        out[n] = v[p] - max(lo, hi)
    return out


def find_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str, *, prominence: float = 0.0, height: float | None = None, distance: int = 1, sigma: float | None = None, min_rows: int = 3) -> DataFrame:
    """Peaks ``(keys, order, height, prominence)`` of each series, missing samples interpolated.

    Low peaks go first, then peaks are thinned by distance, then filtered by prominence.
    """
    kf = [f for f in df.schema.fields if f.name in keys]
    names = [f.name for f in kf]
    cols = [*names, order, "height", "prominence"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        v = g[value].to_numpy(float)
        if np.isfinite(v).sum() < min_rows:
            return pd.DataFrame(columns=cols)
        v = fill_linear(v)
        v = smooth(v, sigma) if sigma else v
        p = local_maxima(v)
        p = p if height is None else p[v[p] >= height]
        p = thin(p, v[p], distance) if distance > 1 else p
        prom = prominences(v, p)
        keep = prom >= prominence
        out = pd.DataFrame({order: g[order].to_numpy()[p[keep]], "height": v[p[keep]], "prominence": prom[keep]})
        for n in names:
            out[n] = g[n].iloc[0]
        return out[cols]

    schema = T.StructType([*kf, T.StructField(order, T.LongType()), T.StructField("height", T.DoubleType()), T.StructField("prominence", T.DoubleType())])
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def peaks_in_cycles(peaks: DataFrame, frames: DataFrame, track: Sequence[str], order: str, cycle: str) -> DataFrame:
    """Peaks with their cycle, their rank inside it and how many it has.

    A cycle is a stride, so the ranking window is small.
    """
    from pyspark.sql import Window

    j = peaks.join(frames.where(F.col(cycle).isNotNull()).select(*track, order, cycle), [*track, order])
    w = Window.partitionBy(*track, cycle)
    return j.withColumn("peak_rank", F.row_number().over(w.orderBy(order)) - 1).withColumn("n_in_cycle", F.count(F.lit(1)).over(w))
