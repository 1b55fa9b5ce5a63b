"""Song: pulse candidates, trains and masks; sine windows, segments and labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators import recursive as R
from strideframe.operators.kernels import find_peaks
from strideframe.operators.ordered import BLOCK, halo, lag_lead, read_once, running_sum, scan
from strideframe.operators.quantiles import attach, exact_median, exact_quantiles
from strideframe.operators.series import step_change
from strideframe.session import cut_lineage


def pulse_trains(peaks: DataFrame, keys: Sequence[str], order: str, *, isolation: int, max_median_interval: float, min_pulses: int = 2, size: int = BLOCK) -> DataFrame:
    """Pulses with a neighbour within ``isolation`` rows whose train (no longer gap inside) has a
    small enough median interval; adds ``train``."""
    d = scan(peaks.select(*keys, order), keys, order, before={"_p": F.col(order)}, after={"_n": F.col(order)}, size=size)
    near = F.coalesce(F.col(order) - F.col("_p") <= isolation, F.lit(False)) | F.coalesce(F.col("_n") - F.col(order) <= isolation, F.lit(False))
    d = cut_lineage(d.where(near).select(*keys, order))
    d = scan(d, keys, order, before={"_p": F.col(order)}, size=size).withColumn("_d", F.col(order) - F.col("_p"))
    joined = F.coalesce(F.col("_d") <= isolation, F.lit(False))
    d = cut_lineage(running_sum(d, keys, order, {"train": (~joined).cast("long")}, size=size).withColumn("_d", F.when(joined, F.col("_d"))))
    n = d.groupBy(*keys, "train").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_pulses)
    good = exact_median(d, [*keys, "train"], "_d", "_m").where(F.col("_m") <= max_median_interval).join(n, [*keys, "train"])
    return d.join(good.select(*keys, "train"), [*keys, "train"], "left_semi").select(*keys, order, "train")


def pulse_mask(frames: DataFrame, peaks: DataFrame, keys: Sequence[str], order: str, *, half: int, bridge: int, name: str, size: int = BLOCK) -> DataFrame:
    """Frames within ``half`` rows of a pulse or between two pulses at most ``bridge`` rows apart."""
    d = frames.join(peaks.select(*keys, order).distinct().withColumn("_hit", F.lit(True)), [*keys, order], "left")
    at = F.when(F.col("_hit"), F.col(order))
    d = scan(d, keys, order, last={"_l": at}, next={"_n": at}, size=size)
    on = (F.col(order) - F.col("_l") <= half, F.col("_n") - F.col(order) <= half, F.col("_n") - F.col("_l") <= bridge)
    flag = F.lit(False)
    for c in on:
        flag = flag | F.coalesce(c, F.lit(False))
    return d.withColumn(name, flag).drop("_hit", "_l", "_n")


def derivative_pulses(
    df: DataFrame, keys: Sequence[str], order: str, left: str, right: str, *, fps: float, height: float, prominence: float, distance: int, baseline: int, exclude: int,
    ratio: float, size: int = BLOCK,
) -> DataFrame:
    """Peaks of the faster wing's speed that stand ``ratio`` times above their surroundings.

    The surroundings are the rows within ``baseline`` but not within ``exclude`` of the peak;
    each peak asks for those rows by number, so it is an equi-join on few rows.
    """
    d = step_change(df, keys, order, left, fps=fps, name="_a", size=size)
    d = step_change(d, keys, order, right, fps=fps, name="_b", size=size)
    d = cut_lineage(d.select(*keys, order, F.greatest("_a", "_b").alias("_dz")))
    p = cut_lineage(find_peaks(d, keys, order, "_dz", prominence=prominence, height=height, distance=distance))
    around = p.select(*keys, F.col(order).alias("_c"), F.explode(F.sequence(F.col(order) - baseline, F.col(order) + baseline)).alias(order))
    around = around.where(F.abs(F.col(order) - F.col("_c")) > exclude).join(d, [*keys, order])
    base = around.groupBy(*keys, F.col("_c").alias(order)).agg(F.median("_dz").alias("_base"))
    j = p.join(base, [*keys, order], "left")
    ok = F.col("_base").isNull() | (F.col("height") / F.greatest(F.col("_base"), F.lit(1e-9)) >= ratio)
    return j.where(ok).drop("_base")


def filled(df: DataFrame, keys: Sequence[str], order: str, value: str, known: Column, *, name: str, size: int = BLOCK) -> DataFrame:
    """``value`` where known, the line between the nearest known rows elsewhere; flat past the ends, 0 in a series without any."""
    v, o = F.col(value).cast("double"), F.col(order)
    on = F.coalesce(known, F.lit(False)) & v.isNotNull()
    d = scan(df, keys, order, last={"_pv": F.when(on, v), "_pp": F.when(on, o)}, next={"_nv": F.when(on, v), "_np": F.when(on, o)}, size=size)
    line = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * ((o - F.col("_pp")) / (F.col("_np") - F.col("_pp")))
    return d.withColumn(name, F.when(on, v).otherwise(F.coalesce(line, "_pv", "_nv", F.lit(0.0)))).drop("_pv", "_pp", "_nv", "_np")


def thin_peaks(peaks: DataFrame, keys: Sequence[str], order: str, height: str, distance: int, *, size: int = BLOCK) -> DataFrame:
    """Peaks in descending height (ties: the later one first), without those closer than ``distance`` to a kept one.

    Rounds: a peak that leads all open ones within reach is kept, its neighbours are dropped. The
    highest open peak is always kept, so rounds end; their number is the longest rising chain of close peaks.
    """
    kept, open_ = None, cut_lineage(peaks.withColumn("_rank", F.struct(height, order)))
    reach = distance - 1
    while True:
        around = lambda w: w.rangeBetween(-reach, reach)
        d = halo(open_, keys, order, lambda w: {"_best": F.max("_rank").over(around(w))}, before=reach, after=reach, size=size)
        d = d.withColumn("_top", F.col("_best") == F.col("_rank")).drop("_best")
        d = cut_lineage(halo(d, keys, order, lambda w: {"_near": F.max("_top").over(around(w))}, before=reach, after=reach, size=size))
        won = d.where("_top").select(*peaks.columns)
        kept = won if kept is None else kept.unionByName(won)
        open_ = d.where("not _near").drop("_top", "_near")
        if open_.limit(1).count() == 0:
            return kept


def pulse_envelope(
    df: DataFrame, keys: Sequence[str], order: str, left: str, right: str, *, fps: float, band: tuple[float, float] = (200.0, 380.0), filter_order: int = 4, lowpass: float = 25.0,
    half: int = 128, size: int = BLOCK,
) -> DataFrame:
    """Adds ``env`` (larger magnitude of both wings in the band), ``env_lp`` (smoothed) and ``bp_max`` (larger deflection in the band)."""
    d = filled(df, keys, order, left, F.lit(True), name="_l", size=size)
    d = cut_lineage(filled(d, keys, order, right, F.lit(True), name="_r", size=size))
    b, a = R.butterworth(filter_order, band, fps)
    d = cut_lineage(R.zero_phase(d, keys, order, ["_l", "_r"], b, a, name=["_bl", "_br"], size=size))
    d = cut_lineage(R.envelope(d, keys, order, ["_bl", "_br"], name="env", half=half, size=size))
    d = R.zero_phase(d, keys, order, "env", *R.butterworth(filter_order, lowpass, fps), name="env_lp", size=size)
    return d.withColumn("bp_max", F.greatest(F.abs("_bl"), F.abs("_br"))).drop("_l", "_r", "_bl", "_br")


def envelope_peaks(
    df: DataFrame, keys: Sequence[str], order: str, left: str, right: str, *, fps: float, band: tuple[float, float] = (200.0, 380.0), sine_band: tuple[float, float] = (80.0, 200.0),
    floor_percentile: float = 0.5, threshold: float = 3.0, min_distance: int = 12, dedupe: int = 8, mask_half: int = 10, ratio: float = 0.5, half: int = 128, size: int = BLOCK, **shape,
) -> DataFrame:
    """Pulse candidates ``(keys, order, height)``: peaks of the smoothed envelope.

    A peak stands ``threshold`` times above the track's usual deflection in the band, is the highest
    within ``min_distance`` and within ``dedupe`` rows, and the mean envelope around it is at least ``ratio`` times that of the
    sine band. Isolation and trains follow by :func:`pulse_trains`.
    """
    df = read_once(df)
    e = cut_lineage(pulse_envelope(df, keys, order, left, right, fps=fps, band=band, half=half, size=size, **shape))
    floor = exact_quantiles(e, keys, "bp_max", {"_floor": floor_percentile})
    p = lag_lead(e.select(*keys, order, "env_lp"), keys, order, lags={"_a": "env_lp"}, leads={"_b": "env_lp"}, size=size)
    p = p.where((F.col("env_lp") > F.col("_a")) & (F.col("env_lp") > F.col("_b")))
    p = attach(p, floor, keys).where(F.col("env_lp") >= threshold * F.col("_floor")).select(*keys, order, F.col("env_lp").alias("height"))
    p = thin_peaks(p, keys, order, "height", min_distance, size=size)
    p = thin_peaks(p, keys, order, "height", 2 * (dedupe // 2) + 1, size=size)
    if ratio <= 0:
        return p
    s = pulse_envelope(df, keys, order, left, right, fps=fps, band=sine_band, half=half, size=size, **shape).select(*keys, order, F.col("env").alias("_s"))
    both = e.select(*keys, order, "env").join(s, [*keys, order])
    mean = lambda c: lambda w: F.avg(c).over(w.rowsBetween(-mask_half, mask_half))
    both = halo(both, keys, order, lambda w: {"_p": mean("env")(w), "_q": mean("_s")(w)}, before=mask_half, after=mask_half, size=size)
    ok = (F.col("_q") <= 0) | (F.col("_p") >= ratio * F.col("_q"))
    return p.join(both.where(ok).select(*keys, order), [*keys, order], "left_semi")


def sine_windows(
    df: DataFrame, keys: Sequence[str], order: str, value: str, pulse: str, *, fps: float, band: tuple[float, float] = (80.0, 200.0), filter_order: int = 4, window: int = 80, hop: int = 8,
    test_band: tuple[float, float] = (90.0, 175.0), bandwidth: float = 3.0, tapers: int = 5, p_max: float = 0.05, pulse_max: float = 0.5, floor_percentile: float = 0.25, floor_mult: float = 0.5,
    size: int = BLOCK,
) -> DataFrame:
    """Windows ``(keys, win, start, freq, f_stat, p, power, pulse_share, sine)`` tested for one steady tone.

    Pulses are bridged, the series is band-passed, and each window's line component is held against
    the rest by an F-test over orthogonal tapers, at every frequency of the test band. ``sine`` marks windows
    that pass the test, are mostly free of pulses and stronger than the quiet part of their track.
    A window that the track doesn't fill gives no row.
    """
    d = filled(df, keys, order, value, F.lit(True), name="_z0", size=size)
    d = filled(d, keys, order, "_z0", ~F.col(pulse), name="_z", size=size).select(*keys, order, F.col(pulse).cast("double").alias("_pulse"), "_z")
    d = R.zero_phase(cut_lineage(d), keys, order, "_z", *R.butterworth(filter_order, band, fps), name="_bp", size=size)
    freqs = np.fft.rfftfreq(window) * fps
    freqs = freqs[(freqs >= test_band[0]) & (freqs <= test_band[1])]
    taper = R.slepian(window, bandwidth, tapers)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(window), freqs / fps))
    gain = taper.sum(1)
    energy = float((gain**2).sum())
    def run(g: R.Rows, own: np.ndarray) -> R.Rows | None:
        at = g[order]
        first = np.flatnonzero(own & (at % hop == 0) & (np.arange(len(at)) + window <= len(at)))
        if not len(first):
            return None
        rows = first[:, None] + np.arange(window)
        x = g["_bp"][rows]
        spectra = np.stack([(x * t) @ waves for t in taper], 1)
        line = np.einsum("mkf,k->mf", spectra, gain) / energy
        rest = (np.abs(spectra - line[:, None] * gain[None, :, None]) ** 2).sum(1)
        f = np.where(rest > 0, (tapers - 1) * np.abs(line) ** 2 * energy / np.where(rest > 0, rest, 1), 0.0)
        best = f.argmax(1)
        top = f[np.arange(len(f)), best]
        p = (1 + top / (tapers - 1)) ** -(tapers - 1.0)
        return {"win": at[first] // hop, "start": at[first], "freq": freqs[best], "f_stat": top, "p": p, "power": (x**2).mean(1), "pulse_share": g["_pulse"][rows].mean(1)}

    names = ["win", "start", "freq", "f_stat", "p", "power", "pulse_share"]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keys], *[T.StructField(n, T.LongType() if n in names[:2] else T.DoubleType()) for n in names]])
    w = cut_lineage(R.block_map(d, keys, order, schema, run, after=window - 1, size=size))
    floor = exact_quantiles(w.where("power > 0"), keys, "power", {"_floor": floor_percentile})
    w = attach(w, floor, keys)
    good = (F.col("p") < p_max) & (F.col("pulse_share") <= pulse_max) & (F.col("power") >= floor_mult * F.coalesce("_floor", F.lit(0.0)))
    return w.withColumn("sine", good).drop("_floor")


def sine_segments(windows: DataFrame, keys: Sequence[str], *, window: int = 80, hop: int = 8, tolerance: float = 0.2, max_gap: int = 2, min_rows: int = 64, size: int = BLOCK) -> DataFrame:
    """Segments ``(keys, start, stop, freq, n_windows)`` of sine windows of one frequency; ``stop`` is exclusive.

    A window joins the open segment if it is within ``tolerance`` of the segment's median frequency,
    and is passed over otherwise; a segment ends once no window joined for more than ``max_gap`` windows. Windows with a longer
    pause between them can't meet, so each stretch without one is read on its own, as a stream in order:
    frequencies are bins of a spectrum, so the state is a count per bin.
    """
    w = scan(windows.where("sine").select(*keys, "win", "start", "freq"), keys, "win", before={"_p": F.col("win")}, size=size)
    w = running_sum(w, keys, "win", {"_island": F.coalesce(F.col("win") - F.col("_p") > max_gap, F.lit(True)).cast("long")}, size=size)
    by = [*keys, "_island"]
    least = max(2, min_rows // max(1, hop))

    def median(counts: dict[float, int]) -> float:
        n, seen, low = sum(counts.values()), 0, None
        for f in sorted(counts):
            seen += counts[f]
            if low is None and seen > (n - 1) // 2:
                low = f
            if seen > n // 2:
                return (low + f) / 2
        raise ValueError("no frequency")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, None  # open_: start, stop, counts, last window
        for g in batches:
            done = []

            def close() -> None:
                if open_ is not None and open_[1] - open_[0] >= min_rows and sum(open_[2].values()) >= least:
                    done.append((*key[:-1], open_[0], open_[1], median(open_[2]), sum(open_[2].values())))

            for *now, win, start, freq in g[[*by, "win", "start", "freq"]].itertuples(index=False):
                if tuple(now) != key or win - open_[3] > max_gap:
                    close()
                    key, open_ = tuple(now), [start, start + window, {freq: 1}, win]
                elif abs(freq - (middle := median(open_[2]))) <= tolerance * middle:
                    open_[1], open_[3] = start + window, win
                    open_[2][freq] = open_[2].get(freq, 0) + 1
            yield pd.DataFrame(done, columns=[*keys, "start", "stop", "freq", "n_windows"])
        if open_ is not None:
            done = []
            close()
            yield pd.DataFrame(done, columns=[*keys, "start", "stop", "freq", "n_windows"])

    fields = [windows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("freq", T.DoubleType()), T.StructField("n_windows", T.LongType())])
    return R.batches_in_order(w.select(*by, "win", "start", "freq"), by, "win", chain, schema)


def song_labels(frames: DataFrame, segments: DataFrame, keys: Sequence[str], order: str, pulse: str, *, name: str = "song", size: int = BLOCK) -> DataFrame:
    """``pulse``, ``sine`` or ``quiet`` for each frame; a pulse inside a sine segment stays a pulse."""
    edges = segments.select(*keys, F.explode(F.array(F.struct(F.col("start").alias(order), F.lit(1).alias("_e")), F.struct(F.col("stop").alias(order), F.lit(-1).alias("_e")))).alias("s"))
    edges = edges.groupBy(*keys, F.col(f"s.{order}").alias(order)).agg(F.sum("s._e").alias("_e"))
    d = running_sum(frames.join(edges, [*keys, order], "left"), keys, order, {"_in": F.col("_e")}, size=size)
    return d.withColumn(name, F.when(F.col(pulse), "pulse").when(F.col("_in") > 0, "sine").otherwise("quiet")).drop("_e", "_in")
