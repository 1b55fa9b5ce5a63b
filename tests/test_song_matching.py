"""Recursive filters, song, matching, lifting and episode peaks against plain loops, with small blocks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows as collected
from strideframe.operators import gait, lifting, matching, motion, recursive, song


def rows(df, *cols):
    return sorted(collected(df, *cols))


def series(spark, tracks, name="v"):
    return spark.createDataFrame([(k, i, float(x)) for k, xs in tracks.items() for i, x in enumerate(xs)], f"k long, f long, {name} double").repartition(3)


def run_filter(b, a, u, x):
    """Transposed direct form, row by row."""
    out = []
    for v in u:
        y = b[0] * v + x[0]
        x = [(x[i + 1] if i + 1 < len(x) else 0.0) + b[i + 1] * v - a[i + 1] * y for i in range(len(x))]
        out.append(y)
    return out


def forward_backward(b, a, v):
    a, b = np.asarray(a) / a[0], np.asarray(b) / a[0]
    rest = recursive.Kernel.of(b, a).rest()
    n = min(3 * max(len(a), len(b)), len(v) - 1)
    u = [2 * v[0] - v[i] for i in range(n, 0, -1)] + list(v) + [2 * v[-1] - v[-1 - i] for i in range(1, n + 1)]
    y = run_filter(b, a, u, list(rest * u[0]))[::-1]
    y = run_filter(b, a, y, list(rest * y[0]))[::-1]
    return y[n : n + len(v)]


def test_known_coefficients():
    b, a = recursive.butterworth(2, 0.5, 2.0)
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322]) and np.allclose(a, [1, 0, 0.17157288])
    b, a = recursive.butterworth(4, (200.0, 380.0), 800.0)
    assert len(a) == 9
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 800)) / np.polyval(a, np.exp(2j * np.pi * f / 800)))
    assert math.isclose(gain(200), 1 / math.sqrt(2), rel_tol=1e-6) and math.isclose(gain(380), 1 / math.sqrt(2), rel_tol=1e-6) and gain(20) < 1e-3


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_zero_phase_by_loop(spark, size, monkeypatch):
    monkeypatch.setattr(recursive, "GROUP", 3)
    rng = np.random.default_rng(size)
    data = {k: rng.normal(size=n).cumsum() for k, n in ((1, 1), (2, 2), (3, 40), (4, 333))}
    for b, a in (recursive.butterworth(4, (80.0, 200.0), 800.0), recursive.butterworth(3, 25.0, 800.0)):
        d = recursive.zero_phase(series(spark, data), ["k"], "f", "v", b, a, name="y", size=size)
        for k, v in data.items():
            got = [r.y for r in d.where(F.col("k") == k).orderBy("f").collect()]
            assert np.allclose(got, forward_backward(b, a, v), atol=1e-7)


def test_envelope_of_a_tone(spark):
    t = np.arange(900)
    d = series(spark, {1: 3 * np.sin(2 * np.pi * 250 / 800 * t), 2: 0 * t})
    e = recursive.envelope(d, ["k"], "f", ["v"], name="e", size=100)
    middle = e.where("k = 1 and f between 200 and 700").agg(F.min("e"), F.max("e")).first()
    assert abs(middle[0] - 3) < 0.01 and abs(middle[1] - 3) < 0.01
    assert e.where("k = 2").agg(F.max("e")).first()[0] == 0


def test_tapers_are_orthonormal_and_concentrated():
    t = recursive.slepian(80, 3.0, 5)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-9)
    power = np.abs(np.fft.fft(t, 8000, axis=1)) ** 2
    near = np.minimum(np.arange(8000), 8000 - np.arange(8000)) <= 3.0 / 80 * 8000
    assert (power[:, near].sum(1) / power.sum(1) > [0.9999, 0.9999, 0.999, 0.99, 0.94]).all()


def test_peaks_are_thinned_like_a_sorted_loop(spark):
    rng = random.Random(2)
    data = [(k, f, float(rng.randrange(6))) for k in (1, 2) for f in sorted(rng.sample(range(300), 90))]
    for distance in (2, 7, 30):
        want = []
        for k in (1, 2):
            kept = []
            for _, f in sorted(((h, f) for q, f, h in data if q == k), reverse=True):
                if all(abs(f - x) >= distance for x in kept):
                    kept.append(f)
            want += [(k, f) for f in kept]
        got = song.thin_peaks(spark.createDataFrame(data, "k long, f long, h double"), ["k"], "f", "h", distance, size=16)
        assert rows(got, "k", "f") == sorted(want)


def chained(windows, window, hop, tolerance, gap, least):
    out, seg = [], None
    for w, f in windows:
        if seg and w - seg[3] > gap:
            out.append(seg)
            seg = None
        if seg is None:
            seg = [w * hop, w * hop + window, [f], w]
        elif abs(f - np.median(seg[2])) <= tolerance * np.median(seg[2]):
            seg[1], seg[3] = w * hop + window, w
            seg[2].append(f)
    out += [seg] if seg else []
    return [(a, b, float(np.median(fs)), len(fs)) for a, b, fs, _ in out if b - a >= least and len(fs) >= max(2, least // hop)]


def test_segments_by_loop(spark):
    rng = random.Random(4)
    data = {k: [(w, rng.choice([100.0, 110.0, 120.0, 160.0])) for w in range(400) if rng.random() < 0.7] for k in (1, 2, 3)}
    df = spark.createDataFrame([(k, w, w * 8, f, True) for k, ws in data.items() for w, f in ws], "k long, win long, start long, freq double, sine boolean").repartition(3)
    want = sorted((k, *s) for k, ws in data.items() for s in chained(ws, 80, 8, 0.2, 2, 64))
    assert rows(song.sine_segments(df, ["k"], size=32), "k", "start", "stop", "freq", "n_windows") == want and len(want) > 10
    assert song.sine_segments(df.limit(0), ["k"]).collect() == []


def test_a_planted_tone_is_found_and_labelled(spark):
    rng = np.random.default_rng(0)
    t = np.arange(1600)
    v = rng.normal(scale=0.3, size=1600) + np.where((t >= 600) & (t < 1000), 4 * np.sin(2 * np.pi * 130 / 800 * t), 0)
    d = series(spark, {1: v, 2: rng.normal(scale=0.3, size=1600)}).withColumn("p", F.col("f").between(700, 720) & (F.col("k") == 1))
    w = song.sine_windows(d, ["k"], "f", "v", "p", fps=800.0, p_max=0.001, size=128)
    s = song.sine_segments(w, ["k"], size=128)
    tone = [r for r in s.collect() if r.k == 1 and abs(r.freq - 130) <= 10]
    assert min(r.start for r in tone) < 760 and max(r.stop for r in tone) > 960
    labels = {(r.k, r.f): r.song for r in song.song_labels(d, s, ["k"], "f", "p", size=128).collect()}
    assert labels[1, 710] == "pulse" and labels[1, 800] == "sine" and len(labels) == 3200


def serial(treated, reference, caliper):
    supply = {t: sum(t[1] - caliper <= r[1] <= t[1] + caliper for r in reference) for t in treated}
    used, out = set(), []
    for t in sorted(treated, key=lambda t: (supply[t], t[1], t[0])):
        free = [r for r in reference if r not in used and t[1] - caliper <= r[1] <= t[1] + caliper]
        if free:
            r = min(free, key=lambda r: (abs(r[1] - t[1]), r[1], r[0]))
            used.add(r)
            out.append((t[0], r[0]))
    return out


@pytest.mark.parametrize(("seed", "step"), [(1, 1), (2, 5), (3, 0)])
def test_caliper_match_is_the_serial_one(spark, seed, step, monkeypatch):
    monkeypatch.setattr(matching, "LOOK", 4)
    rng = random.Random(seed)
    value = lambda: float(rng.randrange(0, 34) // step * step) if step else round(rng.random() * 22, 6)
    t = [(g, i, value()) for g in (1, 2) for i in range(22)]
    r = [(g, i, value()) for g in (1, 2) for i in range(500, 500 + 26)]
    df = lambda x: spark.createDataFrame([*x, (1, 10_000 + len(x), None)], "g long, id long, v double").repartition(3)
    rounds = []
    got = matching.caliper_match(df(t), df(r), "v", "id", caliper=3.0, keys=["g"], rounds=rounds)
    want = sorted((g, a, b) for g in (1, 2) for a, b in serial([x[1:] for x in t if x[0] == g], [x[1:] for x in r if x[0] == g], 3.0))
    assert rows(got, "g", "treated", "reference") == want and rounds[0] > 1


def test_scarce_references_take_few_rounds(spark):
    rng = random.Random(9)
    t, r = ([(i + at, round(rng.random() * 100, 6)) for i in range(n)] for n, at in ((400, 0), (90, 1000)))
    df = lambda x: spark.createDataFrame(x, "id long, v double")
    rounds = []
    got = matching.caliper_match(df(t), df(r), "v", "id", caliper=30.0, rounds=rounds)
    assert rows(got, "treated", "reference") == sorted(serial(t, r, 30.0)) and rounds[0] <= 3


def test_one_value_for_all_and_nothing_in_reach(spark):
    df = lambda n, v, at=0: spark.createDataFrame([(at + i, v) for i in range(n)], "id long, v double")
    got = matching.caliper_match(df(300, 1.0), df(200, 1.0, 1000), "v", "id", caliper=0.5)
    assert rows(got, "treated", "reference") == [(i, 1000 + i) for i in range(200)]
    assert matching.caliper_match(df(5, 1.0), df(5, 9.0), "v", "id", caliper=0.5).collect() == []
    assert matching.caliper_match(df(5, 1.0).limit(0), df(5, 9.0), "v", "id", caliper=0.5).collect() == []


CAMS = {"a": [100, 0, 20, 320, 0, 100, 10, 240, 0.0, 0.0, 0.03], "b": [80, 30, 0, 300, 0, 90, 40, 250, 0.03, 0.0, 0.0], "c": [0, 100, 30, 310, 90, 0, 20, 230, 0.0, 0.03, 0.0], "d": [60, -60, 10, 330, 20, 50, 80, 245, 0.02, 0.02, 0.0]}


def test_planted_animals_are_lifted(spark):
    rng = random.Random(8)
    peaks, want = [], []
    for f in range(20):
        animals = [tuple(rng.uniform(-3, 3) for _ in range(3)) for _ in range(2)]
        for cam, c in CAMS.items():
            for slot, (x, y, z) in enumerate(animals if rng.random() < 0.5 else animals[::-1]):
                depth = c[8] * x + c[9] * y + c[10] * z + 1
                u, v = (c[0] * x + c[1] * y + c[2] * z + c[3]) / depth, (c[4] * x + c[5] * y + c[6] * z + c[7]) / depth
                peaks.append((f, cam, slot, None if f == 3 and cam == "a" else u, v, rng.random()))
        want.append(animals)
    df = spark.createDataFrame(peaks, "f long, camera string, slot int, u double, v double, score double")
    coeffs = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in CAMS.items()], "camera string, c array<double>")
    got = lifting.lift_centres(df, coeffs, ["f"], reach=1.0).collect()
    assert len(got) == 40 and all(r.n_views == (3 if r.f == 3 else 4) for r in got)
    for f, animals in enumerate(want):
        found = [(r.x, r.y, r.z) for r in got if r.f == f]
        assert all(min(math.dist(a, p) for p in found) < 1e-6 for a in animals)
    assert lifting.lift_centres(df.where("camera < 'c'"), coeffs, ["f"], reach=1.0).collect() == []


def merged(points, least):
    pts = [(*p, 1) for p in sorted(points)]
    while True:
        near = [(math.dist(a[:3], b[:3]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(pts), 2)]
        near = min((x for x in near if x[0] < least), default=None)
        if near is None:
            return sorted(pts)
        a, b = pts[near[1]], pts[near[2]]
        pts = [p for k, p in enumerate(pts) if k not in near[1:]] + [(*((x + y) / 2 for x, y in zip(a[:3], b[:3], strict=True)), a[3] + b[3])]


def test_near_centres_are_merged(spark):
    rng = random.Random(3)
    data = [(f, *(rng.uniform(0, 30) for _ in range(3))) for f in range(15) for _ in range(rng.randrange(1, 6))]
    got = lifting.merge_centres(spark.createDataFrame(data, "f long, x double, y double, z double"), ["f"], least=15.0).collect()
    for f in range(15):
        want = merged([d[1:] for d in data if d[0] == f], 15.0)
        assert np.allclose(sorted((r.x, r.y, r.z, r.n_merged) for r in got if r.f == f), want)


def test_chains_of_windows_are_one(spark):
    line = [(0, i, 20.0 * i, 0.0, 0.0, "detection" if i else "reused") for i in range(6)] + [(0, 9, 500.0, 0.0, 0.0, "track"), (1, 1, 0.0, 0.0, 0.0, "detection")]
    got = lifting.merge_windows(spark.createDataFrame(line, "f long, id long, x double, y double, z double, source string"), ["f"], "id", radius=20.0)
    assert rows(got, "f", "window", "x", "source", "members") == [(0, 0, 50.0, "reused", [0, 1, 2, 3, 4, 5]), (0, 1, 500.0, "track", [9]), (1, 0, 0.0, "detection", [1])]


def n_prominent(v, least):
    n = 0
    for i in range(1, len(v) - 1):
        if not (v[i] > v[i - 1] and v[i] >= v[i + 1]):
            continue
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if j == len(v) - 1 or v[j + 1] > v[i]:
            continue
        left = next((k for k in range(i - 1, -1, -1) if v[k] > v[i]), -1)
        right = next((k for k in range(j + 1, len(v)) if v[k] > v[i]), len(v))
        n += v[i] - max(min(v[left + 1 : i + 1]), min(v[i:right])) >= least
    return n


@pytest.mark.parametrize("size", [3, 8, 1000])
def test_episode_peaks_are_those_of_sufficient_prominence(spark, size):
    rng = np.random.default_rng(size)
    data = [(k, f, bool((f // 37 + k) % 2), None if rng.random() < 0.05 else float(x)) for k in range(6) for f, x in enumerate(rng.normal(size=150).cumsum())]
    got = gait.episode_peaks(spark.createDataFrame(data, "k long, f long, s boolean, z double").repartition(3), ["k"], "f", "s", "z", fraction=0.25, floor=0.1, size=size)
    want = []
    for k in range(6):
        for s, run in itertools.groupby((d for d in data if d[0] == k), key=lambda d: d[2]):
            run = list(run)
            z = [d[3] for d in run]
            low, high = min(x for x in z if x is not None), max(x for x in z if x is not None)
            z = [low if x is None else x for x in z]
            n = n_prominent(z, max(0.25 * (high - low), 0.1))
            want.append((k, run[0][1], run[-1][1], "stance" if s else "swing", n, not s and n >= 2))
    assert rows(got, "k", "start", "end", "kind", "n_peaks", "double_peak") == sorted(want)


def test_votes_abstain_and_sources_contradict(spark):
    reads = [(1, 0, "a", 0.9), (1, 1, "a", 0.2), (1, 0, "b", 0.52), (1, 1, "b", 0.49), (2, 0, "a", 0.5), (2, 1, "a", None), (3, 0, "a", 0.2), (3, 1, "a", 0.3)]
    v = {r.b: r for r in motion.sex_vote(spark.createDataFrame(reads, "b long, fly int, s string, p double"), ["b"], "fly", "p", "s").collect()}
    assert (v[1].male, v[1].confidence, v[1].n_sources, v[1].agree) == (1, "high", 1, 1.0)
    assert (v[2].male, v[2].confidence, v[2].n_sources, v[2].agree) == (None, "low", 0, None)
    assert (v[3].male, v[3].confidence) == (0, "low")
    said = [(1, "human", 0), (1, "auto", 0), (2, "human", 1), (2, "auto", 0), (3, "auto", None), (3, "other", 0)]
    got = motion.resolve_male(spark.createDataFrame(said, "b long, s string, slot int"), ["b"], "s", "slot", order=["human", "auto"])
    assert collected(got, "b", "male", "female", "authority", "conflict") == [(1, 0, 1, "human", False), (2, None, None, "human", True), (3, 1, 0, None, False)]


def test_filter_takes_many_groups_at_once():
    """Outputs and last states of groups of unequal lengths, against the recursion row by row."""
    k = recursive.Kernel.of(*recursive.butterworth(2, (200.0, 380.0), 800.0))
    rng = np.random.default_rng(3)
    lengths = np.array([1, 0, 63, 64, 65, 200, 2])
    stops = np.cumsum(lengths)
    starts, u, x0 = stops - lengths, rng.normal(size=stops[-1]), rng.normal(size=(len(lengths), k.order))

    def plain(a, b, x):
        y = []
        for v in u[a:b]:
            y.append(x[0] + k.d * v)
            x = k.A @ x + k.b * v
        return y, x

    after, y = k.states_after(u, starts, stops), k.outputs(u, starts, stops, x0)
    for g, (a, b) in enumerate(zip(starts, stops, strict=True)):
        np.testing.assert_allclose(after[g], plain(a, b, np.zeros(k.order))[1], atol=1e-9)
        np.testing.assert_allclose(y[a:b], plain(a, b, x0[g])[0], atol=1e-9)


def test_zero_phase_reads_its_rows_twice(spark, monkeypatch):
    """Once for the rows, once for the ends of their blocks: of a chain's second filter, too, whose input is a join."""
    cut, plans = recursive.cut_lineage, []
    monkeypatch.setattr(recursive, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().analyzed()) or cut(d))
    b, a = recursive.butterworth(2, 60.0, 800.0)
    rng = np.random.default_rng(5)
    data = {k: rng.normal(size=n) for k, n in ((1, 30), (2, 5))}
    first = recursive.zero_phase(series(spark, data), ["k"], "f", "v", b, a, name="y", size=8)
    n = len(plans)
    second = recursive.zero_phase(first, ["k"], "f", "y", b, a, name="z", size=8)
    assert [plans[i].collectLeaves().size() for i in (0, n)] == [2, 2]
    for k, v in data.items():
        got = [r.z for r in second.where(F.col("k") == k).orderBy("f").collect()]
        assert np.allclose(got, forward_backward(b, a, forward_backward(b, a, v)), atol=1e-7)


@pytest.mark.parametrize("size", [7, 1000])
def test_several_series_pass_in_one_go(spark, size, monkeypatch):
    monkeypatch.setattr(recursive, "GROUP", 3)
    b, a = recursive.butterworth(2, (200.0, 380.0), 800.0)
    rng = np.random.default_rng(size)
    data = {k: rng.normal(size=(n, 2)).cumsum(0) for k, n in ((1, 1), (2, 90), (3, 4))}
    d = spark.createDataFrame([(k, i, *map(float, x)) for k, v in data.items() for i, x in enumerate(v)], "k long, f long, v double, w double")
    d = recursive.zero_phase(d, ["k"], "f", ["v", "w"], b, a, name=["y", "z"], size=size)
    assert d.columns == ["k", "f", "v", "w", "y", "z"]
    for k, v in data.items():
        got = np.array([(r.y, r.z) for r in d.where(F.col("k") == k).orderBy("f").collect()])
        for i in range(2):
            np.testing.assert_allclose(got[:, i], forward_backward(b, a, v[:, i]), atol=1e-7)
