"""Block primitives against pandas, for block sizes that cut the tracks and for shuffled input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import runs as R
from strideframe.operators import series as S
from strideframe.operators.ordered import number_rows, run_length, scan
from strideframe.operators.quantiles import attach, exact_quantiles, median_and_mad


def signal(seed=0, sizes=(1, 2, 3, 40, 57)):
    rng = np.random.default_rng(seed)
    parts = []
    for k, n in enumerate(sizes):
        v = np.round(rng.normal(size=n), 3)
        x = np.where(rng.random(n) < 0.4, np.nan, v)
        parts.append(pd.DataFrame({"k": k, "f": np.arange(n), "v": v, "x": x, "on": rng.random(n) < 0.5}))
    return pd.concat(parts, ignore_index=True)


def load(spark, pdf, parts=3):
    d = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(parts)
    return d.withColumn("x", F.when(~F.isnan("x"), F.col("x"))) if "x" in pdf else d


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_scan_matches_pandas(spark, size):
    pdf = signal()
    d = scan(
        load(spark, pdf), ["k"], "f", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, max_before={"mb": F.col("v")}, last={"l": F.col("x")}, next={"n": F.col("x")},
        before={"b": F.col("x")}, after={"a": F.col("x")}, bounds=("lo", "hi"), size=size,
    )
    got = d.toPandas().sort_values(["k", "f"]).reset_index(drop=True)
    g = pdf.groupby("k")
    want = pd.DataFrame({
        "s": g.v.cumsum(), "m": g.v.cummax(), "mb": g.v.transform(lambda c: c.cummax().shift()), "l": g.x.ffill(), "n": g.x.bfill(),
        "b": g.x.transform(lambda c: c.ffill().shift()), "a": g.x.transform(lambda c: c.bfill().shift(-1)), "lo": g.f.transform("min"), "hi": g.f.transform("max"),
    })
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_scan_ahead_builds_no_frame_anew(spark):
    """A frame to the end of a partition costs the square of a block; the scans ahead run in descending order instead."""
    n = 5000
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("f"), F.when(F.col("id") % 700 == 0, F.col("id")).alias("x"))
    out = scan(d, ["k"], "f", next={"n": F.col("x")}, after={"a": F.col("x")}, size=2000)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    up = lambda f: -(-f // 700) * 700 if f <= 4900 else None
    assert sorted((r.f, r.n, r.a) for r in out.collect()) == [(f, up(f), up(f + 1)) for f in range(n)]


def test_number_rows_is_dense_for_any_block(spark):
    pdf = signal(3)
    for block in (F.lit(0), F.floor(F.col("f") / 4), F.col("f")):
        d = number_rows(load(spark, pdf), ["k"], ["f"], block, name="i")
        assert d.where(F.col("i") != F.col("f")).count() == 0 and d.count() == len(pdf)


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_run_length(spark, size):
    pdf = signal(5)
    got = run_length(load(spark, pdf), ["k"], "f", "on", name="n", first_run="first", size=size).toPandas().sort_values(["k", "f"])
    run = (pdf.on != pdf.groupby("k").on.shift()).groupby(pdf.k).cumsum()
    want = pdf.groupby(["k", run]).on.transform("size")
    assert (got.n.to_numpy() == want.to_numpy()).all()
    assert (got["first"].to_numpy() == (run == 1).to_numpy()).all()


def passes(on, min_run):
    """Left to right: a short run repeats the value before it, the first run excepted."""
    out, i = list(on), 0
    while i < len(on):
        j = i
        while j < len(on) and on[j] == on[i]:
            j += 1
        if j - i < min_run and i:
            out[i:j] = [out[i - 1]] * (j - i)
        i = j
    return out


@pytest.mark.parametrize("min_run", [2, 3, 5])
def test_absorb_short_runs(spark, min_run):
    pdf = signal(7)
    got = R.absorb_short_runs(load(spark, pdf), ["k"], "f", "on", min_run, name="z", size=4).toPandas().sort_values(["k", "f"])
    want = np.concatenate([passes(list(g.on), min_run) for _, g in pdf.groupby("k")])
    assert (got.z.to_numpy() == want).all()


def test_merge_short_segments_head_takes_right_label(spark):
    labels = "aabbbbcdddd"
    pdf = pd.DataFrame({"k": 0, "f": range(len(labels)), "l": list(labels)})
    got = R.merge_short_segments(spark.createDataFrame(pdf), ["k"], "f", "l", 3, name="m", size=3).toPandas().sort_values("f")
    assert "".join(got.m) == "bbbbbbbdddd"


def test_bridge_and_drop(spark):
    mask = [1, 0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 0, 0]
    pdf = pd.DataFrame({"k": 0, "f": range(len(mask)), "on": [bool(m) for m in mask]})
    got = R.bridge_and_drop(spark.createDataFrame(pdf), ["k"], "f", "on", max_gap=1, min_len=5, name="z", size=3).toPandas().sort_values("f")
    assert [int(z) for z in got.z] == [0] * 7 + [1] * 5 + [0, 0]


@pytest.mark.parametrize("window,overlap", [(4, 0), (4, 2), (5, 4), (1, 0)])
def test_run_windows_own_every_frame_once(spark, window, overlap):
    pdf = signal(11)
    w = R.run_windows(load(spark, pdf), ["k"], "f", "on", window, overlap, size=5).toPandas()
    owned = {(k, f) for k, a, b in zip(w.k, w.own_start, w.own_end) for f in range(a, b + 1)}
    assert sum(w.own_end - w.own_start + 1) == len(owned) == int(pdf.on.sum())
    assert (w.win_end - w.win_start + 1 <= window).all()
    assert ((w.own_start >= w.win_start) & (w.own_end <= w.win_end)).all()


def test_bridged_runs_do_not_depend_on_blocks_or_order(spark):
    pdf = signal(13, (200, 31))
    ref = None
    for size, parts in ((1000, 1), (3, 5), (17, 2)):
        got = sorted(map(tuple, R.bridged_runs(load(spark, pdf, parts), ["k"], "f", "on", size=size).select("k", "bout", "start_frame", "end_frame").collect()))
        ref = ref or got
        assert got == ref


def test_gaussian_smooth_reflects_and_skips_missing(spark):
    pdf = signal(17, (3, 9, 30))
    got = S.gaussian_smooth(load(spark, pdf), ["k"], "f", {"y": "x"}, 1.0, size=4).toPandas().sort_values(["k", "f"])
    taps = np.array(S.gaussian_taps(1.0))
    want = []
    for _, g in pdf.groupby("k"):
        x, n = g.x.to_numpy(), len(g)
        idx = np.arange(-4, n + 4) % (2 * n)
        idx = np.where(idx < n, idx, 2 * n - 1 - idx)
        v, m = np.nan_to_num(x)[idx], (~np.isnan(x)).astype(float)[idx]
        num, den = np.convolve(v, taps, "valid"), np.convolve(m, taps, "valid")
        want.append(np.where(np.isnan(x), np.nan, num / np.where(den > 0, den, 1)))
    np.testing.assert_allclose(got.y.astype(float), np.concatenate(want), atol=1e-12)


@pytest.mark.parametrize("per_range", [3, 40, 10**6])
def test_quantiles_exact_under_skew_and_ties(spark, per_range):
    rng = np.random.default_rng(2)
    hot = pd.DataFrame({"k": "hot", "v": rng.choice([1.0, 1.0, 1.0, 5.0, 7.25], 900)})
    rest = pd.DataFrame({"k": rng.choice(list("abcde"), 300), "v": rng.lognormal(0, 4, 300)})
    pdf = pd.concat([hot, rest, pd.DataFrame({"k": ["a"], "v": [np.nan]})], ignore_index=True)
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"q0": 0.0, "q3": 0.3, "q5": 0.5, "q97": 0.97, "q1": 1.0}, n="n", rows=per_range).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        want = np.percentile(g.v, [0, 30, 50, 97, 100])
        np.testing.assert_allclose(got.loc[k, ["q0", "q3", "q5", "q97", "q1"]].astype(float), want, rtol=1e-12)
        assert got.loc[k, "n"] == len(g)


def test_median_and_mad(spark):
    pdf = signal(19)
    got = median_and_mad(load(spark, pdf), ["k"], "v").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        m = np.median(g.v)
        np.testing.assert_allclose(got.loc[k, ["med", "mad"]].astype(float), [m, np.median(np.abs(g.v - m))], atol=1e-12)


def test_attach_keeps_every_row(spark):
    pdf = signal(23)
    d = attach(load(spark, pdf), spark.createDataFrame([(3, "x"), (4, "y")], "k long, s string"), ["k"])
    assert d.count() == len(pdf) and d.where(F.col("s").isNotNull()).count() == 97


def test_groups_that_fit_a_task_need_no_sketch(spark, monkeypatch):
    """Many small groups in a table of more rows than a range holds are ranked whole."""
    from strideframe.operators import quantiles

    d = spark.range(600).select((F.col("id") % 20).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    pdf = d.toPandas()

    def refuse(*a, **kw):
        raise AssertionError("split points asked for")

    monkeypatch.setattr(quantiles, "value_range", refuse)
    got = {r.k: (r.q, r.n) for r in exact_quantiles(d, ["k"], "v", {"q": 0.3}, n="n", rows=50).collect()}
    assert got.keys() == set(pdf.k)
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got[k], (np.quantile(g.v, 0.3), len(g)))
    with pytest.raises(AssertionError):
        exact_quantiles(d, ["k"], "v", {"q": 0.3}, rows=5)


@pytest.mark.parametrize(("keys", "broadcast"), [(3000, False), (100, True)])
def test_attach_counts_the_copies_of_statistics(spark, keys, broadcast):
    """72 KB of statistics make 2.3 MB of copies, which a limit of 1 MB must keep from the driver."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        d = spark.range(keys * 20).select((F.col("id") % keys).alias("k"), "id")
        j = attach(d, d.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
        assert {r.n for r in j.collect()} == {20} and j.count() == keys * 20
        final = j._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert ("BroadcastHashJoin" in final) == broadcast, final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
