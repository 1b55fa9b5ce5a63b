"""Series kernels on signals with known answers."""

import numpy as np

from strideframe.operators import kernels as N


def test_analytic_signal_of_a_cosine():
    for n in (64, 75):
        t = 2 * np.pi * 5 * np.arange(n) / n
        np.testing.assert_allclose(N.analytic(np.cos(t)), np.exp(1j * t), atol=1e-12)


def test_maxima_plateaus_and_borders():
    v = np.array([3.0, 1, 2, 2, 2, 0, 1, 4, 4])
    assert N.local_maxima(v).tolist() == [3]


def test_thinning_keeps_the_highest():
    p = np.array([1, 3, 6, 8])
    assert N.thin(p, np.array([1.0, 5.0, 4.0, 6.0]), 3).tolist() == [3, 8]


def test_prominence_stops_at_higher_samples():
    v = np.array([0.0, 2, 1, 5, 0.5, 3, 2, 2.5, 0])
    p = N.local_maxima(v)
    assert p.tolist() == [1, 3, 5, 7]
    np.testing.assert_allclose(N.prominences(v, p), [1.0, 5.0, 2.5, 0.5])


def test_phase_of_a_strided_foot(spark):
    n = 160
    x = np.cumsum(1 + np.cos(2 * np.pi * np.arange(n) / 20))
    d = spark.createDataFrame([("a", i, float(v), 0.0) for i, v in enumerate(x)] + [("b", i, float(i), 0.0) for i in range(5)], "k string, f long, x double, y double")
    got = N.analytic_phase(d, ["k"], "f", ["x", "y"], fps=1.0, sigma=1.0).toPandas().sort_values(["k", "f"])
    a = got[got.k == "a"].phase.to_numpy(float)
    assert np.isnan(a[:2]).all() and np.isnan(a[-2:]).all() and got[got.k == "b"].phase.isna().all()
    turns = np.unwrap(a[20:140])
    assert abs((turns[-1] - turns[0]) / (2 * np.pi) - 119 / 20) < 0.1
