"""Histogram, exact quantiles and Gaussian smoothing against NumPy."""

import math

import numpy as np

from quarry.operators import stats


def test_histogram_counts_and_range(spark):
    rng = np.random.default_rng(0)
    v = rng.uniform(0, 1, 1000)
    df = spark.createDataFrame([(float(x),) for x in v], "sim double")
    h = stats.histogram(df, "sim", 50).orderBy("bin").collect()
    assert len(h) == 50 and sum(r.n for r in h) == 1000
    exp, _ = np.histogram(v, 50)
    assert sum(abs(a - b) for a, b in zip([r.n for r in h], exp)) <= 2  # edge rounding only
    fixed = stats.histogram(df, "sim", 100, 0.2, 1.0).collect()
    assert sum(r.n for r in fixed) == int(((v >= 0.2) & (v <= 1.0)).sum())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=5003)
    df = spark.createDataFrame([(float(x),) for x in v], "value double").repartition(7)
    q = stats.exact_quantiles(df, "value", [0.02, 0.5, 0.98]).first()
    for got, p in zip(q, [0.02, 0.5, 0.98]):
        assert math.isclose(got, float(np.percentile(v, p * 100)), rel_tol=1e-12, abs_tol=1e-12)


def reflect_smooth(x, sigma=2.0, truncate=4.0):
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        for k, o in enumerate(range(-r, r + 1)):
            j = i + o
            j = -j - 1 if j < 0 else (2 * n - 1 - j if j > n - 1 else j)
            out[i] += w[k] * x[j]
    return out


def test_gaussian_smooth_reflect(spark):
    x = np.array([0, 3, 1, 0, 7, 2, 2, 9, 0, 0, 1, 5], dtype=float)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "bin int, n long")
    got = [r.smoothed for r in stats.gaussian_smooth(df).orderBy("bin").collect()]
    assert np.allclose(got, np.round(reflect_smooth(x), 6), atol=1e-6)


def test_mean_std_population(spark):
    v = [0.5, 0.75, 1.0, 0.25]
    df = spark.createDataFrame([(x,) for x in v], "sim double")
    r = stats.mean_std(df, "sim").first()
    assert r.n == 4 and r.mean_sim == round(np.mean(v), 6) and r.std_sim == round(np.std(v), 6)


def test_exact_quantiles_hot_value(spark):
    v = [5.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(x,) for x in v], "value double").repartition(6)
    q = stats.exact_quantiles(df, "value", [0.1, 0.5, 0.9]).first()
    exp = [float(np.percentile(v, p)) for p in (10, 50, 90)]
    assert [round(a, 9) for a in q] == [round(b, 9) for b in exp]
