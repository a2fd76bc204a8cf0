"""Exact distance correlation against its definition, with buckets down to a few rows, ties and hot values."""

import numpy as np
import pytest

from spanframe.operators.distance_corr import distance_correlation, pair_sum


def plain(x, y):
    a, b = abs(x[:, None] - x), abs(y[:, None] - y)
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    va, vb = (a * a).mean(), (b * b).mean()
    return np.sqrt(max(0.0, (a * b).mean() / np.sqrt(va * vb))) if va > 0 and vb > 0 else 0.0


def test_pair_sum():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 128, 200):
        x, y = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
        assert pair_sum(x, y) == pytest.approx((abs(x[:, None] - x) * abs(y[:, None] - y)).sum() / 2, abs=1e-8)


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "hot both", "same", "line", "flat"])
@pytest.mark.parametrize("bucket", [1 << 16, 40, 7])
def test_equals_the_definition(spark, kind, bucket):
    rng = np.random.default_rng(5)
    n = 260
    x, y = rng.normal(size=n) * 1e3 + 5e4, rng.normal(size=n)
    if kind == "ties":
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 5, n).astype(float)
    if kind.startswith("hot"):
        x[: n // 3] = 5.0
    if kind == "hot both":
        y[n // 4 : n // 2] = 0.25
    if kind == "same":
        y = x.copy()
    if kind == "line":
        y = -3 * x + x**2 / 1e3
    if kind == "flat":
        y[:] = 2.0
    df = spark.createDataFrame([(float(a), float(b), "clash") for a, b in zip(x, y)] + [(None, 1.0, None), (1.0, None, None), (float("nan"), 1.0, None)], "p double, q double, x string").repartition(3)
    row = distance_correlation(df, "p", "q", bucket).first()
    assert row["n"] == n and row["dcor"] == pytest.approx(plain(x, y), abs=1e-8)


def test_small_tables(spark):
    df = spark.createDataFrame([], "p double, q double")
    assert tuple(distance_correlation(df, "p", "q").first()) == ("p", "q", 0, None)
    one = spark.createDataFrame([(1.0, 2.0)], "p double, q double")
    assert distance_correlation(one, "p", "q").first()["dcor"] == 0.0
