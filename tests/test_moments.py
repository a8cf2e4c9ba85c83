"""Centred moments of long frames against plain ones over each frame, beside outliers of 1e6 and more."""

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import factors
from tickloom.functions.factors import compute

BOOK = {}
for k in (60, 100, 120, 240, 600):
    BOOK |= {f"std_{k}": lambda s, k=k: s.std("x", k, 10), f"skew_{k}": lambda s, k=k: s.skew("x", k, 10), f"kurt_{k}": lambda s, k=k: s.kurt("x", k, 10), f"corr_{k}": lambda s, k=k: s.corr("x", "y", k, 10)}


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9])
def test_beside_outliers(spark, monkeypatch, size):
    monkeypatch.setattr(factors, "BLOCK_ROWS", 256)
    rng, n = np.random.default_rng(3), 2500
    x, y = rng.normal(10, 1, n), rng.normal(0, 2, n)
    x[[300, 1400]] += [size, -size]
    y[900] = size
    x[rng.integers(0, n, 60)] = np.nan
    x[1800:1960] = 4.0
    rows = pd.DataFrame({"key": "k", "day": np.arange(n) // 400, "at": np.arange(n), "x": x, "y": y})
    df = spark.createDataFrame(rows).selectExpr("key", "day", "at", "nanvl(x, NULL) AS x", "y")
    got = compute(df, BOOK, list(BOOK), ["key"], ["at"], ["day"]).toPandas().sort_values("at", ignore_index=True)
    for k in (60, 100, 120, 240, 600):
        want = {f: np.full(n, np.nan) for f in ("std", "skew", "kurt", "corr")}
        for i in range(n):
            ok = ~np.isnan(x[max(0, i - k + 1) : i + 1])
            a, b = x[max(0, i - k + 1) : i + 1][ok], y[max(0, i - k + 1) : i + 1][ok]
            m = len(a)
            if m < 10:
                continue
            if (a == a[0]).all():
                want["std"][i] = 0
                continue
            d, e = a - a.mean(), b - b.mean()
            want["std"][i] = np.sqrt((d**2).sum() / (m - 1))
            want["skew"][i] = np.sqrt(m * (m - 1)) / (m - 2) * (d**3).mean() / (d**2).mean() ** 1.5
            want["kurt"][i] = (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * ((d**4).mean() / (d**2).mean() ** 2 - 3) + 6)
            want["corr"][i] = (d * e).sum() / np.sqrt((d**2).sum() * (e**2).sum())
        for f, w in want.items():
            np.testing.assert_allclose(got[f"{f}_{k}"].astype(float).to_numpy(), w, rtol=1e-6, atol=1e-6, err_msg=f"{f}_{k}")


def test_decayed_deviation_beside_a_large_level(spark):
    """Squares less the squared mean would lose it."""
    x = 1e9 + np.random.default_rng(3).normal(size=900)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(900), "x": x}))
    got = compute(df, {"dev": lambda s: s.decayed_std("x", 30, 5)}, ["dev"], ["k"], ["i"]).toPandas().sort_values("i")["dev"].astype(float).to_numpy()
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=30, min_periods=5).std().to_numpy(), rtol=1e-4)
