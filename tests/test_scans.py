"""Scans of affine maps against plain loops, over blocks of every depth."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom.operators import recursive, scans
from tickloom.plans import scan_queries


@pytest.mark.parametrize("size", [2, 3, 7, 64])
def test_any_maps(spark, size):
    rng, rows = np.random.default_rng(size), []
    for key, n in (("a", 1), ("b", 130), (None, 41), ("c", 64)):
        a = rng.choice([0.0, 0.5, -1.0, 0.9], n)
        b = rng.normal(size=n)
        b[(rng.random(n) < 0.1) & (a == 0)] = np.nan
        rows += [(key, i, float(a[i]), None if np.isnan(b[i]) else float(b[i]), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i long, a double, b double, y0 string").repartition(5)
    got = {(r.key, r.i): (r.one, r.two, r.y0) for r in scans.affine_scan(df, ["key"], "i", {"one": ("a", "b"), "two": ("CASE WHEN i = 0 THEN 0 ELSE 1 END", "1")}, size).collect()}
    assert len(got) == len(rows)
    state = {}
    for key, i, a, b, _ in rows:
        before = state.get(key)
        state[key] = b if a == 0 else None if before is None or b is None else a * before + b
        one, two, kept = got[key, i]
        assert (one is None) == (state[key] is None) and (one is None or one == pytest.approx(state[key], abs=1e-9))
        assert two == i + 1 and kept == "x"


def test_empty(spark):
    df = spark.createDataFrame([], "key string, i long, x double")
    assert scans.affine_scan(df, ["key"], "i", {"y": ("1", "x")}).count() == 0


def test_indicators(spark):
    """Against step-by-step loops, with unknown prices and flat stretches; states go on over days."""
    rng, frames = np.random.default_rng(5), []
    for c in ("a", "b", "short"):
        n = 6 if c == "short" else 300
        price = 100 + np.cumsum(rng.integers(-2, 3, n)).astype(float)
        price[40:70] = price[min(40, n - 1)]
        frames.append(pd.DataFrame({"contract": c, "trade_day": np.arange(n) // 90, "ts": np.arange(n), "row_at": np.arange(n), "price": price, "high": price + rng.integers(0, 2, n), "low": price - rng.integers(0, 2, n)}))
    df = spark.createDataFrame(pd.concat(frames)).repartition(3)
    keys, order = ["contract"], ["ts"]
    made = {
        "macd": scans.macd(df, keys, order, "price", {"macd": (12, 26)}), "rsi": scans.rsi(df, keys, order, "price", {"rsi": 14, "rsi_short": 7}), "kdj": scans.kdj(df, keys, order, "high", "low", "price"),
        "rma": scans.rma(df, keys, order, "price", 10), "ewm": scans.weighted_moments(df, keys, order, "price", 2 / 11),
    }
    for name, t in made.items():
        got = t.toPandas().sort_values(["contract", "row_at"], ignore_index=True)
        assert len(got) == sum(map(len, frames)), name
        for f in frames:
            g, x = got[got.contract == f.contract[0]], f.price.to_numpy()
            same = lambda column, want, g=g: np.testing.assert_allclose(g[column].astype(float).to_numpy(), want, rtol=1e-8, atol=1e-8)
            if name == "macd":
                for column, want in zip(("macd", "macd_signal", "macd_histogram"), recursive.macd(x), strict=True):
                    same(column, want)
            elif name == "rsi":
                for column, k in (("rsi", 14), ("rsi_short", 7)):
                    want = recursive.rsi(x, k)
                    want[: k - 1] = np.nan
                    same(column, want)
            elif name == "kdj":
                same("kdj", recursive.kdj(f.high.to_numpy(), f.low.to_numpy(), x))
            elif name == "rma":
                same("rma", recursive.rma(x, 10))
            else:
                same("ewm_mean", recursive.ewm_mean(x, 2 / 11))
                same("ewm_std", recursive.ewm_std(x, 10))
                same("ewm_skew", recursive.ewm_skew(x, 10))


@pytest.mark.parametrize("name", scan_queries.QUERIES)
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    df = scan_queries.QUERIES[name](spark, sf)
    assert "InPandas" not in df._jdf.queryExecution().toString()
    got = df.toPandas().sort_values("event_id", ignore_index=True)
    want = c.sql(scan_queries.ORACLE[name]).df().sort_values("event_id", ignore_index=True)
    assert len(got) and set(got.columns) == set(want.columns)
    for col in got.columns:
        np.testing.assert_allclose(got[col].astype(float), want[col].astype(float), atol=1e-5, rtol=0, err_msg=col)
