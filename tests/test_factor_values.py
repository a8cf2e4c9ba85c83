"""Every factor by value against its SQL in DuckDB, on ticks and bars with gaps, one-sided books, ties, zeros and flat stretches.

Plans run in small blocks here, so copies at the blocks' edges are tried as well.
"""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom.functions import factors
from tickloom.functions.factors import compute, numbered
from tickloom.plans.factor_queries import FACTORS
from tickloom.plans.tables import ORDER, levelled
from tickloom.sources.ticks import without_nan

KEYS = ["contract"]


@pytest.fixture(scope="module")
def made():
    """Two contracts, three days, 700 ticks each: walks with repeated prices, idle stretches and one-sided or missing quotes."""
    rng, out = np.random.default_rng(7), []
    for c in ("a", "b"):
        n = 700
        step = rng.integers(-2, 3, n)
        step[200:330] = 0
        last = 5000.0 + np.cumsum(step)
        dv = rng.integers(0, 30, n)
        dv[220:300] = 0
        day = np.repeat([0, 1, 2], [300, 150, 250])
        rows = pd.DataFrame({"contract": c, "trade_day": [pd.Timestamp("2025-08-04").date() + pd.Timedelta(days=int(d)) for d in day], "ts": pd.Timestamp("2025-08-04 09:00") + pd.to_timedelta(day, unit="D") + pd.to_timedelta(np.arange(n) * 0.5 + rng.integers(0, 4, n) * 1800, unit="s"), "event_id": np.arange(n) + (1000 if c == "b" else 0), "last": last})
        rows = rows.sort_values(["trade_day", "ts", "event_id"], ignore_index=True)
        for i in range(1, 6):
            rows[f"ap{i}"], rows[f"bp{i}"] = rows["last"] + i + rng.integers(0, 2, n), rows["last"] - i - rng.integers(0, 2, n)
            rows[f"av{i}"], rows[f"bv{i}"] = rng.integers(0, 60, n).astype(float), rng.integers(1, 60, n).astype(float)
        rows["dv"], rows["dt"] = dv, dv * rows["last"]
        rows["volume"], rows["turnover"] = rows.groupby("trade_day")["dv"].cumsum().astype(float), rows.groupby("trade_day")["dt"].cumsum().astype(float)
        rows["openinterest"], rows["ordercnt_bid1"], rows["ordercnt_ask1"] = 1000.0 + rng.integers(-5, 6, n).cumsum(), rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        rows.loc[[5, 90, 410], "ap1"], rows.loc[[7, 91], "bp1"], rows.loc[[9, 500], ["ap1", "bp1"]] = 0, 0, 0
        rows.loc[[30, 31, 600], ["ap3", "av3"]], rows.loc[[40, 601], ["bp5", "bv5"]] = np.nan, np.nan
        out.append(rows.drop(columns=["dv", "dt"]))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def bars(made):
    """Bars with flat stretches, no volume and unknown values."""
    rng, out = np.random.default_rng(8), []
    for c in ("a", "b"):
        n = 420
        step = rng.integers(-3, 4, n)
        step[100:150] = 0
        price = 5000.0 + np.cumsum(step)
        up, down = rng.integers(0, 3, n), rng.integers(0, 3, n)
        up[110:140] = down[110:140] = 0
        vol = rng.integers(0, 40, n).astype(float)
        vol[200:212] = 0
        rows = pd.DataFrame({"contract": c, "trade_day": [pd.Timestamp("2025-08-04").date() + pd.Timedelta(days=int(k // 150)) for k in range(n)], "ts": pd.Timestamp("2025-08-04") + pd.to_timedelta(np.arange(n), unit="m"), "event_id": np.arange(n) + (1000 if c == "b" else 0), "row_at": np.arange(n), "price": price, "high": price + up, "low": price - down, "open": np.clip(price + rng.integers(-2, 3, n), price - down, price + up), "vol": vol})
        rows["dollar_volume"], rows["vwap"], rows["openinterest"] = rows.price * vol, rows.price + 0.5, 900.0 + rng.integers(-4, 5, n).cumsum()
        rows["depth"], rows["net_inflow"], rows["elasticity"] = rng.integers(1, 30, n).astype(float), rng.integers(-20, 21, n).astype(float), rng.random(n)
        for part, share in (("bigorder", 0.3), ("buy", 0.5), ("sell", 0.5), ("bigbuy", 0.2), ("bigsell", 0.1)):
            rows[f"{part}_vol"] = np.floor(vol * share)
        rows["delta_turnover"], rows["volume"] = rows.dollar_volume / 10, rows.groupby("trade_day")["vol"].cumsum()
        rows["ap1"], rows["bp1"], rows["av1"], rows["bv1"] = price + 1, price - 1, rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        rows.loc[[50, 51, 300], ["openinterest", "elasticity"]] = np.nan
        out.append(rows)
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def wild(made):
    """The ticks with a doubled price, a row of 1,000,000 lots, and one price of a million."""
    out = made.copy()
    for c in ("a", "b"):
        at = out.index[out.contract == c]
        for col in ["last", *(f"{side}p{i}" for side in "ab" for i in range(1, 6))]:
            out.loc[at[345], col] *= 2
            out.loc[at[480], col] += 1e6
        for day in sorted(set(out.trade_day)):
            rest = [i for i in at if out.trade_day[i] == day][60:]
            out.loc[rest, "volume"] += 1e6
            out.loc[rest, "turnover"] += 1e6 * out.loc[rest[0], "last"]
    return out


@pytest.fixture(scope="module")
def tables(spark, made, bars, wild):
    known = {}
    for name, frame in (("ticks", made), ("bars", bars), ("wild", wild)):
        df = spark.createDataFrame(frame)
        df = without_nan(df).repartition(4)
        df = df if name == "bars" else numbered(df, KEYS, ["trade_day"], ORDER)
        known[name] = df.cache()
    return known


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Few rows and large plans: compiling them takes longer than running them as they are."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", FACTORS)
def test_values(spark, made, bars, tables, monkeypatch, name):
    frame, table = (bars, tables["bars"]) if FACTORS[name][3] else (made, tables["ticks"])
    same_values(name, frame, table, monkeypatch)


@pytest.mark.parametrize("name", [n for n, f in FACTORS.items() if not f[3] and any(w in " ".join(f[2]) for w in ("skew", "std", "corr", "kurt"))])
def test_values_beside_outliers(spark, wild, tables, monkeypatch, name):
    """Long frames that an outlier has left are what they would be without it."""
    same_values(name, wild, tables["wild"], monkeypatch)


def same_values(name, frame, table, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_ROWS", 64)
    book, sql, names, _ = FACTORS[name]
    if name == "emv":
        table = table.join(table.groupBy("contract").agg({"vol": "avg"}).withColumnRenamed("avg(vol)", "mean_vol"), "contract")
    got = compute(table, book, names, KEYS, ORDER).select(*KEYS, "event_id", *names).toPandas().sort_values("event_id", ignore_index=True)
    c = duckdb.connect()
    c.register("frame", frame.astype({"trade_day": "datetime64[ns]"}))
    have = [x for x in frame.columns if x != "row_at"]
    source = f"SELECT {', '.join(f'if(isnan({x}), NULL, {x}) AS {x}' if frame[x].dtype == float else x for x in have)} FROM frame"
    want = c.sql(f"SELECT event_id, {', '.join(names)} FROM ({levelled(source, sql, names, have, KEYS)}) ORDER BY event_id").df()
    assert got.event_id.tolist() == want.event_id.tolist()
    for n in names:
        a, b = got[n].astype(float).to_numpy(), want[n].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), (n, np.flatnonzero(np.isnan(a) != np.isnan(b))[:5])
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-7, err_msg=n)
