"""Operators against pandas, NumPy and plain loops on small made ticks; their SQL plays no part here."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import liquidity, session
from tickloom.functions.expressions import Sql
from tickloom.functions.factors import MINUTE, TICK, compute
from tickloom.functions.kernels import KERNEL
from tickloom.functions.liquidity import LIQUIDITY
from tickloom.operators import backtest, dataset, evaluate, joins, ml, recursive
from tickloom.sources import ticks as sources
from tickloom.streaming import ticks as streaming

KEYS, ORDER = ["contract"], ["ts", "event_id"]


@pytest.fixture(scope="session")
def walk():
    """Two contracts of 260 ticks: a random walk with gaps and one-sided books."""
    rng, out = np.random.default_rng(4), []
    for c in ("a", "b"):
        last = 5000 + np.cumsum(rng.integers(-3, 4, 260)).astype(float)
        dv = rng.integers(0, 30, 260)
        rows = pd.DataFrame({"contract": c, "trade_day": pd.Timestamp("2025-08-01").date(), "ts": pd.date_range("2025-08-01 09:00", periods=260, freq="500ms"), "event_id": np.arange(260) + (1000 if c == "b" else 0), "last": last})
        for i in range(1, 6):
            rows[f"ap{i}"], rows[f"bp{i}"] = last + i, last - i
            rows[f"av{i}"], rows[f"bv{i}"] = rng.integers(1, 40, 260).astype(float), rng.integers(1, 40, 260).astype(float)
        rows["ordercnt_bid1"], rows["ordercnt_ask1"] = 3.0, 4.0
        rows["volume"], rows["turnover"], rows["openinterest"] = np.cumsum(dv).astype(float), np.cumsum(dv * last), 1000.0 + rng.integers(0, 50, 260)
        rows.loc[[5, 90], "ap1"], rows.loc[[7, 91], "bp1"], rows.loc[9, ["ap1", "bp1"]] = 0, 0, 0
        out.append(rows)
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def book(spark, walk):
    return spark.createDataFrame(walk).repartition(3).cache()


def got(df, columns):
    return df.select(*KEYS, *ORDER, *columns).toPandas().sort_values([*KEYS, *ORDER]).reset_index(drop=True)


def same(a, b, tolerance=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=tolerance, atol=1e-9)


def test_rolling_against_pandas(book, walk):
    s = Sql()
    x = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE last END"
    book = book.withColumn("x", F.expr(x))
    p = {"mean": s.mean("x", 20, 5), "std": s.std("x", 20, 5), "skew": s.skew("x", 20, 10), "kurt": s.kurt("x", 20, 10), "q": s.quantile("x", 0.8, 20, 10), "corr": s.corr("x", "av1", 20, 10), "full": s.sum("x", 10)}
    df = book.select("*", *[F.expr(t.replace("{P}", "PARTITION BY contract ORDER BY ts, event_id")).alias(n) for n, t in p.items()])
    out = got(df, p)
    w = walk.assign(x=walk["last"].where(walk.event_id % 13 != 0)).sort_values([*KEYS, *ORDER])
    for n, f in {"mean": lambda r: r.rolling(20, 5).mean(), "std": lambda r: r.rolling(20, 5).std(), "skew": lambda r: r.rolling(20, 10).skew(), "kurt": lambda r: r.rolling(20, 10).kurt(), "q": lambda r: r.rolling(20, 10).quantile(0.8), "full": lambda r: r.rolling(10).sum()}.items():
        same(out[n], w.groupby("contract")["x"].transform(f), 1e-6)
    want = pd.concat([g["x"].rolling(20, 10).corr(g["av1"]) for _, g in w.groupby("contract")])
    same(out["corr"], want, 1e-6)


def test_tick_factors(book, walk):
    names = ["mid", "trade_direction", "delta_volume", "ofi1", "order_imbalance", "soir1", "tick_ret"]
    out = got(compute(book, TICK, names, KEYS, ORDER), names)
    for c, g in walk.groupby("contract"):
        o = out[out.contract == c].reset_index(drop=True)
        g = g.reset_index(drop=True)
        mid = np.where(g.ap1 == 0, g.bp1, np.where(g.bp1 == 0, g.ap1, (g.ap1 + g.bp1) / 2))
        same(o["mid"], np.where(mid == 0, np.nan, mid))
        step, sign, side = g["last"].diff(), 0, []
        for i in range(len(g)):
            sign = np.sign(step[i]) if i else sign
            side.append(1 if g["last"][i] > mid[i] > 0 else -1 if g["last"][i] < mid[i] else sign)
        assert o.trade_direction.tolist() == side
        same(o.delta_volume, np.diff(g.volume, prepend=0))
        want = [np.nan]
        for i in range(1, len(g)):
            b = g.bv1[i] if g.bp1[i] > g.bp1[i - 1] else g.bv1[i] - g.bv1[i - 1] if g.bp1[i] == g.bp1[i - 1] else -g.bv1[i - 1]
            a = g.av1[i] if g.ap1[i] < g.ap1[i - 1] else g.av1[i] - g.av1[i - 1] if g.ap1[i] == g.ap1[i - 1] else -g.av1[i - 1]
            want.append(b - a)
        same(o.ofi1, want)


def test_every_factor_runs_on_few_rows(book):
    """Frames longer than the table give NULLs, and one-sided or flat books raise nothing."""
    few = book.where("event_id % 1000 < 12")
    assert compute(few, TICK, TICK, KEYS, ORDER).count() == 24
    assert compute(few.withColumns({c: F.lit(5.0) for c in ("last", "ap1", "bp1")}), LIQUIDITY, LIQUIDITY, KEYS, ORDER).count() == 24
    bars = few.selectExpr("contract", "ts", "event_id", "last AS price", "last + 2 AS high", "last - 2 AS low", "last AS open", "bv1 AS vol", "turnover AS dollar_volume", "turnover / volume AS vwap", "0.1D AS elasticity", "turnover AS delta_turnover", "volume", "trade_day", "15.0D AS mean_vol", "openinterest", "av1 AS depth", "bv2 - av2 AS net_inflow", "1.0D AS bigorder_vol", "2.0D AS buy_vol", "1.0D AS sell_vol", "0.0D AS bigbuy_vol", "0.0D AS bigsell_vol", "ap1", "bp1", "av1", "bv1")
    assert compute(bars, MINUTE, MINUTE, KEYS, ORDER).count() == 24
    flat = bars.withColumns({c: F.lit(5.0) for c in ("price", "high", "low", "open", "vol")})
    assert compute(flat, KERNEL, KERNEL, KEYS, ORDER).count() == 24


def test_later_rows_change_nothing(book):
    names = ["oi_ma_60", "vol_mid_corr_120", "net_inflow_std", "rolling_amp", "gate_rsi", "price_elasticity"]
    whole = got(compute(book, TICK, names, KEYS, ORDER), names)
    part = got(compute(book.where("event_id % 1000 < 150"), TICK, names, KEYS, ORDER), names)
    head = whole[whole.event_id % 1000 < 150].reset_index(drop=True)
    pd.testing.assert_frame_equal(head, part)


@pytest.mark.parametrize("beyond", ["last", "penalty", "linear", "robust"])
@pytest.mark.parametrize("side", ["a", "b"])
def test_sweep_is_a_walk_over_levels(spark, walk, side, beyond):
    rows = walk.head(40).copy()
    rows.loc[3, f"{side}v2"] = None
    rows.loc[4, f"{side}p5"] = rows.loc[4, f"{side}p1"]
    rows["target"] = [None, 0.0, *np.arange(5.0, 195.0, 5.0)]
    df = sources.without_nan(spark.createDataFrame(rows)).withColumn("price", F.expr(liquidity.sweep_price(side, "target", beyond)))
    for r in df.collect():
        if r.target is None or r.target <= 0:
            assert r.price == r[f"{side}p1"]
            continue
        left, cost, filled = r.target, 0.0, 0.0
        for i in range(1, 6):
            p, v = r[f"{side}p{i}"], r[f"{side}v{i}"]
            if p is None or v is None:
                continue
            take = min(left, v)
            cost, left, filled = cost + take * p, left - take, filled + take
        if left > 0:
            p1, p5 = r[f"{side}p1"], r[f"{side}p5"]
            width = abs(p5 - p1) or 1.0
            past = {"last": 0, "penalty": 2, "linear": 1 + left * width / max(filled, 1) / 2, "robust": 1 + min(width * math.sqrt(left / max(filled, 1)) * 0.5, max(width * 5, 20)) / 2}[beyond]
            cost += left * (p5 + (-past if p1 > p5 else past))
        assert r.price == pytest.approx(cost / r.target)


def test_recursions_against_pandas(walk):
    x = walk[walk.contract == "a"]["last"].to_numpy()
    same(recursive.ema(x, 12), pd.Series(x).ewm(span=12, adjust=False).mean())
    up, down = np.maximum(np.diff(x, prepend=x[0]), 0), np.maximum(-np.diff(x, prepend=x[0]), 0)
    g, l = up[:14].mean(), down[:14].mean()
    for i in range(14, 30):
        g, l = (g * 13 + up[i]) / 14, (l * 13 + down[i]) / 14
    assert recursive.rsi(x)[29] == pytest.approx(100 - 100 / (1 + g / l))
    assert (recursive.kdj(np.ones(20), np.ones(20), np.ones(20))[8:] == 50).all()
    assert recursive.adaptive_mean(np.ones(50), np.zeros(50)).tolist() == [1.0] * 50
    assert recursive.spaced(np.array([1, 5, 12, 13, 30]), 10).tolist() == [True, False, True, False, True]
    with_gap = x.copy()
    with_gap[5] = np.nan
    assert np.isnan(recursive.ema(with_gap, 5)[5]) and recursive.ema(with_gap, 5)[6] == with_gap[6]


def test_day_machine():
    ask, bid = [11.0, 12, 13, 14, 15], [10.0, 11, 12, 13, 14]
    assert recursive.day_machine([1, 0.5, -0.1, -1, -1], ask, bid, 0.8) == (pytest.approx(12 - 11 + 13 - 15), 1, 1)
    assert recursive.day_machine([], [], [], 0.8) == (0.0, 0, 0)
    assert recursive.day_machine([0.9], [11.0], [10.0], 0.8, 0.01) == (pytest.approx(-1 - 0.11 - 0.10), 1, 0)


def test_held_positions(spark):
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"k": "x", "day": np.repeat(range(6), 25), "n": range(150), "signal": rng.choice([0, 0, 0, 0, 1, 2], 150)})
    for carry in (True, False):
        out = backtest.held_positions(spark.createDataFrame(rows), ["k"], "day", ["n"], carry_state=carry).orderBy("n").toPandas()
        want, side, age = [], 0, 99
        for i, s in enumerate(rows.signal):
            if not carry and i % 25 == 0:
                side, age = 0, 99
            side, age = (s, 0) if s else (side, age + 1)
            want.append(0 if i % 25 == 24 or age >= 5 else {0: 0, 1: 1, 2: -1}[side])
        assert out.position.tolist() == want


def test_equity_and_performance(spark):
    r = [0.1, -0.2, 0.05, None, 0.3]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(r)] + [("b", 0, 0.1), ("b", 1, -1.0), ("b", 2, 0.5)], "k string, day int, r double")
    out = backtest.equity(df, ["k"], "day", "r").orderBy("k", "day").toPandas()
    same(out[out.k == "a"].equity, np.cumprod([1.1, 0.8, 1.05, 1, 1.3]))
    same(out[out.k == "b"].equity, [1.1, 0, 0])
    p = backtest.performance(df.where("r IS NOT NULL"), ["k"], "day", "r").where("k = 'a'").first()
    assert p.total_return == pytest.approx(0.25) and p.max_drawdown == pytest.approx(0.9 / 1.1 - 1)


def test_sources(spark, tmp_path):
    clocks = [("20250808", "09:30:01", 5), ("20250808", "09:30", 250), ("20250808", "", 0), ("20250808", "text", None), ("20250808", "21:00:00", 999)]
    df = spark.createDataFrame(clocks, "day string, clock string, ms int")
    got_ = [str(r[0]) for r in df.select(sources.timestamp_from_parts(F.col("day"), F.col("clock"), F.col("ms"))).collect()]
    assert got_ == ["2025-08-08 09:30:01.005000", "2025-08-08 09:30:00.250000", "2025-08-08 00:00:00", "2025-08-08 00:00:00", "2025-08-08 21:00:00.999000"]
    text = df.select(sources.timestamp_from_text(F.col("day"), F.col("clock"), F.col("ms"))).collect()
    assert str(text[0][0]) == "2025-08-08 09:30:01.005000" and text[3][0] is None
    paths = spark.createDataFrame([("/x/20250808_ag_1.csv",), ("/x/20250808_ag_2.csv",), ("/x/none.csv",)], "path string")
    assert [tuple(map(str, r)) for r in sources.newest_files(paths).collect()] == [("2025-08-08", "/x/20250808_ag_2.csv")]
    cal = spark.createDataFrame([("2024-01-02", "AU2406.SHF"), ("2019-01-02", "AU1906.SHF")], "date string, contract string")
    assert [tuple(map(str, r)) for r in sources.roll_calendar(cal).collect()] == [("2024-01-02", "au2406")]
    nan = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "x double, `f.y` int")
    assert [r.x for r in sources.without_nan(nan).collect()] == [None, None, 1.5]
    days = spark.createDataFrame([(1, 2.5, "2025-08-08")], "f_1 int, f_2 double, d string").withColumn("trade_day", F.col("d").cast("date"))
    sources.write_days(days, str(tmp_path / "days"))
    assert sources.factor_columns(days) == ["f_1", "f_2"] and sources.since(spark.read.parquet(str(tmp_path / "days")), "2025-08-01").count() == 1
    twice = days.select("f_1", "f_1", "d")
    assert sources.distinct_columns(twice).columns == ["f_1", "d"]


def test_sessions(spark):
    clocks = "20:59 21:00 02:30 07:59 08:59 09:00 10:15 10:30 11:30 13:30 15:00 15:01".split()
    df = session.with_session(spark.createDataFrame([(f"2025-08-08 {c}:00",) for c in clocks], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts")))
    rows = df.orderBy("ts").collect()
    by = {str(r.ts)[11:16]: r for r in rows}
    assert [c for c in clocks if by[c].is_night] == ["21:00", "02:30", "07:59"]
    assert [c for c in clocks if by[c].is_am] == ["09:00", "10:15", "10:30"] and [c for c in clocks if by[c].is_pm] == ["13:30", "15:00"]
    assert by["09:00"].session_decay == 1 and by["08:59"].session_decay == pytest.approx(1 / math.sqrt(10000))
    assert by["10:30"].open_impulse == 1 and by["02:30"].session_decay == pytest.approx(1 / math.sqrt(331))
    assert session.trading_hours(df).count() == 10


def test_evaluation(spark):
    x = spark.createDataFrame([(i, float(i // 30), float(i)) for i in range(100)] + [(200, None, 1.0), (201, 1.0, None)], "i int, f double, y double")
    b = evaluate.quantile_buckets(x, "f", "y", 10).orderBy("bucket").collect()
    want = pd.qcut(pd.Series([i // 30 for i in range(100)], dtype=float), 10, duplicates="drop")
    assert [r.n for r in b] == [n for n in want.value_counts(sort=False) if n]
    flat = x.withColumn("c", F.lit(3.0))
    assert flat.agg(evaluate.guarded_corr("c", "y")).first()[0] is None
    pairs = pd.DataFrame({"f": [3, 1, 1, 2, 5.0], "y": [1, 2, 2, 9, 4.0]})
    assert evaluate.rank_ic(spark.createDataFrame(pairs.assign(k=1)), ["k"], "f", "y").first().rank_ic == pytest.approx(pairs.f.rank().corr(pairs.y.rank()))
    s = evaluate.threshold_sweep(spark.createDataFrame([(0.5, 2.0), (-0.5, 1.0), (None, 9.0), (0.1, 3.0)], "p double, y double"), "p", "y", 0.5, [0.2]).first()
    assert (s.signals, s.dq, s.dqr) == (2, 15 * (1.5 - 1.5), 1.0)
    ks = evaluate.ks_distance(spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).normal(3, 2, 3000)], "v double"), "v").first()
    assert ks.distance < 0.03 and ks.mean == pytest.approx(3, abs=0.2)
    parts = evaluate.checkpoints(spark.range(1300).withColumnRenamed("id", "n"), "n").groupBy("checkpoint").agg(F.min("n"), F.max("n")).orderBy("checkpoint").collect()
    assert [tuple(r) for r in parts][:6] == [(120, 0, 119), (240, 0, 239), (360, 0, 359), (480, 0, 479), (600, 0, 599), (720, 120, 719)]


def test_datasets(spark):
    t = spark.createDataFrame([("a", i, 100.0 * (1 + (0.003 if i == 3 else -0.003 if i == 6 else 0))) for i in range(12)], "k string, n int, p double")
    label = t.select("n", dataset.triple_barrier("p", ["k"], ["n"], 3).alias("l")).orderBy("n").collect()
    assert [r.l for r in label] == [1, 1, 1, -1, -1, -1, 1, 0, 0, 0, 0, 0]
    w = dataset.windows_as_arrays(t, ["p"], ["k"], ["n"], 3, 2).orderBy("n").collect()
    assert [x[0] for x in w[1].sequence] == [t.first().p] * 2 + [w[1].p] and len(w[11].sequence) == 3
    assert dataset.windows_as_arrays(t, ["p"], ["k"], ["n"], 3, 2, pad=False).count() == 8
    assert [r.n for r in dataset.sampled(t, ["k"], ["n"], 5, 4).orderBy("n").collect()] == [4, 9]
    z = dataset.standardised(t, t, ["p"]).agg(F.avg("p"), F.stddev("p")).first()
    assert z[0] == pytest.approx(0) and z[1] <= 1.0 + 1e-9
    assert dataset.mixup(t, ["p"], ["k"]).count() == 24 and dataset.corrupted(t, ["p"], 0.1).columns == t.columns
    assert t.limit(0).select(dataset.triple_barrier("p", ["k"], ["n"])).count() == 0


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 0, 10.0), ("a", 5, 20.0), ("a", 9, 30.0)], "k string, t int, v double")
    assert sorted(tuple(r) for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()) == [("a", 1, 10.0), ("a", 5, 20.0), ("b", 2, None)]
    both = joins.inner_suffixed(right, right, ["k", "t"])
    assert both.columns == ["k", "t", "v_main", "v_second"] and both.count() == 3
    assert joins.align_left(left, right, ["k", "t"], {"v": 0.0}).agg(F.sum("v")).first()[0] == 20.0
    assert joins.without_first_day(right, "t", ["k"]).count() == 2


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    m = ml.ridge(df, ["a", "b"], "y", 1.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))
    same(m["weights"], want, 1e-8)
    e = evaluate.regression_errors(ml.apply_linear(df, m), "y", "prediction").first()
    assert e.r2 > 0.99 and e.ccc > 0.99
    assert ml.score(df, ["a"], lambda v: v[:, 0] * 2).agg(F.sum(F.abs(F.col("prediction") - 2 * F.col("a")))).first()[0] == pytest.approx(0)


def test_streamed_state(spark, tmp_path):
    """The running mean goes on from batch to batch."""
    for k in range(3):
        spark.createDataFrame([("a", 10 * k + i, float(10 * k + i)) for i in range(10)], "k string, n int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.read_files(spark, str(tmp_path / "in"), "k string, n int, v double", per_trigger=1)
    out = streaming.run_to_table(streaming.running_ema(stream, "k", "n", "v", 5), str(tmp_path)).toPandas()
    assert len(out) == 30 and out["_batch"].nunique() == 3
    seen = out.sort_values(["_batch", "n"])
    same(seen.ema, pd.Series(seen.v.to_numpy()).ewm(span=5, adjust=False).mean())


def test_hurst_slopes_in_blocks(spark):
    """Segments over days of uneven length, with constant ones, gaps and short keys; no task gets over a block of rows."""
    rng, out = np.random.default_rng(8), []
    for c, n in (("a", 2345), ("b", 100), ("c", 15), ("d", 7)):
        last = 5000 + np.cumsum(rng.integers(-3, 4, n)).astype(float)
        last[20:45] = 1.0
        days = np.sort(rng.integers(1, 9, n))
        out.append(pd.DataFrame({"contract": c, "day": [pd.Timestamp(2025, 8, d).date() for d in days], "ts": pd.DatetimeIndex([pd.Timestamp(2025, 8, d) for d in days]) + pd.to_timedelta(np.arange(n), "s"), "event_id": np.arange(n), "last": last}))
    rows = pd.concat(out, ignore_index=True)
    df = spark.createDataFrame(rows).withColumn("last", F.when(F.col("event_id") % 997 != 996, F.col("last")))
    rows["last"] = rows["last"].where(rows["event_id"] % 997 != 996)
    got = {r.contract: (r.hurst, r.n) for r in recursive.hurst_slopes(df.repartition(3), "contract", "day", ORDER, "last").collect()}
    for c, x in rows.groupby("contract"):
        want = recursive.hurst_slope(x["last"].to_numpy())
        assert got[c][1] == len(x) and (got[c][0] is None if math.isnan(want) else math.isclose(got[c][0], want, rel_tol=1e-9))
    plan = recursive.hurst_slopes(df, "contract", "day", ORDER, "last")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
