"""Elastic nets, bordered ridges and tests of one more factor against plain versions over rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import linear


def plain_path(x, y, share, alphas):
    """Coordinate descent over rows and residuals, from the largest alpha down."""
    xc, yc = x - x.mean(0), y - y.mean()
    w, out, n = np.zeros(x.shape[1]), [], len(x)
    for alpha in alphas:
        for _ in range(2000):
            before = w.copy()
            for j in range(len(w)):
                r = yc - xc @ w + xc[:, j] * w[j]
                pull = xc[:, j] @ r / n
                w[j] = np.sign(pull) * max(abs(pull) - alpha * share, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - share))
            if np.abs(w - before).max() < 1e-11:
                break
        out.append((w.copy(), y.mean() - x.mean(0) @ w))
    return out


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 603
    x = rng.normal(size=(n, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0.3]]) + 3
    y = x @ [0.4, 0, -0.3, 0] + rng.normal(0, 1, n)
    return pd.DataFrame(x, columns=list("abcd")).assign(y=y, day=pd.date_range("2024-01-01", periods=60).repeat(11)[:n], at=np.arange(n))


def test_elastic_net_chooses_like_a_plain_path(spark, table):
    shares, steps = (0.1, 0.5, 0.99, 1.0), 25
    x, y, n = table[list("abcd")].to_numpy(), table.y.to_numpy(), len(table)
    size, best = n // 6, None
    for share in shares:
        most = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / n / share
        alphas = most * np.logspace(0, -3, steps)
        errors = np.zeros(steps)
        for k in range(5):
            cut = n - (5 - k) * size
            for i, (w, b) in enumerate(plain_path(x[:cut], y[:cut], share, alphas)):
                errors[i] += ((y[cut : cut + size] - x[cut : cut + size] @ w - b) ** 2).mean() / 5
        i = int(errors.argmin())
        if best is None or errors[i] < best[0]:
            best = errors[i], share, alphas[i], plain_path(x, y, share, alphas[: i + 1])[-1][0]
    df = spark.createDataFrame(table.sample(frac=1, random_state=1)).repartition(5)
    out = linear.elastic_net(df, list("abcd"), "y", "day", ["at"], shares, 5, steps).collect()
    assert {(r.l1_share, round(r.alpha, 10)) for r in out} == {(best[1], round(best[2], 10))}
    assert out[0].mse == pytest.approx(best[0], rel=1e-8)
    got = {r.feature: r.weight for r in out}
    np.testing.assert_allclose([got.get(f, 0) for f in "abcd"], best[3], atol=1e-7)


def test_elastic_net_without_rows_or_variance(spark, table):
    kind = "a double, b double, y double, day date, at long"
    assert linear.elastic_net(spark.createDataFrame([], kind), ["a", "b"], "y", "day", ["at"]).count() == 0
    df = spark.createDataFrame(table.assign(flat=1.0))
    assert "flat" not in {r.feature for r in linear.elastic_net(df, ["a", "flat", "c"], "y", "day", ["at"], steps=10).collect()}


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_products_are_sums_without_rounding_on_the_way(spark, parts):
    """However rows are dealt out, and beside values that take each other away."""
    rng, n = np.random.default_rng(3), 4000
    f = pd.DataFrame({"a": rng.integers(0, 11, n) / 100, "b": rng.integers(1, 51, n) / 10, "c": np.tile([1e9, 0.1, -1e9, 0.3], n // 4), "k": rng.integers(0, 3, n)})
    got = {(r.fold, r.i, r.j): r.v for r in linear.products(spark.createDataFrame(f).repartition(parts), list("abc"), "k").collect()}
    assert len(got) == 30
    for (k, i, j), v in got.items():
        x = np.column_stack([np.ones(n), f[list("abc")]])[f.k == k]
        assert v == math.fsum(x[:, i] * x[:, j])


def test_products_of_infinite_values_and_of_no_rows(spark):
    f = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (1e200, 4.0)], "a double, b double")
    got = {(r.i, r.j): r.v for r in linear.products(f.repartition(3), ["a", "b"]).collect()}
    assert got[1, 1] == got[0, 1] == got[1, 2] == np.inf and (got[0, 0], got[0, 2], got[2, 2]) == (3, 9, 29)
    assert linear.products(f.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("base", [0, 1, 3])
def test_bordered_ridges(table, base):
    m = np.column_stack([np.ones(len(table)), table[["a", "b", "c", "d", "y"]]])
    got = linear.bordered_ridges(m.T @ m, base, 1.0)
    assert [c for _, _, c in got] == list(range(base, 4))
    for w, b, c in got:
        x, y = m[:, [k + 1 for k in [*range(base), c]]], m[:, 5]
        xc = x - x.mean(0)
        want = np.linalg.solve(xc.T @ xc + np.eye(base + 1), xc.T @ (y - y.mean()))
        np.testing.assert_allclose(w, want, rtol=1e-7, atol=1e-9)
        assert b == pytest.approx(y.mean() - x.mean(0) @ want)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 21, 100, 101, 400])
def test_quantile_classes(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"k": ["p"] * n + ["q"] * n, "v": np.concatenate([rng.normal(size=n), rng.integers(0, 6, n).astype(float)]), "i": range(2 * n)})
    got = linear.quantile_classes(spark.createDataFrame(frame), ["k"], "v").toPandas().sort_values("i", ignore_index=True)
    for k, rows in frame.groupby("k"):
        hi, lo = np.quantile(rows.v, 0.95), np.quantile(rows.v, 0.05)
        assert got[got.k == k].signal.tolist() == [1 if v > hi else 2 if v < lo else 0 for v in rows.v]


def test_incremental_test(spark):
    """Against a loop over candidates: a fit, quantiles, positions and days each."""
    rng, n = np.random.default_rng(9), 900
    f = pd.DataFrame({"contract": "a", "trade_day": pd.date_range("2024-01-01", periods=6).repeat(150).date, "ts": np.arange(n), "b": rng.normal(size=n), "c1": rng.normal(size=n), "c2": rng.normal(size=n)})
    f["y"] = 0.5 * f.b + 0.8 * f.c1 + rng.normal(size=n)
    price = 100 + np.cumsum(rng.normal(0, 0.02, n))
    f["ap1"], f["bp1"] = price + 0.01, price - 0.01
    train, test = f[f.ts < 450], f[f.ts >= 450].reset_index(drop=True)
    out = {r.candidate: r for r in linear.incremental_test(spark.createDataFrame(train), spark.createDataFrame(test), ["b"], ["c1", "c2"], "y", "contract", "trade_day", ["ts"]).collect()}
    for c in ("c1", "c2"):
        x, xt = train[["b", c]].to_numpy(), test[["b", c]].to_numpy()
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (train.y - train.y.mean()))
        p = xt @ w + train.y.mean() - x.mean(0) @ w
        hi, lo = np.quantile(p, 0.95), np.quantile(p, 0.05)
        signal = np.where(p > hi, 1, np.where(p < lo, 2, 0))
        net, fired = 1.0, None
        position = []
        for i in range(len(test)):
            fired = (i, signal[i]) if signal[i] else fired
            side = 0 if fired is None or i - fired[0] >= 5 else {1: 1, 2: -1}[fired[1]]
            position.append(0 if i + 1 == len(test) or test.trade_day[i + 1] != test.trade_day[i] else side)
        for _, rows in test.groupby("trade_day"):
            before, entry, pnl = 0, 0.0, 0.0
            for i in rows.index:
                if position[i] != before:
                    if before:
                        pnl += (test.ap1[i] - entry if before > 0 else entry - test.bp1[i]) / 0.02
                    if position[i]:
                        entry = test.bp1[i] if position[i] > 0 else test.ap1[i]
                        pnl -= 1
                    before = position[i]
            net *= 1 + pnl * 0.02 / ((rows.ap1.iloc[0] + rows.bp1.iloc[0]) / 2)
        r = out[c]
        assert r.ic == pytest.approx(np.corrcoef(p, test.y)[0, 1]) and r.long == pytest.approx(test.y[p > hi].mean()) and r.short == pytest.approx(test.y[p < lo].mean())
        assert r.net_value == pytest.approx(net, rel=1e-9)
    kept = linear.kept_candidates(spark.createDataFrame(list(out.values())), 0.0)
    assert kept.count() == 2 and kept.where(F.col("net_value") > 5).count() == 0
