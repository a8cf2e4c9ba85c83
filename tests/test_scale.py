"""Operators that work in blocks or by sketches against plain versions, and what is written and read again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import factors
from tickloom.operators import backtest, dataset, evaluate, ml
from tickloom.plans import catalogue
from tickloom.sources import ticks as sources
from tickloom.streaming import ticks as streaming


@pytest.mark.parametrize("n", (1, 2, 3, 10, 997))
def test_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2 if n > 100 else 9)
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": values})).unionByName(spark.createDataFrame([(None,)], "x double"))
    assert list(evaluate.exact_quantiles(df, "x", qs).first()) == pytest.approx(np.quantile(values, qs).tolist())


def test_quantiles_of_nothing(spark):
    assert list(evaluate.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.1, 0.5]).first()) == [None, None]


def test_ranks_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"k": np.where(rng.random(600) < 0.7, "a", "b"), "x": rng.integers(0, 40, 600).astype(float), "y": rng.normal(size=600)})
    rows.loc[rng.random(600) < 0.3, "x"] = 7.0
    df = spark.createDataFrame(rows)
    got = {(r.k, r.x): r["rank"] for r in evaluate.value_ranks(df, ["k"], "x", 8).collect()}
    assert got == {(k, x): v for k, g in rows.groupby("k") for x, v in zip(g.x, g.x.rank(), strict=True)}
    ic = {r.k: r.rank_ic for r in evaluate.rank_ic(df, ["k"], "x", "y").collect()}
    assert ic == pytest.approx({k: g.x.rank().corr(g.y.rank()) for k, g in rows.groupby("k")})


def test_positions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"contract": "a", "trade_day": np.repeat([1, 2, 3], [40, 3, 57]), "n": np.arange(100), "signal": rng.choice([0, 0, 0, 0, 1, 2], 100)})
    held = backtest.held_positions(spark.createDataFrame(rows), ["contract"], "trade_day", ["n"], hold=5)
    got = [r.position for r in held.orderBy("n").collect()]
    want, last, age = [], 0, 99
    for k, r in rows.iterrows():
        last, age = (r.signal, 0) if r.signal else (last, age + 1)
        ends = k == 99 or rows.trade_day[k + 1] != r.trade_day
        want.append(0 if ends or age >= 5 else {0: 0, 1: 1, 2: -1}[last])
    assert got == want


def test_mixup_is_repeatable(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    runs = [sorted(map(tuple, dataset.mixup(df.repartition(n), ["x"], ["k"], ["id"], shape=0.4).collect())) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 1000
    u = np.random.default_rng(0).beta(0.4, 0.4, 100_000)
    assert np.allclose(np.quantile(u, [0.1, 0.5, 0.9]), np.array(dataset.beta_quantiles(0.4))[[100, 500, 900]], atol=0.02)


def test_models_and_arrays_are_read_again(spark, tmp_path):
    model = {"features": ["a"], "weights": [1.5], "intercept": -2.0}
    ml.save_model(spark, model, str(tmp_path / "m"))
    assert ml.load_model(spark, str(tmp_path / "m")) == model
    spark.createDataFrame([("d", [1, 2], [3.0, 4.0]), ("e", [], [])], "day string, a array<int>, b array<double>").write.parquet(str(tmp_path / "a"))
    assert sorted(map(tuple, sources.read_arrays(spark, str(tmp_path / "a"), ["a", "b"]).collect())) == [("d", 0, 1, 3.0), ("d", 1, 2, 4.0)]


def test_a_batch_that_runs_again_is_not_counted_twice(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "n int, v double").write.parquet(str(tmp_path / "in"))
    stream = streaming.read_files(spark, str(tmp_path / "in"), "n int, v double")
    rows = streaming.run_to_table(stream, str(tmp_path / "out"))
    assert [tuple(r) for r in rows.select("n", "v", "_batch").collect()] == [(1, 2.0, 0)]


@pytest.mark.parametrize("name", ["large_order_lifecycle", "lifecycle_summary"])
def test_no_frame_without_an_end(spark, name):
    """Spark adds such a frame up anew for each row, so a day of n rows takes n * n steps."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_rank_ic_joins_equal_rows_once(spark):
    """Ranks go to one row for equal rows, whatever their number."""
    df = spark.createDataFrame([("a", float(k % 3), float(k % 2)) for k in range(60)], "k string, x double, y double")
    plan = evaluate.rank_ic(df, ["k"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "_w" in plan and evaluate.rank_ic(df, ["k"], "x", "y").first().rank_ic == pytest.approx(0.0, abs=1e-12)
