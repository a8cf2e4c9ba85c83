"""Whole runs put together from the operators: factor build, main and second contract, scoring with a backtest.

Each is one lazy plan; the per-file loops that such runs usually have are partitions here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import session
from ..functions.factors import TICK, compute
from ..functions.liquidity import LIQUIDITY
from ..operators import backtest, dataset, evaluate, joins, ml

DAY, ORDER = ["contract", "trade_day"], ["ts", "event_id"]


def factor_table(clock: DataFrame, market: DataFrame, names: list[str], stride: int = 60, offset: int = 59, keys=DAY) -> DataFrame:
    """Factors of the market's ticks on a factor clock (keys, ts, and its own columns), every ``stride``-th row."""
    factors = compute(market, TICK, names, keys, ORDER).select(*DAY, *ORDER, *names)
    sampled = dataset.sampled(factors, keys, ORDER, stride, offset)
    return joins.align_left(sampled, clock, [*DAY, "ts"])


def main_and_second(main: DataFrame, second: DataFrame, names=("final_spread", "impact_skew", "cost_bps"), snapshot: Callable | None = None) -> DataFrame:
    """Liquidity of two contracts at equal times, the second one scaled by the day before's volumes; without the first day.

    ``snapshot`` picks rows that both can have (ends of hours, say) after all ticks have counted.
    """
    pick = snapshot or (lambda t: t.drop("event_id"))
    wanted = lambda t: pick(compute(t, LIQUIDITY, names, DAY, ORDER).select("trade_day", "ts", "event_id", *names))
    multiplier = joins.cross_day_multiplier(main, second)
    both = joins.inner_suffixed(wanted(main), wanted(second), ["trade_day", "ts"])
    scaled = both.join(multiplier, "trade_day").withColumn("scaled_spread_second", F.col("final_spread_second") * F.col("multiplier"))
    return joins.without_first_day(scaled)


def scored(table: DataFrame, features: list[str], predict: Callable, window: int = 120, stride: int = 60) -> DataFrame:
    """Session columns, rolling means of the features, every ``stride``-th full row, and a model's predictions."""
    rows = dataset.rolling_means(session.with_session(table), features, DAY, ORDER, window)
    means = [f"{f}_mean{window}" for f in features]
    picked = dataset.sampled(rows, DAY, ORDER, stride, window - 1).dropna(subset=means)
    return ml.score(picked, means, predict)


def swept(predictions: DataFrame, outcome: str, cost: float, thresholds: list[float]) -> DataFrame:
    return evaluate.threshold_sweep(predictions, "prediction", outcome, cost, thresholds)


def traded(predictions: DataFrame, low: float, high: float, hold: int = 5) -> DataFrame:
    """Positions and PnL in ticks of predictions beyond the limits."""
    signals = predictions.withColumn("signal", backtest.class_signal(F.col("prediction"), F.lit(low), F.lit(high)))
    held = backtest.held_positions(signals, ["contract"], "trade_day", ORDER, hold=hold)
    return backtest.tick_pnl(held, DAY, ORDER)
