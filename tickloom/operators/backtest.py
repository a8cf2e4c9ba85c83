"""Positions, trades and equity of intraday strategies as windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import over_rows


def held_positions(df: DataFrame, keys: list[str], day: str, order: list[str], signal: str = "signal", hold: int = 5, carry_state: bool = True) -> DataFrame:
    """``df`` with position: the last signal (1 long, 2 short) for ``hold`` rows, flat on a day's last row.

    With ``carry_state`` a signal holds on over the end of its day.
    """
    fired = F.when(F.coalesce(F.col(signal), F.lit(0)) != 0, F.col(signal))
    ends = F.lead(F.lit(True)).over(Window.partitionBy(*keys, day).orderBy(*order)).isNull()
    rows = df.withColumns({"_ends": ends, "_fired": fired})

    def held(rows: DataFrame, w) -> DataFrame:
        return rows.withColumn("_last", F.last("_fired", ignorenulls=True).over(w.rowsBetween(-(hold - 1), 0)))

    rows = over_rows(rows, keys if carry_state else [*keys, day], order, hold, 0, held, [day])
    side = F.when(F.col("_last") == 1, 1).when(F.col("_last") == 2, -1).otherwise(0)
    return rows.withColumn("position", F.when(F.col("_ends"), 0).otherwise(side)).drop("_ends", "_fired", "_last")


def tick_pnl(df: DataFrame, keys: list[str], order: list[str], tick: float = 0.02, cost_ticks: float = 1.0, aggressive: bool = False) -> DataFrame:
    """``df`` with opened, closed and pnl (in ticks, booked where a position ends).

    Keys are those whose rows begin and end flat: a contract and day.
    Passive by default: longs enter at the bid and leave at the ask; ``aggressive`` the other way round.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    buy, sell = ("ap1", "bp1") if aggressive else ("bp1", "ap1")
    rows = df.withColumn("_before", before)
    turn = F.col("position") != F.col("_before")
    entry = F.when(turn & (F.col("position") > 0), F.col(buy)).when(turn & (F.col("position") < 0), F.col(sell))
    rows = rows.withColumn("_entry", F.last(entry, ignorenulls=True).over(so_far)).withColumn("_held", F.lag("_entry").over(w))
    out = F.when(F.col("_before") > 0, F.col(sell) - F.col("_held")).when(F.col("_before") < 0, F.col("_held") - F.col(buy))
    opened = F.when(turn & (F.col("position") != 0), 1).otherwise(0)
    closed = F.when(turn & (F.col("_before") != 0), 1).otherwise(0)
    pnl = F.when(closed == 1, out / tick).otherwise(0.0) - opened * cost_ticks
    return rows.withColumns({"opened": opened, "closed": closed, "pnl": pnl}).drop("_before", "_entry", "_held")


def trade_count(df: DataFrame, keys: list[str], order: list[str], position: str = "position") -> DataFrame:
    """(keys, trades): half the sum of position changes, each key from its first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.abs(F.col(position) - F.lag(position).over(w))
    return df.withColumn("_s", step).groupBy(*keys).agg((F.coalesce(F.sum("_s"), F.lit(0)) / 2).alias("trades"))


def equity(df: DataFrame, keys: list[str], day: str, daily_return: str) -> DataFrame:
    """``df`` (a row a day) with equity (product so far), peak and drawdown; returns of -1 and less end it at 0."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(F.col(daily_return), F.lit(0.0))
    grown = F.when(F.min(r).over(w) <= -1, 0.0).otherwise(F.exp(F.sum(F.when(r > -1, F.log1p(r)).otherwise(0.0)).over(w)))
    rows = df.withColumn("equity", grown)
    rows = rows.withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def performance(df: DataFrame, keys: list[str], day: str, daily_return: str, year: int = 252) -> DataFrame:
    """Per key: days, total and annual return, volatility, Sharpe, deepest drawdown, Calmar; returns are summed."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_cum", 1 + F.sum(daily_return).over(w))
    rows = rows.withColumn("_dd", F.try_divide(F.col("_cum"), F.greatest(F.max("_cum").over(w), F.lit(1.0))) - 1)
    out = rows.groupBy(*keys).agg(F.count("*").alias("days"), F.sum(daily_return).alias("total_return"), (F.avg(daily_return) * year).alias("annual_return"), (F.stddev_samp(daily_return) * year**0.5).alias("annual_vol"), F.min("_dd").alias("max_drawdown"))
    return out.withColumn("sharpe", F.try_divide("annual_return", "annual_vol")).withColumn("calmar", F.try_divide(F.col("annual_return"), -F.col("max_drawdown")))


def class_signal(prediction: Column, low: Column, high: Column) -> Column:
    """1 above the upper, 2 below the lower limit, else 0."""
    return F.when(prediction > high, 1).when(prediction < low, 2).otherwise(0)
