"""Alignment of tick tables: by timestamp, by day, and (as an extension) to the last row at or before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align_left(clock: DataFrame, market: DataFrame, on: list[str], fill: dict | None = None) -> DataFrame:
    """Market columns on a factor clock; the clock's rows stay, each once if the market's keys are unique."""
    out = clock.join(market, on, "left")
    return out.fillna(fill) if fill else out


def inner_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_main", "_second")) -> DataFrame:
    """Rows of both at the same time; columns that both have get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, x: df.select(*[F.col(c).alias(c + x if c in both else c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), on, "inner")


def common_days(left: DataFrame, right: DataFrame, day: str = "trade_day") -> DataFrame:
    return left.select(day).intersect(right.select(day))


def without_first_day(df: DataFrame, day: str = "trade_day", keys: list[str] = ()) -> DataFrame:
    """Rows after each key's first day."""
    first = df.groupBy(*keys).agg(F.min(day).alias("_first")) if keys else df.agg(F.min(day).alias("_first"))
    joined = df.join(first, list(keys)) if keys else df.crossJoin(F.broadcast(first))  # one row
    return joined.where(F.col(day) > F.col("_first")).drop("_first")


def day_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last cumulative volume and turnover of each key."""
    return df.groupBy(*keys).agg(F.max("volume").alias("day_volume"), F.max("turnover").alias("day_turnover"))


def cross_day_multiplier(main: DataFrame, second: DataFrame, day: str = "trade_day", most: float = 500.0) -> DataFrame:
    """(day, multiplier): the day before's main over second volume, capped; 1 on the first day."""
    total = main.groupBy(day).agg(F.max("volume").alias("a")).join(second.groupBy(day).agg(F.max("volume").alias("b")), day)
    w = Window.orderBy(day)  # one row a day
    ratio = F.least(F.lit(most), F.lag(F.try_divide("a", "b")).over(w))
    return total.select(day, F.coalesce(ratio, F.lit(1.0)).alias("multiplier"))


def median_multiplier(df: DataFrame, value: str, keys: list[str], day: str = "trade_day", low: float = 0.0, high: float = 5.0, raised: float = 5.0) -> DataFrame:
    """(keys, day, multiplier): ``raised`` where the day before's median lies between the limits, else 1."""
    daily = df.groupBy(*keys, day).agg(F.median(value).alias("m"))
    before = F.lag("m").over(Window.partitionBy(*keys).orderBy(day))
    return daily.select(*keys, day, F.when((before > low) & (before < high), raised).otherwise(1.0).alias("multiplier"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The last row of ``right`` at or before each row of ``left``: one union and one window, no pair join."""
    row = F.monotonically_increasing_id()
    a = left.withColumn("_side", F.lit(1)).withColumn("_row", row)
    b = right.select(*keys, time, F.struct(*columns).alias("_from")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_from", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, *[F.col(f"_last.{c}").alias(f"{c}_asof") for c in columns])


def back_adjusted(days: DataFrame, keys: list[str], day: str, close: str = "close", presettle: str = "presettle") -> DataFrame:
    """``days`` (a row a day of the stitched main contract) with factor: the product of later days' presettle over the close before.

    Multiplying a day's prices by its factor takes the jumps of rolls out of the series; the last day has 1.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    rows = days.withColumn("_r", F.ln(F.try_divide(F.col(presettle), F.lag(close).over(w))))
    later = Window.partitionBy(*keys).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("factor", F.exp(F.coalesce(F.sum("_r").over(later), F.lit(0.0)))).drop("_r")
