"""Trading sessions: flags, decay since the session's start, impulse after an opening, trading hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def second_of_day(ts: Column | str) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def flags(ts: Column | str) -> dict[str, Column]:
    """is_night (from 21:00 or before 08:00), is_am [09:00, 11:30), is_pm [13:30, 15:00]."""
    s = second_of_day(ts)
    one = lambda c: F.when(c, 1).otherwise(0)
    return {"is_night": one((s >= 21 * 3600) | (s < 8 * 3600)), "is_am": one((s >= 9 * 3600) & (s < 41400)), "is_pm": one((s >= 48600) & (s <= 54000))}


def minutes_since_start(ts: Column | str) -> Column:
    """Minutes since the running session began; 9999 between sessions."""
    s = second_of_day(ts)
    return (
        F.when(s >= 75600, (s - 75600) / 60)
        .when(s < 28800, (s + 10800) / 60)
        .when((s >= 32400) & (s < 41400), (s - 32400) / 60)
        .when((s >= 48600) & (s <= 54000), (s - 48600) / 60)
        .otherwise(9999.0)
    )


def session_decay(ts: Column | str) -> Column:
    return 1 / F.sqrt(minutes_since_start(ts) + 1)


def open_impulse(ts: Column | str, width: float = 10.0) -> Column:
    """exp(-m^2 / 2 width^2) of the minutes since the last opening; the morning reopens at 10:30."""
    s = second_of_day(ts)
    m = F.when((s >= 37800) & (s < 41400), (s - 37800) / 60).otherwise(minutes_since_start(ts))
    return F.exp(-m * m / (2 * width * width))


def with_session(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({**flags(ts), "session_decay": session_decay(ts), "open_impulse": open_impulse(ts)})


def trading_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows from 21:00, before 15:00, or of 15:00 sharp, with ``session_second``: a night comes before its day."""
    s = second_of_day(ts)
    return df.where((s >= 75600) | (s <= 54000)).withColumn("session_second", F.when(s >= 64800, s).otherwise(s + 86400))


def time_of_day_mean(df: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """Mean of a value by the time of day (HH:MM:SS) over all days."""
    return df.groupBy(F.date_format(ts, "HH:mm:ss").alias("time_of_day")).agg(F.avg(value).alias(f"mean_{value}"))
