"""Recursive indicators and state machines over ordered ticks.

They cannot be said with frames, so each key's rows (one contract and day, so a bounded number) go to
``applyInPandas`` in order; keys are spread over tasks like any grouping.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """2/(span+1) smoothing that starts at the first value; a NaN restarts it."""
    out, a = np.full(len(x), np.nan), 2 / (span + 1)
    for i, v in enumerate(x):
        out[i] = v if i == 0 or np.isnan(out[i - 1]) else a * v + (1 - a) * out[i - 1]
    return out


def rma(x: np.ndarray, window: int) -> np.ndarray:
    """1/window smoothing seeded with the mean of the first ``window`` values."""
    out = np.full(len(x), np.nan)
    if len(x) >= window:
        out[window - 1] = x[:window].mean()
        for i in range(window, len(x)):
            out[i] = (out[i - 1] * (window - 1) + x[i]) / window
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal line and histogram."""
    line = ema(x, fast) - ema(x, slow)
    return line, (s := ema(line, signal)), line - s


def rsi(x: np.ndarray, window: int = 14) -> np.ndarray:
    """Wilder's index; the first change counts as 0, no losses as 100; NaN before ``window`` rows."""
    step = np.diff(x, prepend=x[:1])
    gain, loss = rma(np.maximum(step, 0), window), rma(np.maximum(-step, 0), window)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))


def kdj(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 9, m1: int = 3, m2: int = 3) -> np.ndarray:
    """J of the stochastic oscillator; a flat frame counts as 50."""
    top, bottom = pd.Series(high).rolling(n).max().to_numpy(), pd.Series(low).rolling(n).min().to_numpy()
    out, k, d = np.full(len(close), np.nan), np.nan, np.nan
    for i in range(n - 1, len(close)):
        rsv = 50.0 if top[i] == bottom[i] else (close[i] - bottom[i]) / (top[i] - bottom[i]) * 100
        k = rsv if np.isnan(k) else (k * (m1 - 1) + rsv) / m1
        d = k if np.isnan(d) else (d * (m2 - 1) + k) / m2
        out[i] = 3 * k - 2 * d
    return out


def ewm_mean(x: np.ndarray, alpha: float, adjust: bool = True) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=adjust).mean().to_numpy()


def ewm_std(x: np.ndarray, span: int, least: int = 2) -> np.ndarray:
    return pd.Series(x).ewm(span=span, min_periods=least).std().to_numpy()


def ewm_skew(x: np.ndarray, span: int) -> np.ndarray:
    """Third moment over deviation, by three weighted means one after the other."""
    s = pd.Series(x)
    mean = s.ewm(span=span).mean()
    var = ((s - mean) ** 2).ewm(span=span).mean()
    third = ((s - mean) ** 3).ewm(span=span).mean()
    return (third / var.where(var > 0) ** 1.5).to_numpy()


def adaptive_mean(x: np.ndarray, vol: np.ndarray, base: int = 120, least: int = 10, most: int | None = None) -> np.ndarray:
    """Mean of the last N values, N longer where volatility is below its mean."""
    most = most or 5 * base
    target = np.nanmean(vol) if len(vol) and not np.isnan(vol).all() else 1.0
    target = target or 1.0
    n = np.where(vol <= 1e-8, most, np.clip(np.round(base * target / np.maximum(vol, 1e-8)), least, most)).astype(int)
    total = np.concatenate([[0], np.cumsum(x)])
    i = np.arange(len(x))
    start = np.maximum(0, i - n + 1)
    return (total[i + 1] - total[start]) / (i + 1 - start)


def elasticity(price: np.ndarray, depth: np.ndarray, alpha: float = 0.2) -> np.ndarray:
    """Change of depth over the size of the smoothed price change."""
    smooth = np.abs(ewm_mean(np.diff(price, prepend=np.nan), alpha))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.diff(depth, prepend=np.nan) / smooth
    return np.where(np.isfinite(out), out, np.nan)


def rescaled_ranges(x: np.ndarray, size: int) -> list[float]:
    """R/S of each whole segment that is not constant."""
    parts = [x[i : i + size] for i in range(0, len(x) - size + 1, size)]
    return [np.ptp(np.cumsum(p - p.mean())) / p.std() for p in parts if p.std() > 0]


def hurst_slope(x: np.ndarray, sizes=(10, 20, 50, 100)) -> float:
    """Slope of log mean R/S over log size, by segments."""
    logs = []
    for n in sizes:
        if rs := rescaled_ranges(x, n):
            logs.append((np.log(n), np.log(np.mean(rs))))
    return float(np.polyfit(*zip(*logs, strict=True), 1)[0]) if len(logs) > 1 else float("nan")


def per_key(df: DataFrame, keys: list[str], order: list[str], made: dict[str, Callable[[pd.DataFrame], np.ndarray]], kinds: dict[str, str] | None = None) -> DataFrame:
    """``df`` with columns made from each key's rows in order; NaN becomes NULL."""
    kinds = kinds or {}
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(kinds.get(n, "double"))) for n in made]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        return rows.assign(**{n: pd.Series(f(rows), dtype="object").where(lambda s: s.notna(), None) for n, f in made.items()})

    return df.groupBy(*keys).applyInPandas(run, schema)


def hurst_slopes(df: DataFrame, key: str, day: str, order: list[str], value: str, sizes=(10, 20, 50, 100)) -> DataFrame:
    """(key, hurst, n): ``hurst_slope`` of each key's rows over all days, whose segments may span days.

    A row's number is its place in its day and the rows of the days before (``order`` has to run with the
    day).  Rows go on in blocks that hold whole segments of each size; means and slope are Spark's.
    """
    block = math.lcm(*sizes)
    last = [F.col(c).asc_nulls_last() for c in order]
    rows = df.select(key, day, *order, value)
    days = rows.groupBy(F.col(key).alias("_key"), F.col(day).alias("_day")).agg(F.count("*").alias("_count"))
    days = days.select("_key", "_day", F.sum("_count").over(Window.partitionBy("_key").orderBy(F.col("_day").asc_nulls_last())).alias("_upto"), "_count")
    place = F.row_number().over(Window.partitionBy(key, day).orderBy(*last)) - 1
    numbered = rows.withColumn("_place", place).join(days, F.col(key).eqNullSafe(F.col("_key")) & F.col(day).eqNullSafe(F.col("_day")))
    numbered = numbered.select(key, (F.col("_place") + F.col("_upto") - F.col("_count")).alias("_at"), F.col(value).cast("double").alias("_value"))
    blocks = numbered.groupBy(key, F.floor(F.col("_at") / block).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_rows")).select(key, F.col("_rows._value").alias("_values"))

    def run(batches):
        for b in batches:
            x = [np.asarray(v, float) for v in b.column(1).to_pylist()]
            rs = [[rescaled_ranges(v, n) for n in sizes] for v in x]
            kinds = pa.list_(pa.struct([("size", pa.int64()), ("total", pa.float64()), ("parts", pa.int64())]))
            of = pa.array([[{"size": n, "total": float(sum(p)), "parts": len(p)} for n, p in zip(sizes, r, strict=True)] for r in rs], kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in x], pa.int64()), of], names=[key, "_n", "_of"])

    schema = T.StructType([df.schema[key], *T._parse_datatype_string("_n long, _of array<struct<size: long, total: double, parts: long>>").fields])
    sums = blocks.mapInArrow(run, schema).select(key, "_n", F.inline("_of")).groupBy(key, "size").agg(F.sum("_n").alias("_n"), F.sum("total").alias("total"), F.sum("parts").alias("parts"))
    mean = F.when(F.col("parts") > 0, F.log(F.col("total") / F.col("parts")))
    slope = F.when(F.count(mean) > 1, F.regr_slope(mean, F.log(F.col("size").cast("double"))))
    return sums.groupBy(key).agg(slope.alias("hurst"), F.max("_n").alias("n"))


def day_machine(signal, ask, bid, threshold: float, commission: float = 0.0) -> tuple[float, int, int]:
    """PnL and trades of one day: in beyond the threshold, out when the signal turns, flat at the end."""
    position, pnl, entry, trades = 0, 0.0, 0.0, [0, 0]
    for s, a, b in zip(signal, ask, bid, strict=True):
        if position == 0 and abs(s) > threshold:
            position = 1 if s > 0 else -1
            entry = a if s > 0 else b
            pnl -= entry * commission
            trades[int(s < 0)] += 1
        elif position and position * s <= 0:
            out = b if position > 0 else a
            pnl += position * (out - entry) - out * commission
            position = 0
    if position:
        out = bid[-1] if position > 0 else ask[-1]
        pnl += position * (out - entry) - out * commission
    return pnl, trades[0], trades[1]


def backtest_days(df: DataFrame, keys: list[str], order: list[str], threshold: float, commission: float = 0.0, signal: str = "signal", ask: str = "ap1", bid: str = "bp1") -> DataFrame:
    """(keys, pnl, long_trades, short_trades) of each day; null signals count as 0."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("pnl", T.DoubleType()), T.StructField("long_trades", T.LongType()), T.StructField("short_trades", T.LongType())])

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return pd.DataFrame([[*key, *day_machine(rows[signal].fillna(0).to_numpy(), rows[ask].to_numpy(), rows[bid].to_numpy(), threshold, commission)]], columns=schema.names)

    return df.select(*keys, *order, signal, ask, bid).groupBy(*keys).applyInPandas(run, schema)


def spaced(rows: np.ndarray, gap: int) -> np.ndarray:
    """Of ascending row numbers the first, and each more than ``gap`` after the last that was kept."""
    keep, last = np.zeros(len(rows), bool), None
    for i, r in enumerate(rows):
        if last is None or r - last > gap:
            keep[i], last = True, r
    return keep
