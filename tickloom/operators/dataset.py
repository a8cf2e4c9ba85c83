"""Labels and data sets: barriers, regimes, splits, scaling, sampling, windows as arrays, augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import compute, numbered, over_rows
from .order_stats import Quantile, frame_order, with_rows


def triple_barrier(price: str, keys: list[str], order: list[str], rows: int = 10, up: float = 0.002, down: float = 0.002) -> Column:
    """1 if the upper barrier is touched first within ``rows`` rows, -1 for the lower, else 0; on one row the upper counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.lit(0)
    for k in range(rows, 0, -1):
        ahead = F.lead(price, k).over(w)
        out = F.when(ahead >= F.col(price) * (1 + up), 1).when(ahead <= F.col(price) * (1 - down), -1).otherwise(out)
    return out


def dynamic_label(df: DataFrame, price: str, keys: list[str], order: list[str], ahead: int = 10, window: int = 240, least: int = 10, pieces: tuple[str, ...] = ("trade_day",)) -> DataFrame:
    """``df`` with forward return and label: 1 or -1 beyond the 95 % or 5 % quantile of the ``window`` returns known at the row before."""
    rows = with_rows(df, keys, order, pieces, "_row")
    book = {"forward": lambda s: f"{s.div(s.lead(price, ahead), price)} - 1", "_known": lambda s: s.lag("forward", ahead + 1)}
    rows = compute(rows, book, list(book), keys, order, pieces, "_row")
    rows = frame_order(rows, keys, order, {"_hi": Quantile("_known", 0.95, window, least), "_lo": Quantile("_known", 0.05, window, least)}, pieces, "_row")
    return rows.withColumn("label", F.when(F.col("forward") > F.col("_hi"), 1).when(F.col("forward") < F.col("_lo"), -1).otherwise(0)).drop("_known", "_hi", "_lo", "_row")


def day_regimes(days: DataFrame, day: str, ret: str, volume: str, window: int = 5, q: float = 0.7) -> DataFrame:
    """``days`` with regime 1 to 4: of moves and volume of the days before, both, one or none over their quantile."""
    w = Window.orderBy(day)  # a row a day
    frame = w.rowsBetween(-(window - 1), 0)
    full = lambda c: F.when(F.count(c).over(frame) >= window, F.avg(c).over(frame))
    rows = days.withColumn("_m", full(F.abs(ret))).withColumn("_v", full(F.col(volume)))
    rows = rows.withColumn("_m", F.lag("_m").over(w)).withColumn("_v", F.lag("_v").over(w))
    cuts = rows.agg(F.percentile("_m", q).alias("_qm"), F.percentile("_v", q).alias("_qv"))
    moved, heavy = F.col("_m") > F.col("_qm"), F.col("_v") > F.col("_qv")
    out = rows.crossJoin(F.broadcast(cuts)).withColumn("regime", F.when(F.col("_m").isNull() | F.col("_v").isNull(), None).when(moved & heavy, 1).when(moved, 2).when(heavy, 3).otherwise(4))  # one row
    return out.drop("_m", "_v", "_qm", "_qv")


def split_by_day(df: DataFrame, day: str, first_test_day: str) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(first_test_day).cast("date")
    return df.where(F.col(day) < cut), df.where(F.col(day) >= cut)


def split_last_days(df: DataFrame, day: str, n: int = 14) -> tuple[DataFrame, DataFrame]:
    """All but the last n days, and those; the n days are looked up first, so no global sort of the rows."""
    last = df.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return df.join(F.broadcast(last), day, "left_anti"), df.join(F.broadcast(last), day, "left_semi")


def standardised(df: DataFrame, fit: DataFrame, columns: list[str], sample: bool = True, most: float | None = 3.0) -> DataFrame:
    """z-scores by the moments of ``fit`` (ddof 1, or 0 with ``sample`` off), non-finite as NULL, clipped to +-most."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = fit.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[sd(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for i, c in enumerate(columns):
        z = F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}"))
        out = out.withColumn(c, F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(most)), F.lit(-most))) if most else z)
    return out.select(*df.columns)


def context_map(x: Column, most: float = 3.0) -> Column:
    """NULL as 0, clipped, then the logistic function."""
    v = F.greatest(F.least(F.coalesce(x, F.lit(0.0)), F.lit(most)), F.lit(-most))
    return 1 / (1 + F.exp(-v))


def sampled(df: DataFrame, keys: list[str], order: list[str], stride: int = 60, offset: int = 59, pieces: tuple[str, ...] = ("trade_day",)) -> DataFrame:
    """Every ``stride``-th row of each key from row ``offset`` (counted from 0) on, by place and not by time."""
    if set(pieces) & set(keys) or not set(pieces) <= set(df.columns):
        rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        rows = numbered(df, list(keys), list(pieces), list(order), "_n")
    return rows.where((F.col("_n") >= offset) & ((F.col("_n") - offset) % stride == 0)).drop("_n")


def rolling_means(df: DataFrame, columns: list[str], keys: list[str], order: list[str], window: int = 120) -> DataFrame:
    """``df`` with each column's mean over the last ``window`` rows, NULL before."""

    def means(rows: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        return rows.withColumns({f"{c}_mean{window}": F.when(F.count(c).over(frame) >= window, F.avg(c).over(frame)) for c in columns})

    return over_rows(df, keys, order, window, 0, means)


def windows_as_arrays(df: DataFrame, columns: list[str], keys: list[str], order: list[str], length: int, dilation: int = 1, pad: bool = True) -> DataFrame:
    """``df`` with sequence: each row's last ``length`` rows (every ``dilation``-th), the first row repeated where there are fewer.

    Without ``pad`` rows with too little before them are left out.
    """
    reach = (length - 1) * dilation
    w = Window.partitionBy(*keys).orderBy(*order)
    got = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w.rowsBetween(-reach, 0))
    rows = df.withColumn("_w", got)
    if not pad:
        rows = rows.where(F.size("_w") == reach + 1)
    full = F.concat(F.array_repeat(F.element_at("_w", 1), F.lit(reach + 1) - F.size("_w")), F.col("_w"))
    return rows.withColumn("sequence", F.filter(full, lambda _, i: i % dilation == 0)).drop("_w")


def beta_quantiles(shape: float, n: int = 1000) -> list[float]:
    """Quantiles 0, 1/n, ... 1 of Beta(shape, shape), by its density over equal steps of the angle."""
    angle = (np.arange(200_000) + 0.5) / 200_000 * np.pi / 2
    x = np.sin(angle) ** 2
    mass = np.cumsum((np.sin(angle) * np.cos(angle)) ** (2 * shape - 1))
    return [0.0, *np.interp(np.arange(1, n) / n, mass / mass[-1], x).tolist(), 1.0]


def mixup(df: DataFrame, columns: list[str], keys: list[str], ids: list[str] | None = None, shape: float = 1.0, seed: int = 0, part_rows: int = 100_000) -> DataFrame:
    """``df`` and as many convex pairs of neighbours in a random order of each key; the share is Beta(shape, shape).

    Order and shares come from hashes of ``ids`` (all columns by default), so a repeated run gives the same pairs; a key's rows are dealt
    out to parts of about ``part_rows``, and pairs are made inside of a part.
    """
    ids = ids or df.columns
    parts = max(1, -(-df.count() // part_rows))
    place = F.xxhash64(*ids, F.lit(seed))
    w = Window.partitionBy(*keys, F.pmod(F.xxhash64(*ids, F.lit(seed + 1)), F.lit(parts))).orderBy(place, *ids)
    at = F.pmod(F.xxhash64(*ids, F.lit(seed + 2)), F.lit(1 << 50)) / float(1 << 50) * 1000
    table = F.array(*[F.lit(v) for v in beta_quantiles(shape)])
    low = F.floor(at).cast("int")
    share = F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low)
    rows = df.withColumn("_share", share).withColumns({f"_n_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in columns})
    mixed = rows.select(*[(F.col("_share") * F.col(c) + (1 - F.col("_share")) * F.col(f"_n_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
    return df.withColumn("mixed", F.lit(False)).unionByName(mixed.withColumn("mixed", F.lit(True)))


def corrupted(df: DataFrame, columns: list[str], noise: float, seed: int = 0) -> DataFrame:
    """Gaussian noise on the columns."""
    return df.withColumns({c: F.col(c) + noise * F.randn(seed + i) for i, c in enumerate(columns)})


def vol_regime(forecast: Column, limit: float = 0.00085) -> Column:
    """hv where the forecast volatility is over the limit, lv up to it, NULL without one."""
    return F.when(forecast > limit, "hv").when(forecast <= limit, "lv")
