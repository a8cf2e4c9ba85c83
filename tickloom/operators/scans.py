"""Recursions y = a * y_before + b over any number of ordered rows, as scans of affine maps.

Rows of a key are cut into blocks of ``SIZE`` by their number.  Within a block each row gets the map of all rows from
the block's first one on, by doubling: log2(SIZE) windows over one shuffle and sort.  The maps of the blocks' last rows
are rows of a table ``SIZE`` times smaller, whose states are worked out the same way.  The state at a block's end is
the next block's entry, which its rows' maps are applied to.  So no task ever holds more than a block of a key, work
per row is constant, and a contract of n rows needs log(n) / log(SIZE) rounds, each a shuffle of a table that much
smaller than the one before.

A row with a = 0 begins anew whatever came before, also after NULL; NULL states stay NULL until such a row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import compute, dealt

SIZE = 512


def _step(a: str, b: str, y: str) -> str:
    return f"CASE WHEN {a} = 0 THEN {b} ELSE {a} * {y} + {b} END"


def _states(rows: DataFrame, n: int, last: int, size: int) -> DataFrame:
    """``rows`` (_key, _at, _a0, _b0, ..., others) with the states _b0 to _b(n-1) behind each row instead of its maps."""
    rows = dealt(rows.withColumn("_block", F.floor(F.col("_at") / size)), ["_key", "_block"])
    h = 1
    while h < min(size, last):  # maps of h rows and of the h rows before them make those of 2 * h rows
        maps = F.struct(*[f"_{c}{k}" for k in range(n) for c in "ab"])
        rows = rows.withColumn("_before", F.lag(maps, h).over(Window.partitionBy("_key", "_block").orderBy("_at")))
        both = {f"_{c}{k}": f"CASE WHEN _before IS NULL OR _a{k} = 0 THEN _{c}{k} ELSE {f'_a{k} * _before._a{k}' if c == 'a' else _step(f'_a{k}', f'_b{k}', f'_before._b{k}')} END" for k in range(n) for c in "ab"}
        rows = rows.selectExpr(*[f"`{c}`" for c in rows.columns if c not in {"_before", *both}], *[f"{text} AS {name}" for name, text in both.items()])
        h *= 2
    if last > size:
        # a whole block's map is that of its last row
        ends = rows.where(F.col("_at") % size == size - 1).select("_key", F.col("_block").alias("_at"), *[f"_{c}{k}" for k in range(n) for c in "ab"])
        ends = _states(ends, n, -(-last // size), size).select("_key", (F.col("_at") + 1).alias("_block"), F.struct(*[f"_b{k}" for k in range(n)]).alias("_entry"))
        rows = rows.join(ends, ["_key", "_block"], "left")
    else:
        rows = rows.withColumn("_entry", F.expr(f"CAST(NULL AS struct<{', '.join(f'_b{k}: double' for k in range(n))}>)"))
    done = [f"{_step(f'_a{k}', f'_b{k}', f'_entry._b{k}')} AS _b{k}" for k in range(n)]
    return rows.selectExpr(*[f"`{c}`" for c in rows.columns if c not in {"_block", "_entry", *[f"_{c}{k}" for k in range(n) for c in "ab"]}], *done)


def affine_scan(df: DataFrame, keys: Iterable[str], row: str, maps: dict[str, tuple[str, str]], size: int = SIZE) -> DataFrame:
    """``df`` with a column for each of ``maps``: the state y = a * y_before + b at each row, a and b as SQL texts.

    ``row`` numbers each key's rows from 0 in their order.  A key's rows may be any number; its first state is b
    where a is 0, else NULL.
    """
    keys, names = list(keys), list(maps)
    last = df.agg(F.max(row)).first()[0]
    both = [F.expr(f"CAST({t} AS DOUBLE)").alias(f"_{c}{k}") for k, m in enumerate(maps.values()) for c, t in zip("ab", m, strict=True)]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    # a struct is never NULL, and equal to others with NULL in the same places
    rows = df.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"), F.col(row).cast("long").alias("_at"), *own, *both)
    done = _states(rows, len(names), (last or 0) + 1, size)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(f"_b{k}").alias(n) for k, n in enumerate(names)])


def day_rows(df: DataFrame, keys: list[str], order: list[str], row: str = "row_at") -> DataFrame:
    """``df`` with each row's number in its day, from 0; ``keys`` hold the day."""
    return df.withColumn(row, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


# --- indicators -----------------------------------------------------------------------------------------------


def ema_map(x: str, before: str, span: int) -> tuple[str, str]:
    """2/(span+1) smoothing that starts at the first value, and anew behind an unknown one."""
    a = 2 / (span + 1)
    return f"CASE WHEN {before} IS NULL THEN 0D ELSE {1 - a!r}D END", f"CASE WHEN {before} IS NULL THEN {x} ELSE {a!r}D * {x} END"


def wilder_map(x: str, mean: str, row: str, k: int) -> tuple[str, str]:
    """1/k smoothing from the ``mean`` of the first k values."""
    return f"CASE WHEN {row} >= {k} THEN {(k - 1) / k!r}D ELSE 0D END", f"CASE WHEN {row} >= {k} THEN {x} / {k} WHEN {row} = {k - 1} THEN {mean} END"


def weight_maps(x: str, alpha: float) -> dict[str, tuple[str, str]]:
    """Sums of exponential weights w, of their squares v, and of weighted values s and squares t; unknown values keep their places."""
    q = 1 - alpha
    one = f"CASE WHEN {x} IS NULL THEN 0D ELSE 1D END"
    first = lambda q: f"CASE WHEN row_at = 0 THEN 0D ELSE {q!r}D END"
    return {"w": (first(q), one), "v": (first(q * q), one), "s": (first(q), f"coalesce({x}, 0D)"), "t": (first(q), f"coalesce({x} * {x}, 0D)")}


def macd(df: DataFrame, keys: list[str], order: list[str], x: str, spans: dict[str, tuple[int, int]], signal: int = 9, row: str = "row_at") -> DataFrame:
    """Of each name of ``spans`` the difference of a fast and a slow mean, its own mean (``_signal``) and what is between them (``_histogram``)."""
    df = compute(df, {"_before": lambda s: s.lag(x)}, ["_before"], keys, order)
    maps = {f"_{part}_{n}": ema_map(x, "_before", k) for n, both in spans.items() for part, k in zip(("fast", "slow"), both, strict=True)}
    df = affine_scan(df, keys, row, maps)
    df = df.select("*", *[F.expr(f"_fast_{n} - _slow_{n}").alias(n) for n in spans]).drop(*maps)
    df = affine_scan(df, keys, row, {f"{n}_signal": ema_map(n, "_before", signal) for n in spans})
    return df.select("*", *[F.expr(f"{n} - {n}_signal").alias(f"{n}_histogram") for n in spans]).drop("_before")


def rsi(df: DataFrame, keys: list[str], order: list[str], x: str, windows: dict[str, int], row: str = "row_at") -> DataFrame:
    """Wilder's index; the first change counts as 0, no losses as 100; NULL before a window's rows."""
    book = {"_gain": lambda s: f"greatest(coalesce({s.diff(x)}, 0), 0)", "_loss": lambda s: f"greatest(coalesce(-{s.diff(x)}, 0), 0)"}
    book |= {f"_{part}_{k}": lambda s, part=part, k=k: s.mean(f"_{part}", k) for k in windows.values() for part in ("gain", "loss")}
    df = compute(df, book, list(book), keys, order)
    maps = {f"_{part}s_{k}": wilder_map(f"_{part}", f"_{part}_{k}", row, k) for k in windows.values() for part in ("gain", "loss")}
    df = affine_scan(df, keys, row, maps)
    out = [F.expr(f"CASE WHEN _losss_{k} = 0 THEN 100 ELSE 100 - 100 / (1 + _gains_{k} / _losss_{k}) END").alias(n) for n, k in windows.items()]
    return df.select("*", *out).drop(*book, *maps)


def kdj(df: DataFrame, keys: list[str], order: list[str], high: str, low: str, close: str, n: int = 9, m1: int = 3, m2: int = 3, row: str = "row_at") -> DataFrame:
    """``kdj``: J of the stochastic oscillator; a flat frame counts as 50."""
    book = {"_top": lambda s: s.max(high, n), "_bottom": lambda s: s.min(low, n), "_rsv": lambda s: f"CASE WHEN _top = _bottom THEN 50D ELSE ({close} - _bottom) / (_top - _bottom) * 100 END"}
    df = compute(df, book, list(book), keys, order)
    df = affine_scan(df, keys, row, {"_k": wilder_map("_rsv", "_rsv", f"{row} - {n - m1}", m1)})
    df = affine_scan(df, keys, row, {"_d": wilder_map("_k", "_k", f"{row} - {n - m2}", m2)})
    return df.withColumn("kdj", F.expr("3 * _k - 2 * _d")).drop(*book, "_k", "_d")


def rma(df: DataFrame, keys: list[str], order: list[str], x: str, k: int, row: str = "row_at") -> DataFrame:
    """``rma``: 1/k smoothing seeded with the mean of the first k values."""
    df = compute(df, {"_mean": lambda s: s.mean(x, k)}, ["_mean"], keys, order)
    return affine_scan(df, keys, row, {"rma": wilder_map(x, "_mean", row, k)}).drop("_mean")


def weighted_moments(df: DataFrame, keys: list[str], order: list[str], x: str, alpha: float, row: str = "row_at") -> DataFrame:
    """``ewm_mean``, ``ewm_std`` (bias-corrected), ``ewm_skew`` with weights that decay by 1 - alpha a row, over all rows so far.

    Values are taken from the key's first one, so squares stay small; the skew is the mean of third powers over
    that of second ones, each by a scan of its own over deviations from the running mean.
    """
    first = df.where(F.col(row) == 0).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(x), F.lit(0.0)).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    df = df.join(first, same).withColumn("_x", F.expr(f"{x} - _first"))
    df = affine_scan(df, keys, row, {f"_{n}": m for n, m in weight_maps("_x", alpha).items()})
    df = df.select("*", F.expr("_s / nullif(_w, 0)").alias("_mean"))
    std = "CASE WHEN _w * _w > _v * (1 + 1e-12) THEN sqrt(greatest(_t / _w - _mean * _mean, 0) * _w * _w / (_w * _w - _v)) END"
    df = df.select("*", F.expr("_mean + _first").alias("ewm_mean"), F.expr(std).alias("ewm_std"), F.expr("power(_x - _mean, 2)").alias("_2"), F.expr("power(_x - _mean, 3)").alias("_3"))
    decay = f"CASE WHEN {row} = 0 THEN 0D ELSE {1 - alpha!r}D END"
    df = affine_scan(df, keys, row, {"_var": (decay, "coalesce(_2, 0D)"), "_third": (decay, "coalesce(_3, 0D)")})
    skew = "CASE WHEN _var > 0 THEN _third / _w / power(_var / _w, 1.5) END"
    return df.withColumn("ewm_skew", F.expr(skew)).drop("_first", "_x", "_w", "_v", "_s", "_t", "_mean", "_2", "_3", "_var", "_third", *[f"_k{i}" for i in range(len(keys))])
