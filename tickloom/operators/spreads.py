"""Aggregates of spreads over time: exponential, by volume, and over frames as long as volatility allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import compute
from .scans import affine_scan, ema_map


def adaptive_means(df: DataFrame, keys: list[str], row: str, vol: str, columns: dict[str, tuple[str, int]], least: int = 10) -> DataFrame:
    """``df`` with, for each name of ``columns``, the mean of the last N values of a column, from its key's first row on.

    N is base times the key's mean volatility over the row's own (5 * base where that is next to nothing), between
    ``least`` and 5 * base.  Sums so far are looked up at each frame's beginning by row number, so work per row does
    not grow with N.  Unknown values count as 0 and keep their places; rows are numbered from 0 by ``row``.
    """
    target = df.groupBy(*keys).agg(F.avg(vol).alias("_target"))
    same = lambda a, b: F.lit(True) if not keys else _equal(a, b, keys)
    target = target.toDF(*[f"_k{i}" for i in range(len(keys))], "_target")
    rows = df.join(target, same(df, target)).drop(*[f"_k{i}" for i in range(len(keys))])
    w = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.coalesce(F.nullif(F.col("_target"), F.lit(0.0)), F.lit(1.0))
    for k, (x, base) in enumerate(columns.values()):
        n = F.when(F.col(vol) <= 1e-8, F.lit(5 * base)).otherwise(F.greatest(F.lit(least), F.least(F.lit(5 * base), F.rint(base * scale / F.col(vol)))))
        rows = rows.withColumns({f"_s{k}": F.sum(F.coalesce(F.col(x).cast("double"), F.lit(0.0))).over(w), f"_from{k}": F.greatest(F.col(row) - n, F.lit(-1)).cast("long")})
    sums = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(row).alias("_at"), *[F.col(f"_s{k}").alias(f"_b{k}") for k in range(len(columns))])
    for k, name in enumerate(columns):
        before = sums.select(*[f"_k{i}" for i in range(len(keys))], "_at", f"_b{k}")
        rows = rows.join(before, same(rows, before) & (rows[f"_from{k}"] == before["_at"]), "left").drop("_at", *[f"_k{i}" for i in range(len(keys))])
        rows = rows.withColumn(name, (F.col(f"_s{k}") - F.coalesce(F.col(f"_b{k}"), F.lit(0.0))) / (F.col(row) - F.col(f"_from{k}"))).drop(f"_b{k}")
    return rows.drop("_target", *[f"_{c}{k}" for k in range(len(columns)) for c in ("s", "from")])


def _equal(a: DataFrame, b: DataFrame, keys: list[str]):
    out = F.lit(True)
    for i, k in enumerate(keys):
        out &= a[k].eqNullSafe(b[f"_k{i}"])
    return out


def decayed_means(df: DataFrame, keys: list[str], order: list[str], row: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with, for each name of ``columns``, a column's mean of 2/(span+1) smoothing, begun at its first value."""
    before = {f"_before_{x}": lambda s, x=x: s.lag(x) for x, _ in columns.values()}
    df = compute(df, before, list(before), keys, order)
    return affine_scan(df, keys, row, {n: ema_map(x, f"_before_{x}", span) for n, (x, span) in columns.items()}).drop(*before)


def volume_means(df: DataFrame, keys: list[str], order: list[str], volume: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with, for each name of ``columns``, a column's mean over the last k rows by volume; NULL without volume."""
    book = {n: lambda s, x=x, k=k: s.div(s.sum(f"{x} * {volume}", k, 1), f"CASE WHEN {s.sum(volume, k, 1)} > 0 THEN {s.sum(volume, k, 1)} END") for n, (x, k) in columns.items()}
    return compute(df, book, list(book), keys, order)
