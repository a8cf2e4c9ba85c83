"""Queries of order statistics of frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.factors import compute
from ..operators.order_stats import Quantile, Rank, frame_order
from .factor_queries import DAY, ORACLE as _FACTOR_SQL, PRIMITIVE
from .tables import CONTRACT, ORDER, TICKS_SQL, numbered_ticks, ticks


def ts_rank(spark, sf_dir):
    """A value's place among those of its last 30 ticks of a day."""
    t = compute(ticks(spark, sf_dir), PRIMITIVE, ["x"], DAY, ORDER)
    return frame_order(t, DAY, ORDER, {"rank_30_5": Rank("x", 30, 5)}).select("contract", "event_id", F.round("rank_30_5", 7).alias("rank_30_5"))


_LONG = {"rank_240": Rank("x", 240, 20), "median_240": Quantile("x", 0.5, 240, 20), "q05_600": Quantile("x", 0.05, 600, 10), "q95_1200": Quantile("x", 0.95, 1200, 1)}


def long_order_stats(spark, sf_dir):
    """Ranks and quantiles of up to 1,200 ticks of a contract, over days."""
    t = compute(numbered_ticks(spark, sf_dir), PRIMITIVE, ["x"], CONTRACT, ORDER)
    return frame_order(t, CONTRACT, ORDER, _LONG).select("event_id", *[F.round(n, 6).alias(n) for n in _LONG])


def _long_sql() -> str:
    over = lambda k: f"OVER (PARTITION BY contract ORDER BY ts, event_id ROWS {k - 1} PRECEDING)"
    rank = f"CASE WHEN x IS NULL OR count(x) {over(240)} < 20 THEN NULL WHEN max(x) {over(240)} = min(x) {over(240)} THEN 0.5 ELSE least((len(list_filter(list(x) {over(240)}, lambda v: v < x)) + 0.5) / (count(x) {over(240)} - 1), 1) END"
    cuts = [f"round(CASE WHEN count(x) {over(w.rows)} >= {w.least} THEN quantile_cont(x, {w.q}) {over(w.rows)} END, 6) AS {n}" for n, w in _LONG.items() if isinstance(w, Quantile)]
    return f"SELECT event_id, round(CAST({rank} AS DOUBLE), 6) AS rank_240, {', '.join(cuts)} FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL ELSE last / 100 END AS x FROM ({TICKS_SQL}))"


QUERIES = {"ts_rank": ts_rank, "long_order_stats": long_order_stats}
ORACLE = {"ts_rank": _FACTOR_SQL["ts_rank"], "long_order_stats": _long_sql()}
