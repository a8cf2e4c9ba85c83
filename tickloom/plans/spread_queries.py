"""Queries of spreads aggregated over time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.factors import compute
from ..operators import scans, spreads
from .factor_queries import FACTORS
from .tables import BOOK_COLUMNS, ORDER, TICKS_SQL, levelled, ticks

DAY = ["contract", "trade_day"]
NEEDED = ["final_spread", "impact_skew", "mid", "delta_volume"]
_PLAN, _SQL, _, _ = FACTORS["final_spread"]
_O = "PARTITION BY contract, trade_day ORDER BY ts, event_id"
_T = f"""r AS (SELECT *, row_number() OVER ({_O}) AS n, coalesce(mid / nullif(lag(mid) OVER ({_O}), 0) - 1, 0) AS ret FROM ({levelled(TICKS_SQL, _SQL, NEEDED, BOOK_COLUMNS, DAY)})),
t AS MATERIALIZED (SELECT contract, trade_day, event_id, n, final_spread AS x, impact_skew AS y, delta_volume AS v, CASE WHEN n >= 10 THEN stddev_samp(ret) OVER ({_O} ROWS 9 PRECEDING) ELSE 0 END AS vol FROM r)"""


def _rows(spark, sf_dir):
    """Ticks with spread, skew and the volatility of their last 10 returns."""
    book = {**_PLAN, "_ret": lambda s: f"coalesce({s.ret('mid')}, 0)", "vol": lambda s: f"coalesce({s.std('_ret', 10)}, 0)"}
    t = compute(ticks(spark, sf_dir), book, [*NEEDED, "vol"], DAY, ORDER).select(*DAY, *ORDER, *NEEDED, "vol")
    return scans.day_rows(t, DAY, ORDER)


def _out(df, names):
    return df.select("event_id", *[(F.round(n, 4) + 0.0).alias(n) for n in names])


_SPANS = {"spread_ewma_240": ("final_spread", 240), "spread_ewma_600": ("final_spread", 600), "skew_ewma_240": ("impact_skew", 240), "skew_ewma_600": ("impact_skew", 600)}
_STATE = {n: (f"t.{'x' if x == 'final_spread' else 'y'}", k) for n, (x, k) in _SPANS.items()}


def _decayed_sql() -> str:
    begin = ", ".join(x for x, _ in _STATE.values())
    step = ", ".join(f"CASE WHEN m.{n} IS NULL THEN {x} ELSE 2.0::DOUBLE / {k + 1} * {x} + {k - 1}.0::DOUBLE / {k + 1} * m.{n} END" for n, (x, k) in _STATE.items())
    return f"""WITH RECURSIVE {_T}, m(contract, trade_day, n, event_id, {', '.join(_STATE)}) AS (SELECT contract, trade_day, n, event_id, {begin} FROM t WHERE n = 1
UNION ALL SELECT t.contract, t.trade_day, t.n, t.event_id, {step} FROM m JOIN t ON t.contract = m.contract AND t.trade_day = m.trade_day AND t.n = m.n + 1) SELECT event_id, {', '.join(f'round({n}, 4) + 0.0 AS {n}' for n in _STATE)} FROM m"""


def spread_ewma(spark, sf_dir):
    return _out(spreads.decayed_means(_rows(spark, sf_dir), DAY, ORDER, "row_at", _SPANS), _SPANS)


_VOLUME = {"spread_vwma_20": ("final_spread", 20), "spread_vwma_120": ("final_spread", 120), "skew_vwma_120": ("impact_skew", 120)}


def spread_vwma(spark, sf_dir):
    return _out(spreads.volume_means(_rows(spark, sf_dir), DAY, ORDER, "delta_volume", _VOLUME), _VOLUME)


def _volume_sql() -> str:
    of = lambda x, k: f"sum({x} * v) OVER (PARTITION BY contract, trade_day ORDER BY n ROWS {k - 1} PRECEDING) / nullif(sum(v) OVER (PARTITION BY contract, trade_day ORDER BY n ROWS {k - 1} PRECEDING), 0)"
    return f"WITH {_T} SELECT event_id, {', '.join(f'round({of("x" if x == "final_spread" else "y", k)}, 4) + 0.0 AS {n}' for n, (x, k) in _VOLUME.items())} FROM t"


_ADAPTIVE = {"spread_adaptive_120": ("final_spread", 120), "spread_adaptive_60": ("final_spread", 60), "spread_adaptive_12": ("final_spread", 12), "skew_adaptive_12": ("impact_skew", 12)}


def spread_adaptive(spark, sf_dir):
    return _out(spreads.adaptive_means(_rows(spark, sf_dir), DAY, "row_at", "vol", _ADAPTIVE), _ADAPTIVE)


def _adaptive_sql() -> str:
    size = lambda k: f"CASE WHEN vol <= 1e-8 THEN {5 * k} ELSE greatest(10, least({5 * k}, round_even({k} * target / vol, 0))) END"
    of = lambda n, x, k: f"avg(b.{'x' if x == 'final_spread' else 'y'}) FILTER (WHERE b.n > a.n - a.k{k})"
    return f"""WITH {_T}, g AS (SELECT contract, trade_day, coalesce(nullif(avg(vol), 0), 1) AS target FROM t GROUP BY ALL),
a AS (SELECT t.*, {', '.join(f'{size(k)} AS k{k}' for k in (120, 60, 12))} FROM t JOIN g USING (contract, trade_day))
SELECT a.event_id, {', '.join(f'round({of(n, x, k)}, 4) + 0.0 AS {n}' for n, (x, k) in _ADAPTIVE.items())} FROM a JOIN t b ON a.contract = b.contract AND a.trade_day = b.trade_day AND b.n <= a.n GROUP BY a.event_id"""


QUERIES = {"spread_ewma": spread_ewma, "spread_vwma": spread_vwma, "spread_adaptive": spread_adaptive}
ORACLE = {"spread_ewma": _decayed_sql(), "spread_vwma": _volume_sql(), "spread_adaptive": _adaptive_sql()}
