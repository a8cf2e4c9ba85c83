"""Queries of recursions over whole contracts, as scans, and their recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from .factor_queries import bars_sql
from .tables import CONTRACT, ORDER, bars

QUERIES, ORACLE = {}, {}
_T = f"t AS MATERIALIZED (SELECT contract, event_id, price, high, low, vol, row_number() OVER (PARTITION BY contract ORDER BY ts, event_id) AS n FROM ({bars_sql()}))"
_ON = "JOIN t ON t.contract = m.contract AND t.n = m.n + 1"


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return keep


def _bars(spark, sf_dir):
    return bars(spark, sf_dir).select("contract", "trade_day", "ts", "event_id", "row_at", "price", "high", "low", "vol")


def rounded(df, *names):
    return df.select("event_id", *[(F.round(n, 5) + 0.0).alias(n) for n in names])


def _ema(k: int, x: str, y: str) -> str:
    return f"2.0::DOUBLE / {k + 1} * {x} + {k - 1}.0::DOUBLE / {k + 1} * {y}"


_MACD = {"f": 12, "s": 26, "a": 24, "b": 52}
_NEXT = {c: _ema(k, "t.price", f"m.{c}") for c, k in _MACD.items()}


@query(
    "bar_macd",
    f"""WITH RECURSIVE {_T}, m(contract, n, event_id, f, s, a, b, g, h) AS (SELECT contract, n, event_id, price, price, price, price, 0.0::DOUBLE, 0.0::DOUBLE FROM t WHERE n = 1
UNION ALL SELECT t.contract, t.n, t.event_id, {', '.join(_NEXT.values())}, {_ema(9, f"(({_NEXT['f']}) - ({_NEXT['s']}))", 'g')}, {_ema(9, f"(({_NEXT['a']}) - ({_NEXT['b']}))", 'h')} FROM m {_ON})
SELECT event_id, round(f - s, 5) + 0.0 AS macd, round(g, 5) + 0.0 AS macd_signal, round(f - s - g, 5) + 0.0 AS macd_histogram, round(a - b, 5) + 0.0 AS macd_long, round(h, 5) + 0.0 AS macd_long_signal FROM m""",
)
def bar_macd(spark, sf_dir):
    t = scans.macd(_bars(spark, sf_dir), CONTRACT, ORDER, "price", {"macd": (12, 26), "macd_long": (24, 52)})
    return rounded(t, "macd", "macd_signal", "macd_histogram", "macd_long", "macd_long_signal")


_RSI = {"rsi": 14, "rsi_short": 7, "rsi_long": 28}
_U = "u AS MATERIALIZED (SELECT *, greatest(coalesce(price - lag(price) OVER (PARTITION BY contract ORDER BY n), 0), 0) AS up, greatest(coalesce(lag(price) OVER (PARTITION BY contract ORDER BY n) - price, 0), 0) AS down FROM t)"


def _rsi(k: int) -> str:
    return f"m{k}(contract, n, g, l) AS (SELECT contract, {k}, avg(up), avg(down) FROM u WHERE n <= {k} GROUP BY contract HAVING count(*) = {k} UNION ALL SELECT u.contract, u.n, (g * {k - 1} + up) / {k}, (l * {k - 1} + down) / {k} FROM m{k} m JOIN u ON u.contract = m.contract AND u.n = m.n + 1)"


@query(
    "bar_rsi",
    f"WITH RECURSIVE {_T}, {_U}, {', '.join(map(_rsi, _RSI.values()))} SELECT t.event_id, {', '.join(f'round(CASE WHEN m{k}.n IS NULL THEN NULL WHEN m{k}.l = 0 THEN 100 ELSE 100 - 100 / (1 + m{k}.g / m{k}.l) END, 5) + 0.0 AS {name}' for name, k in _RSI.items())} FROM t {' '.join(f'LEFT JOIN m{k} ON t.contract = m{k}.contract AND t.n = m{k}.n' for k in _RSI.values())}",
)
def bar_rsi(spark, sf_dir):
    return rounded(scans.rsi(_bars(spark, sf_dir), CONTRACT, ORDER, "price", _RSI), *_RSI)


@query(
    "bar_kdj",
    f"""WITH RECURSIVE {_T}, h AS MATERIALIZED (SELECT *, CASE WHEN max(high) OVER w = min(low) OVER w THEN 50.0::DOUBLE ELSE (price - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) * 100 END AS rsv FROM t WINDOW w AS (PARTITION BY contract ORDER BY n ROWS 8 PRECEDING)),
m(contract, n, k, d) AS (SELECT contract, n, rsv, rsv FROM h WHERE n = 9 UNION ALL SELECT h.contract, h.n, (k * 2 + rsv) / 3, (d * 2 + (k * 2 + rsv) / 3) / 3 FROM m JOIN h ON h.contract = m.contract AND h.n = m.n + 1)
SELECT t.event_id, round(3 * k - 2 * d, 5) + 0.0 AS kdj FROM t LEFT JOIN m ON t.contract = m.contract AND t.n = m.n""",
)
def bar_kdj(spark, sf_dir):
    # the first bars have no highs and lows of a whole bar before
    t = _bars(spark, sf_dir)
    return rounded(scans.kdj(t, CONTRACT, ORDER, "high", "low", "price"), "kdj")


@query(
    "bar_rma",
    f"WITH RECURSIVE {_T}, m(contract, n, y) AS (SELECT contract, 20, avg(price) FROM t WHERE n <= 20 GROUP BY contract HAVING count(*) = 20 UNION ALL SELECT t.contract, t.n, (y * 19 + price) / 20 FROM m {_ON}) SELECT t.event_id, round(y, 4) + 0.0 AS rma FROM t LEFT JOIN m ON t.contract = m.contract AND t.n = m.n",
)
def bar_rma(spark, sf_dir):
    t = scans.rma(_bars(spark, sf_dir), CONTRACT, ORDER, "price", 20)
    return t.select("event_id", (F.round("rma", 4) + 0.0).alias("rma"))


_W = "p AS (SELECT a.contract, a.event_id, a.n, b.n AS o, power(9.0::DOUBLE / 11, a.n - b.n) AS w, b.price AS x FROM t a JOIN t b ON a.contract = b.contract AND b.n <= a.n)"


@query(
    "bar_ewm",
    f"""WITH {_T}, {_W}, s AS MATERIALIZED (SELECT contract, event_id, n, sum(w) AS s, sum(w * w) AS s2, sum(w * x) / sum(w) AS m FROM p GROUP BY ALL),
v AS (SELECT p.event_id, sum(p.w * (p.x - s.m) * (p.x - s.m)) AS v FROM p JOIN s USING (event_id) GROUP BY 1),
k AS (SELECT p.event_id, sum(p.w * power(p.x - o.m, 2)) / sum(p.w) AS a, sum(p.w * power(p.x - o.m, 3)) / sum(p.w) AS b FROM p JOIN s o ON o.contract = p.contract AND o.n = p.o GROUP BY 1)
SELECT event_id, round(m, 5) + 0.0 AS ewm_mean, round(CASE WHEN n > 1 THEN sqrt(v / s * (s * s) / nullif(s * s - s2, 0)) END, 5) + 0.0 AS ewm_std, round(b / nullif(power(a, 1.5), 0), 5) + 0.0 AS ewm_skew FROM s JOIN v USING (event_id) JOIN k USING (event_id)""",
)
def bar_ewm(spark, sf_dir):
    return rounded(scans.weighted_moments(_bars(spark, sf_dir), CONTRACT, ORDER, "price", 2 / 11), "ewm_mean", "ewm_std", "ewm_skew")
