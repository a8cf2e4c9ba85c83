"""Queries of joins, labels, evaluation, backtests and recursive indicators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import session
from ..functions.factors import TICK, compute
from ..operators import backtest, dataset, evaluate, joins, linear, ml, recursive, scans, spreads
from . import factor_sql
from .tables import BOOK_COLUMNS, DAILY_SQL, ORDER, TICKS_SQL, daily, levelled, numbered_ticks, ticks, view

DAY = ["contract", "trade_day"]
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def r(x, d=6):
    return F.round(x, d) + 0.0


TICK_FACTORS = "mid", "spread", "order_imbalance", "trade_direction", "net_inflow", "estimated_exec_price", "delta_volume", "oi_ma_10", "ofi1"


def features(spark, sf_dir, names=TICK_FACTORS, keys=DAY):
    rows = ticks(spark, sf_dir) if keys == DAY else numbered_ticks(spark, sf_dir)
    return compute(rows, TICK, names, keys, ORDER)


def features_sql(names=TICK_FACTORS, keys=DAY):
    return levelled(TICKS_SQL, factor_sql.TICK, names, BOOK_COLUMNS, keys)


@query(
    "tick_summary",
    f"""SELECT contract, trade_day, count(*) AS n, round(avg(mid), 4) AS mean_mid, round(avg(spread), 4) AS mean_spread, round(avg(order_imbalance), 6) AS mean_imbalance, CAST(sum(ofi1) AS BIGINT) AS ofi, CAST(sum(net_inflow) AS BIGINT) AS inflow, round(avg(oi_ma_10), 6) AS mean_oi_ma
FROM ({features_sql()}) GROUP BY contract, trade_day""",
)
def tick_summary(spark, sf_dir):
    return features(spark, sf_dir).groupBy(*DAY).agg(F.count("*").alias("n"), F.round(F.avg("mid"), 4).alias("mean_mid"), F.round(F.avg("spread"), 4).alias("mean_spread"), F.round(F.avg("order_imbalance"), 6).alias("mean_imbalance"), F.sum("ofi1").cast("long").alias("ofi"), F.sum("net_inflow").cast("long").alias("inflow"), F.round(F.avg("oi_ma_10"), 6).alias("mean_oi_ma"))


# --- sessions, sampling, cleaning ------------------------------------------------------------------------------------------

_S = "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)))"
_MIN = f"(CASE WHEN {_S} >= 75600 THEN ({_S} - 75600) / 60.0 WHEN {_S} < 28800 THEN ({_S} + 10800) / 60.0 WHEN {_S} >= 32400 AND {_S} < 41400 THEN ({_S} - 32400) / 60.0 WHEN {_S} >= 48600 AND {_S} <= 54000 THEN ({_S} - 48600) / 60.0 ELSE 9999.0 END)"
_IMP = f"(CASE WHEN {_S} >= 37800 AND {_S} < 41400 THEN ({_S} - 37800) / 60.0 ELSE {_MIN} END)"


@query(
    "session_flags",
    f"""SELECT event_id, CASE WHEN {_S} >= 75600 OR {_S} < 28800 THEN 1 ELSE 0 END AS is_night, CASE WHEN {_S} >= 32400 AND {_S} < 41400 THEN 1 ELSE 0 END AS is_am, CASE WHEN {_S} >= 48600 AND {_S} <= 54000 THEN 1 ELSE 0 END AS is_pm,
round(1 / sqrt({_MIN} + 1), 7) AS session_decay, round(exp(-{_IMP} * {_IMP} / 200), 7) AS open_impulse FROM events""",
)
def session_flags(spark, sf_dir):
    return session.with_session(view(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", "is_night", "is_am", "is_pm", F.round("session_decay", 7).alias("session_decay"), F.round("open_impulse", 7).alias("open_impulse"))


@query("trading_hours", f"SELECT event_id, CAST(CASE WHEN {_S} >= 64800 THEN {_S} ELSE {_S} + 86400 END AS BIGINT) AS session_second FROM events WHERE {_S} >= 75600 OR {_S} <= 54000")
def trading_hours(spark, sf_dir):
    return session.trading_hours(view(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", F.col("session_second").cast("long").alias("session_second"))


@query("time_of_day_mean", f"SELECT strftime(ts, '%H:%M:%S') AS time_of_day, round(avg(spread), 6) AS mean_spread FROM ({features_sql()}) GROUP BY 1")
def time_of_day_mean(spark, sf_dir):
    return session.time_of_day_mean(features(spark, sf_dir), "spread").select("time_of_day", F.round("mean_spread", 6).alias("mean_spread"))


@query("sample_stride", f"SELECT contract, event_id, last FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY ts, event_id) - 1 AS n FROM ({TICKS_SQL})) WHERE n >= 59 AND (n - 59) % 60 = 0")
def sample_stride(spark, sf_dir):
    return dataset.sampled(ticks(spark, sf_dir), ["contract"], ORDER, 60, 59).select("contract", "event_id", "last")


@query("context_map", f"SELECT event_id, round(1 / (1 + exp(-CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE greatest(least((last - 15000) / 2000, 3.0), -3.0) END)), 8) AS mapped FROM ({TICKS_SQL})")
def context_map(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", F.round(dataset.context_map(F.when(F.col("event_id") % 17 != 0, (F.col("last") - 15000) / 2000)), 8).alias("mapped"))


# --- joins ----------------------------------------------------------------------------------------------------------------------


@query(
    "align_left_join",
    f"WITH t AS ({features_sql()}) SELECT a.event_id, coalesce(b.order_imbalance, 0.0) AS order_imbalance FROM t a LEFT JOIN (SELECT contract, trade_day, ts, order_imbalance FROM t WHERE event_id % 3 = 0) b ON a.contract = b.contract AND a.trade_day = b.trade_day AND a.ts = b.ts",
)
def align_left_join(spark, sf_dir):
    t = features(spark, sf_dir)
    market = t.where("event_id % 3 = 0").select(*DAY, "ts", "order_imbalance")
    return joins.align_left(t.select("event_id", *DAY, "ts"), market, [*DAY, "ts"], {"order_imbalance": 0.0}).select("event_id", "order_imbalance")


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, trade_day, max_by(last, (ts, event_id)) AS last, sum(delta_volume) AS vol FROM ({t}) WHERE contract = '{c}' GROUP BY 1, 2"


def _hourly(t, contract):
    return t.where(F.col("contract") == contract).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "trade_day").agg(F.max_by("last", F.struct("ts", "event_id")).alias("last"), F.sum("delta_volume").alias("vol"))


@query(
    "main_second_inner",
    f"SELECT a.hour, a.trade_day AS day, a.last AS last_main, b.last AS last_second, a.vol AS vol_main, b.vol AS vol_second FROM ({_HOURLY.format(t=features_sql(), c='click')}) a JOIN ({_HOURLY.format(t=features_sql(), c='view')}) b ON a.hour = b.hour AND a.trade_day = b.trade_day WHERE a.trade_day > (SELECT min(CAST(ts AS DATE)) FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'view'))",
)
def main_second_inner(spark, sf_dir):
    t = features(spark, sf_dir)
    both = joins.inner_suffixed(_hourly(t, "click"), _hourly(t, "view"), ["hour", "trade_day"])
    days = joins.common_days(t.where("contract = 'click'"), t.where("contract = 'view'"))
    first = days.agg(F.min("trade_day").alias("_first"))
    return both.crossJoin(F.broadcast(first)).where("trade_day > _first").select("hour", F.col("trade_day").alias("day"), "last_main", "last_second", "vol_main", "vol_second")  # one row


@query(
    "cross_day_multiplier",
    f"""WITH d AS (SELECT trade_day, max(volume) FILTER (contract = 'click') AS a, max(volume) FILTER (contract = 'view') AS b FROM ({TICKS_SQL}) GROUP BY trade_day)
SELECT trade_day, round(coalesce(least(500.0, lag(a / nullif(b, 0)) OVER (ORDER BY trade_day)), 1.0), 9) AS multiplier FROM d WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def cross_day_multiplier(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return joins.cross_day_multiplier(t.where("contract = 'click'"), t.where("contract = 'view'")).select("trade_day", F.round("multiplier", 9).alias("multiplier"))


@query(
    "median_multiplier",
    f"WITH d AS (SELECT contract, trade_day, median(spread) AS m FROM ({features_sql()}) GROUP BY 1, 2) SELECT contract, trade_day, CASE WHEN lag(m) OVER w > 0 AND lag(m) OVER w < 4 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM d WINDOW w AS (PARTITION BY contract ORDER BY trade_day)",
)
def median_multiplier(spark, sf_dir):
    return joins.median_multiplier(features(spark, sf_dir), "spread", ["contract"], high=4.0)


@query("as_of_join", f"WITH t AS ({TICKS_SQL}) SELECT a.event_id, b.last AS last_asof FROM (SELECT * FROM t WHERE contract = 'click') a ASOF LEFT JOIN (SELECT trade_day, ts, last FROM t WHERE contract = 'view') b ON a.trade_day = b.trade_day AND a.ts >= b.ts")
def as_of_join(spark, sf_dir):
    t = ticks(spark, sf_dir)
    left = t.where("contract = 'click'").select("event_id", "trade_day", "ts")
    return joins.as_of(left, t.where("contract = 'view'").select("trade_day", "ts", "last"), ["trade_day"], "ts", ["last"]).select("event_id", "last_asof")


@query("union_days", f"SELECT contract, trade_day, event_id, CAST(0 AS INTEGER) AS part FROM ({TICKS_SQL}) WHERE event_id % 2 = 0 UNION ALL SELECT contract, trade_day, event_id, 1 FROM ({TICKS_SQL}) WHERE event_id % 5 = 0")
def union_days(spark, sf_dir):
    t = ticks(spark, sf_dir).select("contract", "trade_day", "event_id")
    return t.where("event_id % 2 = 0").withColumn("part", F.lit(0)).unionByName(t.where("event_id % 5 = 0").withColumn("part", F.lit(1)))


# --- aggregation and evaluation ---------------------------------------------------------------------------------------------

_FACTORS = ["l_quantity", "l_discount", "l_tax"]
_LABEL = "(l_extendedprice * (1 - l_discount) / 1000)"


def matrix(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", *_FACTORS, (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("label"))


MATRIX = f"SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, {', '.join(_FACTORS)}, {_LABEL} AS label FROM lineitem"


@query("factor_ic_matrix", f"WITH m AS ({MATRIX}) " + " UNION ALL ".join(f"SELECT '{f}' AS factor, round(corr({f}, label), 6) AS ic FROM m" for f in _FACTORS))
def factor_ic_matrix(spark, sf_dir):
    return evaluate.information_coefficients(matrix(spark, sf_dir), _FACTORS, "label").select("factor", F.round("ic", 6).alias("ic"))


@query("correlation_matrix", f"WITH m AS ({MATRIX}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM m" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def correlation_matrix(spark, sf_dir):
    return evaluate.correlation_matrix(matrix(spark, sf_dir), _FACTORS).select("a", "b", r("r").alias("r"))


@query("daily_ic_icir", f"WITH d AS (SELECT CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(label) > 0 THEN covar_pop(l_quantity, label) / (stddev_pop(l_quantity) * stddev_pop(label)) END AS ic FROM ({MATRIX}) GROUP BY l_shipdate) SELECT round(avg(ic), 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 4) AS icir, count(ic) AS days FROM d")
def daily_ic_icir(spark, sf_dir):
    return evaluate.daily_ic(matrix(spark, sf_dir), "l_shipdate", "l_quantity", "label").select(F.round("mean_ic", 6).alias("mean_ic"), F.round("icir", 4).alias("icir"), "days")


@query(
    "rank_ic",
    f"WITH m AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY label) + (count(*) OVER (PARTITION BY l_returnflag, label) - 1) / 2.0 AS b FROM ({MATRIX})) SELECT l_returnflag, round(corr(a, b), 6) AS rank_ic FROM m GROUP BY 1",
)
def rank_ic(spark, sf_dir):
    return evaluate.rank_ic(matrix(spark, sf_dir), ["l_returnflag"], "l_quantity", "label").select("l_returnflag", F.round("rank_ic", 6).alias("rank_ic"))


@query("tail_means", f"WITH m AS ({MATRIX}), c AS (SELECT quantile_cont(l_quantity, 0.95) AS hi, quantile_cont(l_quantity, 0.05) AS lo FROM m) SELECT round(avg(label) FILTER (l_quantity > hi), 6) AS top, round(avg(label) FILTER (l_quantity < lo), 6) AS bottom, round(avg(label) FILTER (l_quantity > hi) - avg(label) FILTER (l_quantity < lo), 6) AS long_short FROM m, c")
def tail_means(spark, sf_dir):
    return evaluate.tail_means(matrix(spark, sf_dir), "l_quantity", "label").select(*[F.round(c, 6).alias(c) for c in ("top", "bottom", "long_short")])


_BUCKETS = f"""WITH m AS ({MATRIX}), e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM m), s AS (SELECT list_sort(e)[2:len(e) - 1] AS e FROM e),
b AS (SELECT CAST(len(list_filter(s.e, lambda x: x < m.l_quantity)) + 1 AS INTEGER) AS bucket, label FROM m, s)"""


@query("qcut_means", f"{_BUCKETS} SELECT bucket, count(*) AS n, round(avg(label), 6) AS mean_label FROM b GROUP BY bucket")
def qcut_means(spark, sf_dir):
    return evaluate.quantile_buckets(matrix(spark, sf_dir), "l_quantity", "label").select("bucket", "n", F.round("mean_label", 6).alias("mean_label"))


@query("decile_table", f"{_BUCKETS} SELECT " + ", ".join(f"round(avg(label) FILTER (bucket = {i}), 6) AS d{i}" for i in range(1, 11)) + ", round(avg(label) FILTER (bucket = 10) - avg(label) FILTER (bucket = 1), 6) AS spread FROM b")
def decile_table(spark, sf_dir):
    d = evaluate.decile_table(matrix(spark, sf_dir), "l_quantity", "label")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(
    "topk_daily_spread",
    f"""WITH m AS (SELECT contract, trade_day, ret_600, order_imbalance, row_number() OVER (PARTITION BY contract, trade_day ORDER BY order_imbalance, event_id) AS r, count(*) OVER (PARTITION BY contract, trade_day) AS n FROM (SELECT *, lead(mid, 5) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) / mid - 1 AS ret_600 FROM ({features_sql()})) WHERE order_imbalance IS NOT NULL)
SELECT contract, trade_day, round(avg(ret_600) FILTER (r > n - floor(n * 0.1)), 7) + 0.0 AS top, round(avg(ret_600) FILTER (r <= floor(n * 0.1)), 7) + 0.0 AS bottom, round(avg(ret_600) FILTER (r > n - floor(n * 0.1)) - avg(ret_600) FILTER (r <= floor(n * 0.1)), 7) + 0.0 AS spread FROM m GROUP BY 1, 2""",
)
def topk_daily_spread(spark, sf_dir):
    t = features(spark, sf_dir).withColumn("fwd", F.expr("lead(mid, 5) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) / mid - 1")).withColumn("key", F.struct(*DAY))
    out = evaluate.top_bottom_spread(t, "key", "order_imbalance", "fwd", ["event_id"])
    return out.select("key.contract", "key.trade_day", *[r(c, 7).alias(c) for c in ("top", "bottom", "spread")])


_GRID = [k / 20.0 for k in range(0, 20)]
_PRED = "((CAST(event_id AS DOUBLE) * 7919 % 2001) / 1000 - 1)"
_Y = "((last - 15000) / 1000)"


@query(
    "dq_threshold_sweep",
    f"""WITH p AS (SELECT {_PRED} AS p, {_Y} AS y FROM ({TICKS_SQL}) WHERE event_id % 23 <> 0), g AS (SELECT k / 20.0::DOUBLE AS t FROM (SELECT unnest(range(0, 20)) AS k)), x AS (SELECT t, CASE WHEN p > t THEN y - 0.05 WHEN p < -t THEN -y - 0.05 END AS x FROM p, g)
SELECT t AS threshold, count(x) AS signals, round(15 * coalesce(sum(x), 0), 4) AS dq, round(sum(greatest(x, 0)) / nullif(sum(greatest(-x, 0)), 0), 6) AS dqr FROM x GROUP BY t""",
)
def dq_threshold_sweep(spark, sf_dir):
    t = ticks(spark, sf_dir).select(F.expr(f"CASE WHEN event_id % 23 <> 0 THEN {_PRED} END").alias("p"), F.expr(_Y).alias("y"))
    return evaluate.threshold_sweep(t, "p", "y", 0.05, _GRID).select("threshold", "signals", F.round("dq", 4).alias("dq"), F.round("dqr", 6).alias("dqr"))


HORIZONS = (1, 3, 5, 10, 15, 30, 60)
_SITES = f"SELECT *, CASE WHEN event_id % 2 = 0 THEN 'AP' ELSE 'BP' END AS site, last AS ref_price, ((event_id * 7919) % 21 - 10) / 2.0::DOUBLE AS prediction, lead(last, 3) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) AS future, {', '.join(f'lead(last, {k}) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) AS future_{k}' for k in HORIZONS)} FROM ({TICKS_SQL})"


def sites(spark, sf_dir):
    ahead = lambda k: F.expr(f"lead(last, {k}) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id)")
    return ticks(spark, sf_dir).withColumns({"site": F.expr("CASE WHEN event_id % 2 = 0 THEN 'AP' ELSE 'BP' END"), "ref_price": F.col("last"), "prediction": F.expr("((event_id * 7919) % 21 - 10) / 2.0D"), "future": ahead(3), **{f"future_{k}": ahead(k) for k in HORIZONS}})


@query(
    "theo_price_sweep",
    f"""WITH s AS ({_SITES}), g AS (SELECT CAST(k AS DOUBLE) AS t FROM (SELECT unnest(range(0, 5)) AS k)), a AS (SELECT t, ap1, bp1, future, CASE WHEN site = 'AP' THEN ref_price - prediction ELSE ref_price + prediction END AS theo FROM s, g WHERE future IS NOT NULL)
SELECT t AS threshold, count(*) FILTER (theo > ap1 + t) AS buys, count(*) FILTER (theo < bp1 - t AND NOT theo > ap1 + t) AS sells, round(coalesce(sum(CASE WHEN theo > ap1 + t THEN future - ap1 * 1.00005 WHEN theo < bp1 - t THEN bp1 * 0.99995 - future END), 0), 2) AS pnl FROM a GROUP BY t""",
)
def theo_price_sweep(spark, sf_dir):
    return evaluate.theo_price_sweep(sites(spark, sf_dir), [0.0, 1.0, 2.0, 3.0, 4.0]).select("threshold", "buys", "sells", F.round("pnl", 2).alias("pnl"))


@query(
    "multi_horizon_pnl",
    f"""WITH s AS ({_SITES}), c AS (SELECT quantile_cont(prediction, 0.9) AS cut FROM s), x AS (SELECT s.* FROM s, c WHERE prediction > cut)
SELECT horizon, count(f) AS trades, round(sum(CASE WHEN site = 'BP' THEN f - ap1 ELSE bp1 - f END), 4) AS pnl FROM ({" UNION ALL ".join(f"SELECT site, ap1, bp1, 'future_{k}' AS horizon, future_{k} AS f FROM x" for k in HORIZONS)}) GROUP BY horizon""",
)
def multi_horizon_pnl(spark, sf_dir):
    return evaluate.horizon_pnl(sites(spark, sf_dir), "prediction", [f"future_{k}" for k in HORIZONS]).select("horizon", "trades", F.round("pnl", 4).alias("pnl"))


@query("regression_errors", f"WITH m AS (SELECT label AS y, l_quantity * 1.5 AS p FROM ({MATRIX})), s AS (SELECT avg((y - p) * (y - p)) AS mse, var_pop(y) AS vy, var_pop(p) AS vp, covar_pop(y, p) AS c, avg(y) AS my, avg(p) AS mp FROM m) SELECT round(mse, 4) AS mse, round(1 - mse / vy, 6) AS r2, round(2 * c / (vy + vp + (my - mp) * (my - mp)), 6) AS ccc, round(c / sqrt(vy * vp), 6) AS pearson FROM s")
def regression_errors(spark, sf_dir):
    e = evaluate.regression_errors(matrix(spark, sf_dir).withColumn("p", F.col("l_quantity") * 1.5), "label", "p")
    return e.select(F.round("mse", 4).alias("mse"), *[F.round(c, 6).alias(c) for c in ("r2", "ccc", "pearson")])


@query("confusion", f"WITH t AS (SELECT trade_direction AS real, CASE WHEN order_imbalance > 0.1 THEN 1 WHEN order_imbalance < -0.1 THEN -1 ELSE 0 END AS predicted FROM ({features_sql()})), c AS (SELECT CAST(real AS INTEGER) AS real, predicted, count(*) AS n FROM t GROUP BY 1, 2) SELECT *, round((SELECT sum(n) FILTER (real = predicted) FROM c) / (SELECT sum(n) FROM c), 6) AS accuracy FROM c")
def confusion(spark, sf_dir):
    t = features(spark, sf_dir).select(F.col("trade_direction").cast("int").alias("real"), F.expr("CASE WHEN order_imbalance > 0.1 THEN 1 WHEN order_imbalance < -0.1 THEN -1 ELSE 0 END").alias("predicted"))
    return evaluate.confusion(t, "real", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query("group_stats", f"SELECT contract, trade_day, round(avg(last), 4) AS mean, round(stddev_pop(last), 4) AS std, max(last) - min(last) AS range, max_by(last, (ts, event_id)) - min_by(last, (ts, event_id)) AS change, count(*) AS n FROM ({TICKS_SQL}) GROUP BY 1, 2")
def group_stats(spark, sf_dir):
    return evaluate.group_stats(ticks(spark, sf_dir), DAY, "last", ORDER).select(*DAY, F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "range", "change", "n")


@query("describe", f"SELECT count(label) AS n, round(avg(label), 6) AS mean, round(stddev_samp(label), 6) AS std, round(min(label), 6) AS low, round(quantile_cont(label, 0.25), 6) AS q1, round(median(label), 6) AS q2, round(quantile_cont(label, 0.75), 6) AS q3, round(max(label), 6) AS high FROM ({MATRIX})")
def describe(spark, sf_dir):
    d = evaluate.described(matrix(spark, sf_dir), "label")
    return d.select("n", *[F.round(c, 6).alias(c) for c in d.columns if c != "n"])


_ENTROPY = "round(CASE WHEN min(t) > 0 THEN sum(CASE WHEN p > 0 THEN -p * ln(p) END) END, 6) AS vol_entropy"


@query("volume_entropy", f"WITH s AS (SELECT contract, trade_day, estimated_exec_price, sum(delta_volume) AS v FROM ({features_sql()}) GROUP BY 1, 2, 3), p AS (SELECT *, sum(v) OVER (PARTITION BY contract, trade_day) AS t, v / nullif(sum(v) OVER (PARTITION BY contract, trade_day), 0) AS p FROM s) SELECT contract, trade_day, {_ENTROPY} FROM p GROUP BY 1, 2")
def volume_entropy(spark, sf_dir):
    return evaluate.volume_entropy(features(spark, sf_dir), DAY).select(*DAY, F.round("vol_entropy", 6).alias("vol_entropy"))


_CHECK = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY ts, event_id) - 1 AS n, last_value(last) OVER (PARTITION BY contract ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS price FROM ({features_sql(keys=['contract'])})),
c AS (SELECT contract, k AS checkpoint, greatest(k - 600, 0) AS lo FROM (SELECT contract, max(n) AS m FROM t GROUP BY 1), LATERAL (SELECT unnest([120, 240, 360, 480] || range(600, m + 601, 120)) AS k)),
w AS (SELECT t.*, checkpoint FROM t JOIN c ON t.contract = c.contract AND t.n < checkpoint AND t.n >= lo)"""


@query("checkpoint_entropy", f"{_CHECK}, s AS (SELECT contract, checkpoint, estimated_exec_price, sum(delta_volume) AS v FROM w GROUP BY 1, 2, 3), p AS (SELECT *, sum(v) OVER (PARTITION BY contract, checkpoint) AS t, v / nullif(sum(v) OVER (PARTITION BY contract, checkpoint), 0) AS p FROM s) SELECT contract, checkpoint, {_ENTROPY} FROM p GROUP BY 1, 2")
def checkpoint_entropy(spark, sf_dir):
    t = features(spark, sf_dir, keys=["contract"]).withColumnRenamed("row_at", "n")
    return evaluate.volume_entropy(evaluate.checkpoints(t, "n"), ["contract", "checkpoint"]).select("contract", "checkpoint", F.round("vol_entropy", 6).alias("vol_entropy"))


@query(
    "tick_hcp_lcp",
    f"""{_CHECK}, e AS (SELECT contract, checkpoint, max_by(last, n) AS final FROM w GROUP BY 1, 2)
SELECT w.contract, w.checkpoint, round(sum(CASE WHEN trade_direction = 1 AND mid > final THEN mid * delta_volume END) / nullif(sum(CASE WHEN trade_direction = 1 AND mid > final THEN delta_volume END), 0) / any_value(final) - 1, 7) AS tick_hcp,
round(sum(CASE WHEN trade_direction = -1 AND mid < final THEN mid * delta_volume END) / nullif(sum(CASE WHEN trade_direction = -1 AND mid < final THEN delta_volume END), 0) / any_value(final) - 1, 7) AS tick_lcp FROM w JOIN e USING (contract, checkpoint) GROUP BY 1, 2""",
)
def tick_hcp_lcp(spark, sf_dir):
    t = features(spark, sf_dir, keys=["contract"]).withColumnRenamed("row_at", "n")
    w = evaluate.checkpoints(t, "n")
    final = w.groupBy("contract", "checkpoint").agg(F.max_by("last", "n").alias("final"))
    rows = w.join(final, ["contract", "checkpoint"])
    dear, cheap = (F.col("trade_direction") == 1) & (F.col("mid") > F.col("final")), (F.col("trade_direction") == -1) & (F.col("mid") < F.col("final"))
    mean = lambda c: F.round(F.try_divide(F.sum(F.when(c, F.col("mid") * F.col("delta_volume"))), F.sum(F.when(c, F.col("delta_volume")))) / F.first("final") - 1, 7)
    return rows.groupBy("contract", "checkpoint").agg(mean(dear).alias("tick_hcp"), mean(cheap).alias("tick_lcp"))


def _ks_sql(x: str, where: str) -> str:
    """Distribution against the fitted normal, by value counts; the normal by the formula that the plan has."""
    t = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2)))"
    tail = f"0.5 * exp(-z * z / 2) * (0.254829592 * {t} - 0.284496736 * {t} ** 2 + 1.421413741 * {t} ** 3 - 1.453152027 * {t} ** 4 + 1.061405429 * {t} ** 5)"
    return f"""SELECT any_value(n) AS n, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS std, round(max(greatest(abs(upto / n - p), abs((upto - c) / n - p))), 5) AS distance FROM (SELECT *, if(z < 0, {tail}, 1 - {tail}) AS p FROM (SELECT c, sum(c) OVER (ORDER BY x) AS upto, n, m, s, (x - m) / s AS z
FROM (SELECT {x} AS x, count(*) AS c FROM ({MATRIX}) WHERE {where} GROUP BY 1), (SELECT count(*) AS n, avg({x}) AS m, stddev_pop({x}) AS s FROM ({MATRIX}) WHERE {where})))"""


@query("ks_normal", f"SELECT CAST(n AS BIGINT) AS n, mean, std, distance FROM ({_ks_sql('label', 'label IS NOT NULL')} UNION ALL {_ks_sql('ln(label)', 'label > 0')})")
def ks_normal(spark, sf_dir):
    return evaluate.ks_distance(matrix(spark, sf_dir), "label").unionByName(evaluate.ks_distance(matrix(spark, sf_dir), "label", log=True)).select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("distance", 5).alias("distance"))


@query("top_k_features", f"SELECT l_orderkey, l_linenumber, round(abs(label), 6) AS size FROM ({MATRIX}) ORDER BY abs(label) DESC, l_orderkey, l_linenumber LIMIT 20")
def top_k_features(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return m.orderBy(F.desc(F.abs("label")), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", F.round(F.abs("label"), 6).alias("size"))


@query("importance_share", f"WITH g AS (SELECT l_returnflag AS feature, sum(label) AS gain FROM ({MATRIX}) GROUP BY 1) SELECT feature, round(gain / sum(gain) OVER (), 8) AS gain_normalized FROM g")
def importance_share(spark, sf_dir):
    g = matrix(spark, sf_dir).groupBy(F.col("l_returnflag").alias("feature")).agg(F.sum("label").alias("gain"))
    return ml.normalised_importance(g, "gain").select("feature", F.round("gain_normalized", 8).alias("gain_normalized"))


# --- labels and data sets ------------------------------------------------------------------------------------------------------

_ORDER_BY = "PARTITION BY contract, trade_day ORDER BY ts, event_id"
_BARRIER = "CASE " + " ".join(f"WHEN lead(last, {k}) OVER w >= last * 1.002 THEN 1 WHEN lead(last, {k}) OVER w <= last * 0.998 THEN -1" for k in range(1, 11)) + " ELSE 0 END"


@query("barrier_label", f"SELECT event_id, {_BARRIER} AS label FROM ({TICKS_SQL}) WINDOW w AS ({_ORDER_BY})")
def barrier_label(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", dataset.triple_barrier("last", DAY, ORDER).alias("label"))


@query(
    "dynamic_label",
    f"""WITH a AS (SELECT *, lead(last, 10) OVER w / last - 1 AS forward FROM ({TICKS_SQL}) WINDOW w AS (PARTITION BY contract ORDER BY ts, event_id)), b AS (SELECT *, lag(forward, 10) OVER w AS known FROM a WINDOW w AS (PARTITION BY contract ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN count(known) OVER f >= 10 THEN quantile_cont(known, 0.95) OVER f END AS hi, CASE WHEN count(known) OVER f >= 10 THEN quantile_cont(known, 0.05) OVER f END AS lo FROM b WINDOW f AS (PARTITION BY contract ORDER BY ts, event_id ROWS BETWEEN 239 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN forward > lag(hi) OVER w THEN 1 WHEN forward < lag(lo) OVER w THEN -1 ELSE 0 END AS label FROM c WINDOW w AS (PARTITION BY contract ORDER BY ts, event_id)""",
)
def dynamic_label(spark, sf_dir):
    return dataset.dynamic_label(ticks(spark, sf_dir), "last", ["contract"], ORDER).select("event_id", "label")


_DAYS = f"SELECT CAST(day AS DATE) AS day, CAST(cents AS DOUBLE) / lag(cents) OVER (ORDER BY day) - 1 AS ret, CAST(n AS DOUBLE) AS vol FROM ({DAILY_SQL})"


def days(spark, sf_dir):
    return daily(spark, sf_dir).select(F.col("day").cast("date").alias("day"), F.expr("CAST(cents AS DOUBLE) / lag(cents) OVER (ORDER BY day) - 1").alias("ret"), F.col("n").cast("double").alias("vol"))


@query(
    "regime_types",
    f"""WITH d AS ({_DAYS}), a AS (SELECT *, CASE WHEN count(ret) OVER f >= 5 THEN avg(abs(ret)) OVER f END AS m0, CASE WHEN count(vol) OVER f >= 5 THEN avg(vol) OVER f END AS v0 FROM d WINDOW f AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), b AS (SELECT *, lag(m0) OVER (ORDER BY day) AS m, lag(v0) OVER (ORDER BY day) AS v FROM a), q AS (SELECT quantile_cont(m, 0.7) AS qm, quantile_cont(v, 0.7) AS qv FROM b)
SELECT day, CASE WHEN m IS NULL OR v IS NULL THEN NULL WHEN m > qm AND v > qv THEN 1 WHEN m > qm THEN 2 WHEN v > qv THEN 3 ELSE 4 END AS regime FROM b, q""",
)
def regime_types(spark, sf_dir):
    return dataset.day_regimes(days(spark, sf_dir), "day", "ret", "vol").select("day", "regime")


_SPLIT = "1996-01-01"


@query("standardize_train_test", f"WITH m AS ({MATRIX}), s AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS b, avg(label) AS c, stddev_samp(label) AS d FROM m WHERE l_shipdate < DATE '{_SPLIT}') SELECT l_orderkey, l_linenumber, round(greatest(least((l_quantity - a) / b, 3.0), -3.0), 6) AS l_quantity, round(greatest(least((label - c) / d, 3.0), -3.0), 6) AS label FROM m, s WHERE l_shipdate >= DATE '{_SPLIT}'")
def standardize_train_test(spark, sf_dir):
    train, test = dataset.split_by_day(matrix(spark, sf_dir), "l_shipdate", _SPLIT)
    return dataset.standardised(test, train, ["l_quantity", "label"]).select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("label", 6).alias("label"))


@query("split_last_days", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 14) GROUP BY 1")
def split_last_days(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return dataset.split_last_days(o, "day")[1].groupBy("day").agg(F.count("*").alias("n"))


@query("rolling_mean_features", f"SELECT contract, event_id, round(CASE WHEN count(order_imbalance) OVER f >= 120 THEN avg(order_imbalance) OVER f END, 7) AS f_1, round(CASE WHEN count(spread) OVER f >= 120 THEN avg(spread) OVER f END, 6) AS f_2 FROM ({features_sql(keys=['contract'])}) WINDOW f AS (PARTITION BY contract ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)")
def rolling_mean_features(spark, sf_dir):
    t = dataset.rolling_means(features(spark, sf_dir, keys=["contract"]), ["order_imbalance", "spread"], ["contract"], ORDER)
    return t.select("contract", "event_id", F.round("order_imbalance_mean120", 7).alias("f_1"), F.round("spread_mean120", 6).alias("f_2"))


@query("sequence_windows", f"WITH t AS (SELECT event_id, list(last) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS w FROM ({TICKS_SQL})), f AS (SELECT event_id, list_concat(list_transform(range(0, 9 - len(w)), lambda i: w[1]), w) AS w FROM t) SELECT event_id, w[1] AS oldest, w[5] AS middle, w[9] AS newest, CAST(5 AS INTEGER) AS n FROM f")
def sequence_windows(spark, sf_dir):
    t = dataset.windows_as_arrays(ticks(spark, sf_dir), ["last"], DAY, ORDER, 5, dilation=2)
    return t.select("event_id", F.expr("sequence[0][0]").alias("oldest"), F.expr("sequence[2][0]").alias("middle"), F.expr("sequence[4][0]").alias("newest"), F.size("sequence").alias("n"))


@query("mixup")
def mixup(spark, sf_dir):
    return dataset.mixup(matrix(spark, sf_dir), ["l_quantity", "label"], ["l_returnflag"], ["l_orderkey", "l_linenumber"], shape=0.4).select("l_orderkey", "l_linenumber", "l_quantity", "label", "mixed")


# --- positions and backtests -----------------------------------------------------------------------------------------------------

_SIGNAL = "CASE WHEN event_id % 19 = 0 THEN 1 WHEN event_id % 23 = 0 THEN 2 ELSE 0 END"


def signalled(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("signal", F.expr(_SIGNAL))


_POSITION = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, {_SIGNAL} AS signal, row_number() OVER (PARTITION BY contract ORDER BY trade_day, ts, event_id) AS n, row_number() OVER (PARTITION BY contract, trade_day ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM ({TICKS_SQL})),
m(contract, n, event_id, side, age, position) AS (SELECT contract, n, event_id, signal, CASE WHEN signal > 0 THEN 0 ELSE 99 END, CASE WHEN is_last OR signal = 0 THEN 0 WHEN signal = 1 THEN 1 ELSE -1 END FROM t WHERE n = 1
UNION ALL SELECT t.contract, t.n, t.event_id, CASE WHEN t.signal > 0 THEN t.signal ELSE m.side END, CASE WHEN t.signal > 0 THEN 0 ELSE m.age + 1 END, CASE WHEN t.is_last THEN 0 WHEN t.signal = 1 THEN 1 WHEN t.signal = 2 THEN -1 WHEN m.age + 1 >= 5 THEN 0 WHEN m.side = 1 THEN 1 WHEN m.side = 2 THEN -1 ELSE 0 END FROM m JOIN t ON t.contract = m.contract AND t.n = m.n + 1)"""


@query("position_hold", f"{_POSITION} SELECT contract, event_id, CAST(position AS INTEGER) AS position FROM m")
def position_hold(spark, sf_dir):
    return backtest.held_positions(signalled(spark, sf_dir), ["contract"], "trade_day", ORDER).select("contract", "event_id", "position")


@query(
    "position_pnl",
    f"""{_POSITION}, x AS (SELECT t.contract, t.n, t.ap1, t.bp1, m.position AS p, coalesce(lag(m.position) OVER (PARTITION BY t.contract ORDER BY t.n), 0) AS b FROM t JOIN m ON t.contract = m.contract AND t.n = m.n),
e AS (SELECT *, last_value(CASE WHEN p <> b AND p > 0 THEN bp1 WHEN p <> b AND p < 0 THEN ap1 END IGNORE NULLS) OVER (PARTITION BY contract ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM x), f AS (SELECT *, lag(entry) OVER (PARTITION BY contract ORDER BY n) AS held FROM e)
SELECT contract, CAST(sum(CASE WHEN p <> b AND p <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS opened, CAST(sum(CASE WHEN p <> b AND b <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS closed, count(*) FILTER (WHERE p <> b AND ((b > 0 AND ap1 > held) OR (b < 0 AND held > bp1))) AS wins, round(sum(CASE WHEN p <> b AND b > 0 THEN (ap1 - held) / 0.02 WHEN p <> b AND b < 0 THEN (held - bp1) / 0.02 ELSE 0 END - CASE WHEN p <> b AND p <> 0 THEN 1 ELSE 0 END), 3) AS pnl FROM f GROUP BY contract""",
)
def position_pnl(spark, sf_dir):
    held = backtest.held_positions(signalled(spark, sf_dir), ["contract"], "trade_day", ORDER)
    pnl = backtest.tick_pnl(held, DAY, ORDER)
    won = F.count_if((F.col("closed") == 1) & (F.col("pnl") + F.col("opened") > 0))
    return pnl.groupBy("contract").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), won.alias("wins"), F.round(F.sum("pnl"), 3).alias("pnl"))


@query("trade_counter", f"{_POSITION}, x AS (SELECT t.contract, t.trade_day, abs(m.position - lag(m.position) OVER (PARTITION BY t.contract, t.trade_day ORDER BY t.n)) AS s FROM t JOIN m ON t.contract = m.contract AND t.n = m.n) SELECT contract, trade_day, CAST(coalesce(sum(s), 0) AS DOUBLE) / 2 AS trades FROM x GROUP BY 1, 2")
def trade_counter(spark, sf_dir):
    held = backtest.held_positions(signalled(spark, sf_dir), ["contract"], "trade_day", ORDER)
    return backtest.trade_count(held, DAY, ORDER)


_DAYSIG = "((event_id * 31) % 201 - 100) / 100.0"


@query(
    "backtest_day",
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, {_DAYSIG}::DOUBLE AS signal, row_number() OVER w AS n, count(*) OVER (PARTITION BY contract, trade_day) AS c FROM ({TICKS_SQL}) WINDOW w AS (PARTITION BY contract, trade_day ORDER BY ts, event_id)),
m(contract, trade_day, n, c, pos, entry, pnl, longs, shorts, ask, bid) AS (SELECT contract, trade_day, 0::BIGINT, c, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM t WHERE n = 1
UNION ALL SELECT t.contract, t.trade_day, t.n, t.c, CASE WHEN pos = 0 AND signal > 0.8 THEN 1 WHEN pos = 0 AND signal < -0.8 THEN -1 WHEN pos <> 0 AND pos * signal <= 0 THEN 0 ELSE pos END,
CASE WHEN pos = 0 AND signal > 0.8 THEN ap1 WHEN pos = 0 AND signal < -0.8 THEN bp1 ELSE entry END,
pnl + CASE WHEN pos = 0 AND signal > 0.8 THEN -ap1 * 0.0001 WHEN pos = 0 AND signal < -0.8 THEN -bp1 * 0.0001 WHEN pos = 1 AND signal <= 0 THEN bp1 - entry - bp1 * 0.0001 WHEN pos = -1 AND signal >= 0 THEN entry - ap1 - ap1 * 0.0001 ELSE 0 END,
longs + CASE WHEN pos = 0 AND signal > 0.8 THEN 1 ELSE 0 END, shorts + CASE WHEN pos = 0 AND signal < -0.8 THEN 1 ELSE 0 END, ap1, bp1 FROM m JOIN t ON t.contract = m.contract AND t.trade_day = m.trade_day AND t.n = m.n + 1)
SELECT contract, trade_day, round(pnl + CASE pos WHEN 1 THEN bid - entry - bid * 0.0001 WHEN -1 THEN entry - ask - ask * 0.0001 ELSE 0 END, 5) AS pnl, longs AS long_trades, shorts AS short_trades FROM m WHERE n = c""",
)
def backtest_day(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("signal", F.expr(f"CAST({_DAYSIG} AS DOUBLE)"))
    return recursive.backtest_days(t, DAY, ORDER, 0.8, 0.0001).withColumn("pnl", F.round("pnl", 5))


@query(
    "equity_stats",
    f"WITH d AS (SELECT day, coalesce(ret, 0) / 10 AS x, CAST(year(day) AS INTEGER) AS y FROM ({_DAYS})), e AS (SELECT *, exp(sum(ln(1 + x)) OVER w) AS equity FROM d WINDOW w AS (PARTITION BY y ORDER BY day ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, max(equity) OVER (PARTITION BY y ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT day, round(equity, 2) AS equity, round(peak, 2) AS peak, round(equity / peak - 1, 7) + 0.0 AS drawdown FROM p",
)
def equity_stats(spark, sf_dir):
    d = days(spark, sf_dir).select("day", F.year("day").alias("y"), (F.coalesce("ret", F.lit(0.0)) / 10).alias("x"))
    return backtest.equity(d, ["y"], "day", "x").select("day", F.round("equity", 2).alias("equity"), F.round("peak", 2).alias("peak"), r("drawdown", 7).alias("drawdown"))


@query(
    "performance_summary",
    f"""WITH d AS (SELECT day, ret / 100 AS x, CAST(year(day) AS INTEGER) AS y FROM ({_DAYS})), c AS (SELECT *, 1 + sum(x) OVER w AS cum FROM d WINDOW w AS (PARTITION BY y ORDER BY day ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, cum / nullif(greatest(max(cum) OVER (PARTITION BY y ORDER BY day ROWS UNBOUNDED PRECEDING), 1.0), 0) - 1 AS dd FROM c)
SELECT y, count(*) AS days, round(sum(x), 6) AS total_return, round(avg(x) * 252, 6) AS annual_return, round(stddev_samp(x) * sqrt(252), 6) AS annual_vol, round(min(dd), 6) AS max_drawdown, round(avg(x) * 252 / nullif(stddev_samp(x) * sqrt(252), 0), 5) AS sharpe, round(avg(x) * 252 / nullif(-min(dd), 0), 4) AS calmar FROM p GROUP BY y""",
)
def performance_summary(spark, sf_dir):
    d = days(spark, sf_dir).select("day", F.year("day").alias("y"), (F.col("ret") / 100).alias("x"))
    p = backtest.performance(d, ["y"], "day", "x")
    return p.select("y", "days", *[F.round(c, k).alias(c) for c, k in (("total_return", 6), ("annual_return", 6), ("annual_vol", 6), ("max_drawdown", 6), ("sharpe", 5), ("calmar", 4))])


# --- recursive indicators ----------------------------------------------------------------------------------------------------------

_N = f"t AS MATERIALIZED (SELECT contract, trade_day, event_id, last, row_number() OVER ({_ORDER_BY}) AS n, greatest(coalesce(last - lag(last) OVER ({_ORDER_BY}), 0), 0) AS up, greatest(coalesce(lag(last) OVER ({_ORDER_BY}) - last, 0), 0) AS down FROM ({TICKS_SQL}))"
_ON = "JOIN t ON t.contract = m.contract AND t.trade_day = m.trade_day AND t.n = m.n + 1"


def _made(spark, sf_dir):
    """Ticks with their number in their day."""
    return scans.day_rows(ticks(spark, sf_dir).select(*DAY, *ORDER, "last", "av1", "bv1"), DAY, ORDER)


@query(
    "ema_macd",
    f"""WITH RECURSIVE {_N}, m(contract, trade_day, n, event_id, f, s, g, a, b) AS (SELECT contract, trade_day, n, event_id, last, last, 0.0::DOUBLE, last, last FROM t WHERE n = 1 UNION ALL SELECT t.contract, t.trade_day, t.n, t.event_id, 2.0 / 13 * last + 11.0 / 13 * f, 2.0 / 27 * last + 25.0 / 27 * s, 0.2 * ((2.0 / 13 * last + 11.0 / 13 * f) - (2.0 / 27 * last + 25.0 / 27 * s)) + 0.8 * g, 2.0 / 25 * last + 23.0 / 25 * a, 2.0 / 53 * last + 51.0 / 53 * b FROM m {_ON})
SELECT event_id, round(f, 5) AS ema_12, round(f - s, 5) + 0.0 AS macd, round(g, 5) + 0.0 AS signal, round(f - s - g, 5) + 0.0 AS histogram, round(a - b, 5) + 0.0 AS macd_long FROM m""",
)
def ema_macd(spark, sf_dir):
    t = spreads.decayed_means(_made(spark, sf_dir), DAY, ORDER, "row_at", {"ema_12": ("last", 12)})
    t = scans.macd(t, DAY, ORDER, "last", {"macd": (12, 26), "macd_long": (24, 52)}).withColumnsRenamed({"macd_signal": "signal", "macd_histogram": "histogram"})
    return t.select("event_id", F.round("ema_12", 5).alias("ema_12"), *[r(c, 5).alias(c) for c in ("macd", "signal", "histogram", "macd_long")])


def _rsi_sql(k: int) -> str:
    return f"""m{k}(contract, trade_day, n, g, l) AS (SELECT contract, trade_day, n, g, l FROM (SELECT *, avg(up) OVER w AS g, avg(down) OVER w AS l FROM t WINDOW w AS (PARTITION BY contract, trade_day ORDER BY n ROWS {k - 1} PRECEDING)) WHERE n = {k} UNION ALL SELECT t.contract, t.trade_day, t.n, (g * {k - 1} + up) / {k}, (l * {k - 1} + down) / {k} FROM m{k} m {_ON})"""


_RSI = {"rsi": 14, "rsi_short": 7, "rsi_long": 28}


@query(
    "rsi_wilder",
    f"WITH RECURSIVE {_N}, {', '.join(map(_rsi_sql, _RSI.values()))} SELECT t.event_id, {', '.join(f'round(CASE WHEN m{k}.n IS NULL THEN NULL WHEN m{k}.l = 0 THEN 100 ELSE 100 - 100 / (1 + m{k}.g / m{k}.l) END, 6) AS {name}' for name, k in _RSI.items())} FROM t {' '.join(f'LEFT JOIN m{k} ON t.contract = m{k}.contract AND t.trade_day = m{k}.trade_day AND t.n = m{k}.n' for k in _RSI.values())}",
)
def rsi_wilder(spark, sf_dir):
    return scans.rsi(_made(spark, sf_dir), DAY, ORDER, "last", _RSI).select("event_id", *[F.round(n, 6).alias(n) for n in _RSI])


@query(
    "kdj",
    f"""WITH RECURSIVE {_N}, h AS MATERIALIZED (SELECT t.*, CASE WHEN max(high) OVER w = min(low) OVER w THEN 50.0 ELSE (last - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) * 100 END AS rsv FROM (SELECT *, max(last) OVER v AS high, min(last) OVER v AS low FROM t WINDOW v AS (PARTITION BY contract, trade_day ORDER BY n ROWS 4 PRECEDING)) t WINDOW w AS (PARTITION BY contract, trade_day ORDER BY n ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
m(contract, trade_day, n, event_id, k, d) AS (SELECT contract, trade_day, n, event_id, rsv, rsv FROM h WHERE n = 9 UNION ALL SELECT h.contract, h.trade_day, h.n, h.event_id, (k * 2 + rsv) / 3, (d * 2 + (k * 2 + rsv) / 3) / 3 FROM m JOIN h ON h.contract = m.contract AND h.trade_day = m.trade_day AND h.n = m.n + 1)
SELECT t.event_id, round(3 * k - 2 * d, 6) + 0.0 AS kdj FROM t LEFT JOIN m ON t.contract = m.contract AND t.trade_day = m.trade_day AND t.n = m.n""",
)
def kdj(spark, sf_dir):
    """J over highs and lows of the last 5 ticks."""
    book = {"high": lambda s: s.max("last", 5, 1), "low": lambda s: s.min("last", 5, 1)}
    t = compute(_made(spark, sf_dir), book, list(book), DAY, ORDER)
    return scans.kdj(t, DAY, ORDER, "high", "low", "last").select("event_id", r("kdj").alias("kdj"))


_EWM = f"WITH t AS (SELECT contract, trade_day, event_id, last, row_number() OVER ({_ORDER_BY}) AS n FROM ({TICKS_SQL})), p AS (SELECT a.event_id, power({{q}}, a.n - b.n) AS w, b.last AS x FROM t a JOIN t b ON a.contract = b.contract AND a.trade_day = b.trade_day AND b.n <= a.n), s AS (SELECT event_id, count(*) AS c, sum(w) AS s, sum(w * w) AS s2, sum(w * x) / sum(w) AS m FROM p GROUP BY 1)"


@query("ewm_mean_adjust", f"{_EWM.format(q='0.8::DOUBLE')} SELECT event_id, round(m, 5) AS ewm FROM s")
def ewm_mean_adjust(spark, sf_dir):
    return scans.weighted_moments(_made(spark, sf_dir), DAY, ORDER, "last", 0.2).select("event_id", F.round("ewm_mean", 5).alias("ewm"))


@query("ewm_std", f"{_EWM.format(q='(9.0::DOUBLE / 11)')}, v AS (SELECT p.event_id, sum(p.w * (p.x - s.m) * (p.x - s.m)) AS v FROM p JOIN s USING (event_id) GROUP BY 1) SELECT event_id, round(CASE WHEN c >= 5 THEN sqrt(v / s * (s * s) / nullif(s * s - s2, 0)) END, 4) AS ewm_std FROM s JOIN v USING (event_id)")
def ewm_std(spark, sf_dir):
    t = scans.weighted_moments(_made(spark, sf_dir), DAY, ORDER, "last", 2 / 11)
    return t.select("event_id", F.when(F.col("row_at") >= 4, F.round("ewm_std", 4)).alias("ewm_std"))


_STEPS = f"""t AS MATERIALIZED (SELECT contract, trade_day, event_id, last, n, last - lag(last) OVER v AS d, depth - lag(depth) OVER v AS dd, CASE WHEN n >= 10 THEN coalesce(stddev_samp(ret) OVER (PARTITION BY contract, trade_day ORDER BY n ROWS 9 PRECEDING), 0) ELSE 0 END AS vol
FROM (SELECT *, av1 + bv1 AS depth, row_number() OVER ({_ORDER_BY}) AS n, coalesce(last / lag(last) OVER ({_ORDER_BY}) - 1, 0) AS ret FROM ({TICKS_SQL})) WINDOW v AS (PARTITION BY contract, trade_day ORDER BY n))"""


@query(
    "ewm_skew_elasticity",
    f"""WITH {_STEPS}, g AS (SELECT contract, trade_day, coalesce(nullif(avg(vol), 0), 1) AS target FROM t GROUP BY ALL), a AS (SELECT t.*, CASE WHEN vol <= 1e-8 THEN 100 ELSE greatest(10, least(100, round_even(20 * target / vol, 0))) END AS k FROM t JOIN g USING (contract, trade_day)),
p AS (SELECT a.event_id, a.dd, b.event_id AS o, power(9.0::DOUBLE / 11, a.n - b.n) AS w, power(0.8::DOUBLE, a.n - b.n) AS u, b.last AS x, b.d, b.n > a.n - a.k AS near FROM a JOIN t b ON a.contract = b.contract AND a.trade_day = b.trade_day AND b.n <= a.n),
s AS MATERIALIZED (SELECT event_id, any_value(dd) AS dd, sum(w * x) / sum(w) AS m, sum(u * d) / sum(u) FILTER (d IS NOT NULL) AS e, avg(x) FILTER (near) AS adaptive FROM p GROUP BY 1),
k AS (SELECT p.event_id, sum(p.w * power(p.x - o.m, 2)) / sum(p.w) AS v2, sum(p.w * power(p.x - o.m, 3)) / sum(p.w) AS v3 FROM p JOIN s o ON o.event_id = p.o GROUP BY 1)
SELECT event_id, round(v3 / nullif(power(v2, 1.5), 0), 5) + 0.0 AS ewm_skew, round(dd / nullif(abs(e), 0), 5) + 0.0 AS elasticity, round(adaptive, 5) + 0.0 AS adaptive FROM s JOIN k USING (event_id)""",
)
def ewm_skew_elasticity(spark, sf_dir):
    book = {"_d": lambda s: s.diff("last"), "_depth": lambda s: "av1 + bv1", "_dd": lambda s: s.diff("_depth"), "_ret": lambda s: f"coalesce({s.ret('last')}, 0)", "_vol": lambda s: f"coalesce({s.std('_ret', 10)}, 0)"}
    t = compute(_made(spark, sf_dir), book, list(book), DAY, ORDER)
    t = scans.weighted_moments(t, DAY, ORDER, "last", 2 / 11)
    weights = scans.weight_maps("_d", 0.2)
    t = scans.affine_scan(t, DAY, "row_at", {"_w": weights["w"], "_s": weights["s"]})
    t = spreads.adaptive_means(t, DAY, "row_at", "_vol", {"adaptive": ("last", 20)})
    t = t.withColumn("elasticity", F.expr("_dd / nullif(abs(_s / nullif(_w, 0)), 0)"))
    return t.select("event_id", *[r(c, 5).alias(c) for c in ("ewm_skew", "elasticity", "adaptive")])


_LARGE = f"t AS MATERIALIZED (SELECT contract, trade_day, event_id, (ap1 + bp1) / 2 AS price, ap2 AS target, row_number() OVER ({_ORDER_BY}) - 1 AS n, count(*) OVER (PARTITION BY contract, trade_day) AS c, max((ap1 + bp1) / 2) OVER ({_ORDER_BY} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS reach, av2 >= 30 AS big FROM ({TICKS_SQL}))"


@query(
    "large_order_lifecycle",
    f"""WITH RECURSIVE {_LARGE}, m(contract, trade_day, n, event_id, kept, is_kept) AS (SELECT contract, trade_day, n, event_id, CASE WHEN big THEN n ELSE -999 END, big FROM t WHERE n = 0 UNION ALL SELECT t.contract, t.trade_day, t.n, t.event_id, CASE WHEN t.big AND (kept < 0 OR t.n - kept > 3) THEN t.n ELSE kept END, t.big AND (kept < 0 OR t.n - kept > 3) FROM m {_ON})
SELECT t.event_id, CASE WHEN reach >= target THEN 'filled' WHEN target - reach <= 400 THEN 'cancelled_near' ELSE 'cancelled_far' END AS outcome FROM t JOIN m USING (contract, trade_day, n) WHERE is_kept AND t.n + 10 < c""",
)
def large_order_lifecycle(spark, sf_dir):
    return _lifecycle(spark, sf_dir).select("event_id", "outcome")


def _lifecycle(spark, sf_dir, ahead=10, gap=3, large=30, near=400):
    t = ticks(spark, sf_dir).withColumn("price", F.expr("(ap1 + bp1) / 2")).select("contract", "trade_day", "ts", "event_id", "price", "av2", "ap2")
    # rows ahead are counted up to ``ahead`` only: a frame without an end is added up anew for each row
    frame = f"OVER ({_ORDER_BY} ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING)"
    t = t.selectExpr("*", f"row_number() OVER ({_ORDER_BY}) AS n", f"max(price) {frame} AS reach", f"count(*) {frame} AS left")
    big = t.where(f"av2 >= {large}").select(*DAY, "event_id", "n", "ap2", "reach", "left")
    kept = lambda rows: recursive.spaced(rows["n"].to_numpy(), gap).astype(float)
    events = recursive.per_key(big, DAY, ["n"], {"kept": kept}).where(f"kept = 1 AND left >= {ahead}")
    return events.withColumn("outcome", F.expr(f"CASE WHEN reach >= ap2 THEN 'filled' WHEN ap2 - reach <= {near} THEN 'cancelled_near' ELSE 'cancelled_far' END"))


@query(
    "lifecycle_summary",
    ORACLE["large_order_lifecycle"].replace("SELECT t.event_id, CASE WHEN reach", "SELECT contract, count(*) FILTER (o = 'filled') AS filled, count(*) FILTER (o = 'cancelled_near') AS cancelled_near, count(*) FILTER (o = 'cancelled_far') AS cancelled_far, round(count(*) FILTER (o = 'filled') / count(*), 6) AS fill_probability, round(count(*) FILTER (o = 'cancelled_near') / count(*), 6) AS spoof_probability FROM (SELECT contract, CASE WHEN reach").replace("END AS outcome", "END AS o") + ") GROUP BY contract",
)
def lifecycle_summary(spark, sf_dir):
    kinds = ["filled", "cancelled_near", "cancelled_far"]
    p = _lifecycle(spark, sf_dir).groupBy("contract").pivot("outcome", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return p.select("contract", *kinds, F.round(F.col("filled") / total, 6).alias("fill_probability"), F.round(F.col("cancelled_near") / total, 6).alias("spoof_probability"))


@query(
    "large_order_impact",
    f"""WITH t AS (SELECT *, lead(last, 5) OVER ({_ORDER_BY}) / last - 1 AS label FROM ({TICKS_SQL})), s AS ({" UNION ALL ".join(f"SELECT '{c}{i}' AS level, {c}{i} >= 30 AS big, label FROM t" for c in ("av", "bv") for i in range(1, 6))})
SELECT level, round(avg(label) FILTER (big), 8) + 0.0 AS large_label, round(avg(label) FILTER (NOT big), 8) + 0.0 AS normal_label, round(avg(abs(label)) FILTER (big) / avg(abs(label)) FILTER (NOT big), 6) AS ratio, round(avg(CASE WHEN big THEN 1.0 ELSE 0.0 END), 6) AS frequency FROM s GROUP BY level""",
)
def large_order_impact(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("label", F.expr(f"lead(last, 5) OVER ({_ORDER_BY}) / last - 1"))
    levels = [f"{c}{i}" for c in ("av", "bv") for i in range(1, 6)]
    s = t.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("level"), (F.col(c) >= 30).alias("big")) for c in levels])).alias("x")).select("label", "x.*")
    on = lambda c, big: F.avg(F.when(F.col("big") == big, c))
    return s.groupBy("level").agg(r(on(F.col("label"), True), 8).alias("large_label"), r(on(F.col("label"), False), 8).alias("normal_label"), F.round(on(F.abs("label"), True) / on(F.abs("label"), False), 6).alias("ratio"), F.round(F.avg(F.when(F.col("big"), 1.0).otherwise(0.0)), 6).alias("frequency"))


# --- models ---------------------------------------------------------------------------------------------------------------------------


def _ridge_sql() -> str:
    """Cramer's rule for three centred features with 1 on the diagonal."""
    x = _FACTORS
    cov = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    parts = [f"{cov(x[i], x[j])}{' + 1' if i == j else ''} AS g{i}{j}" for i in range(3) for j in range(3)] + [f"{cov(x[i], 'label')} AS y{i}" for i in range(3)] + [f"avg({c}) AS m{i}" for i, c in enumerate(x)] + ["avg(label) AS my"]

    def det(column: int | None) -> str:
        g = [[f"y{i}" if j == column else f"g{i}{j}" for j in range(3)] for i in range(3)]
        return f"({g[0][0]} * ({g[1][1]} * {g[2][2]} - {g[1][2]} * {g[2][1]}) - {g[0][1]} * ({g[1][0]} * {g[2][2]} - {g[1][2]} * {g[2][0]}) + {g[0][2]} * ({g[1][0]} * {g[2][1]} - {g[1][1]} * {g[2][0]}))"

    weights = ", ".join(f"{det(i)} / {det(None)} AS w{i}" for i in range(3))
    return f"WITH m AS ({MATRIX}), s AS (SELECT {', '.join(parts)} FROM m WHERE l_shipdate < DATE '{_SPLIT}'), w AS (SELECT *, {weights} FROM s) SELECT l_orderkey, l_linenumber, round(my + {' + '.join(f'w{i} * ({c} - m{i})' for i, c in enumerate(x))}, 5) AS prediction FROM m, w WHERE l_shipdate >= DATE '{_SPLIT}'"


@query("ridge", _ridge_sql())
def ridge(spark, sf_dir):
    m = matrix(spark, sf_dir)
    train, test = dataset.split_by_day(m, "l_shipdate", _SPLIT)
    model = ml.ridge(train, _FACTORS, "label", 1.0)
    return ml.apply_linear(test, model).select("l_orderkey", "l_linenumber", F.round("prediction", 5).alias("prediction"))


_ROW = ["l_orderkey", "l_linenumber", *_FACTORS, "label"]


@query("elastic_net")
def elastic_net(spark, sf_dir):
    return linear.elastic_net(matrix(spark, sf_dir), _FACTORS, "label", "l_shipdate", _ROW)


@query(
    "fold_moments",
    f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, {', '.join(_ROW)}) - 1 AS n, count(*) OVER () AS c FROM ({MATRIX})),
f AS (SELECT CAST(CASE WHEN n < c - 5 * (c // 6) THEN 0 ELSE 1 + (n - (c - 5 * (c // 6))) // (c // 6) END AS INTEGER) AS fold, [1.0::DOUBLE, {', '.join(_FACTORS)}, label] AS x FROM m)
SELECT fold, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(x[i] * x[j]), 3) + 0.0 AS v FROM f, LATERAL (SELECT unnest(range(1, 6)) AS i), LATERAL (SELECT unnest(range(1, 6)) AS j) WHERE i <= j GROUP BY ALL""",
)
def fold_moments(spark, sf_dir):
    """What the elastic net is solved from."""
    rows = linear.time_folds(matrix(spark, sf_dir), "l_shipdate", _ROW)
    return linear.products(rows, [*_FACTORS, "label"], "fold").select("fold", "i", "j", r("v", 3).alias("v"))


@query("incremental_factors")
def incremental_factors(spark, sf_dir):
    """What each of some tick factors adds to order imbalance, learnt on the first 20 days and traded on the others."""
    candidates = ["spread", "ofi1", "net_inflow", "market_pressure", "relative_spread"]
    book = {**TICK, "label": lambda s: s.div(s.lead("mid", 2), "mid") + " - 1"}
    rows = compute(ticks(spark, sf_dir), book, ["order_imbalance", *candidates, "ap1_trade", "bp1_trade", "label"], DAY, ORDER)
    split = F.expr("(SELECT date_add(min(CAST(ts AS DATE)), 20) FROM {e})".replace("{e}", f"parquet.`{sf_dir}/events.parquet`"))
    rows = rows.withColumn("_split", split)
    train, test = rows.where("trade_day < _split"), rows.where("trade_day >= _split").withColumns({"ap1": F.col("ap1_trade"), "bp1": F.col("bp1_trade")})
    out = linear.incremental_test(train, test.dropna(subset=["ap1", "bp1"]), ["order_imbalance"], candidates, "label", "contract", "trade_day", ORDER)
    return out.select("candidate", *[F.round(c, 6).alias(c) for c in ("ic", "long", "short", "net_value")])


@query("gbt_importance")
def gbt_importance(spark, sf_dir):
    train, _ = dataset.split_by_day(matrix(spark, sf_dir), "l_shipdate", _SPLIT)
    return ml.normalised_importance(ml.gbt(train, _FACTORS, "label", rounds=5)[1], "gain")


@query("model_scoring", f"SELECT l_orderkey, l_linenumber, round(l_quantity * 0.5 - l_discount * 2, 6) + 0.0 AS prediction FROM ({MATRIX})")
def model_scoring(spark, sf_dir):
    return ml.score(matrix(spark, sf_dir), _FACTORS[:2], lambda x: x[:, 0] * 0.5 - x[:, 1] * 2).select("l_orderkey", "l_linenumber", r("prediction").alias("prediction"))


@query(
    "ewma_vol_forecast",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT day, abs(ret) AS x, CAST(year(day) AS INTEGER) AS y, row_number() OVER (PARTITION BY year(day) ORDER BY day) AS n FROM ({_DAYS}) WHERE ret IS NOT NULL),
m(y, n, day, e) AS (SELECT y, n, day, x FROM d WHERE n = 1 UNION ALL SELECT d.y, d.n, d.day, 2.0 / 11 * d.x + 9.0 / 11 * m.e FROM m JOIN d ON d.y = m.y AND d.n = m.n + 1)
SELECT day, round(lag(e) OVER w, 8) AS forecast, CASE WHEN lag(e) OVER w > 0.6 THEN 'hv' WHEN lag(e) OVER w <= 0.6 THEN 'lv' END AS regime FROM m WINDOW w AS (PARTITION BY y ORDER BY n)""",
)
def ewma_vol_forecast(spark, sf_dir):
    d = days(spark, sf_dir).where("ret IS NOT NULL").select("day", F.abs("ret").alias("x"), F.year("day").alias("y"))
    e = recursive.per_key(d, ["y"], ["day"], {"e": lambda rows: recursive.ewm_mean(rows["x"].to_numpy(), 2 / 11, adjust=False)})
    f = F.expr("lag(e) OVER (PARTITION BY y ORDER BY day)")
    return e.select("day", F.round(f, 8).alias("forecast"), dataset.vol_regime(f, 0.6).alias("regime"))


@query(
    "back_adjustment",
    f"""WITH d AS (SELECT contract, trade_day, max_by(last, (ts, event_id)) AS close, min_by(last, (ts, event_id)) AS presettle FROM ({TICKS_SQL}) GROUP BY 1, 2), r AS (SELECT *, ln(presettle / lag(close) OVER (PARTITION BY contract ORDER BY trade_day)) AS r FROM d)
SELECT contract, trade_day, round(exp(coalesce(sum(r) OVER (PARTITION BY contract ORDER BY trade_day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 7) AS factor FROM r""",
)
def back_adjustment(spark, sf_dir):
    d = ticks(spark, sf_dir).groupBy(*DAY).agg(F.max_by("last", F.struct(*ORDER)).alias("close"), F.min_by("last", F.struct(*ORDER)).alias("presettle"))
    return joins.back_adjusted(d, ["contract"], "trade_day").select(*DAY, F.round("factor", 7).alias("factor"))


@query(
    "hurst_slope",
    f"""WITH t AS (SELECT contract, last, row_number() OVER (PARTITION BY contract ORDER BY ts, event_id) - 1 AS n FROM ({TICKS_SQL})), z AS (SELECT unnest([10, 20, 50, 100]) AS size),
g AS (SELECT contract, size, n // size AS part, list(last ORDER BY n) AS x FROM t, z GROUP BY 1, 2, 3 HAVING count(*) = size), s AS (SELECT contract, size, list_stddev_pop(x) AS sd, [list_sum(x[1:i]) - i * list_avg(x) for i in range(1, size + 1)] AS y FROM g),
m AS (SELECT contract, size, avg((list_max(y) - list_min(y)) / sd) AS rs FROM s WHERE sd > 0 GROUP BY 1, 2)
SELECT contract, round(regr_slope(ln(rs), ln(size)), 6) AS hurst, (SELECT count(*) FROM t WHERE t.contract = m.contract) AS n FROM m GROUP BY contract""",
)
def hurst_slope(spark, sf_dir):
    """One slope a contract; segments of up to 100 ticks."""
    out = recursive.hurst_slopes(ticks(spark, sf_dir), "contract", "trade_day", ORDER, "last")
    return out.select("contract", F.round("hurst", 6).alias("hurst"), "n")


@query("ts_beta", f"SELECT l_returnflag, round(coalesce(regr_slope(label, l_quantity), 0), 7) AS beta FROM ({MATRIX}) GROUP BY 1")
def ts_beta(spark, sf_dir):
    return matrix(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.coalesce(F.regr_slope("label", "l_quantity"), F.lit(0.0)), 7).alias("beta"))


@query(
    "scored_sweep",
    f"""WITH t AS (SELECT *, (lead(last, 5) OVER w - last) / 1000 AS y, row_number() OVER w AS n, avg(order_imbalance) OVER f AS a, count(order_imbalance) OVER f AS c, count(spread) OVER f AS d FROM ({features_sql()}) WINDOW w AS ({_ORDER_BY}), f AS ({_ORDER_BY} ROWS 9 PRECEDING)),
p AS (SELECT 3 * a AS p, y FROM t WHERE n >= 10 AND (n - 10) % 2 = 0 AND c = 10 AND d = 10 AND y IS NOT NULL), g AS (SELECT k / 20.0::DOUBLE AS t FROM (SELECT unnest(range(0, 10)) AS k)), x AS (SELECT t, CASE WHEN p > t THEN y - 0.05 WHEN p < -t THEN -y - 0.05 END AS x FROM p, g)
SELECT t AS threshold, count(x) AS signals, round(15 * coalesce(sum(x), 0), 4) AS dq, round(sum(greatest(x, 0)) / nullif(sum(greatest(-x, 0)), 0), 6) AS dqr FROM x GROUP BY t""",
)
def scored_sweep(spark, sf_dir):
    """Scoring of sampled rolling features and a threshold sweep of the predictions, as one plan."""
    from .pipelines import scored, swept

    t = features(spark, sf_dir).withColumn("y", F.expr("(lead(last, 5) OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) - last) / 1000"))
    p = scored(t, ["order_imbalance", "spread"], lambda x: x[:, 0] * 3, window=10, stride=2)
    return swept(p, "y", 0.05, _GRID[:10]).select("threshold", "signals", F.round("dq", 4).alias("dq"), F.round("dqr", 6).alias("dqr"))


_LIQ = ("final_spread", "impact_skew", "cost_bps")
_SNAP = "SELECT trade_day, date_trunc('hour', ts) AS ts, max_by(final_spread, (t.ts, event_id)) AS final_spread FROM ({t}) t WHERE contract = '{c}' GROUP BY 1, 2"


@query(
    "main_second_liquidity",
    f"""WITH k AS MATERIALIZED (SELECT contract, trade_day, ts, event_id, final_spread FROM ({levelled(TICKS_SQL, factor_sql.LIQUIDITY, ["final_spread"], BOOK_COLUMNS, DAY)})), a AS ({_SNAP.format(t="SELECT * FROM k", c="click")}), b AS ({_SNAP.format(t="SELECT * FROM k", c="view")}),
d AS (SELECT trade_day, max(volume) FILTER (contract = 'click') AS a, max(volume) FILTER (contract = 'view') AS b FROM ({TICKS_SQL}) GROUP BY trade_day), f AS (SELECT trade_day, coalesce(least(500.0, lag(a / nullif(b, 0)) OVER (ORDER BY trade_day)), 1.0) AS multiplier FROM d WHERE a IS NOT NULL AND b IS NOT NULL),
x AS (SELECT a.trade_day, a.ts, a.final_spread AS m, b.final_spread AS s, b.final_spread * multiplier AS k FROM a JOIN b ON a.trade_day = b.trade_day AND a.ts = b.ts JOIN f ON f.trade_day = a.trade_day)
SELECT trade_day, ts, round(m, 4) AS final_spread_main, round(s, 4) AS final_spread_second, round(k, 4) AS scaled_spread_second FROM x WHERE trade_day > (SELECT min(trade_day) FROM x)""",
)
def main_second_liquidity(spark, sf_dir):
    """Liquidity of two contracts on their ticks, at the ends of equal hours, the second scaled by the day before's volumes."""
    from .pipelines import main_and_second

    def hourly(t):
        values = [c for c in t.columns if c not in ("trade_day", "ts", "event_id")]
        last = F.max_by(F.struct(*values), F.struct("ts", "event_id"))
        return t.groupBy("trade_day", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(last.alias("x")).select("trade_day", F.col("hour").alias("ts"), "x.*")

    t = ticks(spark, sf_dir)
    out = main_and_second(t.where("contract = 'click'"), t.where("contract = 'view'"), _LIQ, hourly)
    return out.select("trade_day", "ts", *[F.round(c, 4).alias(c) for c in ("final_spread_main", "final_spread_second", "scaled_spread_second")])
