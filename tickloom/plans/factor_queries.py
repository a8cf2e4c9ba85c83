"""Queries of tick and minute factors and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import Sql, over
from ..functions.factors import MINUTE, TICK, compute, ts_corr, ts_mean, ts_std
from ..functions.kernels import KERNEL
from ..functions.liquidity import LIQUIDITY
from ..operators.order_stats import Quantile, frame_order
from . import factor_sql
from .tables import BOOK_COLUMNS, CONTRACT, ORDER, TICKS_SQL, bars, levelled, numbered_ticks, ticks, with_mean_volume

DAY = ["contract", "trade_day"]
QUERIES, ORACLE = {}, {}
#: Of each query its plan's book, its SQL's book, its factors, and whether it stands on bars.
FACTORS: dict[str, tuple] = {}


def rounded(names: dict[str, int]) -> list[str]:
    return [f"CAST(round({n}, {d}) + 0.0 AS DOUBLE) AS {n}" for n, d in names.items()]


def bars_sql(extra=()) -> str:
    book = factor_sql.TICK | factor_sql.BAR_PRE | {f"bar_{k}": v for k, v in factor_sql.BAR_SQL_COLUMNS.items()}
    names = ["bar_no", *(f"bar_{k}" for k in factor_sql.BAR_SQL_COLUMNS), *extra]
    columns = ", ".join([*(f"bar_{k} AS {k}" for k in factor_sql.BAR_SQL_COLUMNS), *extra])
    return f"SELECT contract, trade_day, ts, event_id, {columns} FROM ({levelled(TICKS_SQL, book, names, BOOK_COLUMNS, CONTRACT)}) b WHERE bar_no % 10 = 0"


def add(name: str, book: dict, sql: dict, names: dict[str, int], keys=CONTRACT, minute: bool = False, extra=(), table=None):
    """A query of factors, each rounded to some digits."""
    keep = ["contract", "event_id"]

    def run(spark, sf_dir):
        rows = bars(spark, sf_dir, tuple(extra)) if minute else ticks(spark, sf_dir) if keys == DAY else numbered_ticks(spark, sf_dir)
        return compute(table(rows) if table else rows, book, [n for n in names if n not in extra], keys, ORDER).select(*keep, *[F.expr(e) for e in rounded(names)])

    have = ["contract", "trade_day", "ts", "event_id", *factor_sql.BAR_SQL_COLUMNS, *extra] if minute else BOOK_COLUMNS
    FACTORS[name] = book, sql, [n for n in names if n not in extra], minute
    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join([*keep, *rounded(names)])} FROM ({levelled(bars_sql(extra) if minute else TICKS_SQL, sql, names, have, keys)}) f"


def tick(name: str, names: dict[str, int], keys=CONTRACT):
    add(name, TICK, factor_sql.TICK, names, keys)


def minute(name: str, names: dict[str, int], **more):
    add(name, MINUTE, factor_sql.MINUTE, names, minute=True, **more)


_many = lambda d, *names: dict.fromkeys(names, d)

tick("mid_price", _many(4, "mid", "spread", "relative_spread"), DAY)
tick("trade_direction", _many(4, "delta_volume", "delta_turnover", "bigorder_volume", "is_bigorder", "trade_direction", "buy_volume", "sell_volume", "net_inflow", "estimated_exec_price"), DAY)
tick("depth_imbalance", _many(8, "bid_depth", "ask_depth", "total_depth", "order_imbalance", "bid_ask_volume_ratio", "effective_depth"), DAY)
tick("order_imbalance_ma", _many(7, *[f"oi_ma_{k}" for k in (10, 60, 120, 300, 600)], *[f"oi_momentum_{k}" for k in (10, 60, 120, 300, 600)]))
tick("order_imbalance_moments", _many(6, *[f"oi_std_{k}" for k in (120, 300, 600)], "oi_skew_120", "oi_skew_600"))
tick("ofi_levels", _many(2, *[f"ofi{i}" for i in range(1, 6)], "mofi"), DAY)
tick("soir", _many(8, *[f"soir{i}" for i in range(1, 6)], "soir", "soir_weighted"), DAY)
tick("effective_spread", _many(9, "effective_spread"), DAY)
tick("market_pressure", _many(8, "market_pressure"), DAY)
tick("volume_moments", _many(6, "vol_std_120", "vol_std_600", "vol_skew_120", "vol_skew_600"))
tick("ret_forward_label", _many(12, "tick_ret", "ret_600", "tick100_ret"))
tick("vol_mid_corr", _many(6, "vol_mid_corr_120", "vol_mid_corr_600"))
tick("rp_momentum", _many(0, "rp_momentum_20", "rp_momentum_120", "rp_momentum_600"))
tick("delta2", _many(5, "delta2_tick", "delta2_10s", "delta2_60s", "delta2_1min", "delta2_5min"))
tick("price_elasticity", _many(8, "high_120", "low_120", "open_120", "price_elasticity", "elasticity_min"))
tick("next_quotes", _many(2, "ap1_trade", "bp1_trade", "vol"))
tick("bigorder_returns", _many(8, "volweight_bigorder_ret", "mean_bigorder_ret", "bigorder_pct"))
tick("bigorder_flows", _many(3, "bigorder_vol_1min", "buy_vol_1min", "sell_vol_1min", "bigbuy_vol_1min", "bigsell_vol_1min"))
tick("vwap_roll", _many(4, "vwap", "ab_vol", "effective_depth_min"))
tick("net_inflow_stats", _many(5, "net_inflow_min", "net_inflow_std", "net_inflow_skew"))
tick("gate_rv", _many(6, "gate_rv", "gate_downside_ratio", "obi_cum120", "rolling_high", "rolling_low", "rolling_amp", "gate_rv_log", "gate_range_log"))
tick("gate_indicators", _many(6, "gate_spread", "gate_depth", "gate_rv_5", "gate_range", "gate_l1_imbalance", "gate_l5_imbalance", "gate_order_imbalance", "gate_oi_change", "gate_trade_intensity", "gate_rsi", "gate_dist_avg", "gate_trend", "gate_session_decay", "gate_open_impulse"))
minute("delta_vol", _many(2, *[f"delta_vol_{k}" for k in (1, 2, 4, 8, 16)]))

minute("oi_change", _many(8, "oi_change", "ret_min", "ret_5min"))
minute("realized_vol", _many(6, "realized_vol_10", "realized_vol_30", "realized_vol_60"))
minute("rs_vol", _many(5, "rs_vol_10", "rs_vol_30", "pvol_oi_ratio"))
minute("roll_std_minute", _many(7, "pvol_5min", "pvol_30min", "spread_volatility"))
minute("pv_corr", _many(6, "pv_corr_10", "pv_corr_30", "pv_corr_120", "rv_corr_10", "rv_corr_30", "rv_corr_120"))
minute("ivol", _many(7, "ivol_10", "ivol_30"))
minute("channel_position", _many(6, "upper_band", "lower_band", "channel_position", "slope", "price_pos"))
minute("volume_zscore", _many(6, "volume_zscore", "volume_cluster", "volume_oi_ratio", "oi_support"))
minute("effective_depth_minute", _many(6, "effective_depth_5min", "effective_depth_10min", "effective_depth_30min"))
minute("volume_shares", _many(6, *[f"{p}_vol_pct_{k}min" for p in ("bigorder", "buy", "sell", "bigbuy", "bigsell") for k in (1, 5, 10, 30)]))
minute("roll_kurt", _many(5, "ret_kurt_10", "ret_kurt_30", "ret_kurt_120"))
minute("cv", _many(6, "cv_10", "cv_30", "vcv_10", "vcv_30"))
minute("amihud", _many(7, "illiq_ratio", "amihud_ratio_10", "amihud_ratio_30", "amihud_ratio_60"))
minute("amivest", _many(0, "amivest_lr_10", "amivest_lr_30"))
minute("avedev_cci", _many(5, "avedev_10", "avedev_30", "cci_10", "cci_30"))
minute("adtm", _many(6, "dtm", "dbm", "adtm_10m", "adtm_30m"))
minute("roll_skew", _many(5, "skew_overall_10m", "skew_overall_30m", "skew_upside_10m", "skew_upside_30m", "skew_downside_10m", "skew_downside_30m"))
minute("trend_strength", _many(6, "trend_strength_10", "trend_strength_30"))
minute("cls_abs_var", _many(4, "cls_abs_var_10", "cls_abs_var_30"))
minute("mfi", _many(5, "mfi_10m", "mfi_30m"))
minute("pelas", _many(9, "pelas_5min", "pelas_10min", "pelas_30min"))
minute("fuzziness", _many(6, "fuzziness", "fuzzy_corr"))
minute("oi_corr", _many(6, "oi_vol_corr_10", "oi_vol_corr_30", "oi_ret_corr_10", "oi_ret_corr_30"))
minute("flow_in_ratio", _many(6, "flow_in_ratio_10m", "flow_in_ratio_30m"))
minute("oi_flow", _many(6, "oiflow_ratio_10min", "oiflow_ratio_30min"))
minute("volret_ratio", _many(3, "volret_ratio_10", "volret_ratio_30"))
minute("vr", _many(6, "vr_10", "vr_30"))
minute("netflow", _many(5, *[f"netflow_{x}{k}min" for x in ("", "std_") for k in (5, 10, 30)]))
minute("cmo", _many(6, "cmo_10", "cmo_30"))
minute("up_vol_ratio", _many(6, "up_vol_ratio_10", "up_vol_ratio_30", "variance_diff_10m", "variance_diff_30m"))
minute("coppock", _many(6, "coppock_5_10_30m", "coppock_10_15_30m"))
minute("ab_nr", _many(6, "is_reversal", "nr_10", "nr_30", "ab_nr_10m", "ab_nr_30m"))
minute("rsj", _many(6, "rsj_10", "rsj_30"))
minute("ar_br", _many(5, "ar_10", "ar_30", "br_10", "br_30"))
minute("psy", _many(6, "psy_10", "psy_30", "psy_60"))
minute("atr", _many(7, "atr"))
minute("bollinger", _many(6, "ma20", "upper_bb", "lower_bb"))
minute("turnover_minute", _many(1, "turnover_5min", "turnover_10min"))
minute("entropy_vol", _many(6, "entropy_vol_10", "entropy_vol_30"))
minute("adl", _many(4, "adl_10", "adl_30"))
minute("ddi", _many(6, "ddi_10", "ddi_30"))
minute("emv", _many(-4, "emv_10min", "emv_30min"), table=with_mean_volume)
minute("inflection", _many(4, "inflection_count", "inflection_oscillator"))
minute("cumulative_amplitude", _many(6, "cum_amplitude_10m", "cum_amplitude_30m"))
minute("weight_buysell", _many(0, "weight_buysell_10", "weight_buysell_30"))
minute("ewm_vol", _many(6, "ewm_vol_10", "ewm_vol_30"))
minute("weight_ret_skew", _many(4, "weight_ret_skew_10min", "weight_ret_skew_30min"))
minute("peak_reversal", _many(6, "peak_reversal_10", "peak_reversal_30"))
minute("superior_covariance", _many(5, "superior_cov_10", "superior_cov_30"))
minute("cvar", _many(7, "cvar_10", "cvar_30"))
minute("trend_fund", _many(7, "vol_threshold", "trend_10", "trend_30"), table=lambda b: frame_order(b, CONTRACT, ORDER, {"vol_threshold": Quantile("vol", 0.8, 240, 10)}))
minute("roll_quantile", _many(4, "q80_10", "q20_10", "q80_30", "q20_30"))
minute("context_set", _many(6, "psy_60", "ret_kurt_120", "amihud_ratio_60", "ret_5min", "ar_10", "lower_bb", "cv_30", "cvar_10", "bigorder_pct") | {"rp_momentum_120": 0}, extra=("bigorder_pct", "rp_momentum_120"))
minute("market_set", _many(5, "rs_vol_30", "channel_position", "ret_kurt_120", "amihud_ratio_60", "mfi_30m", "cci_30", "psy_60") | {"rp_momentum_600": 0}, extra=("rp_momentum_600",))

# frame primitives by themselves
PRIMITIVE = {
    "x": lambda s: "CASE WHEN event_id % 17 = 0 THEN NULL ELSE last / 100 END",
    "mean_10": lambda s: s.mean("x", 10),
    "mean_10_5": lambda s: s.mean("x", 10, 5),
    "sum_10_1": lambda s: s.sum("x", 10, 1),
    "std_20_5": lambda s: s.std("x", 20, 5),
    "var_20_5": lambda s: s.var("x", 20, 5),
    "skew_20_10": lambda s: s.skew("x", 20, 10),
    "kurt_20_10": lambda s: s.kurt("x", 20, 10),
    "max_14_1": lambda s: s.max("x", 14, 1),
    "min_14_1": lambda s: s.min("x", 14, 1),
    "median_10_5": lambda s: s.quantile("x", 0.5, 10, 5),
    "q05_30_10": lambda s: s.quantile("x", 0.05, 30, 10),
    "q95_30_10": lambda s: s.quantile("x", 0.95, 30, 10),
    "corr_20_10": lambda s: s.corr("x", "volume", 20, 10),
    "filled": lambda s: s.ffill("x"),
    "lag_5": lambda s: s.lag("x", 5),
    "lead_3": lambda s: s.lead("x", 3),
    "diff_10": lambda s: s.diff("x", 10),
    "pct_5": lambda s: s.div("filled", s.lag("filled", 5)) + " - 1",
    "sum_so_far": lambda s: "sum(x) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "max_so_far": lambda s: "max(x) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "vwma_10": lambda s: f"CASE WHEN {s.sum('volume', 10)} > 0 THEN {s.sum('last * volume', 10)} / {s.sum('volume', 10)} END",
    "clipped": lambda s: s.clip("x", 150, 300),
    "ts_mean": lambda s: ts_mean(s, "last"),
    "ts_std": lambda s: ts_std(s, "last"),
    "ts_corr": lambda s: ts_corr(s, "last", "openinterest"),
    "frame": lambda s: s.array("x", 30),
    "rank_30_5": lambda s: f"CASE WHEN {s.size('frame')} >= 5 AND x IS NOT NULL THEN CASE WHEN max(x) {over(30)} = min(x) {over(30)} THEN CAST(0.5 AS DOUBLE) ELSE least(greatest(CAST({below(s)} + 0.5 AS DOUBLE) / ({s.size('frame')} - 1), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END END",
}


def below(s: Sql) -> str:
    """How many values of the frame are below the row's (``here`` keeps the name apart from the element's)."""
    return s.size(s.only("frame", "x < here"))


PRIMITIVE["here"] = lambda s: "x"
for _name, _digits in (
    ("roll_mean_mp", _many(7, "mean_10", "mean_10_5", "sum_10_1")), ("roll_std", {"std_20_5": 5, "var_20_5": 2}), ("roll_skew_kurt", _many(5, "skew_20_10", "kurt_20_10")), ("roll_minmax", _many(4, "max_14_1", "min_14_1", "median_10_5")),
    ("roll_quantile_mp", _many(5, "q05_30_10", "q95_30_10")), ("roll_corr_guarded", _many(6, "corr_20_10")), ("ffill_shift_diff", _many(6, "filled", "lag_5", "lead_3", "diff_10", "pct_5")), ("expanding", _many(5, "sum_so_far", "max_so_far")),
    ("vwma", _many(5, "vwma_10", "clipped")), ("ts_mean_std_corr", _many(5, "ts_mean", "ts_std", "ts_corr")), ("ts_rank", _many(7, "rank_30_5")),
):
    add(_name, PRIMITIVE, factor_sql.PRIMITIVE, _digits, DAY)


def book(name: str, names: dict[str, int], keys=CONTRACT):
    add(name, LIQUIDITY, factor_sql.LIQUIDITY, names, keys)


book("wbas", _many(5, "wbas", *[f"spread_l{i}" for i in range(1, 6)]), DAY)
book("sweep_cost", _many(5, "sweep_last_a", "sweep_last_b", "sweep_penalty_a", "sweep_penalty_b", "sweep_linear_a", "sweep_linear_b", "sweep_20_a", "sweep_20_b", "sweep_penalty_02_a", "sweep_penalty_02_b"), DAY)
book("weighted_price_robust", _many(5, "sweep_robust_a", "sweep_robust_b"), DAY)
book("active_flow_matrix", _many(5, *[f"{side}_{a}_{p}" for side in ("buy", "sell") for a in ("lee_ready", "bvc", "proportional") for p in ("mid", "last", "atp")]))
book("order_flow_demand", _many(5, "flow_total", "demand_buy", "demand_sell", "demand_buy_6", "demand_sell_6"))
book("volume_outliers", _many(4, *[f"{side}v{i}_{kind}" for side in "ab" for i in range(1, 6) for kind in ("trunc", "neighbour", "median", "zero")], *[f"outlier_spread_{kind}" for kind in ("trunc", "neighbour", "median", "zero")]))
book("dssp_depth", _many(6, "dssp_ask", "dssp_bid"))
book("depth_change", _many(3, "depth_change_ask", "depth_change_bid", "depth_change_ask_5", "depth_change_bid_5", "aligned_change_ask", "aligned_change_bid"), DAY)
book("resilience", _many(6, "refill_ask", "refill_bid", "resilience_ask", "resilience_bid", "refill_ask_5", "refill_bid_5", "resilience_ask_5", "resilience_bid_5"))
book("final_spread", _many(5, "final_spread", "final_spread_adjusted", "impact_skew", "final_spread_flows", "final_spread_120", "dssp_spread", "cost_bps"))
book("rolling_spread", _many(5, *[f"rolling_{x}{m}" for x in ("spread", "skew", "spread_mean") for m in ("", "_5", "_aligned")], "spread_mean", "deep_spread_mean"))
book("amihud_ticks", {"amihud_240": 9})
book("vwap_labels", _many(4, *[f"vwap_label{x}_{k}" for x in ("", "_dir", "_ask", "_bid") for k in (120, 600, 1800)], "vwap_60_label"))
for _name, _digits in (("quad_regression", _many(4, "regression_factor_10", "regression_factor_30", "regr_r2_ret_10", "regr_r2_ret_30")), ("hurst_rs", _many(5, "hurst_10", "hurst_30", "hurst_60")), ("amplitude", _many(7, "amplitude_10", "amplitude_30")), ("struct_rev", _many(5, "struct_rev_10", "struct_rev_30"))):
    add(_name, KERNEL, factor_sql.KERNEL, _digits, minute=True)
