"""Tick and minute factors by name.

``TICK`` factors stand on the order-book columns of ``sources.ticks``; ``MINUTE`` factors on the columns of
a down-sampled table (price, high, low, open, vol, dollar_volume, openinterest and so on).  A factor is a
function of an ``Sql`` builder; what it needs is found by name.  ``compute`` works them out in as few
projections as their dependencies allow, so factors of one level share one pass over each window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expressions import SO_FAR, Spark, Sql, over

LEVELS = range(1, 6)
CARRIED = 1000
#: Rows before that a factor with an open frame looks at in effect.
OPEN_FRAMES = {"step_row": CARRIED, "last_sign": CARRIED, "tick_row": 0, "row_no": 0}
#: Rows of a block, at least.
BLOCK_ROWS = 8192
TICK: dict[str, Callable[[Sql], str]] = {}
MINUTE: dict[str, Callable[[Sql], str]] = {}


def _fill(book: dict, **factors):
    book.update(factors)


def _sum(template: str, ks: Iterable[int] = LEVELS) -> str:
    return "(" + " + ".join(template.format(i=i) for i in ks) + ")"


# --- ticks: quotes and trades ------------------------------------------------------------------------------

_fill(
    TICK,
    # a side without quotes is 0; with both missing the mid is 0, and so unknown
    mid=lambda s: "nullif(CASE WHEN ap1 = 0 THEN bp1 WHEN bp1 = 0 THEN ap1 ELSE (bp1 + ap1) / 2 END, 0)",
    # volume and turnover add up over a day and begin anew with the next one
    delta_volume=lambda s: f"CASE WHEN trade_day = {s.lag('trade_day')} THEN {s.diff('volume')} ELSE volume END",
    delta_turnover=lambda s: f"CASE WHEN trade_day = {s.lag('trade_day')} THEN {s.diff('turnover')} ELSE turnover END",
    volume_step=lambda s: f"CASE WHEN trade_day = {s.lag('trade_day')} THEN abs({s.diff('volume')}) END",
    bigorder_volume=lambda s: f"CASE WHEN trade_day = {s.lag('trade_day')} AND {s.diff('volume')} >= 10 THEN {s.diff('volume')} ELSE 0 END",
    is_bigorder=lambda s: "CASE WHEN bigorder_volume > 0 THEN 1 ELSE 0 END",
    # the last price step's sign, where it is not over ``CARRIED`` rows ago
    last_step=lambda s: s.diff("last"),
    tick_row=lambda s: "row_number() OVER ({P})",
    step_row=lambda s: f"max(CASE WHEN last_step IS NOT NULL THEN tick_row END) {SO_FAR}",
    last_sign=lambda s: f"CASE WHEN tick_row - step_row < {CARRIED} THEN {s.ffill('sign(last_step)')} END",
    trade_direction=lambda s: "CASE WHEN last > mid THEN 1 WHEN last < mid THEN -1 ELSE coalesce(last_sign, 0) END",
    buy_volume=lambda s: "CASE WHEN trade_direction = 1 THEN delta_volume ELSE 0 END",
    sell_volume=lambda s: "CASE WHEN trade_direction = -1 THEN delta_volume ELSE 0 END",
    net_inflow=lambda s: "buy_volume - sell_volume",
    estimated_exec_price=lambda s: "CASE trade_direction WHEN 1 THEN ap1 WHEN -1 THEN bp1 ELSE last END",
    spread=lambda s: "ap1 - bp1",
    bid_depth=lambda s: _sum("bv{i}"),
    ask_depth=lambda s: _sum("av{i}"),
    total_depth=lambda s: "bid_depth + ask_depth",
    order_imbalance=lambda s: s.div("bid_depth - ask_depth", "bid_depth + ask_depth"),
    effective_spread=lambda s: s.div("2 * (CASE WHEN last > mid THEN 1 WHEN last < mid THEN -1 ELSE 0 END) * (last - mid)", "mid"),
    market_pressure=lambda s: s.div("bp1 * bv1 - ap1 * av1", "bp1 * bv1 + ap1 * av1"),
    soir=lambda s: "(" + " + ".join(f"soir{i}" for i in LEVELS) + ")",
    soir_weighted=lambda s: "(" + " + ".join(f"{6 - i} * soir{i}" for i in LEVELS) + ")",
    bid_ask_volume_ratio=lambda s: s.div("bid_depth", "ask_depth"),
    relative_spread=lambda s: s.div("ap1 - bp1", "(ap1 + bp1) / 2"),
    mofi=lambda s: "(" + " + ".join(f"ofi{i}" for i in LEVELS) + ")",
    tick_ret=lambda s: s.ret("mid"),
    ret_600=lambda s: s.div(s.lead("mid", 601), s.lead("mid", 1)) + " - 1",
    delta2_tick=lambda s: f"(last - 2 * {s.lag('last')} + {s.lag('last', 2)}) / 0.25",
    delta2_10s=lambda s: f"(last - 2 * {s.lag('last', 20)} + {s.lag('last', 40)}) / 100",
    delta2_60s=lambda s: f"(last - 2 * {s.lag('last', 120)} + {s.lag('last', 240)}) / 3600",
    delta2_1min=lambda s: s.mean("delta2_tick", 120),
    delta2_5min=lambda s: s.mean("delta2_tick", 600),
    high_120=lambda s: s.max("last", 120),
    low_120=lambda s: s.min("last", 120),
    open_120=lambda s: s.lag("last", 119),
    price_elasticity=lambda s: f"CASE WHEN delta_turnover > 0 THEN {s.div('high_120 - low_120', 'delta_turnover')} END",
    elasticity_min=lambda s: s.mean("price_elasticity", 120, 1),
    ap1_trade=lambda s: s.lead("ap1"),
    bp1_trade=lambda s: s.lead("bp1"),
    vol=lambda s: f"CASE WHEN {s.lag('volume', 120)} IS NOT NULL THEN {s.sum('delta_volume', 120)} END",
    tick100_forward=lambda s: s.div(s.lead("mid", 100), "mid") + " - 1",
    tick100_ret=lambda s: s.lag("tick100_forward", 100),
    bigorder_ret=lambda s: "tick100_ret * bigorder_volume",
    volweight_bigorder_ret=lambda s: s.div(s.sum("bigorder_ret", 120), s.sum("bigorder_volume", 120)),
    mean_bigorder_ret=lambda s: s.mean("CASE WHEN is_bigorder = 1 THEN tick100_ret END", 120, 1),
    bigorder_vol_1min=lambda s: s.sum("bigorder_volume", 120),
    buy_vol_1min=lambda s: s.sum("buy_volume", 120),
    sell_vol_1min=lambda s: s.sum("sell_volume", 120),
    bigbuy_vol_1min=lambda s: s.sum("least(is_bigorder, CASE WHEN trade_direction = 1 THEN 1 ELSE 0 END) * delta_volume", 120),
    bigsell_vol_1min=lambda s: s.sum("least(is_bigorder, CASE WHEN trade_direction = -1 THEN 1 ELSE 0 END) * delta_volume", 120),
    bigorder_pct=lambda s: s.mean("is_bigorder", 1200),
    effective_depth=lambda s: "least(av1, bv1)",
    effective_depth_min=lambda s: s.mean("effective_depth", 120),
    vwap=lambda s: s.div(s.sum("delta_volume * last", 120), s.sum("delta_volume", 120)),
    ab_vol=lambda s: s.div(s.max("delta_volume", 120), s.mean("delta_volume", 1200, 120)),
    net_inflow_min=lambda s: s.sum("net_inflow", 120),
    net_inflow_std=lambda s: s.std("net_inflow", 120),
    net_inflow_skew=lambda s: s.skew("net_inflow", 120),
    log_step=lambda s: f"ln({s.div('mid', s.lag('mid'))})",
    gate_rv=lambda s: f"sqrt({s.sum('log_step * log_step', 600)}) * 100",
    gate_downside_ratio=lambda s: f"sqrt({s.sum('CASE WHEN log_step < 0 THEN log_step * log_step ELSE 0 END', 600)}) / (gate_rv / 100 + 1e-9)",
    gate_rv_log=lambda s: "ln(gate_rv + 1e-5)",
    gate_range_log=lambda s: "ln(rolling_amp + 1e-5)",
    obi_cum120=lambda s: s.sum("av1 - bv1", 120),
    rolling_high=lambda s: s.max("last", 1600, 30),
    rolling_low=lambda s: s.min("last", 1600, 30),
    rolling_amp=lambda s: "rolling_high - rolling_low",
)
for i in LEVELS:
    TICK[f"soir{i}"] = lambda s, i=i: s.div(f"bv{i} - av{i}", f"bv{i} + av{i}")
    # where a price is unknown, only the volume's change counts
    TICK[f"ofi{i}"] = lambda s, i=i: (
        f"(CASE WHEN bp{i} > {s.lag(f'bp{i}')} THEN bv{i} WHEN bp{i} < {s.lag(f'bp{i}')} THEN -{s.lag(f'bv{i}')} ELSE {s.diff(f'bv{i}')} END)"
        f" - (CASE WHEN ap{i} < {s.lag(f'ap{i}')} THEN av{i} WHEN ap{i} > {s.lag(f'ap{i}')} THEN -{s.lag(f'av{i}')} ELSE {s.diff(f'av{i}')} END)"
    )
for k in (10, 60, 120, 300, 600):
    TICK[f"oi_ma_{k}"] = lambda s, k=k: s.mean("order_imbalance", k, 120 if k == 600 else None)
    TICK[f"oi_momentum_{k}"] = lambda s, k=k: s.diff("order_imbalance", k)
for k in (120, 300, 600):
    TICK[f"oi_std_{k}"] = lambda s, k=k: s.std("order_imbalance", k, 120)
for k in (120, 600):
    TICK[f"oi_skew_{k}"] = lambda s, k=k: s.skew("order_imbalance", k, 120)
    TICK[f"vol_std_{k}"] = lambda s, k=k: s.std("delta_volume", k)
    TICK[f"vol_skew_{k}"] = lambda s, k=k: s.skew("delta_volume", k)
    TICK[f"vol_mid_corr_{k}"] = lambda s, k=k: s.corr("delta_volume", "tick_ret", k, 120)
for k in (20, 120, 600):
    TICK[f"rp_momentum_{k}"] = lambda s, k=k: s.sum("tick_ret * delta_turnover", k)

# --- the gate indicators of a tick ----------------------------------------------------------------------------

_fill(
    TICK,
    session_avg=lambda s: s.div("turnover", "volume"),
    log_ret=lambda s: f"coalesce(ln({s.div('mid', s.lag('mid'))}), 0)",
    log_ret_10=lambda s: f"coalesce(ln({s.div('mid', s.lag('mid', 10))}), 0)",
    oi_delta=lambda s: f"coalesce({s.diff('openinterest')}, 0)",
    clock=lambda s: "CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE)",
    session_minutes=lambda s: "CASE WHEN clock >= 75600 THEN (clock - 75600) / 60 WHEN clock < 28800 THEN (clock + 10800) / 60 WHEN clock >= 32400 AND clock < 41400 THEN (clock - 32400) / 60 WHEN clock >= 48600 AND clock <= 54000 THEN (clock - 48600) / 60 ELSE 9999 END",
    # unknown values of a gate are 0
    gate_spread=lambda s: "CASE WHEN ap1 = 0 OR bp1 = 0 THEN 0 ELSE coalesce(ap1 - bp1, 0) END",
    # levels that are not there hold nothing
    gate_bids=lambda s: _sum("coalesce(bv{i}, 0)"),
    gate_asks=lambda s: _sum("coalesce(av{i}, 0)"),
    gate_depth=lambda s: "ln(1 + gate_bids + gate_asks)",
    gate_rv_5=lambda s: f"coalesce({s.std('log_ret_10', 30)}, 0)",
    gate_range=lambda s: f"coalesce({s.div(s.max('mid', 30) + ' - ' + s.min('mid', 30), 'mid')}, 0)",
    gate_l1_imbalance=lambda s: "coalesce((bv1 - av1) / (bv1 + av1 + 1e-6), 0)",
    gate_l5_imbalance=lambda s: "(gate_bids - gate_asks) / (gate_bids + gate_asks + 1e-6)",
    gate_order_imbalance=lambda s: "coalesce((ordercnt_bid1 - ordercnt_ask1) / (ordercnt_bid1 + ordercnt_ask1 + 1e-6), 0)",
    gate_oi_change=lambda s: f"coalesce({s.sum('oi_delta', 10)}, 0)",
    gate_trade_intensity=lambda s: f"coalesce(ln(1 + {s.sum('delta_volume', 10)}), 0)",
    gate_up=lambda s: f"coalesce({s.mean('greatest(log_ret, 0)', 30)}, 0)",
    gate_down=lambda s: f"coalesce({s.mean('greatest(-log_ret, 0)', 30)}, 0)",
    gate_rsi=lambda s: "gate_up / (gate_up + gate_down + 1e-9)",
    gate_dist_avg=lambda s: f"coalesce({s.div('last - session_avg', 'session_avg')}, 0)",
    gate_trend=lambda s: f"coalesce({s.ret('mid', 30)}, 0)",
    gate_session_decay=lambda s: "1 / sqrt(session_minutes + 1)",
    gate_open_impulse=lambda s: "exp(-power(CASE WHEN clock >= 37800 AND clock < 41400 THEN (clock - 37800) / 60 ELSE session_minutes END, 2) / 200)",
)

# --- minutes ------------------------------------------------------------------------------------------------------

_fill(
    MINUTE,
    oi_change=lambda s: s.div(s.diff("openinterest"), "openinterest"),
    ret_min=lambda s: s.ret("price"),
    ret_5min=lambda s: s.ret("price", 5),
    sq=lambda s: "ret_min * ret_min",
    rs_term=lambda s: "ln(high / open) * ln(high / price) + ln(low / open) * ln(low / price)",
    row_no=lambda s: "CAST(row_number() OVER ({P}) AS DOUBLE)",
    slope=lambda s: s.div("ap1 - bp1", "av1 + bv1"),
    price_pos=lambda s: s.div("price - low", "coalesce(nullif(high - low, 0), 0.00001)"),
    upper_band=lambda s: s.max("high", 20),
    lower_band=lambda s: s.min("low", 20),
    channel_position=lambda s: "(price - lower_band) / coalesce(nullif(upper_band - lower_band, 0), 0.00001)",
    volume_zscore=lambda s: s.div(f"vol - {s.mean('vol', 30)}", s.std("vol", 30)),
    volume_cluster=lambda s: f"CASE WHEN vol > 1.5 * {s.mean('vol', 30)} THEN 1 ELSE 0 END",
    relative_spread=lambda s: s.div("ap1 - bp1", "(ap1 + bp1) / 2"),
    spread_volatility=lambda s: s.std("relative_spread", 10),
    volume_oi_ratio=lambda s: "vol / (CASE WHEN openinterest = 0 THEN 0.00001 ELSE openinterest END)",
    oi_support=lambda s: f"CASE WHEN openinterest > {s.mean('openinterest', 20)} THEN 1 ELSE 0 END",
    dollar=lambda s: "nullif(price * vol, 0)",
    pvol_oi_ratio=lambda s: s.div("vwap * vol", "(CASE WHEN openinterest > 0 THEN ln(openinterest) END) * rs_vol_30 * 100"),
    illiq_ratio=lambda s: s.div("abs(ret_min)", "dollar") + " * 1e6",
    lr_minute=lambda s: "nullif(" + s.div("dollar", "abs(ret_min)") + ", 0)",
    typical_price=lambda s: "(high + low + price) / 3",
    dtm=lambda s: f"CASE WHEN open > {s.lag('open')} THEN greatest(high - open, open - {s.lag('open')}) ELSE 0 END",
    dbm=lambda s: f"CASE WHEN open < {s.lag('open')} THEN greatest(open - low, {s.lag('open')} - open) ELSE 0 END",
    up_ret=lambda s: "CASE WHEN ret_min > 0 THEN ret_min END",
    down_ret=lambda s: "CASE WHEN ret_min < 0 THEN ret_min END",
    step=lambda s: s.diff("price"),
    money_in=lambda s: f"CASE WHEN typical_price > {s.lag('typical_price')} THEN typical_price * vol ELSE 0 END",
    money_out=lambda s: f"CASE WHEN typical_price <= {s.lag('typical_price')} THEN typical_price * vol ELSE 0 END",
    fuzziness=lambda s: s.std("ret_std_10", 10),
    ret_std_10=lambda s: s.std("ret_min", 10),
    fuzzy_corr=lambda s: s.corr("fuzziness", "dollar", 30),
    signed_dollar=lambda s: "sign(ret_min) * dollar",
    oi_step=lambda s: f"{s.diff('openinterest')} * price",
    sq_up=lambda s: "CASE WHEN ret_min > 0 THEN ret_min * ret_min ELSE 0 END",
    sq_down=lambda s: "CASE WHEN ret_min < 0 THEN ret_min * ret_min ELSE 0 END",
    coppock_5_10_30m=lambda s: s.mean("roc_5 + roc_10", 30),
    coppock_10_15_30m=lambda s: s.mean("roc_10 + roc_15", 30),
    is_reversal=lambda s: f"CASE WHEN {s.lag('ret_min')} > 0 AND ret_min < 0 THEN 1 ELSE 0 END",
    is_up=lambda s: "CASE WHEN ret_min > 0 THEN 1 ELSE 0 END",
    br_up=lambda s: f"greatest(high - {s.lag('price')}, 0)",
    br_down=lambda s: f"greatest({s.lag('price')} - low, 0)",
    true_range=lambda s: f"greatest(high - low, abs(high - {s.lag('price')}), abs(low - {s.lag('price')}))",
    atr=lambda s: s.div(s.mean("true_range", 14), "price"),
    ma20=lambda s: s.mean("price", 20),
    upper_bb=lambda s: s.div(f"{s.mean('price', 20)} + 2 * {s.std('price', 20)} - price", "price"),
    lower_bb=lambda s: s.div(f"{s.mean('price', 20)} - 2 * {s.std('price', 20)} - price", "price"),
    adl_term=lambda s: "coalesce(" + s.div("(price - low) - (high - price)", "high - low") + ", 0) * vol",
    hl_sum=lambda s: "high + low",
    reach=lambda s: f"greatest(abs({s.diff('high')}), abs({s.diff('low')}))",
    dmz=lambda s: f"CASE WHEN hl_sum <= {s.lag('hl_sum')} THEN 0 ELSE reach END",
    dmf=lambda s: f"CASE WHEN hl_sum > {s.lag('hl_sum')} THEN 0 ELSE reach END",
    # over the contract's mean volume, a column (``tables.with_mean_volume``)
    emv_term=lambda s: s.div(f"{s.diff('hl_sum')} / 2 * nullif(high - low, 0)", "vol * mean_vol") + " * 1e8",
    is_inflection=lambda s: f"CASE WHEN (price > {s.lag('price')} AND price > {s.lead('price')}) OR (price < {s.lag('price')} AND price < {s.lead('price')}) THEN 1 ELSE 0 END",
    inflection_count=lambda s: s.sum("is_inflection", 30),
    inflection_oscillator=lambda s: f"inflection_count - {s.roll_back('inflection_count', 5)}",
    buy_over_sell=lambda s: "buy_vol / (sell_vol + 1e-9)",
    cum_amplitude_term=lambda s: s.div("2 * (high - low) * sign(price - open) - (price - open)", "price"),
    # deviation over mean of the prices of 5 bars, and return by it, for the covariance of stormy rows
    superior_vol=lambda s: s.div(" + ".join(s.std(c, 5) for c in ("open", "high", "low", "price")), " + ".join(s.mean(c, 5) for c in ("open", "high", "low", "price"))),
    superior_vol_sq=lambda s: "superior_vol * superior_vol",
    ret_vol_ratio=lambda s: s.div("ret_min", "superior_vol"),
    vol_threshold=lambda s: s.quantile("vol", 0.8, 240, 10),
    high_9=lambda s: s.max("high", 9, 1),
    low_9=lambda s: s.min("low", 9, 1),
)
for k in (5, 10, 15):
    MINUTE[f"roc_{k}"] = lambda s, k=k: f"100 * {s.ret('price', k)}"
for k in (5, 30):
    MINUTE[f"pvol_{k}min"] = lambda s, k=k: s.std("ret_min", k)
for k in (5, 10):
    MINUTE[f"turnover_{k}min"] = lambda s, k=k: s.mean("delta_turnover", k)
for k in (1, 2, 4, 8, 16):
    MINUTE[f"delta_vol_{k}"] = lambda s, k=k: f"CASE WHEN trade_day = {s.lag('trade_day', k)} THEN {s.diff('volume', k)} END"
for k in (10, 30, 60):
    _fill(MINUTE, **{f"amihud_ratio_{k}": lambda s, k=k: s.mean("illiq_ratio", k, 10), f"psy_{k}": lambda s, k=k: s.mean("is_up", k), f"realized_vol_{k}": lambda s, k=k: s.sum("sq", k)})
for k in (10, 30, 120):
    _fill(MINUTE, **{f"ret_kurt_{k}": lambda s, k=k: s.kurt("ret_min", k, 10), f"pv_corr_{k}": lambda s, k=k: s.corr("price", "vol", k), f"rv_corr_{k}": lambda s, k=k: s.corr("ret_min", "vol", k)})
for k in (5, 10, 30):
    _fill(
        MINUTE,
        **{
            f"effective_depth_{k}min": lambda s, k=k: s.mean("depth", k, 1),
            f"pelas_{k}min": lambda s, k=k: s.mean("elasticity", k, 1),
            f"netflow_{k}min": lambda s, k=k: s.mean("net_inflow", k),
            f"netflow_std_{k}min": lambda s, k=k: s.std("net_inflow", k),
        },
    )
for k in (1, 5, 10, 30):
    for part in ("bigorder", "buy", "sell", "bigbuy", "bigsell"):
        MINUTE[f"{part}_vol_pct_{k}min"] = lambda s, k=k, part=part: s.div(s.sum(f"{part}_vol", k, 1), s.sum("vol", k, 1))
for k in (10, 30):
    _fill(
        MINUTE,
        **{
            f"rs_vol_{k}": lambda s, k=k: f"CASE WHEN {s.mean('rs_term', k)} IS NOT NULL THEN sqrt(greatest({s.mean('rs_term', k)}, 0)) * 100 END",
            f"cv_{k}": lambda s, k=k: s.div(s.var("ret_min", k, 5), f"abs({s.mean('ret_min', k, 5)})"),
            f"vcv_{k}": lambda s, k=k: s.div(s.std("vol", k, 5), s.mean("vol", k, 5)),
            f"amivest_lr_{k}": lambda s, k=k: s.mean("lr_minute", k, 5),
            f"hlc_ma_{k}": lambda s, k=k: s.mean("typical_price", k, 1),
            f"stm_{k}": lambda s, k=k: s.sum("dtm", k),
            f"sbm_{k}": lambda s, k=k: s.sum("dbm", k),
            f"adtm_{k}m": lambda s, k=k: "coalesce(" + s.div(f"stm_{k} - sbm_{k}", f"greatest(stm_{k}, sbm_{k})") + ", 0)",
            f"skew_overall_{k}m": lambda s, k=k: s.skew("ret_min", k),
            f"skew_upside_{k}m": lambda s, k=k: s.skew("up_ret", k, 3),
            f"skew_downside_{k}m": lambda s, k=k: s.skew("down_ret", k, 3),
            f"trend_strength_{k}": lambda s, k=k: s.div(s.diff("price", k), s.sum("abs(step)", k - 1)),
            f"mfi_{k}m": lambda s, k=k: f"CASE WHEN {s.sum('money_in', k)} = 0 AND {s.sum('money_out', k)} = 0 THEN 50 ELSE coalesce(100 - 100 / (1 + {s.div(s.sum('money_in', k), s.sum('money_out', k))}), 100) END",
            f"oi_vol_corr_{k}": lambda s, k=k: s.corr("openinterest", "vol", k),
            f"oi_ret_corr_{k}": lambda s, k=k: s.corr("openinterest", "ret_min", k),
            f"flow_in_ratio_{k}m": lambda s, k=k: "coalesce(" + s.div(s.sum("signed_dollar", k, 10), s.sum("dollar", k, 10)) + ", 0)",
            f"oiflow_ratio_{k}min": lambda s, k=k: "coalesce(" + s.div(s.sum("sign(ret_min) * oi_step", k, 5), s.sum("abs(oi_step)", k, 5)) + ", 0)",
            f"volret_ratio_{k}": lambda s, k=k: s.div(s.std("ret_min", k), s.mean("ret_min", k)),
            f"vr_{k}": lambda s, k=k: s.div(s.sum("CASE WHEN ret_min > 0 THEN vol ELSE 0 END", k), s.sum("CASE WHEN ret_min <= 0 THEN vol ELSE 0 END", k)),
            f"cmo_{k}": lambda s, k=k: "coalesce(100 * " + s.div(s.sum("ret_min", k, 1), s.sum("abs(ret_min)", k, 1)) + ", 0)",
            f"up_vol_ratio_{k}": lambda s, k=k: "coalesce(" + s.div(s.sum("sq_up", k), s.sum("sq", k)) + ", 0.5)",
            f"variance_diff_{k}m": lambda s, k=k: f"({s.sum('sq_up', k)} - {s.sum('sq_down', k)}) * 1e4",
            f"nr_{k}": lambda s, k=k: s.sum("is_reversal", k),
            f"ab_nr_{k}m": lambda s, k=k: s.div(f"nr_{k}", s.mean(f"nr_{k}", 5 if k == 10 else 12)),
            f"rsj_{k}": lambda s, k=k: s.div(f"sqrt({s.sum('sq_up', k)}) - sqrt({s.sum('sq_down', k)})", f"sqrt({s.sum('sq', k)})"),
            f"ar_{k}": lambda s, k=k: s.div(s.sum("high - open", k, k // 3 if k > 10 else 5), s.sum("open - low", k, k // 3 if k > 10 else 5)),
            f"br_{k}": lambda s, k=k: "coalesce(100 * " + s.div(s.sum("br_up", k, 1), s.sum("br_down", k, 1)) + ", 400)",
            f"adl_{k}": lambda s, k=k: s.sum("adl_term", k),
            f"ddi_{k}": lambda s, k=k: f"100 * ({s.sum('dmz', k, 5)} - {s.sum('dmf', k, 5)}) / ({s.sum('dmz', k, 5)} + {s.sum('dmf', k, 5)} + 1e-10)",
            f"emv_{k}min": lambda s, k=k: s.mean("emv_term", k, 5),
            f"ivol_{k}": lambda s, k=k: f"CASE WHEN count(ret_min) {over(k)} >= {k} THEN sqrt(greatest((regr_syy(ret_min, row_no) {over(k)} - power(regr_sxy(ret_min, row_no) {over(k)}, 2) / nullif(regr_sxx(ret_min, row_no) {over(k)}, 0)) / {k}, 0)) END",
            # kernels over the frame's values
            f"cvar_cut_{k}": lambda s, k=k: s.quantile("ret_min", 0.05, k),
            f"cvar_{k}": lambda s, k=k: f"CASE WHEN cvar_cut_{k} IS NOT NULL THEN coalesce(" + s.div(s.fold(s.only(f"rets_{k}", f"x < cvar_cut_{k}")), s.size(s.only(f"rets_{k}", f"x < cvar_cut_{k}"))) + f", cvar_cut_{k}) END",
            f"rets_{k}": lambda s, k=k: s.array("ret_min", k),
            f"avedev_{k}": lambda s, k=k: s.div(s.fold(s.each(f"tps_{k}", f"abs(x - hlc_ma_{k})")), s.size(f"tps_{k}")),
            f"tps_{k}": lambda s, k=k: s.array("typical_price", k),
            f"cci_{k}": lambda s, k=k: f"CASE WHEN 0.015 * avedev_{k} <= 1e-9 THEN 0 ELSE " + s.div(f"typical_price - hlc_ma_{k}", f"0.015 * avedev_{k}") + " END",
            f"price_mean_{k}": lambda s, k=k: s.mean("price", k, 10),
            f"prices_{k}": lambda s, k=k: s.array("price", k),
            f"cls_abs_var_{k}": lambda s, k=k: f"CASE WHEN price_mean_{k} IS NOT NULL THEN " + s.fold(s.each(f"prices_{k}", f"abs(x - price_mean_{k})")) + f" / {s.size(f'prices_{k}')} END",
            f"dollars_{k}": lambda s, k=k: s.array("dollar", k),
            f"dollar_sum_{k}": lambda s, k=k: s.sum("dollar", k, k // 2),
            f"entropy_vol_{k}": lambda s, k=k: f"CASE WHEN dollar_sum_{k} IS NOT NULL THEN -{s.fold(s.each(f'dollars_{k}', f'CASE WHEN x / nullif(dollar_sum_{k}, 0) > 0 THEN (x / nullif(dollar_sum_{k}, 0)) * ln(x / nullif(dollar_sum_{k}, 0)) ELSE 0 END'))} END",
            # the frame's rows are held against the threshold of its last one
            f"traded_{k}": lambda s, k=k: s.array_of("price IS NOT NULL AND vol IS NOT NULL", k, p="price", v="vol"),
            f"heavy_{k}": lambda s, k=k: s.only(f"traded_{k}", "x.v > vol_threshold"),
            f"heavy_vol_{k}": lambda s, k=k: s.fold(s.each(f"heavy_{k}", "x.v")),
            f"traded_vwap_{k}": lambda s, k=k: s.div(s.sum("price * vol", k), s.sum("vol", k)),
            f"trend_{k}": lambda s, k=k: f"CASE WHEN vol_threshold IS NULL OR {s.sum('vol', k)} IS NULL THEN NULL WHEN {s.sum('vol', k)} < 1e-9 OR heavy_vol_{k} < 1e-9 THEN 0 WHEN traded_vwap_{k} >= 1e-9 THEN {s.fold(s.each(f'heavy_{k}', 'x.p * x.v'))} / heavy_vol_{k} / traded_vwap_{k} - 1 END",
            f"cum_amplitude_{k}m": lambda s, k=k: s.mean("cum_amplitude_term", k, 5),
            # exponential weights: rows that weigh less than 1e-16 are left out
            f"weight_buysell_{k}": lambda s, k=k: s.decayed_std("buy_over_sell", k, 5 if k == 10 else 10),
            f"ewm_vol_{k}": lambda s, k=k: s.decayed_std("ret_min", k, 5),
            f"ewm_ret_{k}": lambda s, k=k: s.decayed_mean("ret_min", k),
            f"ewm_var_{k}": lambda s, k=k: s.decayed_mean(f"power(ret_min - ewm_ret_{k}, 2)", k),
            f"ewm_third_{k}": lambda s, k=k: s.decayed_mean(f"power(ret_min - ewm_ret_{k}, 3)", k),
            f"weight_ret_skew_{k}min": lambda s, k=k: s.div(f"ewm_third_{k}", f"power(ewm_var_{k}, 1.5)"),
            # first and second extremum of the frame
            f"turn_prices_{k}": lambda s, k=k: s.array("price", k),
            f"turns_{k}": lambda s, k=k: s.turns(f"turn_prices_{k}"),
            f"peak_reversal_{k}": lambda s, k=k: f"CASE WHEN {s.size(f'turn_prices_{k}')} = {k} AND {s.size(f'turns_{k}')} >= 2 THEN {s.div(s.item(f'turns_{k}', 1) + ' - ' + s.item(f'turns_{k}', 2), s.item(f'turns_{k}', 1))} END",
            f"stormy_{k}": lambda s, k=k: s.array_of("superior_vol_sq IS NOT NULL AND ret_vol_ratio IS NOT NULL", k, v="superior_vol_sq", r="ret_vol_ratio"),
            f"storm_limit_{k}": lambda s, k=k: f"{s.mean('superior_vol_sq', k)} + {s.std('superior_vol_sq', k)}",
            f"storms_{k}": lambda s, k=k: s.only(f"stormy_{k}", f"x.v >= storm_limit_{k}"),
            f"storm_mean_v_{k}": lambda s, k=k: s.div(s.fold(s.each(f"storms_{k}", "x.v")), s.size(f"storms_{k}")),
            f"storm_mean_r_{k}": lambda s, k=k: s.div(s.fold(s.each(f"storms_{k}", "x.r")), s.size(f"storms_{k}")),
            f"superior_cov_{k}": lambda s, k=k: f"CASE WHEN {s.size(f'stormy_{k}')} < {k} THEN NULL WHEN {s.std('superior_vol_sq', k)} < 1e-9 OR {s.size(f'storms_{k}')} < 2 THEN 0 ELSE {s.fold(s.each(f'storms_{k}', f'(x.v - storm_mean_v_{k}) * (x.r - storm_mean_r_{k})'))} / ({s.size(f'storms_{k}')} - 1) END",
            f"q80_{k}": lambda s, k=k: s.quantile("price", 0.8, k),
            f"q20_{k}": lambda s, k=k: s.quantile("price", 0.2, k),
        },
    )

# --- series statistics by name with a default frame of 30 --------------------------------------------------------------


def ts_mean(s: Sql, x: str, k: int = 30) -> str:
    """The first rows have the mean so far."""
    return f"avg({x}) {over(k)}"


def ts_std(s: Sql, x: str, k: int = 30) -> str:
    return f"sqrt(greatest(avg({x} * {x}) {over(k)} - power(avg({x}) {over(k)}, 2), 0))"


def ts_corr(s: Sql, x: str, y: str, k: int = 30) -> str:
    top = f"(avg({x} * {y}) {over(k)} - avg({x}) {over(k)} * avg({y}) {over(k)})"
    return f"coalesce({top} / nullif({ts_std(s, x, k)} * {ts_std(s, y, k)}, 0), 0)"


# --- working them out ----------------------------------------------------------------------------------------------------

_NAME = re.compile(r"[A-Za-z_]\w*")


def stages(book: dict, names: Iterable[str], have: Iterable[str], s: Sql) -> list[dict[str, str]]:
    """The factors and what they need, as projections one after the other."""
    have, level, text = set(have), {}, {}
    extra = getattr(s, "extra", {})

    def place(name: str, below: tuple = ()) -> int:
        if name in have:
            return 0
        if name not in level:
            if name in below:
                raise ValueError(f"{name} needs itself")
            text[name] = extra[name] if name in extra else book[name](s)
            needs = {w for w in _NAME.findall(text[name]) if (w in book or w in extra) and w != name}
            level[name] = 1 + max((place(w, (*below, name)) for w in sorted(needs)), default=0)
        return level[name]

    for name in names:
        place(name)
    return [{n: text[n] for n in level if level[n] == k} for k in sorted(set(level.values()))]


def reach(steps: list[dict[str, str]], extra: Iterable[str] = ()) -> tuple[float, float]:
    """How many rows before and after its own the factors of ``stages`` look at, one through the other."""
    back, ahead, extra = {}, {}, set(extra)
    for step in steps:
        for name, text in step.items():
            open_frame = 0 if name in extra else OPEN_FRAMES.get(name, math.inf)
            needs = {w for w in _NAME.findall(text) if w in back}
            rows = [int(n) for n in re.findall(r"(\d+) PRECEDING AND", text)] + [int(n) for n in re.findall(r"\blag\(\w+, (\d+)\)", text)]
            after = [int(n) for n in re.findall(r"\blead\(\w+, (\d+)\)", text)]
            if "UNBOUNDED" in text or name in OPEN_FRAMES:
                rows.append(open_frame)
            back[name] = max(rows, default=0) + max((back[w] for w in needs), default=0)
            ahead[name] = max(after, default=0) + max((ahead[w] for w in needs), default=0)
    return max(back.values(), default=0), max(ahead.values(), default=0)


def numbered(df: DataFrame, keys: list[str], pieces: list[str], order: list[str], name: str = "row_at") -> DataFrame:
    """``df`` with each row's number among those of its keys, from 0, in the order of ``pieces`` and ``order``.

    Rows are numbered inside of pieces (days), whose sizes are summed up in a table of one row a piece.
    """
    sizes = df.groupBy(*keys, *pieces).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*keys, *pieces])], F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.lit(True)  # a NULL key or piece has rows like any other
    for i, c in enumerate([*keys, *pieces]):
        same &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, *pieces).orderBy(*order)))
    return inside.join(starts, same).select(*df.columns, (F.col("_inside") + F.col("_start") - 1).alias(name))


def in_blocks(df: DataFrame, row: str, size: int, back: int, ahead: int) -> DataFrame:
    """``df`` with ``_block`` by row number, and copies (``_own`` false) of the rows that the blocks beside look at."""
    block, place = F.floor(F.col(row) / size), F.col(row) % size
    of = lambda b, own: F.struct(b.cast("long").alias("_block"), F.lit(own).alias("_own"))
    copies = F.array(of(block, True), F.when(place >= size - back, of(block + 1, False)), F.when((place < ahead) & (block > 0), of(block - 1, False)))
    return df.withColumn("_copy", F.explode(F.array_compact(copies))).select(*[F.col(f"`{c}`") for c in df.columns], "_copy.*")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as the session has for shuffles.

    Chains of windows take long for their bytes, by which adaptive execution would join them to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def over_rows(df: DataFrame, keys: list[str], order: list[str], back: int, ahead: int, fn: Callable[[DataFrame, Window], DataFrame], pieces: Iterable[str] = ("trade_day",)) -> DataFrame:
    """``fn(rows, window)`` on each key's rows in order, of which it looks ``back`` and ``ahead`` so many rows.

    In blocks, as in ``compute``, unless ``pieces`` are keys or no columns.
    """
    keys, order, pieces = list(keys), list(order), list(pieces)
    if set(pieces) & set(keys) or not set(pieces) <= set(df.columns):
        return fn(df, Window.partitionBy(*keys).orderBy(*order))
    rows = dealt(in_blocks(numbered(df, keys, pieces, order, "_at"), "_at", max(BLOCK_ROWS, 8 * max(back, ahead)), back, ahead), [*keys, "_block"])
    return fn(rows, Window.partitionBy(*keys, "_block").orderBy("_at")).where("_own").drop("_own", "_block", "_at")


def compute(df: DataFrame, book: dict, names: Iterable[str], keys: Iterable[str], order: Iterable[str], pieces: Iterable[str] = ("trade_day",), row: str = "row_at") -> DataFrame:
    """``df`` with the factors ``names`` (and what they need) over windows by ``keys`` in ``order``.

    Keys alone may hold any number of rows.  So where ``pieces`` are no keys, and all frames are bounded,
    windows are over blocks of a key's rows, each with a copy of as many rows before and after as the
    factors look at; ``row`` numbers a key's rows, where ``df`` has it already.
    """
    keys, order, pieces, names = list(keys), list(order), list(pieces), list(names)
    s = Spark()
    steps = stages(book, names, df.columns, s)
    back, ahead = reach(steps, s.extra)
    blocked = max(back, ahead) < math.inf and not set(pieces) & set(keys) and (row in df.columns or set(pieces) <= set(df.columns))
    columns = [*df.columns, *(n for step in steps for n in step if n not in s.extra)]
    if blocked:
        had = row in df.columns
        df = in_blocks(df if had else numbered(df, keys, pieces, order, row), row, max(BLOCK_ROWS, 8 * max(back, ahead)), back, ahead)
        keys, order = [*keys, "_block"], [row]
        df = dealt(df, keys)
    p = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}"
    for step in steps:
        df = df.select("*", *[F.expr(t.replace("{P}", p).replace("{K}", ", ".join(keys))).alias(n) for n, t in step.items()])
    return (df.where("_own") if blocked else df).select(*[F.col(f"`{c}`") for c in columns])


__all__ = ["MINUTE", "SO_FAR", "TICK", "compute", "numbered", "over_rows", "stages", "ts_corr", "ts_mean", "ts_std"]
