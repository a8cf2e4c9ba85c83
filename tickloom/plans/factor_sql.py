"""SQL of the factors for DuckDB, written from their definitions and apart from the plans of ``functions``.

A text stands for one column over the columns and texts before it; ``{P}`` is the partition and order.
"""

from __future__ import annotations

LEVELS = range(1, 6)
SO_FAR = "OVER ({P} ROWS UNBOUNDED PRECEDING)"


def w(k: int) -> str:
    return f"OVER ({{P}} ROWS {k - 1} PRECEDING)"


def after(a: int, b: int) -> str:
    return f"OVER ({{P}} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({{P}})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({{P}})"


def rolling(f: str, x: str, k: int, least: int | None = None) -> str:
    """An aggregate (``#`` stands for its argument, if it is no plain call) that needs ``least`` values, else the whole frame."""
    call = f.replace("#", x) if "#" in f else f"{f}({x})"
    return f"(CASE WHEN count({x}) {w(k)} >= {k if least is None else least} THEN {call} {w(k)} END)"


def shape(f: str, x: str, k: int, least: int) -> str:
    """Skewness or kurtosis, which equal values do not have."""
    return f"(CASE WHEN count({x}) {w(k)} >= {least} AND min({x}) {w(k)} < max({x}) {w(k)} THEN {f}({x}) {w(k)} END)"


def pair(x: str, y: str, k: int, least: int | None = None) -> str:
    """Correlation of the rows that have both; none where one of them stays equal."""
    a, b = f"if({y} IS NULL, NULL, {x})", f"if({x} IS NULL, NULL, {y})"
    return f"(CASE WHEN count({a}) {w(k)} >= {k if least is None else least} AND min({a}) {w(k)} < max({a}) {w(k)} AND min({b}) {w(k)} < max({b}) {w(k)} THEN covar_samp({b}, {a}) {w(k)} / sqrt(var_samp({a}) {w(k)} * var_samp({b}) {w(k)}) END)"


TICK = {
    "mid": "nullif(if(ap1 = 0, bp1, if(bp1 = 0, ap1, 0.5 * (ap1 + bp1))), 0)",
    "same_day": f"coalesce({lag('trade_day')} = trade_day, false)",
    "delta_volume": f"volume - if(same_day, {lag('volume')}, 0)",
    "delta_turnover": f"turnover - if(same_day, {lag('turnover')}, 0)",
    "volume_gain": f"if(same_day, volume - {lag('volume')}, NULL)",
    "bigorder_volume": "if(volume_gain >= 10, volume_gain, 0)",
    "is_bigorder": "if(volume_gain >= 10, 1, 0)",
    "last_change": f"last - {lag('last')}",
    "last_known_change": f"last_value(last_change IGNORE NULLS) {SO_FAR}",
    "trade_direction": "CAST(if(last <> mid, sign(last - mid), coalesce(sign(last_known_change), 0)) AS INT)",
    "buy_volume": "if(trade_direction > 0, delta_volume, 0)",
    "sell_volume": "if(trade_direction < 0, delta_volume, 0)",
    "net_inflow": "delta_volume * trade_direction",
    "estimated_exec_price": "if(trade_direction > 0, ap1, if(trade_direction < 0, bp1, last))",
    "spread": "ap1 - bp1",
    "bid_depth": "(bv1 + bv5) + (bv2 + bv4) + bv3",
    "ask_depth": "(av1 + av5) + (av2 + av4) + av3",
    "total_depth": "bv1 + av1 + bv2 + av2 + bv3 + av3 + bv4 + av4 + bv5 + av5",
    "order_imbalance": "(bid_depth - ask_depth) / nullif(total_depth, 0)",
    "bid_ask_volume_ratio": "bid_depth / nullif(ask_depth, 0)",
    "effective_depth": "list_min([av1, bv1])",
    "relative_spread": "2 * (ap1 - bp1) / nullif(ap1 + bp1, 0)",
    "effective_spread": "2 * abs(last - mid) / mid",
    "market_pressure": "(bp1 * bv1 - ap1 * av1) / nullif(bp1 * bv1 + ap1 * av1, 0)",
    "soir": "soir1 + soir2 + soir3 + soir4 + soir5",
    "soir_weighted": "5 * soir1 + 4 * soir2 + 3 * soir3 + 2 * soir4 + soir5",
    "mofi": "ofi1 + ofi2 + ofi3 + ofi4 + ofi5",
    "tick_ret": f"(mid - {lag('mid')}) / {lag('mid')}",
    "ret_600": f"({lead('mid', 601)} - {lead('mid')}) / {lead('mid')}",
    "tick100_ret": f"(mid - {lag('mid', 100)}) / {lag('mid', 100)}",
    "change_of_last": f"last - {lag('last')}",
    "delta2_tick": f"4 * (change_of_last - {lag('change_of_last')})",
    "delta2_10s": f"((last - {lag('last', 20)}) - ({lag('last', 20)} - {lag('last', 40)})) / 100",
    "delta2_60s": f"((last - {lag('last', 120)}) - ({lag('last', 120)} - {lag('last', 240)})) / 3600",
    "delta2_1min": rolling("avg", "delta2_tick", 120),
    "delta2_5min": rolling("avg", "delta2_tick", 600),
    "high_120": rolling("max", "last", 120),
    "low_120": rolling("min", "last", 120),
    "open_120": f"CASE WHEN count(*) {w(120)} = 120 THEN first(last) {w(120)} END",
    "price_elasticity": "if(delta_turnover > 0, (high_120 - low_120) / delta_turnover, NULL)",
    "elasticity_min": rolling("avg", "price_elasticity", 120, 1),
    "ap1_trade": lead("ap1"),
    "bp1_trade": lead("bp1"),
    "vol": f"if({lag('volume', 120)} IS NULL, NULL, sum(delta_volume) {w(120)})",
    "big_ret": "tick100_ret * bigorder_volume",
    "volweight_bigorder_ret": f"{rolling('sum', 'big_ret', 120)} / nullif({rolling('sum', 'bigorder_volume', 120)}, 0)",
    "mean_bigorder_ret": f"avg(tick100_ret) FILTER (WHERE is_bigorder = 1) {w(120)}",
    "bigorder_pct": rolling("avg", "is_bigorder", 1200),
    "bigorder_vol_1min": rolling("sum", "bigorder_volume", 120),
    "buy_vol_1min": rolling("sum", "buy_volume", 120),
    "sell_vol_1min": rolling("sum", "sell_volume", 120),
    "big_bought": "is_bigorder * buy_volume",
    "big_sold": "is_bigorder * sell_volume",
    "bigbuy_vol_1min": rolling("sum", "big_bought", 120),
    "bigsell_vol_1min": rolling("sum", "big_sold", 120),
    "effective_depth_min": rolling("avg", "effective_depth", 120),
    "traded_value": "last * delta_volume",
    "vwap": f"{rolling('sum', 'traded_value', 120)} / nullif({rolling('sum', 'delta_volume', 120)}, 0)",
    "ab_vol": f"{rolling('max', 'delta_volume', 120)} / nullif({rolling('avg', 'delta_volume', 1200, 120)}, 0)",
    "net_inflow_min": rolling("sum", "net_inflow", 120),
    "net_inflow_std": rolling("stddev_samp", "net_inflow", 120),
    "net_inflow_skew": shape("skewness", "net_inflow", 120, 120),
    "log_change": f"ln(mid) - ln({lag('mid')})",
    "log_change_sq": "log_change ** 2",
    "log_fall_sq": "if(log_change < 0, log_change ** 2, 0)",
    "gate_rv": f"100 * sqrt({rolling('sum', 'log_change_sq', 600)})",
    "gate_downside_ratio": f"sqrt({rolling('sum', 'log_fall_sq', 600)}) / (sqrt({rolling('sum', 'log_change_sq', 600)}) + 1e-9)",
    "gate_rv_log": "ln(gate_rv + 1e-5)",
    "gate_range_log": "ln(rolling_amp + 1e-5)",
    "obi_now": "av1 - bv1",
    "obi_cum120": rolling("sum", "obi_now", 120),
    "rolling_high": rolling("max", "last", 1600, 30),
    "rolling_low": rolling("min", "last", 1600, 30),
    "rolling_amp": "rolling_high - rolling_low",
    # gates
    "seconds": "extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))",
    "decay_minutes": "CASE WHEN seconds >= 21 * 3600 THEN seconds / 60.0 - 21 * 60 WHEN seconds < 8 * 3600 THEN seconds / 60.0 + 180 WHEN seconds BETWEEN 9 * 3600 AND 11.5 * 3600 - 1 THEN seconds / 60.0 - 540 WHEN seconds BETWEEN 13.5 * 3600 AND 15 * 3600 THEN seconds / 60.0 - 810 ELSE 9999 END",
    "impulse_minutes": "if(seconds BETWEEN 10.5 * 3600 AND 11.5 * 3600 - 1, seconds / 60.0 - 630, decay_minutes)",
    "ten_tick_log": f"coalesce(ln(mid) - ln({lag('mid', 10)}), 0)",
    "one_tick_log": "coalesce(log_change, 0)",
    "rises": "if(one_tick_log > 0, one_tick_log, 0)",
    "falls": "if(one_tick_log < 0, -one_tick_log, 0)",
    "oi_gain": f"coalesce(openinterest - {lag('openinterest')}, 0)",
    "gate_spread": "if(ap1 = 0 OR bp1 = 0, 0, ap1 - bp1)",
    "all_bids": "list_sum([bv1, bv2, bv3, bv4, bv5])",
    "all_asks": "list_sum([av1, av2, av3, av4, av5])",
    "gate_depth": "ln(1 + all_bids + all_asks)",
    "gate_rv_5": f"coalesce({rolling('stddev_samp', 'ten_tick_log', 30)}, 0)",
    "gate_range": f"coalesce(({rolling('max', 'mid', 30)} - {rolling('min', 'mid', 30)}) / mid, 0)",
    "gate_l1_imbalance": "(bv1 - av1) / (bv1 + av1 + 1e-6)",
    "gate_l5_imbalance": "(all_bids - all_asks) / (all_bids + all_asks + 1e-6)",
    "gate_order_imbalance": "(ordercnt_bid1 - ordercnt_ask1) / (ordercnt_bid1 + ordercnt_ask1 + 1e-6)",
    "gate_oi_change": f"coalesce({rolling('sum', 'oi_gain', 10)}, 0)",
    "gate_trade_intensity": f"coalesce(ln(1 + {rolling('sum', 'delta_volume', 10)}), 0)",
    "gate_rsi": f"coalesce({rolling('avg', 'rises', 30)} / ({rolling('avg', 'rises', 30)} + {rolling('avg', 'falls', 30)} + 1e-9), 0)",
    "gate_dist_avg": "coalesce(last / nullif(turnover / nullif(volume, 0), 0) - 1, 0)",
    "gate_trend": f"coalesce(mid / {lag('mid', 30)} - 1, 0)",
    "gate_session_decay": "(decay_minutes + 1) ** -0.5",
    "gate_open_impulse": "exp(-(impulse_minutes ** 2) / (2 * 10 ** 2))",
}
for i in LEVELS:
    b, a = f"bp{i}", f"ap{i}"
    TICK[f"soir{i}"] = f"(bv{i} - av{i}) / nullif(av{i} + bv{i}, 0)"
    TICK[f"ofi{i}"] = f"bv{i} - {lag(f'bv{i}')} + if({b} > {lag(b)}, {lag(f'bv{i}')}, if({b} < {lag(b)}, -bv{i}, 0)) - (av{i} - {lag(f'av{i}')} + if({a} < {lag(a)}, {lag(f'av{i}')}, if({a} > {lag(a)}, -av{i}, 0)))"
for k in (10, 60, 120, 300, 600):
    TICK[f"oi_ma_{k}"] = rolling("avg", "order_imbalance", k, 120 if k == 600 else None)
    TICK[f"oi_momentum_{k}"] = f"order_imbalance - {lag('order_imbalance', k)}"
for k in (120, 300, 600):
    TICK[f"oi_std_{k}"] = rolling("stddev_samp", "order_imbalance", k, 120)
for k in (120, 600):
    TICK |= {f"oi_skew_{k}": shape("skewness", "order_imbalance", k, 120), f"vol_std_{k}": rolling("stddev_samp", "delta_volume", k), f"vol_skew_{k}": shape("skewness", "delta_volume", k, k), f"vol_mid_corr_{k}": pair("delta_volume", "tick_ret", k, 120)}
TICK["ret_value"] = "tick_ret * delta_turnover"
for k in (20, 120, 600):
    TICK[f"rp_momentum_{k}"] = rolling("sum", "ret_value", k)

# the down-sampled table
BAR_SQL_COLUMNS = {
    "price": "last", "high": rolling("max", "last", 10), "low": rolling("min", "last", 10), "open": lag("last", 9), "vol": rolling("sum", "delta_volume", 10), "dollar_volume": rolling("sum", "delta_turnover", 10),
    "vwap": f"{rolling('sum', 'traded_value', 10)} / nullif({rolling('sum', 'delta_volume', 10)}, 0)", "openinterest": "openinterest", "depth": rolling("avg", "effective_depth", 10), "net_inflow": rolling("sum", "net_inflow", 10),
    "bigorder_vol": rolling("sum", "bigorder_volume", 10), "buy_vol": rolling("sum", "buy_volume", 10), "sell_vol": rolling("sum", "sell_volume", 10), "bigbuy_vol": rolling("sum", "big_bought", 10), "bigsell_vol": rolling("sum", "big_sold", 10),
    "elasticity": rolling("avg", "range_share", 10, 1), "delta_turnover": "delta_turnover", "volume": "volume", "ap1": "ap1", "bp1": "bp1", "av1": "av1", "bv1": "bv1",
}
BAR_PRE = {"bar_no": "row_number() OVER ({P})", "range_10": f"{rolling('max', 'last', 10)} - {rolling('min', 'last', 10)}", "range_share": "if(delta_turnover > 0, range_10 / delta_turnover, NULL)"}

MINUTE = {
    "oi_change": f"1 - {lag('openinterest')} / nullif(openinterest, 0)",
    "ret_min": f"(price - {lag('price')}) / nullif({lag('price')}, 0)",
    "ret_5min": f"(price - {lag('price', 5)}) / nullif({lag('price', 5)}, 0)",
    "ret_sq": "ret_min ** 2",
    "rs_now": "ln(high / open) * (ln(high / open) - ln(price / open)) - ln(low / open) * (ln(price / open) - ln(low / open))",
    "bar_row": "row_number() OVER ({P})",
    "slope": "(ap1 - bp1) / nullif(av1 + bv1, 0)",
    "price_pos": "(price - low) / if(high = low, 1e-5, high - low)",
    "upper_band": rolling("max", "high", 20),
    "lower_band": rolling("min", "low", 20),
    "channel_position": "(price - lower_band) / if(upper_band = lower_band, 1e-5, upper_band - lower_band)",
    "volume_zscore": f"(vol - {rolling('avg', 'vol', 30)}) / nullif({rolling('stddev_samp', 'vol', 30)}, 0)",
    "volume_cluster": f"if(vol / 1.5 > {rolling('avg', 'vol', 30)}, 1, 0)",
    "relative_spread": "2 * (ap1 - bp1) / nullif(ap1 + bp1, 0)",
    "spread_volatility": rolling("stddev_samp", "relative_spread", 10),
    "volume_oi_ratio": "vol / if(openinterest = 0, 1e-5, openinterest)",
    "oi_support": f"if(openinterest > {rolling('avg', 'openinterest', 20)}, 1, 0)",
    "dollar": "if(price * vol = 0, NULL, price * vol)",
    "pvol_oi_ratio": "vwap * vol / nullif(if(openinterest > 0, ln(openinterest), NULL) * rs_vol_30 * 100, 0)",
    "illiq_ratio": "1e6 * abs(ret_min) / dollar",
    "liquidity_now": "if(ret_min = 0, NULL, dollar / abs(ret_min))",
    "typical_price": "list_avg([high, low, price])",
    "typical_known": "high + low + price",
    "open_gain": f"open - {lag('open')}",
    "dtm": "if(open_gain > 0, greatest(high - open, open_gain), 0)",
    "dbm": "if(open_gain < 0, greatest(open - low, -open_gain), 0)",
    "up_only": "if(ret_min > 0, ret_min, NULL)",
    "down_only": "if(ret_min < 0, ret_min, NULL)",
    "abs_step": f"abs(price - {lag('price')})",
    "typical_change": f"typical_price - {lag('typical_price')}",
    "money": "typical_price * vol",
    "money_up": "if(typical_change > 0, money, 0)",
    "money_down": "if(typical_change <= 0, money, 0)",
    "ret_std_10": rolling("stddev_samp", "ret_min", 10),
    "fuzziness": rolling("stddev_samp", "ret_std_10", 10),
    "fuzzy_corr": pair("fuzziness", "dollar", 30),
    "dollar_flow": "sign(ret_min) * dollar",
    "oi_money": f"(openinterest - {lag('openinterest')}) * price",
    "oi_flow": "sign(ret_min) * oi_money",
    "oi_size": "abs(oi_money)",
    "up_sq": "if(ret_min > 0, ret_min ** 2, 0)",
    "down_sq": "if(ret_min < 0, ret_min ** 2, 0)",
    "roc_5_10": f"100 * (price / nullif({lag('price', 5)}, 0) - 1) + 100 * (price / nullif({lag('price', 10)}, 0) - 1)",
    "roc_10_15": f"100 * (price / nullif({lag('price', 10)}, 0) - 1) + 100 * (price / nullif({lag('price', 15)}, 0) - 1)",
    "coppock_5_10_30m": rolling("avg", "roc_5_10", 30),
    "coppock_10_15_30m": rolling("avg", "roc_10_15", 30),
    "is_reversal": f"if(ret_min < 0 AND {lag('ret_min')} > 0, 1, 0)",
    "is_up": "if(ret_min > 0, 1, 0)",
    "reach_up": f"greatest(high - {lag('price')}, 0 * {lag('price')})",
    "reach_down": f"greatest({lag('price')} - low, 0 * {lag('price')})",
    "true_range": f"list_max([high - low, abs(high - {lag('price')}), abs(low - {lag('price')})])",
    "atr": f"{rolling('avg', 'true_range', 14)} / nullif(price, 0)",
    "ma20": rolling("avg", "price", 20),
    "band_20": f"2 * {rolling('stddev_samp', 'price', 20)}",
    "upper_bb": "(ma20 + band_20) / price - 1",
    "lower_bb": "(ma20 - band_20) / price - 1",
    "adl_now": "vol * if(high = low, 0, (2 * price - high - low) / (high - low))",
    "hl_change": f"(high + low) - {lag('high + low')}",
    "edge_change": f"list_max([abs(high - {lag('high')}), abs(low - {lag('low')})])",
    "edge_up": "if(hl_change <= 0, 0, edge_change)",
    "edge_down": "if(hl_change > 0, 0, edge_change)",
    "contract_vol": "avg(vol) OVER (PARTITION BY contract)",
    "emv_now": "1e8 * (hl_change / 2) * if(high = low, NULL, high - low) / nullif(vol, 0) / nullif(contract_vol, 0)",
    "extreme": f"if(({lag('price')} < price AND price > {lead('price')}) OR ({lag('price')} > price AND price < {lead('price')}), 1, 0)",
    "inflection_count": rolling("sum", "extreme", 30),
    "inflection_count_before": lag("inflection_count"),
    "inflection_oscillator": f"inflection_count - {rolling('avg', 'inflection_count_before', 5)}",
    "vol_threshold": rolling("quantile_cont(#, 0.8)", "vol", 240, 10),
    "bought_share": "buy_vol / (sell_vol + 1e-9)",
    "body": "price - open",
    "cum_now": "(2 * (high - low) * sign(body) - body) / nullif(price, 0)",
    "sup_vol": "(" + " + ".join(rolling("stddev_samp", c, 5) for c in ("open", "high", "low", "price")) + ") / nullif(" + " + ".join(rolling("avg", c, 5) for c in ("open", "high", "low", "price")) + ", 0)",
    "sup_sq": "sup_vol ** 2",
    "sup_ratio": "ret_min / nullif(sup_vol, 0)",
}
for k in (5, 30):
    MINUTE[f"pvol_{k}min"] = rolling("stddev_samp", "ret_min", k)
for k in (5, 10):
    MINUTE[f"turnover_{k}min"] = rolling("avg", "delta_turnover", k)
for k in (1, 2, 4, 8, 16):
    MINUTE[f"delta_vol_{k}"] = f"if({lag('trade_day', k)} = trade_day, volume - {lag('volume', k)}, NULL)"
for k in (10, 30, 60):
    MINUTE |= {f"amihud_ratio_{k}": rolling("avg", "illiq_ratio", k, 10), f"psy_{k}": rolling("avg", "is_up", k), f"realized_vol_{k}": rolling("sum", "ret_sq", k)}
for k in (10, 30, 120):
    MINUTE |= {f"ret_kurt_{k}": shape("kurtosis", "ret_min", k, 10), f"pv_corr_{k}": pair("price", "vol", k), f"rv_corr_{k}": pair("ret_min", "vol", k)}
for k in (5, 10, 30):
    MINUTE |= {f"effective_depth_{k}min": rolling("avg", "depth", k, 1), f"pelas_{k}min": rolling("avg", "elasticity", k, 1), f"netflow_{k}min": rolling("avg", "net_inflow", k), f"netflow_std_{k}min": rolling("stddev_samp", "net_inflow", k)}
for k in (1, 5, 10, 30):
    for part in ("bigorder", "buy", "sell", "bigbuy", "bigsell"):
        MINUTE[f"{part}_vol_pct_{k}min"] = f"sum({part}_vol) {w(k)} / nullif(sum(vol) {w(k)}, 0)"


def mean_of(a: str, value: str, weight: str = "1.0") -> str:
    """Weighted mean over a list's elements (x), NULL where it is empty."""
    return f"list_sum([({value}) * ({weight}) for x in {a}]) / nullif(list_sum([CAST({weight} AS DOUBLE) for x in {a}]), 0)"


for k in (10, 30):
    full = f"count(ret_min) {w(k)} = {k}"
    MINUTE |= {
        f"rs_vol_{k}": f"100 * sqrt(if({rolling('avg', 'rs_now', k)} > 0, {rolling('avg', 'rs_now', k)}, if({rolling('avg', 'rs_now', k)} IS NULL, NULL, 0)))",
        f"cv_{k}": f"{rolling('var_samp', 'ret_min', k, 5)} / nullif(abs({rolling('avg', 'ret_min', k, 5)}), 0)",
        f"vcv_{k}": f"{rolling('stddev_samp', 'vol', k, 5)} / nullif({rolling('avg', 'vol', k, 5)}, 0)",
        f"amivest_lr_{k}": rolling("avg", "liquidity_now", k, 5),
        f"typicals_{k}": f"list(typical_price) FILTER (WHERE typical_known IS NOT NULL) {w(k)}",
        f"typical_mean_{k}": f"list_avg(typicals_{k})",
        f"typical_dev_{k}": f"list_avg([abs(x - typical_mean_{k}) for x in typicals_{k}])",
        f"avedev_{k}": f"typical_dev_{k}",
        f"cci_{k}": f"if(0.015 * typical_dev_{k} > 1e-9, (typical_price - typical_mean_{k}) / (0.015 * typical_dev_{k}), 0)",
        f"ups_{k}": rolling("sum", "dtm", k),
        f"downs_{k}": rolling("sum", "dbm", k),
        f"adtm_{k}m": f"coalesce((ups_{k} - downs_{k}) / nullif(list_max([ups_{k}, downs_{k}]), 0), 0)",
        f"skew_overall_{k}m": shape("skewness", "ret_min", k, k),
        f"skew_upside_{k}m": shape("skewness", "up_only", k, 3),
        f"skew_downside_{k}m": shape("skewness", "down_only", k, 3),
        f"trend_strength_{k}": f"(price - {lag('price', k)}) / nullif({rolling('sum', 'abs_step', k - 1)}, 0)",
        f"cls_{k}": f"list(price) {w(k)}",
        f"cls_abs_var_{k}": f"CASE WHEN len(cls_{k}) >= 10 THEN list_avg([abs(x - list_avg(cls_{k})) for x in cls_{k}]) END",
        f"pf_{k}": rolling("sum", "money_up", k),
        f"nf_{k}": rolling("sum", "money_down", k),
        f"mfi_{k}m": f"CASE WHEN pf_{k} = 0 AND nf_{k} = 0 THEN 50 WHEN nf_{k} > 0 THEN 100 * pf_{k} / (pf_{k} + nf_{k}) ELSE 100 END",
        f"oi_vol_corr_{k}": pair("openinterest", "vol", k),
        f"oi_ret_corr_{k}": pair("openinterest", "ret_min", k),
        f"flow_in_ratio_{k}m": f"coalesce({rolling('sum', 'dollar_flow', k, 10)} / nullif({rolling('sum', 'dollar', k, 10)}, 0), 0)",
        f"oiflow_ratio_{k}min": f"coalesce({rolling('sum', 'oi_flow', k, 5)} / nullif({rolling('sum', 'oi_size', k, 5)}, 0), 0)",
        f"volret_ratio_{k}": f"{rolling('stddev_samp', 'ret_min', k)} / nullif({rolling('avg', 'ret_min', k)}, 0)",
        f"vr_{k}": f"coalesce(sum(vol) FILTER (WHERE ret_min > 0) {w(k)}, 0) / nullif(sum(vol) FILTER (WHERE ret_min <= 0) {w(k)}, 0) + if(count(CASE WHEN ret_min > 0 OR ret_min <= 0 THEN vol ELSE 0 END) {w(k)} = {k}, 0, NULL)",
        f"cmo_{k}": f"coalesce(100 * (coalesce(sum(ret_min) FILTER (WHERE ret_min > 0) {w(k)}, 0) + coalesce(sum(ret_min) FILTER (WHERE ret_min < 0) {w(k)}, 0)) / nullif(coalesce(sum(ret_min) FILTER (WHERE ret_min > 0) {w(k)}, 0) - coalesce(sum(ret_min) FILTER (WHERE ret_min < 0) {w(k)}, 0), 0), 0)",
        f"up_{k}": rolling("sum", "up_sq", k),
        f"down_{k}": rolling("sum", "down_sq", k),
        f"all_{k}": rolling("sum", "ret_sq", k),
        f"up_vol_ratio_{k}": f"coalesce(up_{k} / nullif(all_{k}, 0), 0.5)",
        f"variance_diff_{k}m": f"10000 * (up_{k} - down_{k})",
        f"nr_{k}": rolling("sum", "is_reversal", k),
        f"ab_nr_{k}m": f"nr_{k} / nullif({rolling('avg', f'nr_{k}', 5 if k == 10 else 12)}, 0)",
        f"rsj_{k}": f"(up_{k} ** 0.5 - down_{k} ** 0.5) / nullif(all_{k} ** 0.5, 0)",
        f"ar_{k}": f"{rolling('sum', '(high - open)', k, 5 if k == 10 else 10)} / nullif({rolling('sum', '(open - low)', k, 5 if k == 10 else 10)}, 0)",
        f"br_{k}": f"coalesce(100 * sum(reach_up) {w(k)} / nullif(sum(reach_down) {w(k)}, 0), 400)",
        f"adl_{k}": rolling("sum", "adl_now", k),
        f"diz_{k}": f"100 * {rolling('sum', 'edge_up', k, 5)} / ({rolling('sum', 'edge_up', k, 5)} + {rolling('sum', 'edge_down', k, 5)} + 1e-10)",
        f"dif_{k}": f"100 * {rolling('sum', 'edge_down', k, 5)} / ({rolling('sum', 'edge_up', k, 5)} + {rolling('sum', 'edge_down', k, 5)} + 1e-10)",
        f"ddi_{k}": f"diz_{k} - dif_{k}",
        f"emv_{k}min": rolling("avg", "emv_now", k, 5),
        f"cum_amplitude_{k}m": rolling("avg", "cum_now", k, 5),
        # residuals of the line through the frame's returns
        f"line_{k}": f"list({{'t': bar_row, 'y': ret_min}}) {w(k)}",
        f"line_slope_{k}": f"regr_slope(ret_min, bar_row) {w(k)}",
        f"line_at_{k}": f"regr_intercept(ret_min, bar_row) {w(k)}",
        f"ivol_{k}": f"CASE WHEN {full} THEN sqrt(list_avg([(x.y - line_at_{k} - line_slope_{k} * x.t) ** 2 for x in line_{k}])) END",
        f"cut_{k}": rolling("quantile_cont(#, 0.05)", "ret_min", k),
        f"tail_{k}": f"list_filter(list(ret_min) {w(k)}, lambda x: x < cut_{k})",
        f"cvar_{k}": f"if(cut_{k} IS NULL, NULL, coalesce(list_avg(tail_{k}), cut_{k}))",
        f"dollars_{k}": f"list(dollar) FILTER (WHERE dollar IS NOT NULL) {w(k)}",
        f"entropy_vol_{k}": f"CASE WHEN len(dollars_{k}) >= {k // 2} THEN -list_sum([if(x > 0, x / list_sum(dollars_{k}) * ln(x / list_sum(dollars_{k})), 0) for x in dollars_{k}]) END",
        f"q80_{k}": rolling("quantile_cont(#, 0.8)", "price", k),
        f"q20_{k}": rolling("quantile_cont(#, 0.2)", "price", k),
        f"deals_{k}": f"list({{'p': price, 'v': vol}}) {w(k)}",
        f"heavies_{k}": f"list_filter(deals_{k}, lambda x: x.v > vol_threshold)",
        f"trend_{k}": f"CASE WHEN count(vol) {w(k)} < {k} OR vol_threshold IS NULL THEN NULL WHEN len(heavies_{k}) = 0 THEN 0 ELSE ({mean_of(f'heavies_{k}', 'x.p', 'x.v')}) / ({mean_of(f'deals_{k}', 'x.p', 'x.v')}) - 1 END",
        f"prices_{k}": f"list(price) {w(k)}",
        f"levels_{k}": f"[prices_{k}[i] for i in range(1, len(prices_{k}) + 1) if i = 1 OR prices_{k}[i] <> prices_{k}[i - 1]]",
        f"turns_{k}": f"[levels_{k}[i] for i in range(2, len(levels_{k})) if (levels_{k}[i] - levels_{k}[i - 1]) * (levels_{k}[i] - levels_{k}[i + 1]) > 0]",
        f"peak_reversal_{k}": f"CASE WHEN len(prices_{k}) = {k} AND len(turns_{k}) >= 2 THEN (turns_{k}[1] - turns_{k}[2]) / nullif(turns_{k}[1], 0) END",
        f"storm_rows_{k}": f"list_filter(list({{'v': sup_sq, 'r': sup_ratio}}) {w(k)}, lambda x: x.v IS NOT NULL AND x.r IS NOT NULL)",
        f"storm_limit_{k}": f"{rolling('avg', 'sup_sq', k)} + {rolling('stddev_samp', 'sup_sq', k)}",
        f"storms_{k}": f"list_filter(storm_rows_{k}, lambda x: x.v >= storm_limit_{k})",
        f"superior_cov_{k}": f"CASE WHEN len(storm_rows_{k}) < {k} THEN NULL WHEN {rolling('stddev_samp', 'sup_sq', k)} < 1e-9 OR len(storms_{k}) < 2 THEN 0 ELSE (list_sum([x.v * x.r for x in storms_{k}]) - list_sum([x.v for x in storms_{k}]) * list_sum([x.r for x in storms_{k}]) / len(storms_{k})) / (len(storms_{k}) - 1) END",
    }
    # exponential weights over all rows so far, by the place of each
    for name, x, least in (("weight_buysell", "bought_share", 5 if k == 10 else 10), ("ewm_vol", "ret_min", 5)):
        q = f"({k - 1}.0::DOUBLE / {k + 1})"
        MINUTE |= {
            f"{name}_rows_{k}": f"list({{'v': {x}}}) {w(600)}",
            f"{name}_kept_{k}": f"list_filter([{{'v': {name}_rows_{k}[i].v, 'w': {q} ** (len({name}_rows_{k}) - i)}} for i in range(1, len({name}_rows_{k}) + 1)], lambda e: e.v IS NOT NULL)",
            f"{name}_w_{k}": f"list_sum([e.w for e in {name}_kept_{k}])",
            f"{name}_m_{k}": f"list_sum([e.w * e.v for e in {name}_kept_{k}]) / {name}_w_{k}",
            f"{name}_{k}": f"CASE WHEN len({name}_kept_{k}) >= {least} THEN sqrt(list_sum([e.w * (e.v - {name}_m_{k}) ** 2 for e in {name}_kept_{k}]) / nullif({name}_w_{k} - list_sum([e.w ** 2 for e in {name}_kept_{k}]) / {name}_w_{k}, 0)) END",
        }
    for name, x in (("fade_mean", "ret_min"), ("fade_var", f"((ret_min - fade_mean_{k}) ** 2)"), ("fade_third", f"((ret_min - fade_mean_{k}) ** 3)")):
        q = f"({k - 1}.0::DOUBLE / {k + 1})"
        MINUTE[f"{name}_rows_{k}"] = f"list({{'v': {x}}}) {w(600)}"
        kept = f"list_filter([{{'v': {name}_rows_{k}[i].v, 'w': {q} ** (len({name}_rows_{k}) - i)}} for i in range(1, len({name}_rows_{k}) + 1)], lambda e: e.v IS NOT NULL)"
        MINUTE[f"{name}_kept_{k}"] = kept
        MINUTE[f"{name}_{k}"] = f"list_sum([e.w * e.v for e in {name}_kept_{k}]) / list_sum([e.w for e in {name}_kept_{k}])"
    MINUTE[f"weight_ret_skew_{k}min"] = f"fade_third_{k} / nullif(fade_var_{k} ** 1.5, 0)"


# kernels over a frame's values
KERNEL = dict(MINUTE) | {"amp_now": "high / nullif(low, 0) - 1"}
for k in (10, 30, 60):
    KERNEL |= {
        f"series_{k}": f"list(price) {w(k)}",
        f"series_mean_{k}": f"avg(price) {w(k)}",
        f"series_sums_{k}": f"[list_sum(series_{k}[1:i]) - i * series_mean_{k} for i in range(1, {k} + 1)]",
        f"hurst_{k}": f"CASE WHEN len(series_{k}) < {k} THEN NULL WHEN stddev_pop(price) {w(k)} < 1e-9 THEN 0.5 ELSE (list_max(series_sums_{k}) - list_min(series_sums_{k})) / nullif(stddev_pop(price) {w(k)}, 0) END",
    }
for k in (10, 30):
    # a parabola over t = 0 .. k - 1 by normal equations: with centred t the odd and even parts fall apart
    c = (k - 1) / 2
    t2 = sum((t - c) ** 2 for t in range(k))
    t4 = sum((t - c) ** 4 for t in range(k))
    for name, x in (("price", f"series_{k}"), ("ret", f"rets_{k}")):
        centred = f"[{{}} for t in range(0, {k})]"
        KERNEL |= {
            f"{name}_avg_{k}": f"list_avg({x})",
            f"{name}_lin_{k}": f"list_sum([{x}[t + 1] * (t - {c}) for t in range(0, {k})]) / {t2}",
            f"{name}_quad_{k}": f"(list_sum([{x}[t + 1] * (t - {c}) ** 2 for t in range(0, {k})]) - {t2} * {name}_avg_{k}) / {t4 - t2 * t2 / k}",
            f"{name}_left_{k}": f"list_sum([({x}[t + 1] - {name}_avg_{k} - {name}_lin_{k} * (t - {c}) - {name}_quad_{k} * ((t - {c}) ** 2 - {t2 / k})) ** 2 for t in range(0, {k})])",
            f"{name}_all_{k}": f"list_sum([(e - {name}_avg_{k}) ** 2 for e in {x}])",
            f"{name}_r2_{k}": f"if({name}_all_{k} < 1e-9, 1, 1 - {name}_left_{k} / nullif({name}_all_{k}, 0))",
        }
    KERNEL |= {
        f"rets_{k}": f"list(ret_min) {w(k)}",
        f"regression_factor_{k}": f"CASE WHEN len(series_{k}) = {k} THEN (price_lin_{k} - 2 * {c} * price_quad_{k}) * price_r2_{k} END",
        f"regr_r2_ret_{k}": f"CASE WHEN count(ret_min) {w(k)} = {k} THEN ret_r2_{k} ELSE 0 END",
        f"rows_{k}": f"list({{'p': price, 'a': amp_now}}) {w(k)}",
        f"dear_{k}": rolling("quantile_cont(#, 0.2)", "price", k),
        f"cheap_{k}": rolling("quantile_cont(#, 0.8)", "price", k),
        f"amplitude_{k}": f"CASE WHEN count(amp_now) {w(k)} = {k} THEN list_avg([e.a for e in rows_{k} if e.p >= dear_{k}]) - list_avg([e.a for e in rows_{k} if e.p <= cheap_{k}]) END",
        f"trades_{k}": f"list_filter(list({{'v': vol, 'r': ln(greatest(ret_min, 1e-9)), 'k': ret_min}}) {w(k)}, lambda e: e.k IS NOT NULL AND e.v IS NOT NULL)",
        f"heavy_cut_{k}": f"list_aggregate([e.v for e in trades_{k}], 'quantile_cont', 0.8)",
        f"heavy_part_{k}": f"coalesce(list_sum([e.v * e.r for e in trades_{k} if e.v > heavy_cut_{k}]) / nullif(list_sum([e.v for e in trades_{k} if e.v > heavy_cut_{k}]), 0), 0)",
        f"light_part_{k}": f"if(len([1 for e in trades_{k} if e.v = 0]) > 0, NULL, coalesce(list_sum([e.r / nullif(e.v, 0) for e in trades_{k} if e.v <= heavy_cut_{k}]) / nullif(list_sum([1 / nullif(e.v, 0) for e in trades_{k} if e.v <= heavy_cut_{k}]), 0), 0))",
        f"struct_rev_{k}": f"CASE WHEN row_number() OVER ({{P}}) >= {k} AND len(trades_{k}) >= 5 THEN heavy_part_{k} - light_part_{k} END",
    }

# the book
LIQUIDITY = dict(TICK) | {
    "wbas": " - ".join(f"({' + '.join(f'{x}v{i} * {x}p{i}' for i in LEVELS)}) / nullif({' + '.join(f'{x}v{i}' for i in LEVELS)}, 0)" for x in "ab"),
    **{f"spread_l{i}": f"ap{i} - bp{i}" for i in LEVELS},
    "flow_total": f"list_max([coalesce(avg(delta_volume) {w(60)} * count(delta_volume) {w(60)} / 60, 0), 3])",
    "atp": "delta_turnover / nullif(delta_volume, 0)",
    "ask_before": lag("ap1"),
    "bid_before": lag("bp1"),
    "demand_buy": f"coalesce({rolling('sum', 'buy_lee_ready_last', 60)}, 0) / 30",
    "demand_sell": f"coalesce({rolling('sum', 'sell_lee_ready_last', 60)}, 0) / 30",
    "demand_buy_6": f"coalesce({rolling('sum', 'buy_lee_ready_last', 60)}, 0) / 10",
    "demand_sell_6": f"coalesce({rolling('sum', 'sell_lee_ready_last', 60)}, 0) / 10",
    "volume_moved": "abs(volume_gain)",
    "refill_scale": f"5 * if(coalesce(avg(volume_moved) {w(60)}, 0) = 0, 1, avg(volume_moved) {w(60)})",
    "final_spread": "robust_ask - robust_bid",
    "ask_impact": "(robust_ask - ap1) * (1 - resilience_ask)",
    "bid_impact": "(bp1 - robust_bid) * (1 - resilience_bid)",
    "final_spread_adjusted": "(ap1 + ask_impact) - (bp1 - bid_impact)",
    "impact_skew": "ask_impact - bid_impact",
    "scaled_buy": "demand_buy - demand_buy * resilience_ask",
    "scaled_sell": "demand_sell - demand_sell * resilience_bid",
    "final_spread_flows": "flows_ask - flows_bid",
    "final_spread_120": f"avg(final_spread) {w(120)}",
    "dssp_spread": "dssp_price_ask - dssp_price_bid",
    "cost_bps": "10000 * final_spread / nullif(mid, 0)",
    "illiquid_now": f"abs(ln(mid) - ln({lag('mid')})) / (delta_turnover / 15 + 1e-8)",
    "amihud_240": rolling("sum", "illiquid_now", 240),
    "spread_now": "ap1 - bp1",
    "spread_mean": rolling("avg", "spread_now", 240),
    "deep_spread_mean": rolling("avg", "wbas", 240),
    **{f"vwap_forward_{k}": f"if({lead('last', k)} IS NULL, NULL, sum(delta_turnover) {after(1, k)} / nullif(sum(delta_volume) {after(1, k)}, 0))" for k in (120, 600, 1800)},
    **{f"vwap_label_dir_{k}": f"vwap_forward_{k} - mid" for k in (120, 600, 1800)},
    **{f"vwap_label_{k}": f"greatest(vwap_forward_{k} - mid, mid - vwap_forward_{k})" for k in (120, 600, 1800)},
    **{f"vwap_label_ask_{k}": f"vwap_forward_{k} - ap1" for k in (120, 600, 1800)},
    **{f"vwap_label_bid_{k}": f"bp1 - vwap_forward_{k}" for k in (120, 600, 1800)},
    "vwap_60_label": f"if({lead('last', 1800)} IS NULL, NULL, sum(delta_turnover) {after(121, 1800)} / nullif(sum(delta_volume) {after(121, 1800)}, 0)) - vwap_forward_120",
}


def volumes(side: str, kind: str = "") -> str:
    """A side's five volumes as a list, 0 where a level is not quoted."""
    one = {
        "": "{s}v{i}",
        "dssp": "{s}v{i} * exp(-0.1 * ({i} - 1)) * if({s}v{i} >= 500 OR ({s}v{i} >= 100 AND {s}v{i} > 2 * flow_total), 0.8, 1)",
    }.get(kind, "{s}v{i}_" + kind)
    return "[" + ", ".join(f"if({side}p{i} IS NULL, 0, coalesce({one.format(s=side, i=i)}, 0))" for i in LEVELS) + "]"


def sweep(name: str, side: str, target: str, beyond: str, kind: str = "", penalty: float = 2) -> None:
    """Adds the mean price of taking a target from a side, as columns that go level by level."""
    away = f"if({side}p1 > {side}p5, -1, 1)"
    width = f"if(abs({side}p5 - {side}p1) < 1e-6, 1, abs({side}p5 - {side}p1))"
    past = {
        "last": "0",
        "penalty": str(penalty),
        "linear": f"1 + {name}_rest * {width} / list_max([{name}_had, 1]) / 2",
        "robust": f"1 + list_min([{width} * sqrt({name}_rest / list_max([{name}_had, 1])) / 2, list_max([5 * {width}, 20])]) / 2",
    }[beyond]
    LIQUIDITY.update(
        {
            f"{name}_v": volumes(side, kind),
            f"{name}_p": "[" + ", ".join(f"coalesce({side}p{i}, 0)" for i in LEVELS) + "]",
            f"{name}_had": f"list_min([{target}, list_sum({name}_v)])",
            f"{name}_rest": f"{target} - {name}_had",
            f"{name}_paid": f"list_sum([if({target} > coalesce(list_sum({name}_v[1:i - 1]), 0), list_min([{name}_v[i], {target} - coalesce(list_sum({name}_v[1:i - 1]), 0)]), 0) * {name}_p[i] for i in range(1, 6)])",
            name: f"if(coalesce({target}, 0) <= 0, {side}p1, ({name}_paid + if({name}_rest > 0, {name}_rest * ({side}p5 + {away} * ({past})), 0)) / {target})",
        }
    )


SIDES = (("ask", "a", "buy"), ("bid", "b", "sell"))
for long, side, flow in SIDES:
    for beyond in ("last", "penalty", "linear", "robust"):
        sweep(f"sweep_{beyond}_{side}", side, "50", beyond)
    sweep(f"sweep_20_{side}", side, "20", "last")
    sweep(f"sweep_penalty_02_{side}", side, "50", "penalty", penalty=0.2)
    sweep(f"robust_{long}", side, f"demand_{flow}", "robust")
    sweep(f"flows_{long}", side, f"scaled_{flow}", "robust")
    sweep(f"dssp_price_{long}", side, f"demand_{flow}", "robust", "dssp")
    LIQUIDITY[f"dssp_{long}"] = " + ".join(f"coalesce({side}v{i} * exp((1 - {i}) / 10.0) * if({side}v{i} >= 500 OR ({side}v{i} >= 100 AND {side}v{i} / 2 > flow_total), 0.8, 1), 0)" for i in LEVELS)
    best, fall, rise = f"{side}p1", (">" if side == "a" else "<"), ("<" if side == "a" else ">")
    for m, levels in (("", (1,)), ("_5", LEVELS)):
        LIQUIDITY[f"depth_now_{long}{m}"] = "list_sum([" + ", ".join(f"{side}v{i}" for i in levels) + "])"
        LIQUIDITY[f"depth_change_{long}{m}"] = f"if({best} {fall} {lag(best)}, 0, depth_now_{long}{m}) - if({best} {rise} {lag(best)}, 0, {lag(f'depth_now_{long}{m}')}) + 0 * {lag(best)}"
        LIQUIDITY[f"depth_change_{long}{m}"] = f"coalesce({LIQUIDITY[f'depth_change_{long}{m}']}, 0)"
    LIQUIDITY[f"jump_{long}"] = f"coalesce(round({best} - {lag(best)}), 0)" if side == "a" else f"-coalesce(round({best} - {lag(best)}), 0)"
    LIQUIDITY[f"aligned_change_{long}"] = f"if(jump_{long} >= 5, 0, depth_now_{long}_5) - if(jump_{long} <= -5, 0, coalesce({lag(f'depth_now_{long}_5')}, 0))"
    for m in ("", "_5", "_aligned"):
        change = f"aligned_change_{long}" if m == "_aligned" else f"depth_change_{long}{m}"
        LIQUIDITY[f"refilled_{long}{m}"] = f"{change} + {flow}_lee_ready_last"
        LIQUIDITY[f"refill_{long}{m}"] = f"avg(refilled_{long}{m}) {w(60)}"
        LIQUIDITY[f"resilience_{long}{m}"] = f"0.3 * (1 - 2 / (exp(2 * refill_{long}{m} / refill_scale) + 1))"
        LIQUIDITY[f"rolling_{flow}{m}"] = f"list_max([demand_{flow} - demand_{flow} * resilience_{long}{m}, 0])"
        sweep(f"rolling_{long}{m}", side, f"rolling_{flow}{m}", "robust")
    for i in LEVELS:
        v = f"{side}v{i}"
        odd = f"({v} > 35 OR ({v} BETWEEN 20 AND 35 AND {v} > flow_total))"
        near = {1: f"{side}v2", 5: f"{side}v4"}.get(i, f"0.5 * ({side}v{i - 1} + {side}v{i + 1})")
        LIQUIDITY |= {
            f"{v}_trunc": f"if({v} > 35, 35, if({v} >= 20 AND {v} > flow_total, flow_total, {v}))",
            f"{v}_neighbour": f"if({odd}, {near}, {v})",
            f"{v}_median": f"if({odd}, list_sort([{', '.join(f'{side}v{j}' for j in LEVELS)}])[3], {v})",
            f"{v}_zero": f"if({odd}, 0, {v})",
        }
    for kind in ("trunc", "neighbour", "median", "zero"):
        sweep(f"outlier_{kind}_{side}", side, "flow_total", "robust", kind)
for kind in ("trunc", "neighbour", "median", "zero"):
    LIQUIDITY[f"outlier_spread_{kind}"] = f"outlier_{kind}_a - outlier_{kind}_b"
for m in ("", "_5", "_aligned"):
    LIQUIDITY |= {f"rolling_spread{m}": f"rolling_ask{m} - rolling_bid{m}", f"rolling_skew{m}": f"rolling_ask{m} + rolling_bid{m} - ap1 - bp1", f"rolling_spread_mean{m}": rolling("avg", f"rolling_spread{m}", 240)}
for p in ("mid", "last", "atp"):
    z = f"step_{p} / if(coalesce(sigma_{p}, 0) = 0, 1, sigma_{p})"
    # quote rule against the quotes before; only what it leaves undecided goes by the step
    LIQUIDITY |= {
        f"step_{p}": f"coalesce({p} - {lag(p)}, 0)",
        f"sigma_{p}": rolling("stddev_samp", f"step_{p}", 60),
        f"is_buy_{p}": f"coalesce({p} >= ask_before, false)",
        f"is_sell_{p}": f"coalesce({p} <= bid_before, false)",
        f"share_lee_ready_{p}": f"if(step_{p} > 0 AND NOT is_buy_{p}, 1, if(step_{p} < 0 AND NOT is_sell_{p}, 0, if(is_sell_{p}, 0, if(is_buy_{p}, 1, 0.5))))",
        f"z_{p}": z,
        # the normal distribution by formula 7.1.26 of Abramowitz and Stegun; fixed values
        f"t_{p}": f"1 / (1 + 0.3275911 * abs(z_{p}) / sqrt(2))",
        f"tail_{p}": f"0.5 * exp(-(z_{p} ** 2) / 2) * (0.254829592 * t_{p} - 0.284496736 * t_{p} ** 2 + 1.421413741 * t_{p} ** 3 - 1.453152027 * t_{p} ** 4 + 1.061405429 * t_{p} ** 5)",
        f"share_bvc_{p}": f"if(z_{p} < 0, tail_{p}, 1 - tail_{p})",
        f"share_proportional_{p}": f"if({p} IS NULL OR ask_before = bid_before OR ask_before IS NULL, 0.5, list_max([list_min([({p} - bid_before) / (ask_before - bid_before), 1]), 0]))",
    }
    for a in ("lee_ready", "bvc", "proportional"):
        LIQUIDITY |= {f"buy_{a}_{p}": f"delta_volume * share_{a}_{p}", f"sell_{a}_{p}": f"delta_volume * (1 - share_{a}_{p})"}

# frame primitives
PRIMITIVE = {
    "val": "if(event_id % 17 = 0, NULL, last / 100)",
    "mean_10": rolling("avg", "val", 10),
    "mean_10_5": rolling("avg", "val", 10, 5),
    "sum_10_1": rolling("sum", "val", 10, 1),
    "std_20_5": f"sqrt({rolling('var_samp', 'val', 20, 5)})",
    "var_20_5": rolling("var_samp", "val", 20, 5),
    "skew_20_10": shape("skewness", "val", 20, 10),
    "kurt_20_10": shape("kurtosis", "val", 20, 10),
    "max_14_1": rolling("max", "val", 14, 1),
    "min_14_1": rolling("min", "val", 14, 1),
    "frame_10": f"list(val) FILTER (WHERE val IS NOT NULL) {w(10)}",
    "frame_30": f"list(val) FILTER (WHERE val IS NOT NULL) {w(30)}",
    "median_10_5": "if(len(frame_10) >= 5, list_median(frame_10), NULL)",
    "q05_30_10": "if(len(frame_30) >= 10, list_aggregate(frame_30, 'quantile_cont', 0.05), NULL)",
    "q95_30_10": "if(len(frame_30) >= 10, list_aggregate(frame_30, 'quantile_cont', 0.95), NULL)",
    "corr_20_10": pair("val", "volume", 20, 10),
    "filled": f"last_value(val IGNORE NULLS) {SO_FAR}",
    "lag_5": lag("val", 5),
    "lead_3": lead("val", 3),
    "diff_10": f"val - {lag('val', 10)}",
    "pct_5": f"(filled - {lag('filled', 5)}) / {lag('filled', 5)}",
    "sum_so_far": f"sum(val) {SO_FAR}",
    "max_so_far": f"max(val) {SO_FAR}",
    "weighted": "last * volume",
    "vwma_10": f"{rolling('sum', 'weighted', 10)} / nullif({rolling('sum', 'volume', 10)}, 0)",
    "clipped": "if(val < 150, 150, if(val > 300, 300, val))",
    "ts_mean": f"avg(last) {w(30)}",
    "ts_std": f"stddev_pop(last) {w(30)}",
    "ts_corr": f"coalesce(covar_pop(last, openinterest) {w(30)} / nullif(stddev_pop(last) {w(30)} * stddev_pop(openinterest) {w(30)}, 0), 0)",
    "rank_30_5": "CASE WHEN val IS NULL OR len(frame_30) < 5 THEN NULL WHEN list_min(frame_30) = list_max(frame_30) THEN 0.5 ELSE list_min([(len([e for e in frame_30 if e < val]) + 0.5) / (len(frame_30) - 1), 1.0]) END",
}
