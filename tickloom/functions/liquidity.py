"""Liquidity of the order book: sweep prices, order-flow splits, depth changes, resilience and spreads.

Expressions over tick columns like those of ``factors``; ``LIQUIDITY`` holds them by name, and the builders
take parameters.  What a sweep takes of a
level is what the depth before it leaves, so it needs no loop.
"""

from __future__ import annotations

from collections.abc import Callable

from .expressions import Sql
from .factors import TICK

LEVELS = range(1, 6)


def sweep_price(side: str, target: str, beyond: str = "robust", penalty: float = 2.0, min_width: float = 1.0, volumes: str = "{side}v{i}") -> str:
    """Mean price of taking ``target`` from a side ("a" or "b") level by level; level 1 where nothing is wanted.

    What the five levels cannot fill is priced beyond them: ``last`` at level 5, ``penalty`` so much past it
    (away from the mid), ``linear`` by the book's density, ``robust`` by the root of remainder over depth,
    capped.  Levels without price or volume are skipped.
    """
    held = {i: f"(CASE WHEN {side}p{i} IS NULL THEN 0 ELSE coalesce({volumes.format(side=side, i=i)}, 0) END)" for i in LEVELS}
    above = lambda i: " - ".join([target, *[held[j] for j in range(1, i)]])  # noqa: E731  what the levels before leave
    cost = "(" + " + ".join(f"greatest(least({held[i]}, {above(i)}), 0) * coalesce({side}p{i}, 0)" for i in LEVELS) + ")"
    filled = f"least({target}, {' + '.join(held.values())})"
    rest = f"({target} - {filled})"
    sign = f"(CASE WHEN {side}p1 > {side}p5 THEN -1 ELSE 1 END)"
    width = f"(CASE WHEN abs({side}p5 - {side}p1) < 1e-6 THEN {min_width} ELSE abs({side}p5 - {side}p1) END)"
    depth = f"greatest({filled}, 1)"
    past = {
        "last": "0",
        "penalty": f"{penalty}",
        "linear": f"({min_width} + {rest} * {width} / {depth} / 2)",
        "robust": f"({min_width} + least({width} * sqrt(greatest({rest}, 0) / {depth}) * 0.5, greatest({width} * 5, 20)) / 2)",
    }[beyond]
    price = f"({cost} + (CASE WHEN {rest} > 0 THEN {rest} * ({side}p5 + {sign} * {past}) ELSE 0 END)) / {target}"
    return f"(CASE WHEN {target} IS NULL OR {target} <= 0 THEN {side}p1 ELSE {price} END)"


def normal_cdf(z: str) -> str:
    """Distribution function of the standard normal (Abramowitz and Stegun 7.1.26, to 1.5e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    # fixed values: the coefficients of the approximation
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 + sign({z}) * (1 - {poly} * exp(-{z} * {z} / 2))))"


def buy_share(s: Sql, price: str, algorithm: str, window: int = 60) -> str:
    """Share of a tick's volume that buyers took: ``lee_ready``, ``bvc`` or ``proportional`` (place in the last spread)."""
    ask, bid = s.lag("ap1"), s.lag("bp1")
    if algorithm == "lee_ready":
        return f"(CASE WHEN {price} > {s.lag(price)} AND NOT coalesce({price} >= {ask}, false) THEN 1.0 WHEN {price} < {s.lag(price)} AND NOT coalesce({price} <= {bid}, false) THEN 0.0 WHEN {price} <= {bid} THEN 0.0 WHEN {price} >= {ask} THEN 1.0 ELSE 0.5 END)"
    if algorithm == "bvc":
        return normal_cdf(f"(coalesce({s.diff(price)}, 0) / coalesce(nullif(bvc_sigma_{price}, 0), 1))")
    return f"(CASE WHEN {s.div(f'{price} - {bid}', f'{ask} - {bid}')} IS NULL THEN 0.5 ELSE greatest(least({s.div(f'{price} - {bid}', f'{ask} - {bid}')}, 1), 0) END)"


def depth_change(s: Sql, side: str, levels=(1,)) -> str:
    """Change of the levels' depth by the best price: same, the difference; worse, all gone; better, all new. 0 on the first row."""
    better, worse = ("<", ">") if side == "a" else (">", "<")
    # of several levels, one that is not there holds nothing
    held = lambda v: v if len(levels) == 1 else f"coalesce({v}, 0)"
    p, now = f"{side}p1", "(" + " + ".join(held(f"{side}v{i}") for i in levels) + ")"
    before = "(" + " + ".join(held(s.lag(f"{side}v{i}")) for i in levels) + ")"
    return f"(CASE WHEN {p} = {s.lag(p)} THEN {now} - {before} WHEN {p} {worse} {s.lag(p)} THEN -{before} WHEN {p} {better} {s.lag(p)} THEN {now} ELSE 0 END)"


def aligned_depth_change(s: Sql, side: str, tick: float = 1.0, jump: int = 5) -> str:
    """Change of five-level depth, begun anew where the best price jumps ``jump`` ticks or more."""
    now = "(" + " + ".join(f"coalesce({side}v{i}, 0)" for i in LEVELS) + ")"
    before = "(" + " + ".join(f"coalesce({s.lag(f'{side}v{i}')}, 0)" for i in LEVELS) + ")"
    k = f"coalesce(round({s.diff(f'{side}p1')} / {tick}), 0)"
    gone, fresh = (">=", "<=") if side == "a" else ("<=", ">=")
    sign = 1 if side == "a" else -1
    return f"(CASE WHEN abs({k}) < {jump} THEN {now} - {before} WHEN {k} {gone} {sign * jump} THEN -{before} WHEN {k} {fresh} {-sign * jump} THEN {now} END)"


def outlier(side: str, i: int, kind: str, flow: str = "coalesce(flow_total, 0)", huge: float = 500, large: float = 100) -> str:
    """A level's volume with outliers (over ``huge``, or over ``large`` and twice the flow) cut, replaced or zeroed."""
    v, limit = f"{side}v{i}", f"(2 * {flow})"
    is_huge, is_large = f"({v} > {huge})", f"({v} >= {large} AND {v} <= {huge} AND {v} > {limit})"
    if kind == "trunc":
        return f"(CASE WHEN {is_huge} THEN {huge} WHEN {is_large} THEN {limit} ELSE {v} END)"
    near = {1: f"{side}v2", 5: f"{side}v4"}.get(i) or f"(({side}v{i - 1} + {side}v{i + 1}) / 2)"
    middle = f"get(array_sort(array({', '.join(f'{side}v{j}' for j in LEVELS)})), 2)"
    return f"(CASE WHEN {is_huge} OR {is_large} THEN {({'neighbour': near, 'median': middle, 'zero': '0'})[kind]} ELSE {v} END)"


def effective_depth(side: str, decay: float = 0.1, cut: float = 0.2, huge: float = 500, large: float = 100) -> str:
    """Depth that counts: each level by exp(-decay * (level - 1)), less ``cut`` where it is huge, or large and twice the flow."""
    return "(" + " + ".join(f"coalesce({side}v{i}, 0) * exp(-{decay} * {i - 1}) * (CASE WHEN {side}v{i} >= {huge} OR ({side}v{i} >= {large} AND {side}v{i} > 2 * coalesce(flow_total, 0)) THEN {1 - cut} ELSE 1 END)" for i in LEVELS) + ")"


def _wbas(s: Sql) -> str:
    side = lambda x: s.div(" + ".join(f"{x}p{i} * {x}v{i}" for i in LEVELS), " + ".join(f"{x}v{i}" for i in LEVELS))
    return f"{side('a')} - {side('b')}"


OUTLIERS = ("trunc", "neighbour", "median", "zero")
SIDES, MODES = (("ask", "buy"), ("bid", "sell")), ("", "_5", "_aligned")
#: What a lot holds, by which turnover over volume is a price.
MULTIPLIER = 1
COUNTED = "({side}v{i} * exp(-0.1 * ({i} - 1)) * (CASE WHEN {side}v{i} >= 500 OR ({side}v{i} >= 100 AND {side}v{i} > 2 * coalesce(flow_total, 0)) THEN 0.8 ELSE 1 END))"

LIQUIDITY: dict[str, Callable[[Sql], str]] = dict(TICK) | {
    "wbas": _wbas,
    **{f"spread_l{i}": lambda s, i=i: f"ap{i} - bp{i}" for i in LEVELS},
    "flow_total": lambda s: f"greatest(coalesce({s.sum('delta_volume', 60, 1)}, 0) / 60, 3)",
    **{f"sweep_{kind}_{side}": lambda s, kind=kind, side=side: sweep_price(side, "50", kind) for kind in ("last", "penalty", "linear", "robust") for side in "ab"},
    **{f"step_{p}": lambda s, p=p: f"coalesce({s.diff(p)}, 0)" for p in ("mid", "last", "atp")},
    "atp": lambda s: s.div("delta_turnover", "delta_volume"),
    **{f"buy_{a}_{p}": lambda s, a=a, p=p: f"delta_volume * {buy_share(s, p, a)}" for a in ("lee_ready", "bvc", "proportional") for p in ("mid", "last", "atp")},
    **{f"sell_{a}_{p}": lambda s, a=a, p=p: f"delta_volume - buy_{a}_{p}" for a in ("lee_ready", "bvc", "proportional") for p in ("mid", "last", "atp")},
    "demand_buy": lambda s: f"coalesce({s.sum('buy_lee_ready_last', 60)}, 0) / 60 * 2",
    "demand_sell": lambda s: f"coalesce({s.sum('sell_lee_ready_last', 60)}, 0) / 60 * 2",
    "demand_buy_6": lambda s: "demand_buy * 3",
    "demand_sell_6": lambda s: "demand_sell * 3",
    **{f"{side}v{i}_{kind}": lambda s, side=side, i=i, kind=kind: outlier(side, i, kind, huge=35, large=20, flow="flow_total / 2") for side in "ab" for i in LEVELS for kind in OUTLIERS},
    # spreads of a sweep over the corrected volumes
    **{f"outlier_spread_{kind}": lambda s, kind=kind: f"{sweep_price('a', 'flow_total', volumes='{side}v{i}_' + kind)} - {sweep_price('b', 'flow_total', volumes='{side}v{i}_' + kind)}" for kind in OUTLIERS},
    **{f"sweep_20_{side}": lambda s, side=side: sweep_price(side, "20", "last") for side in "ab"},
    **{f"sweep_penalty_02_{side}": lambda s, side=side: sweep_price(side, "50", "penalty", penalty=0.2) for side in "ab"},
    "dssp_ask": lambda s: effective_depth("a"),
    "dssp_bid": lambda s: effective_depth("b"),
    "depth_change_ask": lambda s: depth_change(s, "a"),
    "depth_change_bid": lambda s: depth_change(s, "b"),
    "depth_change_ask_5": lambda s: depth_change(s, "a", LEVELS),
    "depth_change_bid_5": lambda s: depth_change(s, "b", LEVELS),
    "aligned_change_ask": lambda s: aligned_depth_change(s, "a"),
    "aligned_change_bid": lambda s: aligned_depth_change(s, "b"),
    **{f"refill_{side}": lambda s, side=side, flow=flow: s.mean(f"depth_change_{side} + {flow}_lee_ready_last", 60, 1) for side, flow in SIDES},
    **{f"refill_{side}_5": lambda s, side=side, flow=flow: s.mean(f"depth_change_{side}_5 + {flow}_lee_ready_last", 60, 1) for side, flow in SIDES},
    "refill_scale": lambda s: f"coalesce(nullif({s.mean('volume_step', 60, 1)}, 0), 1) * 5",
    **{f"resilience_{side}{m}": lambda s, side=side, m=m: f"tanh(refill_{side}{m} / refill_scale) * 0.3" for side, _ in SIDES for m in ("", "_5")},
    # plain; impacts scaled; flows scaled
    "robust_ask": lambda s: sweep_price("a", "demand_buy"),
    "robust_bid": lambda s: sweep_price("b", "demand_sell"),
    "final_spread": lambda s: "robust_ask - robust_bid",
    "ask_impact": lambda s: "(robust_ask - ap1) * (1 - resilience_ask)",
    "bid_impact": lambda s: "(bp1 - robust_bid) * (1 - resilience_bid)",
    "final_spread_adjusted": lambda s: "ap1 - bp1 + ask_impact + bid_impact",
    "impact_skew": lambda s: "ask_impact - bid_impact",
    "scaled_buy": lambda s: "demand_buy * (1 - resilience_ask)",
    "scaled_sell": lambda s: "demand_sell * (1 - resilience_bid)",
    "final_spread_flows": lambda s: f"{sweep_price('a', 'scaled_buy')} - {sweep_price('b', 'scaled_sell')}",
    "final_spread_120": lambda s: s.mean("final_spread", 120, 1),
    # depth by distance and size
    "dssp_spread": lambda s: f"{sweep_price('a', 'demand_buy', volumes=COUNTED)} - {sweep_price('b', 'demand_sell', volumes=COUNTED)}",
    # flows scaled by the resilience of the best level or of all five, or of depth aligned by ticks; their sweep and skew
    **{f"refill_{side}_aligned": lambda s, side=side, flow=flow: s.mean(f"aligned_change_{side} + {flow}_lee_ready_last", 60, 1) for side, flow in SIDES},
    **{f"resilience_{side}_aligned": lambda s, side=side: f"tanh(refill_{side}_aligned / refill_scale) * 0.3" for side, _ in SIDES},
    **{f"rolling_{flow}{m}": lambda s, side=side, flow=flow, m=m: f"greatest(demand_{flow} * (1 - resilience_{side}{m}), 0)" for side, flow in SIDES for m in MODES},
    **{f"rolling_ask{m}": lambda s, m=m: sweep_price("a", f"rolling_buy{m}") for m in MODES},
    **{f"rolling_bid{m}": lambda s, m=m: sweep_price("b", f"rolling_sell{m}") for m in MODES},
    **{f"rolling_spread{m}": lambda s, m=m: f"rolling_ask{m} - rolling_bid{m}" for m in MODES},
    **{f"rolling_skew{m}": lambda s, m=m: f"(rolling_ask{m} - ap1) - (bp1 - rolling_bid{m})" for m in MODES},
    **{f"rolling_spread_mean{m}": lambda s, m=m: s.mean(f"rolling_spread{m}", 240) for m in MODES},
    "spread_mean": lambda s: s.mean("ap1 - bp1", 240),
    "deep_spread_mean": lambda s: s.mean("wbas", 240),
    "cost_bps": lambda s: s.div("final_spread", "mid") + " * 1e4",
    "amihud_term": lambda s: f"abs(ln({s.div('mid', s.lag('mid'))})) / (delta_turnover / 15 + 1e-8)",
    "amihud_240": lambda s: s.sum("amihud_term", 240),
    # forward volume-weighted prices
    **{f"vwap_forward_{k}": lambda s, k=k: s.div(s.following("delta_turnover", k), f"{s.following('delta_volume', k)} * {MULTIPLIER}") for k in (120, 600, 1800)},
    **{f"vwap_label_dir_{k}": lambda s, k=k: f"vwap_forward_{k} - mid" for k in (120, 600, 1800)},
    **{f"vwap_label_{k}": lambda s, k=k: f"abs(vwap_label_dir_{k})" for k in (120, 600, 1800)},
    **{f"vwap_label_ask_{k}": lambda s, k=k: f"vwap_forward_{k} - ap1" for k in (120, 600, 1800)},
    **{f"vwap_label_bid_{k}": lambda s, k=k: f"bp1 - vwap_forward_{k}" for k in (120, 600, 1800)},
    # from 60 to 900 seconds ahead, less the first 60 seconds
    "vwap_60_900": lambda s: s.div(s.following("delta_turnover", 1800, 120), f"{s.following('delta_volume', 1800, 120)} * {MULTIPLIER}"),
    "vwap_60_label": lambda s: "vwap_60_900 - vwap_forward_120",
}
for _p in ("mid", "last", "atp"):
    LIQUIDITY[f"bvc_sigma_{_p}"] = lambda s, _p=_p: s.std(f"step_{_p}", 60)
