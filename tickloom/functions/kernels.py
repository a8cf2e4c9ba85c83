"""Kernels over the values of a frame, as expressions: R/S, amplitude, structural reversal, quadratic fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .expressions import Sql, over
from .factors import MINUTE


def _weighted(s: Sql, x: str, weights) -> str:
    """Constant weights times the frame's values, oldest first."""
    k = len(weights)
    return "(" + " + ".join(f"({float(w)!r}) * {x if i == k - 1 else s.lag(x, k - 1 - i)}" for i, w in enumerate(weights)) + ")"


def quadratic(s: Sql, x: str, k: int) -> tuple[str, str]:
    """Slope at the frame's start and R2 of a parabola over the last k values, by constant-weight sums."""
    t = np.arange(k, dtype=float)
    design = np.stack([np.ones(k), t, t * t], 1)
    slope = np.linalg.solve(design.T @ design, design.T)[1]
    basis = np.linalg.qr(design)[0]
    tot = f"var_pop({x}) {over(k)} * {k}"
    r2 = f"(CASE WHEN {tot} < 1e-9 THEN 1.0 ELSE (power({_weighted(s, x, basis[:, 1])}, 2) + power({_weighted(s, x, basis[:, 2])}, 2)) / nullif({tot}, 0) END)"
    full = f"count({x}) {over(k)} = {k}"
    return f"(CASE WHEN {full} THEN {_weighted(s, x, slope)} END)", f"(CASE WHEN {full} THEN {r2} END)"


KERNEL: dict[str, Callable[[Sql], str]] = dict(MINUTE) | {"amp": lambda s: "high / low - 1"}
for k in (10, 30, 60):
    KERNEL |= {
        # R/S: range of the running sums of deviations over the deviation
        f"rs_prices_{k}": lambda s, k=k: s.array("price", k),
        f"rs_mean_{k}": lambda s, k=k: s.mean("price", k),
        f"rs_sd_{k}": lambda s, k=k: f"stddev_pop(price) {over(k)}",
        f"rs_range_{k}": lambda s, k=k: s.range_of_sums(f"rs_prices_{k}", f"rs_mean_{k}"),
        f"hurst_{k}": lambda s, k=k: f"(CASE WHEN rs_mean_{k} IS NULL THEN NULL WHEN rs_sd_{k} < 1e-9 THEN 0.5 ELSE rs_range_{k} / nullif(rs_sd_{k}, 0) END)",
    }
for k in (10, 30):
    KERNEL |= {
        f"quad_slope_{k}": lambda s, k=k: quadratic(s, "price", k)[0],
        f"quad_r2_{k}": lambda s, k=k: quadratic(s, "price", k)[1],
        f"regression_factor_{k}": lambda s, k=k: f"quad_slope_{k} * quad_r2_{k}",
        f"regr_r2_ret_{k}": lambda s, k=k: f"coalesce({quadratic(s, 'ret_min', k)[1]}, 0)",
        # amplitude of the frame's dear rows less that of its cheap rows
        f"dear_cut_{k}": lambda s, k=k: s.quantile("price", 0.2, k),
        f"cheap_cut_{k}": lambda s, k=k: s.quantile("price", 0.8, k),
        f"amp_pairs_{k}": lambda s, k=k: f"collect_list(named_struct('p', price, 'a', amp)) {over(k)}",
        f"amplitude_{k}": lambda s, k=k: f"(CASE WHEN count(amp) {over(k)} = {k} THEN {_mean_where(s, f'amp_pairs_{k}', f'x.p >= dear_cut_{k}', 'x.a')} - {_mean_where(s, f'amp_pairs_{k}', f'x.p <= cheap_cut_{k}', 'x.a')} END)",
        # log returns of heavy rows, weighted by volume, less those of light rows, weighted by its inverse
        f"pairs_{k}": lambda s, k=k: s.array_of("ret_min IS NOT NULL AND vol IS NOT NULL", k, v="vol", r="ln(greatest(ret_min, 1e-9D))"),
        f"vol_cut_{k}": lambda s, k=k: s.quantile("CASE WHEN ret_min IS NOT NULL THEN vol END", 0.8, k, 5),
        f"struct_rev_{k}": lambda s, k=k: f"(CASE WHEN row_number() OVER ({{P}}) >= {k} AND {s.size(f'pairs_{k}')} >= 5 THEN {_weighted_mean(s, f'pairs_{k}', f'x.v > vol_cut_{k}', 'x.v')} - {_weighted_mean(s, f'pairs_{k}', f'x.v <= vol_cut_{k}', 'try_divide(1, x.v)')} END)",
    }


def _mean_where(s: Sql, a: str, cond: str, value: str) -> str:
    some = s.only(a, cond)
    return f"({s.fold(s.each(some, value))} / nullif({s.size(some)}, 0))"


def _weighted_mean(s: Sql, a: str, cond: str, weight: str) -> str:
    some = s.only(a, cond)
    mean = f"{s.fold(s.each(some, f'({weight}) * x.r'))} / nullif({s.fold(s.each(some, weight))}, 0)"
    return f"(CASE WHEN exists({some}, x -> x.v = 0) THEN NULL ELSE coalesce({mean}, 0) END)"
