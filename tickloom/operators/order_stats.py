"""Order statistics of row-count frames: quantiles and ranks, in time logarithmic in the frame.

A contract's rows are cut into blocks, each with a copy of the rows before it that its frames reach (``in_blocks``),
and a block goes to one Arrow call.  There a wavelet matrix over the block's values answers all rows' frames at once,
a bit of the values' ranks at a time: no frame is ever sorted, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.factors import BLOCK_ROWS, dealt, in_blocks, numbered


class Quantile(NamedTuple):
    """The q quantile, linear between neighbours, of the last ``rows`` rows; NULL below ``least`` known values."""

    column: str
    q: float
    rows: int
    least: int


class Rank(NamedTuple):
    """(smaller values + 0.5) / (known values - 1) of a row in its frame, at most 1; 0.5 in a flat frame, NULL for an unknown value."""

    column: str
    rows: int
    least: int


class Frames:
    """Frames of the last ``rows`` rows over one sequence with gaps, NaN for none."""

    def __init__(self, x: np.ndarray):
        known = ~np.isnan(x)
        self.x, self.before = x, np.concatenate([[0], np.cumsum(known)])
        self.values, codes = np.unique(x[known] + 0.0, return_inverse=True)
        self.codes = np.zeros(len(x), np.int64)
        self.codes[known] = codes
        self.levels = []
        for bit in range(max(len(self.values) - 1, 0).bit_length() - 1, -1, -1):
            one = (codes >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one)]), int((~one).sum())))
            codes = np.concatenate([codes[~one], codes[one]])

    def ends(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's frame begins and ends among the known values."""
        at = np.arange(len(self.x))
        return self.before[np.maximum(at - rows + 1, 0)], self.before[at + 1]

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The rank, among all different values, of the n-th smallest value (from 0) of each frame."""
        out = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            up = n >= b - a
            n = np.where(up, n - (b - a), n)
            low, high = np.where(up, split + low - a, a), np.where(up, split + high - b, b)
            out |= up.astype(np.int64) << bit
        return out

    def below(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many of each frame's values are smaller."""
        out = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b, up = zeros[low], zeros[high], (code >> bit & 1).astype(bool)
            out += np.where(up, b - a, 0)
            low, high = np.where(up, split + low - a, a), np.where(up, split + high - b, b)
        return out

    def quantile(self, q: float, rows: int, least: int) -> np.ndarray:
        low, high = self.ends(rows)
        fit = high - low >= max(least, 1)
        low, high, out = low[fit], high[fit], np.full(len(self.x), np.nan)
        place = q * (high - low - 1)
        first = np.floor(place).astype(np.int64)
        a, b = self.values[self.nth(low, high, first)], self.values[self.nth(low, high, np.minimum(first + 1, high - low - 1))]
        out[fit] = np.where(a == b, a, a + (b - a) * (place - first))
        return out

    def rank(self, rows: int, least: int) -> np.ndarray:
        low, high = self.ends(rows)
        fit = (high - low >= max(least, 1)) & ~np.isnan(self.x)
        low, high, out = low[fit], high[fit], np.full(len(self.x), np.nan)
        n = high - low
        flat = self.nth(low, high, np.zeros(len(n), np.int64)) == self.nth(low, high, n - 1)
        out[fit] = np.where(flat, 0.5, np.minimum((self.below(low, high, self.codes[fit]) + 0.5) / np.maximum(n - 1, 1), 1))
        return out


def with_rows(df: DataFrame, keys: list[str], order: list[str], pieces: Iterable[str], name: str) -> DataFrame:
    """``df`` with each row's number in its keys; by counts of pieces, where keys hold none of them, else by sorting a key's rows."""
    if set(pieces) & set(keys) or not set(pieces) <= set(df.columns):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    return numbered(df, keys, list(pieces), order, name)


def frame_order(df: DataFrame, keys: Iterable[str], order: Iterable[str], wanted: dict[str, Quantile | Rank], pieces: Iterable[str] = ("trade_day",), row: str = "row_at") -> DataFrame:
    """``df`` with a column for each of ``wanted``, over each key's rows in ``order``.

    NaN counts as unknown.  A key may hold any number of rows: they are numbered by counts of ``pieces`` (days),
    unless ``row`` numbers them already (without gaps), and no call sees more than a block of them.
    """
    keys, back = list(keys), max(w.rows for w in wanted.values()) - 1
    at = row if row in df.columns else "_at"
    rows = df if row in df.columns else with_rows(df, keys, list(order), list(pieces), at)
    rows = dealt(in_blocks(rows, at, max(BLOCK_ROWS, 8 * back), back, 0), [*keys, "_block"])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])
    names, used = df.columns, dict(wanted)

    def block(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(at, "ascending")]))
        own = t.column("_own")
        frames = {}
        for w in used.values():
            if w.column not in frames:
                x = t.column(w.column).cast(pa.float64())
                frames[w.column] = Frames(np.asarray(pc.fill_null(x, float("nan"))))
        out = t.select(names)
        for name, w in used.items():
            f = frames[w.column]
            x = f.quantile(w.q, w.rows, w.least) if isinstance(w, Quantile) else f.rank(w.rows, w.least)
            out = out.append_column(name, pa.array(x, mask=np.isnan(x)))
        return out.filter(own)

    return rows.groupBy(*keys, "_block").applyInArrow(block, schema)
