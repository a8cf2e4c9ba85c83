"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``EXPONENT * q`` long, that no neighbouring word
extends.  Periods below ``SMALL`` are read off directly: words q apart are compared.  Longer ones are found
scale by scale, for w = SMALL, 2 * SMALL, 4 * SMALL and so on those of w <= q < 2w:

* every stretch of w words has a name, the same for equal stretches; names of 2w words come from pairs of names,
  so equal names always mean equal words;
* stretches inside a run of a period of at most w / 4, all known from the scales before, are highly periodic and
  never selected;
* a place is selected where the least hash of the names in reach of w places is that of its first or of its last
  stretch.  So places of equal contexts (2w words) are selected alike, and w places in a row without one lie in a
  highly periodic region;
* selected places of equal context that follow each other at a distance of w <= q < 2w propose the period q.  A
  run of that period is at least 4q >= q + 3w long, so it holds such a pair, and no shorter distance in it can
  have equal contexts.  Proposals that overlap are joined, and grown while words q apart are equal.

So all runs are found, and nothing is found that is not one.  Work is a sort of the words for each scale, and only
texts take part that hold some stretch of ``SMALL`` words twice.

Null, empty and blank texts have no words and no runs.  Rows are judged one by one, so repeated rows get equal
answers; a row without doc_id is judged by its text like any other.  Texts of any length are taken whole.  Of runs
with one exponent the first is the best, of those at one start the one of the smaller period.  Columns named like
the new ones are replaced, all others stay.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text, mix, prefix_hash, span_hash, utf8, word_spans
from .minhash import NOT_SPACE

SMALL = 8
EXPONENT = 4
SHORTEST = 6
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts, a number for each word (equal for equal words), and where each text's begin."""
    raw, offs = utf8(column)
    starts, ends, before = word_spans(raw, offs, NOT_SPACE)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    data = np.ascontiguousarray(raw[NOT_SPACE[raw]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), before


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _small(codes: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Runs of periods below ``SMALL``: rows (start, end, period), also of periods that are not the smallest."""
    out = []
    for q in range(1, min(SMALL, len(codes))):
        same = (codes[:-q] == codes[q:]) & (np.arange(q, len(codes)) < end[:-q])
        a, b = _stretches(same)
        long = b - a >= (EXPONENT - 1) * q
        out.append(np.stack([a[long], b[long] + q, np.full(long.sum(), q)], 1))
    return out


def _with_repeats(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Texts that hold some stretch of ``SMALL`` words twice, as flags."""
    n = np.diff(before)
    count = np.maximum(n - SMALL + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) + np.repeat(before[:-1] - (np.cumsum(count) - count), count)
    h = span_hash(prefix_hash(codes), at, at + SMALL) ^ mix(text.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    again = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(n), bool)
    out[text[order][1:][again]] = True
    return out


def _paired(names: np.ndarray, end: np.ndarray, w: int) -> np.ndarray:
    """Names of 2w words from those of w; -1 where a text ends before."""
    out = np.full(len(names), -1, np.int64)
    at = np.flatnonzero(np.arange(2 * w, len(names) + 2 * w) <= end)
    if len(at):
        out[at] = np.unique(names[at] * (names.max() + 1) + names[at + w], return_inverse=True)[1]
    return out


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Of each place the least hash among it and the w places behind it; w is a power of two."""
    m, k = h.copy(), 1
    while k < w:
        m[:-k] = np.minimum(m[:-k], m[k:])
        k *= 2
    m[:-1] = np.minimum(m[:-1], m[1:])
    return m


def selected(names: np.ndarray, end: np.ndarray, w: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set: places chosen by hashes of the stretches of w words that begin in their reach."""
    h = mix(names.astype(np.uint64) + np.uint64(w))
    h[periodic | (names < 0)] = _NEVER
    least = _least(h, w)
    at = np.flatnonzero((np.arange(2 * w, len(names) + 2 * w) <= end) & (least != _NEVER))
    return at[(h[at] == least[at]) | (h[at + w] == least[at])]


def _grow(codes: np.ndarray, lo: int, hi: int, q: int, first: int, end: int) -> tuple[int, int]:
    """The stretch [lo, hi) of period q, as far as it goes inside [first, end)."""
    step = 32
    while lo > first:
        k = min(step, lo - first)
        differs = np.flatnonzero(codes[lo - k : lo] != codes[lo - k + q : lo + q])
        if len(differs):
            lo = lo - k + int(differs[-1]) + 1
            break
        lo, step = lo - k, step * 2
    step = 32
    while hi < end:
        k = min(step, end - hi)
        differs = np.flatnonzero(codes[hi : hi + k] != codes[hi - q : hi + k - q])
        if len(differs):
            hi += int(differs[0])
            break
        hi, step = hi + k, step * 2
    return lo, hi


def _scale(codes: np.ndarray, first: np.ndarray, end: np.ndarray, names: np.ndarray, w: int, known: list[np.ndarray]) -> np.ndarray:
    """Runs of periods from w to 2w - 1, as rows (start, end, period); ``known`` has those of all smaller periods."""
    inside = np.zeros(len(codes) + 1, np.int64)
    for a, b, q in known:
        fits = (4 * q <= w) & (b - a >= w)
        np.add.at(inside, a[fits], 1)
        np.add.at(inside, b[fits] - w + 1, -1)
    at = selected(names, end, w, np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    context = names[at] * (names.max() + 1) + names[at + w]
    order = np.lexsort((at, context))
    a, b = at[order][:-1], at[order][1:]
    q = b - a
    pair = (context[order][1:] == context[order][:-1]) & (end[a] == end[b]) & (q >= w) & (q < 2 * w)
    a, q = a[pair], q[pair]
    order = np.lexsort((a, q))
    a, q = a[order], q[order]
    if not len(a):
        return np.zeros((0, 3), np.int64)
    begins = np.concatenate([[True], (q[1:] != q[:-1]) | (a[1:] > a[:-1] + 2 * w)])
    lo, last = a[begins], a[np.concatenate([np.flatnonzero(begins)[1:] - 1, [len(a) - 1]])]
    out = set()
    for x, y, p in zip(lo.tolist(), last.tolist(), q[begins].tolist(), strict=True):
        s, e = _grow(codes, x, y + p + 2 * w, p, int(first[x]), int(end[x]))
        if e - s >= EXPONENT * p:
            out.add((s, e, p))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def find_runs(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """All runs of all texts, of whatever length: rows (start, end, period) by start and period, places among all words."""
    n = np.diff(before)
    found = _small(codes, np.repeat(before[1:], n))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    stay, w = _with_repeats(codes, before), SMALL
    some, old, names = codes, None, None
    while True:
        texts = np.flatnonzero(stay & (n >= EXPONENT * w))
        if not len(texts):
            break
        # the words of these texts alone, each text's first and end, and where they stand among all
        size = n[texts]
        local = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(local[-1]) + np.repeat(before[texts] - local[:-1], size)
        first, end = np.repeat(local[:-1], size), np.repeat(local[1:], size)
        some = codes[place]
        if names is None:
            names, k = some, 1
            while k < w:
                names, k = _paired(names, end, k), 2 * k
        else:
            keep = np.isin(old, texts)
            names = _paired(names[keep], end, w // 2)
        old = np.repeat(texts, size)
        text = np.searchsorted(before, rows[:, 0], "right") - 1
        near = np.flatnonzero((stay & (n >= EXPONENT * w))[text])
        shift = np.zeros(len(n), np.int64)
        shift[texts] = before[texts] - local[:-1]
        known = (rows[near, 0] - shift[text[near]], rows[near, 1] - shift[text[near]], rows[near, 2])
        new = _scale(some, first, end, names, w, [known])
        if len(new):
            move = shift[old[new[:, 0]]]
            rows = np.concatenate([rows, np.stack([new[:, 0] + move, new[:, 1] + move, new[:, 2]], 1)])
        w *= 2
    # a stretch found by a multiple of its period is found by its period as well
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _joined(words: pa.Array, keep: np.ndarray, before: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    some = words.filter(pa.array(keep))
    raw, bounds = utf8(some)
    last = np.concatenate([[0], np.cumsum(keep)])[before]
    space = np.ones(len(some), np.int64)
    space[last[1:][np.diff(last) > 0] - 1] = 0  # none behind a text's last word
    ends = np.cumsum(np.diff(bounds) + space)
    out = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    letter = np.ones(len(out), bool)
    letter[(ends - 1)[space > 0]] = False
    out[letter] = raw
    offsets = np.concatenate([[0], ends])[last].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(before) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, period and length in words, by start and period) and ``collapsed``: the words outside runs or in a run's first period, joined by one space."""

    def find(part: pa.RecordBatch) -> dict:
        words, codes, before = words_of(part.column(part.schema.get_field_index(text)))
        rows = find_runs(codes, before)
        rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(SHORTEST, EXPONENT * rows[:, 2])]
        covered = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covered, rows[:, 0] + rows[:, 2], 1)
        np.add.at(covered, rows[:, 1], -1)
        bounds = np.searchsorted(rows[:, 0], before)
        own = np.searchsorted(before, rows[:, 0], "right") - 1
        fields = [pa.array(rows[:, 0] - before[own]), pa.array(rows[:, 2]), pa.array(rows[:, 1] - rows[:, 0])]
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "period", "length"]))
        return {"n_words": pa.array(np.diff(before)), "runs": runs, "collapsed": _joined(words, np.cumsum(covered[:-1]) == 0, before)}

    return map_text(docs, text, f"n_words bigint, runs {RUNS}, collapsed string", find, keep)


def with_planted_period(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of the query: every tenth one, by the hash of its doc_id, repeats some of its words up to its end."""
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    docs = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    planted = """array_join(transform(sequence(0, _n - 1), i -> CASE WHEN i < _a THEN _w[i] ELSE _w[int(_a + (i - _a) % (1 + floor((_n - _a) / (3 + (_h div 10) % 8))))] END), ' ')"""
    docs = docs.withColumn("_a", F.expr("CASE WHEN _n > 0 THEN (_h div 10) % _n END"))
    return docs.withColumn(text, F.when(F.col("_n") > 0, F.expr(planted)).otherwise(F.col(text))).drop("_h", "_w", "_n", "_a")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its runs of words, the one of the greatest exponent, and digests of runs and of collapsed text."""
    docs = with_planted_period(documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text")))
    found = periodic_runs(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length.cast("double") / r.period).alias("e"), (-r.start).alias("s"), (-r.period).alias("p"), r.length.alias("length"))))
    found = found.withColumn("best", best)
    line = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
