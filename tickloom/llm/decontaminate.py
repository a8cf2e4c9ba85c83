"""Benchmark decontamination with suffix arrays over the training texts.

Each bounded slice of a training partition is a shard.  Its words become ids of the test vocabulary,
suffixes that cannot begin a test window (a word, pair or triple that no test text has) are left out
unseen, and the rest is sorted into a suffix array.  Every test window is looked up in it by binary
search; chains of hits on one diagonal are the longest verbatim matches.

Test texts go out in blocks of at most ``BLOCK_BYTES``; each block is one more pass over the rows, so
that any number of test texts is held against all training texts and nothing is shuffled.

Null or empty texts, and texts without a word, have no words and no hits.  Repeated rows are judged
one by one, test texts that repeat count as items of their own.  An empty table gives an empty
result, an empty test table no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, HashTable, documents, map_text, mix, utf8, word_hashes, word_spans

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
WINDOW = 10
BLOCK_BYTES = 16 << 20
SPANS = "hit_spans array<struct<start:int,end:int>>, hit_items array<string>, longest_words int, longest_start int, longest_item string"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and how many words stand before each text."""
    raw, offs = utf8(column)
    raw = LOWER[raw]
    starts, ends, before = word_spans(raw, offs, WORD)
    return word_hashes(raw, starts, ends), before


def _bits(n: int) -> int:
    return max(16, int(n).bit_length() + 4)


class TestBlock:
    """A block of test texts: its vocabulary, its windows in sorted order and where each stands."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        hashes, before = _words(pa.array([t for _, t in items], pa.string()))
        self.items = np.array([str(i) for i, _ in items], object)
        self.vocabulary = HashTable(np.unique(hashes))
        ids = (self.vocabulary.find(hashes) + 1).astype(np.uint32)
        rows, self.at, self.length = [], [], []
        for k in range(len(items)):
            a, b = int(before[k]), int(before[k + 1])
            for s in range(a, max(b - window, a) + 1) if b > a else ():
                n = min(window, b - a)
                row = np.zeros(window, np.uint32)
                row[:n] = ids[s : s + n]
                rows.append(row)
                self.at.append((k, s - a))
                self.length.append(n)
        windows = np.array(rows, np.uint32).reshape(-1, window)
        self.at, self.length = np.array(self.at, np.int64).reshape(-1, 2), np.array(self.length, np.int64)
        self.low = as_bytes(windows)
        high = windows.copy()
        for n in np.unique(self.length[self.length < window]):
            high[self.length == n, n:] = 0xFFFFFFFF
        self.high = as_bytes(high)
        self.starts = [self._flags(windows, n) for n in (1, 2, 3)]

    def _flags(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Flags by hash of the first n words of each window; a window of fewer words fits any text."""
        flags = np.zeros(1 << _bits(len(windows)), bool)
        whole = self.length >= n
        flags[_start_key(windows[whole, :n].T, len(flags))] = True
        self.short = np.unique(windows[self.length < 3, 0]) if n == 3 else None
        return flags


def _start_key(columns, size: int) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0x100000001B3) + c.astype(np.uint64))
    return (key & np.uint64(size - 1)).astype(np.int64)


def as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{4 * max(1, rows.shape[1])}")


def suffix_array(ids: np.ndarray, doc_end: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (as far as a window reaches) and their places, of those that can begin a test window."""
    at = np.flatnonzero(ids)
    at = at[block.starts[0][_start_key([ids[at]], len(block.starts[0]))]]
    keep = np.zeros(len(at), bool)
    if len(block.short):
        keep = np.isin(ids[at], block.short)
    padded = np.concatenate([ids, np.zeros(block.window, np.uint32)])
    for n in (2, 3):
        look = at[~keep]
        ok = block.starts[n - 1][_start_key([padded[look + j] for j in range(n)], len(block.starts[n - 1]))]
        keep_now = np.concatenate([at[keep], look[ok]])
        at = np.sort(keep_now)
        keep = np.isin(ids[at], block.short) if len(block.short) else np.zeros(len(at), bool)
    rows = padded[at[:, None] + np.arange(block.window)]
    rows[at[:, None] + np.arange(block.window) >= doc_end[at][:, None]] = 0
    keys = as_bytes(rows)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def find_windows(column: pa.Array, block: TestBlock):
    """Per slice of texts: words before each text, and (place, window) of each test window's occurrences."""
    hashes, before = _words(column)
    ids = (block.vocabulary.find(hashes) + 1).astype(np.uint32)
    doc_end = np.repeat(before[1:], np.diff(before))
    keys, places = suffix_array(ids, doc_end, block)
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    where = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
    return before, where, which


def _scan(part: pa.RecordBatch, text: str, block: TestBlock, first: bool) -> dict:
    column = part.column(part.schema.get_field_index(text))
    before, where, which = find_windows(column, block)
    n_docs = len(before) - 1
    doc = np.searchsorted(before, where, "right") - 1
    item, q = (block.at[which, 0], block.at[which, 1]) if len(which) else (which, which)
    length = block.length[which] if len(which) else which
    old = {k: [None] * n_docs for k in ("hit_spans", "hit_items", "longest_words", "longest_start", "longest_item")}
    if not first:
        old = {k: part.column(part.schema.get_field_index(k)).to_pylist() for k in old}
    out = {k: [] for k in old}
    order = np.lexsort((where, where - q, item, doc))
    doc, item, q, where, length = doc[order], item[order], q[order], where[order], length[order]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for k in range(n_docs):
        a, b = bounds[k], bounds[k + 1]
        spans, items = list(old["hit_spans"][k] or []), set(old["hit_items"][k] or [])
        longest = old["longest_words"][k] or 0, old["longest_start"][k], old["longest_item"][k]
        if b > a:
            w, i, d, e = where[a:b], item[a:b], (where - q)[a:b], (where + length)[a:b]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)]))
            last = np.concatenate([new[1:], [b - a]]) - 1
            s, t = w[new] - before[k], e[last] - before[k]
            spans += [{"start": int(x), "end": int(y)} for x, y in zip(s, t, strict=True)]
            items |= set(block.items[np.unique(i)])
            best = int(np.argmax(t - s))
            if t[best] - s[best] > longest[0]:
                longest = int(t[best] - s[best]), int(s[best]), str(block.items[i[new[best]]])
        out["hit_spans"].append(spans)
        out["hit_items"].append(sorted(items))
        for name, v in zip(("longest_words", "longest_start", "longest_item"), longest, strict=True):
            out[name].append(v)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return {"n_words": pa.array(np.diff(before), pa.int64()), "hit_spans": pa.array(out["hit_spans"], span), "hit_items": pa.array(out["hit_items"], pa.list_(pa.string()))} | {
        k: pa.array(out[k], kind) for k, kind in (("longest_words", pa.int32()), ("longest_start", pa.int32()), ("longest_item", pa.string()))
    }


def test_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The test texts in blocks that the driver can hold: each at most about ``block_bytes``, or one text."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = 1 + size // block_bytes
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        found = sorted(((r.i, r.t) for r in block.collect()), key=lambda x: (x[0] or "", x[1] or ""))
        if found:
            yield found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (of words), hit_items, and length, start and item of the longest verbatim match."""
    out, first = docs, True
    for items in test_blocks(benchmark, item, item_text, block_bytes) if benchmark is not None else ():
        block = out.sparkSession.sparkContext.broadcast(items)

        def scan(part, block=block, first=first, made={}):  # noqa: B006  one index per worker
            if "index" not in made:
                made["index"] = TestBlock(block.value, window)
            return _scan(part, text, made["index"], first)

        scan.reads = () if first else ("hit_spans", "hit_items", "longest_words", "longest_start", "longest_item")
        out = map_text(out, text, f"n_words bigint, {SPANS}", scan)
        first = False
    if first:
        empty = lambda part: _scan(part, text, TestBlock([], window), True)
        out = map_text(out, text, f"n_words bigint, {SPANS}", empty)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a test window, in the columns of ``docs``, whatever their names."""
    places = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    found = contamination(docs.toDF(*places.values()), benchmark, places[text], window)
    return found.where(F.size("hit_spans") == 0).select(*[F.col(p).alias(c) for c, p in places.items()])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside occurrences of test windows, and the items found."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    # the union of the spans by a fold over the sorted spans, the digest by built-in functions
    covered = F.aggregate(
        F.array_sort("hit_spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.reach))).cast("long").alias("n"), F.greatest(a.reach, s.end).alias("reach")),
        lambda a: a.n,
    )
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        F.coalesce("longest_words", F.lit(0)).cast("long").alias("longest_words"),
    )


ORACLE_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
q AS (SELECT DISTINCT m.doc_id, m.item_id, m.i, m.n, b.q FROM m JOIN (SELECT item_id, n, g, q FROM (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, i AS q FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0)) b ON b.item_id = m.item_id AND b.n = m.n JOIN dw ON dw.doc_id = m.doc_id AND dw.i = m.i AND dw.n = m.n AND dw.g = b.g),
r AS (SELECT doc_id, max(len) AS longest_words FROM (SELECT doc_id, count(*) + min(n) - 1 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - q ORDER BY i) AS grp FROM q) GROUP BY doc_id, item_id, i - q, grp) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(k.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated, CAST(coalesce(r.longest_words, 0) AS BIGINT) AS longest_words
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
