"""Removal of long repeated byte strings with suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Each window of
that length is filed under the smallest hash of its ``GRAM``-byte grams, so equal windows are filed
together and windows whose smallest gram stands nowhere else need no further look.  Neighbouring starts
with the same smallest gram form one run; a run's bytes are its context.

Runs of one gram whose contexts are all equal are repeats as they stand.  Of the others, and of runs in
which the gram itself stands twice, one copy of each
different context goes to shards (``SHARD`` contexts of a gram at most, so that a passage that very many
texts share is dealt out over many tasks).  A shard sorts all suffixes of its contexts by prefix
doubling, in which only groups that are not yet settled are refined (Larsson and Sadakane), and takes
the common prefixes of neighbours by Kasai's rule (a suffix shares at least one byte less than the one
before it).  Where a gram has several shards, each cuts its sorted list of distinct windows by binary
search at the limits of ranges; the lists of one range are merged in pairs, the shorter searched for in
the longer.  Contexts and windows that meet across tasks are equal where their 128-bit blake2b digests
are; inside a shard their bytes are compared.  Joins by gram are dealt out by ``SALTS`` hashes of the
context as well, those by context by hashes of the document, so neither a common passage nor a large
group of copies is one task.

Null texts count as empty; texts shorter than the length lose nothing; an empty table gives an empty
result.  Repeated rows are documents of their own, so their long texts go entirely.  Matches never cross
documents, overlaps count, and everything is judged on the input.  Null and repeated ids keep their rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text, partitions, prefix_hash, span_hash, steps, utf8, written

LENGTH = 400
GRAM = 128
#: Longest run of starts, contexts of one gram in a shard, and bytes of contexts that are sorted together.
RUN = 1024
SHARD = 512
SORT_BYTES = 1 << 19
#: Bytes of texts whose grams are hashed together (or one longer text); a step takes some hundred times as much.
SCAN_BYTES = 1 << 19
#: Into how many parts the rows of one gram, or of one context, are dealt for joins.
SALTS = 16
DEPTH = 7  # bytes in a word of the first sorting
_PLACE = np.uint64(0xFFFFFF)
_NO_ID = -(1 << 62)


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def _runs(batches, length: int, gram: int):
    """Runs of window starts with the same smallest gram: gram hash, context digest, row, first start, starts."""
    names = ["m", "digest", "doc_id", "t", "lo", "n", "own"]
    for batch in batches:
        for part in steps(batch, "text", SCAN_BYTES):
            raw, offs = utf8(part.column(2))
            if len(raw) < length:
                continue
            prefix = prefix_hash(raw)
            at = np.arange(len(raw) - gram + 1)
            # of equal smallest grams the first counts: the low bits of the key are the place
            grams = span_hash(prefix, at, at + gram)
            least = _sliding_min((grams & ~_PLACE) | (at.astype(np.uint64) & _PLACE), length - gram + 1)
            size = np.diff(offs)
            count = np.maximum(size - length + 1, 0)
            begin = np.cumsum(count) - count
            starts = np.arange(count.sum()) - np.repeat(begin - offs[:-1], count)
            doc = np.repeat(np.arange(len(size)), count)
            if not len(starts):
                continue
            place = starts + ((least[starts].astype(np.int64) - starts) & int(_PLACE))
            m = grams[place]
            moved = np.zeros(len(m), bool)
            moved[1:] = (place[1:] != place[:-1]) | (starts[1:] & int(_PLACE) == 0)  # past that, places begin anew
            first = np.ones(len(m), bool)
            first[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
            moved &= ~first
            first = np.flatnonzero(first)
            own = np.add.reduceat(moved, first, dtype=np.int64) > 0
            n = np.diff(np.append(first, len(m)))
            pieces = -(-n // RUN)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            own = np.repeat(own, pieces)
            first, left = np.repeat(first, pieces) + k * RUN, np.repeat(n, pieces) - k * RUN
            n = np.minimum(left, RUN)
            s = starts[first]
            data = memoryview(raw)
            digest = [_digest(data[a:b]) for a, b in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)]
            d = doc[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[first].view(np.int64)), pa.array(digest, pa.binary()), part.column(0).take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array((s - offs[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)], names=names
            )


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (0: an end mark) in the order of their first ``depth`` bytes at least; ranks; first words.

    Prefix doubling: groups of equal suffixes keep the number of their first place, and each round sorts
    only groups of several suffixes by the rank of the suffix that far behind.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(DEPTH, np.int64)])
    word = np.zeros(n, np.int64)
    for j in range(DEPTH):
        word = (word << 9) | padded[j : j + n]
    order = np.argsort(word, kind="stable")
    sorted_words = word[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = DEPTH
    while h < depth:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)  # places of groups that are not settled
        if not len(open_):
            break
        suffix = order[open_]
        behind = suffix + h
        key = rank[suffix] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_], key = suffix[by], key[by]
        split = np.ones(len(open_), bool)
        split[1:] = key[1:] != key[:-1]
        new[open_] = split
        rank[order[open_]] = np.maximum.accumulate(np.where(split, open_, 0))
        h *= 2
    return order, rank, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """For each suffix the bytes (``most`` at least where it is more) that it shares with the one sorted before it.

    Suffix i shares with its neighbour at least one byte less than suffix i - 1 with its own (Kasai).
    Where the bytes before both are equal the two neighbours go in step and it is exactly one less, so
    only the other places are compared.
    """
    n = len(order)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    compare = np.ones(n, bool)
    byte = word >> (9 * (DEPTH - 1))
    compare[1:] = (phi[1:] < 0) | (phi[:-1] < 0) | (phi[1:] != phi[:-1] + 1) | (byte[:-1] != byte[phi[1:] - 1])
    compare[1:] |= ~compare[1:] & (np.arange(1, n) % 4096 == 0)  # values above ``most`` are cut, so begin anew now and then
    at = np.flatnonzero(compare & (phi >= 0))
    shared = np.zeros(n, np.int64)
    live, offset = at, 0
    limit = most + 4096 + DEPTH
    while len(live) and offset < limit:
        x, y = live + offset, phi[live] + offset
        inside = (x < n) & (y < n)
        same = np.zeros(len(live), bool)
        same[inside] = word[x[inside]] == word[y[inside]]
        rest = live[~same & inside]
        differ = word[rest + offset] ^ word[phi[rest] + offset]
        lead = np.zeros(len(rest), np.int64)
        for j in range(1, DEPTH):
            lead += (differ >> (9 * (DEPTH - j))) == 0
        shared[rest] = offset + lead
        shared[live[~inside]] = offset
        live = live[same]
        offset += DEPTH
    shared[live] = offset
    last = np.maximum.accumulate(np.where(compare, np.arange(n), 0))
    return np.maximum(shared[last] - (np.arange(n) - last), 0)


def _sorted_shards(batches, length: int):
    """Chunks of whole shards: (m, sub, shards, doc_id, t, lo, n, bytes) rows."""
    held, size, group = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if size >= SORT_BYTES and row[:2] != group:
                yield held
                held, size = [], 0
            group = row[:2]
            held.append(row)
            size += len(row[7])
    if held:
        yield held


def _merge_starts(doc, t, start, length: int, table):
    """Runs of consecutive starts of one document as byte spans."""
    if not len(start):
        return
    o = np.lexsort((start, doc))
    doc, t, start = doc[o], t[o], start[o]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(start)) - 1
    table["doc_id"] += doc[a].tolist()
    table["t"] += t[a].tolist()
    table["lo"] += start[a].tolist()
    table["hi"] += (start[b] + length).tolist()


def _shard_repeats(batches, length: int, ranges: int):
    """Spans of windows that repeat inside a shard, and per digest range the distinct windows of shared grams."""
    for rows in _sorted_shards(batches, length):
        sizes = np.array([len(r[7]) + 1 for r in rows])
        data = b"\0".join(r[7] for r in rows) + b"\0"
        text = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        begin = np.cumsum(sizes) - sizes
        text[begin + sizes - 1] = 0
        order, _, word = suffix_array(text, length)
        shared = common_prefixes(order, word, length)
        n = np.array([r[6] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        valid = np.repeat(begin, n) + start
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        tied = shared[order] >= length  # with the one before it
        is_window = np.zeros(len(text), bool)
        is_window[valid] = True
        tied &= is_window[order]
        after = np.append(tied[1:], False)
        local = (tied | after)[place[valid]]
        doc = np.array([r[3] for r in rows], np.int64)
        t = np.array([r[4] for r in rows], np.int64)
        lo = np.array([r[5] for r in rows], np.int64)
        out = {"doc_id": [], "t": [], "lo": [], "hi": [], "part": [], "windows": []}
        _merge_starts(doc[row[local]], t[row[local]], lo[row[local]] + start[local], length, out)
        out["part"] += [None] * len(out["lo"])
        out["windows"] += [None] * len(out["lo"])
        several = np.array([r[2] > 1 for r in rows])[row]
        one = np.flatnonzero(several & ~tied[place[valid]])  # the first of each set of equal windows
        if len(one):
            at = valid[one]
            w = np.zeros(len(one), _WINDOW)
            w["digest"] = [_digest(data[x : x + length]) for x in at.tolist()]
            w["doc"], w["t"], w["start"], w["known"] = doc[row[one]], t[row[one]], lo[row[one]] + start[one], local[one]
            w = np.sort(w, order="digest")
            limits = np.array([(k * (1 << 64) // ranges).to_bytes(8, "big") for k in range(1, ranges)], "S16")
            for k, piece in enumerate(np.split(w, np.searchsorted(w["digest"], limits))):
                if len(piece):
                    for c in ("doc_id", "t", "lo", "hi"):
                        out[c].append(None)
                    out["part"].append(k)
                    out["windows"].append(piece.tobytes())
        yield _table(out)


# digests are of one length, so that the end zeros which this type does not show are no matter
_WINDOW = np.dtype([("digest", "S16"), ("doc", "i8"), ("t", "i8"), ("start", "i4"), ("known", "?")])
_SPAN = "doc_id long, t long, lo int, hi int"


def _table(out: dict) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "t": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "part": pa.int32(), "windows": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))


def _merged_ranges(batches, length: int):
    """Spans of windows that stand in several shards; the rows of a digest range follow each other."""

    def merge(x, y, found):
        """Both sorted lists as one; windows of both are found, and stay once."""
        if len(x) < len(y):
            x, y = y, x
        at = np.searchsorted(x["digest"], y["digest"])
        near = np.minimum(at, len(x) - 1)
        same = x["digest"][near] == y["digest"]
        found += [x[near[same]], y[same]]
        x = x.copy()
        x["known"][near[same]] = True
        return np.insert(x, at[~same], y[~same])

    def spans(pieces):
        lists, found = [np.frombuffer(p, _WINDOW) for p in pieces], []
        while len(lists) > 1:
            lists = [merge(*lists[i : i + 2], found) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
        w = np.concatenate([np.zeros(0, _WINDOW), *found])
        w = w[~w["known"]]
        out = {"doc_id": [], "t": [], "lo": [], "hi": []}
        _merge_starts(w["doc"], w["t"], w["start"].astype(np.int64), length, out)
        return _table(out)

    part, pieces = None, []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != part and pieces:
                yield spans(pieces)
                pieces = []
            part = k
            pieces.append(piece)
    if pieces:
        yield spans(pieces)


def _cut_contexts(batches, length: int):
    for batch in batches:
        raw, offs = utf8(batch.column(2))
        data = raw.tobytes()
        out = [[] for _ in range(8)]
        for i, (doc, t, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for x in wanted:
                a = int(offs[i]) + x["lo"]
                for c, v in zip(out, (x["m"], x["sub"], x["shards"], doc, t, x["lo"], x["n"], data[a : a + x["n"] + length - 1]), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["m", "sub", "shards", "doc_id", "t", "lo", "n", "bytes"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text, spans): per row of ``docs`` the byte spans (lo, hi), unmerged, of repeated windows; null if none."""
    spark = docs.sparkSession
    gram = min(GRAM, max(1, length // 2))
    n = partitions(spark)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # equal texts have equal spans, so a text's hash tells rows of one id apart
    texts = texts.select("id", F.coalesce("id", F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    by_context = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt")
    by_row = F.pmod(F.xxhash64("doc_id", "t", "lo"), F.lit(SALTS)).alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt")
    runs = written(texts.where(F.octet_length("text") >= length).select("doc_id", "t", "text").mapInArrow(lambda b: _runs(b, length, gram), "m long, digest binary, doc_id long, t long, lo int, n int, own boolean"), "runs")
    known = runs.groupBy("m").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("m", every_salt)
    repeats = written(runs.select("*", by_context).join(known, ["m", "salt"], "left_semi").drop("salt"), "repeats")
    contexts = repeats.groupBy("m", "digest").agg(F.count("*").alias("copies"), F.max("own").alias("own"), F.min(F.struct("doc_id", "t", "lo", "n")).alias("x"))
    contexts = written(contexts, "contexts")
    mixed = contexts.groupBy("m").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("m", (1 + F.floor(F.col("c") / SHARD)).cast("int").alias("shards"))
    wanted = contexts.select("*", by_context).join(mixed.select("*", every_salt), ["m", "salt"]).select("m", "shards", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int").alias("sub"), "x.*")
    wanted = written(wanted, "wanted")
    windows = wanted.where("shards > 1").agg(F.sum("n")).first()[0] or 0
    ranges = max(n, int(windows // 500_000) + 1)
    per_doc = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("m", "sub", "shards", "lo", "n")).alias("wanted"))
    # copies of a row are cut once: contexts are of one of them, but their key is that of all
    cut = texts.join(per_doc, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "wanted").mapInArrow(lambda b: _cut_contexts(b, length), "m long, sub int, shards int, doc_id long, t long, lo int, n int, bytes binary")
    shards = cut.repartition(n, "m", "sub").sortWithinPartitions("m", "sub")
    found = written(shards.mapInArrow(lambda b: _shard_repeats(b, length, ranges), f"{_SPAN}, part int, windows binary"), "found")
    merged = found.where("part is not null").select("part", "windows").repartition(n, "part").sortWithinPartitions("part").mapInArrow(lambda b: _merged_ranges(b, length), _SPAN)
    several = contexts.where("copies > 1").select("m", "digest", every_salt)
    copies = repeats.select("*", by_row).join(several, ["m", "digest", "salt"], "left_semi").select("doc_id", "t", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    spans = copies.unionByName(found.where("part is null").select("doc_id", "t", "lo", "hi")).unionByName(merged)
    per_doc = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.join(per_doc, ["doc_id", "t"], "left").select(F.col("id").alias("doc_id"), "text", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row; ``kept`` are the remaining bytes."""

    def cut(part: pa.RecordBatch) -> dict:
        raw, offs = utf8(part.column(part.schema.get_field_index("text")))
        data = raw.tobytes()
        out = {"n_bytes": np.diff(offs), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
            gone, at, left = merged(spans), int(offs[i]), []
            for lo, hi in gone:
                left.append(data[at : offs[i] + lo])
                at = int(offs[i]) + hi
            left.append(data[at : offs[i + 1]])
            left = b"".join(left)
            out["n_removed"].append(sum(hi - lo for lo, hi in gone))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left if keep_bytes else None)
        return out | {"n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept": pa.array(out["kept"], pa.binary())}

    cut.reads = ("spans",)
    return map_text(repeated_spans(docs, doc_id, text, length), "text", "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", cut, keep=["doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 400-byte repeats cover, as counts and a digest of the rest."""
    return without_repeats(documents(spark, sf_dir), keep_bytes=False).drop("kept")
