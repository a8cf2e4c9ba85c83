"""Token ids as files: Re-Pair grammars per shard, with random access.

A store is a Parquet table of one binary grammar per shard of about ``SHARD_IDS`` ids, in ascending order
of doc_id, written and committed by Spark like any other table.  A grammar replaces frequent pairs of
neighbouring symbols by new symbols, most frequent ones first, again and again; pairs never reach over the
end of a document.  Each round takes all pairs with at least a 32nd of the highest count (of pairs
that share a slot of its hash table one, another one in the next round).  Rounds end when no pair stands
``frequent`` times, when there are ``most_rules`` rules (by default as many as keep symbols at 16 bits with
a vocabulary of 50,000), or after one that saves less than ``least_gain`` of the ids, which costs more time
than space: the README has the sizes.  Rules are stored with the lengths of their expansions, so one document, or any range of
ids, is decoded without the rest.

Layout of a grammar, little-endian: magic ``RPG1``, crc32 of what follows, then 64-bit integers (documents,
symbols, rules, rounds, bytes per symbol, first rule's symbol), then doc ids (8 bytes each, and a byte: 1
where null), ids per document (4), symbols per document (4), rules per round (4), left and right symbols
of the rules, their expansion lengths (4), and the symbols.

Null texts are empty documents, which hold the end id alone; texts of any length are taken whole.  Rows that
repeat a doc_id stand next to each other, ordered by text (rows of one id are dealt out by the beginnings of
their texts); null doc_ids come first.  An empty table makes an empty store.  Other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, documents, partitions, steps, work_folder
from .tokenize import default_tokenizer, encoder

SHARD_IDS = 1 << 20
END_ID = 2
FREQUENT = 8
MOST_RULES = 15_000
#: A round that saves a smaller share of a shard's ids is the last.
LEAST_GAIN = 0.002


def build_grammar(ids: np.ndarray, last: np.ndarray, first_symbol: int, frequent: int = FREQUENT, most_rules: int = MOST_RULES, least_gain: float = LEAST_GAIN):
    """Symbols, which of them end a document, rules (left, right) and rules per round."""
    s, last = ids.astype(np.uint32), last.copy()
    left, right, rounds = [], [], []
    n_rules = 0
    while len(s) > 1 and n_rules < most_rules:
        bits = int(np.clip(len(s).bit_length() - 1, 8, 18))
        key = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        slot = ((key * np.uint64(0x9E3779B97F4A7C15 + 2 * len(rounds))) >> np.uint64(64 - bits)).astype(np.int32)
        owner = np.zeros(1 << bits, np.uint64)
        owner[slot] = key  # of pairs that share a slot one counts in this round
        mine = (owner[slot] == key) & ~last[:-1]
        count = np.bincount(slot[mine], minlength=1 << bits).astype(np.int32)
        most = int(count.max())
        if most < frequent:
            break
        limit = max(frequent, most // 32)
        count[count < limit] = 0
        weight = count[slot] * mine
        # of pairs that overlap the more frequent counts; in a chain of equal ones every second
        chain = np.ones(len(weight), bool)
        chain[1:] = weight[1:] != weight[:-1]
        place = np.arange(len(weight), dtype=np.int32)
        take = (weight > 0) & ((place - np.maximum.accumulate(np.where(chain, place, 0))) & 1 == 0)
        rival = take[1:] & take[:-1]
        less = weight[1:] > weight[:-1]
        take[:-1] &= ~(rival & less)
        take[1:] &= ~(rival & ~less)
        at = np.flatnonzero(take)
        used = np.bincount(slot[at], minlength=1 << bits)
        good = np.flatnonzero(used >= 3)
        if len(good) > most_rules - n_rules:
            good = good[np.argsort(-used[good], kind="stable")[: most_rules - n_rules]]
        if not len(good):
            break
        symbol = np.zeros(1 << bits, np.uint32)
        symbol[good] = first_symbol + n_rules + np.arange(len(good), dtype=np.uint32)
        at = at[symbol[slot[at]] > 0]
        left.append((owner[good] >> np.uint64(32)).astype(np.uint32))
        right.append((owner[good] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        rounds.append(len(good))
        n_rules += len(good)
        s[at] = symbol[slot[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, last = s[keep], last[keep]
        if len(at) < least_gain * len(ids):
            break
    none = np.zeros(0, np.uint32)
    return s, last, np.concatenate([none, *left]), np.concatenate([none, *right]), np.array(rounds, np.uint32)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, first_symbol: int, **limits) -> bytes:
    ends = np.cumsum(lengths)
    last = np.zeros(len(ids), bool)
    last[ends[lengths > 0] - 1] = True
    symbols, last, left, right, rounds = build_grammar(ids, last, first_symbol, **limits)
    per_doc = np.zeros(len(lengths), np.uint32)
    per_doc[lengths > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    size = np.ones(first_symbol + len(left), np.uint32) if len(left) else np.ones(0, np.uint32)
    at = first_symbol
    for n in rounds:
        r = slice(at - first_symbol, at - first_symbol + int(n))
        size[at : at + int(n)] = size[left[r]] + size[right[r]]
        at += int(n)
    width = 2 if first_symbol + len(left) <= 1 << 16 else 4
    kind = f"<u{width}"
    body = struct.pack("<6q", len(lengths), len(symbols), len(left), len(rounds), width, first_symbol)
    body += np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    for x, k in ((lengths, "<u4"), (per_doc, "<u4"), (rounds, "<u4"), (left, kind), (right, kind), (size[first_symbol:], "<u4"), (symbols, kind)):
        body += np.ascontiguousarray(x).astype(k).tobytes()
    return b"RPG1" + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """A grammar that can be read: ``ids()``, ``document(k)``, ``range(start, n)``."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"RPG1" or struct.unpack_from("<I", blob, 4)[0] != zlib.crc32(memoryview(blob)[8:]):
            raise ValueError("not a grammar, or damaged")
        n_docs, n_symbols, n_rules, n_rounds, width, self.first = struct.unpack_from("<6q", blob, 8)
        self._at = 56

        def take(kind, n):
            out = np.frombuffer(blob, kind, n, self._at)
            self._at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths, self.per_doc, self.rounds = take("<u4", n_docs), take("<u4", n_docs), take("<u4", n_rounds)
        self.left, self.right, self.size, self.symbols = (take(f"<u{width}", n_rules), take(f"<u{width}", n_rules), take("<u4", n_rules), take(f"<u{width}", n_symbols))

    def _expand(self, s: np.ndarray) -> np.ndarray:
        s = s.astype(np.uint32)
        top = self.first + len(self.left)
        for n in self.rounds[::-1].tolist():
            low, top = top - n, top - n
            rule = s >= low
            to = np.arange(len(s)) + np.cumsum(rule) - rule
            out = np.empty(len(s) + int(rule.sum()), np.uint32)
            out[to] = s
            which = s[rule] - np.uint32(self.first)
            out[to[rule]], out[to[rule] + 1] = self.left[which], self.right[which]
            s = out
        return s

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        b = int(self.per_doc[: k + 1].sum(dtype=np.int64))
        return self._expand(self.symbols[b - int(self.per_doc[k]) : b])

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from the shard's id number ``start`` on; expands only the symbols that hold them."""
        s = self.symbols.astype(np.int64)
        size = np.ones(len(s), np.int64)
        rule = s >= self.first
        size[rule] = self.size[s[rule] - self.first]
        end = np.cumsum(size)
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, start + n, "left") + 1
        skip = start - int(end[a] - size[a]) if a < len(s) else 0
        return self._expand(self.symbols[a:b])[skip : skip + n]


def write_store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, **limits) -> None:
    """Encode all texts, each with ``end_id`` after it, and write the store's shards to ``path``; ``limits`` of ``build_grammar``."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def shards(batches):
        enc = encoder(tokenizer)
        first = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0

        def out():
            n = np.concatenate(lengths)
            blob = encode_shard(doc_ids, n, np.concatenate(held), first, **limits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "ids_before", "docs", "ids", "grammar"])

        for batch in batches:
            for step in steps(batch, "text", min(STEP_BYTES, 4 * shard_ids)):
                ids, begin = enc.encode(step.column(1))
                ended = np.full(len(ids) + len(begin) - 1, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(begin) - 1), np.diff(begin))] = ids
                doc_ids += step.column(0).to_pylist()
                lengths.append(np.diff(begin) + 1)
                held.append(ended)
                size += len(ended)
                if size >= shard_ids:
                    yield out()
                    shard, before = shard + 1, before + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if size:
            yield out()

    rows.mapInArrow(shards, "part int, shard int, ids_before long, docs long, ids long, grammar binary").write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store; ``start`` counts the ids of all documents before it."""
    return _decoded(spark, path, "ids array<int>", lambda ids: {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})


def _decoded(spark: SparkSession, path: str, schema: str, of_ids) -> DataFrame:
    shards = spark.read.schema("part int, shard int, ids_before long, docs long, ids long, grammar binary").parquet(path)
    # one row for each partition that was written: their number, not that of documents, bounds what is broadcast
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("ids_before")).alias("start"), "grammar")

    def decode(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py())
                ids, n = shard.ids(), shard.lengths.astype(np.int64)
                end = np.cumsum(n)
                cols = {"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(start + end - n), "n_tokens": pa.array(n)}
                cols |= of_ids([ids[a:b] for a, b in zip(end - n, end, strict=True)])
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))

    return rows.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {schema}")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as grammars, read the files back, and return each document's place, size and checksum."""
    path = f"{work_folder(spark)}/tokens"
    write_store(documents(spark, sf_dir), path)
    return _decoded(spark, path, "ids_crc32 long", lambda ids: {"ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())})
