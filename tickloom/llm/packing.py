"""Best-fit packing of token sequences in rounds.

Each partition packs its pieces by best fit, largest first, and emits the bins that are nearly full.  All
others go on as single items; a round's partitions are an ``FAN``-th of those before, so underfull bins
meet those of other partitions and are packed by best fit again, until one partition is left.  Where more
than ``CHUNK`` underfull bins are left for a partition, a round has as many partitions as bound them, and
deals them anew; rounds end as well when one of them saves less than ``LEAST_SAVED`` of its bins, which
then stay as packed.  No piece is dropped.

Null texts are empty documents, which hold the end id alone; texts of any length are taken whole.  Repeated
rows are packed as often as they stand; a null doc_id is kept; pieces of equal length are packed in the
order in which they come.  An empty table gives an empty result.  ``pack`` keeps other columns, and replaces
those named like its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text, partitions, written
from .tokenize import default_tokenizer, encoder

CAPACITY = 2048
NEARLY = 0.99
FAN = 8
LEAST_SAVED = 0.002
#: Pieces, and later underfull bins, that are packed together.
CHUNK = 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and place there, and how full each bin is."""
    bins = np.zeros(len(sizes), np.int64)
    place = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-sizes, kind="stable")
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if size and fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[k], place[k] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return bins, place, np.array(fill, np.int64)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text: cut only where it is over ``capacity`` ids."""
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])
    end = np.array([end_id], np.uint32)

    def cut(part: pa.RecordBatch) -> dict:
        ids, begin = encoder(tokenizer).encode(part.column(part.schema.get_field_index("text")))
        rows = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            doc = np.concatenate([ids[a:b], end]).astype("<u4")
            n = len(doc)
            head = n % capacity or capacity
            cuts = [0, *range(min(head, n), n + 1, capacity)]
            rows.append([{"piece": k, "start": s, "length": e - s, "ids_crc32": zlib.crc32(doc[s:e])} | ({"ids": doc[s:e].astype(np.int32)} if keep_ids else {}) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
        return {"pieces": pa.array(rows, pa.list_(kind))}

    ids = ", ids: array<int>" if keep_ids else ""
    cut_texts = map_text(docs, "text", f"pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint{ids}>>", cut, keep=["doc_id"])
    return cut_texts.select("doc_id", F.inline("pieces"))


def pack(items: DataFrame, capacity: int = CAPACITY, nearly: float = NEARLY, length: str = "length") -> DataFrame:
    """``items`` with sequence_id and offset: none over ``capacity``, gapless from offset 0."""
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset", "done")
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, done boolean"

    def round_of(level: int, final: bool):
        def run(batches):
            part, made = TaskContext.get().partitionId(), 0

            def packed(held):
                nonlocal made
                rows = pa.Table.from_batches(held).combine_chunks()
                n = rows.column(length).to_numpy().astype(np.int64)
                old, inner = rows.column("sequence_id").to_numpy().astype(np.int64), rows.column("offset").to_numpy().astype(np.int64)
                if level:  # rows of one bin of the round before are one item
                    _, item = np.unique(old, return_inverse=True)
                    sizes = np.bincount(item, weights=n).astype(np.int64)
                else:
                    item, sizes = np.arange(len(n)), n
                bins, place, fill = best_fit(sizes, capacity)
                under = np.flatnonzero(fill < nearly * capacity) if not final else np.zeros(0, np.int64)
                done = np.ones(len(fill), bool)
                done[under] = False
                ids = (level << 58) | (part << 34) | (made + np.arange(len(fill)))
                made += len(fill)
                out = rows.select(columns)
                for name, v in (("sequence_id", ids[bins[item]]), ("offset", place[item] + inner), ("done", done[bins[item]])):
                    out = out.append_column(name, pa.array(v))
                return out.to_batches()

            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= CHUNK and not level:
                    yield from packed(held)
                    held, n = [], 0
            if n:
                yield from packed(held)

        return run

    n, level, finished, bins = partitions(spark), 0, [], None
    todo = items.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).repartition(n)
    while True:
        out = written(todo.mapInArrow(round_of(level, n == 1), schema), f"round{level}")
        finished.append(out.where("done").drop("done"))
        if n == 1:
            break
        rest, before = out.where("not done").drop("done"), bins
        bins = rest.where("offset = 0").count()
        if before is not None and bins > (1 - LEAST_SAVED) * before:
            finished.append(rest)
            break
        n, level = max(-(-n // FAN), -(-bins // CHUNK)), level + 1
        todo = rest.repartition(n, "sequence_id")
    whole = finished[0]
    for f in finished[1:]:
        whole = whole.unionByName(f)
    return whole


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids: where each piece lies."""
    return pack(written(pieces(documents(spark, sf_dir)), "pieces"))
