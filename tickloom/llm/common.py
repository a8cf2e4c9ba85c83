"""What the text operators share: a shared work folder, Arrow text buffers and vectorised hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds at a time; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share and whose owner clears it.

    Where that setting is unset and all of Spark is one process (tests), a temporary folder stands in for
    it, which goes with the process; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column and the offsets of each; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def steps(batch: pa.RecordBatch, text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about ``size`` bytes of text or one row."""
    _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_text(df: DataFrame, text: str, schema: str, fn: Callable[[pa.RecordBatch], dict], keep: list[str] | None = None) -> DataFrame:
    """Add to each row the columns that ``fn`` returns for a bounded slice of rows, in one pass and without a shuffle.

    ``keep`` (all by default) are the columns that stay; a new column takes the place of one of its name.
    """
    new = T.StructType.fromDDL(schema)
    names = {f.name for f in new}
    kept = [f for f in df.schema if (keep is None or f.name in keep) and f.name not in names]
    out = T.StructType(kept + list(new))
    kept_names, new_names = [f.name for f in kept], [f.name for f in new]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for part in steps(batch, text):
                cols = fn(part)
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names]
                arrays += [cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n]) for n in new_names]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)], names=target.names)

    needed = list(dict.fromkeys([*kept_names, text, *(c for c in getattr(fn, "reads", ()))]))
    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, out)


# --- vectorised hashing -------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """h with ``span_hash`` of [s, e) from h: sums of (value + 1) * base**i modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    up, _ = powers(len(values), base)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of spans, the same for equal spans wherever they stand."""
    _, down = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words stand before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[raw]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty spans that stand for their bytes.

    Each byte at each place of its word has a number of its own (tabulation), and the words' sums are mixed.  Two
    words have one hash with a chance of 2**-64 whatever they are made of; sums of powers (``span_hash``) are equal
    for whole families of long words, and only file things.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(size.sum())
    byte = raw[place + np.repeat(starts - begin, size)]
    place -= np.repeat(begin, size)
    place += 1
    place <<= 8
    place |= byte
    return mix(np.add.reduceat(mix(place.view(np.uint64)), begin))


class HashTable:
    """Positions of 64-bit keys in a fixed key list, by open addressing in numpy; -1: not there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        bits = max(12, int(len(self.keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.flags[(h >> self.shift).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out
