"""Language identification by a string kernel.

A text's spectrum is the set of its n-grams of 1 to 4 bytes (letters lowered, everything that is no letter
a blank), hashed to fixed places; the kernel of two texts is the cosine of their presence vectors.  A
bounded sample of labelled texts (of each language ``PER_GROUP`` of each of ``GROUPS`` groups, by hashes of
the id: 512 at most) trains a kernel
ridge regression, one language against the rest, on Nyström features of ``LANDMARKS`` landmark texts.
Landmarks and weights fold into one matrix each, so texts are scored by two matrix products a batch.

Longer grams share places (``PLACES``), so the kernel is that of hashed spectra: two texts have a few grams
more in common than their own ones, about the shares of places that each fills.

A text that is null or has no letter is ``und`` with score 0.  Texts are taken whole; rows that repeat are
judged each; null languages are not learned.  Without any labelled text all are ``und``; of equal scores
the first language by name counts.  An empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_text, utf8
from .quality import _held_out

GROUPS, PER_GROUP, LANDMARKS, RIDGE, SHARPNESS = 128, 4, 96, 1e-3, 8.0
#: Places for n-grams of 1, 2, 3 and 4 bytes, as powers of two.
PLACES = (8, 12, 14, 14)
BATCH = 48

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BEGIN = np.cumsum([0, *(1 << b for b in PLACES)])


def spectra(column: pa.Array):
    """Batches of presence rows (float32, of length 1) of whole texts."""
    raw, offs = utf8(column)
    folded = _FOLD[raw].astype(np.uint32)
    codes = []
    code = np.zeros(len(folded), np.uint32)
    for n, bits in enumerate(PLACES):
        code = code.copy()
        code[: len(folded) - n] |= folded[n:] << np.uint32(8 * n)
        codes.append((((code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)).astype(np.int64) + _BEGIN[n])
    for lo in range(0, len(offs) - 1, BATCH):
        hi = min(lo + BATCH, len(offs) - 1)
        x = np.zeros((hi - lo, _BEGIN[-1]), np.float32)
        for i in range(lo, hi):
            for n, c in enumerate(codes):
                x[i - lo, c[offs[i] : max(offs[i], offs[i + 1] - n)]] = 1
        yield x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _has_letter(column: pa.Array) -> np.ndarray:
    raw, offs = utf8(column)
    ascii_letter = np.concatenate([[0], np.cumsum((raw < 128) & (_FOLD[raw] != 32))])
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    for i in np.flatnonzero(~out & (high[offs[1:]] > high[offs[:-1]])):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out


def sample(docs: DataFrame, per_group: int = PER_GROUP, groups: int = GROUPS) -> DataFrame:
    """(lang, k, text) of a bounded number of labelled texts of each language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("text").alias("t"))
    # a language's rows are dealt out over groups, so that no task reads a share of all rows
    grouped = known.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(groups)))
    first = F.row_number().over(Window.partitionBy("lang", "group").orderBy(F.xxhash64("doc_id"), "doc_id", "t"))
    chosen = grouped.withColumn("k", first).where(F.col("k") <= per_group).select("doc_id", "t", "lang", (F.col("k") * groups + F.col("group")).alias("k"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "lang", "text").join(F.broadcast(chosen), ["doc_id", "t", "lang"])
    return texts.dropDuplicates(["lang", "k"]).select("lang", "k", "text")


def fit(rows: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """The model from a bounded sample (lang, k, text)."""

    def pack(part: pa.RecordBatch) -> dict:
        return {"bits": pa.array([np.packbits(r > 0).tobytes() for x in spectra(part.column(part.schema.get_field_index("text"))) for r in x], pa.binary())}

    found = sorted(map_text(rows, "text", "bits binary", pack, keep=["lang", "k"]).collect(), key=lambda r: (r.k, r.lang, r.bits))
    languages = sorted({r.lang for r in found})
    if not found:
        return {"languages": []}

    def presence(some) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in some), np.uint8).reshape(len(some), -1), axis=1)[:, : _BEGIN[-1]].astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = presence(found[: max(landmarks, 2 * len(languages))])  # of all languages in turn
    kernel = np.concatenate([presence(found[i : i + 64]) @ marks.T for i in range(0, len(found), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = np.concatenate([kernel @ whiten, np.ones((len(kernel), 1))], 1)
    targets = np.array([[1.0 if r.lang == c else 0.0 for c in languages] for r in found])
    weights = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ targets)
    return {"languages": languages, "marks": np.ascontiguousarray(marks.T), "weights": (whiten @ weights[:-1]).astype(np.float32), "offset": weights[-1].astype(np.float32)}


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    letter = _has_letter(column)
    if not model["languages"]:
        return ["und"] * len(letter), np.zeros(len(letter))
    raw = [x @ model["marks"] @ model["weights"] + model["offset"] for x in spectra(column)]
    f = np.concatenate(raw).astype(np.float64) if raw else np.zeros((0, len(model["languages"])))
    e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
    best = f.argmax(1)
    score = np.where(letter, (e / e.sum(1, keepdims=True))[np.arange(len(f)), best], 0.0)
    return [model["languages"][k] if ok else "und" for k, ok in zip(best, letter, strict=True)], score


def with_language(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        pred, score = predict(shared.value, part.column(part.schema.get_field_index(text)))
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}

    return map_text(docs, text, "lang_pred string, score double", run, keep)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = with_language(docs.select("doc_id", "text"), fit(sample(docs)), keep=["doc_id"])
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
