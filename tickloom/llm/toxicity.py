"""Toxic spans by a linear-chain conditional random field.

A text is a chain of words, each clean or toxic.  A word's features are hashes of the word, its beginnings and its
ends (``HEADS``, ``TAILS`` bytes); the toxic state's potential is the sum of their weights, those of the transitions
and the start are weights as well.  Forward and backward passes give each word's marginal, and with it the offending
offsets; the document's score is the probability that any word of it is toxic, one less that of the all-clean chain.

Labels are of documents, so labelled words come from them: every word of a clean document is clean, and of a toxic
one's at least one is toxic.  Its words' tags are the marginals of the chain under that condition, worked out anew
in each round (expectation), and weights follow their gradient (maximisation, with steps scaled by past gradients).
They begin at the log-odds of features between toxic and clean documents.  Sums of gradients are made by Spark over
a sample of about ``MOST`` toxic and twice as many clean documents, drawn by hash (a documented bound); where clean ones
are left out, the others count more.  Documents are taken whole.

The chains of a slice of texts are one product of 2x2 matrices, worked out in stretches side by side; a text's first
matrix has equal rows, so nothing passes from one text to the next.

Null and empty texts, and texts without a word, have no toxic word: score 0, no span.  Rows are judged one by one, so
repeated ones get equal answers; labels that repeat or contradict each other count as often as they stand, those that
are neither 0 nor 1 not at all.  Without labels of both classes every score is the share of toxic labels (0.5 without
any).  Texts of any length are taken whole; words of equal marginals are judged the same.  New columns take the place of
such of the same name, all others stay.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, map_text, mix, prefix_hash, span_hash, steps, utf8, word_spans, written
from .decontaminate import WORD

HEADS, TAILS = (3, 4, 5, 6, 7, 8), (3, 5)
KINDS = 1 + len(HEADS) + len(TAILS)
SIZE = 1 << 18
MOST, SHARDS = 3000, 8
ROUNDS, STEP, PRIOR = 14, 0.4, 0.05
KEEP = 0.5
SPANS = "array<struct<start:int,end:int,score:double>>"


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words (words, KINDS), 0 where a word is no longer than its beginning or end; words' starts, ends, and how many stand before each text."""
    raw, offs = utf8(column)
    raw = LOWER[raw]
    start, end, before = word_spans(raw, offs, WORD)
    h = prefix_hash(raw)
    out = np.zeros((len(start), KINDS), np.int32)
    spans = [(0, None), *((k, True) for k in HEADS), *((k, False) for k in TAILS)]
    for n, (k, head) in enumerate(spans):
        some = np.flatnonzero(end - start > k) if k else slice(None)
        a, b = start[some], end[some]
        if head is not None:
            a, b = (a, a + k) if head else (b - k, b)
        out[some, n] = 1 + (mix(span_hash(h, a, b) + np.uint64(n)) % np.uint64(SIZE - 1)).astype(np.int32)
    return out, start, end, before


# --- chains ---------------------------------------------------------------------------------------------------


def _products(m: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Row vectors begin @ m[0] @ ... @ m[t] for each t, scaled to a sum of 1; m is (n, 2, 2) of positive numbers."""
    n = len(m)
    size = max(1, int(n**0.5))
    wide = -(-n // size)
    padded = np.concatenate([m, np.broadcast_to(np.eye(2), (wide * size - n, 2, 2))]).reshape(wide, size, 4).transpose(1, 2, 0)
    done = np.empty_like(padded)
    done[0] = padded[0] / padded[0].sum(0)
    for t in range(1, size):
        p, q = done[t - 1], padded[t]
        done[t, 0], done[t, 1] = p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3]
        done[t, 2], done[t, 3] = p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]
        done[t] /= done[t].sum(0)
    enter, v = np.empty((wide, 2)), np.array(begin, float)
    for c, (a, b, d, e) in enumerate(done[-1].T.tolist()):
        enter[c] = v
        v = np.array([v[0] * a + v[1] * d, v[0] * b + v[1] * e])
        v /= v.sum()
    out = np.stack([enter[:, 0] * done[:, 0] + enter[:, 1] * done[:, 2], enter[:, 0] * done[:, 1] + enter[:, 1] * done[:, 3]], 2)
    out = out.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


class Chains:
    """Marginals of all texts' chains; ``params`` has the start's potential and those of clean-toxic, toxic-clean and toxic-toxic."""

    def __init__(self, emission: np.ndarray, before: np.ndarray, params: np.ndarray):
        n, self.before = len(emission), before
        e = np.exp(np.clip(emission, -40, 40))
        start, to, back, stay = np.exp(np.clip(params, -40, 40))
        m = np.empty((n, 2, 2))
        m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1] = 1, to * e, back, stay * e
        self.first = before[:-1][np.diff(before) > 0]
        m[self.first, :, 0], m[self.first, :, 1] = 1, (start * e[self.first])[:, None]
        self.m = m
        if not n:
            self.toxic, self.log_z = np.zeros(0), np.zeros(len(before) - 1)
            return
        self.forward = _products(m, (0.5, 0.5))
        after = np.concatenate([m[1:], np.ones((1, 2, 2))])[::-1].transpose(0, 2, 1)
        self.backward = _products(after, (0.5, 0.5))[::-1]
        both = self.forward * self.backward
        self.toxic = both[:, 1] / both.sum(1)
        self.came = np.concatenate([[[0.5, 0.5]], self.forward[:-1]])
        grown = np.log((self.came[:, :, None] * m).sum((1, 2)))
        total = np.concatenate([[0], np.cumsum(grown)])
        self.log_z = np.maximum(total[before[1:]] - total[before[:-1]], 0)

    def score(self) -> np.ndarray:
        """Of each text the probability that some word is toxic."""
        return -np.expm1(-self.log_z)

    def transitions(self, weight: np.ndarray) -> np.ndarray:
        """Weighted sums of the expected starts, clean-toxic, toxic-clean and toxic-toxic steps; a weight for each word."""
        x = self.came[:, :, None] * self.m * self.backward[:, None, :]
        x = x / x.sum((1, 2), keepdims=True) * weight[:, None, None]
        inner = np.ones(len(weight), bool)
        inner[self.first] = False
        return np.array([(weight * self.toxic)[self.first].sum(), x[inner, 0, 1].sum(), x[inner, 1, 0].sum(), x[inner, 1, 1].sum()])


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Potentials of the toxic state; weight 0 is the bias, once a word."""
    inner = weights.copy()
    inner[0] = 0
    return inner[features].sum(1) + weights[0]


def gradient(features: np.ndarray, before: np.ndarray, labels: np.ndarray, weights: np.ndarray, params: np.ndarray, clean: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of documents' labels: by feature weights, by params, and the log-likelihood itself; a clean document counts ``clean`` times."""
    chains = Chains(emissions(features, weights), before, params)
    z = np.maximum(chains.log_z, 1e-12)
    by_text = np.where(labels == 1, 1 / np.expm1(np.minimum(z, 700)), -clean)
    weight = np.repeat(by_text, np.diff(before))
    pull = weight * chains.toxic
    by_weight = np.bincount(features.ravel(), np.repeat(pull, features.shape[1]), minlength=len(weights)) if len(pull) else np.zeros(len(weights))
    by_weight[0] = pull.sum()
    has = np.diff(before) > 0
    value = np.where(labels == 1, np.log(-np.expm1(-z)), -clean * z)[has].sum()
    return by_weight, chains.transitions(weight) if len(pull) else np.zeros(4), float(value)


# --- training -------------------------------------------------------------------------------------------------


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _share(n: int, label: int, most: int) -> float:
    """Of n labelled documents of a class the share that the sample takes."""
    return min(1.0, most * (2 - label) / max(1, n))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST) -> tuple[DataFrame, list[float]]:
    """(text, label) of labelled documents that are not held out, about ``most`` toxic and twice as many clean ones, and how many labels each class has."""
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)").where(~_held_out(F.col("_id")))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.element_at(F.lit([_share(count.get(c, 0), c, most) for c in (0, 1)]), F.col("label") + 1)
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # about 3 * ``most`` short rows at most, so they can go to every task
    return texts.join(F.broadcast(known), "_id").select("text", "label"), [count.get(0, 0), count.get(1, 0)]


def _summed(rows: DataFrame, fn, kinds: int) -> np.ndarray:
    """Sums over all slices of ``rows`` (text, label) of the vectors that ``fn`` returns for one, an array (kinds, SIZE + 5)."""

    def run(batches):
        total = np.zeros((kinds, SIZE + 5))
        for batch in batches:
            for part in steps(batch, "text"):
                features, _, _, before = word_features(part.column(0))
                total += fn(features, before, part.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    parts = rows.mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(r.total).reshape(kinds, -1) for r in parts), np.zeros((kinds, SIZE + 5)))


def _presence(features: np.ndarray, before: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """In how many clean and toxic documents each feature is; the documents themselves stand last."""
    text = np.repeat(np.arange(len(labels)), np.diff(before))
    pairs = np.unique(text[:, None] * np.int64(SIZE) + features)
    out = np.zeros((2, SIZE + 5))
    for c in (0, 1):
        out[c, :SIZE] = np.bincount((pairs % SIZE)[labels[pairs // SIZE] == c], minlength=SIZE)
        out[c, SIZE] = (labels == c).sum()
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST, rounds: int = ROUNDS) -> dict:
    """Weights and params from labelled documents; only their sums come to the driver, one vector for each of ``SHARDS`` tasks."""
    rows, count = sample(docs, labels, doc_id, text, label, most)
    if not all(count):
        return {"constant": count[1] / sum(count) if any(count) else 0.5}
    # clean documents count as often as their share of the labels asks for
    often = _share(count[1], 1, most) / _share(count[0], 0, most)
    rows = written(rows.repartition(SHARDS), "sample")
    clean, toxic = _summed(rows, _presence, 2)
    odds = np.log((toxic[:SIZE] + 0.5) / (toxic[SIZE] + 1)) - np.log((clean[:SIZE] + 0.5) / (clean[SIZE] + 1))
    weights = np.clip(odds - 1, 0, None) * toxic[:SIZE] / (toxic[:SIZE] + 8)
    weights[0] = -6.0
    params = np.array([0.0, 0.0, 0.0, 0.0])
    past = np.full(SIZE + 4, 1e-8)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((weights.astype(np.float32), params))

        def step(features, before, labels, sent=sent):
            w, p = sent.value
            by_weight, by_params, value = gradient(features, before, labels, w.astype(float), p, often)
            return np.concatenate([by_weight, by_params, [value]])[None]

        total = _summed(rows, step, 1)[0]
        move = total[:-1] - PRIOR * np.concatenate([[0], weights[1:], params])
        past += move**2
        move = STEP * move / np.sqrt(past)
        weights, params = weights + move[:SIZE], params + move[SIZE:]
        sent.unpersist()
    return {"weights": weights.astype(np.float32), "params": params, "value": total[-1]}


# --- scoring --------------------------------------------------------------------------------------------------


def toxic_spans(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, at_least: float = KEEP) -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_spans``: stretches of words whose marginals are ``at_least`` so much, in code points, with the greatest marginal."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(part: pa.RecordBatch) -> dict:
        column, model = part.column(part.schema.get_field_index(text)), sent.value
        if "constant" in model:
            return {"toxicity": pa.array(np.full(len(part), model["constant"])), "toxic_spans": pa.array([[]] * len(part), pa.list_(pa.struct(_SPAN)))}
        features, start, end, before = word_features(column)
        chains = Chains(emissions(features, model["weights"].astype(float)), before, model["params"])
        hit = np.concatenate([[False], chains.toxic >= at_least, [False]])
        # a stretch goes on to the next word of the same text
        opens = hit[1:-1] & ~hit[:-2]
        opens[chains.first] = hit[1:-1][chains.first]
        at = np.flatnonzero(opens)
        member = np.cumsum(opens)[hit[1:-1]] - 1
        words = np.flatnonzero(hit[1:-1])
        last, top = np.zeros(len(at), np.int64), np.zeros(len(at))
        np.maximum.at(last, member, words)
        np.maximum.at(top, member, chains.toxic[words])
        raw, offs = utf8(column)
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        own = np.searchsorted(before, at, "right") - 1
        fields = [pa.array((point[x] - point[offs[own]]).astype(np.int32)) for x in (start[at], end[last])] + [pa.array(top)]
        bounds = pa.array(np.searchsorted(at, before), pa.int32())
        return {"toxicity": pa.array(chains.score().round(9)), "toxic_spans": pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, fields=_SPAN))}

    return map_text(docs, text, f"toxicity double, toxic_spans {SPANS}", score, keep)


_SPAN = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("score", pa.float64())]


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a chain trained on the labelled ones that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = toxic_spans(docs, model, keep=["doc_id"])
    line = F.transform("toxic_spans", lambda s: F.concat(s.start, F.lit(":"), s.end))
    return found.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= KEEP).cast("int").alias("predicted"),
        F.size("toxic_spans").cast("long").alias("n_spans"),
        F.array_join(line, ",").alias("spans"),
    )
