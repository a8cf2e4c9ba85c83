"""Quality classification by regularised quadratic discriminant analysis.

Each whole text becomes ``FEATURES``: logarithms and logits of counts over its bytes, words and lines.
Class means and covariances of the labelled rows are summed up in Spark.  A class's covariance is shrunk
towards the pooled one (``POOLED``) and then towards a multiple of the identity (``ROUND``); the score is
the posterior of the good class from the difference of the Gaussian log-densities, with the Mahalanobis
distances from Cholesky factors that are worked out once.

Null and empty texts have the features of a text without bytes and are scored like any other.  Rows that
repeat are scored each; labels that repeat or contradict each other count as often as they stand; null
labels and labels other than 0 and 1 are left out.  Without labels of both classes every score is the
share of good labels (0.5 without any).  Texts of any length are taken whole; a text of equal score with
another is judged the same.  An empty table gives an empty result.  ``good_documents`` keeps all columns,
whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text, mix, prefix_hash, span_hash, utf8, word_spans, written
from .minhash import NOT_SPACE

FEATURES = ["bytes", "upper", "digit", "space", "other_letters", "stops", "shouts", "bars", "signs", "word_length", "word_spread", "long_words", "repeated_words", "words_seen_before", "line_length", "lines_seen_before", "shouted_words", "signed_words"]
POOLED, ROUND, KEEP = 0.3, 0.05, 0.7

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _SHOUT, _BAR, _SIGN = range(9)
_CLASS = np.full(256, _SIGN, np.uint8)
for _chars, _kind in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), ((32, 9, 10, 11, 12, 13), _SPACE), (range(128, 256), _HIGH), (b".,;:'\"?-()", _STOP), (b"!", _SHOUT), (b"|", _BAR)):
    _CLASS[list(_chars)] = _kind
_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[10] = False


def _per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


def _seen_before(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each text how many of its hashes stood in it before."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    _, first = np.unique(h ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.diff(begin) - np.bincount(doc[first], minlength=len(begin) - 1)


def text_features(column: pa.Array) -> np.ndarray:
    raw, offs = utf8(column)
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    count = np.bincount(doc * 9 + _CLASS[raw], minlength=9 * n).reshape(n, 9).astype(float)
    start, end, begin = word_spans(raw, offs, NOT_SPACE)
    prefix = prefix_hash(raw)
    words = np.diff(begin).astype(float)
    length = (end - start).astype(float)
    h = span_hash(prefix, start, end)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[begin[:-1][np.diff(begin) > 0]] = False
    kind = _CLASS[raw]
    capital = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    sign = np.concatenate([[0], np.cumsum((kind == _SIGN) | (kind == _BAR))])
    shouted = (capital[end] - capital[start]) * 2 > length
    signed = sign[end] - sign[start] > 0
    mean = _per_text(length, begin) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(_per_text(length**2, begin) / np.maximum(words, 1) - mean**2, 0))
    l_start, l_end, l_begin = word_spans(raw, offs, _NOT_LINE_END)
    lines = np.diff(l_begin).astype(float)
    share = lambda a, b: np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))
    out = [
        np.log1p(size),
        *(share(count[:, k], size) for k in (_UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _SHOUT, _BAR, _SIGN)),
        np.log1p(mean),
        np.log1p(spread),
        share(_per_text(length > 14, begin), words),
        share(_per_text(again, begin), words),
        share(_seen_before(h, begin), words),
        np.log1p(size / np.maximum(lines, 1)),
        share(_seen_before(span_hash(prefix, l_start, l_end), l_begin), lines),
        share(_per_text(shouted, begin), words),
        share(_per_text(signed, begin), words),
    ]
    return np.stack(out, 1)


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def features(part: pa.RecordBatch) -> dict:
        x = text_features(part.column(part.schema.get_field_index(text)))
        return {"features": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}

    return map_text(docs, text, "features array<double>", features, keep)


def fit(labelled: DataFrame, pooled: float = POOLED, rounding: float = ROUND) -> dict | None:
    """The model from (features, label) rows; only sums of features and of their products come to the driver."""
    d = len(FEATURES)
    products = F.flatten(F.transform("features", lambda x: F.transform("features", lambda y: x * y)))
    sums = labelled.where("label in (0, 1)").select("label", F.posexplode(F.concat(F.array(F.lit(1.0)), "features", products)).alias("i", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        total[int(r.label), r.i] = r.v
    n = total[:, 0]
    if not n.all():
        return {"constant": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = total[:, 1 : 1 + d] / n[:, None]
    cov = total[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    together = np.tensordot(n / n.sum(), cov, 1)
    scale = np.sqrt(np.maximum(np.diag(together), 1e-9))
    cov, together = cov / np.outer(scale, scale), together / np.outer(scale, scale)
    model = {"mean": mean, "scale": scale, "prior": float(np.log(n[1] / n[0])), "inverse": [], "logdet": []}
    for c in (0, 1):
        shrunk = (1 - pooled) * cov[c] + pooled * together
        shrunk = (1 - rounding) * shrunk + rounding * np.trace(shrunk) / d * np.eye(d)
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
        model["inverse"].append(np.linalg.inv(factor))
        model["logdet"].append(2 * float(np.log(np.diag(factor)).sum()))
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    density = [-0.5 * ((((x - model["mean"][c]) / model["scale"]) @ model["inverse"][c].T) ** 2).sum(1) - 0.5 * model["logdet"][c] for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(density[0] - density[1] - model["prior"], -700, 700)))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """A model from labelled rows that are not held out; only features, never texts, are joined with the labels."""
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("label")).where("label in (0, 1)").where(~_held_out(F.col("_id")))
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return fit(with_features(texts, keep=["_id"]).join(known, "_id").select("label", "features"))


def good_documents(docs: DataFrame, model: dict, text: str = "text", at_least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score ``at_least`` so much, in the columns of ``docs``."""
    places = {c: f"_{k}" for k, c in enumerate(docs.columns)}

    def score(part: pa.RecordBatch) -> dict:
        return {"score": scores(model, text_features(part.column(part.schema.get_field_index(places[text]))))}

    scored = map_text(docs.toDF(*places.values()), places[text], "score double", score)
    return scored.where(F.col("score") >= at_least).select(*[F.col(p).alias(c) for c, p in places.items()])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a model of the labelled ones that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = written(with_features(docs, keep=["doc_id"]), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.join(labels.where("label in (0, 1)"), "doc_id").where(~_held_out(F.col("doc_id"))))

    def score(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, x))], names=["doc_id", "score"])

    scored = rows.select("doc_id", "features").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
