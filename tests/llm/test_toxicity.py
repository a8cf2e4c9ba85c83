"""The toxic-span chain against plain sums over all taggings, finite differences and held-out documents."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm.toxicity import SIZE, Chains, emissions, gradient, op12_toxicity, toxic_spans, train, word_features


def plain(e, params):
    """(marginals, log of the sum over all taggings) of one text, by all 2**n taggings."""
    start, to, back, stay = params
    total, toxic = 0.0, [0.0] * len(e)
    for tags in itertools.product((0, 1), repeat=len(e)):
        s = sum(x for x, t in zip(e, tags, strict=True) if t) + (start if tags and tags[0] else 0)
        s += sum({(0, 0): 0, (0, 1): to, (1, 0): back, (1, 1): stay}[p] for p in itertools.pairwise(tags))
        total += math.exp(s)
        toxic = [x + math.exp(s) * t for x, t in zip(toxic, tags, strict=True)]
    return [x / total for x in toxic], math.log(total)


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 7, 3, 0, 10, 2, 5, 0]
    before, e, params = np.cumsum([0, *sizes]), rng.normal(-1, 2, sum(sizes)), np.array([-0.5, 0.3, -0.2, 1.1])
    chains = Chains(e, before, params)
    for k in range(len(sizes)):
        toxic, log_z = plain(e[before[k] : before[k + 1]], params)
        assert np.allclose(chains.toxic[before[k] : before[k + 1]], toxic, atol=1e-9)
        assert chains.log_z[k] == pytest.approx(log_z, abs=1e-9) and chains.score()[k] == pytest.approx(1 - math.exp(-log_z), abs=1e-9)
    long = Chains(np.full(50_000, -30.0), np.array([0, 50_000]), params)
    assert np.isfinite(long.toxic).all() and long.score()[0] < 1e-6


def test_gradient_is_that_of_the_likelihood():
    texts = ["you total idiot go away", "a calm day", "", "idiot idiot", "some words that are clean and many", "trash talk here"]
    labels = np.array([1, 0, 1, 1, 0, 1])
    features, _, _, before = word_features(pa.array(texts))
    rng = np.random.default_rng(2)
    weights, params = rng.normal(0, 0.3, SIZE), np.array([0.1, -0.4, 0.2, 0.5])
    by_weight, by_params, _ = gradient(features, before, labels, weights, params)
    for k in [0, *np.unique(features)[1:12]]:
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (gradient(features, before, labels, up, params)[2] - gradient(features, before, labels, down, params)[2]) / 2e-5
        assert by_weight[k] == pytest.approx(slope, abs=1e-5)
    for k in range(4):
        d = np.eye(4)[k] * 1e-5
        slope = (gradient(features, before, labels, weights, params + d)[2] - gradient(features, before, labels, weights, params - d)[2]) / 2e-5
        assert by_params[k] == pytest.approx(slope, abs=1e-5)


def test_features_are_of_the_word_alone():
    features, _, _, before = word_features(pa.array(["Réeuxpa, IDIOT!", None, "x idiot réeuxan"]))
    assert before.tolist() == [0, 2, 2, 5]
    assert (features[1] == features[3]).all() and set(features[0][1:7]) & set(features[4][1:7]) and features[2][0] and not features[2][1:].any()
    weights = np.zeros(SIZE)
    weights[0] = -3
    assert (emissions(features, weights) == -3).all()


def corpus(n):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([5, 20, 60, 400]))]
        if i % 4 == 0:
            for _ in range(rng.randrange(1, 4)):
                t.insert(rng.randrange(len(t) + 1), rng.choice(["Moron", "trash", "vileword" + rng.choice(words)]))
        rows.append((i, " ".join(t)))
        labels.append((i, 0, int(i % 4 == 0)))
    return rows, labels


def test_held_out_documents(spark, tmp_path):
    rows, labels = corpus(900)
    rows += [(None, None), (None, "trash"), (2000, ""), (2001, " . "), (4, rows[4][1])]
    labels += [(None, 1, 1), (3, None, None), (5, 0, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxicity", "2 AS label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held) > 100
    assert {r.score for r in got if r.doc_id in (2000, 2001)} == {0.0} and [r.predicted for r in got if r.doc_id is None and r.score > 0] == [1]
    text = dict(rows)
    spans = [text[r.doc_id][int(a) : int(b)] for r in got if r.doc_id is not None and r.spans for a, b in (s.split(":") for s in r.spans.split(","))]
    assert spans and sum(bool(re.search("Moron|trash|vileword", s)) for s in spans) >= 0.95 * len(spans)


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1), (3, 1)], 1.0), ([(2, 0)], 0.0)):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.toxicity for r in toxic_spans(docs, model).collect()} == {want}
