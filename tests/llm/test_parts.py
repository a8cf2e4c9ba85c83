"""Parts of the operators by themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language, link_graph, merkle, minhash, packing, quality, secret_scan, token_store
from tickloom.llm.components import components
from tickloom.llm.tokenize import default_tokenizer, encoder

from .conftest import prose, tuples


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="'slretvmd \n\tAé1½.!_ü", max_size=60)), max_size=6))
def test_ids_are_the_library_s(texts):
    texts = [t.encode("utf-8", "ignore").decode() if t is not None else None for t in texts]
    enc = encoder(default_tokenizer())
    ids, begin = enc.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 900, 30)
    ids = rng.integers(0, (3, 50, 4000)[seed % 3], lengths.sum()).astype(np.uint32)
    names = [None if k == 3 else k * 7 for k in range(30)]
    blob = token_store.encode_shard(names, lengths, ids, 5000 if seed < 3 else 70_000)
    shard = token_store.Shard(blob)
    assert (shard.ids() == ids).all() and shard.doc_ids == names and (shard.lengths == lengths).all()
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for k in range(30):
        assert (shard.document(k) == ids[begin[k] : begin[k + 1]]).all()
    for a in rng.integers(0, len(ids), 20):
        assert (shard.range(int(a), 37) == ids[a : a + 37]).all()
    if seed % 3 == 0:
        assert len(shard.symbols) < len(ids) / 2
    with pytest.raises(ValueError):
        token_store.Shard(blob[:-1] + bytes([blob[-1] ^ 1]))


def test_store_keeps_order_and_starts(spark, docs, tmp_path):
    token_store.write_store(docs, str(tmp_path / "s"), shard_ids=500)
    got = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert spark.read.parquet(str(tmp_path / "s")).count() > 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_bins(sizes):
    bins, place, fill = packing.best_fit(np.array(sizes, np.int64), 100)
    for b in range(len(fill)):
        at = 0
        for k in sorted(np.flatnonzero(bins == b), key=lambda k: place[k]):
            assert place[k] == at
            at += sizes[k]
        assert at == fill[b] <= 100
    assert sum(f <= 50 for f in fill) <= 1


def test_secret_costs():
    weak, strong = ("password1", "qwerty123", "aaaaaaaaaa", "2019-05-04", "p@ssw0rd", "changeme1", "zxcvbnm,"), ("x9$Kq2!vBz", "8f14e45fceea167a", "Gh7#pL0qWz")
    assert all(secret_scan.guess_bits(v) < secret_scan.LEAST_BITS for v in weak)
    assert all(secret_scan.guess_bits(v) > secret_scan.LEAST_BITS for v in strong)
    assert secret_scan.find_secrets("the secret is out, and the token of time: nothing") == []


@pytest.mark.parametrize("size", (6, 256, 400, 100_000))
def test_secrets_of_any_length(size):
    rng = random.Random(size)
    value = "".join(rng.choice("abcdefXYZ0123456789#%") for _ in range(size - 1)) + "Q"
    text = f"pwd: {value} end"
    assert (5, 3, 5 + size) in secret_scan.find_secrets(text, 20)


@pytest.mark.parametrize("text", ("Authorization: Bearer {}", "auth: Basic {}", "pwd = {}", "password is {}", "login: none, pwd: {}.", "token: Bearer: {}", "x pwd:{}", "pwd=login: {}"))
@pytest.mark.parametrize("value", ("x9$Kq2!vBz", "qXkJvBzMwPfHtRgY", "KdjfhGHskdlfPQ"))
def test_secrets_behind_schemes_and_of_letters(text, value):
    at = text.index("{")
    assert (at, 3, at + len(value)) in secret_scan.find_secrets(text.format(value))


def test_words_are_no_secrets():
    words = "required everything administrator unfortunately Authentication UNAUTHORIZED incorrect straightforward temporarily management bearer abcdefghijklm qwertyuiop 漢字かなの文章がここに続いているので"
    assert secret_scan.find_secrets(" ".join(f"the password is {w}." for w in words.split())) == []
    assert secret_scan.find_secrets("pwd: " + "n" * 200_000) == []


def test_guesses_beyond_base_spans():
    text = "password=abcdefgh!x9$Kq2!vBz"
    assert secret_scan.find_secrets(text) == [(0, 0, 17), (9, 3, len(text))]
    assert [k for _, k, _ in secret_scan.find_secrets("password=x9Kq2vBzLm7TtR")] == [0]


def test_redact_keeps_the_rest(spark, docs):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.where("doc_id = 50").first().text
    assert "hunter2" not in text and "AKIA" not in text and text.startswith("x [secret]")
    assert tuples(out.where("doc_id < 5"), *docs.columns) == tuples(docs.where("doc_id < 5"), *docs.columns)


def test_fingerprints_locate_edits():
    rng = random.Random(1)
    text = prose(rng, 800)
    at = text.index(" ", len(text) // 2) + 1
    edited = text[:at] + "EDITED " + text[at:]
    (a, _), (b, _) = merkle.trees(pa.array([text, edited]))
    assert merkle.likeness(a, b) > 0.9 and merkle.likeness(a, a) == 1.0 and merkle.differing(a, a) == []
    where = len(text[:at].encode())
    assert any(lo <= where <= hi for lo, hi in merkle.differing(b, a))
    assert sum(hi - lo for lo, hi in merkle.differing(b, a)) < len(text) / 5


def test_components(spark):
    pairs = [(k + 1, k) for k in range(1, 60)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in [100, *range(200, 250)]} | {299: 299, 300: 299}


def test_near_groups_without_a_hub(spark):
    """Texts linked to a base only, whose smallest id is not the base; and unlike texts that share a passage."""
    rng = random.Random(2)
    words = prose(rng, 300).replace("\n", "").split()
    rows = []
    for k in range(40):
        w = list(words)
        for j in rng.sample(range(300), 4):
            w[j] = f"z{k}"
        rows.append((k, " ".join(w)))
    rows.append((40, " ".join(words)))
    rows += [(100 + k, " ".join(words[:150]) + " " + prose(rng, 150)) for k in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    group = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert got == group


def test_one_id_with_two_texts(spark):
    """Each text joins its own group; of equal rows one stays."""
    rng = random.Random(3)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = [(1, a), (2, b), (7, a), (7, b), (7, b), (9, prose(rng, 90)), (9, a + " more"), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(df, 85).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (7, 1, False), (7, 2, False), (7, 2, False), (9, 1, False), (9, 9, True)]
    twice = spark.createDataFrame([*rows, (1, a)], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.one_of_each_group(twice, 85).collect()) == [1, 2, 3, 9]


def test_texts_without_ids(spark):
    """Of each group one text stays, though no row of it has an id; with an id, that row stays."""
    rng = random.Random(4)
    alone, copied, near, known = (prose(rng, 90).strip() for _ in range(4))
    edited = near + " more"
    rows = [(None, alone), (None, copied), (None, copied), (None, copied.upper()), (None, near), (None, edited), (None, known), (None, known + " more"), (8, known), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in minhash.one_of_each_group(df, 85).collect()]
    assert len(left) == 5 and {(None, alone), (8, known), (None, "")} <= set(left)
    assert sum(t in (copied, copied.upper()) for _, t in left) == sum(t in (near, edited) for _, t in left) == 1
    groups = minhash.near_groups(df, 85).where("n_shingles > 0").collect()
    assert {(r.component_id, r.kept) for r in groups if r.doc_id is None} == {(None, True), (None, False), (8, False)}


def test_blocks_of_test_texts(spark, docs):
    bench = spark.createDataFrame([(k, f"item {k} one two of it") for k in range(30)] + [(90, "one two")], "item_id long, text string")
    whole = decontaminate.contamination(docs, bench).select("doc_id", "hit_items", "n_words", "longest_words")
    parts = decontaminate.contamination(docs, bench, block_bytes=200).select("doc_id", "hit_items", "n_words", "longest_words")
    assert tuples(whole, *whole.columns) == tuples(parts, *parts.columns)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {33, 34}.isdisjoint({r.doc_id for r in clean.collect()})


def test_trust_spreads(spark):
    seeds = [("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("liked", 0.0, 0.0), ("liker", 0.0, 0.0)]
    links = [("good", "liked", 3), ("liker", "bad", 1), ("liker", "liked", 1)]
    got = {r.host: r for r in link_graph.host_scores(spark.createDataFrame(seeds, "host string, allowed double, blocked double"), spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    assert got["liked"].trust > 0 and got["liked"].distrust == 0 and got["liker"].distrust > 0 and got["liker"].trust == 0


def test_held_out_accuracy(spark):
    """On the given tables: quality and language of rows that no model saw."""
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    q = quality.op2_quality(spark, at).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    lang = language.op9_language(spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert q > 0.95 and lang > 0.98
