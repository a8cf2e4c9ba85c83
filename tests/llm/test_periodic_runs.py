"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tickloom.llm.periodic_runs import find_runs, op13_periodic_runs, periodic_runs


def plain_runs(words):
    """Every (start, period, length) of smallest period, exponent of at least 4 and 6 words or more."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e - s) for (s, e), q in found.items())


def runs_of(texts):
    """The library's runs of lists of numbers."""
    before = np.cumsum([0, *(len(t) for t in texts)])
    rows = find_runs(np.array([x for t in texts for x in t], np.int64), before)
    own = np.searchsorted(before, rows[:, 0], "right") - 1
    out = [[] for _ in texts]
    for t, (s, e, q) in zip(own.tolist(), rows.tolist(), strict=True):
        if e - s >= max(6, 4 * q):
            out[t].append((s - int(before[t]), q, e - s))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        t = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 40, 64])
            word = [rng.randrange(rng.choice([2, 40])) for _ in range(q)]
            t += (word * 7)[: rng.randrange(3 * q, 6 * q)] + [rng.randrange(3) for _ in range(rng.randrange(30))]
        if rng.random() < 0.2:  # a period of periods: highly periodic regions inside a longer period
            word = [1] * rng.randrange(8, 40) + [2] * rng.randrange(1, 9)
            t += (word * 6)[: rng.randrange(4 * len(word), 6 * len(word))]
        texts.append(t)
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_words_of_hard_texts():
    """Fibonacci and Thue-Morse words, one letter, runs at both ends, and a text much longer than the rest."""
    fibonacci = [0]
    other = [1]
    while len(fibonacci) < 400:
        fibonacci, other = fibonacci + other, fibonacci
    thue = [bin(i).count("1") % 2 for i in range(512)]
    texts = [fibonacci, thue, thue[:100] * 5, [7] * 300, [1, 2, 3] * 30 + [9], [9] + list(range(37)) * 9, [], [5], list(range(1200)) * 4 + [1]]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "Ä ä Ä ä\x0bÄ ä Ä\x0cä z"), (5, "Ä ä Ä ä\x0bÄ ä Ä\x0cä z")]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 150)))) for i in range(10, 150)]
    rows += [(200, " ".join(str(i % 700) for i in range(6000))), (201, " ".join(["w"] * 4000))]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS n_words", "2 AS _w").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        words = changed(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
        found = plain_runs(words)
        gone = {k for s, q, n in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((i, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, q, n in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r[1] for r in want) and {i for i, *_ in rows if i and zlib.crc32(str(i).encode()) % 10 == 0}


def test_operator_keeps_columns_and_texts(spark):
    df = spark.createDataFrame([("k", "go go go go go go stop", 3)], "key string, body string, collapsed int")
    row = periodic_runs(df, "body").first()
    assert (row.key, row.body, row.n_words, row.collapsed) == ("k", "go go go go go go stop", 7, "go stop")
    assert [tuple(r) for r in row.runs] == [(0, 1, 6)]
