"""Words are equal only where their bytes are."""

import numpy as np
import pytest

from tickloom.llm.common import prefix_hash, span_hash, word_hashes
from tickloom.llm.decontaminate import op8_decontaminate
from tickloom.llm.minhash import op10_minhash


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_of_two_letters_differ(n):
    """Sums of powers modulo 2**64 take these words for equal, whatever the base."""
    raw = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a")).encode(), np.uint8)
    at = np.array([0, n])
    assert len(set(span_hash(prefix_hash(raw), at, at + n).tolist())) == 1
    assert len(set(word_hashes(raw, at, at + n).tolist())) == 2


def test_hashes_follow_bytes_only():
    words = ["a", "b", "ab", "ba", "aab", "aba", "Ä", "ab", "a" * 70_000, "a" * 70_001]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    h = word_hashes(raw, ends - [len(w.encode()) for w in words], ends)
    assert h[2] == h[7] and len(set(h.tolist())) == len(words) - 1
    assert len(word_hashes(raw, ends[:0], ends[:0])) == 0


def test_no_hit_and_no_link_between_such_words(spark, tmp_path):
    texts = [f(n) for n in (1024, 2048, 4096) for f in (thue_morse, lambda n: thue_morse(n, "b", "a"))]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.n_hit, r.contaminated) for r in op8_decontaminate(spark, str(tmp_path)).collect()} == {(i, i % 2, i % 2 == 1) for i in range(6)}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op10_minhash(spark, str(tmp_path)).collect()} == {(i, 1, i, True) for i in range(6)}
