"""Leaves of texts in which no word's hash ends one."""

import random

import pyarrow as pa
import pytest

from tickloom.llm.merkle import likeness, trees

from .conftest import prose


def edited(text, other):
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


@pytest.mark.parametrize("unit", ["a ", "word ", "zu ", "x", "ab", "Ä ", "lorem ipsum ", "0 1 2 3 4 5 6 7 ", "line of one text\n", "é"])
@pytest.mark.parametrize("size", [200, 700, 4000, 60_000])
def test_unchanged_part_counts(unit, size):
    text = (unit * size)[:size]
    other = prose(random.Random(size), 50 + size // 4)
    a, b, c = (t for t, _ in trees(pa.array([text, edited(text, other), other])))
    assert likeness(a, b) >= 0.4 and likeness(a, b) > likeness(a, c)
    assert likeness(a, a) == 1 and trees(pa.array(["x", text, None]))[1][0] == a


def test_prose_beside_changes():
    rng = random.Random(3)
    for n in (40, 150, 900):
        text = prose(rng, n)
        words = text.split(" ")
        words[n // 2] = "changed"
        (a, _), (b, _) = trees(pa.array([text, " ".join(words)]))
        assert likeness(a, b) > 0.7
