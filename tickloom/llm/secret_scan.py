"""Secret scans: fixed patterns, and credential values by the guesses that they would take.

Three patterns find assignments, access keys and long hex strings.  Beyond them, values in a credential's
place (``CONTEXT``, a scheme such as Bearer may stand between) are judged by how hard they are to guess:
dynamic programming finds the cheapest segmentation into dictionary words, dates, repeats, keyboard walks
and brute-force spans, and values over ``LEAST_BITS`` bits count as secrets (kind ``guess``).
``changeme2019`` or ``qwerty`` are no secrets.  Values are of any length from 6 characters on and judged
whole.  The words are ``WORDS``, which guessers try first, and behind them the words and word parts of the
tokenizer's vocabulary, commonest first.  Values of letters with any of another script than Latin, for which
there are no words, are no secrets.  A guess span stands beside base spans unless they cover it.

Null and empty texts have no spans.  Whole texts of any length are scanned; positions are code points, ends
exclusive.  Spans that begin at one place go in the order of ``KINDS``.  Rows that repeat are scanned each;
an empty table gives an empty result; other columns stay as they are, one named like the result is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text
from .tokenize import default_tokenizer

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Up to where a value of at least 6 characters begins.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer|login)["']?\s{0,3}(?:[:=]|=>|->|\bis\b|(?<=bearer)\s)\s{0,3}["']?(?:(?:bearer|basic|digest|negotiate|token|oauth|apikey|key)\s{1,3}["']?)?(?=[^\s"'<>,;]{6})""",
    re.IGNORECASE,
)
VALUE_END = re.compile(r"""[\s"'<>,;]""")
CUES = ("pass", "pwd", "secret", "token", "api", "auth", "credential", "private", "bearer", "login")
#: Words that guessers try first, commonest first.
WORDS = """password pass admin welcome letmein login master secret changeme default root user test guest hello dragon monkey shadow
sunshine princess football baseball superman batman trustno love summer winter spring autumn monday friday january march april june july
august october november december server backup system access public private example sample demo token key company office internet""".split()
#: Rows of keys, as they stand above each other.
KEYBOARDS = (
    ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"),
    ("1234567890", "qwertzuiopü+", "asdfghjklöä", "yxcvbnm,.-"),
    ("1234567890", "azertyuiop", "qsdfghjklmù", "wxcvbn,;:!"),
    ("1234567890[]", "',.pyfgcrl/=", "aoeuidhtns-", ";qjkxbmwvz"),
    ("789", "456", "123", "0"),
)
LEET = str.maketrans("4@310$5!7", "aaeiossit")
LEAST_BITS = 34.0
_RANK = {w: k + 1 for k, w in enumerate(WORDS)}
_AT = [{c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)} for rows in KEYBOARDS]
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_BEGIN = 1.0  # bits for where a segment ends and which kind it is


@functools.cache
def language_words() -> dict[str, int]:
    """Ranks of the words and word parts of three letters and more in the tokenizer's vocabulary, commonest first, after ``WORDS``."""
    with open(default_tokenizer(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    raw = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    raw |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in raw)}
    out = dict(_RANK)
    for token in sorted(vocab, key=vocab.get):
        word = bytes(raw.get(c, 0) for c in token).decode("utf-8", "replace").removeprefix(" ").lower()
        if len(word) >= 3 and word.isalpha():
            out.setdefault(word, len(out) + 1)
    return out


def _latin(value: str) -> bool:
    return all(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in value)


def _char_bits(value: str) -> float:
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log2(max(size, 10))


def word_bits(rank: int, capitals: int, n: int, replaced: int) -> float:
    """A word by its rank, which of its letters are capital, and how many stand as look-alikes."""
    return math.log2(rank) + min(capitals, 1) + math.log2(1 + math.comb(n, min(capitals, n - capitals))) + replaced


def date_bits(n: int) -> float:
    """A year of 120, and a day of it where there is one."""
    return math.log2(120) + (math.log2(366) if n > 5 else 0)


def walk_bits(n: int, turns: int) -> float:
    """A walk by its first key, its keyboard, its length and its turns."""
    return math.log2(47 * len(KEYBOARDS)) + math.log2(n) + 3 * (1 + turns)


def run_bits(n: int) -> float:
    return math.log2(36) + 1 + math.log2(n)


def guess_bits(value: str, words: dict[str, int] = _RANK, most: float = math.inf) -> float:
    """Base-2 logarithm of the guesses of the cheapest segmentation, or ``most`` where it is not below that."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    each = _char_bits(value)
    longest = max(map(len, words))
    best = [0.0] + [math.inf] * n
    brute, far = math.inf, 0  # the cheapest way that ends in a brute-force span here; how far ways under ``most`` go
    run_ends = [0] * 9
    for i in range(n):
        best[i] = min(best[i], brute)
        if best[i] >= most:
            if far <= i:
                return most
            brute = math.inf
            continue
        base = best[i] + _BEGIN
        brute = min(brute, base) + each
        if brute < most:
            far = max(far, i + 1)

        def reach(j: int, bits: float, base=base):
            nonlocal far
            if base + bits < min(best[j], most):
                best[j] = base + bits
                far = max(far, j)

        for j in range(i + 3, min(n, i + longest) + 1):  # words, with capitals and look-alikes
            if (rank := words.get(plain[i:j])) is not None:
                capitals = sum(c.isupper() for c in value[i:j])
                reach(j, word_bits(rank, capitals, j - i, sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))))
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            for j in {m.end(), *([i + 4] if value[i : i + 2] in ("19", "20") else [])}:
                reach(j, date_bits(j - i))
        for size in range(1, 9):  # repeats of a unit; of long ones the first ends and the last
            unit = min(each, math.log2(95)) * size
            if base + unit >= most:
                break
            if i > run_ends[size] - size:
                j = i + size
                while j < n and value[j] == value[j - size]:
                    j += 1
                run_ends[size] = j
            times = (run_ends[size] - i) // size
            for k in (*range(2, min(times, 64) + 1), *range(max(65, times - 7), times + 1)):
                reach(i + k * size, unit + math.log2(k))
        for at in _AT:  # walks over neighbouring keys of one keyboard
            j, step, turns = i + 1, None, 0
            while j < n and base + 3 * turns < most and low[j - 1] in at and low[j] in at:
                (r, k), (r2, k2) = at[low[j - 1]], at[low[j]]
                if abs(r - r2) > 1 or abs(k - k2) > 1 or low[j] == low[j - 1]:
                    break
                turns += step not in (None, (r2 - r, k2 - k))
                step = r2 - r, k2 - k
                j += 1
                if j - i >= 3:
                    reach(j, walk_bits(j - i, turns))
        for step in (1, -1):  # runs of neighbouring characters
            j = i + 1
            while j < n and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
                if j - i >= 3:
                    reach(j, run_bits(j - i))
    return min(best[n], brute, most) if n else 0.0


def is_secret(value: str, least_bits: float = LEAST_BITS) -> bool:
    """Whether a value in a credential's place takes ``least_bits`` or more."""
    return bool(value) and (not value.isalpha() or _latin(value)) and guess_bits(value, language_words(), least_bits) >= least_bits


def find_secrets(text: str | None, least_bits: float = LEAST_BITS) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in that order."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(c in low for c in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(c in low for c in CUES):
        base = sorted((a, b) for a, _, b in found)
        at = judged = 0
        while m := CONTEXT.search(text, at):
            a = at = m.end()
            if a < judged:  # inside a value that is no secret
                continue
            judged = end.start() if (end := VALUE_END.search(text, a)) else len(text)
            value = text[a:judged].rstrip(".:!?)")
            if is_secret(value, least_bits):
                at, bare = judged, a
                for x, y in base:
                    if x <= bare < y:
                        bare = y
                if bare < a + len(value):
                    found.append((a, 3, a + len(value)))
    return sorted(found)


def with_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with secrets: array of (kind, start, end), code points."""

    def scan(part: pa.RecordBatch) -> dict:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t)] for t in part.column(part.schema.get_field_index(text)).to_pylist()]
        return {"secrets": pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))}

    return map_text(docs, text, "secrets array<struct<kind: string, start: int, end: int>>", scan, keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of the texts replaced by ``mark``; other columns as they are."""

    def cut(part: pa.RecordBatch) -> dict:
        out = []
        for t in part.column(part.schema.get_field_index(text)).to_pylist():
            at, pieces = 0, []
            for a, _, b in find_secrets(t):
                if a >= at:
                    pieces += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*pieces, t[at:]]) if pieces else t)
        return {text: pa.array(out, pa.string())}

    return map_text(docs, text, f"`{text}` string", cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secret spans of every document."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))

    def scan(part: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")}
        for t in part.column(part.schema.get_field_index("text")).to_pylist():
            found = find_secrets(t)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[1] == k for x in found))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 3).encode()).hexdigest())
            out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
        return {c: pa.array(v, pa.int64() if c[:2] == "n_" else pa.string()) for c, v in out.items()}

    return map_text(docs, "text", "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string", scan, keep=["doc_id"])
