"""Document fingerprints: Merkle trees over the paragraphs and sections of a text.

Leaves are stretches of a paragraph that end after a word whose hash says so (about every 16th word, at a
text's beginning more of them; inside of very long words after bytes whose hash says so), so a change
moves no other leaf.  Where no hash says so for long (one word over and over, lines without a cut), a leaf ends after
32 to 512 bytes, by its place; a change moves such ends up to the next one by a hash.  A paragraph ends at a line end, a section after a paragraph whose digest says so.
Digests are 64 bits of blake2b: of a leaf's bytes, of a paragraph's leaves, of a section's paragraphs; the
root has 128, of all sections and the text's size.

A fingerprint is ``root/section/section...`` with a section as ``digest:paragraph;paragraph``, a paragraph as
``digest=leaf,leaf`` and a leaf as its digest (16 hex digits) and its bytes in hex.  Equal texts have equal
fingerprints, equal roots mean equal texts.  Two trees are compared from the root down: branches of one
digest are equal, only branches that have no equal in the other tree are entered.  ``differing`` gives the
spans that are left, ``likeness`` the share of bytes in equal branches (0 to 1; two empty texts: 1).

Null texts count as empty; texts of any length are taken whole.  Rows that repeat a doc_id follow each other
in the order of their texts; null doc_ids come last (with rows of the least long, if there are any).  An
empty table gives an empty result.  Other columns stay as they are, one named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_text, partitions, prefix_hash, span_hash, steps, utf8, word_spans
from .minhash import NOT_SPACE

#: A leaf ends where these bits of a word's hash are 0, by the place of the word up to which that holds.
LEAF_BITS = ((16, 1), (64, 3), (1 << 62, 15))
SECTION_BITS = 7
#: Words of more bytes are cut inside, where these bits of the hash of the last bytes are 0.
LONG_WORD, LAST_BYTES, BYTE_BITS = 64, 8, 31


#: A leaf without a cut has at most so many bytes, by the place of its beginning up to which that holds.
LARGEST = ((512, 32), (2048, 128), (1 << 62, 512))


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def leaf_ends(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends of all leaves of all texts, one after the other."""
    start, end, before = word_spans(raw, offs, NOT_SPACE)
    prefix = prefix_hash(raw)
    place = np.arange(len(start)) - np.repeat(before[:-1], np.diff(before))
    upto, bits = (np.array(x) for x in zip(*LEAF_BITS, strict=True))
    mask = bits[np.searchsorted(upto, place, "right")].astype(np.uint64)
    cuts = [end[(span_hash(prefix, start, end) & mask) == 0], np.flatnonzero(raw == 10) + 1, offs[1:]]
    for a, b in zip(start[(long := end - start > LONG_WORD)].tolist(), end[long].tolist(), strict=True):
        at = np.arange(a + LAST_BYTES, b)
        cuts.append(at[(span_hash(prefix, at - LAST_BYTES, at) & np.uint64(BYTE_BITS)) == 0])
    ends = np.unique(np.concatenate(cuts))
    ends = ends[ends > 0]
    last = np.concatenate([[0], ends])[:-1].astype(np.int64)
    upto, most = (np.array(x) for x in zip(*LARGEST, strict=True))
    most = most[np.searchsorted(upto, last - offs[np.searchsorted(offs, ends) - 1], "right")]
    more = (ends - last - 1) // most
    first = np.cumsum(more) - more
    inner = np.repeat(last, more) + (np.arange(more.sum()) - np.repeat(first, more) + 1) * np.repeat(most, more)
    return np.sort(np.concatenate([ends, inner]))


def trees(column: pa.Array) -> list[tuple[str, int]]:
    """Of each text its fingerprint and its bytes."""
    raw, offs = utf8(column)
    ends = leaf_ends(raw, offs).tolist()
    data = raw.tobytes()
    out, k = [], 0
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        sections, section, paragraph, nodes = [], [], [], []
        digests, top = b"", b""
        at = lo
        while k < len(ends) and ends[k] <= lo:
            k += 1
        while at < hi:
            end = ends[k]
            k += 1
            d = _digest(data[at:end])
            paragraph.append(f"{d.hex()}{end - at:x}")
            digests += d
            if data[end - 1] == 10 or end == hi:
                node = _digest(digests)
                nodes.append(node)
                section.append(f"{node.hex()}={','.join(paragraph)}")
                paragraph, digests = [], b""
                if node[0] & SECTION_BITS == 0 or end == hi:
                    s = _digest(b"".join(nodes))
                    top += s
                    sections.append(f"{s.hex()}:{';'.join(section)}")
                    section, nodes = [], []
            at = end
        root = _digest(top + (hi - lo).to_bytes(8, "little"), 16).hex()
        out.append(("/".join([root, *sections]), hi - lo))
    return out


def _unmatched(a: list, b: list, digest) -> tuple[list, list]:
    """Branches of each side, with their places, that have no equal one on the other, each of which counts once."""
    left = Counter(digest(x) for _, x in b)
    only_a = []
    for at, x in a:
        if left[d := digest(x)] > 0:
            left[d] -= 1
        else:
            only_a.append((at, x))
    only_b = []
    for at, x in reversed(b):
        if left[d := digest(x)] > 0:
            left[d] -= 1
            only_b.append((at, x))
    return only_a, only_b[::-1]


def _children(branches: list, mark: str, split: str) -> list:
    return [((at, k), x) for at, branch in branches for k, x in enumerate(branch.split(mark, 1)[1].split(split))]


def differing_leaves(a: str, b: str) -> tuple[list, list]:
    """Leaves (place, leaf) of both trees that no equal branch of the other holds; only unequal branches are entered."""
    if a == b or a.split("/", 1)[0] == b.split("/", 1)[0]:
        return [], []
    sides = [list(enumerate(x.split("/")[1:])) for x in (a, b)]
    sides = _unmatched(*sides, lambda s: s[:16])
    sides = _unmatched(*(_children(s, ":", ";") for s in sides), lambda p: p[:16])
    return _unmatched(*(_children(s, "=", ",") for s in sides), lambda leaf: leaf)


def text_bytes(fingerprint: str) -> int:
    """Bytes of the text: the sizes of all its leaves."""
    return sum(int(leaf[16:], 16) for s in fingerprint.split("/")[1:] for p in s.split(":", 1)[1].split(";") for leaf in p.split("=", 1)[1].split(","))


def likeness(a: str, b: str, both: int | None = None) -> float:
    """How alike two texts are, from their fingerprints alone; ``both``: the bytes of the two, where they are known."""
    apart = sum(int(leaf[16:], 16) for leaves in differing_leaves(a, b) for _, leaf in leaves)
    return 1 - apart / (text_bytes(a) + text_bytes(b) if both is None else both) if apart else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Byte spans of a's text whose branches b's tree does not have."""
    wanted = defaultdict(set)
    for ((section, paragraph), leaf), _ in differing_leaves(a, b)[0]:
        wanted[section, paragraph].add(leaf)
    out: list[tuple[int, int]] = []
    at = 0
    for i, s in enumerate(a.split("/")[1:]):
        for j, p in enumerate(s.split(":", 1)[1].split(";")):
            for k, leaf in enumerate(p.split("=", 1)[1].split(",")):
                end = at + int(leaf[16:], 16)
                if k in wanted.get((i, j), ()):
                    if out and out[-1][1] == at:
                        out[-1] = out[-1][0], end
                    else:
                        out.append((at, end))
                at = end
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    return map_text(docs, text, f"`{name}` string", lambda part: {name: pa.array([f for f, _ in trees(part.column(part.schema.get_field_index(text)))], pa.string())})


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place, ghost): partitions hold stretches of the descending order of doc_id, each with the
    row that follows it as its last, a ghost (after the last row of all the first).

    The stretches are cut at quantiles; only one id of each comes to the driver.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
    cuts = sorted(set(cuts), reverse=True)
    # a row's place is the number of cuts that are not below it, counted in groups of about the root of their number
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    above = lambda xs: F.size(F.filter(xs, lambda c: c >= F.col("k")))
    whole = above(longs([g[-1] for g in groups]))
    inner = F.get(F.array(*[longs(g) for g in groups]), whole) if groups else longs([])
    placed = docs.select("doc_id", "text", key.alias("k")).withColumn("whole", whole)
    placed = placed.select("doc_id", "text", "k", (F.col("whole") * width + F.when(F.col("whole") < len(groups), above(inner)).otherwise(0)).alias("place"))
    heads = sorted((r.place, r.k) for r in placed.groupBy("place").agg(F.max("k").alias("k")).collect())
    if not heads:
        return placed.withColumn("ghost", F.lit(False))
    head, before = {p: k for p, k in heads}, {p: q for (p, _), (q, _) in zip(heads, heads[-1:] + heads[:-1], strict=True)}
    places = range(heads[-1][0] + 1)
    is_head = F.col("k") == F.get(longs([head.get(p) for p in places]), F.col("place"))
    own = F.struct("place", F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(longs([before.get(p) for p in places]), F.col("place")).cast("int").alias("place"), F.lit(True).alias("ghost"))
    rows = placed.select("doc_id", "text", "k", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("x")).select("doc_id", "text", "k", "x.place", "x.ghost")
    return rows.repartition(partitions(spark), "place").sortWithinPartitions("place", "ghost", F.desc("k"), "text")


def _compare(batches):
    held = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        for part in steps(batch, "text"):
            rows = pa.Table.from_batches(([held] if held is not None else []) + [part]).combine_chunks().to_batches()[0]
            held = rows.slice(rows.num_rows - 1)
            place, ghost = rows.column(3).to_pylist(), rows.column(4).to_pylist()
            texts = [t or "" for t in rows.column(1).to_pylist()]
            at = [i for i in range(len(texts) - 1) if not ghost[i] and place[i] == place[i + 1]]
            if not at:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in at]
            own, new = trees(rows.column(1)), trees(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(at)),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([own[i][0] for i in at]),
                    pa.array([f for f, _ in new]),
                    pa.array([likeness(own[i][0], f, own[i][1] + n) for i, (f, n) in zip(at, new, strict=True)]),
                    pa.array([likeness(own[i][0], own[i + 1][0], own[i][1] + own[i + 1][1]) for i in at]),
                ],
                names=names,
            )


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = followed(docs).select("doc_id", "text", "k", "place", "ghost")
    return rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
