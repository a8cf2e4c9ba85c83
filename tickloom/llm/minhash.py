"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join and exact confirmation.

A signature has ``CHUNKS * WIDTH`` coordinates of 16 bits.  It is split into ``CHUNKS`` chunks, and each
chunk is looked up with one coordinate left out in turn, so that chunks with up to one differing
coordinate meet.  By the pigeonhole principle every pair of signatures that differ in at most
``2 * CHUNKS - 1`` coordinates meets in some chunk.  All that meet are held against each other on their
full shingle sets before they count as linked.

Texts with equal sets are one member from the start.  Within a bucket, first every member is confirmed
against the bucket's smallest member.  Buckets that then still hold several components compare their
members across components (in blocks, by set size and signature, so that a hot bucket is dealt out over
many tasks): each member's nearest is confirmed, components grow, and so on while one in ten is a link.  Then
the members that still have a partner within the signature-distance threshold in another component come
together with their texts, and all such pairs are confirmed in place; only links leave the task.

Null and empty texts have no set: each stays alone and is kept.  Rows that repeat a doc_id are
documents of their own (equal ones get the same answer); a row without doc_id joins the group of its text
and stays only where the whole group has no doc_id: then one text of it is kept, and component_id is null.
Texts of any length are taken whole.  An empty table gives an empty result.  Other columns are not read;
``one_of_each_group`` keeps them, those of one of several equal rows where a text is kept once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, map_text, mix, partitions, prefix_hash, span_hash, steps, utf8, word_hashes, word_spans, written
from .components import components

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
SHINGLE = 5
CHUNKS, WIDTH = 11, 6
#: Members of a bucket's block, and partners of one pivot in a group.
BLOCK = 512
PARTNERS = 128
#: Another round of nearest partners follows one in which at least one in so many was a link.
WORTHWHILE = 10
_rng = np.random.default_rng(10)
_A = _rng.integers(0, 1 << 63, CHUNKS * WIDTH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, CHUNKS * WIDTH, np.int64).astype(np.uint64)


def shingle_hashes(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, repeats included, and where each text's begin."""
    raw, offs = utf8(column)
    raw = LOWER[raw]
    starts, ends, before = word_spans(raw, offs, NOT_SPACE)
    words = word_hashes(raw, starts, ends)
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - before[:-1], count)
    return span_hash(prefix_hash(words), at, at + np.repeat(np.minimum(n, k), count)), begin


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    h, begin = shingle_hashes(column, k)
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _signatures(part: pa.RecordBatch, text: str, k: int) -> dict:
    sets = shingle_sets(part.column(part.schema.get_field_index(text)), k)
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    sig = np.zeros((len(n), CHUNKS * WIDTH), np.uint16)
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for j in range(CHUNKS * WIDTH):
            sig[full, j] = (mix(np.minimum.reduceat((h ^ _B[j]) * _A[j], begin)) & np.uint64(0xFFFF)).astype(np.uint16)
        d1[full], d2[full] = np.add.reduceat(mix(h), begin), np.add.reduceat(mix(h ^ _B[0]), begin)
    return {"n_shingles": n, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "sig": pa.array([s.tobytes() for s in sig], pa.binary())}


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Of each signature the keys of its chunks with one coordinate left out: an array (rows, CHUNKS * WIDTH)."""
    each = mix(sig.astype(np.uint64) + np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0x1000003D))
    whole = each.reshape(len(sig), CHUNKS, WIDTH).sum(2, dtype=np.uint64)
    return mix(np.repeat(whole, WIDTH, 1) - each + np.arange(sig.shape[1], dtype=np.uint64))


def _explode_keys(batches):
    for b in batches:
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo in range(0, len(ids), 2000):
            sig = np.frombuffer(b"".join(b.column(2)[lo : lo + 2000].to_pylist()), np.uint16).reshape(-1, CHUNKS * WIDTH)
            keys = chunk_keys(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[lo : lo + 2000], keys.shape[1])), pa.array(np.repeat(n[lo : lo + 2000], keys.shape[1]))], names=["key", "id", "n"])


def _size_fits(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union, as (u, v).

    Partners come to copies of a's text in groups of about ``PARTNERS``.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg((F.count("*") / PARTNERS).cast("int").alias("groups"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups") + 1).alias("salt"), F.col("b").alias("id"))
    needs = dealt.withColumn("partner", F.lit(True)).unionByName(dealt.select("a", "salt", F.col("a").alias("id")).distinct().withColumn("partner", F.lit(False)))
    rows = needs.join(texts, "id").select("a", "salt", "partner", "id", "text").repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "partner")

    def compare(batches):
        group, own = None, None
        for batch in batches:
            for part in steps(batch, "text"):
                a, salt, partner, ids = (part.column(i).to_pylist() for i in range(4))
                us, vs = [], []
                for i, s in enumerate(shingle_sets(part.column(4), k)):
                    if not partner[i]:
                        group, own = (a[i], salt[i]), s
                    elif group == (a[i], salt[i]):
                        inter = len(np.intersect1d(own, s, assume_unique=True))
                        if inter and 100 * inter >= percent * (len(own) + len(s) - inter):
                            us.append(a[i])
                            vs.append(ids[i])
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


def _near(left: list, right: list, key: int, percent: int, most: int, nearest: bool):
    """Positions (x, y) in two blocks of members (id, component, set size, signature) of pairs that can be linked.

    Only pairs of different components count whose set sizes and signatures allow a link.  ``nearest``: one
    partner at most for each member; else all such pairs, each in the first bucket only that both are in.
    """
    (li, lc, ln, ls), (ri, rc, rn, rs) = ((np.array([r[0] for r in s]), np.array([r[1] for r in s]), np.array([r[2] for r in s]), np.frombuffer(b"".join(r[3] for r in s), np.uint16).reshape(len(s), -1)) for s in (left, right))
    ok = (lc[:, None] != rc) & (np.minimum(ln[:, None], rn) * 100 >= np.maximum(ln[:, None], rn) * percent)
    x, y = np.nonzero(ok)
    d = np.full(ok.shape, most + 1, np.int64)
    for lo in range(0, len(x), 1 << 16):
        i, j = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
        d[i, j] = (ls[i] != rs[j]).sum(1)
    if nearest:
        x, y = np.concatenate([np.arange(len(li)), d.argmin(0)]), np.concatenate([d.argmin(1), np.arange(len(ri))])
        keep = d[x, y] <= most
        return x[keep], y[keep], d[x, y][keep]
    x, y = np.nonzero(d <= most)
    if left is right:
        x, y = x[x < y], y[x < y]
    if len(x):
        kx, ky = chunk_keys(ls).view(np.int64), chunk_keys(rs).view(np.int64)
        here = np.concatenate([(same := kx[x[lo : lo + 10_000]] == ky[y[lo : lo + 10_000]]).argmax(1) == (kx[x[lo : lo + 10_000]] == key).argmax(1) for lo in range(0, len(x), 10_000)])
        x, y = x[here], y[here]
    return x, y, d[x, y]


def _groups(batches, columns: int):
    """Of sorted (key, left block, right block, side, ...) rows each group with its two sides."""
    group, sides = None, ([], [])
    for batch in batches:
        for part in steps(batch, "text") if "text" in batch.schema.names else (batch,):
            for key, i, j, side, *member in zip(*(part.column(c).to_pylist() for c in range(columns)), strict=True):
                if group != (key, i, j):
                    if group and sides[0] and (sides[1] or group[1] == group[2]):
                        yield group, sides[0], sides[1] if sides[1] else sides[0]
                    group, sides = (key, i, j), ([], [])
                sides[side].append(member)
    if group and sides[0] and (sides[1] or group[1] == group[2]):
        yield group, sides[0], sides[1] if sides[1] else sides[0]


def _nearest(batches, percent: int, most: int):
    """Each member's nearest partner in another component: (a, b, differing coordinates)."""
    for group, left, right in _groups(batches, 8):
        x, y, d = _near(left, right, group[0], percent, most, True)
        a, b = np.array([r[0] for r in left])[x], np.array([r[0] for r in right])[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([d, d]))], names=["a", "b", "d"])


def _taking_part(batches, percent: int, most: int):
    """Members of each group that have a partner there."""
    for (key, i, j), left, right in _groups(batches, 8):
        x, y, _ = _near(left, right, key, percent, most, False)
        rows = [(side, r) for side, members, at in ((0, left, x), (int(i != j), right, y)) for r in (members[k] for k in np.unique(at))]
        if i == j:
            rows = [(0, r) for r in {r[0]: r for _, r in rows}.values()]
        cols = [[key] * len(rows), [i] * len(rows), [j] * len(rows), [s for s, _ in rows], *([r[c] for _, r in rows] for c in range(4))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "i", "j", "side", "id", "comp", "n", "sig"])


def _exact(batches, percent: int, most: int, k: int):
    """Links (u, v) between components of each group, confirmed on full sets; only such as still join two."""
    for group, left, right in _groups(batches, 9):
        x, y, _ = _near(left, right, group[0], percent, most, False)
        own, other = shingle_sets(pa.array([r[4] for r in left], pa.string()), k), None
        other = own if left is right else shingle_sets(pa.array([r[4] for r in right], pa.string()), k)
        root: dict[int, int] = {}

        def find(c, root=root):
            while (up := root.get(c, c)) != c:
                c = up
            return c

        us, vs = [], []
        for a in np.unique(x).tolist():
            at = [b for b in y[x == a].tolist() if find(right[b][1]) != find(left[a][1])]
            for lo in range(0, len(at), 256):
                some = at[lo : lo + 256]
                h = np.concatenate([other[b] for b in some])
                begin = np.cumsum([0, *(len(other[b]) for b in some[:-1])])
                place = np.minimum(np.searchsorted(own[a], h), len(own[a]) - 1)
                inter = np.add.reduceat(own[a][place] == h, begin, dtype=np.int64)
                for b, n in zip(some, inter.tolist(), strict=True):
                    if 100 * n >= percent * (len(own[a]) + len(other[b]) - n) and (p := find(left[a][1])) != (q := find(right[b][1])):
                        root[max(p, q)] = min(p, q)
                        us.append(left[a][0])
                        vs.append(right[b][0])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _mixed(inside: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (key, id) those in buckets that hold several components, with component and last block; and as (key, id)."""
    placed = inside.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", (F.col("size") / BLOCK).cast("int").alias("last"))
    placed = written(placed.join(mixed, "key"), "mixed")
    return placed, placed.select("key", "id")


def _blocks(placed: DataFrame, members: DataFrame) -> DataFrame:
    """Members of mixed buckets, once for each pair of blocks in which their block meets another."""
    dealt = placed.join(members.select("id", "n", "sig"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int"))
    meets = F.expr("transform(sequence(0, last), o -> struct(least(block, o) as i, greatest(block, o) as j, int(block > o) as side))")
    blocks = dealt.select("key", F.explode(meets).alias("m"), "id", "comp", "n", "sig").select("key", "m.i", "m.j", "m.side", "id", "comp", "n", "sig")
    return blocks.repartition(partitions(placed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_groups(docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return _near_groups(docs, percent, doc_id, text, k).drop("t")


def _near_groups(docs: DataFrame, percent: int, doc_id: str, text: str, k: int = SHINGLE) -> DataFrame:
    """``near_groups`` with the text's 64-bit hash as t."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    sets = written(map_text(docs, "text", "n_shingles bigint, d1 bigint, d2 bigint, sig binary", lambda part: _signatures(part, "text", k), keep=["doc_id", "t"]), "sets")
    of_id = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t")))
    members = sets.where("n_shingles > 0").groupBy("d1", "d2").agg(of_id.alias("x"), F.min("t").alias("least"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    # a member goes by its smallest doc_id; where texts of one doc_id differ, or none has an id, by a number of its set below all ids
    number = F.lit(-1) - F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2)
    members = members.select("d1", "d2", F.col("x.doc_id").alias("doc_id"), F.coalesce("x.t", "least").alias("t"), "n", "sig").withColumn("name", F.coalesce("doc_id", number))
    several = members.groupBy("name").count().where("count > 1").select("name", F.lit(True).alias("several"))
    members = written(members.join(several, "name", "left").withColumn("id", F.when(F.col("several"), number).otherwise(F.col("name"))).drop("several", "name"), "members")
    keys = members.select("id", "n", "sig").mapInArrow(_explode_keys, "key long, id long, n long")

    # each bucket's members meet its smallest member
    buckets = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = written(keys.join(buckets, "key").select("key", "id", "n", "first"), "shared")
    stars = shared.where((F.col("id") != F.col("first.id")) & _size_fits(F.col("n"), F.col("first.n"), percent)).groupBy(F.col("first.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("times"))
    stars = written(stars, "stars")
    candidates = shared.select("id").distinct()
    wanted = members.select("id", "doc_id", "t").join(candidates, "id")
    of_member = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["t"] == wanted["t"])
    texts = written(docs.join(wanted, of_member).select("id", "text").dropDuplicates(["id"]), "texts")
    best = stars.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = written(confirmed(best, texts, percent, k), "confirmed")
    labels = written(components(links), "labels")

    # the rest: pairs of one bucket in different components, each member's nearest first
    far = 1 - percent / 100
    # the expected distance at the limit and four standard deviations; up to 2 * CHUNKS - 1 all pairs meet
    most = max(2 * CHUNKS - 1, int(CHUNKS * WIDTH * far + 4 * np.sqrt(CHUNKS * WIDTH * far * (1 - far))))
    tested, inside = best, shared.select("key", "id")
    while True:
        placed, inside = _mixed(inside, labels)
        near = _blocks(placed, members).mapInArrow(lambda b: _nearest(b, percent, most), "a long, b long, d long")
        near = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
        near = written(near.join(tested, ["a", "b"], "left_anti"), "nearest")
        more = written(confirmed(near, texts, percent, k), "confirmed")
        tested = tested.unionByName(near)
        tried, found = near.count(), more.count()
        if found:
            links = links.unionByName(more)
            labels = written(components(links), "labels")
        if found * WORTHWHILE <= tried:
            break
    if found:
        placed, _ = _mixed(inside, labels)
    rest = _blocks(placed, members).mapInArrow(lambda b: _taking_part(b, percent, most), "key long, i int, j int, side int, id long, comp long, n long, sig binary")
    rest = rest.join(texts, "id").select("key", "i", "j", "side", "id", "comp", "n", "sig", "text").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = written(rest.mapInArrow(lambda b: _exact(b, percent, most, k), "u long, v long"), "confirmed")
    if not more.isEmpty():
        labels = written(components(links.unionByName(more)), "labels")

    of_set = members.select("d1", "d2", "id", "doc_id", "t").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    of_set = of_set.join(of_set.groupBy("label").agg(F.min("doc_id").alias("component_")), "label")
    # a group without any id keeps the text of its first member
    stays = F.when(F.col("component_").isNull() & (F.col("id") == F.col("label")), F.col("t"))
    of_set = of_set.select("d1", "d2", F.col("component_").alias("component"), stays.alias("stays"))
    rows = sets.select("doc_id", "t", "n_shingles", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    full = F.col("n_shingles") > 0
    kept = F.when(full, F.coalesce(F.col("doc_id") == F.col("component"), F.col("t") == F.col("stays"), F.lit(False))).otherwise(True)
    return rows.select("doc_id", "n_shingles", F.when(full, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"), "t")


def one_of_each_group(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that their near-duplicate group keeps, in the columns of ``docs``."""
    groups = written(_near_groups(docs, percent, doc_id, text), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")).distinct()
    left = docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["_t"]), "left_anti")
    again = groups.where("kept and n_shingles > 0").groupBy("doc_id", "t").count().where("count > 1")
    return left if again.isEmpty() else left.dropDuplicates([doc_id, text])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a Jaccard similarity of 0.85 of 5-word shingles."""
    return near_groups(documents(spark, sf_dir), 85)


ORACLE_OP10 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN f USING (h) JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
k AS (SELECT node, min(root) AS c FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.c AS component_id, k.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN k ON k.node = w.doc_id
"""
