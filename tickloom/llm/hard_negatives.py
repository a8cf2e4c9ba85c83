"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook (k-means over a sample of at most ``SAMPLE`` vectors, drawn by
hash); a vector lies in the cell of its two nearest codewords.  Every vector is indexed, and each codeword knows
the radius of all vectors that it holds.  A half's score with an anchor is at most that of its codeword plus the
anchor's norm times the radius, and the sum of both halves bounds all scores of a cell.

An anchor visits cells by falling bounds: a heap over the two sorted lists of half-score bounds, begun at the best
pair (the multi-sequence search).  A first round visits cells until they hold ``FIRST`` vectors, and every further
one ``MORE`` times as many.  What has been found gives each window (the positives of an anchor, or its negatives
within the scores that one positive allows) the score that a vector must reach to get into it.  Once the heap's
bound is below that for all windows, these are certified: no cell that is left can change them.  Rounds go on until
all are, so results are exact whatever the codebooks; cells whose least possible score is above all windows are
passed over.

Vectors of one first codeword are dealt out by hash in blocks of about ``BLOCK``, and anchors that visit them in
groups of about ``ANCHORS``; scores are matrix products of a block with a batch of anchors, of which each window
keeps its best few before anything is shuffled.  Nothing but codebooks, radii and counts of the at most
``MOST_WORDS`` squared cells comes to the driver.

Rows without label, vector or vec_id, or with a component that is null or not finite, take no part.  Shorter vectors
count as filled up with zeros, empty ones have the score 0 with all.  Rows that repeat, also a vec_id, are rows of their own: each is an
anchor, or a partner of the others.  Ties go to the smaller vec_id.  Scores must fit a long.  Other columns are not
read.  An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

SAMPLE = 4096
#: Vectors of a cell in the mean that codebooks are made for, and the most codewords of a half.
PER_CELL, MOST_WORDS = 128, 64
FIRST, MORE = 1024, 16
BLOCK, ANCHORS, BATCH = 2048, 4096, 64
STEPS = 8
_NONE = -(1 << 62)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, v): the rows that take part, v as doubles of one length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", fine))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"), "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced sample rows; codewords without members stay where they are."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(STEPS):
        near = _nearest(x, words)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1) if len(x) else np.zeros(0, int)


class Cells:
    """Codewords of both halves, their radii over all vectors, and how many vectors each cell holds."""

    def __init__(self, half: int, words: list[np.ndarray], radius: np.ndarray, count: np.ndarray):
        self.half, self.words, self.radius, self.count = half, words, radius, count

    def plan(self, a: np.ndarray, popped: int, budget: int, least: int, most: int) -> tuple[dict[int, int], int, bool]:
        """The next cells of an anchor: {i: bits of j}, cells popped so far, and whether all that can reach ``least`` are among them."""
        best, low = [], []
        for h, p in enumerate((a[: self.half], a[self.half :])):
            mid, reach = self.words[h] @ p, float(np.sqrt(p @ p)) * self.radius[h]
            slack = 1e-9 * (np.abs(self.words[h]) @ np.abs(p) + reach) + 1e-6
            best.append(mid + reach + slack)
            low.append(mid - reach - slack)
        order = [np.argsort(-b, kind="stable") for b in best]
        top = [b[o].tolist() for b, o in zip(best, order, strict=True)]
        place, k = [o.tolist() for o in order], len(top[0])
        low = [x.tolist() for x in low]
        heap, seen, cells, members = [(-top[0][0] - top[1][0], 0, 0)], 0, {}, 0
        while heap and members < budget:
            bound, x, y = heap[0]
            if -bound < least:
                return cells, seen, True
            heapq.heappop(heap)
            # the cell right of this one, and of a row's first cell also the one below: each cell comes once
            if y + 1 < k:
                heapq.heappush(heap, (-top[0][x] - top[1][y + 1], x, y + 1))
            if y == 0 and x + 1 < k:
                heapq.heappush(heap, (-top[0][x + 1] - top[1][0], x + 1, 0))
            seen += 1
            if seen > popped:
                i, j = place[0][x], place[1][y]
                if self.count[i, j] and low[0][i] + low[1][j] <= most:
                    cells[i] = cells.get(i, 0) | (1 << j)
                    members += int(self.count[i, j])
        return cells, seen, not heap


class Index:
    """``rows`` has each vector with its cell (i, j) and its block b of ``blocks`` of the first codeword."""

    def __init__(self, rows: DataFrame):
        k = int(np.clip(round((rows.count() / PER_CELL) ** 0.5), 2, MOST_WORDS))
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
        x = np.array([r.v for r in sample], np.float64).reshape(len(sample), len(sample[0].v) if sample else 0)
        half = x.shape[1] // 2
        words = [_codebook(p, k) if len(p) else np.zeros((k, p.shape[1])) for p in (x[:, :half], x[:, half:])]

        def assign(batches):
            for b in batches:
                v = _matrix(b.column(3))
                cells, away = [], []
                for p, w in ((v[:, :half], words[0]), (v[:, half:], words[1])):
                    near = _nearest(p, w)
                    cells.append(pa.array(near.astype(np.int32)))
                    away.append(pa.array(np.sqrt(((p - w[near]) ** 2).sum(1))))
                yield pa.RecordBatch.from_arrays([*b.columns, *cells, *away], names=["row", "id", "label", "v", "i", "j", "r1", "r2"])

        placed = written(rows.select("row", "id", "label", "v").mapInArrow(assign, "row long, id long, label long, v array<double>, i int, j int, r1 double, r2 double"), "index")
        radius, count = np.zeros((2, k)), np.zeros((k, k), np.int64)
        for c in placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():
            count[c.i, c.j] = c.n
            radius[0, c.i], radius[1, c.j] = max(radius[0, c.i], c.r1), max(radius[1, c.j], c.r2)
        self.cells = Cells(half, words, radius, count)
        self.blocks = 1 + count.sum(1) // BLOCK
        blocks = F.element_at(F.lit(self.blocks.tolist()), F.col("i") + 1)
        self.rows = placed.drop("r1", "r2").withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), blocks).cast("int"))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Flags of the k largest finite values of each row; of equal ones the first."""
    if s.shape[1] <= k:
        return np.isfinite(s)
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, equal = s > edge, s == edge
    return (above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))) & np.isfinite(s)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by doubles where they hold all sums, else by 64-bit integers."""
    if np.sqrt((a**2).sum(1).max(initial=0)) * np.sqrt((b**2).sum(1).max(initial=0)) < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _visit(batches, same: bool, k: int):
    """Of sorted (i, b, s, side, ...) rows, a block's vectors before its visitors, each visitor's best of each of its windows."""
    group, rows, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
        cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part, key = batch.slice(lo, hi - lo), tuple(keys[lo, :3])
            if key != group:
                group, rows, block = key, [], None
            if keys[lo, 3] == 0:
                rows.append(part)
                continue
            if not rows:
                continue
            if block is None:
                whole = pa.Table.from_batches(rows).combine_chunks()
                block = [whole.column(c).to_numpy() for c in (4, 5, 6, 8)] + [_matrix(whole.column(7).combine_chunks())]
                rows = [rows[0]]
            for at in range(0, len(part), BATCH):
                yield _of_batch(part.slice(at, BATCH), block, same, k)


def _of_batch(part: pa.RecordBatch, block: list, same: bool, k: int) -> pa.RecordBatch:
    row, vec_id, label, cell, v = block
    anchor, own = part.column(4).to_numpy(), part.column(6).to_numpy()
    bits, windows = part.column(9).to_numpy().view(np.uint64), part.column(10)
    some = np.flatnonzero((np.bitwise_or.reduce(bits) >> cell.astype(np.uint64)) & np.uint64(1))
    row, vec_id, label, cell, v = row[some], vec_id[some], label[some], cell[some], v[some]
    s = _scores(_matrix(part.column(7)), v)
    fits = ((bits[:, None] >> cell.astype(np.uint64)) & np.uint64(1)).astype(bool) & ((own[:, None] == label) == same)
    if same:
        fits &= anchor[:, None] != row
    out = []
    begin = windows.offsets.to_numpy()
    least, most = (pc.struct_field(windows.values, f).to_numpy() for f in ("least", "most"))
    n = np.diff(begin)
    for w in range(n.max(initial=0)):
        has = np.flatnonzero(n > w)
        at = begin[:-1][has] + w
        got = s[has]
        x, y = np.nonzero(_best(np.where(fits[has] & (got >= least[at, None]) & (got <= most[at, None]), got, -np.inf), k))
        out.append((anchor[has[x]], np.full(len(x), w), row[y], vec_id[y], got[x, y]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int64, np.int64, np.int64), strict=True)], names=["anchor", "w", "row", "id", "score"])


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, w, rank, row, id, score): the k best vectors of each window of ``anchors`` (row, label, v, windows).

    A window has a least and a most score; ``same`` tells whether partners have the anchor's label or another one.
    """
    spark = anchors.sparkSession
    found, budget, cells = None, FIRST, index.cells
    state = anchors.select("row", "label", "v", "windows", F.lit(0).alias("popped"))
    while True:

        def plan(batches, budget=budget):
            for b in batches:
                v, popped, out = _matrix(b.column(2)), b.column(4).to_pylist(), []
                for a, windows, seen in zip(v, b.column(3).to_pylist(), popped, strict=True):
                    windows = [w for w in windows if w["least"] <= w["most"]]
                    if not windows:
                        out.append(({}, seen, True))
                        continue
                    out.append(cells.plan(a, seen, budget, min(w["least"] for w in windows), max(w["most"] for w in windows)))
                visits = [[{"i": i, "bits": bits - (1 << 64) if bits >> 63 else bits} for i, bits in found.items()] for found, _, _ in out]
                cols = [*b.columns[:4], pa.array([p for _, p, _ in out], pa.int32()), pa.array([d for _, _, d in out], pa.bool_()), pa.array(visits, pa.list_(pa.struct([("i", pa.int32()), ("bits", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "label", "v", "windows", "popped", "certified", "visits"])

        kind = "row long, label long, v array<double>, windows array<struct<least:long,most:long>>, popped int, certified boolean, visits array<struct<i:int,bits:long>>"
        planned = written(state.mapInArrow(plan, kind), "plan")
        visits = planned.select("row", "label", "v", "windows", F.explode("visits").alias("c")).select("row", "label", "v", "windows", "c.i", "c.bits")
        per = {r.i: r.n for r in visits.groupBy("i").agg(F.count("*").alias("n")).collect()}
        groups = [1 + per.get(i, 0) // ANCHORS for i in range(len(index.blocks))]
        of = lambda a: F.element_at(F.lit([int(x) for x in a]), F.col("i") + 1)
        none = F.lit(None)
        vectors = index.rows.where(F.col("i").isin(list(per))) if per else index.rows.limit(0)
        vectors = vectors.withColumn("s", F.explode(F.sequence(F.lit(0), of(groups) - 1)))
        vectors = vectors.select("i", "b", "s", F.lit(0).alias("side"), "row", "id", "label", "v", F.col("j"), none.cast("long").alias("bits"), none.cast("array<struct<least:long,most:long>>").alias("windows"))
        visitors = visits.withColumn("b", F.explode(F.sequence(F.lit(0), of(index.blocks) - 1))).withColumn("s", F.pmod(F.xxhash64("row"), of(groups)).cast("int"))
        visitors = visitors.select("i", "b", "s", F.lit(1).alias("side"), "row", none.cast("long").alias("id"), "label", "v", none.cast("int").alias("j"), "bits", "windows")
        met = vectors.unionByName(visitors).repartition(partitions(spark), "i", "b", "s").sortWithinPartitions("i", "b", "s", "side", "id", "row")
        new = met.mapInArrow(lambda b: _visit(b, same, k), "anchor long, w int, row long, id long, score long")
        new = new if found is None else new.unionByName(found.drop("rank"))
        ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id", "row")))
        found = written(ranked.where(F.col("rank") <= k), "found")
        left = planned.where("not certified")
        if left.isEmpty():
            return found
        # a window that is full is entered by the score of its last one only
        full = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
        risen = F.transform("windows", lambda w, i: F.struct(F.greatest(w.least, F.coalesce(F.try_element_at("full", i), w.least)).alias("least"), w.most.alias("most")))
        state = left.join(full, left["row"] == full["anchor"], "left").select("row", "label", "v", F.when(F.col("full").isNull(), F.col("windows")).otherwise(risen).alias("windows"), "popped")
        budget *= MORE


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, index: Index | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (row, id, label, v).

    Each anchor's best ``positives`` rows of its label, and for each of them its best ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    index = index or Index(rows)
    anchors = index.rows.where(is_anchor).select("row", "id", "label", "v")
    everything = F.array(F.struct(F.lit(_NONE).alias("least"), F.lit(-_NONE).alias("most")))
    pos = search(index, anchors.withColumn("windows", everything), True, positives)
    of = pos.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("pos"))
    # whole-number bounds of low/100 and high/100 of the score
    window = F.transform("pos", lambda p: F.struct((-F.floor(-p.score * low / 100)).alias("least"), F.floor(p.score * high / 100).alias("most")))
    wanted = written(anchors.join(of, anchors["row"] == of["anchor"]).select("row", "id", "label", "v", "pos", window.alias("windows")), "windows")
    neg = search(index, wanted, False, negatives)
    named = wanted.select("row", F.col("id").alias("anchor_id"), F.posexplode("pos").alias("w", "p"))
    out = neg.select(F.col("anchor"), "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(named, (out["anchor"] == named["row"]) & (out["w"] == named["w"]))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(256.0) * x).cast("double")))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE_OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""
