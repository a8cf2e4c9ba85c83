"""Hard negatives against a plain search over all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from tickloom.llm import hard_negatives
from tickloom.llm.hard_negatives import ORACLE_OP11, Index, op11_hard_negatives, usable

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    rows = [(i, (n + 1) % 10 if i % 7 == 0 else n, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, n in rows if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, n == label) for b, (j, n, w) in enumerate(rows) if b != a))
        for s, j, _ in [x for x in scores if x[2]][:5]:
            negatives = [(n, k) for n, k, same in scores if not same and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(negatives[:10])]
    return sorted(out)


def rows_of(seed, n, d=9, labels=4):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels * 3)]
    out = []
    for i in range(n):
        c = rng.choice(centre)
        out.append((i * 10, [0.7 * x + 0.4 * rng.gauss(0, 1) for x in c], rng.randrange(labels)))
    return out


@pytest.mark.parametrize("case", ["plain", "hot"])
def test_query(spark, tmp_path, monkeypatch, case):
    """Small blocks, batches and rounds, so that all of them are cut; "hot": a third of all rows is one vector, and ids repeat."""
    for name, value in {"FIRST": 40, "MORE": 4, "BLOCK": 64, "ANCHORS": 8, "BATCH": 3, "PER_CELL": 12}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(1, 600)
    rows += [(None, [1.0] * 9, 1), (7, None, 1), (11, [1.0] * 9, None), (12, [float("nan")] * 9, 1), (13, [float("inf")] * 9, 2), (14, [None] * 9, 2), (15, [0.5, 0.25], 3), (16, [], 1), (100, rows[3][1], 1)]
    if case == "hot":
        rows += [(i * 10, rows[0][1], i % 3) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS score").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect())
    want = plain(rows)
    assert len(want) > 1000 and got == want


def test_sql(spark, tmp_path):
    rows = rows_of(2, 400, 12, 10)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLE_OP11).fetchall()) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)], [(0, [0.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, [0.0, 0.0], 2), (3, [-1.0, 0.5], 1)]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect()) == plain(rows)


def test_bounds_hold_and_cells_come_by_falling_bounds(spark, monkeypatch):
    """Every vector is in one cell, its score is below its cell's bound, and a certified search visits few cells where clusters are tight."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16)) * 4
    x = np.floor(256 * (centre[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 16))))
    rows = usable(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA))
    monkeypatch.setattr(hard_negatives, "PER_CELL", 20)
    index = Index(rows)
    placed = index.rows.collect()
    assert len(placed) == 3000 and index.cells.count.sum() == 3000
    for a in x[:20]:
        s = sorted((float(a @ np.array(r.v)) for r in placed), reverse=True)
        cells, popped, certified = index.cells.plan(a, 0, 1 << 60, int(s[9]), 1 << 62)
        held = [r for r in placed if cells.get(r.i, 0) >> r.j & 1]
        assert certified and sum(float(a @ np.array(r.v)) >= s[9] for r in held) >= 10
        assert len(held) < 1500
        first, seen, _ = index.cells.plan(a, 0, 100, int(s[9]), 1 << 62)
        rest, _, _ = index.cells.plan(a, seen, 1 << 60, int(s[9]), 1 << 62)
        assert {(i, j) for c in (first, rest) for i, b in c.items() for j in range(64) if b >> j & 1} == {(i, j) for i, b in cells.items() for j in range(64) if b >> j & 1}
