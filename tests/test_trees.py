"""Trees grown leaf by leaf against a plain search, and contributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import trees


def table(rng, n):
    """Few different values, so bins are the values; some are unknown or infinite."""
    x = rng.integers(0, 9, (n, 3)).astype(float)
    y = 3.0 * (x[:, 0] > 4) + x[:, 1] * (x[:, 2] > 2) + rng.normal(0, 0.1, n)
    x[rng.random(n) < 0.1, 1] = np.nan
    y += 2.0 * np.isnan(x[:, 1])
    x[rng.random(n) < 0.05, 2] = -np.inf
    x[rng.random(n) < 0.05, 2] = np.inf
    return x, y


def plain(x, y, rounds, most_leaves, least, rate):
    """Best-first growth by trying every cut on the rows themselves."""
    base, found = y.mean(), []
    p = np.full(len(y), base)
    for _ in range(rounds):
        r, leaves = y - p, [np.ones(len(y), bool)]

        def split(rows):
            best = (0.0, None)
            for f in range(x.shape[1]):
                known = np.unique(x[rows, f][np.isfinite(x[rows, f]) | (x[rows, f] == -np.inf)])
                for cut in known:
                    left = rows & (x[:, f] <= cut)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) >= least:
                        gain = r[left].sum() ** 2 / left.sum() + r[right].sum() ** 2 / right.sum() - r[rows].sum() ** 2 / rows.sum()
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            return best

        while len(leaves) < most_leaves:
            tried = [split(rows) for rows in leaves]
            k = int(np.argmax([g for g, _ in tried]))
            if tried[k][0] <= 1e-9:
                break
            leaves[k : k + 1] = tried[k][1]
        for rows in leaves:
            p[rows] += rate * r[rows].mean()
        found.append(p.copy())
    return found


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    x, y = table(np.random.default_rng(0), 900)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), i >= 700) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, `a.b` double, b double, c double, y double, v boolean").repartition(3)
    return x, y, df, trees.boosted(df, ["a.b", "b", "c"], "y", F.col("v"), str(tmp_path_factory.mktemp("t") / "f"), rounds=12, most_leaves=7, least=5, rate=0.3)


def test_against_plain(fitted):
    x, y, df, model = fitted
    want = plain(x[:700], y[:700], 12, 7, 5, 0.3)
    for k, p in enumerate(want, 1):
        np.testing.assert_allclose(trees.predict({**model, "trees": model["trees"][:k]}, x[:700]), p, atol=1e-8)
    held = [np.mean((y[700:] - trees.predict({**model, "trees": model["trees"][:k]}, x[700:])) ** 2) for k in range(1, 13)]
    np.testing.assert_allclose(model["errors"], held, rtol=1e-9)
    assert model["best"] == int(np.argmin(held)) + 1
    assert model["passes"] < 12 * 6  # a pass a split would be 12 * 7


def test_importance(fitted):
    x, y, df, model = fitted
    rows = trees.importance(model)
    assert sum(s for *_, s in rows) == sum(sum(v >= 0 for v in t["left"]) for t in model["trees"]) == 12 * 6
    # without a rate's shrinking the gains of one tree are what its error falls by
    t = model["trees"][0]
    full = {**model, "trees": [{**t, "value": [v / 0.3 for v in t["value"]]}]}
    fall = ((y[:700] - model["base"]) ** 2).sum() - ((y[:700] - trees.predict(full, x[:700])) ** 2).sum()
    np.testing.assert_allclose(sum(t["gain"]), fall, rtol=1e-9)


def game(tree, row, known):
    """The tree's expected value where only some features are known."""

    def walk(node):
        left = tree["left"][node]
        if left < 0:
            return tree["value"][node]
        f = tree["feature"][node]
        if f in known:
            return walk(left if row[f] <= tree["cut"][node] else left + 1)
        n = tree["count"]
        return (n[left] * walk(left) + n[left + 1] * walk(left + 1)) / n[node]

    return walk(0)


def test_contributions(fitted):
    x, _, df, model = fitted
    rows = x[::30]
    got = trees.contributions(model, rows)
    for i, row in enumerate(rows):
        for f in range(3):
            others, want = [k for k in range(3) if k != f], 0.0
            for n in range(3):
                for s in combinations(others, n):
                    want += factorial(n) * factorial(2 - n) / 6 * sum(game(t, row, {*s, f}) - game(t, row, set(s)) for t in model["trees"])
            assert abs(got[i, f] - want) < 1e-9
    np.testing.assert_allclose(got.sum(axis=1), trees.predict(model, rows), rtol=1e-9)


def test_frames(fitted):
    x, _, df, model = fitted
    out = trees.explained(trees.predicted(df, model), model).toPandas().sort_values("id")
    np.testing.assert_allclose(out.prediction, trees.predict(model, x), rtol=1e-12)
    np.testing.assert_allclose(out[["shap_a.b", "shap_b", "shap_c", "shap_expected"]].sum(axis=1), out.prediction, rtol=1e-9)
    mean = trees.mean_contributions(df, model).toPandas().set_index("feature").mean_abs_shap
    np.testing.assert_allclose(mean["b"], np.abs(out["shap_b"]).mean(), rtol=1e-9)


def test_early_stop_and_edges(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.integers(0, 5, 300), "y": rng.normal(size=300), "v": np.arange(300) % 3 == 0}))
    model = trees.boosted(df, ["a"], "y", F.col("v"), str(tmp_path / "1"), rounds=40, most_leaves=4, least=5, rate=0.5, patience=3)
    assert len(model["trees"]) == min(model["best"] + 3, len(model["trees"])) < 40
    assert len(trees.best_trees(model)["trees"]) == model["best"]
    none = trees.boosted(df.where("a > 9"), ["a"], "y", F.col("v"), str(tmp_path / "2"), rounds=3)
    assert none["trees"] == [] and trees.predicted(df, none).where("prediction <> 0").count() == 0
    flat = trees.boosted(df.withColumn("y", F.lit(2.5)), ["a"], "y", F.lit(None).cast("boolean"), str(tmp_path / "3"), rounds=3)
    assert flat["trees"] == [] and flat["base"] == 2.5


def test_rows_of_the_same_bins_are_one(spark, tmp_path):
    df = spark.range(2000).selectExpr("CAST(id % 5 AS DOUBLE) AS u", "CAST(id % 3 AS DOUBLE) AS w", "CAST(id % 5 * 2 + id % 7 AS DOUBLE) AS y")
    trees.boosted(df, ["u", "w"], "y", F.lit(False), f"{tmp_path}/cells", rounds=2)
    table = spark.read.parquet(f"{tmp_path}/cells/0")
    assert table.count() == 15 and table.agg(F.sum("n")).first()[0] == 2000
