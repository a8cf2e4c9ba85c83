"""Boosted regression trees grown leaf by leaf, and how much each feature adds to a prediction.

Features are cut into bins by quantiles.  A round of a tree is one pass over the rows: each Arrow batch adds up counts,
sums and squares of what is left to explain by (leaf, feature, bin), so a task emits some thousand numbers however
many rows it reads, and a shuffle of those sums gives the histograms.  The pass looks at the children of every open
leaf, not only of the one that is split next; splits are then taken best first until one is needed whose histograms
are not there yet.  So a tree of 31 leaves takes about as many passes as it is deep.  Rows of the
same bins are one row of a table, with their number, mean and squares; its rows keep their prediction so far, written every ``KEEP`` trees; between, the few newer trees are added up as rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP = 10
LAST = float(np.finfo(float).max)  # the cut that parts known values from unknown ones


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).fill_null(float("nan"))) for n in names], axis=1) if names else np.empty((batch.num_rows, 0))


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node that each row ends in.  A value up to the cut goes left, a larger one, infinity or an unknown one right."""
    at = np.zeros(len(x), np.int64)
    feature, cut, left = (np.asarray(tree[k]) for k in ("feature", "cut", "left"))
    while True:
        inner = np.flatnonzero(left[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = left[node] + ~(x[inner, feature[node]] <= cut[node])


def predict(model: dict, x: np.ndarray, first: int = 0) -> np.ndarray:
    """Sums of the trees from ``first`` on, with the base where that is 0."""
    out = np.full(len(x), model["base"] if first == 0 else 0.0)
    for tree in model["trees"][first:]:
        out += np.asarray(tree["value"])[leaves(tree, x)]
    return out


def _best(h: np.ndarray, least: int, penalty: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a leaf's histogram [feature, bin, (n, sum)]; the first of equals, 0 where none pays."""
    total = h[0].sum(axis=0)
    left = np.cumsum(h, axis=1)[:, :-1]
    right = total - left
    score = lambda s: s[..., 1] ** 2 / (s[..., 0] + penalty)
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), score(left) + score(right) - score(total), 0.0)
    if not gain.size or not gain.max() > 1e-12 * max(1.0, total[1] ** 2 / max(total[0] + penalty, 1.0)):
        return 0.0, -1, -1
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def _grown(histograms: Callable[[dict, list[int]], dict[int, np.ndarray]], edges: list[np.ndarray], most_leaves: int, least: int, rate: float, penalty: float, judged: Callable[[], bool] = lambda: True) -> tuple[dict, int]:
    """A tree, and the passes that it took; ``histograms`` gives those of some nodes of a tree so far.

    After the root's pass ``judged`` says whether to go on; else the tree is a single leaf.
    """
    # a node beyond the taken splits is grown ahead: it is there for its histogram, and cut off if never reached
    tree = {"feature": [-1], "cut": [0.0], "left": [-1], "value": [0.0], "count": [0.0], "gain": [0.0]}
    hist, best, passes = histograms(tree, [0]), {}, 1

    def look(node: int) -> None:
        best[node] = _best(hist[node], least, penalty)
        n, s = hist[node][0].sum(axis=0)
        tree["value"][node], tree["count"][node] = float(rate * s / (n + penalty)) if n else 0.0, float(n)

    look(0)
    taken, open_leaves = set(), {0}
    if not judged():
        return _pruned(tree, taken), passes
    while len(open_leaves) < most_leaves:
        node = max(open_leaves, key=lambda k: (best[k][0], -k))
        if best[node][0] <= 0:
            break
        if tree["left"][node] < 0:
            ahead = sorted((k for k in open_leaves if tree["left"][k] < 0 and best[k][0] > 0), key=lambda k: -best[k][0])
            small = []
            for k in ahead:  # of two children the smaller one is counted, the other is what is left
                _, f, b = best[k]
                tree["feature"][k], tree["cut"][k], tree["left"][k] = f, float(edges[f][b]), len(tree["left"])
                side = hist[k][f, : b + 1, 0].sum() * 2 > hist[k][0, :, 0].sum()
                small.append(tree["left"][k] + int(side))
                for name, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("value", 0.0), ("count", 0.0), ("gain", 0.0)):
                    tree[name] += [v, v]
            found, passes = histograms(tree, small), passes + 1
            for k, child in zip(ahead, small, strict=True):
                other = 2 * tree["left"][k] + 1 - child
                hist[child], hist[other] = found[child], hist[k] - found[child]
                look(child)
                look(other)
        tree["gain"][node] = best[node][0]
        taken.add(node)
        open_leaves = (open_leaves - {node}) | {tree["left"][node], tree["left"][node] + 1}
    return _pruned(tree, taken), passes


def _pruned(tree: dict, taken: set[int]) -> dict:
    """The tree of the taken splits alone; sons of a node stand side by side."""
    out = {k: [] for k in tree}
    queue = [0]
    for node in queue:
        for k in tree:
            out[k].append(tree[k][node])
        if node in taken:
            out["left"][-1] = len(queue)
            queue += [tree["left"][node], tree["left"][node] + 1]
        else:
            out["feature"][-1], out["cut"][-1], out["left"][-1], out["gain"][-1] = -1, 0.0, -1, 0.0
    return out


def bin_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Of each feature its upper bin ends, values of the column at even quantiles; one pass of sketches."""
    at = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(f), F.col(f)), at, 100 * bins).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.asarray(found[f"c{i}"] or [], float)) for i in range(len(features))]


def _cells(rows: DataFrame, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """``rows`` (features, y, v) with features taken up to their bins' ends, and one row for equal ones: n rows, their mean m of y and squares a around it.

    A tree cannot tell a bin's values apart, so counts, sums and errors come out as those of the rows themselves.
    """
    ends = [np.append(e, np.nan) for e in edges]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names)
            places = [np.where(np.isnan(x[:, f]), len(e), np.searchsorted(e, x[:, f])) for f, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([*[pa.array(e[at]) for e, at in zip(ends, places, strict=True)], batch.column("y"), batch.column("v")], [*names, "y", "v"])

    kinds = ", ".join([*[f"{c} double" for c in names], "y double", "v boolean"])
    return rows.select(*names, "y", "v").mapInArrow(binned, kinds).groupBy(*names, "v").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("a"))


def boosted(df: DataFrame, features: list[str], label: str, valid: Column, folder: str, rounds: int = 100, most_leaves: int = 31, least: int = 20, rate: float = 0.05, penalty: float = 0.0, bins: int = 64, patience: int = 50) -> dict:
    """A model of squared loss: ``base``, ``trees``, ``best`` (trees that the least error on ``valid`` rows has), ``errors``.

    Rows without a label take no part; unknown features go right.  It ends after ``patience`` trees without a lower
    error; without ``valid`` rows all rounds are taken.  ``folder`` is shared by the executors and holds the rows'
    predictions so far.  The model is small (trees times leaves) and goes to the tasks.
    """
    if least < 1 or most_leaves < 1:
        raise ValueError("a leaf holds a row or more, a tree a leaf or more")
    features = list(features)
    y = F.col(label).cast("double")
    # an unknown mark counts as False: such rows are learned from
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], y.alias("y"), F.coalesce(valid, F.lit(False)).alias("v"))
    names = [f"x{i}" for i in range(len(features))]
    spark = df.sparkSession
    cuts = bin_cuts(rows.where("NOT v"), names, bins)
    edges = [np.append(c[c < LAST], LAST) for c in cuts]
    width = max((len(e) for e in edges), default=1) + 1
    _cells(rows, names, edges).withColumn("p", F.lit(0.0)).write.parquet(f"{folder}/0")
    table = spark.read.parquet(f"{folder}/0")
    model = {"features": features, "base": table.where("NOT v").agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()[0] or 0.0, "trees": [], "errors": [], "best": 0, "passes": 0}
    kept = 0

    def histograms(tree: dict, nodes: list[int]) -> dict[int, np.ndarray]:
        """Sums by (node, feature, bin) of the rows that are learned from; with the root's, the error on the others as ``seen``."""
        past, first, base = model["trees"], kept, model["base"]
        place = np.full(len(tree["left"]), -1)
        place[nodes] = np.arange(len(nodes))
        size = len(nodes) * len(names) * width

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(size + 1), np.zeros(size + 1)  # the last place is for the rows held out
            for batch in batches:
                x, both, out = _matrix(batch, names), _matrix(batch, ["m", "p", "n", "a"]), np.asarray(batch.column("v").cast(pa.int8())) == 1
                node = np.where(out, -1, place[leaves(tree, x)])
                use = out | (node >= 0)
                x, node, both, out = x[use], node[use], both[use], out[use]
                left = both[:, 0] - both[:, 1] - base - predict({"base": 0.0, "trees": past}, x, first)
                held = both[:, 2]
                n[-1] += held[out].sum()
                s[-1] += (both[out, 3] + held[out] * left[out] ** 2).sum()
                x, node, left, held = x[~out], node[~out], left[~out], held[~out]
                for f in range(len(names)):
                    b = np.where(np.isnan(x[:, f]), len(edges[f]), np.searchsorted(edges[f], x[:, f]))
                    slot = (node * len(names) + f) * width + b
                    n[:-1] += np.bincount(slot, held, size)
                    s[:-1] += np.bincount(slot, held * left, size)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], ["slot", "n", "s"])

        read = table if nodes == [0] else table.where("NOT v")
        sums = read.mapInArrow(count, "slot long, n double, s double").groupBy("slot").agg(F.sum("n"), F.sum("s")).toArrow()
        out = np.zeros((size + 1, 2))  # as many numbers as nodes x features x bins, whatever the rows
        out[np.asarray(sums.column(0))] = np.stack([np.asarray(sums.column(1)), np.asarray(sums.column(2))], axis=1)
        if nodes == [0]:
            seen.append(float(out[-1, 1] / out[-1, 0]) if out[-1, 0] else None)
        return dict(zip(nodes, out[:-1].reshape(len(nodes), len(names), width, 2), strict=True))

    def judged() -> bool:
        """Take in the error that a pass over the trees so far has seen; whether to go on."""
        if model["trees"] and seen[-1] is not None:
            model["errors"].append(seen[-1])
            model["best"] = int(np.argmin(model["errors"])) + 1
        else:
            model["best"] = len(model["trees"])
        return len(model["trees"]) - model["best"] < patience

    seen: list[float | None] = []
    for _ in range(rounds if names else 0):
        tree, passes = _grown(histograms, edges, most_leaves, least, rate, penalty, judged)
        model["passes"] += passes
        if tree["left"] == [-1]:
            break  # no split pays, nor will it later, or no tree has lowered the error for long
        model["trees"].append(tree)
        if len(model["trees"]) - kept >= KEEP:
            past, first = model["trees"], kept
            fields = table.columns

            def add_up(batches):
                for batch in batches:
                    p = np.asarray(batch.column("p")) + predict({"base": 0.0, "trees": past}, _matrix(batch, names), first)
                    yield batch.set_column(fields.index("p"), "p", pa.array(p))

            table.mapInArrow(add_up, table.schema).write.parquet(f"{folder}/{len(past)}")
            kept = len(past)
            table = spark.read.parquet(f"{folder}/{kept}")
    if len(model["trees"]) > len(model["errors"]):  # the last tree's error
        histograms({"left": [-1], "feature": [-1], "cut": [0.0]}, [0])
        model["passes"] += 1
        judged()
    return model


def best_trees(model: dict) -> dict:
    """The model up to its best tree."""
    return {**model, "trees": model["trees"][: model["best"]]}


def predicted(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    return _mapped(df, model, [name], lambda x: predict(model, x)[:, None])


def _mapped(df: DataFrame, model: dict, names: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with columns ``names`` from the features, in Arrow batches; its own columns stay as they are."""
    taken, own = [f"x{i}" for i in range(len(model["features"]))], [f"c{i}" for i in range(len(df.columns))]
    # by number, as names may hold dots, which Spark's Arrow calls do not look up
    wide = df.select("*", *[F.col(f"`{f}`").cast("double") for f in model["features"]]).toDF(*own, *taken)
    added = [f"y{i}" for i in range(len(names))]
    schema = T.StructType([*wide.schema.fields[: len(own)], *[T.StructField(n, T.DoubleType()) for n in added]])

    def run(batches):
        for batch in batches:
            out = fn(_matrix(batch, taken))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *[pa.array(c) for c in out.T]], [*own, *added])

    return wide.mapInArrow(run, schema).toDF(*df.columns, *names)


def importance(model: dict) -> list[tuple[str, float, int]]:
    """(feature, gain, split): sums of gains of the features' splits, and how many there are."""
    gain, split = np.zeros(len(model["features"])), np.zeros(len(model["features"]), int)
    for tree in model["trees"]:
        for f, g in zip(tree["feature"], tree["gain"], strict=True):
            if f >= 0:
                gain[f] += g
                split[f] += 1
    return [(f, float(g), int(s)) for f, g, s in zip(model["features"], gain, split, strict=True)]


# --- additive contributions -----------------------------------------------------------------------------------


def _paths(tree: dict) -> Iterable[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, conditions) of each leaf; of each feature on its path one condition (feature, above, up to, share of rows).

    ``above`` is NaN where no cut bounds it from below.  ``share`` is how much of a node's training rows goes on towards the leaf, over all the feature's splits; an upper
    end of infinity lets unknown values through.
    """
    stack = [(0, {})]
    while stack:
        node, on = stack.pop()
        left = tree["left"][node]
        if left < 0:
            yield tree["value"][node], [(f, *c) for f, c in on.items()]
            continue
        f, cut = tree["feature"][node], tree["cut"][node]
        low, high, share = on.get(f, (np.nan, np.inf, 1.0))
        whole = tree["count"][node] or 1.0
        stack.append((left, {**on, f: (low, min(high, cut), share * tree["count"][left] / whole)}))
        stack.append((left + 1, {**on, f: (float(np.fmax(low, cut)), high, share * tree["count"][left + 1] / whole)}))


def contributions(model: dict, x: np.ndarray) -> np.ndarray:
    """[rows, features + 1]: what each feature adds to each row's prediction, and the expected one last; they add up to it.

    Shapley values of the game in which a tree follows the row where a feature is known, and both ways by shares of
    the training rows where it is not.  A leaf is reached with the product of its features' ones (the row meets the
    condition) or shares.  With a polynomial in the number of known features all subsets of a path's d features are
    weighed in d * d steps; a feature's own factor is divided out again by doing without it.
    """
    out = np.zeros((len(x), len(model["features"]) + 1))
    out[:, -1] = model["base"]
    for tree in model["trees"]:
        for value, path in _paths(tree):
            d = len(path)
            met = np.stack([_meets(x[:, f], low, high) for f, low, high, _ in path], axis=1) if d else np.empty((len(x), 0))
            share = np.array([s for *_, s in path])
            out[:, -1] += value * share.prod()
            weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            # rows that meet the same conditions of a path have the same values: at most 2**d, mostly few
            if d <= 50:
                codes, back = np.unique(met @ (2.0 ** np.arange(d)), return_inverse=True)
                kinds = (codes[:, None].astype(np.int64) >> np.arange(d) & 1).astype(float)
            else:
                kinds, back = np.unique(met, axis=0, return_inverse=True)
            for i, (f, *_) in enumerate(path):
                poly = np.zeros((len(kinds), d))  # by how many of the others are known
                poly[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        poly[:, 1:], poly[:, 0] = poly[:, 1:] * share[j] + poly[:, :-1] * kinds[:, j : j + 1], poly[:, 0] * share[j]
                out[:, f] += (value * (kinds[:, i] - share[i]) * (poly @ weight))[back]
    return out


def _meets(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Whether a value lies in (low, high], where a low of NaN is none; an unknown one is above every cut."""
    return (~(x <= low) & ((x <= high) | (high == np.inf))).astype(float)


def explained(df: DataFrame, model: dict, prefix: str = "shap_", expected: str = "shap_expected") -> DataFrame:
    """``df`` with a column ``prefix`` + feature for each feature, and the expected prediction."""
    return _mapped(df, model, [*[prefix + f for f in model["features"]], expected], lambda x: contributions(model, x))


def mean_contributions(df: DataFrame, model: dict) -> DataFrame:
    """(feature, mean_abs_shap), a row a feature."""
    wide = explained(df.select(*[F.col(f"`{f}`") for f in model["features"]]), model)
    sums = wide.agg(*[F.avg(F.abs(F.col(f"`shap_{f}`"))).alias(f"m{i}") for i, f in enumerate(model["features"])])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap")) for i, f in enumerate(model["features"])])
    return sums.select(F.inline(pairs))
