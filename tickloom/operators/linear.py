"""Linear models over factor tables from sums of products: elastic net by paths, tests of one more factor at a time.

Sums of products of all columns, by fold, come from one pass over the rows; what is solved here grows with the number
of columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.factors import numbered
from . import backtest, evaluate

SHARES = (0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)


def _sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each row of ``p``, and what was lost to rounding in it (two-sums in a tree)."""
    lost = np.zeros(len(p))
    while p.shape[1] > 1:
        if p.shape[1] % 2:
            p = np.pad(p, ((0, 0), (0, 1)))
        a, b = p[:, ::2], p[:, 1::2]
        p = a + b
        t = p - a
        lost += ((a - (p - t)) + (b - t)).sum(1)
    return p[:, 0], lost


def products(df: DataFrame, columns: list[str], fold: str | None = None) -> DataFrame:
    """(fold, i, j, v): sums of products of columns i <= j of each fold; column 0 is 1, ``columns`` follow; rows without NULL.

    What a sum loses to rounding is carried along to its end, so v does not depend on how rows are dealt out.
    """
    x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns])
    rows = df.select((F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), x.alias("x"))
    i, j = np.triu_indices(len(columns) + 1)

    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        with np.errstate(over="ignore", invalid="ignore"):  # infinite values stay so
            for b in batches:
                f, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(len(b), -1)
                for k in np.unique(f).tolist():
                    y = np.ascontiguousarray(x[f == k].T)
                    v, lost = (np.concatenate(c) for c in zip(*(_sums(y[n] * y[n:]) for n in range(len(y))), strict=True))
                    if k in total:
                        v, more = _sums(np.column_stack([total[k][0], v]))
                        lost += total[k][1] + more
                    total[k] = v, lost
        for k, (v, lost) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v), pa.array(lost)], names=["fold", "i", "j", "v", "lost"])

    def add(x, y):
        v = x.v + y.v
        t = v - x.v
        return F.struct(v.alias("v"), (x.lost + y.lost + ((x.v - (v - t)) + (y.v - t))).alias("lost"))

    # one row a task
    parts = rows.mapInArrow(run, "fold int, i int, j int, v double, lost double").groupBy("fold", "i", "j").agg(F.collect_list(F.struct("v", "lost")).alias("parts"))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("lost"))
    return parts.select("fold", "i", "j", F.aggregate("parts", zero, add, lambda x: x.v + F.nanvl(x.lost, F.lit(0.0))).alias("v"))


def as_matrices(sums: DataFrame, columns: int, folds: int = 1) -> np.ndarray:
    out = np.zeros((folds, columns + 1, columns + 1))
    for r in sums.collect():
        out[r.fold, r.i, r.j] = out[r.fold, r.j, r.i] = r.v
    return out


def _centred(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of all columns and mean products of their deviations."""
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    return mean, sums[1:, 1:] / n - np.outer(mean, mean)


def time_folds(df: DataFrame, day: str, order: list[str], folds: int = 5) -> DataFrame:
    """``df`` with fold: 0 for the first rows, then 1 to ``folds`` for as many equal stretches of rows in their order, the last ones of all."""
    size = df.count() // (folds + 1)
    rows = numbered(df, [], [day], order, "_row")
    first = df.count() - folds * size
    return rows.withColumn("fold", F.when(F.col("_row") < first, 0).otherwise(1 + F.floor((F.col("_row") - first) / max(size, 1))).cast("int")).drop("_row")


def paths(sums: np.ndarray, shares=SHARES, steps: int = 100, least: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(alphas, weights) of elastic nets over all shares, steps of alpha and training sets of ``sums`` (the last one is the whole).

    An alpha's path goes from the least one that keeps no feature of the whole down to ``least`` of it; each fit begins
    at the one before.  All shares and sets take a coordinate's step together: half the mean squared error plus
    alpha * (share * |w| + (1 - share) * w**2 / 2) is minimised.
    """
    both = [_centred(s)[1] for s in sums]
    gram, target = np.stack([c[:-1, :-1] for c in both]), np.stack([c[:-1, -1] for c in both])
    share = np.array(shares)[:, None]
    most = np.abs(target[-1]).max(initial=0) / share[:, 0]
    alphas = most[:, None] * np.logspace(0, np.log10(least), steps)
    w = np.zeros((len(shares), len(sums), gram.shape[1]))
    out = np.zeros((len(shares), steps, *w.shape[1:]))
    size = np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0)
    for k in range(steps):
        alpha = alphas[:, k, None]
        for _ in range(rounds):
            before = w.copy()
            for j in range(w.shape[2]):
                pull = target[:, j] - (gram[:, j] * w).sum(2) + size[:, j] * w[:, :, j]
                w[:, :, j] = np.where(size[:, j] > 0, np.sign(pull) * np.maximum(np.abs(pull) - alpha * share, 0) / np.maximum(size[:, j] + alpha * (1 - share), 1e-300), 0)
            if np.abs((w - before) * np.sqrt(size)).max(initial=0) < 1e-12:
                break
        out[:, k] = w
    return alphas, out


def elastic_net(df: DataFrame, features: list[str], label: str, day: str, order: list[str], shares=SHARES, folds: int = 5, steps: int = 100) -> DataFrame:
    """(l1_share, alpha, feature, weight, mse): the net of the share and alpha with the least mean error over expanding time folds, features of weight 0 left out.

    Fold k is tried on what was learnt from all folds before it.  Rows with a NULL take no part; without rows the result is empty.
    """
    rows = time_folds(df.dropna(subset=[*features, label, day]), day, order, folds)
    sums = as_matrices(products(rows, [*features, label], "fold"), len(features) + 1, folds + 1)
    kind = "l1_share double, alpha double, feature string, weight double, mse double"
    if not sums[:, 0, 0].sum():
        return df.sparkSession.createDataFrame([], kind)
    train = np.stack([*(sums[:k].sum(0) for k in range(1, folds + 1)), sums.sum(0)])
    alphas, weights = paths(train, shares, steps)
    error = np.full((len(shares), steps), 0.0)
    tried = [k for k in range(folds) if sums[k + 1, 0, 0] and train[k, 0, 0]]
    for k in tried:
        mean, _ = _centred(train[k])
        w = weights[:, :, k]
        v = np.concatenate([-(mean[-1] - w @ mean[:-1])[..., None], -w, np.ones((*w.shape[:2], 1))], 2)
        error += ((v @ sums[k + 1]) * v).sum(2) / sums[k + 1, 0, 0] / len(tried)
    s, k = np.unravel_index(error.argmin(), error.shape)
    best = [(float(shares[s]), float(alphas[s, k]), f, float(w), float(error[s, k])) for f, w in zip(features, weights[s, k, -1], strict=True) if w]
    return df.sparkSession.createDataFrame(best, kind)


def bordered_ridges(sums: np.ndarray, base: int, alpha: float = 1.0) -> list[tuple[np.ndarray, float, int]]:
    """(weights, intercept, column) of the ridges over the first ``base`` columns and each one after them; the label is the last column.

    The base's Cholesky factor is made once, and each candidate adds one row to it.
    """
    n = sums[0, 0]
    mean, cov = _centred(sums)
    gram, target = cov[:-1, :-1] * n, cov[:-1, -1] * n
    low = np.linalg.cholesky(gram[:base, :base] + alpha * np.eye(base))
    y = np.linalg.solve(low, target[:base]) if base else np.zeros(0)
    out = []
    for c in range(base, len(target)):
        side = np.linalg.solve(low, gram[:base, c]) if base else np.zeros(0)
        corner = np.sqrt(max(gram[c, c] + alpha - side @ side, 1e-300))
        last = (target[c] - side @ y) / corner / corner
        w = np.append(np.linalg.solve(low.T, y - side * last) if base else np.zeros(0), last)
        used = [*range(base), c]
        out.append((w, float(mean[-1] - w @ mean[used]), c))
    return out


def candidate_predictions(train: DataFrame, test: DataFrame, base: list[str], candidates: list[str], label: str, alpha: float = 1.0) -> DataFrame:
    """The rows of ``test`` once a candidate, with candidate and prediction: ridges over the base and that candidate, from one pass over ``train``."""
    columns = [*base, *candidates]
    sums = as_matrices(products(train.dropna(subset=[*columns, label]), [*columns, label]), len(columns) + 1)[0]
    each = []
    for w, b, c in bordered_ridges(sums, len(base), alpha):
        p = F.lit(b)
        for name, weight in zip([*base, columns[c]], w.tolist(), strict=True):
            p = p + F.col(f"`{name}`") * weight
        each.append(F.struct(F.lit(columns[c]).alias("candidate"), p.alias("prediction")))
    return test.dropna(subset=[*columns, label]).select("*", F.inline(F.array(*each)))


def quantile_classes(df: DataFrame, keys: list[str], value: str, q: float = 0.05) -> DataFrame:
    """``df`` with signal: 1 above a key's upper quantile of ``value`` (linear interpolation), 2 below its lower one, else 0.

    Told by how many rows of the key are below a value, and how many at most equal; these counts are shared by equal values.
    """
    at = evaluate.value_ranks(df, keys, value, count="_n").withColumn("_below", F.col("rank") - (F.col("_n") + 1) / 2)
    size = df.groupBy(*keys).agg(F.count(value).alias("_all"))
    at = at.join(F.broadcast(size), keys)  # a row a key
    high, low = (1 - q) * (F.col("_all") - 1), q * (F.col("_all") - 1)
    above = F.col("_below") >= F.floor(high) + 1
    under = F.col("_below") + F.col("_n") <= F.floor(low) + F.when(low > F.floor(low), 1).otherwise(0)
    at = at.select(*keys, value, F.when(above, 1).when(under, 2).otherwise(0).alias("signal"))
    return df.join(at, [*keys, value], "left")


def incremental_test(train: DataFrame, test: DataFrame, base: list[str], candidates: list[str], label: str, key: str, day: str, order: list[str], alpha: float = 1.0, q: float = 0.05, hold: int = 5, tick: float = 0.02) -> DataFrame:
    """(candidate, ic, long, short, net_value) of each candidate beside the base, over ``test`` (with quotes ap1, bp1 of the trade).

    Correlation of prediction and label, mean label above the upper and below the lower quantile of predictions, and
    the product of the days' returns of holding these classes for ``hold`` rows.
    """
    made = quantile_classes(candidate_predictions(train, test, base, candidates, label, alpha), ["candidate"], "prediction", q)
    part = lambda k: F.avg(F.when(F.col("signal") == k, F.col(label)))
    means = made.groupBy("candidate").agg(evaluate.guarded_corr("prediction", label).alias("ic"), part(1).alias("long"), part(2).alias("short"))
    held = backtest.held_positions(made.select("candidate", key, day, *order, "signal", "ap1", "bp1"), ["candidate", key], day, order, hold=hold)
    days = backtest.tick_pnl(held, ["candidate", key, day], order, tick).groupBy("candidate", key, day)
    days = days.agg((F.sum("pnl") * tick / F.min_by(F.col("ap1") / 2 + F.col("bp1") / 2, F.struct(*order))).alias("r"))
    net = days.groupBy("candidate").agg(F.exp(F.sum(F.when(F.col("r") > -1, F.log1p("r")))).alias("_grown"), F.min("r").alias("_worst"))
    net = net.select("candidate", F.when(F.col("_worst") <= -1, 0.0).otherwise(F.col("_grown")).alias("net_value"))
    return means.join(net, "candidate")


def kept_candidates(results: DataFrame, least: float) -> DataFrame:
    """Candidates whose net value is over ``least``, the best first."""
    return results.where(F.col("net_value") > least).orderBy(F.desc("net_value"), "candidate")
