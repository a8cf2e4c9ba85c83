"""Evaluation of factors and predictions: correlations, quantile buckets, threshold sweeps, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over rows that hold both; NULL where either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)))


def information_coefficients(df: DataFrame, factors: list[str], label: str) -> DataFrame:
    """(factor, ic) of each factor with the label, in one pass."""
    one = df.agg(*[guarded_corr(f, label).alias(f) for f in factors])
    return one.unpivot([], factors, "factor", "ic")


def correlation_matrix(df: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, r) for all pairs a < b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    one = df.agg(*[guarded_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def daily_ic(df: DataFrame, day: str, factor: str, label: str) -> DataFrame:
    """(mean_ic, icir, days): mean of the days' correlations, and that over their deviation."""
    days = df.groupBy(day).agg(guarded_corr(factor, label).alias("ic"))
    return days.agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.count("ic").alias("days"))


def exact_quantiles(df: DataFrame, column: str, qs: list[float], accuracy: int = 10_000) -> DataFrame:
    """One row (q0, q1, ...): quantiles by linear interpolation, NULL without values.

    A sketch gives a short stretch of values that holds each; only the values inside (about 4 / ``accuracy`` of
    the rows) are counted and put in order.  The sketch's bounds and the counts below them, one row, come to
    the driver.
    """
    x = F.col("_x")
    rows = df.select(F.col(column).cast("double").alias("_x")).where(x.isNotNull())
    n = rows.count()
    if not n:
        return rows.agg(*[F.max("_x").alias(f"q{i}") for i in range(len(qs))])
    slack = 2 / accuracy + 1 / n
    bounds = rows.agg(F.percentile_approx("_x", [p for q in qs for p in (max(q - slack, 0.0), min(q + slack, 1.0))], accuracy).alias("p")).first().p
    pairs = list(zip(bounds[::2], bounds[1::2], strict=True))
    below = rows.agg(*[F.count_if(x < lo).alias(f"b{i}") for i, (lo, _) in enumerate(pairs)]).first()
    near = rows.select("_x", F.explode(F.array_compact(F.array(*[F.when(x.between(lo, hi), i) for i, (lo, hi) in enumerate(pairs)]))).alias("_i"))
    counts = near.groupBy("_i", "_x").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("_i").orderBy("_x")))
    at = lambda i, rank: F.min(F.when((F.col("_i") == i) & (F.col("_upto") > rank - below[i]), x))
    out = []
    for i, q in enumerate(qs):
        rank = q * (n - 1)
        low, high = at(i, int(rank)), at(i, min(int(rank) + 1, n - 1))
        out.append((low + (high - low) * (rank - int(rank))).alias(f"q{i}"))
    return counts.agg(*out)


def value_ranks(df: DataFrame, keys: list[str], column: str, parts: int = 64, count: str | None = None, weight: str | None = None) -> DataFrame:
    """(keys, column, rank): the mean rank, from 1, of the rows of each value; ``count`` names a column for their number.

    With ``weight`` a row stands for so many.

    Values go to ``parts`` stretches of a key, cut by a sketch; ranks add up from the stretches' counts.
    """
    counts = df.groupBy(*keys, column).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    before = sizes.select(*keys, "_part", (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")).alias("_before"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(column))
    more = [F.col("_n").alias(count)] if count else []
    return placed.join(before, [*keys, "_part"]).select(*keys, column, (upto - (F.col("_n") - 1) / 2).alias("rank"), *more)


def rank_ic(df: DataFrame, keys: list[str], factor: str, label: str) -> DataFrame:
    """Spearman's correlation of each key's rows that hold both."""
    full = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(factor).alias("_a"), F.col(label).alias("_b"))
    # equal rows are one row: a value that many rows hold is no task of its own, and ranks are joined to fewer rows
    cells = full.groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_w"))
    ranked = cells.join(value_ranks(cells, keys, "_a", weight="_w").withColumnRenamed("rank", "_f"), [*keys, "_a"]).join(value_ranks(cells, keys, "_b", weight="_w").withColumnRenamed("rank", "_l"), [*keys, "_b"])
    n = F.sum("_w")
    # mean ranks are (n + 1) / 2 always
    spread = lambda x, y: F.sum(F.col("_w") * F.col(x) * F.col(y)) - n * ((n + 1) / 2) ** 2
    flat = (F.max("_f") == F.min("_f")) | (F.max("_l") == F.min("_l"))
    return ranked.groupBy(*keys).agg(F.when(~flat, F.try_divide(spread("_f", "_l"), F.sqrt(spread("_f", "_f")) * F.sqrt(spread("_l", "_l")))).alias("rank_ic"))


def tail_means(df: DataFrame, factor: str, label: str, q: float = 0.05) -> DataFrame:
    """Mean label beyond the upper and lower quantile of the factor, and their difference."""
    cuts = exact_quantiles(df, factor, [1 - q, q]).toDF("_hi", "_lo")
    out = df.crossJoin(F.broadcast(cuts)).agg(F.avg(F.when(F.col(factor) > F.col("_hi"), F.col(label))).alias("top"), F.avg(F.when(F.col(factor) < F.col("_lo"), F.col(label))).alias("bottom"))  # one row
    return out.withColumn("long_short", F.col("top") - F.col("bottom"))


def bucket_of(value: Column, edges: Column) -> Column:
    """Number of the (lo, hi] bucket of ascending edges, the first closed below."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value)) + 1


def quantile_buckets(df: DataFrame, factor: str, label: str, n: int = 10) -> DataFrame:
    """(bucket, n, mean_label) by quantile edges of the factor; equal edges are merged."""
    rows = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    edges = exact_quantiles(rows, factor, [i / n for i in range(n + 1)])
    edges = edges.select(F.array_distinct(F.array(*edges.columns)).alias("_edges"))
    placed = rows.crossJoin(F.broadcast(edges)).select(bucket_of(F.col(factor), F.col("_edges")).alias("bucket"), label)  # one row
    return placed.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"))


def decile_table(df: DataFrame, factor: str, label: str) -> DataFrame:
    """One row D1 .. D10 and the spread D10 - D1; a missing decile is NULL."""
    b = quantile_buckets(df, factor, label, 10)
    return b.groupBy().pivot("bucket", list(range(1, 11))).agg(F.first("mean_label")).toDF(*[f"d{i}" for i in range(1, 11)]).withColumn("spread", F.col("d10") - F.col("d1"))


def top_bottom_spread(df: DataFrame, day: str, factor: str, label: str, order: list[str], q: float = 0.1) -> DataFrame:
    """(day, top, bottom, spread): mean label of each day's first and last int(n * q) rows by the factor."""
    w = Window.partitionBy(day)
    rows = df.where(F.col(factor).isNotNull()).select(day, label, F.row_number().over(w.orderBy(factor, *order)).alias("_r"), F.count("*").over(w).alias("_n")).withColumn("_k", F.floor(F.col("_n") * q))
    mean = lambda c: F.avg(F.when(c, F.col(label)))
    out = rows.groupBy(day).agg(mean(F.col("_r") > F.col("_n") - F.col("_k")).alias("top"), mean(F.col("_r") <= F.col("_k")).alias("bottom"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def _grid(thresholds: list[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))


def threshold_sweep(df: DataFrame, prediction: str, outcome: str, cost: Column | float, thresholds: list[float], scale: float = 15.0) -> DataFrame:
    """(threshold, signals, dq, dqr): buy above it, sell below its negative; dq = scale * net PnL, dqr = gains over losses.

    One pass: each row is held against the grid and summed up map-side. NULL predictions give no signal.
    """
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    rows = df.where(F.col(prediction).isNotNull() & F.col(outcome).isNotNull()).select(F.col(prediction).alias("_p"), F.col(outcome).alias("_y"), cost.alias("_c"), _grid(thresholds).alias("threshold"))
    pnl = F.when(F.col("_p") > F.col("threshold"), F.col("_y") - F.col("_c")).when(F.col("_p") < -F.col("threshold"), -F.col("_y") - F.col("_c"))
    sums = rows.select("threshold", pnl.alias("_x")).groupBy("threshold").agg(F.count("_x").alias("signals"), F.sum("_x").alias("_s"), F.sum(F.greatest("_x", F.lit(0.0))).alias("_g"), F.sum(F.greatest(-F.col("_x"), F.lit(0.0))).alias("_l"))
    return sums.select("threshold", "signals", (scale * F.coalesce("_s", F.lit(0.0))).alias("dq"), F.try_divide("_g", "_l").alias("dqr"))


def theo_price_sweep(df: DataFrame, thresholds: list[float], prediction: str = "prediction", future: str = "future", cost_bp: float = 0.5) -> DataFrame:
    """(threshold, buys, sells, pnl): theoretical prices (AP: ref - prediction, BP: ref + prediction) against quotes."""
    theo = F.when(F.col("site") == "AP", F.col("ref_price") - F.col(prediction)).otherwise(F.col("ref_price") + F.col(prediction))
    rows = df.where(F.col(prediction).isNotNull() & F.col(future).isNotNull()).select("ap1", "bp1", F.col(future).alias("_f"), theo.alias("_t"), _grid(thresholds).alias("threshold"))
    act = action(F.col("_t"), F.col("ap1"), F.col("bp1"), F.col("threshold"))
    fee = cost_bp / 10_000
    pnl = F.when(act == "buy", F.col("_f") - F.col("ap1") * (1 + fee)).when(act == "sale", F.col("bp1") * (1 - fee) - F.col("_f"))
    return rows.withColumn("_a", act).withColumn("_x", pnl).groupBy("threshold").agg(F.count(F.when(F.col("_a") == "buy", 1)).alias("buys"), F.count(F.when(F.col("_a") == "sale", 1)).alias("sells"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("pnl"))


def action(theo: Column, ask: Column, bid: Column, threshold: Column) -> Column:
    """buy above the ask plus, sale below the bid minus the threshold, else no_trade."""
    return F.when(theo > ask + threshold, "buy").when(theo < bid - threshold, "sale").otherwise("no_trade")


def horizon_pnl(df: DataFrame, prediction: str, horizons: list[str], q: float = 0.9) -> DataFrame:
    """(horizon, trades, pnl) of predictions over their quantile: BP buys at the ask, AP sells at the bid."""
    cut = exact_quantiles(df, prediction, [q]).toDF("_cut")
    rows = df.crossJoin(F.broadcast(cut)).where(F.col(prediction) > F.col("_cut"))  # one row
    stacked = rows.select("site", "ap1", "bp1", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).alias("future")) for h in horizons])).alias("x")).select("site", "ap1", "bp1", "x.*")
    pnl = F.when(F.col("site") == "BP", F.col("future") - F.col("ap1")).otherwise(F.col("bp1") - F.col("future"))
    return stacked.groupBy("horizon").agg(F.count(pnl).alias("trades"), F.sum(pnl).alias("pnl"))


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(mse, r2, ccc, pearson) from one pass of moments."""
    y, p = F.col(actual), F.col(predicted)
    m = df.where(y.isNotNull() & p.isNotNull()).agg(F.avg((y - p) ** 2).alias("mse"), F.var_pop(y).alias("_vy"), F.var_pop(p).alias("_vp"), F.covar_pop(y, p).alias("_c"), F.avg(y).alias("_my"), F.avg(p).alias("_mp"))
    return m.select("mse", (1 - F.try_divide("mse", "_vy")).alias("r2"), F.try_divide(2 * F.col("_c"), F.col("_vy") + F.col("_vp") + (F.col("_my") - F.col("_mp")) ** 2).alias("ccc"), F.try_divide(F.col("_c"), F.sqrt(F.col("_vy") * F.col("_vp"))).alias("pearson"))


def confusion(df: DataFrame, real: str, predicted: str) -> DataFrame:
    """(real, predicted, n, accuracy): counts, and the share that is right, overall."""
    total = df.groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    right = total.agg(F.try_divide(F.sum(F.when(F.col("real") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return total.crossJoin(F.broadcast(right))  # one row


def group_stats(df: DataFrame, keys: list[str], value: str, order: list[str], least: int = 10) -> DataFrame:
    """mean, std (population), range, skew, excess kurtosis, last - first, n; moments only of ``least`` rows or more."""
    v = F.col(value)
    first, last = F.min_by(value, F.struct(*order)), F.max_by(value, F.struct(*order))
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range"), F.when(F.count(v) >= least, F.skewness(v)).alias("skew"), F.when(F.count(v) >= least, F.kurtosis(v)).alias("kurt"), (last - first).alias("change"), F.count(v).alias("n")
    )


def volume_entropy(df: DataFrame, keys: list[str], price: str = "estimated_exec_price", volume: str = "delta_volume") -> DataFrame:
    """-sum p ln p of the volume's shares by price; NULL without volume."""
    w = Window.partitionBy(*keys)
    shares = df.groupBy(*keys, price).agg(F.sum(volume).alias("_v")).withColumn("_t", F.sum("_v").over(w)).withColumn("_p", F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")))
    return shares.groupBy(*keys).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p"))).alias("vol_entropy"))


def checkpoints(df: DataFrame, row: str, every: int = 120, window: int = 600, heads=(120, 240, 360, 480)) -> DataFrame:
    """Each row once for every checkpoint whose window [t - window, t) holds it; the first checkpoints look back to the start.

    ``row`` counts from 0. A row is copied window / every times, whatever the table's size.
    """
    r = F.col(row)
    first = (F.floor(r / every) + 1) * every
    later = F.transform(F.sequence(F.lit(0), F.lit(window // every - 1)), lambda i: first + i * every)
    early = F.array(*[F.lit(h) for h in heads if h < window])
    point = F.array_distinct(F.concat(F.filter(later, lambda t: t >= window), F.filter(early, lambda t: t > r)).cast("array<bigint>"))
    return df.withColumn("checkpoint", F.explode(point))


def ks_distance(df: DataFrame, value: str, log: bool = False) -> DataFrame:
    """(n, mean, std, distance): largest distance of a value's distribution from the fitted (log)normal."""
    x = F.ln(value) if log else F.col(value).cast("double")
    rows = df.where(F.col(value) > 0 if log else F.col(value).isNotNull()).groupBy(x.alias("_x")).agg(F.count("*").alias("_n"))
    fit = rows.agg(F.sum("_n").alias("n"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"), F.sqrt(F.sum(F.col("_x") ** 2 * F.col("_n")) / F.sum("_n") - (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")) ** 2).alias("std"))
    # distribution by ranges of values, so that no task holds all: counts before each range, then within it
    from ..functions.liquidity import normal_cdf

    spread = rows.crossJoin(F.broadcast(fit)).withColumn("_z", F.try_divide(F.col("_x") - F.col("mean"), "std")).withColumn("_b", F.floor(F.least(F.greatest(F.col("_z"), F.lit(-8.0)), F.lit(8.0)) * 16))  # one row
    sizes = spread.groupBy("_b").agg(F.sum("_n").alias("_size"))  # 257 at most
    before = sizes.select("_b", (F.sum("_size").over(Window.orderBy("_b")) - F.col("_size")).alias("_before"))
    cum = spread.join(F.broadcast(before), "_b").withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_b").orderBy("_x")))
    cdf = F.expr(normal_cdf("_z"))
    gap = F.greatest(F.abs(F.col("_upto") / F.col("n") - cdf), F.abs((F.col("_upto") - F.col("_n")) / F.col("n") - cdf))
    return cum.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("std").alias("std"), F.max(gap).alias("distance"))


def described(df: DataFrame, column: str) -> DataFrame:
    """One row (n, mean, std, low, q1, q2, q3, high)."""
    x = F.col(column)
    moments = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    return moments.crossJoin(exact_quantiles(df, column, [0.25, 0.5, 0.75]).toDF("q1", "q2", "q3"))  # one row each
