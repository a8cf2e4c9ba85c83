"""Models over factor tables: ridge by normal equations, boosted trees, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ridge(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> dict:
    """Coefficients and intercept; the sums of products come from one pass, the small system is solved here."""
    rows = df.dropna(subset=[*features, label])
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    n = len(columns)
    sums = rows.agg(*[F.sum(columns[i] * columns[j]).alias(f"_{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    g = np.array([[sums[f"_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    count, mean = max(g[0, 0], 1.0), g[0, 1:] / max(g[0, 0], 1.0)
    centred = g[1:, 1:] - count * np.outer(mean, mean)
    weights = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(n - 2), centred[:-1, -1])
    return {"features": features, "weights": weights.tolist(), "intercept": float(mean[-1] - mean[:-1] @ weights)}


def save_model(spark, model: dict, path: str) -> None:
    """A model of numbers and names as one line of JSON."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def apply_linear(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    out = F.lit(model["intercept"])
    for f, w in zip(model["features"], model["weights"], strict=True):
        out = out + F.col(f) * w
    return df.withColumn(name, out)


def gbt(df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 5, seed: int = 0):
    """A boosted-tree model and its (feature, gain) table."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[*features, label]))
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(rows)
    gains = model.featureImportances.toArray().tolist()
    return model, df.sparkSession.createDataFrame(list(zip(features, gains, strict=True)), "feature string, gain double")


def normalised_importance(df: DataFrame, gain: str) -> DataFrame:
    """``df`` (a row a feature) with gain_normalized, its share of the sum."""
    total = df.agg(F.sum(gain).alias("_t"))
    return df.crossJoin(F.broadcast(total)).withColumn("gain_normalized", F.try_divide(F.col(gain), F.col("_t"))).drop("_t")  # one row


def important(df: DataFrame, gain: str = "gain_normalized", top: int | None = None, over: float | None = None) -> DataFrame:
    """The first ``top`` features by gain, or those over a gain."""
    return df.orderBy(F.desc(gain), "feature").limit(top) if top else df.where(F.col(gain) > over)


def score(df: DataFrame, features: list[str], predict: Callable[[np.ndarray], np.ndarray], name: str = "prediction") -> DataFrame:
    """``df`` with a Python model's predictions, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield b.assign(**{name: pd.Series(np.asarray(predict(b[features].to_numpy(dtype=float)), dtype=float), index=b.index)})

    return df.mapInPandas(run, schema)


def rank_of(df: DataFrame, score_column: str, keys: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score_column))))
