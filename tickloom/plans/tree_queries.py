"""Queries of boosted trees grown leaf by leaf; no SQL, as they are iterative (tests hold them against plain versions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from .analysis_queries import _FACTORS as FACTOR_NAMES, _SPLIT as SPLIT_DAY, matrix
from .tables import work_folder


def _model(spark, m):
    folder = f"{work_folder(spark)}/trees"
    return trees.best_trees(trees.boosted(m, FACTOR_NAMES, "label", F.col("l_shipdate") >= F.lit(SPLIT_DAY).cast("date"), folder, rounds=12, most_leaves=15, rate=0.2, patience=5))


def leafwise_importance(spark, sf_dir):
    """Gain, its share and number of splits of each feature, of the trees up to the least error on later days."""
    model = _model(spark, matrix(spark, sf_dir))
    rows = trees.importance(model)
    whole = sum(g for _, g, _ in rows) or 1.0
    return spark.createDataFrame([(f, g, g / whole, s, model["best"]) for f, g, s in rows], "feature string, gain double, gain_normalized double, split long, trees long")


def tree_shap(spark, sf_dir):
    """Each row's prediction and what each feature adds to it."""
    m = matrix(spark, sf_dir)
    model = _model(spark, m)
    out = trees.explained(trees.predicted(m, model), model)
    return out.select("l_orderkey", "l_linenumber", "prediction", *[f"shap_{f}" for f in FACTOR_NAMES], "shap_expected")


QUERIES = {"leafwise_importance": leafwise_importance, "tree_shap": tree_shap}
ORACLE: dict[str, str] = {}
