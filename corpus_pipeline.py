"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last
return the columns of ``docs``, whatever their names; the last returns where each piece of each document is
packed.

Null and empty texts are scored like any other; those that stay are no near-duplicates, hold no benchmark
windows and no secrets, and are packed as their end id alone.  Texts of any length are taken whole.  Of equal
texts one row stays; rows without doc_id are judged by their texts.  Empty tables give an empty result, and
without labels of both classes every document has the same score: all stay, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, written
from tickloom.llm.decontaminate import decontaminate
from tickloom.llm.minhash import one_of_each_group
from tickloom.llm.packing import pack, pieces
from tickloom.llm.quality import good_documents, train
from tickloom.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones not held out, scores as good."""
    return good_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8."""
    return one_of_each_group(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 ids."""
    return pack(written(pieces(docs), "pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("without_benchmark", without_benchmark), ("without_secrets", without_secrets), ("packed", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
