"""Feather and NPZ files there and back."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from tickloom.sources import files


def test_feather(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.lit(dt.date(2024, 1, 2)).alias("day"), F.array("id", "id").alias("a")).repartition(3)
    files.write_files(df, "feather", path)
    back = files.read_files(spark, "feather", path)
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())
    some = files.read_files(spark, "feather", path, ["s", "id"])
    assert some.columns == ["s", "id"] and some.where("s IS NULL").count() == 334
    files.write_files(df.limit(5), "feather", path, "append")
    assert files.read_files(spark, "feather", path).count() == 1005
    files.write_files(df.limit(5), "feather", path)
    assert files.read_files(spark, "feather", "file:" + path).count() == 5


def test_feather_of_pandas(spark, tmp_path):
    """Files that pandas writes, several record batches each; one task a batch."""
    for i in range(2):
        pa.feather.write_feather(pa.table({"x": np.arange(100) + 100 * i, "y": ["a"] * 100}), str(tmp_path / f"{i}.feather"), chunksize=30)
    df = files.read_files(spark, "feather", str(tmp_path), ["x"])
    assert df.rdd.getNumPartitions() == 8 and df.agg(F.sum("x")).first()[0] == 199 * 100
    pd.DataFrame({"x": pd.Series([], dtype="int64")}).to_feather(tmp_path / "0.feather")
    (tmp_path / "1.feather").rename(tmp_path / "_1.feather")
    assert files.read_files(spark, "feather", str(tmp_path)).count() == 0


def test_npz(spark, tmp_path, monkeypatch):
    np.savez(tmp_path / "a.npz", x=np.arange(9000), book=np.arange(36000.0).reshape(9000, 2, 2), name=np.array(["q"] * 9000))
    df = files.read_files(spark, "npz", str(tmp_path))
    assert df.dtypes == [("x", "bigint"), ("book", "array<array<double>>"), ("name", "string")]
    assert df.where("book[1][0] <> 4 * x + 2 OR name <> 'q'").count() == 0 and df.count() == 9000
    files.write_files(df.repartition(2), "npz", str(tmp_path / "out"))
    back = files.read_files(spark, "npz", str(tmp_path / "out"), ["book", "x"])
    assert sorted(back.collect()) == sorted(df.select("book", "x").collect())
    with pytest.raises(Exception, match="NULL"):
        files.write_files(spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("x")), "npz", str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.npz"))


def test_npz_pieces():
    np.testing.assert_array_equal(files._array("a", files._nested(np.arange(24).reshape(4, 3, 2))), np.arange(24).reshape(4, 3, 2))
    assert files._nested(np.zeros((3, 0))).to_pylist() == [[], [], []]
