"""Readers and cleaning of tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = range(1, 6)
PRICES = [f"{side}{i}" for side in ("ap", "bp") for i in LEVELS]

#: One row of the order book, five levels; volume and turnover are cumulative within a day.
TICKS = T.StructType(
    [T.StructField("contract", T.StringType()), T.StructField("trade_day", T.DateType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()), T.StructField("last", T.DoubleType())]
    + [T.StructField(f"{c}{i}", T.DoubleType()) for c in ("ap", "bp", "av", "bv") for i in LEVELS]
    + [T.StructField(c, T.DoubleType()) for c in ("volume", "turnover", "openinterest")]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV files with a header and a known schema, the file's name in ``path``."""
    return spark.read.csv(path, header=True, schema=schema).withColumn("path", F.input_file_name())


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of Parquet files; the scan reads no others."""
    return spark.read.parquet(path).select(*[F.col(f"`{c}`") for c in columns])


def date_of(path: Column | str) -> Column:
    """The date that a file's name holds as eight digits (20YYMMDD)."""
    return F.try_to_timestamp(F.regexp_extract(path, r"(20\d{6})(?!.*20\d{6})", 1), F.lit("yyyyMMdd")).cast("date")


def newest_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """One path a date: the last by name."""
    return paths.withColumn("trade_day", date_of(F.col(path))).where("trade_day IS NOT NULL").groupBy("trade_day").agg(F.max(path).alias("path"))


def since(df: DataFrame, day: str, column: str = "trade_day") -> DataFrame:
    """Rows from ``day`` on; on a table partitioned by the column only those partitions are read."""
    return df.where(F.col(column) >= F.lit(day).cast("date"))


def seconds_of(clock: Column | str) -> Column:
    """Seconds of a day of ``HH:MM[:SS]``; what can't be read counts as 0."""
    part = F.split(clock, ":")
    number = lambda i: F.coalesce(F.try_element_at(part, F.lit(i + 1)).try_cast("int"), F.lit(0))
    readable = F.try_element_at(part, F.lit(1)).try_cast("int").isNotNull() & F.try_element_at(part, F.lit(2)).try_cast("int").isNotNull()
    return F.when(readable, number(0) * 3600 + number(1) * 60 + number(2)).otherwise(0)


def timestamp_from_text(day: Column, clock: Column, ms: Column) -> Column:
    """Day, time and milliseconds as text put together and parsed; NULL where that fails."""
    text = F.concat(day.cast("string"), F.lit(" "), clock, F.lit("."), F.lpad(ms.cast("string"), 3, "0"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))).cast("timestamp_ntz")


def timestamp_from_parts(day: Column, clock: Column, ms: Column) -> Column:
    """A day (yyyymmdd) plus the seconds of a clock text and milliseconds; unreadable clocks count as midnight."""
    start = F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=(seconds_of(clock) + F.coalesce(ms, F.lit(0)) / 1000).cast("decimal(18,6)"))


def add_milliseconds(ts: Column, ms: Column) -> Column:
    return ts + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def contract_code(code: Column | str) -> Column:
    """A calendar's contract without its four-letter exchange suffix, in lower case."""
    code = F.col(code) if isinstance(code, str) else code
    return F.lower(F.substring(code, 1, F.greatest(F.length(code) - 4, F.lit(0))))


def roll_calendar(df: DataFrame, start: str = "2020-01-01", end: str = "2024-11-20") -> DataFrame:
    """(trade_day, contract) of the main contract by day."""
    return df.select(F.col("date").cast("date").alias("trade_day"), contract_code("contract").alias("contract")).where(F.col("trade_day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def main_contract(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Ticks of the day's main contract."""
    return ticks.join(calendar.select("trade_day", "contract"), ["trade_day", "contract"], "left_semi")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL in all floating columns."""
    inf = F.lit(float("inf"))
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(f"`{c}`")) < inf), F.col(f"`{c}`")).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def mid_price(ap: str = "ap1", bp: str = "bp1") -> Column:
    """The middle of the best quotes; of a one-sided book the side that is there."""
    a, b = F.col(ap), F.col(bp)
    return F.when(a == 0, b).when(b == 0, a).otherwise((a + b) / 2)


def zero_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns or [p for p in PRICES if p in df.columns]})


def multiplier_of(path: Column) -> Column:
    """A contract's multiplier by the product that a path names: au 1000, ag 15, else 1."""
    p = F.lower(path)
    return F.when(F.contains(p, F.lit("au")), 1000).when(F.contains(p, F.lit("ag")), 15).otherwise(1)


def write_days(df: DataFrame, path: str, day: str = "trade_day") -> None:
    """Snappy Parquet by day, doubles narrowed to floats."""
    narrow = df.select(*[F.col(f"`{c}`").cast("float").alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
    narrow.repartition(day).write.partitionBy(day).parquet(path, mode="overwrite", compression="snappy")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; timestamps to the microsecond."""
    df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path, header=True, mode="overwrite")


def read_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of files that hold a day's columns as arrays of one length; ``place`` is where they stand in them."""
    days = spark.read.parquet(path)
    others = [c for c in days.columns if c not in columns]
    zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in columns])
    return days.select(*others, F.posexplode(zipped).alias("place", "_row")).select(*others, "place", *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def factor_columns(df: DataFrame, prefix: str = "f_") -> list[str]:
    """Names of numeric columns with the prefix."""
    return [f.name for f in df.schema if f.name.startswith(prefix) and isinstance(f.dataType, T.NumericType)]


def distinct_columns(df: DataFrame) -> DataFrame:
    """The first of columns with the same name."""
    names = list(dict.fromkeys(df.columns))
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))]).select(*[F.col(f"_{k}").alias(n) for k, n in zip(at, names, strict=True)])
