"""The driver's tables as ticks and daily series, as a plan and as SQL of the same arithmetic.

Prices are whole cents, so quotes, volumes and turnovers are exact in any engine.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Sql
from ..functions.factors import TICK, compute, numbered, stages

LEVELS = range(1, 6)
_BOOK = ", ".join(
    f"CAST(last0 + {i} + event_id % 2 AS DOUBLE) AS ap{i}, CAST(last0 - {i} - event_id % 3 AS DOUBLE) AS bp{i}, CAST(1 + (event_id * {11 + i}) % 40 AS DOUBLE) AS av{i}, CAST(1 + (event_id * {7 + i}) % 40 AS DOUBLE) AS bv{i}" for i in LEVELS
)
_DAY = "PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
TICKS_SQL = f"""SELECT event_type AS contract, CAST(ts AS DATE) AS trade_day, ts, event_id, CAST(last0 AS DOUBLE) AS last, {_BOOK},
CAST(sum(1 + event_id % 50) OVER ({_DAY}) AS DOUBLE) AS volume, CAST(sum(last0 * (1 + event_id % 50)) OVER ({_DAY}) AS DOUBLE) AS turnover, CAST(1000 + event_id % 97 AS DOUBLE) AS openinterest, CAST(1 + event_id % 9 AS DOUBLE) AS ordercnt_bid1, CAST(1 + event_id % 7 AS DOUBLE) AS ordercnt_ask1
FROM (SELECT *, 10000 + CAST(round(value * 100) AS BIGINT) AS last0 FROM events)"""

DAILY_SQL = "SELECT o_orderdate AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM orders GROUP BY o_orderdate"


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; a temporary one where all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def view(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=view(spark, sf_dir, table))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, TICKS_SQL, "events")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, DAILY_SQL, "orders")


# a bar of BAR ticks at every BAR-th tick of a contract
BAR = 10
BARS = {
    "bar_high": lambda s: s.max("last", BAR),
    "bar_low": lambda s: s.min("last", BAR),
    "bar_open": lambda s: s.lag("last", BAR - 1),
    "bar_vol": lambda s: s.sum("delta_volume", BAR),
    "bar_turnover": lambda s: s.sum("delta_turnover", BAR),
    "bar_vwap": lambda s: s.div(s.sum("delta_volume * last", BAR), s.sum("delta_volume", BAR)),
    "bar_depth": lambda s: s.mean("effective_depth", BAR),
    "bar_inflow": lambda s: s.sum("net_inflow", BAR),
    "bar_bigorder": lambda s: s.sum("bigorder_volume", BAR),
    "bar_buy": lambda s: s.sum("buy_volume", BAR),
    "bar_sell": lambda s: s.sum("sell_volume", BAR),
    "bar_bigbuy": lambda s: s.sum("is_bigorder * buy_volume", BAR),
    "bar_bigsell": lambda s: s.sum("is_bigorder * sell_volume", BAR),
    "bar_range_share": lambda s: f"CASE WHEN delta_turnover > 0 THEN {s.div('bar_high - bar_low', 'delta_turnover')} END",
    "bar_elasticity": lambda s: s.mean("bar_range_share", BAR, 1),
}
BAR_COLUMNS = {
    "price": "last", "high": "bar_high", "low": "bar_low", "open": "bar_open", "vol": "bar_vol", "dollar_volume": "bar_turnover", "vwap": "bar_vwap", "openinterest": "openinterest", "depth": "bar_depth", "net_inflow": "bar_inflow",
    "bigorder_vol": "bar_bigorder", "buy_vol": "bar_buy", "sell_vol": "bar_sell", "bigbuy_vol": "bar_bigbuy", "bigsell_vol": "bar_bigsell", "elasticity": "bar_elasticity", "delta_turnover": "delta_turnover", "volume": "volume", "ap1": "ap1", "bp1": "bp1", "av1": "av1", "bv1": "bv1",
}
CONTRACT, ORDER = ["contract"], ["ts", "event_id"]
BOOK_COLUMNS = ["contract", "trade_day", "ts", "event_id", "last", *[f"{c}{i}" for i in LEVELS for c in ("ap", "bp", "av", "bv")], "volume", "turnover", "openinterest", "ordercnt_bid1", "ordercnt_ask1"]


def numbered_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with ``row_at``, each one's number among those of its contract."""
    return numbered(ticks(spark, sf_dir), CONTRACT, ["trade_day"], ORDER)


def bars(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The down-sampled table that minute factors stand on, with tick factors as they stand at its rows."""
    wide = compute(numbered_ticks(spark, sf_dir), {**TICK, **BARS}, [*BARS, "delta_turnover", *extra], CONTRACT, ORDER)
    kept = wide.where(f"row_at % {BAR} = {BAR - 1}").withColumn("row_at", F.floor(F.col("row_at") / BAR))
    return kept.select("contract", "trade_day", "ts", "event_id", "row_at", *extra, *[F.col(v).alias(k) for k, v in BAR_COLUMNS.items()])


def with_mean_volume(bars: DataFrame) -> DataFrame:
    """``bars`` with mean_vol, that of a contract's bars (one row a contract, which is joined)."""
    return bars.join(bars.groupBy("contract").agg(F.avg("vol").alias("mean_vol")), "contract")


def levelled(sql: str, book: dict[str, str], names, have, keys) -> str:
    """SQL that adds columns of a book of texts to ``sql``, those that others need first."""
    p = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(ORDER)}"
    for stage in stages({k: lambda _, v=v: v for k, v in book.items()}, names, have, Sql()):
        sql = "SELECT *, " + ", ".join(f"{t.replace('{P}', p)} AS {n}" for n, t in stage.items()) + f" FROM ({sql}) t"
    return sql
