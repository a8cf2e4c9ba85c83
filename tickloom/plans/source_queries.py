"""Queries over written and read copies of the events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources import ticks as sources
from .tables import TICKS_SQL, ticks, view, work_folder

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return keep


@query("source_csv", "SELECT event_id, event_type, ts, round(value, 6) AS value FROM events")
def source_csv(spark, sf_dir):
    """Written as CSV and read with the known schema."""
    path = f"{work_folder(spark)}/csv"
    events = view(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    sources.write_csv(events, path)
    return sources.read_csv(spark, path, events.schema).select("event_id", "event_type", "ts", F.round("value", 6).alias("value"))


@query("source_days", f"SELECT event_id, trade_day, last, bv1 FROM ({TICKS_SQL}) WHERE trade_day >= (SELECT min(CAST(ts AS DATE)) + 3 FROM events)")
def source_days(spark, sf_dir):
    """Written by day, doubles as floats; from the fourth day on, only those partitions and columns are read."""
    path = f"{work_folder(spark)}/days"
    t = ticks(spark, sf_dir)
    sources.write_days(t, path)
    first = t.agg(F.date_add(F.min("trade_day"), 3)).first()[0]
    days = sources.read_columns(spark, path, ["event_id", "trade_day", "last", "bv1"])
    return sources.since(days, str(first)).select("event_id", "trade_day", F.col("last").cast("double").alias("last"), F.col("bv1").cast("double").alias("bv1"))


@query("source_arrays", f"SELECT contract, trade_day, CAST(row_number() OVER (PARTITION BY contract, trade_day ORDER BY ts, event_id) - 1 AS INTEGER) AS place, event_id, last FROM ({TICKS_SQL})")
def source_arrays(spark, sf_dir):
    """Written as a row of arrays a contract and day, and read back as rows."""
    path = f"{work_folder(spark)}/arrays"
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "last")))
    days = ticks(spark, sf_dir).groupBy("contract", "trade_day").agg(rows.alias("r")).select("contract", "trade_day", F.col("r.event_id").alias("event_id"), F.col("r.last").alias("last"))
    days.write.parquet(path)
    return sources.read_arrays(spark, path, ["event_id", "last"]).select("contract", "trade_day", "place", "event_id", "last")


@query("source_feather", f"SELECT event_id, trade_day, last, bv1 FROM ({TICKS_SQL})")
def source_feather(spark, sf_dir):
    """Written as Feather files; of their columns four are read back."""
    path = f"{work_folder(spark)}/feather"
    files.write_files(ticks(spark, sf_dir), "feather", path)
    return files.read_files(spark, "feather", path, ["event_id", "trade_day", "last", "bv1"])


@query("source_npz", f"SELECT event_id, last, bv1, ap5 FROM ({TICKS_SQL})")
def source_npz(spark, sf_dir):
    """Written as arrays, the book as one with an axis of levels, and read back as rows."""
    path = f"{work_folder(spark)}/npz"
    book = F.array(*[F.array(f"ap{i}", f"bv{i}") for i in range(1, 6)]).alias("book")
    files.write_files(ticks(spark, sf_dir).select("event_id", "last", "volume", book), "npz", path)
    back = files.read_files(spark, "npz", path, ["book", "event_id", "last"])
    return back.select("event_id", "last", F.col("book")[0][1].alias("bv1"), F.col("book")[4][0].alias("ap5"))


_CLOCK = "CASE WHEN event_id % 7 = 0 THEN strftime(ts, '%H:%M') WHEN event_id % 11 = 0 THEN 'x' ELSE strftime(ts, '%H:%M:%S') END"


@query(
    "source_timestamps",
    f"""SELECT event_id, date_trunc('millisecond', ts) AS from_text, date_trunc('day', ts) + CASE WHEN event_id % 7 = 0 THEN to_minutes(hour(ts) * 60 + minute(ts)) WHEN event_id % 11 = 0 THEN to_minutes(0) ELSE to_seconds(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT)) END + to_milliseconds(CAST(millisecond(ts) % 1000 AS BIGINT)) AS from_parts,
date_trunc('second', ts) + to_milliseconds(CAST(millisecond(ts) % 1000 AS BIGINT)) AS from_second FROM events""",
)
def source_timestamps(spark, sf_dir):
    """Times put together from text, from a day and a clock (some without seconds, some unreadable), and from seconds and milliseconds."""
    e = view(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    ms = F.date_format("ts", "SSS").cast("int")
    clock = F.when(F.col("event_id") % 7 == 0, F.date_format("ts", "HH:mm")).when(F.col("event_id") % 11 == 0, "x").otherwise(F.date_format("ts", "HH:mm:ss"))
    return e.select(
        "event_id",
        sources.timestamp_from_text(F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HH:mm:ss"), ms).alias("from_text"),
        sources.timestamp_from_parts(F.date_format("ts", "yyyyMMdd"), clock, ms).alias("from_parts"),
        sources.add_milliseconds(F.date_trunc("second", "ts").cast("timestamp_ntz"), ms).alias("from_second"),
    )


@query(
    "source_newest_files",
    "SELECT CAST(ts AS DATE) AS trade_day, 'in/' || strftime(CAST(ts AS DATE), '%Y%m%d') || '_v' || max(event_id % 4) || '.csv' AS path FROM events GROUP BY CAST(ts AS DATE)",
)
def source_newest_files(spark, sf_dir):
    """Of files of one date the last by name."""
    names = view(spark, sf_dir, "events").select(F.concat(F.lit("in/"), F.date_format("ts", "yyyyMMdd"), F.lit("_v"), (F.col("event_id") % 4).cast("string"), F.lit(".csv")).alias("path"))
    return sources.newest_files(names).select("trade_day", "path")


@query(
    "source_main_contract",
    f"""WITH n AS (SELECT trade_day, contract, count(*) AS c FROM ({TICKS_SQL}) GROUP BY 1, 2), m AS (SELECT trade_day, max_by(contract, (c, contract)) AS contract FROM n GROUP BY 1)
SELECT t.event_id, t.trade_day, t.contract FROM ({TICKS_SQL}) t JOIN m ON t.trade_day = m.trade_day AND t.contract = m.contract""",
)
def source_main_contract(spark, sf_dir):
    """Ticks of each day's main contract, by a calendar that names it with an exchange's suffix."""
    t = ticks(spark, sf_dir)
    main = t.groupBy("trade_day", "contract").agg(F.count("*").alias("c")).groupBy("trade_day").agg(F.max_by("contract", F.struct("c", "contract")).alias("contract"))
    calendar = sources.roll_calendar(main.select(F.col("trade_day").alias("date"), F.concat(F.upper("contract"), F.lit(".SHF")).alias("contract")), "1990-01-01", "2100-01-01")
    return sources.main_contract(t, calendar).select("event_id", "trade_day", "contract")


@query(
    "source_cleaning",
    f"""SELECT event_id, if(event_id % 5 = 0, 0, ap1) * if(event_id % 7 = 0, NULL, 1) AS ask0, nullif(if(event_id % 5 = 0, 0, ap1), 0) AS ap1, nullif(if(event_id % 3 = 0, 0, bp1), 0) AS bp1, CASE WHEN event_id % 5 = 0 THEN if(event_id % 3 = 0, 0, bp1) WHEN event_id % 3 = 0 THEN ap1 ELSE (ap1 + bp1) / 2 END AS mid,
if(event_id % 13 = 0, NULL, last) AS last, CASE WHEN contract = 'click' THEN 1000 WHEN contract = 'view' THEN 15 ELSE 1 END AS multiplier FROM ({TICKS_SQL})""",
)
def source_cleaning(spark, sf_dir):
    """One-sided books, zeros and non-finite values made NULL, mids of the side that is there, multipliers by product."""
    made = {"ap1": "CASE WHEN event_id % 5 = 0 THEN 0D ELSE ap1 END", "bp1": "CASE WHEN event_id % 3 = 0 THEN 0D ELSE bp1 END", "last": "CASE WHEN event_id % 26 = 0 THEN double('NaN') WHEN event_id % 13 = 0 THEN double('Infinity') ELSE last END"}
    t = ticks(spark, sf_dir).withColumns({k: F.expr(v) for k, v in made.items()})
    t = t.withColumn("ask0", F.when(F.col("event_id") % 7 != 0, F.col("ap1"))).withColumn("mid", sources.mid_price())
    product = F.concat(F.lit("in/"), F.when(F.col("contract") == "click", "AU2512").when(F.col("contract") == "view", "ag2512").otherwise("x"))
    clean = sources.zero_to_null(sources.without_nan(t), ["ap1", "bp1"])
    return clean.select("event_id", "ask0", "ap1", "bp1", "mid", "last", sources.multiplier_of(product).alias("multiplier"))
