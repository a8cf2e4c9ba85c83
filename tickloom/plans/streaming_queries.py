"""Queries that run as streams, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..streaming import ticks as streaming
from .tables import TICKS_SQL, ticks, view, work_folder


def streaming_bars(spark, sf_dir):
    """Hourly bars of events by type, computed by Structured Streaming.

    The table may be one file or a folder of them; rows of any file may be as late as the table spans.
    """
    events = view(spark, sf_dir, "events")
    one_file = any(f.endswith("/events.parquet") for f in events.inputFiles())
    folder, name = (sf_dir, "events.parquet") if one_file else (f"{sf_dir}/events.parquet", "*.parquet")
    days = events.agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0] or 0
    stream = streaming.read_files(spark, folder, events.schema, name).withColumn("ts", F.col("ts").cast("timestamp"))
    bars = streaming.bars(stream, ["event_type"], "ts", "value", late=f"{days + 1} days", ties=("event_id",))
    last = streaming.latest(streaming.run_to_table(bars, work_folder(spark), "update"), ["window", "event_type"])
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "first", "last", "high", "low")


def _frames(rows):
    side = lambda c: sum(rows[f"{c}v{i}"] for i in range(1, 6))
    imbalance = (side("b") - side("a")) / (side("b") + side("a"))
    return pd.DataFrame({"oi_ma_120": imbalance.rolling(120).mean(), "oi_ma_600": imbalance.rolling(600).mean(), "high_1200": rows["last"].rolling(1200, 1).max(), "low_60": rows["last"].rolling(60, 1).min()})


def streaming_frames(spark, sf_dir):
    """Factors over up to 1,200 ticks of a contract, worked out as the ticks come in, a third of the days at a time.

    The stream is stopped and started again for each third; frames reach back over that by the state.
    """
    folder = work_folder(spark)
    t = ticks(spark, sf_dir)
    days = t.agg(F.min("trade_day").alias("a"), F.date_diff(F.max("trade_day"), F.min("trade_day")).alias("n")).first()
    third = F.least(F.floor(F.date_diff("trade_day", F.lit(days.a)) * 3 / ((days.n or 0) + 1)), F.lit(2))
    columns = ["last", *[f"{c}v{i}" for i in range(1, 6) for c in "ab"]]
    for k in range(3):
        t.where(third == k).select("contract", "ts", "event_id", *columns).write.mode("append").parquet(f"{folder}/in")
        stream = streaming.read_files(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, per_trigger=1_000_000)  # all of a third in one batch
        framed = streaming.frames(stream, "contract", ["ts", "event_id"], columns, 1199, _frames, "oi_ma_120 double, oi_ma_600 double, high_1200 double, low_60 double", ["event_id"])
        out = streaming.run_to_table(framed, folder, name="frames")
    return out.select("event_id", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 7).alias(c) for c in ("oi_ma_120", "oi_ma_600", "high_1200", "low_60")])


def _frames_sql() -> str:
    over = lambda k: f"OVER (PARTITION BY contract ORDER BY ts, event_id ROWS {k - 1} PRECEDING)"
    side = lambda c: f"({' + '.join(f'{c}v{i}' for i in range(1, 6))})"
    means = [f"round(CASE WHEN count(*) {over(k)} = {k} THEN avg(x) {over(k)} END, 7) AS oi_ma_{k}" for k in (120, 600)]
    return f"SELECT event_id, {', '.join(means)}, max(last) {over(1200)} AS high_1200, min(last) {over(60)} AS low_60 FROM (SELECT *, ({side('b')} - {side('a')}) / ({side('b')} + {side('a')}) AS x FROM ({TICKS_SQL}))"


QUERIES = {"streaming_bars": streaming_bars, "streaming_frames": streaming_frames}
ORACLE = {
    "streaming_frames": _frames_sql(),
    "streaming_bars": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2"
}
