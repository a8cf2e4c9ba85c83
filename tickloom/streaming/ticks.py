"""Tick features over streams: windowed bars with a watermark, and running state by instrument."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, folder: str, schema, name: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def bars(ticks: DataFrame, keys: list[str], ts: str, price: str, size: str = "1 hour", late: str = "10 minutes", ties: tuple[str, ...] = ()) -> DataFrame:
    """(window, keys, n, first, last, high, low) of event-time windows; rows later than ``late`` are left out.

    Of equal times ``ties`` and then the price decide what is first and last.
    """
    t = F.struct(ts, *ties, price)
    stream = ticks.withWatermark(ts, late).groupBy(F.window(ts, size), *keys)
    return stream.agg(F.count("*").alias("n"), F.min_by(price, t).alias("first"), F.max_by(price, t).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"))


def running_ema(ticks: DataFrame, key: str, order: str, value: str, span: int) -> DataFrame:
    """(key, order, value, ema): exponential mean carried from batch to batch in the state store."""
    a = 2 / (span + 1)
    kinds = {n: ticks.schema[n].dataType.simpleString() for n in (key, order, value)}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for v in rows[value]:
            if v is not None and v == v:
                last = v if last is None else a * v + (1 - a) * last
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), "ema": out})

    columns = ticks.select(key, order, value)
    return columns.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def frames(ticks: DataFrame, key: str, order: list[str], columns: list[str], back: int, fn: Callable[[pd.DataFrame], pd.DataFrame], out: str, keep: list[str], keep_ms: int | None = None) -> DataFrame:
    """Factors over frames of rows of a stream: (keep, out) for each row of ``ticks``.

    The state store holds each key's last ``back`` rows of ``columns`` (as doubles), and, where ``keep_ms`` is given,
    forgets them after so long without a row (for streams that go on: Spark runs batches without data for it, so one
    over what is there alone would not end).  ``fn`` gets those and a batch's new rows, in order, and gives a row of ``out`` for each; only those
    of new rows are kept.  A key's rows of one batch may come in any order, but no batch may hold rows before those of
    an earlier one.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        rows = new[columns].astype(float)
        before = len(state.get[0]) if state.exists else 0
        if before:
            rows = pd.concat([pd.DataFrame(dict(zip(columns, (list(v) for v in state.get), strict=True)), dtype=float), rows], ignore_index=True)
        last = rows.tail(back)
        state.update(tuple(last[c].tolist() for c in columns))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.concat([new[keep], fn(rows).iloc[before:].reset_index(drop=True)], axis=1)

    names = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in keep)
    rows = ticks.select(*dict.fromkeys([key, *order, *columns, *keep]))
    return rows.groupBy(key).applyInPandasWithState(step, f"{names}, {out}", ", ".join(f"{c} array<double>" for c in columns), "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run over all that is there and read the result back; in ``update`` mode the last state of each row's batch.

    A stream of the same folder and ``name`` goes on where the last run ended.
    """
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{name or uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure takes the place of what it wrote before
        rows.write.mode("overwrite").parquet(f"{at}/rows/_batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of a table written in ``update`` mode the last state of each key."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("x")).select(*keys, *[F.col(f"x.{c}") for c in others])
