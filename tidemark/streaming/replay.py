"""Replay of landed bars as messages, and the operators that consume them.

File source and sink stand in for a broker; a broker is a change of
``format`` and options, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.breadth import scan_filter
from tidemark.params import BREADTH, Breadth
from tidemark.plans.series import Series, positions

c = F.col
MESSAGE = (
    "symbol string, date string, open double, high double, low double, close double, volume bigint, adj_close double, "
    "metadata struct<original_date:string, replay_batch:bigint, speed_multiplier:double, topic_name:string>"
)


# -- batch side -------------------------------------------------------------------
def replay_load(bars: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    """Selected bars with replay times; ordering is left to the sink."""
    return scan_filter(bars, symbols, start, end).withColumns(
        {"replay_timestamp": c("date"), "original_date": c("date")})


def replay_envelope(
    bars: DataFrame, batch_rows: int = 1000, speed: float = 60.0, topic: str = "bars"
) -> DataFrame:
    """``key, value, replay_batch``: one JSON message per bar.

    The global row number comes from per-date counts plus numbering inside a
    date, so no task orders the whole table.
    """
    placed = positions(bars, Series(keys=(), order=("date", "symbol")))
    batch = F.floor(c("_pos") / batch_rows) + 1
    body = F.struct(
        "symbol", c("date").cast("string").alias("date"), "open", "high", "low", "close", "volume", "adj_close",
        F.struct(
            c("date").cast("string").alias("original_date"), batch.alias("replay_batch"),
            F.lit(speed).alias("speed_multiplier"), F.lit(topic).alias("topic_name"),
        ).alias("metadata"),
    )
    return placed.select(c("symbol").alias("key"), F.to_json(body).alias("value"), batch.alias("replay_batch"))


def land_messages(messages: DataFrame, path: str) -> None:
    """Messages as text files, in batch order, for a streaming file source."""
    ranged = messages.repartitionByRange(8, "replay_batch").sortWithinPartitions("replay_batch")
    ranged.select("value").write.mode("append").text(path)


# -- streaming side ---------------------------------------------------------------
def message_stream(spark: SparkSession, path: str, fmt: str = "text", files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt)
    if fmt == "text":
        reader = reader.schema("value string")
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.options(**options).load(path) if fmt == "text" else reader.options(**options).load()
    return stream.select(c("value").cast("string").alias("value"))


def stream_parse(messages: DataFrame) -> DataFrame:
    """Typed rows from JSON messages; a bad message gives NULL fields."""
    return messages.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Drain a stream into parquet; returns each trigger's progress."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]} for p in query.recentProgress]


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain an aggregating stream; every trigger replaces the result table."""

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(replace).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def symbol_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("symbol").agg(F.count(F.lit(1)).alias("messages"))


# -- bars, issues, duplicates over a stream -----------------------------------------
def bar_aggregates(order) -> list:
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    ]


def ticks_to_bars(ticks: DataFrame, timeframe: str, watermark: str | None = None) -> DataFrame:
    """Bars per symbol and event-time window; the same plan batch or streaming.

    A tick later than the watermark is dropped.
    """
    if watermark:
        ticks = ticks.withWatermark("ts", watermark)
    out = ticks.groupBy("symbol", F.window("ts", timeframe).alias("w")).agg(*bar_aggregates(F.struct("ts", "event_id")))
    return out.select("symbol", c("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "ticks")


STATUS = "symbol string, date timestamp, close double, price_change_pct double, issue_status string"


def _classify(p: Breadth):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_time, last_close = state.get if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("date")
        if last_time is not None:
            pdf = pdf[pdf["date"] > pd.Timestamp(last_time)]  # a late bar is dropped
        if len(pdf):
            before = pdf["close"].shift(1)
            before.iloc[0] = float("nan") if last_close is None else last_close
            change = (pdf["close"] - before) / before.where(before != 0)
            status = pd.Series("unchanged", index=pdf.index)
            status[change > p.advance], status[change < p.decline] = "advancing", "declining"
            state.update((pdf["date"].iloc[-1].to_pydatetime(), float(pdf["close"].iloc[-1])))
            yield pd.DataFrame({
                "symbol": pdf["symbol"], "date": pdf["date"], "close": pdf["close"],
                "price_change_pct": change, "issue_status": status,
            })

    return step


def stream_statuses(bars: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    """Advancing / declining / unchanged, with the last close as the state.

    A trigger hands a symbol only its new bars; admission control
    (``maxFilesPerTrigger``) bounds them.
    """
    return bars.groupBy("symbol").applyInPandasWithState(
        _classify(p), STATUS, "date timestamp, close double", "append", GroupStateTimeout.NoTimeout
    )


def stream_dedup(bars: DataFrame, watermark: str = "30 days") -> DataFrame:
    """First copy of each (symbol, date) inside the watermark."""
    return bars.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["symbol", "ts"])
