"""Streams drained file by file equal their batch twins."""

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.breadth import issue_status
from tidemark.sources.storage import read_table, scratch_dir
from tidemark.streaming import replay


def test_statuses_carry_the_last_close_across_triggers(spark):
    stamps = pd.date_range("2024-01-01", periods=6, freq="h")
    pdf = pd.DataFrame({"symbol": ["A"] * 6, "date": stamps, "close": [10.0, 11.0, 11.0, 10.0, 12.0, 12.0]})
    schema = "symbol string, date timestamp, close double"
    src, out, ck = (scratch_dir(spark, n) for n in ("src", "out", "ck"))
    for lo, hi in ((0, 3), (3, 6)):
        spark.createDataFrame(pdf.iloc[lo:hi], schema).coalesce(1).write.mode("append").parquet(src)
        replay.run_to_table(replay.stream_statuses(spark.readStream.schema(schema).parquet(src)), out, ck)
    batch = issue_status(spark.createDataFrame(pdf, schema)).select("date", "issue_status")
    assert rows(read_table(spark, out).select("date", "issue_status")) == rows(batch)


def test_late_bar_is_dropped(spark):
    schema = "symbol string, date timestamp, close double"
    src, out, ck = (scratch_dir(spark, n) for n in ("src", "out", "ck"))
    for hours in ((2,), (1, 3)):
        pdf = pd.DataFrame({"symbol": "A", "date": [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in hours], "close": 1.0})
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(src)
        replay.run_to_table(replay.stream_statuses(spark.readStream.schema(schema).parquet(src)), out, ck)
    assert read_table(spark, out).count() == 2


def test_replay_round_trip_and_progress(spark, bars):
    messages = replay.replay_envelope(bars, batch_rows=500)
    sizes = messages.groupBy("replay_batch").count().orderBy("replay_batch").collect()
    assert all(r["count"] == 500 for r in sizes[:-1])
    src, out, ck = (scratch_dir(spark, n) for n in ("msg", "out", "ck"))
    replay.land_messages(messages, src)
    progress = replay.run_to_table(replay.stream_parse(replay.message_stream(spark, src, files_per_trigger=2)), out, ck)
    assert len(progress) > 1
    got = read_table(spark, out).select("symbol", F.col("date").cast("date").alias("date"), "close", "volume")
    assert rows(got) == rows(bars.select("symbol", "date", "close", "volume"))


def test_bad_message_gives_null_fields(spark):
    df = spark.createDataFrame([("{not json",)], "value string")
    assert replay.stream_parse(df).first()["symbol"] is None
