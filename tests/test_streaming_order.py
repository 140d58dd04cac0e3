"""Unordered, late and repeated rows: one trigger, many triggers and batch agree."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.breadth import issue_status
from tidemark.sources.storage import scratch_dir
from tidemark.streaming import ordered, replay

BARS = "symbol string, date timestamp, close double"
START = dt.datetime(2024, 1, 1)


def some_bars(seed=1, days=40, symbols=5, jitter=6):
    """(arrival, symbol, date, close): a bar arrives up to ``jitter`` days after its date."""
    rng = random.Random(seed)
    out = [(d + rng.random() * jitter, s, START + dt.timedelta(days=d), rng.choice([10.0, 11.0, 12.5, 0.0]))
           for s in [*(f"S{k}" for k in range(symbols)), None] for d in range(days)]
    return sorted(out, key=lambda r: r[0])


def land(spark, bars, files):
    src = scratch_dir(spark, "bars")
    size = -(-len(bars) // files)
    for k in range(0, len(bars), size):
        spark.createDataFrame([r[1:] for r in bars[k : k + size]], BARS).coalesce(1).write.mode("append").parquet(src)
    return src


def statuses(spark, src, lateness, per_trigger=1):
    ordered.end_stream(spark, src, spark.read.schema(BARS).parquet(src).schema)
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", per_trigger).parquet(src)
    out, late, ck = (scratch_dir(spark, n) for n in ("out", "late", "ck"))
    progress = ordered.split_late(ordered.ordered_statuses(stream, lateness), out, late, ck)
    return ordered.epochs(spark, out), ordered.epochs(spark, late), progress


@pytest.mark.parametrize(("files", "per_trigger"), [(6, 1), (6, 100)])
def test_unordered_files_equal_batch_within_the_lateness(spark, files, per_trigger):
    bars = some_bars()
    out, late, progress = statuses(spark, land(spark, bars, files), "7 days", per_trigger)
    batch = issue_status(spark.createDataFrame([r[1:] for r in bars], BARS))
    names = ["symbol", "date", "close", "price_change_pct", "issue_status"]
    assert rows(out.select(*names)) == rows(batch.select(*names))
    assert late.count() == 0 and (len(progress) > files) == (per_trigger == 1)


def test_bars_beyond_the_lateness_are_handed_on(spark):
    bars = [(0, "A", START + dt.timedelta(days=d), float(d + 1)) for d in (0, 9, 1, 5, 8)] + [(0, "A", None, 3.0), (0, "B", START, 2.0)]
    out, late, _ = statuses(spark, land(spark, bars, 7), "3 days")
    day = lambda n: START + dt.timedelta(days=n)
    assert {(r["symbol"], r["date"]) for r in late.collect()} == {("A", day(1)), ("A", day(5)), ("A", None), ("B", day(0))}
    kept = out.orderBy("date").collect()
    assert [r["date"] for r in kept] == [day(0), day(8), day(9)]
    # each is compared with the bar before it in time, not in arrival
    assert [r["price_change_pct"] for r in kept] == [None, 8.0, pytest.approx(1 / 9)]
    assert late.filter("issue_status IS NOT NULL").count() == 0


def test_state_ends_with_the_stream(spark):
    """Without the closing row a drained stream keeps what lies within the lateness, and gives it out later."""
    bars = some_bars(days=10, symbols=2, jitter=0.5)
    src = land(spark, bars, 2)
    stream = lambda: spark.readStream.schema(BARS).parquet(src)
    out, late, ck = (scratch_dir(spark, n) for n in ("out", "late", "ck"))
    ordered.split_late(ordered.ordered_statuses(stream(), "2 days"), out, late, ck)
    early = ordered.epochs(spark, out).count()
    assert 0 < early < len(bars)
    ordered.end_stream(spark, src, spark.read.schema(BARS).parquet(src).schema)
    ordered.split_late(ordered.ordered_statuses(stream(), "2 days"), out, late, ck)
    assert ordered.epochs(spark, out).count() == len(bars) and ordered.epochs(spark, late).count() == 0


def keyed(spark, src, per_trigger, order=()):
    stream = spark.readStream.schema("symbol string, ts timestamp, open double").option("maxFilesPerTrigger", per_trigger).parquet(src)
    out, ck = scratch_dir(spark, "first"), scratch_dir(spark, "ck")
    ordered.first_copies_to_table(stream, out, ck, ["symbol", "ts"], "ts", order)
    return out, ck


@pytest.mark.parametrize("per_trigger", [1, 2, 100])
def test_first_copies_do_not_depend_on_triggers(spark, per_trigger):
    rng = random.Random(2)
    base = [(s, START + dt.timedelta(days=d), float(d)) for s in ("A", "B", None) for d in range(60)] + [("A", None, 1.0)]
    doubled = base * 2
    rng.shuffle(doubled)
    src = scratch_dir(spark, "dirty")
    for k in range(5):
        spark.createDataFrame(doubled[k::5], "symbol string, ts timestamp, open double").coalesce(1).write.mode("append").parquet(src)
    out, ck = keyed(spark, src, per_trigger)
    got = ordered.read_first_copies(spark, out, ["symbol", "ts"])
    assert rows(got) == rows(spark.createDataFrame(base, "symbol string, ts timestamp, open double"))
    # a later run of the same stream over new files adds only what is new
    spark.createDataFrame([*base[:7], ("C", START, 1.0)], "symbol string, ts timestamp, open double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("symbol string, ts timestamp, open double").parquet(src)
    ordered.first_copies_to_table(stream, out, ck, ["symbol", "ts"], "ts")
    assert ordered.epochs(spark, out).count() == len(base) + 1


def test_smallest_copy_stays_in_any_file_order(spark):
    parts = [[("A", START, 3.0), ("B", START, 1.0)], [("A", START, 2.0), ("B", START, 5.0)], [("A", START, 9.0)]]
    tables = []
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        src = scratch_dir(spark, "copies")
        for k in order:
            spark.createDataFrame(parts[k], "symbol string, ts timestamp, open double").coalesce(1).write.mode("append").parquet(src)
        out, _ = keyed(spark, src, 1, ["open"])
        tables.append(rows(ordered.read_first_copies(spark, out, ["symbol", "ts"], ["open"])))
    assert tables[0] == tables[1] == tables[2]
    assert [r[0] for r in tables[0]] == [1.0, 2.0]


def test_a_trigger_run_again_leaves_no_row_twice(spark):
    src, out = scratch_dir(spark, "again"), scratch_dir(spark, "first")
    spark.createDataFrame([("A", START, 1.0)] * 3, "symbol string, ts timestamp, open double").write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("symbol string, ts timestamp, open double").parquet(src)
    # a second query over the same files stands for a trigger repeated after its rows were written
    for ck in (scratch_dir(spark, "ck1"), scratch_dir(spark, "ck2")):
        ordered.first_copies_to_table(stream(), out, ck, ["symbol", "ts"], "ts")
    assert ordered.epochs(spark, out).count() == 1


def test_slices_land_every_row_in_arrival_order(spark):
    df = spark.range(1000).withColumn("at", F.when(F.col("id") % 10 > 0, (F.col("id") * 37) % 1000))
    path = scratch_dir(spark, "slices")
    ordered.land_in_slices(df, path, F.col("at"), 4)
    assert rows(spark.read.parquet(path)) == rows(df)


def test_plain_form_still_follows_arrival(spark):
    src = land(spark, [(0, "A", START, 1.0)], 1)
    assert replay.stream_statuses(spark.readStream.schema(BARS).parquet(src)).isStreaming
