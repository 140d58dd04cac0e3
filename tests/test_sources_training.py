"""Source fallback, recommended lists, exact splits, paced replays."""

import datetime as dt
import time
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.sources import ingest
from tidemark.sources.storage import scratch_dir
from tidemark.streaming import pacing

DAY = dt.date(2024, 1, 1)


def priced(spark, data):
    return lambda: spark.createDataFrame([(s, DAY, x) for s, x in data], "symbol string, date date, close double")


def raises():
    raise OSError("vendor is down\nsecond line")


def test_a_failing_source_falls_through_and_is_reported(spark):
    late = lambda: priced(spark, [("a", 9.0)])().withColumn("close", F.raise_error(F.lit("bad row")).cast("double"))
    keyless = lambda: spark.range(3)
    tables, report = ingest.load_resources(spark, {
        "prices": {"down": raises, "torn": late, "keyless": keyless, "first": priced(spark, [("a", 1.0), ("b", 2.0)]), "second": priced(spark, [("b", 7.0), ("c", 3.0)])},
        "news": {"down": raises}})
    assert rows(tables["prices"].select("symbol", "close", "source")) == [(1.0, "first", "a"), (2.0, "first", "b"), (3.0, "second", "c")]
    assert "news" not in tables
    got = {(r["resource"], r["source"]): (r["status"], r["rows"], r["error"]) for r in report.collect()}
    assert got["prices", "down"] == ("failed", None, "vendor is down") and got["news", "down"][0] == "failed"
    assert got["prices", "torn"][0] == "failed" and "bad row" in got["prices", "torn"][2]
    assert "symbol" in got["prices", "keyless"][2] and got["prices", "second"] == ("loaded", 2, None)
    with pytest.raises(RuntimeError, match="all sources of news failed.*vendor is down"):
        ingest.load_resources(spark, {"news": {"down": raises}}, required=["news"])


def test_lists_by_use_case(spark):
    doc = '{"symbols":{"few":{"name":"Few","description":"","symbols":["A","B"]},"all":{"name":"All","symbols":["A","B","C"]}},"recommendations":{"quick":"few"}}'
    docs = spark.createDataFrame([(doc,)], "doc string")
    assert rows(ingest.universe_for(docs, "quick")) == [("few", "Few", "A"), ("few", "Few", "B")]
    with pytest.raises(ValueError, match="quick"):
        ingest.recommended_list(docs, "unknown")
    with pytest.raises(ValueError, match="none"):
        ingest.recommended_list(spark.createDataFrame([("{}",)], "doc string"), "quick")


def test_split_is_exact_in_each_label_and_repeatable(spark):
    data = [(i, "hot" if i % 3 else ("rare" if i % 2 else None)) for i in range(997)] + [(5000, "single")]
    df = spark.createDataFrame(data, "id int, label string").repartition(6)
    train, test = models.split_stratified(df, ["id"], "label", 0.8)
    sizes = Counter(x for _, x in data)
    got = Counter(r["label"] for r in train.collect())
    assert got == {k: int(n * 0.8 + 0.5) for k, n in sizes.items()}
    assert sorted(r["id"] for r in train.unionByName(test).collect()) == sorted(i for i, _ in data)
    again, _ = models.split_stratified(df.repartition(2), ["id"], "label", 0.8)
    other, _ = models.split_stratified(df, ["id"], "label", 0.8, seed=1)
    ids = {r["id"] for r in train.collect()}
    assert ids == {r["id"] for r in again.collect()} != {r["id"] for r in other.collect()}


def test_training_set_uses_training_statistics_only(spark):
    data = [(i, None if i % 7 == 0 else float(i), "ab"[i % 2] if i % 5 else None, None if i == 3 else i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "id int, x double, kind string, y int").withColumn("flat", F.lit(4.0))
    out = models.training_set(df, ["id"], ["x", "flat"], "y", ["kind"]).collect()
    train = [r for r in out if r["part"] == "train"]
    assert len(out) == 200 and len(train) == 160 and not any(r["y"] is None for r in out)
    assert sum(r["x_x"] for r in train) == pytest.approx(0, abs=1e-9)
    assert sum(r["x_x"] ** 2 for r in train) / len(train) == pytest.approx(1)
    assert {r["x_flat"] for r in out} == {0.0} and all(r["x_x"] == 0 for r in out if r["id"] % 7 == 0)
    assert len({r["x_kind_code"] for r in out}) == 3


def test_most_frequent_label_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "y string")
    assert Counter(r["y"] for r in models.fill_modes(df, ["y"]).collect()) == {"a": 3, "b": 2}


def test_replay_keeps_its_pace_and_counts_down(spark):
    src, out, ck = (scratch_dir(spark, n) for n in ("paced", "out", "ck"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)
    every = pacing.trigger_seconds(30, 3, 1, 10 / 3)
    assert every == pytest.approx(3.0)
    progress = pacing.replay_paced(stream, out, ck, every, "paced_test", 30).orderBy("batch").collect()
    assert [r["rows"] for r in progress] == [10, 10, 10] and [r["rows_left"] for r in progress] == [20, 10, 0]
    gaps = [(b["started"] - a["started"]).total_seconds() for a, b in zip(progress, progress[1:])]
    assert all(g > 0.5 for g in gaps) and sum(gaps) > 3
    assert all(r["behind_seconds"] >= 0 for r in progress)
    assert spark.read.parquet(out).count() == 30
    with pytest.raises(ValueError):
        pacing.trigger_seconds(1, 1, 1, 0)
