"""Upserts, compaction and retention: all or nothing, and only the partitions they need."""

import glob
import os

import pytest
from conftest import rows

from tidemark.sources import snapshots, storage

SCHEMA = "k string, day int, x double"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def read(spark, path):
    return rows(storage.read_table(spark, path).select("k", "day", "x"))


def test_upserts_follow_the_keys_and_touch_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    model = {("a", 1): 1.0, ("b", 1): 2.0, ("a", 2): 3.0, (None, 3): 4.0}
    storage.upsert_by_key(spark, table(spark, [(*k, v) for k, v in model.items()]), path, ["k", "day"], ["day"])
    untouched = snapshots.entries(spark, path)
    for change in ({("a", 1): 9.0, ("c", 1): 5.0}, {(None, 3): 7.0}, {("z", 9): 1.0}):
        storage.upsert_by_key(spark, table(spark, [(*k, v) for k, v in change.items()]), path, ["k", "day"], ["day"])
        model |= change
        assert read(spark, path) == rows(table(spark, [(*k, v) for k, v in model.items()]))
    # the folder of day 2 was never written again
    assert [e for e in untouched if e.endswith("day=2")][0] in snapshots.entries(spark, path)
    plan = storage.read_table(spark, path, predicate="day = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_repeated_source_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.upsert_by_key(spark, table(spark, [("a", 1, 1.0)]), path, ["k", "day"])
    for bad in ([("a", 1, 2.0), ("a", 1, 3.0)], [(None, 1, 2.0), (None, 1, 3.0)]):
        with pytest.raises(ValueError, match="more than once"):
            storage.upsert_by_key(spark, table(spark, bad), path, ["k", "day"])
    assert read(spark, path) == rows(table(spark, [("a", 1, 1.0)]))


@pytest.mark.parametrize("action", ["upsert", "compact"])
def test_a_job_that_ends_early_leaves_the_table_readable(spark, tmp_path, monkeypatch, action):
    path = str(tmp_path / "t")
    for k in range(3):
        storage.write_table(table(spark, [("a", d, float(k)) for d in range(2)]), path, ["day"], "append")
    if action == "upsert":
        storage.compact_table(spark, path, ["day"])
    before = read(spark, path)

    def ends(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", ends)
        with pytest.raises(RuntimeError, match="lost"):
            if action == "upsert":
                storage.upsert_by_key(spark, table(spark, [("a", 0, 5.0)]), path, ["k", "day"], ["day"])
            else:
                storage.compact_table(spark, path, ["day"])
    assert read(spark, path) == before
    # a pointer cut off while it was written counts for nothing
    os.makedirs(f"{path}/_pointers", exist_ok=True)
    with open(f"{path}/_pointers/000000000099.json", "w") as f:
        f.write('["_data/batch=nothing"')
    assert read(spark, path) == before
    storage.upsert_by_key(spark, table(spark, [("new", 7, 5.0)]), path, ["k", "day"], ["day"])
    assert len(read(spark, path)) == len(before) + 1


def test_second_writer_fails_instead_of_losing_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.upsert_by_key(spark, table(spark, [("a", 1, 1.0)]), path, ["k"])
    folder, seen, old = snapshots._state(spark, path)
    storage.upsert_by_key(spark, table(spark, [("b", 1, 1.0)]), path, ["k"])
    with pytest.raises(Exception, match="exist"):
        snapshots._commit(folder, seen, old)
    assert len(read(spark, path)) == 2


def test_compaction_rewrites_small_partitions_only_and_vacuum_removes(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        storage.write_table(table(spark, [("a", 1, float(k)), *([("b", 2, 0.5)] if k == 0 else [])]), path, ["day"], "append")
    before = read(spark, path)
    assert snapshots.compact(spark, path, ["day"]) == 1
    assert read(spark, path) == before and "day=2" in snapshots.entries(spark, path)
    assert len(glob.glob(f"{path}/_data/*/day=1/part-*")) == 1
    assert snapshots.compact(spark, path, ["day"]) == 0
    storage.upsert_by_key(spark, table(spark, [("a", 1, 8.0)]), path, ["k", "day"], ["day"])
    assert snapshots.vacuum(spark, path, keep=2) == 0
    assert snapshots.vacuum(spark, path) == 1
    assert read(spark, path) == rows(table(spark, [("a", 1, 8.0), ("b", 2, 0.5)]))


@pytest.mark.parametrize("pointed", [True, False])
def test_retention_frees_what_the_listing_says(spark, tmp_path, pointed):
    path = str(tmp_path / "t")
    data = table(spark, [("a", d, 1.0) for d in (1, 2, 9, 10)])
    if pointed:
        storage.upsert_by_key(spark, data, path, ["k", "day"], ["day"])
    else:
        storage.write_table(data, path, ["day"])

    def held():
        return storage.file_listing(storage.read_table(spark, path)).groupBy().sum("size").first()[0]

    before = held()
    dry = snapshots.remove_expired(spark, path, "day", "9")
    assert len(dry) == 2 and held() == before
    assert snapshots.remove_expired(spark, path, "day", "9", dry_run=False) == dry
    assert before - held() == sum(r["bytes"] for r in dry)
    assert sorted(r["day"] for r in storage.read_table(spark, path).collect()) == [9, 10]
    assert snapshots.remove_expired(spark, path, "day", "9") == []
