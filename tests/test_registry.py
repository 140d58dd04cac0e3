"""Every registered query has a stable shape; twins agree on the small tables."""

import datetime as dt
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
#: one of each kind of plan; the whole set is compared by tools/check.py
SAMPLE = [
    "zbt_features", "ad_rolling", "ma_crossover", "mcc_rolling", "cci", "macd", "ms_intensity", "asof_fundamentals",
    "nearest_tick_join", "fund_all", "time_basic", "composite_signal", "positions_mark", "exit_scan", "returns_metrics", "streaks",
    "outlier_iqr", "drift_ks", "request_metrics", "param_diff", "upsert_by_key", "fetch_union", "stream_bars", "json_parse_signals",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def test_all_but_fitted_models_have_twins():
    # the optional corpus operators have tests of their own
    optional = {"pipeline", *(entry.llm.QUERIES if entry.llm else ())}
    missing = set(entry.queries()) - optional - set(entry.oracle_sql())
    assert all(n.startswith("model_") for n in missing)


def test_twin_text_is_plain_sql(con):
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_equals_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*columns).collect()]
    cur = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    assert [cur.description[i][0] for i in order] == columns
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert not any(isinstance(v, float) and not math.isfinite(v) for r in got for v in r)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and isinstance(df.first()["date"], dt.date)
