"""Plan shapes against brute force, and split series against whole ones."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import breadth, indicators, microstructure, signals
from tidemark.plans import quantile
from tidemark.plans.asof import asof, neighbours
from tidemark.plans.ewm import ewm, memory_rows
from tidemark.plans.series import (
    BARS, Series, calendar_bound, in_blocks, per_series, positions, running_sums, with_stats,
)


def series_frame(n=400, symbols=("A", "B"), seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for k, s in enumerate(symbols):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        out.append(pd.DataFrame({
            "symbol": s, "date": pd.date_range("2001-01-01", periods=n, freq="D").date,
            "open": close + rng.normal(0, 0.3, n), "close": close,
            "high": close + rng.uniform(0.1, 1, n), "low": close - rng.uniform(0.1, 1, n),
            "volume": rng.integers(1000, 9000, n),
        }))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def daily(spark):
    from tidemark.sources.storage import stage

    return stage(spark.createDataFrame(series_frame()), "daily")


def test_positions_number_each_series(daily):
    from pyspark.sql import Window

    plain = daily.select("symbol", "date", (F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).alias("p"))
    got = positions(daily, BARS, F.trunc("date", "month")).select("symbol", "date", F.col("_pos").alias("p"))
    assert rows(got) == rows(plain)


BLOCKED = {
    "price_change": (breadth.price_change, 1),
    "ma": (lambda d, s: breadth.ma_momentum(breadth.ma_crossover(breadth.ma_pair(d, s), s), s), 60),
    "rsi": (indicators.rsi, 15), "bollinger": (indicators.bollinger, 20), "cci": (indicators.cci, 20),
    "stochastic": (indicators.stochastic, 17), "adx": (indicators.adx, 30), "atr": (indicators.atr, 15),
    "volatility": (indicators.volatility_block, 21),
    "rolling": (lambda d, s: indicators.rolling_features(d, "close", [5], ["mean", "median", "skew", "kurt"], s), 5),
    "order_flow": (microstructure.ms_order_flow, 20), "intensity": (microstructure.ms_intensity, 32),
    "quality": (microstructure.ms_quality, 21), "liquidity": (microstructure.ms_liquidity, 26),
}


@pytest.mark.parametrize("name", sorted(BLOCKED))
def test_blocks_equal_whole_series(daily, name):
    op, lookback = BLOCKED[name]
    whole = op(daily, BARS)
    split = in_blocks(daily, op, lookback, block_rows=70, bucket=F.trunc("date", "month"))
    assert rows(split) == rows(whole)


def test_blocks_with_lookahead(daily):
    flagged = daily.withColumn("signal_strength", F.col("close") - 100)
    whole = signals.signal_smoothing(flagged)
    split = in_blocks(flagged, signals.signal_smoothing, 1, 1, block_rows=50)
    assert rows(split) == rows(whole)


def test_macd_in_blocks(spark):
    df = spark.createDataFrame(series_frame(2200, ("A",))).select("symbol", "date", "close")
    whole = indicators.macd(df).select("date", F.round("macd", 9), F.round("macd_signal", 9))
    split = in_blocks(df, indicators.macd, indicators.LOOKBACK["macd"], block_rows=900).select(
        "date", F.round("macd", 9), F.round("macd_signal", 9))
    assert rows(split.toDF("d", "m", "s")) == rows(whole.toDF("d", "m", "s"))


def test_unbounded_frames_refused_in_blocks(daily):
    with pytest.raises(ValueError):
        in_blocks(daily, lambda d, s: d.withColumn("x", F.max("close").over(s.whole)), 1, block_rows=50).count()
    with pytest.raises(ValueError):
        in_blocks(daily, lambda d, s: d, 100, block_rows=50)


def test_frequency_decides_layout(daily):
    assert calendar_bound("1week") < calendar_bound("1min")
    seen = []
    per_series(daily, lambda d, s: seen.append(s.split) or d, 1, frequency="1day")
    per_series(daily, lambda d, s: seen.append(s.split) or d, 1, frequency=None)
    per_series(daily, lambda d, s: seen.append(s.split) or d, 1, frequency="1min")
    assert seen == [False, True, True]


def test_date_grain_operators_agree_across_layouts(daily):
    for op in (breadth.ad_features, breadth.zbt_features, breadth.mcclellan, breadth.pct_above_ma):
        assert rows(op(daily, frequency=None)) == rows(op(daily, frequency="1day"))


def test_technical_signals_agree_across_layouts(daily):
    keep = ["symbol", "date", "signal_type", "signal_strength"]
    assert rows(signals.technical_signals(daily, frequency=None).select(*keep)) == rows(
        signals.technical_signals(daily, frequency="1day").select(*keep))


def test_running_sums_and_stats_two_level(daily):
    sums = {"v": F.col("volume"), "c": F.when(F.col("volume") > 3000, F.col("volume"))}
    assert rows(running_sums(daily, sums, bucket=F.trunc("date", "month"))) == rows(running_sums(daily, sums, frequency="1day"))
    stats = {"top": F.max("close"), "n": F.count(F.lit(1))}
    assert rows(with_stats(daily, stats)) == rows(with_stats(daily, stats, frequency="1day"))


@pytest.mark.parametrize("span", [5, 12, 26])
def test_ewm_equals_pandas(spark, span):
    pdf = series_frame(3 * memory_rows(span) + 11, ("A", "B"))[["symbol", "date", "close"]]
    got = ewm(spark.createDataFrame(pdf), {"y": ("close", span)}).toPandas().sort_values(["symbol", "date"])
    want = pdf.groupby("symbol")["close"].transform(lambda x: x.ewm(span=span).mean())
    assert np.allclose(got["y"].to_numpy(), want.to_numpy(), rtol=1e-13)


def test_ewm_rejects_spans_too_far_apart(daily):
    with pytest.raises(ValueError):
        ewm(daily, {"a": ("close", 2), "b": ("close", 5000)})


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat(["hot", "cold", "one"], [3000, 37, 1]), "x": np.r_[rng.integers(0, 90, 3000), rng.normal(0, 1, 37), [5.0]]})
    pdf.loc[4, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantile.exact_quantiles(df, "x", probs, ["g"], slices=8).collect()}
    for g, part in pdf.groupby("g"):
        x = part["x"].dropna()
        assert got[g][0] == len(x)
        assert np.allclose(got[g][1], np.quantile(x, probs))


def test_slices_keep_a_large_group_in_many_tasks(spark):
    counts = spark.range(20_000).repartition(8).selectExpr("if(id < 9, 'cold', 'hot') AS g", "double(id) AS v", "1L AS m")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        got = quantile.sliced(counts, ["g"], "v")
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        slices = {(r["g"], r["_slice"]): r["count"] for r in got.groupBy("g", "_slice").count().collect()}
    finally:
        spark.conf.set(limit, before)
    assert sum(tasks) == sum(slices.values()) == 20_000
    assert max(tasks) < 5_000 and max(slices.values()) < 3 * 20_000 / quantile.SLICES


def test_cumulative_counts(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 4000, p=[0.9, 0.1]), "x": rng.integers(0, 700, 4000).astype(float), "m": 1})
    counts = spark.createDataFrame(pdf).groupBy("g", "x").agg(F.sum("m").alias("m"))
    got = quantile.cumulative(counts, ["g"], "x", ["m"], slices=16).toPandas()
    want = pdf.groupby(["g", "x"])["m"].sum().groupby(level=0).cumsum().reset_index(name="w")
    both = got.merge(want, on=["g", "x"])
    assert len(both) == len(want) and (both["m_upto"] == both["w"]).all()


def test_asof_and_nearest_against_brute_force(spark):
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2020-01-01")
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 300, p=[0.8, 0.15, 0.05]), "t": base + pd.to_timedelta(rng.integers(0, 4000, 300), "h")}).drop_duplicates()
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 150), "t": base + pd.to_timedelta(rng.integers(0, 4000, 150), "h")})
    right["id"] = np.arange(len(right))
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    got = neighbours(l, r, "k", "t", ["id"], tie=["id"], following=True)
    got = {(x["k"], x["t"]): (x["_prev"]["id"] if x["_prev"] else None, x["_next"]["id"] if x["_next"] else None) for x in got.collect()}
    for _, row in left.iterrows():
        same = right[right["k"] == row["k"]]
        before, after = same[same["t"] <= row["t"]], same[same["t"] > row["t"]]
        p = before[before["t"] == before["t"].max()]["id"].min() if len(before) else None
        n = after[after["t"] == after["t"].min()]["id"].min() if len(after) else None
        assert got[(row["k"], row["t"].to_pydatetime())] == (p, n)
    assert asof(l, r, "k", "t", ["id"]).count() == len(left)


def test_frame_helpers_against_pandas(spark):
    from tidemark.functions.frames import corr, frame_kurt, frame_rank, frame_skew, longest_run

    pdf = series_frame(120, ("A",))
    df = spark.createDataFrame(pdf)
    x = F.col("volume")
    got = df.select("date", frame_rank(x, 10).alias("rank"), frame_skew(x, 10).alias("skew"), frame_kurt(x, 10).alias("kurt"),
                    longest_run(x > 4000, 10).alias("run"), corr("close", "volume", BARS.back(10)).alias("corr")).toPandas().sort_values("date")
    roll = pdf["volume"].astype(float).rolling(10)
    assert np.allclose(got["rank"], roll.rank(pct=True), equal_nan=True)
    assert np.allclose(got["skew"], roll.skew(), equal_nan=True)
    assert np.allclose(got["kurt"], roll.kurt(), equal_nan=True)

    def run(v):
        best = cur = 0
        for y in v:
            cur = cur + 1 if y > 4000 else 0
            best = max(best, cur)
        return best

    assert np.allclose(got["run"].astype(float), roll.apply(run), equal_nan=True)
    want = pdf["close"].rolling(10).corr(pdf["volume"])
    assert np.allclose(got["corr"].iloc[9:], want.iloc[9:])


def test_corr_of_a_constant_is_null(spark):
    from tidemark.functions.frames import corr

    df = spark.range(10).select(F.col("id").alias("a"), F.lit(1.0).alias("b"))
    assert df.agg(corr("a", "b").alias("c")).first()["c"] is None


def test_pareto_front(spark):
    from tidemark.operators.models import pareto_front

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(400), "a": rng.integers(0, 60, 400).astype(float), "b": rng.integers(0, 60, 400).astype(float)})
    got = {r["id"] for r in pareto_front(spark.createDataFrame(pdf), "a", "b").collect()}
    want = {
        r.id for r in pdf.itertuples()
        if not ((pdf.a >= r.a) & (pdf.b >= r.b) & ((pdf.a > r.a) | (pdf.b > r.b))).any()
    }
    assert got == want


def test_calendar_math_constant():
    assert memory_rows(12) == math.ceil(41 / -math.log(11 / 13))


def test_null_keys_and_measures_stay(spark):
    """NULL is a key of a series and a group of a quantile; an as-of row without key or time stays."""
    from tidemark.plans import asof, quantile, series

    left = spark.createDataFrame([("a", 3), ("a", None), (None, 3)], "k string, d int").selectExpr("k", "date_add(DATE '2020-01-01', d) AS d")
    right = spark.createDataFrame([("a", 1, 7), (None, 1, 8), ("a", None, 9)], "k string, d int, x int").selectExpr("k", "date_add(DATE '2020-01-01', d) AS d", "x")
    got = {(r["k"], r["d"] is None): r["x"] for r in asof.asof(left, right, "k", "d", ["x"]).collect()}
    assert got == {("a", False): 7, ("a", True): None, (None, False): None}
    bars = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), (None, 2, 3.0), ("a", None, 4.0)], "symbol string, d int, x double").selectExpr("symbol", "date_add(DATE '2020-01-01', d) AS date", "x")
    assert series.positions(bars).count() == 4
    for made in (lambda f: series.running_sums(bars, {"y": F.col("x")}, frequency=f), lambda f: series.with_stats(bars, {"y": F.sum("x")}, frequency=f)):
        whole, blocks = ({(r["symbol"], r["x"]): r["y"] for r in made(f).collect()} for f in ("1week", None))
        assert whole == blocks and len(whole) == 4
    counts = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, -1), ("g", 1.0, None), ("g", 2.0, 4)], "g string, v double, m long")
    got = {(r["g"], r["v"]): r["m_upto"] for r in quantile.cumulative(counts, ["g"], "v", ["m"]).collect()}
    assert got[None, 1.0] == 2 and got[None, 2.0] == 1 and got["g", 2.0] == 4 and len(got) == 4
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 5.0)], "g string, v double")
    assert {r["g"]: (r["n"], r["q"]) for r in quantile.exact_quantiles(values, "v", [0.5], ["g"]).collect()} == {None: (2, [2.0]), "g": (1, [5.0])}


def test_null_safe_keys_cost_no_further_exchange(spark, tmp_path):
    """Series, as-of joins and quantiles shuffle as often as with keys that can't be NULL."""
    from tidemark.operators import joins
    from tidemark.plans import quantile, series

    path = str(tmp_path / "bars")
    spark.range(10).selectExpr("CAST(id % 2 AS string) AS symbol", "date_add(DATE '2020-01-01', CAST(id AS int)) AS date", "double(id) AS x",
                               "TIMESTAMP '2020-01-01' AS ts", "id AS event_id").write.parquet(path)
    bars = spark.read.parquet(path)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plans = {
            "positions": series.positions(bars), "running": series.running_sums(bars, {"y": F.col("x")}),
            "asof": asof(bars, bars, "symbol", "date", ["x"]), "quantile": quantile.exact_quantiles(bars, "x", [0.5], ["symbol"]),
            "nearest": joins.nearest_tick_join(bars, bars, ["x"]),
        }
        counts = {k: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for k, df in plans.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counts["positions"] <= 4 and counts["running"] <= 4 and counts["asof"] <= 8
    assert counts["quantile"] <= 10 and counts["nearest"] <= 10


def test_runs_in_slots_equal_runs_of_the_whole(spark):
    from itertools import groupby

    from tidemark.plans.islands import run_lengths

    rng = np.random.default_rng(8)
    data = [(k, int(i), "wlf"[rng.choice(3, p=[0.6, 0.3, 0.1])] if i % 40 < 30 else "w") for k in ("a", "b", None) for i in rng.permutation(200)]
    df = spark.createDataFrame(data, "symbol string, at int, flag string").repartition(4)
    want = sorted(repr((k, f, len(list(g)))) for k in ("a", "b", None) for f, g in groupby(x[2] for x in sorted((d for d in data if d[0] == k), key=lambda d: d[1])))
    for width in (1, 7, 50, 1000):
        got = run_lengths(df, F.col("flag"), Series(order=("at",)), F.floor(F.col("at") / width))
        assert sorted(repr(tuple(r)) for r in got.select("symbol", "_flag", "_n").collect()) == want, width


@pytest.mark.parametrize(("method", "limit"), [("forward_fill", None), ("backward_fill", None), ("forward_fill", 2), ("backward_fill", 3)])
def test_fills_of_long_series_equal_those_of_short_ones(spark, method, limit):
    from tidemark.operators import prep

    rng = np.random.default_rng(9)
    # gaps of many days cross slots; a slot is a day of up to eight rows
    data = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=3 * i), None if rng.random() < (0.98 if 80 < i < 160 else 0.4) else float(i), None if i % 3 else i)
            for k in ("a", "b", None) for i in range(240)]
    df = spark.createDataFrame([(k, t.to_pydatetime(), x, y) for k, t, x, y in data], "symbol string, date timestamp, x double, y int").repartition(4)
    whole, slots = (prep.fill_missing(df, ["x", "y"], method, limit, frequency=f) for f in ("1week", None))
    assert rows(whole) == rows(slots) and slots.columns == df.columns


def test_entity_stats_of_long_series_equal_those_of_short_ones(daily):
    from tidemark.operators import prep

    whole, blocks = (prep.entity_stats(daily, frequency=f) for f in ("1week", None))
    assert whole.columns == blocks.columns
    pairs = zip(whole.orderBy("symbol").collect(), blocks.orderBy("symbol").collect(), strict=True)
    for a, b in pairs:
        assert a["symbol"] == b["symbol"] and list(a[1:]) == pytest.approx(list(b[1:]), rel=1e-6, abs=1e-9)


def test_slots_follow_the_densest_symbol(spark):
    from tidemark.operators import joins

    start = pd.Timestamp("2024-01-01")
    # a burst of one symbol: 4000 ticks in 40 seconds of one hour
    ticks = spark.createDataFrame(
        [("HOT", (start + pd.Timedelta(milliseconds=10 * i)).to_pydatetime(), i, float(i)) for i in range(4000)]
        + [("b", (start + pd.Timedelta(hours=i)).to_pydatetime(), i, float(i)) for i in range(50)], "symbol string, ts timestamp, event_id long, bid double")
    signals = ticks.filter("event_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 4 MILLISECONDS")).select("symbol", "ts")
    slot = joins.time_slot(ticks, "symbol", "ts", 200)
    assert ticks.groupBy("symbol", slot.alias("s")).count().agg(F.max("count")).first()[0] <= 200
    narrow, wide = (joins.nearest_tick_join(signals, ticks, ["bid"], most) for most in (200, 10**9))
    assert rows(narrow) == rows(wide) and narrow.count() == signals.count()
