"""Joins of bars with reports, ticks, signals, statistics and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import TIMEFRAMES
from tidemark.plans.asof import asof, neighbours

c = F.col


def asof_fundamentals(bars: DataFrame, reports: DataFrame, columns: list[str]) -> DataFrame:
    """Latest report at or before each bar of the same symbol."""
    return asof(bars, reports, "symbol", "date", columns, slot=F.trunc("date", "year"))


#: rows of one symbol and time slot that a task may hold, and the slots tried, in seconds
SLOT_ROWS, SLOT_SECONDS = 500_000, (3600, 60, 1, 0.001)


def time_slot(rows: DataFrame, key: str, time: str, most: int = SLOT_ROWS) -> Column:
    """The widest time slot of which no key has more than ``most`` rows, by counting them.

    Ordinary tables are settled by one count by key and hour.
    """
    micros = F.unix_micros(c(time).cast("timestamp"))
    for seconds in SLOT_SECONDS:
        slot = F.floor(micros / (seconds * 1_000_000))
        counts = rows.groupBy(key, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("n"))
        if seconds == SLOT_SECONDS[-1] or (counts.agg(F.max("n")).first()[0] or 0) <= most:
            return slot


def nearest_tick_join(signals: DataFrame, ticks: DataFrame, payload: list[str], most: int = SLOT_ROWS) -> DataFrame:
    """The tick closest in time to each signal; the earlier one wins a tie.

    Slots are as wide as the ticks of the densest symbol allow, so no task holds more
    than ``most`` of them; signals are taken to be no denser than ticks.
    """
    slot = time_slot(ticks, "symbol", "ts", most)
    both = neighbours(signals, ticks, "symbol", "ts", payload, tie=["event_id"], slot=slot, following=True)

    def gap(side: str):
        a, b = c("ts").cast("timestamp"), c(f"{side}.ts").cast("timestamp")
        return F.abs(F.unix_micros(a) - F.unix_micros(b))

    pick = F.when(c("_next").isNull() | (gap("_prev") <= gap("_next")), c("_prev")).otherwise(c("_next"))
    out = both.withColumn("_tick", pick)
    return out.select(
        *signals.columns, c("_tick.ts").alias("tick_ts"),
        *[c(f"_tick.{p}").alias(p) for p in payload],
        gap("_tick").alias("gap_micros"),
    )


def signal_price_join(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Price of the symbol at the signal's own date."""
    return signals.join(bars.select("symbol", "date", c("close").alias("market_price")), ["symbol", "date"])


def feature_target_join(features: DataFrame, target: DataFrame) -> DataFrame:
    return features.join(target, ["symbol", "date"])


def entity_stats_join(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Per-symbol statistics beside each row; the strategy is the optimizer's."""
    return rows.join(stats, "symbol", "left")


SETTINGS_SCHEMA = (
    "ma_short_period int, ma_long_period int, rsi_period int, commission_rate double, max_position_size double"
)


def timeframe_configs(spark: SparkSession) -> DataFrame:
    """The fixed settings table: five rows, so always small enough to broadcast."""
    raw = spark.createDataFrame(TIMEFRAMES, "timeframe string, display_name string, config_json string")
    return raw.withColumn("cfg", F.from_json("config_json", SETTINGS_SCHEMA)).select(
        "timeframe", "display_name", "cfg.*"
    )


def timeframe_params(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(timeframe_configs(rows.sparkSession)), "timeframe", "left")
