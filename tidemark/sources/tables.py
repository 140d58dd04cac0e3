"""Bar, report, tick, trade and run-log tables derived from the given data.

Each property is a lazy plan over the parquet tables (``bars_landed`` excepted);
nothing is cached or collected.  A deployment with landed bar tables swaps this class for
``storage.read_table``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import stage


def week(ts: Column) -> Column:
    """Monday of the week, by date arithmetic (no session time zone)."""
    d = ts.cast("date")
    return F.date_sub(d, F.weekday(d))


def nation_symbol(key: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))


class Tables:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    # -- bars ---------------------------------------------------------------
    @cached_property
    def lines(self) -> DataFrame:
        """Line items as prints: unit price plus the full time-order key."""
        return self.read("lineitem").select(
            "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount",
            "l_returnflag",
            # the hair makes exact decimal ties round alike everywhere
            (F.col("l_extendedprice") / F.col("l_quantity") + 1e-9).alias("p"),
            F.struct(
                "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
            ).alias("k"),
        )

    @cached_property
    def bars_w(self) -> DataFrame:
        """Weekly bars, symbol = supplier nation.

        One scan, one equi-join (a hot supplier is AQE's skew join to split)
        and one aggregation with map-side combine: a hot nation ships one
        partial row per task and week, not its lines.
        """
        # within a week the first three key columns pack into one number; a
        # narrow order key and an integer group key keep the aggregation light
        first = F.weekday("l_shipdate") * F.lit(10**13) + F.col("k.l_orderkey")
        prints = self.lines.join(
            self.read("supplier").select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        ).select(
            "s_nationkey", week(F.col("l_shipdate")).alias("date"), "p", "l_quantity",
            F.struct(
                (first * 10 + F.col("k.l_linenumber")).alias("a"), F.col("k.l_partkey"), F.col("k.l_suppkey")
            ).alias("k"),
        )
        return (
            prints.groupBy("s_nationkey", "date")
            .agg(
                F.round(F.min_by("p", "k"), 6).alias("open"),
                F.round(F.max("p"), 6).alias("high"),
                F.round(F.min("p"), 6).alias("low"),
                F.round(F.max_by("p", "k"), 6).alias("close"),
                (F.sum("l_quantity") * 100).cast("bigint").alias("volume"),
            )
            .select(
                nation_symbol(F.col("s_nationkey")).alias("symbol"), "date", "open", "high", "low", "close",
                "volume", F.col("close").alias("adj_close"),
            )
        )

    @cached_property
    def bars_landed(self) -> DataFrame:
        """The weekly bars as a written table, for queries that read them
        more than once: deriving them again costs a scan of the prints each."""
        return stage(self.bars_w, "bars")

    @cached_property
    def bars_d(self) -> DataFrame:
        """Daily sparse series, symbol = supplier."""
        return self.read("lineitem").groupBy(
            F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
        ).agg(
            F.round(F.avg("l_extendedprice"), 6).alias("close"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )

    @cached_property
    def bars_h(self) -> DataFrame:
        """Hourly bars, symbol = event type."""
        key = F.struct("ts", "event_id")
        return self.read("events").groupBy(
            F.col("event_type").alias("symbol"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"),
        ).agg(
            F.min_by("value", key).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", key).alias("close"),
            (F.count(F.lit(1)) * 1000).alias("volume"),
        )

    @cached_property
    def dirty_bars(self) -> DataFrame:
        """Weekly bars with planted gaps, bad prices and repeated rows."""
        w = Window.partitionBy("symbol").orderBy("date")
        bars = self.bars_landed
        per = bars.groupBy("symbol").count()
        start = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
        offset = per.select(
            "symbol", F.coalesce(F.sum("count").over(start), F.lit(0)).alias("o")
        )
        i = F.col("i")
        dirty = (
            bars.join(offset, "symbol")
            .withColumn("i", F.row_number().over(w) + F.col("o"))
            .select(
                "symbol", "date", "open", "high", "low",
                F.when(i % 17 == 0, F.lit(None).cast("double"))
                .when(i % 23 == 0, F.lit(-1.0)).otherwise(F.col("close")).alias("close"),
                F.when(i % 19 == 0, F.lit(0).cast("bigint")).otherwise(F.col("volume")).alias("volume"),
                "adj_close", "i",
            )
        )
        copies = F.when(i % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return dirty.withColumn("_c", F.explode(copies)).drop("_c", "i")

    # -- reports, sentiment, ticks --------------------------------------------
    @cached_property
    def fundamentals_q(self) -> DataFrame:
        """Quarterly reports, symbol = customer nation.

        Balances are summed over distinct customers from a (symbol, quarter,
        customer) pre-aggregate, so no distinct set is ever held in a buffer.
        """
        status, price = F.col("o_orderstatus"), F.col("o_totalprice")
        per_customer = (
            self.read("orders").join(
                self.read("customer").select("c_custkey", "c_nationkey", "c_acctbal"),
                F.col("o_custkey") == F.col("c_custkey"),
            )
            .groupBy(
                nation_symbol(F.col("c_nationkey")).alias("symbol"),
                F.trunc("o_orderdate", "quarter").alias("date"), "c_custkey", "c_acctbal",
            )
            .agg(
                F.sum(price).alias("rev"),
                F.sum(F.when(status == "F", price).otherwise(0.0)).alias("f"),
                F.sum(F.when(status == "P", price).otherwise(0.0)).alias("p"),
                F.sum(F.when(status == "O", price).otherwise(0.0)).alias("o"),
            )
        )
        q = per_customer.groupBy("symbol", "date").agg(
            F.round(F.sum("rev"), 2).alias("revenue"),
            F.round(F.sum("f") - 0.5 * F.sum("p"), 3).alias("net_income"),
            F.round(F.sum("c_acctbal"), 2).alias("equity"),
            F.round(F.sum("o"), 2).alias("inventory"),
            F.round(F.sum("p"), 2).alias("accounts_receivable"),
        )
        return q.select(
            "symbol", "date", "revenue", "net_income", F.col("net_income").alias("earnings"),
            (F.col("revenue") * 2).alias("total_assets"), "equity",
            F.round(F.col("revenue") * 2 - F.col("equity"), 2).alias("total_debt"),
            "inventory", "accounts_receivable", (F.col("revenue") * 10).alias("market_cap"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("symbol"), "ts", "event_id",
            F.round(F.col("value") - 0.01, 6).alias("bid"),
            F.round(F.col("value") + 0.01, 6).alias("ask"),
            F.col("user_id").alias("volume"),
        )

    @cached_property
    def sentiment_items(self) -> DataFrame:
        m = F.col("event_id") % 3
        return self.read("events").select(
            F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date"), "event_id",
            F.when(m == 0, "Positive").when(m == 1, "neutral").otherwise("NEGATIVE").alias("sentiment"),
        )

    @cached_property
    def sentiment_d(self) -> DataFrame:
        e, m, value = F.col("event_id") % 2, F.col("event_id") % 3, F.col("value")
        return self.read("events").groupBy(
            F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date")
        ).agg(
            F.count_if(e == 0).alias("positive_mentions"),
            F.count_if(e == 1).alias("negative_mentions"),
            F.count(F.lit(1)).alias("news_count"),
            F.try_divide(
                (F.count_if(e == 0) - F.count_if(e == 1)).cast("double"), F.count(F.lit(1)).cast("double")
            ).alias("sentiment_score"),
            F.round(F.sum(F.when(e == 1, value).otherwise(0.0)), 4).alias("put_volume"),
            F.round(F.sum(F.when(e == 0, value).otherwise(0.0)), 4).alias("call_volume"),
            F.count_if(m == 0).alias("buy_ratings"),
            F.count_if(m == 1).alias("hold_ratings"),
            F.count_if(m == 2).alias("sell_ratings"),
            F.round(F.sum(value), 4).alias("volume"),
        )

    # -- trades, equity ------------------------------------------------------
    @cached_property
    def trades(self) -> DataFrame:
        """Every print of a supplier is a trade."""
        qty, p = F.col("l_quantity"), F.round("p", 6)
        return self.lines.select(
            F.col("l_suppkey").alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("k.l_orderkey").alias("order_id"), F.col("k.l_linenumber").alias("line"),
            F.col("k.l_partkey").alias("part_id"),
            F.when(F.col("l_returnflag") == "A", "buy")
            .when(F.col("l_returnflag") == "R", "sell").otherwise("hold").alias("signal_type"),
            qty.alias("quantity"), p.alias("price"),
            F.round(F.greatest(qty * p * 0.001, F.lit(1.0)) + 1e-10, 6).alias("commission"),
            F.round(qty * p * 0.0005 + 2e-11, 6).alias("slippage"),
            F.round((F.col("l_discount") - 0.05) * F.col("l_extendedprice"), 6).alias("realized_pnl"),
        )

    @cached_property
    def equity(self) -> DataFrame:
        """Weekly equity: a start value plus running profit, one row a date."""
        weekly = self.read("lineitem").groupBy(week(F.col("l_shipdate")).alias("date")).agg(
            F.round(
                F.sum((F.col("l_discount") - 0.05) * F.col("l_extendedprice")) / 100, 6
            ).alias("pnl")
        )
        running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return weekly.select(
            "date", F.round(F.sum("pnl").over(running) + 100000, 6).alias("total_value")
        )

    # -- run log --------------------------------------------------------------
    @cached_property
    def pipeline_runs(self) -> DataFrame:
        kind, u = F.col("event_type"), F.col("user_id") % 5
        status = (
            F.when(kind.isin("purchase", "click"), "completed")
            .when(kind == "error", "failed").when(kind == "view", "running").otherwise("stopped")
        )
        return self.read("events").select(
            F.col("event_id").alias("run_id"), kind.alias("command"), status.alias("status"),
            F.col("ts").alias("start_time"),
            F.when(status != "running", F.col("value")).alias("duration"),
            F.when(u == 0, "1day").when(u == 1, "1hour").when(u == 2, "15min")
            .when(u == 3, "5min").otherwise("1min").alias("timeframe"),
            F.col("props").alias("metadata"), "user_id", "value",
        )
