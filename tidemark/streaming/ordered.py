"""Streams whose rows arrive out of order, late or twice, without losing any.

``ordered_statuses`` holds bars back until the watermark has passed them and then
classifies them in time order; what arrives after that is handed on as late, not
dropped. ``first_copies_to_table`` keeps one row a key in its sink, so neither the
triggers nor the order of files change the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.params import BREADTH, Breadth
from tidemark.sources.storage import table_exists

c = F.col
#: a row dated here or later only moves the watermark: it ends a stream, see ``end_stream``
END_OF_STREAM = pd.Timestamp("2200-01-01")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """State with timers needs the key-value state store while a query runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# -- landing ----------------------------------------------------------------------
def land_in_slices(df: DataFrame, path: str, arrival: Column, slices: int) -> None:
    """Write rows in order of arrival, one append a slice of about equal size."""
    timed = df.withColumn("_at", arrival)
    shares = [(k + 1) / slices for k in range(slices - 1)]
    cuts = timed.agg(F.percentile_approx("_at", shares).alias("cuts")).first()["cuts"] if shares else []
    edges = [None, *(cuts or []), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = timed
        if low is not None:
            part = part.filter(c("_at") > F.lit(low))
        if high is not None:
            part = part.filter((c("_at") <= F.lit(high)) if low is not None else (c("_at") <= F.lit(high)) | c("_at").isNull())
        part.drop("_at").write.mode("append").parquet(path)


def end_stream(spark: SparkSession, path: str, schema, time_col: str = "date") -> None:
    """Append the row that lets a drained stream give out all it still holds."""
    names = schema.fieldNames()
    row = [F.lit(END_OF_STREAM.to_pydatetime()) if n == time_col else F.lit(None).cast(schema[n].dataType) for n in names]
    end = spark.range(1, numPartitions=1).select(*[x.cast(schema[n].dataType).alias(n) for n, x in zip(names, row, strict=True)])
    end.write.mode("append").parquet(path)


# -- statuses in time order --------------------------------------------------------------
class _InOrder(StatefulProcessor):
    """Bars of one symbol: held until the watermark passes them, then compared with the last close.

    The state is the bars not yet passed, as many as arrive within the lateness, and
    the last close given out. One timer stands at the earliest held bar.
    """

    def __init__(self, p: Breadth):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us bigint, close double")
        self.last = handle.getValueState("last", "close double")

    def _rows(self, key, us: list, closes: list, changes: list, late: bool) -> pd.DataFrame:
        change = pd.Series(changes, dtype=float)
        status = pd.Series("unchanged", index=change.index, dtype=object)
        status[change > self.p.advance], status[change < self.p.decline] = "advancing", "declining"
        return pd.DataFrame({
            "symbol": pd.Series([key] * len(us), dtype=object), "date": pd.to_datetime(pd.Series(us, dtype="Int64"), unit="us"),
            "close": pd.Series(closes, dtype=float), "price_change_pct": change,
            "issue_status": None if late else status, "late": late,
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        earliest, gone = None, ([], [])
        for pdf in rows:
            pdf = pdf[~(pdf["date"] >= END_OF_STREAM)]
            # a missing time can't be put in order
            us = [None if pd.isna(t) else t.value // 1000 for t in pdf["date"]]
            keep = []
            for t, close in zip(us, pdf["close"].tolist(), strict=True):
                if t is None or t < passed:
                    gone[0].append(t)
                    gone[1].append(close)
                else:
                    keep.append((t, close))
            if keep:
                self.held.appendList(keep)
                first = min(t for t, _ in keep)
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self._wake(earliest)
        yield self._rows(key[0], *gone, [None] * len(gone[0]), late=True)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((t, x) for t, x in self.held.get()), key=lambda r: r[0])
        ready = [r for r in held if r[0] < passed]
        rest = held[len(ready):]
        if rest:
            self.held.put(rest)
            self._wake(rest[0][0])
        else:
            self.held.clear()
        before = self.last.get()[0] if self.last.exists() else None
        changes = []
        for _, close in ready:
            known = close is not None and before is not None and not pd.isna(close) and not pd.isna(before) and before != 0
            changes.append((close - before) / before if known else None)
            before = close
        if ready:
            self.last.update((before,))
        yield self._rows(key[0], [t for t, _ in ready], [x for _, x in ready], changes, late=False)

    def close(self) -> None:
        pass


def ordered_statuses(bars: DataFrame, lateness: str, p: Breadth = BREADTH) -> DataFrame:
    """Advancing, declining or unchanged, as in the batch form, for bars in any order.

    A bar not more than ``lateness`` behind the newest bar of earlier triggers is
    classified in its place. One farther behind comes out with ``late`` set and no
    status; so does one without time. Bars of one time keep no order among themselves.
    """
    symbol = bars.schema["symbol"].dataType.simpleString()
    schema = f"symbol {symbol}, date timestamp, close double, price_change_pct double, issue_status string, late boolean"
    # the clock is a column of its own: the engine drops late rows only where it sees the watermarked one
    timed = bars.select("symbol", "date", "close", c("date").alias("_clock")).withWatermark("_clock", lateness).drop("_clock")
    return timed.groupBy("symbol").transformWithStateInPandas(_InOrder(p), schema, "append", "eventTime")


# -- sinks ---------------------------------------------------------------------------------
def _run_name(checkpoint: str) -> str:
    return f"{zlib.crc32(checkpoint.encode()):08x}"


def _drain(stream: DataFrame, checkpoint: str, step) -> list[dict]:
    with keyed_state(stream.sparkSession):
        query = (
            stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
            .foreachBatch(step).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


def split_late(stream: DataFrame, path: str, late_path: str, checkpoint: str) -> list[dict]:
    """Drain a stream with a ``late`` column into two tables.

    Each trigger owns one folder of each table and replaces it, so a trigger that is
    run again after a failure leaves no row twice.
    """
    run = _run_name(checkpoint)

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for at, rows in ((path, batch.filter(~c("late"))), (late_path, batch.filter("late"))):
                rows.drop("late").write.mode("overwrite").parquet(f"{at}/of={run}/epoch={epoch}")
        finally:
            batch.unpersist()

    return _drain(stream, checkpoint, step)


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """A table of trigger folders, without the columns that name them."""
    return spark.read.parquet(path).drop("of", "epoch")


def first_copies_to_table(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time_col: str | None = None, order: Sequence[str] = ()
) -> list[dict]:
    """Drain a stream into a table of one row a key, however late a copy comes.

    A trigger writes the keys that no other trigger has written, compared with NULL
    equal to NULL. It owns one folder and replaces it when run again. ``time_col``,
    one of the keys, limits the look-up to the time span of the trigger's rows. Of
    copies in one trigger the smallest row stays. With ``order``, a copy that is
    smaller in those columns than the one written is written too, and
    ``read_first_copies`` gives the smallest whatever came first.
    """
    run = _run_name(checkpoint)
    spark = stream.sparkSession
    if time_col is not None and time_col not in keys:
        raise ValueError("the time column has to be one of the keys")

    def step(batch: DataFrame, epoch: int) -> None:
        rest = [n for n in batch.columns if n not in keys]
        ranked = [*order, *[n for n in rest if n not in order]]
        best = F.min(F.struct(*ranked)).alias("_row") if ranked else F.lit(None).alias("_row")
        fresh = batch.groupBy(*keys).agg(best).persist()
        try:
            if table_exists(spark, path):
                seen = spark.read.parquet(path).filter(~((c("of") == run) & (c("epoch") == epoch)))
                if time_col is not None:
                    span = fresh.agg(F.min(time_col).alias("low"), F.max(time_col).alias("high"), F.count_if(c(time_col).isNull()).alias("none")).first()
                    inside = c(time_col).between(F.lit(span["low"]), F.lit(span["high"]))
                    seen = seen.filter(inside | c(time_col).isNull() if span["none"] else inside)
                seen = seen.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], *([F.struct(*order).alias("_seen")] if order else []))
                same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_k{i}")) for i, k in enumerate(keys)])
                if order:
                    same = same & (c("_seen") <= F.struct(*[c(f"_row.{n}").alias(n) for n in order]))
                new = fresh.join(seen, same, "left_anti")
            else:
                new = fresh
            new.select(*[c(n) if n in keys else c(f"_row.{n}").alias(n) for n in batch.columns]).write.mode("overwrite").parquet(
                f"{path}/of={run}/epoch={epoch}")
        finally:
            fresh.unpersist()

    return _drain(stream, checkpoint, step)


def read_first_copies(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    rows = epochs(spark, path)
    if not order:
        return rows
    rest = [n for n in rows.columns if n not in keys]
    ranked = [*order, *[n for n in rest if n not in order]]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_row"))
    return best.select(*[c(n) if n in keys else c(f"_row.{n}").alias(n) for n in rows.columns])
