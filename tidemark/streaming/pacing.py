"""Replays that keep a pace, and what each trigger did."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

c = F.col
PROGRESS = (
    "query string, batch bigint, started timestamp, rows bigint, rows_total bigint, rows_left bigint, seconds double, behind_seconds double, event_time string"
)


class Progress(StreamingQueryListener):
    """Rows, remaining rows and delay of each trigger of the queries named.

    ``due`` is the seconds between triggers that the pace asks for; a trigger is
    behind by the time it started after its turn.
    """

    def __init__(self, name: str, rows_expected: int | None = None, due: float = 0.0):
        self.name, self.expected, self.due = name, rows_expected, due
        self.rows: list[tuple] = []
        self.ended = threading.Event()
        self._first = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or not p.numInputRows:
            return
        at = datetime.fromisoformat(p.timestamp).timestamp()
        self._first = at if self._first is None else self._first
        total = (self.rows[-1][4] if self.rows else 0) + p.numInputRows
        left = None if self.expected is None else self.expected - total
        behind = max(0.0, at - self._first - len(self.rows) * self.due)
        took = float(p.durationMs.get("triggerExecution", 0)) / 1000
        self.rows.append((self.name, int(p.batchId), p.timestamp, int(p.numInputRows), total, left, took, behind, p.eventTime.get("max")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a trigger that read something."""
        text = PROGRESS.replace("started timestamp", "started string")
        return spark.createDataFrame(self.rows, text).withColumn("started", F.to_timestamp("started"))


def trigger_seconds(rows: int, files: int, files_per_trigger: int, speed: float) -> float:
    """Seconds between triggers at which ``speed`` rows a second go out on average."""
    if speed <= 0 or files_per_trigger < 1:
        raise ValueError("speed and files per trigger have to be positive")
    return rows / max(files, 1) * files_per_trigger / speed


def replay_paced(
    stream: DataFrame, path: str, checkpoint: str, every: float, name: str, rows_expected: int | None = None, patience: float = 600.0
) -> DataFrame:
    """Write a stream to a table, a trigger every ``every`` seconds, until it is drained; the progress table.

    How much a trigger takes is the source's admission control (files or offsets per
    trigger), so speed is that over ``every``. A trigger that takes longer than its
    turn is followed at once by the next: the delay shows as ``behind_seconds``.
    """
    spark = stream.sparkSession
    listener = Progress(name, rows_expected, every)
    spark.streams.addListener(listener)
    try:
        query = (
            stream.writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(processingTime=f"{every} seconds").start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        listener.ended.wait(patience)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark)
