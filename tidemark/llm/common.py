"""Reading the corpus tables, and sizes the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import storage

#: Spark's setting that removes the shuffle files of a query when it ends
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: and the one of the rows that travel to Python at once
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The setting has the value for what runs meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table; what was shuffled for it is not read again and goes."""
    with setting(df.sparkSession, CLEANED, "true"):
        return storage.stage(df, name)


def free_of(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns that have one of ``names`` (whatever the case) called ``<name>_given`` instead."""
    taken = {c.lower() for c in (*docs.columns, *names)}
    for own in [c for c in docs.columns if c.lower() in {n.lower() for n in names}]:
        new = f"{own}_given"
        while new.lower() in taken:
            new += "_given"
        taken.add(new.lower())
        docs = docs.withColumnRenamed(own, new)
    return docs


def among(rows: DataFrame, column: str, wanted: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """The rows whose ``column`` is in the one column of ``wanted``, and a few more that a filter of fixed size lets through.

    No row is dealt for it: at most bits / 64 rows of the filter are broadcast.
    """
    def slot(name: str):
        return F.pmod(F.xxhash64(name), F.lit(bits))

    marks = wanted.select(slot(wanted.columns[0]).alias("slot")).selectExpr("slot div 64 AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.withColumn("slot", slot(column)).withColumn("word", F.expr("slot div 64")).join(F.broadcast(marks), "word")
    return found.filter(F.expr("(shiftrightunsigned(bits, CAST(slot % 64 AS INT)) & 1L) = 1")).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """What the session deals a shuffle to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
