"""Reading, writing and maintaining bar tables.

Format is a parameter everywhere; parquet is the default, a lake format is a
matter of having its connector on the class path.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
FORMATS = ("parquet", "orc", "csv", "json", "delta")
MODES = ("append", "overwrite", "error", "ignore")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder the cluster names.

    Only a local session without that setting (tests) gets a folder of its own,
    which is then also set for later callers; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table: survives the loss of any executor."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    return fmt


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", predicate: str | None = None, schema=None) -> DataFrame:
    """A table by path; the predicate prunes partitions and row groups."""
    from tidemark.sources import snapshots

    reader = spark.read.format(_check_format(fmt))
    pointed = snapshots.entries(spark, path)
    if pointed is not None:
        df = snapshots.read_entries(spark, path, pointed, fmt)
        return df.filter(F.expr(predicate)) if predicate else df
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df.filter(F.expr(predicate)) if predicate else df


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)})


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append", fmt: str = "parquet",
    max_records: int = 5_000_000,
) -> None:
    """Partitioned write.

    The rebalance hint gathers each partition's rows into few files, and lets
    adaptive execution split a partition that holds far more than the others.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode!r}")
    missing = [p for p in partition_by if p in ("year", "month", "day") and p not in df.columns]
    if missing:
        df = with_date_parts(df)
        df = df.drop(*[p for p in ("year", "month", "day") if p not in partition_by])
    if partition_by:
        df = df.hint("rebalance", *[c(p) for p in partition_by])
    writer = df.write.format(_check_format(fmt)).mode(mode).option("maxRecordsPerFile", max_records)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def upsert_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target no source row replaces, plus the source."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def upsert_by_key(
    spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> None:
    """Update matched, insert new, create if absent; a failed job leaves the table as it was.

    Only partitions the source touches are rewritten, and only those are read: the
    touched partition values come as a semi-join the scan prunes with. A key that
    stands twice in the source is refused.
    """
    from tidemark.sources import snapshots

    if any(p not in source.columns for p in partition_by):
        parts = with_date_parts(source)
        source = parts.select(*source.columns, *[p for p in partition_by if p not in source.columns])
    snapshots.upsert(spark, source, path, keys, partition_by, _check_format(fmt))


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def compact_table(spark: SparkSession, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Rewrite the partitions of many small files; adaptive rebalancing sizes the new ones."""
    from tidemark.sources import snapshots

    snapshots.compact(spark, path, partition_by, _check_format(fmt))


def file_listing(df: DataFrame) -> DataFrame:
    """One row per data file behind a file-based table."""
    return df.select(
        c("_metadata.file_path").alias("path"), c("_metadata.file_size").alias("size"),
        c("_metadata.file_modification_time").alias("modified"),
    ).groupBy("path").agg(F.first("size").alias("size"), F.first("modified").alias("modified"), F.count(F.lit(1)).alias("rows"))


def table_info(spark: SparkSession, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    files = file_listing(read_table(spark, path, fmt))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.agg(
        F.lit(True).alias("exists"), F.lit(path).alias("location"), F.lit(fmt).alias("format"),
        F.lit(",".join(partition_by)).alias("partition_columns"), F.countDistinct(folder).alias("partitions"),
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"),
    )


# -- layout by type / list / date ---------------------------------------------------
LAYOUT = ("data_type", "symbol_list", "year", "month", "day")


def layout_path(date: Column, data_type: str, symbol_list: str, filename: str) -> Column:
    return F.concat_ws(
        "/", F.lit(data_type), F.lit(symbol_list), F.date_format(date, "yyyy"), F.date_format(date, "MM"),
        F.date_format(date, "dd"), F.lit(filename),
    )


def write_layout(df: DataFrame, path: str, data_type: str, symbol_list: str, fmt: str = "parquet") -> None:
    parts = with_date_parts(df).withColumns({
        "data_type": F.lit(data_type), "symbol_list": F.lit(symbol_list),
        "month": F.date_format("date", "MM"), "day": F.date_format("date", "dd"),
    })
    write_table(parts, path, LAYOUT, "append", fmt)


def _part(name: str) -> Column:
    return F.regexp_extract("path", f"/{name}=([^/]+)", 1)


def storage_summary(files: DataFrame) -> DataFrame:
    """Objects, bytes and date range by data type and list, from file paths."""
    day = F.make_date(_part("year").cast("int"), _part("month").cast("int"), _part("day").cast("int"))
    rows = files.select(_part("data_type").alias("data_type"), _part("symbol_list").alias("symbol_list"), day.alias("day"), "size")
    return rows.groupBy("data_type", "symbol_list").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), (F.sum("size") / (1024 * 1024)).alias("mb"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def retention_cleanup(files: DataFrame, cutoff: Column) -> DataFrame:
    """Which files are older than the cutoff, and what removing them frees."""
    return files.filter(c("modified") < cutoff).agg(
        F.count(F.lit(1)).alias("expired_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed_bytes")
    )
