"""Gaps and islands over a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.series import Series, cell, default_bucket


def islands(df: DataFrame, flag: Column, s: Series) -> DataFrame:
    """Add ``_flag`` and ``_island``: a number constant over each run of equal flags."""
    marked = df.withColumn("_flag", flag)
    changed = (F.col("_flag") != F.lag("_flag").over(s.ordered)).cast("int")
    return marked.withColumn("_new", F.coalesce(changed, F.lit(1))).withColumn(
        "_island", F.sum("_new").over(s.running)
    ).drop("_new")


def run_lengths(df: DataFrame, flag: Column, s: Series, bucket: Column | None = None) -> DataFrame:
    """``keys, _flag, _n``: the runs of equal flags of each series, whatever its length.

    Runs are found inside ``(keys, slot)``. Those in the middle of a slot are whole;
    only the first and the last of a slot can go on in the next one, so at most two
    rows a slot are put in order along the series. A flag must not be NULL.
    """
    slot = bucket if bucket is not None else default_bucket(s)
    rows = df.select(*s.keys, cell(*s.keys, slot).alias("_cell"), *s.order, flag.alias("_flag"))
    inside = Window.partitionBy("_cell").orderBy(*s.order)
    begins = F.coalesce((F.col("_flag") != F.lag("_flag").over(inside)).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", begins).withColumn(
        "_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("_cell", "_run", "_flag").agg(*[F.first(k).alias(k) for k in s.keys], F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_last", F.max("_run").over(Window.partitionBy("_cell")))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    along = Window.partitionBy(*[f"_cell.k{i}" for i in range(len(s.keys))]).orderBy(f"_cell.k{len(s.keys)}", "_run")
    # two runs of one slot are never one: others lie between them, or their flags differ
    goes_on = (F.col("_flag") == F.lag("_flag").over(along)) & (F.lag("_cell").over(along) != F.col("_cell"))
    joined = runs.filter(edge).withColumn("_new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn(
        "_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    across = joined.groupBy(*s.keys, "_island", "_flag").agg(F.sum("_n").alias("_n")).drop("_island")
    return runs.filter(~edge).select(*s.keys, "_flag", "_n").unionByName(across)
