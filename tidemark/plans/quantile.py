"""Exact quantiles of tables too large for the ``percentile`` aggregate.

``percentile`` keeps every distinct value of a group in one buffer.  Here
values are counted (a shuffle on key *and* value), a sketch of all groups'
values cuts each group into slices, slice totals say which slice holds the wanted rank, and only
those slices are ordered.  The sketch steers the work, it never decides a
result: the answer is the exact, linearly interpolated quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.series import cell

SLICES = 256


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ])).alias("_cv"),
    ).select(*by, "_cv.column", "_cv.value")


def _below(cuts: Column, value: str) -> Column:
    """How many of the sorted cuts lie below the value, by halving; 0 for NULL."""
    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(cuts, at + width - 1) < F.col(value), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(SLICES.bit_length()))]), F.lit(0), step)


def _sliced(counts: DataFrame, by: Sequence[str], value: str, slices: int = SLICES) -> DataFrame:
    """``sliced`` with the group also as one value, ``_group``, that is never NULL."""
    if not 1 <= slices <= SLICES:
        raise ValueError(f"between 1 and {SLICES} slices, not {slices}")
    steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    # the cuts are those of all groups' values and reach the rows as a scalar: a join with cuts of each group
    # would bring a whole group into one task
    cuts = counts.agg(F.array_sort(F.percentile_approx(value, steps, F.lit(slices * 40)))).scalar()
    rows = counts.withColumn("_group", cell(*by) if by else F.lit(0)).withColumn("_cuts", cuts)
    return rows.withColumn("_slice", _below(F.col("_cuts"), value)).drop("_cuts")


def sliced(
    counts: DataFrame, by: Sequence[str], value: str, slices: int = SLICES
) -> DataFrame:
    """Add ``_slice``: ordered value ranges of a group, from a mergeable sketch.

    Slices hold about equally many distinct values of all groups together, so none
    grows with how often a value occurs, and none of a group is larger than those.  No row is dropped: NULL is
    a group like any other, and measures may be NULL or negative.
    """
    return _sliced(counts, by, value, slices).drop("_group")


def cumulative(
    counts: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """Running totals of ``measures`` in value order, as ``{m}_upto``.

    ``counts`` has one row per (group, value).  Totals per slice are summed
    across slices, values only within one: no task orders a whole group.
    """
    by = list(by)
    rows = _sliced(counts, by, value, slices)
    place = ["_group", "_slice"]
    across = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*place).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures]).select(
        *place, *[F.coalesce(F.sum(f"_t_{m}").over(across), F.lit(0)).alias(f"_b_{m}") for m in measures]
    )
    inside = Window.partitionBy(*place).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({f"{m}_upto": F.sum(m).over(inside) for m in measures})
    return sums.join(starts, place).withColumns({
        f"{m}_upto": F.col(f"{m}_upto") + F.col(f"_b_{m}") for m in measures
    }).drop(*place, *[f"_b_{m}" for m in measures])


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """One row per group: ``by``, ``n`` and ``q`` (array, one per prob)."""
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rows = _sliced(counts, by, "_v", slices)
    place = ["_group", "_slice"]
    totals = rows.groupBy(*place).agg(F.sum("_c").alias("_t"))
    across = Window.partitionBy("_group").orderBy("_slice")
    wanted = (
        totals.withColumns({
            "_before": F.sum("_t").over(across) - F.col("_t"),
            "_n": F.sum("_t").over(Window.partitionBy("_group")),
        })
        .withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in sorted(probs)])))
        .withColumn("_h", F.col("_p") * (F.col("_n") - 1))
        .withColumn("_r", F.explode(F.array(F.floor("_h"), F.ceil("_h"))))
        .filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_t")))
        .groupBy(*place, "_before", "_n")
        .agg(F.collect_set(F.struct("_p", "_h", "_r")).alias("_ask"))
    )
    inside = Window.partitionBy(*place).orderBy("_v")
    hits = (
        rows.join(wanted, place)
        .withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_ask", F.explode("_ask"))
        .filter(
            (F.col("_ask._r") < F.col("_end"))
            & (F.col("_ask._r") >= F.col("_end") - F.col("_c"))
        )
    )
    # a quantile lies between at most two values: few for each group
    frac = F.col("_ask._h") - F.floor("_ask._h")
    near = F.struct(F.col("_ask._p").alias("p"), F.col("_v").alias("v"), frac.alias("f"))
    points = hits.groupBy("_group", *by, F.col("_n").alias("n")).agg(F.collect_set(near).alias("_near"))

    def between(p: float):
        own = F.filter("_near", lambda x: x["p"] == F.lit(float(p)))
        lo, hi = F.array_min(F.transform(own, lambda x: x["v"])), F.array_max(F.transform(own, lambda x: x["v"]))
        return lo + (hi - lo) * own[0]["f"]

    return points.select(*by, "n", F.array(*[between(p) for p in sorted(set(probs))]).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``column, n, q`` over the whole table, one row per column."""
    return exact_quantiles(unpivot(df, columns), "value", sorted(probs), ["column"])
