"""As-of and nearest joins as a union plus carried values.

Left and right rows are stacked, and the last (first) right row before
(after) each left row is carried along the time order.  Carrying is done
inside ``(key, time slot)``; only one row per key and slot, its last and first
right row, crosses slots.  No range join, and no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.series import cell


def neighbours(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    payload: list[str],
    tie: list[str] | None = None,
    slot: Column | None = None,
    following: bool = False,
) -> DataFrame:
    """Left rows with ``_prev`` (and ``_next``): right rows around them.

    ``_prev`` is the latest right row at or before the left row's time,
    ``_next`` the earliest one after it.  ``tie`` orders right rows of equal
    time for ``_prev``: the first of them is taken.  Left rows without key or
    time stay, with nothing around them; such right rows are near nothing.
    """
    right = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    slot = slot if slot is not None else F.date_trunc("month", F.col(time).cast("timestamp"))
    tie = tie or []
    picked = F.struct(F.col(time), *[F.col(c) for c in payload])
    # one right row per time: the first by the tie order
    first = right.groupBy(key, time).agg(
        F.min_by(picked, F.struct(*tie) if tie else F.col(time)).alias("_hit")
    )
    columns = left.columns
    lefts = left.select(
        F.col(key), F.col(time), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"),
        F.lit(None).cast(first.schema["_hit"].dataType).alias("_hit"),
    )
    rights = first.select(
        F.col(key), F.col(time), F.lit(0).alias("_side"),
        F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), "_hit",
    )
    at = cell(key, slot).alias("_cell")
    both = lefts.unionByName(rights).select("*", at)
    edges = rights.select("*", at).groupBy("_cell").agg(F.max_by("_hit", time).alias("_last"), F.min_by("_hit", time).alias("_first"))
    slots = both.select("_cell").distinct().join(edges, "_cell", "left")
    across = Window.partitionBy("_cell.k0").orderBy("_cell.k1")
    carried = slots.select(
        "_cell",
        F.last("_last", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.first("_first", ignorenulls=True)
        .over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"),
    )
    inside = Window.partitionBy("_cell").orderBy(time, "_side")
    out = both.withColumn(
        "_prev",
        F.last("_hit", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    )
    if following:
        # same sort order, read from the other end: a running frame, not a growing one
        back = Window.partitionBy("_cell").orderBy(F.col(time).desc(), F.col("_side").desc())
        out = out.withColumn(
            "_next",
            F.last("_hit", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        )
    out = out.filter("_side = 1").join(carried, "_cell")
    timed = F.col(time).isNotNull()
    extra = [F.when(timed, F.coalesce("_prev", "_carry")).alias("_prev")]
    if following:
        extra.append(F.when(timed, F.coalesce("_next", "_ahead")).alias("_next"))
    return out.select("_row.*", *extra)


def asof(
    left: DataFrame, right: DataFrame, key: str, time: str, payload: list[str],
    slot: Column | None = None,
) -> DataFrame:
    """Left rows plus the payload of the latest right row at or before them."""
    out = neighbours(left, right, key, time, payload, slot=slot)
    return out.select(*left.columns, *[F.col(f"_prev.{c}").alias(c) for c in payload])
