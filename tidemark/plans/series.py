"""How one symbol's series is laid out over tasks.

Bars are unique on ``(symbol, date)``, so a series cannot be longer than the
calendar at its bar frequency.  Weekly to hourly series are short by that
proof and run as one window partition each.  For everything else (minute
bars, ticks, input of unknown frequency) a series may hold a third of the
table; ``per_series`` then cuts it into row blocks with a halo, so no task
ever sees more than ``block_rows + halo`` rows of one symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Window builder of a series; ``split`` marks a block of a longer one,
    where frames without a bound would be wrong and are refused."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("date",)
    split: bool = False

    def _unsplit(self) -> None:
        if self.split:
            raise ValueError("an unbounded frame was asked for inside a block of a series")

    @property
    def whole(self) -> WindowSpec:
        self._unsplit()
        return Window.partitionBy(*self.keys)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, first: int, last: int = 0) -> WindowSpec:
        return self.ordered.rowsBetween(first, last)

    def back(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` rows before it."""
        return self.frame(-(n - 1), 0)

    @property
    def running(self) -> WindowSpec:
        self._unsplit()
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)



BARS = Series()
#: One row per date: only ever applied after the aggregation by date.
DAILY = Series(keys=())
TICKS = Series(order=("ts",))

#: Calendar slots in two centuries, by bar frequency.
CALENDAR_ROWS = {
    "quarterly": 4 * 200,
    "monthly": 12 * 200,
    "1week": 53 * 200,
    "1day": 366 * 200,
    "1hour": 24 * 366 * 200,
    "15min": 96 * 366 * 200,
    "5min": 288 * 366 * 200,
    "1min": 1440 * 366 * 200,
}
#: Longest series left in one task.
MAX_SERIES_ROWS = 2_000_000
BLOCK_ROWS = 200_000


def calendar_bound(frequency: str | None) -> int | None:
    return CALENDAR_ROWS.get(frequency) if frequency else None


def fits_one_task(frequency: str | None) -> bool:
    bound = calendar_bound(frequency)
    return bound is not None and bound <= MAX_SERIES_ROWS


def default_bucket(s: Series) -> Column:
    """Coarse time slot used to number rows without one task per symbol."""
    return F.date_trunc("day", F.col(s.order[0]).cast("timestamp"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns where NULL equals NULL, as in groups and windows."""
    keyed = right.select(cell(*on).alias("_cell"), *[F.col(c) for c in right.columns if c not in on])
    return left.withColumn("_cell", cell(*on)).join(keyed, "_cell", how).drop("_cell")


def cell(*parts: str | Column) -> Column:
    """Keys as one value that is never NULL itself.

    Windows, groups and joins on it keep NULL keys together and share one layout:
    a join on nullable columns would need an order of its own.
    """
    return F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(f"k{i}") for i, x in enumerate(parts)])


def positions(df: DataFrame, s: Series = BARS, bucket: Column | None = None) -> DataFrame:
    """Add ``_pos``, the 0-based row number in the series, slot by slot.

    The only per-symbol window runs on slot counts (one row per symbol and
    slot); rows themselves are numbered inside ``(symbol, slot)``.
    """
    slot = bucket if bucket is not None else default_bucket(s)
    rows = df.withColumn("_cell", cell(*s.keys, slot))
    series, place = [F.col(f"_cell.k{i}") for i in range(len(s.keys))], F.col(f"_cell.k{len(s.keys)}")
    starts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "_cell", (F.sum("_n").over(Window.partitionBy(*series).orderBy(place)) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_cell").orderBy(*s.order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside)).join(starts, "_cell")
        .withColumn("_pos", F.col("_start") + F.col("_rn") - 1)
        .select(*df.columns, "_pos")
    )


def in_blocks(
    df: DataFrame,
    op: Callable[[DataFrame, Series], DataFrame],
    lookback: int,
    lookahead: int = 0,
    s: Series = BARS,
    block_rows: int = BLOCK_ROWS,
    bucket: Column | None = None,
) -> DataFrame:
    """Run a row-preserving window operator on blocks of each series.

    Each block carries the ``lookback`` rows before it and the ``lookahead``
    rows after it; results are kept for its own rows only, so the answer is
    that of the unsplit series.
    """
    if max(lookback, lookahead) > block_rows:
        raise ValueError("halo is longer than a block")
    own = F.floor(F.col("_pos") / block_rows)
    inside = F.col("_pos") % block_rows
    copies = F.array_compact(
        F.array(
            own,
            F.when(inside >= block_rows - lookback, own + 1),
            F.when((inside < lookahead) & (own > 0), own - 1),
        )
    )
    spread = (
        positions(df, s, bucket)
        .withColumns({"_home": own, "_block": F.explode(copies)})
        .drop("_pos")
    )
    out = op(spread, Series((*s.keys, "_block"), s.order, split=True))
    return out.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def per_series(
    df: DataFrame,
    op: Callable[[DataFrame, Series], DataFrame],
    lookback: int,
    lookahead: int = 0,
    s: Series = BARS,
    frequency: str | None = None,
    block_rows: int = BLOCK_ROWS,
    bucket: Column | None = None,
) -> DataFrame:
    """Plain windows when the bar frequency proves them short, else blocks."""
    if fits_one_task(frequency):
        return op(df, s)
    return in_blocks(df, op, lookback, lookahead, s, block_rows, bucket)


def with_stats(
    df: DataFrame, stats: dict[str, Column], s: Series = BARS, frequency: str | None = None
) -> DataFrame:
    """Whole-series aggregates beside each row.

    A window when the series is short; else grouped (with map-side combine)
    and joined back, so a hot symbol is never gathered.
    """
    if fits_one_task(frequency):
        return df.withColumns({n: a.over(s.whole) for n, a in stats.items()})
    rows = df.withColumn("_cell", cell(*s.keys))
    return rows.join(rows.groupBy("_cell").agg(*[a.alias(n) for n, a in stats.items()]), "_cell").drop("_cell")


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    s: Series = BARS,
    frequency: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Cumulative sums; two-level (slot totals, then rows) for long series."""
    if fits_one_task(frequency):
        return df.withColumns({n: F.sum(c).over(s.running) for n, c in sums.items()})
    names = list(sums)
    slot = bucket if bucket is not None else default_bucket(s)
    rows = df.withColumns({"_cell": cell(*s.keys, slot), **{f"_x_{n}": c for n, c in sums.items()}})
    series, place = [F.col(f"_cell.k{i}") for i in range(len(s.keys))], F.col(f"_cell.k{len(s.keys)}")
    totals = rows.groupBy("_cell").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*series).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_cell", *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    inside = Window.partitionBy("_cell").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_x_{n}").over(inside) for n in names})
    out = local.join(carry, "_cell").withColumns({
        n: F.coalesce(F.col(f"_l_{n}") + F.col(f"_c_{n}"), F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in names
    })
    return out.drop("_cell", *[f"_{k}_{n}" for k in "xlc" for n in names])
