"""Column helpers over a series: guarded frames, changes, ranks, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidemark.plans.series import BARS, Series


def div(a, b) -> Column:
    """Division that yields NULL, not an error, for a zero divisor."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def snap(x: Column, digits: int = 9) -> Column:
    """Cut float noise before a threshold test."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def full(agg: Callable[[Column], Column], x: Column, n: int, s: Series = BARS) -> Column:
    """``agg`` over the last ``n`` rows, NULL until all of them are non-null."""
    w = s.back(n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def mean(x: Column, n: int, s: Series = BARS) -> Column:
    return full(F.avg, x, n, s)


def std(x: Column, n: int, s: Series = BARS) -> Column:
    return full(F.stddev_samp, x, n, s)


def prev(x: Column, k: int = 1, s: Series = BARS) -> Column:
    return F.lag(x, k).over(s.ordered)


def pct_change(x: Column, k: int = 1, s: Series = BARS) -> Column:
    p = prev(x, k, s)
    return div(x - p, p)


def corr(x, y, w: WindowSpec | None = None) -> Column:
    """Correlation, NULL (where the built-in raises) for a constant side.

    Rows with either side NULL are ignored, as the built-in does.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(x, y), F.stddev_pop(a), F.stddev_pop(b)]
    if w is not None:
        parts = [p.over(w) for p in parts]
    return div(parts[0], parts[1] * parts[2])


def frame_skew(x: Column, n: int, s: Series = BARS) -> Column:
    return full(F.skewness, x, n, s) * ((n * (n - 1)) ** 0.5 / (n - 2))


def frame_kurt(x: Column, n: int, s: Series = BARS) -> Column:
    g2 = full(F.kurtosis, x, n, s)
    return (g2 * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def frame_quantile(x: Column, p: float, n: int, s: Series = BARS) -> Column:
    """Interpolated quantile of a bounded frame."""
    return full(lambda c: F.percentile(c, F.lit(p)), x, n, s)


def frame_rank(x: Column, n: int, s: Series = BARS) -> Column:
    """Average rank of the current value in its frame, as a share."""
    w = s.back(n)
    seen = F.collect_list(x).over(w)
    less = F.size(F.filter(seen, lambda v: v < x))
    same = F.size(F.filter(seen, lambda v: v == x))
    return F.when(F.count(x).over(w) == n, (less + (same + 1) / 2) / n)


def longest_run(flag: Column, n: int, s: Series = BARS) -> Column:
    """Longest stretch of true flags in the last ``n`` rows."""
    seen = F.collect_list(flag).over(s.back(n))
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(acc, v):
        cur = F.when(v, acc["cur"] + 1).otherwise(0)
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    return F.when(
        F.count(flag).over(s.back(n)) == n,
        F.aggregate(seen, zero, step, lambda acc: acc["best"]),
    )


def true_range(s: Series = BARS, null_first: bool = False) -> Column:
    """High-low range widened by the gap to the previous close.

    ``null_first`` leaves a series' first row NULL instead of high - low.
    """
    p = prev(F.col("close"), 1, s)
    wide = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)
    )
    return F.when(p.isNotNull(), wide) if null_first else wide


def minmax(x: Column, s: Series = BARS) -> Column:
    """Position of a value between its series' minimum and maximum."""
    lo, hi = F.min(x).over(s.whole), F.max(x).over(s.whole)
    return div(x - lo, hi - lo)


def mean_of(*parts: Column) -> Column:
    """Row-wise mean of the non-null parts."""
    some = [F.coalesce(p, F.lit(0.0)) for p in parts]
    n = [p.isNotNull().cast("int") for p in parts]
    total, count = some[0], n[0]
    for a, b in zip(some[1:], n[1:]):
        total, count = total + a, count + b
    return div(total, count)


def flag(cond: Column) -> Column:
    """0/1, with an unknown condition counted as not met."""
    return F.coalesce(cond, F.lit(False)).cast("int")
