"""Exponentially weighted means without Python and without growing frames.

``y_n = sum_i q^(n-i) x_i / sum_i q^(n-i)`` is a scaled prefix sum.  Scaling
overflows on long series, so each series is numbered off in spans of ``B``
rows, ``B >= ceil(41 / -ln q)``: weights older than one span are below 1e-17
of the total, hence the local prefix sum plus the last local value of the
span before is exact to double precision.

All means of a call share one span length.  The span number grows with the
position, so windows inside a span and across spans need the same order
(keys, span, time): one sort serves them all, and the exchange by key is the
one the surrounding windows already have.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.series import BARS, Series

#: exponents beyond this overflow a double
MAX_EXPONENT = 600.0


def memory_rows(span: int) -> int:
    """Rows after which a value has no weight left in double precision."""
    return math.ceil(41 / -math.log(1 - 2 / (span + 1)))


def number_off(df: DataFrame, spans: list[int], s: Series = BARS) -> DataFrame:
    """Add ``_n`` (position), ``_b`` (span number), ``_p`` (position in span)."""
    size = max(memory_rows(x) for x in spans)
    if max(-math.log(1 - 2 / (x + 1)) for x in spans) * size > MAX_EXPONENT:
        raise ValueError("spans differ too much for one pass; call ewm once per span")
    n = F.row_number().over(s.ordered) - 1
    return df.withColumn("_n", n).withColumns(
        {"_b": F.floor(F.col("_n") / size), "_p": F.col("_n") % size, "_size": F.lit(size)}
    )


def ewm_numbered(df: DataFrame, means: dict[str, tuple[str, int]], s: Series = BARS) -> DataFrame:
    inside = (
        Window.partitionBy(*s.keys, "_b").orderBy(*s.order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    across = (
        Window.partitionBy(*s.keys).orderBy("_b", *s.order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    p = F.col("_p")
    out = df.withColumns({
        f"_l_{name}": F.pow(F.lit(1 - 2 / (span + 1)), p)
        * F.sum(F.col(x) * F.pow(F.lit(1 - 2 / (span + 1)), -p)).over(inside)
        for name, (x, span) in means.items()
    })
    last_of_span = p == F.col("_size") - 1
    whole = {}
    for name, (_, span) in means.items():
        q, local = 1 - 2 / (span + 1), F.col(f"_l_{name}")
        carry = F.last(F.when(last_of_span, local), ignorenulls=True).over(across)
        whole[name] = (
            (local + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(q), p + 1))
            * (1 - q) / (1 - F.pow(F.lit(q), F.col("_n") + 1))
        )
    return out.withColumns(whole).drop(*[f"_l_{name}" for name in means])


def ewm(df: DataFrame, means: dict[str, tuple[str, int]], s: Series = BARS) -> DataFrame:
    """Add ``{output: (input column, span)}``; inputs must not be NULL."""
    numbered = number_off(df, [span for _, span in means.values()], s)
    return ewm_numbered(numbered, means, s).drop("_n", "_b", "_p", "_size")
