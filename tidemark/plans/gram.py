"""All pairwise correlations of many columns in one job.

An expression for each pair makes a plan that grows with the square of the
columns. Here each task multiplies the matrix of its rows with itself and sends
one number a pair and sum; the rows of a pair are those where both are present.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
SUMS = ("n", "x", "y", "xx", "yy", "xy")
#: rows multiplied at once, so a wide batch stays small
ROWS = 2048
#: a variance below this share of the mean square is rounding: the column is constant
ROUNDING = 1e-12


def _products(width: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                values = batch.column(0).slice(lo, ROWS).flatten()
                here = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
                x = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
                with np.errstate(invalid="ignore", over="ignore"):
                    n += here.T @ here
                    s += x.T @ here
                    q += (x * x).T @ here
                    p += x.T @ x
        later, earlier = np.tril_indices(width, -1)
        if n.any():
            values = (n[later, earlier], s[later, earlier], s[earlier, later], q[later, earlier], q[earlier, later], p[later, earlier])
            yield pa.RecordBatch.from_arrays(
                [pa.array(later, pa.int32()), pa.array(earlier, pa.int32()), *[pa.array(v) for v in values]], ["i", "j", *SUMS])

    return step


def pair_corr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, corr``: correlation of columns i and j (places in ``columns``, j before i).

    Over the rows where both are present; NULL where there are none or a side is
    constant. Values are taken off their column's mean first, which keeps the sums
    short.
    """
    d = [c(x).cast("double") for x in columns]
    finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in d]
    means = df.agg(F.array(*[F.avg(x) for x in finite])).scalar()
    # one mention of the subquery, one expression for all columns
    rows = df.select(F.array(*d).alias("x"), means.alias("m")).select(
        F.zip_with("x", "m", lambda x, m: x - F.coalesce(m, F.lit(0.0))).alias("x"))
    parts = rows.mapInArrow(_products(len(columns)), "i int, j int, " + ", ".join(f"{n} double" for n in SUMS))
    total = parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in SUMS])
    n = c("n")
    vx, vy = c("xx") / n - (c("x") / n) * (c("x") / n), c("yy") / n - (c("y") / n) * (c("y") / n)
    varies = (n > 0) & (vx > c("xx") / n * ROUNDING) & (vy > c("yy") / n * ROUNDING)
    cov = c("xy") / n - (c("x") / n) * (c("y") / n)
    return total.filter("n > 0").select("i", "j", F.when(varies, cov / F.sqrt(vx * vy)).alias("corr"))
