"""Data-quality, drift and training-readiness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, pct_change, snap
from tidemark.plans.quantile import cumulative, unpivot
from tidemark.plans.series import BARS, Series

c = F.col
PRICES = ("open", "high", "low", "close", "adj_close")


def _missing(df: DataFrame, x: str) -> Column:
    kind = dict(df.dtypes)[x]
    bad = c(x).isNull()
    return bad | F.isnan(x) if kind in ("double", "float") else bad


def _stack(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("_x")).select("_x.*")


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Expected against actual columns, with the rows that fill each."""
    actual = dict(df.dtypes)
    counts = df.agg(*[F.count(x).alias(x) for x in actual])
    rows = []
    for x in sorted({*expected, *actual}):
        status = (
            "missing" if x not in actual else "extra" if x not in expected
            else "ok" if actual[x] == expected[x] else "mismatch"
        )
        rows.append(F.struct(
            F.lit(x).alias("column"), F.lit(status).alias("status"),
            F.lit(expected.get(x)).cast("string").alias("expected"), F.lit(actual.get(x)).cast("string").alias("actual"),
            (c(x) if x in actual else F.lit(0).cast("bigint")).alias("non_null"),
        ))
    return _stack(counts, rows)


def missing_analysis(df: DataFrame) -> DataFrame:
    """Missing values per column in one pass."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count_if(_missing(df, x)).alias(x) for x in df.columns])
    return _stack(one, [
        F.struct(F.lit(x).alias("column"), c(x).alias("missing"), div(c(x), c("_n")).alias("missing_ratio"))
        for x in df.columns
    ])


def _moves(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("_move", F.abs(pct_change(c("close"), 1, s)))


def _count_of(tests: list[Column]) -> Column:
    total = F.count_if(tests[0])
    for t in tests[1:]:
        total = total + F.count_if(t)
    return total


def price_checks(df: DataFrame, s: Series = BARS, limit: float = 0.5) -> DataFrame:
    have = [x for x in PRICES if x in df.columns]
    n = F.count(F.lit(1))
    return _moves(df, s).agg(
        n.alias("total_records"), _count_of([c(x) <= 0 for x in have]).alias("non_positive_prices"),
        F.count_if(snap(c("_move")) > limit).alias("extreme_changes"),
    ).withColumn(
        "is_valid", (c("non_positive_prices") == 0) & (c("extreme_changes") < c("total_records") * 0.01)
    )


def volume_checks(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(c("volume") < 0).alias("negative_volumes"),
        F.count_if(c("volume") == 0).alias("zero_volumes"),
    ).withColumn(
        "is_valid", (c("negative_volumes") == 0) & (c("zero_volumes") < c("total_records") * 0.1)
    )


def column_stats(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    long = unpivot(df, columns)
    n = F.count(F.lit(1))
    aggs = [
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"), (n - F.count("value")).alias("missing_count"),
        div(n - F.count("value"), n).alias("missing_ratio"),
    ]
    if approximate:
        return long.groupBy("column").agg(*aggs, F.approx_count_distinct("value").alias("unique_count"))
    values = long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1).alias("_u"))
    unique = values.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return long.groupBy("column").agg(*aggs).join(unique, "column", "left")


def quality_report(df: DataFrame, s: Series = BARS, limit: float = 0.5) -> DataFrame:
    """Completeness, price and volume verdicts and the weighted score: one pass."""
    cols = df.columns
    have = [x for x in PRICES if x in cols]
    one = _moves(df, s).agg(
        F.count(F.lit(1)).alias("total_records"), _count_of([_missing(df, x) for x in cols]).alias("total_missing"),
        _count_of([c(x) <= 0 for x in have]).alias("non_positive_prices"),
        F.count_if(snap(c("_move")) > limit).alias("extreme_changes"),
        F.count_if(c("volume") < 0).alias("negative_volumes"), F.count_if(c("volume") == 0).alias("zero_volumes"),
    )
    n = c("total_records")
    out = one.withColumns({
        "missing_ratio": div(c("total_missing"), n * len(cols)),
        "price_valid": (c("non_positive_prices") == 0) & (c("extreme_changes") < n * 0.01),
        "volume_valid": (c("negative_volumes") == 0) & (c("zero_volumes") < n * 0.1),
    })
    score = (
        (1 - c("missing_ratio")) * 0.5
        + F.when(c("price_valid"), 1.0).otherwise(0.5) * 0.3
        + F.when(c("volume_valid"), 1.0).otherwise(0.5) * 0.2
    )
    return out.withColumns({
        "completeness": 1 - c("missing_ratio"), "quality_score": F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))),
        "is_valid": (snap(1 - c("missing_ratio")) >= 0.95) & (snap(c("missing_ratio")) <= 0.05)
        & c("price_valid") & c("volume_valid"),
    })


def symbol_quality_score(df: DataFrame, s: Series = BARS, limit: float = 0.5, accept: float = 0.95, min_rows: int = 10) -> DataFrame:
    fields = ("open", "high", "low", "close", "volume")
    n = F.count(F.lit(1))
    out = _moves(df, s).groupBy(*s.keys).agg(
        n.alias("rows"), div(_count_of([c(x).isNull() for x in fields]), n * 5).alias("missing_ratio"),
        div(_count_of([c(x) <= 0 for x in fields[:4]]), n * 4).alias("invalid_ratio"),
        div(F.count_if(snap(c("_move")) > limit), n).alias("extreme_ratio"),
    )
    score = 1 - (c("missing_ratio") + c("invalid_ratio") + c("extreme_ratio")) / 3
    return out.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))).withColumn(
        "accepted",
        (snap(c("quality_score")) >= accept) & (snap(1 - c("missing_ratio")) >= accept) & (c("rows") >= min_rows),
    )


# -- drift ---------------------------------------------------------------------------
def drift(current: DataFrame, reference: DataFrame, columns: Sequence[str], limit: float = 0.1) -> DataFrame:
    """Mean shift and deviation change per column, relative to the reference."""

    def stats(df: DataFrame, side: str) -> DataFrame:
        return unpivot(df, columns).groupBy("column").agg(
            F.avg("value").alias(f"{side}_mean"), F.stddev_samp("value").alias(f"{side}_std")
        )

    both = stats(current, "current").join(stats(reference, "reference"), "column")
    out = both.withColumns({
        "mean_shift": div(F.abs(c("current_mean") - c("reference_mean")), F.abs("reference_mean")),
        "std_change": div(F.abs(c("current_std") - c("reference_std")), c("reference_std")),
    }).withColumn("drift_score", F.least(F.lit(1.0), c("mean_shift") + c("std_change")))
    return out.withColumn("has_drift", (snap(c("drift_score")) > limit) | (snap(c("mean_shift")) > limit))


def drift_ks(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column.

    Both samples are counted by (column, value) and their cumulative shares
    built slice by slice, so no task sorts a whole column.
    """
    both = unpivot(current, columns).withColumn("_a", F.lit(1)).unionByName(
        unpivot(reference, columns).withColumn("_a", F.lit(0))
    ).filter("value IS NOT NULL")
    counts = both.groupBy("column", "value").agg(
        F.sum("_a").alias("a"), F.sum(1 - c("_a")).alias("b")
    )
    sizes = counts.groupBy("column").agg(F.sum("a").alias("current_n"), F.sum("b").alias("reference_n"))
    cum = cumulative(counts, ["column"], "value", ["a", "b"])
    gap = F.abs(div(c("a_upto"), c("current_n")) - div(c("b_upto"), c("reference_n")))
    return cum.join(sizes, "column").groupBy("column", "current_n", "reference_n").agg(F.max(gap).alias("ks_statistic"))


def training_readiness(
    df: DataFrame, today: str, target: str | None = None, min_rows: int = 1000, min_symbols: int = 10, min_days: int = 30
) -> DataFrame:
    """Is the table large, wide, long and clean enough to train on?"""
    now = F.lit(today).cast("date")
    bad_target = F.count_if(c(target).isNull()) if target else F.lit(0)
    # symbols are counted from a grouping, one row each, not a distinct buffer
    per = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_if(c("date") > now).alias("future"), bad_target.alias("bad"),
    )
    out = per.agg(
        F.sum("n").alias("total_records"), F.count(F.lit(1)).alias("unique_symbols"),
        F.date_diff(F.max("hi"), F.min("lo")).alias("date_span_days"), F.sum("future").alias("future_data_count"),
        div(F.sum("bad"), F.sum("n")).alias("target_missing_ratio"),
    )
    # advice texts: fixed values
    advice = F.array_compact(F.array(
        F.when(c("total_records") < min_rows, f"Consider collecting more data (minimum {min_rows} records recommended)"),
        F.when(c("unique_symbols") < min_symbols, f"Consider including more symbols (minimum {min_symbols} recommended)"),
        F.when(c("date_span_days") < min_days, f"Consider extending the date range (minimum {min_days} days recommended)"),
        F.when(c("future_data_count") > 0, "Remove future data to prevent data leakage"),
    ))
    ok = (
        (c("total_records") >= min_rows) & (c("unique_symbols") >= min_symbols) & (c("date_span_days") >= min_days)
        & (c("future_data_count") == 0) & (snap(c("target_missing_ratio")) < 0.1)
    )
    return out.withColumns({
        "is_valid": ok,
        "recommendations": F.when(F.size(advice) == 0, F.array(F.lit("Data appears suitable for training"))).otherwise(advice),
    })
