"""Feature preparation, selection and validation.

Statistics come from one aggregation each and reach the rows as a scalar
subquery, never through the driver; wide tables are one pass, not one job per
column.  Quantiles are exact and distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import corr, div, pct_change, snap
from tidemark.operators import indicators as ind
from tidemark.plans.gram import pair_corr
from tidemark.plans.quantile import column_quantiles, exact_quantiles, unpivot
from tidemark.plans.series import (
    BARS, Series, cell, default_bucket, fits_one_task, in_blocks, null_safe_join, positions, with_stats,
)
from tidemark.sources.storage import stage

c = F.col


# -- missing values, outliers, scale ----------------------------------------------
def _as_map(stats: DataFrame, value: str = "q") -> Column:
    """A small per-column table as one scalar map."""
    return stats.agg(F.map_from_entries(F.collect_list(F.struct("column", value)))).scalar()


def carried(df: DataFrame, columns: Sequence[str], s: Series = BARS, backward: bool = False) -> DataFrame:
    """The last (or next) known value of each column, for series of any length.

    Values are carried inside ``(keys, slot)``; of each slot one value a column goes on
    to the following ones.
    """
    rows = df.withColumn("_cell", cell(*s.keys, default_bucket(s)))
    at, place = F.struct(*s.order), c(f"_cell.k{len(s.keys)}")
    pick = F.min_by if backward else F.max_by
    edges = rows.groupBy("_cell").agg(*[pick(x, F.when(c(x).isNotNull(), at)).alias(f"_e_{x}") for x in columns])

    def way(x: Column) -> Column:
        return x.desc() if backward else x.asc()

    along = Window.partitionBy(*[f"_cell.k{i}" for i in range(len(s.keys))]).orderBy(way(place)).rowsBetween(Window.unboundedPreceding, -1)
    before = edges.select("_cell", *[F.last(f"_e_{x}", ignorenulls=True).over(along).alias(f"_b_{x}") for x in columns])
    inside = Window.partitionBy("_cell").orderBy(*[way(c(o)) for o in s.order]).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({x: F.last(x, ignorenulls=True).over(inside) for x in columns})
    return own.join(before, "_cell").withColumns({x: F.coalesce(x, f"_b_{x}") for x in columns}).select(*df.columns)


def fill_missing(
    df: DataFrame, columns: Sequence[str], method: str = "forward_fill", limit: int | None = None,
    s: Series = BARS, frequency: str | None = "1week",
) -> DataFrame:
    """Missing values from neighbours, from the column, or the rows without them.

    Series not known to be short (``frequency=None``) are filled slot by slot.
    """
    if method in ("forward_fill", "backward_fill"):
        backward = method == "backward_fill"
        if not fits_one_task(frequency):
            if not limit:
                return carried(df, columns, s, backward)

            def near(rows: DataFrame, x: Series) -> DataFrame:
                w = x.ordered.rowsBetween(0, limit) if backward else x.ordered.rowsBetween(-limit, 0)
                take = F.first if backward else F.last
                return rows.withColumns({n: take(n, ignorenulls=True).over(w) for n in columns})

            return in_blocks(df, near, 0 if backward else limit, limit if backward else 0, s)
        # a backward fill is a forward fill in reversed order: a running frame
        order = [c(o).desc() if backward else c(o).asc() for o in s.order]
        w = s.whole.orderBy(*order)
        w = w.rowsBetween(-limit, 0) if limit else w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in columns})
    if method == "mean":
        means = df.agg(F.struct(*[F.avg(x).alias(x) for x in columns])).scalar()
        return df.withColumn("_m", means).withColumns(
            {x: F.coalesce(c(x), c(f"_m.{x}")) for x in columns}
        ).drop("_m")
    if method == "median":
        medians = _as_map(column_quantiles(df, columns, [0.5]))
        return df.withColumn("_m", medians).withColumns(
            {x: F.coalesce(c(x), c("_m")[x][0]) for x in columns}
        ).drop("_m")
    if method == "zero":
        return df.fillna(0, subset=list(columns))
    if method == "drop":
        return df.dropna(subset=list(columns))
    raise ValueError(f"unknown method {method}")


def _keep_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    keep = tests[0]
    for t in tests[1:]:
        keep = keep & t
    return df.filter(F.coalesce(keep, F.lit(False)))


def outlier_iqr(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """Rows with every column inside its quartile fences; a NULL fails.

    The fences are finished inside the scalar subquery, and every mention is
    of the same subquery, so it runs once.
    """
    lo, hi = c("q")[0], c("q")[1]
    spread = (hi - lo) * threshold
    table = column_quantiles(df, columns, [0.25, 0.75]).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct((lo - spread).alias("lo"), (hi + spread).alias("hi")))))
        .alias("m")
    )
    tests, fences = [], table.scalar()
    for x in columns:
        fence = fences[x]
        tests.append(snap(c(x) - fence["lo"], 6) >= 0)
        tests.append(snap(c(x) - fence["hi"], 6) <= 0)
    return _keep_all(df, tests)


def _moments(df: DataFrame, columns: Sequence[str], std) -> Column:
    return df.agg(F.struct(*[
        F.struct(F.avg(x).alias("mean"), std(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(x)
        for x in columns
    ])).scalar()


def outlier_z(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    moments = df.agg(F.struct(*[
        F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias(x) for x in columns
    ])).scalar()
    return _keep_all(df, [
        snap(F.abs(div(c(x) - moments[x]["mean"], moments[x]["std"]))) < threshold for x in columns
    ])


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Standard (population deviation), min-max or robust (median, IQR) scaling."""
    if method == "robust":
        base = df.withColumn("_m", _as_map(column_quantiles(df, columns, [0.25, 0.5, 0.75])))
        parts = {x: (c("_m")[x][1], c("_m")[x][2] - c("_m")[x][0]) for x in columns}
    elif method in ("standard", "minmax"):
        base = df.withColumn("_m", _moments(df, columns, F.stddev_pop))
        parts = {
            x: (c(f"_m.{x}.mean"), c(f"_m.{x}.std")) if method == "standard"
            else (c(f"_m.{x}.min"), c(f"_m.{x}.max") - c(f"_m.{x}.min"))
            for x in columns
        }
    else:
        raise ValueError(f"unknown method {method}")
    return base.withColumns({
        x: (c(x) - mid) / F.when(width == 0, F.lit(1.0)).otherwise(width) for x, (mid, width) in parts.items()
    }).drop("_m")


# -- selection ----------------------------------------------------------------------
def _rows_of(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("_x")).select("_x.*")


def target_corr(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``feature, corr`` with the target: one aggregation for all features."""
    one = df.agg(*[corr(c(x).cast("double"), c(target).cast("double")).alias(x) for x in features])
    return _rows_of(one, [F.struct(F.lit(x).alias("feature"), c(x).alias("corr")) for x in features])


def select_by_corr(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.1) -> DataFrame:
    return target_corr(df, features, target).filter(snap(F.abs("corr")) > threshold)


def top_features(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    return target_corr(df, features, target).orderBy(F.abs("corr").desc_nulls_last(), "feature").limit(k)


def feature_profile(df: DataFrame, features: Sequence[str], target: str | None) -> DataFrame:
    """One row per feature: share missing, variance, correlations with earlier
    features, correlation with the target.  Pairs come from one product of the
    rows with themselves, so the plan does not grow with their number."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), *[
        F.struct(F.count(x).alias("n"), F.var_samp(c(x).cast("double")).alias("v")).alias(f"f_{x}") for x in features])
    base = _rows_of(one, [
        F.struct(F.lit(k).alias("position"), F.lit(x).alias("feature"), (1 - div(c(f"f_{x}.n"), c("n"))).alias("missing_ratio"), c(f"f_{x}.v").alias("variance"))
        for k, x in enumerate(features)])
    # the target stands before all features: its pairs have j = 0
    columns, first = ([target, *features], 1) if target else (list(features), 0)
    pairs = pair_corr(df, columns).select((c("i") - first).alias("position"), (c("j") - first).alias("other"), "corr")
    names = F.array(*[F.lit(x) for x in features])
    by_feature = pairs.groupBy("position").agg(
        F.max(F.when(c("other") < 0, c("corr"))).alias("target_corr"),
        F.array_sort(F.collect_list(F.when(c("other") >= 0, F.struct("other", F.abs("corr").alias("corr"))))).alias("_near"),
    )
    earlier = F.transform("_near", lambda e: F.struct(names[e["other"]].alias("feature"), e["corr"].alias("corr")))
    return base.join(by_feature, "position", "left").select(
        "position", "feature", "missing_ratio", "variance", "target_corr",
        F.coalesce(earlier, F.array().cast("array<struct<feature:string,corr:double>>")).alias("earlier"))


def select_features(
    df: DataFrame, features: Sequence[str], target: str, max_missing: float = 0.5,
    corr_limit: float = 0.95, min_variance: float = 0.01, k: int = 1000,
) -> DataFrame:
    """Why each feature stays or goes; the feature-by-feature table is tiny."""
    prof = feature_profile(df, features, target)
    # correlation is only judged among features that are present enough
    valid = prof.filter(snap(c("missing_ratio")) < max_missing).agg(F.collect_set("feature")).scalar()
    worst = F.array_max(F.transform(
        F.filter("earlier", lambda e: F.array_contains("_valid", e["feature"])), lambda e: e["corr"]
    ))
    out = prof.withColumn("_valid", valid).withColumn("max_earlier_corr", worst)
    reason = (
        F.when(snap(c("missing_ratio")) >= max_missing, "missing")
        .when(snap(c("max_earlier_corr")) > corr_limit, "correlated")
        .when(snap(c("variance")) < min_variance, "variance")
    )
    ranked = out.withColumn("reason", reason).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(c("reason").isNull()).orderBy(F.abs("target_corr").desc_nulls_last(), "feature"))
    )
    final = F.when(c("reason").isNull() & (c("_rank") > k), "rank").otherwise(c("reason"))
    return ranked.withColumn("reason", final).withColumn("selected", c("reason").isNull()).select(
        "feature", "missing_ratio", "variance", "max_earlier_corr", "target_corr", "reason", "selected"
    )


def select_constant_corr_kbest(
    df: DataFrame, features: Sequence[str], target: str, corr_limit: float = 0.95, k: int = 50
) -> DataFrame:
    """Zero-filled features: constants and correlated ones out, best F scores in."""
    filled = df.fillna(0, subset=list(features))
    prof = feature_profile(filled, features, target)
    alive = prof.filter("variance > 0").agg(F.collect_set("feature")).scalar()
    worst = F.array_max(F.transform(
        F.filter("earlier", lambda e: F.array_contains("_alive", e["feature"])), lambda e: e["corr"]
    ))
    n = df.agg(F.count(F.lit(1))).scalar()
    r2 = c("target_corr") * c("target_corr")
    return (
        prof.filter("variance > 0").withColumn("_alive", alive).withColumn("_w", worst)
        .filter(F.coalesce(snap(c("_w")) <= corr_limit, F.lit(True)))
        .select("feature", (div(r2, 1 - r2) * (n - 2)).alias("f_score"))
        .orderBy(c("f_score").desc_nulls_last(), "feature").limit(k)
    )


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: counts, distinct values, moments.

    Distinct values are counted from a (column, value) grouping, so no
    aggregation buffer holds a column's values.
    """
    long = unpivot(df, columns)
    n = F.count(F.lit(1))
    moments = long.groupBy("column").agg(
        F.count("value").alias("non_null_count"), (n - F.count("value")).alias("null_count"),
        (div(n - F.count("value"), n) * 100).alias("null_percentage"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    distinct = long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1).alias("_u"))
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    types = dict(df.dtypes)
    dtype = F.create_map(*[F.lit(x) for col in columns for x in (col, types[col])])
    return moments.join(counts, "column", "left").select(
        c("column").alias("feature"), dtype[c("column")].alias("dtype"), "non_null_count", "null_count",
        "null_percentage", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "mean", "std", "min", "max",
    )


def validate_features(df: DataFrame, features: Sequence[str], skew_limit: float = 3.0, corr_limit: float = 0.95) -> DataFrame:
    """One row of totals and lists; three aggregations over the table.

    Duplicates come from grouping whole rows with a count, skew from one wide
    aggregation, pairs from one product of the rows with themselves.
    """
    kinds = dict(df.dtypes)
    d = {x: c(x).cast("double") for x in features}
    n = F.count(F.lit(1))
    aggs = [n.alias("rows")]
    for x in features:
        m = F.count(x).cast("double")
        aggs += [
            (n - F.count(x)).alias(f"m_{x}"),
            F.count_if(F.abs(d[x]) == float("inf")).alias(f"i_{x}"),
            F.min(d[x]).alias(f"lo_{x}"), F.max(d[x]).alias(f"hi_{x}"),
            F.when(m > 2, F.skewness(d[x]) * F.sqrt(m * (m - 1)) / (m - 2)).alias(f"s_{x}"),
        ]
    one = df.agg(*aggs)

    def names(tests: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(t, F.lit(x)) for x, t in tests.items()]))

    constant = names({x: F.coalesce(c(f"lo_{x}") == c(f"hi_{x}"), F.lit(True)) for x in features})
    skewed = names({x: snap(F.abs(f"s_{x}")) > skew_limit for x in features})
    called = F.array(*[F.lit(x) for x in features])
    near = pair_corr(df, features).filter(snap(F.abs("corr")) > corr_limit)
    tied = near.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "j"))), lambda p: F.concat_ws("~", called[p["j"]], called[p["i"]])), ",")).scalar()
    repeated = df.groupBy(*df.columns).agg((n - 1).alias("_d")).agg(F.sum("_d")).scalar()
    numeric = sum(k in ("int", "bigint", "double", "float") for k in kinds.values())

    def total(prefix: str) -> Column:
        out = c(f"{prefix}_{features[0]}")
        for x in features[1:]:
            out = out + c(f"{prefix}_{x}")
        return out

    return one.select(
        F.lit(len(kinds)).alias("total_features"), F.lit(numeric).alias("numeric_features"),
        c("rows").alias("total_rows"), total("m").alias("missing_values"), total("i").alias("infinite_values"),
        repeated.alias("duplicate_rows"), F.array_join(constant, ",").alias("constant_features"),
        F.array_join(skewed, ",").alias("skewed_features"), tied.alias("correlated_pairs"),
    )


# -- generated features ---------------------------------------------------------------
def entity_stats(bars: DataFrame, column: str = "close", s: Series = BARS, frequency: str | None = "1week") -> DataFrame:
    """A fixed list of series statistics per symbol.

    For series not known to be short (``frequency=None``) places and the value before
    come block by block, and the median from counted values.
    """
    x = c(column)
    if fits_one_task(frequency):
        shaped = bars.withColumns({
            "_lag": F.lag(x).over(s.ordered), "_n": F.row_number().over(s.ordered), "_mean": F.avg(x).over(s.whole),
        })
        median = [F.percentile(x, F.lit(0.5)).alias("median")]
    else:
        lagged = in_blocks(bars, lambda rows, b: rows.withColumn("_lag", F.lag(x).over(b.ordered)), 1, s=s)
        shaped = with_stats(positions(lagged, s).withColumn("_n", c("_pos") + 1), {"_mean": F.avg(x)}, s)
        median = []
    n = F.count(x).cast("double")
    stats = shaped.groupBy(*s.keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        *median,
        F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (F.kurtosis(x) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"),
        corr(x, "_lag").alias("autocorr_1"), F.sum(x * x).alias("abs_energy"),
        F.avg(F.abs(x - c("_lag"))).alias("mean_abs_change"), F.regr_slope(x, c("_n")).alias("slope"),
        F.count_if(snap(x - c("_mean")) > 0).alias("count_above_mean"),
        F.count_if(snap(x - c("_mean")) < 0).alias("count_below_mean"),
    )
    if median:
        return stats
    middle = exact_quantiles(bars, column, [0.5], s.keys).select(*s.keys, c("q")[0].alias("median"))
    return null_safe_join(stats, middle, s.keys, "left").select(*s.keys, *stats.columns[len(s.keys):len(s.keys) + 4], "median", *stats.columns[len(s.keys) + 4:])


def deep_agg_features(levels: Sequence[tuple[DataFrame, str, Sequence[str]]], parents: Sequence[DataFrame]) -> DataFrame:
    """Relational aggregates up a declared chain of parents.

    ``levels[i]`` is (child rows, parent key, columns to aggregate); each
    result joins ``parents[i]`` and feeds the next level.
    """
    carried: list[str] = []
    table = None
    for (child, key, columns), parent in zip(levels, parents):
        rows = child if table is None else table
        use = list(columns) + carried
        aggs = [F.count(F.lit(1)).alias(f"{key}__count")]
        for x in use:
            for name, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_samp)):
                aggs.append(f(x).alias(f"{x}__{name}"))
        up = rows.groupBy(key).agg(*aggs)
        carried = [f"{x}__mean" for x in use]
        table = parent.join(up, key, "left")
    return table


def target_label(
    bars: DataFrame, s: Series = BARS, kind: str = "classification", threshold: float = 0.02, same_bar: bool = False
) -> DataFrame:
    """Label from the next bar's change (or, as an option, this bar's own)."""
    if same_bar:
        change = pct_change(c("close"), 1, s)
    else:
        change = div(F.lead("close").over(s.ordered) - c("close"), c("close"))
    target = (change > threshold).cast("int") if kind == "classification" else change
    return bars.withColumn("target", target)


#: stage name -> row-preserving builder on (bars, series)
STAGES = {
    "technical": lambda df, s: ind.technical_all(df, s),
    "volume": lambda df, s: ind.volume_block(df, s),
    "impact": lambda df, s: ind.true_range_impact(df, s),
    "volatility": lambda df, s: ind.volatility_block(df, s),
}


def engineer_features(
    bars: DataFrame, stages: Sequence[str] = tuple(STAGES), s: Series = BARS
) -> tuple[DataFrame, list[dict]]:
    """All stages on one frame keyed by symbol, plus what each stage added."""
    report, df = [], bars
    for name in stages:
        before = set(df.columns)
        df = STAGES[name](df, s)
        report.append({"stage": name, "added": [x for x in df.columns if x not in before]})
    return df, report


def experiment_dataset(bars: DataFrame, config: dict, s: Series = BARS) -> DataFrame:
    """Config-driven dataset: features, fill, fences, lags, frames, scale, label.

    The fences and the scaling each read their input twice (statistics, then
    rows), so the table is written down before both.
    """
    df, _ = engineer_features(bars, config["stages"], s)
    df = target_label(df, s, **config.get("target", {}))
    features = list(config["features"])
    df = df.select(*s.keys, *s.order, *dict.fromkeys([*features, *config["lag_columns"], *config["rolling_columns"]]), "target")
    fill = config["missing"]
    df = stage(fill_missing(df, features, fill["method"], fill.get("limit"), s), "filled")
    df = outlier_iqr(df, features, config["outlier_threshold"])
    for x in config["lag_columns"]:
        df = ind.lag_features(df, x, config["lags"], s)
    for x in config["rolling_columns"]:
        df = ind.rolling_features(df, x, config["windows"], config["functions"], s)
    numeric = [x for x in df.columns if x not in (*s.keys, *s.order, "target")]
    return scale(stage(df, "framed"), numeric, config["scaling"])
