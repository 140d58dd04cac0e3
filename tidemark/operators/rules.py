"""Declared resources: fields, types and value rules as column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div

c = F.col

#: resource -> (required fields, optional fields), each (name, type)
RESOURCES = {
    "stock_price": (
        [("symbol", "string"), ("date", "datetime"), ("open", "float"), ("high", "float"),
         ("low", "float"), ("close", "float"), ("volume", "integer")],
        [("adj_close", "float")],
    ),
    "revenue": (
        [("symbol", "string"), ("date", "datetime"), ("revenue", "float"), ("period", "string")],
        [("currency", "string"), ("source", "string")],
    ),
    "market_cap": (
        [("symbol", "string"), ("date", "datetime"), ("market_cap", "float")],
        [("shares_outstanding", "integer"), ("currency", "string"), ("source", "string")],
    ),
    "news_sentiment": (
        [("symbol", "string"), ("date", "datetime"), ("sentiment_score", "float")],
        [("sentiment_label", "string"), ("news_count", "integer"), ("source", "string"), ("confidence", "float")],
    ),
}
ACCEPTED = {
    "string": {"string"}, "integer": {"int", "bigint", "smallint", "tinyint"},
    "float": {"double", "float", "int", "bigint"}, "datetime": {"timestamp", "timestamp_ntz", "date", "string"},
    "boolean": {"boolean"},
}


def value_rules(resource: str) -> dict[str, tuple[tuple[str, ...], Column, str]]:
    """rule -> (columns, condition of failure, severity)."""
    prices = ("open", "high", "low", "close")
    bad_price = (c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)
    return {
        "stock_price": {
            "price_positive": (prices, bad_price, "error"),
            "high_ge_low": (("high", "low"), c("high") < c("low"), "error"),
            "volume_positive": (("volume",), c("volume") < 0, "warning"),
        },
        "revenue": {"revenue_positive": (("revenue",), c("revenue") <= 0, "error")},
        "market_cap": {"market_cap_positive": (("market_cap",), c("market_cap") <= 0, "error")},
        "news_sentiment": {
            "sentiment_range": (("sentiment_score",), ~c("sentiment_score").between(-1.0, 1.0), "error"),
            "confidence_range": (("confidence",), ~c("confidence").between(0.0, 1.0), "warning"),
        },
    }[resource]


def type_mismatches(df: DataFrame, resource: str) -> list[str]:
    required, optional = RESOURCES[resource]
    kinds = dict(df.dtypes)
    return [n for n, t in [*required, *optional] if n in kinds and kinds[n] not in ACCEPTED[t]]


def failed_rules(df: DataFrame, resource: str) -> Column:
    """Names of the rules a row breaks (required values present included)."""
    have = set(df.columns)
    required, _ = RESOURCES[resource]
    checks = [
        F.when(c(n).isNull(), F.lit(f"required:{n}")) if n in have else F.lit(f"required:{n}")
        for n, _ in required
    ]
    checks += [
        F.when(bad, F.lit(rule))
        for rule, (needs, bad, _) in value_rules(resource).items() if set(needs) <= have
    ]
    return F.array_compact(F.array(*checks))


def resource_rules(df: DataFrame, resource: str) -> DataFrame:
    return df.withColumn("failed_rules", failed_rules(df, resource)).withColumn(
        "is_valid", F.size("failed_rules") == 0
    )


def rule_report(df: DataFrame, resource: str) -> DataFrame:
    """One row per rule: severity, failing rows, verdict.  One pass over data."""
    rules = {n: r for n, r in value_rules(resource).items() if set(r[0]) <= set(df.columns)}
    counts = df.agg(*[F.count_if(bad).alias(n) for n, (_, bad, _) in rules.items()])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"), c(n).alias("failures"))
        for n, (_, _, sev) in rules.items()
    ]))
    return counts.select(rows.alias("r")).select("r.*", (c("r.failures") == 0).alias("is_valid"))


def rule_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if("is_valid").alias("passed"),
        F.count_if(~c("is_valid")).alias("failed"), F.sum("failures").alias("failures"),
    )


def resource_quality(df: DataFrame, resource: str) -> DataFrame:
    """Completeness, duplicate and rule-failure counts folded into a score.

    Rows are first grouped by their full value with a count, which gives the
    duplicates without a distinct set, and shrinks what the checks read.
    """
    cols = df.columns
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    nulls = sum((c(x).isNull().cast("int") for x in cols[1:]), c(cols[0]).isNull().cast("int"))
    bad = F.size(failed_rules(df, resource)) > 0
    agg = grouped.select("_c", nulls.alias("_nulls"), bad.alias("_bad")).agg(
        F.sum("_c").alias("total_records"),
        F.sum(c("_nulls") * c("_c")).alias("missing_values"),
        F.sum(c("_c") - 1).alias("duplicates"),
        F.sum(F.when(c("_bad"), c("_c")).otherwise(0)).alias("invalid_records"),
    )
    n = c("total_records")
    complete = 1 - div(c("missing_values"), n * len(cols))
    return agg.withColumn("completeness", complete).withColumn(
        "quality_score",
        F.when(c("completeness") < 0.9, c("completeness")).otherwise(F.lit(1.0))
        * F.when(c("duplicates") > 0, 0.9).otherwise(1.0)
        * (1 - div(c("invalid_records"), n)),
    )
