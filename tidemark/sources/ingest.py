"""Landed vendor files to bar tables, universes, and ingest reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import div
from tidemark.sources.storage import read_table, stage, with_date_parts, write_layout

c = F.col

#: vendor column -> ours (fixed values)
VENDOR = {
    "Date": "date", "Datetime": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Volume": "volume", "Adj Close": "adj_close", "Symbol": "symbol", "Ticker": "symbol",
}
BAR_TYPES = {
    "symbol": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint", "adj_close": "double",
}


def normalize_bars(df: DataFrame, fetched_at=None, as_date: bool = True) -> DataFrame:
    """Vendor names and types to the bar schema; no session time zone involved."""
    df = df.withColumnsRenamed({v: o for v, o in VENDOR.items() if v in df.columns})
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", c("close"))
    when = F.to_timestamp_ntz(F.regexp_replace(c("date").cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", ""))
    typed = df.select(
        *[c(n).cast(t).alias(n) for n, t in BAR_TYPES.items()],
        (when.cast("date") if as_date else when).alias("date"),
    )
    out = typed.withColumns({
        **{n: F.when(~F.isnan(n), c(n)) for n, t in BAR_TYPES.items() if t == "double"},
    })
    out = out.withColumn("adj_close", F.coalesce("adj_close", "close"))
    if fetched_at is not None:
        out = out.withColumn("fetched_at", fetched_at)
    return with_date_parts(out)


def fetch_union(spark: SparkSession, landed: Sequence[tuple[str, str]], schema=None) -> DataFrame:
    """All landed files, whatever their format, as one bar table."""
    parts = [normalize_bars(read_table(spark, path, fmt, schema=schema if fmt in ("csv", "json") else None)) for path, fmt in landed]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fetch_report(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """Totals, and the requested symbols nothing was found for."""
    per = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    lost = requested.select("symbol").distinct().join(per, "symbol", "left_anti")
    missing = lost.agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",")).scalar()
    return per.agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("symbols_fetched")).withColumn("symbols_missing", missing)


def bars_summary(bars: DataFrame) -> DataFrame:
    """One aggregation by symbol, then one over symbols."""
    quality = F.avg("data_quality_score") if "data_quality_score" in bars.columns else F.lit(None).cast("double")
    per = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"), quality.alias("q"))
    return per.agg(
        F.sum("n").alias("total_records"), F.count(F.lit(1)).alias("unique_symbols"), F.min("lo").alias("start_date"),
        F.max("hi").alias("end_date"), div(F.sum(c("q") * c("n")), F.sum(F.when(c("q").isNotNull(), c("n")))).alias("avg_quality"),
        F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"),
    )


#: The user's extension point: source name -> () -> DataFrame, in order of preference.
Source = Callable[[], DataFrame]
REPORT = "resource string, source string, place int, status string, rows bigint, error string"


def _merged(loaded: Sequence[tuple[int, str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Rows of all sources, of each key those of the most preferred."""
    ranked = [df.withColumns({"source": F.lit(label), "_p": F.lit(i)}) for i, label, df in loaded]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    rest = [x for x in both.columns if x not in (*keys, "_p")]
    picked = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), c("_p")).alias("_r"))
    return picked.select(*keys, "_r.*")


def load_resources(
    spark: SparkSession, resources: dict[str, dict[str, Source]], keys: Sequence[str] = ("symbol", "date"), required: Sequence[str] = ()
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each resource from the sources that work, and a report row for every source.

    A source is read and written down before it counts, so one that fails while it is
    built or read is reported and the next ones stand in for it: of each key the most
    preferred source that has it wins. A resource without any working source is left
    out; one of ``required`` is an error that names what failed.
    """
    tables, report = {}, []
    for name, sources in resources.items():
        loaded = []
        for place, (label, build) in enumerate(sources.items()):
            try:
                df = stage(build(), f"source_{name}_{label}")
                lost = [k for k in keys if k not in df.columns]
                if lost:
                    raise ValueError(f"no column {', '.join(lost)}")
            except Exception as failure:  # whatever a foreign source raises, the others go on
                report.append((name, label, place, "failed", None, str(failure).splitlines()[0][:500] if str(failure) else type(failure).__name__))
                continue
            loaded.append((place, label, df))
            report.append((name, label, place, "loaded", df.count(), None))
        if loaded:
            tables[name] = _merged(loaded, keys)
        elif name in required:
            why = "; ".join(f"{label}: {error}" for resource, label, _, _, _, error in report if resource == name)
            raise RuntimeError(f"all sources of {name} failed ({why or 'there are none'})")
    return tables, spark.createDataFrame(report, REPORT)


def multi_resource_load(resources: dict[str, dict[str, Source]], keys: Sequence[str] = ("symbol", "date")) -> dict[str, DataFrame]:
    """Each resource from its sources; the first source that has a key wins.

    One grouping per resource (the priority rides in ``min_by``), however many
    sources there are. A source that fails ends the load; see ``load_resources``.
    """
    return {
        name: _merged([(i, label, build()) for i, (label, build) in enumerate(sources.items())], keys)
        for name, sources in resources.items()
    }


# -- universes -----------------------------------------------------------------------
UNIVERSE = "map<string, struct<name:string, description:string, symbols:array<string>>>"


def universe_explode(docs: DataFrame, column: str = "doc") -> DataFrame:
    """A JSON document of named lists to (list_name, name, symbol) rows."""
    entries = docs.select(F.explode(F.map_entries(F.from_json(column, UNIVERSE))).alias("e"))
    return entries.select(
        c("e.key").alias("list_name"), c("e.value.name").alias("name"), F.explode("e.value.symbols").alias("symbol"))


def recommended_list(docs: DataFrame, use_case: str, column: str = "doc") -> str:
    """Name of the list a universe document recommends for a use case; an unknown case is refused."""
    found = docs.select(F.explode(F.from_json(F.get_json_object(column, "$.recommendations"), "map<string,string>")).alias("case", "list_name"))
    named = {r["case"]: r["list_name"] for r in found.collect()}
    if use_case not in named:
        raise ValueError(f"no list is recommended for {use_case!r}; there are {', '.join(sorted(named)) or 'none'}")
    return named[use_case]


def universe_for(docs: DataFrame, use_case: str, column: str = "doc") -> DataFrame:
    """Symbols of the list recommended for a use case."""
    name = recommended_list(docs, use_case, column)
    lists = docs.select(F.get_json_object(column, "$.symbols").alias(column))
    return universe_explode(lists, column).filter(c("list_name") == name)


def universe_lists(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("list_name", "name").agg(F.count(F.lit(1)).alias("symbols"))


def universe_filter(bars: DataFrame, universe: DataFrame, list_name: str) -> DataFrame:
    """Bars of a list's symbols; a semi-join the optimizer sizes."""
    return bars.join(universe.filter(c("list_name") == list_name).select("symbol"), "symbol", "left_semi")


def symbol_validate(df: DataFrame, column: str = "symbol") -> DataFrame:
    clean = F.upper(F.trim(column))
    ok = clean.rlike("^[A-Z0-9.-]{1,10}$") & clean.rlike("[A-Z0-9]")
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False))).withColumn(
        "clean_symbol", F.when(c("is_valid"), clean)
    )


def symbol_validation_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if("is_valid").alias("valid_count"),
        F.count_if(~c("is_valid")).alias("invalid_count"),
    ).withColumn("valid", (c("invalid_count") == 0) & (c("total_symbols") > 0))


def custom_list(symbols: DataFrame, name: str) -> DataFrame:
    """A list of valid symbols; a row that is not valid fails the job."""
    checked = symbol_validate(symbols)
    return checked.select(
        F.lit(name).alias("list_name"),
        F.when(c("is_valid"), c("clean_symbol"))
        .otherwise(F.raise_error(F.concat(F.lit("invalid symbol: "), F.coalesce(c("symbol"), F.lit("NULL"))))).alias("symbol"),
    ).distinct()


def ingest_list(spark: SparkSession, universe: DataFrame, list_name: str, landed: Sequence[tuple[str, str]], path: str, schema=None) -> DataFrame:
    """Named list to stored table to counts, without passing the driver."""
    bars = universe_filter(fetch_union(spark, landed, schema), universe, list_name).drop("year", "month", "day")
    write_layout(bars, path, "ohlcv", list_name)
    stored = read_table(spark, path)
    wanted = universe.filter(c("list_name") == list_name)
    return fetch_report(stored, wanted)
