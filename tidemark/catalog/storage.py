"""Source, sink, ingest, universe and streaming queries.

Tables are written to the shared scratch folder and read back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog.core import cte, register
from tidemark.functions.frames import div
from tidemark.sources import ingest as g
from tidemark.sources import snapshots
from tidemark.sources import storage as s
from tidemark.streaming import ordered, pacing
from tidemark.streaming import replay as r

c = F.col


def landed(t, name="bars", fmt="parquet", parts=("year", "month")):
    path = s.scratch_dir(t.spark, name)
    s.write_table(t.bars_w, path, parts, "overwrite", fmt)
    return path


YM = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"
register("src_bars", lambda t: s.read_table(t.spark, landed(t)), f"SELECT *, {YM} FROM bars_w")
register("src_partition_filter", lambda t: s.read_table(t.spark, landed(t), predicate="year = 1998 AND month >= 6"),
         f"SELECT *, {YM} FROM bars_w WHERE year(date) = 1998 AND month(date) >= 6")


def sink_modes(t):
    path = landed(t, parts=("year",))
    s.write_table(t.bars_w.filter("symbol < 'N05'"), path, ("year",), "append")
    s.write_table(t.bars_w, path, ("year",), "ignore")
    return s.read_table(t.spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


register("sink_partitioned", sink_modes, """
SELECT CAST(year(date) AS INTEGER) AS year, count(*) + count(*) FILTER (symbol < 'N05') AS rows, CAST(sum(volume) + coalesce(sum(volume) FILTER (symbol < 'N05'), 0) AS BIGINT) AS volume FROM bars_w GROUP BY 1
""")


def upsert(t):
    path = s.scratch_dir(t.spark, "upsert")
    s.upsert_by_key(t.spark, t.bars_w.filter("date < DATE '1999-01-01'"), path, ["symbol", "date"], ["year"])
    changed = t.bars_w.filter("date >= DATE '1998-07-01'").withColumn("volume", -c("volume"))
    s.upsert_by_key(t.spark, changed, path, ["symbol", "date"], ["year"])
    return s.read_table(t.spark, path)


register("upsert_by_key", upsert, """
SELECT * REPLACE (CASE WHEN date >= DATE '1998-07-01' THEN -volume ELSE volume END AS volume), CAST(year(date) AS INTEGER) AS year FROM bars_w
""")


def compact(t):
    path = s.scratch_dir(t.spark, "compact")
    for k in range(3):
        s.write_table(t.bars_w.filter(c("volume") % 300 == k * 100), path, ("year",), "append")
    s.compact_table(t.spark, path, ("year",))
    return s.read_table(t.spark, path)


register("compact_table", compact, "SELECT *, CAST(year(date) AS INTEGER) AS year FROM bars_w")
register("table_info", lambda t: s.table_info(t.spark, landed(t, parts=("year",)), ("year",)).select(
    "exists", "format", "partition_columns", "partitions", "rows", (c("bytes") > 0).alias("has_bytes"), (c("files") >= c("partitions")).alias("files_cover_partitions")), """
SELECT true AS exists, 'parquet' AS format, 'year' AS partition_columns, count(DISTINCT year(date)) AS partitions, count(*) AS rows, true AS has_bytes, true AS files_cover_partitions FROM bars_w
""")

VENDOR_SCHEMA = "Symbol string, Date string, Open double, High double, Low double, Close double, Volume bigint, `Adj Close` double"


def vendor(df):
    return df.select(c("symbol").alias("Symbol"), F.concat(c("date").cast("string"), F.lit("T00:00:00+00:00")).alias("Date"), c("open").alias("Open"), c("high").alias("High"),
                     c("low").alias("Low"), c("close").alias("Close"), c("volume").alias("Volume"), c("adj_close").alias("Adj Close"))


def land_vendor(t):
    out = []
    for fmt, lo, hi in (("parquet", "N00", "N08"), ("csv", "N08", "N16"), ("json", "N16", "N99")):
        path = s.scratch_dir(t.spark, f"vendor_{fmt}")
        s.write_table(vendor(t.bars_w.filter((c("symbol") >= lo) & (c("symbol") < hi))), path, (), "overwrite", fmt)
        out.append((path, fmt))
    return out


YMD = YM + ", CAST(day(date) AS INTEGER) AS day"
register("normalize_bars", lambda t: g.normalize_bars(vendor(t.bars_w).drop("Adj Close")), f"SELECT *, {YMD} FROM bars_w")
register("fetch_union", lambda t: g.fetch_union(t.spark, land_vendor(t), VENDOR_SCHEMA), f"SELECT *, {YMD} FROM bars_w")
register("fetch_report", lambda t: g.fetch_report(
    t.bars_w.filter("symbol >= 'N03'"), t.read("nation").select(F.concat(F.lit("N"), F.lpad(c("n_nationkey").cast("string"), 2, "0")).alias("symbol"))), """
SELECT count(*) AS total_rows, count(DISTINCT symbol) AS symbols_fetched,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS s FROM nation) WHERE s NOT IN (SELECT symbol FROM bars_w WHERE symbol >= 'N03')) AS symbols_missing
FROM bars_w WHERE symbol >= 'N03'
""")
register("bars_summary", lambda t: g.bars_summary(t.bars_w.withColumn("data_quality_score", div(c("low"), c("high")))), """
SELECT count(*) AS total_records, count(DISTINCT symbol) AS unique_symbols, min(date) AS start_date, max(date) AS end_date, avg(low / high) AS avg_quality,
  (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM bars_w)) AS symbols FROM bars_w
""", "avg_quality")


def io_formats(t):
    out = None
    for fmt in ("parquet", "orc", "csv", "json"):
        path = s.scratch_dir(t.spark, f"io_{fmt}")
        small = t.bars_w.select("symbol", "date", "close", "volume")
        s.write_table(small, path, (), "overwrite", fmt)
        df = s.read_table(t.spark, path, fmt, schema="symbol string, date date, close double, volume bigint").withColumn("fmt", F.lit(fmt))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("fmt").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close"), F.sum("volume").alias("volume"))


register("io_formats", io_formats, """
SELECT fmt, count(*) AS rows, sum(close) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars_w, (VALUES ('parquet'), ('orc'), ('csv'), ('json')) f(fmt) GROUP BY 1
""", "close:2")
register("layout_path", lambda t: t.bars_w.select("symbol", "date", s.layout_path(c("date"), "ohlcv", "nations", "data.parquet").alias("path")),
         "SELECT symbol, date, 'ohlcv/nations/' || strftime(date, '%Y/%m/%d') || '/data.parquet' AS path FROM bars_w")


def layout(t):
    path = s.scratch_dir(t.spark, "layout")
    monthly = t.bars_w.withColumn("date", F.trunc("date", "month"))
    s.write_layout(monthly.filter("symbol < 'N12'"), path, "ohlcv", "first")
    s.write_layout(monthly.filter("symbol >= 'N12'"), path, "ohlcv", "second")
    return s.file_listing(s.read_table(t.spark, path))


register("storage_summary", lambda t: s.storage_summary(layout(t)).select(
    "data_type", "symbol_list", (c("objects") > 0).alias("has_objects"), (c("bytes") > 0).alias("has_bytes"), "first_day", "last_day"), """
SELECT 'ohlcv' AS data_type, CASE WHEN symbol < 'N12' THEN 'first' ELSE 'second' END AS symbol_list, true AS has_objects, true AS has_bytes,
  CAST(date_trunc('month', min(date)) AS DATE) AS first_day, CAST(date_trunc('month', max(date)) AS DATE) AS last_day FROM bars_w GROUP BY 2
""")


def retention(t):
    files = s.file_listing(s.read_table(t.spark, landed(t, parts=("year",))))
    later = F.lit(dt.datetime.now() + dt.timedelta(days=1))
    past = F.lit(dt.datetime.now() - dt.timedelta(days=30))
    a = s.retention_cleanup(files, later).select(F.lit("tomorrow").alias("cutoff"), (c("expired_objects") > 0).alias("any_expired"), (c("freed_bytes") > 0).alias("frees"))
    return a.unionByName(s.retention_cleanup(files, past).select(F.lit("last_month").alias("cutoff"), (c("expired_objects") > 0).alias("any_expired"), (c("freed_bytes") > 0).alias("frees")))


register("retention_cleanup", retention, "SELECT 'tomorrow' AS cutoff, count(*) > 0 AS any_expired, count(*) > 0 AS frees FROM bars_w UNION ALL SELECT 'last_month', count(*) < 0, count(*) < 0 FROM bars_w")


def resources(t):
    return g.multi_resource_load({"stock_price": {
        "primary": lambda: t.bars_w.filter("symbol < 'N15'").select("symbol", "date", "close"),
        "backup": lambda: t.bars_w.filter("symbol >= 'N10'").select("symbol", "date", (c("close") + 1).alias("close")),
    }})["stock_price"]


register("multi_resource_load", resources, """
SELECT symbol, date, CASE WHEN symbol < 'N15' THEN close ELSE close + 1 END AS close, CASE WHEN symbol < 'N15' THEN 'primary' ELSE 'backup' END AS source FROM bars_w
""", "close")



def resource_sources(t):
    """The most preferred source can't be read, the second breaks on a row while it is read."""
    torn = c("close") + F.when(c("close") > 0, F.raise_error(F.lit("torn row"))).otherwise(0.0)
    return g.load_resources(t.spark, {"stock_price": {
        "missing": lambda: s.read_table(t.spark, s.scratch_dir(t.spark, "nowhere")),
        "torn": lambda: t.bars_w.select("symbol", "date", torn.alias("close")),
        "primary": lambda: t.bars_w.filter("symbol < 'N15'").select("symbol", "date", "close"),
        "backup": lambda: t.bars_w.filter("symbol >= 'N10'").select("symbol", "date", (c("close") + 1).alias("close")),
    }}, required=["stock_price"])


register("resource_fallback", lambda t: resource_sources(t)[0]["stock_price"], """
SELECT symbol, date, CASE WHEN symbol < 'N15' THEN close ELSE close + 1 END AS close, CASE WHEN symbol < 'N15' THEN 'primary' ELSE 'backup' END AS source FROM bars_w
""", "close")
register("resource_report", lambda t: resource_sources(t)[1].select("resource", "source", "place", "status", "rows"), """
SELECT 'stock_price' AS resource, source, place, status, rows FROM (
  SELECT 'missing' AS source, 0 AS place, 'failed' AS status, NULL::BIGINT AS rows UNION ALL SELECT 'torn', 1, 'failed', NULL
  UNION ALL SELECT 'primary', 2, 'loaded', count(*) FROM bars_w WHERE symbol < 'N15' UNION ALL SELECT 'backup', 3, 'loaded', count(*) FROM bars_w WHERE symbol >= 'N10')
""")

# -- universes ----------------------------------------------------------------------


def universe_doc(t):
    """One JSON document of named lists: a region's nations."""
    n = t.read("nation").join(t.read("region"), c("n_regionkey") == c("r_regionkey"))
    sym = F.concat(F.lit("N"), F.lpad(c("n_nationkey").cast("string"), 2, "0"))
    lists = n.groupBy(F.lower("r_name").alias("k")).agg(F.struct(
        F.first("r_name").alias("name"), F.lit("nations of a region").alias("description"), F.array_sort(F.collect_list(sym)).alias("symbols")).alias("v"))
    return lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("doc"))


cte("universe", "SELECT lower(r_name) AS list_name, r_name AS name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
register("universe_explode", lambda t: g.universe_explode(universe_doc(t)), "SELECT * FROM universe")
register("universe_lists", lambda t: g.universe_lists(g.universe_explode(universe_doc(t))), "SELECT list_name, name, count(*) AS symbols FROM universe GROUP BY 1, 2")


def recommended(t):
    case = t.read("region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("trade_"), F.lower("r_name")), F.lower("r_name"))))).alias("cases"))
    doc = universe_doc(t).crossJoin(case).select(F.concat(F.lit('{"symbols":'), "doc", F.lit(',"recommendations":'), "cases", F.lit("}")).alias("doc"))
    return g.universe_for(doc, "trade_europe")


register("universe_for", recommended, "SELECT * FROM universe WHERE list_name = 'europe'")
register("universe_filter", lambda t: g.universe_filter(t.bars_w, g.universe_explode(universe_doc(t)), "asia"),
         "SELECT * FROM bars_w WHERE symbol IN (SELECT symbol FROM universe WHERE list_name = 'asia')")
register("symbol_validate", lambda t: g.symbol_validate(t.read("part").select("p_partkey", c("p_type").alias("symbol")).unionByName(
    t.read("part").select("p_partkey", F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("symbol"))), "symbol"), """
SELECT *, CASE WHEN is_valid THEN upper(trim(symbol)) END AS clean_symbol FROM (
  SELECT *, regexp_full_match(upper(trim(symbol)), '[A-Z0-9.-]{1,10}') AND regexp_matches(upper(trim(symbol)), '[A-Z0-9]') AS is_valid FROM (
   SELECT p_partkey, p_type AS symbol FROM part UNION ALL SELECT p_partkey, ' ' || lower(p_brand) || ' ' FROM part))
""")
register("symbol_validation_summary", lambda t: g.symbol_validation_summary(g.symbol_validate(t.read("customer").select(F.replace("c_name", F.lit("Customer#"), F.lit("C")).alias("symbol")))), """
SELECT *, invalid_count = 0 AND total_symbols > 0 AS valid FROM (SELECT count(*) AS total_symbols, count(*) FILTER (ok) AS valid_count, count(*) FILTER (NOT ok) AS invalid_count
FROM (SELECT regexp_full_match(upper(trim(replace(c_name, 'Customer#', 'C'))), '[A-Z0-9.-]{1,10}') AND regexp_matches(upper(trim(replace(c_name, 'Customer#', 'C'))), '[A-Z0-9]') AS ok FROM customer))
""")
register("custom_list", lambda t: g.custom_list(t.bars_w.select(F.lower("symbol").alias("symbol")), "mine"), "SELECT DISTINCT 'mine' AS list_name, symbol FROM bars_w")
register("ingest_list", lambda t: g.ingest_list(
    t.spark, g.universe_explode(universe_doc(t)), "asia", land_vendor(t), s.scratch_dir(t.spark, "ingest"), VENDOR_SCHEMA), """
SELECT count(*) AS total_rows, count(DISTINCT symbol) AS symbols_fetched, coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM universe WHERE list_name = 'asia' AND symbol NOT IN (SELECT symbol FROM bars_w)), '') AS symbols_missing
FROM bars_w WHERE symbol IN (SELECT symbol FROM universe WHERE list_name = 'asia')
""")



def expired(t):
    """Bars of the years before 1998 go, their folders with them."""
    path = landed(t, "expiring", parts=("year",))
    snapshots.remove_expired(t.spark, path, "year", "1998", dry_run=False)
    return s.read_table(t.spark, path)


register("retention_remove", expired, "SELECT *, CAST(year(date) AS INTEGER) AS year FROM bars_w WHERE year(date) >= 1998")

# -- replay and streams ----------------------------------------------------------------
register("replay_load", lambda t: r.replay_load(t.bars_w, ["N02", "N11"], "1997-01-01", "2000-12-31"),
         "SELECT *, date AS replay_timestamp, date AS original_date FROM bars_w WHERE symbol IN ('N02', 'N11') AND date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'")
cte("numbered", "SELECT *, (row_number() OVER (ORDER BY date, symbol) - 1) // 1000 + 1 AS replay_batch FROM bars_w")
register("replay_envelope", lambda t: r.stream_parse(r.replay_envelope(t.bars_w)).select(
    "symbol", c("date").cast("date").alias("date"), "open", "high", "low", "close", "volume", "adj_close", c("metadata.replay_batch").alias("replay_batch"), c("metadata.topic_name").alias("topic")),
    "SELECT symbol, date, open, high, low, close, volume, adj_close, replay_batch, 'bars' AS topic FROM numbered")


def streamed(t, name):
    return s.scratch_dir(t.spark, name), s.scratch_dir(t.spark, name + "_ck")


def replay_stream(t):
    src = s.scratch_dir(t.spark, "messages")
    r.land_messages(r.replay_envelope(t.bars_w), src)
    out, ck = streamed(t, "replayed")
    r.run_to_table(r.stream_parse(r.message_stream(t.spark, src, files_per_trigger=3)), out, ck)
    return s.read_table(t.spark, out).groupBy(c("metadata.replay_batch").alias("replay_batch")).agg(F.count(F.lit(1)).alias("messages"), F.sum("volume").alias("volume"))


register("replay_stream", replay_stream, "SELECT replay_batch, count(*) AS messages, CAST(sum(volume) AS BIGINT) AS volume FROM numbered GROUP BY 1")


def replay_progress(t):
    """A paced replay, a few landed files a trigger; what its progress table adds up to."""
    src = s.scratch_dir(t.spark, "messages")
    r.land_messages(r.replay_envelope(t.bars_w), src)
    total = t.spark.read.text(src).count()
    out, ck = streamed(t, "paced")
    every = pacing.trigger_seconds(total, 8, 1, total)
    progress = pacing.replay_paced(r.stream_parse(r.message_stream(t.spark, src, files_per_trigger=1)), out, ck, every, "paced_replay", total)
    sums = progress.agg(F.sum("rows").alias("rows"), F.min("rows_left").alias("rows_left"), (F.count(F.lit(1)) > 1).alias("several_triggers"),
                        F.coalesce(F.min("behind_seconds") >= 0, F.lit(False)).alias("delay_known"))
    return sums.withColumn("stored", s.read_table(t.spark, out).agg(F.count(F.lit(1))).scalar())


register("replay_progress", replay_progress, """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS rows_left, true AS several_triggers, true AS delay_known, count(*) AS stored FROM bars_w
""")


def stream_parse(t):
    src = s.scratch_dir(t.spark, "messages")
    r.land_messages(r.replay_envelope(t.bars_w), src)
    out, ck = streamed(t, "counts")
    r.run_complete(r.symbol_counts(r.stream_parse(r.message_stream(t.spark, src, files_per_trigger=4))), out, ck)
    return s.read_table(t.spark, out)


register("stream_parse", stream_parse, "SELECT symbol, count(*) AS messages FROM bars_w GROUP BY 1")
TICK = "symbol string, ts timestamp, event_id bigint, price double, volume bigint"


def tick_rows(t):
    return t.read("events").select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), "event_id", c("value").alias("price"), c("user_id").alias("volume"))


def stream_bars(t):
    src = s.scratch_dir(t.spark, "ticks")
    tick_rows(t).repartitionByRange(6, "ts").write.parquet(src)
    # an end marker far ahead moves the watermark past the last real window
    end = t.spark.range(1).select(F.lit("_end").alias("symbol"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
                                  F.lit(0.0).alias("price"), F.lit(0).cast("bigint").alias("volume"))
    end.write.mode("append").parquet(src)
    out, ck = streamed(t, "bars")
    ticks = t.spark.readStream.schema(TICK).parquet(src)
    r.run_to_table(r.ticks_to_bars(ticks, "1 hour", "60 days"), out, ck)
    return s.read_table(t.spark, out).filter("symbol <> '_end'").withColumn("bar_start", c("bar_start").cast("timestamp_ntz"))


BARS_SQL = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, CAST(sum(user_id) AS BIGINT) AS volume, count(*) AS ticks FROM events GROUP BY 1, 2
"""
register("stream_bars", stream_bars, BARS_SQL)
register("ticks_to_bars", lambda t: r.ticks_to_bars(tick_rows(t), "1 hour").withColumn("bar_start", c("bar_start").cast("timestamp_ntz")), BARS_SQL)


def stream_ad(t):
    """Hourly bars that arrive up to three days after their hour, a few files a trigger."""
    src, (out, ck), late = s.scratch_dir(t.spark, "hourly"), streamed(t, "statuses"), s.scratch_dir(t.spark, "late")
    bars = s.stage(t.bars_h.select("symbol", c("date").cast("timestamp").alias("date"), "close"), "hourly_bars")
    delay, slices = F.pmod(F.xxhash64("symbol", "date"), F.lit(72 * 3600)), 6
    ordered.land_in_slices(bars, src, c("date").cast("long") + delay, slices)
    ordered.end_stream(t.spark, src, bars.schema)
    # rows of one slice lie in several files, in no order: the lateness covers two slices besides the delay
    hours = bars.agg(F.coalesce(F.ceil((F.max("date").cast("long") - F.min("date").cast("long")) / 3600), F.lit(0)).alias("h")).first()["h"]
    stream = t.spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 4).parquet(src)
    ordered.split_late(ordered.ordered_statuses(stream, f"{72 + 2 * hours // slices} hours"), out, late, ck)
    day = ordered.epochs(t.spark, out).groupBy(c("date").cast("timestamp_ntz").alias("date"))
    return day.agg(*[F.count_if(c("issue_status") == k).alias(k) for k in ("advancing", "declining", "unchanged")])


register("stream_ad", stream_ad, """
SELECT date, count(*) FILTER (chg > 0.001) AS advancing, count(*) FILTER (chg < -0.001) AS declining, count(*) FILTER (chg IS NULL OR chg BETWEEN -0.001 AND 0.001) AS unchanged
FROM (SELECT *, (close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS chg FROM bars_h) GROUP BY 1
""")


def stream_dedup(t):
    """Repeated bars in no order, a few files a trigger."""
    src, (out, ck) = s.scratch_dir(t.spark, "dirty"), streamed(t, "dedup")
    bars = t.dirty_bars.select("symbol", c("date").cast("timestamp").alias("ts"), "open")
    ordered.land_in_slices(s.stage(bars.withColumn("at", F.rand(11)), "dirty_rows"), src, c("at"), 4)
    stream = t.spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 4).parquet(src)
    ordered.first_copies_to_table(stream, out, ck, ["symbol", "ts"], "ts")
    return ordered.epochs(t.spark, out).select("symbol", c("ts").cast("date").alias("date"), "open")


register("stream_dedup", stream_dedup, "SELECT DISTINCT symbol, date, open FROM dirty_bars")
