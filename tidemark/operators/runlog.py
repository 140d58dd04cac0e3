"""Run-log, signal-log, monitoring, experiment and parameter analytics.

"Now" is always a parameter (a column), so results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, snap
from tidemark.operators.joins import timeframe_configs
from tidemark.plans.quantile import exact_quantiles
from tidemark.plans.series import Series, in_blocks

c = F.col


def _pct(part: Column, whole: Column) -> Column:
    return F.floor(div(part * 100.0, whole) * 100 + 0.5) / 100


def latest(df: DataFrame, column: str) -> Column:
    """The newest time in a log, as a scalar."""
    return df.agg(F.max(column)).scalar()


# -- views -------------------------------------------------------------------------
def v_timeframe_performance(runs: DataFrame) -> DataFrame:
    """Runs by timeframe; active days are counted from a (timeframe, day) grouping."""
    day = runs.filter(c("timeframe").isNotNull()).groupBy("timeframe", c("start_time").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "completed").alias("ok"),
        F.sum("duration").alias("dur"), F.count("duration").alias("dur_n"),
        F.min("start_time").alias("lo"), F.max("start_time").alias("hi"),
    )
    out = day.groupBy("timeframe").agg(
        F.sum("n").alias("total_runs"), F.sum("ok").alias("successful_runs"),
        div(F.sum("dur"), F.sum("dur_n")).alias("avg_duration"), F.min("lo").alias("first_run"),
        F.max("hi").alias("last_run"), F.count(F.lit(1)).alias("active_days"),
    ).withColumn("success_rate", _pct(c("successful_runs"), c("total_runs")))
    names = timeframe_configs(runs.sparkSession).select("timeframe", c("display_name").alias("timeframe_display"))
    return out.join(F.broadcast(names), "timeframe", "left")


def v_signals_summary(signals: DataFrame) -> DataFrame:
    per = signals.groupBy("timeframe", "signal_date", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c("confidence").cast("double")).alias("conf"),
        *[F.count_if(c("signal_type") == k).alias(k) for k in ("BUY", "SELL", "HOLD")],
    )
    return per.groupBy("timeframe", "signal_date").agg(
        F.sum("n").alias("total_signals"), F.sum("BUY").alias("buy_signals"), F.sum("SELL").alias("sell_signals"),
        F.sum("HOLD").alias("hold_signals"), div(F.sum("conf"), F.sum("n")).alias("avg_confidence"),
        F.count(F.lit(1)).alias("unique_symbols"),
    )


def v_data_availability(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("timeframe", "data_source", "symbol").agg(
        F.sum("records_count").alias("r"), F.min("start_date").alias("lo"), F.max("end_date").alias("hi"),
        F.count(F.lit(1)).alias("f"), F.sum("file_size_bytes").alias("b"),
    )
    out = per.groupBy("timeframe", "data_source").agg(
        F.count(F.lit(1)).alias("unique_symbols"), F.sum("r").alias("total_records"), F.min("lo").alias("earliest_date"),
        F.max("hi").alias("latest_date"), F.sum("f").alias("file_count"), F.sum("b").alias("total_size_bytes"),
    )
    return out.withColumn("total_size_mb", F.floor(c("total_size_bytes") / (1024.0 * 1024.0) * 100 + 0.5) / 100)


# -- runs ----------------------------------------------------------------------------
def run_summary(runs: DataFrame, now: Column) -> DataFrame:
    done = c("status") == "completed"
    recent = c("start_time") >= now - F.expr("INTERVAL 24 HOURS")
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), _pct(F.count_if(done), F.count(F.lit(1))).alias("success_rate"),
        F.count_if(recent).alias("recent_runs"), F.avg(F.when(done, c("duration"))).alias("avg_duration"),
        *[F.count_if(c("status") == k).alias(f"{k}_runs") for k in ("completed", "failed", "running", "stopped")],
    )


def _elapsed(now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(c("start_time").cast("timestamp"))
    return F.coalesce(c("duration"), micros / 1e6)


def run_page(runs: DataFrame, now: Column, limit: int = 10, offset: int = 0) -> DataFrame:
    """Newest first; the page is a top-k, the total a scalar subquery."""
    total = runs.agg(F.count(F.lit(1))).scalar()
    page = runs.orderBy(c("start_time").desc(), c("run_id").desc()).offset(offset).limit(limit)
    return page.select(
        "run_id", "command", "status", "start_time", _elapsed(now).alias("duration_seconds"), total.alias("total_count")
    )


def run_detail(runs: DataFrame, run_id) -> DataFrame:
    return runs.filter(c("run_id") == run_id)


def run_latest_running(runs: DataFrame, now: Column) -> DataFrame:
    """The newest running run with its uptime, else the last run."""
    key = F.struct((c("status") == "running").alias("on"), "start_time", "run_id")
    top = runs.agg(F.max_by(F.struct("run_id", "command", "status", "start_time"), key).alias("r"))
    running = c("r.status") == "running"
    up = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(c("r.start_time").cast("timestamp"))) / 1e6
    return top.select(
        F.when(c("r").isNull(), "never_run").when(running, "running").otherwise("stopped").alias("state"),
        "r.*", F.when(running, F.floor(up)).alias("uptime_seconds"),
    )


def run_recent(runs: DataFrame, now: Column, days: int = 2, n: int = 20) -> DataFrame:
    since = runs.filter(c("start_time") >= now - F.make_dt_interval(days=F.lit(days)))
    return since.orderBy(c("start_time").desc(), c("run_id").desc()).limit(n).select(
        "run_id", "command", "status", "start_time", _elapsed(now).alias("duration_seconds")
    )


# -- monitoring ------------------------------------------------------------------------
def metric_summary(metrics: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    recent = metrics.filter(c("ts") > now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("avg"), F.max_by("value", F.struct("ts", "id")).alias("latest"),
    )


#: metric -> alert threshold (fixed values)
THRESHOLDS = {"cpu_usage": 80.0, "memory_usage": 85.0, "disk_usage": 90.0, "error_rate": 0.1, "response_time": 5.0}


def metric_alerts(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Values over their metric's threshold; the thresholds fold into the scan."""
    limits = F.create_map(*[F.lit(x) for pair in (thresholds or THRESHOLDS).items() for x in pair])
    return metrics.withColumn("threshold", F.try_element_at(limits, c("name"))).filter(c("value") > c("threshold"))


SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def error_summary(log: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Errors by component and severity against all its operations."""
    recent = log.filter(c("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy("component").agg(
        F.count(F.lit(1)).alias("operations"), F.count_if("is_error").alias("errors"),
        *[F.count_if(c("is_error") & (c("severity") == k)).alias(k.lower()) for k in SEVERITIES],
    ).withColumn("error_rate", div(c("errors"), F.greatest(c("operations"), F.lit(1))))


def component_health(log: DataFrame, now: Column, rollback: float = 0.05) -> DataFrame:
    """Health by the last hour's error rate; rollback by the last five minutes'."""
    hour = log.filter(c("ts") >= now - F.expr("INTERVAL 1 HOUR"))
    soon = c("ts") >= now - F.expr("INTERVAL 5 MINUTES")
    out = hour.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_operations"), F.count_if("is_error").alias("total_errors"),
        F.max(F.when(c("is_error"), c("ts"))).alias("last_error"),
        div(F.count_if(soon & c("is_error")), F.greatest(F.count_if(soon), F.lit(1))).alias("_soon"),
    ).withColumn("error_rate", div(c("total_errors"), c("total_operations")))
    rate = c("error_rate")
    status = (
        F.when(rate == 0, "HEALTHY").when(rate < 0.01, "WARNING").when(rate < 0.05, "DEGRADED").otherwise("CRITICAL")
    )
    return out.withColumns({"health_status": status, "should_rollback": c("_soon") > rollback}).drop("_soon")


def request_metrics(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """Rate, error share and exact p50/p95 latency per time window."""
    slot = F.window("ts", f"{minutes} minutes")["start"].alias("window_start")
    rows = requests.select(slot, "is_error", "latency")
    base = rows.groupBy("window_start").agg(
        (F.count(F.lit(1)) / (minutes * 60.0)).alias("rate"), F.count(F.lit(1)).alias("requests"),
        div(F.count_if("is_error"), F.count(F.lit(1))).alias("error_share"),
    )
    tails = exact_quantiles(rows, "latency", [0.5, 0.95], ["window_start"])
    return base.join(tails, "window_start", "left").select(
        c("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "rate", "error_share",
        c("q")[0].alias("p50"), c("q")[1].alias("p95"),
    )


# -- experiments and parameters ------------------------------------------------------------
def training_history(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(c("start_time").desc(), c("run_id").desc()).limit(n)


def runs_best(runs: DataFrame, metric: str, by: list[str]) -> DataFrame:
    key = F.struct(c(metric), -c("run_id"))
    return runs.filter(c(metric).isNotNull()).groupBy(*by).agg(
        F.max_by("run_id", key).alias("run_id"), F.max(metric).alias("metric_value")
    )


def runs_compare(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """All runs, best first."""
    return runs.select("run_id", "run_name", *metrics).orderBy(c(metrics[0]).desc_nulls_last(), "run_id")


def runs_describe(runs: DataFrame, metrics: list[str], params: list[str]) -> DataFrame:
    """Tall description: moments and exact quartiles of metrics, distinct params."""
    from tidemark.plans.quantile import column_quantiles, unpivot

    names = ("count", "mean", "std", "min", "max")
    base = unpivot(runs, metrics).groupBy("column").agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = column_quantiles(runs, metrics, [0.25, 0.5, 0.75])
    quart = [F.struct(F.lit(n).alias("statistic"), c("q")[i].alias("value")) for i, n in enumerate(("25%", "50%", "75%"))]
    stats = [F.struct(F.lit(n).alias("statistic"), c(n).alias("value")) for n in names]
    wide = base.join(q.select("column", "q"), "column").select("column", F.explode(F.array(*stats, *quart)).alias("x"))
    tall = wide.select("column", "x.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("column"), c(p).cast("string").alias("v")) for p in params]))
    seen = runs.select(pairs.alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("column", "v").agg(F.lit(1).alias("_u"))
    distinct = seen.groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return tall.unionByName(distinct.withColumn("statistic", F.lit("nunique")))


PARAMETERS = Series(keys=("group_name", "parameter_name"), order=("modified", "change_id"))


def parameter_latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("group_name", "parameter_name").agg(
        F.max_by("value", F.struct("modified", "change_id")).alias("value"),
        F.max("modified").alias("last_modified"), F.count(F.lit(1)).alias("changes"),
    )


def param_diff(changes: DataFrame, block_rows: int = 200_000) -> DataFrame:
    """Each change beside the value it replaced; only true changes are kept.

    A parameter may own a third of the log, so histories run in row blocks.
    """
    def step(df: DataFrame, s: Series) -> DataFrame:
        return df.withColumn("old_value", F.lag("value").over(s.ordered))

    both = in_blocks(changes, step, 1, s=PARAMETERS, block_rows=block_rows)
    return both.filter(c("old_value").isNull() | (c("old_value") != c("value"))).withColumn(
        "delta", c("value") - c("old_value")
    )


def ab_assign(rows: DataFrame, key: str, split: int = 50) -> DataFrame:
    """Stable traffic split by a hash of the key."""
    h = F.conv(F.substring(F.md5(c(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("bucket", h % 100).withColumn(
        "arm", F.when(c("bucket") < split, "A").otherwise("B")
    )


def ab_compare(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("arm").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"), F.avg(c("success").cast("int")).alias("success_rate"),
    )
