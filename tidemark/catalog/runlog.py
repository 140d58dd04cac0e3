"""Run-log, monitoring, experiment and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.core import cte, register
from tidemark.catalog.prep import train
from tidemark.catalog.scalars import signals_json
from tidemark.operators import models as m
from tidemark.operators import parse, prep
from tidemark.operators import runlog as r
from tidemark.sources.storage import stage

c = F.col
NOW = "2024-01-30 12:00:00"
N = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


register("v_timeframe_performance", lambda t: r.v_timeframe_performance(t.pipeline_runs), """
SELECT p.timeframe, display_name AS timeframe_display, count(*) AS total_runs, count(*) FILTER (status = 'completed') AS successful_runs,
  floor(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS success_rate, avg(duration) AS avg_duration,
  min(start_time) AS first_run, max(start_time) AS last_run, count(DISTINCT CAST(start_time AS DATE)) AS active_days
FROM pipeline_runs p LEFT JOIN tf_cfg c ON c.timeframe = p.timeframe GROUP BY 1, 2
""", "avg_duration")
register("v_signals_summary", lambda t: r.v_signals_summary(parse.json_parse_signals(signals_json(t))), """
SELECT timeframe, signal_date, count(*) AS total_signals, count(*) FILTER (signal_type = 'BUY') AS buy_signals, count(*) FILTER (signal_type = 'SELL') AS sell_signals,
  count(*) FILTER (signal_type = 'HOLD') AS hold_signals, avg(confidence::DOUBLE) AS avg_confidence, count(DISTINCT symbol) AS unique_symbols FROM signal_rows GROUP BY 1, 2
""", "avg_confidence")
cte("avail", """
SELECT symbol, CASE WHEN volume % 2 = 0 THEN '1week' END AS timeframe, 'landed' AS data_source, min(date) AS start_date, max(date) AS end_date, count(*) AS records_count, count(*) * 64 AS file_size_bytes
FROM bars_w GROUP BY symbol, year(date), 2
""")
register("v_data_availability", lambda t: r.v_data_availability(t.bars_w.groupBy(
    "symbol", F.year("date"), F.when(c("volume") % 2 == 0, "1week").alias("timeframe"), F.lit("landed").alias("data_source")).agg(
    F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("records_count"), (F.count(F.lit(1)) * 64).alias("file_size_bytes"))), """
SELECT timeframe, data_source, count(DISTINCT symbol) AS unique_symbols, CAST(sum(records_count) AS BIGINT) AS total_records, min(start_date) AS earliest_date, max(end_date) AS latest_date,
  count(*) AS file_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes, floor(sum(file_size_bytes) / (1024.0::DOUBLE * 1024.0) * 100 + 0.5) / 100 AS total_size_mb FROM avail GROUP BY 1, 2
""")
register("run_summary", lambda t: r.run_summary(t.pipeline_runs, now()), f"""
SELECT count(*) AS total_runs, floor(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS success_rate,
  count(*) FILTER (start_time >= {N} - INTERVAL 24 HOUR) AS recent_runs, avg(duration) FILTER (status = 'completed') AS avg_duration,
  count(*) FILTER (status = 'completed') AS completed_runs, count(*) FILTER (status = 'failed') AS failed_runs, count(*) FILTER (status = 'running') AS running_runs,
  count(*) FILTER (status = 'stopped') AS stopped_runs FROM pipeline_runs
""", "avg_duration")
EL = f"coalesce(duration, epoch_us({N}) / 1e6 - epoch_us(start_time) / 1e6)"
EL = f"coalesce(duration, (epoch_us({N}) - epoch_us(start_time)) / 1e6)"
register("run_page", lambda t: r.run_page(t.pipeline_runs, now(), 25, 50), f"""
SELECT run_id, command, status, start_time, {EL} AS duration_seconds, (SELECT count(*) FROM pipeline_runs) AS total_count FROM pipeline_runs
ORDER BY start_time DESC, run_id DESC LIMIT 25 OFFSET 50
""", "duration_seconds")
register("run_detail", lambda t: r.run_detail(t.pipeline_runs, 777), "SELECT * FROM pipeline_runs WHERE run_id = 777")
register("run_latest_running", lambda t: r.run_latest_running(t.pipeline_runs, now()), f"""
SELECT CASE status WHEN 'running' THEN 'running' ELSE 'stopped' END AS state, run_id, command, status, start_time,
  CASE status WHEN 'running' THEN CAST(floor((epoch_us({N}) - epoch_us(start_time)) / 1e6) AS BIGINT) END AS uptime_seconds
FROM pipeline_runs ORDER BY status = 'running' DESC, start_time DESC, run_id DESC LIMIT 1
""")
register("run_recent", lambda t: r.run_recent(t.pipeline_runs, now()), f"""
SELECT run_id, command, status, start_time, {EL} AS duration_seconds FROM pipeline_runs WHERE start_time >= {N} - INTERVAL 2 DAY ORDER BY start_time DESC, run_id DESC LIMIT 20
""", "duration_seconds")
register("metric_summary", lambda t: r.metric_summary(
    t.read("events").select(c("event_type").alias("name"), "ts", c("event_id").alias("id"), "value"), now(), 24), f"""
SELECT event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS avg, arg_max(value, row(ts, event_id)) AS latest
FROM events WHERE ts > {N} - INTERVAL 24 HOUR GROUP BY 1
""", "avg")
LIMITS = {"click": 20.0, "error": 15.5, "view": 30.0}
register("metric_alerts", lambda t: r.metric_alerts(
    t.read("events").select(c("event_type").alias("name"), "ts", "event_id", "value"), LIMITS), """
SELECT event_type AS name, ts, event_id, value, threshold FROM events JOIN (VALUES ('click', 20.0::DOUBLE), ('error', 15.5::DOUBLE), ('view', 30.0::DOUBLE)) v(n, threshold) ON n = event_type WHERE value > threshold
""")
cte("ops", """
SELECT 'C' || CAST(user_id % 5 AS VARCHAR) AS component, ts, event_type = 'error' AS is_error,
  CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, value AS latency FROM events
""")


def ops(t):
    e = c("event_id") % 4
    return t.read("events").select(
        F.concat(F.lit("C"), (c("user_id") % 5).cast("string")).alias("component"), "ts", (c("event_type") == "error").alias("is_error"),
        F.when(e == 0, "LOW").when(e == 1, "MEDIUM").when(e == 2, "HIGH").otherwise("CRITICAL").alias("severity"), c("value").alias("latency"))


register("error_summary", lambda t: r.error_summary(ops(t), now(), 24), f"""
SELECT component, count(*) AS operations, count(*) FILTER (is_error) AS errors, count(*) FILTER (is_error AND severity = 'LOW') AS low, count(*) FILTER (is_error AND severity = 'MEDIUM') AS medium,
  count(*) FILTER (is_error AND severity = 'HIGH') AS high, count(*) FILTER (is_error AND severity = 'CRITICAL') AS critical, count(*) FILTER (is_error) / count(*)::DOUBLE AS error_rate
FROM ops WHERE ts >= {N} - INTERVAL 24 HOUR GROUP BY 1
""", "error_rate")
register("component_health", lambda t: r.component_health(ops(t), now()), f"""
SELECT *, CASE WHEN error_rate = 0 THEN 'HEALTHY' WHEN error_rate < 0.01 THEN 'WARNING' WHEN error_rate < 0.05 THEN 'DEGRADED' ELSE 'CRITICAL' END AS health_status FROM (
 SELECT component, count(*) AS total_operations, count(*) FILTER (is_error) AS total_errors, max(ts) FILTER (is_error) AS last_error, count(*) FILTER (is_error) / count(*)::DOUBLE AS error_rate,
  count(*) FILTER (is_error AND ts >= {N} - INTERVAL 5 MINUTE) / greatest(count(*) FILTER (ts >= {N} - INTERVAL 5 MINUTE), 1)::DOUBLE > 0.05 AS should_rollback
 FROM ops WHERE ts >= {N} - INTERVAL 1 HOUR GROUP BY 1)
""", "error_rate")
register("request_metrics", lambda t: r.request_metrics(ops(t)), """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests, count(*) / 300.0::DOUBLE AS rate, count(*) FILTER (is_error) / count(*)::DOUBLE AS error_share,
  quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM ops GROUP BY 1
""", "rate error_share p50 p95")
cte("experiments", "SELECT event_id AS run_id, 'run_' || CAST(event_id AS VARCHAR) AS run_name, event_type AS experiment, ts AS start_time, value AS accuracy, value / (1 + user_id) AS f1, props AS params, user_id % 5 AS seed FROM events")


def experiments(t):
    return t.read("events").select(
        c("event_id").alias("run_id"), F.concat(F.lit("run_"), c("event_id").cast("string")).alias("run_name"), c("event_type").alias("experiment"),
        c("ts").alias("start_time"), c("value").alias("accuracy"), (c("value") / (1 + c("user_id"))).alias("f1"), c("props").alias("params"), (c("user_id") % 5).alias("seed"))


register("training_history", lambda t: r.training_history(experiments(t).drop("f1"), 30),
         "SELECT * EXCLUDE f1 FROM experiments ORDER BY start_time DESC, run_id DESC LIMIT 30")
register("runs_best", lambda t: r.runs_best(experiments(t), "accuracy", ["experiment"]),
         "SELECT experiment, arg_max(run_id, row(accuracy, -run_id)) AS run_id, max(accuracy) AS metric_value FROM experiments GROUP BY 1")
register("runs_compare", lambda t: r.runs_compare(experiments(t), ["accuracy", "f1"]),
         "SELECT run_id, run_name, accuracy, f1 FROM experiments ORDER BY accuracy DESC NULLS LAST, run_id", "f1")
register("runs_describe", lambda t: r.runs_describe(experiments(t), ["accuracy", "f1"], ["params", "seed"]), " UNION ALL ".join(
    f"SELECT '{x}' AS column, '{n}' AS statistic, CAST({e} AS DOUBLE) AS value FROM experiments" for x in ("accuracy", "f1") for n, e in (
        ("count", f"count({x})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"), ("max", f"max({x})"),
        ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"), ("75%", f"quantile_cont({x}, 0.75)")))
    + "".join(f" UNION ALL SELECT '{p}', 'nunique', CAST(count(DISTINCT {p}) AS DOUBLE) FROM experiments" for p in ("params", "seed")), "value")
cte("changes", "SELECT event_type AS group_name, 'p' || CAST(user_id % 4 AS VARCHAR) AS parameter_name, floor(value) AS value, ts AS modified, event_id AS change_id FROM events")


def changes(t):
    return t.read("events").select(
        c("event_type").alias("group_name"), F.concat(F.lit("p"), (c("user_id") % 4).cast("string")).alias("parameter_name"),
        F.floor("value").cast("double").alias("value"), c("ts").alias("modified"), c("event_id").alias("change_id"))


register("parameter_latest", lambda t: r.parameter_latest(changes(t)),
         "SELECT group_name, parameter_name, arg_max(value, row(modified, change_id)) AS value, max(modified) AS last_modified, count(*) AS changes FROM changes GROUP BY 1, 2")
register("param_diff", lambda t: r.param_diff(changes(t)), """
SELECT *, value - old_value AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY group_name, parameter_name ORDER BY modified, change_id) AS old_value FROM changes)
WHERE old_value IS NULL OR old_value <> value
""")
cte("arms", "SELECT event_id, value, event_type = 'purchase' AS success, (('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT) % 100 AS bucket FROM events")


def arms(t):
    return r.ab_assign(t.read("events").select("event_id", "user_id", "value", (c("event_type") == "purchase").alias("success")), "user_id", 40).drop("user_id")


register("ab_assign", arms, "SELECT *, CASE WHEN bucket < 40 THEN 'A' ELSE 'B' END AS arm FROM arms")
register("ab_compare", lambda t: r.ab_compare(arms(t)), """
SELECT CASE WHEN bucket < 40 THEN 'A' ELSE 'B' END AS arm, count(*) AS requests, avg(value) AS mean_value, stddev_samp(value) AS std_value, avg(CASE WHEN success THEN 1 ELSE 0 END) AS success_rate FROM arms GROUP BY 1
""", "mean_value std_value success_rate")

# -- models ------------------------------------------------------------------------
FEATURES = ["sma", "volatility", "volume", "open", "close"]


def labelled(t):
    """The training set, written once: estimators read it many times over."""
    return stage(_labelled(t), "train")


def _labelled(t):
    return train(t).filter("target IS NOT NULL").withColumn("target", c("target").cast("double")).withColumn("volume", c("volume").cast("double"))


cte("scored_votes", """
SELECT b.symbol, b.date, x.target AS label, CASE WHEN b.close > b.open THEN 1.0 ELSE 0.0 END AS prediction,
  (0.05 + 0.9 * ((b.close - b.low) / CASE WHEN b.high = b.low THEN 1 ELSE b.high - b.low END)) AS score
FROM bars_w b JOIN (SELECT symbol, date, target FROM train_rows WHERE target IS NOT NULL) x ON x.symbol = b.symbol AND x.date = b.date
""")


def votes(t):
    span = F.when(c("high") == c("low"), 1.0).otherwise(c("high") - c("low"))
    return prep.target_label(t.bars_w).filter("target IS NOT NULL").select(
        c("target").alias("label"), F.when(c("close") > c("open"), 1.0).otherwise(0.0).alias("prediction"), (0.05 + (c("close") - c("low")) / span * 0.9).alias("score"))


register("model_metrics", lambda t: m.model_metrics(votes(t)), """
SELECT sum(hit) / sum(n) AS accuracy, sum(prec * n) / sum(n) AS precision, sum(rec * n) / sum(n) AS recall, sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * n) / sum(n) AS f1,
  CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes,
  (SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM (
     SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored_votes GROUP BY 1))) AS roc_auc,
  (SELECT -avg(CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END) FROM scored_votes) AS log_loss
FROM (SELECT k, n, hit, hit / NULLIF(called, 0)::DOUBLE AS prec, hit / n::DOUBLE AS rec FROM (
  SELECT l.k, (SELECT count(*) FROM scored_votes WHERE label = l.k) AS n, (SELECT count(*) FROM scored_votes WHERE label = l.k AND prediction = l.k) AS hit,
    (SELECT count(*) FROM scored_votes WHERE prediction = l.k) AS called FROM (SELECT DISTINCT label AS k FROM scored_votes) l))
""", "accuracy precision recall f1 roc_auc log_loss")


PREPARED = ["sma", "volatility", "volume", "open", "close"]


def prepared(t):
    # moving means are missing at the start of a series, labels at its end
    return m.training_set(train(t), ["symbol", "date"], PREPARED, "target", ["symbol"])


def scaled(x: str) -> str:
    return f"(coalesce(r.{x}, s.m_{x}) - s.m_{x}) / CASE WHEN s.s_{x} = 0 THEN 1 ELSE s.s_{x} END AS x_{x}"


PREPARED_SQL = f"""
WITH filled AS (
  SELECT symbol, date, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in PREPARED)},
         coalesce(target, (SELECT target FROM train_rows WHERE target IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1)) AS target FROM train_rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha256('42|' || symbol || '|' || CAST(date AS VARCHAR)), symbol, date) - 1
            < floor(count(*) OVER (PARTITION BY target) * 0.8::DOUBLE + 0.5::DOUBLE) AS is_train FROM filled),
codes AS (SELECT symbol AS value, row_number() OVER (ORDER BY symbol) - 1 AS code FROM (SELECT DISTINCT symbol FROM placed WHERE is_train)),
coded AS (SELECT p.*, CAST(coalesce(k.code, (SELECT count(*) FROM codes)) AS DOUBLE) AS symbol_code FROM placed p LEFT JOIN codes k ON k.value = p.symbol),
stats AS (SELECT {', '.join(f'avg({x}) AS m_{x}, sqrt(var_pop({x}) * count({x}) / count(*)) AS s_{x}' for x in [*PREPARED, 'symbol_code'])} FROM coded WHERE is_train)
SELECT symbol, date, CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, target, {', '.join(scaled(x) for x in [*PREPARED, 'symbol_code'])}
FROM coded r, stats s
"""


def fitted(t, name="random_forest"):
    a, b = m.split_time(labelled(t))
    return m.model_train(a, FEATURES, "target", name), a, b


def trained(t):
    model, a, b = fitted(t)
    parts = [m.model_metrics(m.model_score(model, d, ["target"]).withColumnRenamed("target", "label")).withColumn("part", F.lit(n))
             for n, d in (("train", a), ("test", b))]
    return parts[0].unionByName(parts[1])


def regress(t):
    df = stage(prep.target_label(t.bars_w, kind="regression").filter("target IS NOT NULL").withColumn("volume", c("volume").cast("double")), "train")
    a, b = m.split_time(df)
    return m.model_regress(a, b, ["open", "high", "low", "close", "volume"], "target")


def score(t):
    model, _, b = fitted(t, "logistic")
    return m.model_score(model, b, ["symbol", "date", "target"])


def importance(t):
    model, a, _ = fitted(t)
    return m.model_importance(model, FEATURES, a)


register("model_prepare", prepared, PREPARED_SQL, " ".join(f"x_{x}" for x in [*PREPARED, "symbol_code"]))
register("model_train", trained)
register("model_compare", lambda t: m.model_compare(*m.split_time(labelled(t)), FEATURES, "target"))
register("model_regress", regress)
register("model_importance", importance)
register("model_score", score)
register("model_tune", lambda t: m.model_tune(labelled(t), FEATURES, "target", [{"regParam": x, "elasticNetParam": y} for x in (0.01, 0.1) for y in (0.0, 0.5)], folds=3))
register("pareto_front", lambda t: m.pareto_front(experiments(t).select("run_id", "accuracy", "f1"), "accuracy", "f1"), """
SELECT run_id, accuracy, f1 FROM experiments e WHERE NOT EXISTS (
  SELECT 1 FROM experiments o WHERE o.accuracy >= e.accuracy AND o.f1 >= e.f1 AND (o.accuracy > e.accuracy OR o.f1 > e.f1))
""", "f1")
