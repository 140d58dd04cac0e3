"""Calendar, ratio, sentiment, JSON and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.breadth import weekly
from tidemark.catalog.core import cte, register
from tidemark.catalog.indicators import mean, pct
from tidemark.functions import calendar, ratios, sentiment
from tidemark.operators import indicators as i
from tidemark.operators import joins, parse

c = F.col


def calendar_query(build):
    return lambda t: t.bars_h.select("symbol", "date", *[x.alias(n) for n, x in build(c("date")).items()])


def cyc(name: str, x: str, period: int) -> str:
    return f"sin({x} * 2 * pi() / {period}) AS {name}_sin, cos({x} * 2 * pi() / {period}) AS {name}_cos"


def i32(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


register("time_basic", calendar_query(calendar.time_basic), f"""
SELECT symbol, date, {i32('hour(date)')} AS hour, {i32('isodow(date) - 1')} AS day_of_week, {i32('day(date)')} AS day_of_month,
  {i32('month(date)')} AS month, {i32('quarter(date)')} AS quarter, {i32('year(date)')} AS year,
  {cyc('hour', 'hour(date)', 24)}, {cyc('day', '(isodow(date) - 1)', 7)}, {cyc('month', 'month(date)', 12)},
  {i32('isodow(date) >= 6')} AS is_weekend, {i32('day(date) = 1')} AS is_month_start,
  {i32('CAST(date AS DATE) = last_day(date)')} AS is_month_end,
  {i32('day(date) = 1 AND month(date) IN (1, 4, 7, 10)')} AS is_quarter_start,
  {i32('CAST(date AS DATE) = last_day(date) AND month(date) IN (3, 6, 9, 12)')} AS is_quarter_end,
  {i32('day(date) = 1 AND month(date) = 1')} AS is_year_start,
  {i32('CAST(date AS DATE) = last_day(date) AND month(date) = 12')} AS is_year_end FROM bars_h
""", "hour_sin hour_cos day_sin day_cos month_sin month_cos")
register("time_season", lambda t: t.bars_w.select("symbol", "date", *[x.alias(n) for n, x in calendar.time_season(c("date")).items()]), f"""
SELECT symbol, date, {i32('dayofyear(date)')} AS day_of_year, {i32('weekofyear(date)')} AS week_of_year,
  CASE WHEN month(date) IN (12, 1, 2) THEN 1 WHEN month(date) <= 5 THEN 2 WHEN month(date) <= 8 THEN 3 ELSE 4 END AS season,
  {cyc('day_of_year', 'dayofyear(date)', 365)}, {cyc('week_of_year', 'weekofyear(date)', 52)} FROM bars_w
""", "day_of_year_sin day_of_year_cos week_of_year_sin week_of_year_cos")
register("time_session", lambda t: t.ticks.select("event_id", "ts", *[x.alias(n) for n, x in calendar.time_session(c("ts")).items()]), f"""
SELECT event_id, ts, {i32('h >= 4 AND h < 9')} AS is_premarket, {i32('h >= 9 AND h < 16')} AS is_regular_hours,
  {i32('h >= 16 AND h < 20')} AS is_afterhours, {i32('h >= 20 OR h < 4')} AS is_overnight,
  {i32('CASE WHEN h < 9 THEN (9 - h) * 60 - m WHEN h >= 16 THEN (24 - h + 9) * 60 - m ELSE 0 END')} AS minutes_to_open,
  {i32('CASE WHEN h < 16 THEN (16 - h) * 60 - m ELSE 0 END')} AS minutes_to_close
FROM (SELECT event_id, ts, hour(ts) AS h, minute(ts) AS m FROM ticks)
""")

# -- fundamentals ---------------------------------------------------------------
cte("reports", "SELECT *, equity AS book_value, revenue AS sales, equity AS total_equity FROM fundamentals_q")


def reports(t):
    return t.fundamentals_q.withColumns(
        {"book_value": c("equity"), "sales": c("revenue"), "total_equity": c("equity")}
    )


for block, pairs in ratios.STATEMENT_RATIOS.items():
    name = {"valuation": "fund_valuation", "profitability": "fund_profit",
            "leverage": "fund_leverage", "efficiency": "fund_efficiency"}[block]
    register(name, lambda t, block=block: ratios.fund_block(reports(t), block).select("symbol", "date", *ratios.STATEMENT_RATIOS[block]),
             "SELECT symbol, date, " + ", ".join(f"{a} / NULLIF({b}, 0) AS {n}" for n, (a, b) in pairs.items()) + " FROM reports",
             " ".join(pairs))
ALLR = [n for b in ("valuation", "profitability", "leverage") for n in ratios.STATEMENT_RATIOS[b]]
register("fund_all", lambda t: ratios.fund_all(reports(t)).select("symbol", "date", *ALLR, "revenue_growth", "earnings_growth"),
         "SELECT symbol, date, " + ", ".join(f"{a} / NULLIF({b}, 0) AS {n}" for blk in ("valuation", "profitability", "leverage")
                                             for n, (a, b) in ratios.STATEMENT_RATIOS[blk].items())
         + f", {pct('revenue', 4)} AS revenue_growth, {pct('earnings', 4)} AS earnings_growth FROM reports",
         " ".join(ALLR) + " revenue_growth earnings_growth")
REPORT_COLS = ["revenue", "net_income", "earnings", "total_assets", "total_debt", "inventory", "market_cap", "book_value", "total_equity"]
cte("asof_w", f"""
SELECT b.*, {', '.join('r.' + x for x in REPORT_COLS)} FROM bars_w b ASOF LEFT JOIN reports r ON b.symbol = r.symbol AND b.date >= r.date
""")


def bars_with_reports(t):
    return joins.asof_fundamentals(t.bars_landed, reports(t), REPORT_COLS)


register("asof_fundamentals", bars_with_reports, "SELECT * FROM asof_w")
register("fund_indicators", lambda t: ratios.fund_indicators(bars_with_reports(t)).select("symbol", "date", *ratios.PRICE_RATIOS),
         "SELECT symbol, date, " + ", ".join(
             f"{top[0]} / NULLIF({bottom}, 0) AS {n}" if {*top, bottom} <= {*REPORT_COLS, "close"} else f"NULL::DOUBLE AS {n}"
             for n, (top, bottom) in ratios.PRICE_RATIOS.items()) + " FROM asof_w",
         " ".join(ratios.PRICE_RATIOS))

# -- sentiment --------------------------------------------------------------------


def sent(name, build, sql, extra=""):
    register(name, lambda t: t.sentiment_d.select("symbol", "date", build().alias("value")),
             f"SELECT symbol, date, {sql} AS value FROM sentiment_d", "value")


sent("sent_social", lambda: sentiment.social(c("positive_mentions"), c("negative_mentions")),
     "coalesce((positive_mentions - negative_mentions) / NULLIF(positive_mentions + negative_mentions, 0)::DOUBLE, 0)")
sent("sent_analyst", lambda: sentiment.analyst(c("buy_ratings"), c("hold_ratings"), c("sell_ratings")),
     "coalesce((buy_ratings + 0.5 * hold_ratings) / NULLIF(buy_ratings + hold_ratings + sell_ratings, 0)::DOUBLE, 0.5)")
sent("sent_insider", lambda: sentiment.insider(c("call_volume"), c("put_volume"), c("news_count")),
     "coalesce((call_volume - put_volume) / NULLIF(call_volume + put_volume, 0), 0) * ((call_volume + put_volume) / NULLIF(news_count, 0)::DOUBLE)")
sent("sent_options", lambda: sentiment.options_flow(c("call_volume"), c("put_volume"), c("buy_ratings"), c("sell_ratings")),
     "1 / NULLIF(coalesce(put_volume / NULLIF(call_volume, 0), 1), 0) + (buy_ratings - sell_ratings) / NULLIF(buy_ratings + sell_ratings, 0)::DOUBLE")
sent("sent_short", lambda: sentiment.short_interest(c("put_volume"), c("volume"), c("call_volume")),
     "put_volume / NULLIF(volume, 0) * coalesce(put_volume / NULLIF(call_volume, 0), 0)")
sent("put_call_ratio", lambda: sentiment.put_call(c("put_volume"), c("call_volume")),
     "coalesce(put_volume / NULLIF(call_volume, 0), 1)")


def mm(x: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY symbol)", f"max({x}) OVER (PARTITION BY symbol)"
    return f"(({x} - {lo}) / NULLIF({hi} - {lo}, 0)::DOUBLE)"


sent("sent_news", lambda: sentiment.news(c("sentiment_score"), c("news_count")), f"sentiment_score * {mm('news_count')}")
register("sent_label_mean", lambda t: sentiment.label_mean(t.sentiment_items), """
SELECT symbol, date, avg(CASE lower(sentiment) WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE) AS sentiment_mean, count(*) AS items
FROM sentiment_items GROUP BY 1, 2
""", "sentiment_mean")
cte("fg", f"""
SELECT symbol, date, volume, {pct('volume', 3)} AS momentum, abs({pct('volume', 1)}) AS volatility,
  coalesce(put_volume / NULLIF(call_volume, 0), 1) AS put_call_ratio FROM sentiment_d
""")


def fear_greed_input(t):
    from tidemark.functions.frames import pct_change
    return t.sentiment_d.select(
        "symbol", "date", "volume", pct_change(c("volume"), 3).alias("momentum"),
        F.abs(pct_change(c("volume"), 1)).alias("volatility"),
        sentiment.put_call(c("put_volume"), c("call_volume")).alias("put_call_ratio"))


def fear_greed_query(t):
    df = fear_greed_input(t)
    return df.select("symbol", "date", sentiment.fear_greed(df).alias("fear_greed"))


register("fear_greed", fear_greed_query, f"""
SELECT symbol, date, list_avg(list_filter([1 - vo, mo, vl, 1 - pc], lambda x: x IS NOT NULL)) AS fear_greed FROM (
  SELECT symbol, date, {mm('volatility')} AS vo, {mm('momentum')} AS mo, {mm('volume')} AS vl, {mm('put_call_ratio')} AS pc FROM fg)
""", "fear_greed")
NAMED = ["social_sentiment", "analyst_rating", "put_call_ratio", "options_flow", "insider_trading"]
register("indicator_dispatch", lambda t: sentiment.dispatch(t.sentiment_d, NAMED).select("symbol", "date", *NAMED), """
SELECT symbol, date, coalesce((positive_mentions - negative_mentions) / NULLIF(positive_mentions + negative_mentions, 0)::DOUBLE, 0) AS social_sentiment,
  coalesce((buy_ratings + 0.5 * hold_ratings) / NULLIF(buy_ratings + hold_ratings + sell_ratings, 0)::DOUBLE, 0.5) AS analyst_rating,
  coalesce(put_volume / NULLIF(call_volume, 0), 1) AS put_call_ratio, 1 / NULLIF(coalesce(put_volume / NULLIF(call_volume, 0), 1), 0) AS options_flow,
  NULL::DOUBLE AS insider_trading FROM sentiment_d
""", " ".join(NAMED))
SCORED = ["social_sentiment", "analyst_rating", "put_call_ratio"]
cte("sent_scored", f"""
SELECT symbol, date, ((2 * {mm('social_sentiment')} - 1) + (2 * {mm('analyst_rating')} - 1) + (2 * {mm('put_call_ratio')} - 1)) / 3 AS total FROM (
  SELECT symbol, date, coalesce((positive_mentions - negative_mentions) / NULLIF(positive_mentions + negative_mentions, 0)::DOUBLE, 0) AS social_sentiment,
  coalesce((buy_ratings + 0.5 * hold_ratings) / NULLIF(buy_ratings + hold_ratings + sell_ratings, 0)::DOUBLE, 0.5) AS analyst_rating,
  coalesce(put_volume / NULLIF(call_volume, 0), 1) AS put_call_ratio FROM sentiment_d)
""")


def scored(t):
    return sentiment.dispatch(t.sentiment_d, SCORED).select("symbol", "date", *SCORED)


def sent_score_query(t):
    df = scored(t)
    return df.select("symbol", "date", sentiment.sentiment_score(df, SCORED).alias("score"))


register("sent_score", sent_score_query, "SELECT symbol, date, total AS score FROM sent_scored", "score")
register("sent_signals", lambda t: sentiment.sentiment_signals(scored(t), SCORED).drop(*SCORED), """
SELECT symbol, date, total AS sentiment_score_total, CAST(x > 0.3 AS INTEGER) AS sentiment_bullish, CAST(x < -0.3 AS INTEGER) AS sentiment_bearish,
  CAST(x BETWEEN -0.3 AND 0.3 AS INTEGER) AS sentiment_neutral FROM (SELECT *, floor(total * 1e9 + 0.5) / 1e9 AS x FROM sent_scored)
""", "sentiment_score_total")

# -- algebra --------------------------------------------------------------------------


def interaction(df, pairs, ops=("x", "div", "plus", "minus")):
    from tidemark.functions.frames import div
    build = {"x": lambda a, b: c(a) * c(b), "div": lambda a, b: div(c(a), c(b)),
             "plus": lambda a, b: c(a) + c(b), "minus": lambda a, b: c(a) - c(b)}
    return df.withColumns({f"{a}_{o}_{b}": build[o](a, b) for a, b in pairs for o in ops})


def polynomial(df, columns, degree):
    return df.withColumns({f"{x}_pow_{d}": F.pow(c(x), F.lit(d)) for x in columns for d in range(2, degree + 1)})


PAIRS = [("close", "volume"), ("high", "low")]
INTER = [f"{a}_{o}_{b}" for a, b in PAIRS for o in ("x", "div", "plus", "minus")]
register("interaction_features", lambda t: interaction(t.bars_w, PAIRS).select("symbol", "date", *INTER),
         "SELECT symbol, date, " + ", ".join(
             f"{a} * {b} AS {a}_x_{b}, {a} / NULLIF({b}, 0) AS {a}_div_{b}, {a} + {b} AS {a}_plus_{b}, {a} - {b} AS {a}_minus_{b}" for a, b in PAIRS) + " FROM bars_w",
         " ".join(x + (":0" if "_x_" in x else "") for x in INTER))
register("polynomial_features", lambda t: polynomial(t.bars_w, ["close"], 3).select("symbol", "date", "close_pow_2", "close_pow_3"),
         "SELECT symbol, date, pow(close, 2) AS close_pow_2, pow(close, 3) AS close_pow_3 FROM bars_w", "close_pow_2:0 close_pow_3:-5")

# -- JSON -------------------------------------------------------------------------------


def signals_json(t):
    """One JSON array per symbol and year (at most 53 weekly elements)."""
    one = t.bars_w.select(
        F.concat_ws("-", "symbol", F.year("date").cast("string")).alias("run_id"),
        F.struct(
            "symbol", F.when(c("close") > c("open"), "BUY").otherwise("SELL").alias("signal_type"),
            F.format_string("%.3f", (c("volume") % 1000) / 1000).alias("confidence"),
            F.when(c("volume") % 2000 >= 1000, "STRONG").otherwise("WEAK").alias("strength"),
            c("date").cast("string").alias("date"), c("close").cast("decimal(18,6)").cast("string").alias("close"),
            c("volume").cast("string").alias("volume"),
            F.create_map(F.lit("open"), c("open")).alias("indicators"),
        ).alias("s"),
    )
    return one.groupBy("run_id").agg(F.to_json(F.collect_list("s")).alias("signals")).withColumn("timeframe", F.lit("1week"))


cte("signal_rows", """
SELECT symbol || '-' || CAST(year(date) AS VARCHAR) AS run_id, '1week' AS timeframe, symbol,
  CASE WHEN close > open THEN 'BUY' ELSE 'SELL' END AS signal_type,
  CAST((volume % 1000) / 1000.0 AS DECIMAL(5,3)) AS confidence, CASE WHEN volume % 2000 >= 1000 THEN 'STRONG' ELSE 'WEAK' END AS strength,
  date AS signal_date, CAST(CAST(close AS DECIMAL(18,6)) AS DECIMAL(12,4)) AS price, volume, open AS indicator_open FROM bars_w
""")
register("json_parse_signals", lambda t: parse.json_parse_signals(signals_json(t)).withColumn(
    "indicator_open", c("indicators")["open"]).drop("indicators"), "SELECT * FROM signal_rows")


def results_json(t):
    pnl = c("realized_pnl")
    agg = t.trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pnl > 0).alias("w"), F.count_if(pnl < 0).alias("l"),
        F.floor(F.sum(F.round(pnl * 10000).cast("bigint")) / 100).alias("cents"))
    doc = F.to_json(F.struct(
        (c("cents") / 100 + 100000).cast("decimal(15,2)").cast("string").alias("final_capital"),
        c("n").cast("string").alias("total_trades"), c("w").cast("string").alias("winning_trades"),
        c("l").cast("string").alias("losing_trades"),
        F.lit("n/a").alias("sharpe_ratio")))
    return agg.select(c("symbol").cast("string").alias("run_id"), F.lit("1day").alias("timeframe"), doc.alias("results"))


register("json_parse_results", lambda t: parse.json_parse_results(results_json(t)), """
SELECT CAST(symbol AS VARCHAR) AS run_id, '1day' AS timeframe, CAST(cents / 100.0::DOUBLE + 100000 AS DECIMAL(15,2)) AS final_capital, NULL::DECIMAL(18,6) AS total_return,
  NULL::DECIMAL(8,4) AS sharpe_ratio, NULL::DECIMAL(8,6) AS max_drawdown, CAST(n AS INTEGER) AS total_trades, CAST(w AS INTEGER) AS winning_trades,
  CAST(l AS INTEGER) AS losing_trades, NULL::DECIMAL(5,3) AS win_rate, NULL::DECIMAL(12,4) AS avg_win, NULL::DECIMAL(12,4) AS avg_loss, NULL::DECIMAL(8,4) AS profit_factor
FROM (SELECT symbol, count(*) AS n, count(*) FILTER (realized_pnl > 0) AS w, count(*) FILTER (realized_pnl < 0) AS l,
  CAST(floor(sum(CAST(round(realized_pnl * 10000) AS BIGINT)) / 100) AS BIGINT) AS cents FROM trades GROUP BY 1)
""")

# -- joins ----------------------------------------------------------------------------------
register("nearest_tick_join", lambda t: joins.nearest_tick_join(
    t.bars_h.select("symbol", c("date").alias("ts"), "close"), t.ticks, ["event_id", "bid", "ask", "volume"]), """
SELECT symbol, ts, close, tick_ts, event_id, bid, ask, volume, gap_micros FROM (
  SELECT s.symbol, s.date AS ts, s.close, k.ts AS tick_ts, k.event_id, k.bid, k.ask, k.volume, abs(epoch_us(s.date) - epoch_us(k.ts)) AS gap_micros,
    row_number() OVER (PARTITION BY s.symbol, s.date ORDER BY abs(epoch_us(s.date) - epoch_us(k.ts)), k.ts, k.event_id) AS rn
  FROM bars_h s JOIN ticks k ON k.symbol = s.symbol) WHERE rn = 1
""")
register("signal_price_join", lambda t: joins.signal_price_join(
    t.trades.select("symbol", "date", "order_id", "line", "signal_type", "price"), t.bars_d), """
SELECT t.symbol, t.date, order_id, line, signal_type, price, close AS market_price FROM trades t JOIN bars_d b ON b.symbol = t.symbol AND b.date = t.date
""")


def next_change(t):
    from tidemark.operators.prep import target_label
    return target_label(t.bars_w).select("symbol", "date", "target")


register("feature_target_join", lambda t: joins.feature_target_join(
    weekly(t, i.sma, 20).select("symbol", "date", "sma"), next_change(t).filter("target is not null")), f"""
SELECT f.symbol, f.date, f.sma, CAST(x.chg > 0.02 AS INTEGER) AS target FROM (SELECT symbol, date, {mean('close', 20)} AS sma FROM bars_w) f
JOIN (SELECT symbol, date, (lead(close) OVER (PARTITION BY symbol ORDER BY date) - close) / NULLIF(close, 0) AS chg FROM bars_w) x
  ON x.symbol = f.symbol AND x.date = f.date WHERE x.chg IS NOT NULL
""", "sma")
register("feature_block_join", lambda t: weekly(t, lambda d, s: i.volatility_block(i.rsi(d, s), s), 21)
         .select("symbol", "date", "rsi", "volatility", *[x.alias(n) for n, x in calendar.time_season(c("date")).items() if n in ("season", "day_of_year")]),
         f"""
SELECT r.symbol, r.date, rsi, v.volatility, CASE WHEN month(r.date) IN (12, 1, 2) THEN 1 WHEN month(r.date) <= 5 THEN 2 WHEN month(r.date) <= 8 THEN 3 ELSE 4 END AS season,
  CAST(dayofyear(r.date) AS INTEGER) AS day_of_year
FROM rsi_w r JOIN (SELECT symbol, date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS volatility
  FROM (SELECT *, {pct('close')} AS r FROM bars_w) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) v ON v.symbol = r.symbol AND v.date = r.date
""", "rsi volatility")
register("entity_stats_join", lambda t: joins.entity_stats_join(
    t.bars_w.select("symbol", "date", "close"),
    t.bars_w.groupBy("symbol").agg(F.avg("close").alias("close_mean"), F.max("close").alias("close_max"), F.count(F.lit(1)).alias("bars"))), """
SELECT b.symbol, date, close, close_mean, close_max, bars FROM bars_w b LEFT JOIN (
  SELECT symbol, avg(close) AS close_mean, max(close) AS close_max, count(*) AS bars FROM bars_w GROUP BY 1) s ON s.symbol = b.symbol
""", "close_mean")
cte("tf_cfg", """
SELECT * FROM (VALUES ('1day','Daily',20,50,14,0.001::DOUBLE,0.1::DOUBLE), ('1hour','1 Hour',12,24,14,0.0015::DOUBLE,0.08::DOUBLE),
 ('15min','15 Minutes',8,16,14,0.002::DOUBLE,0.06::DOUBLE), ('5min','5 Minutes',6,12,10,0.0025::DOUBLE,0.05::DOUBLE),
 ('1min','1 Minute',5,10,8,0.003::DOUBLE,0.03::DOUBLE)) v(timeframe, display_name, ma_short_period, ma_long_period, rsi_period, commission_rate, max_position_size)
""")
register("timeframe_params", lambda t: joins.timeframe_params(t.pipeline_runs.select("run_id", "timeframe")),
         "SELECT run_id, r.timeframe, display_name, ma_short_period, ma_long_period, rsi_period, commission_rate, max_position_size FROM pipeline_runs r LEFT JOIN tf_cfg c ON c.timeframe = r.timeframe")
register("timeframe_stats_join", lambda t: joins.timeframe_params(t.pipeline_runs.select("run_id", "timeframe", "status"))
         .select("run_id", "status", "timeframe", "display_name"),
         "SELECT run_id, status, r.timeframe, display_name FROM pipeline_runs r LEFT JOIN tf_cfg c ON c.timeframe = r.timeframe")
