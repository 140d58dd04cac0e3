"""Rule, signal and fusion queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.core import cte, register
from tidemark.catalog.indicators import TECH, mean, pct
from tidemark.catalog.scalars import mm, reports, signals_json
from tidemark.functions import ratios
from tidemark.functions.frames import pct_change
from tidemark.operators import joins, parse, rules
from tidemark.operators import signals as g
from tidemark.params import SIGNALS
from tidemark.plans.series import per_series

c = F.col


def r9(x: str) -> str:
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"


def b(x: str) -> str:
    return f"CASE WHEN {x} THEN 1 ELSE 0 END"


FLAGS = ["rsi_buy", "rsi_sell", "rsi_neutral", "macd_buy", "macd_sell", "macd_crossover", "bb_buy", "bb_sell", "bb_squeeze",
         "ma_buy", "ma_sell", "volume_spike", "volume_low"]
cte("tech_flagged", f"""
SELECT * EXCLUDE (g, vm), {b(f"{r9('rsi')} < 30")} AS rsi_buy, {b(f"{r9('rsi')} > 70")} AS rsi_sell, {b(f"{r9('rsi')} BETWEEN 30 AND 70")} AS rsi_neutral,
  {b('g > 0')} AS macd_buy, {b('g < 0')} AS macd_sell, {b('g > 0 AND lag(g) OVER (PARTITION BY symbol ORDER BY date) <= 0')} AS macd_crossover,
  {b(r9('close - bb_lower') + ' < 0')} AS bb_buy, {b(r9('close - bb_upper') + ' > 0')} AS bb_sell, {b(r9('bb_width') + ' < 0.1')} AS bb_squeeze,
  {b(r9('close - sma') + ' > 0')} AS ma_buy, {b(r9('close - sma') + ' < 0')} AS ma_sell,
  {b(r9('volume - 1.5 * vm') + ' > 0')} AS volume_spike, {b(r9('volume - 0.5 * vm') + ' < 0')} AS volume_low
FROM (SELECT *, {r9('macd - macd_signal')} AS g, {mean('volume', 20)} AS vm, {mean('close', 20)} AS sma FROM tech_w)
""")
cte("tech_sig", f"""
SELECT *, CASE WHEN signal_strength > 0.3 THEN 'buy' WHEN signal_strength < -0.3 THEN 'sell' ELSE 'hold' END AS signal_type FROM (
  SELECT *, coalesce((rsi_buy + macd_buy + bb_buy + ma_buy - rsi_sell - macd_sell - bb_sell - ma_sell)
    / NULLIF(rsi_buy + macd_buy + bb_buy + ma_buy + rsi_sell + macd_sell + bb_sell + ma_sell, 0)::DOUBLE, 0.0) AS signal_strength,
   (coalesce(1 - abs(rsi - 50) / 50, 0) + coalesce(abs(macd_histogram) / NULLIF(max(abs(macd_histogram)) OVER (PARTITION BY symbol), 0), 0)
     + coalesce(volume / NULLIF(max(volume) OVER (PARTITION BY symbol), 0)::DOUBLE, 0))
   / (2 + CASE WHEN rsi IS NULL THEN 0 ELSE 1 END)::DOUBLE AS confidence
  FROM tech_flagged)
""")
def tech(t, p=SIGNALS, bars=None):
    return g.technical_signals(t.bars_w if bars is None else bars, p=p, frequency="1week")


register("tech_flags", lambda t: tech(t).select("symbol", "date", *FLAGS), f"SELECT symbol, date, {', '.join(FLAGS)} FROM tech_flagged")
register("tech_signal", lambda t: tech(t).select(*g.RESULT), "SELECT symbol, date, signal_type, signal_strength, confidence FROM tech_sig", "signal_strength confidence")
register("tech_votes", lambda t: g.tech_votes(tech(t)).select("symbol", "date", "rsi_strategy", "macd_strategy", "bb_strategy", "ma_strategy"), """
SELECT symbol, date, rsi_buy - rsi_sell AS rsi_strategy, CASE WHEN macd_buy = 1 THEN 1 ELSE -1 END AS macd_strategy,
  bb_buy - bb_sell AS bb_strategy, CASE WHEN ma_buy = 1 THEN 1 ELSE -1 END AS ma_strategy FROM tech_flagged
""")
register("signal_strength_count", lambda t: g.signal_strength_count(
    tech(t).drop("signal_strength"), ["rsi_buy", "macd_crossover", "volume_spike"], ["rsi_sell", "bb_sell"]).select("symbol", "date", "signal_strength"),
    "SELECT symbol, date, CAST(rsi_buy + macd_crossover + volume_spike - rsi_sell - bb_sell AS DOUBLE) AS signal_strength FROM tech_flagged")
LOOSE = replace(SIGNALS, confidence_threshold=0.4)
register("technical_pipeline", lambda t: g.technical_pipeline(t.bars_w, p=LOOSE, frequency="1week").select(*g.RESULT, "rsi", "macd"), f"""
SELECT symbol, date, signal_type, signal_strength, confidence, rsi, macd FROM tech_sig
WHERE abs(signal_strength) >= 0.5 AND {r9('confidence')} >= 0.4
""", "signal_strength confidence rsi macd")
register("signal_threshold_filter", lambda t: g.signal_threshold_filter(tech(t)).select(*g.RESULT),
         f"SELECT symbol, date, signal_type, signal_strength, confidence FROM tech_sig WHERE abs(signal_strength) >= 0.5 AND {r9('confidence')} >= 0.7",
         "signal_strength confidence")
register("signal_smoothing", lambda t: per_series(tech(t), g.signal_smoothing, 1, 1, frequency="1week").select("symbol", "date", "signal_strength"), """
SELECT symbol, date, CASE WHEN count(signal_strength) OVER w = 3 THEN avg(signal_strength) OVER w END AS signal_strength FROM tech_sig
WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
""", "signal_strength")
register("preprocess_resource", lambda t: g.preprocess_resource(t.dirty_bars, 340), """
SELECT DISTINCT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM dirty_bars) WHERE n >= 340
""")
cte("price_rules", """
SELECT *, list_filter([CASE WHEN close IS NULL THEN 'required:close' END,
  CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'price_positive' END, CASE WHEN high < low THEN 'high_ge_low' END,
  CASE WHEN volume < 0 THEN 'volume_positive' END], lambda x: x IS NOT NULL) AS failed FROM dirty_bars
""")
register("resource_rules", lambda t: rules.resource_rules(t.dirty_bars, "stock_price").withColumn("failed_rules", F.array_join("failed_rules", ",")),
         "SELECT * EXCLUDE failed, array_to_string(failed, ',') AS failed_rules, len(failed) = 0 AS is_valid FROM price_rules")
cte("rule_rows", """
SELECT rule, severity, failures, failures = 0 AS is_valid FROM (
  SELECT 'price_positive' AS rule, 'error' AS severity, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS failures FROM dirty_bars
  UNION ALL SELECT 'high_ge_low', 'error', count(*) FILTER (high < low) FROM dirty_bars
  UNION ALL SELECT 'volume_positive', 'warning', count(*) FILTER (volume < 0) FROM dirty_bars)
""")
register("rule_report", lambda t: rules.rule_report(t.dirty_bars, "stock_price"), "SELECT * FROM rule_rows")
register("rule_summary", lambda t: rules.rule_summary(rules.rule_report(t.dirty_bars, "stock_price")), """
SELECT severity, count(*) AS rules, count(*) FILTER (is_valid) AS passed, count(*) FILTER (NOT is_valid) AS failed, CAST(sum(failures) AS BIGINT) AS failures FROM rule_rows GROUP BY 1
""")
register("resource_quality", lambda t: rules.resource_quality(t.dirty_bars, "stock_price"), """
SELECT *, (CASE WHEN completeness < 0.9 THEN completeness ELSE 1.0 END) * (CASE WHEN duplicates > 0 THEN 0.9 ELSE 1.0 END) * (1 - invalid_records / total_records::DOUBLE) AS quality_score
FROM (SELECT count(*) AS total_records, count(*) FILTER (close IS NULL) AS missing_values, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_bars)) AS duplicates,
  count(*) FILTER (len(failed) > 0) AS invalid_records, 1 - count(*) FILTER (close IS NULL) / (count(*) * 8.0::DOUBLE) AS completeness FROM price_rules)
""", "completeness quality_score")

# -- fundamental ----------------------------------------------------------------------
FUND_COLS = ["earnings", "book_value", "revenue", "net_income", "total_equity", "total_assets", "revenue_growth", "earnings_growth"]


def fund_input(t):
    grown = reports(t).withColumns({"revenue_growth": pct_change(c("revenue"), 4), "earnings_growth": pct_change(c("earnings"), 4)})
    joined = joins.asof_fundamentals(t.bars_landed.select("symbol", "date", "close"), grown, FUND_COLS)
    return ratios.fund_indicators(joined, ["pe_ratio", "pb_ratio", "ps_ratio", "roe", "roa"]).select(
        "symbol", "date", "close", "pe_ratio", "pb_ratio", "ps_ratio", "roe", "roa", "revenue_growth", "earnings_growth")


cte("fund_in", f"""
SELECT b.symbol, b.date, close, close / NULLIF(earnings, 0) AS pe_ratio, close / NULLIF(book_value, 0) AS pb_ratio, close / NULLIF(revenue, 0) AS ps_ratio,
  net_income / NULLIF(total_equity, 0) AS roe, net_income / NULLIF(total_assets, 0) AS roa, revenue_growth, earnings_growth
FROM bars_w b ASOF LEFT JOIN (SELECT *, {pct('revenue', 4)} AS revenue_growth, {pct('earnings', 4)} AS earnings_growth FROM reports) r
  ON b.symbol = r.symbol AND b.date >= r.date
""")


def rank_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0::DOUBLE)"
            f" / count({x}) OVER (PARTITION BY symbol)::DOUBLE END AS {x}_rank")


VAL = ["pe_ratio", "pb_ratio", "ps_ratio"]
cte("fund_ranked", f"SELECT *, {', '.join(rank_sql(x) for x in VAL)} FROM fund_in")
cte("fund_flagged", "SELECT *, " + ", ".join(
    f"{b(r9(x + '_rank') + ' < 0.3')} AS {x}_undervalued, {b(r9(x + '_rank') + ' > 0.7')} AS {x}_overvalued, {b(r9(x + '_rank') + ' BETWEEN 0.3 AND 0.7')} AS {x}_fair_value"
    for x in VAL) + " FROM fund_ranked")
register("valuation_rank", lambda t: g.valuation_rank(fund_input(t), VAL).select(
    "symbol", "date", *[f"{x}_{k}" for x in VAL for k in ("rank", "undervalued", "overvalued", "fair_value")]),
    "SELECT symbol, date, " + ", ".join(f"{x}_{k}" for x in VAL for k in ("rank", "undervalued", "overvalued", "fair_value")) + " FROM fund_flagged",
    " ".join(f"{x}_rank" for x in VAL))


def minmax_query(t):
    from tidemark.functions.frames import minmax
    return t.bars_w.select("symbol", "date", minmax(c("close")).alias("close_scaled"), minmax(c("volume")).alias("volume_scaled"))


register("minmax", minmax_query, f"SELECT symbol, date, {mm('close')} AS close_scaled, {mm('volume')} AS volume_scaled FROM bars_w", "close_scaled volume_scaled")


def fund_score_query(t):
    df = fund_input(t)
    return df.select("symbol", "date", g.fund_score(df, ["roe", "roa"], ["pe_ratio", "pb_ratio"], {"roe": 2.0, "pe_ratio": 0.5}).alias("score"))


register("fund_score", fund_score_query,
         f"SELECT symbol, date, 2 * {mm('roe')} + {mm('roa')} + 0.5 * (1 - {mm('pe_ratio')}) + (1 - {mm('pb_ratio')}) AS score FROM fund_in", "score")
cte("fund_scored", "SELECT *, " + " + ".join([mm(x + "_undervalued") for x in VAL] + [f"(1 - {mm(x + '_overvalued')})" for x in VAL])
    + f" AS valuation_score, {mm('revenue_growth')} + {mm('earnings_growth')} AS growth_score, {mm('roe')} + {mm('roa')} AS profitability_score FROM fund_flagged")
cte("fund_sig", f"""
SELECT *, CASE WHEN {r9('signal_strength')} > 0.3 THEN 'buy' WHEN {r9('signal_strength')} < -0.3 THEN 'sell' ELSE 'hold' END AS signal_type FROM (
  SELECT *, {mm('fundamental_score')} * 2 - 1 AS signal_strength,
    list_avg(list_filter([abs(valuation_score - 0.5) * 2, abs(growth_score), profitability_score], lambda x: x IS NOT NULL)) AS confidence
  FROM (SELECT *, coalesce({mm('valuation_score')} * 0.3, 0) + coalesce({mm('growth_score')} * 0.4, 0) + coalesce({mm('profitability_score')} * 0.3, 0) AS fundamental_score,
    {b(r9('growth_score') + ' > 0.1')} AS growth_buy, {b(r9('growth_score') + ' < -0.1')} AS growth_sell,
    {b(r9('profitability_score') + ' > 0.15')} AS profitability_buy, {b(r9('profitability_score') + ' < 0.05')} AS profitability_sell FROM fund_scored))
""")
FS = "valuation_score growth_score profitability_score fundamental_score signal_strength confidence"
FI = ["growth_buy", "growth_sell", "profitability_buy", "profitability_sell"]


def fund(t):
    return g.fund_signal(fund_input(t))


register("fund_signal", lambda t: fund(t).select("symbol", "date", *FS.split(), *FI, "signal_type"),
         f"SELECT symbol, date, {', '.join(FS.split() + FI)}, signal_type FROM fund_sig", FS)


def vote(x: str, hi: float, lo: float) -> str:
    return f"CASE WHEN {r9(x)} > {hi} THEN 1 WHEN {r9(x)} < {lo} THEN -1 ELSE 0 END"


register("fund_votes", lambda t: g.fund_votes(fund(t)).select("symbol", "date", "valuation_strategy", "growth_strategy", "profitability_strategy", "fundamental_strategy"), f"""
SELECT symbol, date, {vote('valuation_score', 0.7, 0.3)} AS valuation_strategy, {vote('growth_score', 0.1, -0.1)} AS growth_strategy,
  {vote('profitability_score', 0.15, 0.05)} AS profitability_strategy, {vote('fundamental_score', 0.6, 0.4)} AS fundamental_strategy FROM fund_sig
""")

# -- fusion ----------------------------------------------------------------------------
cte("aligned", """
SELECT symbol, date, signal_type, signal_strength, confidence, 'technical_analysis' AS strategy, 0.6::DOUBLE AS w FROM tech_sig
UNION ALL SELECT symbol, date, signal_type, signal_strength, confidence, 'fundamental_analysis', 0.4::DOUBLE FROM fund_sig
""")


def results(t):
    return {"technical_analysis": tech(t, bars=t.bars_landed), "fundamental_analysis": fund(t)}


register("strategy_align", lambda t: g.strategy_align(results(t)), "SELECT * EXCLUDE w FROM aligned", "signal_strength confidence")
TYPE = f"CASE WHEN {r9('signal_strength')} > 0.3 THEN 'buy' WHEN {r9('signal_strength')} < -0.3 THEN 'sell' ELSE 'hold' END AS signal_type"
cte("comb_w", f"""
SELECT *, {TYPE} FROM (SELECT symbol, date, sum(signal_strength * w) / sum(w) AS signal_strength, sum(confidence * w) / sum(w) AS confidence,
  count(*) AS strategy_count, list(signal_type) AS types FROM aligned GROUP BY 1, 2)
""")
for method in ("mean", "median", "max", "min"):
    sql = f"""
SELECT *, {TYPE} FROM (SELECT symbol, date, {'avg' if method == 'mean' else method}(signal_strength) AS signal_strength,
  sum(confidence * abs(signal_strength)) / NULLIF(sum(abs(signal_strength)) FILTER (confidence IS NOT NULL), 0) AS confidence, count(*) AS strategy_count FROM aligned GROUP BY 1, 2)
"""
    register("combine_ensemble" + ("" if method == "mean" else f"_{method}"),
             lambda t, method=method: g.combine(g.strategy_align(results(t)), "ensemble", method).drop("_types"), sql, "signal_strength confidence")
register("combine_weighted", lambda t: g.combine(g.strategy_align(results(t))).drop("_types"), "SELECT * EXCLUDE types FROM comb_w", "signal_strength confidence")
register("combine_voting", lambda t: g.combine(g.strategy_align(results(t)), "voting").drop("_types"), """
SELECT symbol, date, (bv - sv) / n::DOUBLE AS signal_strength, greatest(bv, sv, hv) / n::DOUBLE AS confidence, n AS strategy_count,
  CASE WHEN bv >= 0.7 * n THEN 'buy' WHEN sv >= 0.7 * n THEN 'sell' ELSE 'hold' END AS signal_type
FROM (SELECT symbol, date, count(*) AS n, count(*) FILTER (signal_type = 'buy') AS bv, count(*) FILTER (signal_type = 'sell') AS sv,
  count(*) FILTER (signal_type = 'hold') AS hv FROM aligned GROUP BY 1, 2)
""", "signal_strength confidence")
cte("composite", """
SELECT symbol, date, signal_strength, confidence, strategy_count, signal_type, agree / strategy_count::DOUBLE AS consensus_score,
  abs(signal_strength) * confidence AS signal_quality
FROM (SELECT *, len(list_filter(types, lambda x: x = signal_type)) AS agree FROM comb_w) WHERE agree / strategy_count::DOUBLE >= 0.7 AND agree >= 1
""")
COMP = "signal_strength confidence consensus_score signal_quality"
register("consensus_filter", lambda t: g.consensus_filter(g.combine(g.strategy_align(results(t)))),
         "SELECT * EXCLUDE signal_quality FROM composite", "signal_strength confidence consensus_score")
register("composite_signal", lambda t: g.composite_signal(results(t)), "SELECT * FROM composite", COMP)
register("signal_quality", lambda t: g.signal_quality(tech(t)).select("symbol", "date", "signal_quality"),
         "SELECT symbol, date, abs(signal_strength) * confidence AS signal_quality FROM tech_sig", "signal_quality")
CNT = """count(*) AS total_signals, count(*) FILTER (lower(signal_type) = 'buy') AS buy_signals, count(*) FILTER (lower(signal_type) = 'sell') AS sell_signals,
  count(*) FILTER (lower(signal_type) = 'hold') AS hold_signals"""
register("signal_summary", lambda t: g.signal_summary(fund(t)), f"""
SELECT {CNT}, avg(signal_strength) AS average_strength, avg(confidence) AS average_confidence, avg(valuation_score) AS valuation_score_avg,
  avg(growth_score) AS growth_score_avg, avg(profitability_score) AS profitability_score_avg FROM fund_sig
""", "average_strength average_confidence valuation_score_avg growth_score_avg profitability_score_avg")
register("signal_distribution", lambda t: tech(t).groupBy("signal_type").count(), "SELECT signal_type, count(*) AS count FROM tech_sig GROUP BY 1")
register("signal_quality_metrics", lambda t: g.signal_quality_metrics(g.composite_signal(results(t))), f"""
SELECT {CNT}, avg(signal_strength) AS signal_strength_avg, avg(confidence) AS confidence_avg, avg(signal_quality) AS quality_score_avg,
  avg(strategy_count) AS avg_strategy_agreement FROM composite
""", "signal_strength_avg confidence_avg quality_score_avg avg_strategy_agreement")


def stored(t):
    return parse.json_parse_signals(signals_json(t))


register("signal_stats_api", lambda t: g.signal_stats_api(stored(t), ["run_id"]), f"""
SELECT run_id, {CNT}, avg(confidence::DOUBLE) * 100 AS avg_confidence, count(*) FILTER (strength = 'STRONG') AS strong_signals FROM signal_rows GROUP BY 1
""", "avg_confidence")
register("export_signals", lambda t: g.export_signals(stored(t)), """
SELECT symbol AS "Symbol", signal_type AS "Signal Type", printf('%.3f', confidence::DOUBLE) AS "Confidence", strength AS "Strength", signal_date AS "Date", timeframe AS "Timeframe" FROM signal_rows
""")
register("signals_latest", lambda t: g.signals_latest(stored(t)).drop("indicators"),
         "SELECT * EXCLUDE indicator_open FROM signal_rows ORDER BY signal_date DESC, symbol LIMIT 50")
