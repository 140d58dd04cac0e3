"""Filters, breadth, moving-average, oscillator and thrust queries."""

from __future__ import annotations

from dataclasses import replace

from tidemark.catalog.core import cte, register
from tidemark.operators import breadth as b
from tidemark.params import BREADTH
from tidemark.plans.series import per_series

#: The share of advancers peaks below the default threshold on these tables.
THRUST = replace(BREADTH, zbt_threshold=0.54)
THRUST_SHORT = replace(BREADTH, zbt_threshold=0.54, zbt_lookback_rows=26)


def weekly(t, op, lookback=64):
    return per_series(t.bars_w, op, lookback, frequency="1week")


cte("ad_bars", "SELECT * FROM bars_w WHERE volume >= 1000 AND close >= 1.0")
cte("pos_bars", "SELECT * FROM bars_w WHERE close > 0 AND volume > 0")
for name, src in (("ad_status", "ad_bars"), ("pos_status", "pos_bars"), ("all_status", "bars_w")):
    cte(name, f"""
SELECT *, CASE WHEN price_change_pct > 0.001 THEN 'advancing' WHEN price_change_pct < -0.001 THEN 'declining'
               ELSE 'unchanged' END AS issue_status
FROM (SELECT *, (close - lag(close) OVER (PARTITION BY symbol ORDER BY date))
                / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS price_change_pct FROM {src})
""")

register("scan_filter",
         lambda t: b.scan_filter(t.bars_w, ["N01", "N07", "N19"], "1997-01-06", "1999-12-27"),
         "SELECT * FROM bars_w WHERE symbol IN ('N01','N07','N19') AND date BETWEEN DATE '1997-01-06' AND DATE '1999-12-27'")
register("quality_filter_ad", lambda t: b.quality_filter_ad(t.bars_w), "SELECT * FROM ad_bars")
register("quality_filter_pos", lambda t: b.quality_filter_pos(t.dirty_bars),
         "SELECT * FROM dirty_bars WHERE close > 0 AND volume > 0")
register("price_change", lambda t: weekly(t, b.price_change, 1),
         "SELECT * EXCLUDE issue_status FROM all_status", "price_change_pct")
register("issue_status", lambda t: weekly(t, b.issue_status, 1), "SELECT * FROM all_status", "price_change_pct")

cte("ad_day", """
SELECT *, coalesce(advancing_stocks / NULLIF(declining_stocks, 0)::DOUBLE, 0.0) AS ad_issues_ratio,
  coalesce(advancing_volume / NULLIF(declining_volume, 0)::DOUBLE, 0.0) AS ad_volume_ratio,
  (advancing_stocks - declining_stocks) / NULLIF(advancing_stocks + declining_stocks, 0)::DOUBLE AS ad_strength,
  advancing_stocks / NULLIF(advancing_stocks + declining_stocks + unchanged_stocks, 0)::DOUBLE AS ad_breadth
FROM (SELECT date, count(*) FILTER (issue_status = 'advancing') AS advancing_stocks,
  count(*) FILTER (issue_status = 'declining') AS declining_stocks,
  count(*) FILTER (issue_status = 'unchanged') AS unchanged_stocks,
  CAST(sum(volume) AS BIGINT) AS total_volume,
  CAST(coalesce(sum(volume) FILTER (issue_status = 'advancing'), 0) AS BIGINT) AS advancing_volume,
  CAST(coalesce(sum(volume) FILTER (issue_status = 'declining'), 0) AS BIGINT) AS declining_volume
  FROM ad_status GROUP BY date)
""")
cte("ad_lined", """
SELECT *, advancing_stocks - declining_stocks AS ad_difference,
  CAST(sum(advancing_stocks - declining_stocks) OVER (ORDER BY date) AS BIGINT) AS ad_line FROM ad_day
""")
cte("ad_feat", "SELECT *, (ad_line - lag(ad_line, 20) OVER (ORDER BY date)) / 20.0::DOUBLE AS ad_momentum FROM ad_lined")
AD = "ad_issues_ratio ad_volume_ratio ad_strength ad_breadth"
register("ad_daily", lambda t: b.ad_daily(b.quality_filter_ad(t.bars_w)), "SELECT * FROM ad_day", AD)
register("ad_line", lambda t: b.ad_line(b.ad_daily(b.quality_filter_ad(t.bars_w))), "SELECT * FROM ad_lined", AD)
register("ad_momentum", lambda t: b.ad_features(t.bars_w).select("date", "ad_line", "ad_momentum"),
         "SELECT date, ad_line, ad_momentum FROM ad_feat", "ad_momentum")
register("ad_features", lambda t: b.ad_features(t.bars_w), "SELECT * FROM ad_feat", AD + " ad_momentum")
register("ad_summary", lambda t: b.ad_summary(b.ad_features(t.bars_w)), """
SELECT CAST(sum(advancing_stocks) AS BIGINT) AS total_advancing, CAST(sum(declining_stocks) AS BIGINT) AS total_declining,
  CAST(sum(total_volume) AS BIGINT) AS total_volume, CAST(sum(advancing_volume) AS BIGINT) AS total_advancing_volume,
  CAST(sum(declining_volume) AS BIGINT) AS total_declining_volume, avg(ad_issues_ratio) AS avg_ad_issues_ratio,
  avg(ad_volume_ratio) AS avg_ad_volume_ratio, avg(ad_strength) AS avg_ad_strength, avg(ad_breadth) AS avg_ad_breadth,
  stddev_samp(ad_momentum) AS ad_momentum_volatility FROM ad_feat
""", "avg_ad_issues_ratio avg_ad_volume_ratio avg_ad_strength avg_ad_breadth ad_momentum_volatility")
register("ad_signals", lambda t: b.ad_signals(b.ad_features(t.bars_w)), """
SELECT *, ad_issues_ratio > 2.0 AND ad_volume_ratio > 1.5 AND ad_momentum > 0 AS ad_bullish_signal,
  ad_issues_ratio < 0.5 AND ad_volume_ratio < 0.67 AND ad_momentum < 0 AS ad_bearish_signal,
  ad_issues_ratio > 3.0 AND ad_volume_ratio > 2.0 AND ad_momentum > 5 AS ad_thrust_signal,
  ad_issues_ratio > 1.5 AND ad_volume_ratio < 0.8 AS ad_divergence_signal FROM ad_feat
""", AD + " ad_momentum")
register("ad_rolling", lambda t: b.ad_rolling(b.ad_features(t.bars_w)), """
SELECT *, avg(ad_issues_ratio) OVER w AS rolling_ad_issues_ratio, avg(ad_volume_ratio) OVER w AS rolling_ad_volume_ratio,
  avg(ad_strength) OVER w AS rolling_ad_strength, avg(ad_momentum) OVER w AS rolling_ad_momentum
FROM ad_feat WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
""", AD + " ad_momentum rolling_ad_issues_ratio rolling_ad_volume_ratio rolling_ad_strength rolling_ad_momentum")

# -- moving averages -------------------------------------------------------------
cte("ma_pairs", """
SELECT *, (close - ma_short) / NULLIF(ma_short, 0) AS price_vs_ma_short, (close - ma_long) / NULLIF(ma_long, 0) AS price_vs_ma_long
FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS ma_short,
                avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS ma_long FROM pos_bars)
""")
cte("ma_crossed", """
SELECT * EXCLUDE (gap, was), gap > 0 AND was <= 0 AS golden_cross, gap < 0 AND was >= 0 AS death_cross,
  CASE WHEN gap > 0 AND was <= 0 THEN 'golden_cross' WHEN gap < 0 AND was >= 0 THEN 'death_cross' ELSE 'none' END AS ma_cross_signal
FROM (SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY date) AS was,
        lag(ma_short) OVER (PARTITION BY symbol ORDER BY date) AS ma_short_lag,
        lag(ma_long) OVER (PARTITION BY symbol ORDER BY date) AS ma_long_lag
      FROM (SELECT *, floor((ma_short - ma_long) * 1e9 + 0.5) / 1e9 AS gap FROM ma_pairs))
""")
cte("ma_feat", """
SELECT *, (ma_short_slope + ma_long_slope) / 2 AS ma_momentum FROM (
  SELECT *, (ma_short - lag(ma_short, 5) OVER w) / 5 AS ma_short_slope, (ma_long - lag(ma_long, 10) OVER w) / 10 AS ma_long_slope,
    abs(ma_short - ma_long) / NULLIF(ma_long, 0) AS ma_trend_strength FROM ma_crossed WINDOW w AS (PARTITION BY symbol ORDER BY date))
""")
MA2 = "ma_short ma_long price_vs_ma_short price_vs_ma_long"
MA = MA2 + " ma_short_lag ma_long_lag ma_short_slope ma_long_slope ma_momentum ma_trend_strength"
register("ma_pair", lambda t: b.ma_pair(b.quality_filter_pos(t.bars_w)), "SELECT * FROM ma_pairs", MA2)
register("ma_crossover", lambda t: b.ma_crossover(b.ma_pair(b.quality_filter_pos(t.bars_w))),
         "SELECT * FROM ma_crossed", MA2 + " ma_short_lag ma_long_lag")
register("ma_momentum", lambda t: b.ma_features(t.bars_w).select(
    "symbol", "date", "ma_short_slope", "ma_long_slope", "ma_momentum", "ma_trend_strength"),
    "SELECT symbol, date, ma_short_slope, ma_long_slope, ma_momentum, ma_trend_strength FROM ma_feat",
    "ma_short_slope ma_long_slope ma_momentum ma_trend_strength")
register("ma_features", lambda t: b.ma_features(t.bars_w), "SELECT * FROM ma_feat", MA)
register("ma_summary", lambda t: b.ma_summary(b.ma_features(t.bars_w)), """
SELECT count(symbol) AS total_records, count(DISTINCT symbol) AS unique_symbols, avg(price_vs_ma_short) AS avg_price_vs_ma_short,
  avg(price_vs_ma_long) AS avg_price_vs_ma_long, avg(ma_momentum) AS avg_ma_momentum, avg(ma_trend_strength) AS avg_ma_trend_strength,
  count(*) FILTER (golden_cross) AS total_golden_crosses, count(*) FILTER (death_cross) AS total_death_crosses,
  stddev_samp(ma_momentum) AS ma_momentum_volatility FROM ma_feat
""", "avg_price_vs_ma_short avg_price_vs_ma_long avg_ma_momentum avg_ma_trend_strength ma_momentum_volatility")
register("ma_symbol_summary", lambda t: b.ma_symbol_summary(b.ma_features(t.bars_w)), """
SELECT symbol, avg(ma_short) AS avg_ma_short, avg(ma_long) AS avg_ma_long, avg(ma_momentum) AS avg_ma_momentum,
  avg(ma_trend_strength) AS avg_ma_trend_strength, count(*) FILTER (golden_cross) AS golden_crosses,
  count(*) FILTER (death_cross) AS death_crosses, max(close) AS max_price, min(close) AS min_price,
  stddev_samp(ma_momentum) AS momentum_volatility FROM ma_feat GROUP BY symbol
""", "avg_ma_short avg_ma_long avg_ma_momentum avg_ma_trend_strength momentum_volatility")
register("ma_signals", lambda t: b.ma_signals(b.ma_features(t.bars_w)), """
SELECT *, golden_cross AND ma_momentum > 0 AND price_vs_ma_short > 0.02 AS ma_bullish_signal,
  death_cross AND ma_momentum < 0 AND price_vs_ma_short < -0.02 AS ma_bearish_signal,
  floor((ma_short - ma_long) * 1e9 + 0.5) / 1e9 > 0 AND ma_momentum > 0.01 AND ma_trend_strength > 0.05 AS ma_trend_following_signal,
  ma_cross_signal <> 'none' AND abs(ma_momentum) > 0.02 AS ma_reversal_signal FROM ma_feat
""", MA)
register("ma_rolling", lambda t: b.ma_rolling(b.ma_features(t.bars_w)), """
SELECT *, avg(ma_momentum) OVER w AS rolling_ma_momentum, avg(ma_trend_strength) OVER w AS rolling_ma_trend_strength,
  avg(price_vs_ma_short) OVER w AS rolling_price_vs_ma_short, avg(price_vs_ma_long) OVER w AS rolling_price_vs_ma_long
FROM ma_feat WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING)
""", MA + " rolling_ma_momentum rolling_ma_trend_strength rolling_price_vs_ma_short rolling_price_vs_ma_long")

# -- oscillator --------------------------------------------------------------------
cte("mcc_day", """
SELECT *, advancing_issues - declining_issues AS net_advances FROM (
  SELECT date, count(*) FILTER (issue_status = 'advancing') AS advancing_issues,
    count(*) FILTER (issue_status = 'declining') AS declining_issues,
    count(*) FILTER (issue_status = 'unchanged') AS unchanged_issues FROM pos_status GROUP BY date)
""")
cte("mcc_osc", """
SELECT *, ema_short - ema_long AS mcclellan_oscillator,
  coalesce(advancing_issues / NULLIF(declining_issues, 0)::DOUBLE, 0.0) AS mcclellan_ratio
FROM (SELECT *, avg(net_advances) OVER (ORDER BY date ROWS 19 PRECEDING) AS ema_short,
             avg(net_advances) OVER (ORDER BY date ROWS 39 PRECEDING) AS ema_long FROM mcc_day)
""")
cte("mcc_summed", """
SELECT *, sum(mcclellan_oscillator) OVER (ORDER BY date) AS mcclellan_summation_index,
  mcclellan_oscillator - lag(mcclellan_oscillator, 5) OVER (ORDER BY date) AS oscillator_momentum FROM mcc_osc
""")
cte("mcc_full", """
SELECT * EXCLUDE (o, own), o > 100 AS overbought_signal, o < -100 AS oversold_signal,
  o > 0 AND o > own AS bullish_divergence, o < 0 AND o < own AS bearish_divergence
FROM (SELECT *, floor(mcclellan_oscillator * 1e9 + 0.5) / 1e9 AS o,
   floor(avg(mcclellan_oscillator) OVER (ORDER BY date ROWS 10 PRECEDING) * 1e9 + 0.5) / 1e9 AS own FROM mcc_summed)
""")
OSC = "ema_short ema_long mcclellan_oscillator mcclellan_ratio"
MCC = OSC + " mcclellan_summation_index oscillator_momentum"
register("mcc_issues", lambda t: b.mcc_issues(b.quality_filter_pos(t.bars_w)), "SELECT * FROM mcc_day")
register("mcc_oscillator", lambda t: b.mcc_oscillator(b.mcc_issues(b.quality_filter_pos(t.bars_w))), "SELECT * FROM mcc_osc", OSC)
register("mcc_oscillator_ema", lambda t: b.mcc_oscillator(b.mcc_issues(b.quality_filter_pos(t.bars_w)), true_ema=True), """
SELECT m.*, e.ema_short, e.ema_long, e.ema_short - e.ema_long AS mcclellan_oscillator,
  coalesce(advancing_issues / NULLIF(declining_issues, 0)::DOUBLE, 0.0) AS mcclellan_ratio
FROM mcc_day m JOIN (
  SELECT a.date, sum(o.net_advances * pow(1 - 2.0 / 20, a.n - o.n)) / sum(pow(1 - 2.0 / 20, a.n - o.n)) AS ema_short,
         sum(o.net_advances * pow(1 - 2.0 / 40, a.n - o.n)) / sum(pow(1 - 2.0 / 40, a.n - o.n)) AS ema_long
  FROM mcc_numbered a JOIN mcc_numbered o ON o.n <= a.n GROUP BY a.date) e ON e.date = m.date
""", OSC)
cte("mcc_numbered", "SELECT date, net_advances, row_number() OVER (ORDER BY date) AS n FROM mcc_day")
register("mcc_summation", lambda t: b.mcclellan(t.bars_w).select("date", "mcclellan_summation_index", "oscillator_momentum"),
         "SELECT date, mcclellan_summation_index, oscillator_momentum FROM mcc_summed",
         "mcclellan_summation_index oscillator_momentum")
register("mcc_flags", lambda t: b.mcclellan(t.bars_w), "SELECT * FROM mcc_full", MCC)
register("mcc_summary", lambda t: b.mcc_summary(b.mcclellan(t.bars_w)), """
SELECT avg(mcclellan_oscillator) AS avg_oscillator, min(mcclellan_oscillator) AS min_oscillator, max(mcclellan_oscillator) AS max_oscillator,
  stddev_samp(mcclellan_oscillator) AS oscillator_volatility, avg(mcclellan_ratio) AS avg_ratio, avg(oscillator_momentum) AS avg_momentum,
  count(*) FILTER (overbought_signal) AS overbought_days, count(*) FILTER (oversold_signal) AS oversold_days,
  count(*) FILTER (bullish_divergence) AS bullish_divergences, count(*) FILTER (bearish_divergence) AS bearish_divergences FROM mcc_full
""", "avg_oscillator min_oscillator max_oscillator oscillator_volatility avg_ratio avg_momentum")
register("mcc_signals", lambda t: b.mcc_signals(b.mcclellan(t.bars_w)), """
SELECT * EXCLUDE (o, m), o > 0 AND m > 0 AND mcclellan_ratio > 1.2 AS mcclellan_bullish_signal,
  o < 0 AND m < 0 AND mcclellan_ratio < 0.8 AS mcclellan_bearish_signal, oversold_signal AND m > 0 AS mcclellan_buy_signal,
  overbought_signal AND m < 0 AS mcclellan_sell_signal, o > 50 AND m > 10 AND mcclellan_ratio > 2.0 AS mcclellan_thrust_signal
FROM (SELECT *, floor(mcclellan_oscillator * 1e9 + 0.5) / 1e9 AS o, floor(oscillator_momentum * 1e9 + 0.5) / 1e9 AS m FROM mcc_full)
""", MCC)
register("mcc_rolling", lambda t: b.mcc_rolling(b.mcclellan(t.bars_w)), """
SELECT *, avg(mcclellan_oscillator) OVER w AS rolling_oscillator, avg(oscillator_momentum) OVER w AS rolling_momentum,
  avg(mcclellan_ratio) OVER w AS rolling_ratio,
  avg(mcclellan_oscillator) OVER w - avg(mcclellan_oscillator) OVER (ORDER BY date ROWS BETWEEN 40 PRECEDING AND 20 PRECEDING) AS oscillator_trend
FROM mcc_full WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)
""", MCC + " rolling_oscillator rolling_momentum rolling_ratio oscillator_trend")

# -- thrust ---------------------------------------------------------------------------
cte("zbt_pcts", """
SELECT *, coalesce(zbt_advancing_sum / NULLIF(zbt_total_sum, 0)::DOUBLE, 0.0) AS zbt_10day_percentage FROM (
  SELECT *, CAST(sum(advancing_issues) OVER w AS BIGINT) AS zbt_advancing_sum, CAST(sum(total_issues) OVER w AS BIGINT) AS zbt_total_sum
  FROM (SELECT *, coalesce(advancing_issues / NULLIF(total_issues, 0)::DOUBLE, 0.0) AS advancing_percentage
        FROM (SELECT * EXCLUDE net_advances, advancing_issues + declining_issues + unchanged_issues AS total_issues FROM mcc_day))
  WINDOW w AS (ORDER BY date ROWS 9 PRECEDING))
""")
for name, rows in (("zbt", 180), ("zbt_short", 26)):
    cte(f"{name}_sig", f"""
SELECT *, above_threshold AND recent_above_threshold = 0 AS zbt_signal FROM (
  SELECT *, CAST(sum(CASE WHEN above_threshold THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING) AS BIGINT) AS recent_above_threshold
  FROM (SELECT *, zbt_10day_percentage >= 0.54::DOUBLE AS above_threshold FROM zbt_pcts))
""")
    cte(f"{name}_feat", f"""
SELECT *, CASE WHEN zbt_signal THEN zbt_strength * 0.4::DOUBLE + zbt_momentum * 0.3::DOUBLE + zbt_rarity_score * 0.3::DOUBLE ELSE 0.0 END AS zbt_confidence
FROM (SELECT *, CASE WHEN floor(std_60d_percentage * 1e9 + 0.5) / 1e9 > 0
                     THEN (zbt_10day_percentage - avg_60d_percentage) / std_60d_percentage ELSE 0.0 END AS zbt_rarity_score
  FROM (SELECT *, CASE WHEN zbt_signal THEN zbt_10day_percentage - 0.54::DOUBLE ELSE 0.0::DOUBLE END AS zbt_strength,
      zbt_10day_percentage - lag(zbt_10day_percentage, 5) OVER (ORDER BY date) AS zbt_momentum,
      avg(zbt_10day_percentage) OVER w AS avg_60d_percentage, stddev_samp(zbt_10day_percentage) OVER w AS std_60d_percentage
    FROM {name}_sig WINDOW w AS (ORDER BY date ROWS 60 PRECEDING)))
""")
PCT = "advancing_percentage zbt_10day_percentage"
ZBT = PCT + " zbt_strength zbt_momentum avg_60d_percentage std_60d_percentage zbt_rarity_score zbt_confidence"
register("zbt_pct", lambda t: b.zbt_pct(b.zbt_issues(b.quality_filter_pos(t.bars_w))), "SELECT * FROM zbt_pcts", PCT)
register("zbt_signal", lambda t: b.zbt_signal(b.zbt_pct(b.zbt_issues(b.quality_filter_pos(t.bars_w))), THRUST), "SELECT * FROM zbt_sig", PCT)
register("zbt_metrics", lambda t: b.zbt_features(t.bars_w, p=THRUST_SHORT), "SELECT * FROM zbt_short_feat", ZBT)
register("zbt_features", lambda t: b.zbt_features(t.bars_w, p=THRUST), "SELECT * FROM zbt_feat", ZBT)
register("zbt_summary", lambda t: b.zbt_summary(b.zbt_features(t.bars_w, p=THRUST_SHORT)), """
SELECT avg(zbt_10day_percentage) AS avg_zbt_percentage, min(zbt_10day_percentage) AS min_zbt_percentage, max(zbt_10day_percentage) AS max_zbt_percentage,
  stddev_samp(zbt_10day_percentage) AS zbt_percentage_volatility, avg(zbt_strength) AS avg_zbt_strength, avg(zbt_momentum) AS avg_zbt_momentum,
  avg(zbt_rarity_score) AS avg_zbt_rarity, avg(zbt_confidence) AS avg_zbt_confidence, count(*) FILTER (zbt_signal) AS total_zbt_signals,
  count(*) FILTER (above_threshold) AS days_above_threshold FROM zbt_short_feat
""", "avg_zbt_percentage min_zbt_percentage max_zbt_percentage zbt_percentage_volatility avg_zbt_strength avg_zbt_momentum avg_zbt_rarity avg_zbt_confidence")
register("zbt_history", lambda t: b.zbt_history(b.zbt_features(t.bars_w, p=THRUST_SHORT)), """
SELECT count(*) FILTER (zbt_signal) AS total_signals, avg(zbt_10day_percentage) FILTER (zbt_signal) AS avg_signal_percentage,
  avg(zbt_strength) FILTER (zbt_signal) AS avg_signal_strength, avg(zbt_confidence) FILTER (zbt_signal) AS avg_signal_confidence,
  avg(zbt_rarity_score) FILTER (zbt_signal) AS avg_signal_rarity, min(date) FILTER (zbt_signal) AS first_signal_date,
  max(date) FILTER (zbt_signal) AS last_signal_date, count(*)::DOUBLE / NULLIF(count(*) FILTER (zbt_signal), 0)::DOUBLE AS days_per_signal FROM zbt_short_feat
""", "avg_signal_percentage avg_signal_strength avg_signal_confidence avg_signal_rarity days_per_signal")
register("zbt_signals", lambda t: b.zbt_signals(b.zbt_features(t.bars_w, p=THRUST_SHORT)), """
SELECT *, zbt_signal AND zbt_confidence > 0.7 AND zbt_strength > 0.05 AS zbt_bullish_signal,
  zbt_signal AND zbt_confidence > 0.8 AND zbt_strength > 0.1 AND zbt_rarity_score > 2.0 AS zbt_strong_signal,
  zbt_10day_percentage > 0.7 AND zbt_momentum > 0.05 AND zbt_rarity_score > 1.5 AS zbt_momentum_signal,
  zbt_signal AND zbt_10day_percentage > 0.75 AND zbt_momentum > 0.1 AS zbt_breakout_signal FROM zbt_short_feat
""", ZBT)
register("zbt_rolling", lambda t: b.zbt_rolling(b.zbt_features(t.bars_w, p=THRUST)), """
SELECT *, avg(zbt_10day_percentage) OVER w AS rolling_zbt_percentage, avg(zbt_momentum) OVER w AS rolling_zbt_momentum,
  avg(zbt_rarity_score) OVER w AS rolling_zbt_rarity,
  avg(zbt_10day_percentage) OVER w - avg(zbt_10day_percentage) OVER (ORDER BY date ROWS BETWEEN 40 PRECEDING AND 20 PRECEDING) AS zbt_trend
FROM zbt_feat WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)
""", ZBT + " rolling_zbt_percentage rolling_zbt_momentum rolling_zbt_rarity zbt_trend")

# -- composite -------------------------------------------------------------------------
cte("above_ma", """
SELECT date, avg(CASE WHEN floor((close - ma_short) * 1e9 + 0.5) / 1e9 > 0 THEN 1 ELSE 0 END) AS pct_above_ma20,
  avg(CASE WHEN floor((close - ma_long) * 1e9 + 0.5) / 1e9 > 0 THEN 1 ELSE 0 END) AS pct_above_ma50 FROM ma_pairs GROUP BY date
""")
register("pct_above_ma", lambda t: b.pct_above_ma(t.bars_w), "SELECT * FROM above_ma", "pct_above_ma20 pct_above_ma50")
register("breadth_score", lambda t: b.breadth_score(t.bars_w, p=THRUST), """
SELECT *, CASE WHEN floor(score * 1e9 + 0.5) / 1e9 > 60 THEN 'buy' WHEN floor(score * 1e9 + 0.5) / 1e9 < 40 THEN 'sell' ELSE 'hold' END AS score_signal
FROM (SELECT *, adv_ratio * 0.2 + up_dn_vol_ratio * 0.2 + pct_above_ma20 * 0.2 + pct_above_ma50 * 0.2 + mcclellan_osc * 0.15 + zbt_flag * 0.05 AS score
  FROM (SELECT z.date, coalesce(z.advancing_issues * 100 / NULLIF(z.advancing_issues + z.declining_issues, 0)::DOUBLE, 50.0) AS adv_ratio,
      coalesce(v.up * 100 / NULLIF(v.up + v.down, 0)::DOUBLE, 50.0) AS up_dn_vol_ratio,
      a.pct_above_ma20 * 100 AS pct_above_ma20, a.pct_above_ma50 * 100 AS pct_above_ma50,
      least(greatest(o.mcclellan_oscillator / 2 + 50, 0.0), 100.0) AS mcclellan_osc,
      CASE WHEN z.zbt_signal THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS zbt_flag
    FROM zbt_sig z JOIN above_ma a ON a.date = z.date JOIN mcc_osc o ON o.date = z.date
    JOIN (SELECT date, coalesce(sum(volume) FILTER (issue_status = 'advancing'), 0) AS up,
                 coalesce(sum(volume) FILTER (issue_status = 'declining'), 0) AS down FROM pos_status GROUP BY date) v ON v.date = z.date))
""", "adv_ratio up_dn_vol_ratio pct_above_ma20 pct_above_ma50 mcclellan_osc score")
