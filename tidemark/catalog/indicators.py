"""Indicator, exponential-mean and microstructure queries."""

from __future__ import annotations

from tidemark.catalog.breadth import weekly
from tidemark.catalog.core import cte, register
from tidemark.operators import indicators as i
from tidemark.operators import microstructure as m
from tidemark.plans.ewm import ewm, memory_rows

W = "(PARTITION BY symbol ORDER BY date"


def fullw(expr: str, arg: str, n: int) -> str:
    """SQL for an aggregate over a full frame of n rows."""
    over = f"OVER {W} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({arg}) {over} = {n} THEN {expr} {over} END)"


def mean(x: str, n: int) -> str:
    return fullw(f"avg({x})", x, n)


def std(x: str, n: int) -> str:
    return fullw(f"stddev_samp({x})", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W})"


def pct(x: str, k: int = 1) -> str:
    return f"(({x} - {lag(x, k)}) / NULLIF({lag(x, k)}, 0)::DOUBLE)"


def simple(name, op, lookback, sql, doubles):
    register(name, lambda t: weekly(t, op, lookback), sql, doubles)


simple("sma", i.sma, 20, f"SELECT *, {mean('close', 20)} AS sma FROM bars_w", "sma")
cte("rsi_w", f"""
SELECT * EXCLUDE (gain, loss, g, l), CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l = 0 THEN NULL ELSE 100 - 100 / (1 + g / l) END AS rsi
FROM (SELECT *, {mean('gain', 14)} AS g, {mean('loss', 14)} AS l FROM (
  SELECT *, coalesce(greatest(close - {lag('close')}, 0), 0) AS gain, coalesce(greatest({lag('close')} - close, 0), 0) AS loss FROM bars_w))
""")
simple("rsi", i.rsi, 15, "SELECT * FROM rsi_w", "rsi")
cte("boll_w", f"""
SELECT symbol, date, mid AS bb_middle, mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower,
  ((mid + 2 * sd) - (mid - 2 * sd)) / NULLIF(mid, 0) AS bb_width,
  (close - (mid - 2 * sd)) / NULLIF((mid + 2 * sd) - (mid - 2 * sd), 0) AS bb_position
FROM (SELECT symbol, date, close, {mean('close', 20)} AS mid, {std('close', 20)} AS sd FROM bars_w)
""")
BB = "bb_middle bb_upper bb_lower bb_width bb_position"
register("bollinger", lambda t: weekly(t, i.bollinger, 20).select("symbol", "date", *BB.split()), "SELECT * FROM boll_w", BB)
cte("range14", f"""
SELECT *, {fullw('min(low)', 'low', 14)} AS lo, {fullw('max(high)', 'high', 14)} AS hi FROM bars_w
""")
register("stochastic", lambda t: weekly(t, i.stochastic, 17).select("symbol", "date", "stoch_k", "stoch_d"),
         f"SELECT *, {mean('stoch_k', 3)} AS stoch_d FROM (SELECT symbol, date, (close - lo) / NULLIF(hi - lo, 0) * 100 AS stoch_k FROM range14)",
         "stoch_k stoch_d")
register("williams_r", lambda t: weekly(t, i.williams_r, 14).select("symbol", "date", "williams_r"),
         "SELECT symbol, date, (hi - close) / NULLIF(hi - lo, 0) * -100 AS williams_r FROM range14", "williams_r")
register("cci", lambda t: weekly(t, i.cci, 20).select("symbol", "date", "cci"), f"""
SELECT symbol, date, (tp - mu) / NULLIF(0.015 * list_sum(list_transform(seen, lambda x: abs(x - mu))) / 20, 0) AS cci
FROM (SELECT symbol, date, tp, {mean('tp', 20)} AS mu, list(tp) OVER {W} ROWS 19 PRECEDING) AS seen
      FROM (SELECT symbol, date, (high + low + close) / 3 AS tp FROM bars_w))
""", "cci")
cte("moves_w", f"""
SELECT *, high - {lag('high')} AS up, low - {lag('low')} AS lowdiff,
  CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr2,
  greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0)) AS tr1
FROM bars_w
""")
for name, down in (("adx", "lowdiff"), ("adx_wilder", "(-lowdiff)")):
    sql = f"""
SELECT symbol, date, plus_di, minus_di, {mean('dx', 14)} AS adx FROM (
 SELECT *, 100 * abs(plus_di - minus_di) / NULLIF(plus_di + minus_di, 0) AS dx FROM (
  SELECT symbol, date, {mean('pdm', 14)} / NULLIF({mean('tr2', 14)}, 0) * 100 AS plus_di,
    {mean('mdm', 14)} / NULLIF({mean('tr2', 14)}, 0) * 100 AS minus_di
  FROM (SELECT symbol, date, tr2, CASE WHEN up > {down} AND up > 0 THEN up ELSE 0.0 END AS pdm,
          CASE WHEN {down} > up AND {down} > 0 THEN {down} ELSE 0.0 END AS mdm FROM moves_w)))
"""
    wilder = name != "adx"
    register(name, lambda t, wilder=wilder: weekly(t, lambda d, s: i.adx(d, s, wilder=wilder), 30)
             .select("symbol", "date", "plus_di", "minus_di", "adx"), sql, "plus_di minus_di adx")
register("atr", lambda t: weekly(t, i.atr, 15).select("symbol", "date", "true_range", "atr"),
         f"SELECT symbol, date, tr1 AS true_range, {mean('tr1', 14)} AS atr FROM moves_w", "true_range atr")
register("true_range_impact", lambda t: weekly(t, i.true_range_impact, 1).select("symbol", "date", "true_range", "price_impact"),
         "SELECT symbol, date, tr1 AS true_range, tr1 / NULLIF(volume, 0) AS price_impact FROM moves_w", "true_range price_impact")
cte("vol_w", f"""
SELECT *, CAST(sum(sgn) OVER {W}) AS BIGINT) AS obv, sum(flow) OVER {W}) AS pvt FROM (
  SELECT *, {mean('volume', 20)} AS volume_ma, {pct('volume', 20)} AS volume_roc, volume * {pct('close')} AS flow,
    CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END AS sgn FROM bars_w)
""")
register("volume_block", lambda t: i.volume_block(t.bars_w, frequency="1week").select("symbol", "date", "volume_ma", "volume_roc", "pvt", "obv"),
         "SELECT symbol, date, volume_ma, volume_roc, pvt, obv FROM vol_w", "volume_ma volume_roc pvt:3")
register("volatility_block", lambda t: weekly(t, i.volatility_block, 21).select("symbol", "date", "volatility", "parkinson_vol", "gk_vol"),
         f"""SELECT symbol, date, v AS volatility, v * sqrt(2 * ln(2)) AS parkinson_vol, v * sqrt(0.5) AS gk_vol
FROM (SELECT symbol, date, {std('r', 20)} AS v FROM (SELECT *, {pct('close')} AS r FROM bars_w))""", "volatility parkinson_vol gk_vol")

# -- exponential means ---------------------------------------------------------
cte("wk", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars_w")


def ew(x: str, span: int) -> str:
    q = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"sum(b.{x} * pow({q}, a.n - b.n)) / sum(pow({q}, a.n - b.n))"


cte("macd_line", f"""
SELECT a.symbol, a.date, a.n, {ew('close', 12)} - {ew('close', 26)} AS macd
FROM wk a JOIN wk b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2, 3
""")
cte("macd_w", f"""
SELECT symbol, date, macd, macd_signal, macd - macd_signal AS macd_histogram FROM (
  SELECT a.symbol, a.date, a.macd, {ew('macd', 9)} AS macd_signal
  FROM macd_line a JOIN macd_line b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2, 3)
""")
register("ewm", lambda t: weekly_d(t), f"""
SELECT a.symbol, a.date, {ew('close', 12)} AS ewm_12, {ew('close', 26)} AS ewm_26
FROM dd a JOIN dd b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2
""", "ewm_12:5 ewm_26:5")
cte("dd", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars_d")


def weekly_d(t):
    return ewm(t.bars_d, {"ewm_12": ("close", 12), "ewm_26": ("close", 26)}).select("symbol", "date", "ewm_12", "ewm_26")


register("macd", lambda t: weekly(t, i.macd, i.LOOKBACK["macd"]).select("symbol", "date", "macd", "macd_signal", "macd_histogram"),
         "SELECT * FROM macd_w", "macd macd_signal macd_histogram")
cte("tech_w", """
SELECT b.*, r.rsi, l.bb_middle, l.bb_upper, l.bb_lower, l.bb_width, l.bb_position, m.macd, m.macd_signal, m.macd_histogram
FROM bars_w b JOIN rsi_w r USING (symbol, date) JOIN boll_w l USING (symbol, date) JOIN macd_w m USING (symbol, date)
""")
TECH = "rsi " + BB + " macd macd_signal macd_histogram"
register("technical_all", lambda t: weekly(t, i.technical_all, i.LOOKBACK["technical_all"]), "SELECT * FROM tech_w", TECH)

# -- lags, frames, growth ----------------------------------------------------------
register("lag_features", lambda t: weekly(t, lambda d, s: i.lag_features(d, "close", [1, 2, 3, 5, 10], s), 10).select(
    "symbol", "date", *[f"close_lag_{k}" for k in (1, 2, 3, 5, 10)]),
    "SELECT symbol, date, " + ", ".join(f"{lag('close', k)} AS close_lag_{k}" for k in (1, 2, 3, 5, 10)) + " FROM bars_w")
FUNCS = ["mean", "std", "min", "max", "median", "skew", "kurt"]
SQLF = {"mean": "avg(close)", "std": "stddev_samp(close)", "min": "min(close)", "max": "max(close)",
        "median": "median(close)", "skew": "skewness(close)", "kurt": "kurtosis(close)"}
ROLL = [f"close_rolling_{n}_{f}" for n in (5, 10, 20) for f in FUNCS]
register("rolling_features", lambda t: weekly(t, lambda d, s: i.rolling_features(d, "close", [5, 10, 20], FUNCS, s), 20).select("symbol", "date", *ROLL),
         "SELECT symbol, date, " + ", ".join(f"{fullw(SQLF[f], 'close', n)} AS close_rolling_{n}_{f}" for n in (5, 10, 20) for f in FUNCS) + " FROM bars_w",
         " ".join(ROLL))
register("pct_growth", lambda t: i.pct_growth(t.fundamentals_q, ["revenue", "earnings"]).select("symbol", "date", "revenue_growth", "earnings_growth"),
         f"SELECT symbol, date, {pct('revenue', 4)} AS revenue_growth, {pct('earnings', 4)} AS earnings_growth FROM fundamentals_q",
         "revenue_growth earnings_growth")
register("volatility_index", lambda t: weekly(t, i.volatility_index, 21).select("symbol", "date", "volatility_index"),
         f"SELECT symbol, date, {mean('tr2', 20)} / NULLIF(close, 0) AS volatility_index FROM moves_w", "volatility_index")
register("momentum_sentiment", lambda t: weekly(t, i.momentum_sentiment, 14).select("symbol", "date", "momentum_sentiment"),
         f"SELECT symbol, date, {pct('close', 14)} * {pct('volume', 14)} AS momentum_sentiment FROM bars_w", "momentum_sentiment")
cte("returns", """
SELECT date, total_value, (total_value - lag(total_value) OVER (ORDER BY date)) / NULLIF(lag(total_value) OVER (ORDER BY date), 0) AS ret,
  row_number() OVER (ORDER BY date) AS n FROM equity
""")
register("rolling_perf", lambda t: i.rolling_perf(t.equity), """
SELECT r.date, r.total_value, r.ret AS return,
  CASE WHEN f THEN v * sqrt(252) END AS rolling_volatility, CASE WHEN f THEN m / NULLIF(v, 0) * sqrt(252) END AS rolling_sharpe,
  CASE WHEN f THEN d.dd END AS rolling_max_drawdown, CASE WHEN f THEN wr END AS rolling_win_rate
FROM (SELECT *, count(ret) OVER w = 30 AS f, stddev_samp(ret) OVER w AS v, avg(ret) OVER w AS m,
        avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER w AS wr FROM returns WINDOW w AS (ORDER BY date ROWS 29 PRECEDING)) r
JOIN (SELECT n, max((peak - v) / peak) AS dd FROM (
   SELECT a.n, b.total_value AS v, max(b.total_value) OVER (PARTITION BY a.n ORDER BY b.n) AS peak
   FROM returns a JOIN returns b ON b.n BETWEEN a.n - 29 AND a.n) GROUP BY n) d ON d.n = r.n
""", "return rolling_volatility rolling_sharpe rolling_max_drawdown rolling_win_rate")

# -- microstructure -----------------------------------------------------------------
MSV = ([f"volume_sma_{n}" for n in (5, 10, 20, 50)] + [f"volume_ema_{n}" for n in (5, 10, 20, 50)]
       + [f"volume_{k}_{n}" for n in (5, 10, 20) for k in ("volatility", "ratio", "zscore", "cv")]
       + [f"volume_momentum_{n}" for n in (1, 5, 10)] + [f"volume_percentile_{n}" for n in (20, 50)])
cte("vol_ema", f"""
SELECT a.symbol, a.date, {', '.join(f"{ew('volume', n)} AS volume_ema_{n}" for n in (5, 10, 20, 50))}
FROM wk a JOIN wk b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2
""")
register("ms_volume", lambda t: weekly(t, m.ms_volume, memory_rows(50)).select("symbol", "date", *MSV, "volume_acceleration"), f"""
SELECT *, {', '.join(f'volume_volatility_{n} / NULLIF(volume_sma_{n}, 0) AS volume_cv_{n}, volume / NULLIF(volume_sma_{n}, 0) AS volume_ratio_{n}, (volume - volume_sma_{n}) / NULLIF(volume_volatility_{n}, 0) AS volume_zscore_{n}' for n in (5, 10, 20))}
FROM (SELECT symbol, date, volume, {', '.join(f"{mean('volume', n)} AS volume_sma_{n}" for n in (5, 10, 20, 50))},
  {', '.join(f"{std('volume', n)} AS volume_volatility_{n}" for n in (5, 10, 20))},
  {', '.join(f"{pct('volume', n)} AS volume_momentum_{n}" for n in (1, 5, 10))},
  volume - 2 * {lag('volume')} + {lag('volume', 2)} AS volume_acceleration FROM bars_w)
JOIN vol_ema USING (symbol, date)
JOIN (SELECT symbol, date, {', '.join(f'''CASE WHEN len(l{n}) = {n} THEN (len(list_filter(l{n}, lambda x: x < volume)) + (len(list_filter(l{n}, lambda x: x = volume)) + 1) / 2.0) / {n} END AS volume_percentile_{n}''' for n in (20, 50))}
  FROM (SELECT symbol, date, volume, list(volume) OVER {W} ROWS 19 PRECEDING) AS l20, list(volume) OVER {W} ROWS 49 PRECEDING) AS l50 FROM bars_w)) USING (symbol, date)
""".replace("SELECT *, volume_vol", "SELECT * EXCLUDE volume, volume_vol"), " ".join(MSV))
PV = ("vwap price_vs_vwap price_vs_vwap_zscore volume_weighted_price price_volume_trend:1 price_impact price_impact_ma "
      "volume_price_corr_5 volume_price_corr_10 volume_price_corr_20 volume_weighted_return")
PVC = [x.split(":")[0] for x in PV.split()]
cte("pv_w", f"""
SELECT symbol, date, vwap, price_vs_vwap, (price_vs_vwap - {mean('price_vs_vwap', 20)}) / NULLIF({std('price_vs_vwap', 20)}, 0) AS price_vs_vwap_zscore,
  {fullw('sum(close * volume)', 'close', 20)} / NULLIF({fullw('sum(volume)', 'volume', 20)}, 0) AS volume_weighted_price,
  {fullw('sum(step)', 'step', 20)} AS price_volume_trend, price_impact, {mean('price_impact', 20)} AS price_impact_ma,
  {', '.join(f"CASE WHEN isfinite({fullw('corr(close, volume)', 'close', n)}) THEN {fullw('corr(close, volume)', 'close', n)} END AS volume_price_corr_{n}" for n in (5, 10, 20))},
  {fullw('sum(ret * volume)', 'ret', 20)} / NULLIF({fullw('sum(volume)', 'volume', 20)}, 0) AS volume_weighted_return,
  CASE WHEN n >= 10 THEN sign(floor(regr_slope(close, n) OVER {W} ROWS 9 PRECEDING) * 1e6 + 0.5)) <> sign(floor(regr_slope(volume, n) OVER {W} ROWS 9 PRECEDING) * 1e6 + 0.5)) END AS price_volume_divergence
FROM (SELECT *, (close / NULLIF(vwap, 0) - 1) * 100 AS price_vs_vwap FROM (
  SELECT *, sum((high + low + close) / 3 * volume) OVER {W}) / NULLIF(sum(volume) OVER {W}), 0) AS vwap, {pct('close')} AS ret,
    {pct('close')} / NULLIF({pct('volume')}, 0) AS price_impact, (close - {lag('close')}) * volume AS step FROM wk))
""")
register("ms_price_volume", lambda t: m.ms_price_volume(t.bars_w, frequency="1week").select("symbol", "date", *PVC, "price_volume_divergence"),
         "SELECT * FROM pv_w", PV)
OF = ("spread_proxy price_range price_range_pct open_close_range high_close_range low_close_range price_efficiency "
      "order_flow_imbalance spread_proxy_ma spread_proxy_zscore price_range_ma price_efficiency_ma")
register("ms_order_flow", lambda t: weekly(t, m.ms_order_flow, 20).select("symbol", "date", *OF.split()), f"""
SELECT *, {mean('spread_proxy', 20)} AS spread_proxy_ma, (spread_proxy - {mean('spread_proxy', 20)}) / NULLIF({std('spread_proxy', 20)}, 0) AS spread_proxy_zscore,
  {mean('price_range_pct', 20)} AS price_range_ma, {mean('price_efficiency', 20)} AS price_efficiency_ma
FROM (SELECT symbol, date, (high - low) / NULLIF(close, 0) AS spread_proxy, high - low AS price_range, (high - low) / NULLIF(close, 0) AS price_range_pct,
  abs(open - close) / NULLIF(close, 0) AS open_close_range, (high - close) / NULLIF(close, 0) AS high_close_range,
  (close - low) / NULLIF(close, 0) AS low_close_range, (close - low) / NULLIF(high - low, 0) AS price_efficiency,
  coalesce((close - open) / NULLIF(high - low, 0), 0) AS order_flow_imbalance FROM bars_w)
""", OF)
IN = ("trading_intensity volume_burst_intensity volume_acceleration_ma volume_acceleration_std volume_momentum_ma volume_momentum_std")
register("ms_intensity", lambda t: weekly(t, m.ms_intensity, 32).select(
    "symbol", "date", *IN.split(), "volume_regime", "volume_burst", "volume_clustering", "volume_persistence"), f"""
SELECT symbol, date, trading_intensity, volume_burst_intensity, volume_acceleration_ma, volume_acceleration_std, volume_momentum_ma, volume_momentum_std,
  volume_regime, volume_burst, CAST({fullw('sum(CASE WHEN volume_burst THEN 1 ELSE 0 END)', 'volume_burst', 5)} AS BIGINT) AS volume_clustering,
  r.volume_persistence
FROM (SELECT *, {mean('accel', 5)} AS volume_acceleration_ma, {std('accel', 10)} AS volume_acceleration_std,
        {mean('mom', 5)} AS volume_momentum_ma, {std('mom', 10)} AS volume_momentum_std FROM burst_w)
JOIN (SELECT symbol, n, CASE WHEN n >= 10 THEN coalesce(max(len), 0) END::INTEGER AS volume_persistence FROM (
   SELECT a.symbol, a.n, b.n - row_number() OVER (PARTITION BY a.symbol, a.n ORDER BY b.n) AS island, count(*) OVER (PARTITION BY a.symbol, a.n, b.isl) AS len
   FROM burst_w a LEFT JOIN (SELECT symbol, n, n - row_number() OVER (PARTITION BY symbol ORDER BY n) AS isl FROM burst_w WHERE volume_burst) b
     ON a.symbol = b.symbol AND b.n BETWEEN a.n - 9 AND a.n WHERE b.n IS NOT NULL) GROUP BY 1, 2
   UNION ALL SELECT symbol, n, CASE WHEN n >= 10 THEN 0 END::INTEGER FROM burst_w a
   WHERE NOT EXISTS (SELECT 1 FROM burst_w b WHERE b.symbol = a.symbol AND b.volume_burst AND b.n BETWEEN a.n - 9 AND a.n)) r USING (symbol, n)
""", IN)
cte("burst_w", f"""
SELECT *, coalesce(volume > thr, false) AS volume_burst, volume / NULLIF(thr, 0) AS volume_burst_intensity FROM (
  SELECT *, floor({fullw('quantile_cont(volume, 0.8)', 'volume', 20)} * 1e6 + 0.5) / 1e6 AS thr, volume / NULLIF({mean('volume', 20)}, 0) AS trading_intensity,
    volume - 2 * {lag('volume')} + {lag('volume', 2)} AS accel, {pct('volume')} AS mom,
    CASE WHEN floor({mean('volume', 5)} * 1e9 + 0.5) / 1e9 > floor({mean('volume', 20)} * 1e9 + 0.5) / 1e9 THEN 1 ELSE 0 END AS volume_regime FROM wk)
""")
QU = ("price_stability price_consistency volume_stability volume_consistency price_efficiency_ratio volume_efficiency market_depth_proxy:4 price_impact_measure")
QUC = [x.split(":")[0] for x in QU.split()]
cte("qual_w", f"""
SELECT symbol, date, 1 / ({mean('abs(r)', 20)} + 1e-8) AS price_stability, 1 / ({std('r', 20)} + 1e-8) AS price_consistency,
  1 / ({mean('abs(vr)', 20)} + 1e-8) AS volume_stability, 1 / ({std('vr', 20)} + 1e-8) AS volume_consistency,
  coalesce(abs(r) / NULLIF(high - low, 0) / NULLIF(close, 0), 0) AS price_efficiency_ratio, coalesce(volume / NULLIF(high - low, 0) / NULLIF(close, 0), 0) AS volume_efficiency,
  coalesce(volume / NULLIF((high - low) / NULLIF(close, 0), 0), 0) AS market_depth_proxy,
  coalesce(abs(r) / NULLIF(volume / NULLIF({mean('volume', 20)}, 0), 0), 0) AS price_impact_measure
FROM (SELECT *, {pct('close')} AS r, {pct('volume')} AS vr FROM bars_w)
""")
register("ms_quality", lambda t: weekly(t, m.ms_quality, 21).select("symbol", "date", *QUC), "SELECT * FROM qual_w", QU)
LQ = ("liquidity_ratio:4 amihud_illiquidity amihud_illiquidity_ma volume_weighted_liquidity:-3 volume_weighted_liquidity_ma:-3 liquidity_volatility:2")
LQC = [x.split(":")[0] for x in LQ.split()]
cte("liq_w", f"""
SELECT *, {mean('volume_weighted_liquidity', 20)} AS volume_weighted_liquidity_ma,
  CAST({fullw('sum(CASE WHEN high_liquidity THEN 1 ELSE 0 END)', 'high_liquidity', 5)} AS BIGINT) AS liquidity_persistence
FROM (SELECT symbol, date, liquidity_ratio, amihud_illiquidity, {mean('amihud_illiquidity', 20)} AS amihud_illiquidity_ma,
   liquidity_ratio * volume AS volume_weighted_liquidity, {std('liquidity_ratio', 20)} AS liquidity_volatility,
   coalesce(floor(liquidity_ratio * 1e4 + 0.5) > floor({fullw('quantile_cont(liquidity_ratio, 0.5)', 'liquidity_ratio', 20)} * 1e4 + 0.5), false) AS high_liquidity
  FROM (SELECT symbol, date, volume, coalesce(volume / NULLIF((high - low) / NULLIF(close, 0), 0), 0) AS liquidity_ratio,
     coalesce(abs({pct('close')}) / NULLIF(volume, 0), 0) AS amihud_illiquidity FROM bars_w))
""")
register("ms_liquidity", lambda t: weekly(t, m.ms_liquidity, 26).select("symbol", "date", *LQC, "high_liquidity", "liquidity_persistence"),
         "SELECT * FROM liq_w", LQ)
register("microstructure_summary", lambda t: m.microstructure_summary(t.bars_w, frequency="1week"), """
SELECT symbol, avg(volume) AS volume_mean, stddev_samp(volume) AS volume_std, skewness(volume) AS volume_skewness, kurtosis(volume) AS volume_kurtosis,
  corr(close, volume) AS price_volume_correlation, avg(price_vs_vwap) AS vwap_deviation_mean, stddev_samp(price_vs_vwap) AS vwap_deviation_std,
  avg((high - low) / NULLIF(close, 0)) AS spread_proxy_mean, avg(price_stability) AS price_stability_mean, avg(volume_stability) AS volume_stability_mean,
  avg(liquidity_ratio) AS liquidity_ratio_mean, avg(amihud_illiquidity) AS amihud_illiquidity_mean
FROM bars_w JOIN pv_w USING (symbol, date) JOIN qual_w USING (symbol, date) JOIN liq_w USING (symbol, date) GROUP BY symbol
""", "volume_mean volume_std volume_skewness volume_kurtosis price_volume_correlation vwap_deviation_mean vwap_deviation_std spread_proxy_mean "
     "price_stability_mean volume_stability_mean liquidity_ratio_mean:3 amihud_illiquidity_mean")
