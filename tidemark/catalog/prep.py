"""Preparation, selection, quality and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.core import cte, register
from tidemark.catalog.indicators import mean, pct, std
from tidemark.operators import indicators as i
from tidemark.operators import prep, quality

c = F.col
LEAD = "(lead(close) OVER (PARTITION BY symbol ORDER BY date) - close) / NULLIF(close, 0)"

# -- fills, fences, scales -----------------------------------------------------
WF = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN"
for name, method, limit, sql in (
    ("fill_missing", "forward_fill", None, f"last_value(close IGNORE NULLS) {WF} UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("fill_missing_limit", "forward_fill", 1, f"last_value(close IGNORE NULLS) {WF} 1 PRECEDING AND CURRENT ROW)"),
    ("fill_missing_backward", "backward_fill", None, f"first_value(close IGNORE NULLS) {WF} CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    ("fill_missing_mean", "mean", None, "coalesce(close, avg(close) OVER ())"),
    ("fill_missing_median", "median", None, "coalesce(close, (SELECT median(close) FROM dirty_bars))"),
    ("fill_missing_zero", "zero", None, "coalesce(close, 0.0)"),
):
    register(name, lambda t, method=method, limit=limit: prep.fill_missing(t.dirty_bars, ["close"], method, limit).select("symbol", "date", "volume", "close"),
             f"SELECT symbol, date, volume, {sql} AS close FROM dirty_bars", "close")
register("fill_missing_drop", lambda t: prep.fill_missing(t.dirty_bars, ["close"], "drop"), "SELECT * FROM dirty_bars WHERE close IS NOT NULL")
OUT = ["close", "volume", "open"]


def fence(x: str) -> str:
    q1, q3 = f"(SELECT quantile_cont({x}, 0.25) FROM bars_w)", f"(SELECT quantile_cont({x}, 0.75) FROM bars_w)"
    return (f"floor(({x} - ({q1} - 1.5 * ({q3} - {q1}))) * 1e6 + 0.5) >= 0 AND floor(({x} - ({q3} + 1.5 * ({q3} - {q1}))) * 1e6 + 0.5) <= 0")


register("outlier_iqr", lambda t: prep.outlier_iqr(t.bars_landed, OUT), "SELECT * FROM bars_w WHERE " + " AND ".join(fence(x) for x in OUT))
register("outlier_z", lambda t: prep.outlier_z(t.bars_landed, OUT, 2.0), "SELECT * FROM bars_w WHERE " + " AND ".join(
    f"floor(abs(({x} - (SELECT avg({x}) FROM bars_w)) / (SELECT stddev_samp({x}) FROM bars_w)) * 1e9 + 0.5) / 1e9 < 2" for x in OUT))
for name, method, sql in (
    ("scale", "standard", "({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()"),
    ("scale_minmax", "minmax", "({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())::DOUBLE"),
    ("scale_robust", "robust", "({x} - (SELECT median({x}) FROM bars_w)) / (SELECT quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) FROM bars_w)"),
):
    register(name, lambda t, method=method: prep.scale(t.bars_landed, ["close", "volume"], method).select("symbol", "date", "close", "volume"),
             "SELECT symbol, date, " + ", ".join(f"{sql.format(x=x)} AS {x}" for x in ("close", "volume")) + " FROM bars_w", "close volume")
register("union_symbols", lambda t: t.bars_w.filter("symbol < 'N10'").select("symbol", "date", "close", "volume").unionByName(
    t.bars_w.filter("symbol >= 'N10'").select("symbol", "date", "close"), allowMissingColumns=True),
    "SELECT symbol, date, close, CASE WHEN symbol < 'N10' THEN volume END AS volume FROM bars_w")
register("distinct_symbols", lambda t: t.bars_w.select("symbol").distinct(), "SELECT DISTINCT symbol FROM bars_w")
register("sort_final", lambda t: t.bars_w.select("symbol", "date", "close").orderBy("date", "symbol"), "SELECT symbol, date, close FROM bars_w ORDER BY date, symbol")

# -- train set ---------------------------------------------------------------------
FEATS = ["sma", "volatility", "parkinson_vol", "volume", "open", "close", "flat"]
cte("train_rows", f"""
SELECT symbol, date, {mean('close', 20)} AS sma, volatility, volatility * sqrt(2 * ln(2)) AS parkinson_vol, volume, open, close, 1.0::DOUBLE AS flat, CAST(chg > 0.02 AS INTEGER) AS target
FROM (SELECT *, {std('r', 20)} AS volatility FROM (SELECT *, {pct('close')} AS r, {LEAD} AS chg FROM bars_w))
""")


def train(t):
    df = prep.target_label(i.volatility_block(i.sma(t.bars_w)))
    return df.select("symbol", "date", "sma", "volatility", "parkinson_vol", "volume", "open", "close", F.lit(1.0).alias("flat"), "target")


register("target_label", lambda t: prep.target_label(t.bars_w).select("symbol", "date", "target"),
         f"SELECT symbol, date, CAST({LEAD} > 0.02 AS INTEGER) AS target FROM bars_w")
register("target_label_regression", lambda t: prep.target_label(t.bars_w, kind="regression", same_bar=True).select("symbol", "date", "target"),
         f"SELECT symbol, date, {pct('close')} AS target FROM bars_w", "target")


def corr_sql(x: str, y: str, rel: str = "train_rows") -> str:
    return f"(SELECT CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END FROM {rel} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


NOFLAT = [x for x in FEATS if x != "flat"]
cte("tcorr", " UNION ALL ".join(f"SELECT '{x}' AS feature, {corr_sql(x, 'target')} AS corr" for x in NOFLAT))
register("select_by_corr", lambda t: prep.select_by_corr(train(t), NOFLAT, "target", 0.05), "SELECT * FROM tcorr WHERE floor(abs(corr) * 1e9 + 0.5) / 1e9 > 0.05", "corr")
register("top_features", lambda t: prep.top_features(train(t), NOFLAT, "target", 3), "SELECT * FROM tcorr ORDER BY abs(corr) DESC NULLS LAST, feature LIMIT 3", "corr")
cte("fprof", " UNION ALL ".join(
    f"SELECT {j} AS pos, '{y}' AS feature, 1 - count({y}) / count(*)::DOUBLE AS missing_ratio, var_samp({y}) AS variance, "
    + ("NULL::DOUBLE" if j == 0 else "greatest(" + ", ".join(f"abs({corr_sql(x, y)})" for x in NOFLAT[:j]) + ")" if j > 1 else f"abs({corr_sql(NOFLAT[0], y)})")
    + f" AS max_earlier_corr, {corr_sql(y, 'target')} AS target_corr FROM train_rows" for j, y in enumerate(NOFLAT)))
register("select_features", lambda t: prep.select_features(train(t), NOFLAT, "target", k=3), """
SELECT feature, missing_ratio, variance, max_earlier_corr, target_corr, CASE WHEN reason IS NULL AND rk > 3 THEN 'rank' ELSE reason END AS reason,
  reason IS NULL AND rk <= 3 AS selected
FROM (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY abs(target_corr) DESC NULLS LAST, feature) AS rk FROM (
 SELECT *, CASE WHEN missing_ratio >= 0.5 THEN 'missing' WHEN floor(max_earlier_corr * 1e9 + 0.5) / 1e9 > 0.95 THEN 'correlated' WHEN variance < 0.01 THEN 'variance' END AS reason FROM fprof))
""", "missing_ratio variance:1 max_earlier_corr target_corr")
cte("train_zero", "SELECT " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in FEATS) + ", target FROM train_rows")
register("select_constant_corr_kbest", lambda t: prep.select_constant_corr_kbest(train(t), FEATS, "target", k=3),
         "SELECT feature, r * r / (1 - r * r) * ((SELECT count(*) FROM train_rows) - 2) AS f_score FROM ("
         + " UNION ALL ".join(
             f"SELECT '{y}' AS feature, {corr_sql(y, 'target', 'train_zero')} AS r, "
             + ("0.0" if j == 0 else "greatest(0, " + ", ".join(f"abs({corr_sql(x, y, 'train_zero')})" for x in NOFLAT[:j]) + ")") + " AS w"
             for j, y in enumerate(NOFLAT)) + ") WHERE floor(w * 1e9 + 0.5) / 1e9 <= 0.95 ORDER BY f_score DESC NULLS LAST, feature LIMIT 3", "f_score:5")
TYPES = {"volume": "bigint"}
register("feature_summary", lambda t: prep.feature_summary(train(t), FEATS),
         " UNION ALL ".join(f"""SELECT '{x}' AS feature, '{TYPES.get(x, 'double')}' AS dtype, count({x}) AS non_null_count, count(*) - count({x}) AS null_count,
  (count(*) - count({x})) / count(*)::DOUBLE * 100 AS null_percentage, count(DISTINCT {x}) AS unique_count, avg({x}) AS mean, stddev_samp({x}) AS std,
  min({x})::DOUBLE AS min, max({x})::DOUBLE AS max FROM train_rows""" for x in ("volume", "open", "close", "flat", "sma", "volatility", "parkinson_vol")).replace("count(DISTINCT sma)", "(SELECT count(DISTINCT sma) FROM train_rows)"),
         "null_percentage mean:4 std:4 min max")
VF = ["open", "close", "volume", "flat"]
register("validate_features", lambda t: prep.validate_features(
    t.dirty_bars.select("symbol", "date", "open", "close", "volume", F.lit(1.0).alias("flat")), VF), """
SELECT 6 AS total_features, 4 AS numeric_features, count(*) AS total_rows, count(*) - count(close) AS missing_values, 0::BIGINT AS infinite_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, date, open, close, volume FROM dirty_bars)) AS duplicate_rows, 'flat' AS constant_features,
  array_to_string(list_filter([CASE WHEN abs(skewness(open)) > 3 THEN 'open' END, CASE WHEN abs(skewness(close)) > 3 THEN 'close' END, CASE WHEN abs(skewness(volume)) > 3 THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS skewed_features,
  array_to_string(list_filter([CASE WHEN abs(corr(open, close)) > 0.95 THEN 'open~close' END, CASE WHEN abs(corr(open, volume)) > 0.95 THEN 'open~volume' END, CASE WHEN abs(corr(close, volume)) > 0.95 THEN 'close~volume' END], lambda x: x IS NOT NULL), ',') AS correlated_pairs
FROM dirty_bars
""")
register("entity_stats", lambda t: prep.entity_stats(t.bars_w), """
SELECT symbol, avg(close) AS mean, stddev_samp(close) AS std, min(close) AS min, max(close) AS max, median(close) AS median, skewness(close) AS skew, kurtosis(close) AS kurt,
  corr(close, lg) AS autocorr_1, sum(close * close) AS abs_energy, avg(abs(close - lg)) AS mean_abs_change, regr_slope(close, n) AS slope,
  count(*) FILTER (floor((close - mu) * 1e9 + 0.5) > 0) AS count_above_mean, count(*) FILTER (floor((close - mu) * 1e9 + 0.5) < 0) AS count_below_mean
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS lg, avg(close) OVER (PARTITION BY symbol) AS mu FROM wk) GROUP BY symbol
""", "mean std median skew kurt autocorr_1 abs_energy:-2 mean_abs_change slope")


def deep(t):
    orders = t.read("orders").select("o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    cust = t.read("customer").select("c_custkey", "c_nationkey", "c_acctbal").withColumnRenamed("c_nationkey", "n_nationkey")
    nation = t.read("nation").select("n_nationkey", "n_name")
    return prep.deep_agg_features(
        [(orders, "c_custkey", ["o_totalprice"]), (cust, "n_nationkey", ["c_acctbal"])], [cust, nation])


FN = (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp"))
DEEP = [f"{x}__{n}" for x in ("c_acctbal", "o_totalprice__mean") for n, _ in FN]
register("deep_agg_features", deep, f"""
SELECT n_nationkey, n_name, n_nationkey__count, {', '.join(DEEP)} FROM nation LEFT JOIN (
  SELECT c_nationkey, count(*) AS n_nationkey__count, {', '.join(f'{f}({x}) AS {x}__{n}' for x in ('c_acctbal', 'o_totalprice__mean') for n, f in FN)}
  FROM (SELECT c_nationkey, c_acctbal, m AS o_totalprice__mean FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey) GROUP BY 1)
  ON c_nationkey = n_nationkey
""", " ".join(x + ":3" for x in DEEP))
ENG = "rsi macd macd_signal macd_histogram bb_width bb_position volume_ma volume_roc pvt:3 true_range price_impact volatility parkinson_vol gk_vol"
ENGC = [x.split(":")[0] for x in ENG.split()]
cte("engineered", f"""
SELECT w.*, tr1 AS true_range, tr1 / NULLIF(m.volume, 0) AS price_impact, v.volatility, v.volatility * sqrt(2 * ln(2)) AS parkinson_vol, v.volatility * sqrt(0.5) AS gk_vol,
  o.volume_ma, o.volume_roc, o.pvt, o.obv
FROM tech_w w JOIN moves_w m ON m.symbol = w.symbol AND m.date = w.date JOIN vol_w o ON o.symbol = w.symbol AND o.date = w.date
JOIN (SELECT symbol, date, {std('r', 20)} AS volatility FROM (SELECT *, {pct('close')} AS r FROM bars_w)) v ON v.symbol = w.symbol AND v.date = w.date
""")
register("engineer_features", lambda t: prep.engineer_features(t.bars_w)[0].select("symbol", "date", *ENGC, "obv"),
         f"SELECT symbol, date, {', '.join(ENGC)}, obv FROM engineered", ENG)
EXPERIMENT = {
    "stages": ["technical", "volatility"], "features": ["rsi", "bb_width", "bb_position", "volatility"],
    "missing": {"method": "forward_fill", "limit": 5}, "outlier_threshold": 1.5, "lag_columns": ["rsi"], "lags": [1, 2, 3, 5, 10],
    "rolling_columns": ["rsi"], "windows": [5, 10, 20], "functions": ["mean", "std", "min", "max"], "scaling": "standard",
    "target": {"kind": "classification", "threshold": 0.02},
}
XF = EXPERIMENT["features"]
XL = [f"rsi_lag_{k}" for k in EXPERIMENT["lags"]]
XR = [(f"rsi_rolling_{n}_{f}", n, g) for n in (5, 10, 20) for f, g in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
cte("x_filled", "SELECT symbol, date, " + ", ".join(
    f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING) AS {x}" for x in XF)
    + f", CAST({LEAD} > 0.02 AS INTEGER) AS target FROM engineered")


def xfence(x: str) -> str:
    return fence(x).replace("FROM bars_w", "FROM x_filled")


cte("x_kept", "SELECT * FROM x_filled WHERE " + " AND ".join(xfence(x) for x in XF))
cte("x_framed", "SELECT *, " + ", ".join(f"lag(rsi, {k}) OVER (PARTITION BY symbol ORDER BY date) AS rsi_lag_{k}" for k in EXPERIMENT["lags"]) + ", "
    + ", ".join(f"CASE WHEN count(rsi) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN {g}(rsi) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END AS {x}" for x, n, g in XR)
    + " FROM x_kept")
XALL = XF + XL + [x for x, _, _ in XR]
register("experiment_dataset", lambda t: prep.experiment_dataset(t.bars_w, EXPERIMENT),
         "SELECT symbol, date, target, " + ", ".join(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS {x}" for x in XALL) + " FROM x_framed", " ".join(XALL))

# -- quality -------------------------------------------------------------------------
EXPECTED = {"symbol": "string", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "int", "currency": "string"}
register("schema_check", lambda t: quality.schema_check(t.dirty_bars, EXPECTED), " UNION ALL ".join(
    f"SELECT '{x}' AS column, '{st}' AS status, {e} AS expected, {a} AS actual, {n} AS non_null FROM dirty_bars" for x, st, e, a, n in (
        [(x, "ok", f"'{k}'", f"'{k}'", f"count({x})") for x, k in (("symbol", "string"), ("date", "date"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"))]
        + [("volume", "mismatch", "'int'", "'bigint'", "count(volume)"), ("adj_close", "extra", "NULL::VARCHAR", "'double'", "count(adj_close)"),
           ("currency", "missing", "'string'", "NULL::VARCHAR", "count(*) * 0")])))
COLS = ["symbol", "date", "open", "high", "low", "close", "volume", "adj_close"]
register("missing_analysis", lambda t: quality.missing_analysis(t.dirty_bars), " UNION ALL ".join(
    f"SELECT '{x}' AS column, count(*) - count({x}) AS missing, (count(*) - count({x})) / count(*)::DOUBLE AS missing_ratio FROM dirty_bars" for x in COLS), "missing_ratio")
cte("bar_moves", "SELECT *, floor(abs((close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0)) * 1e9 + 0.5) / 1e9 AS mv FROM dirty_bars")
NP = "count(*) FILTER (open <= 0) + count(*) FILTER (high <= 0) + count(*) FILTER (low <= 0) + count(*) FILTER (close <= 0) + count(*) FILTER (adj_close <= 0)"
register("price_checks", lambda t: quality.price_checks(t.dirty_bars), f"""
SELECT *, non_positive_prices = 0 AND extreme_changes < total_records * 0.01 AS is_valid FROM (
  SELECT count(*) AS total_records, {NP} AS non_positive_prices, count(*) FILTER (mv > 0.5) AS extreme_changes FROM bar_moves)
""")
register("volume_checks", lambda t: quality.volume_checks(t.dirty_bars), """
SELECT *, negative_volumes = 0 AND zero_volumes < total_records * 0.1 AS is_valid FROM (
  SELECT count(*) AS total_records, count(*) FILTER (volume < 0) AS negative_volumes, count(*) FILTER (volume = 0) AS zero_volumes FROM dirty_bars)
""")
register("column_stats", lambda t: quality.column_stats(t.dirty_bars, ["open", "close", "volume"]), " UNION ALL ".join(
    f"SELECT '{x}' AS column, count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS stddev, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, count(*) - count({x}) AS missing_count, "
    f"(count(*) - count({x})) / count(*)::DOUBLE AS missing_ratio, count(DISTINCT {x}) AS unique_count FROM dirty_bars" for x in ("open", "close", "volume")), "mean:4 stddev:4 missing_ratio")
register("quality_report", lambda t: quality.quality_report(t.dirty_bars), f"""
SELECT *, 1 - missing_ratio AS completeness, (1 - missing_ratio) * 0.5 + (CASE WHEN price_valid THEN 1.0 ELSE 0.5 END) * 0.3 + (CASE WHEN volume_valid THEN 1.0 ELSE 0.5 END) * 0.2 AS quality_score,
  1 - missing_ratio >= 0.95 AND missing_ratio <= 0.05 AND price_valid AND volume_valid AS is_valid
FROM (SELECT *, total_missing / (total_records * 8)::DOUBLE AS missing_ratio, non_positive_prices = 0 AND extreme_changes < total_records * 0.01 AS price_valid,
   negative_volumes = 0 AND zero_volumes < total_records * 0.1 AS volume_valid
  FROM (SELECT count(*) AS total_records, count(*) - count(close) AS total_missing, {NP} AS non_positive_prices, count(*) FILTER (mv > 0.5) AS extreme_changes,
    count(*) FILTER (volume < 0) AS negative_volumes, count(*) FILTER (volume = 0) AS zero_volumes FROM bar_moves))
""", "missing_ratio completeness quality_score")
register("symbol_quality_score", lambda t: quality.symbol_quality_score(t.dirty_bars), """
SELECT *, floor(quality_score * 1e9 + 0.5) / 1e9 >= 0.95 AND floor((1 - missing_ratio) * 1e9 + 0.5) / 1e9 >= 0.95 AND rows >= 10 AS accepted
FROM (SELECT *, greatest(0, least(1, 1 - (missing_ratio + invalid_ratio + extreme_ratio) / 3)) AS quality_score FROM (
  SELECT symbol, count(*) AS rows, (count(*) - count(close)) / (count(*) * 5)::DOUBLE AS missing_ratio,
   (count(*) FILTER (open <= 0) + count(*) FILTER (high <= 0) + count(*) FILTER (low <= 0) + count(*) FILTER (close <= 0)) / (count(*) * 4)::DOUBLE AS invalid_ratio,
   count(*) FILTER (mv > 0.5) / count(*)::DOUBLE AS extreme_ratio FROM bar_moves GROUP BY 1))
""", "missing_ratio invalid_ratio extreme_ratio quality_score")
SPLIT = "1999-06-01"
DRIFT = ["open", "close", "volume"]


def halves(t):
    return t.dirty_bars.filter(f"date >= DATE '{SPLIT}'"), t.dirty_bars.filter(f"date < DATE '{SPLIT}'")


register("drift", lambda t: quality.drift(*halves(t), DRIFT), f"""
SELECT *, floor(drift_score * 1e9 + 0.5) / 1e9 > 0.1 OR floor(mean_shift * 1e9 + 0.5) / 1e9 > 0.1 AS has_drift FROM (SELECT *, least(1.0, mean_shift + std_change) AS drift_score FROM (
 SELECT *, abs(current_mean - reference_mean) / NULLIF(abs(reference_mean), 0) AS mean_shift, abs(current_std - reference_std) / NULLIF(reference_std, 0) AS std_change FROM (
 {' UNION ALL '.join(f"SELECT '{x}' AS column, avg({x}) FILTER (date >= DATE '{SPLIT}') AS current_mean, stddev_samp({x}) FILTER (date >= DATE '{SPLIT}') AS current_std, avg({x}) FILTER (date < DATE '{SPLIT}') AS reference_mean, stddev_samp({x}) FILTER (date < DATE '{SPLIT}') AS reference_std FROM dirty_bars" for x in DRIFT)})))
""", "current_mean:4 current_std:4 reference_mean:4 reference_std:4 mean_shift std_change drift_score")
register("drift_ks", lambda t: quality.drift_ks(*halves(t), DRIFT), " UNION ALL ".join(f"""
SELECT '{x}' AS column, CAST(any_value(na) AS BIGINT) AS current_n, CAST(any_value(nb) AS BIGINT) AS reference_n, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks_statistic FROM (
  SELECT sum(a) OVER (ORDER BY {x}) AS ca, sum(b) OVER (ORDER BY {x}) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
   SELECT {x}, count(*) FILTER (date >= DATE '{SPLIT}') AS a, count(*) FILTER (date < DATE '{SPLIT}') AS b FROM dirty_bars WHERE {x} IS NOT NULL GROUP BY 1))""" for x in DRIFT), "ks_statistic")
register("training_readiness", lambda t: quality.training_readiness(t.dirty_bars, "2001-01-01", "close").withColumn("recommendations", F.array_join("recommendations", "|")), """
SELECT *, total_records >= 1000 AND unique_symbols >= 10 AND date_span_days >= 30 AND future_data_count = 0 AND target_missing_ratio < 0.1 AS is_valid,
  coalesce(NULLIF(concat_ws('|', CASE WHEN total_records < 1000 THEN 'Consider collecting more data (minimum 1000 records recommended)' END,
   CASE WHEN unique_symbols < 10 THEN 'Consider including more symbols (minimum 10 recommended)' END, CASE WHEN date_span_days < 30 THEN 'Consider extending the date range (minimum 30 days recommended)' END,
   CASE WHEN future_data_count > 0 THEN 'Remove future data to prevent data leakage' END), ''), 'Data appears suitable for training') AS recommendations
FROM (SELECT count(*) AS total_records, count(DISTINCT symbol) AS unique_symbols, CAST(max(date) - min(date) AS INTEGER) AS date_span_days,
  count(*) FILTER (date > DATE '2001-01-01') AS future_data_count, count(*) FILTER (close IS NULL) / count(*)::DOUBLE AS target_missing_ratio FROM dirty_bars)
""", "target_missing_ratio")
