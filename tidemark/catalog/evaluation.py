"""Costing, performance and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.core import cte, register
from tidemark.catalog.indicators import pct
from tidemark.operators import costing as k
from tidemark.operators import performance as pf
from tidemark.params import ES_FACTORS, FAST_TRADING, Z_SCORES

c = F.col
KEY = ["symbol", "date", "order_id", "line", "part_id"]
KS = ", ".join(KEY)

# daily price of the traded symbol as market price; the print itself as limit/stop
cte("orders_in", """
SELECT t.symbol, t.date, order_id, line, part_id, signal_type, t.quantity, t.price AS limit_price, t.price AS stop_price, round(b.close / 25, 6) AS market_price,
  round((t.order_id % 100) / 100.0::DOUBLE, 2) AS confidence
FROM trades t JOIN bars_d b ON b.symbol = t.symbol AND b.date = t.date
""")


def orders(t):
    b = t.bars_d.select("symbol", "date", F.round(c("close") / 25, 6).alias("market_price"))
    return t.trades.join(b, ["symbol", "date"]).select(
        *KEY, "signal_type", "quantity", c("price").alias("limit_price"), c("price").alias("stop_price"), "market_price",
        F.round((c("order_id") % 100) / 100, 2).alias("confidence"))


def buy(x: str, y: str, side: str = "signal_type") -> str:
    return f"CASE WHEN {side} IN ('buy', 'cover') THEN {x} ELSE {y} END"


for name, prof, slip, edge in (("exec_price", k.TRADING, 0.0005, 0.0), ("exec_hft_profile", FAST_TRADING, 0.00025, 0.0001)):
    stop = """CASE WHEN signal_type IN ('sell', 'cover') THEN CASE WHEN market_price <= stop_price THEN stop_price * (1 - 0.0005) END
      WHEN market_price >= stop_price THEN stop_price * (1 + 0.0005) END""" if name == "exec_price" else "market_price"
    imp, unit, better = (0.0001, 1000.0, 0.0001) if name == "exec_price" else (0.00005, 10000.0, 0.00005)
    sql = f"""
SELECT {KS}, {buy(f'market_price * (1 + {slip})', f'market_price * (1 - {slip})')} AS market_exec,
  {buy(f'least(limit_price, market_price * (1 - {edge}))', f'greatest(limit_price, market_price * (1 + {edge}))')} AS limit_exec, {stop} AS stop_exec,
  {buy(f'market_price * (1 + {imp} * quantity / {unit}) * (1 - {better})', f'market_price / (1 + {imp} * quantity / {unit}) * (1 + {better})')} AS impact_price
FROM orders_in"""

    def run(t, prof=prof):
        side, px = c("signal_type"), c("market_price")
        return orders(t).select(
            *KEY, k.exec_price(side, px, "market", p=prof).alias("market_exec"),
            k.exec_price(side, px, "limit", c("limit_price"), p=prof).alias("limit_exec"),
            k.exec_price(side, px, "stop", stop=c("stop_price"), p=prof).alias("stop_exec"),
            k.exec_impact(side, px, c("quantity"), prof).alias("impact_price"))

    register(name, run, sql, "market_exec limit_exec stop_exec impact_price")
register("exec_impact", lambda t: orders(t).select(*KEY, k.exec_impact(c("signal_type"), c("market_price"), c("quantity")).alias("price")),
         f"SELECT {KS}, {buy('market_price * (1 + 0.0001 * quantity / 1000) * (1 - 0.0001)', 'market_price / (1 + 0.0001 * quantity / 1000) * (1 + 0.0001)')} AS price FROM orders_in", "price")
register("exec_commission", lambda t: orders(t).select(
    *KEY, k.commission(c("quantity") * c("market_price")).alias("commission"), k.slippage_cost(c("quantity") * c("market_price")).alias("slippage")),
    f"SELECT {KS}, greatest(quantity * market_price * 0.001, 1.0) AS commission, quantity * market_price * 0.0005 AS slippage FROM orders_in", "commission slippage")
KELLY = "greatest(100.0, least(greatest(0.0, least((confidence * 0.1 - (1 - confidence) * 0.05) / 0.1, 0.25)) * 100000.0, 10000.0))"
register("position_size", lambda t: orders(t).select(
    *KEY, k.position_size(c("confidence")).alias("fixed_size"), k.position_size(c("confidence"), "kelly").alias("kelly_size")),
    f"SELECT {KS}, 5000.0::DOUBLE AS fixed_size, {KELLY} AS kelly_size FROM orders_in", "fixed_size kelly_size")
register("position_cap", lambda t: orders(t).select(
    *KEY, k.position_cap(c("quantity"), c("market_price"), F.lit(100000.0), F.lit(2500.0)).alias("quantity")), f"""
SELECT {KS}, CASE WHEN floor(q * market_price * 1e6 + 0.5) / 1e6 >= 100 THEN q END AS quantity FROM (
  SELECT *EXCLUDE quantity, least(quantity, 10000.0 / market_price, 2500.0 / market_price) AS q FROM orders_in)
""", "quantity")
register("position_size_risk", lambda t: orders(t).select(
    *KEY, k.position_size_risk("risk_based", F.lit(100000.0), c("confidence") / 40).alias("risk_based"),
    k.position_size_risk("equal_weight", F.lit(100000.0), F.lit(0.0)).alias("equal_weight"),
    k.position_size_risk("volatility_weight", F.lit(100000.0), F.lit(0.0), c("confidence") / 20).alias("volatility_weight")), f"""
SELECT {KS}, CASE WHEN 0.02 - confidence / 40 <= 0 THEN 0.0 ELSE 100000.0 * least(0.02 - confidence / 40, 0.01) END AS risk_based, 10000.0::DOUBLE AS equal_weight,
  5000.0::DOUBLE * greatest(0.5, least(coalesce(0.02 / NULLIF(confidence / 20, 0), 1e9), 2.0)) AS volatility_weight FROM orders_in WHERE confidence <> 0
UNION ALL SELECT {KS}, 1000.0, 10000.0, 10000.0 FROM orders_in WHERE confidence = 0
""", "risk_based equal_weight volatility_weight")
register("stop_levels", lambda t: orders(t).select(*KEY, *[x.alias(n) for n, x in k.stop_levels(c("signal_type"), c("market_price")).items()]),
         f"SELECT {KS}, {buy('market_price * 0.95', 'market_price * 1.05')} AS stop_loss, {buy('market_price * 1.1', 'market_price * 0.9')} AS take_profit FROM orders_in",
         "stop_loss take_profit")
register("trade_type", lambda t: orders(t).select(*KEY, k.trade_type(c("signal_type"), c("quantity") - 25).alias("trade_type")), f"""
SELECT {KS}, CASE WHEN signal_type = 'buy' AND quantity - 25 < 0 THEN 'cover' WHEN signal_type IN ('buy', 'sell', 'short', 'cover') THEN signal_type END AS trade_type FROM orders_in
""")
cte("trade_rows", f"""
SELECT *, total_cost + commission + slippage AS net_amount FROM (
 SELECT *, quantity * price AS total_cost, CASE WHEN price IS NOT NULL THEN greatest(quantity * price * 0.001, 1.0) END AS commission, quantity * price * 0.0005 AS slippage,
   CASE WHEN signal_type = 'hold' THEN 'rejected' WHEN price IS NULL THEN 'cancelled' ELSE 'executed' END AS status
 FROM (SELECT * EXCLUDE raw, {buy('raw * (1 + 0.0001 * quantity / 1000) * (1 - 0.0001)', 'raw / (1 + 0.0001 * quantity / 1000) * (1 + 0.0001)')} AS price
  FROM (SELECT {KS}, signal_type, CASE WHEN signal_type <> 'hold' THEN signal_type END AS trade_type, CASE WHEN signal_type <> 'hold' THEN {KELLY} END AS quantity,
    CASE signal_type WHEN 'sell' THEN CASE WHEN market_price <= stop_price THEN stop_price * (1 - 0.0005) END
      WHEN 'buy' THEN CASE WHEN market_price >= stop_price THEN stop_price * (1 + 0.0005) END END AS raw FROM orders_in)))
""")
TR = "quantity price:5 total_cost:3 commission:4 slippage:4 net_amount:3"


def trade_rows(t):
    return k.trade_log(orders(t).drop("quantity"), "stop", "kelly").select(
        *KEY, "signal_type", "trade_type", "quantity", "price", "total_cost", "commission", "slippage", "status", "net_amount")


register("trade_log", trade_rows, "SELECT * FROM trade_rows", TR)
register("exec_stats", lambda t: k.exec_stats(trade_rows(t)), """
SELECT count(*) AS total_orders, count(*) FILTER (status = 'executed') AS executed_orders, count(*) FILTER (status = 'cancelled') AS cancelled_orders,
  count(*) FILTER (status = 'rejected') AS rejected_orders, sum(commission) FILTER (status = 'executed') AS total_commission, sum(slippage) FILTER (status = 'executed') AS total_slippage,
  count(*) FILTER (status = 'executed') / count(*)::DOUBLE AS execution_rate, count(*) FILTER (status = 'cancelled') / count(*)::DOUBLE AS cancellation_rate,
  count(*) FILTER (status = 'rejected') / count(*)::DOUBLE AS rejection_rate FROM trade_rows
""", "total_commission:2 total_slippage:2 execution_rate cancellation_rate rejection_rate")


def limit_input(t):
    held = t.bars_d.groupBy("symbol").agg(F.max_by("close", "date").alias("position_value"))
    return t.trades.select(*KEY, "quantity", (c("price") / 200).alias("price")).join(held, "symbol")


register("trade_limits", lambda t: k.trade_limits(limit_input(t), 100000.0, 0.005, 12).drop("quantity", "price", "position_value"), f"""
SELECT *, NOT (below_min_size OR above_max_size OR single_risk_exceeded OR concentration_exceeded OR portfolio_risk_exceeded) AS accepted FROM (
SELECT {KS}, v AS trade_value, (pv + v) / 100000 AS position_share, (v / 100000 + 0.005) * 0.5::DOUBLE AS adjusted_risk,
  (v / 100000 + 0.005) * 0.5::DOUBLE / 0.02 AS risk_utilization, floor(v * 1e6 + 0.5) / 1e6 < 100 AS below_min_size, floor(v * 1e6 + 0.5) / 1e6 > 10000 AS above_max_size,
  floor(v / 100000 * 1e9 + 0.5) / 1e9 > 0.02 AS single_risk_exceeded, floor((pv + v) / 100000 * 1e9 + 0.5) / 1e9 > 0.1 AS concentration_exceeded,
  floor((v / 100000 + 0.005) * 0.5 * 1e9 + 0.5) / 1e9 > 0.02 AS portfolio_risk_exceeded
FROM (SELECT {', '.join('t.' + x for x in KEY)}, quantity * (price / 200) AS v, pv FROM trades t JOIN (SELECT symbol, arg_max(close, date) AS pv FROM bars_d GROUP BY 1) h ON h.symbol = t.symbol))
""", "trade_value position_share adjusted_risk risk_utilization")
cte("trade_seq", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, order_id, line, part_id) AS n FROM trades")
register("positions_mark", lambda t: k.positions_mark(t.trades), f"""
SELECT m.symbol, s.date, s.order_id, s.line, s.part_id, s.signal_type, s.quantity, s.price, m.status, m.q AS position_quantity, m.a AS average_price, m.gain AS trade_pnl, m.r AS realized_pnl,
  m.q * s.price AS market_value, (s.price - m.a) * m.q AS unrealized_pnl, (s.price - m.a) * m.q + m.r AS total_pnl
FROM walk m JOIN trade_seq s ON s.symbol = m.symbol AND s.n = m.n WHERE m.n > 0
""", "average_price:4 trade_pnl:2 realized_pnl:1 market_value:2 unrealized_pnl:2 total_pnl:1")
cte("walk", """
WITH RECURSIVE w AS (
  SELECT DISTINCT symbol, 0::BIGINT AS n, 0.0::DOUBLE AS q, 0.0::DOUBLE AS a, NULL::DOUBLE AS gain, 0.0::DOUBLE AS r, '' AS status FROM trades
  UNION ALL
  SELECT w.symbol, s.n, CASE WHEN s.signal_type = 'buy' THEN w.q + s.quantity WHEN s.signal_type = 'sell' AND s.quantity <= w.q THEN w.q - s.quantity ELSE w.q END,
    CASE WHEN s.signal_type = 'buy' THEN (w.q * w.a + s.quantity * s.price) / (w.q + s.quantity)
         WHEN s.signal_type = 'sell' AND s.quantity = w.q THEN 0.0 ELSE w.a END,
    CASE WHEN s.signal_type = 'sell' AND s.quantity <= w.q THEN s.quantity * s.price - s.quantity * w.a - s.commission - s.slippage END,
    w.r + CASE WHEN s.signal_type = 'sell' AND s.quantity <= w.q THEN s.quantity * s.price - s.quantity * w.a - s.commission - s.slippage ELSE 0.0 END,
    CASE WHEN s.signal_type = 'buy' OR (s.signal_type = 'sell' AND s.quantity <= w.q) THEN 'executed' ELSE 'rejected' END
  FROM w JOIN trade_seq s ON s.symbol = w.symbol AND s.n = w.n + 1)
SELECT * FROM w
""")
register("portfolio_value", lambda t: k.portfolio_value(t.bars_d.select("symbol", "date", (c("close") * 10).alias("market_value")), 100000.0), """
SELECT date, count(*) AS num_positions, sum(close * 10) AS positions_value, sum(close * 10) + 100000 AS total_value FROM bars_d GROUP BY 1
""", "positions_value:3 total_value:3")
register("exit_scan", lambda t: k.exit_scan(t.bars_landed, t.bars_landed.groupBy("symbol", F.trunc("date", "quarter").alias("q")).agg(
    F.min_by(F.struct("date", "close"), "date").alias("e")).select("symbol", "e.*")), """
SELECT e.symbol, e.date AS entry_date, e.close AS entry_price, x.date AS exit_date, x.close AS exit_price, x.reason AS exit_reason, CAST(x.date - e.date AS INTEGER) AS holding_days
FROM entry_points e LEFT JOIN (
  SELECT symbol, entry_date, arg_min(date, date) AS date, arg_min(close, date) AS close, arg_min(reason, date) AS reason FROM (
   SELECT b.symbol, e.date AS entry_date, b.date, b.close, CASE WHEN floor((b.close - e.close * 0.95) * 1e9 + 0.5) <= 0 THEN 'STOP_LOSS'
     WHEN floor((b.close - e.close * 1.1) * 1e9 + 0.5) >= 0 THEN 'TAKE_PROFIT' WHEN floor((b.close - e.close * 1.05 * 0.95) * 1e9 + 0.5) <= 0 THEN 'TRAILING_STOP' END AS reason
   FROM bars_w b JOIN entry_points e ON b.symbol = e.symbol AND b.date > e.date AND b.date < coalesce(e.nxt, DATE '9999-01-01')) WHERE reason IS NOT NULL GROUP BY 1, 2) x
  ON x.symbol = e.symbol AND x.entry_date = e.date
""")
cte("entry_points", """
SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM (
  SELECT symbol, min(date) AS date, arg_min(close, date) AS close FROM bars_w GROUP BY symbol, date_trunc('quarter', date))
""")
register("tick_stats", lambda t: k.tick_stats(t.ticks), """
SELECT symbol, count(*) AS ticks, avg(ask - bid) AS avg_spread, avg((ask + bid) / 2) AS avg_mid, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1
""", "avg_spread avg_mid")

# -- performance ------------------------------------------------------------------------
cte("curve", """
SELECT *, (peak - total_value) / NULLIF(peak, 0) AS drawdown FROM (SELECT *, max(total_value) OVER (ORDER BY date) AS peak FROM returns)
""")
register("equity_returns", lambda t: pf.equity_returns(t.equity), "SELECT date, total_value, ret AS return FROM returns", "return")
register("drawdown_curve", lambda t: pf.drawdown_curve(t.equity), "SELECT date, total_value, peak, drawdown FROM curve", "drawdown")
cte("ret_metrics", """
SELECT arg_max(total_value, date) / arg_min(total_value, date) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS volatility,
  avg(ret - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio, avg(ret - 0.02 / 252) / NULLIF(stddev_samp(ret) FILTER (ret < 0), 0) * sqrt(252) AS sortino_ratio,
  max(drawdown) AS max_drawdown, avg(drawdown) AS avg_drawdown, any_value(v95) AS var_95, avg(ret) FILTER (ret <= v95) AS cvar_95, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis,
  pow(product(1 + ret), 1 / (date_diff('day', min(date), max(date)) / 365.25)) - 1 AS annualized_return,
  coalesce((arg_max(total_value, date) / arg_min(total_value, date) - 1) / NULLIF(abs(max(drawdown)), 0), 0) AS calmar_ratio
FROM curve, (SELECT quantile_cont(ret, 0.05) AS v95 FROM returns)
""")
RM = "total_return volatility sharpe_ratio sortino_ratio max_drawdown avg_drawdown var_95 cvar_95 skewness kurtosis annualized_return calmar_ratio"
register("returns_metrics", lambda t: pf.returns_metrics(t.equity), "SELECT * FROM ret_metrics", RM)
cte("risk_row", """
SELECT any_value(v95) AS var_95, any_value(v99) AS var_99, avg(ret) FILTER (ret <= v95) AS cvar_95, avg(ret) FILTER (ret <= v99) AS cvar_99,
  coalesce(stddev_samp(ret) FILTER (ret < 0), 0) AS downside_deviation, max(drawdown) AS max_drawdown
FROM curve, (SELECT quantile_cont(ret, 0.05) AS v95, quantile_cont(ret, 0.01) AS v99 FROM returns)
""")
register("risk_metrics", lambda t: pf.risk_metrics(t.equity), "SELECT * FROM risk_row", "var_95 var_99 cvar_95 cvar_99 downside_deviation max_drawdown")
register("standard_metrics", lambda t: pf.standard_metrics(t.equity), """
SELECT arg_max(total_value, date) / 100000 - 1 AS total_return, avg(ret) * 252 AS annualized_return, stddev_pop(ret) * sqrt(252) AS volatility,
  coalesce(avg(ret) * 252 / NULLIF(stddev_pop(ret) * sqrt(252), 0), 0) AS sharpe_ratio, max(drawdown) AS max_drawdown, arg_max(total_value, date) AS final_portfolio_value FROM curve
""", "total_return annualized_return volatility sharpe_ratio max_drawdown")
cte("month_rows", "SELECT strftime(date, '%Y-%m') AS month, product(1 + ret) - 1 AS return, count(*) AS days FROM returns WHERE ret IS NOT NULL GROUP BY 1")
register("monthly_returns", lambda t: pf.monthly_returns(t.equity), "SELECT * FROM month_rows", "return")


def market_returns(t):
    from tidemark.operators.breadth import price_change
    return price_change(t.bars_w).groupBy("date").agg(F.median("price_change_pct").alias("market_return"))


register("beta_corr", lambda t: pf.beta_corr(pf.equity_returns(t.equity), market_returns(t)), f"""
SELECT regr_slope(ret, mr) AS beta, corr(ret, mr) AS market_correlation, count(*) AS observations FROM returns JOIN (
  SELECT date, median(chg) AS mr FROM (SELECT date, {pct('close')} AS chg FROM bars_w) GROUP BY 1) USING (date) WHERE ret IS NOT NULL AND mr IS NOT NULL
""", "beta market_correlation")
register("recovery_time", lambda t: pf.recovery_time(t.equity), """
SELECT min(date) AS start_date, arg_max(date, row(d9, -n)) AS trough_date, max(drawdown) AS depth,
  CAST(CASE WHEN max(n) < any_value(total) THEN max(n) + 1 - arg_max(n, row(d9, -n)) END AS INTEGER) AS recovery_rows
FROM (SELECT *, n - row_number() OVER (ORDER BY n) AS isl FROM (
  SELECT *, floor(drawdown * 1e9 + 0.5) / 1e9 AS d9, (SELECT max(n) FROM curve) AS total FROM curve) WHERE d9 > 0) GROUP BY isl
""", "depth")
cte("trade_stats", """
SELECT count(*) AS total_trades, count(*) FILTER (realized_pnl > 0) AS winning_trades, count(*) FILTER (realized_pnl < 0) AS losing_trades,
  count(*) FILTER (realized_pnl > 0) / count(*)::DOUBLE AS win_rate, sum(realized_pnl) AS total_pnl, avg(realized_pnl) AS avg_pnl,
  avg(realized_pnl) FILTER (realized_pnl > 0) AS avg_win, avg(realized_pnl) FILTER (realized_pnl < 0) AS avg_loss,
  abs(sum(realized_pnl) FILTER (realized_pnl > 0) / sum(realized_pnl) FILTER (realized_pnl < 0)) AS profit_factor, max(realized_pnl) AS largest_win, min(realized_pnl) AS largest_loss,
  avg(CAST(quantity AS INTEGER) % 7) AS avg_trade_duration FROM trades
""")


def dated(t):
    return t.trades.withColumns({"entry_date": c("date"), "exit_date": F.date_add("date", c("quantity").cast("int") % 7)})


register("trade_metrics", lambda t: pf.trade_metrics(dated(t)), "SELECT * FROM trade_stats", "win_rate total_pnl:3 avg_pnl avg_win avg_loss profit_factor avg_trade_duration")
register("symbol_performance", lambda t: pf.symbol_performance(t.trades), """
SELECT symbol, count(*) AS total_trades, sum(realized_pnl) AS total_pnl, avg(realized_pnl) AS avg_pnl, count(*) FILTER (realized_pnl > 0) / count(*)::DOUBLE AS win_rate,
  max(realized_pnl) AS max_win, min(realized_pnl) AS max_loss FROM trades GROUP BY 1
""", "total_pnl:4 avg_pnl win_rate")
register("streaks", lambda t: pf.streaks(t.trades), """
SELECT symbol, coalesce(max(len) FILTER (sgn = 1), 0) AS consecutive_wins, coalesce(max(len) FILTER (sgn = -1), 0) AS consecutive_losses FROM (
  SELECT symbol, sgn, isl, count(*) AS len FROM (
   SELECT symbol, n, sign(realized_pnl) AS sgn, n - row_number() OVER (PARTITION BY symbol, sign(realized_pnl) ORDER BY n) AS isl FROM trade_seq) GROUP BY 1, 2, 3) GROUP BY 1
""")


def tall(rel: str, section: str, names: str, label: str = "") -> str:
    pre = f"{label} || ':' || " if label else ""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {pre}'{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {rel}" for n in names.split())


register("performance_report", lambda t: pf.performance_report(t.equity, dated(t)), " UNION ALL ".join([
    tall("ret_metrics", "returns", RM), tall("risk_row", "risk", "var_95 var_99 cvar_95 cvar_99 downside_deviation max_drawdown"),
    tall("trade_stats", "trades", "total_trades winning_trades losing_trades win_rate total_pnl avg_pnl avg_win avg_loss profit_factor largest_win largest_loss avg_trade_duration"),
    tall("curve", "curve", "total_value drawdown", "CAST(date AS VARCHAR)"), tall("month_rows", "months", "return days", "month")]), "value:4")

# -- portfolio risk --------------------------------------------------------------------------
cte("ret252", f"""
SELECT symbol, date, ret AS return FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM (
  SELECT symbol, date, {pct('close')} AS ret FROM bars_w) WHERE ret IS NOT NULL) WHERE rn <= 252
""")
cte("wts", "SELECT symbol, sum(volume) / (SELECT sum(volume) FROM bars_w)::DOUBLE AS weight FROM bars_w GROUP BY 1")
cte("port", "SELECT date, sum(weight * return) AS pr FROM ret252 JOIN wts USING (symbol) GROUP BY 1")
Z, E = Z_SCORES[0.95], ES_FACTORS[0.95]
cte("var_row", f"SELECT stddev_samp(pr) AS volatility, abs(stddev_samp(pr) * {Z}) AS portfolio_var, abs(stddev_samp(pr) * {E}) AS expected_shortfall, count(*) AS observations FROM port")


def weights(t):
    per = t.bars_landed.groupBy("symbol").agg(F.sum("volume").alias("v"))
    total = t.bars_landed.agg(F.sum("volume")).scalar()
    return per.select("symbol", (c("v") / total).alias("weight"))


register("return_window", lambda t: pf.return_window(t.bars_w), "SELECT * FROM ret252", "return")
register("var_parametric", lambda t: pf.var_parametric(pf.return_window(t.bars_landed), weights(t)), "SELECT * FROM var_row", "volatility portfolio_var expected_shortfall")
register("position_var", lambda t: pf.position_var(pf.return_window(t.bars_landed), weights(t)), f"""
SELECT symbol, weight, volatility, abs(weight * volatility * {Z}) AS position_var FROM wts JOIN (SELECT symbol, stddev_samp(return) AS volatility FROM ret252 GROUP BY 1) USING (symbol)
""", "weight volatility position_var")
register("var_historical", lambda t: pf.var_historical(pf.return_window(t.bars_landed), weights(t)), "SELECT abs(quantile_cont(pr, 0.05)) AS historical_var FROM port", "historical_var")
register("var_stress", lambda t: pf.var_stress(pf.var_parametric(pf.return_window(t.bars_landed), weights(t))), """
SELECT scenario, multiplier, portfolio_var * multiplier AS stress_var FROM var_row,
 (VALUES ('market_crash', 2.0::DOUBLE), ('volatility_spike', 1.5::DOUBLE), ('correlation_breakdown', 1.3::DOUBLE)) s(scenario, multiplier)
""", "stress_var")


def var_trades(t):
    return t.bars_w.select("symbol", "date", (c("volume") / 10000).alias("quantity"), (c("close") / 10000).alias("price"))


register("var_limit_flags", lambda t: pf.var_limit_flags(
    var_trades(t), pf.return_window(t.bars_landed).groupBy("symbol").agg((F.stddev_samp("return") / 1000).alias("volatility")),
    pf.var_parametric(pf.return_window(t.bars_landed), weights(t)).select(
        (c("portfolio_var") / 1000).alias("portfolio_var"), (c("expected_shortfall") / 1000).alias("expected_shortfall")), 1000.0), f"""
SELECT *, floor(new_var * 1e9 + 0.5) / 1e9 > 0.02 AS var_exceeded, floor(new_es * 1e9 + 0.5) / 1e9 > 0.03 AS es_exceeded, floor(stress_var * 1e9 + 0.5) / 1e9 > 0.04 AS stress_exceeded FROM (
SELECT b.symbol, date, volume / 10000.0::DOUBLE AS quantity, close / 10000 AS price, v.volatility, volume / 10000.0::DOUBLE * (close / 10000) / 1000 AS trade_weight,
  pvar / 1000 + volume / 10000.0::DOUBLE * (close / 10000) / 1000 * v.volatility * {Z} * 0.5 AS new_var, es / 1000 + volume / 10000.0::DOUBLE * (close / 10000) / 1000 * v.volatility * {E} * 0.5 AS new_es,
  pvar / 1000 * 2.0 AS stress_var
FROM bars_w b LEFT JOIN (SELECT symbol, stddev_samp(return) / 1000 AS volatility FROM ret252 GROUP BY 1) v ON v.symbol = b.symbol, (SELECT portfolio_var AS pvar, expected_shortfall AS es FROM var_row))
""", "price volatility trade_weight new_var new_es stress_var")
register("diversification", lambda t: pf.diversification(
    t.bars_w.groupBy("symbol").agg(F.max_by("close", "date").alias("market_value")), 1000000.0), """
SELECT count(*) AS num_positions, greatest(1 / sqrt(count(*)), 0.5) AS diversification_factor, sum(abs(mv)) / 1000000 * greatest(1 / sqrt(count(*)), 0.5) AS portfolio_risk
FROM (SELECT symbol, arg_max(close, date) AS mv FROM bars_w GROUP BY 1)
""", "diversification_factor portfolio_risk")
