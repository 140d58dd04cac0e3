"""Return, drawdown, trade and risk statistics.

Equity tables hold one row per date (bounded by the calendar), so their
windows run unpartitioned on purpose; trade tables are only ever grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import corr, div, pct_change, snap
from tidemark.operators.costing import TRADES_SERIES, diversification_factor
from tidemark.params import ES_FACTORS, STRESS, TRADING, Z_SCORES, Trading
from tidemark.plans.islands import islands, run_lengths
from tidemark.plans.series import BARS, DAILY, Series

c = F.col


def equity_returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("return", pct_change(c("total_value"), 1, DAILY))


def drawdown_curve(equity: DataFrame) -> DataFrame:
    peak = F.max("total_value").over(DAILY.running)
    return equity.withColumn("peak", peak).withColumn("drawdown", div(c("peak") - c("total_value"), c("peak")))


def _skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (F.kurtosis(x) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _with_tails(equity: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Returns and drawdowns with the requested return quantiles beside them."""
    df = drawdown_curve(equity_returns(equity))
    return df.withColumns({n: F.percentile("return", F.lit(q)).over(DAILY.whole) for n, q in probs.items()})


def returns_metrics(equity: DataFrame, p: Trading = TRADING) -> DataFrame:
    r, year = c("return"), math.sqrt(p.trading_days)
    df = _with_tails(equity, {"_var95": 0.05})
    down = F.stddev_samp(F.when(r < 0, r))
    first, last = F.min_by("total_value", "date"), F.max_by("total_value", "date")
    agg = df.agg(
        (div(last, first) - 1).alias("total_return"),
        F.exp(F.sum(F.log1p(r))).alias("_growth"),
        (F.date_diff(F.max("date"), F.min("date")) / 365.25).alias("_years"),
        (F.stddev_samp(r) * year).alias("volatility"),
        (div(F.avg(r - p.risk_free / p.trading_days), F.stddev_samp(r)) * year).alias("sharpe_ratio"),
        (div(F.avg(r - p.risk_free / p.trading_days), down) * year).alias("sortino_ratio"),
        F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown"),
        F.first("_var95").alias("var_95"), F.avg(F.when(r <= c("_var95"), r)).alias("cvar_95"),
        _skew("return").alias("skewness"), _kurt("return").alias("kurtosis"),
    )
    annual = F.when(c("_years") > 0, F.pow(c("_growth"), div(1, c("_years"))) - 1)
    return agg.withColumns({
        "annualized_return": F.coalesce(annual, F.lit(0.0)),
        "calmar_ratio": F.coalesce(div(c("total_return"), F.abs("max_drawdown")), F.lit(0.0)),
    }).drop("_growth", "_years")


def risk_metrics(equity: DataFrame) -> DataFrame:
    r = c("return")
    df = _with_tails(equity, {"_v95": 0.05, "_v99": 0.01})
    return df.agg(
        F.first("_v95").alias("var_95"), F.first("_v99").alias("var_99"),
        F.avg(F.when(r <= c("_v95"), r)).alias("cvar_95"), F.avg(F.when(r <= c("_v99"), r)).alias("cvar_99"),
        F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)).alias("downside_deviation"),
        F.max("drawdown").alias("max_drawdown"),
    )


def standard_metrics(equity: DataFrame, p: Trading = TRADING) -> DataFrame:
    r = c("return")
    df = drawdown_curve(equity_returns(equity))
    return df.agg(
        (F.max_by("total_value", "date") / p.initial_capital - 1).alias("total_return"),
        (F.avg(r) * p.trading_days).alias("annualized_return"),
        (F.stddev_pop(r) * math.sqrt(p.trading_days)).alias("volatility"),
        F.coalesce(
            div(F.avg(r) * p.trading_days, F.stddev_pop(r) * math.sqrt(p.trading_days)), F.lit(0.0)
        ).alias("sharpe_ratio"),
        F.max("drawdown").alias("max_drawdown"),
        F.max_by("total_value", "date").alias("final_portfolio_value"),
    )


def monthly_returns(equity: DataFrame) -> DataFrame:
    return equity_returns(equity).filter(c("return").isNotNull()).groupBy(
        F.date_format("date", "yyyy-MM").alias("month")
    ).agg(
        (F.exp(F.sum(F.log1p("return"))) - 1).alias("return"), F.count(F.lit(1)).alias("days")
    )


def beta_corr(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Slope and correlation of ``return`` on the benchmark's ``market_return``."""
    both = returns.join(benchmark, "date").filter("return IS NOT NULL AND market_return IS NOT NULL")
    return both.agg(
        F.regr_slope("return", "market_return").alias("beta"),
        corr("return", "market_return").alias("market_correlation"), F.count(F.lit(1)).alias("observations"),
    )


def recovery_time(equity: DataFrame) -> DataFrame:
    """Every spell under water: its trough and the rows back to a new peak."""
    df = drawdown_curve(equity).withColumn("_row", F.row_number().over(DAILY.ordered))
    under = islands(df, snap(c("drawdown")) > 0, DAILY)
    last = F.max("_row").over(DAILY.whole)
    spells = under.withColumn("_last", last).filter("_flag").groupBy("_island").agg(
        F.min("date").alias("start_date"), F.max("drawdown").alias("depth"),
        F.max_by(F.struct("date", "_row"), F.struct(snap(c("drawdown")), -c("_row"))).alias("_trough"),
        F.max("_row").alias("_end"), F.first("_last").alias("_last"),
    )
    return spells.select(
        "start_date", c("_trough.date").alias("trough_date"), "depth",
        F.when(c("_end") < c("_last"), c("_end") + 1 - c("_trough._row")).alias("recovery_rows"),
    )


# -- trades -----------------------------------------------------------------------
def trade_metrics(trades: DataFrame) -> DataFrame:
    pnl, n = c("realized_pnl"), F.count(F.lit(1))
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    extra = []
    if {"entry_date", "exit_date"} <= set(trades.columns):
        extra.append(F.avg(F.date_diff("exit_date", "entry_date")).alias("avg_trade_duration"))
    return trades.agg(
        n.alias("total_trades"), F.count(win).alias("winning_trades"), F.count(loss).alias("losing_trades"),
        F.coalesce(div(F.count(win), n), F.lit(0.0)).alias("win_rate"),
        F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.abs(div(F.sum(win), F.sum(loss))).alias("profit_factor"),
        F.max(pnl).alias("largest_win"), F.min(pnl).alias("largest_loss"), *extra,
    )


def symbol_performance(trades: DataFrame) -> DataFrame:
    pnl = c("realized_pnl")
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"),
        div(F.count_if(pnl > 0), F.count(F.lit(1))).alias("win_rate"),
        F.max(pnl).alias("max_win"), F.min(pnl).alias("max_loss"),
    )


def streaks(trades: DataFrame, s: Series = TRADES_SERIES) -> DataFrame:
    """Longest winning and losing run of each symbol's trades."""
    sign = F.when(c("realized_pnl") > 0, "win").when(c("realized_pnl") < 0, "loss").otherwise("flat")
    runs = run_lengths(trades, sign, s)
    return runs.groupBy(*s.keys).agg(
        F.coalesce(F.max(F.when(c("_flag") == "win", c("_n"))), F.lit(0)).alias("consecutive_wins"),
        F.coalesce(F.max(F.when(c("_flag") == "loss", c("_n"))), F.lit(0)).alias("consecutive_losses"),
    )


def performance_report(equity: DataFrame, trades: DataFrame) -> DataFrame:
    """All statistics as one tall ``(section, metric, value)`` table."""

    def tall(df: DataFrame, section: str, label: str | None = None) -> DataFrame:
        names = [n for n, t in df.dtypes if n != label and t != "string"]
        pairs = F.explode(F.array(*[
            F.struct(F.lit(n).alias("metric"), c(n).cast("double").alias("value")) for n in names
        ]))
        name = c("x.metric") if label is None else F.concat_ws(":", c(label).cast("string"), c("x.metric"))
        keep = [] if label is None else [label]
        return df.select(*keep, pairs.alias("x")).select(
            F.lit(section).alias("section"), name.alias("metric"), c("x.value").alias("value")
        )

    curve = drawdown_curve(equity).select("date", "total_value", "drawdown")
    parts = [
        tall(returns_metrics(equity), "returns"), tall(risk_metrics(equity), "risk"),
        tall(trade_metrics(trades), "trades"), tall(curve, "curve", "date"),
        tall(monthly_returns(equity), "months", "month"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# -- portfolio risk -------------------------------------------------------------------
def return_window(bars: DataFrame, rows: int = 252, s: Series = BARS) -> DataFrame:
    """The latest returns of each symbol (rank limit pushed below the shuffle)."""
    back = s.whole.orderBy(c("date").desc())
    r = bars.withColumn("return", pct_change(c("close"), 1, s)).filter(c("return").isNotNull())
    return r.withColumn("_n", F.row_number().over(back)).filter(c("_n") <= rows).select("symbol", "date", "return")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of returns by date: w'Cw is its variance, without pairs."""
    return returns.join(weights.select("symbol", "weight"), "symbol").groupBy("date").agg(
        F.sum(c("weight") * c("return")).alias("portfolio_return")
    )


def var_parametric(returns: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    z, es = Z_SCORES[level], ES_FACTORS[level]
    sigma = F.stddev_samp("portfolio_return")
    return portfolio_returns(returns, weights).agg(
        sigma.alias("volatility"), F.abs(sigma * z).alias("portfolio_var"),
        F.abs(sigma * es).alias("expected_shortfall"), F.count(F.lit(1)).alias("observations"),
    )


def position_var(returns: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    vol = returns.groupBy("symbol").agg(F.stddev_samp("return").alias("volatility"))
    return vol.join(weights, "symbol").withColumn(
        "position_var", F.abs(c("weight") * c("volatility") * Z_SCORES[level])
    ).select("symbol", "weight", "volatility", "position_var")


def var_historical(returns: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    q = F.percentile("portfolio_return", F.lit(1 - level))
    return portfolio_returns(returns, weights).agg(F.abs(q).alias("historical_var"))


def var_stress(var: DataFrame) -> DataFrame:
    """The base figure under each fixed scenario."""
    scenarios = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(m).alias("multiplier")) for k, m in STRESS.items()])
    return var.select("portfolio_var", F.explode(scenarios).alias("s")).select(
        "s.*", (c("portfolio_var") * c("s.multiplier")).alias("stress_var")
    )


def var_limit_flags(
    trades: DataFrame, volatility: DataFrame, var: DataFrame, portfolio_value: float, level: float = 0.95,
    max_var: float = 0.02, max_es: float = 0.03,
) -> DataFrame:
    """Does a trade push VaR, shortfall or stressed VaR over its limit?

    ``var`` is the one-row portfolio figure, read as a scalar subquery.
    """
    base = var.select("portfolio_var").scalar()
    tail = var.select("expected_shortfall").scalar()
    share = c("quantity") * c("price") / portfolio_value
    out = trades.join(volatility, "symbol", "left").withColumn("trade_weight", share)
    risk = c("trade_weight") * c("volatility")
    worst = max(STRESS.values())
    out = out.withColumns({
        "new_var": base + risk * Z_SCORES[level] * 0.5,
        "new_es": tail + risk * ES_FACTORS[level] * 0.5,
        "stress_var": base * worst,
    })
    return out.withColumns({
        "var_exceeded": snap(c("new_var")) > max_var,
        "es_exceeded": snap(c("new_es")) > max_es,
        "stress_exceeded": snap(c("stress_var")) > max_var * 2,
    })


def diversification(positions: DataFrame, portfolio_value: float) -> DataFrame:
    n = F.count(F.lit(1))
    factor = diversification_factor(n)
    return positions.agg(
        n.alias("num_positions"), factor.alias("diversification_factor"),
        (F.sum(F.abs("market_value")) / portfolio_value * factor).alias("portfolio_risk"),
    )
