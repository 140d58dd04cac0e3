"""Execution price, cost, size and limits of trades, as table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, snap
from tidemark.operators.positions import positions_mark as positions_mark
from tidemark.params import TRADING, Trading
from tidemark.plans.series import Series

c = F.col
SIDES = ("buy", "sell", "short", "cover")


def is_buyer(side: Column) -> Column:
    return side.isin("buy", "cover")


def exec_price(
    side: Column, price: Column, kind: str = "market", limit: Column | None = None,
    stop: Column | None = None, p: Trading = TRADING,
) -> Column:
    """Fill price of an order; NULL when a stop order is not triggered."""
    slip = p.slippage_rate * p.slippage_scale
    if kind == "market":
        return F.when(is_buyer(side), price * (1 + slip)).otherwise(price * (1 - slip))
    if kind == "limit":
        at = price if limit is None else limit
        return F.when(is_buyer(side), F.least(at, price * (1 - p.limit_edge))).otherwise(
            F.greatest(at, price * (1 + p.limit_edge))
        )
    if kind == "stop" and p.supports_stop:
        at = price if stop is None else stop
        falls = side.isin("sell", "cover")
        return F.when(falls & (price <= at), at * (1 - slip)).when(~falls & (price >= at), at * (1 + slip))
    return price


def exec_impact(side: Column, price: Column, quantity: Column, p: Trading = TRADING) -> Column:
    """Linear market impact, then price improvement."""
    factor = quantity * p.market_impact / p.impact_unit + 1
    moved = F.when(is_buyer(side), price * factor).otherwise(div(price, factor))
    better = F.when(is_buyer(side), 1 - p.price_improvement).otherwise(1 + p.price_improvement)
    return moved * better


def commission(value: Column, p: Trading = TRADING) -> Column:
    return F.greatest(value * (p.commission_rate * p.commission_scale), F.lit(p.min_commission))


def slippage_cost(value: Column, p: Trading = TRADING) -> Column:
    return value * (p.slippage_rate * p.slippage_scale)


def position_size(confidence: Column, method: str = "fixed", p: Trading = TRADING) -> Column:
    if method == "kelly":
        edge = (confidence * p.kelly_win - (1 - confidence) * p.kelly_loss) / p.kelly_win
        size = F.greatest(F.lit(0.0), F.least(edge, F.lit(p.kelly_cap))) * p.initial_capital
    else:
        size = F.lit(p.initial_capital * p.fixed_fraction)
    return F.greatest(F.lit(p.min_trade_size), F.least(size, F.lit(p.max_trade_size)))


def position_cap(
    quantity: Column, price: Column, portfolio_value: Column, symbol_limit: Column | None = None,
    p: Trading = TRADING,
) -> Column:
    """Quantity under the symbol and concentration limits; NULL if too small."""
    caps = [quantity, F.when(portfolio_value > 0, div(portfolio_value * p.max_concentration, price))]
    if symbol_limit is not None:
        caps.append(div(symbol_limit, price))
    capped = F.least(*caps)
    return F.when(snap(capped * price, 6) >= p.min_trade_size, capped)


def position_size_risk(
    method: str, portfolio_value: Column, current_risk: Column, volatility: Column | None = None,
    p: Trading = TRADING,
) -> Column:
    if method == "equal_weight":
        return portfolio_value / p.target_positions
    if method == "volatility_weight":
        vol = F.lit(p.base_volatility) if volatility is None else F.coalesce(volatility, F.lit(p.base_volatility))
        factor = F.greatest(F.lit(0.5), F.least(div(p.base_volatility, vol), F.lit(2.0)))
        return portfolio_value * p.fixed_fraction * factor
    free = F.lit(p.max_portfolio_risk) - current_risk
    return F.when(free <= 0, F.lit(0.0)).otherwise(
        portfolio_value * F.least(free, F.lit(p.risk_per_trade))
    )


def stop_levels(side: Column, entry: Column, p: Trading = TRADING) -> dict[str, Column]:
    long = is_buyer(side)
    return {
        "stop_loss": F.when(long, entry * (1 - p.stop_loss)).otherwise(entry * (1 + p.stop_loss)),
        "take_profit": F.when(long, entry * (1 + p.take_profit)).otherwise(entry * (1 - p.take_profit)),
    }


def trade_type(side: Column, position: Column) -> Column:
    """Side and held quantity to trade type; NULL for an invalid side."""
    return (
        F.when((side == "buy") & (position < 0), "cover").when(side.isin(*SIDES), side)
    )


def trade_log(signals: DataFrame, kind: str = "market", method: str = "fixed", p: Trading = TRADING) -> DataFrame:
    """Signals with ``market_price`` to costed trade rows with a status."""
    side, valid = c("signal_type"), c("signal_type").isin(*SIDES)
    size = F.when(valid, position_size(c("confidence"), method, p))
    limit = c("limit_price") if "limit_price" in signals.columns else None
    stop = c("stop_price") if "stop_price" in signals.columns else None
    raw = F.when(valid, exec_price(side, c("market_price"), kind, limit, stop, p))
    out = signals.withColumns({
        "trade_type": trade_type(side, F.lit(0)), "quantity": size, "_raw": raw,
    }).withColumn("price", exec_impact(side, c("_raw"), c("quantity"), p))
    value = c("quantity") * c("price")
    return out.withColumns({
        "total_cost": value,
        "commission": F.when(value.isNotNull(), commission(value, p)),
        "slippage": slippage_cost(value, p),
        "status": F.when(~valid, "rejected").when(c("_raw").isNull(), "cancelled").otherwise("executed"),
    }).withColumn("net_amount", c("total_cost") + c("commission") + c("slippage")).drop("_raw")


def exec_stats(trades: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    on = {k: F.count_if(c("status") == k) for k in ("executed", "cancelled", "rejected")}
    done = c("status") == "executed"
    return trades.agg(
        n.alias("total_orders"), *[v.alias(f"{k}_orders") for k, v in on.items()],
        F.sum(F.when(done, c("commission"))).alias("total_commission"),
        F.sum(F.when(done, c("slippage"))).alias("total_slippage"),
        F.coalesce(div(on["executed"], n), F.lit(0.0)).alias("execution_rate"),
        F.coalesce(div(on["cancelled"], n), F.lit(0.0)).alias("cancellation_rate"),
        F.coalesce(div(on["rejected"], n), F.lit(0.0)).alias("rejection_rate"),
    )


def diversification_factor(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(div(1, F.sqrt(n)), F.lit(0.5)))


def trade_limits(trades: DataFrame, portfolio_value: float, current_risk: float, positions: int, p: Trading = TRADING) -> DataFrame:
    """Limit flags of each trade against its symbol's position and the portfolio.

    ``position_value`` is the symbol's market value before the trade.
    """
    value = c("quantity") * c("price")
    share, held = value / portfolio_value, (c("position_value") + value) / portfolio_value
    factor = 1.0 if positions <= 1 else max(positions**-0.5, 0.5)
    risk = (share + current_risk) * factor
    flags = {
        "below_min_size": snap(value, 6) < p.min_trade_size,
        "above_max_size": snap(value, 6) > p.max_trade_size,
        "single_risk_exceeded": snap(share) > p.max_single_risk,
        "concentration_exceeded": snap(held) > p.max_position_size,
        "portfolio_risk_exceeded": snap(risk) > p.max_portfolio_risk,
    }
    bad = None
    for x in flags.values():
        bad = x if bad is None else bad | x
    return trades.withColumns({
        "trade_value": value, "position_share": held, "adjusted_risk": risk,
        "risk_utilization": risk / p.max_portfolio_risk, **flags, "accepted": ~bad,
    })


# -- positions -------------------------------------------------------------------
def portfolio_value(positions: DataFrame, cash: float) -> DataFrame:
    """Cash plus market value of the positions held, by date."""
    return positions.groupBy("date").agg(
        F.count(F.lit(1)).alias("num_positions"), F.sum("market_value").alias("positions_value")
    ).withColumn("total_value", c("positions_value") + cash)


def exit_scan(bars: DataFrame, entries: DataFrame, p: Trading = TRADING) -> DataFrame:
    """First bar after each entry that hits a stop, target or trailing level.

    A new entry replaces the open position, so each bar belongs to at most
    one entry: an as-of carry, linear in the bars, not entry x bar pairs.
    """
    from tidemark.plans.asof import neighbours

    right = entries.select("symbol", "date", c("close").alias("entry_price"))
    held = neighbours(
        bars.select("symbol", "date", "close"), right, "symbol", "date", ["entry_price"],
        slot=F.trunc("date", "year"),
    ).select(
        "symbol", "date", "close", c("_prev.date").alias("entry_date"), c("_prev.entry_price").alias("entry_price"),
    ).filter(c("entry_date").isNotNull())
    close, entry = c("close"), c("entry_price")
    reason = (
        F.when(snap(close - entry * (1 - p.stop_loss)) <= 0, "STOP_LOSS")
        .when(snap(close - entry * (1 + p.take_profit)) >= 0, "TAKE_PROFIT")
        .when(snap(close - entry * 1.05 * (1 - p.trailing)) <= 0, "TRAILING_STOP")
    )
    hit = held.withColumn("reason", F.when(c("date") > c("entry_date"), reason))
    first = F.min_by(F.struct("date", "close", "reason"), F.when(c("reason").isNotNull(), c("date")))
    out = hit.groupBy("symbol", "entry_date", "entry_price").agg(first.alias("x"))
    return out.select(
        "symbol", "entry_date", "entry_price", c("x.date").alias("exit_date"), c("x.close").alias("exit_price"),
        c("x.reason").alias("exit_reason"), F.date_diff(c("x.date"), c("entry_date")).alias("holding_days"),
    )


def tick_stats(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"), F.avg(c("ask") - c("bid")).alias("avg_spread"),
        F.avg((c("ask") + c("bid")) / 2).alias("avg_mid"), F.sum("volume").alias("volume"),
    )


TRADES_SERIES = Series(order=("date", "order_id", "line", "part_id"))
