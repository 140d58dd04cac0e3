"""Sentiment indicators as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, flag, mean_of, minmax, snap
from tidemark.plans.series import BARS, Series

c = F.col


def _or(x: Column, default: float) -> Column:
    return F.coalesce(x, F.lit(default))


def social(pos: Column, neg: Column) -> Column:
    return _or(div(pos - neg, pos + neg), 0.0)


def analyst(buy: Column, hold: Column, sell: Column) -> Column:
    return _or(div(buy + hold * 0.5, buy + hold + sell), 0.5)


def insider(buy: Column, sell: Column, volume: Column | None = None) -> Column:
    total = buy + sell
    ratio = _or(div(buy - sell, total), 0.0)
    return ratio if volume is None else ratio * div(total, volume)


def put_call(put: Column, call: Column) -> Column:
    return _or(div(put, call), 1.0)


def options_flow(
    call: Column, put: Column, call_premium: Column | None = None, put_premium: Column | None = None
) -> Column:
    volume = div(1, put_call(put, call))
    if call_premium is None or put_premium is None:
        return volume
    return volume + div(call_premium - put_premium, call_premium + put_premium)


def short_interest(short: Column, outstanding: Column | None = None, avg_volume: Column | None = None) -> Column:
    ratio = short if outstanding is None else div(short, outstanding)
    return ratio if avg_volume is None else ratio * _or(div(short, avg_volume), 0.0)


def news(score: Column, count: Column, s: Series = BARS) -> Column:
    """Score weighted by the day's place in the symbol's news-count range."""
    return score * minmax(count, s)


def fear_greed(df: DataFrame, s: Series = BARS) -> Column:
    """Mean of the min-max parts whose columns are present."""
    have = set(df.columns)
    parts = []
    for name, inverted in (("volatility", True), ("momentum", False), ("volume", False), ("put_call_ratio", True)):
        if name in have:
            x = minmax(c(name), s)
            parts.append(1 - x if inverted else x)
    return mean_of(*parts) if parts else F.lit(None).cast("double")


def label_value(label: Column) -> Column:
    """Text label or number as a score; unknown text counts as neutral."""
    low = F.lower(label)
    return (
        F.when(low == "positive", 1.0).when(low == "negative", -1.0).when(low == "neutral", 0.0)
        .otherwise(F.coalesce(label.try_cast("double"), F.lit(0.0)))
    )


def label_mean(items: DataFrame) -> DataFrame:
    return items.filter(c("sentiment").isNotNull()).groupBy("symbol", "date").agg(
        F.avg(label_value(c("sentiment"))).alias("sentiment_mean"),
        F.count(F.lit(1)).alias("items"),
    )


#: name -> (columns needed, builder): the extension point for named indicators.
INDICATORS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "social_sentiment": (("positive_mentions", "negative_mentions"), social),
    "analyst_rating": (("buy_ratings", "hold_ratings", "sell_ratings"), analyst),
    "insider_trading": (("insider_buy_volume", "insider_sell_volume", "volume"), insider),
    "options_flow": (("call_volume", "put_volume"), options_flow),
    "put_call_ratio": (("put_volume", "call_volume"), put_call),
    "short_interest": (("short_interest", "shares_outstanding", "avg_volume"), short_interest),
    "news_sentiment": (("sentiment_score", "news_count"), news),
}


def dispatch(df: DataFrame, names: list[str]) -> DataFrame:
    """Add named indicators in one projection; absent inputs give NULL."""
    have, out = set(df.columns), {}
    for name in names:
        if name not in INDICATORS:
            raise ValueError(f"unknown indicator {name}")
        needs, build = INDICATORS[name]
        out[name] = build(*[c(x) for x in needs]) if set(needs) <= have else F.lit(None).cast("double")
    return df.withColumns(out)


def sentiment_score(df: DataFrame, names: list[str], weights: dict[str, float] | None = None, s: Series = BARS) -> Column:
    weights = weights or {}
    present = [n for n in names if n in df.columns]
    total = sum(weights.get(n, 1.0) for n in present)
    score = F.lit(0.0)
    for n in present:
        score = score + (minmax(c(n), s) * 2 - 1) * weights.get(n, 1.0)
    return score / total if total else score


def sentiment_signals(df: DataFrame, names: list[str], s: Series = BARS, bull: float = 0.3, bear: float = -0.3) -> DataFrame:
    scored = df.withColumn("sentiment_score_total", sentiment_score(df, names, None, s))
    x = snap(c("sentiment_score_total"))
    return scored.withColumns({
        "sentiment_bullish": flag(x > bull),
        "sentiment_bearish": flag(x < bear),
        "sentiment_neutral": flag((x >= bear) & (x <= bull)),
    })
