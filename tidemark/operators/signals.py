"""Buy / sell / hold signals from indicators, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, flag, mean, mean_of, minmax, prev, snap
from tidemark.operators.indicators import LOOKBACK, sma, technical_all
from tidemark.params import SIGNALS, Signals
from tidemark.plans.series import BARS, Series, per_series, with_stats

c = F.col

BUY_VOTES = ("rsi_buy", "macd_buy", "bb_buy", "ma_buy")
SELL_VOTES = ("rsi_sell", "macd_sell", "bb_sell", "ma_sell")
RESULT = ["symbol", "date", "signal_type", "signal_strength", "confidence"]


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, [c(x) for x in columns])


def signal_type(strength: Column, cut: float = SIGNALS.type_cut) -> Column:
    x = snap(strength)
    return F.when(x > cut, "buy").when(x < -cut, "sell").otherwise("hold")


# -- technical ------------------------------------------------------------------
def tech_flags(df: DataFrame, s: Series = BARS, p: Signals = SIGNALS) -> DataFrame:
    """0/1 conditions over indicator columns; unknown counts as not met."""
    r, gap = snap(c("rsi")), snap(c("macd") - c("macd_signal"))
    close, vol_mean = c("close"), mean(c("volume"), 20, s)
    return df.withColumns({
        "rsi_buy": flag(r < p.rsi_oversold),
        "rsi_sell": flag(r > p.rsi_overbought),
        "rsi_neutral": flag((r >= p.rsi_oversold) & (r <= p.rsi_overbought)),
        "macd_buy": flag(gap > 0),
        "macd_sell": flag(gap < 0),
        "macd_crossover": flag((gap > 0) & (prev(gap, 1, s) <= 0)),
        "bb_buy": flag(snap(close - c("bb_lower")) < 0),
        "bb_sell": flag(snap(close - c("bb_upper")) > 0),
        "bb_squeeze": flag(snap(c("bb_width")) < p.squeeze_width),
        "ma_buy": flag(snap(close - c("sma")) > 0),
        "ma_sell": flag(snap(close - c("sma")) < 0),
        "volume_spike": flag(snap(c("volume") - vol_mean * p.volume_spike) > 0),
        "volume_low": flag(snap(c("volume") - vol_mean * p.volume_low) < 0),
    })


def tech_signal(
    flags: DataFrame, s: Series = BARS, p: Signals = SIGNALS, point_in_time: bool = False,
    frequency: str | None = "1day",
) -> DataFrame:
    """Net vote as strength, mean of three factors as confidence.

    Maxima are taken over the symbol's history; ``point_in_time`` restricts
    them to what was known at each bar.
    """
    hist = F.abs("macd_histogram")
    if point_in_time:
        based = flags.withColumns({"_h": F.max(hist).over(s.running), "_v": F.max("volume").over(s.running)})
    else:
        based = with_stats(flags, {"_h": F.max(hist), "_v": F.max("volume")}, s, frequency)
    buys, sells = _sum(BUY_VOTES), _sum(SELL_VOTES)
    factors = (1 - F.abs(c("rsi") - 50) / 50, div(hist, c("_h")), div(c("volume"), c("_v")))
    return based.withColumns({
        "signal_strength": F.coalesce(div(buys - sells, buys + sells), F.lit(0.0)),
        "confidence": mean_of(*factors),
    }).withColumn("signal_type", signal_type(c("signal_strength"), p.type_cut)).drop("_h", "_v")


def tech_votes(df: DataFrame, p: Signals = SIGNALS) -> DataFrame:
    r, close = snap(c("rsi")), c("close")
    return df.withColumns({
        "rsi_strategy": F.when(r < p.rsi_oversold, 1).when(r > p.rsi_overbought, -1).otherwise(0),
        "macd_strategy": F.when(snap(c("macd") - c("macd_signal")) > 0, 1).otherwise(-1),
        "bb_strategy": F.when(snap(close - c("bb_lower")) < 0, 1)
        .when(snap(close - c("bb_upper")) > 0, -1).otherwise(0),
        "ma_strategy": F.when(snap(close - c("sma")) > 0, 1).otherwise(-1),
    })


def signal_strength_count(df: DataFrame, buy: list[str], sell: list[str]) -> DataFrame:
    have = set(df.columns)
    score = F.lit(0)
    for names, step in ((buy, 1), (sell, -1)):
        for n in names:
            if n in have:
                score = score + F.when(c(n) > 0, step).otherwise(0)
    return df.withColumn("signal_strength", score.cast("double"))


def preprocess_resource(
    df: DataFrame, min_points: int, s: Series = BARS, frequency: str | None = "1day"
) -> DataFrame:
    """Drop exact duplicates and symbols with too few rows."""
    counted = with_stats(df, {"_n": F.count(F.lit(1))}, s, frequency)
    return counted.filter(c("_n") >= min_points).drop("_n").dropDuplicates()


def signal_threshold_filter(df: DataFrame, p: Signals = SIGNALS) -> DataFrame:
    return df.filter(
        (snap(F.abs("signal_strength")) >= p.signal_threshold) & (snap(c("confidence")) >= p.confidence_threshold)
    )


def signal_smoothing(df: DataFrame, s: Series = BARS) -> DataFrame:
    w = s.frame(-1, 1)
    x = c("signal_strength")
    return df.withColumn("signal_strength", F.when(F.count(x).over(w) == 3, F.avg(x).over(w)))


#: rows before a bar its technical signal depends on
TECH_LOOKBACK = LOOKBACK["technical_all"] + 1


def technical_signals(
    bars: DataFrame, s: Series = BARS, p: Signals = SIGNALS, frequency: str | None = "1day"
) -> DataFrame:
    """Indicators, flags and signal of every bar."""

    def flagged(df: DataFrame, s: Series) -> DataFrame:
        return tech_flags(sma(technical_all(df, s, p), s, p.sma_period), s, p)

    flags = per_series(bars, flagged, TECH_LOOKBACK, s=s, frequency=frequency)
    return tech_signal(flags, s, p, frequency=frequency)


def technical_pipeline(
    bars: DataFrame, s: Series = BARS, p: Signals = SIGNALS, frequency: str | None = "1day"
) -> DataFrame:
    """Checked, de-duplicated bars to thresholded signals."""
    missing = {"open", "high", "low", "close", "volume"} - set(bars.columns)
    if missing:
        raise ValueError(f"missing required columns {sorted(missing)}")
    clean = preprocess_resource(bars, p.min_data_points, s, frequency)
    return signal_threshold_filter(technical_signals(clean, s, p, frequency), p)


# -- fundamental ------------------------------------------------------------------
def fund_score(
    df: DataFrame, positive: list[str], negative: list[str], weights: dict[str, float] | None = None,
    s: Series = BARS,
) -> Column:
    """Weighted sum of min-max values, inverted for the negatives."""
    weights, score = weights or {}, F.lit(0.0)
    for names, inverted in ((positive, False), (negative, True)):
        for n in names:
            if n in df.columns:
                x = minmax(c(n), s)
                score = score + (1 - x if inverted else x) * weights.get(n, 1.0)
    return score


def valuation_rank(
    df: DataFrame, names: list[str], s: Series = BARS, under: float = 0.3, over: float = 0.7
) -> DataFrame:
    """Average percentile rank in the symbol's history, as three 0/1 flags."""
    out = df
    for n in names:
        x = c(n)
        by_value = s.whole.orderBy(x.asc_nulls_last())
        ties = F.count(F.lit(1)).over(by_value.rangeBetween(0, 0))  # peers: same sort as the rank
        rank = div(F.rank().over(by_value) + (ties - 1) / 2, F.count(x).over(s.whole))
        out = out.withColumn(f"{n}_rank", F.when(x.isNotNull(), rank))
        r = snap(c(f"{n}_rank"))
        out = out.withColumns({
            f"{n}_undervalued": flag(r < under),
            f"{n}_overvalued": flag(r > over),
            f"{n}_fair_value": flag((r >= under) & (r <= over)),
        })
    return out


def fund_signal(df: DataFrame, s: Series = BARS, p: Signals = SIGNALS) -> DataFrame:
    """Valuation, growth and profitability scores blended to a signal.

    Needs pe/pb/ps ratios, revenue/earnings growth and roe/roa columns;
    absent ones drop out of their score.
    """
    have = set(df.columns)
    val = [n for n in ("pe_ratio", "pb_ratio", "ps_ratio") if n in have]
    ranked = valuation_rank(df, val, s)
    scored = ranked.withColumns({
        "valuation_score": fund_score(
            ranked, [f"{n}_undervalued" for n in val], [f"{n}_overvalued" for n in val], None, s
        ),
        "growth_score": fund_score(ranked, ["revenue_growth", "earnings_growth"], [], None, s),
        "profitability_score": fund_score(ranked, ["roe", "roa", "gross_margin"], [], None, s),
    })
    g, r = snap(c("growth_score")), snap(c("profitability_score"))
    scored = scored.withColumns({
        "growth_buy": flag(g > 0.1), "growth_sell": flag(g < -0.1),
        "growth_neutral": flag((g >= -0.1) & (g <= 0.1)),
        "profitability_buy": flag(r > 0.15), "profitability_sell": flag(r < 0.05),
        "profitability_neutral": flag((r >= 0.05) & (r <= 0.15)),
    })
    zero = F.lit(0.0)
    blend = (
        F.coalesce(minmax(c("valuation_score"), s) * 0.3, zero)
        + F.coalesce(minmax(c("growth_score"), s) * 0.4, zero)
        + F.coalesce(minmax(c("profitability_score"), s) * 0.3, zero)
    )
    return scored.withColumn("fundamental_score", blend).withColumns({
        "signal_strength": minmax(c("fundamental_score"), s) * 2 - 1,
        "confidence": mean_of(
            F.abs(c("valuation_score") - 0.5) * 2, F.abs("growth_score"), c("profitability_score")
        ),
    }).withColumn("signal_type", signal_type(c("signal_strength"), p.type_cut))


def _vote(x: str, high: float, low: float) -> Column:
    v = snap(c(x))
    return F.when(v > high, 1).when(v < low, -1).otherwise(0)


def fund_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "valuation_strategy": _vote("valuation_score", 0.7, 0.3),
        "growth_strategy": _vote("growth_score", 0.1, -0.1),
        "profitability_strategy": _vote("profitability_score", 0.15, 0.05),
        "fundamental_strategy": _vote("fundamental_score", 0.6, 0.4),
    })


# -- fusion -----------------------------------------------------------------------
def strategy_align(results: dict[str, DataFrame]) -> DataFrame:
    """Strategies' signals as one long table keyed (symbol, date, strategy)."""
    longs = [df.select(*RESULT).withColumn("strategy", F.lit(n)) for n, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b), longs)


def _weight(weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(c("strategy") == name, value).otherwise(w)
    return w


def combine(
    aligned: DataFrame, method: str = "weighted_average", aggregation: str = "mean", p: Signals = SIGNALS
) -> DataFrame:
    """One row per (symbol, date): a single shuffle, whatever the method.

    ``_types`` keeps the strategies' votes (as many as there are strategies)
    for the consensus test, sparing a join back.
    """
    x, conf = c("signal_strength"), c("confidence")
    w = _weight(p.strategy_weights)
    n = F.count(F.lit(1))
    votes = {k: F.count_if(c("signal_type") == k) for k in ("buy", "sell", "hold")}
    common = [n.alias("strategy_count"), F.array_sort(F.collect_list("signal_type")).alias("_types")]
    key = aligned.groupBy("symbol", "date")
    if method == "weighted_average":
        out = key.agg(
            div(F.sum(x * w), F.sum(w)).alias("signal_strength"),
            div(F.sum(conf * w), F.sum(w)).alias("confidence"), *common,
        )
    elif method == "voting":
        need = n * p.consensus
        return key.agg(
            div(votes["buy"] - votes["sell"], n).alias("signal_strength"),
            div(F.greatest(*votes.values()), n).alias("confidence"),
            F.when(votes["buy"] >= need, "buy").when(votes["sell"] >= need, "sell")
            .otherwise("hold").alias("signal_type"), *common,
        )
    elif method == "ensemble":
        agg = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[aggregation]
        out = key.agg(
            agg(x).alias("signal_strength"),
            div(F.sum(conf * F.abs(x)), F.sum(F.when(conf.isNotNull(), F.abs(x)))).alias("confidence"), *common,
        )
    else:
        raise ValueError(f"unknown combination method {method}")
    return out.withColumn("signal_type", signal_type(c("signal_strength"), p.type_cut))


def consensus_filter(combined: DataFrame, p: Signals = SIGNALS) -> DataFrame:
    """Keep rows most strategies agree with; ``consensus_score`` is the share."""
    agree = F.size(F.filter("_types", lambda t: t == c("signal_type")))
    scored = combined.withColumn("_agree", agree).withColumn(
        "consensus_score", div(c("_agree"), c("strategy_count"))
    )
    return scored.filter(
        (c("consensus_score") >= p.consensus) & (c("_agree") >= p.min_strategies)
    ).drop("_agree", "_types")


def signal_quality(df: DataFrame) -> DataFrame:
    return df.withColumn("signal_quality", F.abs("signal_strength") * c("confidence"))


def composite_signal(
    results: dict[str, DataFrame], method: str = "weighted_average", p: Signals = SIGNALS
) -> DataFrame:
    return signal_quality(consensus_filter(combine(strategy_align(results), method, p=p), p))


# -- summaries -------------------------------------------------------------------
def _type_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_signals")] + [
        F.count_if(F.lower("signal_type") == k).alias(f"{k}_signals") for k in ("buy", "sell", "hold")
    ]


def signal_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    extra = [
        F.avg(n).alias(f"{n}_avg")
        for n in ("valuation_score", "growth_score", "profitability_score") if n in df.columns
    ]
    return df.groupBy(*(by or [])).agg(
        *_type_counts(), F.avg("signal_strength").alias("average_strength"),
        F.avg("confidence").alias("average_confidence"), *extra,
    )


def signal_quality_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        *_type_counts(), F.avg("signal_strength").alias("signal_strength_avg"),
        F.avg("confidence").alias("confidence_avg"), F.avg("signal_quality").alias("quality_score_avg"),
        F.avg("strategy_count").alias("avg_strategy_agreement"),
    )


def signal_stats_api(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        *_type_counts(), (F.avg(c("confidence").cast("double")) * 100).alias("avg_confidence"),
        F.count_if(F.upper("strength") == "STRONG").alias("strong_signals"),
    )


def export_signals(df: DataFrame) -> DataFrame:
    """Fixed export columns; confidence as text with three decimals."""
    return df.select(
        c("symbol").alias("Symbol"), c("signal_type").alias("Signal Type"),
        F.format_string("%.3f", c("confidence").cast("double")).alias("Confidence"),
        c("strength").alias("Strength"), c("signal_date").alias("Date"), c("timeframe").alias("Timeframe"),
    )


def signals_latest(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(c("signal_date").desc(), "symbol").limit(n)
