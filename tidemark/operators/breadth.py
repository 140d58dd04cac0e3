"""Advance/decline, moving-average, oscillator and thrust breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, pct_change, prev, snap
from tidemark.params import BREADTH, Breadth
from tidemark.plans.ewm import ewm
from tidemark.plans.series import BARS, DAILY, Series, per_series

c = F.col


# -- filters ------------------------------------------------------------------
def scan_filter(
    bars: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Inclusive symbol/date selection.

    The date is compared as a date literal, so it reaches the parquet scan;
    on a year/month layout the matching partition predicates are added.
    """
    if symbols:
        bars = bars.filter(c("symbol").isin(symbols))
    parts = {"year", "month"} <= set(bars.columns)
    for text, cmp in ((start, "ge"), (end, "le")):
        if text is None:
            continue
        day = F.lit(text).cast("date")
        bars = bars.filter(c("date") >= day if cmp == "ge" else c("date") <= day)
        if parts:
            year, month = int(text[:4]), int(text[5:7])
            later = c("year") > year if cmp == "ge" else c("year") < year
            edge = c("month") >= month if cmp == "ge" else c("month") <= month
            bars = bars.filter(later | ((c("year") == year) & edge))
    return bars


def quality_filter_ad(bars: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    return bars.filter((c("volume") >= p.min_volume) & (c("close") >= p.min_close))


def quality_filter_pos(bars: DataFrame) -> DataFrame:
    return bars.filter((c("close") > 0) & (c("volume") > 0))


# -- issues ---------------------------------------------------------------------
def price_change(bars: DataFrame, s: Series = BARS) -> DataFrame:
    return bars.withColumn("price_change_pct", pct_change(c("close"), 1, s))


def issue_status(bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH) -> DataFrame:
    """Advancing / declining / unchanged; a first bar counts as unchanged."""
    moved = c("price_change_pct")
    return price_change(bars, s).withColumn(
        "issue_status",
        F.when(moved > p.advance, "advancing")
        .when(moved < p.decline, "declining")
        .otherwise("unchanged"),
    )


def _statuses(bars: DataFrame, s: Series, p: Breadth, frequency: str | None) -> DataFrame:
    return per_series(bars, lambda df, x: issue_status(df, x, p), 1, s=s, frequency=frequency)


def _issues(status: str) -> Column:
    return F.count_if(c("issue_status") == status)


def _volume(status: str) -> Column:
    return F.sum(F.when(c("issue_status") == status, c("volume")).otherwise(0))


def ad_daily(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    """Counts and volumes by class and date, with their ratios."""
    day = _statuses(bars, s, p, frequency).groupBy("date").agg(
        _issues("advancing").alias("advancing_stocks"),
        _issues("declining").alias("declining_stocks"),
        _issues("unchanged").alias("unchanged_stocks"),
        F.sum("volume").alias("total_volume"),
        _volume("advancing").alias("advancing_volume"),
        _volume("declining").alias("declining_volume"),
    )
    adv, dec, unch = c("advancing_stocks"), c("declining_stocks"), c("unchanged_stocks")
    return day.withColumns({
        "ad_issues_ratio": F.coalesce(div(adv, dec), F.lit(0.0)),
        "ad_volume_ratio": F.coalesce(div(c("advancing_volume"), c("declining_volume")), F.lit(0.0)),
        "ad_strength": div(adv - dec, adv + dec),
        "ad_breadth": div(adv, adv + dec + unch),
    })


def ad_line(daily: DataFrame) -> DataFrame:
    net = c("advancing_stocks") - c("declining_stocks")
    return daily.withColumn("ad_difference", net).withColumn(
        "ad_line", F.sum("ad_difference").over(DAILY.running)
    )


def ad_momentum(line: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    n = p.momentum_rows
    return line.withColumn("ad_momentum", (c("ad_line") - prev(c("ad_line"), n, DAILY)) / n)


def ad_features(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    return ad_momentum(ad_line(ad_daily(quality_filter_ad(bars, p), s, p, frequency)), p)


def ad_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.sum("advancing_stocks").alias("total_advancing"),
        F.sum("declining_stocks").alias("total_declining"),
        F.sum("total_volume").alias("total_volume"),
        F.sum("advancing_volume").alias("total_advancing_volume"),
        F.sum("declining_volume").alias("total_declining_volume"),
        F.avg("ad_issues_ratio").alias("avg_ad_issues_ratio"),
        F.avg("ad_volume_ratio").alias("avg_ad_volume_ratio"),
        F.avg("ad_strength").alias("avg_ad_strength"),
        F.avg("ad_breadth").alias("avg_ad_breadth"),
        F.stddev_samp("ad_momentum").alias("ad_momentum_volatility"),
    )


def ad_signals(features: DataFrame) -> DataFrame:
    issues, vol, mom = c("ad_issues_ratio"), c("ad_volume_ratio"), c("ad_momentum")
    return features.withColumns({
        "ad_bullish_signal": (issues > 2.0) & (vol > 1.5) & (mom > 0),
        "ad_bearish_signal": (issues < 0.5) & (vol < 0.67) & (mom < 0),
        "ad_thrust_signal": (issues > 3.0) & (vol > 2.0) & (mom > 5),
        "ad_divergence_signal": (issues > 1.5) & (vol < 0.8),
    })


def _rolling(df: DataFrame, columns: dict[str, str], s: Series, rows: int) -> DataFrame:
    """Means over the current row and ``rows`` before it (partial at first)."""
    w = s.frame(-rows, 0)
    return df.withColumns({out: F.avg(col).over(w) for out, col in columns.items()})


def ad_rolling(features: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    names = ["ad_issues_ratio", "ad_volume_ratio", "ad_strength", "ad_momentum"]
    return _rolling(features, {f"rolling_{n}": n for n in names}, DAILY, p.rolling_rows)


# -- moving averages --------------------------------------------------------------
def ma_pair(bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH) -> DataFrame:
    close = c("close")
    return bars.withColumns({
        "ma_short": F.avg(close).over(s.back(p.ma_short)),
        "ma_long": F.avg(close).over(s.back(p.ma_long)),
    }).withColumns({
        "price_vs_ma_short": div(close - c("ma_short"), c("ma_short")),
        "price_vs_ma_long": div(close - c("ma_long"), c("ma_long")),
    })


def ma_crossover(pairs: DataFrame, s: Series = BARS) -> DataFrame:
    gap = snap(c("ma_short") - c("ma_long"))
    was = prev(gap, 1, s)
    return pairs.withColumns({
        "ma_short_lag": prev(c("ma_short"), 1, s),
        "ma_long_lag": prev(c("ma_long"), 1, s),
        "golden_cross": (gap > 0) & (was <= 0),
        "death_cross": (gap < 0) & (was >= 0),
    }).withColumn(
        "ma_cross_signal",
        F.when(c("golden_cross"), "golden_cross").when(c("death_cross"), "death_cross").otherwise("none"),
    )


def ma_momentum(crossed: DataFrame, s: Series = BARS) -> DataFrame:
    short, long = c("ma_short"), c("ma_long")
    return crossed.withColumns({
        "ma_short_slope": (short - prev(short, 5, s)) / 5,
        "ma_long_slope": (long - prev(long, 10, s)) / 10,
        "ma_trend_strength": div(F.abs(short - long), long),
    }).withColumn("ma_momentum", (c("ma_short_slope") + c("ma_long_slope")) / 2)


def ma_features(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    def chain(df: DataFrame, s: Series) -> DataFrame:
        return ma_momentum(ma_crossover(ma_pair(df, s, p), s), s)

    return per_series(quality_filter_pos(bars), chain, p.ma_long + 10, s=s, frequency=frequency)


def ma_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("symbol").alias("total_records"),
        F.countDistinct("symbol").alias("unique_symbols"),
        F.avg("price_vs_ma_short").alias("avg_price_vs_ma_short"),
        F.avg("price_vs_ma_long").alias("avg_price_vs_ma_long"),
        F.avg("ma_momentum").alias("avg_ma_momentum"),
        F.avg("ma_trend_strength").alias("avg_ma_trend_strength"),
        F.count_if("golden_cross").alias("total_golden_crosses"),
        F.count_if("death_cross").alias("total_death_crosses"),
        F.stddev_samp("ma_momentum").alias("ma_momentum_volatility"),
    )


def ma_symbol_summary(features: DataFrame) -> DataFrame:
    """Every symbol's summary in one aggregation."""
    return features.groupBy("symbol").agg(
        F.avg("ma_short").alias("avg_ma_short"),
        F.avg("ma_long").alias("avg_ma_long"),
        F.avg("ma_momentum").alias("avg_ma_momentum"),
        F.avg("ma_trend_strength").alias("avg_ma_trend_strength"),
        F.count_if("golden_cross").alias("golden_crosses"),
        F.count_if("death_cross").alias("death_crosses"),
        F.max("close").alias("max_price"),
        F.min("close").alias("min_price"),
        F.stddev_samp("ma_momentum").alias("momentum_volatility"),
    )


def ma_signals(features: DataFrame) -> DataFrame:
    mom, gap = c("ma_momentum"), c("price_vs_ma_short")
    return features.withColumns({
        "ma_bullish_signal": c("golden_cross") & (mom > 0) & (gap > 0.02),
        "ma_bearish_signal": c("death_cross") & (mom < 0) & (gap < -0.02),
        "ma_trend_following_signal": (snap(c("ma_short") - c("ma_long")) > 0)
        & (mom > 0.01) & (c("ma_trend_strength") > 0.05),
        "ma_reversal_signal": (c("ma_cross_signal") != "none") & (F.abs(mom) > 0.02),
    })


def ma_rolling(features: DataFrame, s: Series = BARS, p: Breadth = BREADTH) -> DataFrame:
    names = ["ma_momentum", "ma_trend_strength", "price_vs_ma_short", "price_vs_ma_long"]
    return _rolling(features, {f"rolling_{n}": n for n in names}, s, p.rolling_rows)


# -- oscillator ---------------------------------------------------------------------
def mcc_issues(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    return _statuses(bars, s, p, frequency).groupBy("date").agg(
        _issues("advancing").alias("advancing_issues"),
        _issues("declining").alias("declining_issues"),
        _issues("unchanged").alias("unchanged_issues"),
    ).withColumn("net_advances", c("advancing_issues") - c("declining_issues"))


def mcc_oscillator(issues: DataFrame, p: Breadth = BREADTH, true_ema: bool = False) -> DataFrame:
    """Fast minus slow average of net advances.

    The published form uses plain means over period + 1 rows; ``true_ema``
    switches to exponential ones.
    """
    if true_ema:
        averaged = ewm(
            issues, {"ema_short": ("net_advances", p.mcc_short), "ema_long": ("net_advances", p.mcc_long)}, DAILY
        )
    else:
        averaged = issues.withColumns({
            "ema_short": F.avg("net_advances").over(DAILY.frame(-p.mcc_short, 0)),
            "ema_long": F.avg("net_advances").over(DAILY.frame(-p.mcc_long, 0)),
        })
    return averaged.withColumns({
        "mcclellan_oscillator": c("ema_short") - c("ema_long"),
        "mcclellan_ratio": F.coalesce(div(c("advancing_issues"), c("declining_issues")), F.lit(0.0)),
    })


def mcc_summation(osc: DataFrame) -> DataFrame:
    o = c("mcclellan_oscillator")
    return osc.withColumns({
        "mcclellan_summation_index": F.sum(o).over(DAILY.running),
        "oscillator_momentum": o - prev(o, 5, DAILY),
    })


def mcc_flags(ind: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    o = snap(c("mcclellan_oscillator"))
    own = snap(F.avg("mcclellan_oscillator").over(DAILY.frame(-10, 0)))
    return ind.withColumns({
        "overbought_signal": o > p.overbought,
        "oversold_signal": o < p.oversold,
        "bullish_divergence": (o > 0) & (o > own),
        "bearish_divergence": (o < 0) & (o < own),
    })


def mcclellan(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, true_ema: bool = False, frequency: str | None = "1day"
) -> DataFrame:
    issues = mcc_issues(quality_filter_pos(bars), s, p, frequency)
    return mcc_flags(mcc_summation(mcc_oscillator(issues, p, true_ema)), p)


def mcc_summary(res: DataFrame) -> DataFrame:
    o = "mcclellan_oscillator"
    return res.agg(
        F.avg(o).alias("avg_oscillator"),
        F.min(o).alias("min_oscillator"),
        F.max(o).alias("max_oscillator"),
        F.stddev_samp(o).alias("oscillator_volatility"),
        F.avg("mcclellan_ratio").alias("avg_ratio"),
        F.avg("oscillator_momentum").alias("avg_momentum"),
        F.count_if("overbought_signal").alias("overbought_days"),
        F.count_if("oversold_signal").alias("oversold_days"),
        F.count_if("bullish_divergence").alias("bullish_divergences"),
        F.count_if("bearish_divergence").alias("bearish_divergences"),
    )


def mcc_signals(res: DataFrame) -> DataFrame:
    o, mom, ratio = snap(c("mcclellan_oscillator")), snap(c("oscillator_momentum")), c("mcclellan_ratio")
    return res.withColumns({
        "mcclellan_bullish_signal": (o > 0) & (mom > 0) & (ratio > 1.2),
        "mcclellan_bearish_signal": (o < 0) & (mom < 0) & (ratio < 0.8),
        "mcclellan_buy_signal": c("oversold_signal") & (mom > 0),
        "mcclellan_sell_signal": c("overbought_signal") & (mom < 0),
        "mcclellan_thrust_signal": (o > 50) & (mom > 10) & (ratio > 2.0),
    })


def _trend(column: str, rows: int) -> Column:
    """Mean of the last frame minus the mean of the frame before it."""
    return F.avg(column).over(DAILY.frame(-rows, 0)) - F.avg(column).over(DAILY.frame(-2 * rows, -rows))


def mcc_rolling(res: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    out = _rolling(res, {
        "rolling_oscillator": "mcclellan_oscillator",
        "rolling_momentum": "oscillator_momentum",
        "rolling_ratio": "mcclellan_ratio",
    }, DAILY, p.rolling_rows)
    return out.withColumn("oscillator_trend", _trend("mcclellan_oscillator", p.rolling_rows))


# -- thrust -----------------------------------------------------------------------
def zbt_issues(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    day = mcc_issues(bars, s, p, frequency).drop("net_advances").withColumn(
        "total_issues", c("advancing_issues") + c("declining_issues") + c("unchanged_issues")
    )
    return day.withColumn(
        "advancing_percentage", F.coalesce(div(c("advancing_issues"), c("total_issues")), F.lit(0.0))
    )


def zbt_pct(issues: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    w = DAILY.back(p.zbt_rows)
    return issues.withColumns({
        "zbt_advancing_sum": F.sum("advancing_issues").over(w),
        "zbt_total_sum": F.sum("total_issues").over(w),
    }).withColumn(
        "zbt_10day_percentage", F.coalesce(div(c("zbt_advancing_sum"), c("zbt_total_sum")), F.lit(0.0))
    )


def zbt_signal(pct: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    """A thrust: the share crosses the threshold, not seen in the lookback."""
    return pct.withColumn("above_threshold", c("zbt_10day_percentage") >= p.zbt_threshold).withColumn(
        "recent_above_threshold",
        F.sum(c("above_threshold").cast("bigint")).over(DAILY.frame(-p.zbt_lookback_rows, -1)),
    ).withColumn("zbt_signal", c("above_threshold") & (c("recent_above_threshold") == 0))


def zbt_metrics(sig: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    pct, w = c("zbt_10day_percentage"), DAILY.frame(-60, 0)
    fired = F.coalesce(c("zbt_signal"), F.lit(False))
    zero = F.lit(0.0)
    return sig.withColumns({
        "zbt_strength": F.when(fired, pct - p.zbt_threshold).otherwise(zero),
        "zbt_momentum": pct - prev(pct, 5, DAILY),
        "avg_60d_percentage": F.avg(pct).over(w),
        "std_60d_percentage": F.stddev_samp(pct).over(w),
    }).withColumn(
        "zbt_rarity_score",
        F.when(snap(c("std_60d_percentage")) > 0, div(pct - c("avg_60d_percentage"), c("std_60d_percentage")))
        .otherwise(zero),
    ).withColumn(
        "zbt_confidence",
        F.when(
            fired, c("zbt_strength") * 0.4 + c("zbt_momentum") * 0.3 + c("zbt_rarity_score") * 0.3
        ).otherwise(zero),
    )


def zbt_features(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    return zbt_metrics(zbt_signal(zbt_pct(zbt_issues(quality_filter_pos(bars), s, p, frequency), p), p), p)


def zbt_summary(res: DataFrame) -> DataFrame:
    pct = "zbt_10day_percentage"
    return res.agg(
        F.avg(pct).alias("avg_zbt_percentage"),
        F.min(pct).alias("min_zbt_percentage"),
        F.max(pct).alias("max_zbt_percentage"),
        F.stddev_samp(pct).alias("zbt_percentage_volatility"),
        F.avg("zbt_strength").alias("avg_zbt_strength"),
        F.avg("zbt_momentum").alias("avg_zbt_momentum"),
        F.avg("zbt_rarity_score").alias("avg_zbt_rarity"),
        F.avg("zbt_confidence").alias("avg_zbt_confidence"),
        F.count_if("zbt_signal").alias("total_zbt_signals"),
        F.count_if("above_threshold").alias("days_above_threshold"),
    )


def zbt_history(res: DataFrame) -> DataFrame:
    """Signal days only, in one pass; ``days_per_signal`` over all days."""
    on = F.coalesce(c("zbt_signal"), F.lit(False))
    return res.agg(
        F.count_if(on).alias("total_signals"),
        F.avg(F.when(on, c("zbt_10day_percentage"))).alias("avg_signal_percentage"),
        F.avg(F.when(on, c("zbt_strength"))).alias("avg_signal_strength"),
        F.avg(F.when(on, c("zbt_confidence"))).alias("avg_signal_confidence"),
        F.avg(F.when(on, c("zbt_rarity_score"))).alias("avg_signal_rarity"),
        F.min(F.when(on, c("date"))).alias("first_signal_date"),
        F.max(F.when(on, c("date"))).alias("last_signal_date"),
        div(F.count(F.lit(1)), F.count_if(on)).alias("days_per_signal"),
    )


def zbt_signals(res: DataFrame) -> DataFrame:
    on = c("zbt_signal")
    pct, conf, strong = c("zbt_10day_percentage"), c("zbt_confidence"), c("zbt_strength")
    mom, rare = c("zbt_momentum"), c("zbt_rarity_score")
    return res.withColumns({
        "zbt_bullish_signal": on & (conf > 0.7) & (strong > 0.05),
        "zbt_strong_signal": on & (conf > 0.8) & (strong > 0.1) & (rare > 2.0),
        "zbt_momentum_signal": (pct > 0.7) & (mom > 0.05) & (rare > 1.5),
        "zbt_breakout_signal": on & (pct > 0.75) & (mom > 0.1),
    })


def zbt_rolling(res: DataFrame, p: Breadth = BREADTH) -> DataFrame:
    out = _rolling(res, {
        "rolling_zbt_percentage": "zbt_10day_percentage",
        "rolling_zbt_momentum": "zbt_momentum",
        "rolling_zbt_rarity": "zbt_rarity_score",
    }, DAILY, p.rolling_rows)
    return out.withColumn("zbt_trend", _trend("zbt_10day_percentage", p.rolling_rows))


# -- composite ----------------------------------------------------------------------
def pct_above_ma(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    """Share of symbols above their short and long average, by date."""
    pairs = per_series(quality_filter_pos(bars), lambda df, x: ma_pair(df, x, p), p.ma_long, s=s, frequency=frequency)
    above = {n: snap(c("close") - c(n)) > 0 for n in ("ma_short", "ma_long")}
    return pairs.groupBy("date").agg(
        F.avg(above["ma_short"].cast("int")).alias("pct_above_ma20"),
        F.avg(above["ma_long"].cast("int")).alias("pct_above_ma50"),
    )


def breadth_score(
    bars: DataFrame, s: Series = BARS, p: Breadth = BREADTH, frequency: str | None = "1day"
) -> DataFrame:
    """Weighted 0-100 score of six breadth inputs (our own definition).

    All six inputs come out of one classified pass over the bars and one
    aggregation by date; the rest runs on the date table.
    """
    w = p.score_weights
    marked = per_series(
        quality_filter_pos(bars), lambda df, x: ma_pair(issue_status(df, x, p), x, p), p.ma_long, s=s, frequency=frequency
    )
    day = marked.groupBy("date").agg(
        _issues("advancing").alias("advancing_issues"),
        _issues("declining").alias("declining_issues"),
        F.count(F.lit(1)).alias("total_issues"),
        _volume("advancing").alias("up_volume"),
        _volume("declining").alias("down_volume"),
        F.avg((snap(c("close") - c("ma_short")) > 0).cast("int")).alias("pct_above_ma20"),
        F.avg((snap(c("close") - c("ma_long")) > 0).cast("int")).alias("pct_above_ma50"),
    ).withColumn("net_advances", c("advancing_issues") - c("declining_issues"))
    day = zbt_signal(zbt_pct(mcc_oscillator(day, p), p), p)
    adv, dec, up, down = c("advancing_issues"), c("declining_issues"), c("up_volume"), c("down_volume")
    parts = {
        "adv_ratio": F.coalesce(div(adv * 100, adv + dec), F.lit(50.0)),
        "up_dn_vol_ratio": F.coalesce(div(up * 100, up + down), F.lit(50.0)),
        "pct_above_ma20": c("pct_above_ma20") * 100,
        "pct_above_ma50": c("pct_above_ma50") * 100,
        "mcclellan_osc": F.least(F.greatest(c("mcclellan_oscillator") / 2 + 50, F.lit(0.0)), F.lit(100.0)),
        "zbt_flag": F.coalesce(c("zbt_signal"), F.lit(False)).cast("int") * 100.0,
    }
    total = None
    for name, value in parts.items():
        total = value * w[name] if total is None else total + value * w[name]
    scored = day.select("date", *[v.alias(n) for n, v in parts.items()], total.alias("score"))
    s9 = snap(c("score"))
    return scored.withColumn(
        "score_signal",
        F.when(s9 > p.score_buy, "buy").when(s9 < p.score_sell, "sell").otherwise("hold"),
    )
