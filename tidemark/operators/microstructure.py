"""Volume, price-volume, order-flow, intensity, quality and liquidity features.

Each block keeps all rows.  Blocks share one partitioning and one sort order,
so a chain of them costs a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import (
    corr, div, flag, frame_quantile, frame_rank, full, longest_run, mean, pct_change, prev, snap, std,
)
from tidemark.operators.indicators import typical
from tidemark.plans.ewm import ewm
from tidemark.plans.series import BARS, Series, running_sums

c = F.col


def _zscore(x: Column, m: Column, sd: Column) -> Column:
    return div(x - m, sd)


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def ms_volume(bars: DataFrame, s: Series = BARS) -> DataFrame:
    v = c("volume")
    out = ewm(bars, {f"volume_ema_{n}": ("volume", n) for n in (5, 10, 20, 50)}, s)
    out = out.withColumns({
        **{f"volume_sma_{n}": mean(v, n, s) for n in (5, 10, 20, 50)},
        **{f"volume_volatility_{n}": std(v, n, s) for n in (5, 10, 20)},
        **{f"volume_momentum_{n}": pct_change(v, n, s) for n in (1, 5, 10)},
        **{f"volume_percentile_{n}": frame_rank(v, n, s) for n in (20, 50)},
        "volume_acceleration": v - prev(v, 1, s) * 2 + prev(v, 2, s),
    })
    ratios = {}
    for n in (5, 10, 20):
        m, sd = c(f"volume_sma_{n}"), c(f"volume_volatility_{n}")
        ratios[f"volume_ratio_{n}"] = div(v, m)
        ratios[f"volume_zscore_{n}"] = _zscore(v, m, sd)
        ratios[f"volume_cv_{n}"] = div(sd, m)
    return out.withColumns(ratios)


def ms_price_volume(bars: DataFrame, s: Series = BARS, frequency: str | None = "1day") -> DataFrame:
    close, v = c("close"), c("volume")
    out = running_sums(bars, {"_pv": typical() * v, "_v": v}, s, frequency)
    change, vchange = pct_change(close, 1, s), pct_change(v, 1, s)
    out = out.withColumns({
        "vwap": div(c("_pv"), c("_v")),
        "_ret": change,
        "_n": F.row_number().over(s.ordered),
        "price_impact": div(change, vchange),
        "_step": (close - prev(close, 1, s)) * v,
        "_sum_v": full(F.sum, v, 20, s),
        "_cv": close * v,
    }).withColumns({"price_vs_vwap": (div(close, c("vwap")) - 1) * 100, "_rv": c("_ret") * v})
    dev = c("price_vs_vwap")

    def slope(x: Column) -> Column:
        return F.signum(snap(F.regr_slope(x, c("_n")).over(s.back(10)), 6))

    full_ten = F.count(close).over(s.back(10)) == 10
    out = out.withColumns({
        "price_vs_vwap_zscore": _zscore(dev, mean(dev, 20, s), std(dev, 20, s)),
        "volume_weighted_price": div(full(F.sum, c("_cv"), 20, s), c("_sum_v")),
        "price_volume_trend": full(F.sum, c("_step"), 20, s),
        "price_impact_ma": mean(c("price_impact"), 20, s),
        "volume_weighted_return": div(full(F.sum, c("_rv"), 20, s), c("_sum_v")),
        "price_volume_divergence": F.when(full_ten, slope(close) != slope(v)),
        **{
            f"volume_price_corr_{n}": F.when(F.count(close).over(s.back(n)) == n, corr(close, v, s.back(n)))
            for n in (5, 10, 20)
        },
    })
    return out.drop("_pv", "_v", "_ret", "_n", "_step", "_sum_v", "_cv", "_rv")


def spread_proxy() -> Column:
    return div(c("high") - c("low"), c("close"))


def ms_order_flow(bars: DataFrame, s: Series = BARS) -> DataFrame:
    close, high, low = c("close"), c("high"), c("low")
    span = high - low
    out = bars.withColumns({
        "spread_proxy": spread_proxy(),
        "price_range": span,
        "price_range_pct": div(span, close),
        "open_close_range": div(F.abs(c("open") - close), close),
        "high_close_range": div(high - close, close),
        "low_close_range": div(close - low, close),
        "price_efficiency": div(close - low, span),
        "order_flow_imbalance": _or_zero(div(close - c("open"), span)),
    })
    return out.withColumns({
        "spread_proxy_ma": mean(c("spread_proxy"), 20, s),
        "spread_proxy_zscore": _zscore(
            c("spread_proxy"), mean(c("spread_proxy"), 20, s), std(c("spread_proxy"), 20, s)
        ),
        "price_range_ma": mean(c("price_range_pct"), 20, s),
        "price_efficiency_ma": mean(c("price_efficiency"), 20, s),
    })


def ms_intensity(bars: DataFrame, s: Series = BARS) -> DataFrame:
    v = c("volume")
    out = bars.withColumns({
        "_limit": snap(frame_quantile(v, 0.8, 20, s), 6),
        "trading_intensity": div(v, mean(v, 20, s)),
        "_accel": v - prev(v, 1, s) * 2 + prev(v, 2, s),
        "_mom": pct_change(v, 1, s),
        "volume_regime": flag(snap(mean(v, 5, s)) > snap(mean(v, 20, s))),
    }).withColumns({
        "volume_burst": F.coalesce(v > c("_limit"), F.lit(False)),
        "volume_burst_intensity": div(v, c("_limit")),
    })
    burst = c("volume_burst").cast("int")
    return out.withColumns({
        "volume_clustering": full(F.sum, burst, 5, s),
        "volume_persistence": longest_run(c("volume_burst"), 10, s),
        "volume_acceleration_ma": mean(c("_accel"), 5, s),
        "volume_acceleration_std": std(c("_accel"), 10, s),
        "volume_momentum_ma": mean(c("_mom"), 5, s),
        "volume_momentum_std": std(c("_mom"), 10, s),
    }).drop("_limit", "_accel", "_mom")


def ms_quality(bars: DataFrame, s: Series = BARS) -> DataFrame:
    close, v, span = c("close"), c("volume"), c("high") - c("low")
    tiny = 1e-8
    out = bars.withColumns({"_r": pct_change(close, 1, s), "_vr": pct_change(v, 1, s)})
    out = out.withColumns({"_ar": F.abs("_r"), "_avr": F.abs("_vr")})
    relative = div(v, mean(v, 20, s))
    return out.withColumns({
        "price_stability": div(1, mean(c("_ar"), 20, s) + tiny),
        "price_consistency": div(1, std(c("_r"), 20, s) + tiny),
        "volume_stability": div(1, mean(c("_avr"), 20, s) + tiny),
        "volume_consistency": div(1, std(c("_vr"), 20, s) + tiny),
        "price_efficiency_ratio": _or_zero(div(div(c("_ar"), span), close)),
        "volume_efficiency": _or_zero(div(div(v, span), close)),
        "market_depth_proxy": _or_zero(div(v, spread_proxy())),
        "price_impact_measure": _or_zero(div(c("_ar"), relative)),
    }).drop("_r", "_vr", "_ar", "_avr")


def ms_liquidity(bars: DataFrame, s: Series = BARS) -> DataFrame:
    v = c("volume")
    out = bars.withColumns({
        "liquidity_ratio": _or_zero(div(v, spread_proxy())),
        "amihud_illiquidity": _or_zero(div(F.abs(pct_change(c("close"), 1, s)), v)),
    })
    liq = c("liquidity_ratio")
    out = out.withColumns({
        "amihud_illiquidity_ma": mean(c("amihud_illiquidity"), 20, s),
        "volume_weighted_liquidity": liq * v,
        "high_liquidity": F.coalesce(
            snap(liq, 4) > snap(frame_quantile(liq, 0.5, 20, s), 4), F.lit(False)
        ),
        "liquidity_volatility": std(liq, 20, s),
    })
    return out.withColumns({
        "volume_weighted_liquidity_ma": mean(c("volume_weighted_liquidity"), 20, s),
        "liquidity_persistence": full(F.sum, c("high_liquidity").cast("int"), 5, s),
    })


def microstructure_all(bars: DataFrame, s: Series = BARS, frequency: str | None = "1day") -> DataFrame:
    out = ms_price_volume(ms_volume(bars, s), s, frequency)
    for block in (ms_order_flow, ms_intensity, ms_quality, ms_liquidity):
        out = block(out, s)
    return out


def microstructure_summary(bars: DataFrame, s: Series = BARS, frequency: str | None = "1day") -> DataFrame:
    """Per-symbol statistics; moments carry the small-sample correction."""
    out = ms_liquidity(ms_quality(ms_price_volume(bars, s, frequency), s), s)
    out = out.withColumn("spread_proxy", spread_proxy())
    v, n = c("volume"), F.count("volume").cast("double")
    skew = F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (F.kurtosis(v) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return out.groupBy("symbol").agg(
        F.avg(v).alias("volume_mean"),
        F.stddev_samp(v).alias("volume_std"),
        skew.alias("volume_skewness"),
        kurt.alias("volume_kurtosis"),
        corr("close", "volume").alias("price_volume_correlation"),
        F.avg("price_vs_vwap").alias("vwap_deviation_mean"),
        F.stddev_samp("price_vs_vwap").alias("vwap_deviation_std"),
        F.avg("spread_proxy").alias("spread_proxy_mean"),
        F.avg("price_stability").alias("price_stability_mean"),
        F.avg("volume_stability").alias("volume_stability_mean"),
        F.avg("liquidity_ratio").alias("liquidity_ratio_mean"),
        F.avg("amihud_illiquidity").alias("amihud_illiquidity_mean"),
    )
