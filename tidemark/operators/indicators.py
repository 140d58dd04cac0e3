"""Per-symbol technical indicators as window expressions.

Every function takes bars and the series layout, keeps all rows and adds
columns; frames are full (NULL until they hold enough non-null rows).
``LOOKBACK`` gives the rows each needs before a row, for block execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import (
    div, flag, frame_kurt, frame_quantile, frame_skew, full, mean, pct_change, prev, std, true_range,
)
from tidemark.params import SIGNALS, Signals
from tidemark.plans.ewm import ewm_numbered, memory_rows, number_off
from tidemark.plans.series import BARS, DAILY, Series, per_series, running_sums

c = F.col

LOOKBACK = {
    "sma": 20, "rsi": 15, "bollinger": 20, "stochastic": 17, "williams_r": 14, "cci": 20,
    "adx": 30, "atr": 15, "volatility_block": 21, "volatility_index": 21,
    "momentum_sentiment": 14, "macd": memory_rows(26) + memory_rows(9),
    "technical_all": memory_rows(26) + memory_rows(9),
}


def sma(bars: DataFrame, s: Series = BARS, n: int = 20) -> DataFrame:
    return bars.withColumn("sma", mean(c("close"), n, s))


def rsi(bars: DataFrame, s: Series = BARS, n: int = 14) -> DataFrame:
    """Simple-mean relative strength; a first difference counts as zero."""
    move = c("close") - prev(c("close"), 1, s)
    zero = F.lit(0.0)
    moved = bars.withColumns({
        "_gain": F.coalesce(F.greatest(move, zero), zero),
        "_loss": F.coalesce(F.greatest(-move, zero), zero),
    }).withColumns({"_g": mean(c("_gain"), n, s), "_l": mean(c("_loss"), n, s)})
    value = (
        F.when((c("_l") == 0) & (c("_g") > 0), F.lit(100.0))
        .otherwise(100 - div(100, 1 + div(c("_g"), c("_l"))))
    )
    return moved.withColumn("rsi", value).drop("_gain", "_loss", "_g", "_l")


def bollinger(bars: DataFrame, s: Series = BARS, n: int = 20, k: float = 2.0) -> DataFrame:
    width = std(c("close"), n, s) * k
    mid = mean(c("close"), n, s)
    return bars.withColumns({"bb_middle": mid, "bb_upper": mid + width, "bb_lower": mid - width}).withColumns({
        "bb_width": div(c("bb_upper") - c("bb_lower"), c("bb_middle")),
        "bb_position": div(c("close") - c("bb_lower"), c("bb_upper") - c("bb_lower")),
    })


def stochastic(bars: DataFrame, s: Series = BARS, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = full(F.min, c("low"), k, s), full(F.max, c("high"), k, s)
    return bars.withColumn("stoch_k", div(c("close") - lo, hi - lo) * 100).withColumn(
        "stoch_d", mean(c("stoch_k"), d, s)
    )


def williams_r(bars: DataFrame, s: Series = BARS, n: int = 14) -> DataFrame:
    lo, hi = full(F.min, c("low"), n, s), full(F.max, c("high"), n, s)
    return bars.withColumn("williams_r", div(hi - c("close"), hi - lo) * -100)


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def cci(bars: DataFrame, s: Series = BARS, n: int = 20) -> DataFrame:
    """Deviation of the typical price from its mean, in mean absolute deviations."""
    framed = bars.withColumn("_tp", typical()).withColumns({
        "_m": mean(c("_tp"), n, s), "_seen": F.collect_list("_tp").over(s.back(n)),
    })
    spread = F.aggregate("_seen", F.lit(0.0), lambda a, v: a + F.abs(v - c("_m"))) / n
    return framed.withColumn("cci", div(c("_tp") - c("_m"), spread * 0.015)).drop("_tp", "_m", "_seen")


def adx(bars: DataFrame, s: Series = BARS, n: int = 14, wilder: bool = False) -> DataFrame:
    """Directional index; ``wilder`` takes falls, not rises, of the low."""
    up = c("high") - prev(c("high"), 1, s)
    low = c("low") - prev(c("low"), 1, s)
    down = -low if wilder else low
    zero = F.lit(0.0)
    moved = bars.withColumns({
        "_plus": F.when((up > down) & (up > 0), up).otherwise(zero),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(zero),
        "_tr": true_range(s, null_first=True),
    })
    tr = mean(c("_tr"), n, s)
    di = moved.withColumns({
        "plus_di": div(mean(c("_plus"), n, s), tr) * 100,
        "minus_di": div(mean(c("_minus"), n, s), tr) * 100,
    }).withColumn("_dx", div(F.abs(c("plus_di") - c("minus_di")) * 100, c("plus_di") + c("minus_di")))
    return di.withColumn("adx", mean(c("_dx"), n, s)).drop("_plus", "_minus", "_tr", "_dx")


def atr(bars: DataFrame, s: Series = BARS, n: int = 14, null_first: bool = False) -> DataFrame:
    return bars.withColumn("true_range", true_range(s, null_first)).withColumn("atr", mean(c("true_range"), n, s))


def true_range_impact(bars: DataFrame, s: Series = BARS) -> DataFrame:
    return bars.withColumn("true_range", true_range(s)).withColumn(
        "price_impact", div(c("true_range"), c("volume"))
    )


def volume_block(
    bars: DataFrame, s: Series = BARS, n: int = 20, frequency: str | None = "1day"
) -> DataFrame:
    """Volume mean and change, plus the two cumulative volume lines."""

    def moves(df: DataFrame, s: Series) -> DataFrame:
        v = c("volume")
        step = c("close") - prev(c("close"), 1, s)
        return df.withColumns({
            "volume_ma": mean(v, n, s),
            "volume_roc": pct_change(v, n, s),
            "_flow": v * pct_change(c("close"), 1, s),
            "_signed": F.when(step > 0, v).when(step < 0, -v).otherwise(F.lit(0)),
        })

    moved = per_series(bars, moves, n, s=s, frequency=frequency)
    return running_sums(moved, {"pvt": c("_flow"), "obv": c("_signed")}, s, frequency).drop("_flow", "_signed")


def volatility_block(bars: DataFrame, s: Series = BARS, n: int = 20) -> DataFrame:
    changed = bars.withColumn("_ret", pct_change(c("close"), 1, s))
    return changed.withColumn("volatility", std(c("_ret"), n, s)).withColumns({
        "parkinson_vol": c("volatility") * math.sqrt(2 * math.log(2)),
        "gk_vol": c("volatility") * math.sqrt(0.5),
    }).drop("_ret")


def macd(
    bars: DataFrame, s: Series = BARS, fast: int = 12, slow: int = 26, signal: int = 9
) -> DataFrame:
    """Both steps run on one numbering, so on one sort."""
    out = number_off(bars, [fast, slow, signal], s)
    out = ewm_numbered(out, {"_fast": ("close", fast), "_slow": ("close", slow)}, s)
    out = out.withColumn("macd", c("_fast") - c("_slow"))
    out = ewm_numbered(out, {"macd_signal": ("macd", signal)}, s)
    return out.withColumn("macd_histogram", c("macd") - c("macd_signal")).drop(
        "_fast", "_slow", "_n", "_b", "_p", "_size"
    )


def technical_all(bars: DataFrame, s: Series = BARS, p: Signals = SIGNALS) -> DataFrame:
    out = rsi(bars, s, p.rsi_period)
    out = bollinger(out, s, p.bb_period, p.bb_std)
    return macd(out, s, p.macd_fast, p.macd_slow, p.macd_signal)


def lag_features(bars: DataFrame, column: str, lags: list[int], s: Series = BARS) -> DataFrame:
    return bars.withColumns({f"{column}_lag_{k}": prev(c(column), k, s) for k in lags})


def rolling_features(
    bars: DataFrame, column: str, windows: list[int], functions: list[str], s: Series = BARS
) -> DataFrame:
    x = c(column)
    build = {
        "mean": lambda n: mean(x, n, s),
        "std": lambda n: std(x, n, s),
        "min": lambda n: full(F.min, x, n, s),
        "max": lambda n: full(F.max, x, n, s),
        "median": lambda n: frame_quantile(x, 0.5, n, s),
        "skew": lambda n: frame_skew(x, n, s),
        "kurt": lambda n: frame_kurt(x, n, s),
    }
    unknown = set(functions) - set(build)
    if unknown:
        raise ValueError(f"unknown rolling function {sorted(unknown)}")
    return bars.withColumns({
        f"{column}_rolling_{n}_{f}": build[f](n) for n in windows for f in functions
    })


def pct_growth(reports: DataFrame, columns: list[str], k: int = 4, s: Series = BARS) -> DataFrame:
    return reports.withColumns({f"{x}_growth": pct_change(c(x), k, s) for x in columns})


def volatility_index(bars: DataFrame, s: Series = BARS, n: int = 20) -> DataFrame:
    ranged = bars.withColumn("_tr", true_range(s, null_first=True))
    return ranged.withColumn("volatility_index", div(mean(c("_tr"), n, s), c("close"))).drop("_tr")


def momentum_sentiment(bars: DataFrame, s: Series = BARS, n: int = 14) -> DataFrame:
    return bars.withColumn(
        "momentum_sentiment", pct_change(c("close"), n, s) * pct_change(c("volume"), n, s)
    )


def rolling_perf(equity: DataFrame, n: int = 30, days: int = 252) -> DataFrame:
    """Risk figures over the last ``n`` returns of a date-grain equity table."""
    s = DAILY
    r = pct_change(c("total_value"), 1, s)
    base = equity.withColumn("return", r)
    full_frame = F.count("return").over(s.back(n)) == n
    zero = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(acc["worst"], div(peak - v, peak)).alias("worst"))

    values = F.collect_list("total_value").over(s.back(n))
    return base.withColumns({
        "rolling_volatility": std(c("return"), n, s) * math.sqrt(days),
        "rolling_sharpe": div(mean(c("return"), n, s), std(c("return"), n, s)) * math.sqrt(days),
        "rolling_max_drawdown": F.when(full_frame, F.aggregate(values, zero, step, lambda a: a["worst"])),
        "rolling_win_rate": F.when(full_frame, F.avg(flag(c("return") > 0)).over(s.back(n))),
    })
