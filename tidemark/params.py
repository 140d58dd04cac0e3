"""Every tunable of the engine in one place.

The numbers below are fixed values: they have to equal the published
defaults of the analytics, otherwise results differ.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Breadth:
    advance: float = 0.001
    decline: float = -0.001
    min_volume: int = 1000
    min_close: float = 1.0
    momentum_rows: int = 20
    rolling_rows: int = 20
    ma_short: int = 20
    ma_long: int = 50
    mcc_short: int = 19
    mcc_long: int = 39
    overbought: float = 100.0
    oversold: float = -100.0
    zbt_rows: int = 10
    zbt_threshold: float = 0.615
    zbt_lookback_rows: int = 180
    score_weights: dict = field(
        default_factory=lambda: {
            "adv_ratio": 0.2,
            "up_dn_vol_ratio": 0.2,
            "pct_above_ma20": 0.2,
            "pct_above_ma50": 0.2,
            "mcclellan_osc": 0.15,
            "zbt_flag": 0.05,
        }
    )
    score_buy: float = 60.0
    score_sell: float = 40.0


@dataclass(frozen=True)
class Signals:
    rsi_period: int = 14
    rsi_oversold: float = 30.0
    rsi_overbought: float = 70.0
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bb_period: int = 20
    bb_std: float = 2.0
    sma_period: int = 20
    squeeze_width: float = 0.1
    volume_spike: float = 1.5
    volume_low: float = 0.5
    type_cut: float = 0.3
    signal_threshold: float = 0.5
    confidence_threshold: float = 0.7
    min_data_points: int = 30
    strategy_weights: dict = field(
        default_factory=lambda: {"technical_analysis": 0.6, "fundamental_analysis": 0.4}
    )
    consensus: float = 0.7
    min_strategies: int = 1


@dataclass(frozen=True)
class Trading:
    initial_capital: float = 100000.0
    commission_rate: float = 0.001
    min_commission: float = 1.0
    slippage_rate: float = 0.0005
    market_impact: float = 0.0001
    impact_unit: float = 1000.0
    price_improvement: float = 0.0001
    limit_edge: float = 0.0
    slippage_scale: float = 1.0
    commission_scale: float = 1.0
    supports_stop: bool = True
    min_trade_size: float = 100.0
    max_trade_size: float = 10000.0
    fixed_fraction: float = 0.05
    kelly_cap: float = 0.25
    kelly_win: float = 0.1
    kelly_loss: float = 0.05
    max_concentration: float = 0.1
    max_position_size: float = 0.1
    max_single_risk: float = 0.02
    max_portfolio_risk: float = 0.02
    risk_per_trade: float = 0.01
    target_positions: int = 10
    base_volatility: float = 0.02
    stop_loss: float = 0.05
    take_profit: float = 0.10
    trailing: float = 0.05
    risk_free: float = 0.02
    trading_days: int = 252


#: Low-latency execution profile of the same cost model.
FAST_TRADING = Trading(
    market_impact=0.00005,
    impact_unit=10000.0,
    price_improvement=0.00005,
    limit_edge=0.0001,
    slippage_scale=0.5,
    commission_scale=0.5,
    min_commission=0.1,
    supports_stop=False,
)

#: Per-timeframe settings, kept as the JSON documents they arrive as.
TIMEFRAMES = [
    ("1day", "Daily", '{"ma_short_period": 20, "ma_long_period": 50, "rsi_period": 14, "commission_rate": 0.001, "max_position_size": 0.1}'),
    ("1hour", "1 Hour", '{"ma_short_period": 12, "ma_long_period": 24, "rsi_period": 14, "commission_rate": 0.0015, "max_position_size": 0.08}'),
    ("15min", "15 Minutes", '{"ma_short_period": 8, "ma_long_period": 16, "rsi_period": 14, "commission_rate": 0.002, "max_position_size": 0.06}'),
    ("5min", "5 Minutes", '{"ma_short_period": 6, "ma_long_period": 12, "rsi_period": 10, "commission_rate": 0.0025, "max_position_size": 0.05}'),
    ("1min", "1 Minute", '{"ma_short_period": 5, "ma_long_period": 10, "rsi_period": 8, "commission_rate": 0.003, "max_position_size": 0.03}'),
]

#: Standard-normal quantiles and the matching expected-shortfall factors
#: (density at the quantile over the tail probability).
Z_SCORES = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
ES_FACTORS = {0.95: 2.062712807507438, 0.99: 2.665214220345808}

STRESS = {"market_crash": 2.0, "volatility_spike": 1.5, "correlation_breakdown": 1.3}

BREADTH = Breadth()
SIGNALS = Signals()
TRADING = Trading()
