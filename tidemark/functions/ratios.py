"""Fundamental ratios; NULL for a zero or missing denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import div, pct_change
from tidemark.plans.series import BARS, Series

c = F.col

#: block -> {ratio: (numerator, denominator)}
STATEMENT_RATIOS = {
    "valuation": {
        "pe_ratio": ("market_cap", "earnings"),
        "pb_ratio": ("market_cap", "book_value"),
        "ps_ratio": ("market_cap", "sales"),
    },
    "profitability": {
        "net_margin": ("net_income", "revenue"),
        "roa": ("net_income", "total_assets"),
        "roe": ("net_income", "equity"),
    },
    "leverage": {
        "debt_to_assets": ("total_debt", "total_assets"),
        "debt_to_equity": ("total_debt", "equity"),
        "equity_ratio": ("equity", "total_assets"),
    },
    "efficiency": {
        "asset_turnover": ("revenue", "total_assets"),
        "inventory_turnover": ("revenue", "inventory"),
        "receivables_turnover": ("revenue", "accounts_receivable"),
    },
}

#: Price-based ratios: (numerator columns, denominator column); a second
#: numerator column is subtracted.
PRICE_RATIOS = {
    "pe_ratio": (("close",), "earnings"),
    "pb_ratio": (("close",), "book_value"),
    "ps_ratio": (("close",), "revenue"),
    "ev_ebitda": (("enterprise_value",), "ebitda"),
    "debt_to_equity": (("total_debt",), "total_equity"),
    "current_ratio": (("current_assets",), "current_liabilities"),
    "quick_ratio": (("current_assets", "inventory"), "current_liabilities"),
    "roe": (("net_income",), "total_equity"),
    "roa": (("net_income",), "total_assets"),
    "gross_margin": (("gross_profit",), "revenue"),
    "operating_margin": (("operating_income",), "revenue"),
    "net_margin": (("net_income",), "revenue"),
    "dividend_yield": (("dividend",), "close"),
    "payout_ratio": (("dividend",), "earnings"),
}


def fund_block(reports: DataFrame, block: str) -> DataFrame:
    return reports.withColumns({n: div(c(a), c(b)) for n, (a, b) in STATEMENT_RATIOS[block].items()})


def fund_all(reports: DataFrame, s: Series = BARS) -> DataFrame:
    """Every block whose inputs exist, plus year-on-year growth."""
    have = set(reports.columns)
    out = {}
    for block in ("valuation", "profitability", "leverage"):
        pairs = STATEMENT_RATIOS[block]
        if {x for pair in pairs.values() for x in pair} <= have:
            out.update({n: div(c(a), c(b)) for n, (a, b) in pairs.items()})
    for x in ("revenue", "earnings"):
        if x in have:
            out[f"{x}_growth"] = pct_change(c(x), 4, s)
    return reports.withColumns(out)


def price_ratio(name: str, have: set[str]) -> Column:
    """One named ratio; NULL when an input column is absent."""
    if name not in PRICE_RATIOS:
        raise ValueError(f"unknown indicator {name}")
    top, bottom = PRICE_RATIOS[name]
    if not {*top, bottom} <= have:
        return F.lit(None).cast("double")
    upper = c(top[0]) - c(top[1]) if len(top) > 1 else c(top[0])
    return div(upper, c(bottom))


def fund_indicators(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({n: price_ratio(n, have) for n in names or PRICE_RATIOS})
