"""JSON documents to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

SIGNAL = (
    "array<struct<symbol string, signal_type string, confidence string, strength string, "
    "date string, close string, volume string, indicators map<string,double>>>"
)


def json_parse_signals(runs: DataFrame) -> DataFrame:
    """One typed row per element of each run's JSON signal array."""
    one = runs.withColumn("s", F.explode(F.from_json("signals", SIGNAL)))
    return one.select(
        "run_id", "timeframe", c("s.symbol").alias("symbol"), c("s.signal_type").alias("signal_type"),
        c("s.confidence").try_cast("decimal(5,3)").alias("confidence"), c("s.strength").alias("strength"),
        c("s.date").try_cast("date").alias("signal_date"),
        c("s.close").try_cast("decimal(12,4)").alias("price"),
        c("s.volume").try_cast("bigint").alias("volume"),
        c("s.indicators").alias("indicators"),
    )


#: result field -> type
RESULT = {
    "final_capital": "decimal(15,2)", "total_return": "decimal(18,6)", "sharpe_ratio": "decimal(8,4)",
    "max_drawdown": "decimal(8,6)", "total_trades": "int", "winning_trades": "int",
    "losing_trades": "int", "win_rate": "decimal(5,3)", "avg_win": "decimal(12,4)",
    "avg_loss": "decimal(12,4)", "profit_factor": "decimal(8,4)",
}


def json_parse_results(runs: DataFrame) -> DataFrame:
    """A JSON result object per run as one typed row; absent fields are NULL."""
    schema = ", ".join(f"{n} string" for n in RESULT)
    doc = runs.withColumn("r", F.from_json("results", schema))
    return doc.select(
        "run_id", "timeframe", *[c(f"r.{n}").try_cast(t).alias(n) for n, t in RESULT.items()]
    )
