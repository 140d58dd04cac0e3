"""Market-breadth and trading-signal analytics as Spark DataFrame operators."""
