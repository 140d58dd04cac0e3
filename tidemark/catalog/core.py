"""Registration of queries and assembly of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import Tables

#: Named sub-queries usable in any twin; a twin pulls in those it mentions.
CTE: dict[str, str] = {}


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    digits: dict[str, int]


ENTRIES: dict[str, Entry] = {}


def cte(name: str, body: str) -> None:
    if name in CTE:
        raise ValueError(f"duplicate sub-query {name}")
    CTE[name] = body.strip()


def register(
    name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, doubles: str = ""
) -> None:
    """``doubles``: computed columns compared to 6 places (or ``name:places``)."""
    if name in ENTRIES:
        raise ValueError(f"duplicate query {name}")
    digits = {}
    for item in doubles.split():
        column, _, places = item.partition(":")
        digits[column] = int(places or 6)
    ENTRIES[name] = Entry(name, run, sql, digits)


def _nudge(places: int) -> tuple[float, float]:
    # a hair above one half, so exact decimal ties round alike in both engines
    return float(10**places), 0.50037


def _spark_rounded(column: str, places: int):
    scale, half = _nudge(places)
    return F.floor(F.col(column) * F.lit(scale) + F.lit(half)) / F.lit(scale)


def run_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = ENTRIES[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = entry.run(Tables(spark, sf_dir))
        return df.select(*[
            _spark_rounded(c, entry.digits[c]).alias(c) if c in entry.digits else F.col(c)
            for c in df.columns
        ])

    return call


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in CTE and word not in order:
                visit(CTE[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    return order


def twin(name: str) -> str | None:
    entry = ENTRIES[name]
    if entry.sql is None:
        return None
    body = entry.sql.strip()
    parts = [f"{n} AS ({CTE[n]})" for n in _needed(body)]
    parts.append(f"final_rows AS ({body})")
    rounded = []
    for column, places in entry.digits.items():
        scale, half = _nudge(places)
        rounded.append(f"floor({column} * {scale!r}::DOUBLE + {half!r}::DOUBLE) / {scale!r}::DOUBLE AS {column}")
    star = f"* REPLACE ({', '.join(rounded)})" if rounded else "*"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {star} FROM final_rows"
