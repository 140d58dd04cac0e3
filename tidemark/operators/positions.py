"""Positions after each trade, also where one symbol holds most of the trades.

Buying adds to the position at its price; selling more than is held is rejected.
A symbol of few trades is walked in one task. One of many is cut into row blocks
that are summarised at the same time:

* What a block does to the quantity is a table: for each quantity it may start
  with, the one it ends with. Beyond the largest shortfall of the block nothing is
  rejected, so the table ends there and the rest is one addition.
* Given the quantity at its start, what it does to cost and profit is affine.

Both summaries are chained block by block, which takes one row a block, and the
blocks are then marked, again all at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import Series, null_safe_join, positions
from tidemark.sources.storage import stage

c = F.col
ORDER = ("date", "order_id", "line", "part_id")
#: trades of a symbol walked in one task, and of one block beyond that
BLOCK_TRADES = 200_000
OUT = ("_taken", "position_quantity", "average_price", "trade_pnl", "realized_pnl")
#: quantity held, its average price, profit realised so far
FLAT = (0.0, 0.0, 0.0)


def prepared(trades: DataFrame) -> DataFrame:
    """Trades with their signed effect: zero for one that can't be executed whatever is held."""
    way = F.when(c("signal_type").isin("buy", "cover"), 1.0).when(c("signal_type").isin("sell", "short"), -1.0).otherwise(0.0)
    sound = (c("quantity") >= 0) & ~F.isnan("quantity") & c("price").isNotNull() & ~F.isnan("price")
    fees = F.coalesce(c("commission"), F.lit(0.0)) + F.coalesce(c("slippage"), F.lit(0.0))
    return trades.select(
        "symbol", *ORDER, "signal_type", "quantity", "price",
        F.when(sound, way * c("quantity")).otherwise(0.0).alias("_step"), F.when(sound, way).otherwise(0.0).alias("_way"),
        fees.cast("double").alias("_fees"))


# -- walking ------------------------------------------------------------------------
def walk(step: np.ndarray, way: np.ndarray, price: np.ndarray, fees: np.ndarray, carry=FLAT) -> tuple[list[np.ndarray], tuple]:
    """(taken, held, average, gain, realised) after each trade, and what is carried on."""
    held, avg, _ = carry
    n = len(step)
    taken, after, average, gain = np.zeros(n, bool), np.empty(n), np.empty(n), np.full(n, np.nan)
    for i, (s, w, p, fee) in enumerate(zip(step.tolist(), way.tolist(), price.tolist(), fees.tolist(), strict=True)):
        if w and held + s >= 0:
            taken[i] = True
            left = held + s
            if w < 0:
                gain[i] = s * avg - s * p - fee
            elif left:
                avg = (held * avg + s * p) / left
            # what is left keeps its average; nothing left has none
            held, avg = left, avg if left else 0.0
        after[i], average[i] = held, avg
    realised = np.cumsum(np.concatenate(([carry[2]], np.nan_to_num(gain))))
    return [taken, after, average, gain, realised[1:]], (held, avg, float(realised[-1]))


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Effect, way, price and fees; a missing price belongs to a trade without way."""
    price = rows.column("price").cast(pa.float64()).fill_null(0.0)
    columns = [rows.column("_step"), rows.column("_way"), price, rows.column("_fees")]
    return tuple(np.asarray(x.to_pandas()) for x in columns)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted trades of whole symbols; the open position is all that goes from batch to batch."""
    symbol, carry, started = None, FLAT, False
    for batch in batches:
        if not batch.num_rows:
            continue
        step, way, price, fees = _arrays(batch)
        names = batch.column("symbol").dictionary_encode(null_encoding="encode")
        runs = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1))
        parts = []
        for a, e in zip(runs, [*runs[1:], batch.num_rows], strict=True):
            now = batch.column("symbol")[int(a)].as_py()
            if not started or now != symbol:
                symbol, carry, started = now, FLAT, True
            out, carry = walk(step[a:e], way[a:e], price[a:e], fees[a:e], carry)
            parts.append(out)
        new = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *OUT])


# -- blocks -------------------------------------------------------------------------------
def exits(lots: np.ndarray) -> tuple[int, np.ndarray]:
    """(net, table): a block started with x lots ends with ``table[x]``, or ``x + net`` beyond the table.

    Built from the last trade back. Before a purchase of s lots the table is that
    after it, from place s on; before a sale of q lots its first q places, where the
    sale is rejected, stand twice. So the work is the number of lots.
    """
    table = np.empty(int(-lots[lots < 0].sum()), np.int64)
    start, net = len(table), 0
    for s in lots[::-1].tolist():
        if s < 0:
            known = min(len(table) - start, -s)
            head = table[start : start + known]
            if known < -s:
                head = np.concatenate((head, np.arange(known, -s) + net))
            table[start + s : start] = head
        start = min(start + s, len(table))
        net += s
    return net, table[start:]


def affine(step: np.ndarray, way: np.ndarray, price: np.ndarray, fees: np.ndarray, held: float) -> tuple[float, float, float, float]:
    """(m, b, r, d): a block started with ``held`` and cost C ends with cost ``m C + b`` and ``r + d C`` more profit."""
    m, b, r, d = 1.0, 0.0, 0.0, 0.0
    for s, w, p, fee in zip(step.tolist(), way.tolist(), price.tolist(), fees.tolist(), strict=True):
        if not w or held + s < 0:
            continue
        if w > 0:
            b += s * p
        else:
            each, left = (1 / held, (held + s) / held) if held else (0.0, 0.0)
            r += -s * (p - b * each) - fee
            d += s * m * each
            m, b = m * left, b * left
        held += s
    return m, b, r, d


def _sorted(block: pa.Table) -> pa.Table:
    return block.sort_by("_pos").combine_chunks()


def _exit_tables(lot: float):
    def summary(block: pa.Table) -> pa.Table:
        block = _sorted(block)
        step, _, _, _ = _arrays(block)
        lots = np.rint(step / lot)
        if not np.allclose(lots * lot, step, rtol=1e-12, atol=lot * 1e-6):
            raise ValueError(f"a quantity is no multiple of the lot {lot}; give the smallest unit traded as lot")
        net, table = exits(lots.astype(np.int64))
        return pa.table({
            "symbol": block.column("symbol").slice(0, 1), "_block": block.column("_block").slice(0, 1),
            "_net": pa.array([net]), "_table": pa.array([table.tobytes()], pa.binary())})

    return summary


def _costs(block: pa.Table) -> pa.Table:
    block = _sorted(block)
    held = block.column("_held")[0].as_py()
    values = affine(*_arrays(block), held)
    return pa.table({
        "symbol": block.column("symbol").slice(0, 1), "_block": block.column("_block").slice(0, 1), "_held": pa.array([held]),
        **{n: pa.array([x]) for n, x in zip(("_m", "_b", "_r", "_d"), values, strict=True)}})


def _marks(block: pa.Table) -> pa.Table:
    block = _sorted(block)
    held, cost, realised = (block.column(n)[0].as_py() for n in ("_held", "_cost", "_realized"))
    out, _ = walk(*_arrays(block), (held, cost / held if held else 0.0, realised))
    kept = block.drop_columns(["_pos", "_block", "_held", "_cost", "_realized"])
    for name, x in zip(OUT, out, strict=True):
        kept = kept.append_column(name, pa.array(x))
    return kept


def _chain(start: tuple, follow: Callable[[dict, tuple], tuple], names: tuple[str, ...]):
    """State before each block; the rows of a symbol come in block order."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state, started = None, start, False
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for row in rows:
                if not started or row["symbol"] != symbol:
                    symbol, state, started = row["symbol"], start, True
                out.append(state)
                state = follow(row, state)
            columns = [pa.array([s[k] for s in out], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("_block"), *columns], ["symbol", "_block", *names])

    return step


def _after(lot: float):
    def follow(row: dict, state: tuple) -> tuple:
        x = round(state[0] / lot)
        table = row["_table"]
        end = int(np.frombuffer(table, np.int64, 1, 8 * x)[0]) if 8 * x < len(table) else x + row["_net"]
        return (end * lot,)

    return follow


def _carried(row: dict, state: tuple) -> tuple:
    cost, realised = state
    return row["_m"] * cost + row["_b"], realised + row["_r"] + row["_d"] * cost


def in_blocks(rows: DataFrame, block_trades: int, lot: float) -> DataFrame:
    """Marks of symbols of any length: no task sees more than a block, and the chains one row a block."""
    symbol = rows.schema["symbol"].dataType.simpleString()
    placed = positions(rows, Series(order=ORDER)).withColumn("_block", F.floor(c("_pos") / block_trades))
    placed = stage(placed, "trade_blocks")
    by = ["symbol", "_block"]

    def chained(df: DataFrame, start: tuple, follow, names: tuple[str, ...]) -> DataFrame:
        schema = f"symbol {symbol}, _block bigint, " + ", ".join(f"{n} double" for n in names)
        return df.repartition("symbol").sortWithinPartitions(*by).mapInArrow(_chain(start, follow, names), schema)

    tables = placed.groupBy(*by).applyInArrow(_exit_tables(lot), f"symbol {symbol}, _block bigint, _net bigint, _table binary")
    held = stage(chained(tables, (0.0,), _after(lot), ("_held",)), "block_quantities")
    costs = null_safe_join(placed, held, by).groupBy(*by).applyInArrow(
        _costs, f"symbol {symbol}, _block bigint, _held double, _m double, _b double, _r double, _d double")
    costs = stage(costs, "block_costs")
    carry = null_safe_join(chained(costs, (0.0, 0.0), _carried, ("_cost", "_realized")), costs.select(*by, "_held"), by)
    return null_safe_join(placed, carry, by).groupBy(*by).applyInArrow(_marks, _schema(rows))


def _schema(rows: DataFrame) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return f"{kept}, _taken boolean, position_quantity double, average_price double, trade_pnl double, realized_pnl double"


# -- the operator ----------------------------------------------------------------------------
def positions_mark(trades: DataFrame, block_trades: int = BLOCK_TRADES, lot: float = 1.0) -> DataFrame:
    """Position after each trade: average cost, realised and open profit.

    Symbols of more than ``block_trades`` trades go block by block; for them all
    quantities have to be multiples of ``lot``. A trade of an unknown side, without
    quantity or price, of a negative quantity, or of more than is held is rejected;
    missing fees are none. Trades without symbol are a symbol of their own.
    """
    rows = prepared(trades)
    large = stage(trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > block_trades).select("symbol"), "large_symbols")
    if large.isEmpty():
        few, many = rows, None
    else:
        same = rows["symbol"].eqNullSafe(large["symbol"])
        few, many = rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")
    marked = few.repartition("symbol").sortWithinPartitions("symbol", *ORDER).mapInArrow(_walked, _schema(rows))
    if many is not None:
        marked = marked.unionByName(in_blocks(many, block_trades, lot))
    gain, q, average = c("trade_pnl"), c("position_quantity"), c("average_price")
    opened = (c("price") - average) * q
    return marked.select(
        "symbol", *ORDER, "signal_type", "quantity", "price", F.when(c("_taken"), "executed").otherwise("rejected").alias("status"),
        "position_quantity", "average_price", F.when(~F.isnan(gain), gain).alias("trade_pnl"), "realized_pnl",
        (q * c("price")).alias("market_value"), opened.alias("unrealized_pnl"), (opened + c("realized_pnl")).alias("total_pnl"))
