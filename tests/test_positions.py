"""Positions: blocks of one symbol equal the walk over all of it."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import positions

SIDES = ["buy", "sell", "short", "cover", "hold", None]
SCHEMA = ("symbol {}, date date, order_id bigint, line int, part_id bigint, signal_type string, quantity double, price double, "
          "commission double, slippage double")


def fold(trades):
    """One trade after the other, by the book: {order_id: (status, quantity, average, gain, realised)}."""
    out, state = {}, {}
    for sym, date, order, line, part, side, q, p, com, slip in sorted(trades, key=lambda t: t[1:5]):
        held, avg, done = state.get(sym, (0.0, 0.0, 0.0))
        status, gain = "rejected", None
        if side in ("buy", "cover") and q is not None and p is not None and q >= 0:
            status = "executed"
            avg = (held * avg + q * p) / (held + q) if held + q > 0 else 0.0
            held += q
        elif side in ("sell", "short") and q is not None and p is not None and 0 <= q <= held:
            status, gain = "executed", q * p - q * avg - (com or 0.0) - (slip or 0.0)
            held -= q
            done += gain
            avg = avg if held else 0.0
        state[sym] = (held, avg, done)
        out[order] = (status, held, avg, gain, done)
    return out


def trades(n, seed, symbols, lot=1.0, bias=0.5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        side = rng.choice(SIDES) if rng.random() < 0.1 else ("buy" if rng.random() < bias else "sell")
        q = None if rng.random() < 0.01 else -lot if rng.random() < 0.01 else rng.randint(0, 50) * lot
        p = None if rng.random() < 0.01 else round(rng.uniform(1, 20), 2)
        out.append((rng.choice(symbols), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 60)), i, rng.randint(1, 3), 7, side, q, p,
                    rng.choice([None, 1.0]), 0.25))
    return out


@pytest.mark.parametrize(("kind", "symbols", "block", "lot", "bias"), [
    ("string", ["HOT"] * 8 + ["a", "b", None], 40, 1.0, 0.5), ("bigint", [1], 17, 1.0, 0.3),
    ("string", ["x", None], 64, 0.25, 0.6), ("string", ["HOT"] * 8 + ["a"], 100_000, 0.1, 0.5)])
def test_blocks_equal_the_fold(spark, kind, symbols, block, lot, bias):
    rows = trades(1500, 4, symbols, lot, bias)
    df = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(5)
    got = {r["order_id"]: r for r in positions.positions_mark(df, block, lot).collect()}
    want = fold(rows)
    assert len(got) == len(want)
    for order, (status, held, avg, gain, done) in want.items():
        r = got[order]
        assert r["status"] == status, order
        assert r["position_quantity"] == pytest.approx(held, abs=1e-9)
        assert r["average_price"] == pytest.approx(avg, rel=1e-9, abs=1e-9)
        assert (r["trade_pnl"] is None) == (gain is None) and (gain is None or r["trade_pnl"] == pytest.approx(gain, rel=1e-9, abs=1e-7))
        assert r["realized_pnl"] == pytest.approx(done, rel=1e-9, abs=1e-6)
        assert r["market_value"] == (None if r["price"] is None else pytest.approx(held * r["price"]))


def test_blocks_of_a_hot_symbol_are_many_tasks_rows(spark):
    """No group that reaches Python is larger than a block."""
    rows = trades(3000, 5, ["HOT"] * 9 + ["a"])
    df = spark.createDataFrame(rows, SCHEMA.format("string"))
    placed = positions.positions(positions.prepared(df.filter("symbol = 'HOT'")), positions.Series(order=positions.ORDER))
    sizes = placed.groupBy(F.floor(F.col("_pos") / 100)).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) == 100


@pytest.mark.parametrize("seed", range(30))
def test_exit_table_equals_walking_from_every_start(seed):
    rng = np.random.default_rng(seed)
    lots = rng.integers(-9, 10 - seed % 7, rng.integers(0, 40))
    net, table = positions.exits(lots)
    assert net == lots.sum()
    for x in range(len(table) + 20):
        y = x
        for s in lots:
            y = y + s if y + s >= 0 else y
        assert y == (table[x] if x < len(table) else x + net)


def test_cost_and_profit_of_a_block_are_affine():
    rng = np.random.default_rng(1)
    way = rng.choice([-1.0, 0.0, 1.0], 60)
    step, price, fees = way * rng.integers(0, 9, 60), rng.uniform(1, 9, 60), np.full(60, 0.1)
    for held, cost in ((0.0, 0.0), (5.0, 20.0), (40.0, 99.0)):
        m, b, r, d = positions.affine(step, way, price, fees, held)
        _, (left, avg, done) = positions.walk(step, way, price, fees, (held, cost / held if held else 0.0, 3.0))
        assert left * avg == pytest.approx(m * cost + b) and done == pytest.approx(3.0 + r + d * cost)


def test_quantities_between_lots_are_refused(spark):
    rows = [("A", dt.date(2024, 1, 1), i, 1, 1, "buy", 1.5, 2.0, None, None) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA.format("string"))
    with pytest.raises(Exception, match="multiple of the lot"):
        positions.positions_mark(df, 2).collect()
    assert [r["position_quantity"] for r in positions.positions_mark(df, 2, lot=0.5).orderBy("order_id").collect()] == [1.5, 3.0, 4.5, 6.0]
    assert positions.positions_mark(df.limit(0)).count() == 0
