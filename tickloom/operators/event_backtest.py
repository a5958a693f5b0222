"""An event-driven backtester as a keyed fold over heartbeats.

Each symbol's heartbeats pass through a strategy in order; its signals become
orders, fills and positions in the fold's small state.  Ledgers of cash and
holdings are running sums over the fills, and pending stop and limit orders find
their first crossing tick by the same search as the triple barrier.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.functions.fold import fold
from tickloom.operators.bars import time_bars
from tickloom.operators.crossing import first_crossings

FILLS = "symbol string, start timestamp, price double, signal string, quantity long"


class Strategy(Protocol):
    """Sees a symbol's heartbeats one by one; says LONG, SHORT, EXIT or nothing."""

    def on_bar(self, start: pd.Timestamp, price: float, volume: float) -> tuple[str, float] | None: ...


class Alternating:
    """The sample: long, and out at every heartbeat not divisible by three."""

    def __init__(self):
        self.periods = 0

    def on_bar(self, start, price, volume):
        self.periods += 1
        return ("EXIT", 1.0) if self.periods % 3 else ("LONG", 1.0)


def heartbeats(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Half-open windows of ticks: ``symbol, start, price`` (the last), ``volume``."""
    return time_bars(ticks, width).select("symbol", "start", F.col("close_price").alias("price"), "vwap", "volume")


def order_quantity(signal: str, strength: float, position: int, lot: int = 100) -> int:
    """Entries only when flat; an exit reverses the position."""
    size = int(lot * strength)
    if signal == "LONG" and position == 0:
        return size
    if signal == "SHORT" and position == 0:
        return -size
    return -position if signal == "EXIT" else 0


def simulate(beats: DataFrame, strategy: Callable[[], Strategy], lot: int = 100) -> DataFrame:
    """Fills ``symbol, start, price, signal, quantity`` at each heartbeat's price."""

    def step(state, rows: pd.DataFrame):
        player, position = state
        out = []
        for start, price, volume in zip(rows["start"], rows["price"].tolist(), rows["volume"].tolist(), strict=True):
            said = player.on_bar(start, price, volume)
            if said is None:
                continue
            quantity = order_quantity(said[0], said[1], position, lot)
            if quantity:
                position += quantity
                out.append((rows["symbol"].iloc[0], start, price, said[0], quantity))
        return (player, position), pd.DataFrame(out, columns=["symbol", "start", "price", "signal", "quantity"]).astype({"price": float, "quantity": np.int64})

    return fold(beats.select("symbol", "start", "price", "volume"), ["symbol"], ["start"], lambda: (strategy(), 0), step, FILLS)


def commission(quantity: Column) -> Column:
    """Per-share fees with a floor."""
    q = F.abs(quantity)
    return F.when(q == 0, 0.0).when(q <= 500, F.greatest(F.lit(1.3), 0.013 * q)).otherwise(F.greatest(F.lit(1.3), 0.008 * q))


def ledger(beats: DataFrame, fills: DataFrame) -> DataFrame:
    """``symbol, start, held, market_value, cash_flow, fees``: state before the
    heartbeat's own fills, which show from the next row on."""
    own = beats.select("symbol", "start", "price").join(fills.select("symbol", "start", "quantity"), ["symbol", "start"], "left").withColumn("quantity", F.coalesce("quantity", F.lit(0)))
    before = Window.partitionBy("symbol").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return own.select(
        "symbol", "start", past(F.col("quantity")).alias("held"), (past(F.col("quantity")) * F.col("price")).alias("market_value"),
        past((-F.col("quantity") * F.col("price")).cast("decimal(28,6)")).cast("double").alias("cash_flow"), past(commission(F.col("quantity")).cast("decimal(28,6)")).cast("double").alias("fees"),
    )


def equity(ledgers: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """``start, cash, holdings, total, ret, growth, fall`` over all symbols.

    Symbols without a heartbeat at a time keep their last state.
    """
    w = Window.partitionBy("symbol").orderBy("start")
    names = ("market_value", "cash_flow", "fees")
    # Changes of state add up over symbols and then over times; no grid of symbols and times is made.
    money = lambda c: F.col(c).cast("decimal(28,6)")
    moved = ledgers.select("start", *[(money(c) - F.coalesce(F.lag(money(c)).over(w), F.lit(0).cast("decimal(28,6)"))).alias(c) for c in names])
    by_time = moved.groupBy("start").agg(*[F.sum(c).alias(c) for c in names])
    order = Window.orderBy("start")  # one row per time
    total = by_time.select("start", *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias(c) for c in names])
    out = total.select("start", (capital + F.col("cash_flow") - F.col("fees")).alias("cash"), F.col("market_value").alias("holdings"), (capital + F.col("cash_flow") - F.col("fees") + F.col("market_value")).alias("total"))
    ret = F.coalesce(ratio(F.col("total"), F.lag("total").over(order)) - 1, F.lit(0.0))
    out = out.withColumn("ret", ret)
    return out.withColumn("growth", ratio(F.col("total"), F.lit(capital))).withColumn("fall", F.least("ret", F.lit(0.0)))


def summary(curve: DataFrame, periods: int = 252) -> DataFrame:
    """Total return, annualised Sharpe ratio (population deviation) and worst fall."""
    return curve.agg((F.max_by("growth", "start") - 1).alias("total_return"), (ratio(F.avg("ret"), F.stddev_pop("ret")) * periods**0.5).alias("sharpe"), F.min("fall").alias("worst_fall"), F.count("*").alias("beats"))


def pending_fills(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """``order_id, ts, price`` of the first tick that reaches a pending order.

    ``orders``: ``order_id, symbol, placed, kind`` (STP or LMT), ``side`` (1 buy,
    -1 sell), ``target``, ``expires``.  A stop fills at or beyond its target, a
    limit at or inside it, after the order was placed and up to its end.
    """
    rising = F.coalesce((F.col("kind") == "STP") == (F.col("side") == 1), F.lit(False))
    spans = orders.select(
        "order_id", "symbol", F.col("placed").alias("_after"), (F.col("expires") + F.expr("INTERVAL 1 MICROSECOND")).alias("_before"),
        F.when(rising, F.col("target")).alias("_above"), F.when(~rising, F.col("target")).alias("_below"),
    )
    return first_crossings(spans, ticks, ["order_id"], touch=True).where("hit IS NOT NULL").select("order_id", "hit.ts", "hit.price")


def latest(beats: DataFrame, n: int) -> DataFrame:
    """The last ``n`` heartbeats of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("start"))
    return beats.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
