"""Imbalance bars: a bar closes when signed flow exceeds its expectation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.functions.fold import Kernel, fold


def size_of(kind: str) -> Column:
    """What a tick weighs: 1, its volume or its dollars."""
    return {"tick": F.lit(1.0), "volume": F.col("vol").cast("double"), "dollar": F.col("price") * F.col("vol")}[kind]


def kernel(alpha_t: float = 0.1, alpha_flow: float = 0.1) -> Kernel:
    """Ticks ``price, size, e_t, e_flow`` get the ``bar_id`` of :func:`imbalance_bars`, null before the first move.

    Signs are part of the state, so that later ticks need no earlier ones.
    """

    def step(state, rows: pd.DataFrame):
        last, sign, theta, n, bar, e_t, e_flow = state
        ids = []
        for price, size, t0, flow0 in zip(*(rows[c].tolist() for c in ("price", "size", "e_t", "e_flow")), strict=True):
            if last is None:
                e_t, e_flow = t0, flow0
            else:
                sign = 1.0 if price > last else -1.0 if price < last else sign
            last = price
            ids.append(bar if sign else None)
            if not sign:
                continue
            theta, n = theta + sign * size, n + 1
            if abs(theta) >= abs(e_t * e_flow):
                e_t, e_flow = (1 - alpha_t) * e_t + alpha_t * n, (1 - alpha_flow) * e_flow + alpha_flow * theta / n
                theta, n, bar = 0.0, 0, bar + 1
        return [last, sign, theta, n, bar, e_t, e_flow], rows.assign(bar_id=pd.array(ids, "Int64"))

    return Kernel(lambda: [None, 0.0, 0.0, 0, 0, 0.0, 0.0], step, "bar_id long")


def signed_flow(ticks: DataFrame, kind: str = "volume") -> DataFrame:
    """Ticks with ``b`` (the sign of the last price move, null before one) and
    ``flow``: ``b`` times 1, the volume or the dollars."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    move = F.nullif(F.signum(F.col("price") - F.lag("price").over(w)), F.lit(0.0))
    size = size_of(kind)
    moved = ticks.withColumn("_m", move)
    signed = moved.withColumn("b", F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_m")
    return signed.withColumn("size", size).withColumn("flow", F.col("b") * size)


def expectations(flows: DataFrame, bars_a_day: int = 10) -> DataFrame:
    """``symbol, e_t, p_up, e_up, e_down, e_flow``: initial expectations from daily means."""
    up, down = F.col("b") > 0, F.col("b") < 0
    days = flows.where("b IS NOT NULL").groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n"), F.avg(F.when(up, 1.0).otherwise(0.0)).alias("p"), F.avg(F.when(up, F.col("size"))).alias("u"), F.avg(F.when(down, F.col("size"))).alias("d")
    )
    means = days.groupBy("symbol").agg((F.avg("n") / bars_a_day).alias("e_t"), F.avg("p").alias("p_up"), F.avg("u").alias("e_up"), F.avg("d").alias("e_down"))
    return means.withColumn("e_flow", F.col("p_up") * F.coalesce("e_up", F.lit(0.0)) - (1 - F.col("p_up")) * F.coalesce("e_down", F.lit(0.0)))


def imbalance_bars(flows: DataFrame, start: DataFrame, alpha_t: float = 0.1, alpha_flow: float = 0.1) -> DataFrame:
    """Ticks with ``bar_id``: the number of bars closed before the tick.

    A bar closes at the tick whose cumulated flow reaches the product of the
    expected length and flow; both expectations then move towards the bar's.
    """
    own = flows.where("flow IS NOT NULL").join(start.select("symbol", "e_t", "e_flow"), "symbol").select("symbol", "ts", "seq", "price", "vol", "flow", "e_t", "e_flow")

    def step(state, rows: pd.DataFrame):
        theta, n, bar, e_t, e_flow = state
        if e_t is None:
            e_t, e_flow = float(rows["e_t"].iloc[0]), float(rows["e_flow"].iloc[0])
        ids = []
        for x in rows["flow"].to_numpy(float).tolist():
            ids.append(bar)
            theta, n = theta + x, n + 1
            if abs(theta) >= abs(e_t * e_flow):
                e_t, e_flow = (1 - alpha_t) * e_t + alpha_t * n, (1 - alpha_flow) * e_flow + alpha_flow * theta / n
                theta, n, bar = 0.0, 0, bar + 1
        return (theta, n, bar, e_t, e_flow), rows[["symbol", "ts", "seq", "price", "vol"]].assign(bar_id=np.array(ids, np.int64))

    return fold(own, ["symbol"], ["ts", "seq"], lambda: (0.0, 0, 0, None, None), step, "symbol string, ts timestamp, seq long, price double, vol long, bar_id long")


def imbalance_counts(dealt: DataFrame) -> DataFrame:
    """Bars that end on each day of a symbol."""
    ends = dealt.groupBy("symbol", "bar_id").agg(F.max("ts").alias("ts"))
    return ends.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("n_bars"))


def earlier_matches(message: str) -> np.ndarray:
    """For each place the length of the longest match with one that starts earlier (and may run into it).

    A suffix automaton with the first place where each of its states ends.  Going
    on by one symbol takes the last match without its first symbol, by suffix
    links, and extends it: linear in the message for a fixed alphabet.
    """
    go: list[dict[str, int]] = [{}]
    link, size, ends = [-1], [0], [-1]
    last = 0
    for at, symbol in enumerate(message):
        new = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        ends.append(at)
        state = last
        while state >= 0 and symbol not in go[state]:
            go[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = go[state][symbol]
            if size[target] != size[state] + 1:
                copy = len(go)
                go.append(dict(go[target]))
                link.append(link[target])
                size.append(size[state] + 1)
                ends.append(ends[target])
                link[target] = copy
                while state >= 0 and go[state].get(symbol) == target:
                    go[state][symbol] = copy
                    state = link[state]
                target = copy
            link[new] = target
        last = new
    out = np.zeros(len(message), np.int64)
    state = length = 0
    for at in range(len(message)):
        while at + length < len(message):
            # The longer match must begin before `at` for the first time.
            step = go[state].get(message[at + length])
            if step is None or ends[step] - length >= at:
                break
            state, length = step, length + 1
        out[at] = length
        if length:
            length -= 1
            while size[link[state]] >= length and link[state] >= 0 and state:
                state = link[state]
                if size[state] == length:
                    break
    return out


def window_matches(message: str, window: int) -> np.ndarray:
    """The same among the ``window`` places before each, no match being longer than the window.

    Runs of equal symbols so many places apart, for every distance up to the window.
    """
    symbols = np.frombuffer(message.encode("utf-32-le"), np.uint32)
    n = len(symbols)
    out = np.zeros(n, np.int64)
    for apart in range(1, min(window, n - 1) + 1):
        equal = symbols[apart:] == symbols[:-apart]
        # From each place to the next unequal one.
        stop = np.where(equal, n, np.arange(apart, n))
        run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(apart, n)
        np.maximum(out[apart:], run, out=out[apart:])
    return np.minimum(out, window)


def redundancy(message: str, window: int | None = None) -> float:
    """Lempel-Ziv redundancy by the lengths of the longest earlier matches.

    Matches of a place are those with all places before it, and no longer than
    there are of these, or with ``window`` places.  0 for fewer than ten symbols.
    """
    n = len(message)
    if n < 10:
        return 0.0
    if window is None:
        at = np.arange(1, n // 2 + 1)
        longest, size = np.minimum(earlier_matches(message)[at], at), at
    else:
        at = np.arange(window, n - window + 1)
        longest, size = window_matches(message, window)[at], np.full(len(at), window)
    return float(1 - (np.log2(size + 1) / (longest + 1)).sum() / len(at) / math.log2(n)) if len(at) else 0.0


def bar_entropy(dealt: DataFrame, d: float = 0.4, window: int | None = None) -> DataFrame:
    """``symbol, date, bar_id, entropy`` of each bar's ticks: fractional
    differences of log prices, coded by whether they exceed their mean."""

    @F.pandas_udf("double")
    def coded(prices: pd.Series) -> pd.Series:
        def one(p: np.ndarray) -> float:
            x = np.log(np.asarray(p, float))
            y = x[1:] - d * x[:-1]
            return redundancy("".join("1" if v > y.mean() else "0" for v in y), window) if len(y) else 0.0

        return prices.map(one)

    # The ticks of one bar: bounded by the bar's threshold.
    listed = dealt.groupBy("symbol", "date", "bar_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "price"))), lambda t: t["price"]).alias("p"))
    return listed.select("symbol", "date", "bar_id", coded("p").alias("entropy"))


def flow_by_day(flows: DataFrame) -> DataFrame:
    """Net signed flow, gross size and imbalance of each day."""
    days = flows.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("flow").alias("net"), F.sum("size").alias("gross"))
    return days.withColumn("imbalance", ratio(F.col("net"), F.col("gross"), 0.0))
