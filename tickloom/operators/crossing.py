"""The first tick beyond a bound, for many spans of time at once.

A symbol's day of ticks is cut by their number, not by the clock, so that work
does not grow with how dense the ticks are.  Each part's first and last time,
lowest and highest price are a small table.  From it a span learns the few parts
whose ticks it has to see: the one it begins in and, on each of its days, the
first later one that leaves its bounds.  There a halving search over nested
extremes finds the tick.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import micros

#: Ticks of a part; those of one time stay together.
PART = 1 << 15


def first_beyond(prices: np.ndarray, start: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each ``start`` the first place from it on whose price is over ``above`` or under ``below``; -1 for none.

    NaN is over every bound but NaN, which bounds nothing.
    """
    top, bottom, offset, n = [np.where(np.isnan(prices), np.inf, prices)], [np.where(np.isnan(prices), np.inf, prices)], [0], len(prices)
    while len(top[-1]) > 1:
        odd = len(top[-1]) % 2
        offset.append(offset[-1] + len(top[-1]))
        top.append(np.r_[top[-1], [-np.inf] * odd].reshape(-1, 2).max(1))
        bottom.append(np.r_[bottom[-1], [np.inf] * odd].reshape(-1, 2).min(1))
    highs, lows, offsets, last = np.concatenate(top), np.concatenate(bottom), np.array(offset), len(top) - 1
    out = np.full(len(start), -1)
    at, level = start.astype(np.int64), np.zeros(len(start), np.int64)
    live = np.flatnonzero(at < n)
    while len(live):
        i, k = at[live], level[live]
        node = offsets[k] + (i >> k)
        met = (highs[node] > above[live]) | (lows[node] < below[live])
        done = met & (k == 0)
        out[live[done]] = i[done]
        # Into the first half of a node that has such a price; past one that has none, and up where a wider one begins.
        on = i + np.where(met, 0, 1 << k)
        wider = ~met & ((on >> k) % 2 == 0) & (k < last)
        at[live], level[live] = on, k - (met & ~done) + wider
        live = live[~done & (on < n)]
    return out


def _parts(ticks: DataFrame, part: int) -> DataFrame:
    w = Window.partitionBy("symbol", "_day").orderBy("ts")
    own = ticks.select("symbol", F.to_date("ts").alias("_day"), "ts", "seq", F.col("price").cast("double").alias("price")).where("ts IS NOT NULL AND price IS NOT NULL")
    return own.withColumn("_part", F.floor((F.rank().over(w) - 1) / part).cast("long"))


def first_crossings(spans: DataFrame, ticks: DataFrame, keys: list[str], touch: bool = False, part: int = PART) -> DataFrame:
    """``keys, hit, side, last`` of each span that has ticks.

    ``spans``: ``keys`` (which identify a row and contain ``symbol`` or not),
    ``symbol``, ``_after`` and ``_before`` (times, both excluded), ``_above`` and
    ``_below``.  ``hit`` is the first tick (``ts, seq, price``) inside whose price is
    over ``_above`` (``side`` 1) or under ``_below`` (-1), null for none; a null bound
    bounds nothing; with ``touch`` a price at the bound will do.  ``last`` is the last
    tick inside.  Ticks without a price do not
    count.
    """
    names = list(dict.fromkeys([*keys, "symbol"]))
    dealt = _parts(ticks, part)
    sums = dealt.groupBy("symbol", "_day", "_part").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("price").alias("high"), F.min("price").alias("low"))
    days = sums.groupBy("symbol", "_day").agg(F.array_sort(F.collect_list(F.struct("_part", "first", "last", "high", "low"))).alias("_parts"))
    own = spans.select(*names, "_after", "_before", "_above", "_below").where("_after < _before")
    own = own.withColumn("_day", F.explode(F.sequence(F.to_date("_after"), F.to_date("_before")))).join(days.alias("_d"), ["symbol", "_day"])
    own = own.withColumn("_parts", F.filter("_parts", lambda x: (x["last"] > F.col("_after")) & (x["first"] < F.col("_before"))))
    over, under = F.col("_above"), F.col("_below")
    beyond = lambda x: F.coalesce(x["high"] >= over if touch else x["high"] > over, F.lit(False)) | F.coalesce(x["low"] <= under if touch else x["low"] < under, F.lit(False))
    begun = F.filter("_parts", lambda x: x["first"] <= F.col("_after"))
    later = F.filter("_parts", lambda x: (x["first"] > F.col("_after")) & beyond(x))
    wanted = F.array_distinct(F.array_compact(F.array(*[F.get(parts, F.lit(0))["_part"] for parts in (begun, later)], F.try_element_at("_parts", F.lit(-1))["_part"])))
    asked = own.select(*names, "_day", "_after", "_before", "_above", "_below", F.explode(wanted).alias("_part"))

    kinds = dict(spans.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ts long, seq long, price double, side int, last_ts long, last_seq long, last_price double"])

    def find(asked: pd.DataFrame, ticks: pd.DataFrame) -> pd.DataFrame:
        ticks = ticks.sort_values(["_t", "seq"])
        t, seq, price = (ticks[c].to_numpy() for c in ("_t", "seq", "price"))
        out = asked[keys]
        if not len(t) or not len(asked):
            return out.iloc[:0].assign(ts=0, seq=0, price=0.0, side=0, last_ts=0, last_seq=0, last_price=0.0)
        above, below = (asked[c].to_numpy(dtype=float, na_value=np.nan) for c in ("_above", "_below"))
        if touch:
            above, below = np.nextafter(above, -np.inf), np.nextafter(below, np.inf)
        start, stop = np.searchsorted(t, asked["_after"].to_numpy(), "right"), np.searchsorted(t, asked["_before"].to_numpy(), "left")
        at = first_beyond(price, start, above, below)
        hit, some = (at >= 0) & (at < stop), stop > start
        at, end = np.where(hit, at, 0), np.where(some, stop - 1, 0)
        up = (price[at] > above) | (np.isnan(price[at]) & ~np.isnan(above))
        null = lambda x, there, kind: pd.Series(x, index=out.index).astype(kind).where(there)
        return out.assign(
            ts=null(t[at], hit, "Int64"), seq=null(seq[at], hit, "Int64"), price=null(price[at], hit, "Float64"), side=null(np.where(up, 1, -1), hit, "Int32"),
            last_ts=null(t[end], some, "Int64"), last_seq=null(seq[end], some, "Int64"), last_price=null(price[end], some, "Float64"),
        )

    by = ["symbol", "_day", "_part"]
    queries = asked.select(*names, "_day", "_part", micros("_after").alias("_after"), micros("_before").alias("_before"), F.col("_above").cast("double").alias("_above"), F.col("_below").cast("double").alias("_below"))
    # Spans may come from the same ticks: other names keep the two sides apart.
    read = dealt.select(*[F.col(c).alias(f"_of_{c}") for c in by], micros("ts").alias("_t"), "seq", "price").groupBy(*[f"_of_{c}" for c in by])
    found = queries.groupBy(*by).cogroup(read).applyInPandas(find, schema)
    tick = lambda t, s, p: F.when(F.col(t).isNotNull(), F.struct(F.timestamp_micros(t).alias("ts"), F.col(s).alias("seq"), F.col(p).alias("price")))
    hit = F.when(F.col("ts").isNotNull(), F.struct(tick("ts", "seq", "price").alias("tick"), "side"))
    one = found.groupBy(*keys).agg(F.min(hit).alias("_hit"), F.max(tick("last_ts", "last_seq", "last_price")).alias("last"))
    return one.select(*keys, F.col("_hit.tick").alias("hit"), F.col("_hit.side").alias("side"), "last")
