"""Information-driven bars: tick, volume and dollar bars with their features.

Bars restart each day; a tick whose cumulated quantity reaches the threshold
opens the next bar, and a large tick may skip ids.  Everything is computed with
one shuffle by ``(symbol, date)``: windows number the ticks, and the group-by of
a bar needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio


def day_window() -> WindowSpec:
    return Window.partitionBy("symbol", "date").orderBy("ts", "seq")


def tick_sign(price: Column, frame: WindowSpec) -> Column:
    """Sign of the price change; zeros carry the last sign and the first is +1."""
    move = F.nullif(F.signum(price - F.lag(price).over(frame)), F.lit(0.0))
    return move


def with_tick_rule(ticks: DataFrame) -> DataFrame:
    """Ticks with ``date`` and ``rule`` (+1 or -1), restarting each day."""
    w = day_window()
    dated = ticks.withColumn("date", F.to_date("ts"))
    moved = dated.withColumn("_move", tick_sign(F.col("price"), w))
    carried = F.last("_move", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn("rule", F.coalesce(carried, F.lit(1.0)).cast("int")).drop("_move")


def calibrate(ticks: DataFrame, bars_a_day: int = 10) -> DataFrame:
    """``symbol, tick_t, volume_t, dollar_t``: thresholds for a number of bars a day."""
    daily = ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("ticks"), F.sum("vol").alias("volume"), F.sum((F.col("price") * F.col("vol")).cast("decimal(28,2)")).alias("dollars")
    )
    floor = lambda c: F.floor(F.avg(F.col(c).cast("double")) / bars_a_day).cast("long")
    return daily.groupBy("symbol").agg(floor("ticks").alias("tick_t"), floor("volume").alias("volume_t"), floor("dollars").alias("dollar_t"))


def rounded_threshold(value: Column) -> Column:
    """Half-even rounding to tens, at least 1."""
    return F.greatest(F.bround(value.cast("double"), -1), F.lit(1.0))


def assign(ruled: DataFrame, kind: str, threshold: float | Column) -> DataFrame:
    """``bar_id`` within the day for ``kind`` in tick, volume, dollar."""
    w = day_window()
    limit = rounded_threshold(F.lit(threshold) if isinstance(threshold, int | float) else threshold)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if kind == "tick":
        done = (F.row_number().over(w) - 1).cast("double")
    elif kind == "volume":
        done = F.sum("vol").over(so_far).cast("double")
    elif kind == "dollar":
        done = F.sum((F.col("price") * F.col("vol")).cast("decimal(28,2)")).over(so_far).cast("double")
    else:
        raise ValueError(f"unknown kind of bar: {kind}")
    return ruled.withColumn("bar_id", F.floor(done / limit).cast("long"))


def aggregate(dealt: DataFrame) -> DataFrame:
    """One row per bar: prices, times of the extremes, volume, spread, features."""
    w = day_window()
    lead = F.lag("bar_id").over(w)
    later = F.coalesce(lead == F.col("bar_id"), F.lit(False))
    rows = dealt.withColumn("_later", later)
    at = F.struct("ts", "seq")
    up, down = F.col("_later") & (F.col("rule") == 1), F.col("_later") & (F.col("rule") == -1)
    vol, worth = F.col("vol"), F.sqrt(F.col("price") * F.col("vol"))
    total = lambda c, x: F.sum(F.when(c, x).otherwise(F.lit(0)))
    return rows.groupBy("symbol", "date", "bar_id").agg(
        F.min_by("price", at).alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", at).alias("close_price"),
        F.min("ts").alias("open_date"),
        F.min_by("ts", F.struct(-F.col("price"), F.col("ts"), F.col("seq"))).alias("high_date"),
        F.min_by("ts", F.struct("price", "ts", "seq")).alias("low_date"),
        F.max("ts").alias("close_date"),
        F.stddev_pop("price").alias("basic_volatility"),
        F.sum("vol").alias("bar_cum_volume"),
        F.count("*").alias("n_ticks"),
        total(up, F.lit(1)).cast("double").alias("feat_buyInitTotal"),
        total(down, F.lit(1)).cast("double").alias("feat_sellInitTotal"),
        total(F.col("_later"), vol * F.col("rule")).cast("double").alias("feat_signVolSide"),
        total(up, vol).cast("double").alias("feat_accumulativeVolBuyInit"),
        total(down, vol).cast("double").alias("feat_accumulativeVolSellInit"),
        F.sum(F.col("price") * vol).alias("feat_accumulativeDollarValue"),
        F.sum(F.when(F.col("_later"), worth * F.col("rule")).otherwise(0.0)).alias("feat_hasbrouckSign"),
        ratio(F.sum(F.col("price") * vol), F.sum("vol"), 0.0).alias("vwap"),
    )


def bars(ticks: DataFrame, kind: str = "volume", threshold: float | Column = 500) -> DataFrame:
    """Ticks to bars of one kind; a column threshold may vary by symbol."""
    return aggregate(assign(with_tick_rule(ticks), kind, threshold))


def calibrated_bars(ticks: DataFrame, kind: str = "volume", bars_a_day: int = 10) -> DataFrame:
    """Bars whose thresholds come from each symbol's own daily averages."""
    joined = with_tick_rule(ticks).join(calibrate(ticks, bars_a_day), "symbol")
    return aggregate(assign(joined, kind, F.col(f"{kind}_t")).drop("tick_t", "volume_t", "dollar_t"))


def bar_counts(ticks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Number of bars per symbol and day."""
    return assign(with_tick_rule(ticks), kind, threshold).groupBy("symbol", "date").agg(F.countDistinct("bar_id").alias("n_bars"))


def time_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Bars over tumbling (or sliding) windows of time: mean, VWAP, OHLC, volume."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    at = F.struct("ts", "seq")
    return (
        ticks.groupBy("symbol", window.alias("w"))
        .agg(
            F.count("*").alias("n_ticks"), F.avg("price").alias("mean_price"), ratio(F.sum(F.col("price") * F.col("vol")), F.sum("vol"), 0.0).alias("vwap"),
            F.min_by("price", at).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", at).alias("close_price"), F.sum("vol").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("start"), "n_ticks", "mean_price", "vwap", "open_price", "high_price", "low_price", "close_price", "volume")
    )


def session_bars(ticks: DataFrame, gap: str = "4 hours") -> DataFrame:
    """Bars over bursts of ticks that are less than ``gap`` apart."""
    return ticks.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_ticks"), F.sum("vol").alias("volume")).select("symbol", F.col("w.start").alias("start"), "n_ticks", "volume")


def equal_count_bars(ticks: DataFrame, n: int = 8) -> DataFrame:
    """Each day of a symbol cut into ``n`` runs of equal numbers of ticks."""
    dealt = ticks.withColumn("date", F.to_date("ts")).withColumn("part", F.ntile(n).over(day_window()))
    at = F.struct("ts", "seq")
    return dealt.groupBy("symbol", "date", "part").agg(F.count("*").alias("n_ticks"), F.avg("price").alias("mean_price"), F.max_by("price", at).alias("close_price"), F.sum("vol").alias("volume"))


def daily(ticks: DataFrame) -> DataFrame:
    """First, last, high, low, volume and VWAP of each symbol and day."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.sum("vol").alias("volume"), F.count("*").alias("n_ticks"), ratio(F.sum(F.col("price") * F.col("vol")), F.sum("vol"), 0.0).alias("vwap"),
    )


def scaled_bars(ticks: DataFrame, kind: str = "tick", bars_a_day: int = 10, scale: float | None = None) -> DataFrame:
    """``symbol, date, bar, start, vwap``: bars of a day's own size.

    A day's ticks (or volume) by ``bars_a_day``, rounded half-even to tens, times
    ``scale`` (a quarter for ticks, a fifth for volume) is the size of its bars,
    which are numbered from 1 and begin at their first tick.  A size of 0 makes
    the whole day one bar.
    """
    w = day_window()
    whole = Window.partitionBy("symbol", "date")
    own = ticks.withColumn("date", F.to_date("ts"))
    total = F.count("*").over(whole) if kind == "tick" else F.sum("vol").over(whole)
    done = F.row_number().over(w) - 1 if kind == "tick" else F.sum("vol").over(w.rowsBetween(Window.unboundedPreceding, 0))
    size = F.bround(total.cast("double") / bars_a_day, -1) * (scale or (0.25 if kind == "tick" else 0.2))
    cut = own.withColumn("_id", F.coalesce(F.floor(F.try_divide(done.cast("double"), size)), F.lit(0)))
    made = cut.groupBy("symbol", "date", "_id").agg(F.min("ts").alias("start"), ratio(F.sum(F.col("price") * F.col("vol")), F.sum("vol"), 0.0).alias("vwap"))
    return made.withColumn("bar", F.row_number().over(whole.orderBy("_id")).cast("long")).select("symbol", "date", "bar", "start", "vwap")
