"""Triple-barrier labels and their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.crossing import first_crossings


def triple_barrier(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """``symbol, bar, barrierPrice, barrierLabel, barrierTime`` for each bar.

    The first tick strictly between the close and the horizon whose price is
    strictly beyond a barrier decides; without one the last price and the
    horizon, label 0; without ticks price 0.  ``bars`` has ``symbol, bar,
    close_date, horizon, upper_barrier, lower_barrier``, a ``bar`` being unique
    in its symbol.
    """
    own = bars.select("symbol", "bar", "horizon", F.col("close_date").alias("_after"), F.col("horizon").alias("_before"), F.col("upper_barrier").alias("_above"), F.col("lower_barrier").alias("_below"))
    met = own.select("symbol", "bar", "horizon").join(first_crossings(own, ticks, ["symbol", "bar"]), ["symbol", "bar"], "left")
    return met.select(
        "symbol",
        "bar",
        F.coalesce("hit.price", "last.price", F.lit(0.0)).alias("barrierPrice"),
        F.coalesce("side", F.lit(0)).alias("barrierLabel"),
        F.coalesce("hit.ts", "horizon").alias("barrierTime"),
    )


def bar_barrier(bars: DataFrame, ahead: int = 10) -> DataFrame:
    """Labels from the highs and lows of the next ``ahead`` bars.

    The first bar that leaves the barriers decides; when one bar passes both,
    the barrier whose extreme came earlier in the bar.
    """
    w = Window.partitionBy("symbol").orderBy("bar")
    later = F.collect_list(F.struct("high_price", "low_price", "high_date", "low_date", "close_date")).over(w.rowsBetween(1, ahead))
    found = bars.withColumn("_next", later)

    def side(x: Column) -> Column:
        up, down = x["high_price"] > F.col("upper_barrier"), x["low_price"] < F.col("lower_barrier")
        return F.when(up & down, F.when(x["high_date"] <= x["low_date"], 1).otherwise(-1)).when(up, 1).when(down, -1).otherwise(0)

    first = F.get(F.filter(F.transform("_next", lambda x: F.struct(side(x).alias("label"), x["close_date"].alias("ts"))), lambda s: s["label"] != 0), F.lit(0))
    return found.withColumn("_hit", first).select("symbol", "bar", F.coalesce("_hit.label", F.lit(0)).alias("label"), F.col("_hit.ts").alias("hit_bar_close"))


def daily_barrier(ticks: DataFrame, volatility: DataFrame, buffer: float = 0.0) -> DataFrame:
    """The day's first crossing of the open's barriers, in four zones.

    ``zone``: 2 and -2 beyond ``1 + buffer`` volatilities, 1 and -1 beyond one,
    0 for none.
    """
    at = F.struct("ts", "seq")
    dated = ticks.withColumn("date", F.to_date("ts"))
    opened = dated.join(volatility, ["symbol", "date"]).withColumn("open", F.first("price").over(Window.partitionBy("symbol", "date").orderBy("ts", "seq")))
    up, down = F.col("open") * (1 + F.col("volatility")), F.col("open") * (1 - F.col("volatility"))
    far_up, far_down = F.col("open") * (1 + F.col("volatility") * (1 + buffer)), F.col("open") * (1 - F.col("volatility") * (1 + buffer))
    zone = F.when(F.col("price") > far_up, 2).when(F.col("price") > up, 1).when(F.col("price") < far_down, -2).when(F.col("price") < down, -1)
    return opened.groupBy("symbol", "date").agg(F.coalesce(F.min_by(zone, F.when(zone.isNotNull(), at)), F.lit(0)).alias("zone"), F.min(F.when(zone.isNotNull(), F.col("ts"))).alias("crossed"))


def three_way(ret: Column) -> Column:
    """1, -1 or 0 by the sign."""
    return F.when(ret > 0, 1).when(ret < 0, -1).otherwise(0)


def graded(ret: Column, sigma: Column) -> Column:
    """1, 0.75, 0.5, 0.25 or 0 by the return in units of volatility."""
    return F.when(ret > sigma, 1.0).when(ret > 0, 0.75).when(ret == 0, 0.5).when(ret >= -sigma, 0.25).otherwise(0.0)
