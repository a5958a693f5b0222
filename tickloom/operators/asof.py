"""As-of joins and time-lagged lookups without range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its time.

    Both sides are united, sorted once per key, and values are carried forward:
    one shuffle, linear in the rows.  ``strict`` excludes equal times.
    """
    side = 0 if strict else 1
    l_rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 - side).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    r_rows = right.select(*keys, F.col(right_time).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(l_rows.schema["_l"].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    order = F.when(F.col("_side") == side, 0 if not strict else 1).otherwise(1 if not strict else 0)
    w = Window.partitionBy(*keys).orderBy("_t", order).rowsBetween(Window.unboundedPreceding, 0)
    carried = l_rows.unionByName(r_rows).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return carried.where(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns])


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def lagged_value(value: str, time: str, keys: Sequence[str], lag_micros: int, strict: bool = True) -> Column:
    """The last value before ``time - lag``, by a range frame over microseconds."""
    w = Window.partitionBy(*keys).orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -(lag_micros + (1 if strict else 0)))
    return F.last(value).over(w)


def first_time_after(time: str, keys: Sequence[str], lead_micros: int) -> Column:
    """The first time at or after ``time + lead``.

    Read backwards, it is the last of the rows so far: a frame that only grows,
    instead of one that is summed up anew for each row.
    """
    w = Window.partitionBy(*keys).orderBy(-micros(time)).rangeBetween(Window.unboundedPreceding, -lead_micros)
    return F.last(time).over(w)


def align(df: DataFrame, symbols: Sequence[str], time: str = "ts", value: str = "price") -> DataFrame:
    """One column per symbol on the union of times, carried forward, complete rows only.

    Times at which two symbols tick are one row; the pivot is one aggregation.
    Values are carried forward inside each day, and from day to day over one row
    per day, so that no task sees the whole series.
    """
    wide = df.groupBy(time).pivot("symbol", list(symbols)).agg(F.max(value)).withColumn("_day", F.to_date(time))
    q = lambda s: F.col(f"`{s}`")
    days = wide.groupBy("_day").agg(*[F.max_by(q(s), F.when(q(s).isNotNull(), F.col(time))).alias(s) for s in symbols])
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    carried = days.select("_day", F.struct(*[F.last(q(s), ignorenulls=True).over(before).alias(s) for s in symbols]).alias("_before"))
    inside = Window.partitionBy("_day").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.select(time, "_day", *[F.last(q(s), ignorenulls=True).over(inside).alias(s) for s in symbols]).join(carried, "_day")
    return filled.select(time, *[F.coalesce(q(s), F.col(f"_before.`{s}`")).alias(s) for s in symbols]).na.drop()


def repair_collisions(df: DataFrame, time: str = "ts", by: str = "symbol") -> DataFrame:
    """Times shared by several symbols are moved apart by whole milliseconds."""
    w = Window.partitionBy(time).orderBy(by)
    return df.withColumn(time, F.timestamp_micros(micros(time) + (F.row_number().over(w) - 1) * 1000))
