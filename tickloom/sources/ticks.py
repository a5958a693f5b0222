"""Scans of tick tables and their helpers.

The canonical tick table is ``symbol, ts, seq, price, vol``, ordered within a
symbol by ``(ts, seq)``.  Zero or missing prices, times and volumes stand for
"no tick" and are filtered where the table is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """The ``events`` table as ticks, by event type (deep) or by user (wide)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("vol"),
    )


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as ticks by supplier; ``seq`` orders equal times."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("long").alias("vol"),
    )


def real_ticks(ticks: DataFrame) -> DataFrame:
    """Without padding: time set, price and volume above 0."""
    return ticks.where(F.col("ts").isNotNull() & (F.col("price") > 0) & (F.col("vol") > 0))


def between_days(ticks: DataFrame, first: str, last: str) -> DataFrame:
    """Days ``first`` to ``last``, both included, as a range on ``ts`` that is pushed to the scan."""
    return ticks.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("date") + F.expr("INTERVAL 1 DAY")))


def on_days(ticks: DataFrame, days: DataFrame) -> DataFrame:
    """Ticks on the days of ``days(date)``; the list is joined, not collected."""
    return ticks.withColumn("date", F.to_date("ts")).join(days.select("date"), "date", "left_semi").drop("date")


def distinct_ticks(ticks: DataFrame) -> DataFrame:
    """One tick of those equal in symbol, time, price and volume: the first."""
    return ticks.groupBy("symbol", "ts", "price", "vol").agg(F.min("seq").alias("seq")).select("symbol", "ts", "seq", "price", "vol")


def session_ticks(ticks: DataFrame, opens: str = "09:30:00", closes: str = "16:00:00") -> DataFrame:
    """Ticks inside the session's hours ``[opens, closes)``."""
    clock = F.date_format("ts", "HH:mm:ss")
    return ticks.where((clock >= opens) & (clock < closes))


def universe(ticks: DataFrame) -> DataFrame:
    """The distinct symbols."""
    return ticks.select("symbol").distinct()


def missing_days(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``symbol, date`` of ``wanted`` not yet in ``stored`` (idempotent ingestion)."""
    return wanted.join(stored, ["symbol", "date"], "left_anti")


def calendar(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = ()) -> DataFrame:
    """``date`` of each weekday in the range that is no holiday."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    days = days.where(~F.dayofweek("date").isin(1, 7))
    return days.where(~F.col("date").isin([F.lit(h).cast("date") for h in holidays])) if holidays else days


def nearest_sessions(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each ``day`` the session nearest in time, however far, the earlier on a tie.

    The last session up to the day and the first from it on are carried over the
    distinct days of both tables: a calendar, so one ordered pass will do.  Null
    where there is no session at all; null days are left out.
    """
    days = wanted.select(F.col("day").alias("at"), F.lit(True).alias("asked"), F.lit(None).cast("date").alias("session"))
    both = days.union(sessions.select("date", F.lit(False), "date")).where("at IS NOT NULL").groupBy("at").agg(F.max("asked").alias("asked"), F.max("session").alias("session"))
    w = Window.orderBy("at")
    before = F.last("session", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("session", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"_before": before, "_after": after}).where("asked")
    later = F.col("_before").isNull() | (F.datediff("_after", "at") < F.datediff("at", "_before"))
    return near.select(F.col("at").alias("day"), F.when(later, F.col("_after")).otherwise(F.col("_before")).alias("session"))


def parameters(spark: SparkSession, path: str, defaults: Sequence[float] = (1e-4, 1e-4, 15.0)) -> DataFrame:
    """``symbol, alpha1, alpha2, bars`` of a CSV file with a header."""
    names = ("alpha1", "alpha2", "bars")
    read = spark.read.csv(path, header=True, schema="symbol string, alpha1 double, alpha2 double, bars double")
    return read.select("symbol", *[F.coalesce(n, F.lit(d)).alias(n) for n, d in zip(names, defaults, strict=True)])


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def columns_without(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """The complement: columns with none of ``parts`` in their names."""
    return [c for c in df.columns if not any(p in c for p in parts)]


def model_inputs(df: DataFrame, label: str, end: str, time: str, weight: str | None = None, part: str = "feature") -> DataFrame:
    """Feature columns, ``label``, ``t1``, ``w`` and ``time`` of complete rows in time order."""
    kept = [F.col(c) for c in columns_like(df, part)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(F.col(time).alias("time"), *kept, F.col(label).cast("int").alias("label"), F.col(end).alias("t1"), w.alias("w")).na.drop().orderBy("time")


def made_classification(spark: SparkSession, rows: int, informative: int = 5, redundant: int = 5, noise: int = 5, seed: int = 0) -> DataFrame:
    """Labelled rows with informative, redundant and noise features."""
    base = spark.range(rows).select("id", *[F.randn(seed + i).alias(f"I_{i}") for i in range(informative)])
    copies = [(F.col(f"I_{i % informative}") + 0.1 * F.randn(seed + 100 + i)).alias(f"R_{i}") for i in range(redundant)]
    noises = [F.randn(seed + 200 + i).alias(f"N_{i}") for i in range(noise)]
    score = sum((F.col(f"I_{i}") for i in range(informative)), F.lit(0.0))
    return base.select("*", *copies, *noises, (score > 0).cast("int").alias("label"))


def day(ts: str = "ts") -> Column:
    return F.to_date(ts)
