"""The registry, and SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The canonical ticks by event type, in SQL.
TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS vol, CAST(ts AS DATE) AS date FROM events)"""
#: The same by user.
WIDE = TICKS.replace("event_type AS", "CAST(user_id AS VARCHAR) AS")
#: Ticks with the sign rule.
RULED = (
    TICKS
    + """,
moved AS (
  SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS move FROM ticks WINDOW w AS (PARTITION BY symbol, date ORDER BY ts, seq)),
ruled AS (
  SELECT symbol, ts, seq, price, vol, date,
         CAST(coalesce(last_value(move IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS rule FROM moved)"""
)
#: Volume bars of 500 on the deep ticks, all columns.
BARS = (
    RULED
    + """,
dealt AS (
  SELECT *, CAST(floor(sum(vol) OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / 500.0) AS BIGINT) AS bar_id FROM ruled),
later AS (
  SELECT *, coalesce(lag(bar_id) OVER (PARTITION BY symbol, date ORDER BY ts, seq) = bar_id, false) AS later FROM dealt),
bars AS (
  SELECT symbol, date, bar_id,
    arg_min(price, (ts, seq)) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, (ts, seq)) AS close_price,
    min(ts) AS open_date, arg_min(ts, (-price, ts, seq)) AS high_date, arg_min(ts, (price, ts, seq)) AS low_date, max(ts) AS close_date,
    stddev_pop(price) AS basic_volatility, CAST(sum(vol) AS BIGINT) AS bar_cum_volume, count(*) AS n_ticks,
    CAST(count(*) FILTER (later AND rule = 1) AS DOUBLE) AS buys, CAST(count(*) FILTER (later AND rule = -1) AS DOUBLE) AS sells,
    CAST(coalesce(sum(vol * rule) FILTER (later), 0) AS DOUBLE) AS sign_vol,
    CAST(coalesce(sum(vol) FILTER (later AND rule = 1), 0) AS DOUBLE) AS vol_buy, CAST(coalesce(sum(vol) FILTER (later AND rule = -1), 0) AS DOUBLE) AS vol_sell,
    sum(price * vol) AS dollars, coalesce(sum(sqrt(price * vol) * rule) FILTER (later), 0) AS hasbrouck, sum(price * vol) / sum(vol) AS vwap
  FROM later GROUP BY symbol, date, bar_id)"""
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as in the tables."""
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


def rounded(df: DataFrame, digits: int = 6, nudge: bool = False) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show.

    ``nudge`` moves values off decimal ties first, as :func:`nudged` does in SQL.
    """
    off = 1.3 * 10.0 ** -(digits + 3) if nudge else 0.0
    return df.select(*[(F.round(F.col(f"`{c}`") + off, digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in plain_times(df).dtypes])


def nudged(names: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({n} + 1.3e-{digits + 3}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
