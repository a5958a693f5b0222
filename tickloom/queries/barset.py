"""Queries over ticks and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.queries.registry import BARS, RULED, TICKS, WIDE, plain_times, query, rounded
from tickloom.sources import ticks as S

_SHORT = {
    "feat_buyInitTotal": "buys", "feat_sellInitTotal": "sells", "feat_signVolSide": "sign_vol", "feat_accumulativeVolBuyInit": "vol_buy",
    "feat_accumulativeVolSellInit": "vol_sell", "feat_accumulativeDollarValue": "dollars", "feat_hasbrouckSign": "hasbrouck",
}


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_ticks(spark, sf_dir)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_ticks(spark, sf_dir, "user_id")


def volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(deep(spark, sf_dir), "volume", 500)


_OHLC = """symbol, date, {bar}, arg_min(price, (ts, seq)) AS open_price, max(price) AS high_price, min(price) AS low_price,
 arg_max(price, (ts, seq)) AS close_price, CAST(sum(vol) AS BIGINT) AS bar_cum_volume, count(*) AS n_ticks"""


@query("s1_tick_range_scan", f"WITH {TICKS} SELECT symbol, ts, seq, price, vol FROM ticks WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' AND price > 0 AND vol > 0")
def s1(spark, sf_dir):
    return plain_times(S.between_days(S.real_ticks(deep(spark, sf_dir)), "2024-01-05", "2024-01-10"))


@query("s7_distinct_ticks", f"WITH {TICKS} SELECT symbol, ts, min(seq) AS seq, price, vol FROM ticks GROUP BY symbol, ts, price, vol")
def s7(spark, sf_dir):
    return plain_times(S.distinct_ticks(deep(spark, sf_dir)))


@query("s19_universe", f"WITH {WIDE} SELECT DISTINCT symbol FROM ticks")
def s19(spark, sf_dir):
    return S.universe(wide(spark, sf_dir))


@query("s20_session_ticks", f"WITH {TICKS} SELECT symbol, ts, seq, price, vol FROM ticks WHERE CAST(ts AS TIME) >= TIME '09:30:00' AND CAST(ts AS TIME) < TIME '16:00:00'")
def s20(spark, sf_dir):
    return plain_times(S.session_ticks(deep(spark, sf_dir)))


@query("s21_calendar_ticks", f"WITH {TICKS} SELECT symbol, ts, seq, price, vol FROM ticks WHERE dayofweek(date) NOT IN (0, 6) AND date <> DATE '2024-01-15' AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-31'")
def s21(spark, sf_dir):
    return plain_times(S.on_days(deep(spark, sf_dir), S.calendar(spark, "2024-01-02", "2024-01-31", ["2024-01-15"])))


@query(
    "s22_nearest_sessions",
    f"""WITH {TICKS}, s AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) NOT IN (0, 6)),
w AS (SELECT DISTINCT date AS day FROM ticks)
SELECT day, arg_min(s.date, (abs(date_diff('day', day, s.date)), s.date)) AS session FROM w, s GROUP BY day""",
)
def s22(spark, sf_dir):
    days = deep(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    return S.nearest_sessions(days, S.calendar(spark, "2024-01-01", "2024-01-31"))


@query(
    "s23_missing_days",
    f"""WITH {WIDE}, a AS (SELECT DISTINCT symbol, date FROM ticks) SELECT symbol, date FROM a ANTI JOIN (SELECT DISTINCT symbol, date FROM ticks WHERE vol > 50) b USING (symbol, date)""",
)
def s23(spark, sf_dir):
    t = wide(spark, sf_dir).withColumn("date", F.to_date("ts"))
    return S.missing_days(t.select("symbol", "date").distinct(), t.where("vol > 50").select("symbol", "date").distinct())


@query("b1_calibration", f"""WITH {WIDE}, d AS (SELECT symbol, date, count(*) AS t, sum(vol) AS v, sum(CAST(price * vol AS DECIMAL(28,2))) AS m FROM ticks GROUP BY symbol, date)
SELECT symbol, CAST(floor(avg(CAST(t AS DOUBLE)) / 10) AS BIGINT) AS tick_t, CAST(floor(avg(CAST(v AS DOUBLE)) / 10) AS BIGINT) AS volume_t, CAST(floor(avg(CAST(m AS DOUBLE)) / 10) AS BIGINT) AS dollar_t FROM d GROUP BY symbol""")
def b1(spark, sf_dir):
    return bars.calibrate(wide(spark, sf_dir))


@query("b2_tick_bars", f"WITH {RULED}, x AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) - 1) / 20.0) AS BIGINT) AS bar_id FROM ruled) SELECT {_OHLC.format(bar='bar_id')} FROM x GROUP BY symbol, date, bar_id")
def b2(spark, sf_dir):
    return bars.bars(deep(spark, sf_dir), "tick", 25).select("symbol", "date", "bar_id", "open_price", "high_price", "low_price", "close_price", "bar_cum_volume", "n_ticks")


@query(
    "b3_volume_bars",
    f"""WITH {BARS} SELECT symbol, date, bar_id, open_price, high_price, low_price, close_price, open_date, high_date, low_date, close_date, round(basic_volatility, 6) AS basic_volatility, bar_cum_volume, n_ticks,
 buys, sells, sign_vol, vol_buy, vol_sell, round(dollars, 4) AS dollars, round(hasbrouck, 4) AS hasbrouck, round(vwap, 4) AS vwap FROM bars""",
)
def b3(spark, sf_dir):
    found = volume_bars(spark, sf_dir).withColumnsRenamed(_SHORT)
    return plain_times(found.withColumn("basic_volatility", F.round("basic_volatility", 6)).withColumns({c: F.round(c, 4) for c in ("dollars", "hasbrouck", "vwap")}))


@query("b4_dollar_bars", f"WITH {RULED}, x AS (SELECT *, CAST(floor(CAST(sum(CAST(price * vol AS DECIMAL(28,2))) OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 50000) AS BIGINT) AS bar_id FROM ruled) SELECT {_OHLC.format(bar='bar_id')} FROM x GROUP BY symbol, date, bar_id")
def b4(spark, sf_dir):
    return bars.bars(deep(spark, sf_dir), "dollar", 50_000).select("symbol", "date", "bar_id", "open_price", "high_price", "low_price", "close_price", "bar_cum_volume", "n_ticks")


def _scaled(total: str, done: str, scale: float) -> str:
    return f"""WITH {TICKS}, d AS (SELECT *, round_even({total} OVER (PARTITION BY symbol, date) / 10.0, -1) * {scale} AS size, {done} OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS done FROM ticks),
i AS (SELECT *, coalesce(floor(done / nullif(size, 0)), 0) AS id FROM d), g AS (SELECT symbol, date, id, min(ts) AS start, sum(price * vol) / sum(vol) AS vwap FROM i GROUP BY symbol, date, id)
SELECT symbol, date, row_number() OVER (PARTITION BY symbol, date ORDER BY id) AS bar, start, round(vwap + 1.3e-9, 6) + 0.0 AS vwap FROM g"""


@query("b5_scaled_tick_bars", _scaled("count(*)", "count(*)", 0.25).replace("AS done FROM", "- 1 AS done FROM"))
def b5_ticks(spark, sf_dir):
    return rounded(bars.scaled_bars(deep(spark, sf_dir)), nudge=True)


@query("b5_scaled_volume_bars", _scaled("sum(vol)", "sum(vol)", 0.2))
def b5_volume(spark, sf_dir):
    return rounded(bars.scaled_bars(deep(spark, sf_dir), "volume"), nudge=True)


@query("b6_bar_counts", f"WITH {RULED}, x AS (SELECT *, floor(sum(vol) OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / 500.0) AS bar_id FROM ruled) SELECT symbol, date, count(DISTINCT bar_id) AS n_bars FROM x GROUP BY symbol, date")
def b6(spark, sf_dir):
    return bars.bar_counts(deep(spark, sf_dir), "volume", 500)


@query("b13_tick_rule", f"WITH {RULED} SELECT symbol, ts, seq, rule FROM ruled")
def b13(spark, sf_dir):
    return plain_times(bars.with_tick_rule(deep(spark, sf_dir)).select("symbol", "ts", "seq", "rule"))


@query(
    "b15_calibrated_volume_bars",
    f"""WITH {RULED}, d AS (SELECT symbol, date, sum(vol) AS v FROM ticks GROUP BY symbol, date), p AS (SELECT symbol, floor(avg(CAST(v AS DOUBLE)) / 10) AS t FROM d GROUP BY symbol),
x AS (SELECT r.*, CAST(floor(sum(vol) OVER (PARTITION BY r.symbol, date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / greatest(round_even(t, -1), 1)) AS BIGINT) AS bar_id FROM ruled r JOIN p USING (symbol))
SELECT {_OHLC.format(bar='bar_id')} FROM x GROUP BY symbol, date, bar_id""",
)
def b15(spark, sf_dir):
    return bars.calibrated_bars(deep(spark, sf_dir)).select("symbol", "date", "bar_id", "open_price", "high_price", "low_price", "close_price", "bar_cum_volume", "n_ticks")


@query(
    "b17_time_bars",
    f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n_ticks, round(avg(price), 6) AS mean_price, round(sum(price * vol) / sum(vol), 4) AS vwap,
 arg_min(price, (ts, seq)) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, (ts, seq)) AS close_price, CAST(sum(vol) AS BIGINT) AS volume FROM ticks GROUP BY symbol, start""",
)
def b17(spark, sf_dir):
    found = bars.time_bars(deep(spark, sf_dir), "6 hours")
    return plain_times(found.withColumn("mean_price", F.round("mean_price", 6)).withColumn("vwap", F.round("vwap", 4)))


@query(
    "b17_equal_count_bars",
    f"""WITH {TICKS}, x AS (SELECT *, CAST(ntile(8) OVER (PARTITION BY symbol, date ORDER BY ts, seq) AS INTEGER) AS part FROM ticks)
SELECT symbol, date, part, count(*) AS n_ticks, round(avg(price), 6) AS mean_price, arg_max(price, (ts, seq)) AS close_price, CAST(sum(vol) AS BIGINT) AS volume FROM x GROUP BY symbol, date, part""",
)
def b17_counts(spark, sf_dir):
    return rounded(bars.equal_count_bars(deep(spark, sf_dir)))


@query(
    "b17_sliding_bars",
    f"""WITH {TICKS}, x AS (SELECT symbol, vol, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM ticks)
SELECT symbol, start, count(*) AS n_ticks, CAST(sum(vol) AS BIGINT) AS volume FROM x GROUP BY symbol, start""",
)
def b17_slide(spark, sf_dir):
    return plain_times(bars.time_bars(deep(spark, sf_dir), "6 hours", "3 hours").select("symbol", "start", "n_ticks", "volume"))


@query(
    "b17_session_bars",
    f"""WITH {WIDE}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT symbol, min(ts) AS start, count(*) AS n_ticks, CAST(sum(vol) AS BIGINT) AS volume FROM n GROUP BY symbol, s""",
)
def b17_sessions(spark, sf_dir):
    return plain_times(bars.session_bars(wide(spark, sf_dir)))


@query("a1_daily", f"""WITH {WIDE} SELECT symbol, date, arg_min(price, (ts, seq)) AS first_price, arg_max(price, (ts, seq)) AS last_price, max(price) AS high_price, min(price) AS low_price,
 CAST(sum(vol) AS BIGINT) AS volume, count(*) AS n_ticks, round(sum(price * vol) / sum(vol) + 1.3e-7, 4) AS vwap FROM ticks GROUP BY symbol, date""")
def a1(spark, sf_dir):
    return bars.daily(wide(spark, sf_dir)).withColumn("vwap", F.round(F.col("vwap") + 1.3e-7, 4))
