"""Queries over projections, set operations, sorts and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import average_rank, clip, hash_share, logarithm, ratio
from tickloom.queries.registry import nudged, plain_times, query, rounded, table
from tickloom.sources import ticks as S


@query("p1_columns_like", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def p1(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return plain_times(df.select(*S.columns_like(df, "order")))


@query("p2_columns_without", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def p2(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select(*S.columns_without(df, ["nation", "segment"]))


@query("p3_expression_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem WHERE l_discount <> 0 AND l_quantity >= 30 AND l_shipdate < TIMESTAMP '1996-01-01'")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_discount <> 0 AND l_quantity >= 30 AND l_shipdate < '1996-01-01'").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query("p5_interval_predicates", """SELECT event_id, ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' AS open_interval, ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06' AS closed_interval, ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 06:00:00' AS heartbeat FROM events""")
def p5(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", ((t > at("2024-01-05")) & (t < at("2024-01-06"))).alias("open_interval"), t.between(at("2024-01-05"), at("2024-01-06")).alias("closed_interval"), ((t >= at("2024-01-05")) & (t < at("2024-01-05 06:00:00"))).alias("heartbeat"))


@query("p7_piecewise", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'middle' ELSE 'low' END AS level, least(greatest(value, 5), 50) AS clipped FROM events")
def p7(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.when(v > 100, "high").when(v > 20, "middle").otherwise("low").alias("level"), clip(v, 5.0, 50.0).alias("clipped"))


@query("p10_nulls", "SELECT event_id, coalesce(nullif(value, 0), 0) AS filled, value / nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS per FROM events")
def p10(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(0.0)).alias("filled"), ratio(F.col("value"), F.get_json_object("props", "$.k").cast("double")).alias("per"))


@query("o3_latest_bars", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def o3(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id", "ts")


@query("o3_above_median", "WITH m AS (SELECT user_id, avg(value) AS mean FROM events GROUP BY user_id) SELECT user_id, round(mean + 1.3e-9, 6) + 0.0 AS mean FROM m WHERE mean > (SELECT quantile_cont(mean, 0.5) FROM m)")
def o3_median(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    return rounded(m.join(F.broadcast(m.agg(F.percentile("mean", 0.5).alias("mid")))).where("mean > mid").select("user_id", "mean"), nudge=True)  # one row


@query("u1_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def u1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("u2_intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def u2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase' AND value > 50").select("user_id"))


@query("u4_distinct", "SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events")
def u4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("u5_except", "SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def u5(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey").exceptAll(table(spark, sf_dir, "part").select("p_partkey"))


@query("a2_conditional_sums", "SELECT user_id, CAST(ts AS DATE) AS date, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def a2(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date"))
    return e.agg(F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)), 4).alias("clicks"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))


@query("a6_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5) + 1.3e-9, 6) AS median, round(quantile_cont(value, 0.9) + 1.3e-9, 6) AS p90 FROM events GROUP BY event_type")
def a6(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.9).alias("p90")), nudge=True)


@query("a7_pick_row", "SELECT user_id, arg_max(event_id, (value, event_id)) AS largest, arg_min(event_id, (value, event_id)) AS smallest FROM events GROUP BY user_id")
def a7(spark, sf_dir):
    k = F.struct("value", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", k).alias("largest"), F.min_by("event_id", k).alias("smallest"))


@query("a8_moments", f"""WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY event_type), d AS (SELECT event_type, value - mu AS d, value FROM events JOIN m USING (event_type)),
s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sample_sd, stddev_pop(value) AS pop_sd, avg(power(d, 3)) / power(avg(d * d), 1.5) AS skew, avg(power(d, 4)) / power(avg(d * d), 2) - 3 AS kurt FROM d GROUP BY event_type) SELECT event_type, {nudged(['mean', 'sample_sd', 'pop_sd', 'skew', 'kurt'], 6)} FROM s""")
def a8(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sample_sd"), F.stddev_pop("value").alias("pop_sd"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt")), nudge=True)


@query("a10_pivot", "SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def a10(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).pivot("event_type", ["click", "view"]).count()
    return e.na.fill(0)


@query("a11_correlation", f"WITH s AS (SELECT event_type, covar_samp(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS cov, corr(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS rho FROM events GROUP BY event_type) SELECT event_type, {nudged(['cov', 'rho'], 6)} FROM s")
def a11(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.covar_samp("value", k).alias("cov"), F.corr("value", k).alias("rho")), nudge=True)


@query("a12_cube", "SELECT event_type, user_id % 4 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, user_id % 4)")
def a12(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 4)
    return e.cube("event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("o1_ranked_sort", "SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY CAST(json_extract_string(props, '$.k') AS INTEGER)) + (count(*) OVER (PARTITION BY event_type, json_extract_string(props, '$.k')) - 1) / 2.0 AS place FROM events")
def o1(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select("event_type", "event_id", average_rank(F.col("k"), Window.partitionBy("event_type")).alias("place"))


@query("f0_scalar_functions", f"WITH s AS (SELECT event_id, ln(value) AS a, sqrt(value) AS b, exp(-value / 100) AS c, log10(value) AS d, log2(value) AS e, power(value, 0.3) AS f, round_even(value, 0) AS g, ln(0.2 / 0.8) AS h FROM events) SELECT event_id, {nudged(list('abcdefgh'), 6)} FROM s")
def f0(spark, sf_dir):
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").select("event_id", logarithm(v).alias("a"), F.sqrt(v).alias("b"), F.exp(-v / 100).alias("c"), logarithm(v, F.log10).alias("d"), logarithm(v, F.log2).alias("e"), F.pow(v, F.lit(0.3)).alias("f"), F.bround(v, 0).alias("g"), F.ln(F.lit(0.2) / F.lit(0.8)).alias("h")), nudge=True)


@query("f0_dates", "SELECT event_id, CAST(ts AS DATE) AS day, ts + INTERVAL 1 DAY AS next_day, date_trunc('hour', ts) AS hour, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS since, strftime(ts, '%Y-%m') AS month FROM events")
def f0_dates(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return plain_times(table(spark, sf_dir, "events").select("event_id", F.to_date(t).alias("day"), (t + F.expr("INTERVAL 1 DAY")).alias("next_day"), F.date_trunc("hour", t).alias("hour"), F.datediff(F.to_date(t), F.lit("2024-01-01").cast("date")).cast("long").alias("since"), F.date_format(t, "yyyy-MM").alias("month")))


@query("f0_hash_share", "SELECT o_orderkey, CAST('0x' || substr(md5('7|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders")
def f0_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hash_share("o_orderkey", seed=7).alias("u"))
