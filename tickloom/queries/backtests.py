"""Queries over backtest statistics, overfitting tests and cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import normal_cdf
from tickloom.operators import backtest_stats as B
from tickloom.operators import crossval as X
from tickloom.operators import labels
from tickloom.queries.barset import deep
from tickloom.queries.labelset import LABELLED, barred
from tickloom.queries.registry import TICKS, nudged, plain_times, query, rounded

_SHARE = "CAST('0x' || substr(md5('0|' || symbol || '|' || bar), 1, 8) AS BIGINT) / 4294967296.0"
TRADES = LABELLED + f""",
tr0 AS (SELECT l.symbol, l.bar, l.close_date, l.close_price AS c, CASE WHEN "barrierPrice" <> 0 THEN "barrierPrice" ELSE l.close_price END AS p, "barrierLabel" AS lab,
  {_SHARE.replace("symbol", "l.symbol").replace("|| bar", "|| l.bar")} * CASE "barrierLabel" WHEN 1 THEN upper_barrier WHEN -1 THEN lower_barrier ELSE l.close_price END * 0.01 AS costs FROM labelled l JOIN barred b ON b.symbol = l.symbol AND b.bar = l.bar),
tr1 AS (SELECT *, CASE lab WHEN 1 THEN (p - c - costs) / c WHEN -1 THEN (c - p - costs) / c ELSE 0 END AS ret FROM tr0),
tr AS (SELECT symbol AS trial, bar, close_date, costs, ret, c * ret AS pnl, CAST(5000 + sum(CAST(c * ret AS DECIMAL(28,8))) OVER (PARTITION BY symbol ORDER BY close_date, bar ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS capital FROM tr1),
hw AS (SELECT *, max(capital) OVER (PARTITION BY trial ORDER BY close_date, bar ROWS UNBOUNDED PRECEDING) AS high FROM tr),
mk AS (SELECT trial, high, min(capital) AS low, min(close_date) AS since FROM hw GROUP BY trial, high HAVING min(capital) < high),
dd AS (SELECT trial, high, since, 1 - low / high AS drawdown, epoch_us(lead(since) OVER (PARTITION BY trial ORDER BY since, high)) - epoch_us(since) AS gap FROM mk)"""


#: With costs that make some trades lose.
DEAR = TRADES.replace("* 0.01 AS costs", "* 1.5 AS costs")


def traded(spark: SparkSession, sf_dir: str, cost_share: float = 0.01) -> DataFrame:
    own = barred(spark, sf_dir)
    met = own.join(labels.triple_barrier(own, deep(spark, sf_dir)), ["symbol", "bar"]).withColumnRenamed("symbol", "trial")
    return B.trades(met, cost_share=cost_share)


@query("x1_trades", f"WITH {TRADES} SELECT trial, bar, {nudged(['costs', 'ret', 'pnl', 'capital'])} FROM tr")
def x1(spark, sf_dir):
    return rounded(traded(spark, sf_dir).select("trial", "bar", "costs", "ret", "pnl", "capital"), 4, nudge=True)


@query("x3_drawdowns", f"WITH {DEAR} SELECT trial, {nudged(['high'])}, since, {nudged(['drawdown'], 6)}, round(gap / (86400e6 * 365.2425) + 1.3e-9, 6) AS under_water FROM dd")
def x3(spark, sf_dir):
    d = B.drawdowns(traded(spark, sf_dir, 1.5))
    return plain_times(d.select("trial", F.round(F.col("high") + 1.3e-7, 4).alias("high"), "since", F.round(F.col("drawdown") + 1.3e-9, 6).alias("drawdown"), F.round(F.col("under_water") + 1.3e-9, 6).alias("under_water")))


_HHI = "CASE WHEN count(*) FILTER (ret {s} 0) > 2 THEN (sum(ret * ret) FILTER (ret {s} 0) / power(sum(ret) FILTER (ret {s} 0), 2) - 1.0 / count(*) FILTER (ret {s} 0)) / (1 - 1.0 / count(*) FILTER (ret {s} 0)) END"


_FIGURES = f""", st AS (SELECT trial, arg_min(capital, (close_date, bar)) AS f, arg_max(capital, (close_date, bar)) AS l, avg(capital) AS mc, avg(costs) AS cost, date_diff('day', CAST(min(close_date) AS DATE), CAST(max(close_date) AS DATE)) AS days, count(*) AS n,
 count(*) FILTER (ret > 0) AS hits, avg(ret) FILTER (ret > 0) AS hit_return, avg(ret) AS mu, stddev_samp(ret) AS sd, {_HHI.format(s='>=')} AS hhi_positive, {_HHI.format(s='<=')} AS hhi_negative FROM tr GROUP BY trial),
m AS (SELECT tr.trial, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5) AS skew, avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) - 3 AS kurt FROM tr JOIN st USING (trial) GROUP BY tr.trial),
w AS (SELECT trial, max(drawdown) AS max_drawdown, max(gap) / (86400e6 * 365.2425) AS max_under_water FROM dd GROUP BY trial),
s AS (SELECT *, mu / sd AS sharpe, l / f - 1 AS growth FROM st JOIN m USING (trial) LEFT JOIN w USING (trial)),
z AS (SELECT trial, l - f AS pnl, power(1 + growth, 360.0 / days) - 1 AS annual_return, hits, hits / n AS hit_ratio, hit_return, max_drawdown, max_under_water, hhi_positive, hhi_negative, sharpe, growth * mc / f AS dollar_performance, growth / cost AS return_on_costs,
 n, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS spread FROM s)"""


def _phi(x: str) -> str:
    """The normal distribution by the same polynomial as the library's."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    upper = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END"


@query("x8_statistics_by_trial", f"WITH {DEAR}{_FIGURES} SELECT trial, hits, {nudged(['pnl', 'annual_return', 'hit_ratio', 'hit_return', 'max_drawdown', 'max_under_water', 'hhi_positive', 'hhi_negative', 'sharpe', 'dollar_performance', 'return_on_costs'])} FROM z")
def x8(spark, sf_dir):
    return rounded(B.statistics(traded(spark, sf_dir, 1.5)).drop("psr", "track_record"), 4, nudge=True)


@query("x5_probabilistic_sharpe", f"WITH {DEAR}{_FIGURES}, q AS (SELECT *, sharpe * sqrt(n - 1) / sqrt(spread) AS v FROM z) SELECT trial, round(sharpe + 1.3e-7, 4) + 0.0 AS sharpe, round(CASE WHEN spread > 0 THEN {_phi('v')} END + 1.3e-7, 4) + 0.0 AS psr, round(1 + spread * power(-1.6448536269514722 / sharpe, 2) + 1.3e-7, 4) + 0.0 AS track_record FROM q")
def x5(spark, sf_dir):
    return rounded(B.statistics(traded(spark, sf_dir, 1.5)).select("trial", "sharpe", "psr", "track_record"), 4, nudge=True)


@query("x7_composite_score", f"WITH {DEAR}{_FIGURES} , c AS (SELECT trial, 25 * (annual_return / 0.1 + hit_ratio / 0.5 + sharpe / 0.1 + dollar_performance / 0.05) AS v FROM z) SELECT trial, round(sign(v) * ln(abs(v) + sqrt(v * v + 1)) + 1.3e-9, 6) + 0.0 AS score FROM c")
def x7(spark, sf_dir):
    s = B.composite_score(B.statistics(traded(spark, sf_dir, 1.5)), {"annual_return": 0.1, "hit_ratio": 0.5, "sharpe": 0.1, "dollar_performance": 0.05})
    return rounded(s.select("trial", F.asinh("score").alias("score")), nudge=True)  # scores span many magnitudes


_USERS = """WITH r AS (SELECT CAST(ts AS DATE) AS t, 'm' || (user_id % 8) AS model, avg(value) / 100 - 0.5 AS ret FROM events GROUP BY 1, 2)"""


def model_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight series of daily figures that stand for models."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.to_date("ts").alias("t"), F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model")).agg((F.avg("value") / 100 - 0.5).alias("ret"))


@query("x9_pnl_matrix", f"{_USERS} SELECT t, model, round(1 + ret + 1.3e-9, 6) + 0.0 AS value FROM r")
def x9(spark, sf_dir):
    return rounded(B.pnl_matrix(model_returns(spark, sf_dir)), nudge=True)


_CSCV = _USERS + """, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT t FROM r)), i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM r)),
b AS (SELECT t, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block FROM i, n),
s AS (SELECT a, c, d, row_number() OVER (ORDER BY a, c, d) - 1 AS split FROM range(6) x(a), range(6) y(c), range(6) z(d) WHERE a < c AND c < d),
v AS (SELECT split, model, block IN (a, c, d) AS inside, ret FROM r JOIN b USING (t), s),
g AS (SELECT split, model, avg(ret) FILTER (inside) / stddev_pop(ret) FILTER (inside) AS a, avg(ret) FILTER (NOT inside) / stddev_pop(ret) FILTER (NOT inside) AS b FROM v GROUP BY split, model),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY b, model) AS rank, count(*) OVER (PARTITION BY split) + 1 AS m, row_number() OVER (PARTITION BY split ORDER BY a DESC, model DESC) AS top FROM g),
o AS (SELECT split, model AS best_model, a AS sharpe_in, b AS sharpe_out, rank, rank / m AS omega FROM k WHERE top = 1)"""


@query("x10_cscv", f"{_CSCV} SELECT CAST(split AS INTEGER) AS split, best_model, CAST(rank AS INTEGER) AS rank, {nudged(['sharpe_in', 'sharpe_out', 'omega'])}, round(ln(omega / (1 - omega)) + 1.3e-7, 4) + 0.0 AS logit FROM o")
def x10(spark, sf_dir):
    return rounded(B.cscv(model_returns(spark, sf_dir).withColumnRenamed("ret", "value"), 6), 4, nudge=True)


@query("x11_overfitting", f"{_CSCV} SELECT count(*) AS n_splits, avg((omega < 0.5)::INT) AS pbo, avg((sharpe_in < 0)::INT) AS loss_in, avg((sharpe_out < 0)::INT) AS loss_out FROM o")
def x11(spark, sf_dir):
    return B.overfitting(B.cscv(model_returns(spark, sf_dir).withColumnRenamed("ret", "value"), 6))


def _splits_sql(k: int, score: str = "avg({v}) / stddev_pop({v})") -> str:
    """The same for any even number of blocks: a split is a mask with half of the bits."""
    return _USERS + f""", n AS (SELECT count(*) AS n FROM (SELECT DISTINCT t FROM r)), i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM r)),
b AS (SELECT t, CAST(CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS block FROM i, n),
s AS (SELECT m, row_number() OVER (ORDER BY m DESC) - 1 AS split FROM range({1 << k}) x(m) WHERE bit_count(m) = {k // 2}),
v AS (SELECT split, model, (m >> ({k - 1} - block)) & 1 AS inside, ret FROM r JOIN b USING (t), s),
g AS (SELECT split, model, {score.format(v="CASE WHEN inside = 1 THEN ret END")} AS a, {score.format(v="CASE WHEN inside = 0 THEN ret END")} AS b FROM v GROUP BY split, model),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY b, model) AS rank, count(*) OVER (PARTITION BY split) + 1 AS m, row_number() OVER (PARTITION BY split ORDER BY a DESC, model DESC) AS top FROM g),
o AS (SELECT split, model AS best_model, a AS sharpe_in, b AS sharpe_out, rank, rank / m AS omega FROM k WHERE top = 1)"""


@query("x10_cscv_16", f"{_splits_sql(16)} SELECT count(*) AS n_splits, avg((omega < 0.5)::INT) AS pbo, avg((sharpe_in < 0)::INT) AS loss_in, avg((sharpe_out < 0)::INT) AS loss_out FROM o")
def x10_16(spark, sf_dir):
    """All 12,870 splits of 16 blocks."""
    return B.overfitting(B.cscv(model_returns(spark, sf_dir).withColumnRenamed("ret", "value"), 16))


@query("x10_cscv_by_median", f"{_splits_sql(6, 'median({v})')} SELECT CAST(split AS INTEGER) AS split, best_model, CAST(rank AS INTEGER) AS rank, {nudged(['sharpe_in', 'sharpe_out', 'omega'])} FROM o")
def x10_median(spark, sf_dir):
    """Models chosen by any aggregate of their returns."""
    found = B.cscv(model_returns(spark, sf_dir).withColumnRenamed("ret", "value"), 6, aggregate=F.median)
    return rounded(found.drop("logit"), 4, nudge=True)


@query("x12_overfitting_gate", f"{_splits_sql(8)} SELECT count(*) AS n_splits, avg((omega < 0.5)::INT) AS pbo, avg((sharpe_in < 0)::INT) AS loss_in, avg((sharpe_out < 0)::INT) AS loss_out, avg((omega < 0.5)::INT) < 0.5 AS passed FROM o")
def x12(spark, sf_dir):
    return B.overfitting_gate(model_returns(spark, sf_dir).withColumnRenamed("ret", "value"), 8)


@query(
    "x13_nearest_to_ideal",
    """WITH m AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS spread, count(*) AS n FROM events GROUP BY user_id),
z AS (SELECT user_id, (mean - avg(mean) OVER ()) / stddev_pop(mean) OVER () AS a, (spread - avg(spread) OVER ()) / stddev_pop(spread) OVER () AS b FROM m),
d AS (SELECT user_id, sqrt(power(a - max(a) OVER (), 2) + power(b - min(b) OVER (), 2)) AS distance FROM z)
SELECT user_id, round(distance + 1.3e-7, 4) + 0.0 AS distance, row_number() OVER (ORDER BY distance, user_id) = 1 AS chosen FROM d""",
)
def x13(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return rounded(B.choose_nearest(e, "user_id", ["mean"], ["spread"]), 4, nudge=True)


@query("x14_swarm_minimum")
def x14(spark, sf_dir):
    import numpy as np

    best, value = B.swarm(lambda p: float(np.sum(p * p)), 3, -5, 5, particles=20, rounds=200, inertia=0.5, seed=3)
    return spark.createDataFrame([(i, float(round(x, 3) + 0.0), value < 0.1) for i, x in enumerate(best)], "dim int, position double, found boolean")


@query("x14_swarm_choice")
def x14_choice(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return rounded(B.choose_by_swarm(e, "user_id", ["mean"], ["spread"]), 4)


@query(
    "x15_test_functions",
    """WITH p AS (SELECT event_id, value / 100 AS x, epoch_us(ts) % 1000 / 500.0 AS y FROM events),
f AS (SELECT event_id, -20 * exp(-0.2 * sqrt((x * x + y * y) / 2)) - exp((cos(2 * pi() * x) + cos(2 * pi() * y)) / 2) + 20 + exp(1) AS ackley, 20 + x * x - 10 * cos(2 * pi() * x) + y * y - 10 * cos(2 * pi() * y) AS rastrigin,
 100 * power(y - x * x, 2) + power(1 - x, 2) AS rosenbrock, 418.9829 * 2 - x * sin(sqrt(abs(x))) - y * sin(sqrt(abs(y))) AS schwefel FROM p) SELECT event_id, """ + nudged(["ackley", "rastrigin", "rosenbrock", "schwefel"]) + " FROM f",
)
def x15(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") / 100).alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) % 1000 / 500.0).alias("y"))
    return rounded(e.select("event_id", *[v.alias(k) for k, v in B.test_functions([F.col("x"), F.col("y")]).items()]), 4, nudge=True)


_ROWS = f"""WITH {TICKS}, rows AS (SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS row_id, ts AS time, ts + INTERVAL 6 HOUR AS t1 FROM ticks), n AS (SELECT count(*) AS n FROM rows)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = deep(spark, sf_dir).select(F.col("ts").alias("time"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("t1"), "seq")
    return X.number_rows(own, "time", "seq").drop("seq")


def _piece(k: int) -> str:
    return f"CASE WHEN row_id < (n % {k}) * (n // {k} + 1) THEN row_id // (n // {k} + 1) ELSE n % {k} + (row_id - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"


@query(
    "m6_purged_folds",
    f"""{_ROWS}, p AS (SELECT rows.*, n, {_piece(5)} AS fold FROM rows, n), s AS (SELECT fold, min(time) AS t0, min(row_id) AS a, max(row_id) AS b, max(t1) AS te FROM p GROUP BY fold),
r AS (SELECT s.*, (SELECT coalesce(min(row_id), max(n)) FROM p WHERE time > te) AS rt FROM s), q AS (SELECT r.*, coalesce(rt, n) + CAST(floor(n * 0.01) AS BIGINT) AS rr FROM r, n),
o AS (SELECT q.fold, row_id, CASE WHEN row_id BETWEEN a AND b THEN 'test' WHEN row_id < a AND t1 <= t0 THEN 'train' WHEN row_id >= greatest(rr, b + 1) THEN 'train' END AS role FROM p, q)
SELECT CAST(fold AS INTEGER) AS fold, row_id, role FROM o WHERE role IS NOT NULL""",
)
def m6(spark, sf_dir):
    return X.purged_folds(event_rows(spark, sf_dir), 5, 0.01)


_SPLITS = """s AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split FROM range(6) x(a), range(6) y(b) WHERE a < b),
tp AS (SELECT split, piece, row_number() OVER (PARTITION BY piece ORDER BY split) - 1 AS path FROM (SELECT split, a AS piece FROM s UNION ALL SELECT split, b FROM s))"""


@query("m26_paths", f"WITH {_SPLITS} SELECT CAST(split AS INTEGER) AS split, CAST(piece AS INTEGER) AS piece, CAST(path AS INTEGER) AS path FROM tp")
def m26(spark, sf_dir):
    return X.splits(spark, 6)


@query(
    "m24_combinatorial_test",
    f"""{_ROWS}, {_SPLITS}, p AS (SELECT row_id, {_piece(6)} AS piece FROM rows, n) SELECT CAST(split AS INTEGER) AS split, CAST(path AS INTEGER) AS path, row_id FROM p JOIN tp USING (piece)""",
)
def m24(spark, sf_dir):
    return X.combinatorial_test(event_rows(spark, sf_dir), X.splits(spark, 6), 6)


@query(
    "m25_purge_and_embargo",
    f"""{_ROWS}, {_SPLITS}, p AS (SELECT rows.*, {_piece(6)} AS piece FROM rows, n), g AS (SELECT piece, min(time) AS s, max(time) AS e FROM p GROUP BY piece)
SELECT CAST(split AS INTEGER) AS split, row_id FROM (SELECT tp.split, p.row_id, bool_and(p.piece <> tp.piece AND (p.t1 < g.s OR p.time > g.e + INTERVAL 2 DAY)) AS stays FROM p, tp JOIN g USING (piece) GROUP BY tp.split, p.row_id) WHERE stays""",
)
def m25(spark, sf_dir):
    return X.combinatorial_train(event_rows(spark, sf_dir), X.splits(spark, 6), 6, 2)


_P = "least(value / 200, 1.0)"


@query("m20_bet_size", f"""WITH e AS (SELECT event_id, {_P} AS probability, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, value / 100 AS u FROM events), z AS (SELECT *, (probability - 0.5) / nullif(sqrt(greatest(probability * (1 - probability), 0)), 0) AS z FROM e),
s AS (SELECT *, CASE WHEN probability >= 1 THEN 1.0 WHEN probability <= 0 THEN -1.0 ELSE 2 * ({_phi('z')}) - 1 END AS size0 FROM z)
SELECT event_id, round(probability + 1.3e-7, 4) + 0.0 AS probability, round(greatest(-1, least(1, round_even(side * size0 / 0.2, 0) * 0.2)) + 1.3e-7, 4) + 0.0 AS size, round({_phi('u')} + 1.3e-7, 4) + 0.0 AS phi FROM s""")
def m20(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p, side = F.least(F.col("value") / 200, F.lit(1.0)), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return rounded(e.select("event_id", p.alias("probability"), X.bet_size(p, side).alias("size"), normal_cdf(F.col("value") / 100).alias("phi")), 4, nudge=True)


@query(
    "p8_three_way_split",
    """WITH u AS (SELECT event_id, CAST('0x' || substr(md5('5|' || event_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events) SELECT event_id, CASE WHEN u < 0.6 THEN 'exogenous' WHEN u < 0.8 THEN 'endogenous' ELSE 'backtest' END AS part FROM u""",
)
def p8(spark, sf_dir):
    return X.three_way(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), 0.6, "event_id", seed=5)


@query(
    "e10_equity_curve",
    f"""WITH {TICKS}, d AS (SELECT date, sum(price * vol) AS v FROM ticks GROUP BY date), r AS (SELECT date, v, v / lag(v) OVER (ORDER BY date) - 1 AS ret FROM d)
SELECT date, round(coalesce(ret, 0) + 1.3e-7, 4) + 0.0 AS ret, round(least(coalesce(ret, 0), 0) + 1.3e-7, 4) + 0.0 AS fall FROM r""",
)
def e10(spark, sf_dir):
    d = deep(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.sum(F.col("price") * F.col("vol")).alias("v"))
    ret = F.coalesce(F.col("v") / F.lag("v").over(Window.orderBy("date")) - 1, F.lit(0.0))
    return rounded(d.select("date", ret.alias("ret")).withColumn("fall", F.least("ret", F.lit(0.0))), 4, nudge=True)
