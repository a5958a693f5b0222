"""Queries over imbalance bars, allocation, learning and the event backtester."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.operators import allocation, bars, crossval, event_backtest, imbalance, learning, sampling
from tickloom.queries.barset import deep
from tickloom.queries.labelset import _RETS, bar_returns, numbered_bars
from tickloom.queries.registry import BARS, TICKS, nudged, plain_times, query, rounded, table

_FLOW = f"""{TICKS}, m AS (SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS mv FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
fl AS (SELECT *, last_value(mv IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS b FROM m),
dy AS (SELECT symbol, date, count(*) AS n, avg((b > 0)::INT) AS p, avg(vol) FILTER (b > 0) AS u, avg(vol) FILTER (b < 0) AS d FROM fl WHERE b IS NOT NULL GROUP BY symbol, date),
ex AS (SELECT symbol, avg(n) / 10 AS e_t, avg(p) AS p_up, avg(u) AS e_up, avg(d) AS e_down FROM dy GROUP BY symbol)"""


@query("b8_signed_flow", f"WITH {_FLOW} SELECT symbol, ts, seq, CAST(b * vol AS DOUBLE) AS flow FROM fl")
def b8(spark, sf_dir):
    return plain_times(imbalance.signed_flow(deep(spark, sf_dir)).select("symbol", "ts", "seq", "flow"))


@query("b9_expectations", f"WITH {_FLOW}, o AS (SELECT *, p_up * e_up - (1 - p_up) * e_down AS e_flow FROM ex) SELECT symbol, {nudged(['e_t', 'p_up', 'e_up', 'e_down', 'e_flow'], 6)} FROM o")
def b9(spark, sf_dir):
    return rounded(imbalance.expectations(imbalance.signed_flow(deep(spark, sf_dir))), nudge=True)


_IMB = f"""WITH RECURSIVE {_FLOW}, q AS (SELECT f.symbol, ts, seq, b * vol AS x, e_t, p_up * e_up - (1 - p_up) * e_down AS e_flow, row_number() OVER (PARTITION BY f.symbol ORDER BY ts, seq) AS i FROM fl f JOIN ex ON ex.symbol = f.symbol WHERE b IS NOT NULL),
r AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS th, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS bar, CAST(0 AS BIGINT) AS nxt, e_t, e_flow FROM q WHERE i = 1
 UNION ALL SELECT r.symbol, q.i, CASE WHEN abs(th + x) >= abs(r.e_t * r.e_flow) THEN 0 ELSE th + x END, CASE WHEN abs(th + x) >= abs(r.e_t * r.e_flow) THEN 0 ELSE n + 1 END, nxt, nxt + (abs(th + x) >= abs(r.e_t * r.e_flow))::BIGINT,
  CASE WHEN abs(th + x) >= abs(r.e_t * r.e_flow) THEN 0.9 * r.e_t + 0.1 * (n + 1) ELSE r.e_t END, CASE WHEN abs(th + x) >= abs(r.e_t * r.e_flow) THEN 0.9 * r.e_flow + 0.1 * (th + x) / (n + 1) ELSE r.e_flow END
  FROM r JOIN q ON q.symbol = r.symbol AND q.i = r.i + 1),
z AS (SELECT q.symbol, q.ts, q.seq, r.bar AS bar_id FROM r JOIN q ON q.symbol = r.symbol AND q.i = r.i)"""


def _imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = imbalance.signed_flow(deep(spark, sf_dir))
    return imbalance.imbalance_bars(flows, imbalance.expectations(flows))


@query("b7_imbalance_bars", _IMB + " SELECT symbol, ts, seq, bar_id FROM z")
def b7(spark, sf_dir):
    return plain_times(_imbalance(spark, sf_dir).select("symbol", "ts", "seq", "bar_id"))


@query("b10_imbalance_counts", _IMB + ", e AS (SELECT symbol, bar_id, max(ts) AS ts FROM z GROUP BY symbol, bar_id) SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS n_bars FROM e GROUP BY ALL")
def b10(spark, sf_dir):
    return imbalance.imbalance_counts(_imbalance(spark, sf_dir))


@query("de1_bar_entropy")
def de1(spark, sf_dir):
    return rounded(imbalance.bar_entropy(bars.assign(bars.with_tick_rule(deep(spark, sf_dir)), "volume", 2000)))


ASSETS = ["click", "error", "purchase", "signup", "view"]


def asset_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars.daily(deep(spark, sf_dir)).groupBy("date").pivot("symbol", ASSETS).agg(F.first(F.log(ratio(F.col("last_price"), F.col("first_price")))))
    return days.na.drop()


@query("dp1_least_variance")
def dp1(spark, sf_dir):
    return rounded(allocation.weights(asset_returns(spark, sf_dir), ASSETS, "least_variance"))


@query("dp2_eigen_risk")
def dp2(spark, sf_dir):
    return rounded(allocation.weights(asset_returns(spark, sf_dir), ASSETS, "eigen_risk"))


@query("dp3_hierarchical_risk_parity")
def dp3(spark, sf_dir):
    return rounded(allocation.weights(asset_returns(spark, sf_dir), ASSETS, "hierarchical"))


@query("dp4_basket", f"""WITH {TICKS}, d AS (SELECT date, symbol, arg_max(price, (ts, seq)) AS p FROM ticks GROUP BY date, symbol), w AS (SELECT date, max(p) FILTER (symbol = 'click') AS a, max(p) FILTER (symbol = 'view') AS b FROM d GROUP BY date),
f AS (SELECT date, greatest(1 + coalesce(0.5 * (a / lag(a) OVER (ORDER BY date) - 1) + 0.5 * (b / lag(b) OVER (ORDER BY date) - 1), 0), 1e-12) AS f FROM w) SELECT date, round(ln(exp(sum(ln(f)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))) + 1.3e-7, 4) + 0.0 AS log_value FROM f""")
def dp4(spark, sf_dir):
    wide = bars.daily(deep(spark, sf_dir)).groupBy("date").pivot("symbol", ["click", "view"]).agg(F.first("last_price"))
    return rounded(allocation.basket(wide, "date", ["click", "view"], {"click": 0.5, "view": 0.5}).select("date", F.log("value").alias("log_value")), 4, nudge=True)


FEATURES = ["f_ret", "f_ret2", "f_vol", "f_sign", "f_range", "f_vwap"]


def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with six features and the direction of the next bar (0, 1, 2)."""
    from pyspark.ml.feature import VectorAssembler  # noqa: F401

    w = Window.partitionBy("symbol").orderBy("bar")
    own = numbered_bars(spark, sf_dir).withColumn("f_ret", F.log(ratio(F.col("close_price"), F.lag("close_price").over(w))))
    ahead = F.log(ratio(F.lead("close_price").over(w), F.col("close_price")))
    own = own.withColumns({
        "f_ret2": F.lag("f_ret").over(w), "f_vol": F.col("bar_cum_volume") / 100.0, "f_sign": F.col("feat_signVolSide") / 100.0, "f_range": F.log(ratio(F.col("high_price"), F.col("low_price"))),
        "f_vwap": ratio(F.col("vwap"), F.col("close_price")) - 1, "label": F.when(ahead > 0.7, 2.0).when(ahead < -0.7, 0.0).when(ahead.isNotNull(), 1.0), "time": F.col("close_date"), "t1": F.lead("close_date").over(w),
    })
    rows = own.select("symbol", "bar", "time", "t1", "close_price", *FEATURES, "label", F.lit(1.0).alias("w")).na.drop()
    return crossval.number_rows(rows, "time", "symbol")


@query("m1_standardised", f"""WITH {BARS}, s AS (SELECT symbol, date, bar_id, (close_price - avg(close_price) OVER ()) / stddev_pop(close_price) OVER () AS z, (vwap - avg(vwap) OVER (PARTITION BY symbol)) / stddev_pop(vwap) OVER (PARTITION BY symbol) AS zs FROM bars) SELECT symbol, date, bar_id, {nudged(['z', 'zs'], 6)} FROM s""")
def m1(spark, sf_dir):
    own = numbered_bars(spark, sf_dir).select("symbol", "date", "bar_id", F.col("close_price").alias("z"), F.col("vwap").alias("zs"))
    return rounded(learning.standardise(learning.standardise(own, ["z"]), ["zs"], "symbol"), nudge=True)


@query("m2_stationarity", f"""WITH {BARS}, l AS (SELECT symbol, close_price AS y, lag(close_price) OVER (PARTITION BY symbol ORDER BY date, bar_id) AS x FROM bars),
s AS (SELECT symbol, count(*) AS n, regr_slope(y - x, x) AS b, regr_syy(y - x, x) AS syy, regr_sxx(y - x, x) AS sxx FROM l WHERE x IS NOT NULL GROUP BY symbol), t AS (SELECT symbol, b / sqrt((syy - b * b * sxx) / ((n - 2) * sxx)) AS t FROM s)
SELECT symbol, 'close_price' AS feature, round(t + 1.3e-7, 4) + 0.0 AS t, t < -2.86 AS stationary FROM t""")
def m2(spark, sf_dir):
    return rounded(learning.stationarity(numbered_bars(spark, sf_dir), ["close_price"], "bar"), 4, nudge=True)


@query("m3_principal_axes")
def m3(spark, sf_dir):
    rows = learning_rows(spark, sf_dir)
    _, axes = learning.principal_axes(rows, FEATURES)
    return rounded(learning.project(rows.select("row_id", *FEATURES), FEATURES, axes))


@query("m4_impurity_importance")
def m4(spark, sf_dir):
    return learning.mean_decrease_impurity(learning_rows(spark, sf_dir), FEATURES, trees=10)


@query("m5_permutation_importance")
def m5(spark, sf_dir):
    rows = learning_rows(spark, sf_dir).persist()
    return learning.mean_decrease_accuracy(rows, FEATURES, crossval.purged_folds(rows, 3, 0.01).persist(), learning.forest(5, 3), "accuracy")


@query("m7_cross_scores")
def m7(spark, sf_dir):
    rows = learning_rows(spark, sf_dir).persist()
    scores = learning.cross_scores(rows, FEATURES, crossval.purged_folds(rows, 3, 0.01).persist(), learning.forest(5, 3), "accuracy")
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "fold int, score double")


@query("m9_clustered_importance")
def m9(spark, sf_dir):
    rows = learning_rows(spark, sf_dir)
    return learning.clustered_impurity(learning.mean_decrease_impurity(rows, FEATURES, trees=10), learning.cluster_features(rows, FEATURES))


@query("m10_feature_clusters")
def m10(spark, sf_dir):
    found = learning.cluster_features(learning_rows(spark, sf_dir), FEATURES)
    return spark.createDataFrame(sorted(found.items()), "feature string, cluster int")


@query("m12_residuals", f"""WITH {BARS}, r AS (SELECT regr_slope(vwap, close_price) AS b, regr_intercept(vwap, close_price) AS a FROM bars) SELECT symbol, date, bar_id, round(vwap - a - b * close_price + 1.3e-7, 4) + 0.0 AS vwap FROM bars, r""")
def m12(spark, sf_dir):
    own = numbered_bars(spark, sf_dir).select("symbol", "date", "bar_id", "vwap", "close_price")
    return rounded(learning.residualise(own, "vwap", ["close_price"]).drop("close_price"), 4, nudge=True)


@query("m13_feature_subsets")
def m13(spark, sf_dir):
    found = learning.feature_subsets(FEATURES, 3, 4)
    return spark.createDataFrame([(i, list(s)) for i, s in enumerate(found)], "subset int, features array<string>")


_COLUMNS = ("open_price", "high_price", "low_price", "close_price", "bar_cum_volume", "basic_volatility", "vwap", "n_ticks")
#: A row for each feature of the bars: its variation, and how it goes with the next move.
FIGURES = (
    BARS
    + ", mv AS (SELECT *, lead(close_price) OVER (PARTITION BY symbol ORDER BY date, bar_id) - close_price AS move FROM bars), s AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_pop({c}) / avg({c}) AS a, abs(corr({c}, move)) AS b FROM mv" for c in _COLUMNS)
    + ")"
)


def feature_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, a, b`` for the columns of all bars, from one pass."""
    move = F.lead("close_price").over(Window.partitionBy("symbol").orderBy("bar")) - F.col("close_price")
    own = numbered_bars(spark, sf_dir).withColumn("_move", move)
    each = [F.struct(F.lit(c).alias("feature"), (F.stddev_pop(c) / F.avg(c)).alias("a"), F.abs(F.corr(F.col(c).cast("double"), F.col("_move"))).alias("b")) for c in _COLUMNS]
    return own.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("m14_kendall", f"WITH {FIGURES}, p AS (SELECT sign(x.a - y.a) AS u, sign(x.b - y.b) AS v FROM s x JOIN s y ON x.feature < y.feature) SELECT round(sum(u * v) / sqrt(sum(u * u) * sum(v * v)) + 1.3e-9, 6) + 0.0 AS tau, (SELECT count(*) FROM s) AS n FROM p")
def m14(spark, sf_dir):
    return rounded(learning.kendall(feature_figures(spark, sf_dir), "a", "b").select("tau", F.col("n").cast("long").alias("n")), nudge=True)


@query("m17_search")
def m17(spark, sf_dir):
    rows = learning_rows(spark, sf_dir).persist()
    _, scored = learning.search(rows, FEATURES, crossval.purged_folds(rows, 2).persist(), learning.forest(5), {"maxDepth": [2, 4]}, "accuracy")
    return spark.createDataFrame([(p["maxDepth"], s) for p, s in scored], "max_depth int, score double")


_DRAWS = "[" + ", ".join(repr(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(learning.MOST_DRAWS)) + "]"


@query("m17_bag_draws", f"""WITH b AS (SELECT event_id AS row_id, bag, CAST('0x' || substr(md5('7|' || event_id || '|' || bag), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events, range(10) t(bag)),
d AS (SELECT row_id, CAST(bag AS INTEGER) AS bag, CAST(len(list_filter({_DRAWS}, lambda x: u >= x)) AS INTEGER) AS draws FROM b) SELECT * FROM d WHERE draws > 0""")
def m17_draws(spark, sf_dir):
    return learning.bag_draws(table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id")), 10, 7)


@query("m17_weighted_f1", f"""WITH {TICKS}, p AS (SELECT symbol, seq % 3 AS label, CASE WHEN price > 120 THEN 2 WHEN price > 60 THEN 1 ELSE 0 END AS prediction, CAST(vol AS DOUBLE) AS w FROM ticks),
c AS (SELECT symbol, k, sum(w) FILTER (label = k) AS t, coalesce(2 * sum(w) FILTER (label = k AND prediction = k), 0) / (coalesce(sum(w) FILTER (label = k), 0) + coalesce(sum(w) FILTER (prediction = k), 0)) AS f FROM p, range(3) x(k) GROUP BY symbol, k)
SELECT symbol, round(sum(t * f) / sum(t) + 1.3e-9, 6) + 0.0 AS f1 FROM c GROUP BY symbol""")
def m17_f1(spark, sf_dir):
    price = F.col("price")
    own = deep(spark, sf_dir).select("symbol", (F.col("seq") % 3).alias("label"), F.when(price > 120, 2).when(price > 60, 1).otherwise(0).alias("prediction"), F.col("vol").cast("double").alias("w"))
    return rounded(own.groupBy("symbol").agg(learning.weighted_f1()(own).alias("f1")), nudge=True)


@query("m17_bagged_votes")
def m17_votes(spark, sf_dir):
    rows = learning_rows(spark, sf_dir)
    models = learning.bagging(rows, FEATURES, learning.forest(3, 3), bags=5)
    return learning.voted(models, rows, FEATURES).select("row_id", "label", "prediction", "probability")


@query("m19_oversampled")
def m19(spark, sf_dir):
    return learning.oversample(learning_rows(spark, sf_dir), FEATURES).select("row_id", "label", *FEATURES)


@query("m23_rule_model", f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, bar_id) AS bar FROM bars), m AS (SELECT symbol, bar, close_price, avg(close_price) OVER (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING) AS m FROM n) SELECT symbol, bar, CASE WHEN close_price > m THEN 1 WHEN close_price < m THEN -1 ELSE 0 END AS predicted FROM m")
def m23(spark, sf_dir):
    mean = F.avg("close_price").over(Window.partitionBy("symbol").orderBy("bar").rowsBetween(-4, 0))
    own = numbered_bars(spark, sf_dir).select("symbol", "bar", "close_price").withColumn("mean", mean)
    rule = lambda d: F.when(d["close_price"] > d["mean"], 1).when(d["close_price"] < d["mean"], -1).otherwise(0)
    return learning.rule_model(own, rule).select("symbol", "bar", "predicted")


@query("m27_composite_backtest")
def m27(spark, sf_dir):
    rows = learning_rows(spark, sf_dir).persist()
    cut = rows.count() * 3 // 4
    out = learning.composite(rows.where(F.col("row_id") >= cut), FEATURES, rows.where(F.col("row_id") < cut), learning.forest(5, 3), learning.forest(5, 3, 1))
    return plain_times(learning.backtest_frame(out).select("symbol", "bar", "time", "predicted", "bet_size", "leverage", "trial"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_backtest.heartbeats(deep(spark, sf_dir), "6 hours")


_BEATS = f"""{TICKS}, hb AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS start, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY ALL),
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS i FROM hb),
fi AS (SELECT symbol, start, price, CASE WHEN i % 3 = 0 THEN 100 WHEN i > 3 AND i % 3 = 1 THEN -100 ELSE 0 END AS q FROM nb),
le AS (SELECT symbol, start, price, CAST(coalesce(sum(q) OVER w, 0) AS BIGINT) AS held, coalesce(sum(-q * price) OVER w, 0) AS cash_flow, coalesce(sum(CASE WHEN q <> 0 THEN 1.3 ELSE 0 END) OVER w, 0) AS fees FROM fi WINDOW w AS (PARTITION BY symbol ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("e5_fills", f"WITH {_BEATS} SELECT symbol, start, price, CASE WHEN q > 0 THEN 'LONG' ELSE 'EXIT' END AS signal, CAST(q AS BIGINT) AS quantity FROM fi WHERE q <> 0")
def e5(spark, sf_dir):
    return plain_times(event_backtest.simulate(beats(spark, sf_dir), event_backtest.Alternating))


@query("e8_ledger", f"WITH {_BEATS} SELECT symbol, start, held, round(held * price + 1.3e-7, 4) + 0.0 AS market_value, round(cash_flow + 1.3e-7, 4) + 0.0 AS cash_flow, round(fees + 1.3e-7, 4) + 0.0 AS fees FROM le")
def e8(spark, sf_dir):
    b = beats(spark, sf_dir)
    return rounded(event_backtest.ledger(b, event_backtest.simulate(b, event_backtest.Alternating)), 4, nudge=True)


@query("e10_equity", f"""WITH {_BEATS}, t AS (SELECT start, 100000 + sum(cash_flow) - sum(fees) AS cash, sum(held * price) AS holdings FROM le GROUP BY start), r AS (SELECT *, cash + holdings AS total FROM t)
SELECT start, round(cash + 1.3e-7, 4) AS cash, round(holdings + 1.3e-7, 4) AS holdings, round(total + 1.3e-7, 4) AS total FROM r""")
def e10_equity(spark, sf_dir):
    b = beats(spark, sf_dir)
    curve = event_backtest.equity(event_backtest.ledger(b, event_backtest.simulate(b, event_backtest.Alternating)))
    return rounded(curve.select("start", "cash", "holdings", "total"), 4, nudge=True)


@query("e9_pending_orders", f"""WITH {TICKS}, o AS (SELECT seq AS order_id, symbol, ts AS placed, CASE WHEN seq % 2 = 0 THEN 'STP' ELSE 'LMT' END AS kind, CASE WHEN seq % 4 < 2 THEN 1 ELSE -1 END AS side, price * (1 + CASE WHEN (seq % 2 = 0) = (seq % 4 < 2) THEN 0.5 ELSE -0.5 END) AS target, ts + INTERVAL 12 HOUR AS expires FROM ticks),
h AS (SELECT order_id, t.ts, t.seq, t.price FROM o JOIN ticks t ON t.symbol = o.symbol AND t.ts > placed AND t.ts <= expires WHERE CASE WHEN (kind = 'STP') = (side = 1) THEN t.price >= target ELSE t.price <= target END)
SELECT order_id, min(ts) AS ts, arg_min(price, (ts, seq)) AS price FROM h GROUP BY order_id""")
def e9(spark, sf_dir):
    t = deep(spark, sf_dir)
    seq = F.col("seq")
    up = ((seq % 2) == 0) == ((seq % 4) < 2)
    orders = t.select(
        seq.alias("order_id"), "symbol", F.col("ts").alias("placed"), F.when(seq % 2 == 0, "STP").otherwise("LMT").alias("kind"), F.when(seq % 4 < 2, 1).otherwise(-1).alias("side"),
        (F.col("price") * (1 + F.when(up, 0.5).otherwise(-0.5))).alias("target"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires"),
    )
    return plain_times(event_backtest.pending_fills(orders, t))


@query("e7_commissions", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n, round(max(CASE WHEN l_quantity * 20 <= 500 THEN greatest(1.3, 0.013 * l_quantity * 20) ELSE greatest(1.3, 0.008 * l_quantity * 20) END) + 1.3e-9, 6) AS fee FROM lineitem GROUP BY l_orderkey, l_linenumber, l_quantity")
def e7(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber", "l_quantity").agg(F.count("*").alias("n"))
    return rounded(q.withColumn("fee", event_backtest.commission(F.col("l_quantity") * 20)), nudge=True)


@query("e3_latest_beats", f"WITH {_BEATS} SELECT symbol, start, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start DESC) AS k FROM hb) WHERE k <= 3")
def e3(spark, sf_dir):
    return plain_times(event_backtest.latest(beats(spark, sf_dir).select("symbol", "start", "price"), 3))


@query("dc3_sampled_on_returns", "WITH RECURSIVE " + _RETS + """, k AS (SELECT symbol, bar, close_date, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM (SELECT nb.symbol, nb.bar, nb.close_date, rets.ret FROM nb JOIN rets USING (symbol, bar)) WHERE ret <> 0),
s AS (SELECT symbol, CAST(1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, 0 AS event FROM (SELECT DISTINCT symbol FROM k)
 UNION ALL SELECT r.symbol, r.i, CASE WHEN NOT (least(0, down + ret) < -1) AND greatest(0, up + ret) > 1 THEN 0 ELSE greatest(0, up + ret) END,
  CASE WHEN least(0, down + ret) < -1 THEN 0 ELSE least(0, down + ret) END, CASE WHEN least(0, down + ret) < -1 THEN -1 WHEN greatest(0, up + ret) > 1 THEN 1 ELSE 0 END
  FROM s JOIN k r ON r.symbol = s.symbol AND r.i = s.i + 1)
SELECT symbol, bar, close_date, event FROM s JOIN k USING (symbol, i) WHERE event <> 0""")
def dc3(spark, sf_dir):
    return plain_times(sampling.sampled(bar_returns(spark, sf_dir), "ret", 1.0, ["symbol"], ["bar"], "ret <> 0").select("symbol", "bar", "close_date", "event"))


_LAGGED = _RETS + """, l0 AS (SELECT symbol, bar, ln(close_price) AS y FROM rets), l1 AS (SELECT symbol, bar, lag(y) OVER w AS x0, y - lag(y) OVER w AS d FROM l0 WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
l AS (SELECT symbol, bar, x0, lag(d) OVER (PARTITION BY symbol ORDER BY bar) AS x1, d FROM l1), o AS (SELECT * FROM l WHERE x1 IS NOT NULL)"""


@query("ds2_lag_choice", f"""WITH {_LAGGED}, t AS (SELECT symbol, count(*) AS n, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c, sum(x0 * d) AS p, sum(x1 * d) AS q, sum(d * d) AS r FROM o GROUP BY symbol),
f AS (SELECT symbol, n * ln((r - p * p / a) / n) + ln(n) AS none, n * ln((r - (c * p - b * q) / (a * c - b * b) * p - (a * q - b * p) / (a * c - b * b) * q) / n) + 2 * ln(n) AS one FROM t) SELECT symbol, CASE WHEN one < none THEN 1 ELSE 0 END AS lags FROM f""")
def ds2(spark, sf_dir):
    return sampling.lag_choice(bar_returns(spark, sf_dir), "close_price", ["symbol"], ["bar"])


@query("ds1_lagged_sadf", f"""WITH {_LAGGED}, c AS (SELECT symbol, bar, sum(x0 * x0) OVER w AS a, sum(x0 * x1) OVER w AS b, sum(x1 * x1) OVER w AS c, sum(x0 * d) OVER w AS p, sum(x1 * d) OVER w AS q, sum(d * d) OVER w AS r FROM o WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)),
z AS (SELECT * FROM c UNION ALL SELECT DISTINCT symbol, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0 FROM c),
g AS (SELECT e.symbol, e.bar, e.bar - s.bar AS m, e.a - s.a AS a, e.b - s.b AS b, e.c - s.c AS c, e.p - s.p AS p, e.q - s.q AS q, e.r - s.r AS r FROM c e JOIN z s ON s.symbol = e.symbol AND s.bar <= e.bar - 10 WHERE e.bar - s.bar <= 60),
h AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b0, (a * q - b * p) / (a * c - b * b) AS b1 FROM g), t AS (SELECT symbol, bar, max(b0 / sqrt((r - b0 * p - b1 * q) / (m - 2) * c / (a * c - b * b))) AS t FROM h GROUP BY symbol, bar)
SELECT rets.symbol, rets.bar, round(t + 1.3e-7, 4) + 0.0 AS sadf FROM rets LEFT JOIN t USING (symbol, bar)""")
def ds1_lagged(spark, sf_dir):
    """One lag, regressions of 10 to 60 rows."""
    own = sampling.sadf(bar_returns(spark, sf_dir), "close_price", ["symbol"], ["bar"], least=12, lags=1, longest=60)
    return rounded(own.select("symbol", "bar", "sadf"), 4, nudge=True)


def _basket_sql(assets: list[str], first: int) -> str:
    """The recursion over the days of all assets; least-variance weights by elimination, column by column."""
    k = range(len(assets))
    each = lambda text, sep=", ": sep.join(text.format(j=j) for j in k)
    pick = lambda c: ", ".join(f"max({c}) FILTER (symbol = '{a}') AS {c}{j}" for j, a in enumerate(assets))
    steps = [f"g0 AS (SELECT *, {', '.join(f'covar_samp(r{i}, r{j}) OVER p AS a{i}_{j}' for i in k for j in k)}, {each('1.0::DOUBLE AS b{j}')} FROM n WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"]
    plain = "date, i, " + ", ".join(f"{c}{j}" for c in ("o", "c", "n") for j in k)
    for p in k:
        rows = [f"a{i}_{j}" + (f" - a{i}_{p} * a{p}_{j} / a{p}_{p}" if i != p else "") + f" AS a{i}_{j}" for i in k for j in k]
        sides = [f"b{i}" + (f" - a{i}_{p} * b{p} / a{p}_{p}" if i != p else "") + f" AS b{i}" for i in k]
        steps.append(f"g{p + 1} AS (SELECT {plain}, {', '.join(rows + sides)} FROM g{p}{f' WHERE i >= {first}' if p == 0 else ''})")
    total = " + ".join(f"b{j} / a{j}_{j}" for j in k)
    steps.append(f"y AS (SELECT {plain}, {', '.join(f'b{j} / a{j}_{j} / ({total}) AS w{j}' for j in k)} FROM g{len(assets)} WHERE n0 IS NOT NULL)")
    size = " + ".join(f"abs(w{j})" for j in k)
    steps.append(f"x AS (SELECT *, {', '.join(f'w{j} / (n{j} * n{j} / 100 * ({size})) AS u{j}' for j in k)} FROM y)")
    steps.append(f"f AS (SELECT i, date, {', '.join(f'u{j}, o{j}' for j in k)}, 1 + coalesce({' + '.join(f'lag(u{j}) OVER (ORDER BY i) * n{j} / 100 * (c{j} - o{j})' for j in k)}, 0) AS f FROM x)")
    steps.append(f"m AS (SELECT i, date, 10000 * f AS k, {', '.join(f'u{j}, o{j}' for j in k)} FROM f WHERE i = {first} UNION ALL SELECT f.i, f.date, m.k * f.f, {', '.join(f'f.u{j}, f.o{j}' for j in k)} FROM m JOIN f ON f.i = m.i + 1)")
    return f"""WITH RECURSIVE {TICKS}, d AS (SELECT date, symbol, arg_min(price, (ts, seq)) AS o, arg_max(price, (ts, seq)) AS c FROM ticks GROUP BY date, symbol),
w AS (SELECT date, {pick('o')}, {pick('c')} FROM d GROUP BY date),
n AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, {each('c{j} / lag(c{j}) OVER (ORDER BY date) - 1 AS r{j}')}, {each('lead(o{j}) OVER (ORDER BY date) AS n{j}')} FROM w WHERE {each('o{j} + c{j}', ' + ')} IS NOT NULL),
{", ".join(steps)},
t AS (SELECT date, k, k * ({each('u{j} * o{j}', ' + ')}) AS v FROM m)
SELECT date, round(sign(k) * ln(abs(k) + 1) + 1.3e-9, 6) + 0.0 AS capital, round(sign(v) * ln(abs(v) + 1) + 1.3e-9, 6) + 0.0 AS value FROM t"""


@query("dp4_traded_basket", _basket_sql(ASSETS, 10))
def dp4_traded(spark, sf_dir):
    days = bars.daily(deep(spark, sf_dir)).groupBy("date").pivot("symbol", ASSETS).agg(F.first("first_price").alias("open"), F.first("last_price").alias("close"))
    wide = days.select("date", *[F.col(f"{a}_{c}").alias(f"{c}_{a}") for a in ASSETS for c in ("open", "close")]).na.drop()
    made = allocation.traded_basket(wide, "date", ASSETS, first=10)
    return rounded(made.select("date", *[(F.signum(c) * F.log1p(F.abs(c))).alias(c) for c in ("capital", "value")]), nudge=True)  # magnitudes differ
