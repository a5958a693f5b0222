"""Queries over bar features and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.operators import features
from tickloom.queries.labelset import numbered_bars
from tickloom.queries.registry import BARS, ORACLE_SQL, nudged, query, rounded

_NB = BARS + """, b AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date, bar_id) AS bar, open_price AS o, high_price AS h, low_price AS l, close_price AS c, bar_cum_volume AS v,
  vol_buy, vol_sell, dollars, hasbrouck FROM bars)"""
_W = "(PARTITION BY symbol ORDER BY bar)"


def _rows(n: int, back: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1 + back} PRECEDING AND {back} PRECEDING)".replace("AND 0 PRECEDING", "AND CURRENT ROW")


def _full(agg: str, n: int, x: str, back: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(n, back)} >= {n} THEN {agg} OVER {_rows(n, back)} END"


_round = nudged


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_bars(spark, sf_dir)


_TECH = ["trima", "kama", "ema", "aroonosc", "mfi", "rsi", "ultosc", "willr", "atr", "bop", "disparity", "choppiness", "fisher", "countdown_ind"]
_REC = _NB + f""", q AS (SELECT *, lag(c) OVER {_W} AS c1, lag(h) OVER {_W} AS h1, lag(l) OVER {_W} AS l1, lag(c, 30) OVER {_W} AS c30 FROM b),
i AS (SELECT *, avg(c) OVER {_rows(30)} AS sma, greatest(c - c1, 0) AS up, greatest(c1 - c, 0) AS down, greatest(h, c1) - least(l, c1) AS tr,
  CASE WHEN bar = 1 THEN 0 ELSE (c > o)::INT + (h > h1)::INT - (c < o)::INT - (l < l1)::INT END AS press, abs(c - c1) AS step FROM q),
j AS (SELECT *, avg(up) OVER {_rows(14)} AS ups, avg(down) OVER {_rows(14)} AS downs, avg(tr) OVER {_rows(14)} AS trs, avg(press) OVER {_rows(30)} AS presses,
  power(abs(c - c30) / sum(step) OVER {_rows(30)} * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc FROM i),
r AS (SELECT symbol, bar, CAST(NULL AS DOUBLE) AS ema, CAST(NULL AS DOUBLE) AS kama, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS cd FROM j WHERE bar = 1
 UNION ALL SELECT j.symbol, j.bar, CASE WHEN j.bar = 30 THEN sma WHEN j.bar > 30 THEN ema + (c - ema) * 2 / 31 END,
  CASE WHEN j.bar = 31 THEN c1 + sc * (c - c1) WHEN j.bar > 31 THEN kama + sc * (c - kama) END,
  CASE WHEN j.bar = 15 THEN ups WHEN j.bar > 15 THEN g + (up - g) / 14 END, CASE WHEN j.bar = 15 THEN downs WHEN j.bar > 15 THEN d + (down - d) / 14 END,
  CASE WHEN j.bar = 15 THEN trs WHEN j.bar > 15 THEN atr + (tr - atr) / 14 END, CASE WHEN j.bar = 30 THEN presses WHEN j.bar > 30 THEN cd + (press - cd) * 2 / 31 END
  FROM r JOIN j ON j.symbol = r.symbol AND j.bar = r.bar + 1)"""


@query("f_technical", "WITH RECURSIVE " + _REC + f""",
k AS (SELECT b.*, ema, kama, 100 * g / (g + d) AS rsi, atr, cd AS countdown_ind, lag(c) OVER w AS c1, (h + l + c) / 3 AS tp, {_full("avg(c)", 16, "c")} AS s16 FROM b JOIN r USING (symbol, bar) WINDOW w AS {_W}),
m AS (SELECT *, CASE WHEN c1 IS NULL THEN NULL WHEN tp > lag(tp) OVER w THEN tp * v ELSE 0 END AS up, CASE WHEN c1 IS NULL THEN NULL WHEN tp < lag(tp) OVER w THEN tp * v ELSE 0 END AS down, c - least(l, c1) AS bp, CASE WHEN c1 IS NOT NULL THEN greatest(h, c1) - least(l, c1) END AS tr FROM k WINDOW w AS {_W}),
n AS (SELECT *, CASE WHEN c1 IS NULL THEN NULL ELSE bp END AS bp2, CASE WHEN count(*) OVER {_rows(15)} >= 15 THEN 100.0 * (arg_max(bar, (h, bar)) OVER {_rows(15)} - arg_min(bar, (l, -bar)) OVER {_rows(15)}) / 14 END AS aroonosc,
  {_full("sum(up)", 14, "up")} AS fu, {_full("sum(down)", 14, "down")} AS fd, {_full("max(h)", 14, "h")} AS hh, {_full("min(l)", 14, "l")} AS ll,
  CASE WHEN c1 IS NULL THEN c ELSE max(c) OVER {_rows(15, 1)} - min(c) OVER {_rows(15, 1)} END AS spread, min(c) OVER {_rows(16)} AS lo, max(c) OVER {_rows(16)} AS hi, {_full("avg(s16)", 15, "s16")} AS trima FROM m),
y AS (SELECT *, CASE WHEN c1 IS NULL THEN -1 ELSE 2 * (c - lo) / nullif(hi - lo, 0) - 1 END AS y0,
  {_full("sum(bp2)", 7, "bp2")} / {_full("sum(tr)", 7, "tr")} AS p7, {_full("sum(bp2)", 14, "bp2")} / {_full("sum(tr)", 14, "tr")} AS p14, {_full("sum(bp2)", 28, "bp2")} / {_full("sum(tr)", 28, "tr")} AS p28 FROM n),
z AS (SELECT *, CASE WHEN y0 = 1 THEN 0.999 WHEN y0 = -1 THEN -0.999 ELSE y0 END AS y1, 100 * fu / nullif(fu + fd, 0) AS mfi, 100 * (4 * p7 + 2 * p14 + p28) / 7 AS ultosc, -100 * (hh - c) / nullif(hh - ll, 0) AS willr,
  coalesce((c - o) / nullif(h - l, 0), 0) AS bop, (c / ema - 1) * 100 AS disparity, 100 * log10(atr / nullif(spread, 0)) / log10(15) AS choppiness FROM y),
t AS (SELECT *, ln((1 + y1) / (1 - y1)) / 2 AS fisher FROM z)
SELECT symbol, bar, {_round(_TECH)} FROM t""")
def f_technical(spark, sf_dir):
    return rounded(features.technical(_bars(spark, sf_dir)), 4, nudge=True)


_SPEAR = """(SELECT symbol, bar, corr(rx, ry) AS rho FROM (SELECT symbol, bar, rank() OVER (PARTITION BY symbol, bar ORDER BY x) + (count(*) OVER (PARTITION BY symbol, bar, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY symbol, bar ORDER BY y) + (count(*) OVER (PARTITION BY symbol, bar, y) - 1) / 2.0 AS ry FROM ({pairs})) GROUP BY symbol, bar)"""
_RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY symbol, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0 END"
_ALPHAS = ["alpha2", "alpha3", "alpha5", "alpha9", "alpha12", "alpha14", "alpha20", "alpha23"]


@query("f_alphas", f"""WITH {_NB}, d AS (SELECT *, ln(v) - lag(ln(v), 2) OVER w AS v2, (c - o) / o AS co, c - lag(c) OVER w AS dc, v - lag(v) OVER w AS dv, o - (h - lag(h) OVER w) AS oh, o - (c - lag(c) OVER w) AS oc, o - (l - lag(l) OVER w) AS ol,
  h - lag(h, 2) OVER w AS h2, c / lag(c) OVER w - 1 AS pct FROM b WINDOW w AS {_W}),
e AS (SELECT *, pct - lag(pct, 3) OVER {_W} AS d3 FROM d),
a2 AS {_SPEAR.format(pairs="SELECT i.symbol, i.bar, j.v2 AS x, j.co AS y FROM e i JOIN e j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 18 AND i.bar - 1 WHERE i.bar > 20")},
a3 AS {_SPEAR.format(pairs="SELECT i.symbol, i.bar, j.o AS x, j.v AS y FROM e i JOIN e j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 20 AND i.bar - 1 WHERE i.bar > 20")},
a5 AS (SELECT i.symbol, i.bar, count(*) FILTER (j.l < i.l) + (count(*) FILTER (j.l = i.l) + 1) / 2.0 AS r FROM e i JOIN e j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 8 AND i.bar WHERE i.bar >= 9 GROUP BY i.symbol, i.bar),
g AS (SELECT symbol, corr(ro, rv) AS rho FROM (SELECT symbol, {_RANK.format(x="o")} AS ro, {_RANK.format(x="v")} AS rv FROM e) GROUP BY symbol),
k AS (SELECT symbol, bar, {_RANK.format(x="d3")} AS r3, {_RANK.format(x="oh")} AS r_oh, {_RANK.format(x="oc")} AS r_oc, {_RANK.format(x="ol")} AS r_ol FROM e),
u AS (SELECT symbol, min(dc) AS lo, max(dc) AS hi, avg(h) AS mh, arg_max(h, bar) AS lh, arg_max(h2, bar) AS lh2 FROM e GROUP BY symbol),
t AS (SELECT e.symbol, e.bar, -a2.rho AS alpha2, -a3.rho AS alpha3, -a5.r AS alpha5, CASE WHEN lo > 0 OR hi < 0 THEN dc ELSE -dc END AS alpha9, sign(dv) * -dc AS alpha12, -r3 * g.rho AS alpha14,
  round_even(-r_oh * r_oc * r_ol / 1e6, 0) AS alpha20, CASE WHEN e.bar > 20 THEN CASE WHEN mh > lh THEN -lh2 ELSE 0 END END AS alpha23
  FROM e JOIN g USING (symbol) JOIN u USING (symbol) JOIN k USING (symbol, bar) LEFT JOIN a2 USING (symbol, bar) LEFT JOIN a3 USING (symbol, bar) LEFT JOIN a5 USING (symbol, bar))
SELECT symbol, bar, {_round(_ALPHAS)} FROM t""")
def f_alphas(spark, sf_dir):
    return rounded(features.alphas(_bars(spark, sf_dir)), 4, nudge=True)


_MICRO = ["roll", "corwinschultz", "corwinschultz_sigma", "kyle", "amihud", "hasbrouck", "vpin"]


@query("f_microstructure", f"""WITH {_NB}, d AS (SELECT *, ln(c / lag(c) OVER w) AS r, c - lag(c) OVER w AS dp, power(ln(h / l), 2) AS hl, abs(vol_buy - vol_sell) AS ab, vol_buy + vol_sell AS tot FROM b WINDOW w AS {_W}),
e AS (SELECT *, lag(r) OVER {_W} AS r1 FROM d),
f AS (SELECT *, CASE WHEN count(r1 + r) OVER {_rows(10)} >= 10 THEN covar_samp(r1, r) OVER {_rows(10)} END AS cov, {_full("sum(hl)", 2, "hl")} AS beta, power(ln({_full("max(h)", 2, "h")} / {_full("min(l)", 2, "l")}), 2) AS gamma, {_full("sum(ab)", 5, "ab")} AS sab, {_full("sum(tot)", 5, "tot")} AS stot FROM e),
a AS (SELECT *, CASE WHEN beta IS NOT NULL THEN greatest(0, (sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2)))) END AS a,
  CASE WHEN beta IS NOT NULL THEN greatest(0, (1 / sqrt(2) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(gamma / (8 / pi() * (3 - 2 * sqrt(2))))) END AS corwinschultz_sigma FROM f),
t AS (SELECT symbol, bar, 2 * sqrt(abs(cov)) AS roll, 2 * (exp(a) - 1) / (1 + exp(a)) AS corwinschultz, corwinschultz_sigma, CASE WHEN dp IS NOT NULL THEN greatest(0, dp / (v * CASE WHEN dp < 0 THEN -1 ELSE 1 END)) END AS kyle, abs(r) / dollars AS amihud,
  CASE WHEN r / nullif(hasbrouck, 0) < 0 THEN 0 ELSE r / nullif(hasbrouck, 0) END AS hasbrouck, coalesce(sab / nullif(stot, 0), 0) AS vpin FROM a)
SELECT symbol, bar, {_round(_MICRO, 6)} FROM t""")
def f_micro(spark, sf_dir):
    return rounded(features.micro(_bars(spark, sf_dir)), nudge=True)


@query("f_standard", f"""WITH {_NB}, t AS (SELECT symbol, bar, (c - avg(c) OVER a) / stddev_samp(c) OVER a AS z_score, ({_RANK.format(x="c")}) / count(*) OVER a AS pct,
  CASE WHEN count(*) OVER {_rows(200)} >= 20 THEN (c - avg(c) OVER {_rows(200)}) / stddev_samp(c) OVER {_rows(200)} END AS rolling_zscore, (c - min(c) OVER a) / (max(c) OVER a - min(c) OVER a) AS minmax FROM b WINDOW a AS (PARTITION BY symbol))
SELECT symbol, bar, {_round(["z_score", "pct", "rolling_zscore", "minmax"], 6)} FROM t""")
def f_standard(spark, sf_dir):
    return rounded(features.standard(_bars(spark, sf_dir)), nudge=True)


_SUMS = ["absolute_sum_of_changes", "abs_energy", "sum_values", "variance_larger_than_standard_deviation", "variation_coefficient", "mean_second_derivative_central"]


@query("f_series_sums", f"""WITH {_NB}, p AS (SELECT i.symbol, i.bar, j.bar AS k, j.c, abs(j.c - lag(j.c) OVER (PARTITION BY i.symbol, i.bar ORDER BY j.bar)) AS d FROM b i JOIN b j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 199 AND i.bar),
t AS (SELECT symbol, bar, count(*) AS n, sum(d) AS absolute_sum_of_changes, sum(c * c) AS abs_energy, sum(c) AS sum_values, CASE WHEN var_pop(c) > stddev_pop(c) THEN 1.0 ELSE 0.0 END AS variance_larger_than_standard_deviation, stddev_pop(c) / avg(c) AS variation_coefficient,
  ((list(c ORDER BY k))[-1] - (list(c ORDER BY k))[-2] - ((list(c ORDER BY k))[2] - (list(c ORDER BY k))[1])) / (2.0 * (count(*) - 2)) AS mean_second_derivative_central FROM p GROUP BY symbol, bar)
SELECT symbol, bar, {", ".join(f"CASE WHEN n >= 20 THEN round(CAST({x} AS DOUBLE) + 1.3e-7, 4) + 0.0 END AS {x}" for x in _SUMS)} FROM t""")
def f_series_sums(spark, sf_dir):
    return rounded(features.series_sums(_bars(spark, sf_dir)), 4, nudge=True)


_ORDERS = f"""{_NB}, p AS (SELECT i.symbol, i.bar, j.bar - greatest(i.bar - 199, 1) AS k, j.c FROM b i JOIN b j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 199 AND i.bar WHERE i.bar >= 20),
q AS (SELECT *, avg(c) OVER w AS m, max(c) OVER w AS hi, min(c) OVER w AS lo, count(*) OVER w AS n, stddev_pop(c) OVER w * 0.2 AS tol FROM p WINDOW w AS (PARTITION BY symbol, bar)),
g AS (SELECT *, CASE WHEN c > m THEN 1 WHEN c < m THEN -1 ELSE 0 END AS side FROM q),
h AS (SELECT *, k - row_number() OVER (PARTITION BY symbol, bar, side ORDER BY k) AS island FROM g),
r AS (SELECT symbol, bar, side, count(*) AS len FROM h GROUP BY symbol, bar, side, island),
st AS (SELECT symbol, bar, coalesce(max(len) FILTER (side = 1), 0) AS above, coalesce(max(len) FILTER (side = -1), 0) AS below FROM r GROUP BY symbol, bar),
v AS (SELECT symbol, bar, c, count(*) AS times FROM q GROUP BY symbol, bar, c),
rv AS (SELECT symbol, bar, coalesce(sum(times) FILTER (times > 1), 0) AS again_points, count(*) FILTER (times > 1) AS again_values, count(*) AS distinct_values, coalesce(sum(c * times) FILTER (times > 1), 0) AS sum_points, coalesce(sum(c) FILTER (times > 1), 0) AS sum_values FROM v GROUP BY symbol, bar),
ld AS (SELECT symbol, bar, CAST(floor(round(c / power(10, floor(log10(c))), 10)) AS INTEGER) AS x FROM q WHERE c > 0),
dg AS (SELECT symbol, bar, CASE WHEN x >= 10 THEN 1 ELSE x END AS digit, count(*) AS times FROM ld GROUP BY ALL),
bf AS (SELECT z.symbol, z.bar, corr(log10(1 + 1.0 / d), coalesce(times, 0) / n) AS benford FROM (SELECT DISTINCT symbol, bar, n FROM q) z CROSS JOIN range(1, 10) t(d) LEFT JOIN dg ON dg.symbol = z.symbol AND dg.bar = z.bar AND dg.digit = d GROUP BY z.symbol, z.bar),
tm AS (SELECT symbol, bar, tol, n, k, c AS c0, lead(c) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM q WINDOW w AS (PARTITION BY symbol, bar ORDER BY k)),
se AS (SELECT x.symbol, x.bar, count(*) - any_value(x.n - 1) AS b, count(*) FILTER (abs(x.c2 - y.c2) <= x.tol) - any_value(x.n - 2) AS a FROM tm x JOIN tm y ON y.symbol = x.symbol AND y.bar = x.bar AND abs(x.c0 - y.c0) <= x.tol AND abs(x.c1 - y.c1) <= x.tol WHERE x.tol > 0 GROUP BY x.symbol, x.bar),
base AS (SELECT symbol, bar, any_value(n) AS n, count(*) FILTER (c > m) AS up, count(*) FILTER (c < m) AS down, min(k) FILTER (c = hi) AS top, min(k) FILTER (c = lo) AS bottom FROM q GROUP BY symbol, bar),
t AS (SELECT symbol, bar, up AS count_above_mean, down AS count_below_mean, top / n AS first_location_of_maximum, bottom / n AS first_location_of_minimum, above AS longest_strike_above_mean, below AS longest_strike_below_mean,
 again_points / n AS percentage_of_reoccurring_datapoints_to_all_datapoints, again_values / distinct_values AS percentage_of_reoccurring_values_to_all_values, sum_points AS sum_of_reoccurring_data_points, sum_values AS sum_of_reoccurring_values, benford AS benford_correlation,
 CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END AS sample_entropy FROM base JOIN st USING (symbol, bar) JOIN rv USING (symbol, bar) JOIN bf USING (symbol, bar) LEFT JOIN se USING (symbol, bar))"""


@query("f_series_orders", f"WITH {_ORDERS} SELECT b.symbol, b.bar, {', '.join(f'round(CAST({x} AS DOUBLE) + 1.3e-9, 6) + 0.0 AS {x}' for x in features.ORDER_STATS)} FROM b LEFT JOIN t USING (symbol, bar)")
def f_series_orders(spark, sf_dir):
    return rounded(features.series_orders(_bars(spark, sf_dir)), 6, nudge=True)


_STANDARD = ["z_score", "pct", "rolling_zscore", "minmax"]
_SETS = {"f_technical": _TECH, "f_alphas": _ALPHAS, "f_microstructure": [c for c in _MICRO if c != "corwinschultz_sigma"], "f_standard": _STANDARD, "f_series_sums": _SUMS, "f_series_orders": list(features.ORDER_STATS)}
#: The sets of features joined; rows with all of them.
_ASSEMBLED = (
    f"WITH {_NB} SELECT b.symbol, b.bar, round(b.c + 1.3e-7, 4) AS close_price, {', '.join(f'{c} AS feature_{c}' for c in (*_TECH, *_ALPHAS))} FROM b "
    + " ".join(f"JOIN ({ORACLE_SQL[name]}) {name} ON {name}.symbol = b.symbol AND {name}.bar = b.bar" for name in _SETS)
    + " WHERE " + " AND ".join(f"{name}.{c} IS NOT NULL" for name, columns in _SETS.items() for c in columns)
)


@query("f31_assembled_features", _ASSEMBLED)
def f31(spark, sf_dir):
    made = features.assemble(_bars(spark, sf_dir)).select("symbol", "bar", F.col("close_price"), *[f"feature_{c}" for c in (*_TECH, *_ALPHAS)])
    return rounded(made, 4, nudge=True)


@query("w2_rolling", f"WITH {_NB} SELECT symbol, bar, round({_full('avg(c)', 20, 'c')}, 6) AS mean, round({_full('stddev_samp(c)', 20, 'c')}, 6) AS std, {_full('max(c)', 20, 'c')} AS high, {_full('min(c)', 20, 'c')} AS low, round({_full('sum(c)', 20, 'c')}, 6) AS total FROM b")
def w2(spark, sf_dir):
    c = F.col("close_price")
    return rounded(_bars(spark, sf_dir).select("symbol", "bar", R.mean(c, 20).alias("mean"), R.deviation(c, 20).alias("std"), R.highest(c, 20).alias("high"), R.lowest(c, 20).alias("low"), R.total(c, 20).alias("total")))


@query("w7_ranks", f"WITH {_NB} SELECT symbol, bar, {_RANK.format(x='v')} AS rank_v, round(({_RANK.format(x='c')}) / count(*) OVER (PARTITION BY symbol), 6) AS share_c FROM b")
def w7(spark, sf_dir):
    return rounded(_bars(spark, sf_dir).select("symbol", "bar", R.all_rank(F.col("bar_cum_volume")).alias("rank_v"), R.all_rank("close_price", share=True).alias("share_c")))


@query("w9_gaussian_sum", f"WITH {_NB}, g AS (SELECT i.symbol, i.bar, count(*) AS n, sum(j.c * exp(-0.5 * power((j.bar - i.bar + 9 - 4.5) / 5, 2))) AS s FROM b i JOIN b j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 9 AND i.bar GROUP BY i.symbol, i.bar) SELECT symbol, bar, CASE WHEN n = 10 THEN round(s, 4) END AS smooth FROM g")
def w9(spark, sf_dir):
    return rounded(_bars(spark, sf_dir).select("symbol", "bar", R.gaussian_sum(F.col("close_price")).alias("smooth")), 4)


@query("w10_high_water", f"WITH {_NB} SELECT symbol, bar, max(c) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS high_water FROM b")
def w10(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "bar", F.max("close_price").over(R.by_bar().rowsBetween(Window.unboundedPreceding, 0)).alias("high_water"))


@query("w11_cumulative", f"WITH {_NB} SELECT symbol, bar, CAST(sum(v) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS volume, round(sum(ln(1 + v / 10000.0)) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) + 1.3e-9, 6) AS log_growth FROM b")
def w11(spark, sf_dir):
    own = _bars(spark, sf_dir)
    return rounded(own.select("symbol", "bar", F.sum("bar_cum_volume").over(R.by_bar().rowsBetween(Window.unboundedPreceding, 0)).alias("volume"), R.log_compound(1 + F.col("bar_cum_volume") / 10000).alias("log_growth")), nudge=True)


@query("w4_rolling_function", f"WITH {_NB}, g AS (SELECT i.symbol, i.bar, count(*) AS n, max(j.c) - min(j.c) AS spread FROM b i JOIN b j ON j.symbol = i.symbol AND j.bar BETWEEN i.bar - 199 AND i.bar GROUP BY i.symbol, i.bar) SELECT symbol, bar, CASE WHEN n >= 20 THEN round(spread, 6) END AS spread FROM g")
def w4(spark, sf_dir):
    own = _bars(spark, sf_dir).select("symbol", "bar", "close_price")
    return rounded(R.apply(own, "close_price", lambda x: x.max() - x.min(), 200, ["symbol"], ["bar"], "spread", least=20).select("symbol", "bar", "spread"))


@query("f0_autocorrelation", f"WITH {_NB}, l AS (SELECT symbol, c, lag(c) OVER w AS c1, lag(c, 3) OVER w AS c3 FROM b WINDOW w AS {_W}) SELECT symbol, round(corr(c, c1) + 1.3e-9, 6) + 0.0 AS lag1, round(corr(c, c3) + 1.3e-9, 6) + 0.0 AS lag3 FROM l GROUP BY symbol")
def f0_autocorrelation(spark, sf_dir):
    one = features.autocorrelations(_bars(spark, sf_dir), "close_price", [1, 3])
    return rounded(one, nudge=True)


@query("w12_fill", """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value > 50 THEN value END AS x FROM events)
SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM e""")
def w12(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.when(F.col("value") > 50, F.col("value"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("x", x)
    return e.select("event_id", F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("forward"), F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("backward"))
