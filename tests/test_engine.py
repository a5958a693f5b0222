"""Features, statistics, cross-validation, learning, backtester and streams."""

import datetime as dt
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tickloom.functions.exprs import normal_cdf
from tickloom.operators import allocation, asof, backtest_stats, crossval, event_backtest, features, learning
from tickloom.queries.labelset import numbered_bars
from tickloom.queries.learning import ASSETS, FEATURES, asset_returns, learning_rows
from tickloom.sources import tables
from tickloom.sources import ticks as S
from tickloom.streaming import ticks as stream


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normal_cdf(spark):
    xs = [float(x) for x in np.linspace(-5, 5, 101)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) for r in got) < 1e-6


def test_recursive_averages_match_plain_loops(spark, sf):
    made = numbered_bars(spark, sf).where("symbol = 'click'")
    pdf = features.recursive_averages(made, slow=5, fast=4).orderBy("bar").toPandas()
    c = pdf.close_price.to_numpy()
    ema = c[:5].mean()
    for i in range(5, len(c)):
        ema += (c[i] - ema) * 2 / 6
        assert pdf.ema[i] == pytest.approx(ema)
    up, down = np.maximum(np.diff(c), 0), np.maximum(-np.diff(c), 0)
    g, d = up[:4].mean(), down[:4].mean()
    for i in range(4, len(up)):
        g, d = g + (up[i] - g) / 4, d + (down[i] - d) / 4
        assert pdf.rsi[i + 1] == pytest.approx(100 * g / (g + d))


def test_sample_entropy_by_pairs():
    x = np.random.default_rng(3).normal(size=40)
    tol = 0.2 * x.std()

    def matches(k, n):
        t = [x[i : i + k] for i in range(n)]
        return sum(np.abs(a - b).max() <= tol for a, b in itertools.permutations(t, 2))

    assert features.sample_entropy(x) == pytest.approx(-math.log(matches(3, 38) / matches(2, 39)))


def test_asof_both_ways(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("A", at(5), 1), ("A", at(10), 2), ("B", at(1), 3)], "k string, t timestamp, i long")
    right = spark.createDataFrame([("A", at(5), 1.0), ("A", at(9), 2.0)], "k string, u timestamp, v double")
    loose = {r.i: r.v for r in asof.asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()}
    strict = {r.i: r.v for r in asof.asof_backward(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert loose == {1: 1.0, 2: 2.0, 3: None}
    assert strict == {1: None, 2: 2.0, 3: None}


def test_every_row_is_tested_once_on_each_path(spark, sf):
    rows = learning_rows(spark, sf)
    tested = crossval.combinatorial_test(rows, crossval.splits(spark, 5), 5)
    n = rows.count()
    per_path = tested.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).collect()
    assert len(per_path) == 4 and all(r.n == r.d == n for r in per_path)
    split3 = crossval.splits(spark, 3)
    assert {r.split: None for r in split3.collect()}.keys() == {0, 1, 2} and split3.agg(F.max("path")).first()[0] == 1


def test_training_rows_do_not_reach_into_tests(spark, sf):
    rows = learning_rows(spark, sf)
    folds = crossval.purged_folds(rows, 4, 0.01)
    joined = folds.join(rows.select("row_id", "time", "t1"), "row_id")
    spans = joined.where("role = 'test'").groupBy("fold").agg(F.min("time").alias("a"), F.max("t1").alias("b"))
    assert joined.where("role = 'train'").join(spans, "fold").where("time <= b AND t1 > a").isEmpty()


def test_bet_sizes(spark):
    rows = spark.createDataFrame([(0.5, 1), (1.0, 1), (1.0, -1), (0.9, 1)], "p double, side int")
    got = [r.s for r in rows.select(crossval.bet_size(F.col("p"), F.col("side")).alias("s")).collect()]
    assert got[:3] == [0, 1, -1] and got[3] == pytest.approx(0.8)


def test_commissions(spark):
    got = [r[0] for r in spark.createDataFrame([(50,), (200,), (1000,)], "q int").select(event_backtest.commission(F.col("q"))).collect()]
    assert got == pytest.approx([1.3, 2.6, 8.0])


def test_block_sums_give_the_sharpe_ratio(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.1, 1, (24, 3))
    rows = [(t, f"m{m}", float(x[t, m])) for t in range(24) for m in range(3)]
    got = backtest_stats.cscv(spark.createDataFrame(rows, "t int, model string, value double"), 4).orderBy("split").collect()
    blocks = np.arange(24).reshape(4, 6)
    for r, chosen in zip(got, itertools.combinations(range(4), 2)):
        inside = x[blocks[list(chosen)].ravel()]
        ratio = inside.mean(0) / inside.std(0)
        assert r.best_model == f"m{ratio.argmax()}" and r.sharpe_in == pytest.approx(ratio.max())


def test_allocations_add_up(spark, sf):
    wide = asset_returns(spark, sf)
    for method in ("least_variance", "hierarchical"):
        w = {r.asset: r.weight for r in allocation.weights(wide, ASSETS, method).collect()}
        assert sum(w.values()) == pytest.approx(1)
    cov = np.array([[4, 1], [1, 2.0]])
    assert allocation.least_variance(cov) == pytest.approx([0.25, 0.75])


def test_oversampling_evens_out(spark, sf):
    rows = learning_rows(spark, sf)
    before = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    after = {r["label"]: r["count"] for r in learning.oversample(rows, FEATURES).groupBy("label").count().collect()}
    assert min(after.values()) > min(before.values()) and max(after.values()) == max(before.values())


def test_permutation_keeps_values(spark, sf):
    rows = learning_rows(spark, sf)
    mixed = learning.permuted(rows, ["f_ret"])
    same = lambda d: sorted(r[0] for r in d.select("f_ret").collect())
    assert same(rows) == same(mixed)
    assert rows.select("row_id", "f_ret").exceptAll(mixed.select("row_id", "f_ret")).count() > rows.count() // 2


def test_rule_model_rejects_other_values(spark):
    df = spark.createDataFrame([(2,)], "x int")
    with pytest.raises(Exception, match="a rule must give"):
        learning.rule_model(df, lambda d: d["x"]).collect()


def test_kendall_by_pairs(spark):
    a, b = [3, 1, 2, 5, 4], [1, 2, 3, 5, 5]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    s = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i in range(5) for j in range(i)]
    want = sum(u * v for u, v in s) / math.sqrt(sum(u * u for u, _ in s) * sum(v * v for _, v in s))
    assert learning.kendall(df, "a", "b").first().tau == pytest.approx(want)


def test_ticks_round_trip_by_day(spark, sf, tmp_path):
    t = S.event_ticks(spark, sf)
    tables.write_ticks(t, str(tmp_path / "ticks"))
    back = tables.read_ticks(spark, str(tmp_path / "ticks"), "2024-01-03", "2024-01-05")
    want = S.between_days(t, "2024-01-03", "2024-01-05")
    assert back.select(*want.columns).exceptAll(want).isEmpty() and back.count() == want.count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_dataset_pipeline_through_tables(spark, sf):
    from tickloom.plans.dataset import Settings, dataset

    store = tables.StageStore(spark, "tickloom_test")
    store.drop()
    store.create_database()
    try:
        out = dataset(S.event_ticks(spark, sf), Settings(bars_a_day=3), store)
        assert out.count() > 0 and {"barrierLabel", "weightTime", "sadf", "feature_ema"} <= set(out.columns)
        assert store.tables() == sorted(["tuning", "bars", "sampled", "labelled", "weighted", "features"])
        with pytest.raises(Exception, match="already exists"):
            store.create("bars", out)
    finally:
        store.drop()


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(src))
    from tickloom.operators.bars import time_bars

    live = stream.time_bars(stream.stream_ticks(spark, str(src)), "6 hours", late="40 days")
    q = live.writeStream.format("memory").queryName("streamed_bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.start): (r.n_ticks, r.close_price, r.volume) for r in spark.table("streamed_bars").collect()}
    want = {(r.symbol, r.start): (r.n_ticks, r.close_price, r.volume) for r in time_bars(S.event_ticks(spark, sf), "6 hours").collect()}
    assert got == want


def test_stop_and_limit_orders(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(hours=s)
    t = spark.createDataFrame([("A", at(h), h, float(p), 1) for h, p in enumerate([10, 12, 9, 13, 8])], "symbol string, ts timestamp, seq long, price double, vol long")
    orders = spark.createDataFrame([(1, "A", at(0), "STP", 1, 12.5, at(4)), (2, "A", at(0), "LMT", 1, 9.0, at(4)), (3, "A", at(0), "STP", -1, 8.5, at(3)), (4, "A", at(0), "LMT", -1, 12.0, at(4))], "order_id long, symbol string, placed timestamp, kind string, side int, target double, expires timestamp")
    assert {r.order_id: r.price for r in event_backtest.pending_fills(orders, t).collect()} == {1: 13.0, 2: 9.0, 4: 12.0}


def test_swarm_finds_the_minimum():
    best, value = backtest_stats.swarm(lambda p: float(((p - 1) ** 2).sum()), 2, -5, 5, particles=20, rounds=200, inertia=0.5)
    assert value < 0.2 and np.abs(best - 1).max() < 0.5


def test_normal_quantile_and_choices(spark):
    from statistics import NormalDist

    from tickloom.functions.exprs import chosen, mapped, normal_quantile, softmax

    ps = [i / 500 for i in range(1, 500)]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in got[:-3]) < 1e-7 and all(r.z is None for r in got[-3:])
    row = spark.range(1).select(chosen(F.lit(16), F.lit(8)).alias("c"), chosen(F.lit(3), F.lit(5)).alias("z"), mapped(F.lit("b"), {"a": 1, "b": 2}).alias("m"), softmax(F.array(F.lit(800.0), F.lit(800.0))).alias("s")).first()
    assert (row.c, row.z, row.m, row.s) == (12870.0, 0.0, 2, [0.5, 0.5]) and crossval.ways(16, 8) == 12870


@pytest.mark.parametrize("trend, lags", [("nc", 0), ("c", 1), ("ct", 2), ("ctt", 1)])
def test_lagged_sadf_by_least_squares(spark, trend, lags):
    from tickloom.operators import sampling

    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=40)) * 0.05 + 3
    rows = spark.createDataFrame([("A", i, float(math.exp(v))) for i, v in enumerate(y)], "symbol string, bar int, p double")
    got = [r.sadf for r in sampling.sadf(rows, "p", ["symbol"], ["bar"], least=12, lags=lags, trend=trend).orderBy("bar").collect()]
    k = 1 + lags + sampling.TRENDS[trend]
    for t in (11, 20, 39):
        best = -math.inf
        for start in range(0, t + 1 - 12 + 1):
            part = y[start : t + 1]
            moves = np.diff(part)
            at = range(lags, len(moves))
            x = np.array([[part[i], *(moves[i - j] for j in range(1, lags + 1)), *(float(i) ** p for p in range(sampling.TRENDS[trend]))] for i in at])
            d = moves[lags:]
            if len(d) <= k:
                continue
            beta, *_ = np.linalg.lstsq(x, d, rcond=None)
            rss = float(((d - x @ beta) ** 2).sum())
            best = max(best, beta[0] / math.sqrt(rss / (len(d) - k) * np.linalg.inv(x.T @ x)[0, 0]))
        assert got[t] == pytest.approx(best, rel=1e-4), t
    assert got[5] is None
    bounded = sampling.sadf(rows, "p", ["symbol"], ["bar"], least=12, lags=lags, trend=trend, longest=25).where("bar = 39").first().sadf
    assert bounded <= got[39] + 1e-6


def test_lags_by_information(spark):
    from tickloom.operators import sampling

    rng = np.random.default_rng(5)
    moves = [0.0]
    for e in rng.normal(size=400):
        moves.append(0.7 * moves[-1] + e)
    steps = {"auto": np.cumsum(moves) * 0.01 + 5, "plain": np.cumsum(rng.normal(size=400)) * 0.01 + 5, "short": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(s, i, float(math.exp(v))) for s, y in steps.items() for i, v in enumerate(y)], "symbol string, bar int, p double")
    assert {r.symbol: r.lags for r in sampling.lag_choice(rows, "p", ["symbol"], ["bar"]).collect()} == {"auto": 1, "plain": 0, "short": 0}


def test_baskets_of_one_asset_and_ruin(spark):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i)
    wide = spark.createDataFrame([(at(i), float(p), 1.0) for i, p in enumerate([10, 11, 12, 6])], "t timestamp, a double, b double")
    got = [r.value for r in allocation.basket(wide, "t", ["a"], {"a": 1.0}, 10.0).orderBy("t").collect()]
    assert got == pytest.approx([10, 11, 12, 6])
    ruin = [r.value for r in allocation.basket(wide, "t", ["a", "b"], {"a": -30.0, "b": 1.0}, 10.0).orderBy("t").collect()]
    assert ruin[0] == 10 and ruin[1] > 0 and allocation.basket(wide, "t", ["a"], {"a": 30.0}).count() == 4


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(float(x % 97), x) for x in range(1000)] + [(None, 5)], "a double, b long")
    got = [(r.a, r.b) for r in crossval.number_rows(rows, "a", "b", parts=7).orderBy("row_id").collect()]
    assert got == [(None, 5), *sorted((float(x % 97), x) for x in range(1000))]
    numbers = [r.row_id for r in crossval.number_rows(rows, "a", "b", parts=7).select("row_id").orderBy("row_id").collect()]
    assert numbers == list(range(1001)) and crossval.number_rows(rows.limit(0), "a").count() == 0


def test_selection_keeps_rows_and_writes_parts(spark, sf):
    from tickloom.operators import selection

    rows = learning_rows(spark, sf)
    store = tables.StageStore(spark, "tl_selection")
    store.create_database()
    try:
        found = selection.select_features(rows, FEATURES[:3], 0.5, samples=1, store=store)
        assert set(found.features) <= set(FEATURES[:3]) and len(found.scored) == 2
        assert sum(p.count() for p in found.parts.values()) == rows.count() and {"exogenous", "endogenous", "backtest"} <= set(store.tables())
        fitted = selection.fan_out({"small": (learning.forest(2, 2), {"maxDepth": [1]}), "large": (learning.forest(3), {"maxDepth": [2]})}, found.parts["endogenous"], found.features, crossval.purged_folds(crossval.number_rows(found.parts["endogenous"].drop("row_id"), "time", "symbol"), 2), "accuracy")
        assert {f.name for f in fitted} == {"small", "large"} and fitted[0].score >= fitted[1].score
        out = selection.backtests(fitted, found.parts["backtest"], found.features, store)
        assert out.count() == 2 * found.parts["backtest"].count() and out.where("predicted NOT IN (-1, 0, 1)").isEmpty()
    finally:
        store.drop()
    assert selection.low_silhouettes(rows, FEATURES, dict.fromkeys(FEATURES, 0) | {FEATURES[0]: 1}, 1.0) == FEATURES


def test_training_ranges_equal_a_check_of_every_pair(spark):
    """Short, long and odd labels, equal times, an empty table."""
    import datetime as dt
    import itertools
    import random

    r, day = random.Random(6), dt.timedelta(days=1)
    times = sorted(dt.datetime(2024, 1, 1) + day * r.randrange(60) for _ in range(120))
    rows = [(i, t, t + day * r.choice([0, 1, 1, 2, 9])) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "row_id long, time timestamp, t1 timestamp")
    for pieces, k, embargo in ((6, 2, 2), (5, 3, 0), (3, 1, 20)):
        got = {(x.split, x.row_id) for x in crossval.combinatorial_train(df, crossval.splits(spark, pieces, k), pieces, embargo).collect()}
        size, extra = divmod(len(rows), pieces)
        piece = [min(i // (size + 1), extra) if i < extra * (size + 1) else extra + (i - extra * (size + 1)) // size for i in range(len(rows))]
        span = {p: (min(t for i, t, _ in rows if piece[i] == p), max(t for i, t, _ in rows if piece[i] == p)) for p in range(pieces)}
        want = {
            (s, i) for s, tested in enumerate(itertools.combinations(range(pieces), k)) for i, t, t1 in rows
            if all(piece[i] != p and (t1 < span[p][0] or t > span[p][1] + day * embargo) for p in tested)
        }
        assert got == want
    assert crossval.combinatorial_train(df.limit(0), crossval.splits(spark, 3), 3).count() == 0


def test_sliding_statistics_equal_window_by_window():
    from tickloom.functions import sliding

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(5, 2, 700), 1)
    got = sliding.order_statistics(x, 50)
    for i in (0, 3, 300, 650):
        w = x[i : i + 50]
        above, values, counts = w > w.mean(), *np.unique(w, return_counts=True)
        runs = max(len(s) for s in "".join("x" if a else " " for a in above).split(" "))
        again = counts > 1
        assert got[i, 0] == above.sum() and got[i, 2] == w.argmax() / 50 and got[i, 4] == runs
        assert got[i, 6:10] == pytest.approx([counts[again].sum() / 50, again.sum() / len(values), (values * counts)[again].sum(), values[again].sum()])
        assert got[i, 11] == pytest.approx(sliding._entropy(w, 0.2 * w.std(), 2), nan_ok=True)
    y = rng.integers(0, 4, 700).astype(float)
    x[10], y[40] = np.nan, np.nan
    rho = sliding.spearman(x, y, 20)
    for i in (0, 5, 30, 100, 600):
        a, b = pd.Series(x[i : i + 20]), pd.Series(y[i : i + 20])
        good = a.notna() & b.notna()
        assert rho[i] == pytest.approx(np.corrcoef(a[good].rank(), b[good].rank())[0, 1], nan_ok=True)
    assert np.isnan(sliding.spearman(np.ones(9), np.arange(9.0), 5)).all() and not len(sliding.spearman(x[:3], y[:3], 5))


def test_nearest_session_however_far(spark):
    days = lambda *ds: spark.createDataFrame([(d,) for d in ds], "day string").select(F.col("day").cast("date"))
    sessions = days("2024-01-05", "2024-01-09", "2024-03-01").withColumnRenamed("day", "date")
    got = S.nearest_sessions(days("2023-01-01", "2024-01-05", "2024-01-07", "2024-01-08", "2024-02-15", "2030-01-01", "2024-01-07"), sessions).collect()
    assert {str(r.day): str(r.session) for r in got} == {
        "2023-01-01": "2024-01-05", "2024-01-05": "2024-01-05", "2024-01-07": "2024-01-05", "2024-01-08": "2024-01-09", "2024-02-15": "2024-03-01", "2030-01-01": "2024-03-01"}
    assert S.nearest_sessions(days("2024-01-05"), sessions.limit(0)).first().session is None


def test_traded_basket_by_the_recursion(spark):
    """The recursion written out, with any block size; a move that turns the capital negative."""
    import pandas as pd

    rng = np.random.default_rng(12)
    n, names = 60, ["a", "b", "c"]
    closes = 50 * np.exp(np.cumsum(rng.normal(0, 0.2, (n, 3)), axis=0))
    opens = closes * np.exp(rng.normal(0, 0.2, (n, 3)))
    times = pd.date_range("2024-01-01", periods=n, freq="h")
    rows = [(t.to_pydatetime(), *map(float, o), *map(float, c)) for t, o, c in zip(times, opens, closes)]
    df = spark.createDataFrame(rows, "at timestamp, open_a double, open_b double, open_c double, close_a double, close_b double, close_c double").repartition(3)
    returns, money, held, want = closes[1:] / closes[:-1] - 1, 10_000.0, None, []
    for t in range(8, n - 1):
        w = allocation.least_variance(np.cov(returns[: t - 1].T))
        point = opens[t + 1] / 100
        if held is not None:
            money += float(np.sum(held * point * (closes[t] - opens[t])))
        held = w * money / (opens[t + 1] * point * np.abs(w).sum())
        want.append((money, float(held @ opens[t]), *held))
    for block in (7, 1024):
        got = allocation.traded_basket(df, "at", names, first=8, block=block).orderBy("at").collect()
        assert np.allclose([(r.capital, r.value, *r.holdings) for r in got], want, rtol=1e-8)
    assert allocation.traded_basket(df.limit(0), "at", names).count() == 0


def test_near_rows_are_nearest_and_new_rows_lie_between(spark):
    import pandas as pd

    rng = np.random.default_rng(21)
    x = rng.normal(size=(1500, 4)) * [1, 10, 0.1, 1]
    x[100:140] = x[100]  # repeated rows
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1500), **{f"f{j}": x[:, j] for j in range(4)}})).repartition(3)
    names = [f"f{j}" for j in range(4)]
    got = {r.row_id: r.near for r in learning.near_rows(df, names).collect()}
    z = (x - x.mean(0)) / x.std(0)
    found = total = 0
    for i in range(0, 1500, 10):
        if 100 <= i < 140:
            continue
        want = np.argsort(((z - z[i]) ** 2).sum(1))[1:6]
        found += len(set(want.tolist()) & set(got[i]))
        total += 5
    assert found / total >= 0.9 and all(len(n) == 5 and i not in n for i, n in got.items())
    some = df.withColumn("label", (F.col("row_id") < 300).cast("int")).withColumn("w", F.lit(1.0))
    made = learning.oversample(some, names).where("row_id NOT BETWEEN 0 AND 1499")
    assert abs(made.count() - 900) < 60
    few = x[:300]
    for r in made.limit(20).collect():
        # On the line between two of the class.
        p = np.array([r[c] for c in names])
        a, b = few[:, None, :], few[None, :, :]
        t = ((p - a) * (b - a)).sum(2) / np.maximum(((b - a) ** 2).sum(2), 1e-12)
        assert np.abs(a + np.clip(t, 0, 1)[:, :, None] * (b - a) - p).max(2).min() < 1e-6


def test_bags_and_votes(spark, sf):
    rows = learning_rows(spark, sf)
    drawn = learning.bag_draws(rows, 20)
    assert abs(drawn.agg(F.sum("draws")).first()[0] / (20 * rows.count()) - 1) < 0.05
    models = learning.bagging(rows, FEATURES, learning.forest(2, 2), bags=3)
    out = learning.voted(models, rows, FEATURES)
    assert len(models) == 3 and out.count() == rows.count() and {"probability", "prediction", *rows.columns} == set(out.columns)
    assert out.where("abs(aggregate(probability, 0D, (s, x) -> s + x) - 1) > 1e-9 OR probability[int(prediction)] < array_max(probability)").isEmpty()
    f1 = out.agg(learning.weighted_f1()(out).alias("s")).first().s
    pairs = [(int(r.label), int(r.prediction), r.w) for r in out.select("label", "prediction", "w").collect()]
    each = []
    for k in range(3):
        there, called = sum(w for y, _, w in pairs if y == k), sum(w for _, p, w in pairs if p == k)
        each.append(there * (2 * sum(w for y, p, w in pairs if y == p == k) / (there + called) if there + called else 0))
    assert f1 == pytest.approx(sum(each) / sum(w for *_, w in pairs))


def test_bags_hash_a_row_twice_at_most(spark):
    """Once to drop the rows that are not in a bag, once to count the draws; not for each of the draws."""
    rows = learning.bag_draws(spark.range(400).withColumnRenamed("id", "row_id"), 3, 7)
    assert 1 <= rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(learning.MOST_DRAWS)])
    u = lambda i, b: int(hashlib.md5(f"7|{i}|{b}".encode()).hexdigest()[:8], 16) / 2**32
    want = {(i, b): n for i in range(400) for b in range(3) if (n := int((u(i, b) >= shares).sum()))}
    assert {(r.row_id, r.bag): r.draws for r in rows.collect()} == want


def test_permutation_importance_orders_a_fold_once(spark, sf, monkeypatch):
    """The losses of one score for each unit, from two orders of a fold's test rows however many units there are."""
    rows = learning_rows(spark, sf).persist()
    folds = crossval.purged_folds(rows, 2, 0.01).persist()
    units, model = {"one": ["f_ret"], "two": ["f_vwap"], "both": ["f_ret", "f_vwap"]}, learning.forest(3, 3)
    want: dict[str, list[float]] = {u: [] for u in units}
    for train, test in learning.fold_sets(learning.assembled(rows, FEATURES), folds):
        fitted = model.fit(train)

        def score(d, fitted=fitted):
            p = fitted.transform(d)
            return p.agg(learning.accuracy(p).alias("s")).first().s

        base = score(test)
        for u, members in units.items():
            s = score(learning.assembled(learning.permuted(test.drop("features"), members, 5), FEATURES))
            want[u].append((base - s) / (1 - s) if s != 1 else 0.0)
    ordered, number_rows = [], learning.number_rows
    monkeypatch.setattr(learning, "number_rows", lambda *a, **k: ordered.append(1) or number_rows(*a, **k))
    got = learning.mean_decrease_accuracy(rows, FEATURES, folds, model, "accuracy", units, 5).collect()
    assert len(ordered) == 4
    assert {r.feature: r.mean for r in got} == pytest.approx({u: float(np.mean(v)) for u, v in want.items()})
    assert {r.feature: r.error for r in got} == pytest.approx({u: float(np.std(v)) / 2**0.5 for u, v in want.items()})
