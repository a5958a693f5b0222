"""Bars on hand-made ticks, and their invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, imbalance, labels, sampling, volatility, weights
from tickloom.sources import ticks as S

T0 = dt.datetime(2024, 1, 2, 10)


def ticks(spark, prices, vols=None, gap=60, symbol="A"):
    vols = vols or [1] * len(prices)
    rows = [(symbol, T0 + dt.timedelta(seconds=gap * i), i, float(p), int(v)) for i, (p, v) in enumerate(zip(prices, vols))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, vol long")


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_tick_rule(spark):
    assert column(bars.with_tick_rule(ticks(spark, [10, 10, 11, 11, 10])), "rule") == [1, 1, 1, 1, -1]


def test_volume_bars_close_on_the_threshold(spark):
    t = bars.with_tick_rule(ticks(spark, [1] * 5, [4] * 5))
    assert column(bars.assign(t, "volume", 10), "bar_id") == [0, 0, 1, 1, 2]


def test_half_even_threshold(spark):
    df = spark.createDataFrame([(25.0,), (35.0,), (3.0,)], "k double")
    assert [r[0] for r in df.select(bars.rounded_threshold(F.col("k"))).collect()] == [20, 40, 1]


def test_proto_features(spark):
    row = bars.aggregate(bars.assign(bars.with_tick_rule(ticks(spark, [10, 11, 10], [1, 2, 3])), "tick", 10)).first()
    assert (row.feat_buyInitTotal, row.feat_sellInitTotal, row.feat_signVolSide, row.feat_accumulativeVolBuyInit, row.feat_accumulativeVolSellInit) == (1, 1, -1, 2, 3)
    assert row.feat_accumulativeDollarValue == 62
    assert row.feat_hasbrouckSign == pytest.approx(math.sqrt(22) - math.sqrt(30))


def test_vwap_of_no_volume_is_zero(spark):
    assert bars.bars(ticks(spark, [5], [0]), "tick", 10).first().vwap == 0


@pytest.mark.parametrize("kind", ["tick", "volume", "dollar"])
def test_bars_keep_every_tick(spark, sf, kind):
    t = S.event_ticks(spark, sf)
    made = bars.bars(t, kind, 300)
    total = t.agg(F.sum("vol").alias("v"), F.count("*").alias("n")).first()
    got = made.agg(F.sum("bar_cum_volume").alias("v"), F.sum("n_ticks").alias("n")).first()
    assert (got.v, got.n) == (total.v, total.n)
    assert made.where("low_price > open_price OR low_price > close_price OR high_price < open_price OR high_price < close_price OR open_date > close_date").isEmpty()


def test_bars_shuffle_once(spark, sf):
    plan = bars.bars(S.event_ticks(spark, sf), "volume", 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_empty_ticks(spark):
    none = ticks(spark, [1]).where("price < 0")
    assert bars.bars(none, "volume", 10).isEmpty()
    assert bars.calibrate(none).isEmpty()


def barred(spark, upper, lower, prices, gap=60):
    t = ticks(spark, prices, gap=gap)
    rows = [("A", 1, T0 - dt.timedelta(seconds=1), T0 + dt.timedelta(days=1), upper, lower)]
    b = spark.createDataFrame(rows, "symbol string, bar long, close_date timestamp, horizon timestamp, upper_barrier double, lower_barrier double")
    return labels.triple_barrier(b, t).first()


def test_triple_barrier(spark):
    up = barred(spark, 11.0, 9.0, [10, 11, 11.5, 8])
    assert (up.barrierPrice, up.barrierLabel) == (11.5, 1)
    none = barred(spark, 11.0, 9.0, [10, 10.5])
    assert (none.barrierPrice, none.barrierLabel, none.barrierTime) == (10.5, 0, T0 + dt.timedelta(days=1))


def test_triple_barrier_without_ticks(spark):
    rows = [("A", 1, T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=4), 11.0, 9.0)]
    b = spark.createDataFrame(rows, "symbol string, bar long, close_date timestamp, horizon timestamp, upper_barrier double, lower_barrier double")
    got = labels.triple_barrier(b, ticks(spark, [10])).first()
    assert (got.barrierPrice, got.barrierLabel, got.barrierTime) == (0.0, 0, rows[0][3])


def test_triple_barrier_plan_has_no_nested_loop(spark, sf):
    t = S.event_ticks(spark, sf)
    made = bars.bars(t, "volume", 500).withColumn("bar", F.monotonically_increasing_id())
    met = labels.triple_barrier(volatility.with_barriers(made, volatility.daily_open_close(t)), t)
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def events(spark, closes, ends, prices=None):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    prices = prices or [1.0] * len(closes)
    rows = [("A", i, at(c), at(e), float(p)) for i, (c, e, p) in enumerate(zip(closes, ends, prices))]
    return spark.createDataFrame(rows, "symbol string, bar long, close_date timestamp, barrierTime timestamp, close_price double")


def test_overlap(spark):
    assert column(weights.overlap(events(spark, [0, 10, 20], [15, 12, 25])), "overlap", "bar") == [0, 1, 0]


def test_time_decay(spark):
    e = events(spark, [0, 1, 2, 3], [1, 2, 3, 4]).withColumn("weight", F.lit(0.25))
    assert column(weights.time_decay(e, 0.5), "weightTime", "bar") == pytest.approx([0.625, 0.75, 0.875, 1])
    assert min(column(weights.time_decay(e, -0.5), "weightTime", "bar")) == 0


def test_weights_add_up(spark, sf):
    from tickloom.queries.labelset import weighted

    for row in weighted(spark, sf).groupBy("symbol").agg(F.sum("weight").alias("w")).collect():
        assert row.w == pytest.approx(1) or row.w == 0


def test_cusum(spark):
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate([0, 2, 2, -5, -1])], "symbol string, i long, x double")
    found = sampling.cusum(df, "x", 3.0, ["symbol"], ["i"])
    assert [(r.i, r.event) for r in found.where("event <> 0").orderBy("i").collect()] == [(2, 1), (3, -1)]


def test_fracdiff_weights():
    assert sampling.fracdiff_weights(0.4, 4) == pytest.approx([1, -0.4, -0.12, -0.064])


def test_redundancy():
    assert imbalance.redundancy("01" * 4) == 0
    assert imbalance.redundancy("1" * 64) > imbalance.redundancy("0110100110010110" * 4) > 0


def test_imbalance_bars_match_a_plain_loop(spark, sf):
    t = S.event_ticks(spark, sf).where("symbol = 'click'")
    flows = imbalance.signed_flow(t)
    start = imbalance.expectations(flows)
    got = {r.seq: r.bar_id for r in imbalance.imbalance_bars(flows, start).collect()}
    s = start.first()
    e_t, e_flow, theta, n, bar, want = s.e_t, s.e_flow, 0.0, 0, 0, {}
    for r in flows.where("flow IS NOT NULL").orderBy("ts", "seq").collect():
        want[r.seq] = bar
        theta, n = theta + r.flow, n + 1
        if abs(theta) >= abs(e_t * e_flow):
            e_t, e_flow, theta, n, bar = 0.9 * e_t + 0.1 * n, 0.9 * e_flow + 0.1 * theta / n, 0.0, 0, bar + 1
    assert got == want


def test_ewm_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    x = np.random.default_rng(0).normal(size=300)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, i long, x double")
    want = pd.Series(x).ewm(span=20).std().to_numpy()
    native = df.withColumn("s", volatility.ewm_std(F.col("x"), 20, ["symbol"], ["i"])).orderBy("i").toPandas().s.to_numpy(float)
    folded = volatility.ewm_std_fold(df, "x", "s", 20, ["symbol"], ["i"]).orderBy("i").toPandas().s.to_numpy(float)
    np.testing.assert_allclose(native[1:], want[1:], rtol=1e-8)
    np.testing.assert_allclose(folded[1:], want[1:], rtol=1e-8)


def test_sadf_matches_least_squares(spark):
    import numpy as np

    p = np.exp(np.cumsum(np.random.default_rng(1).normal(size=40)) / 10)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(p)], "symbol string, i long, p double")
    got = sampling.sadf(df, "p", ["symbol"], ["i"]).orderBy("i").toPandas().sadf.to_numpy(float)
    y = np.log(p)
    for end in (5, 20, 39):
        best = -np.inf
        for start in range(0, end - 4):
            x, d = y[start:end], np.diff(y[start : end + 1])
            b = x @ d / (x @ x)
            best = max(best, b / math.sqrt(((d - b * x) ** 2).sum() / (len(x) - 1) / (x @ x)))
        assert got[end] == pytest.approx(best)


def test_one_long_series_is_many_tiles(spark):
    """Tiles of any size give what one tile gives, and a series is several groups."""
    rng = np.random.default_rng(3)
    prices = [("a", i, float(np.exp(x))) for i, x in enumerate(np.cumsum(rng.normal(0, 0.02, 300)))] + [("b", i, 2.0 + i % 5) for i in range(9)] + [(None, i, 1.0 + i) for i in range(30)]
    df = spark.createDataFrame(prices, "symbol string, i long, p double").repartition(3)
    read = lambda **k: sorted(((r.symbol is None, r.symbol, r.i, None if r.sadf is None else round(r.sadf, 9)) for r in sampling.sadf(df, "p", ["symbol"], ["i"], **k).collect()), key=str)
    for k in ({}, {"lags": 1, "trend": "c"}, {"longest": 40}):
        one = read(**k)
        assert len(one) == len(prices) and one == read(tile=32, **k) == read(tile=7, **k)
        assert sum(x[3] is not None for x in one) > 250


def test_longest_earlier_matches_by_trying_all():
    import random

    def longest(m, i, w):
        return max((next((k for k in range(min(w, len(m) - i)) if m[s + k] != m[i + k]), min(w, len(m) - i)) for s in range(max(0, i - w), i)), default=0)

    r = random.Random(1)
    for t in range(200):
        m = "01" * 15 if t == 0 else "0" * 30 if t == 1 else "".join(r.choice("01" if t % 3 else "012") for _ in range(r.randrange(1, 50)))
        assert imbalance.earlier_matches(m).tolist() == [longest(m, i, len(m)) for i in range(len(m))]
        w = r.randrange(1, 12)
        assert imbalance.window_matches(m, w).tolist() == [longest(m, i, w) for i in range(len(m))]
        n, half = len(m), range(1, len(m) // 2 + 1)
        if n >= 10:
            terms = [math.log2(i + 1) / (min(longest(m, i, i), i) + 1) for i in half]
            assert imbalance.redundancy(m) == pytest.approx(1 - sum(terms) / len(terms) / math.log2(n))


def test_first_beyond_against_a_plain_search():
    from tickloom.operators.crossing import first_beyond

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 333):
        x = rng.integers(0, 50, n).astype(float)
        start = rng.integers(0, n + 1, 200)
        above, below = rng.choice([np.nan, 10, 48, 60], 200), rng.choice([np.nan, 2, -1], 200)
        got = first_beyond(x, start, above, below)
        want = [next((i for i in range(s, n) if x[i] > a or x[i] < b), -1) for s, a, b in zip(start, above, below)]
        assert got.tolist() == want


def test_crossings_over_parts_and_days(spark):
    """Parts of three ticks, ties in time, several days: as by looking at every tick, and no join of spans with all ticks of a day."""
    from tickloom.operators.crossing import first_crossings

    rng = np.random.default_rng(5)
    rows = [(str(i % 2), T0 + dt.timedelta(minutes=int(m)), i, float(p), 1) for i, (m, p) in enumerate(zip(rng.integers(0, 4000, 300), rng.integers(0, 100, 300)))]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, vol long")
    spans = [(i, str(i % 2), T0 + dt.timedelta(minutes=int(a)), T0 + dt.timedelta(minutes=int(a + w)), float(u), float(d)) for i, (a, w, u, d) in enumerate(zip(rng.integers(-50, 4000, 150), rng.integers(0, 2000, 150), rng.integers(60, 101, 150), rng.integers(-1, 20, 150)))]
    asked = spark.createDataFrame(spans, "id long, symbol string, _after timestamp, _before timestamp, _above double, _below double")
    for touch in (False, True):
        got = {r.id: (r.hit and (r.hit.ts, r.hit.seq, r.hit.price), r.side, r.last and r.last.seq) for r in first_crossings(asked, t, ["id"], touch, part=3).collect()}
        for i, s, a, b, u, d in spans:
            inside = sorted((x[1], x[2], x[3]) for x in rows if x[0] == s and a < x[1] < b)
            side = lambda p: 1 if p > u or (touch and p == u) else -1 if p < d or (touch and p == d) else 0  # noqa: E731, B023
            hit = next((x for x in inside if side(x[2])), None)
            assert got.get(i, (None, None, None)) == (hit, side(hit[2]) if hit else None, inside[-1][1] if inside else None)


def test_one_regressor_at_a_time_or_all():
    """The short form for one regressor gives what the general one gives, also with infinite sums."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 2))
    for spoilt in (False, True):
        if spoilt:
            v[120, 0] = np.inf
        with np.errstate(all="ignore"):
            sums = np.concatenate([np.zeros((1, 4)), np.cumsum((v[:, :, None] * v[:, None, :]).reshape(-1, 4), axis=0)])
            for i in (60, 121, 200, 300):
                rows = i - np.arange(i - 2)
                want = sampling._best_ratios(sums[i], sums[: i - 2], rows, 1)
                assert sampling._best_single(sums[i], np.ascontiguousarray(sums[: i - 2].T), rows) == pytest.approx(want, rel=1e-12, nan_ok=True)
