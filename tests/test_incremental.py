"""Parallel scans equal folds; days one by one equal all at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.fold import Kernel, resume
from tickloom.operators import bars, imbalance, sampling, volatility
from tickloom.plans.incremental import DailyStages, Rules
from tickloom.sources import ticks as S
from tickloom.sources.tables import StageStore, write_ticks


@pytest.fixture(scope="module")
def series(spark):
    """A hot series, one shorter than a block and one of a single row, with nulls."""
    r = random.Random(8)
    rows = [("hot", i, None if i % 97 == 5 else r.gauss(0, 1)) for i in range(3000)] + [("few", i, r.gauss(0, 1)) for i in range(50)] + [("one", 7, 1.0), (None, 1, 2.0), (None, 2, None), (None, 1100, 5.0)]
    return spark.createDataFrame(rows, "symbol string, i long, x double").repartition(4)


def listed(df, *names):
    return sorted(((r.symbol is None, r.symbol, r.i, *(r[n] for n in names)) for r in df.collect()), key=str)


def block():
    return F.floor(F.col("i") / 256)


@pytest.mark.parametrize("h", [0.5, 2.0, 9.0])
@pytest.mark.parametrize("differences", [False, True])
def test_cusum_by_blocks(series, h, differences):
    one = sampling.cusum(series, "x", h, ["symbol"], ["i"], differences)
    assert listed(one, "event") == listed(sampling.cusum(series, "x", h, ["symbol"], ["i"], differences, block=block()), "event")
    assert one.where("event <> 0").count() > 0


def test_side_summaries_are_exact():
    r = random.Random(9)
    for _ in range(300):
        h = r.choice([1.0, 3.0, 6.0])
        side, moves = scan.open_side(), [float(r.randrange(-3, 4)) for _ in range(r.randrange(40))]
        for m in moves:
            scan.move_side(side, m, h)
        for start in [x / 2 for x in range(int(2 * h) + 1)]:
            x = start
            for m in moves:
                x = max(0.0, x + m)
                x = 0.0 if x > h else x
            assert scan.side_after(start, side) == x


def test_weighted_deviation_and_mean_by_blocks(series):
    for kind in (volatility.ewm_std_fold, volatility.ewm_mean_fold):
        one = listed(kind(series, "x", "y", 30, ["symbol"], ["i"]), "y")
        cut = listed(kind(series, "x", "y", 30, ["symbol"], ["i"], block=block()), "y")
        assert len(one) == len(cut)
        for a, b in zip(one, cut):
            assert a[:3] == b[:3] and ((a[3] is None) == (b[3] is None)) and (a[3] is None or math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-12))


def test_a_hot_series_is_many_tasks(spark, series):
    """The rows of one symbol come from several partitions, in both passes."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = series.where("symbol = 'hot'")
        dealt = sampling.cusum(hot, "x", 2.0, ["symbol"], ["i"], block=block())
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert sampling.cusum(hot, "x", 2.0, ["symbol"], ["i"]).select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_series(spark):
    none = spark.createDataFrame([], "symbol string, i long, x double")
    assert sampling.cusum(none, "x", 1.0, ["symbol"], ["i"], block=block()).count() == 0


def test_resumed_states_of_old_and_new_keys(spark):
    count = Kernel(lambda: 0, lambda n, rows: (n + len(rows), rows.assign(n=range(n + 1, n + 1 + len(rows)))), "n long")
    first = resume(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "symbol string, i long"), ["symbol"], ["i"], count)
    states = first.where("_state IS NOT NULL").select("symbol", "_state")
    assert {tuple(r) for r in states.collect()} == {("a", "2"), ("b", "1")}
    big = (1 << 62) + 1
    second = resume(spark.createDataFrame([("a", big), ("c", 1)], "symbol string, i long"), ["symbol"], ["i"], count, states).collect()
    assert {(r.symbol, r.i, r.n) for r in second if r._state is None} == {("a", big, 3), ("c", 1, 1)}
    assert {(r.symbol, r._state) for r in second if r._state is not None} == {("a", "3"), ("b", "1"), ("c", "1")}


RULES = Rules(threshold=200, cusum=0.5)


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ticks") / "ticks")
    ticks = S.event_ticks(spark, sf)
    days = [r.d for r in ticks.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:6]
    ticks = ticks.where(F.to_date("ts") <= F.lit(days[-1]))
    # A symbol that is silent on some days.
    ticks = ticks.where(~((F.col("symbol") == "click") & F.to_date("ts").isin(days[2:4])))
    write_ticks(ticks, folder)
    start = imbalance.expectations(imbalance.signed_flow(ticks)).select("symbol", "e_t", "e_flow").collect()
    return folder, ticks, [str(d) for d in days], spark.createDataFrame(start, "symbol string, e_t double, e_flow double")


def of_store(spark, name, start):
    store = StageStore(spark, name)
    store.drop()
    store.create_database()
    return DailyStages(store, RULES, start)


STAGES = ("daily_bars", "daily_volatility", "daily_imbalance")


def test_day_by_day_equals_all_at_once(spark, stored):
    folder, ticks, days, start = stored
    daily, whole = of_store(spark, "tl_daily", start), of_store(spark, "tl_whole", start)
    try:
        for day in days:
            daily.advance(folder, day)
        whole.advance(folder, days[0], days[-1])
        tables = {}
        for stage in STAGES:
            one, all_ = (sorted(map(str, s.rows(stage).collect())) for s in (daily, whole))
            assert one == all_ and one
            tables[stage] = one
        # Doing the last day again changes nothing.
        daily.advance(folder, days[-1])
        for stage in STAGES:
            assert sorted(map(str, daily.rows(stage).collect())) == tables[stage]
        # The batch operators say the same.
        made = {(r.symbol, r.date, r.bar_id) for r in bars.bars(ticks, "volume", 200).collect()}
        got = daily.rows("daily_bars").collect()
        assert {(r.symbol, r.date, r.bar_id) for r in got} == made and max(r.bar for r in got if r.symbol == "view") == sum(m[0] == "view" for m in made)
        spread = {(r.symbol, r.date): r.volatility for r in volatility.daily_open_close(ticks).collect()}
        for r in daily.rows("daily_volatility").collect():
            assert math.isclose(r.volatility or 0.0, spread[r.symbol, r.date], rel_tol=1e-6, abs_tol=1e-9)
        flows = imbalance.imbalance_bars(imbalance.signed_flow(ticks), start)
        assert {(r.symbol, r.seq, r.bar_id) for r in daily.rows("daily_imbalance").where("bar_id IS NOT NULL").collect()} == {(r.symbol, r.seq, r.bar_id) for r in flows.collect()}
    finally:
        daily.store.drop()
        whole.store.drop()


def test_a_day_reads_no_older_day(spark, stored):
    folder, _, days, start = stored
    daily = of_store(spark, "tl_pruned", start)
    try:
        daily.advance(folder, days[0], days[-2])
        for stage, df in daily.stages(folder, days[-1]).items():
            states = [f for f in df.inputFiles() if f"/{stage}/" in f]
            assert states and all(f"date={days[-2]}/part=states" in f for f in states)
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.splitlines() if "FileScan" in line]
            ticks = [x for x in scans if "_state:string" not in x]
            assert ticks and all(x.split("PartitionFilters: [")[1].split("]")[0].count(days[-1]) == 2 for x in ticks)
    finally:
        daily.store.drop()


def test_replaced_days_leave_others_alone(spark):
    store = StageStore(spark, "tl_replaced")
    store.drop()
    store.create_database()
    try:
        rows = lambda *xs: spark.createDataFrame(xs, "symbol string, x int, date string")
        store.create("bars", rows(("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 3, "2024-01-02")), partition_by=("date",))
        store.replace_days("bars", rows(("a", 5, "2024-01-02"), ("c", 6, "2024-01-03")))
        assert sorted((r.symbol, r.x) for r in store.read("bars").collect()) == [("a", 1), ("a", 5), ("c", 6)]
        store.append("bars", rows(("d", 7, "2024-01-01")))
        assert store.read("bars", ["d"]).count() == 1 and store.read("bars").count() == 4
    finally:
        store.drop()
