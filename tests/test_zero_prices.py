"""Prices of 0: quotients and logarithms are those of floating point, as in the queries' SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import logarithm, quotient
from tickloom.operators import sampling, weights
from tickloom.queries.registry import ORACLE_SQL, QUERIES

T0 = dt.datetime(2024, 1, 1)


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (a == b or (a != a and b != b))


def test_quotients_and_logarithms(spark):
    values = [None, 0.0, 1.0, -2.0, math.inf, -math.inf, math.nan]
    rows = [(a, b) for a in values for b in values]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", quotient(F.col("a"), F.col("b")).alias("q"), logarithm(F.col("a")).alias("l")).collect()
    for r in got:
        want = duckdb.execute("SELECT ?::DOUBLE / ?::DOUBLE, ln(?::DOUBLE)", [r.a, r.b, r.a]).fetchone()
        assert same(r.q, want[0]) and same(r.l, want[1]), r


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Two symbols of ticks, some at one time, some at 0, enough of these to close a bar."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    rows, n = [], 0
    for symbol in ("a", "b"):
        for i in range(420):
            price = 0.0 if symbol == "a" and i in (100, 101, 250) else 0.0 if symbol == "b" and i == 399 else float((i * i * 7919) % 83 + 1) / 4
            for _ in range(9 if not price else 1 + i % 3 // 2 * 2):
                rows.append((n, T0 + dt.timedelta(minutes=11 * i), n % 5, symbol, price, f'{{"k": {180 + n * 31 % 97}}}'))
                n += 1
    made = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


NAMES = ["w1_changes", "dfd_fracdiff", "dc1_cusum_events", "dc2_cusum_differences", "dc3_sampled_on_returns", "ds2_lag_choice", "dv1_lagged_volatility", "dv3_intraday_volatility", "j6_attribution_weights", "dw2_time_decay", "f_alphas", "f_microstructure", "f31_assembled_features", "f_series_orders"]


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices_as_in_sql(spark, zeros, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r[:2])
    want = sorted(want.fetchall(), key=key)
    got = sorted((tuple(r) for r in QUERIES[name](spark, zeros).select(*[f"`{c}`" for c in names]).collect()), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(same(x, y) or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-6)) for x, y in zip(a, b)), (a, b)


def test_infinite_moves_by_blocks(spark):
    """Blocks give what one pass gives, with infinite and undefined moves."""
    moves = [0.5, 1.0, math.inf, 0.7, -math.inf, -0.4, 0.9, math.nan, 0.3, 1.5, -math.inf, math.inf, 0.2] * 8
    rows = spark.createDataFrame([("A", i, m) for i, m in enumerate(moves)], "symbol string, bar long, x double")
    whole = [r.event for r in sampling.cusum(rows, "x", 1.2, ["symbol"], ["bar"]).orderBy("bar").collect()]
    for size in (3, 7):
        cut = sampling.cusum(rows, "x", 1.2, ["symbol"], ["bar"], block=F.floor(F.col("bar") / size))
        assert [r.event for r in cut.orderBy("bar").collect()] == whole
    assert whole[2] == 1 and whole[4] == -1 and whole[7] == 1


def test_attribution_of_equal_closes(spark):
    """Events that close together are in one another's interval."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("A", 1, at(0), at(9), 1.0, 0), ("A", 2, at(1), at(5), 2.0, 1), ("A", 3, at(1), at(1), 8.0, 1), ("A", 4, at(2), at(3), 4.0, 1)]
    events = spark.createDataFrame(rows, "symbol string, bar long, close_date timestamp, barrierTime timestamp, close_price double, overlap int")
    got = {r.bar: r.weight for r in weights.attribution(events).collect()}
    raw = {1: 2.0, 2: 2.0, 3: 3.0, 4: 1.0}  # in units of ln 2
    assert got == pytest.approx({k: v / 8 for k, v in raw.items()})


def test_deviation_after_an_infinite_value(spark):
    kernel = scan.ewm_std("x", 20, "s").kernel
    import pandas as pd

    _, made = kernel.step(kernel.start(), pd.DataFrame({"x": [1.0, 2.0, math.inf, 3.0]}))
    assert made["s"].tolist()[2:] == [math.inf, math.inf] and 0 < made["s"].tolist()[1] < 1


def test_scalar_functions_of_odd_values(spark, tmp_path):
    values = [None, 0.0, -0.0, 1.0, -2.5, 100.25, 1e-9, math.inf, -math.inf, math.nan]
    made = spark.createDataFrame(list(enumerate(values)), "event_id long, value double")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["f0_scalar_functions"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["f0_scalar_functions"](spark, str(tmp_path)).collect())
    assert len(got) == len(want) == len(values)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_mean_moves_of_zero_prices(spark, zeros):
    test_zero_prices_as_in_sql(spark, zeros, "w2_mean_absolute_move")
    means = [r.mean_move for r in QUERIES["w2_mean_absolute_move"](spark, zeros).collect()]
    assert any(m == math.inf for m in means) and any(m is not None and m < math.inf for m in means)
