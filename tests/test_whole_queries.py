"""Queries over whole tables and long series."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.queries import backtests, coverage


def test_weighted_deviation_of_a_long_series(spark, monkeypatch):
    n, beta = 50_000, 99 / 101
    rows = spark.range(1, n + 1).select(F.lit("a").alias("symbol"), F.col("id").cast("int").alias("bar"), (100 + F.sin(F.col("id") * 0.7) * 5).alias("vwap"))
    monkeypatch.setattr(coverage, "numbered_bars", lambda *_: rows)
    got = coverage.w8(spark, "").orderBy("bar").toPandas()["std"].to_numpy(dtype=float, na_value=np.nan)
    x = 100 + np.sin(np.arange(1, n + 1) * 0.7) * 5
    w = w2 = s1 = s2 = 0.0
    for i, v in enumerate(x - 100):
        w, w2, s1, s2 = w * beta + 1, w2 * beta * beta + 1, s1 * beta + v, s2 * beta + v * v
        if i:
            want = ((s2 / w - (s1 / w) ** 2) * w * w / (w * w - w2)) ** 0.5
            assert abs(got[i] - want) < 1e-3, i
    assert np.isnan(got[0])


def test_bet_sizes_of_all_events(spark, sf):
    assert backtests.m20(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
