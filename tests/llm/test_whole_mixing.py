"""Mixing at rates beyond exp's range."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import table

from tickloom.llm import mixing


@pytest.mark.parametrize("rate", [500.5, 2000.0])
def test_large_rates_are_drawn(spark, rate):
    n = 4000
    docs = table(spark, [(i, "a") for i in range(n)], "doc_id long, source string")
    got = np.array([r.c for r in mixing.copies(docs, {"a": 1.0}, total=rate * n).select(F.col("__tl_n").alias("c")).collect()])
    assert abs(got.mean() - rate) < 5 * np.sqrt(rate / n)
    assert got.var() == pytest.approx(rate, rel=0.12)


def test_distribution_in_log_space_is_the_direct_one(spark, monkeypatch):
    docs = table(spark, [(i, "a") for i in range(10)], "doc_id long, source string")
    direct = mixing.rates(docs, {"a": 1.0}, total=4900.0).first()
    monkeypatch.setattr(mixing, "DIRECT_RATE", 400.0)
    far = mixing.rates(docs, {"a": 1.0}, total=4900.0).first()
    assert direct.least == 0 < far.least
    assert np.abs(np.array(direct.cdf[far.least :]) - far.cdf).max() < 1e-11
