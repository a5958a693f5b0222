"""Functions of this library by name, for SQL users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickloom.operators.sampling import fracdiff_weights


def register(spark: SparkSession) -> None:
    """Make these known to ``spark.sql``:

    ``tl_normal_quantile(p)`` (a column function in Arrow batches),
    ``tl_spread(x)`` (an aggregate: the largest less the smallest, 0 for none) and
    ``tl_fracdiff_weights(order, size)`` (a table ``lag, weight``).
    """

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        from statistics import NormalDist

        inverse = NormalDist().inv_cdf
        return p.map(lambda x: inverse(x) if 0 < x < 1 else None)

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min()) if len(x) else 0.0

    class Weights:
        def eval(self, order: float, size: int):
            yield from enumerate(fracdiff_weights(order, size))

    spark.udf.register("tl_normal_quantile", quantile)
    spark.udf.register("tl_spread", spread)
    spark.udtf.register("tl_fracdiff_weights", F.udtf(Weights, returnType="lag: int, weight: double"))
