"""Rolling expressions over rows of a symbol's bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.functions.fold import fold


def by_bar() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar")


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def rows(n: int, back: int = 0) -> WindowSpec:
    """The last ``n`` rows, ending ``back`` rows before the current one."""
    return by_bar().rowsBetween(-(n - 1) - back, -back)


def full(agg: Column, n: int, counted: Column, back: int = 0, least: int | None = None) -> Column:
    """An aggregate over ``n`` rows, null until ``least`` (default ``n``) values are there."""
    w = rows(n, back)
    return F.when(F.count(counted).over(w) >= (least or n), agg.over(w))


def mean(x: Column, n: int, **k) -> Column:
    return full(F.avg(x), n, x, **k)


def total(x: Column, n: int, **k) -> Column:
    return full(F.sum(x), n, x, **k)


def highest(x: Column, n: int, **k) -> Column:
    return full(F.max(x), n, x, **k)


def lowest(x: Column, n: int, **k) -> Column:
    return full(F.min(x), n, x, **k)


def deviation(x: Column, n: int, **k) -> Column:
    return full(F.stddev_samp(x), n, x, **k)


def covariance(x: Column, y: Column, n: int) -> Column:
    return full(F.covar_samp(x, y), n, x + y)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_bar())


def change(x: Column | str, n: int = 1) -> Column:
    return (F.col(x) if isinstance(x, str) else x) - lag(x, n)


def gaussian_sum(x: Column, n: int = 10, std: float = 5.0) -> Column:
    """Rolling sum with a Gaussian window centred on the frame."""
    import math

    weights = [math.exp(-0.5 * ((k - (n - 1) / 2) / std) ** 2) for k in range(n)]
    out = sum((F.lag(x, n - 1 - k).over(by_bar()) * w for k, w in enumerate(weights)), F.lit(0.0))
    return F.when(F.count(x).over(rows(n)) >= n, out)


def log_compound(x: Column) -> Column:
    """The logarithm of the running product of positive factors; it does not overflow."""
    return F.sum(F.log(x)).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))


def compound(x: Column) -> Column:
    """Running product of positive factors, by logarithms."""
    return F.exp(log_compound(x))


def apply(df: DataFrame, value: str, function: Callable[[np.ndarray], float], n: int, keys: Sequence[str], order: Sequence[str], out: str = "applied", least: int | None = None) -> DataFrame:
    """``df`` with ``out``: any function of the last ``n`` values, null below ``least``.

    Series are streamed; only the last ``n - 1`` values are carried over batches.
    Rows without a value count as NaN.
    """

    def step(state: np.ndarray, rows: pd.DataFrame):
        both = np.r_[state, rows[value].to_numpy(dtype=float, na_value=np.nan)]
        first = len(state)
        got = [function(both[max(0, i + 1 - n) : i + 1]) if min(i + 1, n) >= (least or n) else np.nan for i in range(first, len(both))]
        return both[max(0, len(both) - n + 1) :] if n > 1 else both[:0], rows.assign(**{out: pd.array(got, "Float64")})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` double"])
    return fold(df, keys, order, lambda: np.zeros(0), step, schema)


def all_rank(x: Column | str, share: bool = False) -> Column:
    """Rank in the whole series with ties averaged, or its share; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy("symbol", x.isNull()).orderBy(x)
    rank = F.rank().over(w) + (F.count(x).over(w.rangeBetween(0, 0)) - 1) / 2.0
    return F.when(x.isNotNull(), ratio(rank, F.count(x).over(whole())) if share else rank)


def rank_of_last(x: Column, n: int) -> Column:
    """Average rank of the current value among the last ``n``."""
    values = F.collect_list(x).over(rows(n))
    last = F.element_at(values, -1)
    rank = F.size(F.filter(values, lambda v: v < last)) + (F.size(F.filter(values, lambda v: v == last)) + 1) / 2.0
    return F.when(F.size(values) >= n, rank)
