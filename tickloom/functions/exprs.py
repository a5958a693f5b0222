"""Column expressions that Spark lacks or that need care under ANSI mode."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """``a / b``; null, or ``default``, where ``b`` is 0 or either is null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it: infinite or NaN where ``b`` is 0; null where either is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when((b == 0) & a.isNotNull(), by_zero).otherwise(F.try_divide(a, b))


def logarithm(x: Column, log: Callable[[Column], Column] = F.log) -> Column:
    """The logarithm, natural unless ``log`` is another, as floating point has it: -infinity for 0, NaN below; null for null."""
    x = x.cast("double")
    return F.when(x > 0, log(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def sign_up(x: Column) -> Column:
    """The sign of ``x`` with 0 counted as +1."""
    return F.when(x < 0, -1.0).when(x >= 0, 1.0)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(high)).otherwise(x)
    return x


def finite(x: Column, default: float = 0.0) -> Column:
    """``default`` for null, NaN and infinities."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by a rational polynomial (error < 1e-7).

    Abramowitz and Stegun 26.2.17, as a native expression.
    """
    #: Fixed values of that formula.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution: Acklam's rational
    approximation (relative error 1.2e-9); null outside (0, 1)."""
    #: Fixed values of that formula: numerators and denominators of the middle and of the tails.
    a = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
    b = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
    c = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(factors: tuple[float, ...], x: Column) -> Column:
        out = F.lit(0.0)
        for f in factors:
            out = out * x + f
        return out

    q = p - 0.5
    middle = q * poly(a, q * q) / poly(b, q * q)
    tail = lambda x: poly(c, F.sqrt(-2 * F.log(x))) / poly(d, F.sqrt(-2 * F.log(x)))
    low = 0.02425
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(p)).when(p <= 1 - low, middle).when(p < 1, -tail(1 - p))


def softmax(values: Column) -> Column:
    """The shares of an array's exponentials, shifted by the largest."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def mapped(x: Column, table: Mapping, default: object = None) -> Column:
    """The entry of a small table by value; ``default`` for values it lacks."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), F.lit(default)) if pairs else F.lit(default)


def chosen(n: Column, k: Column) -> Column:
    """The number of ways to choose ``k`` of ``n`` as a double; 0 for ``k`` outside 0 to ``n``."""
    steps = F.when((k >= 1) & (k <= n), F.sequence(F.lit(1).cast("int"), k.cast("int")))
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - k + i) / i))


def over_full(agg: Column, counted: Column, frame: WindowSpec, n: int) -> Column:
    """A window aggregate that is null until the frame has ``n`` values."""
    return F.when(F.count(counted).over(frame) >= n, agg.over(frame))


def average_rank(values: Column, partition: WindowSpec) -> Column:
    """Rank with ties averaged; ``partition`` is an unordered window."""
    ordered = partition.orderBy(values)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ordered.rangeBetween(0, 0)) - 1) / 2.0


def hash_share(*columns: str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) by a hash of the columns."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
