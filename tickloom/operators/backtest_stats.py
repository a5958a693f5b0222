"""Backtest statistics, overfitting tests and model choice."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import hash_share, normal_cdf, ratio

INITIAL_CAPITAL = 5000.0
YEAR_DAYS = 365.2425


def trades(events: DataFrame, capital: float = INITIAL_CAPITAL, cost_share: float = 0.01, seed: int = 0) -> DataFrame:
    """Returns, profit and running capital of labelled events, per ``trial``.

    ``events``: ``trial, bar, close_date, close_price, barrierPrice,
    barrierLabel, upper_barrier, lower_barrier``.  The cost of an event is a
    reproducible share up to ``cost_share`` of the price that its label reached.
    Profits add up as decimals, so that a capital that stands still is equal.
    """
    level = F.when(F.col("barrierLabel") == 1, F.col("upper_barrier")).when(F.col("barrierLabel") == -1, F.col("lower_barrier")).otherwise(F.col("close_price"))
    price = F.when(F.col("barrierPrice") != 0, F.col("barrierPrice")).otherwise(F.col("close_price"))
    close = F.col("close_price")
    out = events.withColumn("costs", hash_share("trial", "bar", seed=seed) * level * cost_share)
    gain = F.when(F.col("barrierLabel") == 1, price - close - F.col("costs")).when(F.col("barrierLabel") == -1, close - price - F.col("costs")).otherwise(0.0)
    out = out.withColumn("ret", ratio(gain, close, 0.0)).withColumn("pnl", close * F.col("ret"))
    w = Window.partitionBy("trial").orderBy("close_date", "bar").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("capital", (F.sum(F.col("pnl").cast("decimal(28,8)")).over(w) + F.lit(capital).cast("decimal(28,8)")).cast("double"))


def drawdowns(traded: DataFrame) -> DataFrame:
    """``trial, high, since, drawdown, under_water`` of each high-water mark that
    was followed by a fall; years until the next such mark."""
    order = Window.partitionBy("trial").orderBy("close_date", "bar")
    marked = traded.withColumn("high", F.max("capital").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = marked.groupBy("trial", "high").agg(F.min("capital").alias("low"), F.min("close_date").alias("since")).where("high > low")
    nxt = F.lead("since").over(Window.partitionBy("trial").orderBy("since", "high"))
    years = (F.unix_micros(nxt) - F.unix_micros("since")) / (86_400e6 * YEAR_DAYS)
    return marks.select("trial", "high", "since", (1 - ratio(F.col("low"), F.col("high"))).alias("drawdown"), years.alias("under_water"))


def _concentration(sign: int) -> Column:
    """Herfindahl-Hirschman index of the returns of one sign, zeros included."""
    side = F.when((F.col("ret") * sign) >= 0, F.col("ret"))
    n = F.count(side)
    share = ratio(F.sum(side * side), F.pow(F.sum(side), 2))
    return F.when(n > 2, ratio(share - ratio(F.lit(1.0), n), 1 - ratio(F.lit(1.0), n)))


def statistics(traded: DataFrame, benchmark_sharpe: float = 0.0, raw_kurtosis: bool = False) -> DataFrame:
    """The table of backtest statistics, one row per trial.

    The probabilistic Sharpe ratio uses the excess kurtosis, or the raw one on
    request; undefined values are null.
    """
    at = F.struct("close_date", "bar")
    ret = F.col("ret")
    base = traded.groupBy("trial").agg(
        F.min_by("capital", at).alias("first"), F.max_by("capital", at).alias("last"), F.avg("capital").alias("mean_capital"), F.avg("costs").alias("mean_costs"),
        F.datediff(F.max("close_date"), F.min("close_date")).alias("days"), F.count("*").alias("n"), F.sum(F.when(ret > 0, 1).otherwise(0)).alias("hits"), F.avg(F.when(ret > 0, ret)).alias("hit_return"),
        F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"), _concentration(1).alias("hhi_positive"), _concentration(-1).alias("hhi_negative"),
    )
    worst = drawdowns(traded).groupBy("trial").agg(F.max("drawdown").alias("max_drawdown"), F.max("under_water").alias("max_under_water"))
    sharpe = ratio(F.col("mu"), F.col("sd"))
    kurt = F.col("kurt") + (3 if raw_kurtosis else 0)
    spread = 1 - F.col("skew") * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    psr = F.when(spread > 0, normal_cdf(ratio((sharpe - benchmark_sharpe) * F.sqrt(F.col("n") - 1), F.sqrt(spread))))
    growth = ratio(F.col("last"), F.col("first")) - 1
    return base.join(worst, "trial", "left").select(
        "trial", (F.col("last") - F.col("first")).alias("pnl"),
        F.when((growth > -1) & (F.col("days") > 0), F.pow(growth + 1, ratio(F.lit(360.0), F.col("days"))) - 1).alias("annual_return"),
        "hits", ratio(F.col("hits"), F.col("n")).alias("hit_ratio"), "hit_return", "max_drawdown", "max_under_water", "hhi_positive", "hhi_negative", sharpe.alias("sharpe"), psr.alias("psr"),
        ratio(growth * F.col("mean_capital"), F.col("first")).alias("dollar_performance"), ratio(growth, F.col("mean_costs")).alias("return_on_costs"),
        least_track_record(sharpe, F.col("skew"), kurt, benchmark_sharpe).alias("track_record"),
    )


def least_track_record(sharpe: Column, skew: Column, kurt: Column, benchmark: float = 0.0, confidence: float = 0.95) -> Column:
    """The number of returns needed for a Sharpe ratio above the benchmark to be significant."""
    z = NormalDist().inv_cdf(1 - confidence)
    return 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * F.pow(ratio(F.lit(z), sharpe - benchmark), 2)


def composite_score(stats: DataFrame, benchmarks: Mapping[str, float]) -> DataFrame:
    """``stats`` with ``score``: 100 times the mean of each figure by its benchmark."""
    parts = [ratio(F.col(k), F.lit(v), 0.0) for k, v in benchmarks.items()]
    return stats.withColumn("score", 100 * sum(parts, F.lit(0.0)) / len(parts))


def pnl_matrix(returns: DataFrame, compounded: bool = False) -> DataFrame:
    """Long ``t, model, value``: ``1 + ret`` or its running product."""
    factor = 1 + F.col("ret")
    if compounded:
        factor = F.exp(F.sum(F.log(1 + F.col("ret"))).over(Window.partitionBy("model").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return returns.select("t", "model", factor.alias("value"))


def _sharpe(n: Column, s: Column, ss: Column) -> Column:
    """Mean by population deviation, from sums."""
    mean = ratio(s, n)
    return ratio(mean, F.sqrt(F.greatest(ratio(ss, n) - mean * mean, F.lit(0.0))))


def cscv(matrix: DataFrame, blocks: int = 16, metric: Callable[[Column, Column, Column], Column] = _sharpe, aggregate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Combinatorially symmetric cross-validation: one row per split.

    ``split, best_model, sharpe_in, sharpe_out, rank, omega, logit``.  Times are
    cut into ``blocks`` runs; a ``metric`` of number, sum and sum of squares (by
    default the Sharpe ratio) of any union of runs comes from the runs' three
    sums, so a split costs a few additions per model instead of a pass over the
    returns.  ``aggregate`` is any aggregate expression of the returns instead;
    each return is then read once for every split.  Ties go to the model of the
    greater name.
    """
    spark = matrix.sparkSession
    n_rows = matrix.select("t").distinct().count()
    size, extra = divmod(n_rows, blocks)
    times = matrix.select("t").distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)
    cut = extra * (size + 1)
    block = F.when(F.col("i") < cut, F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - cut) / max(size, 1))).cast("int")
    sums = matrix.join(times.select("t", block.alias("block")), "t").groupBy("model", "block").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    chosen = [(k, list(c)) for k, c in enumerate(itertools.combinations(range(blocks), blocks // 2))]
    splits = spark.createDataFrame(chosen, "split int, inside array<int>").select("split", F.explode("inside").alias("block"))
    if aggregate is None:
        total = sums.groupBy("model").agg(*[F.sum(c).alias(f"{c}_all") for c in ("n", "s", "ss")])
        inner = sums.join(splits, "block").groupBy("split", "model").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).join(total, "model")
        scored = inner.select("split", "model", metric(*[F.col(c) for c in ("n", "s", "ss")]).alias("a"), metric(*[F.col(f"{c}_all") - F.col(c) for c in ("n", "s", "ss")]).alias("b"))
    else:
        designs = spark.createDataFrame(chosen, "split int, inside array<int>")
        # The design has C(blocks, blocks / 2) rows, whatever the returns.
        each = matrix.join(times.select("t", block.alias("block")), "t").join(F.broadcast(designs)).withColumn("_in", F.array_contains("inside", F.col("block")))
        scored = each.groupBy("split", "model").agg(aggregate(F.when(F.col("_in"), F.col("value"))).alias("a"), aggregate(F.when(~F.col("_in"), F.col("value"))).alias("b"))
    w = Window.partitionBy("split")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy("b", "model"))).withColumn("models", F.count("*").over(w))
    best = ranked.groupBy("split").agg(F.max_by(F.struct("model", "a", "b", "rank", "models"), F.struct("a", "model")).alias("x"))
    omega = ratio(F.col("x.rank"), F.col("x.models") + 1)
    return best.select("split", F.col("x.model").alias("best_model"), F.col("x.a").alias("sharpe_in"), F.col("x.b").alias("sharpe_out"), F.col("x.rank").alias("rank"), omega.alias("omega"), F.log(omega / (1 - omega)).alias("logit"))


def overfitting(splits: DataFrame) -> DataFrame:
    """One row: probability of overfitting and of a loss in and out of sample."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return splits.agg(F.count("*").alias("n_splits"), share(F.col("logit") < 0).alias("pbo"), share(F.col("sharpe_in") < 0).alias("loss_in"), share(F.col("sharpe_out") < 0).alias("loss_out"))


def overfitting_gate(matrix: DataFrame, blocks: int = 16, most: float = 0.5) -> DataFrame:
    """The figures and ``passed``: whether the probability stays below ``most``."""
    return overfitting(cscv(matrix, blocks)).withColumn("passed", F.col("pbo") < most)


def choose_nearest(stats: DataFrame, key: str, larger: Sequence[str], smaller: Sequence[str] = (), farthest: bool = False) -> DataFrame:
    """Rows by Euclidean distance of standardised figures from the ideal row.

    The ideal has the largest of ``larger`` and the smallest of ``smaller``;
    ``chosen`` marks the nearest (or farthest) row.
    """
    names = [*larger, *smaller]
    figures = stats.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("spread", F.stddev_pop), ("low", F.min), ("high", F.max))])
    joined = stats.join(F.broadcast(figures))  # one row of figures
    scaled = lambda x, c: ratio(x - F.col(f"mean_{c}"), F.col(f"spread_{c}"), 0.0)
    ideal = {**{c: f"high_{c}" for c in larger}, **{c: f"low_{c}" for c in smaller}}
    squares = [F.pow(scaled(F.col(c), c) - scaled(F.col(at), c), 2) for c, at in ideal.items()]
    far = joined.select(key, F.sqrt(sum(squares, F.lit(0.0))).alias("distance"))
    best = far.agg((F.max if farthest else F.min)("distance").alias("_d"))
    tied = far.join(F.broadcast(best), F.col("distance") == F.col("_d")).agg(F.min(key).alias("_best"))
    return far.join(F.broadcast(tied)).select(key, "distance", F.coalesce(F.col(key) == F.col("_best"), F.lit(False)).alias("chosen"))


def swarm(objective, dims: int, low: float | np.ndarray, high: float | np.ndarray, particles: int = 5, rounds: int = 100, inertia: float = 0.01, pull: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Particle swarm minimum of a function of a vector: a few numbers on the driver.

    Every particle draws one random number for its memory and one for the swarm.
    """
    rng = np.random.default_rng(seed)
    x = rng.uniform(low, high, (particles, dims))
    v = np.zeros_like(x)
    own, own_value = x.copy(), np.array([objective(p) for p in x])
    best = own[own_value.argmin()].copy()
    for _ in range(rounds):
        v = inertia * v + pull * rng.random((particles, 1)) * (own - x) + pull * rng.random((particles, 1)) * (best - x)
        x = np.clip(x + v, low, high)
        value = np.array([objective(p) for p in x])
        better = value < own_value
        own[better], own_value[better] = x[better], value[better]
        best = own[own_value.argmin()].copy()
    return best, float(own_value.min())


def choose_by_swarm(stats: DataFrame, key: str, larger: Sequence[str], smaller: Sequence[str] = (), objective: Callable[[np.ndarray], float] | None = None, seed: int = 0) -> DataFrame:
    """``key, distance, chosen``: rows by distance from the point that a swarm finds.

    Figures are standardised, those of ``larger`` with their sign turned; the
    swarm looks for the least value of ``objective`` (by default the Ackley
    function) inside their bounds, and the row farthest from that point (signs
    turned back) is chosen.  Only the bounds, one row, reach the driver.
    """
    names = [*larger, *smaller]
    if objective is None:
        objective = lambda p: float(20 + np.e - 20 * np.exp(-0.2 * np.sqrt(np.mean(p * p))) - np.exp(np.mean(np.cos(2 * np.pi * p))))
    figures = stats.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("spread", F.stddev_pop), ("low", F.min), ("high", F.max))]).first()
    sign = {c: -1.0 if c in larger else 1.0 for c in names}
    z = lambda x, c: (x - figures[f"mean_{c}"]) / figures[f"spread_{c}"] if figures[f"spread_{c}"] else 0.0
    ends = [sorted((sign[c] * z(figures[f"low_{c}"], c), sign[c] * z(figures[f"high_{c}"], c))) for c in names] if figures[f"mean_{names[0]}"] is not None else [(0.0, 0.0)] * len(names)
    low, high = (np.array(e, float) for e in zip(*ends, strict=True))
    best, _ = swarm(objective, len(names), low, high, seed=seed)
    squares = [F.pow((ratio(F.col(c) - figures[f"mean_{c}"], F.lit(figures[f"spread_{c}"]), 0.0) if figures[f"spread_{c}"] is not None else F.lit(0.0)) - float(sign[c] * b), 2) for c, b in zip(names, best, strict=True)]
    far = stats.select(key, F.sqrt(sum(squares, F.lit(0.0))).alias("distance"))
    chosen = far.agg(F.max_by(key, F.struct("distance", key)).alias("_best"))
    return far.join(F.broadcast(chosen)).select(key, "distance", F.coalesce(F.col(key) == F.col("_best"), F.lit(False)).alias("chosen"))  # one row


def test_functions(x: Sequence[Column]) -> dict[str, Column]:
    """Ackley, Rastrigin, Rosenbrock and Schwefel functions of columns."""
    import math

    n = len(x)
    total = lambda parts: sum(parts, F.lit(0.0))
    ackley = -20 * F.exp(-0.2 * F.sqrt(total(c * c for c in x) / n)) - F.exp(total(F.cos(2 * math.pi * c) for c in x) / n) + 20 + math.e
    rastrigin = 10 * n + total(c * c - 10 * F.cos(2 * math.pi * c) for c in x)
    rosenbrock = total(100 * F.pow(b - a * a, 2) + F.pow(1 - a, 2) for a, b in zip(x, x[1:]))
    schwefel = 418.9829 * n - total(c * F.sin(F.sqrt(F.abs(c))) for c in x)
    return {"ackley": ackley, "rastrigin": rastrigin, "rosenbrock": rosenbrock, "schwefel": schwefel}
