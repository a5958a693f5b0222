"""Portfolio weights over a set of assets, and the basket ("ETF") series.

Moments of returns are aggregated in Spark; the matrices that reach a kernel
have as many rows as there are assets, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.functions.fold import Kernel
from tickloom.functions.scan import Scan, scan


def moments(wide: DataFrame, assets: Sequence[str], by: str | None = None) -> DataFrame:
    """One row (per ``by``): ``n``, sums and cross products of the asset columns."""
    pairs = [(i, j) for i in range(len(assets)) for j in range(i, len(assets))]
    col = lambda a: F.col(f"`{a}`")
    grouped = wide.groupBy(by) if by else wide.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.array(*[F.sum(col(a)) for a in assets]).alias("s"), F.array(*[F.sum(col(assets[i]) * col(assets[j])) for i, j in pairs]).alias("ss"))


def covariance_matrix(n: float, s: Sequence[float], ss: Sequence[float]) -> np.ndarray:
    """Sample covariance from the sums of :func:`moments`."""
    k = len(s)
    cross = np.zeros((k, k))
    cross[np.triu_indices(k)] = ss
    cross = cross + np.triu(cross, 1).T
    s = np.asarray(s, float)
    return (cross - np.outer(s, s) / n) / (n - 1)


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def least_variance(cov: np.ndarray) -> np.ndarray:
    """Weights of the portfolio of least variance, summing to 1."""
    w = np.linalg.solve(cov, np.ones(len(cov)))
    return w / w.sum()


def eigen_risk(cov: np.ndarray, which: int = 0, softmax: bool = False) -> np.ndarray:
    """Weights that put all risk on one principal axis (by default the least)."""
    values, vectors = np.linalg.eigh(cov)
    w = vectors[:, which] / np.sqrt(max(values[which], 1e-300))
    w = w * np.sign(w.sum() or 1.0)
    if softmax:
        e = np.exp(w - w.max())
        return e / e.sum()
    return w / np.abs(w).sum()


def single_linkage(distance: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Merges of nearest clusters, as pairs of member lists in order."""
    clusters = {i: [i] for i in range(len(distance))}
    d = {(i, j): distance[i, j] for i in clusters for j in clusters if i < j}
    merges, new = [], len(distance)
    while len(clusters) > 1:
        a, b = min(d, key=lambda p: (d[p], p))
        merges.append((clusters[a], clusters[b]))
        near = {c: min(d[tuple(sorted((a, c)))], d[tuple(sorted((b, c)))]) for c in clusters if c not in (a, b)}
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        d = {p: v for p, v in d.items() if a not in p and b not in p} | {(c, new): v for c, v in near.items()}
        new += 1
    return merges


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Risk shared along the leaves of a single-linkage tree, half against half.

    A run of leaves gets an allotment; its halves share it in inverse proportion
    to the variance of their inverse-variance portfolios, down to single assets.
    """
    merges = single_linkage(np.sqrt(np.clip((1 - correlation(cov)) / 2, 0, None)))
    leaves = np.array([*merges[-1][0], *merges[-1][1]] if merges else [0])
    out = np.zeros(len(cov))

    def risk(run: np.ndarray) -> float:
        """1' D^-1 C D^-1 1 / (1' D^-1 1)^2 of the run's covariances C with diagonal D."""
        block = cov[np.ix_(run, run)]
        d = 1 / np.diag(block)
        return float(d @ block @ d / d.sum() ** 2)

    def share(run: np.ndarray, allotment: float) -> None:
        if len(run) == 1:
            out[run[0]] = allotment
            return
        near, far = np.split(run, [len(run) // 2])
        a, b = risk(near), risk(far)
        share(near, allotment * b / (a + b))
        share(far, allotment * a / (a + b))

    share(leaves, 1.0)
    return out


METHODS = {"least_variance": least_variance, "eigen_risk": eigen_risk, "hierarchical": hierarchical_risk_parity}


def weights(wide: DataFrame, assets: Sequence[str], method: str = "hierarchical", by: str | None = None) -> DataFrame:
    """``[by,] asset, weight`` from return columns, one matrix per ``by``."""
    names, f = list(assets), METHODS[method]
    made = moments(wide, assets, by)
    key = [by] if by else []
    kind = f"`{by}` {dict(made.dtypes)[by]}, " if by else ""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                w = f(covariance_matrix(row.n, row.s, row.ss))
                yield pd.DataFrame({**({by: [getattr(row, by)] * len(names)} if by else {}), "asset": names, "weight": w})

    return made.select(*key, "n", "s", "ss").where(F.col("n") > len(names)).mapInPandas(run, kind + "asset string, weight double")


def running_weights(assets: Sequence[str], choose: Callable[[np.ndarray], np.ndarray], first: int) -> Scan:
    """Weights ``_w`` of each row from the covariance of the returns of all closes before it.

    Rows have ``row_id`` and ``close_<asset>``; from row ``first`` on, and with more
    returns than assets.  A block's moments merge with those before it and with
    the return between the two.
    """
    columns, k = [f"close_{a}" for a in assets], len(assets)

    def add(state: list, r: np.ndarray) -> list:
        n, mean, cross = state[0] + 1, np.asarray(state[1]), np.asarray(state[2])
        move = r - mean
        mean = mean + move / n
        return [n, mean, cross + np.outer(move, r - mean), *state[3:]]

    def told(state: list) -> list:
        return [state[0], np.asarray(state[1]).tolist(), np.asarray(state[2]).tolist(), *state[3:]]

    def step(state: list, rows: pd.DataFrame):
        out = []
        for row, c in zip(rows["row_id"].tolist(), rows[columns].to_numpy(float), strict=True):
            out.append(choose(np.asarray(state[2]) / (state[0] - 1)).tolist() if row >= first and state[0] > k else None)
            if state[3] is not None:
                state = add(state, c / np.asarray(state[3]) - 1)
            state = [*state[:3], c.tolist()]
        return told(state), rows.assign(_w=pd.Series(out, index=rows.index, dtype=object))

    def sums(state: list, rows: pd.DataFrame):
        for c in rows[columns].to_numpy(float):
            if state[3] is not None:
                state = add(state, c / np.asarray(state[3]) - 1)
            state = [*state[:3], c.tolist(), c.tolist() if state[4] is None else state[4]]
        return told(state), rows.iloc[:0].assign(_w=[])

    def after(state: list, summary: list) -> list:
        n, mean, cross, last, start = summary
        if last is None:
            return state
        if state[3] is not None:
            state = add(state, np.asarray(start) / np.asarray(state[3]) - 1)
        both = state[0] + n
        gap = np.asarray(mean) - np.asarray(state[1])
        joined = [both, np.asarray(state[1]) + gap * (n / both if both else 0), np.asarray(state[2]) + np.asarray(cross) + np.outer(gap, gap) * (state[0] * n / both if both else 0), last]
        return told(joined)

    none = [0, [0.0] * k, [[0.0] * k] * k]
    return Scan(Kernel(lambda: [*none, None], step, "_w array<double>"), Kernel(lambda: [*none, None, None], sums, "_w array<double>"), after)


def traded_basket(prices: DataFrame, time: str, assets: Sequence[str], method: str = "least_variance", capital: float = 10_000.0, first: int = 25, block: int = 1024) -> DataFrame:
    """``time, capital, value, holdings`` of a basket ("ETF trick") of ``assets``.

    ``prices`` has the columns ``open_<asset>`` and ``close_<asset>`` on common
    times.  From row ``first`` on (rows from 0), the weights w of a row come from
    the covariance of the returns of all closes before it, by ``method``; with
    o the opens, o' the next row's, p = o' / 100 and K the capital, holdings are
    h = w K / (o' p sum|w|), K grows by sum(h p (close - open)) with the holdings
    of the row before, and the value is sum(h o).  The last row has no next open
    and is left out.

    Nothing is one task: weights come from a scan by blocks of rows, and as
    holdings are in proportion to K, K is a product of factors that each row and
    its neighbours tell, made of sums of logarithms with signs in each block and
    over one row per block.
    """
    from tickloom.operators.crossval import number_rows

    names = list(assets)
    own = number_rows(prices.select(time, *[f"{c}_{a}" for c in ("open", "close") for a in names]), time).withColumn("_basket", F.lit(0))
    at = F.floor(F.col("row_id") / block)
    weighed = scan(own, ["_basket"], ["row_id"], at, running_weights(names, METHODS[method], first)).drop("_basket")
    later = weighed.select((F.col("row_id") - 1).alias("row_id"), *[F.col(f"open_{a}").alias(f"_next_{a}") for a in names])
    before = weighed.select((F.col("row_id") + 1).alias("row_id"), F.col("_w").alias("_held"))
    rows = weighed.where("_w IS NOT NULL").join(later, "row_id").join(before, "row_id", "left").withColumn("_block", at)
    size = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + F.abs(x))
    unit = lambda w, price, i: F.col(w)[i] / (price * price / 100 * size(w))
    grown = sum((unit("_held", F.col(f"open_{a}"), i) * F.col(f"_next_{a}") / 100 * (F.col(f"close_{a}") - F.col(f"open_{a}")) for i, a in enumerate(names)), F.lit(0.0))
    rows = rows.withColumn("_f", F.when(F.col("_held").isNull(), 1.0).otherwise(1 + grown))
    parts = {"_log": F.log(F.nullif(F.abs("_f"), F.lit(0.0))), "_neg": (F.col("_f") < 0).cast("int"), "_zero": (F.col("_f") == 0).cast("int")}
    rows = rows.withColumns(parts)
    so_far = Window.partitionBy("_block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = rows.groupBy("_block").agg(*[F.sum(c).alias(c) for c in parts]).select("_block", *[total(c, past).alias(f"{c}_past") for c in parts])
    met = rows.withColumns({f"{c}_sum": total(c, so_far) for c in parts}).join(blocks, "_block")
    log, neg, zero = ((F.col(f"{c}_sum") + F.col(f"{c}_past")) for c in parts)
    money = F.when(zero > 0, 0.0).otherwise(capital * F.exp(log) * F.when(neg % 2 == 0, 1.0).otherwise(-1.0))
    met = met.withColumn("capital", money)
    held = [F.col("capital") * unit("_w", F.col(f"_next_{a}"), i) for i, a in enumerate(names)]
    return met.withColumn("holdings", F.array(*held)).select(time, "capital", sum((F.col("holdings")[i] * F.col(f"open_{a}") for i, a in enumerate(names)), F.lit(0.0)).alias("value"), "holdings")


def basket(aligned: DataFrame, time: str, assets: Sequence[str], shares: dict[str, float], capital: float = 1.0) -> DataFrame:
    """``time, value`` of a basket rebalanced to fixed shares at every row.

    The capital grows by the weighted price change of each row: a running
    product, as a sum of logarithms inside each day and over one row per day.
    From the row on that wipes the capital out the value is 0.
    """
    day = F.to_date(time)
    total = sum(abs(shares[a]) for a in assets)
    col = lambda a: F.col(f"`{a}`")
    inside = Window.partitionBy("_day").orderBy(time)
    ends = aligned.groupBy(day.alias("_day")).agg(*[F.max_by(col(a), F.col(time)).alias(f"_end_{i}") for i, a in enumerate(assets)])
    before = Window.orderBy("_day")  # one row per day
    ends = ends.select("_day", *[F.lag(f"_end_{i}").over(before).alias(f"_end_{i}") for i in range(len(assets))])
    own = aligned.withColumn("_day", day).join(ends, "_day")
    last = lambda i, a: F.coalesce(F.lag(col(a)).over(inside), F.col(f"_end_{i}"))
    growth = sum((shares[a] / total * (ratio(col(a), last(i, a)) - 1) for i, a in enumerate(assets)), F.lit(0.0))
    own = own.withColumn("_f", 1 + F.coalesce(growth, F.lit(0.0)))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    factor = F.when(F.col("_f") > 0, F.col("_f"))
    own = own.withColumns({"_log": F.coalesce(F.sum(F.log(factor)).over(so_far), F.lit(0.0)), "_gone": F.max(F.when(F.col("_f") <= 0, 1).otherwise(0)).over(so_far)})
    days = own.groupBy("_day").agg(F.coalesce(F.sum(F.log(factor)), F.lit(0.0)).alias("_sum"), F.max("_gone").alias("_lost"))
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_sum").over(past), F.lit(0.0)).alias("_past"), F.coalesce(F.max("_lost").over(past), F.lit(0)).alias("_lost"))
    value = F.when((F.col("_gone") == 1) | (F.col("_lost") == 1), 0.0).otherwise(capital * F.exp(F.col("_past") + F.col("_log")))
    return own.join(days, "_day").select(time, value.alias("value"))
