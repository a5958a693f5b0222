"""Feature selection, importance, tuning and bet sizing on ``pyspark.ml``.

Tables carry feature columns, ``label`` (an index from 0), ``w`` and ``row_id``.
What reaches the driver has the size of the feature list or of a search grid.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import hash_share, ratio
from tickloom.operators.allocation import correlation, covariance_matrix, moments
from tickloom.operators.crossval import number_rows
from tickloom.operators.sampling import unit_root_ratio


def standardise(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Columns less their mean by their population deviation (0 for constants)."""
    w = Window.partitionBy(*([by] if by else []))
    if by:
        return df.withColumns({c: ratio(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w), 0.0) for c in columns})
    figures = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(figures))  # one row of figures
    return joined.select(*[ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}"), 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


def principal_axes(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and axes of the correlation matrix up to a share of variance."""
    row = moments(df, columns).first()
    values, vectors = np.linalg.eigh(correlation(covariance_matrix(row.n, row.s, row.ss)))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1
    return values[:keep], vectors[:, :keep]


def project(df: DataFrame, columns: Sequence[str], axes: np.ndarray) -> DataFrame:
    """Standardised columns projected on the axes, as ``PC_0, PC_1, ...``."""
    z = standardise(df, columns)
    parts = [sum((F.col(c) * float(a) for c, a in zip(columns, axis, strict=True)), F.lit(0.0)).alias(f"PC_{i}") for i, axis in enumerate(axes.T)]
    return z.select(*[c for c in df.columns if c not in columns], *parts)


def stationarity(df: DataFrame, columns: Sequence[str], order: str, by: str = "symbol", critical: float = -2.86) -> DataFrame:
    """``by, feature, t, stationary`` of a Dickey-Fuller test (constant, 5 %)."""
    w = Window.partitionBy(by).orderBy(order)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("y"), F.lag(F.col(c).cast("double")).over(w).alias("x")) for c in columns])
    long = df.select(by, order, pairs.alias("v")).select(by, F.explode("v").alias("v")).select(by, "v.*").where("x IS NOT NULL AND y IS NOT NULL")
    d = F.col("y") - F.col("x")
    sums = long.groupBy(by, "feature").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(d).alias("sd"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * d).alias("xd"), F.sum(d * d).alias("dd"))
    return sums.select(by, "feature", unit_root_ratio(*[F.col(c) for c in ("n", "sx", "sd", "xx", "xd", "dd")]).alias("t")).withColumn("stationary", F.coalesce(F.col("t") < critical, F.lit(False)))


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def forest(trees: int = 20, depth: int = 4, seed: int = 0, one_feature: bool = False) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="w", featureSubsetStrategy="onethird" if not one_feature else "1")


def mean_decrease_impurity(df: DataFrame, columns: Sequence[str], trees: int = 20, seed: int = 0) -> DataFrame:
    """``feature, mean, error`` of impurity importance over the trees.

    Each split looks at one feature, so that none masks another; trees that
    never use a feature do not count for it.
    """
    model = forest(trees, seed=seed, one_feature=True).fit(assembled(df, columns))
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    each[each == 0] = np.nan
    used = (~np.isnan(each)).sum(0)
    mean = np.nan_to_num(np.nanmean(np.where(used, each, 0), axis=0))
    error = np.nan_to_num(np.nanstd(np.where(used, each, 0), axis=0)) / math.sqrt(trees)
    total = mean.sum() or 1.0
    return df.sparkSession.createDataFrame([(c, float(m / total), float(e / total)) for c, m, e in zip(columns, mean, error, strict=True)], "feature string, mean double, error double")


def log_loss(predicted: DataFrame) -> Column:
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return ratio(F.sum(-F.log(F.greatest(p, F.lit(1e-15))) * F.col("w")), F.sum("w"))


def accuracy(predicted: DataFrame) -> Column:
    return ratio(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("w")).otherwise(0.0)), F.sum("w"))


METRICS: dict[str, Callable[[DataFrame], Column]] = {"neg_log_loss": lambda d: -log_loss(d), "accuracy": accuracy}


def fold_sets(df: DataFrame, folds: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Training and test tables of each fold, by joins on ``row_id``."""
    out = []
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):  # the folds' numbers
        role = folds.where(F.col("fold") == k)
        out.append(tuple(df.join(role.where(F.col("role") == r).select("row_id"), "row_id", "left_semi") for r in ("train", "test")))
    return out


def cross_scores(df: DataFrame, columns: Sequence[str], folds: DataFrame, estimator: Estimator | None = None, metric: str = "neg_log_loss") -> list[float]:
    """The weighted score of each purged fold; folds are fitted side by side."""
    full = assembled(df, columns).persist()

    def one(sets) -> float:
        fitted = (estimator or forest()).fit(sets[0])
        predicted = fitted.transform(sets[1])
        return float(predicted.agg(METRICS[metric](predicted).alias("s")).first().s)

    try:
        with ThreadPoolExecutor(4) as pool:
            return list(pool.map(one, fold_sets(full, folds)))
    finally:
        full.unpersist()


def mean_decrease_accuracy(df: DataFrame, columns: Sequence[str], folds: DataFrame, estimator: Estimator | None = None, metric: str = "neg_log_loss", groups: Mapping[str, Sequence[str]] | None = None, seed: int = 0) -> DataFrame:
    """``feature, mean, error`` of the loss of score when a feature's test values
    (or those of all features of a group) are permuted, over all folds."""
    units = dict(groups) if groups else {c: [c] for c in columns}
    members = list(dict.fromkeys(c for own in units.values() for c in own))
    full = assembled(df, columns).persist()
    top = 0.0 if metric == "neg_log_loss" else 1.0

    def one(sets) -> dict[str, float]:
        train, test = sets[0].persist(), sets[1].drop("features").persist()  # a fit reads its rows several times
        try:
            return loss((estimator or forest()).fit(train), test)
        finally:
            train.unpersist()
            test.unpersist()

    def loss(model: Model, test: DataFrame) -> dict[str, float]:
        # One order of the test rows does for all units: each row is scored as it is and once for every unit.
        paired = dealt(test, members, seed)
        variants = [("", [])] + list(units.items())
        each = [F.struct(F.lit(i).alias("_unit"), *[F.col(f"_of_{c}" if c in own else c).alias(c) for c in columns]) for i, (_, own) in enumerate(variants)]
        rows = paired.select("label", "w", F.explode(F.array(*each)).alias("_v")).select("label", "w", "_v.*")
        predicted = model.transform(assembled(rows, columns))
        scores = {r._unit: r.s for r in predicted.groupBy("_unit").agg(METRICS[metric](predicted).alias("s")).collect()}  # one row per unit
        base = float(scores[0])
        return {u: (base - s) / (top - s) if top != (s := float(scores[i])) else 0.0 for i, u in enumerate(units, 1)}

    try:
        with ThreadPoolExecutor(4) as pool:
            losses = list(pool.map(one, fold_sets(full, folds)))
    finally:
        full.unpersist()
    rows = [(u, float(np.mean(v)), float(np.std(v)) / math.sqrt(len(v))) for u in units for v in [[own[u] for own in losses]]]
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, error double")


#: Ranges of hashes in which rows are put in order.
HASH_RANGES = 200


def dealt(df: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """``df`` with ``_of_<column>``: the values of ``columns`` of another row, together.

    Row k in one hash order gets the values of row k in another; hashes are cut at
    even steps, and rows are numbered inside the ranges, not in one task.
    """

    def numbered(part: DataFrame, s: int) -> DataFrame:
        keyed = part.withColumnRenamed("row_id", "_id").withColumn("_h", hash_share("_id", seed=s))
        return number_rows(keyed, "_h", "_id", part=F.floor(F.col("_h") * HASH_RANGES)).drop("_h").withColumnRenamed("row_id", "_k")

    left = numbered(df, seed).withColumnRenamed("_id", "row_id")
    right = numbered(df.select("row_id", *[F.col(c).alias(f"_of_{c}") for c in columns]), seed + 1).drop("_id")
    return left.join(right, "_k").drop("_k")


def permuted(df: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """``df`` with the values of ``columns`` dealt to other rows, together, as :func:`dealt` does."""
    return dealt(df, columns, seed).select(*[F.col(f"_of_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def feature_correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    row = moments(df, columns).first()
    return correlation(covariance_matrix(row.n, row.s, row.ss))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return label


def silhouettes(distance: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.zeros(len(label))
    for i in range(len(label)):
        own = (label == label[i]) & (np.arange(len(label)) != i)
        others = [distance[i, label == j].mean() for j in set(label) - {label[i]}]
        if own.any() and others:
            a, b = distance[i, own].mean(), min(others)
            out[i] = (b - a) / max(a, b)
    return out


def cluster_features(df: DataFrame, columns: Sequence[str], most: int = 10, tries: int = 5, seed: int = 0, top: bool = True) -> dict[str, int]:
    """Clusters of features by correlation distance; the number of clusters has
    the best t-value of silhouettes.  ``top`` splits clusters of below-average
    quality again and keeps a split that helps.  The matrix has one row per feature."""
    distance = np.sqrt(np.clip((1 - feature_correlation(df, columns)) / 2, 0, None))
    rng = np.random.default_rng(seed)

    def quality(items: np.ndarray, label: np.ndarray) -> float:
        s = silhouettes(distance[np.ix_(items, items)], label)
        return float(s.mean() / (s.std() or 1e-9))

    def base(items: np.ndarray) -> np.ndarray:
        best, label = -math.inf, np.zeros(len(items), int)
        for k in range(2, min(most, len(items) - 1) + 1):
            for _ in range(tries):
                found = _kmeans(distance[np.ix_(items, items)], k, rng)
                if len(set(found)) > 1 and quality(items, found) > best:
                    best, label = quality(items, found), found
        return label

    every = np.arange(len(columns))
    label = base(every)
    if top and len(set(label)) > 1:
        s = silhouettes(distance, label)
        scores = {j: s[label == j].mean() / (s[label == j].std() or 1e-9) for j in set(label)}
        weak = np.flatnonzero(np.isin(label, [j for j, v in scores.items() if v < np.mean(list(scores.values()))]))
        if 3 < len(weak) < len(columns):
            again = label.copy()
            again[weak] = base(weak) + label.max() + 1
            if quality(every, again) > quality(every, label):
                label = again
    names = {j: i for i, j in enumerate(dict.fromkeys(label.tolist()))}
    return {c: names[j] for c, j in zip(columns, label.tolist(), strict=True)}


def clustered_impurity(importance: DataFrame, clusters: Mapping[str, int]) -> DataFrame:
    """``cluster, mean, error``: importance summed by cluster."""
    table = importance.sparkSession.createDataFrame(list(clusters.items()), "feature string, cluster int")
    return importance.join(F.broadcast(table), "feature").groupBy("cluster").agg(F.sum("mean").alias("mean"), F.sqrt(F.sum(F.col("error") * F.col("error"))).alias("error"))


def residualise(df: DataFrame, target: str, others: Sequence[str]) -> DataFrame:
    """``df`` with ``target`` replaced by its residual on the other features,
    by the normal equations over one pass of sums."""
    names = [target, *others]
    row = moments(df, names).first()
    cov, mean = covariance_matrix(row.n, row.s, row.ss), np.array(row.s) / row.n
    beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    fitted = sum((F.lit(float(b)) * (F.col(c) - float(m)) for c, b, m in zip(others, beta, mean[1:], strict=True)), F.lit(float(mean[0])))
    return df.withColumn(target, F.col(target) - fitted)


def feature_subsets(columns: Sequence[str], least: int, samples: int, seed: int = 0) -> list[tuple[str, ...]]:
    """Distinct random subsets of each size from ``least`` on."""
    rng = np.random.default_rng(seed)
    found = {tuple(sorted(rng.choice(columns, k, replace=False).tolist())) for k in range(least, len(columns) + 1) for _ in range(samples)}
    return sorted(found)


def kendall(table: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """``tau, p_value, n`` of two columns of a short list (a row per feature).

    Tau-b by pairs; ``weighted`` gives a pair the sum of the hyperbolic weights
    of its ranks by ``a``.  The p-value is the normal approximation.
    """
    from tickloom.functions.exprs import normal_cdf

    w = Window.orderBy(F.desc(a))
    own = table.select(a, b, F.row_number().over(w).alias("i"))
    x, y = own.alias("x"), own.alias("y")
    pairs = x.join(y, F.col("x.i") < F.col("y.i"))  # features by features: a few thousand
    da, db = F.signum(F.col(f"x.{a}") - F.col(f"y.{a}")), F.signum(F.col(f"x.{b}") - F.col(f"y.{b}"))
    weight = (1 / F.col("x.i") + 1 / F.col("y.i")) if weighted else F.lit(1.0)
    sums = pairs.agg(F.sum(weight * da * db).alias("s"), F.sum(weight * da * da).alias("u"), F.sum(weight * db * db).alias("v"), F.max("y.i").alias("n"))
    tau = ratio(F.col("s"), F.sqrt(F.col("u") * F.col("v")))
    z = tau * F.sqrt(ratio(9 * F.col("n") * (F.col("n") - 1), 2 * (2 * F.col("n") + 5)))
    return sums.select(tau.alias("tau"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p_value"), "n")


def search(df: DataFrame, columns: Sequence[str], folds: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], metric: str = "neg_log_loss", tries: int | None = None, seed: int = 0) -> tuple[Estimator, list[tuple[dict, float]]]:
    """The estimator with the best mean score over purged folds, and all scores.

    Every combination of the grid, or ``tries`` of them at random.
    """
    points = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    if tries is not None and tries < len(points):
        points = [points[i] for i in np.random.default_rng(seed).choice(len(points), tries, replace=False)]
    scored = []
    for p in points:
        e = estimator.copy({estimator.getParam(k): v for k, v in p.items()})
        scored.append((p, float(np.mean(cross_scores(df, columns, folds, e, metric)))))
    best = max(scored, key=lambda s: s[1])[0]
    return estimator.copy({estimator.getParam(k): v for k, v in best.items()}), scored


#: Up to this many times a row is in a bag: the rest has a chance below that of any hash.
MOST_DRAWS = 13


def bag_draws(df: DataFrame, bags: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``bag`` and ``draws``: how often each row is in each bag, where it is at all.

    A Poisson number with mean 1, by a hash of bag and row: what drawing with
    replacement comes to in a large table, without a row of it being moved.
    """
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST_DRAWS)]).tolist()
    own = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn("_u", hash_share(row_id, "bag", seed=seed))
    # The hash is a column that is filtered before its shares are counted: Spark would else work it out for each of them.
    return own.where(F.col("_u") >= shares[0]).withColumn("draws", sum((F.when(F.col("_u") >= s, 1).otherwise(0) for s in shares), F.lit(0))).drop("_u")


def bagging(df: DataFrame, columns: Sequence[str], estimator: Estimator | None = None, bags: int = 10, seed: int = 0, at_once: int = 4) -> list[Model]:
    """One model per bag, fitted side by side; a row counts ``draws`` times its weight ``w``."""
    drawn = assembled(bag_draws(df, bags, seed).withColumn("w", F.col("w") * F.col("draws")), columns).persist()
    try:
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(lambda b: (estimator or forest()).fit(drawn.where(F.col("bag") == b)), range(bags)))
    finally:
        drawn.unpersist()


def voted(models: Sequence[Model], df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the models' mean ``probability`` per class, as an array, and the likeliest class as ``prediction``, the lower on a tie."""
    out, own = assembled(df, columns), []
    for i, model in enumerate(models):
        out = model.transform(out).withColumn(f"_p{i}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
        own.append(F.col(f"_p{i}"))
    classes = max(m.numClasses for m in models)
    mean = F.array(*[sum((F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)) for p in own), F.lit(0.0)) / len(models) for c in range(classes)])
    out = out.withColumn("probability", mean).drop("features", *[f"_p{i}" for i in range(len(models))])
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def weighted_f1(classes: int = 3) -> Callable[[DataFrame], Column]:
    """The F1 score of each class, weighted by its share of the (weighted) labels; a class that
    is neither there nor predicted has none."""

    def score(_: DataFrame) -> Column:
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
        each = []
        for k in range(classes):
            there, called = F.col("label") == k, F.col("prediction") == k
            hit = total(there & called)
            each.append(total(there) * ratio(2 * hit, total(there) + total(called), 0.0))
        return ratio(sum(each, F.lit(0.0)), F.sum("w"))

    return score


METRICS["f1"] = weighted_f1()


def log_uniform(low: float, high: float, n: int, seed: int = 0) -> list[float]:
    """Draws whose logarithms are uniform."""
    return np.exp(np.random.default_rng(seed).uniform(math.log(low), math.log(high), n)).tolist()


#: Rows of a cell of near_rows; the most ranges in which cells are numbered, and the cells that a range has at least.
CELL, RANGES, LEAST_CELLS = 32, 256, 64


def near_rows(df: DataFrame, columns: Sequence[str], k: int = 5, projections: int = 8, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``row_id, near``: up to ``k`` near rows of each, the nearest first, by exact distance of standardised columns.

    Candidates are the rows in the same or a neighbouring cell of some random
    projection; a cell has ``CELL`` rows next to one another in its order, so that
    no cell is large, whatever repeats.  A true neighbour is missed if it is far in
    the order of every projection.  Rows with a null column have no near rows.
    """
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(projections, len(columns)))
    own = standardise(df.select(row_id, *columns).na.drop(), columns).select(F.col(row_id).alias("_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    along = F.array(*[sum((F.col("_x")[j] * float(d) for j, d in enumerate(direction)), F.lit(0.0)) for direction in directions])
    each = own.select("_id", "_x", F.posexplode(along).alias("_l", "_z"))
    # The cuts of each projection: fewer than RANGES numbers.
    ranges = max(2, min(RANGES, own.count() // (CELL * LEAST_CELLS)))
    cuts = each.groupBy("_l").agg(F.percentile_approx("_z", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    ranged = each.join(F.broadcast(cuts), "_l").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_z")))).drop("_cuts")
    place = F.row_number().over(Window.partitionBy("_l", "_range").orderBy("_z", "_id")) - 1
    cells = ranged.withColumn("_cell", F.floor(place / CELL)).drop("_z")
    there = cells.select("_l", "_range", F.explode(F.array(*[F.col("_cell") + i for i in (-1, 0, 1)])).alias("_cell"), F.col("_id").alias("_other"), F.col("_x").alias("_y"))
    apart = F.aggregate(F.zip_with("_x", "_y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    pairs = cells.join(there, ["_l", "_range", "_cell"]).where("_id <> _other").select("_id", F.struct(apart.alias("d"), F.col("_other").alias("id")).alias("o"))
    # At most 3 * CELL * projections candidates a row.
    best = pairs.groupBy("_id").agg(F.slice(F.array_sort(F.collect_set("o")), 1, k).alias("o"))
    return best.select(F.col("_id").alias(row_id), F.transform("o", lambda o: o["id"]).alias("near"))


def oversample(df: DataFrame, columns: Sequence[str], label: str = "label", seed: int = 0, neighbours: int = 5) -> DataFrame:
    """Minority rows interpolated with one of their ``neighbours`` nearest of the class until classes are even.

    Which of them, and how far towards it, is told by a hash of the row and the
    copy; a row without near rows (null columns, or alone) is repeated.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    if len(counts) < 2:
        return df
    minor, major = min(counts, key=counts.get), max(counts.values())
    few = df.where(F.col(label) == minor)
    share = (major - counts[minor]) / counts[minor]
    times = F.lit(int(share)) + F.when(hash_share("row_id", seed=seed) < share - int(share), 1).otherwise(0)
    made = few.withColumn("_n", times).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    made = made.join(near_rows(few, columns, neighbours, seed=seed), "row_id", "left")
    chosen = F.get("near", F.floor(hash_share("row_id", "_i", seed=seed + 2) * F.size("near")).cast("int"))
    other = few.select(F.col("row_id").alias("_near"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    made = made.withColumn("_near", chosen).join(other, "_near", "left")
    mixed = made.withColumns({c: F.col(c) + hash_share("row_id", "_i", seed=seed + 1) * (F.coalesce(f"_p_{c}", c) - F.col(c)) for c in columns})
    return df.unionByName(mixed.withColumn("row_id", -F.xxhash64("row_id", "_i")).select(*df.columns))


def meta_labels(df: DataFrame, side: str = "prediction", label: str = "label", neutral: float = 1.0) -> DataFrame:
    """Rows for the second model: whether the first one's call was right, with its
    side as a feature ``side``."""
    return df.withColumn("side", F.col(side) - neutral).withColumn("label", F.when((F.col(side) == F.col(label)) & (F.col(label) != neutral), 1.0).otherwise(0.0))


def composite(df: DataFrame, columns: Sequence[str], train: DataFrame, side_model: Estimator | None = None, size_model: Estimator | None = None, step: float = 0.2) -> DataFrame:
    """Side and size: a model of the label, and one of whether it is right.

    ``df`` with ``predicted`` (-1, 0, 1) and ``bet_size`` in [-1, 1].  Labels
    are 0, 1, 2 for down, flat and up.
    """
    from tickloom.operators.crossval import bet_size

    drop = ("features", "rawPrediction", "probability", "prediction")
    side = (side_model or forest()).fit(assembled(train, columns))
    called = meta_labels(side.transform(assembled(train, columns))).drop(*drop)
    second = [*columns, "side"]
    size = (size_model or forest(seed=1)).fit(assembled(called, second))
    out = side.transform(assembled(df, columns)).withColumn("side", F.col("prediction") - 1.0).drop(*drop)
    out = size.transform(assembled(out, second)).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.withColumn("predicted", F.col("side").cast("int")).withColumn("bet_size", bet_size(F.col("_p"), F.col("side"), 2, step)).drop(*drop, "side", "_p")


def backtest_frame(predicted: DataFrame, largest: float = 1.0, trial: int = 0) -> DataFrame:
    """Predictions with ``leverage`` and ``trial``."""
    return predicted.withColumn("leverage", F.col("bet_size") * largest).withColumn("trial", F.lit(trial))


def rule_model(df: DataFrame, rule: Callable[[DataFrame], Column]) -> DataFrame:
    """``df`` with ``predicted`` from a rule over its columns; only -1, 0, 1 may come out."""
    out = df.withColumn("predicted", rule(df).cast("int"))
    bad = F.when(F.col("predicted").isin(-1, 0, 1), F.col("predicted")).otherwise(F.raise_error(F.lit("a rule must give -1, 0 or 1")))
    return out.withColumn("predicted", bad.cast("int"))


def perceptron(n_features: int, hidden: int = 8, classes: int = 3, seed: int = 0) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_features, hidden, classes], seed=seed, maxIter=50)


def normalised_sizes(df: DataFrame, size: str = "bet_size", by: str = "time") -> DataFrame:
    """Sizes scaled so that those of one time add up to 1 in absolute value."""
    return df.withColumn(size, ratio(F.col(size), F.sum(F.abs(F.col(size))).over(Window.partitionBy(by)), 0.0))
