"""Choice of features, and of models: the flows that join the learning operators.

Data stays in tables; what reaches the driver has one entry per feature, fold,
grid point or model.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import learning as L
from tickloom.operators.crossval import purged_folds, three_way
from tickloom.sources.tables import StageStore

PARTS = ("exogenous", "endogenous", "backtest")


def single_importance(df: DataFrame, columns: Sequence[str], folds: DataFrame, estimator: Estimator | None = None, metric: str = "neg_log_loss") -> DataFrame:
    """``feature, mean, error``: the cross-validated score of each feature alone."""
    rows = []
    for c in columns:
        scores = L.cross_scores(df, [c], folds, estimator, metric)
        rows.append((c, float(np.mean(scores)), float(np.std(scores) / len(scores) ** 0.5)))
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, error double")


def importance(df: DataFrame, columns: Sequence[str], method: str = "impurity", folds: DataFrame | None = None, estimator: Estimator | None = None, metric: str = "neg_log_loss", trees: int = 20, seed: int = 0) -> DataFrame:
    """``feature, mean, error`` by ``impurity``, ``permutation`` or ``single``.

    The last two need purged ``folds`` (three, with an embargo of 1 %, by default).
    """
    if method == "impurity":
        return L.mean_decrease_impurity(df, columns, trees, seed)
    folds = folds if folds is not None else purged_folds(df, 3, 0.01)
    if method == "permutation":
        return L.mean_decrease_accuracy(df, columns, folds, estimator, metric, seed=seed)
    if method == "single":
        return single_importance(df, columns, folds, estimator, metric)
    raise ValueError(f"no such method: {method}")


def clustered_importance(df: DataFrame, columns: Sequence[str], method: str = "impurity", folds: DataFrame | None = None, estimator: Estimator | None = None, metric: str = "neg_log_loss", weak: float | None = None, seed: int = 0) -> DataFrame:
    """``cluster, mean, error``: importance of clusters of features.

    With ``weak``, features whose silhouette is at most so large are replaced by
    what the other clusters do not explain of them before they are judged.
    """
    clusters = L.cluster_features(df, columns, seed=seed)
    if weak is not None:
        for c in low_silhouettes(df, columns, clusters, weak):
            others = [o for o in columns if clusters[o] != clusters[c]]
            if others:
                df = L.residualise(df, c, others)
    if method == "impurity":
        return L.clustered_impurity(L.mean_decrease_impurity(df, columns, seed=seed), clusters)
    groups = {str(k): [c for c in columns if clusters[c] == k] for k in sorted(set(clusters.values()))}
    folds = folds if folds is not None else purged_folds(df, 3, 0.01)
    found = L.mean_decrease_accuracy(df, columns, folds, estimator, metric, groups, seed)
    return found.select(F.col("feature").cast("int").alias("cluster"), "mean", "error")


def low_silhouettes(df: DataFrame, columns: Sequence[str], clusters: Mapping[str, int], most: float = 0.0) -> list[str]:
    """The features that fit their cluster badly: silhouettes up to ``most``."""
    distance = np.sqrt(np.clip((1 - L.feature_correlation(df, columns)) / 2, 0, None))
    label = np.array([clusters[c] for c in columns])
    return [c for c, s in zip(columns, L.silhouettes(distance, label), strict=True) if s <= most]


def axis_ranks(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """A feature's weight on the principal axes, by their variance: what varies most without looking at labels."""
    values, axes = L.principal_axes(df, columns, 1.0)
    weight = (np.abs(axes) * values).sum(1)
    return dict(zip(columns, weight.tolist(), strict=True))


@dataclass(frozen=True)
class Selection:
    """``features`` chosen, ``scored`` subsets (features, tau, mean importance) and the three ``parts``."""

    features: tuple[str, ...]
    scored: list[tuple[tuple[str, ...], float, float]]
    parts: dict[str, DataFrame] = field(default_factory=dict)


def select_features(df: DataFrame, columns: Sequence[str], share: float = 0.5, method: str = "impurity", least: int = 2, samples: int = 3, least_tau: float = 0.0, store: StageStore | None = None, estimator: Estimator | None = None, metric: str = "neg_log_loss", seed: int = 0) -> Selection:
    """The best subset of features, and the table in three parts.

    Rows (``row_id``, ``time``, ``t1``, ``label``, ``w`` and features, of any
    number of symbols, stacked) are dealt into an exogenous part of ``share`` and
    two halves of the rest.  On the exogenous part, random subsets of each size
    are judged: importances are ranked against the principal axes by the
    weighted tau, subsets below ``least_tau`` go, and of the others the one with
    the largest mean importance is chosen (all subsets compete if none is left).
    With a ``store`` the parts are written as tables with the chosen features.
    """
    dealt = three_way(df, share, "row_id", seed=seed)
    rest = [c for c in df.columns if c not in columns]
    own = dealt.where(F.col("part") == PARTS[0]).drop("part").persist()
    scored = []
    try:
        for subset in L.feature_subsets(columns, least, samples, seed):
            found = {r.feature: r["mean"] for r in importance(own, subset, method, estimator=estimator, metric=metric, seed=seed).collect()}  # a row per feature
            ranks = axis_ranks(own, subset)
            table = own.sparkSession.createDataFrame([(c, found[c], ranks[c]) for c in subset], "feature string, a double, b double")
            tau = L.kendall(table, "a", "b", weighted=True).first().tau
            scored.append((subset, float(tau) if tau is not None else 0.0, float(np.mean(list(found.values())))))
    finally:
        own.unpersist()
    able = [s for s in scored if s[1] >= least_tau] or scored
    best = max(able, key=lambda s: (s[2], s[1], s[0]))[0]
    parts = {}
    for name in PARTS:
        part = dealt.where(F.col("part") == name).select(*rest, *best).orderBy("time", "row_id")
        if store is not None:
            store.create(name, part)
            part = store.read(name)
        parts[name] = part
    return Selection(best, scored, parts)


@dataclass(frozen=True)
class Fitted:
    """A tuned model: its grid point, mean score and fitted form."""

    name: str
    params: dict
    score: float
    model: Model


def fan_out(models: Mapping[str, tuple[Estimator, Mapping[str, Sequence]]], df: DataFrame, columns: Sequence[str], folds: DataFrame | None = None, metric: str = "neg_log_loss", tries: int | None = None, save: Callable[[str, Model], None] | None = None, at_once: int = 4, seed: int = 0) -> list[Fitted]:
    """Tune and fit each model (an estimator and its grid) side by side; best first.

    Every model is searched over the same purged folds, fitted on all rows with
    its best grid point, and given to ``save`` by name.  Spark shares its
    executors between the jobs of ``at_once`` models.
    """
    folds = (folds if folds is not None else purged_folds(df, 3, 0.01)).persist()

    def one(item) -> Fitted:
        name, (estimator, grid) = item
        best, scored = L.search(df, columns, folds, estimator, grid, metric, tries, seed)
        params, score = max(scored, key=lambda s: s[1])
        model = best.fit(L.assembled(df, columns))
        if save is not None:
            save(name, model)
        return Fitted(name, params, score, model)

    try:
        with ThreadPoolExecutor(at_once) as pool:
            return sorted(pool.map(one, models.items()), key=lambda f: (-f.score, f.name))
    finally:
        folds.unpersist()


def backtests(fitted: Sequence[Fitted], df: DataFrame, columns: Sequence[str], store: StageStore | None = None, table: str = "backtests") -> DataFrame:
    """Predictions of all models in one table, ``model_name`` and ``trial`` telling them apart."""
    keep = [c for c in df.columns if c not in columns]
    frames = []
    for trial, f in enumerate(fitted):
        said = f.model.transform(L.assembled(df, columns))
        frames.append(said.select(*keep, (F.col("prediction") - 1.0).cast("int").alias("predicted"), F.lit(f.name).alias("model_name"), F.lit(trial).alias("trial")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    if store is not None:
        store.create(table, out)
        return store.read(table)
    return out
