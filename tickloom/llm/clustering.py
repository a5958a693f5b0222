"""Centroid clustering: plain Lloyd rounds over integer vectors.

Vectors become integers once, in the JVM, and are stored.  A round broadcasts
the centroids (``k * dims`` numbers), and each partition takes the integer
squared differences to one centroid after the other in NumPy, gives a vector to
the first least one and adds up its clusters' components.  Only these sums, one
row per partition, cluster and component, merge through a group-by, and only
``k * dims`` sums reach the driver.  All arithmetic is exact, so neither the
order of rows nor a recomputed task can change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import drop, put

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: Components below this have squared distances that fit 63 bits, in up to 64 dimensions; others are worked with as Python's integers.
SMALL = 1 << 27
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """Centroids as exact integers, by number."""

    centroids: tuple[tuple[int, ...], ...]


def usable(column: Column, dims: int = DIMS) -> Column:
    """Whether a vector has exactly ``dims`` components, none null or non-finite."""
    x = column.cast("array<double>")
    return F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def units(column: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as a double; beyond 63 bits the nearest long."""
    return F.transform(column.cast("array<double>"), lambda v: F.floor(v * float(scale)))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows: 64-bit integers, or Python's where they may overflow."""
    v = np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, dims), np.int64)
    return v if not v.size or (v.min() > -SMALL and v.max() < SMALL) else v.astype(object)


def nearest(v: np.ndarray, centroids: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the first of equals, and the squared distance."""
    c = np.array(centroids, dtype=object)
    if v.dtype != object and all(abs(x) < SMALL for x in c.ravel()):
        c = c.astype(np.int64)
    distances = np.empty((len(v), len(c)), np.result_type(v, c))
    for i, centre in enumerate(c):
        moved = v - centre
        distances[:, i] = (moved * moved).sum(1)
    cluster = distances.argmin(1)
    return cluster, distances[np.arange(len(v)), cluster]


def _sums(centroids, dims: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(centroids.value)
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for frame in frames:
            v = _matrix(frame["units"], dims)
            cluster, _ = nearest(v, centroids.value)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                totals[c] += v[cluster == c].sum(0).astype(object)
        own = np.repeat(np.flatnonzero(counts), dims)
        yield pd.DataFrame({
            "cluster": own.astype(np.int32), "dim": np.tile(np.arange(dims, dtype=np.int32), len(own) // dims),
            "n": counts[own], "total": [Decimal(int(x)) for x in totals[np.flatnonzero(counts)].ravel()],
        })

    return run


def _assign(centroids, dims: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cluster, distance = nearest(_matrix(frame["units"], dims), centroids.value)
            yield pd.DataFrame({"id": frame["id"], "cluster": cluster.astype(np.int32), "distance": np.minimum(distance, LARGEST).astype(np.int64)})

    return run


def prepare(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``id, units`` of the usable vectors, stored."""
    own = vectors.where(usable(F.col(f"`{vector}`"), dims))
    return put(own.select(F.col(f"`{vec_id}`").cast("long").alias("id"), units(F.col(f"`{vector}`"), scale).alias("units")), "units")


def starts(ready: DataFrame, k: int = K, seed: int = 3) -> tuple[tuple[int, ...], ...]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order.

    Rows of one id are ordered by their components; a vector without an id
    starts no centroid.
    """
    named = ready.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return tuple(tuple(r["units"]) for r in named.orderBy("h", "units").limit(k).select("units").collect())


def fit(ready: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """``rounds`` Lloyd rounds; a round that moves nothing ends them, since all that follow would repeat it.

    A non-empty cluster's centroid becomes the floor of its vectors' mean,
    component by component; an empty one stays.
    """
    centroids = starts(ready, k, seed)
    for _ in range(rounds if centroids else 0):
        dims = len(centroids[0])
        shared = ready.sparkSession.sparkContext.broadcast(centroids)
        sums = ready.mapInPandas(_sums(shared, dims), "cluster int, dim int, n long, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        shared.unpersist()
        moved = [list(c) for c in centroids]
        for row in sums:
            moved[row["cluster"]][row["dim"]] = int(row["total"]) // row["n"]
        before, centroids = centroids, tuple(map(tuple, moved))
        if before == centroids:
            break
    return Model(centroids)


def assign(ready: DataFrame, model: Model) -> DataFrame:
    """``id, cluster, distance`` per vector; a distance beyond 63 bits is the largest long."""
    if not model.centroids:
        return ready.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    shared = ready.sparkSession.sparkContext.broadcast(model.centroids)
    return ready.mapInPandas(_assign(shared, len(model.centroids[0])), "id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 3, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` per usable vector.

    A vector of another length (null too), or with a null or non-finite
    component, is left out.  Repeated rows are vectors each and give repeated
    rows; a null id stays null and is clustered like any.  With fewer than ``k``
    vectors each starts a centroid; where no vector has an id there is none, and
    clusters are null.  An empty table gives no rows; columns of any other name
    are not read.  ``centroid`` has the final centroid's components; inertias
    beyond 63 bits are the largest long.
    """
    spark = vectors.sparkSession
    ready = prepare(vectors, dims, scale, vector, vec_id)
    model = fit(ready, k, rounds, seed)
    assigned = put(assign(ready, model), "assigned")
    drop(ready)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, min(s, LARGEST), min(sum(sums.values()), LARGEST), [str(x) for x in model.centroids[c]]) for c, s in sums.items()]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    # One row per centroid.
    return assigned.join(F.broadcast(per_cluster), "cluster", "left").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
