import hashlib
import math
import random

from tickloom.llm import clustering as C


def brute(rows, k=8, rounds=10, dims=64):
    """Lloyd over Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    out = []
    for i, d, n in last:
        out.append((i, n, d, sum(x for _, x, m in last if m == n), sum(x for _, x, _ in last), [str(x) for x in centroids[n]]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def same(spark, rows, **kw):
    got = [tuple(r) for r in C.cluster(frame(spark, rows), **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **kw), key=str)


def test_odd_vectors(spark):
    r = random.Random(5)
    good = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, [float("nan")] * 64), (104, [1.0] * 63 + [float("inf")]), (105, [1.0] * 63 + [None])]
    same(spark, good + bad + good[:3] + [(None, [0.5] * 64), (None, [0.5] * 64)])


def test_ties_and_empty_clusters(spark):
    # Equal vectors start several equal centroids: the first takes all, the others stay empty.
    same(spark, [(i, [0.25 * (i // 20)] * 64) for i in range(40)])


def test_few_none_and_large(spark):
    same(spark, [(1, [0.1] * 64), (2, [-0.1] * 64)])
    assert C.cluster(frame(spark, [])).count() == 0
    assert C.cluster(frame(spark, [(None, [0.0] * 64)])).collect()[0].cluster is None
    # Beyond 2 ** 27 the arithmetic is of Python's integers.
    same(spark, [(i, [1000.0 * ((i * 37 + j) % 401 - 200) for j in range(64)]) for i in range(30)], k=3)


def test_distances_of_large_vectors_are_exact():
    import numpy as np

    v = np.array([[1 << 40, -(1 << 40)]], object)
    cluster, distance = C.nearest(v, ((0, 0), (1, -1)))
    assert cluster[0] == 1 and distance[0] == 2 * ((1 << 40) - 1) ** 2


def test_other_names_and_shapes(spark):
    rows = [(i, [float(i % 7), float(i % 3)], "x") for i in range(50)]
    odd = spark.createDataFrame(rows, "`the id` int, vec array<double>, cluster string")
    got = C.cluster(odd, k=3, dims=2, vector="vec", vec_id="the id")
    want = brute([r[:2] for r in rows], k=3, dims=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark, sf):
    import __spark_entry__

    got = __spark_entry__.queries()["op13_centroid_clustering"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == sorted((i, n, d, a, b, hashlib.sha256(",".join(c).encode()).hexdigest()) for i, n, d, a, b, c in want)
