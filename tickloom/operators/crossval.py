"""Purged, embargoed and combinatorial cross-validation as relations.

Rows carry a unique ``row_id`` in time order, ``time`` and ``t1`` (the end of
the label).  Splits are relations, so a fold's training set is a join, not an
index array on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, *order: str, parts: int = 200, part: Column | None = None) -> DataFrame:
    """``df`` with ``row_id`` from 0 in the given order.

    The first order column (a number, date or time) is cut at approximate
    quantiles.  Rows are numbered inside each range and shifted by the sizes of
    the ranges before, so that neither a global window nor a cache is needed and
    a lost task gives the same numbers again.  Nulls come first.  A column ``part``,
    which must not fall as the order goes on, gives the ranges without a pass for
    the quantiles.
    """
    if part is not None:
        return _numbered(df.withColumn("_part", part), order)
    kind = dict(df.dtypes)[order[0]]
    at = F.col(f"`{order[0]}`")
    at = F.unix_micros(at.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else at.cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < at)), F.lit(0)) if cuts else F.lit(0)
    return _numbered(df.withColumn("_part", F.when(at.isNull(), -1).otherwise(part)), order)


def _numbered(own: DataFrame, order: Sequence[str]) -> DataFrame:
    """``row_id`` inside each ``_part``, after the rows of the parts before."""
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(f"`{c}`") for c in order])))
    # At most `parts` + 1 rows.
    return numbered.join(F.broadcast(before.drop("_n")), "_part").withColumn("row_id", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")


def piece_of(row_id: Column, n_rows: int, pieces: int) -> Column:
    """Contiguous pieces; the first ``n_rows % pieces`` have one row more."""
    size, extra = divmod(n_rows, pieces)
    cut = extra * (size + 1)
    return F.when(row_id < cut, F.floor(row_id / (size + 1))).otherwise(extra + F.floor((row_id - cut) / max(size, 1))).cast("int")


def with_pieces(rows: DataFrame, pieces: int, n_rows: int | None = None) -> DataFrame:
    """``rows`` with their piece; ``n_rows``, if known, saves a count."""
    return rows.withColumn("piece", piece_of(F.col("row_id"), rows.count() if n_rows is None else n_rows, pieces))


def purged_folds(rows: DataFrame, folds: int, embargo: float = 0.0) -> DataFrame:
    """``fold, row_id, role`` (train or test) of purged k-fold with embargo.

    Left training rows end before the test starts; right ones start after the
    last end of a test label plus ``embargo`` times the number of rows.
    """
    n = rows.count()
    own = rows.withColumn("fold", piece_of(F.col("row_id"), n, folds))
    spans = own.groupBy("fold").agg(F.min("time").alias("t0"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.max("t1").alias("t_end"))
    # For all folds at once, the first row after each one's last label: one pass, one row.
    ends = [(r.fold, r.t_end) for r in spans.select("fold", "t_end").collect()]
    after = rows.agg(*[F.min(F.when(F.col("time") > F.lit(t).cast(dict(rows.dtypes)["time"]), F.col("row_id"))).alias(f"f{k}") for k, t in ends])
    starts = F.array(*[F.struct(F.lit(k).alias("fold"), (F.coalesce(F.col(f"f{k}"), F.lit(n)) + int(n * embargo)).alias("right")) for k, _ in ends])
    right = spans.join(after.select(F.explode(starts).alias("x")).select("x.*"), "fold") if ends else spans.withColumn("right", F.lit(n))
    # A fold's spans are a handful of rows: one row per fold.
    met = own.drop("fold").crossJoin(F.broadcast(right))
    role = F.when(F.col("row_id").between(F.col("first"), F.col("last")), "test").when((F.col("row_id") < F.col("first")) & (F.col("t1") <= F.col("t0")), "train").when(F.col("row_id") >= F.greatest("right", F.col("last") + 1), "train")
    return met.withColumn("role", role).where(F.col("role").isNotNull()).select("fold", "row_id", "role")


def splits(spark, pieces: int, k: int = 2) -> DataFrame:
    """``split, piece, path`` of all ways to test ``k`` of ``pieces``.

    ``path`` is the number of earlier splits that test the piece, so that each
    path has every piece once.
    """
    import itertools

    chosen = [(i, list(c)) for i, c in enumerate(itertools.combinations(range(pieces), k))]
    each = spark.createDataFrame(chosen, "split int, tested array<int>").select("split", F.explode("tested").alias("piece"))
    return each.withColumn("path", (F.row_number().over(Window.partitionBy("piece").orderBy("split")) - 1).cast("int"))


#: A table is cut into so many runs of row ids when ranges are joined with it.
CHUNKS = 128


def in_ranges(rows: DataFrame, ranges: DataFrame, n_rows: int) -> DataFrame:
    """Rows and ranges ``[lo, hi)`` of row ids that hold them, by an equality of chunks."""
    size = -(-max(n_rows, 1) // CHUNKS)
    chunk = lambda c: F.floor(c / size)
    cut = ranges.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("lo")), chunk(F.col("hi") - 1))))
    return rows.withColumn("_chunk", chunk(F.col("row_id"))).join(cut, "_chunk").where((F.col("row_id") >= F.col("lo")) & (F.col("row_id") < F.col("hi"))).drop("_chunk", "lo", "hi")


def _gaps(taken: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What ``taken`` leaves of ``[0, n)``."""
    out, at = [], 0
    for lo, hi in sorted(taken):
        if lo > at:
            out.append((at, lo))
        at = max(at, hi)
    return [*out, (at, n)] if at < n else out


def train_ranges(rows: DataFrame, table: DataFrame, pieces: int, embargo_days: int = 5, n_rows: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """``(clean, zones)`` of a design, from one row of figures per piece.

    A tested piece's zone ``[lo, hi)`` goes from the first row whose label reaches
    the piece to the last before its embargo ends: running extremes of the labels'
    ends and of time.  Zones are ``(piece, lo, hi, start, end)``; ``clean`` has
    ``(split, lo, hi)``, the row ids outside all zones of a split, which are
    trained on whatever their labels.
    """
    own = with_pieces(rows, pieces, n_rows)
    kind = dict(rows.dtypes)["time"]
    spans = own.groupBy("piece").agg(F.min("time").alias("s"), F.max("time").alias("e"), F.min("row_id").alias("first"), F.max("row_id").alias("last")).orderBy("piece").collect()
    if not spans:
        return [], []
    n = max(x.last for x in spans) + 1
    at = lambda t: F.lit(t).cast(kind)
    reach = [F.min(F.when(~F.coalesce(F.col("t1") < at(x.s), F.lit(False)), F.col("row_id"))).alias(f"a{x.piece}") for x in spans]
    clear = [F.min(F.when(F.col("time") > at(x.e) + F.expr(f"INTERVAL {embargo_days} DAYS"), F.col("row_id"))).alias(f"b{x.piece}") for x in spans]
    met = rows.agg(*reach, *clear).first()
    least = lambda x, y: x if y is None else min(x, y)
    zones = [(x.piece, least(x.first, met[f"a{x.piece}"]), max(x.last + 1, n if met[f"b{x.piece}"] is None else met[f"b{x.piece}"]), x.s, x.e) for x in spans]
    of_piece = {z[0]: z[1:3] for z in zones}
    tested: dict[int, list[tuple[int, int]]] = {}
    for row in table.select("split", "piece").collect():  # the design
        tested.setdefault(row.split, []).append(of_piece.get(row.piece, (0, 0)))
    return [(k, lo, hi) for k, taken in tested.items() for lo, hi in _gaps(taken, n)], zones


def combinatorial_train(rows: DataFrame, table: DataFrame, pieces: int, embargo_days: int = 5) -> DataFrame:
    """``split, row_id`` of the training rows of each split.

    A row stays if, for every tested piece ``[s, e]``, its label ends before
    ``s`` or it starts after ``e`` plus the embargo.  Rows outside the zones of a
    split (:func:`train_ranges`) are ranges of row ids; only those inside a zone
    are looked at one by one.
    """
    spark, n = rows.sparkSession, rows.count()
    clean, zones = train_ranges(rows, table, pieces, embargo_days, n)
    kind = dict(rows.dtypes)["time"]
    whole = in_ranges(rows.select("row_id"), spark.createDataFrame(clean, "split int, lo long, hi long"), n).select("split", "row_id")
    spans = spark.createDataFrame([z[:3] for z in zones], "piece int, lo long, hi long")
    ends = spark.createDataFrame([(z[0], z[3], z[4]) for z in zones], f"piece int, s {kind}, e {kind}")
    tests = table.select("split", "piece").join(ends, "piece").groupBy("split").agg(F.collect_list(F.struct("piece", "s", "e")).alias("tests"))
    near = in_ranges(with_pieces(rows, pieces, n).withColumnRenamed("piece", "own").select("row_id", "own", "time", "t1"), spans, n).where("own <> piece")
    outside = lambda t: (F.col("own") != t["piece"]) & ((F.col("t1") < t["s"]) | (F.col("time") > t["e"] + F.expr(f"INTERVAL {embargo_days} DAYS")))
    passed = near.join(table.select("split", "piece"), "piece").select("split", "row_id", "own", "time", "t1").distinct().join(tests, "split").where(F.forall("tests", outside)).select("split", "row_id")
    return whole.union(passed)


def combinatorial_test(rows: DataFrame, table: DataFrame, pieces: int) -> DataFrame:
    """``split, path, row_id`` of the tested rows."""
    return with_pieces(rows, pieces).join(F.broadcast(table), "piece").select("split", "path", "row_id")


def ways(n: int, k: int) -> int:
    """The number of ways to choose ``k`` of ``n``: splits of a design, of which each path takes ``k / n``."""
    return math.comb(n, k)


def bet_size(probability: Column, side: Column, classes: int = 2, step: float = 0.2) -> Column:
    """Signed size of a bet from a predicted probability, in steps, within [-1, 1].

    Certain predictions get the full size.
    """
    from tickloom.functions.exprs import clip, normal_cdf, ratio

    p = probability
    z = ratio(p - 1.0 / classes, F.sqrt(F.greatest(p * (1 - p), F.lit(0.0))))
    size = F.when(p >= 1, 1.0).when(p <= 0, -1.0).otherwise(2 * normal_cdf(z) - 1)
    return clip(F.bround(side * size / step, 0) * step, -1.0, 1.0)


def three_way(df: DataFrame, first: float, *keys: str, seed: int = 0) -> DataFrame:
    """``df`` with ``part``: a share ``first`` for one use, the rest in two halves."""
    from tickloom.functions.exprs import hash_share

    u = hash_share(*keys, seed=seed)
    return df.withColumn("part", F.when(u < first, "exogenous").when(u < first + (1 - first) / 2, "endogenous").otherwise("backtest"))
