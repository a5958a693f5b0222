"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate; a document's count is drawn by
inverting the Poisson distribution of that mean at a hash of its id, the
document is exploded by its count, and all copies are shuffled globally.  Only
DataFrame expressions are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import put

SEED = 20240131
#: Up to so many sources the rates are broadcast (about 1 kB each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 5_000
#: Up to this rate the distribution starts at exp(-rate), which is 0 in doubles from about 745 on.
DIRECT_RATE = 500.0


def _hex(digits: int, *parts: Column) -> Column:
    """The first hex digits of an md5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) by the seed and the id, on a grid of 2**-52."""
    return _hex(13, F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))) / F.lit(float(1 << 52))


def _source(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _mass(k: Column, rate: Column) -> Column:
    """The Poisson probability of ``k`` in log space, for ``k`` of some hundreds at
    least: k ln(rate) - rate - ln(k!) by Stirling's series, without its large terms."""
    k = k.cast("double")
    log_factorial = 1 / (12 * k) - 1 / (360 * k * k * k) + 0.5 * F.log(2 * math.pi * k)
    return F.exp(k - rate - k * F.log1p((k - rate) / rate) - log_factorial)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, power: float = 0.5, source: str = "source") -> DataFrame:
    """``source_key, n, rate, cdf, least`` of each source: the distribution of
    its counts from ``least`` on.

    ``weights`` are target shares by source (a source not named gets 0); by
    default a source of n documents weighs ``n ** power``.  ``total`` documents
    are expected, by default as many as there are.
    """
    sizes = docs.groupBy(_source(source).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow("n", F.lit(power)))
    else:
        named = docs.sparkSession.createDataFrame([("=" + k, float(v)) for k, v in weights.items()], "source_key string, w double")
        weighed = sizes.join(named, "source_key", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    goal = F.col("all_n") if total is None else F.lit(float(total))
    rated = weighed.join(F.broadcast(sums)).withColumn("rate", F.coalesce(F.try_divide(goal * F.col("w"), F.col("all_w") * F.col("n")), F.lit(0.0)))  # sums is one row
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    first = F.exp(-F.col("rate"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("rate") / k).alias("p"), (s["c"] + s["p"] * F.col("rate") / k).alias("c"), F.concat(s["cdf"], F.array(s["c"] + s["p"] * F.col("rate") / k)).alias("cdf")),
    )
    direct = F.col("rate") <= DIRECT_RATE
    least = F.when(direct, 0).otherwise(F.floor(F.col("rate") - 12 * F.sqrt("rate") - 20)).cast("int")
    far = F.aggregate(
        F.sequence(least, last),
        F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("cdf")),
        lambda s, k: F.struct((s["c"] + _mass(k, F.col("rate"))).alias("c"), F.concat(s["cdf"], F.array(s["c"] + _mass(k, F.col("rate")))).alias("cdf")),
    )
    return rated.select("source_key", "n", "rate", F.when(direct, grown["cdf"]).otherwise(far["cdf"]).alias("cdf"), least.alias("least"))


def copies(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``__tl_n``, the number of copies of each row.

    A null source is a source of its own and a null id has one hash; repeated
    rows get equal counts.  An empty table stays empty.  Large rates are drawn
    from the counts within 12 deviations of the rate.
    """
    table = put(rates(docs, weights, total, power, source).select(F.col("source_key").alias("__tl_source"), F.col("cdf").alias("__tl_cdf"), F.col("least").alias("__tl_least")), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    keyed = docs.withColumn("__tl_source", _source(source)).join(table, "__tl_source")
    u = uniform(seed, F.col(doc_id))
    return keyed.withColumn("__tl_u", u).withColumn("__tl_n", F.col("__tl_least") + F.size(F.filter("__tl_cdf", lambda c: c <= F.col("__tl_u")))).drop("__tl_source", "__tl_cdf", "__tl_least", "__tl_u")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All copies in an order set by a hash: ``docs`` with ``__tl_n``,
    ``__tl_copy`` (1 and up) and ``__tl_order``.

    Rows are dealt over partitions by the hash and sorted by it inside.
    """
    counted = copies(docs, weights, total, power, seed, source, doc_id).where("__tl_n > 0")
    each = counted.withColumn("__tl_copy", F.explode(F.sequence(F.lit(1), F.col("__tl_n"))))
    order = _hex(15, F.lit(str(seed + 1)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("__tl_copy").cast("string"))
    return each.withColumn("__tl_order", order).repartition("__tl_order").sortWithinPartitions("__tl_order", doc_id)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs`` alone, replicated and shuffled."""
    return mix(docs, **how).select(*[F.col(f"`{c}`") for c in docs.columns])
