"""Connected components by alternating large and small stars.

Every round is two aggregations (with map-side combining, so a hub with a large
share of the edges is combined before it is shuffled) and joins that adaptive
execution may split; edges are written between rounds, so lineage stays short,
and those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import drop, put


def _star(edges: DataFrame, spent: list[DataFrame], *, large: bool) -> DataFrame:
    """Link a node's larger (or own and smaller) neighbours to the least one.

    What is stored on the way goes to ``spent``, which is to be dropped later.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        # A hub has many larger neighbours.  Stored, so that both sides of the join have exchanges of their own and a hub's edges can be split.
        least = put(least, "least")
        spent.append(least)
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge, the component being the
    smallest node reachable.  Self-loops, repeated edges and an empty table are
    allowed; nodes without an edge to another node are left out.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    e, mark = put(e, "edges"), None
    for _ in range(max_rounds):
        spent = [e]
        e = put(_star(_star(e, spent, large=True), spent, large=False), "edges")
        for table in spent:
            drop(table)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
