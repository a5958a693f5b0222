"""Chat formatting with collapse of cumulative snapshots.

Chats are often logged again after every turn, so that most logged
conversations are prefixes of longer ones.  Every turn gets a rolling hash of
the turns up to it (two 64-bit hashes over position, role and text, combined by
exclusive or, which a window adds up turn by turn).  Conversations whose whole
hash is the hash of a proper prefix of another are removed by an anti-join, of
equal conversations the smallest id stays, and those left are rendered.  Only
DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import NO_ID, doc_key, given_id, put


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with ``conv, lost``; a null role or text is empty.

    A turn without a conversation id is a conversation by itself: ``lost`` tells
    such turns apart, and is 0 for all others.
    """
    own = conversations.select(doc_key(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.md5("text"))
    return own.withColumn("lost", F.when(F.col("conv") == NO_ID, F.xxhash64("turn", "role", "h")).otherwise(F.lit(0).cast("long")))


def prefixes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, lost, n, k, a, b``: the rolling hash ``a, b`` of the first ``k`` of ``n`` turns."""
    own = _turns(conversations, conv_id, turn, role, text).withColumn("g", F.xxhash64("role", "text")).drop("text")
    grouped = own.groupBy("conv", "lost").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "h", "g"))).alias("turns"))
    each = grouped.select("conv", "lost", F.size("turns").alias("n"), F.posexplode("turns").alias("at", "t"))
    rolling = Window.partitionBy("conv", "lost").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(
        "conv",
        "lost",
        "n",
        (F.col("at") + 1).alias("k"),
        F.bit_xor(F.xxhash64(F.lit(1), "at", "t.role", "t.h")).over(rolling).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(2), "at", "t.g")).over(rolling).alias("b"),
    )


def maximal(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, lost, n, n_copies`` of conversations that are no proper prefix of another."""
    rolled = put(prefixes(conversations, conv_id, turn, role, text), "prefixes")
    whole = rolled.where("k = n").groupBy("n", "a", "b").agg(F.min(F.struct("conv", "lost")).alias("c"), F.count("*").alias("n_copies"))
    begun = rolled.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(begun, ["n", "a", "b"], "left_anti").select("c.conv", "c.lost", "n", "n_copies")


def template(role: Column, text: Column) -> Column:
    """One rendered turn; markers inside a text are broken up."""
    return F.concat(F.lit("<|"), F.replace(role, F.lit("|"), F.lit("")), F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of the maximal conversations.

    Turns are in the order of ``turn`` (null first), ties by role and then by the
    md5 of their texts; a turn logged twice in a conversation counts once, a null
    role or text is empty and very long texts are rendered whole.  A row without
    a conversation id is a conversation of one turn.  An empty table gives no
    rows, and other columns are not read.
    """
    kept = maximal(conversations, conv_id, turn, role, text)
    own = _turns(conversations, conv_id, turn, role, text).join(kept.select("conv", "lost"), ["conv", "lost"], "left_semi")
    grouped = own.groupBy("conv", "lost").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "h", "text"))).alias("turns"))
    text_of = F.array_join(F.transform("turns", lambda t: template(t["role"], t["text"])), "")
    return grouped.select("conv", "lost", text_of.alias("rendered")).join(kept, ["conv", "lost"]).select(given_id(F.col("conv")).alias("conv_id"), F.col("n").cast("long").alias("n_turns"), "n_copies", "rendered")
