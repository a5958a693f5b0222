"""Exact deduplication by 128-bit content hash, confirmed byte by byte.

Hashes are grouped first, some hundred bytes a row.  Only texts whose hash
occurs twice are compared: Spark groups them by the hash *and* the text, with
copies combined before the shuffle, so that a group with a third of all rows
sends one text per task.  Texts that occur once never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import doc_key, given_id, put

#: Up to so many repeated hashes, or rows to be dropped (some 100 bytes each), are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space made one space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hashes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``hash, sha, id, n``: rows that repeat both id and text are one."""
    own = docs.select(doc_key(doc_id).alias("id"), normalised(F.col(text)).alias("norm")).select("id", F.md5("norm").alias("hash"), F.sha2("norm", 256).alias("sha"))
    return put(own.groupBy("hash", "sha", "id").agg(F.count("*").alias("n")), "hashes")


def _bounded(rows: DataFrame) -> DataFrame:
    """Stored ``rows``, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def groups(docs: DataFrame, hashes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per group of two equal texts or more: ``hash, sha, keep, size``.

    ``hashes`` are those of ``docs``.  Texts that share a hash but not all bytes
    are groups of their own.
    """
    twice = put(hashes.groupBy("hash").agg(F.sum("n").alias("rows")).where("rows > 1").select("hash"), "repeated")
    texts = docs.select(doc_key(doc_id).alias("id"), normalised(F.col(text)).alias("norm")).withColumn("hash", F.md5("norm"))
    same = texts.join(_bounded(twice), "hash", "left_semi").groupBy("hash", "norm").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    return same.where("size > 1").select("hash", F.sha2("norm", 256).alias("sha"), "keep", "size")


def _decided(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    hashes = _hashes(docs, text, doc_id)
    found = groups(docs, hashes, text, doc_id)
    return hashes.join(found, ["hash", "sha"], "left").select("hash", "sha", "id", "n", F.coalesce("keep", "id").alias("keep"), F.coalesce("size", "n").alias("size"))


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document.

    A null text counts as empty, and a null id as larger than any other.  Rows
    that repeat an id with an equal text are one document: they give one row,
    and ``group_size`` counts each.  A very long text is compared whole.  An
    empty table gives no rows, and columns of any other name are not read.
    """
    return _decided(docs, text, doc_id).select(
        given_id(F.col("id")).alias("doc_id"),
        given_id(F.col("keep")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text a row of smaller id has.

    All columns stay, whatever they are called.  Of rows that repeat both id
    and text, one stays.  Only rows of such repeats are moved, if there are few
    rows to drop.
    """
    decided = put(_decided(docs, text, doc_id).select("hash", "id", "n", (F.col("id") != F.col("keep")).alias("gone")).where("gone OR n > 1"), "decided")
    keys = {"__tl_hash": F.md5(normalised(F.col(text))), "__tl_id": doc_key(doc_id)}
    named = lambda rows: put(rows.select(F.col("hash").alias("__tl_hash"), F.col("id").alias("__tl_id")), "named")
    own = docs.withColumns(keys)
    rest = own.join(_bounded(named(decided)), [*keys], "left_anti")
    once = own.join(_bounded(named(decided.where("NOT gone"))), [*keys], "left_semi").dropDuplicates([*keys])
    return rest.union(once).select(*[F.col(f"`{c}`") for c in docs.columns])
