"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``, whatever they are called and in their order; further columns
of ``docs`` pass through.  An empty table gives an empty table in every stage,
texts are read whole however long, and null values never end a stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exactdup, mixing, neardup, packing, quality
from tickloom.llm.queries import tokenizer_path
from tickloom.llm.scratch import drop, put, small_batches


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not, by a model of the labels.

    A null or empty text has the model's base score; repeated rows stay or go
    together; labels without an id or a value are not used, and without labels
    every document has the score a half and stays.
    """
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_documents(docs, model, cut=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id.

    Null and empty texts are equal; a null id is the largest; of rows that
    repeat id and text one stays.
    """
    return exactdup.deduplicate(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingle sets with a similarity of 0.8 or more.

    The smallest id of a group stays, a null id being the largest; texts without
    words are linked with nothing and stay.
    """
    small_batches(spark)
    return neardup.deduplicate(docs, threshold=Fraction(80, 100), n_bands=37)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in random order.

    A null source is a source; rows with equal ids (null too) get equal counts,
    and a count of 0 drops a document, as the method says.
    """
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    A null or empty text is the end id alone; copies are packed each.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: The classifier is not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = put(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)  # what the stage read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
