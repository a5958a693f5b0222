"""Line deduplication with levelled sorted runs of line hashes.

The index is a set of runs, each a table of distinct line hashes bucketed and
sorted by hash, so that joins with it need no shuffle of the run.  A new batch
is merge-anti-joined with the runs: the hashes it brings become a run of its
own, with the document that keeps the line, and only those.  For hashes that a
run has already, the batch leaves nothing but a count of documents, in a narrow
count run.  When a level has ``fanout`` runs they are compacted into one run of
the next; since no two runs share a hash, that is a merge without a join.
Only DataFrame expressions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.scratch import doc_key, given_id, put

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, BATCHES = 20, 3, 4
#: Lines for each bucket of a run, at least.
BUCKET_LINES = 5_000_000
#: Up to so many repeated hashes (24 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class LineRuns:
    """A growing index of the lines seen so far.

    Runs have ``h1, h2, n_docs, last``, each hash in one run only: the documents
    of the batch that brought it, and the largest id among them.  Count runs
    have ``h1, h2, n_docs``: documents of later batches with a known hash.  A
    batch must not share documents with another.  Tables are managed by Spark,
    in the warehouse, until :meth:`close`.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[tuple[str, int], list[str]] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"tickloom_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _tables(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(n) for (k, _), names in self.levels.items() if k == kind for n in names]

    def runs(self) -> list[DataFrame]:
        return self._tables("run")

    def new(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (``h1, h2, ...``) whose hash no run has."""
        for run in self.runs():
            batch = batch.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Add a batch ``h1, h2, id`` of lines of documents not added before."""
        own = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
        if not self.runs():
            self._keep("run", own)
            return
        batch = self._write(own)
        own = self.spark.table(batch)
        fresh = self._write(self.new(own))
        self._keep("count", own.join(self.spark.table(fresh).select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", "n_docs"))
        self.spark.sql(f"DROP TABLE {batch}")
        self.levels.setdefault(("run", 0), []).append(fresh)
        self._compact("run")

    def _keep(self, kind: str, rows: DataFrame) -> None:
        self.levels.setdefault((kind, 0), []).append(self._write(rows))
        self._compact(kind)

    def _compact(self, kind: str) -> None:
        level = 0
        while len(self.levels.get((kind, level), [])) >= self.fanout:
            old = self.levels.pop((kind, level))
            rows = self._union([self.spark.table(n) for n in old])
            if kind == "count":
                rows = rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            self.levels.setdefault((kind, level + 1), []).append(self._write(rows))
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.union(table)
        return rows

    def counts(self) -> DataFrame:
        """``h1, h2, n_docs, last`` of every hash: its run's row and what the count runs add."""
        runs, more = self.runs(), self._tables("count")
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last long")
        rows = self._union(runs)
        if not more:
            return rows
        added = self._union(more).groupBy("h1", "h2").agg(F.sum("n_docs").alias("added"))
        return rows.join(added, ["h1", "h2"], "left").select("h1", "h2", (F.col("n_docs") + F.coalesce("added", F.lit(0))).alias("n_docs"), "last")

    def close(self) -> None:
        """Delete all runs."""
        for names in self.levels.values():
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()


def lines(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, row, at, h1, h2`` of every line whose key has ``min_chars`` code points.

    ``row`` tells texts of one id apart and ``at`` counts lines from 0.
    """
    own = docs.select(doc_key(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    each = own.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("id", "row", "at", line_key(F.col("line")).alias("key"))
    return each.where(F.length("key") >= min_chars).select("id", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, row, drop``: for each document that loses lines, their sorted positions.

    Batches are ranges of ids, the largest first, so that the batch whose hashes
    the anti-join finds new holds the document that keeps their lines.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(doc_key(doc_id), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = sum((F.when(F.col("id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    found = put(lines(docs, min_chars, text, doc_id).withColumn("batch", number), "lines", "batch")
    index = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // BUCKET_LINES))
    try:
        for b in range(len(cuts) + 1):
            index.add(found.where(F.col("batch") == b))
        often = put(index.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last"), "often")
    finally:
        index.close()
    if often.count() <= BROADCAST_LINES:
        often = F.broadcast(often)
    return found.join(often, ["h1", "h2"]).where("id <> last").groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("drop"))


def strip(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``.

    A null or empty text is one empty line.  Rows that repeat an id count as
    one document, and a null id as the largest; repeated rows lose the same
    lines.  A very long text is one row; its lines are rows while they are
    counted.  An empty table gives no rows, and other columns are not read.
    """
    drops = repeated(docs, min_chars, min_docs, batches, text, doc_id)
    own = docs.select(doc_key(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    parts = F.expr(
        "array_join(flatten(transform(sequence(0, size(drop)), k -> slice(lines, if(k = 0, 0, drop[k - 1] + 1) + 1,"
        " if(k = size(drop), size(lines), drop[k]) - if(k = 0, 0, drop[k - 1] + 1)))), '\n')"
    )
    joined = own.join(drops, ["id", "row"], "left").withColumn("lines", F.split("text", "\n", -1))
    return joined.select(
        given_id(F.col("id")).alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(parts).alias("kept_text"),
    )
