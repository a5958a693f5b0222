"""Intermediate tables in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
and Spark runs on one machine (tests, a laptop) is one made under the system's
temporary folder.  Tables are plain Parquet, so a lost executor costs no
recomputation of what was written.  All of an application's tables are deleted
when it ends; :func:`drop` deletes one as soon as nothing reads it any more.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null ``doc_id`` inside an operator; larger than any other id.
NO_ID = (1 << 63) - 1
_own: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _path(spark: SparkSession, name: str):
    """A Hadoop path and the file system that holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        _own[app] = f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tickloom-')}/tickloom/{app}"
        path, store = _path(spark, _own[app])
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _own[app]


def put(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` and return a DataFrame that reads what was written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python read at most so many rows at once: a batch of 10,000 whole texts, Spark's
    own bound, is held several times over on either side.  Smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def drop(df: DataFrame) -> None:
    """Delete what :func:`put` wrote; nothing may read ``df`` afterwards."""
    path, store = _path(df.sparkSession, _written.pop(df))
    store.delete(path, True)


def doc_key(column: str = "doc_id") -> Column:
    """A document's id as a long that is never null; a null id sorts last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def given_id(column: Column) -> Column:
    """The inverse of :func:`doc_key`."""
    return F.when(column != NO_ID, column)
