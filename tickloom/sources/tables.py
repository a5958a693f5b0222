"""Stage tables, file sources and sinks, and model artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("tuning", "bars", "entropy", "basket", "sampled", "labelled", "weighted", "features", "exogenous", "endogenous", "backtest", "backtests", "metrics", "daily_bars", "daily_volatility", "daily_imbalance")


class StageStore:
    """One table per pipeline stage in a database; the symbol is a column.

    ``create`` fails if the table exists, ``append`` adds rows by name, and
    ``replace_days`` overwrites only the days that a table brings.
    """

    def __init__(self, spark: SparkSession, database: str = "tickloom"):
        self.spark, self.database = spark, database

    def create_database(self, exists_ok: bool = False) -> None:
        self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if exists_ok else ''}{self.database}")

    def name(self, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")
        return f"{self.database}.{stage}"

    def exists(self, stage: str) -> bool:
        return self.spark.catalog.tableExists(self.name(stage))

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def create(self, stage: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("errorifexists").partitionBy(*partition_by).saveAsTable(self.name(stage))

    def append(self, stage: str, df: DataFrame) -> None:
        df.select(*self.spark.table(self.name(stage)).columns).write.insertInto(self.name(stage))

    def replace_days(self, stage: str, df: DataFrame) -> None:
        own = df.select(*self.spark.table(self.name(stage)).columns)
        # A catalogue table takes the mode from the session, not from the writer's options.
        mode, setting = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(mode, "dynamic")
        try:
            own.write.mode("overwrite").insertInto(self.name(stage))
        finally:
            self.spark.conf.set(mode, setting)

    def read(self, stage: str, symbols: Sequence[str] | None = None) -> DataFrame:
        out = self.spark.table(self.name(stage))
        return out.where(F.col("symbol").isin(list(symbols))) if symbols is not None else out

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


def write_ticks(ticks: DataFrame, path: str) -> None:
    """Append ticks as Parquet by day; days already there are replaced."""
    dated = ticks.withColumn("date", F.to_date("ts")).repartition("date", "symbol").sortWithinPartitions("symbol", "ts", "seq")
    dated.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("date").parquet(path)


def read_ticks(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Ticks of the days asked for; other days' folders are not listed."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        out = out.where(F.col("date") <= F.lit(last).cast("date"))
    return out.drop("date")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, complete: bool = True) -> DataFrame:
    """A CSV table with a given schema; rows with a null are dropped on request."""
    out = spark.read.schema(schema).option("header", True).csv(path)
    return out.na.drop() if complete else out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def finite_values(df: DataFrame) -> DataFrame:
    """Doubles with infinities and NaN made 0, as sinks of reports expect."""
    from tickloom.functions.exprs import finite

    return df.select(*[finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
