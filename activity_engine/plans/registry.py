"""Registry of the ready-made queries and, where SQL can say the same, their SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder by attribute: ``Tables(spark, folder).events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """``documents``, for work that is heavy per row: a file of fewer partitions than cores is dealt out first.
        A table of any size has more partitions than that and is read as it is."""
        scan, cores = self.documents, self.spark.sparkContext.defaultParallelism
        return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its own name."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def sql_list(values) -> str:
    """Strings as a SQL list of literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
