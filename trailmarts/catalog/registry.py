"""Registry of queries and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fit_partitions
from . import roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The role views of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.sized = spark, folder, set()

    def raw(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if name not in self.sized:
            self.sized.add(name)
            fit_partitions(self.spark, self.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0)
        return self.spark.read.parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        return roles.SPARK[name](self)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query. ``uses`` lists the role views the SQL reads, in order."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = roles.with_views(uses.split(), sql)
        return fn

    return add
