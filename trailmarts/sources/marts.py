"""Parquet tables of the library: price history and session marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import local_day
from ..operators.pricing import PRICING
from ..session import stored


def price_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICING).json(path)


def _by_day(items: DataFrame) -> DataFrame:
    return items.withColumn("day", local_day(F.coalesce("started_ms", "mtime_ms")))


def write_items(items: DataFrame, folder: str) -> None:
    """Session rows below ``source`` and UTC day, so that windows prune folders; only the days of ``items`` are written, whole.

    Rows are rebalanced by day first, so a day has few files whatever the tasks were.
    """
    rows = _by_day(items).hint("rebalance", "source", "day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day").parquet(folder)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every session: one that moved to another day is also in the old day until that is written again."""
    rows = spark.read.parquet(folder)
    names = [c for c in rows.columns if c not in ("source", "session")]
    newest = rows.groupBy("source", "session").agg(F.max_by(F.struct(*names), F.struct("mtime_ms", "day")).alias("x"))
    return newest.select("source", "session", "x.*")


def refresh_items(changed: DataFrame, folder: str) -> None:
    """Put the rows of ``changed`` sessions into the mart: the days they have are rewritten with the other sessions of those days, all else is left."""
    spark = changed.sparkSession
    changed = stored(changed, "changed-items")
    days = _by_day(changed).select("source", "day").distinct()
    others = spark.read.parquet(folder).join(days, ["source", "day"], "left_semi").join(changed.select("source", "session"), ["source", "session"], "left_anti")
    write_items(stored(changed.unionByName(others.drop("day")), "refreshed-items"), folder)


def write_silver(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").parquet(folder)
