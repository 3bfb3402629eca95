"""Tables clustered by session and line with Parquet Bloom filters, for drill-downs that read little.

Rows are ranged and sorted by session and line, so the limits in the footers
prune files and row groups for one place in a session. A Bloom filter on each
column of ``blooms`` (call ids, message ids) prunes the row groups that do not
hold one value, wherever it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("session", "line")
ROW_GROUP = 32 << 20
VALUES = 200_000  # distinct values that a row group's filter is sized for; more only make it pass more often


def write_clustered(table: DataFrame, folder: str, blooms: Sequence[str] = ("call_id",), order: Sequence[str] = ORDER, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write ``table`` below ``folder``. A session that holds most rows is spread over many files, as lines belong to the ranges too."""
    ranged = table.repartitionByRange(files, *order) if files else table.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", str(row_group))
    for column in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(VALUES))
    out.parquet(folder)


def at_line(spark: SparkSession, folder: str, session: str, line: int) -> DataFrame:
    """The rows of one line of a session: limits of session and line prune what is read."""
    return spark.read.parquet(folder).where((F.col("session") == session) & (F.col("line") == line))


def by_value(spark: SparkSession, folder: str, column: str, value: str) -> DataFrame:
    """The rows that hold ``value`` in a column with a Bloom filter."""
    return spark.read.parquet(folder).where(F.col(column) == value)
