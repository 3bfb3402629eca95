"""Running values along an ordered key, safe for a key that holds most of the rows.

A plain window over a key sends the whole key through one task. Here every key
is cut into chunks along its order column: rows are scanned inside their chunk,
chunks are summarised with map-side aggregation, and the carry of the earlier
chunks (one small row per chunk) is joined back. The largest unit of work is a
chunk, or the chunk summaries of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

CHUNK_ROWS = 1 << 16
_CHUNK = "__chunk"

# kind -> what the running value holds at a row
#   sum   sum of the values up to and including the row
#   max   largest value up to and including the row
#   last  last value that is not NULL up to and including the row
#   prev  value of the row before (NULL at the first row)
#   past  last value before the row that is not NULL
Spec = tuple[str, Column]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: Mapping[str, Spec],
    *,
    ties: Sequence[str] = (),
    chunk: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running columns ``specs`` over ``keys`` ordered by ``order`` then ``ties``.

    ``chunk`` may give another chunk number; it must not decrease along the order.
    """
    keys = list(keys)
    values = {name: f"__v_{name}" for name in specs}
    work = df.withColumn(
        _CHUNK, chunk if chunk is not None else F.floor(F.col(order) / chunk_rows)
    ).withColumns({values[n]: c for n, (_, c) in specs.items()})
    position = F.struct(order, *ties)

    totals, carries, inside, final = [], {}, {}, {}
    in_chunk = Window.partitionBy(*keys, _CHUNK).orderBy(order, *ties)
    up_to = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK)
    for name, (kind, _) in specs.items():
        value, total, carry, local = values[name], f"__t_{name}", f"__c_{name}", f"__l_{name}"
        v = F.col(value)
        if kind == "sum":
            totals.append(F.sum(v).alias(total))
            carries[carry] = F.sum(total).over(earlier)
            inside[local] = F.sum(v).over(up_to)
            zero = F.lit(0)
            final[name] = F.coalesce(F.col(local), zero) + F.coalesce(F.col(carry), zero)
        elif kind == "max":
            totals.append(F.max(v).alias(total))
            carries[carry] = F.max(total).over(earlier)
            inside[local] = F.max(v).over(up_to)
            final[name] = F.greatest(F.col(local), F.col(carry))
        elif kind in ("last", "past"):
            totals.append(
                F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), position)).alias(total)
            )
            carries[carry] = F.last(total, ignorenulls=True).over(earlier)
            inside[local] = F.last(v, ignorenulls=True).over(up_to if kind == "last" else past)
            final[name] = F.coalesce(F.col(local), F.col(carry))
        elif kind == "prev":
            totals.append(F.max_by(F.struct(v.alias("x")), position).alias(total))
            carries[carry] = F.lag(total).over(before)
            inside[local] = F.lag(F.struct(v.alias("x"))).over(in_chunk)
            final[name] = F.coalesce(F.col(local), F.col(carry))["x"]
        else:
            raise ValueError(f"unknown running kind: {kind}")

    summary = (
        work.groupBy(*keys, _CHUNK)
        .agg(*totals)
        .select(*keys, _CHUNK, *[c.alias(n) for n, c in carries.items()])
    )
    # Dealt by key and chunk: after a join on the keys alone, Spark would take a
    # key's chunks as dealt already and leave them all in one task.
    return (
        work.repartition(*keys, _CHUNK).join(summary, [*keys, _CHUNK], "left")
        .withColumns(inside)
        .withColumns(final)
        .select(*df.columns, *specs)
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "seq",
    *,
    ties: Sequence[str] = (),
    chunk: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number the rows of each key 1, 2, 3, … along ``order``."""
    return running(
        df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))},
        ties=ties, chunk=chunk, chunk_rows=chunk_rows,
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combines map-side."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in columns])


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order``; combines map-side."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in columns])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "range") -> DataFrame:
    """``df`` written in ranges of about equal numbers of rows along ``keys`` and ``order``, with the range's number.

    The number is a chunk for ``running`` where values of the order column may
    stand for any number of rows.
    """
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "__tie")
    return stored(dealt.withColumn(name, F.spark_partition_id()).drop("__tie"), "ranged")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key (all, if None) with their place. The filter on
    ``row_number`` lets Spark cut each map task to ``n`` rows per key before the shuffle."""
    placed = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if n is None else placed.where(F.col(name) <= n)
