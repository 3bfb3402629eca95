"""Two-pass external shuffle of rows into shards.

Pass one scatters rows over buckets by a seeded hash of their id, as many
buckets as keep each within ``bucket_bytes``. Pass two puts the rows of a
bucket in Fisher-Yates order, seeded by bucket. The buckets laid end to end are
a random order of all rows; shard s takes the s-th of equal stretches of it, so
shard sizes differ by one row at most (law ``rows``), and a row's slot is its
place in the stretch. Only one count per bucket is summed up over buckets.

The written table has one folder per shard. The order depends on ids, texts,
seed and the total size alone.

Defined results: a null text has no bytes and the crc32 of an empty one; rows
without id are scattered by their text; rows that share an id share a bucket
and are ordered by text; an empty table gives no rows; other columns are
written along (``scatter``), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trailmarts.session import fresh_dir

SHARDS = 24
BUCKET_BYTES = 16 << 20
ROW_BYTES = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def scatter(rows: DataFrame, shards: int = SHARDS, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` as a struct ``row`` with ``shard`` and ``slot``, in the order of the shuffle within each task."""
    total = rows.agg(F.sum(size_of(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.col(text).cast("string")), F.lit(""))
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int")
    keyed = rows.select(bucket.alias("bucket"), F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("body"), F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != text)).alias("rest"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    first = counts.select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))

    # The offsets come before the rows are dealt by bucket, so that each row is shuffled once.
    dealt = keyed.join(first, "bucket").select("bucket", "first", "total", "key", "body", "rest")
    out = T.StructType([T.StructField("position", T.LongType()), *dealt.schema.fields[2:]])

    def mix(group_key: tuple, group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group.select(["key", "body"]), sort_keys=[("key", "ascending"), ("body", "ascending")])
        drawn = np.random.default_rng([seed, group_key[0].as_py()]).permutation(group.num_rows)  # a Fisher-Yates shuffle
        taken = group.take(pa.array(order.to_numpy()[drawn]))
        places = np.arange(group.num_rows) + group.column("first")[0].as_py()
        return pa.table([pa.array(places), *(taken.column(c) for c in out.names[1:])], names=out.names)

    mixed = dealt.groupBy("bucket").applyInArrow(mix, out)
    # shard s holds the positions from floor(s * total / shards) on
    shard = F.expr(f"int(((position + 1) * {shards} - 1) div total)")
    slot = F.expr(f"position - (shard * total) div {shards}")
    return mixed.withColumn("shard", shard).withColumn("slot", slot).select("shard", "slot", "key", "body", "rest")


def write(rows: DataFrame, path: str, **how) -> DataFrame:
    """Write the shuffled rows, one folder per shard, and give back what lies there."""
    scatter(rows, **how).write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema("slot long, key long, body string, shard int").parquet(path)


def report(documents: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """Per document, from the written shards: size, crc32 of the text, shard and slot."""
    back = write(documents.select("doc_id", "text"), fresh_dir(documents.sparkSession, "shards"), shards=shards, **how)
    return back.select(
        F.col("key").alias("doc_id"), size_of(F.col("body")).alias("size"), F.crc32(F.coalesce("body", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
