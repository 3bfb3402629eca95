"""Searchable fields as Parquet files with the trigrams that each file holds, so that a search opens few of them.

Layout below a folder, by batch: ``fields/<batch>-<version>`` the fields,
``grams/<batch>-<version>`` bit maps of trigrams by file, and ``files/batch=<batch>``
the files that count. The last is written at the end: until then a batch, or
its second writing, is not seen by any reader, and a batch that is written
again takes the place of the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

BITS = 1 << 20  # of one file's map; a file of 100 MB of text holds far fewer trigrams
BUCKET = 1 << 15  # bits of one stored map: that of Spark's bitmap functions
PIECE = 1 << 13  # code points of a text that are cut into trigrams at a time
GRAM = 3

FIELDS = "session string, thread string, line bigint, ts_ms bigint, ord int, field string, text string, tool string"


def _pieces(text: Column) -> Column:
    """``text`` in pieces that together hold all its trigrams; each one takes the first two code points of the next."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    rest = F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))
    return F.zip_with(cut, rest, lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(GRAM - 1)), F.lit(""))))


def grams(piece: Column) -> Column:
    """Distinct trigrams; one that cuts a code point in two may be among them, which only makes a map wider."""
    return F.array_distinct(F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def bit_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def trigram_maps(texts: DataFrame) -> DataFrame:
    """Bit maps of the lower-cased trigrams of each file: ``file, bucket, bits``. ``texts`` has file and text.

    Bitmaps are built by sorting, so the bits of a file are made distinct first, by
    hash and before the shuffle: a task holds at most ``BITS`` of a file, however long its text.
    """
    pieces = texts.where(F.length("text") >= GRAM).select("file", F.explode(_pieces(F.lower("text"))).alias("piece"))
    bits = pieces.select("file", F.explode(grams(F.col("piece"))).alias("gram")).select("file", bit_of(F.col("gram")).alias("bit")).distinct()
    return bits.groupBy("file", F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg((F.col("bit") % BUCKET)).alias("bits"))


def write_batch(fields: DataFrame, folder: str, batch: str, files: int | None = None) -> None:
    """Write one batch of fields, clustered by session and line, and its maps; the whole batch replaces an earlier one of that name.

    Rows are ranged by session and line, so a session is in few files and one
    that holds most rows is still spread over many. ``files`` is how many at
    most; without it, Spark sizes them.
    """
    spark = fields.sparkSession
    version = f"{batch}-{uuid.uuid4().hex}"
    order = ["session", "thread", "line"]
    ranged = fields.repartitionByRange(files, *order) if files else fields.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(f"{folder}/fields/{version}")
    written = spark.read.schema(fields.schema).parquet(f"{folder}/fields/{version}").select("text", F.col("_metadata.file_path").alias("file"))
    trigram_maps(written).write.parquet(f"{folder}/grams/{version}")
    listed = written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/files/batch={batch}")


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, rows bigint, batch string").parquet(f"{folder}/files")


def _needed(query: str, case_sensitive: bool) -> Column:
    """Trigrams that the lower-cased text of a match holds.

    Where case counts, only those in ASCII: the lower case of other letters may
    depend on the letters around them.
    """
    found = grams(F.lit(query if case_sensitive else query.lower()))
    return F.transform(F.filter(found, lambda g: F.regexp_like(g, F.lit(r"^[\x00-\x7F]*$"))), F.lower) if case_sensitive else found


def may_hold(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """The files that may hold ``query``: all of its trigrams are in their map. Short queries pass every file, an empty one none."""
    files = known_files(spark, folder)
    if not query:
        return files.limit(0)
    bits = spark.range(1).select(F.explode(_needed(query, case_sensitive)).alias("gram")).select(bit_of(F.col("gram")).alias("bit"))
    by_bucket = bits.groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.collect_set(F.col("bit") % BUCKET).alias("places"))
    wanted = {r["bucket"]: r["places"] for r in by_bucket.collect()}  # as many as the query has trigrams
    if not wanted:
        return files
    maps = spark.read.schema("file string, bucket bigint, bits binary").parquet(f"{folder}/grams/*")

    def is_set(place: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", place // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(F.lit(1 << place % 8)) > 0

    def all_set(places: list[int]) -> Column:
        test = F.lit(True)
        for place in sorted(places):
            test = test & is_set(place)
        return test

    held = F.lit(False)
    for bucket, places in wanted.items():
        held = held | ((F.col("bucket") == bucket) & all_set(places))
    passing = maps.where(F.col("bucket").isin(*wanted)).where(held).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return files.join(passing.select("file"), "file", "left_semi")


def read_fields(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The fields of ``files``. Their names go through the driver, as those of any table that Spark reads."""
    paths = [r["file"] for r in files.select("file").collect()]
    return spark.read.schema(FIELDS).parquet(*paths) if paths else spark.createDataFrame([], FIELDS)


def matches(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """``search.matches`` over the files that may hold the query; the result is that over all files."""
    return search.matches(read_fields(spark, may_hold(spark, folder, query, case_sensitive)), query, case_sensitive, wanted)
