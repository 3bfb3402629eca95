"""Search and drill-downs over written files: the same results as without them, and less read."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailmarts.operators import search
from trailmarts.sources import record_files, search_files

COLUMNS = ["session", "thread", "line", "field", "occurrences", "snippet"]


def as_fields(spark, texts):
    data = [(f"s{i // 4:02}", "main", i, None, 0, "user", text, None) for i, text in enumerate(texts)]
    return spark.createDataFrame(data, search_files.FIELDS)


def letters(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [letters(rng, "abcdefgh ", 60) for _ in range(90)]
    long = letters(rng, "xyz", 3 * search_files.PIECE)
    edge = search_files.PIECE
    return out + [
        "Needle in Hay", "NEEDLE", "naïve CAFÉ", "ΟΔΟΣ ΟΔΟΣ", "a😀b😀c", "", "ab", None, "quote \" and \\ and\nbreak",
        long, long[: edge - 2] + "QRSTUV" + long[edge:], letters(rng, "mn", 2 * edge),
    ]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("search"))
    search_files.write_batch(as_fields(spark, texts), place, "one", files=12)
    return place


@pytest.mark.parametrize("query", ["needle", "Needle", "café", "οδος", "ΟΔΟΣ", "😀b", "qrstuv", "and\nbreak", "ab", "a", "abc", "xyzzy", "absent words", '" and \\', ""])
@pytest.mark.parametrize("case_sensitive", [False, True])
def test_skipping_files_loses_no_match(spark, texts, folder, query, case_sensitive):
    want = search.matches(as_fields(spark, texts), query, case_sensitive)
    got = search_files.matches(spark, folder, query, case_sensitive)
    assert rows(got, *COLUMNS) == rows(want, *COLUMNS)


def test_files_are_skipped(spark, texts, folder):
    every = search_files.known_files(spark, folder)
    assert every.count() > 6 and every.agg(F.sum("rows")).first()[0] == len(texts)
    holding = search_files.read_fields(spark, every).where(F.lower("text").contains("needle")).select(F.col("_metadata.file_path")).distinct().count()
    assert search_files.may_hold(spark, folder, "needle").count() == holding < every.count()
    assert search_files.may_hold(spark, folder, "absent words").count() == 0
    assert search_files.may_hold(spark, folder, "ab").count() == every.count()


def test_a_batch_written_again_or_not_to_its_end(spark, tmp_path):
    place = str(tmp_path)
    search_files.write_batch(as_fields(spark, ["first batch"]), place, "one")
    search_files.write_batch(as_fields(spark, ["second batch"]), place, "two")
    search_files.write_batch(as_fields(spark, ["first again"]), place, "one")
    as_fields(spark, ["lost batch"]).write.parquet(f"{place}/fields/three-0")
    assert rows(search_files.matches(spark, place, "batch"), "snippet") == [("second batch",)]
    assert rows(search_files.matches(spark, place, "first"), "snippet") == [("first again",)]
    search_files.write_batch(as_fields(spark, []), place, "two")
    assert rows(search_files.matches(spark, place, "batch"), "snippet") == []


def scanned(df):
    """Rows that the scan of a plan without adaptive execution has given after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_drill_downs_read_few_row_groups(spark, tmp_path):
    place = str(tmp_path / "records")
    n = 60_000
    # Half of the rows are one session.
    table = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 89).cast("string"))).alias("session"), F.col("id").alias("line"),
        F.sha2(F.col("id").cast("string"), 256).alias("call_id"), F.repeat(F.col("id").cast("string"), 40).alias("text"))
    record_files.write_clustered(table, place, files=8, row_group=1 << 18)
    wanted = table.where("line = 31234").first()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned(spark.read.parquet(place)) == n
        for one in (record_files.at_line(spark, place, "hot", 31234), record_files.by_value(spark, place, "call_id", wanted["call_id"])):
            assert scanned(one.select("session", "line", "call_id", "text")) <= n // 8
            assert one.collect() == [wanted]
        assert scanned(record_files.by_value(spark, place, "call_id", "not there")) <= n // 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bits_of_a_file_are_distinct_before_its_maps_are_sorted(spark):
    """Every trigram of a file's text was sorted, so the memory of a task grew with the text."""
    texts = spark.range(2000).selectExpr("concat('f', id % 2) AS file", "repeat(concat('abc', id % 5), 50) AS text")
    maps = search_files.trigram_maps(texts)
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and plan.index("SortAggregate") < plan.index("HashAggregate(keys=[file")
    bits = texts.selectExpr("file", f"explode(transform(sequence(1, length(text) - 2), i -> pmod(xxhash64(substr(text, i, 3)), {search_files.BITS}))) AS bit").distinct()
    assert rows(maps.groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("n")), "file", "n") == rows(bits.groupBy("file").count(), "file", "count")
