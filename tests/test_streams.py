"""Streams over many sessions and slices of several files."""

import time
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from trailmarts.catalog import q_streaming
from trailmarts.catalog.registry import QUERIES, Tables
from trailmarts.operators import records_b, usage
from trailmarts.session import shared_dir
from trailmarts.streaming import jobs


def test_slices_of_several_files_come_one_to_a_batch(spark, tmp_path, monkeypatch):
    """One task wrote a slice as one file, however large; now it has a file for every FILE_ROWS."""
    spark.range(4000).selectExpr("id AS at", "id % 7 AS x").write.parquet(str(tmp_path / "numbers.parquet"))
    monkeypatch.setattr(q_streaming.Streamed, "FILE_ROWS", 200, raising=False)
    streamed = q_streaming.Streamed(Tables(spark, str(tmp_path)), "numbers", "at")
    files = spark.read.parquet(streamed.parts).inputFiles()
    assert len(files) == 4 * streamed.files and streamed.files == 4
    jobs.run_available(streamed.raw("numbers"), str(tmp_path / "job"))
    got = jobs.output(spark, str(tmp_path / "job")).withColumn("late", F.col("at") % 10 == 7)
    slices = got.where("NOT late").groupBy("batch").agg(F.min(F.expr("at div 1000")).alias("low"), F.max(F.expr("at div 1000")).alias("top"))
    assert rows(slices, "batch", "low", "top") == [(0, 1, 1), (1, 0, 0), (2, 2, 2), (3, 3, 3)]
    assert got.count() == 4000 == got.select("at").distinct().count()


def test_counts_of_many_sessions_are_taken_in_groups(spark, tmp_path):
    """The calls of a batch grew with the sessions."""
    names = records_b.COUNTERS
    for batch in range(3):
        made = spark.range(900).selectExpr(
            "concat('s', id % 300) AS session", f"{batch * 3} + id div 300 AS line", f"86400000 + ({batch * 3} + id div 300) * 60000L AS ts_ms", "true AS has_info",
            *(f"CASE WHEN id % 5 = 0 AND '{c}' = 'output_tokens' THEN NULL ELSE (id % 300 + {batch}) END AS total_{c}" for c in names),
            *(f"CASE WHEN id % 2 = 0 THEN NULL ELSE 9007199254740993L END AS last_{c}" for c in names))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.range(1).selectExpr("'end' AS session", "1L AS line", "99999999999L AS ts_ms", "true AS has_info", *(f"1L AS total_{c}" for c in names), *(f"1L AS last_{c}" for c in names)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = jobs.run_available(jobs.counter_deltas(stream, "1 minute", groups=4), str(tmp_path / "job"), rocksdb=True)
    assert 1 <= max(kept) <= 4 and kept[-1] == 1
    want = {(f"s{s}", batch * 3, None if (s % 2 == 0) else 0, None if s % 2 == 0 else 9007199254740993, s + batch) for s in range(300) for batch in range(3)}
    assert {tuple(r) for r in jobs.output(spark, str(tmp_path / "job")).drop("batch").collect()} == want


def shuffled_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}


def test_a_stream_of_messages_leaves_only_its_rows_on_disk(spark, tmp_path):
    """The input lay there twice, with all that the batches shuffled, every version of the state and the last checkpoint."""
    spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id + 0.25 AS DOUBLE) AS l_extendedprice",
        "0.05D AS l_discount", "element_at(array('A', 'N', 'R'), CAST(id % 3 + 1 AS INT)) AS l_returnflag", "CAST(DATE '2020-01-01' + CAST(id % 397 AS INT) AS TIMESTAMP_NTZ) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(7).selectExpr("id AS p_partkey", "concat('Brand#', id) AS p_brand", "CAST(id AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    shared, shuffled = Path(shared_dir(spark).removeprefix("file://")), shuffled_files(spark)
    before = set(shared.iterdir()) if shared.exists() else set()
    found = QUERIES["stream_message_dedup"](spark, str(tmp_path))
    for _ in range(50):
        if not (left := shuffled_files(spark) - shuffled):
            break
        time.sleep(0.2)
    kept = {p.relative_to(x).parts[0] for x in set(shared.iterdir()) - before for p in x.rglob("*") if p.is_file()}
    got = rows(found)
    assert kept == {"out"} and len({n.split("_")[1] for n in left}) < 3  # of one-row totals
    assert got == rows(Tables(spark, str(tmp_path)).messages.select(*found.columns)) and len(got) > 1500


def test_first_line_and_last_usage_of_odd_snapshots(spark, tmp_path):
    """Lines and usage that are missing take no part; state holds a line number once."""
    names = [*usage.USAGE]
    schema = "session string, thread string, message_id string, line bigint, model string, ts_ms bigint, has_usage boolean, " + ", ".join(f"{c} bigint" for c in names)
    made = [("s", "m", "a", None, "none", 5, True, 9), ("s", "m", "a", 3, None, None, True, 7), ("s", "m", "a", 2, "two", 6, None, 8), ("s", "m", "b", None, "x", 5, True, 1), ("s", "m", "a", 4, "four", 7, True, None), ("s", "m", "a", 5, "five", 8, False, 6)]
    for at in range(3):
        spark.createDataFrame([(*r[:7], *[r[7]] * len(names)) for r in made[at * 2 : at * 2 + 2]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.message_updates(stream, "5 days"), str(tmp_path / "job"), "update", rocksdb=True)
    days = jobs.latest_per_key(jobs.output(spark, str(tmp_path / "job")), ["session", "thread", "message_id", "day_ms"])
    assert rows(days, "message_id", "line", "model", "ts_ms", "usage_line", "input_tokens") == [("a", 2, "two", 6, 4, None), ("b", None, None, None, None, None)]
