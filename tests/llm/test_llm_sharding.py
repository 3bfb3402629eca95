import zlib

import pytest
from llm_cases import awkward_rows, collected, docs_frame

from trailmarts.llm import sharding


@pytest.mark.parametrize("bucket", [16 << 20, 3000])
def test_rows_law_and_slots(spark, bucket):
    rows = [*awkward_rows(2, 200), (None, "no id"), (None, None), (12, "twice"), (12, "twice")]
    df = docs_frame(spark, rows)
    found = sharding.report(df, bucket_bytes=bucket).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = {}
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.report(df.repartition(7), bucket_bytes=bucket)
    assert collected(again, "doc_id", "shard", "slot") == sorted(((r.doc_id, r.shard, r.slot) for r in found), key=repr)


def test_order_is_mixed_and_follows_the_seed(spark):
    df = docs_frame(spark, [(i, f"t{i}") for i in range(4800)])
    a, b = ({r.doc_id: r.shard * 200 + r.slot for r in sharding.report(df, seed=s).collect()} for s in (1, 2))
    assert a != b
    assert abs(sum((i - 2399.5) * (a[i] - 2399.5) for i in a)) / sum((i - 2399.5) ** 2 for i in a) < 0.08
    neighbours = sum(abs(a[i] - a[i + 1]) < 100 for i in range(4799))
    assert neighbours < 400  # about 200 by chance


def test_shards_are_written_with_all_columns(spark, tmp_path):
    df = docs_frame(spark, awkward_rows())
    sharding.scatter(df, shards=5).write.partitionBy("shard").parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collected(back.select("rest.*", "body")) == collected(df.select(*(c for c in df.columns if c != "text"), "text"))


def test_no_documents(spark):
    assert sharding.report(docs_frame(spark, [])).collect() == []
