"""Shuffle partitions follow the size of the tables."""

from trailmarts.catalog.registry import Tables
from trailmarts.session import INITIAL_PARTITIONS, PART_BYTES, fit_partitions


def test_partitions_follow_the_size_of_the_tables(spark, tmp_path):
    spark.conf.unset(INITIAL_PARTITIONS)
    try:
        spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "small.parquet"))
        Tables(spark, str(tmp_path)).raw("small")
        assert spark.conf.get(INITIAL_PARTITIONS, None) is None
        (tmp_path / "large.parquet").mkdir()
        for i in range(10):  # files of size, listed like tables; reading the schema needs one that is whole
            spark.range(600_000 * i, 600_000 * (i + 1)).selectExpr("xxhash64(id) AS x").coalesce(1).write.mode("append").parquet(str(tmp_path / "large.parquet"))
        size = sum(p.stat().st_size for p in (tmp_path / "large.parquet").glob("*.parquet"))
        Tables(spark, str(tmp_path)).raw("large")
        assert int(spark.conf.get(INITIAL_PARTITIONS)) == -(-size // PART_BYTES) > 4
        fit_partitions(spark, 1)
        assert int(spark.conf.get(INITIAL_PARTITIONS)) == -(-size // PART_BYTES)
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
