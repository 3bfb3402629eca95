"""Telemetry export lines and captured requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.skew import SALTS, hot_keys
from ..functions.times import iso_ms
from ..operators import telemetry
from .files import clear_folder, listed, write_files
from .transcripts import plain_lines, raw_lines

EXPORTED = r"/batch=(\d+)/session=([^/]+)/[^/]+$"
ESCAPED = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"  # as Spark escapes the values of partition folders, which it reads back


def otlp_lines(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Export lines with the session each belongs to."""
    return telemetry.routed(raw_lines(spark, root))


def write_by_session(routed: DataFrame, folder: str, batch: int, lines_per_file: int = 1_000_000) -> None:
    """Write export lines below the batch and one folder per session.

    A batch that is written again replaces its own folder, so a retry adds
    nothing. Lines are dealt by session first: a session has one file, or
    several where it holds much of the batch, and not one per task. Tasks put
    their files in place themselves and take away those of an earlier writing, as
    the driver would do it one by one.
    """
    rows = routed.select("session", "text", F.monotonically_increasing_id().alias("line"))
    hot = hot_keys(rows, ["session"], floor=lines_per_file)
    salt = F.when(F.col("__hot"), F.pmod("line", F.lit(SALTS))).otherwise(0)
    escaped = F.col("session")
    for c in ESCAPED:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name = F.concat(F.lit("session="), escaped, F.lit("/part-"), salt, F.lit(".txt"))
    place = f"{folder}/batch={batch}"
    clear_folder(place, routed.sparkSession)
    write_files(rows.join(F.broadcast(hot), "session", "left").select(name.alias("name"), "line", "text", F.lit("\n").alias("ending")), place)


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, session, text`` of all batches that ``write_by_session`` has written; tasks take both from the path, which spares the driver every folder's name."""
    lines = listed(spark, folder).lines()
    session = F.regexp_extract("path", EXPORTED, 2)
    for _ in range(2):  # Spark shows paths URL-encoded, and the folder's name is escaped
        session = F.url_decode(F.replace(session, F.lit("+"), F.lit("%2B")))
    return lines.select(F.regexp_extract("path", EXPORTED, 1).cast("bigint").alias("batch"), session.alias("session"), "text")


def captures(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Captured exchanges; torn lines are dropped."""
    v = F.col("v")
    rows = jsonx.with_parsed(plain_lines(spark, root)).where(jsonx.is_object(v))
    return rows.select(
        jsonx.string_at(v, "$.sessionId").alias("session"), jsonx.string_at(v, "$.requestId").alias("request_id"), iso_ms(jsonx.string_at(v, "$.startedAt")).alias("started_ms"),
        iso_ms(jsonx.string_at(v, "$.endedAt")).alias("ended_ms"), jsonx.long_at(v, "$.latencyMs").alias("latency_ms"), jsonx.string_at(v, "$.method").alias("method"),
        jsonx.string_at(v, "$.path").alias("url_path"), jsonx.long_at(v, "$.status").alias("status"), jsonx.bool_at(v, "$.isSubagent").alias("is_subagent"),
        jsonx.long_at(v, "$.requestBytes").alias("request_bytes"), jsonx.long_at(v, "$.responseBytes").alias("response_bytes"),
        jsonx.string_at(v, "$.assembledMessage.model").alias("model"), jsonx.string_at(v, "$.error").alias("error"))
