"""Task executions: foreground, background and preview servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.nulls import span_ms
from ..functions.ordered import latest

# Preview server tools.
PREVIEW_START = "mcp__Claude_Preview__preview_start"
PREVIEW_STOP = "mcp__Claude_Preview__preview_stop"
TASK_TOOLS = ["Bash", "Agent", "Task"]
SCOPE = ["session", "thread"]


def launches(details: DataFrame, calls: DataFrame) -> DataFrame:
    """Background launches named by their call's description or command.

    ``details`` has one row per launch record: kind, task_id, description
    (of an async agent), call_id, line, ts_ms.
    """
    v = jsonx.parse(F.col("input"))
    named = calls.select(*SCOPE, "call_id", jsonx.string_at(v, "$.description").alias("__d"), jsonx.string_at(v, "$.command").alias("__c"))
    name = F.when(
        F.col("kind") == "bash", F.coalesce("__d", "__c", F.lit("background command"))
    ).otherwise(F.coalesce("description", "__d", F.lit("subagent")))
    return details.join(named, [*SCOPE, "call_id"], "left").select(
        *SCOPE, "kind", "task_id", "call_id", "line", "ts_ms", name.alias("name")
    )


def note_status(exit_code: Column, status: Column, found: Column) -> Column:
    """An exit code decides, then the status; no notification leaves the task unresolved."""
    return (
        F.when(~found, F.lit("unresolved"))
        .when(exit_code.isNotNull(), F.when(exit_code == 0, F.lit("completed")).otherwise(F.lit("failed")))
        .when(status == "failed", F.lit("failed"))
        .otherwise(F.lit("completed"))
    )


def launch_outcomes(launched: DataFrame, notes: DataFrame) -> DataFrame:
    """Each launch with its last notification."""
    last = latest(notes, [*SCOPE, "task_id"], [F.col("line")], ["line", "status", "exit_code", "ts_ms"])
    last = last.select(
        *SCOPE, "task_id", F.col("line").alias("note_line"), F.col("status").alias("note_status"), "exit_code",
        F.col("ts_ms").alias("note_ts_ms"), F.lit(True).alias("__found"),
    )
    found = F.coalesce(F.col("__found"), F.lit(False))
    return launched.join(last, [*SCOPE, "task_id"], "left").withColumn(
        "status", note_status(F.col("exit_code"), F.col("note_status"), found)
    ).drop("__found")


def foreground(calls: DataFrame, launched: DataFrame) -> DataFrame:
    v = jsonx.parse(F.col("input"))
    name = F.coalesce(*[jsonx.string_at(v, f"$.{k}") for k in ("description", "command", "prompt")], F.col("tool"))
    plain = calls.where(F.col("tool").isin(*TASK_TOOLS)).join(launched.select(*SCOPE, "call_id"), [*SCOPE, "call_id"], "left_anti")
    return plain.select(
        *SCOPE, F.when(F.col("tool") == "Bash", F.lit("bash")).otherwise(F.lit("agent")).alias("kind"), F.lit(False).alias("background"),
        F.col("call_id").alias("task_id"), name.alias("name"),
        F.when(~F.col("has_result"), F.lit("unresolved")).when(F.col("is_error"), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.col("line").alias("start_line"), F.col("ts_ms").alias("start_ts_ms"), F.col("result_line").alias("end_line"), F.col("result_ts_ms").alias("end_ts_ms"),
    )


def background(calls: DataFrame, launched: DataFrame, notes: DataFrame) -> DataFrame:
    # The last launch of a call counts.
    one = latest(launched, [*SCOPE, "call_id"], [F.col("line")], ["kind", "task_id", "name", "ts_ms"])
    outcome = launch_outcomes(one.withColumnRenamed("ts_ms", "launch_ts_ms"), notes)
    body = calls.where(F.col("tool").isin(*TASK_TOOLS)).select(*SCOPE, "call_id", "tool", "line", "ts_ms").join(outcome, [*SCOPE, "call_id"])
    return body.select(
        *SCOPE, F.when(F.col("tool") == "Bash", F.lit("bash")).otherwise(F.lit("agent")).alias("kind"), F.lit(True).alias("background"),
        "task_id", "name", "status", F.col("line").alias("start_line"), F.coalesce("ts_ms", "launch_ts_ms").alias("start_ts_ms"),
        F.col("note_line").alias("end_line"), F.col("note_ts_ms").alias("end_ts_ms"),
    )


def previews(calls: DataFrame) -> DataFrame:
    """Preview servers with the call that stopped them."""
    v = jsonx.parse(F.col("input"))
    server = F.nullif(F.regexp_extract("result_text", r'"serverId":\s*"([^"]+)"', 1), F.lit(""))
    stops = calls.where(F.col("tool") == PREVIEW_STOP).select(*SCOPE, jsonx.string_at(v, "$.serverId").alias("server"), "line", "ts_ms").where("server IS NOT NULL")
    stops = latest(stops, [*SCOPE, "server"], [F.col("line")], ["line", "ts_ms"]).select(
        *SCOPE, "server", F.col("line").alias("end_line"), F.col("ts_ms").alias("end_ts_ms")
    )
    starts = calls.where(F.col("tool") == PREVIEW_START).select(
        *SCOPE, "line", "ts_ms", server.alias("server"), F.coalesce(jsonx.string_at(v, "$.name"), F.lit("preview server")).alias("name")
    )
    return starts.join(stops, [*SCOPE, "server"], "left").select(
        *SCOPE, F.lit("preview-server").alias("kind"), F.lit(True).alias("background"),
        F.coalesce("server", F.concat(F.lit("preview:"), F.col("line").cast("string"))).alias("task_id"), "name",
        F.when(F.col("end_line").isNotNull(), F.lit("stopped")).otherwise(F.lit("unresolved")).alias("status"),
        F.col("line").alias("start_line"), F.col("ts_ms").alias("start_ts_ms"), "end_line", "end_ts_ms",
    )


def executions(calls: DataFrame, launched: DataFrame, notes: DataFrame) -> DataFrame:
    every = foreground(calls, launched).unionByName(background(calls, launched, notes)).unionByName(previews(calls))
    return every.withColumn("duration_ms", span_ms(F.col("start_ts_ms"), F.col("end_ts_ms")))


def notification_entries(notes: DataFrame, launched: DataFrame, calls: DataFrame) -> DataFrame:
    """Notifications with the name, start line and duration of what they report on."""
    first = latest(launched, [*SCOPE, "task_id"], [F.col("line")], ["name", "call_id", "line", "ts_ms"]).select(
        *SCOPE, "task_id", "name", "call_id", F.col("line").alias("launch_line"), F.col("ts_ms").alias("launch_ts_ms")
    )
    start = calls.select(*SCOPE, "call_id", F.col("line").alias("call_line"), F.col("ts_ms").alias("call_ts_ms"))
    return notes.join(first, [*SCOPE, "task_id"], "left").join(start, [*SCOPE, "call_id"], "left").select(
        *SCOPE, "line", "ts_ms", "task_id", "status", "exit_code", "name",
        F.coalesce("call_line", "launch_line").alias("start_line"),
        span_ms(F.coalesce("call_ts_ms", "launch_ts_ms"), F.col("ts_ms")).alias("duration_ms"),
    )
