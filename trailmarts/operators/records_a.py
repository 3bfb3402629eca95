"""Format A transcripts: raw JSON lines to one wide record table, and the event tables cut from it.

Every field is optional except the type. The wide table names only plain
columns and arrays of structs, so a reader of few columns parses few fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.ordered import top_rows
from ..functions.times import iso_ms
from .usage import USAGE

KEYS = ["session", "thread", "line"]
# Marks of injected listings.
AGENT_LISTING = (
    "<system-reminder>\nAvailable agent types for the Agent tool:\n",
    "\n\nWhen you launch multiple agents for independent work, send them in a single message with multiple tool uses"
    " so they run concurrently.\n</system-reminder>",
)
SKILL_LISTING = (
    "<system-reminder>\nThe following skills are available for use with the Skill tool:\n\n", "\n</system-reminder>\n",
)


def parsed(raw: DataFrame) -> DataFrame:
    """Non-blank lines with their JSON value and record type."""
    return jsonx.with_parsed(raw.where(F.trim("text") != "")).withColumn("type", jsonx.string_at(F.col("v"), "$.type"))


def warnings(raw: DataFrame) -> DataFrame:
    """Lines that are not JSON, or have no record type."""
    bad = parsed(raw).where("type IS NULL")
    reason = F.when(F.col("v").isNull(), F.lit("malformed JSON")).otherwise(F.lit("missing record type"))
    return bad.select(*KEYS, reason.alias("reason"))


def _note(text: Column, field: str) -> Column:
    """One field of a task notification, NULL when the text holds none."""
    found = text.contains("<task-notification>") & (F.regexp_extract(text, "<task-id>([^<]+)</task-id>", 1) != "")
    pattern = {"task": "<task-id>([^<]+)</task-id>", "status": "<status>([^<]+)</status>", "exit": r"(?i)exit code (\d+)"}[field]
    return F.when(found, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def _blocks(content: Column) -> Column:
    """Text, thinking and tool-use blocks of an assistant message, in order."""
    text = F.lit(None).cast("string")

    def block(b, i):
        kind = jsonx.string_at(b, "$.type")
        body = F.when(kind == "text", jsonx.string_at(b, "$.text")).when(kind == "thinking", F.coalesce(jsonx.string_at(b, "$.thinking"), F.lit("")))
        use = kind == "tool_use"
        return F.struct(
            i.cast("int").alias("pos"), kind.alias("kind"), body.alias("text"), F.when(use, jsonx.string_at(b, "$.id")).otherwise(text).alias("call_id"),
            F.when(use, jsonx.string_at(b, "$.name")).alias("name"), F.when(use, F.coalesce(F.to_json(jsonx.at(b, "$.input")), F.lit("null"))).alias("input"),
        )

    every = F.transform(F.try_variant_get(content, "$", "array<variant>"), block)
    keep = lambda b: (b["kind"].isin("text", "thinking") & b["text"].isNotNull()) | (b["call_id"].isNotNull() & b["name"].isNotNull())
    return F.filter(every, keep)


def _results(content: Column) -> Column:
    """Tool results of a user record, in order."""

    def result(b, i):
        body = jsonx.text_of(jsonx.at(b, "$.content"))
        return F.struct(
            i.cast("int").alias("pos"), jsonx.string_at(b, "$.type").alias("kind"), jsonx.string_at(b, "$.tool_use_id").alias("call_id"),
            F.coalesce(jsonx.bool_at(b, "$.is_error"), F.lit(False)).alias("is_error"), body.alias("text"),
        )

    every = F.transform(F.try_variant_get(content, "$", "array<variant>"), result)
    return F.filter(every, lambda b: b["kind"] == "tool_result")


def records(raw: DataFrame) -> DataFrame:
    v = F.col("v")
    base = parsed(raw).where("type IS NOT NULL")
    s = lambda path: jsonx.string_at(v, path)
    n = lambda path: jsonx.long_at(v, path)
    user, assistant, system = F.col("type") == "user", F.col("type") == "assistant", F.col("type") == "system"
    content = F.col("__content")
    first = jsonx.computed_once(base, {
        "__content": jsonx.at(v, "$.message.content"), "__usage": jsonx.at(v, "$.message.usage"),
        "__detail": jsonx.at(v, "$.toolUseResult"), "__attachment": jsonx.at(v, "$.attachment"), "subtype": F.when(system, s("$.subtype")),
    })
    staged = jsonx.computed_once(first, {
        "results": F.when(user & jsonx.is_array(content), _results(content)),
        "blocks": F.when(assistant & jsonx.is_array(content), _blocks(content)),
        "__text": F.when(user, jsonx.text_of(content)), "has_usage": assistant & jsonx.is_object(F.col("__usage")),
        "timestamp": F.coalesce(s("$.timestamp"), F.when(F.col("type") == "attachment", s("$.attachment.timestamp"))),
    })
    queued = jsonx.string_at(F.col("__attachment"), "$.type") == "queued_command"
    carrier = F.coalesce(F.size("results") > 0, F.lit(False))
    note_text = (
        F.when(user & ~carrier, F.col("__text")).when(F.col("type") == "queue-operation", s("$.content"))
        .when((F.col("type") == "attachment") & queued, jsonx.string_at(F.col("__attachment"), "$.prompt"))
    )
    u = lambda path: F.when(F.col("has_usage"), F.coalesce(jsonx.long_at(F.col("__usage"), path), F.lit(0)))
    w = lambda path: F.when(F.col("has_usage"), jsonx.long_at(F.col("__usage"), path))
    d = lambda path: jsonx.string_at(F.col("__detail"), path)
    is_async = d("$.status") == "async_launched"
    prompt = F.when(user & ~carrier & (F.col("__text") != "") & F.col("note_task").isNull(), F.col("__text"))
    kind = jsonx.string_at(F.col("__attachment"), "$.type")
    lines = F.array_join(F.try_variant_get(F.col("__attachment"), "$.addedLines", "array<string>"), "\n")
    listing = (
        F.when(kind == "agent_listing_delta", F.concat(F.lit(AGENT_LISTING[0]), lines, F.lit(AGENT_LISTING[1])))
        .when(kind == "skill_listing", F.concat(F.lit(SKILL_LISTING[0]), jsonx.string_at(F.col("__attachment"), "$.content"), F.lit(SKILL_LISTING[1])))
    )
    title = (
        F.when(F.col("type") == "ai-title", s("$.aiTitle")).when(F.col("type") == "custom-title", F.coalesce(s("$.customTitle"), s("$.title")))
        .when(F.col("type") == "summary", s("$.summary"))
    )
    compact, failed = F.col("subtype") == "compact_boundary", F.col("subtype") == "api_error"
    noted = jsonx.computed_once(staged, {"__note": note_text})
    told = F.col("__note")
    fields = {"note_task": _note(told, "task"), "note_status": _note(told, "status"), "note_exit": _note(told, "exit").cast("bigint")}
    return jsonx.computed_once(noted, fields).select(
        *KEYS, "type", "subtype", s("$.uuid").alias("uuid"), s("$.parentUuid").alias("parent_uuid"), "timestamp", iso_ms(F.col("timestamp")).alias("ts_ms"),
        jsonx.bool_at(v, "$.isSidechain").alias("is_sidechain"), s("$.cwd").alias("cwd"), s("$.version").alias("version"), s("$.gitBranch").alias("git_branch"),
        s("$.agentId").alias("agent_id"), F.when(assistant, s("$.requestId")).alias("request_id"), F.when(assistant, s("$.message.id")).alias("message_id"),
        F.when(assistant, s("$.message.model")).alias("model"), F.when(assistant, s("$.message.stop_reason")).alias("stop_reason"), "has_usage",
        u("$.input_tokens").alias("input_tokens"), u("$.output_tokens").alias("output_tokens"), u("$.cache_read_input_tokens").alias("cache_read_tokens"),
        u("$.cache_creation_input_tokens").alias("cache_write_tokens"), w("$.cache_creation.ephemeral_5m_input_tokens").alias("cache_write_5m_tokens"),
        w("$.cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h_tokens"), "blocks", "results",
        (user & F.coalesce(jsonx.bool_at(v, "$.isMeta"), F.lit(False))).alias("is_meta"),
        (user & F.coalesce(jsonx.bool_at(v, "$.isCompactSummary"), F.lit(False))).alias("is_compact_summary"),
        prompt.alias("prompt_text"), "note_task", "note_status", "note_exit",
        F.when(user, d("$.backgroundTaskId")).alias("background_task"), F.when(user, d("$.agentId")).alias("result_agent"),
        F.when(user & is_async, d("$.agentId")).alias("async_agent"), F.when(user & is_async, d("$.description")).alias("async_description"),
        title.alias("title"),
        F.when(compact, s("$.compactMetadata.trigger")).alias("trigger"), F.when(compact, n("$.compactMetadata.preTokens")).alias("pre_tokens"),
        F.when(compact, n("$.compactMetadata.postTokens")).alias("post_tokens"), F.when(failed, n("$.retryAttempt")).alias("retry_attempt"),
        F.when(failed, F.coalesce(s("$.error.formatted"), s("$.error.message"))).alias("error_message"),
        F.when(failed, F.coalesce(n("$.error.status"), n("$.status"))).alias("error_status"), listing.alias("listing"),
        F.when(listing.isNotNull(), F.when(kind == "skill_listing", F.lit("skill-listing")).otherwise(F.lit("agent-listing"))).alias("listing_kind"),
    )


def message_snapshots(raw: DataFrame) -> DataFrame:
    """Message snapshots straight from raw lines, reading only their fields."""
    v = F.col("v")
    has = jsonx.is_object(jsonx.at(v, "$.message.usage"))
    n = lambda path: F.when(has, jsonx.long_at(v, f"$.message.usage.{path}"))
    z = lambda path: F.when(has, F.coalesce(jsonx.long_at(v, f"$.message.usage.{path}"), F.lit(0)))
    rows = parsed(raw).where("type = 'assistant'").select(
        *KEYS, jsonx.string_at(v, "$.message.id").alias("message_id"), jsonx.string_at(v, "$.message.model").alias("model"),
        iso_ms(jsonx.string_at(v, "$.timestamp")).alias("ts_ms"), has.alias("has_usage"), z("input_tokens").alias("input_tokens"),
        z("output_tokens").alias("output_tokens"), z("cache_read_input_tokens").alias("cache_read_tokens"),
        z("cache_creation_input_tokens").alias("cache_write_tokens"), n("cache_creation.ephemeral_5m_input_tokens").alias("cache_write_5m_tokens"),
        n("cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h_tokens"))
    return rows.where("message_id IS NOT NULL")


def snapshots(rec: DataFrame) -> DataFrame:
    return rec.where("type = 'assistant' AND message_id IS NOT NULL").select(*KEYS, "message_id", "model", "ts_ms", "has_usage", *USAGE)


def tool_calls(rec: DataFrame) -> DataFrame:
    return rec.where("type = 'assistant'").select(*KEYS, "message_id", "request_id", "ts_ms", F.explode("blocks").alias("b")).where("b.kind = 'tool_use'").select(
        *KEYS, F.col("b.pos").alias("block"), "message_id", "request_id", "ts_ms", F.col("b.call_id").alias("call_id"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"))


def tool_results(rec: DataFrame) -> DataFrame:
    return rec.where("type = 'user'").select("session", "thread", F.col("line").alias("result_line"), F.col("ts_ms").alias("result_ts_ms"), F.explode("results").alias("b")).where(
        "b.call_id IS NOT NULL").select(
        "session", "thread", "result_line", "result_ts_ms", F.col("b.pos").alias("result_block"), F.col("b.call_id").alias("call_id"), F.col("b.is_error").alias("is_error"),
        F.col("b.text").alias("result_text"), F.length("b.text").cast("bigint").alias("result_chars"))


def prompts(rec: DataFrame) -> DataFrame:
    """What the user typed: not meta, not a summary, not a notification, not a result carrier."""
    return rec.where("type = 'user' AND prompt_text IS NOT NULL AND NOT is_meta AND NOT is_compact_summary").select(*KEYS, "ts_ms", F.col("prompt_text").alias("text"))


def user_texts(rec: DataFrame, meta: bool = False) -> DataFrame:
    hits = rec.where("type = 'user' AND prompt_text IS NOT NULL")
    return (hits.where("is_meta") if meta else hits).select(*KEYS, "ts_ms", F.col("prompt_text").alias("text"))


def notifications(rec: DataFrame) -> DataFrame:
    return rec.where("note_task IS NOT NULL").select(
        *KEYS, "ts_ms", F.col("note_task").alias("task_id"), F.col("note_status").alias("status"), F.col("note_exit").alias("exit_code"))


def launch_details(rec: DataFrame) -> DataFrame:
    """Background commands and asynchronous agents announced by a tool result."""
    call = F.get("results", F.lit(0))["call_id"].alias("call_id")
    hits = rec.where("type = 'user'")
    shell = hits.where("background_task IS NOT NULL").select(*KEYS, "ts_ms", F.lit("bash").alias("kind"), F.col("background_task").alias("task_id"), F.lit(None).cast("string").alias("description"), call)
    agent = hits.where("async_agent IS NOT NULL").select(*KEYS, "ts_ms", F.lit("agent").alias("kind"), F.col("async_agent").alias("task_id"), F.col("async_description").alias("description"), call)
    return shell.unionByName(agent)


def result_agents(rec: DataFrame) -> DataFrame:
    call = F.get("results", F.lit(0))["call_id"]
    return rec.where("result_agent IS NOT NULL").select("session", F.col("result_agent").alias("agent"), call.alias("call_id"), "line").where("call_id IS NOT NULL")


def compactions(rec: DataFrame) -> DataFrame:
    return rec.where("subtype = 'compact_boundary'").select(*KEYS, "ts_ms", "trigger", "pre_tokens", "post_tokens")


def api_errors(rec: DataFrame) -> DataFrame:
    return rec.where("subtype = 'api_error'").select(
        *KEYS, "ts_ms", F.col("error_status").alias("status"), "retry_attempt", F.col("error_message").alias("message"))


def api_error_list(errors: DataFrame, cap: int | None = None) -> DataFrame:
    """The errors of each thread in order (the first ``cap``, if given) with the exact number of all."""
    counts = errors.groupBy("session", "thread").agg(F.count(F.lit(1)).alias("errors"))
    return top_rows(errors, ["session", "thread"], [F.col("line")], cap).join(counts, ["session", "thread"])


def headers(rec: DataFrame, keys=("session",)) -> DataFrame:
    """First and last time, first directory, branch and version, last custom or else last generated title."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("line"))
    own = lambda t: F.max_by("title", F.when((F.col("type") == t) & F.col("title").isNotNull(), F.col("line")))
    return rec.groupBy(*keys).agg(
        F.min_by("ts_ms", known("ts_ms")).alias("first_ts_ms"), F.max_by("ts_ms", known("ts_ms")).alias("last_ts_ms"),
        F.min_by("cwd", known("cwd")).alias("cwd"), F.min_by("git_branch", known("git_branch")).alias("git_branch"), F.min_by("version", known("version")).alias("version"),
        F.coalesce(own("custom-title"), own("ai-title")).alias("title"),
    )


def rest_state(rec: DataFrame) -> DataFrame:
    """Whether a thread's last user or assistant record ended its turn."""
    last = F.max_by(F.struct("type", "stop_reason"), "line")
    return rec.where("type IN ('user', 'assistant')").groupBy("session", "thread").agg(last.alias("l")).select(
        "session", "thread", F.coalesce((F.col("l.type") == "assistant") & (F.col("l.stop_reason") == "end_turn"), F.lit(False)).alias("ends_at_rest"))


def injected_listings(rec: DataFrame) -> DataFrame:
    return rec.where("listing IS NOT NULL").select(*KEYS, F.col("listing_kind").alias("kind"), F.col("listing").alias("text"))
