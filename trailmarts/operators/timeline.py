"""Timelines of a session: ordered entries of eight kinds, visibility, counts, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonx, text
from . import records_a, records_b, tasks, tools

SHOWN_CHARS = 2_000
ELIDE_OVER, ANCHORS = 16, 6
LAUNCH_TOOLS = ["Agent", "Task"]
MINIMAL = ["user", "assistant-text", "subagent-launch", "compaction"]
COLUMNS = ["session", "thread", "line", "block", "ts_ms", "kind", "text", "model", "tool", "call_id", "status", "duration_ms", "result_line", "agent", "cost", "output_tokens"]


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        padded = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])
        out = padded if out is None else out.unionByName(padded)
    return out


TYPES = {"line": "bigint", "block": "int", "ts_ms": "bigint", "duration_ms": "bigint", "result_line": "bigint", "cost": "double", "output_tokens": "bigint"}


def shown(entries: DataFrame, chars: int = SHOWN_CHARS) -> DataFrame:
    """Entries with their texts cut for display."""
    return entries.withColumn("text", text.clip(F.col("text"), chars))


def usage_badges(rec: DataFrame) -> DataFrame:
    """The last text block of every message, the one that shows the message's usage."""
    texts = rec.where("type = 'assistant' AND message_id IS NOT NULL").select("session", "thread", "message_id", "line", F.explode("blocks").alias("b")).where("b.kind = 'text'")
    return texts.groupBy("session", "thread", "message_id").agg(F.max(F.struct("line", F.col("b.pos").alias("block"))).alias("at")).select(
        "session", "thread", "message_id", "at.line", "at.block")


def entries_a(rec: DataFrame, calls: DataFrame, notes: DataFrame, launched: DataFrame, costed: DataFrame, threads: DataFrame, thread_costs: DataFrame) -> DataFrame:
    """Entries of a format A transcript in record order.

    ``calls`` carry status and duration; ``threads`` link launching calls to
    agents, ``thread_costs`` hold each agent's own cost.
    """
    keys = ["session", "thread", "line"]
    blocks = rec.where("type = 'assistant'").select(*keys, "ts_ms", "message_id", "model", F.explode("blocks").alias("b"))
    user = records_a.prompts(rec).select(*keys, F.lit(0).alias("block"), "ts_ms", F.lit("user").alias("kind"), F.col("text"))
    badge = usage_badges(rec).withColumn("__badge", F.lit(True))
    cost = costed.select("session", "thread", "message_id", "cost", "output_tokens")
    said = (
        blocks.where("b.kind = 'text'").select(*keys, F.col("b.pos").alias("block"), "ts_ms", "message_id", "model", F.col("b.text").alias("text"))
        .join(badge, ["session", "thread", "message_id", "line", "block"], "left").join(cost, ["session", "thread", "message_id"], "left")
        .withColumns({"cost": F.when(F.col("__badge") & F.col("model").isNotNull(), F.col("cost")), "output_tokens": F.when(F.col("__badge"), F.col("output_tokens")), "kind": F.lit("assistant-text")})
    )
    thought = blocks.where("b.kind = 'thinking'").select(
        *keys, F.col("b.pos").alias("block"), "ts_ms", "model", F.lit("thinking").alias("kind"), F.col("b.text").alias("text"))
    linked = threads.select("session", F.col("tool_use_id").alias("call_id"), "agent").where("call_id IS NOT NULL").join(thread_costs, ["session", "agent"], "left")
    used = tools.with_status(calls).select(*keys, "block", "ts_ms", "tool", "call_id", "status", "duration_ms", "result_line", "input").join(linked, ["session", "call_id"], "left")
    launches = F.col("tool").isin(*LAUNCH_TOOLS) | F.col("agent").isNotNull()
    used = used.withColumns({
        "kind": F.when(launches, F.lit("subagent-launch")).otherwise(F.lit("tool-call")),
        "text": F.when(launches, jsonx.string_at(jsonx.parse(F.col("input")), "$.description")).otherwise(text.input_summary(F.col("input"))),
    })
    told = tasks.notification_entries(notes, launched, calls).select(
        *keys, F.lit(0).alias("block"), "ts_ms", F.lit("task-notification").alias("kind"), F.col("name").alias("text"), "status", "duration_ms")
    packed = records_a.compactions(rec).select(*keys, F.lit(0).alias("block"), "ts_ms", F.lit("compaction").alias("kind"), F.col("trigger").alias("text"))
    failed = records_a.api_errors(rec).select(*keys, F.lit(0).alias("block"), "ts_ms", F.lit("api-error").alias("kind"), F.col("message").alias("text"))
    return _stack([user, said, thought, used, told, packed, failed])


def entries_b(rec: DataFrame, calls: DataFrame, **chunking) -> DataFrame:
    """Entries of a format B rollout; assistant entries carry the running model."""
    keys = ["session", "line"]
    main = F.lit("main").alias("thread")
    modelled = records_b.with_model(rec, **chunking)
    user = records_b.prompts(rec).select(*keys, main, "ts_ms", F.lit("user").alias("kind"), F.col("text"))
    said = modelled.where("type = 'event_msg' AND kind = 'agent_message' AND text <> ''").select(
        *keys, main, "ts_ms", "model", F.lit("assistant-text").alias("kind"), F.col("text"))
    thought = modelled.where("type = 'response_item' AND kind = 'reasoning'").select(
        *keys, main, "ts_ms", "model", F.lit("thinking").alias("kind"), F.col("text"))
    used = calls.select(
        *keys, main, "ts_ms", "tool", "call_id", "status", F.when(F.col("result_ts_ms") >= F.col("ts_ms"), F.col("result_ts_ms") - F.col("ts_ms")).alias("duration_ms"),
        "result_line", F.lit("tool-call").alias("kind"), F.col("input_summary").alias("text"))
    searched = rec.where("kind = 'web_search_call'").select(
        *keys, main, "ts_ms", F.lit("web_search").alias("tool"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("call_id"), F.lit("tool-call").alias("kind"),
        F.when(F.col("status") == "failed", F.lit("error")).otherwise(F.lit("ok")).alias("status"), text.clip_line(F.coalesce("query", F.lit("")), 120).alias("text"))
    packed = rec.where(F.col("kind").isin(*records_b.COMPACTIONS) | (F.col("type") == "compacted")).select(*keys, main, "ts_ms", F.lit("compaction").alias("kind"))
    return _stack([user, said, thought, used, searched, packed]).withColumn("block", F.coalesce("block", F.lit(0)))


def chip(kind, status):
    """The filter chip an entry belongs to; failed calls and API errors share one."""
    return (
        F.when((kind == "tool-call") & (status == "error"), F.lit("error")).when(kind == "api-error", F.lit("error"))
        .when(kind.isin("tool-call", "task-notification"), F.lit("tool")).when(kind == "assistant-text", F.lit("assistant"))
        .when(kind == "subagent-launch", F.lit("subagent")).otherwise(kind))


def visible(entries: DataFrame, dial: str = "full", chips: list[str] | None = None) -> DataFrame:
    out = entries
    if dial == "user-only":
        out = out.where("kind = 'user'")
    elif dial == "minimal":
        out = out.where(F.col("kind").isin(*MINIMAL))
    if chips is not None:
        out = out.where(chip(F.col("kind"), F.col("status")).isin(*chips))
    return out


def chip_counts(entries: DataFrame, keys=("session",)) -> DataFrame:
    named = entries.withColumn("chip", chip(F.col("kind"), F.col("status")))
    return named.groupBy(*keys).agg(*[F.count_if(F.col("chip") == c).alias(c) for c in ("user", "assistant", "thinking", "tool", "subagent", "error", "compaction")])


def elided(entries: DataFrame, keys=("session", "turn")) -> DataFrame:
    """Head and tail of long groups; the middle is reported as counts by kind.

    The ends are picked by rank limits on both sides, which Spark applies
    before the shuffle, so a long group is not sorted whole in one task.
    """
    size = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col("line"), F.col("block")]
    head = Window.partitionBy(*keys).orderBy(*order)
    tail = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    cut = entries.join(size.where(F.col("__n") > ELIDE_OVER).select(*keys), list(keys), "left_semi")
    whole = entries.join(size.where(F.col("__n") <= ELIDE_OVER).select(*keys), list(keys), "left_semi").withColumn("part", F.lit("head"))
    first = cut.withColumn("__r", F.row_number().over(head)).where(F.col("__r") <= ANCHORS).drop("__r").withColumn("part", F.lit("head"))
    last = cut.withColumn("__r", F.row_number().over(tail)).where(F.col("__r") <= ANCHORS).drop("__r").withColumn("part", F.lit("tail"))
    return whole.unionByName(first).unionByName(last)


def hidden_counts(entries: DataFrame, keys=("session", "turn")) -> DataFrame:
    """Entries per kind in the middle that ``elided`` leaves out."""
    shown = elided(entries, keys).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("__shown"))
    every = entries.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("__all"))
    return every.join(shown, [*keys, "kind"], "left").withColumn("hidden", F.col("__all") - F.coalesce("__shown", F.lit(0))).where("hidden > 0").drop("__all", "__shown")


def record_detail(rec: DataFrame, session: str, line: int) -> DataFrame:
    return rec.where((F.col("session") == session) & (F.col("line") == line))


def call_detail(calls: DataFrame, notes: DataFrame, launched: DataFrame, session: str, call_id: str) -> DataFrame:
    """One call in full with the notifications about its background task."""
    return call_details(calls.where((F.col("session") == session) & (F.col("call_id") == call_id)), notes, launched)


def call_details(calls: DataFrame, notes: DataFrame, launched: DataFrame) -> DataFrame:
    """Calls in full, once for each notification about their background task."""
    one = tools.with_status(calls)
    about = launched.select("session", "call_id", "task_id").join(
        notes.select("session", "task_id", F.col("line").alias("note_line"), F.col("status").alias("note_status"), "exit_code"), ["session", "task_id"])
    return one.join(about, ["session", "call_id"], "left")
