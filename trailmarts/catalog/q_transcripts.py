"""Queries that start from raw JSON lines built out of the given tables."""

from pyspark.sql import functions as F

from ..functions import completeness
from ..operators import files, pricing, records_a, records_b, search, tasks, telemetry, timeline, tools, trace, usage
from ..session import stored
from .q_shell import usd
from .registry import query
from .roles import spread

r = F.round


def cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])


def js(*fields, **named):
    """A JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*fields, *[v.alias(k) for k, v in named.items()]))


def iso(ms):
    """ISO text of epoch milliseconds."""
    return F.concat(F.date_format(F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


# Messages of format A from line items ----------------------------------------


def snapshot_lines(t):
    """Each snapshot as a transcript line."""
    c = F.col
    split = F.struct(c("cache_write_5m_tokens").alias("ephemeral_5m_input_tokens"), c("cache_write_1h_tokens").alias("ephemeral_1h_input_tokens"))
    tokens = F.when(c("has_usage"), F.struct(
        "input_tokens", "output_tokens", c("cache_read_tokens").alias("cache_read_input_tokens"), c("cache_write_tokens").alias("cache_creation_input_tokens"),
        F.when(c("cache_write_5m_tokens").isNotNull(), split).alias("cache_creation")))
    message = F.struct(c("message_id").alias("id"), "model", tokens.alias("usage"))
    line = js(F.lit("assistant").alias("type"), iso(c("ts_ms")).alias("timestamp"), message.alias("message"))
    return spread(t.snapshots).select("session", "thread", "line", line.alias("text"))


@query(
    "transcript_snapshots",
    """SELECT session, thread, line, message_id, model, ts_ms, has_usage, CASE WHEN has_usage THEN input_tokens END AS input_tokens, CASE WHEN has_usage THEN output_tokens END AS output_tokens,
       CASE WHEN has_usage THEN cache_read_tokens END AS cache_read_tokens, CASE WHEN has_usage THEN cache_write_tokens END AS cache_write_tokens,
       CASE WHEN has_usage THEN cache_write_5m_tokens END AS cache_write_5m_tokens, CASE WHEN has_usage THEN cache_write_1h_tokens END AS cache_write_1h_tokens FROM snapshots""",
    "snapshots",
)
def _(t):
    return records_a.message_snapshots(snapshot_lines(t))


@query(
    "transcript_cost_by_model",
    """SELECT session, model, count(*) AS messages, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read_tokens,
       sum(cache_write_tokens) AS cache_write_tokens, round(sum(cost), 9) AS cost, count(cost) = count(*) AS cost_is_complete FROM costed GROUP BY session, model""",
    "costed",
)
def _(t):
    messages = stored(usage.dedupe_messages(records_a.message_snapshots(snapshot_lines(t))), "messages")
    costed = pricing.priced(messages.where("input_tokens IS NOT NULL"), t.pricing)
    out = usage.usage_by_model(costed)
    return out.select("session", "model", "messages", *usage.TOKENS, r("cost", 9).alias("cost"), "cost_is_complete")


# A mixed format A transcript from events ------------------------------------
# Every event becomes up to three lines, at 4 * event_id + 1, + 2 and + 3.


def lines_a(t):
    k, n, et = F.col("k"), F.col("event_id"), F.col("event_type")
    at = lambda i: n * 4 + i
    when = iso(F.col("ts_ms"))
    base = lambda i, text: F.struct(at(i).alias("line"), text.alias("text"))
    called = et.isin("view", "click")
    tokens = lambda extra: F.struct((k * 10).alias("input_tokens"), (k + extra).alias("output_tokens"), (k * 100).alias("cache_read_input_tokens"))
    arg = F.struct(cat("/repo/f", k % 13).alias("file_path"), cat("look at ", k).alias("description"))
    block_text = F.struct(F.lit("text").alias("type"), cat("Answer ", k).alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(arg_type()).alias("input"))
    block_use = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), cat("t", n).alias("id"), F.lit("Read").alias("name"), arg.alias("input"))
    first = js(F.lit("assistant").alias("type"), when.alias("timestamp"), cat("req", n).alias("requestId"), cat("/w/", k % 5).alias("cwd"),
               F.struct(cat("m", n).alias("id"), F.lit("brand#3").alias("model"), F.array(block_text, block_use).alias("content"), tokens(0).alias("usage")).alias("message"))
    again = js(F.lit("assistant").alias("type"), when.alias("timestamp"), F.struct(
        cat("m", n).alias("id"), F.lit("brand#3").alias("model"), F.when(k % 2 == 0, F.lit("end_turn")).alias("stop_reason"),
        F.array(F.struct(F.lit("thinking").alias("type"), cat("Thought ", k).alias("thinking"))).alias("content"), tokens(1).alias("usage")).alias("message"))
    result = js(F.lit("user").alias("type"), when.alias("timestamp"), F.struct(F.array(F.struct(
        F.lit("tool_result").alias("type"), cat("t", n).alias("tool_use_id"), F.when(k % 7 == 0, F.lit(True)).alias("is_error"),
        F.array(F.struct(F.lit("text").alias("type"), cat("Result ", k).alias("text"))).alias("content"))).alias("content")).alias("message"))
    plain = js(F.lit("user").alias("type"), when.alias("timestamp"), F.when(k % 11 == 0, F.lit(True)).alias("isMeta"), F.when(k % 13 == 0, F.lit(True)).alias("isCompactSummary"),
               F.struct(cat("Prompt ", k).alias("content")).alias("message"))
    parts = js(F.lit("user").alias("type"), when.alias("timestamp"), F.when(k % 11 == 0, F.lit(True)).alias("isMeta"), F.when(k % 13 == 0, F.lit(True)).alias("isCompactSummary"),
               F.struct(F.array(F.struct(F.lit("text").alias("type"), cat("Prompt ", k).alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"))).alias("content")).alias("message"))
    note = cat("<task-notification><task-id>task", k, "</task-id><status>completed</status> exit code ", k % 2, "</task-notification>")
    system = (
        F.when(k % 10 == 0, js(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), when.alias("timestamp"), F.struct(F.lit("auto").alias("trigger"), (k * 1000).alias("preTokens")).alias("compactMetadata")))
        .when(k % 10 < 4, js(F.lit("system").alias("type"), F.lit("api_error").alias("subtype"), when.alias("timestamp"), (k % 3).alias("retryAttempt"), F.struct(cat("Overloaded ", k).alias("message"), (F.lit(500) + k % 30).alias("status")).alias("error")))
        .when(k % 10 < 6, js(F.lit("queue-operation").alias("type"), when.alias("timestamp"), note.alias("content")))
        .when(k % 10 == 6, js(F.lit("ai-title").alias("type"), cat("Title ", n).alias("aiTitle")))
        .when(k % 10 == 7, js(F.lit("attachment").alias("type"), F.struct(F.lit("queued_command").alias("type"), note.alias("prompt"), when.alias("timestamp")).alias("attachment")))
        .when(k % 10 == 8, js(F.lit("attachment").alias("type"), F.struct(F.lit("skill_listing").alias("type"), cat("skills ", k).alias("content")).alias("attachment")))
        .otherwise(js(F.lit("file-history-snapshot").alias("type"))))
    odd = (
        F.when(k % 5 == 0, F.lit('{"type": "assistant", ')).when(k % 5 == 1, cat('{"foo": ', k, "}")).when(k % 5 == 2, F.lit("  ")).when(k % 5 == 3, F.lit("[1]"))
        .otherwise(js(F.lit("user").alias("type"), when.alias("timestamp"), F.struct(cat("bg", n).alias("backgroundTaskId")).alias("toolUseResult"), F.struct(F.array(F.struct(
            F.lit("tool_result").alias("type"), cat("t", n - 1).alias("tool_use_id"), F.lit("started").alias("content"))).alias("content")).alias("message"))))
    one = F.when(called, first).when(et == "signup", F.when(k % 2 == 0, plain).otherwise(parts)).when(et == "purchase", system).otherwise(odd)
    lines = F.array(base(1, one), base(2, F.when(called, again)), base(3, F.when(called & (k % 23 != 0), result)))
    return spread(t.ev).select("session", "thread", F.explode(lines).alias("l")).select("session", "thread", "l.*").where("text IS NOT NULL")


def arg_type():
    return "struct<file_path:string,description:string>"


def rec_a(t):
    return records_a.records(lines_a(t))


CALLED = "event_type IN ('view', 'click')"


@query(
    "records_a_types",
    """SELECT type, count(*) AS n FROM (
       SELECT 'assistant' AS type FROM ev WHERE event_type IN ('view', 'click') UNION ALL SELECT 'assistant' FROM ev WHERE event_type IN ('view', 'click')
       UNION ALL SELECT 'user' FROM ev WHERE event_type IN ('view', 'click') AND k % 23 <> 0 UNION ALL SELECT 'user' FROM ev WHERE event_type = 'signup' OR (event_type = 'error' AND k % 5 = 4)
       UNION ALL SELECT CASE WHEN k % 10 < 4 THEN 'system' WHEN k % 10 < 6 THEN 'queue-operation' WHEN k % 10 = 6 THEN 'ai-title' WHEN k % 10 < 9 THEN 'attachment' ELSE 'file-history-snapshot' END FROM ev WHERE event_type = 'purchase') x GROUP BY type""",
    "ev",
)
def _(t):
    return rec_a(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_warnings_a",
    """SELECT session, thread, event_id * 4 + 1 AS line, CASE k % 5 WHEN 0 THEN 'malformed JSON' ELSE 'missing record type' END AS reason FROM ev WHERE event_type = 'error' AND k % 5 IN (0, 1, 3)""",
    "ev",
)
def _(t):
    return records_a.warnings(lines_a(t))


@query("prompts_a", """SELECT session, thread, event_id * 4 + 1 AS line, ts_ms, 'Prompt ' || k || CASE WHEN k % 2 = 1 THEN chr(10) || 'more' ELSE '' END AS text FROM ev
       WHERE event_type = 'signup' AND k % 11 <> 0 AND k % 13 <> 0""", "ev")
def _(t):
    return records_a.prompts(rec_a(t))


@query("tool_calls_a", f"""SELECT session, thread, event_id * 4 + 1 AS line, 't' || event_id AS call_id, 'Read' AS tool, '/repo/f' || (k % 13) AS path, 'm' || event_id AS message_id FROM ev WHERE {CALLED}""", "ev")
def _(t):
    return tools.with_path(records_a.tool_calls(rec_a(t))).select("session", "thread", "line", "call_id", "tool", "path", "message_id")


@query(
    "tool_results_a",
    f"""SELECT session, thread, event_id * 4 + 3 AS result_line, 't' || event_id AS call_id, k % 7 = 0 AS is_error, 'Result ' || k AS result_text FROM ev WHERE {CALLED} AND k % 23 <> 0
        UNION ALL SELECT session, thread, event_id * 4 + 1, 't' || (event_id - 1), false, 'started' FROM ev WHERE event_type = 'error' AND k % 5 = 4""",
    "ev",
)
def _(t):
    return records_a.tool_results(rec_a(t)).select("session", "thread", "result_line", "call_id", "is_error", "result_text")


@query(
    "notifications_a",
    """SELECT session, thread, event_id * 4 + 1 AS line, ts_ms, 'task' || k AS task_id, 'completed' AS status, k % 2 AS exit_code FROM ev WHERE event_type = 'purchase' AND k % 10 IN (4, 5, 7)""",
    "ev",
)
def _(t):
    return records_a.notifications(rec_a(t))


@query("compactions_a", "SELECT session, thread, event_id * 4 + 1 AS line, ts_ms, 'auto' AS trigger, k * 1000 AS pre_tokens, CAST(NULL AS BIGINT) AS post_tokens FROM ev WHERE event_type = 'purchase' AND k % 10 = 0", "ev")
def _(t):
    return records_a.compactions(rec_a(t))


@query(
    "api_errors_a",
    """SELECT session, thread, line, status, retry_attempt, message, errors FROM (SELECT session, thread, event_id * 4 + 1 AS line, 500 + k % 30 AS status, k % 3 AS retry_attempt, 'Overloaded ' || k AS message,
       count(*) OVER (PARTITION BY session, thread) AS errors, row_number() OVER (PARTITION BY session, thread ORDER BY event_id) AS n FROM ev WHERE event_type = 'purchase' AND k % 10 BETWEEN 1 AND 3) x""",
    "ev",
)
def _(t):
    return records_a.api_error_list(records_a.api_errors(rec_a(t))).drop("ts_ms", "rank")


HEAD = f"""SELECT session, min(ts_ms) FILTER (dated) AS first_ts_ms, arg_max(ts_ms, event_id) FILTER (dated) AS last_ts_ms, arg_min('/w/' || (k % 5), event_id) FILTER ({CALLED}) AS cwd,
   arg_max('Title ' || event_id, event_id) FILTER (event_type = 'purchase' AND k % 10 = 6) AS title
  FROM (SELECT *, {CALLED} OR event_type = 'signup' OR (event_type = 'purchase' AND k % 10 NOT IN (6, 8, 9)) OR (event_type = 'error' AND k % 5 = 4) AS dated FROM ev) e GROUP BY session"""


@query("session_headers_a", HEAD, "ev")
def _(t):
    return records_a.headers(rec_a(t)).select("session", "first_ts_ms", "last_ts_ms", "cwd", "title")


@query(
    "rest_state_a",
    f"""SELECT session, thread, arg_max(CASE WHEN {CALLED} AND k % 23 = 0 AND k % 2 = 0 THEN 1 ELSE 0 END, event_id) = 1 AS ends_at_rest FROM ev
        WHERE {CALLED} OR event_type = 'signup' OR (event_type = 'error' AND k % 5 = 4) GROUP BY session, thread""",
    "ev",
)
def _(t):
    return records_a.rest_state(rec_a(t))


@query(
    "launch_details_a",
    """SELECT session, thread, event_id * 4 + 1 AS line, ts_ms, 'bash' AS kind, 'bg' || event_id AS task_id, 't' || (event_id - 1) AS call_id FROM ev WHERE event_type = 'error' AND k % 5 = 4""",
    "ev",
)
def _(t):
    return records_a.launch_details(rec_a(t)).drop("description")


@query(
    "injected_listings",
    """SELECT session, thread, event_id * 4 + 1 AS line, 'skill-listing' AS kind, '<system-reminder>' || chr(10) || 'The following skills are available for use with the Skill tool:' || chr(10) || chr(10) || 'skills ' || k || chr(10) || '</system-reminder>' || chr(10) AS text
       FROM ev WHERE event_type = 'purchase' AND k % 10 = 8""",
    "ev",
)
def _(t):
    return records_a.injected_listings(rec_a(t))


# Search ----------------------------------------------------------------------

FIELDS = f"""(SELECT session, thread, event_id * 4 + 1 AS line, 'tool_input' AS field, 'look at ' || k || chr(10) || '/repo/f' || (k % 13) AS text, 1 AS ord FROM ev WHERE {CALLED}
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'assistant', 'Answer ' || k, 99 FROM ev WHERE {CALLED}
  UNION ALL SELECT session, thread, event_id * 4 + 2, 'thinking', 'Thought ' || k, 0 FROM ev WHERE {CALLED}
  UNION ALL SELECT session, thread, event_id * 4 + 3, 'tool_result', 'Result ' || k, 0 FROM ev WHERE {CALLED} AND k % 23 <> 0
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'tool_result', 'started', 0 FROM ev WHERE event_type = 'error' AND k % 5 = 4
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'user', 'Prompt ' || k || CASE WHEN k % 2 = 1 THEN chr(10) || 'more' ELSE '' END, 99 FROM ev WHERE event_type = 'signup'
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'title', 'Title ' || event_id, 0 FROM ev WHERE event_type = 'purchase' AND k % 10 = 6)"""


@query("search_fields_a", f"SELECT session, thread, line, field, text FROM {FIELDS} f", "ev")
def _(t):
    return search.fields_a(rec_a(t)).select("session", "thread", "line", "field", "text")


@query(
    "search_transcripts",
    f"""SELECT session, thread, line, arg_min(field, ord) AS field, CAST(sum((length(text) - length(replace(lower(text), '7', ''))) / 1) AS BIGINT) AS occurrences
        FROM {FIELDS} f WHERE contains(lower(text), '7') GROUP BY ALL""",
    "ev",
)
def _(t):
    found = search.matches(search.fields_a(records_a.records(search.gate(lines_a(t), "7"))), "7")
    return found.select("session", "thread", "line", "field", "occurrences")


SNIPPET = """CASE WHEN p > 61 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(p - 60, 1), least(length(text), p - 1 + 2 + 100) - greatest(p - 61, 0)), '\\s+', ' ', 'g')) ||
  CASE WHEN p - 1 + 2 + 100 < length(text) THEN '…' ELSE '' END"""


@query(
    "search_documents",
    f"""SELECT doc_id AS line, CAST((length(text) - length(replace(lower(text), 'en', ''))) / 2 AS BIGINT) AS occurrences, {SNIPPET} AS snippet FROM (SELECT *, instr(lower(text), 'en') AS p FROM documents) d WHERE p > 0""",
)
def _(t):
    fields = t.raw("documents").select(
        F.col("source").alias("session"), F.lit("main").alias("thread"), F.col("doc_id").alias("line"), F.lit(None).cast("bigint").alias("ts_ms"), F.lit(0).alias("ord"),
        F.lit("user").alias("field"), "text", F.lit(None).cast("string").alias("tool"))
    return search.matches(fields, "en").select("line", "occurrences", "snippet")


@query(
    "search_sessions",
    """
    WITH m AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'en')), c AS (SELECT conv_id, count(*) AS match_count FROM m GROUP BY conv_id ORDER BY conv_id * 13 % 101 DESC, 'c' || conv_id LIMIT 10)
    SELECT 'c' || conv_id AS session, turn AS line, position, match_count FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM m JOIN c USING (conv_id)) x WHERE position <= 3
    """,
)
def _(t):
    conv = t.raw("conversations")
    fields = conv.select(
        cat("c", F.col("conv_id")).alias("session"), F.lit("main").alias("thread"), F.col("turn").alias("line"), F.lit(None).cast("bigint").alias("ts_ms"), F.lit(0).alias("ord"),
        F.col("role").alias("field"), "text", F.lit(None).cast("string").alias("tool"))
    sessions = conv.select(cat("c", F.col("conv_id")).alias("session"), F.lit("x").alias("source"), (F.col("conv_id") * 13 % 101).alias("started_ms")).distinct()
    return search.results(search.matches(fields, "en"), sessions).select("session", "line", "position", "match_count")


@query(
    "search_parents",
    """SELECT CASE WHEN conv_id % 3 = 0 THEN 'c' || (conv_id + 1) ELSE 'c' || conv_id END AS session, CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id END AS agent, turn AS line FROM conversations WHERE contains(text, 'en')""",
)
def _(t):
    conv = t.raw("conversations")
    fields = conv.select(
        cat("c", F.col("conv_id")).alias("session"), F.lit("main").alias("thread"), F.col("turn").alias("line"), F.lit(None).cast("bigint").alias("ts_ms"), F.lit(0).alias("ord"),
        F.col("role").alias("field"), "text", F.lit(None).cast("string").alias("tool"))
    first = js(F.lit("session_meta").alias("type"), F.struct(F.lit("x").alias("id"), F.struct(F.struct(F.struct(
        cat("c", F.col("conv_id") + 1).alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")).alias("source")).alias("payload"))
    raw = conv.where("turn = 0 AND conv_id % 3 = 0").select(cat("c", F.col("conv_id")).alias("session"), (F.col("turn") + 1).alias("line"), first.alias("text"))
    return search.to_parents(search.matches(fields, "en", case_sensitive=True), records_b.parent_of(raw)).select("session", "agent", "line")


# Timelines -------------------------------------------------------------------

ENTRIES = f"""(SELECT session, thread, event_id * 4 + 1 AS line, 'user' AS kind, CAST(NULL AS VARCHAR) AS status FROM ev WHERE event_type = 'signup' AND k % 11 <> 0 AND k % 13 <> 0
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'assistant-text', NULL FROM ev WHERE {CALLED} UNION ALL SELECT session, thread, event_id * 4 + 2, 'thinking', NULL FROM ev WHERE {CALLED}
  UNION ALL SELECT e.session, e.thread, e.event_id * 4 + 1, CASE WHEN e.k % 10 = 3 THEN 'subagent-launch' ELSE 'tool-call' END,
    CASE WHEN e.k % 23 <> 0 THEN CASE WHEN e.k % 7 = 0 THEN 'error' ELSE 'ok' END WHEN b.event_id IS NOT NULL THEN 'ok' ELSE 'missing-result' END FROM ev e
    LEFT JOIN (SELECT session, thread, event_id FROM ev WHERE event_type = 'error' AND k % 5 = 4) b ON b.session = e.session AND b.thread = e.thread AND b.event_id = e.event_id + 1 WHERE e.event_type IN ('view', 'click')
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'task-notification', 'completed' FROM ev WHERE event_type = 'purchase' AND k % 10 IN (4, 5, 7)
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'compaction', NULL FROM ev WHERE event_type = 'purchase' AND k % 10 = 0
  UNION ALL SELECT session, thread, event_id * 4 + 1, 'api-error', NULL FROM ev WHERE event_type = 'purchase' AND k % 10 BETWEEN 1 AND 3)"""


def linked_calls(rec):
    return tools.link_results(records_a.tool_calls(rec), records_a.tool_results(rec))


def entries_a(t):
    rec = stored(rec_a(t), "records")
    calls = linked_calls(rec)
    launched = tasks.launches(records_a.launch_details(rec), calls)
    costed = pricing.priced(usage.dedupe_messages(records_a.snapshots(rec)), t.pricing)
    threads = t.ev.where("event_type IN ('view', 'click') AND k % 10 = 3").select("session", cat("g", F.col("event_id")).alias("agent"), cat("t", F.col("event_id")).alias("tool_use_id"))
    costs = threads.select("session", "agent", F.lit(1.5).alias("cost"))
    return timeline.entries_a(rec, calls, records_a.notifications(rec), launched, costed, threads, costs)


@query("timeline_a", f"SELECT * FROM {ENTRIES} e", "ev")
def _(t):
    return entries_a(t).select("session", "thread", "line", "kind", "status")


CHIP = "CASE WHEN kind = 'tool-call' AND status = 'error' OR kind = 'api-error' THEN 'error' WHEN kind IN ('tool-call', 'task-notification') THEN 'tool' WHEN kind = 'assistant-text' THEN 'assistant' WHEN kind = 'subagent-launch' THEN 'subagent' ELSE kind END"


@query("timeline_chip_counts", "SELECT session, " + ", ".join(f"count(*) FILTER (chip = '{c}') AS {c}" for c in ("user", "assistant", "thinking", "tool", "subagent", "error", "compaction")) + f" FROM (SELECT *, {CHIP} AS chip FROM {ENTRIES} e) x GROUP BY session", "ev")
def _(t):
    return timeline.chip_counts(entries_a(t))


@query("timeline_visible", f"SELECT session, thread, line, kind FROM {ENTRIES} e WHERE kind IN ('user', 'assistant-text', 'subagent-launch', 'compaction') AND {CHIP} IN ('user', 'subagent')", "ev")
def _(t):
    return timeline.visible(entries_a(t), "minimal", ["user", "subagent"]).select("session", "thread", "line", "kind")


ELIDED = f"(SELECT *, row_number() OVER (PARTITION BY session ORDER BY line, block) AS a, count(*) OVER (PARTITION BY session) AS n FROM (SELECT *, CASE kind WHEN 'tool-call' THEN 1 WHEN 'subagent-launch' THEN 1 ELSE 0 END AS block FROM {ENTRIES} e) q)"


@query("timeline_elided", f"SELECT session, line, kind, CASE WHEN n <= 16 OR a <= 6 THEN 'head' ELSE 'tail' END AS part FROM {ELIDED} x WHERE n <= 16 OR a <= 6 OR a > n - 6", "ev")
def _(t):
    return timeline.elided(stored(entries_a(t), "entries"), ("session",)).select("session", "line", "kind", "part")


@query("timeline_hidden", f"SELECT session, kind, count(*) AS hidden FROM {ELIDED} x WHERE n > 16 AND a > 6 AND a <= n - 6 GROUP BY ALL", "ev")
def _(t):
    return timeline.hidden_counts(stored(entries_a(t), "entries"), ("session",))


@query(
    "usage_badges",
    f"""SELECT session, thread, 'm' || event_id AS message_id, event_id * 4 + 1 AS line, 0 AS block FROM ev WHERE {CALLED}""",
    "ev",
)
def _(t):
    return timeline.usage_badges(rec_a(t))


@query(
    "record_detail",
    "SELECT session, event_id * 4 + 1 AS line, 'assistant' AS type FROM ev WHERE event_type IN ('view', 'click')",
    "ev",
)
def _(t):
    wanted = t.ev.where("event_type IN ('view', 'click')").select("session", (F.col("event_id") * 4 + 1).alias("line"))
    return rec_a(t).join(wanted, ["session", "line"], "left_semi").select("session", "line", "type")


# Traces ----------------------------------------------------------------------

CAPTURES = "(SELECT session, 'req' || (event_id - event_id % 2) AS request_id, ts_ms + 7 AS started_ms, k * 3 AS latency_ms, 200 AS status FROM ev WHERE event_type IN ('view', 'error'))"


def captures(t):
    n = F.col("event_id")
    return t.ev.where("event_type IN ('view', 'error')").select(
        "session", cat("req", n - n % 2).alias("request_id"), (F.col("ts_ms") + 7).alias("started_ms"), (F.col("k") * 3).alias("latency_ms"),
        F.lit(200).cast("bigint").alias("status"), F.lit(1).cast("bigint").alias("request_bytes"), F.lit(2).cast("bigint").alias("response_bytes"))


def requests(t):
    return t.ev.where("event_type IN ('view', 'click') AND thread = 'main'").select(
        "session", (F.col("event_id") * 4 + 1).alias("line"), "ts_ms", cat("req", F.col("event_id")).alias("request_id"), F.lit("brand#3").alias("model"))


@query("hidden_calls", f"SELECT session, request_id FROM {CAPTURES} c WHERE (session, request_id) NOT IN (SELECT session, 'req' || event_id FROM ev WHERE {CALLED} AND thread = 'main')", "ev")
def _(t):
    return trace.hidden_calls(captures(t), requests(t)).select("session", "request_id")


@query(
    "captured_requests",
    f"""SELECT e.session, 'req' || event_id AS request_id, latency_ms, status FROM ev e LEFT JOIN (SELECT session, request_id, arg_min(latency_ms, started_ms) AS latency_ms, min(status) AS status FROM {CAPTURES} c GROUP BY ALL) c
        ON c.session = e.session AND c.request_id = 'req' || event_id WHERE {CALLED} AND thread = 'main'""",
    "ev",
)
def _(t):
    return trace.enriched_requests(requests(t), captures(t)).select("session", "request_id", "latency_ms", "status")


@query(
    "capture_channels",
    f"""SELECT r.session, count(*) AS requests, count(c.request_id) AS enriched, coalesce(min(q.n), 0) AS captures, min(q.n) IS NOT NULL AS capture_available FROM (SELECT session, 'req' || event_id AS request_id FROM ev WHERE {CALLED} AND thread = 'main') r
        LEFT JOIN (SELECT DISTINCT session, request_id FROM {CAPTURES} c) c USING (session, request_id) LEFT JOIN (SELECT session, count(*) AS n FROM {CAPTURES} c GROUP BY session) q ON q.session = r.session GROUP BY r.session""",
    "ev",
)
def _(t):
    return trace.channels(captures(t), trace.enriched_requests(requests(t), captures(t)))


MEASURED = "event_type = 'view' AND user_id % 4 > 0"


@query(
    "trace_enrichment",
    f"""WITH s AS (SELECT DISTINCT session FROM ev), c AS (SELECT * FROM {CAPTURES} c), m AS (SELECT session, count(*) AS n FROM ev WHERE {MEASURED} GROUP BY session), n AS (SELECT session, count(*) AS n FROM c GROUP BY session),
       h AS (SELECT session, count(*) AS n FROM c WHERE request_id IS NOT NULL AND (session, request_id) NOT IN (SELECT session, 'req' || event_id FROM ev WHERE {CALLED} AND thread = 'main') GROUP BY session)
       SELECT session, 'telemetry' AS channel, true AS consulted, m.n IS NOT NULL AS available, coalesce(m.n, 0) AS "rows", CASE WHEN m.n IS NULL THEN 'nothing of this session' END AS note, NULL AS hidden_calls FROM s LEFT JOIN m USING (session)
       UNION ALL SELECT session, 'captures', true, n.n IS NOT NULL, coalesce(n.n, 0), CASE WHEN n.n IS NULL THEN 'nothing of this session' END, coalesce(h.n, 0) FROM s LEFT JOIN n USING (session) LEFT JOIN h USING (session)""",
    "ev",
)
def _(t):
    found = captures(t)
    return trace.enrichment(t.ev, found, t.ev.where(MEASURED), trace.hidden_calls(found, requests(t)))


@query(
    "trace_limitations",
    f"""SELECT DISTINCT session, unnest(['subagents', 'reconstruction', 'listings']) AS name FROM ev UNION ALL SELECT DISTINCT session, 'telemetry' FROM ev WHERE {MEASURED}""",
    "ev",
)
def _(t):
    return trace.limitations(trace.enrichment(t.ev, None, t.ev.where(MEASURED)), listings=False).select("session", "name")


def all_events(t):
    rec = stored(rec_a(t), "records")
    hidden = trace.hidden_calls(captures(t), requests(t)).withColumn("ts_ms", F.col("started_ms"))
    return trace.events(rec, linked_calls(rec), trace.enriched_requests(requests(t), captures(t)), hidden)


TRACE = f"""(SELECT session, event_id * 4 + 1 AS line, ts_ms, 'gen_ai.user.message' AS name FROM ev WHERE thread = 'main' AND event_type = 'signup' AND k % 11 <> 0 AND k % 13 <> 0
  UNION ALL SELECT session, event_id * 4 + 1, ts_ms, unnest(['gen_ai.assistant.message', 'gen_ai.tool.call', 'request']) FROM ev WHERE thread = 'main' AND {CALLED}
  UNION ALL SELECT session, line, ts_ms, 'gen_ai.tool.result' FROM (SELECT session, i, arg_min(ts_ms, line) AS ts_ms, min(line) AS line FROM (
      SELECT session, 't' || event_id AS i, event_id * 4 + 3 AS line, ts_ms FROM ev WHERE thread = 'main' AND {CALLED} AND k % 23 <> 0
      UNION ALL SELECT session, 't' || (event_id - 1), event_id * 4 + 1, ts_ms FROM ev WHERE thread = 'main' AND event_type = 'error' AND k % 5 = 4) z
      WHERE (session, i) IN (SELECT session, 't' || event_id FROM ev WHERE thread = 'main' AND {CALLED}) GROUP BY session, i) y
  UNION ALL SELECT session, event_id * 4 + 1, ts_ms, CASE WHEN k % 10 = 0 THEN 'compaction' WHEN k % 10 < 4 THEN 'api_error' ELSE 'task_notification' END FROM ev WHERE thread = 'main' AND event_type = 'purchase' AND k % 10 IN (0, 1, 2, 3, 4, 5, 7)
  UNION ALL SELECT session, event_id * 4 + 1, NULL, 'injected_context' FROM ev WHERE thread = 'main' AND event_type = 'purchase' AND k % 10 = 8
  UNION ALL SELECT session, NULL, started_ms, 'hidden_call' FROM {CAPTURES} c WHERE (session, request_id) NOT IN (SELECT session, 'req' || event_id FROM ev WHERE {CALLED} AND thread = 'main'))"""


@query("trace_events", f"SELECT session, line, ts_ms, name FROM {TRACE} t", "ev")
def _(t):
    return all_events(t).select("session", "line", "ts_ms", "name")


@query(
    "trace_order",
    f"""
    WITH t AS MATERIALIZED (SELECT * FROM {TRACE} t), a AS MATERIALIZED (SELECT session, line, max(ts_ms) AS ts, lag(line) OVER (PARTITION BY session ORDER BY line) AS before FROM t WHERE line IS NOT NULL AND ts_ms IS NOT NULL GROUP BY session, line),
    h AS (SELECT t.session, t.ts_ms, t.name, min(a.line) AS hit FROM t LEFT JOIN a ON a.session = t.session AND a.ts >= t.ts_ms WHERE t.line IS NULL GROUP BY ALL)
    SELECT session, ts_ms, name, CAST(line AS DOUBLE) AS sort_key FROM t WHERE line IS NOT NULL
    UNION ALL SELECT h.session, h.ts_ms, h.name, CASE WHEN hit IS NULL THEN coalesce((SELECT max(line) FROM a WHERE a.session = h.session) + 0.5, 'Infinity'::DOUBLE) WHEN a.before IS NULL THEN hit - 0.5 ELSE (a.before + hit) / 2 END
      FROM h LEFT JOIN a ON a.session = h.session AND a.line = h.hit
    """,
    "ev",
)
def _(t):
    every = all_events(t)
    one = every.where("name <> 'hidden_call'").unionByName(every.where("name = 'hidden_call'").dropDuplicates(["session", "ts_ms"]))
    return trace.ordered(stored(one, "trace")).select("session", "ts_ms", "name", "sort_key")


@query(
    "source_completeness",
    """SELECT dimension, status, count(*) AS sessions FROM (SELECT unnest(CASE WHEN source = 'codex' THEN [{'d': 'cost', 's': 'estimate'}, {'d': 'systemPrompt', 's': 'unknown'}, {'d': 'toolSchemas', 's': 'unknown'}, {'d': 'hiddenApiCalls', 's': 'unknown'}, {'d': 'latency', 's': 'unknown'}]
         ELSE [{'d': 'systemPrompt', 's': 'absent'}, {'d': 'toolSchemas', 's': 'absent'}, {'d': 'generationParams', 's': 'absent'}, {'d': 'injectedContext', 's': 'partial'}, {'d': 'hiddenApiCalls', 's': 'not-recorded'}, {'d': 'cost', 's': 'estimate'},
               {'d': 'thinking', 's': 'partial'}, {'d': 'latency', 's': 'absent'}] END) AS x FROM items) y, LATERAL (SELECT x.d AS dimension, x.s AS status) GROUP BY ALL""",
    "items",
)
def _(t):
    kinds = t.items.select("session", F.when(F.col("source") == "codex", F.lit("codex-session-jsonl")).otherwise(F.lit("claude-session-jsonl")).alias("source_kind"))
    return completeness.per_session(kinds).groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("sessions"))


# Telemetry -------------------------------------------------------------------


def otlp_lines(t):
    """One export per event: logs, metrics, or a broken line, with the session id in different places."""
    k, et = F.col("k"), F.col("event_type")
    name = (
        F.when(et == "view", F.lit("api_request")).when(et == "click", F.lit("tool_decision")).when(k % 3 == 0, F.lit("mcp_server_connection")).when(k % 3 == 1, F.lit("hook_execution_start")).otherwise(F.lit("other_event")))
    sid = cat('{"key":"session.id","value":{"stringValue":"', F.col("session"), '"}}')
    attrs = F.concat(cat('{"key":"event.name","value":{"stringValue":"', name, '"}}'), F.when((et == "view") & (k % 4 != 0), cat(',{"key":"cost_usd","value":{"doubleValue":', k * 0.5, "}}")).otherwise(F.lit("")),
                     F.when(et == "view", cat(',{"key":"duration_ms","value":{"intValue":"', k * 2, '"}}')).otherwise(F.lit("")), F.when(et == "click", cat(',{"key":"tool_name","value":{"stringValue":"T', k % 3, '"}}')).otherwise(F.lit("")))
    where_record = F.when(k % 2 == 0, F.concat(attrs, F.lit(","), sid)).otherwise(attrs)
    where_resource = F.when(k % 2 == 1, sid).otherwise(F.lit(""))
    logs = cat('{"resourceLogs":[{"resource":{"attributes":[', where_resource, ']},"scopeLogs":[{"logRecords":[{"timeUnixNano":"', F.col("ts_ms") * 1_000_000, '","attributes":[', where_record, "]}]}]}]}")
    metric = cat('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"', F.when(k % 2 == 0, F.lit("x.cost.usage")).otherwise(F.lit("x.tokens")), '","sum":{"dataPoints":[{"asDouble":', k * 0.25, ',"attributes":[', F.when(k % 10 != 0, sid).otherwise(F.lit("")), "]}]}}]}]}]}")
    body = F.when(et.isin("view", "click", "signup"), logs).when(et == "purchase", metric).when(k % 2 == 0, F.lit('{"broken')).otherwise(F.lit('{"x":1}'))
    return spread(t.ev).select("line", body.alias("text"))


SID = "CASE WHEN event_type IN ('view', 'click', 'signup') OR (event_type = 'purchase' AND k % 10 <> 0) THEN session ELSE '_unassigned' END"


@query("otlp_routing", f"SELECT line, {SID} AS session FROM ev", "ev")
def _(t):
    return telemetry.routed(otlp_lines(t)).select("line", "session")


@query(
    "otlp_session_stats",
    f"""
    SELECT {SID} AS session, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS log_payloads, count(*) FILTER (event_type = 'purchase') AS metric_payloads, count(*) FILTER (event_type = 'error') AS malformed_lines,
      count(*) FILTER (event_type = 'view') AS requests, count(*) FILTER (event_type = 'view') AS durations, sum(k * 2.0::DOUBLE) FILTER (event_type = 'view') AS duration_sum, min(k * 2.0::DOUBLE) FILTER (event_type = 'view') AS duration_min,
      max(k * 2.0::DOUBLE) FILTER (event_type = 'view') AS duration_max, round(avg(k * 2) FILTER (event_type = 'view'), 9) AS duration_avg, count(*) FILTER (event_type = 'click') AS decisions,
      count(*) FILTER (event_type = 'signup' AND k % 3 = 0) AS mcp_events, count(*) FILTER (event_type = 'signup' AND k % 3 = 1) AS hook_events, count(*) FILTER (event_type = 'signup' AND k % 3 = 2) AS other_events,
      count(*) FILTER (event_type = 'purchase' AND k % 2 = 1) AS other_metrics,
      CAST(round(coalesce(sum(k * 0.5) FILTER (event_type = 'view' AND k % 4 <> 0), sum(k * 0.25) FILTER (event_type = 'purchase' AND k % 2 = 0), 0), 9) AS DOUBLE) AS cost_usd,
      CASE WHEN count(*) FILTER (event_type = 'view' AND k % 4 <> 0) > 0 THEN 'api_request_events' WHEN count(*) FILTER (event_type = 'purchase' AND k % 2 = 0) > 0 THEN 'cost_metric' ELSE 'none' END AS cost_source
    FROM ev GROUP BY 1
    """,
    "ev",
)
def _(t):
    out = telemetry.session_stats(telemetry.routed(otlp_lines(t)))
    return out.withColumns({"duration_avg": r("duration_avg", 9), "cost_usd": r("cost_usd", 9)})


@query(
    "otlp_tool_decisions",
    "SELECT session, rank, ts_ms, 'T' || (k % 3) AS tool_name FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS rank FROM ev WHERE event_type = 'click') x",
    "ev",
)
def _(t):
    return telemetry.tool_decisions(telemetry.routed(otlp_lines(t))).select("session", "rank", "ts_ms", "tool_name")


@query("otlp_health", "SELECT session, line, CASE k % 3 WHEN 0 THEN 'mcp' ELSE 'hook' END AS kind, ts_ms FROM ev WHERE event_type = 'signup' AND k % 3 < 2", "ev")
def _(t):
    return telemetry.health_events(telemetry.routed(otlp_lines(t))).select("session", "line", "kind", "ts_ms")


@query(
    "otlp_unrecognized",
    """SELECT session, 'event' AS signal, 'other_event' AS name, count(*) AS count FROM ev WHERE event_type = 'signup' AND k % 3 = 2 GROUP BY session
       UNION ALL SELECT session, 'metric', 'x.tokens', count(*) FROM ev WHERE event_type = 'purchase' AND k % 2 = 1 GROUP BY session""",
    "ev",
)
def _(t):
    return telemetry.unrecognized(telemetry.routed(otlp_lines(t)))
