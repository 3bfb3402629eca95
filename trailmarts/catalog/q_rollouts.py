"""Format B rollouts built out of the events."""

from pyspark.sql import functions as F

from ..operators import records_b, search, timeline, turns
from ..session import stored
from .q_transcripts import cat, iso, js
from .registry import query
from .roles import spread

r = F.round

# Every session starts with a header at line 0 (or none, for one session in ten);
# every event becomes the lines 2 * event_id + 2 and, for calls, + 3.


def lines_b(t, headers: bool = True):
    k, n, et = F.col("k"), F.col("event_id"), F.col("event_type")
    when = iso(F.col("ts_ms")).alias("timestamp")
    env = lambda kind, payload: js(when, F.lit(kind).alias("type"), payload.alias("payload"))
    counters = lambda f: F.struct(
        (k * 10 * f).alias("input_tokens"), (k * 4 * f).alias("cached_input_tokens"), (k * f).alias("output_tokens"), (k % 3 * f).alias("reasoning_output_tokens"), (k * 11 * f).alias("total_tokens"))
    count = F.struct(F.lit("token_count").alias("type"), F.struct(counters(1).alias("total_token_usage"), counters(2).alias("last_token_usage")).alias("info"), F.struct((k % 4).alias("used")).alias("rate_limits"))
    context = F.struct(cat("turn", n).alias("turn_id"), F.when(k % 3 > 0, cat("brand#", k % 4)).alias("model"))
    complete = F.struct(F.lit("task_complete").alias("type"), F.when(k % 2 == 0, k * 100).alias("duration_ms"))
    said = F.struct(F.when(k % 8 < 4, F.lit("user_message")).otherwise(F.lit("agent_message")).alias("type"), cat("Message ", k).alias("message"))
    item = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(
        F.when(k % 3 == 0, F.lit("<environment_context>x")).otherwise(cat("Typed ", k)).alias("text"))).alias("content"))
    arguments = F.when(k % 2 == 0, F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), cat("echo ", k)).alias("command")))).otherwise(
        F.to_json(F.struct(F.array(F.lit("git"), F.lit("commit"), F.lit("-m"), cat("it's ", k)).alias("command"))))
    call = F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), cat("c", n).alias("call_id"), arguments.alias("arguments"))
    output = F.struct(F.lit("function_call_output").alias("type"), cat("c", n).alias("call_id"), F.when(k % 5 == 0, F.lit("process exited with code 2")).otherwise(cat("fine ", k)).alias("output"))
    ended = F.struct(F.lit("exec_command_end").alias("type"), cat("c", n).alias("call_id"), (k % 2).alias("exit_code"))
    one = (
        F.when(et == "view", env("event_msg", count)).when((et == "click") & (k % 4 == 0), env("turn_context", context)).when((et == "click") & (k % 4 == 1), env("event_msg", complete))
        .when((et == "signup") & (F.col("user_id") % 2 == 0), env("event_msg", said)).when(et == "signup", env("response_item", item)).when(et == "error", env("response_item", call))
        .when((et == "purchase") & (k % 3 == 0), F.lit("{nope")).when((et == "purchase") & (k % 3 == 1), F.lit('"text"')).when(et == "purchase", F.lit('{"a":1}')))
    two = F.when((et == "error") & (k % 3 == 0), env("response_item", output)).when((et == "error") & (k % 3 == 1), env("event_msg", ended))
    both = F.array(F.struct((n * 2 + 2).alias("line"), one.alias("text")), F.struct((n * 2 + 3).alias("line"), two.alias("text")))
    lines = spread(t.ev).select("session", F.explode(both).alias("l")).select("session", "l.*").where("text IS NOT NULL")
    if not headers:
        return lines
    uid = F.col("user_id")
    head = js(F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(
        F.col("session").alias("id"), F.lit("/w").alias("cwd"), F.when(uid % 3 == 0, F.struct(F.struct(F.struct(cat("s", uid + 1).alias("parent_thread_id"), (uid % 4).alias("depth")).alias("thread_spawn")).alias("subagent"))).alias("source"),
        F.struct(cat("https://git/x", uid % 5).alias("repository_url")).alias("git")).alias("payload"))
    heads = t.ev.where(uid % 10 > 0).select("session", "user_id").distinct().select("session", F.lit(0).cast("bigint").alias("line"), head.alias("text"))
    return lines.union(heads)


def rec_b(t):
    return stored(records_b.records(lines_b(t)), "rollouts")


COUNTS = """c AS (SELECT session, event_id * 2 + 2 AS line, ts_ms, k, lag(k) OVER (PARTITION BY session ORDER BY event_id) AS pk FROM ev WHERE event_type = 'view'),
  moved AS (SELECT * FROM c WHERE pk IS NULL OR pk <> k)"""
MARKS = f"""{COUNTS},
  m AS (SELECT session, line, ts_ms, 'count' AS st, k, NULL AS mo, NULL AS dur, NULL AS tid FROM moved
    UNION ALL SELECT session, event_id * 2 + 2, ts_ms, 'open', k, CASE WHEN k % 3 > 0 THEN 'brand#' || (k % 4) END, NULL, 'turn' || event_id FROM ev WHERE event_type = 'click' AND k % 4 = 0
    UNION ALL SELECT session, event_id * 2 + 2, ts_ms, 'closed', k, NULL, CASE WHEN k % 2 = 0 THEN k * 100 END, NULL FROM ev WHERE event_type = 'click' AND k % 4 = 1),
  n AS (SELECT *, lag(st) OVER w AS before, last_value(mo IGNORE NULLS) OVER w AS cm FROM m WINDOW w AS (PARTITION BY session ORDER BY line)),
  o AS (SELECT *, st = 'open' OR (st = 'count' AND (before IS NULL OR before = 'closed')) AS starts FROM n),
  p AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line) AS BIGINT) AS turn FROM o),
  tm AS (SELECT session, turn, coalesce(cm, 'unknown') AS model, tid, ts_ms AS started_ms FROM p WHERE starts),
  d AS (SELECT p.session, p.line, p.ts_ms, p.turn, p.k, tm.model FROM p JOIN tm USING (session, turn) WHERE st = 'count')"""


@query(
    "parse_warnings_b",
    "SELECT session, event_id * 2 + 2 AS line, CASE k % 3 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'not an object' ELSE 'missing envelope type' END AS reason FROM ev WHERE event_type = 'purchase'",
    "ev",
)
def _(t):
    return records_b.warnings(lines_b(t))


@query("current_rollouts", "SELECT session, count(*) AS lines FROM (SELECT session FROM ev WHERE user_id % 10 > 0 AND event_type IN ('view', 'error', 'signup')) x GROUP BY session", "ev")
def _(t):
    kept = records_b.current_files(lines_b(t))
    return kept.where("line > 0 AND line % 2 = 0").join(
        t.ev.where("event_type IN ('view', 'error', 'signup')").select("session", (F.col("event_id") * 2 + 2).alias("line")), ["session", "line"], "left_semi"
    ).groupBy("session").agg(F.count(F.lit(1)).alias("lines"))


@query("token_deltas", f"WITH {COUNTS} SELECT session, line, k * 12 AS fresh_tokens, k * 11 AS context_tokens FROM moved", "ev")
def _(t):
    return records_b.token_deltas(rec_b(t), chunk_rows=4096).select("session", "line", "fresh_tokens", "context_tokens")


@query(
    "rollout_turns",
    f"""WITH {MARKS} SELECT tm.session, tm.turn, tid AS turn_id, nullif(model, 'unknown') AS model, started_ms, ended_ms, coalesce(dur, CASE WHEN ended_ms >= started_ms THEN ended_ms - started_ms END) AS duration_ms,
        CAST(coalesce(i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(r, 0) AS BIGINT) AS reasoning_tokens FROM tm
        LEFT JOIN (SELECT session, turn, arg_min(ts_ms, line) AS ended_ms, (arg_min({{'v': dur}}, line)).v AS dur FROM p WHERE st = 'closed' AND turn > 0 GROUP BY ALL) e USING (session, turn)
        LEFT JOIN (SELECT session, turn, sum(k * 12) AS i, sum(k % 3 * 2) AS r FROM d GROUP BY ALL) s USING (session, turn)""",
    "ev",
)
def _(t):
    _, found = records_b.usage_and_turns(rec_b(t), chunk_rows=4096)
    return found.select("session", "turn", "turn_id", "model", "started_ms", "ended_ms", "duration_ms", "input_tokens", "reasoning_tokens")


# Starts and times are moved so that both run backwards; one turn in 17 of some sessions has no start.
@query(
    "rollout_turn_groups",
    f"""WITH {MARKS},
      tt AS (SELECT session, turn, nullif(model, 'unknown') AS model, CASE WHEN turn % 17 > 0 OR session NOT LIKE '%3' THEN started_ms - turn % 3 * 72000000 END AS st FROM tm),
      pl AS (SELECT a.session, a.turn, a.model, a.st, b.turn AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY st, turn) AS n FROM tt WHERE st IS NOT NULL) a
        JOIN (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn) AS n FROM tt WHERE st IS NOT NULL) b USING (session, n)
        UNION ALL SELECT session, turn, model, st, turn FROM tt WHERE st IS NULL),
      bl AS (SELECT session, min(place) AS stop FROM pl WHERE st IS NULL AND place > 1 GROUP BY session),
      mk AS (SELECT session, st, row_number() OVER (PARTITION BY session ORDER BY place) AS n FROM pl LEFT JOIN bl USING (session) WHERE place > 1 AND st IS NOT NULL AND (stop IS NULL OR place < stop)),
      ml AS (SELECT session, st, max(n) AS n FROM mk GROUP BY ALL),
      e AS (SELECT session, line, event_type, k, max(CASE WHEN k % 11 > 0 THEN ts_ms + (k % 5 - 2) * 36000000 END) OVER (PARTITION BY session ORDER BY line) AS upto FROM ev WHERE event_type IN ('signup', 'error', 'purchase')),
      z AS (SELECT e.session, line, event_type, k, 1 + coalesce(n, 0) AS place FROM e ASOF LEFT JOIN ml ON e.session = ml.session AND upto >= st),
      g AS (SELECT session, place, count(*) AS n, count(*) FILTER (event_type = 'error' AND k % 2 = 0) AS errs, min(line) AS anchor, min(line) FILTER (event_type = 'signup') AS user_line FROM z GROUP BY ALL),
      sp AS (SELECT session, place, 'brand#' || (k % 4) AS m, min(line) AS seen FROM z WHERE event_type = 'purchase' GROUP BY ALL
        UNION ALL SELECT session, place, model, 0 FROM pl WHERE model IS NOT NULL),
      ms AS (SELECT session, place, string_agg(m, ',' ORDER BY seen) AS models FROM (SELECT session, place, m, min(seen) AS seen FROM sp GROUP BY ALL) x GROUP BY ALL)
      SELECT session, place, turn, st AS started_ms, coalesce(g.n, 0) AS entries, coalesce(errs, 0) AS tool_errors, coalesce(anchor, -(place + 1)) AS anchor_line, user_line, coalesce(models, '') AS models
      FROM pl LEFT JOIN g USING (session, place) LEFT JOIN ms USING (session, place)""",
    "ev",
)
def _(t):
    k, et = F.col("k"), F.col("event_type")
    _, found = records_b.usage_and_turns(rec_b(t), chunk_rows=4096)
    early = F.col("started_ms") - F.col("turn") % 3 * 72000000
    found = found.withColumn("started_ms", F.when((F.col("turn") % 17 > 0) | ~F.col("session").endswith("3"), early))
    entries = t.ev.where(et.isin("signup", "error", "purchase")).select(
        "session", "line", F.lit(0).alias("block"), F.when(k % 11 > 0, F.col("ts_ms") + (k % 5 - 2) * 36000000).alias("ts_ms"),
        F.when(et == "signup", F.lit("user")).when(et == "error", F.lit("tool-call")).otherwise(F.lit("assistant-text")).alias("kind"),
        F.when((et == "error") & (k % 2 == 0), F.lit("error")).alias("status"), F.when(et == "purchase", cat("brand#", k % 4)).alias("model"))
    out = turns.turn_groups_by_time(entries, found, chunk_rows=2048)
    return out.select("session", "place", "turn", "started_ms", "entries", "tool_errors", "anchor_line", "user_line", F.array_join("models", ",").alias("models"))


@query(
    "rollout_usage",
    f"""WITH {MARKS}, u AS (SELECT session, model, count(*) AS messages, CAST(sum(k * 12) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, CAST(sum(k * 8) AS BIGINT) AS cache_read_tokens FROM d GROUP BY ALL)
        SELECT u.*, round(CASE WHEN input_tokens + output_tokens + cache_read_tokens = 0 THEN 0.0::DOUBLE ELSE input_tokens * r.ir + output_tokens * r.ir * 5 + cache_read_tokens * r.cr END, 8) AS cost FROM u
        LEFT JOIN (SELECT model, input_rate AS ir, coalesce(cache_read_rate, input_rate * 0.1) AS cr FROM pricing WHERE model IN ('brand#1', 'brand#2', 'brand#3') QUALIFY row_number() OVER (PARTITION BY model ORDER BY valid_from DESC NULLS LAST) = 1) r USING (model)""",
    "ev pricing",
)
def _(t):
    deltas, _ = records_b.usage_and_turns(rec_b(t), chunk_rows=4096)
    out = records_b.usage_by_model(deltas, t.pricing)
    return out.select("session", "model", "messages", "input_tokens", "output_tokens", "cache_read_tokens", r("cost", 8).alias("cost"))


@query(
    "rollout_calls",
    """SELECT session, event_id * 2 + 2 AS line, 'c' || event_id AS call_id, CASE WHEN k % 2 = 0 THEN 'echo ' || k ELSE 'git commit -m ''it''\\''''s ' || k || '''' END AS command,
       CASE k % 3 WHEN 0 THEN CASE WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 'error' ELSE 'ok' END ELSE 'missing-result' END AS status,
       CASE WHEN k % 3 < 2 THEN event_id * 2 + 3 END AS result_line FROM ev WHERE event_type = 'error'""",
    "ev",
)
def _(t):
    return records_b.tool_calls(rec_b(t)).select("session", "line", "call_id", "command", "status", "result_line")


@query(
    "rollout_call_counts",
    """SELECT session, count(*) AS calls, count(*) FILTER ((k % 3 = 0 AND k % 5 = 0) OR (k % 3 = 1 AND k % 2 = 1)) AS errors FROM ev WHERE event_type = 'error' GROUP BY session""",
    "ev",
)
def _(t):
    return records_b.call_counts(rec_b(t))


@query(
    "rollout_prompts",
    """SELECT session, event_id * 2 + 2 AS line, 'Message ' || k AS text FROM ev WHERE event_type = 'signup' AND user_id % 2 = 0 AND k % 8 < 4
       UNION ALL SELECT session, event_id * 2 + 2, 'Typed ' || k FROM ev WHERE event_type = 'signup' AND user_id % 2 = 1 AND k % 3 > 0""",
    "ev",
)
def _(t):
    return records_b.prompts(rec_b(t)).select("session", "line", "text")


@query(
    "rollout_extras",
    f"""WITH {COUNTS} SELECT session, CASE WHEN user_id % 10 > 0 AND user_id % 3 = 0 THEN 's' || (user_id + 1) END AS parent_thread, CASE WHEN user_id % 10 > 0 AND user_id % 3 = 0 THEN user_id % 4 END AS spawn_depth,
       user_id % 10 > 0 AND user_id % 3 = 0 AS is_subagent, arg_max('{{"used":' || (k % 4) || '}}', event_id) FILTER (event_type = 'view') AS rate_limits,
       CAST(coalesce(any_value(m.reasoning), 0) AS BIGINT) AS reasoning_tokens, count(*) FILTER (event_type = 'purchase') AS spawned
       FROM ev LEFT JOIN (SELECT session, sum(k % 3 * 2) AS reasoning FROM moved GROUP BY session) m USING (session) GROUP BY session, user_id""",
    "ev",
)
def _(t):
    rec = spawning(t)
    return records_b.extras(rec, records_b.token_deltas(rec, chunk_rows=4096)).select("session", "parent_thread", "spawn_depth", "is_subagent", "rate_limits", "reasoning_tokens", "spawned")


def spawning(t):
    """The records with one more line after each purchase, that of a thread it started."""
    k, n = F.col("k"), F.col("event_id")
    started = F.struct(F.lit("collab_agent_spawn_end").alias("type"), cat("sp", n).alias("call_id"), cat("thread", n).alias("new_thread_id"),
                       F.when(k % 2 == 0, cat("Nick ", k)).alias("new_agent_nickname"), F.when(k % 3 == 0, F.lit("explorer")).alias("new_agent_role"))
    line = js(iso(F.col("ts_ms")).alias("timestamp"), F.lit("event_msg").alias("type"), started.alias("payload"))
    extra = t.ev.where("event_type = 'purchase'").select("session", (n * 2 + 3).alias("line"), line.alias("text"))
    return stored(records_b.records(lines_b(t).union(extra)), "rollouts")


@query(
    "spawned_threads",
    """SELECT session, event_id * 2 + 3 AS line, ts_ms, 'thread' || event_id AS agent, CASE WHEN k % 2 = 0 THEN 'Nick ' || k END AS nickname, CASE WHEN k % 3 = 0 THEN 'explorer' END AS role,
       'sp' || event_id AS call_id, row_number() OVER (PARTITION BY session ORDER BY event_id) AS nth FROM ev WHERE event_type = 'purchase'""",
    "ev",
)
def _(t):
    return records_b.spawned_threads(spawning(t))


@query(
    "rollout_timeline",
    """WITH m AS (SELECT * REPLACE (event_id * 2 + 2 AS line), last_value(CASE WHEN event_type = 'click' AND k % 4 = 0 AND k % 3 > 0 THEN 'brand#' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_id) AS running FROM ev)
       SELECT session, line, ts_ms, 'user' AS kind, CAST(NULL AS VARCHAR) AS status, CASE WHEN user_id % 2 = 0 THEN 'Message ' ELSE 'Typed ' END || k AS text, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS BIGINT) AS result_line
         FROM m WHERE event_type = 'signup' AND ((user_id % 2 = 0 AND k % 8 < 4) OR (user_id % 2 = 1 AND k % 3 > 0))
       UNION ALL SELECT session, line, ts_ms, 'assistant-text', NULL, 'Message ' || k, running, NULL, NULL FROM m WHERE event_type = 'signup' AND user_id % 2 = 0 AND k % 8 >= 4
       UNION ALL SELECT session, line, ts_ms, 'tool-call', CASE k % 3 WHEN 0 THEN CASE WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 'error' ELSE 'ok' END ELSE 'missing-result' END,
         CASE WHEN k % 2 = 0 THEN 'bash -lc echo ' || k ELSE 'git commit -m it''s ' || k END, NULL, CASE WHEN k % 3 < 2 THEN 0 END, CASE WHEN k % 3 < 2 THEN line + 1 END FROM m WHERE event_type = 'error'""",
    "ev",
)
def _(t):
    rec = rec_b(t)
    return timeline.entries_b(rec, records_b.tool_calls(rec), chunk_rows=4096).select("session", "line", "ts_ms", "kind", "status", "text", "model", "duration_ms", "result_line")


@query(
    "rollout_models",
    """SELECT session, event_id * 2 + 2 AS line, last_value(CASE WHEN event_type = 'click' AND k % 4 = 0 AND k % 3 > 0 THEN 'brand#' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_id) AS model
       FROM ev QUALIFY event_type = 'signup'""",
    "ev",
)
def _(t):
    modelled = records_b.with_model(rec_b(t), chunk_rows=4096)
    return modelled.join(t.ev.where("event_type = 'signup'").select("session", (F.col("event_id") * 2 + 2).alias("line")), ["session", "line"]).select("session", "line", "model")


@query(
    "search_fields_b",
    """SELECT session, event_id * 2 + 2 AS line, CASE WHEN k % 8 < 4 THEN 'user' ELSE 'assistant' END AS field, 'Message ' || k AS text FROM ev WHERE event_type = 'signup' AND user_id % 2 = 0
       UNION ALL SELECT session, event_id * 2 + 2, 'user', 'Typed ' || k FROM ev WHERE event_type = 'signup' AND user_id % 2 = 1 AND k % 3 > 0
       UNION ALL SELECT session, event_id * 2 + 2, 'tool_input', CASE WHEN k % 2 = 0 THEN 'bash' || chr(10) || '-lc' || chr(10) || 'echo ' || k ELSE 'git' || chr(10) || 'commit' || chr(10) || '-m' || chr(10) || 'it''s ' || k END FROM ev WHERE event_type = 'error'
       UNION ALL SELECT session, event_id * 2 + 3, 'tool_result', CASE WHEN k % 5 = 0 THEN 'process exited with code 2' ELSE 'fine ' || k END FROM ev WHERE event_type = 'error' AND k % 3 = 0""",
    "ev",
)
def _(t):
    return search.fields_b(rec_b(t)).select("session", "line", "field", "text")
