"""Tool calls and turns."""

from pyspark.sql import functions as F

from ..operators import tools, turns
from .q_shell import usd
from .registry import query
from .roles import ERROR_TEXTS

r = F.round
CLASS_SQL = "CASE k % 7 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(
        ["file-not-found", "string-not-found", "permission-denied", "interrupted", "timeout", "command-failed", "other"]
    )
) + " END"
assert len(ERROR_TEXTS) == 7


RESULTS_SQL = """(SELECT session, thread, call_id, line + k % 3 - 1 AS result_line, k % 2 AS tag FROM calls WHERE has_result
  UNION ALL SELECT session, thread, call_id, line + 5, 2 FROM calls WHERE has_result AND k % 11 = 0)"""


@query(
    "link_results",
    f"""SELECT session, thread, call_id, tool, CASE WHEN result_line IS NULL THEN 'missing-result' WHEN tag = 1 THEN 'error' ELSE 'ok' END AS status,
        result_line FROM calls c LEFT JOIN (SELECT session AS s, thread AS th, call_id AS i, min(result_line) AS rl, arg_min(tag, result_line) AS tag
        FROM {RESULTS_SQL} x GROUP BY ALL) q ON s = session AND th = thread AND i = call_id"""
    .replace("SELECT session, thread, call_id, tool, CASE WHEN result_line", "SELECT session, thread, call_id, tool, CASE WHEN rl")
    .replace("result_line FROM calls c", "rl AS result_line FROM calls c"),
    "calls",
)
def _(t):
    c = t.calls
    done = c.where("has_result")
    res = lambda df, line, tag: df.select(
        "session", "thread", "call_id", line.alias("result_line"), F.lit(0).alias("result_block"), F.col("ts_ms").alias("result_ts_ms"),
        (tag == 1).alias("is_error"), F.lit("").alias("result_text"), F.lit(0).cast("bigint").alias("result_chars"),
    )
    results = res(done, F.col("line") + F.col("k") % 3 - 1, F.col("k") % 2).union(res(done.where("k % 11 = 0"), F.col("line") + 5, F.lit(2)))
    base = c.select("session", "thread", "call_id", "tool", "line", "ts_ms")
    return tools.with_status(tools.link_results(base, results)).select("session", "thread", "call_id", "tool", "status", "result_line")


@query(
    "tool_status",
    f"""SELECT session, call_id, CASE WHEN NOT has_result THEN 'missing-result' WHEN is_error THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN has_result THEN k * 1000 END AS duration_ms, CASE WHEN is_error THEN {CLASS_SQL} END AS error_class FROM calls""",
    "calls",
)
def _(t):
    return tools.with_status(t.calls).select("session", "call_id", "status", "duration_ms", "error_class")


@query(
    "tool_stats",
    """SELECT session, tool, count(*) AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (NOT has_result) AS missing_results
       FROM calls GROUP BY session, tool""",
    "calls",
)
def _(t):
    return tools.tool_stats(t.calls)


@query(
    "tool_error_classes",
    f"SELECT session, tool, {CLASS_SQL} AS error_class, count(*) AS errors FROM calls WHERE is_error GROUP BY ALL",
    "calls",
)
def _(t):
    return tools.error_classes(t.calls)


CELLS = ", ".join(
    f"count(*) FILTER ({CLASS_SQL} = '{c}') AS {c.replace('-', '_')}"
    for c in ["file-not-found", "string-not-found", "permission-denied", "interrupted", "timeout", "command-failed", "other"]
)


@query(
    "error_matrix",
    f"SELECT coalesce(tool, '(all)') AS tool, {CELLS}, count(*) AS total FROM calls WHERE is_error GROUP BY ROLLUP (tool)",
    "calls",
)
def _(t):
    return tools.error_matrix(t.calls)


@query(
    "identical_runs",
    """
    SELECT session, thread, tool, count(*) AS count, min(line) AS first_line, max(line) AS last_line FROM (
      SELECT *, sum(brk) OVER (PARTITION BY session, thread ORDER BY line) AS run FROM (
        SELECT *, CASE WHEN tool = lag(tool) OVER w AND input = lag(input) OVER w THEN 0 ELSE 1 END AS brk
        FROM calls2 WINDOW w AS (PARTITION BY session, thread ORDER BY line)) x) y
    GROUP BY session, thread, tool, input, run HAVING count(*) >= 2
    """.replace("calls2", "(SELECT session, thread, line, tool, CASE WHEN tool = 'Bash' THEN '' ELSE tool END AS input FROM calls)"),
    "calls",
)
def _(t):
    same = F.when(F.col("tool") == "Bash", F.lit("")).otherwise(F.col("tool"))
    return tools.identical_runs(t.calls.withColumn("input", same), chunk_rows=2048).drop("subject")


PATH = "'/repo/d' || (k % 7) || '/f' || (k % 13) || '.py'"


def coarse_reads(t):
    """Reads of few files, so that files are read often."""
    return t.calls.withColumn("input", F.concat(F.lit('{"file_path":"/repo/d'), (F.col("k") % 3).cast("string"), F.lit('.py"}')))


@query(
    "file_rereads",
    """SELECT session, thread, '/repo/d' || (k % 3) || '.py' AS path, count(*) AS count, min(line) AS first_line, max(line) AS last_line FROM calls
       WHERE tool = 'Read' GROUP BY ALL HAVING count(*) >= 4""",
    "calls",
)
def _(t):
    return tools.rereads(coarse_reads(t))


@query(
    "file_reread_lines",
    """SELECT session, thread, path, line FROM (SELECT session, thread, '/repo/d' || (k % 3) || '.py' AS path, line,
       count(*) OVER (PARTITION BY session, thread, k % 3) AS n FROM calls WHERE tool = 'Read') x WHERE n >= 4""",
    "calls",
)
def _(t):
    return tools.reread_lines(coarse_reads(t))


@query(
    "repeated_failures",
    """SELECT session, thread, tool, count(*) AS count, min(line) AS first_line, substr(command, 1, 200) AS subject FROM (
       SELECT c.session, c.thread, c.tool, c.line, m.command FROM calls c JOIN commands m USING (session, line) WHERE c.is_error) x
       GROUP BY session, thread, tool, command HAVING count(*) >= 2""",
    "calls commands",
)
def _(t):
    return tools.repeated_failures(t.calls)


@query(
    "exploration",
    f"""
    SELECT e.session, read_calls, edit_calls, round(CASE WHEN edit_calls > 0 THEN read_calls / edit_calls END, 9) AS read_edit_ratio, files_read, files_edited,
      nullif((SELECT count(*) FROM prompts p WHERE p.session = e.session AND p.line <= e.fl), 0) AS first_edit_turn, fts - s.f AS time_to_first_edit_ms
    FROM (SELECT session, count(*) FILTER (tool IN ('Read', 'Grep')) AS read_calls, count(*) FILTER (tool = 'Edit') AS edit_calls,
        count(DISTINCT {PATH}) FILTER (tool = 'Read') AS files_read, count(DISTINCT {PATH}) FILTER (tool = 'Edit') AS files_edited,
        min(line) FILTER (tool = 'Edit') AS fl, min(ts_ms) FILTER (tool = 'Edit') AS fts FROM calls WHERE thread = 'main' GROUP BY session) e
    JOIN (SELECT session, min(ts_ms) AS f FROM ev GROUP BY session) s USING (session)
    """,
    "calls prompts ev",
)
def _(t):
    sessions = t.ev.groupBy("session").agg(F.min("ts_ms").alias("first_ts_ms"))
    return tools.exploration(t.calls, t.prompts, sessions).withColumn("read_edit_ratio", r("read_edit_ratio", 9))


TSUM = """count(*) AS calls, count(*) FILTER (is_error) AS errors, CAST(sum(result_chars) AS BIGINT) AS result_chars,
  CAST(ceil(sum(result_chars) / 4.0) AS BIGINT) AS estimated_tokens, sum(est_usd) AS est_usd"""
BY_TOOL = f"""SELECT g.* EXCLUDE (m), CASE WHEN sum(result_chars) OVER (PARTITION BY session) > 0
      THEN round(result_chars / sum(result_chars) OVER (PARTITION BY session) * 1000) / 10 ELSE 0 END AS share_pct,
    CASE WHEN result_chars > 0 THEN round(m / result_chars * 1000) / 10 ELSE 0 END AS main_share_pct
  FROM (SELECT session, tool, {TSUM}, coalesce(sum(result_chars) FILTER (thread = 'main'), 0) AS m FROM priced_calls GROUP BY session, tool) g"""


@query("tool_usage_totals", f"SELECT * REPLACE (round(est_usd, 8) AS est_usd) FROM (SELECT session, {TSUM} FROM priced_calls GROUP BY session) x", "priced_calls")
def _(t):
    return usd(tools.usage_totals(t.priced_calls))


@query("tool_usage", f"SELECT * REPLACE (round(est_usd, 8) AS est_usd) FROM ({BY_TOOL}) x", "priced_calls")
def _(t):
    return usd(tools.usage_by_tool(t.priced_calls))


@query(
    "tool_usage_by_thread",
    f"""SELECT g.* REPLACE (round(est_usd, 8) AS est_usd), CASE WHEN c > 0 THEN round(g.result_chars / c * 1000) / 10 ELSE 0 END AS chars_share_pct,
        CASE WHEN u > 0 THEN round(g.est_usd / u * 1000) / 10 END AS usd_share_pct
        FROM (SELECT session, thread, min(model) AS model, {TSUM} FROM priced_calls GROUP BY session, thread) g
        JOIN (SELECT session, sum(result_chars) AS c, sum(est_usd) AS u FROM priced_calls GROUP BY session) w USING (session)""",
    "priced_calls",
)
def _(t):
    return usd(tools.usage_by_thread(t.priced_calls))


@query(
    "tool_heavy_hitters",
    """SELECT session, rank, tool, thread, line, call_id, result_chars, round(est_usd, 8) AS est_usd FROM (SELECT *,
       row_number() OVER (PARTITION BY session ORDER BY result_chars DESC, thread, line) AS rank FROM priced_calls) x WHERE rank <= 10""",
    "priced_calls",
)
def _(t):
    return usd(tools.heavy_hitters(t.priced_calls))


@query(
    "tool_source_split",
    f"""SELECT session, starts_with(tool, 'mcp__') AS is_mcp, count(*) AS tools,
        count(DISTINCT CASE WHEN starts_with(tool, 'mcp__') THEN split_part(tool, '__', 2) END) AS servers, CAST(sum(calls) AS BIGINT) AS calls,
        CAST(sum(result_chars) AS BIGINT) AS result_chars, round(sum(est_usd), 8) AS est_usd FROM ({BY_TOOL}) b GROUP BY ALL""",
    "priced_calls",
)
def _(t):
    return usd(tools.source_split(tools.usage_by_tool(t.priced_calls)))


@query(
    "tool_ranking",
    f"""
    WITH b AS ({BY_TOOL.replace("SELECT session, tool,", "SELECT thread AS session, tool,").replace("GROUP BY session, tool", "GROUP BY thread, tool")}),
    q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(coalesce(est_usd, -1), 9) DESC, result_chars DESC, tool) AS n FROM b)
    SELECT session, least(n, 9) AS place, CASE WHEN n <= 8 THEN tool ELSE 'rest' END AS name, count(*) AS tools, CAST(sum(calls) AS BIGINT) AS calls,
      CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(result_chars) AS BIGINT) AS result_chars, round(sum(est_usd), 8) AS est_usd FROM q GROUP BY ALL
    UNION ALL SELECT session, 0, 'total', count(*), CAST(sum(calls) AS BIGINT), CAST(sum(errors) AS BIGINT), CAST(sum(result_chars) AS BIGINT), round(sum(est_usd), 8)
      FROM b GROUP BY session
    """.replace("priced_calls", "(SELECT * REPLACE (CASE WHEN tool = 'Bash' THEN 'Bash' || (k % 5) ELSE tool END AS tool) FROM priced_calls)"),
    "priced_calls",
)
def _(t):
    split = F.when(F.col("tool") == "Bash", F.concat(F.lit("Bash"), (F.col("k") % 5).cast("string"))).otherwise(F.col("tool"))
    per_thread = t.priced_calls.withColumns({"tool": split, "session": F.col("thread"), "thread": F.lit("main")})
    by_tool = tools.usage_by_tool(per_thread).withColumn("est_usd", r("est_usd", 9))
    return usd(tools.ranking(by_tool))


@query(
    "tool_decisions",
    f"""
    SELECT d.session, top_cost.t AS top_cost_tool, CASE WHEN usd > 0 THEN round(top_cost.v / usd * 1000) / 10 END AS top_cost_pct,
      top_err.t AS top_error_tool, CASE WHEN errs > 0 THEN round(top_err.v / errs * 1000) / 10 END AS top_error_pct,
      big.t AS largest_tool, big.v AS largest_chars, CASE WHEN ch > 0 THEN round(mc / ch * 1000) / 10 ELSE 0 END AS main_share_pct
    FROM (SELECT session, arg_min({{'t': tool, 'v': est_usd}}, (-round(est_usd, 9), tool)) FILTER (est_usd IS NOT NULL) AS top_cost, sum(est_usd) AS usd,
            arg_min({{'t': tool, 'v': errors}}, (-errors, tool)) FILTER (errors > 0) AS top_err, sum(errors) AS errs FROM ({BY_TOOL}) b GROUP BY session) d
    JOIN (SELECT session, arg_min({{'t': tool, 'v': result_chars}}, (-result_chars, thread, line)) AS big, sum(result_chars) AS ch,
            coalesce(sum(result_chars) FILTER (thread = 'main'), 0) AS mc FROM priced_calls GROUP BY session) c USING (session)
    """,
    "priced_calls",
)
def _(t):
    by_tool = tools.usage_by_tool(t.priced_calls).withColumn("est_usd", r("est_usd", 9))
    return tools.decisions(by_tool, t.priced_calls)


@query(
    "call_page",
    """SELECT session, position, line, thread, tool, call_id, total FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line, thread) AS position,
       count(*) OVER (PARTITION BY session) AS total FROM calls WHERE thread = 'main') x""",
    "calls",
)
def _(t):
    return tools.call_page(t.calls, thread="main", limit=None)


# Turns ----------------------------------------------------------------------

TURN_OF = """(SELECT m.*, greatest(1, (SELECT count(*) FROM prompts p WHERE p.session = m.session AND p.line <= m.line)) AS turn
  FROM {rows} m WHERE m.session IN (SELECT session FROM prompts))"""
TURN_USAGE = f"""
  SELECT p.session, p.turn, p.line AS turn_line, p.ts_ms AS turn_ts_ms, count(m.message_id) AS messages,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens,
    sum(cost) AS cost, count(*) FILTER (m.message_id IS NOT NULL AND cost IS NULL) AS unpriced
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS turn FROM prompts) p
  LEFT JOIN {TURN_OF.format(rows="evcosted")} m ON m.session = p.session AND m.turn = p.turn GROUP BY ALL
"""


def turn_rows(t):
    return turns.assign_turns(t.evcosted, t.prompts, chunk_rows=2048)


def turn_usage(t):
    return turns.turn_usage(turn_rows(t), t.prompts, chunk_rows=2048)


@query("turn_assignment", f"SELECT session, message_id, turn FROM {TURN_OF.format(rows='evmessages')} x", "evmessages prompts")
def _(t):
    return turns.assign_turns(t.evmessages, t.prompts, chunk_rows=2048).select("session", "message_id", "turn")


@query(
    "turn_usage",
    f"SELECT * REPLACE (round(cost, 8) AS cost), cost IS NOT NULL AND unpriced > 0 AS cost_partial FROM ({TURN_USAGE}) x",
    "evcosted prompts",
)
def _(t):
    return usd(turn_usage(t), "cost")


@query(
    "turn_steps",
    f"SELECT session, turn, line, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, round(cost, 8) AS cost FROM {TURN_OF.format(rows='evcosted')} x",
    "evcosted prompts",
)
def _(t):
    return usd(turn_rows(t).select(
        "session", "turn", "line", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost"), "cost")


@query(
    "outlier_turns",
    f"""SELECT session, turn, round(cost, 8) AS cost, coalesce(cost > sum(cost) OVER (PARTITION BY session) * 0.25 AND cost >= 0.1, false) AS is_outlier
        FROM ({TURN_USAGE}) x""",
    "evcosted prompts",
)
def _(t):
    return usd(turns.outlier_turns(turn_usage(t)).select("session", "turn", "cost", "is_outlier"), "cost")


@query(
    "turn_pages",
    f"""SELECT session, turn, entries FROM (SELECT *, sum(entries) OVER (PARTITION BY session ORDER BY turn) - entries AS before FROM (
        SELECT session, turn, count(*) AS entries FROM {TURN_OF.format(rows='calls')} c GROUP BY ALL) x) y WHERE before < 20""",
    "calls prompts",
)
def _(t):
    sizes = turns.assign_turns(t.calls, t.prompts, chunk_rows=2048).groupBy("session", "turn").agg(F.count(F.lit(1)).alias("entries"))
    return turns.pages(sizes, 20)


@query(
    "turns_and_compactions",
    f"""SELECT session, turn_line AS line, 0 AS kind_order, 'turn' AS kind, turn AS value FROM ({TURN_USAGE}) x
        UNION ALL SELECT session, line, 1, 'compaction', k * 1000 FROM ev WHERE event_type = 'purchase' AND k % 10 = 0""",
    "evcosted prompts ev",
)
def _(t):
    compactions = t.ev.where("event_type = 'purchase' AND k % 10 = 0").select("session", "line", (F.col("k") * 1000).alias("pre_tokens"))
    return turns.interleave(turn_usage(t), compactions)


@query(
    "turn_groups",
    f"""
    SELECT u.session, u.turn, turn_line, turn_ts_ms, messages, round(u.cost, 8) AS cost, u.cost IS NOT NULL AND unpriced > 0 AS cost_partial,
      coalesce(n, 0) AS entries, coalesce(errs, 0) AS tool_errors, round(dc, 8) AS delegated_cost, coalesce(inc, false) AS delegated_incomplete,
      CASE WHEN lt >= turn_ts_ms THEN lt - turn_ts_ms END AS duration_ms
    FROM ({TURN_USAGE}) u LEFT JOIN (
      SELECT session, turn, count(*) AS n, count(*) FILTER (tool <> 'Edit' AND is_error) AS errs,
        sum(CASE WHEN tool = 'Edit' THEN coalesce(sc, 0.5) END) AS dc, bool_or(tool = 'Edit' AND (sc IS NULL OR NOT ok)) AS inc, arg_max(ts_ms, line) AS lt
      FROM (SELECT c.*, sc, ok FROM {TURN_OF.format(rows='calls')} c LEFT JOIN (SELECT session AS ss, thread AS st, sum(cost) AS sc, count(cost) = count(*) AS ok
        FROM evcosted GROUP BY ALL) s ON ss = c.session AND st = c.thread) z GROUP BY session, turn) g USING (session, turn)
    """,
    "evcosted prompts calls",
)
def _(t):
    entries = t.calls.select(
        "session", "line", "ts_ms", F.when(F.col("tool") == "Edit", F.lit("subagent-launch")).otherwise(F.lit("tool-call")).alias("kind"),
        F.when(F.col("is_error"), F.lit("error")).otherwise(F.lit("ok")).alias("status"), F.col("thread").alias("agent"), F.lit(0.5).alias("cost"),
    )
    trees = t.evcosted.groupBy("session", F.col("thread").alias("agent")).agg(
        F.sum("cost").alias("subtree_cost"), (F.count("cost") == F.count(F.lit(1))).alias("subtree_complete"))
    return usd(turns.turn_groups(entries, t.prompts, turn_usage(t), trees, chunk_rows=2048), "cost", "delegated_cost")


@query(
    "request_grouping",
    """
    SELECT session, thread, arg_min(id, line) AS request_key, min(line) AS first_line, max(line) AS last_line, count(*) AS records, n - 1 AS ordinal FROM (
      SELECT *, sum(CASE WHEN a AND (id IS DISTINCT FROM pid) THEN 1 ELSE 0 END) OVER (PARTITION BY session, thread ORDER BY line) AS n FROM (
        SELECT *, lag(id) OVER (PARTITION BY session, thread ORDER BY line) AS pid FROM (
          SELECT session, thread, line, event_type <> 'signup' AS a, CASE WHEN event_type <> 'signup' THEN CASE WHEN k % 2 = 0 THEN 'req' || (k % 4)
            WHEN k % 5 = 0 THEN 'msg' || (k % 3) ELSE 'line:' || line END END AS id FROM ev) x) y) z
    WHERE a GROUP BY session, thread, n
    """,
    "ev",
)
def _(t):
    k = F.col("k")
    records = t.ev.select(
        "session", "thread", "line", F.when(F.col("event_type") != "signup", F.lit("assistant")).otherwise(F.lit("user")).alias("kind"),
        F.when(k % 2 == 0, F.concat(F.lit("req"), (k % 4).cast("string"))).alias("request_id"),
        F.when(k % 5 == 0, F.concat(F.lit("msg"), (k % 3).cast("string"))).alias("message_id"),
    )
    return turns.requests(records, chunk_rows=2048)
