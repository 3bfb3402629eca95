"""Files, skills, tasks, delegation trees, context policies."""

from pyspark.sql import functions as F

from ..functions.ordered import running
from ..operators import files, forest, policy, skills, tasks, timeline
from ..session import stored
from .registry import query

r = F.round

# Files ----------------------------------------------------------------------

def doc_texts(t):
    k = F.col("k")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    body = cat("intro\nContents of /docs/p", (k % 9).cast("string"), ".md (project):\n", F.repeat(F.lit("x"), k.cast("int")),
               F.when(k % 3 == 0, F.lit("\nContents of /docs/q.md (user):\nyyyyy")).otherwise(F.lit("")))
    return t.ev.where("event_type = 'signup'").select("session", "thread", "line", "ts_ms", body.alias("text"))


DOCS = """(SELECT session, thread, line, ts_ms, '/docs/p' || (k % 9) || '.md' AS path, 1 + k + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS chars
    FROM ev WHERE event_type = 'signup'
  UNION ALL SELECT session, thread, line, ts_ms, '/docs/q.md', 6 FROM ev WHERE event_type = 'signup' AND k % 3 = 0)"""


@query("injected_documents", f"SELECT * FROM {DOCS} d", "ev")
def _(t):
    return files.injected_documents(doc_texts(t))


ACCESS = f"""(SELECT session, path, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(inj) AS BIGINT) AS injections,
    CAST(sum(chars) AS BIGINT) AS injected_chars, min(ts_ms) AS first_ts_ms, min(line) FILTER (thread = 'main') AS first_main_line,
    CASE WHEN bool_or(thread = 'main') AND bool_or(thread <> 'main') THEN 'both' WHEN bool_or(thread = 'main') THEN 'main' ELSE 'subagent' END AS threads
  FROM (SELECT session, thread, line, ts_ms, '/repo/d' || (k % 7) || '/f' || (k % 13) || '.py' AS path, CASE WHEN tool = 'Read' THEN 1 ELSE 0 END AS reads,
          CASE WHEN tool = 'Edit' THEN 1 ELSE 0 END AS edits, 0 AS inj, 0 AS chars FROM calls WHERE tool IN ('Read', 'Edit')
        UNION ALL SELECT session, thread, line, ts_ms, path, 0, 0, 1, chars FROM {DOCS} d) x GROUP BY session, path)"""


def access(t):
    touches = files.call_touches(t.calls).unionByName(files.injection_touches(files.injected_documents(doc_texts(t))))
    return files.file_access(touches)


@query("file_access", f"SELECT * FROM {ACCESS} a", "calls ev")
def _(t):
    return access(t)


@query(
    "file_access_capped",
    f"""SELECT session, path, rank, omitted FROM (SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY reads + edits + injections DESC, path) AS rank,
        0 AS omitted FROM {ACCESS} a) x""",
    "calls ev",
)
def _(t):
    return files.capped_access(access(t)).select("session", "path", "rank", "omitted")


@query(
    "directory_totals",
    f"""
    WITH f AS (SELECT session, path, reads, edits, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM {ACCESS} a),
    d AS (SELECT session, reads, edits, p, unnest(range(1, len(p))) AS depth FROM f),
    tot AS (SELECT session, array_to_string(p[1:depth], '/') AS dir, depth, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(edits) AS BIGINT) AS edits,
              count(DISTINCT p[depth + 1]) FILTER (depth = len(p) - 1) AS files, count(DISTINCT p[depth + 1]) FILTER (depth < len(p) - 1) AS dirs
            FROM d GROUP BY ALL),
    kept AS (SELECT * FROM tot WHERE NOT (files = 0 AND dirs = 1))
    SELECT session, dir, reads, edits, files, dirs,
      substr(dir, coalesce((SELECT max(length(o.dir)) + 2 FROM kept o WHERE o.session = k.session AND starts_with(k.dir, o.dir || '/')), 1)) AS label
    FROM kept k
    """,
    "calls ev",
)
def _(t):
    return files.directory_totals(access(t))


@query(
    "file_scope",
    f"""SELECT session, path, CASE WHEN starts_with(path, '/repo/d' || (u % 7) || '/') THEN 'repo' ELSE 'system' END AS scope
        FROM {ACCESS} a JOIN (SELECT DISTINCT session, user_id AS u FROM ev) s USING (session)""",
    "calls ev",
)
def _(t):
    sessions = t.ev.select("session", F.concat(F.lit("/repo/d"), (F.col("user_id") % 7).cast("string")).alias("cwd")).distinct()
    return files.scoped(access(t), sessions).select("session", "path", "scope")


@query(
    "command_read_paths",
    """SELECT call_id, CASE k % 10 WHEN 1 THEN '/var/log/app' || k || '.log' WHEN 4 THEN '/w/src/f' || k || '.txt' WHEN 7 THEN '/w/in.txt' END AS path
       FROM commands WHERE k % 10 IN (1, 4, 7)""",
    "commands",
)
def _(t):
    return t.commands.select("call_id", F.explode(files.read_paths(F.col("command"), F.lit("/w"))).alias("path"))


@query(
    "program_commands",
    """SELECT event_id, 'git log -n ' || k AS cmd, 'src/f' || k || '.ts' AS patch FROM ev""",
    "ev",
)
def _(t):
    k = F.col("k").cast("string")
    program = F.concat(
        F.lit('const r = await tools.exec_command({workdir: "/w", cmd: "git log -n '), k,
        F.lit('", yield_time_ms: 5});\nawait tools.apply_patch(`*** Begin Patch\n*** Update File: src/f'), k, F.lit(".ts\n*** End Patch`);"),
    )
    base = t.ev.select("event_id", program.alias("p"))
    return base.select(
        "event_id", F.get(files.program_commands(F.col("p")), F.lit(0)).alias("cmd"),
        F.get(files.program_patch_paths(F.col("p")), F.lit(0)).alias("patch"),
    )


@query(
    "agents_documents",
    """SELECT session, thread, line, ts_ms, '/w/p' || (k % 4) AS path, CASE WHEN k % 2 = 0 THEN 5 + 23 + k ELSE k END AS chars,
       CASE WHEN k % 2 = 0 THEN 5 END AS user_chars, CASE WHEN k % 2 = 0 THEN k END AS project_chars FROM ev WHERE event_type = 'view' AND k > 0""",
    "ev",
)
def _(t):
    k = F.col("k")
    body = F.concat(
        F.lit("# AGENTS.md instructions for /w/p"), (k % 4).cast("string"), F.lit("/\n\n"),
        F.when(k % 2 == 0, F.lit("users" + files.PROJECT_DOC)).otherwise(F.lit("")), F.repeat(F.lit("z"), k.cast("int")), F.lit("\n"),
    )
    return files.agents_documents(t.ev.where("event_type = 'view' AND k > 0").select("session", "thread", "line", "ts_ms", body.alias("text")))


# Skills ---------------------------------------------------------------------

SKILL_MATCH = """
    WITH c AS (SELECT session, k % 3 AS s, 't' || event_id AS call_id, line, line + 1 AS pos FROM ev WHERE event_type = 'purchase'),
    b AS (SELECT session, k % 3 AS s, line, k + 50 AS chars, row_number() OVER (PARTITION BY session, k % 3 ORDER BY line) - 1 AS slot
          FROM ev WHERE event_type = 'view' AND k % 4 = 0),
    f AS (SELECT c.*, (SELECT count(*) FROM b WHERE b.session = c.session AND b.s = c.s AND b.line <= c.pos) AS first,
            row_number() OVER (PARTITION BY session, s ORDER BY pos) - 1 AS nth FROM c),
    p AS (SELECT *, nth + max(first - nth) OVER (PARTITION BY session, s ORDER BY pos) AS slot FROM f)
    SELECT p.session, p.call_id, b.line AS body_line FROM p JOIN b USING (session, s, slot)
"""


def skill_inputs(t):
    k = F.col("k")
    name = F.concat(F.lit("sk"), (k % 3).cast("string"))
    calls = t.ev.where("event_type = 'purchase'").select(
        "session", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("call_id"), "line", (F.col("line") + 1).alias("after_line"), name.alias("short_name"))
    bodies = t.ev.where("event_type = 'view' AND k % 4 = 0").select(
        "session", "line", "ts_ms", F.concat(F.lit("/skills/"), name).alias("base_path"), name.alias("short_name"), (k + 50).alias("chars"))
    return calls, bodies


@query("skill_bodies", SKILL_MATCH, "ev")
def _(t):
    return skills.match_bodies(*skill_inputs(t), chunk_rows=1024).select("session", "call_id", "body_line")


TURN = "(SELECT count(*) FROM prompts p WHERE p.session = e.session AND p.line <= e.line)"


@query(
    "skill_invocations",
    f"""SELECT session, line, 'skill' AS kind, 'plug:sk' || (k % 3) AS name, CASE WHEN session IN (SELECT session FROM prompts) THEN greatest(1, {TURN}) END AS turn FROM ev e WHERE event_type = 'purchase'
        UNION ALL SELECT session, line, 'command', '/cmd' || (k % 5), CASE WHEN session IN (SELECT session FROM prompts) THEN greatest(1, {TURN}) END FROM ev e WHERE event_type = 'click'""",
    "ev prompts",
)
def _(t):
    k = F.col("k")
    calls = t.ev.where("event_type = 'purchase'").select(
        "session", F.lit("main").alias("thread"), "line", "ts_ms", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("call_id"), F.lit("Skill").alias("tool"),
        F.concat(F.lit('{"skill":"plug:sk'), (k % 3).cast("string"), F.lit('"}')).alias("input"), F.lit(3).cast("bigint").alias("result_chars"), (F.col("line") + 1).alias("result_line"))
    meta = t.ev.where("event_type = 'view' AND k % 4 = 0").select(
        "session", "line", "ts_ms", F.concat(F.lit("Base directory for this skill: /skills/sk"), (k % 3).cast("string"), F.lit("\nbody")).alias("text"))
    typed = t.ev.where("event_type = 'click'").select(
        "session", "line", "ts_ms", F.concat(F.lit("<command-name>/cmd"), (k % 5).cast("string"), F.lit("</command-name><command-args></command-args>")).alias("text"))
    return skills.invocations(calls, typed, meta, t.prompts, chunk_rows=2048).select("session", "line", "kind", "name", "turn")


@query(
    "skill_links",
    """SELECT session, line, row_number() OVER (PARTITION BY session ORDER BY line) AS turn, unnest(CASE WHEN k % 2 = 0 THEN ['plug:sk' || (k % 3), 'two:b'] ELSE ['plug:sk' || (k % 3)] END) AS name
       FROM ev WHERE event_type = 'signup'""",
    "ev",
)
def _(t):
    k = F.col("k")
    body = F.concat(F.lit("use [$plug:sk"), (k % 3).cast("string"), F.lit("](/s/SKILL.md)"), F.when(k % 2 == 0, F.lit(" and [$two:b](/t)")).otherwise(F.lit("")))
    return skills.linked_skills(t.ev.where("event_type = 'signup'").select("session", "line", body.alias("text")), chunk_rows=2048)


# Tasks ----------------------------------------------------------------------

LAUNCHES = """(SELECT session, thread, CASE WHEN k % 2 = 0 THEN 'bash' ELSE 'agent' END AS kind, 'task' || (event_id % 400) AS task_id, call_id, line + 1 AS line, ts_ms FROM calls
  WHERE tool = 'Bash' AND k % 4 < 2)"""
NOTES = """(SELECT session, thread, 'task' || (event_id % 400) AS task_id, line, ts_ms, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN k % 5 = 0 THEN k % 2 END AS exit_code FROM ev WHERE event_type = 'view')"""
LAST_NOTE = f"(SELECT session, thread, task_id, arg_max({{'l': line, 's': status, 'e': exit_code, 't': ts_ms}}, line) AS n FROM {NOTES} x GROUP BY ALL)"
NOTE_STATUS = "CASE WHEN n IS NULL THEN 'unresolved' WHEN n.e IS NOT NULL THEN CASE WHEN n.e = 0 THEN 'completed' ELSE 'failed' END WHEN n.s = 'failed' THEN 'failed' ELSE 'completed' END"


def task_inputs(t):
    k = F.col("k")
    task = F.concat(F.lit("task"), (F.col("event_id") % 400).cast("string"))
    details = t.calls.where("tool = 'Bash' AND k % 4 < 2").select(
        "session", "thread", F.when(k % 2 == 0, F.lit("bash")).otherwise(F.lit("agent")).alias("kind"), task.alias("task_id"), "call_id",
        (F.col("line") + 1).alias("line"), "ts_ms", F.lit(None).cast("string").alias("description"))
    notes = t.ev.where("event_type = 'view'").select(
        "session", "thread", task.alias("task_id"), "line", "ts_ms", F.when(k % 3 == 0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(k % 5 == 0, k % 2).alias("exit_code"))
    return tasks.launches(details, t.calls), notes


@query(
    "background_launches",
    f"SELECT l.session, l.thread, kind, task_id, l.call_id, l.line, CASE WHEN kind = 'bash' THEN command ELSE 'subagent' END AS name FROM {LAUNCHES} l JOIN commands USING (call_id)"
    .replace("l.call_id, l.line", "call_id, l.line"),
    "calls commands",
)
def _(t):
    return task_inputs(t)[0].drop("ts_ms")


@query(
    "launch_outcomes",
    f"SELECT session, thread, call_id, {NOTE_STATUS} AS status, n.l AS note_line FROM {LAUNCHES} l LEFT JOIN {LAST_NOTE} q USING (session, thread, task_id)",
    "calls ev",
)
def _(t):
    return tasks.launch_outcomes(*task_inputs(t)).select("session", "thread", "call_id", "status", "note_line")


@query(
    "task_executions",
    f"""SELECT c.session, c.thread, 'bash' AS kind, true AS background, l.task_id, {NOTE_STATUS} AS status, c.line AS start_line, n.l AS end_line,
          CASE WHEN n.t >= c.ts_ms THEN n.t - c.ts_ms END AS duration_ms
        FROM calls c JOIN {LAUNCHES} l USING (session, thread, call_id) LEFT JOIN {LAST_NOTE} q ON q.session = c.session AND q.thread = c.thread AND q.task_id = l.task_id
        UNION ALL SELECT session, thread, 'bash', false, call_id, CASE WHEN NOT has_result THEN 'unresolved' WHEN is_error THEN 'failed' ELSE 'completed' END, line, result_line,
          result_ts_ms - ts_ms FROM calls WHERE tool = 'Bash' AND NOT (k % 4 < 2)""",
    "calls ev",
)
def _(t):
    out = tasks.executions(t.calls, *task_inputs(t))
    return out.select("session", "thread", "kind", "background", "task_id", "status", "start_line", "end_line", "duration_ms")


@query(
    "preview_servers",
    """SELECT a.session, a.thread, CASE WHEN a.k % 6 = 0 THEN 'preview:' || a.line ELSE 'srv' || a.k END AS task_id, CASE WHEN b.l IS NULL THEN 'unresolved' ELSE 'stopped' END AS status, b.l AS end_line
       FROM (SELECT * FROM ev WHERE event_type = 'click') a LEFT JOIN (SELECT session, thread, k, max(line) AS l FROM ev WHERE event_type = 'error' GROUP BY ALL) b
       ON a.session = b.session AND a.thread = b.thread AND a.k = b.k AND a.k % 6 <> 0""",
    "ev",
)
def _(t):
    sid = F.concat(F.lit("srv"), F.col("k").cast("string"))
    start = F.col("event_type") == "click"
    rows = t.ev.where("event_type IN ('click', 'error')").select(
        "session", "thread", "line", "ts_ms", F.when(start, F.lit(tasks.PREVIEW_START)).otherwise(F.lit(tasks.PREVIEW_STOP)).alias("tool"),
        F.when(start, F.lit('{"name":"web"}')).otherwise(F.concat(F.lit('{"serverId":"'), sid, F.lit('"}'))).alias("input"),
        F.when(start & (F.col("k") % 6 != 0), F.concat(F.lit('{"serverId": "'), sid, F.lit('"}'))).alias("result_text"))
    return tasks.previews(rows).select("session", "thread", "task_id", "status", "end_line")


@query(
    "notification_entries",
    f"""SELECT session, thread, line, task_id, status, coalesce(cl, ll) AS start_line, CASE WHEN ts_ms >= ct THEN ts_ms - ct END AS duration_ms FROM {NOTES} n
        LEFT JOIN (SELECT session, thread, task_id, arg_max(call_id, line) AS call_id, max(line) AS ll FROM {LAUNCHES} l GROUP BY ALL) l USING (session, thread, task_id)
        LEFT JOIN (SELECT session, thread, call_id, line AS cl, ts_ms AS ct FROM calls) c USING (session, thread, call_id)""",
    "calls ev",
)
def _(t):
    launched, notes = task_inputs(t)
    return tasks.notification_entries(notes, launched, t.calls).select("session", "thread", "line", "task_id", "status", "start_line", "duration_ms")


# Trees ----------------------------------------------------------------------

NODES = """SELECT 's' AS session, 'n' || p_partkey AS agent, CASE WHEN p_partkey >= 5 THEN 'n' || (p_partkey // 5) END AS parent, p_partkey * 7 AS tokens,
  CASE WHEN p_size % 11 <> 0 THEN p_retailprice END AS cost, p_size % 11 <> 0 AS cost_is_complete, p_partkey * 1000 AS start_ms, p_partkey * 1000 + p_size * 50 AS end_ms,
  CASE WHEN p_partkey < 5 THEN 'run' || (p_partkey % 2) END AS run_id, CASE WHEN p_partkey % 3 = 0 THEN 'plan' WHEN p_partkey % 3 = 1 THEN 'build' END AS phase FROM part"""
TREE = f"""WITH RECURSIVE g AS (SELECT n.*, agent AS root, 0 AS depth, [agent] AS path FROM ({NODES}) n WHERE parent IS NULL
  UNION ALL SELECT n.*, g.root, g.depth + 1, list_append(g.path, n.agent) FROM ({NODES}) n JOIN g ON n.parent = g.agent),
  tot AS (SELECT session, a AS agent, count(*) AS nodes, CAST(sum(tokens) AS BIGINT) AS subtree_tokens, sum(coalesce(cost, 0)) AS subtree_cost,
    bool_and(cost_is_complete) AS subtree_complete, max(end_ms) - min(start_ms) AS span_ms FROM (SELECT *, unnest(path) AS a FROM g) x GROUP BY ALL)"""


def nodes(t):
    key = F.col("p_partkey")
    return t.raw("part").select(
        F.lit("s").alias("session"), F.concat(F.lit("n"), key.cast("string")).alias("agent"),
        F.when(key >= 5, F.concat(F.lit("n"), F.floor(key / 5).cast("string"))).alias("parent"), (key * 7).alias("tokens"),
        F.when(F.col("p_size") % 11 != 0, F.col("p_retailprice")).alias("cost"), (F.col("p_size") % 11 != 0).alias("cost_is_complete"),
        (key * 1000).alias("start_ms"), (key * 1000 + F.col("p_size") * 50).alias("end_ms"),
        F.when(key < 5, F.concat(F.lit("run"), (key % 2).cast("string"))).alias("run_id"),
        F.when(key % 3 == 0, F.lit("plan")).when(key % 3 == 1, F.lit("build")).alias("phase"),
    )


@query("tree_build", f"{TREE} SELECT session, agent, root, depth, parent AS above, array_to_string(path, '/') AS agent_path FROM g")
def _(t):
    grown = forest.grow(nodes(t))
    return grown.nodes.join(forest.agent_paths(grown), ["session", "agent"]).select("session", "agent", "root", "depth", "above", "agent_path")


@query("subtree_totals", f"{TREE} SELECT * REPLACE (round(subtree_cost, 4) AS subtree_cost) FROM tot")
def _(t):
    return forest.subtree_totals(forest.grow(nodes(t))).withColumn("subtree_cost", r("subtree_cost", 4))


@query(
    "tree_rows",
    f"""{TREE} SELECT session, agent, root, parent AS above, depth, row_number() OVER (PARTITION BY session ORDER BY [CAST(substr(x, 2) AS BIGINT) for x in path]) - 1 AS place, nodes, start_ms,
        row_number() OVER (PARTITION BY session, coalesce(parent, '') ORDER BY start_ms DESC, agent DESC) = 1 AS is_last FROM g JOIN tot USING (session, agent)""",
)
def _(t):
    grown = forest.grow(nodes(t))
    return forest.tree_rows(grown, forest.subtree_totals(grown))


# Rings of seven nodes among the others, and all that hangs below them.
RINGED = f"""SELECT * REPLACE (CASE WHEN tokens // 7 % 100 BETWEEN 90 AND 95 THEN 'n' || (tokens // 7 + 1) WHEN tokens // 7 % 100 = 96 THEN 'n' || (tokens // 7 - 6) ELSE parent END AS parent) FROM ({NODES}) n"""


def ringed(t):
    key = F.expr("tokens div 7")
    parent = F.when((key % 100).between(90, 95), F.concat(F.lit("n"), (key + 1).cast("string"))).when(key % 100 == 96, F.concat(F.lit("n"), (key - 6).cast("string")))
    return nodes(t).withColumn("parent", F.coalesce(parent, "parent"))


@query(
    "tree_unreached",
    f"""WITH RECURSIVE n AS ({RINGED}), g AS (SELECT agent FROM n WHERE parent IS NULL OR parent NOT IN (SELECT agent FROM n) UNION ALL SELECT n.agent FROM n JOIN g ON n.parent = g.agent)
        SELECT session, agent, parent, 'on or below a cycle of parents' AS reason FROM n WHERE agent NOT IN (SELECT agent FROM g)""",
)
def _(t):
    return forest.unreached(ringed(t), forest.grow(ringed(t)))


# Every order of a customer hangs on the one before it; a third of the customers share one session, so one chain holds a third of the rows.
CHAINS = "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'all' ELSE 'c' || o_custkey END AS session, 'o' || o_orderkey AS agent, o_orderkey AS nr, o_custkey AS tokens FROM orders"


@query(
    "tree_chains",
    f"""SELECT session, agent, CAST(count(*) OVER (PARTITION BY session ORDER BY nr) - 1 AS INTEGER) AS depth, count(*) OVER (PARTITION BY session ORDER BY nr) - 1 AS place,
        count(*) OVER (PARTITION BY session ORDER BY nr DESC) AS nodes, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY nr DESC) AS BIGINT) AS subtree_tokens FROM ({CHAINS}) c""",
)
def _(t):
    orders = t.raw("orders").selectExpr(
        "CASE WHEN o_custkey % 3 = 0 THEN 'all' ELSE concat('c', o_custkey) END AS session", "concat('o', o_orderkey) AS agent", "o_orderkey AS nr", "o_custkey AS tokens")
    linked = running(orders, ["session"], "nr", {"parent": ("prev", F.col("agent"))})
    chains = stored(linked.selectExpr("session", "agent", "parent", "tokens", "0.0D AS cost", "true AS cost_is_complete", "nr AS start_ms", "nr AS end_ms"), "chains")
    grown = forest.grow(chains)
    totals = forest.subtree_totals(grown)
    return forest.tree_rows(grown, totals).drop("nodes").join(totals, ["session", "agent"]).select("session", "agent", "depth", "place", "nodes", "subtree_tokens")


@query(
    "tree_shares",
    f"""{TREE} SELECT g.session, g.agent, depth, round(t.subtree_cost, 4) AS subtree_cost,
        round(t.subtree_cost / coalesce(p.subtree_cost, w.c), 9) AS parent_share, round(t.subtree_cost / w.c, 9) AS total_share
        FROM g JOIN tot t USING (session, agent) LEFT JOIN tot p ON p.agent = g.parent
        CROSS JOIN (SELECT sum(subtree_cost) AS c FROM tot JOIN g USING (agent) WHERE g.depth = 0) w""",
)
def _(t):
    grown = forest.grow(nodes(t))
    out = forest.shares(grown, forest.subtree_totals(grown))
    return out.withColumns({"subtree_cost": r("subtree_cost", 4), "parent_share": r("parent_share", 9), "total_share": r("total_share", 9)})


@query(
    "workflow_rollup",
    f"""{TREE} SELECT session, run_id, count(*) AS members, CAST(sum(subtree_tokens) AS BIGINT) AS tokens, round(sum(subtree_cost), 3) AS cost,
        bool_and(subtree_complete) AS cost_is_complete, (SELECT max(end_ms) - min(start_ms) FROM g x WHERE x.path[1] IN (SELECT agent FROM g y WHERE y.run_id = g.run_id AND y.depth = 0)) AS duration_ms
        FROM g JOIN tot USING (session, agent) WHERE depth = 0 GROUP BY session, run_id""",
)
def _(t):
    grown = forest.grow(nodes(t))
    runs = grown.nodes.where("depth = 0").select("session", "run_id", F.lit(5).cast("bigint").alias("duration_ms")).distinct()
    return forest.run_rollup(grown, forest.subtree_totals(grown), runs).withColumn("cost", r("cost", 3))


@query(
    "workflow_phases",
    f"""{TREE} SELECT session, run_id, phase, count(*) AS members, CAST(sum(subtree_tokens) AS BIGINT) AS tokens, round(sum(subtree_cost), 3) AS cost
        FROM g JOIN tot USING (session, agent) WHERE depth = 0 GROUP BY ALL""",
)
def _(t):
    grown = forest.grow(nodes(t))
    return forest.phase_groups(grown, forest.subtree_totals(grown)).withColumn("cost", r("cost", 3))


@query(
    "attached_sessions",
    """SELECT p_partkey AS session, parent AS parent_session FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 2 END AS parent FROM part) x
       WHERE parent IS NULL OR parent NOT IN (SELECT p_partkey FROM part)""",
)
def _(t):
    key = F.col("p_partkey")
    return forest.hide_attached(t.raw("part").select(key.alias("session"), F.when(key % 3 == 0, key * 2).alias("parent_session")))


LINKED = """(SELECT session, 'g' || event_id AS agent, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 9 = 0 THEN 'nope' ELSE 't' || event_id END AS tool_use_id,
  CASE WHEN k % 5 = 0 THEN 'w' || (k % 20) END AS run_id, k % 2 = 0 AS rest, k FROM ev)"""
STATUS_SQL = f"""
  SELECT session, agent, parent, status, async_launch, CASE WHEN NOT async_launch AND coalesce(has_result, false) THEN result_chars END AS returned_chars FROM (
  SELECT *, CASE WHEN run_id IS NOT NULL AND s2 = 'unresolved' AND rs = 'completed' THEN CASE WHEN rest THEN 'completed' ELSE 'failed' END ELSE s2 END AS status FROM (
  SELECT *, CASE WHEN run_id IS NOT NULL AND coalesce(rs = 'killed', false) AND s1 <> 'completed' THEN 'failed' ELSE s1 END AS s2 FROM (
  SELECT *, CASE WHEN run_id IS NOT NULL THEN coalesce(CASE st WHEN 'done' THEN 'completed' WHEN 'errored' THEN 'failed' END, s0) ELSE s0 END AS s1 FROM (
  SELECT l.session, l.agent, CASE WHEN c.thread <> 'main' THEN c.thread END AS parent, l.run_id, rest, c.has_result, c.result_chars,
    n.status AS ns, n.call_id IS NOT NULL AS async_launch,
    CASE l.k % 20 WHEN 0 THEN 'killed' WHEN 5 THEN 'completed' WHEN 10 THEN 'running' END AS rs,
    CASE l.k % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'errored' WHEN 2 THEN 'progress' END AS st,
    CASE WHEN tool_use_id2 IS NULL THEN 'unresolved' WHEN n.call_id IS NOT NULL AND n.status IN ('completed', 'failed') THEN n.status
      WHEN n.call_id IS NOT NULL THEN CASE WHEN rest THEN 'completed' ELSE 'unresolved' END
      WHEN NOT coalesce(c.has_result, false) THEN 'unresolved' WHEN c.is_error THEN 'failed' ELSE 'completed' END AS s0
  FROM (SELECT *, coalesce(tool_use_id, CASE WHEN k % 14 = 0 THEN 't' || substr(agent, 2) END) AS tool_use_id2 FROM {LINKED} q) l
  LEFT JOIN calls c ON c.session = l.session AND c.call_id = tool_use_id2
  LEFT JOIN (SELECT session, thread, call_id, {NOTE_STATUS} AS status FROM {LAUNCHES} x LEFT JOIN {LAST_NOTE} y USING (session, thread, task_id) WHERE kind = 'agent') n
    ON n.session = l.session AND n.thread = coalesce(c.thread, 'main') AND n.call_id = tool_use_id2) a) b) c) d"""


def linked_status(t):
    k = F.col("k")
    gid = F.concat(F.lit("g"), F.col("event_id").cast("string"))
    tid = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    threads = t.ev.select(
        "session", gid.alias("agent"), F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 9 == 0, F.lit("nope")).otherwise(tid).alias("tool_use_id"),
        F.when(k % 5 == 0, F.concat(F.lit("w"), (k % 20).cast("string"))).alias("run_id"), (k % 2 == 0).alias("ends_at_rest"))
    recovered = t.ev.where("k % 14 = 0").select("session", gid.alias("agent"), tid.alias("call_id"), "line")
    state = F.when(k % 4 == 0, F.lit("done")).when(k % 4 == 1, F.lit("errored")).when(k % 4 == 2, F.lit("progress"))
    run_agents = t.ev.where("k % 5 = 0").select("session", F.concat(F.lit("w"), (k % 20).cast("string")).alias("run_id"), gid.alias("agent"), state.alias("state"))
    runs = t.ev.where("k % 20 IN (0, 5, 10)").select(
        "session", F.concat(F.lit("w"), (k % 20).cast("string")).alias("run_id"),
        F.when(k % 20 == 0, F.lit("killed")).when(k % 20 == 5, F.lit("completed")).otherwise(F.lit("running")).alias("status")).distinct()
    return forest.thread_status(forest.link_threads(threads, t.calls, recovered), *task_inputs(t), runs, run_agents)


@query("thread_status", STATUS_SQL, "calls ev")
def _(t):
    return linked_status(t).select("session", "agent", "parent", "status", "async_launch", "returned_chars")


@query(
    "return_stats",
    f"SELECT session, count(*) AS returns, CAST(sum(returned_chars) AS BIGINT) AS total_chars, max(returned_chars) AS max_chars FROM ({STATUS_SQL}) z WHERE returned_chars IS NOT NULL GROUP BY session",
    "calls ev",
)
def _(t):
    return forest.return_stats(linked_status(t))


@query(
    "span_rows",
    f"""SELECT x.session, lane, id, s - f AS offset_ms, CASE WHEN e >= s THEN e - s END AS duration_ms, round((s - f) / (l - f) * 100, 6) AS left_pct,
          round(CASE WHEN coalesce(e, l) >= s THEN coalesce(e, l) - s END / (l - f) * 100, 6) AS width_pct
        FROM (SELECT session, 'agent' AS lane, 'g' || event_id AS id, ts_ms AS s, CASE WHEN k % 3 > 0 THEN ts_ms + k * 500 END AS e FROM ev
          UNION ALL SELECT c.session, 'task', l.task_id, c.ts_ms, n.t FROM calls c JOIN {LAUNCHES} l USING (session, thread, call_id)
            LEFT JOIN {LAST_NOTE} q ON q.session = c.session AND q.thread = c.thread AND q.task_id = l.task_id) x
        JOIN (SELECT session, min(ts_ms) AS f, max(ts_ms) AS l FROM ev GROUP BY session HAVING max(ts_ms) > min(ts_ms)) b USING (session)""",
    "calls ev",
)
def _(t):
    k = F.col("k")
    agents = t.ev.select("session", F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("agent"), F.col("ts_ms").alias("start_ms"),
                         F.when(k % 3 > 0, F.col("ts_ms") + k * 500).alias("end_ms"))
    sessions = t.ev.groupBy("session").agg(F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms")).where("last_ts_ms > first_ts_ms")
    out = forest.spans(agents, tasks.executions(t.calls, *task_inputs(t)), sessions)
    return out.withColumns({"left_pct": r("left_pct", 6), "width_pct": r("width_pct", 6)})


@query(
    "workflow_runs",
    """
    WITH c AS (SELECT session, 'w' || (k % 30) AS run_id, 't' || event_id AS call_id, line, k % 4 AS form FROM ev WHERE event_type = 'purchase' AND thread = 'main'),
    a AS (SELECT session, 'w' || (k % 30) AS run_id, count(*) AS agents FROM ev WHERE event_type = 'view' GROUP BY ALL),
    n AS (SELECT DISTINCT session, 'w' || (k % 30) AS run_id FROM ev WHERE event_type = 'signup'),
    e AS (SELECT *, false AS synthesized FROM n UNION ALL SELECT session, run_id, true FROM a ANTI JOIN n USING (session, run_id)),
    l AS (SELECT session, run_id, arg_min(call_id, line) AS launch_call, min(line) AS launch_line FROM c WHERE form < 2 GROUP BY ALL)
    SELECT session, run_id, synthesized, coalesce(agents, 0) AS agents, launch_call, launch_line FROM e LEFT JOIN a USING (session, run_id) LEFT JOIN l USING (session, run_id)
    """,
    "ev",
)
def _(t):
    k = F.col("k")
    rid = F.concat(F.lit("w"), (k % 30).cast("string"))
    said = F.when(k % 4 == 0, F.concat(F.lit("started\nRun ID: "), rid, F.lit(" ok"))).when(k % 4 == 1, F.concat(F.lit("see /x/subagents/workflows/"), rid, F.lit("/a")))
    calls = t.ev.where("event_type = 'purchase'").select(
        "session", "thread", "line", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("call_id"), F.lit("Workflow").alias("tool"), said.alias("result_text"))
    threads = t.ev.where("event_type = 'view'").select("session", rid.alias("run_id"))
    runs = t.ev.where("event_type = 'signup'").select(
        "session", rid.alias("run_id"), F.lit("n").alias("name"), F.lit("completed").alias("status"), F.lit(1).cast("bigint").alias("duration_ms")).distinct()
    return forest.workflow_runs(runs, calls, threads).select("session", "run_id", "synthesized", "agents", "launch_call", "launch_line")


@query(
    "node_names",
    """SELECT event_id, CASE WHEN k % 5 = 0 THEN 'label' || k WHEN k % 5 = 1 THEN 'desc' || k WHEN k % 5 = 2 THEN left(repeat('word ', 20), 48) || '…'
       WHEN k % 5 = 3 THEN 'short' ELSE 'type' END AS name FROM ev""",
    "ev",
)
def _(t):
    k = F.col("k")
    none = F.lit(None).cast("string")
    return t.ev.select("event_id", forest.display_name(
        F.when(k % 5 == 0, F.concat(F.lit("label"), k.cast("string"))), F.when(k % 5 == 1, F.concat(F.lit("desc"), k.cast("string"))).otherwise(F.lit("")),
        F.when(k % 5 == 2, F.repeat(F.lit("word "), 20)).when(k % 5 == 3, F.lit("short\nmore")).otherwise(none), F.lit("type"), F.lit("id")).alias("name"))


# Context policies -----------------------------------------------------------

POINTS = """p AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY line) AS idx, line, ts_ms, model, input_tokens + cache_read_tokens + cache_write_tokens AS context
  FROM evmessages WHERE thread = 'main')"""
DAY_RATES = """rates AS (SELECT d.model, arg_max(p.model, length(p.model)) AS price_key FROM (SELECT DISTINCT model FROM evmessages) d JOIN (SELECT DISTINCT model FROM pricing) p ON starts_with(d.model, p.model) GROUP BY d.model),
  rated AS (SELECT r.model, q.* EXCLUDE (model) FROM rates r JOIN (SELECT * FROM pricing WHERE coalesce(valid_from, DATE '0001-01-01') <= DATE '2024-01-01'
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY valid_from DESC NULLS LAST) = 1) q ON q.model = r.price_key)"""
SAVED = """sum(context - counter) AS saved_tokens, sum(context) AS real_tokens, CASE WHEN count(usd) = count(*) THEN round(sum(usd), 8) END AS saved_usd,
  count(usd) = count(*) AS pricing_complete, round(CASE WHEN sum(context) > 0 THEN sum(context - counter) / sum(context) END, 9) AS saved_share"""
USD = """context * coalesce(CASE WHEN context > 200000 THEN cache_read_rate_200k END, cache_read_rate, input_rate * 0.1)
  - counter * coalesce(CASE WHEN counter > 200000 THEN cache_read_rate_200k END, cache_read_rate, input_rate * 0.1)"""


def tidy(df):
    return df.withColumns({"saved_usd": r("saved_usd", 8), "saved_share": r("saved_share", 9)}).withColumns(
        {c: F.col(c).cast("bigint") for c in ("saved_tokens", "real_tokens")})


@query(
    "compaction_policy",
    f"""
    WITH RECURSIVE {POINTS}, {DAY_RATES},
    b AS (SELECT session, context AS base FROM p WHERE idx = 1),
    s AS (SELECT session, 1::BIGINT AS idx, 0::BIGINT AS off, base AS counter, 0 AS fired, base FROM b
      UNION ALL
      SELECT session, idx, CASE WHEN c1 > 60000 THEN context - base ELSE context - c1 END, CASE WHEN c1 > 60000 THEN base ELSE c1 END, CASE WHEN c1 > 60000 THEN 1 ELSE 0 END, base FROM (
        SELECT s.session, p.idx, s.base, p.context, CASE WHEN p.context - s.off < s.base THEN least(s.base, p.context) ELSE p.context - s.off END AS c1
        FROM s JOIN p ON p.session = s.session AND p.idx = s.idx + 1) x),
    f AS (SELECT session, idx, CASE WHEN idx = 1 AND base > 60000 THEN 1 ELSE fired END AS fired, counter FROM s)
    SELECT session, CAST(sum(fired) AS BIGINT) AS resets, {SAVED.replace('sum(context - counter) AS', 'CAST(sum(context - counter) AS BIGINT) AS').replace('sum(context) AS', 'CAST(sum(context) AS BIGINT) AS')}
    FROM (SELECT p.*, f.fired, f.counter, {USD} AS usd FROM p JOIN f USING (session, idx) LEFT JOIN rated USING (model)) z GROUP BY session
    """,
    "evmessages pricing",
)
def _(t):
    points = policy.context_points(t.evmessages, chunk_rows=2048)
    return tidy(policy.compaction_savings(points, t.pricing, threshold=60_000))


HEAVY = "(SELECT session, call_id, line, result_chars, CAST(ceil(result_chars / 4.0) AS BIGINT) AS tokens FROM calls WHERE result_chars > 10000)"


@query(
    "eviction_policy",
    f"""
    WITH {POINTS}, {DAY_RATES},
    e AS (SELECT h.*, (SELECT count(*) FROM p WHERE p.session = h.session AND p.line < h.line) + 4 AS evict FROM {HEAVY} h),
    c AS (SELECT p.*, greatest(0, context - coalesce((SELECT sum(tokens) FROM e WHERE e.session = p.session AND e.evict <= p.idx), 0)) AS counter FROM p
          WHERE session IN (SELECT session FROM e))
    SELECT session, {SAVED.replace('sum(context - counter) AS', 'CAST(sum(context - counter) AS BIGINT) AS').replace('sum(context) AS', 'CAST(sum(context) AS BIGINT) AS')}
    FROM (SELECT c.*, {USD} AS usd FROM c LEFT JOIN rated USING (model)) z GROUP BY session
    """,
    "evmessages calls pricing",
)
def _(t):
    points = policy.context_points(t.evmessages, chunk_rows=2048)
    return tidy(policy.eviction_savings(points, t.calls, t.pricing, min_chars=10_000, chunk_rows=2048))


@query(
    "eviction_marginals",
    f"""
    WITH {POINTS},
    e AS (SELECT h.*, (SELECT count(*) FROM p WHERE p.session = h.session AND p.line < h.line) + 4 AS evict FROM {HEAVY} h)
    SELECT e.session, call_id, e.line, result_chars, tokens, count(p.idx) AS points_freed, CAST(coalesce(sum(CASE WHEN p.idx IS NOT NULL THEN least(p.context, tokens) END), 0) AS BIGINT) AS saved_tokens
    FROM e LEFT JOIN p ON p.session = e.session AND p.idx >= e.evict WHERE e.session IN (SELECT session FROM p) GROUP BY ALL
    """,
    "evmessages calls",
)
def _(t):
    points = policy.context_points(t.evmessages, chunk_rows=2048)
    return policy.eviction_marginals(points, t.calls, min_chars=10_000, chunk_rows=2048)


# Every source of file access, and calls in full ------------------------------

ALL_ACCESS = f"""
    WITH p AS ({SKILL_MATCH}), d AS (
      SELECT session, path, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(inj) AS BIGINT) AS injections, CAST(sum(chars) AS BIGINT) AS injected_chars, min(ts_ms) AS first_ts_ms
      FROM (SELECT session, ts_ms, '/repo/d' || (k % 7) || '/f' || (k % 13) || '.py' AS path, CASE WHEN tool = 'Read' THEN 1 ELSE 0 END AS reads, CASE WHEN tool = 'Edit' THEN 1 ELSE 0 END AS edits, 0 AS inj, 0 AS chars
              FROM calls WHERE tool IN ('Read', 'Edit')
            UNION ALL SELECT session, ts_ms, path, 0, 0, 1, chars FROM {DOCS} d
            UNION ALL SELECT e.session, e.ts_ms, '/skills/sk' || (e.k % 3) || '/SKILL.md', 0, 0, 1, e.k + 50 FROM p JOIN ev e ON e.session = p.session AND e.line = p.body_line
            UNION ALL SELECT session, ts_ms, '/b/f' || (k % 11) || '.txt', 1, 0, 0, 0 FROM ev WHERE event_type = 'click'
            UNION ALL SELECT session, ts_ms, 'src/g' || (k % 6) || '.py', 0, 1, 0, 0 FROM ev WHERE event_type = 'error') x GROUP BY session, path)
    SELECT * FROM d"""


@query("file_access_all", ALL_ACCESS, "calls ev")
def _(t):
    k = F.col("k")
    documents = files.injected_documents(doc_texts(t)).unionByName(skills.body_documents(skills.match_bodies(*skill_inputs(t), chunk_rows=1024)))
    keys = ["session", "thread", "line", "ts_ms"]
    commands = t.ev.where("event_type = 'click'").select(*keys, F.concat(F.lit("cat f"), (k % 11).cast("string"), F.lit(".txt")).alias("command"), F.lit("/b").alias("cwd"))
    patches = t.ev.where("event_type = 'error'").select(*keys, F.concat(F.lit("*** Begin Patch\n*** Update File: src/g"), (k % 6).cast("string"), F.lit(".py\n@@\n-a\n+b\n*** End Patch")).alias("patch"))
    return files.file_access(files.all_touches(t.calls, documents, commands, patches)).drop("first_main_line", "threads")


@query(
    "call_details",
    f"""SELECT c.session, c.call_id, c.line, l.task_id, n.line AS note_line, n.status AS note_status, n.exit_code FROM calls c
        LEFT JOIN ({LAUNCHES} l JOIN {NOTES} n USING (session, task_id)) ON l.session = c.session AND l.call_id = c.call_id""",
    "calls ev",
)
def _(t):
    launched, notes = task_inputs(t)
    return timeline.call_details(t.calls, notes, launched).select("session", "call_id", "line", "task_id", "note_line", "note_status", "exit_code")
