"""Shell commands."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import opportunities as opp
from ..operators import shell_usage as su
from ..session import stored
from .registry import query

r = F.round
SUMS = """count(*) AS calls, count(*) FILTER (is_error) AS errors, CAST(sum(input_chars) AS BIGINT) AS input_chars,
  CAST(sum(result_chars) AS BIGINT) AS result_chars, CAST(ceil(sum(input_chars + result_chars) / 4.0) AS BIGINT) AS estimated_tokens,
  round(sum(est_usd), 8) AS est_usd"""


def usd(df, *names):
    return df.withColumns({n: r(n, 8) for n in names or ("est_usd",)})


@query(
    "command_parse",
    "SELECT session, call_id, command, shape, family, subcommand, reads_file, input_chars FROM commands",
    "commands",
)
def _(t):
    return t.commands.select("session", "call_id", "command", "shape", "family", "subcommand", "reads_file", "input_chars")


@query("shell_totals", f"SELECT session, {SUMS} FROM priced_commands GROUP BY session", "priced_commands")
def _(t):
    return usd(su.totals(t.priced_commands))


@query(
    "shell_by_command",
    f"""
    SELECT g.*, CASE WHEN t.c > 0 THEN round(g.result_chars / t.c * 1000) / 10 ELSE 0 END AS share_pct,
      CASE WHEN g.result_chars > 0 THEN round(m / g.result_chars * 1000) / 10 ELSE 0 END AS main_share_pct FROM (
      SELECT g0.* EXCLUDE (m) , m FROM (
        SELECT session, family, subcommand, {SUMS}, coalesce(sum(result_chars) FILTER (thread = 'main'), 0) AS m
        FROM priced_commands GROUP BY session, family, subcommand) g0) g
    JOIN (SELECT session, sum(result_chars) AS c FROM priced_commands GROUP BY session) t USING (session)
    """.replace("SELECT g.*, CASE", "SELECT g.* EXCLUDE (m), CASE"),
    "priced_commands",
)
def _(t):
    return usd(su.by_command(t.priced_commands))


@query(
    "shell_samples",
    """
    SELECT session, family, subcommand, rank, command
    FROM (SELECT *, row_number() OVER (PARTITION BY session, family, subcommand ORDER BY pos) AS rank FROM (
      SELECT session, family, subcommand, command, min((thread <> 'main', thread, line)) AS pos FROM commands GROUP BY ALL) x) y
    WHERE rank <= 3
    """,
    "commands",
)
def _(t):
    return su.sample_commands(t.commands)


@query(
    "shell_by_thread",
    f"""
    SELECT g.*, CASE WHEN t.c > 0 THEN round(g.result_chars / t.c * 1000) / 10 ELSE 0 END AS chars_share_pct,
      CASE WHEN t.u > 0 THEN round(g.est_usd / t.u * 1000) / 10 END AS usd_share_pct FROM (
      SELECT session, thread, min(model) AS model, {SUMS.replace("round(sum(est_usd), 8)", "sum(est_usd)")}
      FROM priced_commands GROUP BY session, thread) g
    JOIN (SELECT session, sum(result_chars) AS c, sum(est_usd) AS u FROM priced_commands GROUP BY session) t USING (session)
    """.replace("SELECT g.*,", "SELECT g.* REPLACE (round(g.est_usd, 8) AS est_usd),"),
    "priced_commands",
)
def _(t):
    return usd(su.by_thread(t.priced_commands))


PROGRAMS = """CASE k % 10 WHEN 0 THEN ['cd', 'git'] WHEN 1 THEN ['cat'] WHEN 2 THEN ['npm'] WHEN 3 THEN ['echo', 'grep', 'wc']
  WHEN 4 THEN ['sed'] WHEN 5 THEN [] WHEN 6 THEN ['ls', 'docker'] WHEN 7 THEN ['head'] WHEN 8 THEN ['python3'] ELSE ['ls'] END"""


@query(
    "program_counts",
    f"SELECT session, program, count(*) AS count FROM (SELECT session, unnest({PROGRAMS}) AS program FROM commands) x GROUP BY ALL",
    "commands",
)
def _(t):
    return su.program_counts(t.commands)


@query(
    "near_duplicates",
    """SELECT session, shape, count(*) AS count, CAST(sum(result_chars) AS BIGINT) AS result_chars FROM commands
       GROUP BY session, shape HAVING count(*) >= 3""",
    "commands",
)
def _(t):
    return su.near_duplicates(t.commands)


@query(
    "large_results",
    """SELECT session, thread, line, command, result_chars, round(est_usd, 8) AS est_usd FROM priced_commands
       WHERE result_chars >= 20000""",
    "priced_commands",
)
def _(t):
    return usd(su.large_results(t.priced_commands))


@query(
    "file_dumps",
    "SELECT session, thread, line, command, result_chars, round(est_usd, 8) AS est_usd FROM priced_commands WHERE reads_file",
    "priced_commands",
)
def _(t):
    return usd(su.file_dumps(t.priced_commands).select("session", "thread", "line", "command", "result_chars", "est_usd"))


@query(
    "shell_heavy_hitters",
    """SELECT session, rank, thread, line, family, result_chars, round(est_usd, 8) AS est_usd FROM (
       SELECT *, row_number() OVER (PARTITION BY session ORDER BY result_chars DESC, thread, line) AS rank FROM priced_commands) x
       WHERE rank <= 10""",
    "priced_commands",
)
def _(t):
    return usd(su.heavy_hitters(t.priced_commands).select("session", "rank", "thread", "line", "family", "result_chars", "est_usd"))


RERUNS = """
    SELECT session, thread, shape, line AS error_line, coalesce(CASE WHEN s1 = shape THEN l1 END, CASE WHEN s2 = shape THEN l2 END,
      CASE WHEN s3 = shape THEN l3 END) AS rerun_line FROM (
      SELECT *, lead(shape, 1) OVER w AS s1, lead(shape, 2) OVER w AS s2, lead(shape, 3) OVER w AS s3,
             lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3
      FROM commands WINDOW w AS (PARTITION BY session, thread ORDER BY line)) x
    WHERE is_error AND (s1 = shape OR s2 = shape OR s3 = shape)
"""


@query(
    "rerun_after_error",
    f"SELECT q.*, c.result_chars FROM ({RERUNS}) q JOIN commands c ON c.session = q.session AND c.line = q.rerun_line",
    "commands",
)
def _(t):
    return su.reruns_after_error(t.commands, chunk_rows=4096)


def _threads_sql(rows):
    return f"""(SELECT session, shape, CASE count(*) WHEN 1 THEN min_by(thread, pos) WHEN 2 THEN min_by(thread, pos) || ' and ' || max_by(thread, pos)
      ELSE count(*) || ' threads' END AS tt FROM (SELECT session, shape, thread, min((thread <> 'main', thread, line)) AS pos
      FROM ({rows}) z GROUP BY ALL) p GROUP BY session, shape)"""


def _sized_sql(cls, lever, where, share, title, fix, note):
    rows = f"SELECT * FROM priced_commands WHERE {where}"
    return f"""
    SELECT session, '{cls}' AS class, shape, {title} AS title, '{lever}' AS lever, {fix} AS fix_text,
      saved AS est_usd_saved, 'heuristic' AS savings_basis, '{note}' AS heuristic_note, n AS occurrences, total AS total_chars
    FROM (SELECT session, shape, count(*) AS n, CAST(sum(result_chars) AS BIGINT) AS total,
        CASE WHEN count(*) FILTER (NOT placeholder) > 0 AND count(est_usd) = count(*) FILTER (NOT placeholder)
          THEN sum(est_usd) * {share} END AS saved,
        arg_min({{'command': command, 'thread': thread, 'model': model, 'family': family, 'chars': result_chars}},
                (-result_chars, thread <> 'main', thread, line)) AS top
      FROM ({rows}) q GROUP BY session, shape) g JOIN {_threads_sql(rows)} USING (session, shape)"""


SIZE = "CASE WHEN top.chars >= 1000 THEN CAST(round(top.chars / 1000) AS BIGINT) || 'k' ELSE CAST(top.chars AS VARCHAR) END"
SUFFIX = "coalesce(' (' || top.model || ')', '')"
OPPORTUNITIES = f"""
    SELECT session, 'near-duplicate' AS class, shape, n || ' runs of "' || shape || '" by ' || tt AS title, 'spawn-prompt' AS lever,
      'Run `' || shape || '` once and pass its output on: ' || tt || ' ran it ' || n || ' times.' AS fix_text,
      CASE WHEN unknown - CASE WHEN first_usd.v IS NULL THEN 1 ELSE 0 END = 0 THEN coalesce(total_usd, 0) - coalesce(first_usd.v, 0) END AS est_usd_saved,
      'measured' AS savings_basis, CAST(NULL AS VARCHAR) AS heuristic_note, n AS occurrences, total AS total_chars
    FROM (SELECT session, shape, count(*) AS n, CAST(sum(result_chars) AS BIGINT) AS total, sum(raw_usd) AS total_usd,
            count(*) - count(raw_usd) AS unknown, arg_min({{'v': raw_usd}}, (thread <> 'main', thread, line)) AS first_usd
          FROM priced_commands GROUP BY session, shape HAVING count(*) >= 3) g JOIN {_threads_sql('SELECT * FROM priced_commands')} USING (session, shape)
    UNION ALL
    SELECT session, 'rerun-after-error', shape, n || ' retries right after a failure: "' || shape || '"', 'investigate',
      'Look at what `' || shape || '` printed before trying it again: ' || n || ' retries by ' || tt || '.',
      CASE WHEN known = n THEN total_usd END, 'measured', NULL, n, total
    FROM (SELECT q.session, q.shape, count(*) AS n, CAST(sum(result_chars) AS BIGINT) AS total, sum(raw_usd) AS total_usd, count(raw_usd) AS known
          FROM ({RERUNS}) q JOIN priced_commands c ON c.session = q.session AND c.line = q.rerun_line GROUP BY ALL) g
      JOIN {_threads_sql('SELECT *, error_line AS line FROM (' + RERUNS + ') rr')} USING (session, shape)
    UNION ALL {_sized_sql('bash-as-read', 'claude-md-rule', 'reads_file', 0.7,
      "top.family || ' put ' || " + SIZE + " || ' characters into ' || top.thread || " + SUFFIX,
      "'Have ' || tt || ' read files by range: `' || top.command || '` brought in ' || format('{:,}', top.chars) || ' characters (' || n || ' calls alike, ' || format('{:,}', total) || ' in all).'",
      'The saving is taken as 70 % of the text read.')}
    UNION ALL {_sized_sql('large-result', 'command-flag', 'result_chars >= 20000', 0.9,
      "top.family || ' returned ' || " + SIZE + " || ' characters to ' || top.thread || " + SUFFIX,
      "'Filter what `' || top.command || '` prints: ' || format('{:,}', top.chars) || ' characters (' || n || ' calls alike, ' || format('{:,}', total) || ' in all, by ' || tt || ').'",
      'The saving is taken as 90 % of the text returned.')}
"""


def rows(t):
    """Priced commands, written once: the four classes read them several times."""
    return stored(opp.with_raw_cost(t.commands, t.pricing), "commands")


@query("shell_opportunities", f"SELECT * REPLACE (round(est_usd_saved, 8) AS est_usd_saved) FROM ({OPPORTUNITIES}) o", "priced_commands")
def _(t):
    return opp.opportunities(rows(t)).withColumn("est_usd_saved", r("est_usd_saved", 8))


@query(
    "opportunity_ranking",
    f"""
    SELECT session, class, shape, row_number() OVER (PARTITION BY session ORDER BY est_usd_saved IS NULL, round(est_usd_saved, 9) DESC,
      CASE WHEN est_usd_saved IS NULL THEN CASE savings_basis WHEN 'measured' THEN 0 ELSE 1 END END,
      CASE WHEN est_usd_saved IS NULL THEN -total_chars END, class, shape) AS rank FROM ({OPPORTUNITIES}) o
    """,
    "priced_commands",
)
def _(t):
    found = opp.opportunities(rows(t)).withColumn("est_usd_saved", r("est_usd_saved", 9))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(*opp.rank_order()))
    return found.select("session", "class", "shape", rank.alias("rank"))


@query(
    "opportunity_evidence",
    """
    SELECT session, shape, rank, thread, line, result_chars, round(raw_usd, 8) AS est_usd FROM (
      SELECT *, row_number() OVER (PARTITION BY session, shape ORDER BY result_chars DESC, thread <> 'main', thread, line) AS rank,
        count(*) OVER (PARTITION BY session, shape) AS n FROM priced_commands) x WHERE n >= 3 AND rank <= 10
    """,
    "priced_commands",
)
def _(t):
    return usd(opp.evidence(rows(t)))
