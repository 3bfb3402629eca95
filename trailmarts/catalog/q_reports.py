"""Session list and reports across sessions."""

from pyspark.sql import functions as F

from ..functions import models, repo, text
from ..plans import briefing, insight, items, learnings, overview, percentile, trends
from .q_shell import OPPORTUNITIES, rows
from ..operators import opportunities as opp
from ..operators import search
from ..operators import shell_usage, usage
from ..session import stored
from .registry import query

r = F.round
NOW = 897_912_000_000  # 1998-06-15 12:00 UTC
DAYS, ZONE = 30, "America/New_York"


def tidy(df, digits=8, *names):
    return df.withColumns({n: r(n, digits) for n in names})


# The list --------------------------------------------------------------------


@query("repo_keys", "SELECT session, repo_key FROM keyed_items", "keyed_items")
def _(t):
    return t.keyed_items.select("session", "repo_key")


@query(
    "session_page",
    """SELECT session, coalesce(started_ms, mtime_ms) AS start_ms FROM items ORDER BY coalesce(started_ms, mtime_ms) DESC NULLS LAST, source, session LIMIT 50 OFFSET 100""",
    "items",
)
def _(t):
    return items.page(t.items, 100, 50).select("session", F.coalesce("started_ms", "mtime_ms").alias("start_ms"))


@query("session_total", "SELECT count(*) AS total FROM items", "items")
def _(t):
    return items.page_total(t.items)


@query(
    "session_filter",
    f"""SELECT session FROM keyed_items WHERE source = 'claude-code' AND repo_key = '/repos/NATION_3' AND coalesce(started_ms, mtime_ms) >= {NOW} - 31536000000
        AND coalesce(started_ms, mtime_ms) < {NOW}""",
    "keyed_items",
)
def _(t):
    return items.filter_items(t.items, source="claude-code", repo_key="/repos/NATION_3", since_ms=NOW - 31_536_000_000, until_ms=NOW).select("session")


@query("sessions_last_days", f"SELECT session FROM items WHERE started_ms >= {NOW} - 7776000000", "items")
def _(t):
    return items.last_days(t.items, NOW, 90).select("session")


@query(
    "sessions_day_range",
    """SELECT session FROM items WHERE CAST(timezone('America/New_York', to_timestamp(started_ms // 1000)) AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-11-03'""",
    "items",
)
def _(t):
    return items.day_range(t.items, "1997-03-01", "1997-11-03", ZONE).select("session")


@query("sessions_sorted", "SELECT session, bash_usd FROM items", "items")
def _(t):
    return items.sorted_by(t.items, "bash_usd", True, "session").select("session", "bash_usd")


@query(
    "repo_root_votes",
    """
    SELECT session, coalesce(repo_root, v) AS repo_root FROM items LEFT JOIN (
      SELECT repo_url, v FROM (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY c DESC, length(v), v) AS n FROM (
        SELECT repo_url, repo_root AS v, count(*) AS c FROM items WHERE repo_root IS NOT NULL AND repo_url IS NOT NULL GROUP BY ALL) y) x WHERE n = 1) w USING (repo_url)
    """,
    "items",
)
def _(t):
    return items.fill_roots(t.items).select("session", "repo_root")


@query(
    "source_union",
    """SELECT session, source FROM (SELECT *, row_number() OVER (PARTITION BY source, session ORDER BY copy) AS n FROM (
       SELECT session, source, 0 AS copy FROM items WHERE source = 'codex' UNION ALL SELECT session, source, 0 FROM items WHERE source <> 'codex'
       UNION ALL SELECT session, source, 1 FROM items WHERE k % 3 = 0) u) x WHERE n = 1""",
    "items",
)
def _(t):
    base = t.items.select("session", "source", "k", F.lit(0).alias("copy"))
    both = items.union_items(base.where("source = 'codex'"), base.where("source <> 'codex'"))
    again = base.where("k % 3 = 0").withColumn("copy", F.lit(1))
    return items.first_candidates(items.union_items(both, again), "copy").select("session", "source")


@query("live_sessions", "SELECT 'u' || (user_id % 50) AS session, max(ts_ms) AS last_activity_ms, max(ts_ms) >= 1706655000000 - 300000 AS is_live FROM ev GROUP BY 1", "ev")
def _(t):
    files = t.ev.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("session"), F.col("ts_ms").alias("mtime_ms"))
    return items.live_sessions(files, 1_706_655_000_000)


@query(
    "session_files",
    """SELECT session, path FROM (SELECT session, 'f' || line AS path, row_number() OVER (PARTITION BY session ORDER BY k % 3 = 0, ts_ms DESC, 'f' || line) AS n FROM ev) x WHERE n = 1""",
    "ev",
)
def _(t):
    files = t.ev.select("session", F.concat(F.lit("f"), F.col("line").cast("string")).alias("path"), (F.col("k") % 3 == 0).alias("archived"), F.col("ts_ms").alias("mtime_ms"))
    return items.one_file_per_session(files).select("session", "path")


@query(
    "session_titles",
    """SELECT session, coalesce(ix, CASE WHEN k % 3 = 0 THEN 'own' END, dt) AS title FROM items
       LEFT JOIN (SELECT 'o' || (event_id % 3000) AS session, 'name' || max(event_id) AS ix FROM ev GROUP BY 1) a USING (session)
       LEFT JOIN (SELECT 'o' || (event_id % 5000) AS session, 'desk' || max(event_id) AS dt FROM ev GROUP BY 1) b USING (session)""",
    "items ev",
)
def _(t):
    n = F.col("event_id")
    cat = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    index = t.ev.select(cat("o", n % 3000).alias("session"), cat("name", n).alias("name"), "line")
    desktop = t.ev.select(cat("o", n % 5000).alias("session"), cat("desk", n).alias("title"), F.col("ts_ms").alias("created_ms"))
    base = t.items.select("session", F.when(F.col("k") % 3 == 0, F.lit("own")).alias("title"))
    return items.with_titles(base, index, desktop)


@query(
    "session_items",
    """
    SELECT d.session, d.main_tokens, d.sub_tokens, tt AS total_tokens, round(tc, 8) AS total_cost, cc AS cost_is_complete, coalesce(p.n, 0) AS user_turns,
      fp AS first_prompt, coalesce(s.calls, 0) AS bash_calls, mc AS max_context_tokens, coalesce(z.n, 0) AS compactions, nm AS models
    FROM (SELECT DISTINCT session FROM ev) e LEFT JOIN (
      SELECT session, sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens) FILTER (thread = 'main') AS main_tokens,
        coalesce(sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens) FILTER (thread <> 'main'), 0) AS sub_tokens,
        CAST(sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens) AS BIGINT) AS tt, coalesce(sum(cost), 0) AS tc, count(cost) = count(*) AS cc,
        count(DISTINCT coalesce(model, '?')) AS nm, max(input_tokens + cache_read_tokens + cache_write_tokens) FILTER (thread = 'main') AS mc FROM evcosted GROUP BY session) d USING (session)
    LEFT JOIN (SELECT session, count(*) AS n, arg_min(text, line) AS fp FROM prompts GROUP BY session) p USING (session)
    LEFT JOIN (SELECT session, count(*) AS calls FROM commands GROUP BY session) s USING (session)
    LEFT JOIN (SELECT session, count(*) AS n FROM ev WHERE event_type = 'purchase' AND k % 10 = 0 GROUP BY session) z USING (session)
    """,
    "evcosted prompts commands ev",
)
def _(t):
    costed = t.evcosted
    by_model = usage.usage_by_model(costed)
    priced = t.priced_commands
    top = shell_usage.by_command(priced).groupBy("session").agg(F.max_by("family", F.struct("result_chars", "family")).alias("top_family"))
    returns = t.calls.where("tool = 'Edit' AND has_result").groupBy("session").agg(
        F.count(F.lit(1)).alias("returns"), F.sum("result_chars").alias("total_chars"), F.max("result_chars").alias("max_chars"))
    compactions = t.ev.where("event_type = 'purchase' AND k % 10 = 0").select("session", "line")
    out = items.session_items(
        t.ev.select("session").distinct(), by_model, usage.delegation(costed), shell_usage.totals(priced), returns, t.prompts, compactions,
        usage.context_peak(costed), top)
    return out.select(
        "session", "main_tokens", "sub_tokens", "total_tokens", r("total_cost", 8).alias("total_cost"), "cost_is_complete", "user_turns", "first_prompt",
        "bash_calls", "max_context_tokens", "compactions", F.size("usage_by_model").cast("bigint").alias("models"))


@query(
    "repo_identity",
    """SELECT event_id, CASE k % 6 WHEN 0 THEN '/repo/x' || k WHEN 1 THEN '/repo/x' || k WHEN 2 THEN '/repo/y/.claude/worktrees' WHEN 4 THEN '/u/.codex/worktrees/h' || k WHEN 5 THEN '/' END AS repo_root,
       CASE k % 6 WHEN 1 THEN 'wt' || k WHEN 3 THEN 'h' || k END AS worktree FROM ev""",
    "ev",
)
def _(t):
    k, n = F.col("k"), F.col("k").cast("string")
    cwd = (
        F.when(k % 6 == 0, F.concat(F.lit("/repo/x"), n, F.lit("/"))).when(k % 6 == 1, F.concat(F.lit("/repo/x"), n, F.lit("/.claude/worktrees/wt"), n, F.lit("/src")))
        .when(k % 6 == 2, F.lit("/repo/y/.claude/worktrees/")).when(k % 6 == 3, F.concat(F.lit("/u/.codex/worktrees/h"), n, F.lit("/proj")))
        .when(k % 6 == 4, F.concat(F.lit("/u/.codex/worktrees/h"), n)).otherwise(F.lit("/")))
    return t.ev.select("event_id", repo.identity(cwd).alias("i")).select("event_id", "i.*")


@query("repo_urls", "SELECT page_id, regexp_replace(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '.git//' ELSE '/' END, '/+$', ''), '\\.git$', '') AS url FROM pages")
def _(t):
    tail = F.when(F.col("page_id") % 2 == 0, F.lit(".git//")).otherwise(F.lit("/"))
    return t.raw("pages").select("page_id", repo.plain_url(F.concat("url", tail)).alias("url"))


@query(
    "repo_names",
    """SELECT 'd' || n AS name, count(p) AS candidates, CASE WHEN count(p) = 1 THEN min(p) END AS repo, coalesce(string_agg(p, ',' ORDER BY p), '') AS roots FROM (SELECT DISTINCT k AS n FROM ev) a
       LEFT JOIN (SELECT DISTINCT k % 40 AS m, '/r' || (k % 3) || '/d' || (k % 40) AS p FROM ev) b ON m = n GROUP BY n
       UNION ALL SELECT DISTINCT '/r' || (k % 3) || '/d' || (k % 40), 0, '/r' || (k % 3) || '/d' || (k % 40), '' FROM ev""",
    "ev",
)
def _(t):
    k = F.col("k")
    roots = t.ev.select(F.concat(F.lit("/r"), (k % 3).cast("string"), F.lit("/d"), (k % 40).cast("string")).alias("repo_root"))
    names = t.ev.select(F.concat(F.lit("d"), k.cast("string")).alias("name")).unionByName(roots.select(F.col("repo_root").alias("name")))
    return repo.resolve_name(roots, names).withColumn("roots", F.array_join("roots", ","))


@query(
    "path_labels",
    """
    WITH u AS (SELECT DISTINCT url AS path, list_filter(string_split(url, '/'), lambda s: s <> '') AS p FROM pages),
    d AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS depth FROM u),
    q AS (SELECT path, depth, array_to_string(p[len(p) - depth + 1:], '/') AS tail FROM d),
    n AS (SELECT *, count(*) OVER (PARTITION BY depth, tail) AS n FROM q)
    SELECT path, arg_min(tail, CASE WHEN n = 1 THEN depth ELSE 1000 - depth END) AS label FROM n GROUP BY path
    """,
)
def _(t):
    return repo.path_labels(t.raw("pages").select(F.col("url").alias("path")))


@query(
    "model_classes",
    """SELECT m AS model, CASE i WHEN 0 THEN 'f' WHEN 1 THEN 'f' WHEN 2 THEN 's' WHEN 3 THEN 'h' WHEN 4 THEN 'gpt' WHEN 5 THEN 'sol' WHEN 6 THEN 'gpt' WHEN 7 THEN 'mut' ELSE 'rev' END AS cls,
       CASE i WHEN 0 THEN 'opus 4.' || j WHEN 1 THEN 'fable' WHEN 2 THEN 'sonnet 3.5' WHEN 3 THEN 'haiku 4.' || j WHEN 4 THEN 'gpt-5.' || j WHEN 5 THEN '5.6 sol' WHEN 6 THEN 'gpt-4o' WHEN 7 THEN 'solar-' || j ELSE 'auto-review' END AS label,
       i < 2 AS top_tier FROM (SELECT DISTINCT k % 9 AS i, k % 10 AS j, CASE k % 9 WHEN 0 THEN 'claude-opus-4-' || (k % 10) || '-20250101' WHEN 1 THEN 'fable' WHEN 2 THEN 'claude-3-5-sonnet-20241022' WHEN 3 THEN 'claude-haiku-4-' || (k % 10)
       WHEN 4 THEN 'gpt-5.' || (k % 10) || '-2025-01-01' WHEN 5 THEN 'gpt-5.6-sol' WHEN 6 THEN 'gpt-4o-latest' WHEN 7 THEN 'solar-' || (k % 10) ELSE 'codex-auto-review' END AS m FROM ev) x
       QUALIFY row_number() OVER (PARTITION BY m ORDER BY j) = 1""",
    "ev",
)
def _(t):
    k, j = F.col("k"), (F.col("k") % 10).cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    m = (
        F.when(k % 9 == 0, cat("claude-opus-4-", j, "-20250101")).when(k % 9 == 1, F.lit("fable")).when(k % 9 == 2, F.lit("claude-3-5-sonnet-20241022"))
        .when(k % 9 == 3, cat("claude-haiku-4-", j)).when(k % 9 == 4, cat("gpt-5.", j, "-2025-01-01")).when(k % 9 == 5, F.lit("gpt-5.6-sol"))
        .when(k % 9 == 6, F.lit("gpt-4o-latest")).when(k % 9 == 7, cat("solar-", j)).otherwise(F.lit("codex-auto-review")))
    distinct = t.ev.select(m.alias("model")).distinct()
    return distinct.select("model", models.family(F.col("model")).alias("cls"), models.short_label(F.col("model")).alias("label"), models.is_top_tier(F.col("model")).alias("top_tier"))


# Overview --------------------------------------------------------------------


@query(
    "overview_totals",
    """SELECT repo_key, count(*) AS sessions, count(*) FILTER (source = 'claude-code') AS sessions_a, count(*) FILTER (source = 'codex') AS sessions_b, round(sum(total_cost), 8) AS total_cost,
       bool_and(cost_is_complete) AS cost_is_complete, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(main_tokens) AS BIGINT) AS main_tokens, CAST(sum(sub_tokens) AS BIGINT) AS sub_tokens,
       CASE WHEN count(main_cost) = count(*) THEN round(sum(main_cost), 8) END AS main_cost, CASE WHEN count(sub_cost) = count(*) THEN round(sum(sub_cost), 8) END AS sub_cost,
       CAST(sum(bash_calls) AS BIGINT) AS bash_calls, CAST(sum(bash_chars) AS BIGINT) AS bash_chars, round(sum(bash_usd), 8) AS bash_usd FROM keyed_items GROUP BY repo_key""",
    "keyed_items",
)
def _(t):
    return tidy(overview.totals(t.keyed_items), 8, "total_cost", "main_cost", "sub_cost", "bash_usd")


@query(
    "overview_days",
    """SELECT repo_key, strftime(make_timestamp(started_ms * 1000), '%Y-%m-%d') AS day, round(sum(total_cost), 8) AS cost, count(*) AS sessions FROM keyed_items WHERE started_ms IS NOT NULL GROUP BY ALL""",
    "keyed_items",
)
def _(t):
    return tidy(overview.per_day(t.keyed_items), 8, "cost").withColumn("day", F.col("day").cast("string"))


MODEL_SUMS = "CAST(sum(m.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(m.output_tokens) AS BIGINT) AS output_tokens"


@query(
    "overview_models",
    f"""SELECT repo_key, model, {MODEL_SUMS}, CAST(sum(m.cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(m.cache_write_tokens) AS BIGINT) AS cache_write_tokens,
        round(sum(m.cost), 8) AS cost FROM keyed_items JOIN item_models m USING (session) GROUP BY repo_key, model""",
    "keyed_items item_models",
)
def _(t):
    return tidy(overview.by_model(t.keyed_items), 8, "cost")


@query(
    "overview_top_sessions",
    """SELECT repo_key, rank, session, source, total_cost, CASE WHEN length(first_prompt) > 80 THEN left(first_prompt, 80) || '…' ELSE first_prompt END AS first_prompt
       FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY total_cost DESC, session) AS rank FROM keyed_items) x WHERE rank <= 5""",
    "keyed_items",
)
def _(t):
    return overview.top_sessions(t.keyed_items)


@query("overview_distribution", "SELECT repo_key, bash_chars, count(*) AS sessions FROM keyed_items GROUP BY ALL", "keyed_items")
def _(t):
    return overview.shell_distribution(t.keyed_items)


@query(
    "shell_percentile",
    """
    WITH c AS (SELECT repo_key, session, bash_chars AS v, rank() OVER (PARTITION BY repo_key ORDER BY bash_chars) - 1 AS below, count(*) OVER (PARTITION BY repo_key, bash_chars) AS eq,
                 count(*) OVER (PARTITION BY repo_key) AS n, median(bash_chars) OVER (PARTITION BY repo_key) AS med FROM keyed_items),
    u AS (SELECT repo_key, session, bash_usd AS v, rank() OVER (PARTITION BY repo_key ORDER BY bash_usd) - 1 AS below, count(*) OVER (PARTITION BY repo_key, bash_usd) AS eq,
                 count(*) OVER (PARTITION BY repo_key) AS n, median(bash_usd) OVER (PARTITION BY repo_key) AS med FROM keyed_items WHERE bash_usd IS NOT NULL),
    p AS (SELECT c.repo_key, c.session, u.n IS NOT NULL AS by_usd, coalesce(u.v, c.v) AS v, coalesce(u.below, c.below) AS below, coalesce(u.eq, c.eq) AS eq, coalesce(u.n, c.n) AS n, coalesce(u.med, c.med) AS med
          FROM c LEFT JOIN (SELECT * FROM u WHERE n >= 5) u USING (session) WHERE c.n >= 5)
    SELECT repo_key, session, by_usd, round((below + eq / 2) / n * 100 * 10) / 10 AS pct, CASE WHEN med > 0 THEN round(v / med * 100) / 100 END AS median_ratio, n AS samples FROM p
    """,
    "keyed_items",
)
def _(t):
    return percentile.shell_percentile(t.keyed_items)


# Trends ----------------------------------------------------------------------

LOCAL = f"CAST(timezone('{ZONE}', to_timestamp(started_ms // 1000)) AS DATE)"
TODAY = "DATE '1998-06-15'"
WINDOWED = f"""(SELECT *, {LOCAL} AS day, CASE WHEN {TODAY} - {LOCAL} BETWEEN 0 AND {DAYS - 1} THEN 'current' WHEN {TODAY} - {LOCAL} BETWEEN {DAYS} AND {2 * DAYS - 1} THEN 'previous' END AS w FROM keyed_items)"""
HIT = "round(CASE WHEN sum(i + cr + cw) > 0 THEN sum(cr) / sum(i + cr + cw) END, 9)"
TOKENS_OF = "(SELECT session, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS cr, sum(cache_write_tokens) AS cw FROM item_models GROUP BY session)"
STRICT = "CASE WHEN count({0}) = count(session) THEN round(coalesce(sum({0}), 0), 8) END"
BUCKETS = f"""
  SELECT CAST(d.day AS VARCHAR) AS day, count(session) AS sessions, CAST(coalesce(sum(user_turns), 0) AS BIGINT) AS user_turns, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms,
    round(coalesce(sum(total_cost), 0), 8) AS cost, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(cr), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cw), 0) AS BIGINT) AS cache_write_tokens, {HIT} AS cache_hit_rate,
    {STRICT.format('main_cost')} AS main_cost, {STRICT.format('sub_cost')} AS sub_cost, CAST(coalesce(sum(compactions), 0) AS BIGINT) AS compactions,
    CAST(sum(returns) AS BIGINT) AS returns, CAST(sum(return_chars) AS BIGINT) AS return_chars, max(return_max_chars) AS return_max_chars,
    CAST(coalesce(sum(bash_calls), 0) AS BIGINT) AS bash_calls, CAST(coalesce(sum(bash_chars), 0) AS BIGINT) AS bash_chars, round(sum(bash_usd), 8) AS bash_usd
  FROM (SELECT {TODAY} - CAST(n AS INTEGER) AS day FROM range({DAYS}) t(n)) d LEFT JOIN (SELECT * FROM {WINDOWED} q JOIN {TOKENS_OF} k USING (session) WHERE w = 'current') x ON x.day = d.day
  GROUP BY d.day
"""


@query("trend_buckets", BUCKETS, "keyed_items item_models")
def _(t):
    out = trends.buckets(t.keyed_items, NOW, DAYS, ZONE)
    return tidy(out, 8, "cost", "main_cost", "sub_cost", "bash_usd").withColumns({"cache_hit_rate": r("cache_hit_rate", 9), "day": F.col("day").cast("string")})


SUMMARY = f"""(SELECT w, count(*) AS sessions, sum(total_cost) AS cost, {HIT} AS chr, CASE WHEN count(sub_cost) = count(*) AND sum(total_cost) > 0 THEN sum(sub_cost) / sum(total_cost) END AS scs,
  CAST(sum(bash_chars) AS BIGINT) AS bc, sum(bash_usd) AS bu FROM {WINDOWED} q JOIN {TOKENS_OF} k USING (session) WHERE w IS NOT NULL GROUP BY w)"""


@query(
    "trend_totals",
    f"SELECT w AS window, sessions, round(cost, 8) AS cost, chr AS cache_hit_rate, round(scs, 9) AS sub_cost_share, bc AS bash_chars, round(bu, 8) AS bash_usd FROM {SUMMARY} s",
    "keyed_items item_models",
)
def _(t):
    out = trends.window_totals(t.keyed_items, NOW, DAYS, ZONE)
    return tidy(tidy(out, 8, "cost", "bash_usd"), 9, "cache_hit_rate", "sub_cost_share")


@query(
    "trend_summary",
    f"""SELECT c.sessions AS current_sessions, p.sessions AS previous_sessions, round(c.cost, 8) AS current_cost, round(p.cost, 8) AS previous_cost,
        round((c.sessions - p.sessions) / p.sessions * 100, 6) AS sessions_pct, round((c.cost - p.cost) / p.cost * 100, 6) AS cost_pct,
        round((c.bc - p.bc) / p.bc * 100, 6) AS bash_chars_pct, round((c.bu - p.bu) / p.bu * 100, 6) AS bash_usd_pct, round((c.scs - p.scs) * 100, 6) AS sub_cost_share_pts
        FROM (SELECT * FROM {SUMMARY} a WHERE w = 'current') c, (SELECT * FROM {SUMMARY} b WHERE w = 'previous') p""",
    "keyed_items item_models",
)
def _(t):
    out = trends.summary(t.keyed_items, NOW, DAYS, ZONE)
    names = ["sessions_pct", "cost_pct", "bash_chars_pct", "bash_usd_pct", "sub_cost_share_pts"]
    return tidy(tidy(out.select("current_sessions", "previous_sessions", "current_cost", "previous_cost", *names), 6, *names), 8, "current_cost", "previous_cost")


@query(
    "trend_day_models",
    f"SELECT CAST(day AS VARCHAR) AS day, model, {MODEL_SUMS}, round(sum(m.cost), 8) AS cost FROM {WINDOWED} q JOIN item_models m USING (session) WHERE w = 'current' GROUP BY ALL",
    "keyed_items item_models",
)
def _(t):
    return tidy(trends.day_models(t.keyed_items, NOW, DAYS, ZONE), 8, "cost").withColumn("day", F.col("day").cast("string"))


#: Some sessions are made so dear that their days stand out.
SPIKY = "(SELECT * REPLACE (CASE WHEN k % 53 = 0 THEN total_cost * 400 ELSE total_cost END AS total_cost) FROM keyed_items)"


@query(
    "trend_spikes",
    f"""SELECT day, cost, round(mean, 8) AS mean, round(stddev, 8) AS stddev FROM (SELECT *, avg(cost) OVER () AS mean, stddev_pop(cost) OVER () AS stddev, count(*) FILTER (sessions > 0) OVER () AS active
        FROM ({BUCKETS.replace("keyed_items", SPIKY)}) b) s WHERE active >= 4 AND cost > mean + 2 * stddev""",
    "keyed_items item_models",
)
def _(t):
    dear = F.when(F.col("k") % 53 == 0, F.col("total_cost") * 400).otherwise(F.col("total_cost"))
    out = trends.spike_days(trends.buckets(t.keyed_items.withColumn("total_cost", dear), NOW, DAYS, ZONE))
    return tidy(out, 8, "cost", "mean", "stddev").withColumn("day", F.col("day").cast("string"))


@query(
    "trend_top_sessions",
    f"""SELECT session, source, repo_key, total_cost, started_ms, CASE WHEN length(first_prompt) > 120 THEN left(first_prompt, 120) || '…' ELSE first_prompt END AS first_prompt
        FROM {WINDOWED} q WHERE w = 'current' ORDER BY total_cost DESC, session LIMIT 5""",
    "keyed_items",
)
def _(t):
    return trends.top_sessions(t.keyed_items, NOW, DAYS, ZONE)


# Insight ---------------------------------------------------------------------

SHAPED = """(SELECT *, CASE WHEN total_cost > 0 THEN main_cost / total_cost END AS share,
  CASE WHEN main_cost / total_cost >= 0.85 THEN 'marathon' WHEN main_cost / total_cost <= 0.55 THEN 'fan-out' ELSE 'mixed' END AS archetype,
  max_context_tokens > 200000 AND compactions = 0 AS warn FROM items)"""


@query("session_shapes", f"SELECT session, round(share, 9) AS main_cost_share, archetype, warn AS context_warning FROM {SHAPED} s", "items")
def _(t):
    return tidy(insight.session_shapes(t.items).select("session", "main_cost_share", "archetype", "context_warning"), 9, "main_cost_share")


@query("archetype_counts", f"SELECT archetype, count(*) AS sessions, count(*) FILTER (warn) AS context_warnings FROM {SHAPED} s GROUP BY archetype", "items")
def _(t):
    return insight.archetype_counts(insight.session_shapes(t.items))


# Orders play sessions here and their lines play subagents with some number of tool calls.
THREADS = "(SELECT 'o' || l_orderkey AS session, 'a' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS agent, CASE WHEN l_partkey % 2 = 0 THEN 'label' || l_partkey END AS label, CAST(l_quantity AS BIGINT) * 4 AS tool_calls FROM lineitem)"
BUDGET = f"""(SELECT session, count(*) AS subagents, count(*) FILTER (tool_calls > 60) AS watch, count(*) FILTER (tool_calls > 150) AS outliers,
  arg_min({{'n': coalesce(label, agent), 'c': tool_calls}}, (-tool_calls, agent)) FILTER (tool_calls > 150) AS w FROM {THREADS} t GROUP BY session)"""


def budget(t):
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    c = F.col
    threads = t.raw("lineitem").select(
        cat("o", c("l_orderkey")).alias("session"), cat("a", c("l_partkey"), "-", c("l_suppkey"), "-", c("l_linenumber")).alias("agent"),
        F.when(c("l_partkey") % 2 == 0, cat("label", c("l_partkey"))).alias("label"), (c("l_quantity").cast("bigint") * 4).alias("tool_calls"))
    return insight.turn_budget(threads)


@query("turn_budget", f"SELECT session, subagents, watch, outliers, w.n AS worst, w.c AS worst_calls FROM {BUDGET} b")
def _(t):
    return budget(t)


@query(
    "top_tier_share",
    """SELECT thread AS session, count(*) FILTER (sub) AS sub_messages, count(*) FILTER (sub AND top) AS top_tier_messages,
       round(CASE WHEN count(*) FILTER (sub) > 0 THEN count(*) FILTER (sub AND top) / count(*) FILTER (sub) END, 9) AS top_tier_share
       FROM (SELECT thread, k % 3 > 0 AS sub, k % 5 = 0 AS top FROM ev) x GROUP BY thread""",
    "ev",
)
def _(t):
    k = F.col("k")
    rows_ = t.ev.select(F.col("thread").alias("session"), F.when(k % 3 > 0, F.lit("a1")).otherwise(F.lit("main")).alias("thread"),
                        F.when(k % 5 == 0, F.lit("claude-opus-4")).otherwise(F.lit("claude-sonnet-4")).alias("model"))
    return tidy(usage.top_tier_share(rows_), 9, "top_tier_share")


STRUCTURAL = f"""SELECT session, source, 'marathon-context' AS class, 'Marathon session ran to ' || format('{{:,}}', max_context_tokens) || ' context tokens with 0 compactions' AS title,
    '{insight.FIX_MARATHON}' AS fix, CAST(NULL AS DOUBLE) AS impact_usd, total_cost AS session_cost, 0 AS tier FROM {SHAPED} s WHERE archetype = 'marathon' AND warn
  UNION ALL SELECT session, source, 'fan-out-turn-budget', 'Fan-out session with ' || outliers || ' subagent(s) past 150 tool calls (worst: ' || w.n || ' at ' || w.c || ')',
    '{insight.FIX_FAN_OUT}', NULL, total_cost, 0 FROM {SHAPED} s JOIN {BUDGET} b USING (session) WHERE archetype = 'fan-out' AND outliers > 0"""
RETURN_WASTE = f"""SELECT session, source, 'oversized-return' AS class, 'Subagent ' || k || ' returned ' || format('{{:,}}', return_max_chars) || ' chars to its parent' AS title, '{insight.FIX_RETURN}' AS fix,
    bash_usd AS impact_usd, CAST(NULL AS DOUBLE) AS session_cost, 1 AS tier FROM items WHERE return_max_chars >= 20000"""
WASTE = f"(SELECT * FROM ({STRUCTURAL}) a UNION ALL SELECT * FROM ({RETURN_WASTE}) b)"


def waste(t):
    shaped = insight.session_shapes(t.items)
    returns = t.items.select("session", "source", F.col("k").cast("string").alias("agent"), F.col("return_max_chars").alias("returned_chars"), F.col("bash_usd").alias("cost"))
    return insight.all_waste(insight.structural_waste(shaped, budget(t)), insight.return_waste(returns))


@query("waste_items", f"SELECT session, source, class, title, fix, impact_usd, session_cost FROM {WASTE} w", "items")
def _(t):
    return waste(t).drop("tier")


@query("waste_ranking", f"SELECT session, class, title, impact_usd FROM {WASTE} w", "items")
def _(t):
    return insight.ranked_waste(waste(t)).select("session", "class", "title", "impact_usd")


@query(
    "waste_totals",
    f"SELECT round(sum(impact_usd), 8) AS waste_usd, count(*) AS waste_items, round(sum(impact_usd) / (SELECT sum(total_cost) FROM items), 9) AS waste_share FROM {WASTE} w",
    "items",
)
def _(t):
    cost = t.items.agg(F.sum("total_cost").alias("cost"))
    return tidy(tidy(insight.waste_totals(waste(t), cost), 8, "waste_usd"), 9, "waste_share")


@query("waste_patterns", f"SELECT class, count(DISTINCT session) AS sessions, count(*) AS occurrences FROM {WASTE} w GROUP BY class", "items")
def _(t):
    return insight.waste_patterns(waste(t))


@query(
    "opportunity_waste",
    f"SELECT session, 'claude-code' AS source, class, title, fix_text AS fix, round(est_usd_saved, 8) AS impact_usd FROM ({OPPORTUNITIES}) o",
    "priced_commands",
)
def _(t):
    sources = t.ev.select("session", F.lit("claude-code").alias("source")).distinct()
    return tidy(insight.opportunity_waste(opp.opportunities(rows(t)), sources), 8, "impact_usd")


@query(
    "delegation_wins",
    """SELECT * FROM (SELECT coalesce(model, '(unknown model)') AS model, count(*) AS launches, round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS success_rate,
       CAST(round(sum(k) / count(*)) AS BIGINT) AS avg_return_chars, round(avg(CASE WHEN k % 2 = 0 THEN value END), 6) AS avg_cost FROM ev GROUP BY ALL) x WHERE success_rate > 0""",
    "ev",
)
def _(t):
    launches = t.ev.select(
        "model", F.when(F.col("event_type") != "error", F.lit("completed")).otherwise(F.lit("failed")).alias("status"), F.col("k").alias("returned_chars"),
        F.when(F.col("k") % 2 == 0, F.col("value")).alias("cost"))
    return tidy(tidy(insight.wins(launches), 9, "success_rate"), 6, "avg_cost")


@query(
    "delegation_patterns",
    """SELECT bucket, models, count(*) AS sessions, round(avg(total_cost), 6) AS avg_cost, CAST(round(avg(return_chars)) AS BIGINT) AS avg_return_chars,
       bucket || ' · ' || CASE models WHEN '' THEN 'no delegation' ELSE models END AS shape FROM (SELECT *, CASE WHEN subagents = 0 THEN '0 subagents' WHEN subagents <= 2 THEN '1-2 subagents'
         WHEN subagents <= 5 THEN '3-5 subagents' ELSE '6+ subagents' END AS bucket, CASE WHEN subagents = 0 THEN '' WHEN k % 2 = 0 THEN 'brand#' || (k % 5) || '+opus-4' ELSE 'brand#' || (k % 5) END AS models FROM items) x
       GROUP BY ALL""",
    "items",
)
def _(t):
    names = F.when(F.col("subagents") == 0, F.array().cast("array<string>")).otherwise(F.reverse(F.transform("usage_by_model", lambda m: m["model"])))
    return tidy(insight.delegation_patterns(t.items.withColumn("delegation_models", names)), 6, "avg_cost")


@query(
    "cost_drivers",
    """SELECT session, rank, thread, round(est_usd, 8) AS est_usd, result_chars FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY est_usd DESC NULLS LAST, result_chars DESC, thread) AS rank
       FROM (SELECT session, thread, round(sum(est_usd), 9) AS est_usd, CAST(sum(result_chars) AS BIGINT) AS result_chars FROM priced_commands GROUP BY ALL) a) b WHERE rank <= 3""",
    "priced_commands",
)
def _(t):
    by_thread = tidy(shell_usage.by_thread(t.priced_commands), 9, "est_usd")
    return tidy(insight.cost_drivers(by_thread).select("session", "rank", "thread", "est_usd", "result_chars"), 8, "est_usd")


@query(
    "session_headlines",
    f"""SELECT session, '$' || printf('%.2f', round(total_cost, 2)) || ' across ' || CASE WHEN k % 2 = 0 THEN 'brand#' || (k % 5) || ', opus-4' ELSE 'brand#' || (k % 5) END || '; ' ||
        CASE WHEN sub_cost IS NULL THEN 'unpriced' ELSE CAST(round(sub_cost / total_cost * 100) AS BIGINT) || '%' END || ' of cost delegated to subagents (' || archetype || ').' AS headline FROM {SHAPED} s""",
    "items",
)
def _(t):
    return insight.headline(insight.session_shapes(t.items)).select("session", "headline")


@query(
    "recommendations",
    f"""
    SELECT session, rank, tier, finding, change, expected_effect FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tier, impact_usd DESC NULLS LAST, finding) AS rank FROM (
      SELECT session, 0 AS tier, 'Marathon session — ' || CAST(round(share * 100) AS BIGINT) || '% of cost on the main loop, which ran to ' || format('{{:,}}', max_context_tokens) || ' context tokens with 0 compactions.' AS finding,
        '{insight.CHANGE_MARATHON}' AS change, '{insight.EFFECT_MARATHON.replace("'", "''")}' AS expected_effect, CAST(NULL AS DOUBLE) AS impact_usd FROM {SHAPED} s WHERE archetype = 'marathon' AND warn
      UNION ALL SELECT session, 1, 'Fan-out session with ' || outliers || ' subagent(s) past 150 tool calls (worst: ' || w.n || ' at ' || w.c || ').', '{insight.CHANGE_FAN_OUT}', '{insight.EFFECT_FAN_OUT}', NULL
        FROM {SHAPED} s JOIN {BUDGET} b USING (session) WHERE archetype = 'fan-out' AND outliers > 0
      UNION ALL SELECT session, 2, title, fix, CASE WHEN impact_usd IS NOT NULL THEN 'Save ~$' || printf('%.2f', round(impact_usd, 2)) || ' of avoidable spend.' END, impact_usd FROM ({RETURN_WASTE}) x) u) v WHERE rank <= 5
    """,
    "items",
)
def _(t):
    out = insight.recommendations(insight.session_shapes(t.items), budget(t), waste(t))
    return out.select("session", "rank", "tier", "finding", "change", "expected_effect")


@query(
    "truncated_lists",
    "SELECT repo_key AS path, 100 AS shown, count(*) AS total FROM keyed_items GROUP BY repo_key HAVING count(*) > 100",
    "keyed_items",
)
def _(t):
    counts = t.keyed_items.groupBy(F.col("repo_key").alias("path")).agg(F.count(F.lit(1)).alias("total")).withColumn("cap", F.lit(100))
    return insight.truncation(counts)


# Learnings -------------------------------------------------------------------


@query(
    "learning_ids",
    """
    WITH f AS (SELECT event_id, (915148800 + 86400 * (k % 3)) * 1000 AS created_ms, CASE WHEN k % 4 = 0 THEN '!!' ELSE 'Too much ' || event_type || ' in: cat & less!' END AS finding FROM ev),
    b AS (SELECT *, 'L-' || strftime(make_timestamp(created_ms * 1000), '%Y%m%d') || '-' || CASE WHEN finding = '!!' THEN 'learning' ELSE rtrim(left(rtrim(lower(regexp_replace(finding, '[^A-Za-z0-9]+', '-', 'g')), '-'), 40), '-') END AS base FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_ms, finding, event_id) AS nth FROM b)
    SELECT base || CASE nth WHEN 1 THEN '-2' WHEN 2 THEN '-4' ELSE '-' || (nth + 2) END AS id, count(*) AS n FROM n GROUP BY ALL
    """,
    "ev ledger",
)
def _(t):
    k = F.col("k")
    finding = F.when(k % 4 == 0, F.lit("!!")).otherwise(F.concat(F.lit("Too much "), F.col("event_type"), F.lit(" in: cat & less!")))
    base = t.ev.select(((F.lit(915148800).cast("bigint") + 86400 * (k % 3)) * 1000).alias("created_ms"), finding.alias("finding"))
    first = stored(learnings.new_ids(base.distinct(), t.ledger.select("id")).select("id"), "ids")
    existing = first.union(first.select(F.concat("id", F.lit("-3"))))
    return learnings.new_ids(base, existing).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "learning_upsert",
    """
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.status, o.status, 'open') AS status, coalesce(n.finding, o.finding) AS finding, coalesce(o.created_ms, n.now_ms) AS created_ms,
      coalesce(n.repo_key, o.repo_key) AS repo_key, coalesce(n.verification, o.verification) AS verification, o.proposer, o.change, o.metric, o.before, o.after,
      CASE WHEN o.id IS NULL THEN n.sources WHEN n.id IS NULL OR n.sources = o.sources THEN o.sources ELSE o.sources || '+' || n.sources END AS sources,
      CASE WHEN n.status = 'applied' AND o.applied_ms IS NULL THEN n.now_ms ELSE o.applied_ms END AS applied_ms,
      CASE WHEN n.status IN ('verified', 'rejected') AND o.resolved_ms IS NULL THEN n.now_ms ELSE o.resolved_ms END AS resolved_ms
    FROM (SELECT *, 's' || c_custkey AS sources, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS proposer, 'check ' || c_custkey AS verification FROM ledger) o
    FULL JOIN (SELECT 'L' || (c_custkey * 2) AS id, CASE WHEN c_custkey % 7 = 0 THEN '/moved' END AS repo_key, CASE WHEN c_custkey % 6 = 0 THEN 'done' END AS verification,
      's' || (c_custkey * CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) AS sources, CASE c_custkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'verified' END AS status,
      CASE WHEN c_custkey % 5 = 0 THEN 'new' END AS finding, 999000000000 + c_custkey AS now_ms FROM ledger) n ON o.id = n.id
    """,
    "ledger",
)
def _(t):
    k = F.col("c_custkey")
    none = F.lit(None)
    changes = t.ledger.select(
        F.concat(F.lit("L"), (k * 2).cast("string")).alias("id"), F.when(k % 3 == 0, F.lit("applied")).when(k % 3 == 1, F.lit("verified")).alias("status"),
        F.when(k % 5 == 0, F.lit("new")).alias("finding"), F.when(k % 7 == 0, F.lit("/moved")).alias("repo_key"), F.when(k % 6 == 0, F.lit("done")).alias("verification"),
        F.array(F.concat(F.lit("s"), (k * F.when(k % 3 == 0, 2).otherwise(1)).cast("string"))).alias("source_sessions"),
        (999000000000 + k).alias("now_ms"), none.cast("bigint").alias("applied_ms"), none.cast("bigint").alias("resolved_ms"))
    ledger = t.ledger.withColumns({
        "source_sessions": F.array(F.concat(F.lit("s"), k.cast("string"))), "proposer": F.when(k % 2 == 0, F.lit("p")), "verification": F.concat(F.lit("check "), k.cast("string"))})
    out = learnings.upsert(ledger, changes).withColumn("sources", F.array_join("source_sessions", "+"))
    return out.drop("source_sessions", "c_custkey")


@query("learning_listing", "SELECT id FROM ledger WHERE finding IS NOT NULL AND status = 'applied'", "ledger")
def _(t):
    return learnings.listing(t.ledger, status="applied").select("id")


@query("learning_invalid", "SELECT id, 'not a valid learning' AS reason FROM ledger WHERE finding IS NULL", "ledger")
def _(t):
    return learnings.invalid(t.ledger)


@query(
    "learning_board",
    "SELECT repo_key, CASE status WHEN 'open' THEN 'learn' WHEN 'applied' THEN 'change' ELSE 'verify' END AS board_column, count(*) AS learnings FROM ledger GROUP BY ALL",
    "ledger",
)
def _(t):
    return learnings.board(t.ledger).groupBy("repo_key", "board_column").agg(F.count(F.lit(1)).alias("learnings"))


@query(
    "loop_health",
    """SELECT repo_key, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'verified') AS verified,
       count(*) FILTER (status = 'rejected') AS rejected, round(sum(before - after) FILTER (status = 'verified' AND metric = 'costPerDayUsd'), 8) AS verified_saving_per_day,
       round(avg(resolved_ms - applied_ms) FILTER (status = 'verified' AND resolved_ms >= applied_ms) / 86400000, 6) AS cycle_days FROM ledger GROUP BY repo_key""",
    "ledger",
)
def _(t):
    return tidy(tidy(learnings.loop_health(t.ledger, ("repo_key",)), 8, "verified_saving_per_day"), 6, "cycle_days")


def _window_sql(name, low, high, rlow, rhigh):
    cal = f"back >= {low} AND back < {high}"
    roll = f"started_ms >= applied_ms {rlow} AND started_ms < applied_ms {rhigh}"
    return f"""count(*) FILTER ({cal}) AS {name}_sessions, round(coalesce(sum(total_cost) FILTER ({cal}), 0) / 14, 8) AS {name}_cost_per_day,
      round(CASE WHEN count(sub_cost) FILTER ({cal}) = count(*) FILTER ({cal}) THEN sum(sub_cost) FILTER ({cal}) / sum(total_cost) FILTER ({cal}) END, 9) AS {name}_delegation_share,
      round(CASE WHEN sum(i + cr + cw) FILTER ({cal}) > 0 THEN sum(cr) FILTER ({cal}) / sum(i + cr + cw) FILTER ({cal}) END, 9) AS {name}_cache_hit_rate, round(sum(bash_usd) FILTER ({cal}), 8) AS {name}_bash_usd,
      round(coalesce(avg(max_context_tokens) FILTER ({roll}), 0), 8) AS {name}_avg_max_context,
      round(CASE WHEN sum(sub_messages) FILTER ({roll}) > 0 THEN sum(top_tier_messages) FILTER ({roll}) / sum(sub_messages) FILTER ({roll}) END, 9) AS {name}_top_tier_share"""


@query(
    "learning_review",
    f"""
    SELECT id, repo_key, applied_ms, {", ".join(f"coalesce(w.after_{c}, 0) AS after_{c}" for c in ("sessions", "cost_per_day", "avg_max_context"))},
      {", ".join(f"CASE WHEN w.before_sessions > 0 THEN w.before_{c} END AS before_{c}" for c in ("sessions", "cost_per_day", "avg_max_context", "delegation_share", "cache_hit_rate", "bash_usd", "top_tier_share"))},
      {", ".join(f"w.after_{c}" for c in ("delegation_share", "cache_hit_rate", "bash_usd", "top_tier_share"))}
    FROM (SELECT * FROM ledger WHERE status = 'applied') l LEFT JOIN (
      SELECT id, {_window_sql("after", 0, 14, "", "+ 1209600000")}, {_window_sql("before", 14, 28, "- 1209600000", "")}
      FROM (SELECT l.id, l.applied_ms, x.* EXCLUDE (session), k.* EXCLUDE (session), CAST(make_timestamp((l.applied_ms + 1209600000) * 1000) AS DATE) - CAST(make_timestamp(x.started_ms * 1000) AS DATE) AS back
            FROM ledger l JOIN keyed_items x USING (repo_key) JOIN {TOKENS_OF} k ON k.session = x.session
            WHERE l.status = 'applied' AND x.started_ms >= l.applied_ms - 1209600000 - 2 * 86400000 AND x.started_ms < l.applied_ms + 1209600000 + 86400000) m GROUP BY id) w USING (id)
    """,
    "ledger keyed_items item_models",
)
def _(t):
    out = learnings.review(t.ledger, t.keyed_items, 14)
    four = [f"{n}_{c}" for n in ("after", "before") for c in ("cost_per_day", "bash_usd", "avg_max_context")]
    nine = [f"{n}_{c}" for n in ("after", "before") for c in ("delegation_share", "cache_hit_rate", "top_tier_share")]
    return tidy(tidy(out, 8, *four), 9, *nine)


@query(
    "payload_tokens",
    """SELECT session, CAST(ceil(length('{"session":"' || session || '","k":' || k || '}') / 4.0) AS BIGINT) AS tokens FROM items""",
    "items",
)
def _(t):
    return t.items.select("session", text.payload_tokens(F.struct("session", "k")).alias("tokens"))


# Composed reports ------------------------------------------------------------

RECENT = f"(SELECT session FROM keyed_items WHERE started_ms >= {NOW - DAYS * 86_400_000})"
WINS = """(SELECT * FROM (SELECT coalesce(model, '(unknown model)') AS model, count(*) AS launches, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM ev GROUP BY ALL) x WHERE success_rate > 0)"""
KNOWN = "(SELECT * FROM ledger WHERE finding IS NOT NULL)"
RANKED_WASTE = f"""(SELECT *, row_number() OVER (ORDER BY impact_usd DESC NULLS LAST, tier, session_cost DESC NULLS LAST, session, class, title) AS rank FROM {WASTE} w WHERE session IN {RECENT})"""


@query(
    "briefing",
    f"""
    WITH c AS (SELECT * FROM {SUMMARY} a WHERE w = 'current'), p AS (SELECT * FROM {SUMMARY} b WHERE w = 'previous'), rows AS (
    SELECT 'summary' AS section, r AS rank, label, amount FROM (SELECT unnest([
        {{'r': 1, 'label': 'current_cost', 'amount': c.cost}}, {{'r': 2, 'label': 'current_sessions', 'amount': c.sessions}}, {{'r': 3, 'label': 'current_cache_hit_rate', 'amount': c.chr}},
        {{'r': 4, 'label': 'current_sub_cost_share', 'amount': c.scs}}, {{'r': 5, 'label': 'cost_pct', 'amount': (c.cost - p.cost) / p.cost * 100}},
        {{'r': 6, 'label': 'sessions_pct', 'amount': (c.sessions - p.sessions) / p.sessions * 100}}, {{'r': 7, 'label': 'cache_hit_rate_pts', 'amount': (c.chr - p.chr) * 100}},
        {{'r': 8, 'label': 'sub_cost_share_pts', 'amount': (c.scs - p.scs) * 100}}], recursive := true) FROM c, p) s
    UNION ALL SELECT 'archetypes', NULL, archetype, count(*) FROM {SHAPED} s WHERE session IN {RECENT} GROUP BY archetype
    UNION ALL SELECT 'context_warnings', NULL, 'sessions', count(*) FILTER (warn) FROM {SHAPED} s WHERE session IN {RECENT}
    UNION ALL SELECT 'waste_totals', NULL, 'waste_usd', sum(impact_usd) FROM {RANKED_WASTE} w
    UNION ALL SELECT 'waste_totals', NULL, 'waste_items', count(*) FROM {RANKED_WASTE} w
    UNION ALL SELECT 'waste_totals', NULL, 'waste_share', sum(impact_usd) / (SELECT cost FROM c) FROM {RANKED_WASTE} w
    UNION ALL SELECT 'waste', rank, session || ' ' || class || ' ' || title, impact_usd FROM {RANKED_WASTE} w WHERE rank <= 5
    UNION ALL SELECT 'wins', row_number() OVER (ORDER BY launches DESC, model) AS n, model, success_rate FROM {WINS} w QUALIFY n <= 3
    UNION ALL SELECT 'learnings', NULL, status, count(*) FROM {KNOWN} k GROUP BY status
    UNION ALL SELECT 'recent_learnings', row_number() OVER (ORDER BY created_ms DESC, id) AS n, id, NULL FROM {KNOWN} k QUALIFY n <= 5
    UNION ALL SELECT 'daily_costs', NULL, day, cost FROM ({BUCKETS}) b
    UNION ALL SELECT 'top_sessions', row_number() OVER (ORDER BY total_cost DESC, session) AS n, session, total_cost FROM {WINDOWED} q WHERE w = 'current' QUALIFY n <= 5
    UNION ALL SELECT 'cut', 5, 'waste', count(*) AS n FROM {RANKED_WASTE} w HAVING count(*) > 5
    UNION ALL SELECT 'cut', 3, 'wins', count(*) FROM {WINS} w HAVING count(*) > 3
    UNION ALL SELECT 'cut', 5, 'recent_learnings', count(*) FROM {KNOWN} k HAVING count(*) > 5)
    SELECT section, CAST(rank AS BIGINT) AS rank, label, round(CAST(amount AS DOUBLE), 5) AS amount FROM rows
    """,
    "keyed_items item_models items ledger ev",
)
def _(t):
    launches = t.ev.select("model", F.when(F.col("event_type") != "error", F.lit("completed")).otherwise(F.lit("failed")).alias("status"), F.col("k").alias("returned_chars"), F.lit(None).cast("double").alias("cost"))
    return tidy(briefing.briefing(t.keyed_items, waste(t), insight.wins(launches), t.ledger, NOW, ZONE, DAYS), 5, "amount")


@query(
    "text_patterns",
    """
    WITH h AS (SELECT 'c' || conv_id AS session, conv_id * 13 % 101 AS started_ms, turn, role, text FROM conversations WHERE contains(lower(text), 'th'))
    SELECT row_number() OVER (ORDER BY started_ms DESC, session, turn) AS rank, session, role AS field, (SELECT count(*) FROM h) AS total FROM h QUALIFY rank <= 10
    """,
)
def _(t):
    conv = t.raw("conversations")
    fields = conv.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"), F.lit("main").alias("thread"), F.col("turn").alias("line"), F.lit(None).cast("bigint").alias("ts_ms"),
        F.lit(0).alias("ord"), F.col("role").alias("field"), "text", F.lit(None).cast("string").alias("tool"))
    started = conv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"), F.lit("x").alias("source"), (F.col("conv_id") * 13 % 101).alias("started_ms")).distinct()
    return briefing.text_patterns(search.matches(fields, "th").join(started, "session")).select("rank", "session", "field", "total")


# Texts for display -----------------------------------------------------------

ONE_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "text_summaries",
    f"""SELECT doc_id, CASE WHEN length(s) > 160 THEN left(s, 160) || '…' ELSE s END AS summary, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines,
        left(text, 4000) AS shown, length(text) > 4000 AS truncated, length(text) AS full_chars
        FROM (SELECT *, CASE WHEN split_part(text, chr(10), 1) <> '' THEN split_part(text, chr(10), 1) ELSE {ONE_LINE} END AS s FROM documents) d""",
)
def _(t):
    cut = text.capped(F.col("text"), 4000)
    return t.raw("documents").select(
        "doc_id", text.result_summary(F.col("text")).alias("summary"), text.line_count(F.col("text")).alias("lines"), cut["text"].alias("shown"), cut["truncated"].alias("truncated"), cut["full_chars"].alias("full_chars"))


@query(
    "input_summaries",
    """SELECT session, call_id, CASE WHEN length(s) > 120 THEN left(s, 120) || '…' ELSE s END AS summary FROM (
       SELECT session, call_id, trim(regexp_replace(coalesce(json_extract_string(input, '$.command'), json_extract_string(input, '$.file_path'), json_extract_string(input, '$.pattern'),
         json_extract_string(input, '$.query'), input), '\\s+', ' ', 'g')) AS s FROM calls) c""",
    "calls",
)
def _(t):
    return t.calls.select("session", "call_id", text.input_summary(F.col("input")).alias("summary"))
