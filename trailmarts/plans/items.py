"""The session list: one flat row per session, and how rows are merged, filtered, paged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import repo
from ..functions.times import DAY_MS, local_day

MODEL_USAGE = (
    "array<struct<model:string,input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,"
    "cache_write_tokens:bigint,cost:double>>"
)


def session_items(
    sessions: DataFrame, by_model: DataFrame, delegation: DataFrame, shell_totals: DataFrame, returns: DataFrame,
    prompts: DataFrame, compactions: DataFrame, peaks: DataFrame, top_families: DataFrame,
) -> DataFrame:
    """Assemble list rows from the per-session marts. Only the models of a session are nested; they are few."""
    usage = by_model.groupBy("session").agg(
        F.sort_array(F.collect_list(F.struct(
            "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost"))).alias("usage_by_model"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"), F.bool_and("cost_is_complete").alias("cost_is_complete"),
        F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("total_tokens"),
    )
    split = delegation.select("session", "main_tokens", "main_cost", "sub_tokens", "sub_cost", "sub_messages")
    shell = shell_totals.select(
        "session", F.col("calls").alias("bash_calls"), F.col("result_chars").alias("bash_chars"), F.col("est_usd").alias("bash_usd"))
    asked = prompts.groupBy("session").agg(
        F.count(F.lit(1)).alias("user_turns"), F.min_by("text", "line").alias("first_prompt"))
    packed = compactions.groupBy("session").agg(F.count(F.lit(1)).alias("compactions"))
    backs = returns.select("session", "returns", F.col("total_chars").alias("return_chars"), F.col("max_chars").alias("return_max_chars"))
    out = sessions
    for part in (usage, split, shell, asked, packed, peaks.select("session", "max_context_tokens"), backs, top_families):
        out = out.join(part, "session", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("total_tokens", "bash_calls", "bash_chars", "user_turns", "compactions", "main_tokens", "sub_tokens", "sub_messages")}
    return out.withColumns({**zeros, "total_cost": F.coalesce("total_cost", F.lit(0.0)), "cost_is_complete": F.coalesce("cost_is_complete", F.lit(True))})


def with_repo_key(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumn("repo_key", repo.repo_key(c("source"), c("repo_root"), c("project_dir"), c("repo_url"), c("cwd")))


def vote_roots(sessions: DataFrame) -> DataFrame:
    """The root most sessions of a repository URL have; shorter, then smaller on ties."""
    counts = sessions.where("repo_root IS NOT NULL AND repo_url IS NOT NULL").groupBy("repo_url", "repo_root").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("repo_url").agg(
        F.min_by("repo_root", F.struct(-F.col("n"), F.length("repo_root"), F.col("repo_root"))).alias("voted_root"))


def fill_roots(sessions: DataFrame) -> DataFrame:
    """Sessions without a root take the one their URL voted for. There are as many votes as URLs."""
    known = sessions.join(vote_roots(sessions), "repo_url", "left")
    return known.withColumn("repo_root", F.coalesce("repo_root", "voted_root")).drop("voted_root")


def union_items(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def first_candidates(items: DataFrame, *preference) -> DataFrame:
    """One row per (source, session): the first by ``preference``."""
    best = F.row_number().over(Window.partitionBy("source", "session").orderBy(*preference))
    return items.withColumn("__n", best).where("__n = 1").drop("__n")


def filter_items(
    items: DataFrame, source: str | None = None, repo_key: str | None = None, project_dir: str | None = None,
    session: str | None = None, since_ms: int | None = None, until_ms: int | None = None,
) -> DataFrame:
    """Filters of the list; the start bounds fall back to the file time and exclude their end."""
    out = with_repo_key(items) if repo_key is not None and "repo_key" not in items.columns else items
    start = F.coalesce("started_ms", "mtime_ms")
    if source is not None:
        out = out.where(F.col("source") == source)
    if repo_key is not None:
        out = out.where(F.col("repo_key") == repo_key)
    if project_dir is not None:
        out = out.where(F.col("project_dir") == project_dir)
    if session is not None:
        out = out.where(F.col("session") == session)
    if since_ms is not None:
        out = out.where(start >= since_ms)
    if until_ms is not None:
        out = out.where(start < until_ms)
    return out


def last_days(items: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Sessions started within a rolling window."""
    return items.where(F.col("started_ms") >= now_ms - days * DAY_MS)


def day_range(items: DataFrame, first: str | None, last: str | None, zone: str) -> DataFrame:
    """Sessions started on local days from ``first`` to ``last``, both included."""
    day = local_day(F.col("started_ms"), zone)
    out = items
    if first is not None:
        out = out.where(day >= F.lit(first).cast("date"))
    if last is not None:
        out = out.where(day <= F.lit(last).cast("date"))
    return out


def page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the newest sessions; the order decides ties by source and id."""
    start = F.coalesce("started_ms", "mtime_ms")
    return items.orderBy(start.desc_nulls_last(), "source", "session").offset(offset).limit(limit)


def page_total(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("total"))


def sorted_by(items: DataFrame, column: str, descending: bool, *ties) -> DataFrame:
    """Any column in either direction, missing values last."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return items.orderBy(key, *ties)


def live_sessions(files: DataFrame, now_ms: int, minutes: int = 5) -> DataFrame:
    """Last activity over all files of a session, and whether it lies within the last minutes."""
    return files.groupBy("session").agg(F.max("mtime_ms").alias("last_activity_ms")).withColumn(
        "is_live", F.col("last_activity_ms") >= now_ms - minutes * 60_000)


def one_file_per_session(files: DataFrame) -> DataFrame:
    """Live files before archived ones, then the newest."""
    best = F.row_number().over(Window.partitionBy("session").orderBy("archived", F.col("mtime_ms").desc(), "path"))
    return files.withColumn("__n", best).where("__n = 1").drop("__n")


def with_titles(items: DataFrame, index: DataFrame, desktop: DataFrame) -> DataFrame:
    """Index names override own titles; the desktop store fills what is still missing."""
    named = index.groupBy("session").agg(F.max_by("name", "line").alias("__index"))
    shown = desktop.groupBy("session").agg(F.max_by("title", "created_ms").alias("__desktop"))
    return (
        items.join(named, "session", "left").join(shown, "session", "left")
        .withColumn("title", F.coalesce("__index", "title", "__desktop")).drop("__index", "__desktop")
    )
