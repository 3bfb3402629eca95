"""The briefing of a repository, and patterns in the texts of its sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_rows
from ..functions.times import DAY_MS
from . import insight, learnings, trends

DAYS = 7
WASTE_SHOWN = {"concise": 5, "full": 50}
WINS_SHOWN = {"concise": 3, "full": None}
PATTERNS_SHOWN = {"concise": 10, "full": 100}


def recent(items: DataFrame, now_ms: int, days: int = DAYS, repo_key: str | None = None) -> DataFrame:
    """Sessions that started within the last ``days`` times 24 hours."""
    out = items.where(F.col("started_ms") >= now_ms - days * DAY_MS)
    return out if repo_key is None else out.where(F.col("repo_key") == repo_key)


def _rows(df: DataFrame, section: str, rank: Column, label: Column, amount: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), rank.cast("bigint").alias("rank"), label.cast("string").alias("label"), amount.cast("double").alias("amount"))


def _shown(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows with their place. The result of a list is a page, so the limit comes first."""
    page = df if limit is None else df.orderBy(*order).limit(limit)
    return top_rows(page.withColumn("__all", F.lit(True)), ["__all"], order, limit)


def briefing(
    items: DataFrame, waste: DataFrame, wins: DataFrame, ledger: DataFrame, now_ms: int, zone: str, days: int = DAYS, repo_key: str | None = None, detail: str = "concise",
) -> DataFrame:
    """Rows (section, rank, label, amount) of the whole report.

    Totals, changes, daily costs and top sessions use calendar days of
    ``zone``; archetypes, warnings and waste use the sessions of the last
    ``days`` times 24 hours. ``wins`` are per model; lists that were cut are
    named with their full length.
    """
    parts = []
    summary = trends.summary(items, now_ms, days, zone, repo_key)
    names = [
        "current_cost", "current_sessions", "current_cache_hit_rate", "current_sub_cost_share", "cost_pct", "sessions_pct", "cache_hit_rate_pts", "sub_cost_share_pts",
    ]
    measures = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(n).alias("label"), F.col(n).cast("double").alias("amount")) for i, n in enumerate(names)])).alias("m")
    parts.append(summary.select(measures).select(F.lit("summary").alias("section"), F.col("m.rank").cast("bigint").alias("rank"), "m.label", "m.amount"))
    shaped = insight.session_shapes(recent(items, now_ms, days, repo_key))
    per_shape = shaped.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rows(per_shape, "archetypes", F.lit(None), F.col("archetype"), F.col("n")))
    parts.append(_rows(shaped.agg(F.count_if("context_warning").alias("n")), "context_warnings", F.lit(None), F.lit("sessions"), F.col("n")))
    own = waste.join(recent(items, now_ms, days, repo_key).select("session"), "session", "left_semi")
    totals = insight.waste_totals(own, summary.select(F.col("current_cost").alias("cost")))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("amount")) for n in ("waste_usd", "waste_items", "waste_share")])).alias("m")
    parts.append(_rows(totals.select(both), "waste_totals", F.lit(None), F.col("m.label"), F.col("m.amount")))
    found = _shown(own, insight.waste_order(), WASTE_SHOWN[detail])
    parts.append(_rows(found, "waste", F.col("rank"), F.concat_ws(" ", "session", "class", "title"), F.col("impact_usd")))
    best = [F.col("launches").desc(), F.col("model")]
    parts.append(_rows(_shown(wins, best, WINS_SHOWN[detail]), "wins", F.col("rank"), F.col("model"), F.col("success_rate")))
    known = learnings.valid(ledger if repo_key is None else ledger.where(F.col("repo_key") == repo_key))
    by_status = known.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rows(by_status, "learnings", F.lit(None), F.col("status"), F.col("n")))
    latest = _shown(known, [F.col("created_ms").desc(), F.col("id")], learnings.RECENT)
    parts.append(_rows(latest, "recent_learnings", F.col("rank"), F.col("id"), F.lit(None)))
    parts.append(_rows(trends.buckets(items, now_ms, days, zone, repo_key), "daily_costs", F.lit(None), F.col("day"), F.col("cost")))
    top = _shown(trends.top_sessions(items, now_ms, days, zone, repo_key), [F.col("total_cost").desc(), F.col("session")], None)
    parts.append(_rows(top, "top_sessions", F.col("rank"), F.col("session"), F.col("total_cost")))
    for path, rows, limit in (("waste", own, WASTE_SHOWN[detail]), ("wins", wins, WINS_SHOWN[detail]), ("recent_learnings", known, learnings.RECENT)):
        if limit is not None:
            parts.append(_rows(rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "cut", F.lit(limit), F.lit(path), F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_patterns(hits: DataFrame, detail: str = "concise") -> DataFrame:
    """The first search hits over all sessions, newest sessions first, and how many there are.

    ``hits`` come from the search results: session, source, started_ms, line, thread, field, snippet.
    """
    order = [F.col("started_ms").desc_nulls_last(), F.col("session"), F.col("line"), F.col("thread")]
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = _shown(hits, order, PATTERNS_SHOWN[detail])
    return page.join(F.broadcast(total), F.lit(True)).select("rank", "source", "session", "field", F.col("snippet").alias("excerpt"), "total")  # total is one row
