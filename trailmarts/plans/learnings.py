"""The ledger of learnings: upsert, listing, board, and the check before and after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nulls import ratio_or_null
from ..functions.ordered import numbered, ranged, running
from ..functions.times import DAY_MS, local_day
from .trends import model_sum

REQUIRED = ["id", "created_ms", "finding", "change", "status"]
STAMPED = ["id", "created_ms", "status", "applied_ms", "resolved_ms"]
RECENT = 5


def new_ids(findings: DataFrame, existing: DataFrame) -> DataFrame:
    """Dated slug ids; ids that are taken get the next free suffix from 2 up.

    New rows are numbered within their base id, and the nth takes the nth free
    suffix, so gaps in the existing ids are filled first: n plus the taken
    suffixes that have fewer than n free ones below them.
    """
    stamp = F.date_format(local_day(F.col("created_ms")), "yyyyMMdd")
    base = F.concat(F.lit("L-"), stamp, F.lit("-"), text.slug(F.col("finding")))
    dealt = ranged(findings.withColumn("base", base), ["base"], ["created_ms", "finding"])
    fresh = numbered(dealt, ["base"], "created_ms", "nth", ties=["finding"], chunk=F.col("range")).drop("range")
    suffix = F.regexp_extract("id", r"-(\d+)$", 1)
    taken = existing.select("id").distinct()
    as_base = taken.select(F.col("id").alias("base"), F.lit(1).cast("bigint").alias("n"))
    as_suffixed = taken.where(suffix != "").select(F.regexp_replace("id", r"-\d+$", "").alias("base"), suffix.cast("bigint").alias("n")).where("n >= 2")
    used = ranged(as_base.unionByName(as_suffixed).distinct(), ["base"], ["n"])
    free_below = numbered(used, ["base"], "n", "i", chunk=F.col("range")).select("base", (F.col("n") - F.col("i")).alias("nth"), F.lit(1).alias("taken"))
    axis = ranged(fresh.withColumn("taken", F.lit(0)).unionByName(free_below, allowMissingColumns=True), ["base"], ["nth", "taken"])
    n = F.col("nth") + F.col("passed")
    placed = running(axis, ["base"], "nth", {"passed": ("sum", F.col("taken").cast("bigint"))}, ties=["taken"], chunk=F.col("range")).where("taken = 0")
    return placed.withColumn("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))).select(*findings.columns, "id")


def upsert(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes by id: only given fields change, applied and resolved times are stamped once.

    ``changes`` carries the change time ``now_ms`` and may carry ``applied_ms``,
    ``resolved_ms`` and any other column of the ledger; source sessions are
    added to those known. New ids are inserted as open.
    """
    old, new = ledger.alias("o"), changes.alias("n")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    applied = F.when(
        (n("status") == "applied") & o("applied_ms").isNull(), F.coalesce(n("applied_ms"), n("now_ms"))
    ).otherwise(F.coalesce(n("applied_ms"), o("applied_ms")))
    done = n("status").isin("verified", "rejected")
    resolved = F.when(done & o("resolved_ms").isNull(), F.coalesce(n("resolved_ms"), n("now_ms"))).otherwise(
        F.coalesce(n("resolved_ms"), o("resolved_ms")))
    return old.join(new, o("id") == n("id"), "full_outer").select(
        F.coalesce(o("id"), n("id")).alias("id"), F.coalesce(o("created_ms"), n("now_ms")).alias("created_ms"),
        F.coalesce(n("status"), o("status"), F.lit("open")).alias("status"),
        applied.alias("applied_ms"), resolved.alias("resolved_ms"),
        *[
            (merged_sources(o(c), n(c)) if c == "source_sessions" else F.coalesce(n(c), o(c)) if c in changes.columns else o(c)).alias(c)
            for c in ledger.columns if c not in STAMPED
        ],
    )


def valid(ledger: DataFrame) -> DataFrame:
    return ledger.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))


def invalid(ledger: DataFrame) -> DataFrame:
    return ledger.where(" OR ".join(f"{c} IS NULL" for c in REQUIRED)).select("id", F.lit("not a valid learning").alias("reason"))


def listing(ledger: DataFrame, status: str | None = None, repo: str | None = None) -> DataFrame:
    out = valid(ledger)
    if status is not None:
        out = out.where(F.col("status") == status)
    if repo is not None:
        out = out.where(F.col("repo_key") == repo)
    return out.orderBy(F.col("created_ms").desc(), "id")


def merged_sources(existing, added):
    """Source sessions without duplicates, existing ones first."""
    return F.array_distinct(F.concat(F.coalesce(existing, F.array()), F.coalesce(added, F.array())))


def board(ledger: DataFrame) -> DataFrame:
    column = (
        F.when(F.col("status") == "open", F.lit("learn")).when(F.col("status") == "applied", F.lit("change")).otherwise(F.lit("verify")))
    return ledger.withColumn("board_column", column)


def loop_health(ledger: DataFrame, keys=("repo_key",)) -> DataFrame:
    verified = F.col("status") == "verified"
    daily = verified & (F.col("metric") == "costPerDayUsd")
    cycle = verified & (F.col("resolved_ms") >= F.col("applied_ms"))
    return ledger.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "applied", "verified", "rejected")],
        F.sum(F.when(daily, F.col("before") - F.col("after"))).alias("verified_saving_per_day"),
        (F.avg(F.when(cycle, F.col("resolved_ms") - F.col("applied_ms"))) / DAY_MS).alias("cycle_days"),
    )


def _calendar(applied: DataFrame, facts: DataFrame, window_days: int) -> DataFrame:
    """Sums of both calendar windows per learning, from one row per repository and day."""
    daily = facts.groupBy("repo_key", local_day(F.col("started_ms")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cost").alias("cost"), F.sum("sub_cost").alias("sub"), F.count("sub_cost").alias("known"),
        F.sum("bash_usd").alias("usd"), F.sum("__read").alias("read"), F.sum("__in").alias("input"))
    anchor = local_day(F.col("applied_ms") + window_days * DAY_MS)
    back = F.explode(F.sequence(F.lit(0), F.lit(2 * window_days - 1))).alias("back")
    days = applied.select("id", "repo_key", anchor.alias("__anchor"), back).withColumn("day", F.date_sub("__anchor", F.col("back")))
    sums = []
    for name, inside in (("after", F.col("back") < window_days), ("before", F.col("back") >= window_days)):
        total = lambda c, cond=inside: F.sum(F.when(cond, F.col(c)))
        sums += [
            F.coalesce(total("n"), F.lit(0)).alias(f"{name}_sessions"), (F.coalesce(total("cost"), F.lit(0.0)) / window_days).alias(f"{name}_cost_per_day"),
            ratio_or_null(F.when(total("known") == total("n"), total("sub")), total("cost")).alias(f"{name}_delegation_share"),
            ratio_or_null(total("read"), total("input")).alias(f"{name}_cache_hit_rate"), total("usd").alias(f"{name}_bash_usd"),
        ]
    return days.join(daily, ["repo_key", "day"]).groupBy("id").agg(*sums)


def _rolling(applied: DataFrame, facts: DataFrame, window_days: int) -> DataFrame:
    """Context peak and top-tier share right before and after each change.

    Window sums are differences of running sums along the start times of a
    repository, read off at the window bounds, so learnings and sessions are
    never paired.
    """
    span = window_days * DAY_MS
    bounds = F.explode(F.array(*[F.struct(F.lit(i).alias("bound"), (F.col("applied_ms") + d).alias("t")) for i, d in enumerate((-span, 0, span))])).alias("b")
    marks = applied.select("id", "repo_key", bounds).select("id", "repo_key", "b.*", F.lit(0).alias("kind"))
    values = {"n": F.col("max_context_tokens").isNotNull().cast("bigint"), "peak": F.col("max_context_tokens"), "msgs": F.col("sub_messages"), "top": F.col("top_tier_messages")}
    points = facts.select("repo_key", F.col("started_ms").alias("t"), F.lit(1).alias("kind"), *[v.alias(f"__{k}") for k, v in values.items()])
    # A bound comes before the sessions that start at it.
    cum = running(
        marks.unionByName(points, allowMissingColumns=True), ["repo_key"], "t", {k: ("sum", F.col(f"__{k}")) for k in values},
        ties=["kind"], chunk=F.floor(F.col("t") / DAY_MS)).where("kind = 0")
    at = lambda k, i: F.max(F.when(F.col("bound") == i, F.col(k)))
    sums = []
    for name, low, high in (("after", 1, 2), ("before", 0, 1)):
        part = {k: at(k, high) - at(k, low) for k in values}
        sums += [
            F.coalesce(ratio_or_null(part["peak"], part["n"]), F.lit(0.0)).alias(f"{name}_avg_max_context"),
            ratio_or_null(part["top"], part["msgs"]).alias(f"{name}_top_tier_share"),
        ]
    return cum.groupBy("id").agg(*sums)


def review(learnings: DataFrame, items: DataFrame, window_days: int) -> DataFrame:
    """Each applied learning with its repository's figures before and after the change.

    Cost, shares and shell dollars use the calendar-day windows that end
    ``window_days`` after the change (UTC); context peak and top-tier share
    use rolling windows around it. A later window without sessions costs 0; an
    earlier one without sessions has no figures.
    """
    applied = learnings.where("status = 'applied' AND applied_ms IS NOT NULL").select("id", "repo_key", "applied_ms")
    facts = items.where("started_ms IS NOT NULL").join(applied.select("repo_key").distinct(), "repo_key", "left_semi").select(
        "repo_key", "started_ms", "total_cost", "sub_cost", "bash_usd", "max_context_tokens", "sub_messages", "top_tier_messages",
        model_sum("cache_read_tokens").alias("__read"),
        (model_sum("input_tokens") + model_sum("cache_read_tokens") + model_sum("cache_write_tokens")).alias("__in"),
    )
    out = applied.join(_calendar(applied, facts, window_days), "id", "left").join(_rolling(applied, facts, window_days), "id", "left")
    zero = [f"{w}_{c}" for w in ("after", "before") for c in ("sessions", "cost_per_day", "avg_max_context")]
    figures = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    before = [c for c in figures.columns if c.startswith("before_")]
    return figures.withColumns({c: F.when(F.col("before_sessions") > 0, F.col(c)) for c in before})
