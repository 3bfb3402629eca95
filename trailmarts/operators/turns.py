"""User turns: which turn a line belongs to, what a turn cost, groups of timeline entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import ranged, running
from ..session import stored
from .pricing import TOKENS

OUTLIER_SHARE = 0.25
OUTLIER_USD = 0.10


def assign_turns(rows: DataFrame, prompts: DataFrame, **chunking) -> DataFrame:
    """Add ``turn``: the number of prompts at or before the row's line, at least 1.

    Prompts and rows are laid on one line axis and counted along it, so no
    range join is needed. Sessions without prompts have no turns.
    """
    names = rows.columns
    marks = prompts.select("session", F.col("line").alias("__line"), F.lit(0).alias("__kind"), F.lit(1).cast("bigint").alias("__mark"))
    body = rows.withColumns({"__line": F.col("line"), "__kind": F.lit(1), "__mark": F.lit(0).cast("bigint")})
    axis = body.unionByName(marks, allowMissingColumns=True)
    numbered = running(axis, ["session"], "__line", {"__n": ("sum", F.col("__mark"))}, ties=["__kind"], **chunking)
    return (
        numbered.where("__kind = 1").withColumn("turn", F.greatest(F.lit(1), F.col("__n")).cast("bigint"))
        .select(*names, "turn")
        .join(prompts.select("session").distinct(), "session", "left_semi")
    )


def number_prompts(prompts: DataFrame, **chunking) -> DataFrame:
    return running(prompts, ["session"], "line", {"turn": ("sum", F.lit(1).cast("bigint"))}, **chunking)


def turn_usage(costed_turns: DataFrame, prompts: DataFrame, **chunking) -> DataFrame:
    """One row per turn with its tokens, messages and cost; turns without messages hold zeros."""
    sums = costed_turns.groupBy("session", "turn").agg(
        F.count(F.lit(1)).alias("messages"), *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )
    turns = number_prompts(prompts, **chunking).select("session", "turn", F.col("line").alias("turn_line"), F.col("ts_ms").alias("turn_ts_ms"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ["messages", "unpriced", *TOKENS]}
    out = turns.join(sums, ["session", "turn"], "left").withColumns(zero)
    return out.withColumn("cost_partial", F.col("cost").isNotNull() & (F.col("unpriced") > 0))


def outlier_turns(usage: DataFrame) -> DataFrame:
    """Turns with more than a quarter of the session's cost and at least ten cents."""
    whole = usage.groupBy("session").agg(F.sum("cost").alias("session_cost"))
    return usage.join(whole, "session").withColumn(
        "is_outlier",
        F.coalesce((F.col("cost") > F.col("session_cost") * OUTLIER_SHARE) & (F.col("cost") >= OUTLIER_USD), F.lit(False)),
    )


def pages(turn_sizes: DataFrame, budget: int, **chunking) -> DataFrame:
    """Turns of the first page: those whose earlier turns hold fewer than ``budget`` entries."""
    total = running(turn_sizes, ["session"], "turn", {"__upto": ("sum", F.col("entries"))}, **chunking)
    return total.where(F.col("__upto") - F.col("entries") < budget).drop("__upto")


def interleave(turn_rows: DataFrame, compactions: DataFrame) -> DataFrame:
    """Turns and compactions on one line axis, a turn before a compaction of the same line."""
    left = turn_rows.select("session", F.col("turn_line").alias("line"), F.lit(0).alias("kind_order"), F.lit("turn").alias("kind"), F.col("turn").alias("value"))
    right = compactions.select("session", "line", F.lit(1).alias("kind_order"), F.lit("compaction").alias("kind"), F.col("pre_tokens").alias("value"))
    return left.unionByName(right)


def turn_groups(entries: DataFrame, prompts: DataFrame, usage: DataFrame, subtree_costs: DataFrame, **chunking) -> DataFrame:
    """Timeline entries per turn: counts, errors, delegated cost and span.

    ``entries`` has session, line, ts_ms, kind, status, agent and cost;
    ``subtree_costs`` has session, agent, subtree_cost, subtree_complete.
    """
    placed = assign_turns(entries, prompts, **chunking)
    launched = F.col("kind") == "subagent-launch"
    with_tree = placed.join(subtree_costs, ["session", "agent"], "left")
    found = F.col("subtree_cost").isNotNull()
    groups = with_tree.groupBy("session", "turn").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if((F.col("kind") == "tool-call") & (F.col("status") == "error")).alias("tool_errors"),
        F.sum(F.when(launched, F.coalesce("subtree_cost", "cost", F.lit(0.0)))).alias("delegated_cost"),
        F.coalesce(F.bool_or(launched & (~found | ~F.col("subtree_complete"))), F.lit(False)).alias("delegated_incomplete"),
        F.max_by("ts_ms", "line").alias("__last_ts"),
    )
    return (
        usage.select("session", "turn", "turn_line", "turn_ts_ms", "messages", "cost", "cost_partial")
        .join(groups, ["session", "turn"], "left")
        .withColumns({
            "entries": F.coalesce("entries", F.lit(0)), "tool_errors": F.coalesce("tool_errors", F.lit(0)),
            "delegated_incomplete": F.coalesce("delegated_incomplete", F.lit(False)),
            "duration_ms": F.when(F.col("__last_ts") >= F.col("turn_ts_ms"), F.col("__last_ts") - F.col("turn_ts_ms")),
        })
        .drop("__last_ts")
    )


def places_by_start(turns: DataFrame, **chunking) -> DataFrame:
    """``place`` of every turn once those with a start stand in order of it; one without a start keeps its place.

    ``turns`` has session, turn (1, 2, 3, …) and started_ms.
    """
    started = turns.where("started_ms IS NOT NULL").select("session", "turn", "started_ms")
    one = {"__nth": ("sum", F.lit(1).cast("bigint"))}
    by_turn = running(started, ["session"], "turn", one, **chunking).select("session", "__nth", F.col("turn").alias("place"))
    by_time = running(
        ranged(started, ["session"], ["started_ms", "turn"]), ["session"], "started_ms", one, ties=["turn"], chunk=F.col("range"))
    moved = by_time.select("session", "turn", "__nth").join(by_turn, ["session", "__nth"]).drop("__nth")
    return turns.join(moved, ["session", "turn"], "left").withColumn("place", F.coalesce("place", "turn"))


def assign_by_time(entries: DataFrame, placed: DataFrame, **chunking) -> DataFrame:
    """Add ``place``: the turn that is open at an entry, walking the entries in line order.

    An entry opens the next turns that start at or before its time; times may
    be missing or run backwards, a turn once open is never left for an earlier
    one, and a turn without a start lets nothing past it. So an entry belongs
    to the last turn that starts by the latest time so far: a running maximum
    along the lines, then a count along the times.
    """
    names = entries.columns
    stops = placed.where("started_ms IS NULL AND place > 1").groupBy("session").agg(F.min("place").alias("__stop"))
    marks = placed.where("started_ms IS NOT NULL AND place > 1").join(stops, "session", "left").where("__stop IS NULL OR place < __stop")
    seen = running(entries, ["session"], "line", {"__upto": ("max", F.col("ts_ms"))}, ties=["block"], **chunking)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    axis = seen.withColumns({"__kind": F.lit(1), "__mark": zero}).unionByName(
        marks.select("session", F.col("started_ms").alias("__upto"), F.lit(0).alias("__kind"), one.alias("__mark")), allowMissingColumns=True)
    # Entries before any time sort first, where no turn is counted yet.
    counted = running(
        ranged(axis, ["session"], ["__upto", "__kind", "line", "block"], "__range"), ["session"], "__upto", {"__n": ("sum", F.col("__mark"))},
        ties=["__kind", "line", "block"], chunk=F.col("__range"))
    return counted.where("__kind = 1").select(*names, (F.col("__n") + 1).alias("place"))


def turn_groups_by_time(entries: DataFrame, turns: DataFrame, **chunking) -> DataFrame:
    """Timeline entries per turn of format B, whose turns have times but no lines.

    ``entries`` has session, line, block, ts_ms, kind, status and model;
    ``turns`` is that of ``records_b.usage_and_turns``. Models are the turn's
    own, then those of its assistant texts in order. A turn without entries has
    the anchor ``-(place + 1)``, which is never a line.
    """
    placed = stored(places_by_start(turns, **chunking), "places")
    inside = stored(assign_by_time(entries.select("session", "line", "block", "ts_ms", "kind", "status", "model"), placed, **chunking), "entries")
    keys = ["session", "place"]
    groups = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if((F.col("kind") == "tool-call") & (F.col("status") == "error")).alias("tool_errors"),
        F.min("line").alias("anchor_line"), F.min(F.when(F.col("kind") == "user", F.col("line"))).alias("user_line"))
    spoken = inside.where("kind = 'assistant-text' AND model IS NOT NULL").groupBy(*keys, "model").agg(F.min(F.struct("line", "block")).alias("at"))
    named = placed.where("model IS NOT NULL").select(*keys, "model", F.lit(None).cast(spoken.schema["at"].dataType).alias("at"))
    models = named.unionByName(spoken).groupBy(*keys, "model").agg(F.min_by("at", F.when(F.col("at").isNull(), 0).otherwise(1)).alias("at"))
    models = models.groupBy(*keys).agg(F.collect_list(F.struct("at", "model")).alias("__models"))
    return (
        placed.join(groups, keys, "left").join(models, keys, "left")
        .withColumns({
            "entries": F.coalesce("entries", F.lit(0)), "tool_errors": F.coalesce("tool_errors", F.lit(0)),
            "anchor_line": F.coalesce("anchor_line", -(F.col("place") + 1)),
            "models": F.coalesce(F.transform(F.array_sort("__models"), lambda m: m["model"]), F.array().cast("array<string>")),
        })
        .drop("__models", "model")
    )


def requests(records: DataFrame, **chunking) -> DataFrame:
    """Consecutive assistant records of one request, with ordinal and the line before them.

    A record of another kind in between starts a new request.
    """
    keys = ["session", "thread"]
    flagged = records.withColumn("is_assistant", F.col("kind") == "assistant").withColumn(
        "__id", F.when(F.col("is_assistant"), F.coalesce("request_id", "message_id", F.concat(F.lit("line:"), F.col("line").cast("string"))))
    )
    seen = running(flagged, keys, "line", {"__prev": ("prev", F.col("__id"))}, **chunking)
    starts = F.when(F.col("is_assistant") & ~F.col("__id").eqNullSafe(F.col("__prev")), 1).otherwise(0).cast("bigint")
    islands = running(seen, keys, "line", {"__n": ("sum", starts)}, **chunking).where("is_assistant")
    return islands.groupBy(*keys, "__n").agg(
        F.min_by("__id", "line").alias("request_key"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        F.count(F.lit(1)).alias("records"),
    ).withColumn("ordinal", F.col("__n") - 1).drop("__n")
