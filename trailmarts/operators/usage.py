"""API messages, token usage and cost per session, model and scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.nulls import all_known, ratio_or_zero
from .pricing import TOKENS

USAGE = [*TOKENS, "cache_write_5m_tokens", "cache_write_1h_tokens"]
MAIN = "main"


def dedupe_messages(snapshots: DataFrame) -> DataFrame:
    """One row per message: line, model and time of its first line, usage of its last line that has one.

    Both picks are aggregates, so a message with many snapshots is combined
    before the shuffle.
    """
    first = F.min_by(F.struct("line", "model", "ts_ms"), F.col("line"))
    last = F.max_by(F.struct(*USAGE), F.when(F.col("has_usage"), F.col("line")))
    return (
        snapshots.groupBy("session", "thread", "message_id")
        .agg(first.alias("f"), last.alias("u"))
        .select("session", "thread", "message_id", "f.*", "u.*")
    )


def context_tokens():
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")


def _sums(*extra):
    return [
        F.count(F.lit(1)).alias("messages"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("cost").alias("cost"),
        F.sum("cache_write_cost").alias("cache_write_cost"),
        *extra,
    ]


def usage_by_model(costed: DataFrame, keys=("session",)) -> DataFrame:
    """Tokens and cost per model; the cost is unknown only when no message of the model is priced."""
    return costed.groupBy(*keys, "model").agg(*_sums(all_known(F.col("cost")).alias("cost_is_complete")))


def usage_total(by_model: DataFrame, keys=("session",)) -> DataFrame:
    return by_model.groupBy(*keys).agg(
        F.sum("messages").alias("messages"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.bool_and("cost_is_complete").alias("cost_is_complete"),
    )


def merge_threads(by_thread_model: DataFrame) -> DataFrame:
    """Usage of the main thread and all subagents merged by model."""
    return by_thread_model.groupBy("session", "model").agg(
        F.sum("messages").alias("messages"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("cost").alias("cost"),
        F.bool_and("cost_is_complete").alias("cost_is_complete"),
    )


def dominant_model(costed: DataFrame, keys=("session", "thread")) -> DataFrame:
    """The model with most input tokens per key, the first seen on ties, and the first seen."""
    per = costed.groupBy(*keys, "model").agg(
        F.sum("input_tokens").alias("tokens"), F.min("line").alias("first_line")
    )
    return per.groupBy(*keys).agg(
        F.max_by("model", F.struct(F.col("tokens"), -F.col("first_line"))).alias("dominant_model"),
        F.min_by("model", "first_line").alias("first_model"),
    )


def primary_model(by_model: DataFrame, keys=("session",)) -> DataFrame:
    """The most expensive model; ties and unknown costs fall to the smaller name."""
    return by_model.groupBy(*keys).agg(
        F.min_by("model", F.struct(-F.coalesce(F.col("cost"), F.lit(0.0)), F.col("model"))).alias("primary_model")
    )


def delegation(costed: DataFrame, keys=("session",)) -> DataFrame:
    """Main thread against all subagents: tokens, output, messages and cost."""
    main = F.col("thread") == MAIN
    moved = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))

    def split(name, x):
        return [
            F.coalesce(F.sum(F.when(main, x)), F.lit(0)).alias(f"main_{name}"),
            F.coalesce(F.sum(F.when(~main, x)), F.lit(0)).alias(f"sub_{name}"),
        ]

    return costed.groupBy(*keys).agg(
        *split("tokens", moved),
        *split("output_tokens", F.col("output_tokens")),
        *split("messages", F.lit(1)),
        *split("cost", F.coalesce(F.col("cost"), F.lit(0.0))),
        all_known(F.col("cost")).alias("cost_is_complete"),
    )


def delegation_by_model(costed: DataFrame) -> DataFrame:
    """The same split per model; a scope the model never ran in costs 0, an unpriced scope is unknown."""
    main = F.col("thread") == MAIN
    moved = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))

    def scope(name, cond):
        n = F.count(F.when(cond, F.lit(1)))
        known = F.count(F.when(cond, F.col("cost")))
        return [
            n.alias(f"{name}_messages"),
            F.coalesce(F.sum(F.when(cond, moved)), F.lit(0)).alias(f"{name}_tokens"),
            F.when((n == 0) | (known > 0), F.coalesce(F.sum(F.when(cond, F.col("cost"))), F.lit(0.0))).alias(f"{name}_cost"),
        ]

    return costed.groupBy("session", "model").agg(*scope("main", main), *scope("sub", ~main))


def model_mix(by_model: DataFrame) -> DataFrame:
    """Output tokens per model over models that did anything."""
    active = (sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0])) > 0) | (F.coalesce(F.col("cost"), F.lit(0.0)) > 0)
    return by_model.where(active).groupBy("model").agg(
        F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("sessions")
    )


def cache_hit_rate(tokens_by_key: DataFrame) -> DataFrame:
    return tokens_by_key.withColumn("cache_hit_rate", ratio_or_zero(F.col("cache_read_tokens"), context_tokens()))


def context_peak(costed: DataFrame) -> DataFrame:
    """Largest context of the main thread per session."""
    return costed.where(F.col("thread") == MAIN).groupBy("session").agg(
        F.max(context_tokens()).alias("max_context_tokens"), F.count(F.lit(1)).alias("points")
    )


def top_tier_share(costed: DataFrame, keys=("session",)) -> DataFrame:
    """Share of subagent messages on top-tier models, NULL without subagent messages."""
    sub = F.col("thread") != MAIN
    n = F.count(F.when(sub, F.lit(1)))
    top = F.count(F.when(sub & models.is_top_tier(F.col("model")), F.lit(1)))
    return costed.groupBy(*keys).agg(
        n.alias("sub_messages"), top.alias("top_tier_messages"), F.when(n > 0, top / n).alias("top_tier_share")
    )
