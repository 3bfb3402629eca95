"""Repository overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import repo, text
from ..functions.nulls import strict_sum
from ..functions.ordered import top_rows
from ..functions.times import local_day

TOP = 5
PROMPT_LIMIT = 80


def totals(items: DataFrame) -> DataFrame:
    """Counts, cost, tokens, delegation and shell sums per repository."""
    return items.groupBy("repo_key").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("source") == repo.SOURCE_A).alias("sessions_a"), F.count_if(F.col("source") == repo.SOURCE_B).alias("sessions_b"),
        F.sum("total_cost").alias("total_cost"), F.bool_and("cost_is_complete").alias("cost_is_complete"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("main_tokens").alias("main_tokens"), F.sum("sub_tokens").alias("sub_tokens"),
        strict_sum(F.col("main_cost")).alias("main_cost"), strict_sum(F.col("sub_cost")).alias("sub_cost"),
        F.sum("bash_calls").alias("bash_calls"), F.sum("bash_chars").alias("bash_chars"), F.sum("bash_usd").alias("bash_usd"),
    )


def per_day(items: DataFrame) -> DataFrame:
    return items.where("started_ms IS NOT NULL").groupBy("repo_key", local_day(F.col("started_ms")).alias("day")).agg(
        F.sum("total_cost").alias("cost"), F.count(F.lit(1)).alias("sessions"))


def by_model(items: DataFrame) -> DataFrame:
    each = items.select("repo_key", F.explode("usage_by_model").alias("m"))
    return each.groupBy("repo_key", F.col("m.model").alias("model")).agg(
        F.sum("m.input_tokens").alias("input_tokens"), F.sum("m.output_tokens").alias("output_tokens"),
        F.sum("m.cache_read_tokens").alias("cache_read_tokens"), F.sum("m.cache_write_tokens").alias("cache_write_tokens"),
        F.sum("m.cost").alias("cost"))


def top_sessions(items: DataFrame) -> DataFrame:
    order = [F.col("total_cost").desc(), F.col("session")]
    return top_rows(items, ["repo_key"], order, TOP).select(
        "repo_key", "rank", "session", "source", "total_cost", text.clip(F.col("first_prompt"), PROMPT_LIMIT).alias("first_prompt"))


def shell_distribution(items: DataFrame) -> DataFrame:
    """How often each shell output size occurs per repository: the sorted samples as counts."""
    return items.groupBy("repo_key", "bash_chars").agg(F.count(F.lit(1)).alias("sessions"))
