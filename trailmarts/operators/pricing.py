"""Effective-dated prices: which rates apply to a message, and what it costs.

A price history has one row per model key and start date (NULL = since ever)
with rates per token. A model is resolved to one key first (exact id, id
without its date, longest key that prefixes the id), then the entry in effect
on the day of the message is taken within that key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import models, text, times

RATES = [
    "input_rate", "output_rate", "cache_write_rate", "cache_read_rate",
    "input_rate_200k", "output_rate_200k", "cache_write_rate_200k", "cache_read_rate_200k",
    "cache_write_1h_rate",
]
PRICING = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("valid_from", T.DateType())]
    + [T.StructField(r, T.DoubleType()) for r in RATES]
)
TIER_TOKENS = 200_000
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
COSTS = ["input_cost", "output_cost", "cache_read_cost", "cache_write_cost", "cost"]


def intervals(pricing: DataFrame) -> DataFrame:
    """Each price entry with the half-open range of days it is in effect."""
    # A later row for the same model and day replaces the earlier one, as in a history file.
    w = Window.partitionBy("model").orderBy(F.col("valid_from").asc_nulls_first())
    until = F.lead("valid_from").over(w)
    return pricing.select(
        F.col("model").alias("price_key"), "valid_from", until.alias("valid_until"), *RATES
    )


def resolve_keys(models_df: DataFrame, pricing: DataFrame, column: str = "model") -> DataFrame:
    """``(model, price_key)`` for every distinct model that has a key.

    All prefixes of a model id are matched by equality, so the longest-prefix
    rule needs no theta join. There are as many rows here as distinct models.
    """
    keys = pricing.select(F.col("model").alias("price_key")).distinct()
    ids = models_df.select(F.col(column).alias("model")).where("model IS NOT NULL").distinct()
    plain = models.plain_id(F.col("model"))
    candidates = ids.select("model", plain.alias("plain")).select(
        "model",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.col("plain").alias("price_key"), F.lit(1_000_000).alias("rank")),
                    F.struct(models.undated_id(F.col("plain")).alias("price_key"), F.lit(500_000).alias("rank")),
                ),
                F.transform(
                    F.sequence(F.lit(1), F.length("plain")),
                    lambda n: F.struct(F.substr(F.col("plain"), F.lit(1), n).alias("price_key"), n.alias("rank")),
                ),
            )
        ).alias("c"),
    ).where("length(c.price_key) > 0").select("model", "c.*")
    return candidates.join(keys, "price_key").groupBy("model").agg(F.max_by("price_key", "rank").alias("price_key"))


def with_rates(usage: DataFrame, pricing: DataFrame, day: Column | None) -> DataFrame:
    """Add the rates in effect on ``day`` (the newest entry when ``day`` is None).

    Models are resolved to keys once per distinct model; the entry is then
    found by equality on the key and the day range, which at most one entry
    of a key satisfies. Spark broadcasts both small sides when it measures
    them below its threshold.
    """
    keyed = usage.join(resolve_keys(usage, pricing), "model", "left")
    spans = intervals(pricing).withColumnRenamed("price_key", "__key")
    if day is None:
        newest = spans.where("valid_until IS NULL").drop("valid_from", "valid_until")
        return keyed.join(newest, F.col("price_key") == F.col("__key"), "left").drop("price_key", "__key")
    dated = keyed.withColumn("__day", day)
    in_effect = (
        (F.col("price_key") == F.col("__key"))
        & (F.col("valid_from").isNull() | F.col("__day").isNull() | (F.col("valid_from") <= F.col("__day")))
        & (F.col("valid_until").isNull() | (F.col("__day") < F.col("valid_until")))
    )
    return dated.join(spans, in_effect, "left").drop("price_key", "__key", "__day", "valid_from", "valid_until")


def cost_columns() -> dict[str, Column]:
    """The four cost components and the total from tokens and rates, NULL when unpriced."""
    c = F.col
    zero = (c("input_tokens") == 0) & (c("output_tokens") == 0) & (c("cache_read_tokens") == 0) & (c("cache_write_tokens") == 0)
    above = (c("input_tokens") + c("cache_read_tokens") + c("cache_write_tokens")) > TIER_TOKENS
    priced = c("input_rate").isNotNull() & c("output_rate").isNotNull()

    def tier(rate: str, *fallback: Column) -> Column:
        return F.coalesce(F.when(above, c(f"{rate}_200k")), c(rate), *fallback)

    write_rate = tier("cache_write_rate", c("input_rate") * 1.25)
    hour_rate = F.coalesce(c("cache_write_1h_rate"), c("input_rate") * 2)
    split = c("cache_write_5m_tokens").isNotNull() | c("cache_write_1h_tokens").isNotNull()
    write = F.when(
        split,
        F.coalesce(c("cache_write_5m_tokens"), F.lit(0)) * write_rate
        + F.coalesce(c("cache_write_1h_tokens"), F.lit(0)) * hour_rate,
    ).otherwise(c("cache_write_tokens") * write_rate)

    def cost(x: Column) -> Column:
        return F.when(zero, F.lit(0.0)).when(priced, x)

    parts = {
        "input_cost": cost(c("input_tokens") * tier("input_rate")),
        "output_cost": cost(c("output_tokens") * tier("output_rate")),
        "cache_read_cost": cost(c("cache_read_tokens") * tier("cache_read_rate", c("input_rate") * 0.1)),
        "cache_write_cost": cost(write),
    }
    total = parts["input_cost"] + parts["output_cost"] + parts["cache_read_cost"] + parts["cache_write_cost"]
    return {**parts, "cost": total}


def priced(usage: DataFrame, pricing: DataFrame, day: Column | None = None, *, latest: bool = False) -> DataFrame:
    """Usage rows with their five costs; the day defaults to the UTC day of ``ts_ms``."""
    for name in ("cache_write_5m_tokens", "cache_write_1h_tokens"):
        if name not in usage.columns:
            usage = usage.withColumn(name, F.lit(None).cast("bigint"))
    if not latest and day is None:
        day = times.local_day(F.col("ts_ms"))
    rated = with_rates(usage, pricing, None if latest else day)
    return rated.withColumns(cost_columns()).drop(*RATES)


def with_result_cost(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Estimated dollars of the result text at the thread model's newest input rate.

    Needs ``model`` (of the owning thread) and ``result_chars``; placeholders
    and unpriced models stay NULL.
    """
    rated = with_rates(calls, pricing, None)
    known = ~F.coalesce(F.col("placeholder"), F.lit(False)) if "placeholder" in calls.columns else F.lit(True)
    est = F.when(known, text.approx_tokens(F.col("result_chars")) * F.col("input_rate"))
    return rated.withColumn("est_usd", est).drop(*RATES)


def merge_history(history: DataFrame, snapshot: DataFrame, fetched_on: Column) -> tuple[DataFrame, DataFrame]:
    """Append a snapshot's rates where they differ from the entry in effect on ``fetched_on``.

    Returns the new history and the appended rows. A change on a day that
    already has other rates for the model fails the job.
    """
    spans = intervals(history)
    current = spans.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= fetched_on))
        & (F.col("valid_until").isNull() | (fetched_on < F.col("valid_until")))
    )
    cur = current.select(
        F.col("price_key").alias("model"), F.col("valid_from").alias("__since"),
        F.struct(*RATES).alias("__current"),
    )
    known = history.select("model").distinct().withColumn("__known", F.lit(True))
    new = snapshot.select("model", F.struct(*RATES).alias("__new"))
    changed = (
        new.join(cur, "model", "left").join(known, "model", "left")
        .where(~F.col("__new").eqNullSafe(F.col("__current")))
    )
    conflict = F.assert_true(
        F.coalesce(F.col("__since") != fetched_on, F.lit(True)),
        F.concat(F.lit("prices changed twice on one day for "), F.col("model")),
    )
    appended = (
        changed.withColumn("__ok", conflict).where("__ok IS NULL")
        .select(
            "model",
            F.when(F.col("__known"), fetched_on).cast("date").alias("valid_from"),
            *[F.col("__new")[r].alias(r) for r in RATES],
        )
    )
    return history.select("model", "valid_from", *RATES).unionByName(appended), appended
