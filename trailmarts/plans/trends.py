"""Daily trends over a window of local days, against the window before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nulls import pct_change, points_change, ratio_or_null, strict_sum
from ..functions.times import DAY_MS, local_day

MIN_ACTIVE_DAYS = 4
SPIKE_DEVIATIONS = 2
TOP = 5
PROMPT_LIMIT = 120
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def windowed(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    """Items of the current and the previous window with their local day and window label.

    A superset in milliseconds comes first: it reaches the file scan, the
    calendar filter does not.
    """
    days = max(0, int(days))
    today = local_day(F.lit(now_ms).cast("bigint"), zone)
    inside = items.where(
        (F.col("started_ms") >= now_ms - (2 * days + 2) * DAY_MS) & (F.col("started_ms") < now_ms + 2 * DAY_MS))
    if repo_key is not None:
        inside = inside.where(F.col("repo_key") == repo_key)
    back = F.date_diff(today, F.col("day"))
    label = F.when((back >= 0) & (back < days), F.lit("current")).when((back >= days) & (back < 2 * days), F.lit("previous"))
    return inside.withColumn("day", local_day(F.col("started_ms"), zone)).withColumn("window", label).where("window IS NOT NULL")


def model_sum(token: str):
    """A token count summed over the nested models of a session."""
    return F.aggregate("usage_by_model", F.lit(0).cast("bigint"), lambda acc, m: acc + m[token])


def _tokens() -> list:
    return [model_sum(t).alias(t) for t in TOKENS]


def _hit_rate():
    return ratio_or_null(F.col("cache_read_tokens"), F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))


def buckets(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    """One row per day of the current window, days without sessions included."""
    current = windowed(items, now_ms, days, zone, repo_key).where("window = 'current'").select("*", *_tokens())
    sums = current.groupBy("day").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("user_turns").alias("user_turns"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.sum("total_cost").alias("cost"),
        *[F.sum(t).alias(t) for t in TOKENS],
        strict_sum(F.col("main_cost")).alias("main_cost"), strict_sum(F.col("sub_cost")).alias("sub_cost"),
        F.sum("compactions").alias("compactions"),
        F.sum("returns").alias("returns"), F.sum("return_chars").alias("return_chars"), F.max("return_max_chars").alias("return_max_chars"),
        F.sum("bash_calls").alias("bash_calls"), F.sum("bash_chars").alias("bash_chars"), F.sum("bash_usd").alias("bash_usd"),
        F.lit(True).alias("__seen"),
    )
    today = local_day(F.lit(now_ms).cast("bigint"), zone)
    every = items.sparkSession.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    zero = ["sessions", "user_turns", "duration_ms", "compactions", "bash_calls", "bash_chars", *TOKENS]
    out = every.join(sums, "day", "left").withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in zero}, "cost": F.coalesce("cost", F.lit(0.0)),
        # An empty day has a known cost of 0, a day with an unpriced session an unknown one.
        "main_cost": F.when(F.col("__seen"), F.col("main_cost")).otherwise(F.lit(0.0)),
        "sub_cost": F.when(F.col("__seen"), F.col("sub_cost")).otherwise(F.lit(0.0)),
    })
    return out.withColumn("cache_hit_rate", _hit_rate()).drop("__seen")


def window_totals(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    rows = windowed(items, now_ms, days, zone, repo_key).select("*", *_tokens())
    sums = rows.groupBy("window").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("total_cost").alias("cost"), *[F.sum(t).alias(t) for t in TOKENS],
        strict_sum(F.col("sub_cost")).alias("__sub"), F.sum("bash_chars").alias("bash_chars"), F.sum("bash_usd").alias("bash_usd"),
    )
    return sums.select(
        "window", "sessions", "cost", _hit_rate().alias("cache_hit_rate"), ratio_or_null(F.col("__sub"), F.col("cost")).alias("sub_cost_share"),
        "bash_chars", "bash_usd",
    )


def summary(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    """Totals of both windows and their change on one row; no change without a previous window."""
    totals = window_totals(items, now_ms, days, zone, repo_key)
    names = ["sessions", "cost", "cache_hit_rate", "sub_cost_share", "bash_chars", "bash_usd"]
    pick = lambda w, n: F.max(F.when(F.col("window") == w, F.col(n))).alias(f"{w}_{n}")
    one = totals.agg(*[pick(w, n) for w in ("current", "previous") for n in names]).withColumns({
        "current_sessions": F.coalesce("current_sessions", F.lit(0)), "current_cost": F.coalesce("current_cost", F.lit(0.0)),
        "current_bash_chars": F.coalesce("current_bash_chars", F.lit(0)),
    })
    change = {}
    for n in ("sessions", "cost", "bash_chars", "bash_usd"):
        change[f"{n}_pct"] = pct_change(F.col(f"current_{n}"), F.col(f"previous_{n}"))
    for n in ("cache_hit_rate", "sub_cost_share"):
        change[f"{n}_pts"] = points_change(F.col(f"current_{n}"), F.col(f"previous_{n}"))
    return one.withColumns(change)


def day_models(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    current = windowed(items, now_ms, days, zone, repo_key).where("window = 'current'")
    each = current.select("day", F.explode("usage_by_model").alias("m"))
    return each.groupBy("day", F.col("m.model").alias("model")).agg(
        F.sum("m.input_tokens").alias("input_tokens"), F.sum("m.output_tokens").alias("output_tokens"), F.sum("m.cost").alias("cost"))


def spike_days(bucket_rows: DataFrame) -> DataFrame:
    """Days above mean + 2 standard deviations of all days of the window; needs four active days."""
    stats = bucket_rows.agg(
        F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("stddev"), F.count_if(F.col("sessions") > 0).alias("active"))
    over = F.col("cost") > F.col("mean") + SPIKE_DEVIATIONS * F.col("stddev")
    # ``stats`` is one row.
    return bucket_rows.select("day", "cost", "sessions").join(F.broadcast(stats), (F.col("active") >= MIN_ACTIVE_DAYS) & over).select(
        "day", "cost", "mean", "stddev")


def top_sessions(items: DataFrame, now_ms: int, days: int, zone: str, repo_key: str | None = None) -> DataFrame:
    current = windowed(items, now_ms, days, zone, repo_key).where("window = 'current'")
    return current.orderBy(F.col("total_cost").desc(), "session").limit(TOP).select(
        "session", "source", "repo_key", "total_cost", "started_ms", text.clip(F.col("first_prompt"), PROMPT_LIMIT).alias("first_prompt"))
