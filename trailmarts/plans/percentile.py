"""Where a session's shell usage stands among the sessions of its repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running

MIN_SESSIONS = 5


def ranks(values: DataFrame, width: float, **chunking) -> DataFrame:
    """Midpoint percentile of every distinct value per repository, with the median.

    Values are counted first, so equal values cost one row; the running count
    goes along value bands of ``width``, so a repository with most of the
    sessions is not ranked in one task.
    """
    counted = values.groupBy("repo_key", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running(counted, ["repo_key"], "value", {"upto": ("sum", F.col("n"))}, chunk=F.floor(F.col("value") / width))
    size = counted.groupBy("repo_key").agg(F.sum("n").alias("samples"))
    ranked = cum.join(size, "repo_key").withColumn(
        "pct", (F.col("upto") - F.col("n") + F.col("n") / 2) / F.col("samples") * 100)
    low, high = F.floor((F.col("samples") + 1) / 2), F.floor(F.col("samples") / 2) + 1
    middle = ranked.groupBy("repo_key").agg(
        ((F.min(F.when(F.col("upto") >= low, F.col("value"))) + F.min(F.when(F.col("upto") >= high, F.col("value")))) / 2).alias("median"))
    return ranked.join(middle, "repo_key").select("repo_key", "value", "pct", "samples", "median")


def shell_percentile(items: DataFrame) -> DataFrame:
    """By dollars where known and enough sessions are priced, else by characters; needs five sessions."""
    chars = ranks(items.select("repo_key", F.col("bash_chars").alias("value")), 4096)
    usd = ranks(items.where("bash_usd IS NOT NULL").select("repo_key", F.col("bash_usd").alias("value")), 0.01)

    def side(df, value, name):
        return df.where(F.col("samples") >= MIN_SESSIONS).select(
            "repo_key", F.col("value").alias(value), F.struct("value", "pct", "samples", "median").alias(name))

    joined = (
        items.select("repo_key", "session", "bash_chars", "bash_usd")
        .join(side(chars, "bash_chars", "c"), ["repo_key", "bash_chars"])
        .join(side(usd, "bash_usd", "u"), ["repo_key", "bash_usd"], "left")
        .withColumn("s", F.coalesce("u", F.struct(F.col("c.value").cast("double").alias("value"), F.col("c.pct"), F.col("c.samples"), F.col("c.median"))))
    )
    return joined.select(
        "repo_key", "session", F.col("u").isNotNull().alias("by_usd"), (F.round(F.col("s.pct") * 10) / 10).alias("pct"),
        F.when(F.col("s.median") > 0, F.round(F.col("s.value") / F.col("s.median") * 100) / 100).alias("median_ratio"),
        F.col("s.samples").alias("samples"),
    )
