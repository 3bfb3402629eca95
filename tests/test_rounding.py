"""Halves: shares of dollars do not hang on the order of rows, dollars are rounded as they are stored."""

from conftest import rows
from pyspark.sql import functions as F

from trailmarts.operators import shell_usage, tools
from trailmarts.plans import insight

# 0.036 dollars in all; the part of "a" is 0.03375, 93.75 %, that of "b" 0.00225, 6.25 %.
PARTS = [("a", 0.0027)] * 12 + [("a", 0.00135)] + [("b", 0.00015)] * 15


def priced(spark, parts):
    data = [("s", thread, "m", line, usd) for line, (thread, usd) in enumerate(parts)]
    made = spark.createDataFrame(data, "session string, thread string, model string, line bigint, est_usd double")
    return made.selectExpr("*", "'x' AS tool", "false AS is_error", "1L AS input_chars", "4L AS result_chars").coalesce(1)


def test_shares_of_dollars_round_halves_up_in_any_order(spark):
    for parts in (PARTS, PARTS[::-1], PARTS[::2] + PARTS[1::2]):
        for by_thread in (shell_usage.by_thread, tools.usage_by_thread):
            assert rows(by_thread(priced(spark, parts)), "thread", "usd_share_pct") == [("a", 93.8), ("b", 6.3)]


def test_shares_of_dollars_without_a_price(spark):
    for by_thread in (shell_usage.by_thread, tools.usage_by_thread):
        assert rows(by_thread(priced(spark, [("a", None), ("b", 0.5)])), "thread", "usd_share_pct") == [("a", None), ("b", 100.0)]


def test_headline_rounds_the_stored_value(spark):
    shaped = spark.createDataFrame([("s", 153.545), ("t", 0.125), ("u", 2.0)], "session string, total_cost double").selectExpr(
        "*", "1.0D AS sub_cost", "array(named_struct('model', 'm')) AS usage_by_model", "0.5D AS main_cost_share", "'mixed' AS archetype", "false AS context_warning")
    shown = insight.headline(shaped).select("session", F.split("headline", " ")[0].alias("usd"))
    assert rows(shown) == [("s", "$153.54"), ("t", "$0.13"), ("u", "$2.00")]
