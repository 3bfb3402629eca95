"""Messages, prices, usage and delegation."""

from pyspark.sql import functions as F

from ..operators import pricing as pricing_ops
from ..operators import usage
from .registry import query

r = F.round
TOK = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens"
TOKSUM = ", ".join(f"sum({t}) AS {t}" for t in usage.TOKENS)


@query("message_dedup", "SELECT session, thread, message_id, line, model, ts_ms, " + TOK + ", cache_write_5m_tokens, cache_write_1h_tokens FROM messages", "messages")
def _(t):
    return t.messages


@query(
    "price_keys",
    """
    SELECT model, arg_max(key, CASE WHEN key = plain THEN 1000000
             WHEN key = regexp_replace(plain, '-[0-9]{8}$', '') THEN 500000 ELSE length(key) END) AS price_key
    FROM (SELECT DISTINCT model, regexp_replace(regexp_replace(model, '^us\\.anthropic\\.', ''), '-v[0-9]+:[0-9]+$', '') AS plain FROM snapshots) d
    JOIN (SELECT DISTINCT model AS key FROM pricing) p ON starts_with(plain, key) GROUP BY model
    """,
    "snapshots pricing",
)
def _(t):
    return pricing_ops.resolve_keys(t.snapshots, t.pricing)


@query(
    "message_costs",
    "SELECT session, thread, message_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in pricing_ops.COSTS) + " FROM costed",
    "costed",
)
def _(t):
    return t.costed.select("session", "thread", "message_id", *[r(c, 9).alias(c) for c in pricing_ops.COSTS])


@query(
    "usage_by_model",
    f"""SELECT session, model, count(*) AS messages, {TOKSUM}, round(sum(cost), 9) AS cost,
        count(cost) = count(*) AS cost_is_complete FROM costed GROUP BY session, model""",
    "costed",
)
def _(t):
    out = usage.usage_by_model(t.costed)
    return out.select("session", "model", "messages", *usage.TOKENS, r("cost", 9).alias("cost"), "cost_is_complete")


@query(
    "usage_total",
    f"""SELECT session, count(*) AS messages, {TOKSUM}, round(coalesce(sum(cost), 0), 9) AS cost,
        count(cost) = count(*) AS cost_is_complete FROM costed GROUP BY session""",
    "costed",
)
def _(t):
    out = usage.usage_total(usage.usage_by_model(t.costed))
    return out.withColumn("cost", r("cost", 9))


@query(
    "usage_merge_threads",
    f"""SELECT session, model, count(*) AS messages, {TOKSUM}, round(sum(cost), 9) AS cost,
        count(cost) = count(*) AS cost_is_complete FROM costed GROUP BY session, model""",
    "costed",
)
def _(t):
    by_thread = usage.usage_by_model(t.costed, ("session", "thread"))
    return usage.merge_threads(by_thread).withColumn("cost", r("cost", 9))


@query(
    "dominant_model",
    """
    SELECT session, thread, arg_max(model, (tokens, -first_line)) AS dominant_model, arg_min(model, first_line) AS first_model
    FROM (SELECT session, thread, model, sum(input_tokens) AS tokens, min(line) AS first_line FROM costed GROUP BY ALL) p
    GROUP BY session, thread
    """,
    "costed",
)
def _(t):
    return usage.dominant_model(t.costed)


@query(
    "primary_model",
    """
    SELECT session, model AS primary_model FROM (
      SELECT session, model, row_number() OVER (PARTITION BY session ORDER BY round(coalesce(sum(cost), 0), 9) DESC, model) AS n
      FROM costed GROUP BY session, model) x WHERE n = 1
    """,
    "costed",
)
def _(t):
    by_model = usage.usage_by_model(t.costed).withColumn("cost", r("cost", 9))
    return usage.primary_model(by_model)


MOVED = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"


@query(
    "delegation_split",
    f"""
    SELECT session,
      coalesce(sum({MOVED}) FILTER (thread = 'main'), 0) AS main_tokens, coalesce(sum({MOVED}) FILTER (thread <> 'main'), 0) AS sub_tokens,
      coalesce(sum(output_tokens) FILTER (thread = 'main'), 0) AS main_output_tokens,
      coalesce(sum(output_tokens) FILTER (thread <> 'main'), 0) AS sub_output_tokens,
      count(*) FILTER (thread = 'main') AS main_messages, count(*) FILTER (thread <> 'main') AS sub_messages,
      round(coalesce(sum(cost) FILTER (thread = 'main'), 0), 9) AS main_cost,
      round(coalesce(sum(cost) FILTER (thread <> 'main'), 0), 9) AS sub_cost, count(cost) = count(*) AS cost_is_complete
    FROM costed GROUP BY session
    """,
    "costed",
)
def _(t):
    out = usage.delegation(t.costed)
    return out.withColumns({"main_cost": r("main_cost", 9), "sub_cost": r("sub_cost", 9)})


@query(
    "delegation_by_model",
    f"""
    SELECT session, model, count(*) FILTER (thread = 'main') AS main_messages,
      coalesce(sum({MOVED}) FILTER (thread = 'main'), 0) AS main_tokens,
      CASE WHEN count(*) FILTER (thread = 'main') = 0 OR count(cost) FILTER (thread = 'main') > 0
        THEN round(coalesce(sum(cost) FILTER (thread = 'main'), 0), 9) END AS main_cost,
      count(*) FILTER (thread <> 'main') AS sub_messages,
      coalesce(sum({MOVED}) FILTER (thread <> 'main'), 0) AS sub_tokens,
      CASE WHEN count(*) FILTER (thread <> 'main') = 0 OR count(cost) FILTER (thread <> 'main') > 0
        THEN round(coalesce(sum(cost) FILTER (thread <> 'main'), 0), 9) END AS sub_cost
    FROM costed GROUP BY session, model
    """,
    "costed",
)
def _(t):
    out = usage.delegation_by_model(t.costed)
    return out.withColumns({"main_cost": r("main_cost", 9), "sub_cost": r("sub_cost", 9)})


@query(
    "model_mix",
    f"""SELECT model, sum(output_tokens) AS output_tokens, count(*) AS sessions FROM (
        SELECT session, model, {TOKSUM}, sum(cost) AS cost FROM costed GROUP BY session, model) x
        WHERE {MOVED} > 0 OR coalesce(cost, 0) > 0 GROUP BY model""",
    "costed",
)
def _(t):
    return usage.model_mix(usage.usage_by_model(t.costed))


@query(
    "cache_hit_rate",
    f"""SELECT session, {TOKSUM}, round(CASE WHEN sum(input_tokens + cache_read_tokens + cache_write_tokens) > 0
        THEN sum(cache_read_tokens) / sum(input_tokens + cache_read_tokens + cache_write_tokens) ELSE 0 END, 9) AS cache_hit_rate
        FROM costed GROUP BY session""",
    "costed",
)
def _(t):
    sums = t.costed.groupBy("session").agg(*[F.sum(x).alias(x) for x in usage.TOKENS])
    return usage.cache_hit_rate(sums).withColumn("cache_hit_rate", r("cache_hit_rate", 9))


@query(
    "context_series",
    """SELECT session, thread, message_id, line, input_tokens + cache_read_tokens + cache_write_tokens AS context_tokens,
       output_tokens FROM messages WHERE input_tokens IS NOT NULL""",
    "messages",
)
def _(t):
    m = t.messages.where("input_tokens IS NOT NULL")
    return m.select("session", "thread", "message_id", "line", usage.context_tokens().alias("context_tokens"), "output_tokens")


@query(
    "context_peak",
    """SELECT session, max(input_tokens + cache_read_tokens + cache_write_tokens) AS max_context_tokens, count(*) AS points
       FROM costed WHERE thread = 'main' GROUP BY session""",
    "costed",
)
def _(t):
    return usage.context_peak(t.costed)


@query(
    "price_history_merge",
    """
    SELECT model, CAST(valid_from AS VARCHAR) AS valid_from, round(input_rate * 1e6, 9) AS input_rate FROM pricing
    UNION ALL
    SELECT 'brand#' || b, CASE WHEN b < 20 THEN '2001-01-01' END, round(r, 9) FROM (
      SELECT CAST(regexp_extract(p_brand, '[0-9]+', 0) AS BIGINT) AS b, round(max(p_retailprice) / 100) AS r FROM part GROUP BY 1) s
    """,
    "pricing",
)
def _(t):
    brand = F.regexp_extract("p_brand", r"\d+", 0).cast("bigint")
    snap = t.raw("part").groupBy(brand.alias("b")).agg(F.round(F.max("p_retailprice") / 100).alias("x")).select(
        F.concat(F.lit("brand#"), F.col("b").cast("string")).alias("model"),
        *[(F.col("x") * 1e-6).alias(name) for name in pricing_ops.RATES],
    )
    merged, _ = pricing_ops.merge_history(t.pricing, snap, F.lit("2001-01-01").cast("date"))
    return merged.select("model", F.col("valid_from").cast("string").alias("valid_from"), r(F.col("input_rate") * 1e6, 9).alias("input_rate"))
