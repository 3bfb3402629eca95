"""OTLP export lines: routing to sessions and per-session statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.ordered import top_rows

SESSION_ATTRIBUTE = "session.id"
UNASSIGNED = "_unassigned"


def _items(v: Column, path: str) -> Column:
    """An array field, empty when it is missing or of another type."""
    return F.coalesce(jsonx.array_at(v, path), F.array().cast("array<variant>"))


def attribute(attrs: Column, key: str) -> Column:
    """Text of a named attribute: its string value, or any other scalar as text.

    Keys are compared as text: no number, truth value, list or object reads as a name.
    """
    hit = F.get(F.filter(attrs, lambda a: F.try_variant_get(a, "$.key", "string") == key), F.lit(0))
    return F.coalesce(*[F.try_variant_get(hit, f"$.value.{k}", "string") for k in ("stringValue", "intValue", "doubleValue", "boolValue")])


def _log_records(v: Column) -> Column:
    scopes = F.flatten(F.transform(_items(v, "$.resourceLogs"), lambda r: _items(r, "$.scopeLogs")))
    return F.flatten(F.transform(scopes, lambda s: _items(s, "$.logRecords")))


def _metrics(v: Column) -> Column:
    scopes = F.flatten(F.transform(_items(v, "$.resourceMetrics"), lambda r: _items(r, "$.scopeMetrics")))
    return F.flatten(F.transform(scopes, lambda s: _items(s, "$.metrics")))


def _points(metric: Column) -> Column:
    return F.coalesce(*[jsonx.array_at(metric, f"$.{k}.dataPoints") for k in ("gauge", "sum", "histogram")], F.array().cast("array<variant>"))


def _first_id(lists: Column) -> Column:
    ids = F.filter(F.transform(lists, lambda attrs: attribute(attrs, SESSION_ATTRIBUTE)), lambda x: x.isNotNull())
    return F.get(ids, F.lit(0))


def parsed(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    return jsonx.with_parsed(lines.where(F.trim("text") != "")).withColumns({
        "has_logs": F.coalesce(jsonx.is_array(jsonx.at(v, "$.resourceLogs")), F.lit(False)),
        "has_metrics": F.coalesce(jsonx.is_array(jsonx.at(v, "$.resourceMetrics")), F.lit(False)),
    })


def routed(lines: DataFrame) -> DataFrame:
    """Session of each export: resource attributes of logs, log records, resource attributes of metrics, data points."""
    v = F.col("v")
    attrs = lambda x: _items(x, "$.attributes")
    resource = lambda x: _items(x, "$.resource.attributes")
    found = F.coalesce(
        _first_id(F.transform(_items(v, "$.resourceLogs"), resource)), _first_id(F.transform(_log_records(v), attrs)),
        _first_id(F.transform(_items(v, "$.resourceMetrics"), resource)),
        _first_id(F.transform(F.flatten(F.transform(_metrics(v), _points)), attrs)),
    )
    clean = F.col("__id")
    unsafe = clean.isNull() | clean.isin("", ".", "..") | clean.rlike(r"[/\\\x00]")
    named = jsonx.computed_once(parsed(lines), {"__id": F.trim(found)})
    return named.withColumn("session", F.when(unsafe, F.lit(UNASSIGNED)).otherwise(clean)).drop("__id")


def _event(r: Column, attrs: Column) -> Column:
    return F.coalesce(attribute(attrs, "event.name"), jsonx.string_at(r, "$.body.stringValue"), F.lit("__unknown"))


def _number(attrs: Column, key: str) -> Column:
    return attribute(attrs, key).try_cast("double")


def _metric(m: Column) -> Column:
    return F.coalesce(jsonx.string_at(m, "$.name"), F.lit("__unknown"))


def _total(m: Column) -> Column:
    """Sum of a metric's data points."""
    value = lambda p: F.coalesce(
        F.try_variant_get(p, "$.asDouble", "double"), F.try_variant_get(p, "$.asInt", "string").try_cast("double"), F.try_variant_get(p, "$.sum", "double"))
    return F.aggregate(F.transform(_points(m), value), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def log_events(lines: DataFrame) -> DataFrame:
    """One row per log record of routed lines."""
    r, a = F.col("r"), F.col("a")
    each = lines.where("has_logs").select("session", "line", F.posexplode(_log_records(F.col("v"))).alias("pos", "r")).withColumn("a", _items(r, "$.attributes"))
    return each.select(
        "session", "line", "pos", _event(r, a).alias("event"), (F.try_variant_get(r, "$.timeUnixNano", "decimal(38,0)") / 1_000_000).cast("bigint").alias("ts_ms"),
        _number(a, "cost_usd").alias("cost_usd"), _number(a, "duration_ms").alias("duration_ms"),
        attribute(a, "tool_name").alias("tool_name"), attribute(a, "decision").alias("decision"), attribute(a, "source").alias("decision_source"),
    )


def metric_points(lines: DataFrame) -> DataFrame:
    each = lines.where("has_metrics").select("session", "line", F.posexplode(_metrics(F.col("v"))).alias("pos", "m"))
    return each.select("session", "line", "pos", _metric(F.col("m")).alias("metric"), _total(F.col("m")).alias("value"))


def _is_cost(name: Column) -> Column:
    return (name == "cost.usage") | name.endswith(".cost.usage")


def _is_hook(name: Column) -> Column:
    return (name == "hook_registered") | name.startswith("hook_execution_")


def session_stats(lines: DataFrame) -> DataFrame:
    """Requests, cost, durations and payload counts per session; event costs beat the cost metric.

    Each line gives one row for itself and one for each of its records and
    metrics, so it is parsed once and one aggregate makes all figures.
    """
    kind, x, a = F.col("kind"), F.col("x"), F.col("a")

    def part(name: str, items: Column) -> Column:
        return F.transform(items, lambda item: F.struct(F.lit(name).alias("kind"), item.alias("x")))

    own = F.array(F.struct(F.lit("line").alias("kind"), F.lit(None).cast("variant").alias("x")))
    each = lines.select("session", "has_logs", "has_metrics", F.explode(F.concat(own, part("log", _log_records(F.col("v"))), part("metric", _metrics(F.col("v"))))).alias("p"))
    each = each.select("session", "has_logs", "has_metrics", "p.kind", "p.x").withColumn("a", F.when(kind == "log", _items(x, "$.attributes")))
    log, metric = kind == "log", kind == "metric"
    rows = jsonx.computed_once(each.select("session", "has_logs", "has_metrics", "kind", "x", "a"), {
        "event": F.when(log, _event(x, a)), "cost": F.when(log, _number(a, "cost_usd")), "took": F.when(log, _number(a, "duration_ms")),
        "metric": F.when(metric, _metric(x)), "value": F.when(metric, _total(x)),
    })
    line, event = kind == "line", F.col("event")
    request = log & (event == "api_request")
    cost, took = F.when(request, F.col("cost")), F.when(request, F.col("took"))
    known = request | event.isin("tool_decision", "mcp_server_connection") | _is_hook(event)
    paid = _is_cost(F.col("metric"))
    return rows.groupBy("session").agg(
        F.count_if(line & F.col("has_logs")).alias("log_payloads"), F.count_if(line & F.col("has_metrics")).alias("metric_payloads"),
        F.count_if(line & ~F.col("has_logs") & ~F.col("has_metrics")).alias("malformed_lines"),
        F.count_if(request).alias("requests"), F.sum(cost).alias("__events"), F.count(took).alias("durations"), F.sum(took).alias("duration_sum"),
        F.min(took).alias("duration_min"), F.max(took).alias("duration_max"), F.avg(took).alias("duration_avg"),
        F.count_if(event == "tool_decision").alias("decisions"), F.count_if(event == "mcp_server_connection").alias("mcp_events"),
        F.count_if(_is_hook(event)).alias("hook_events"), F.count_if(log & ~known).alias("other_events"),
        F.sum(F.when(metric & paid, F.col("value"))).alias("__metric"), F.count_if(metric & ~paid).alias("other_metrics"),
    ).withColumns({
        "cost_usd": F.coalesce("__events", "__metric", F.lit(0.0)),
        "cost_source": F.when(F.col("__events").isNotNull(), F.lit("api_request_events")).when(F.col("__metric").isNotNull(), F.lit("cost_metric")).otherwise(F.lit("none")),
    }).drop("__events", "__metric")


def tool_decisions(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """Decisions of each session in order, the first ``cap`` if given."""
    rows = log_events(lines).where("event = 'tool_decision'")
    return top_rows(rows, ["session"], [F.col("line"), F.col("pos")], cap).select("session", "rank", "ts_ms", "tool_name", "decision", "decision_source")


def health_events(lines: DataFrame) -> DataFrame:
    rows = log_events(lines)
    mcp = F.col("event") == "mcp_server_connection"
    return rows.where(mcp | _is_hook(F.col("event"))).select("session", "line", "pos", F.when(mcp, F.lit("mcp")).otherwise(F.lit("hook")).alias("kind"), "event", "ts_ms")


def unrecognized(lines: DataFrame) -> DataFrame:
    """Counts of event and metric names that no statistic covers."""
    e = log_events(lines)
    known = F.col("event").isin("api_request", "tool_decision", "mcp_server_connection") | _is_hook(F.col("event"))
    events = e.where(~known).select("session", F.lit("event").alias("signal"), F.col("event").alias("name"))
    metrics = metric_points(lines).where(~_is_cost(F.col("metric"))).select("session", F.lit("metric").alias("signal"), F.col("metric").alias("name"))
    return events.unionByName(metrics).groupBy("session", "signal", "name").agg(F.count(F.lit(1)).alias("count"))
