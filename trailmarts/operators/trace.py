"""Evaluation trace: every event of a session in one ordered table, enriched by captured requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import earliest, ranged, running
from . import records_a

# Event names shared with other tracing tools.
USER, ASSISTANT, CALL, RESULT = "gen_ai.user.message", "gen_ai.assistant.message", "gen_ai.tool.call", "gen_ai.tool.result"
LAUNCH, NOTE, COMPACTION, API_ERROR = "subagent_launch", "task_notification", "compaction", "api_error"
INJECTED, REQUEST, HIDDEN = "injected_context", "request", "hidden_call"
LAUNCH_TOOLS = ["Agent", "Task"]


def hidden_calls(captures: DataFrame, request_ids: DataFrame) -> DataFrame:
    """Captured exchanges whose request the transcript does not know."""
    return captures.where("request_id IS NOT NULL").join(request_ids.select("session", "request_id").distinct(), ["session", "request_id"], "left_anti")


def enriched_requests(messages: DataFrame, captures: DataFrame) -> DataFrame:
    """Messages with the exchange captured for their request id (session, request_id, latency_ms, …)."""
    one = earliest(captures.where("request_id IS NOT NULL"), ["session", "request_id"], [F.col("started_ms")], ["latency_ms", "status", "request_bytes", "response_bytes"])
    return messages.join(one, ["session", "request_id"], "left")


def _event(df: DataFrame, name, attributes: dict, line="line") -> DataFrame:
    pairs = []
    for key, column in attributes.items():
        pairs += [F.lit(key), F.col(column).cast("string")]
    attrs = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select("session", F.col(line).cast("bigint").alias("line") if line else F.lit(None).cast("bigint").alias("line"), "ts_ms", F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), attrs.alias("attributes"))


def events(rec: DataFrame, calls: DataFrame, requests: DataFrame, hidden: DataFrame) -> DataFrame:
    """All events of the main thread. ``requests`` are enriched messages, ``hidden`` have no line."""
    main = rec.where("thread = 'main'")
    said = main.where("type = 'assistant'").select("session", "line", "ts_ms", "request_id", "model", F.explode("blocks").alias("b")).where("b.kind = 'text'").withColumn("text", F.col("b.text"))
    first = earliest(calls.where("thread = 'main'"), ["session", "call_id"], [F.col("line")], [c for c in calls.columns if c not in ("session", "call_id")])
    done = first.where("has_result").withColumn("ts_ms", F.col("result_ts_ms"))
    kind = F.when(F.col("tool").isin(*LAUNCH_TOOLS), F.lit(LAUNCH)).otherwise(F.lit(CALL))
    parts = [
        _event(records_a.prompts(main), USER, {"text": "text"}),
        _event(said, ASSISTANT, {"text": "text", "model": "model", "request_id": "request_id"}),
        _event(first, kind, {"call_id": "call_id", "tool": "tool", "input": "input"}),
        _event(done.where(~F.col("tool").isin(*LAUNCH_TOOLS)), RESULT, {"call_id": "call_id", "tool": "tool", "is_error": "is_error"}, "result_line"),
        _event(records_a.notifications(main), NOTE, {"task_id": "task_id", "status": "status", "exit_code": "exit_code"}),
        _event(records_a.compactions(main), COMPACTION, {"trigger": "trigger", "pre_tokens": "pre_tokens", "post_tokens": "post_tokens"}),
        _event(records_a.api_errors(main), API_ERROR, {"status": "status", "retry_attempt": "retry_attempt", "message": "message"}),
        _event(records_a.injected_listings(main).withColumn("ts_ms", F.lit(None).cast("bigint")), INJECTED, {"kind": "kind", "text": "text"}),
        _event(requests, REQUEST, {"request_id": "request_id", "model": "model", "latency_ms": "latency_ms", "status": "status"}),
        _event(hidden, HIDDEN, {"request_id": "request_id", "status": "status"}, None),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ordered(trace: DataFrame, **chunking) -> DataFrame:
    """Add ``sort_key``: the line, or a place between lines for events that have none.

    Events without a line go before the first line whose time, in line order,
    reaches theirs: half-way to the line before it, half a line before the
    first, half a line after the last; without a time they go last. The first
    line that reaches a time is found along the running maximum of the times,
    by counting, so no range join is needed.
    """
    lined, loose = trace.where("line IS NOT NULL"), trace.where("line IS NULL")
    anchors = lined.where("ts_ms IS NOT NULL").groupBy("session", "line").agg(F.max("ts_ms").alias("ts_ms"))
    # Only lines that raise the running maximum can be the first to reach a time.
    peaks = running(anchors, ["session"], "line", {"peak": ("max", F.col("ts_ms")), "before": ("prev", F.struct("line"))}, **chunking)
    above = running(peaks, ["session"], "line", {"last_peak": ("prev", F.col("peak"))}, **chunking)
    rising = above.where("last_peak IS NULL OR peak > last_peak").select(
        "session", F.col("peak").alias("t"), F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("one"),
        F.when(F.col("before").isNull(), F.col("line") - 0.5).otherwise((F.col("before.line") + F.col("line")) / 2).alias("key"))
    ends = anchors.groupBy("session").agg(F.max("line").alias("last_line"))
    axis = loose.withColumns({"t": F.col("ts_ms"), "kind": F.lit(0), "one": F.lit(0).cast("bigint")}).where("t IS NOT NULL").unionByName(rising, allowMissingColumns=True)
    # The number of peaks strictly below a time names the next one.
    counted = running(ranged(axis, ["session"], ["t", "kind"]), ["session"], "t", {"below": ("sum", F.col("one"))}, ties=["kind"], chunk=F.col("range")).drop("range")
    spots = counted.where("kind = 1").select("session", F.col("below").alias("nth"), "key")
    timed = (
        counted.where("kind = 0").select(*trace.columns, (F.col("below") + 1).alias("nth")).join(spots, ["session", "nth"], "left").join(ends, "session", "left")
        .select(*trace.columns, F.coalesce("key", F.col("last_line") + 0.5, F.lit(float("inf"))).alias("sort_key"))
    )
    untimed = loose.where("ts_ms IS NULL").withColumn("sort_key", F.lit(float("inf")))
    return lined.withColumn("sort_key", F.col("line").cast("double")).unionByName(timed).unionByName(untimed)


def channels(captures: DataFrame, requests: DataFrame) -> DataFrame:
    """Per session: which side channels were available and how many requests they explain."""
    seen = captures.groupBy("session").agg(F.count(F.lit(1)).alias("captures"))
    per = requests.groupBy("session").agg(F.count(F.lit(1)).alias("requests"), F.count("latency_ms").alias("enriched"))
    return per.join(seen, "session", "left").select(
        "session", "requests", "enriched", F.coalesce("captures", F.lit(0)).alias("captures"), F.col("captures").isNotNull().alias("capture_available"))


NOT_ASKED = "not consulted for this trace"
#: What a trace leaves out, by name.
LIMITATIONS = {
    "subagents": "launches are summarised; the calls and messages of a subagent are in its own session data",
    "listings": "listings injected into the context were not looked for",
    "telemetry": "telemetry names no request, so cost and duration of single requests are not taken from it",
    "reconstruction": "single requests are not reconstructed",
}


def enrichment(sessions: DataFrame, captures: DataFrame | None = None, telemetry: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """One row per session and side channel: whether it was consulted and had anything, its rows, a note, and the hidden calls of captures.

    A channel that is None was not consulted. ``sessions``, ``captures``,
    ``telemetry`` and ``hidden`` have a session; repeated sessions count once.
    """
    known = sessions.select("session").distinct()

    def counted(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("session").agg(F.count(F.lit(1)).alias(name))

    def channel(name: str, table: DataFrame | None) -> DataFrame:
        none = F.lit(None).cast("bigint")
        rows = known.withColumn("rows", none) if table is None else known.join(counted(table, "rows"), "session", "left")
        found = F.coalesce(F.col("rows"), F.lit(0))
        if name == "captures" and table is not None and hidden is not None:
            rows = rows.join(counted(hidden, "hidden_calls"), "session", "left").withColumn("hidden_calls", F.coalesce("hidden_calls", F.lit(0)))
        else:
            rows = rows.withColumn("hidden_calls", none)
        note = F.lit(NOT_ASKED) if table is None else F.when(found == 0, F.lit("nothing of this session"))
        return rows.select(
            "session", F.lit(name).alias("channel"), F.lit(table is not None).alias("consulted"), (found > 0).alias("available"), found.alias("rows"), note.alias("note"), "hidden_calls")

    return channel("telemetry", telemetry).unionByName(channel("captures", captures))


def limitations(channels_of: DataFrame, listings: bool = True) -> DataFrame:
    """What the trace of each session leaves out: ``name`` and text. ``channels_of`` is that of ``enrichment``; API errors are whole, so none is capped."""
    names = ["subagents", "reconstruction"] + ([] if listings else ["listings"])
    always = channels_of.select("session").distinct().select("session", F.explode(F.array(*map(F.lit, names))).alias("name"))
    measured = channels_of.where("channel = 'telemetry' AND available").select("session", F.lit("telemetry").alias("name"))
    texts = F.create_map(*[F.lit(x) for pair in LIMITATIONS.items() for x in pair])
    return always.unionByName(measured).withColumn("text", texts[F.col("name")])
