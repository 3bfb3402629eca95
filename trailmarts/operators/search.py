"""Full-text search over transcript fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.ordered import top_rows
from . import records_b

SESSIONS, MATCHES = 10, 3


def gate(raw: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Drop raw lines that cannot hold the query before their JSON is parsed.

    JSON writers escape quotes, backslashes and control characters, and may
    escape slashes and anything beyond ASCII, so queries with those pass
    everything, as does a line that holds an escaped code point. An empty query
    is found nowhere.
    """
    if not query:
        return raw.where(F.lit(False))
    if any(c in '"\\/' or not 32 <= ord(c) < 127 for c in query):
        return raw
    held = F.col("text").contains(query) if case_sensitive else F.lower("text").contains(query.lower())
    return raw.where(held | F.col("text").contains("\\u"))


def flat_text(v):
    """Values of a JSON tree, one per line, level by level, in document order of the variant."""

    def leaf(x):
        return F.when(jsonx.is_object(x) | jsonx.is_array(x), F.lit(None).cast("string")).otherwise(x.cast("string"))

    def children(x):
        return F.coalesce(
            F.when(jsonx.is_object(x), F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))).when(
                jsonx.is_array(x), F.try_variant_get(x, "$", "array<variant>")), F.array().cast("array<variant>"))

    start = F.struct(F.array(v).alias("level"), F.transform(F.array(v), leaf).alias("found"))

    def descend(acc, _):
        below = F.flatten(F.transform(acc["level"], children))
        return F.transform(F.array(below), lambda b: F.struct(b.alias("level"), F.concat(acc["found"], F.transform(b, leaf)).alias("found")))[0]

    # A tree is at most as deep as its text has opening brackets.
    deepest = F.coalesce(F.length(F.regexp_replace(F.to_json(v), r"[^\[{]", "")), F.lit(0))
    found = F.aggregate(F.sequence(F.lit(0), deepest), start, lambda acc, i: F.when(F.size(acc["level"]) > 0, descend(acc, i)).otherwise(acc))["found"]
    return F.array_join(F.filter(found, lambda s: s.isNotNull()), "\n")


def fields_a(rec: DataFrame) -> DataFrame:
    """Searchable fields of format A records; ``ord`` keeps their order within a record."""
    keys = ["session", "thread", "line", "ts_ms"]
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    said = F.array_join(F.filter(F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"]), lambda x: x != ""), "\n")
    last = 1 << 20

    def field(order, name, body, tool=None):
        tool = F.lit(None).cast("string") if tool is None else tool
        return F.struct(order.cast("int").alias("ord"), F.lit(name).alias("field"), body.alias("text"), tool.alias("tool"))

    def of_block(b):
        used = F.when(b["kind"] == "tool_use", flat_text(jsonx.parse(b["input"])))
        return F.when(b["kind"] == "thinking", field(b["pos"], "thinking", b["text"])).otherwise(field(b["pos"], "tool_input", used, b["name"]))

    none = F.array().cast("array<struct<ord:int,field:string,text:string,tool:string>>")
    found = F.concat(
        F.coalesce(F.transform(F.when(user, F.col("results")), lambda b: field(b["pos"], "tool_result", b["text"])), none),
        F.coalesce(F.transform(F.when(assistant, F.filter("blocks", lambda b: b["kind"].isin("thinking", "tool_use"))), of_block), none),
        F.array(field(F.lit(last), "user", F.when(user, F.col("prompt_text"))), field(F.lit(last), "assistant", F.when(assistant, said)), field(F.lit(0), "title", F.col("title"))),
    )
    # One pass over the records: a branch for each field would parse every line again.
    each = rec.select(*keys, F.explode(F.filter(found, lambda f: f["text"] != "")).alias("f"))
    return each.select(*keys, "f.ord", "f.field", "f.text", "f.tool")


def fields_b(rec: DataFrame) -> DataFrame:
    """Searchable fields of format B records; messages of response items count only in
    files that have no event of the same kind."""
    keys = ["session", "line", "ts_ms"]
    event, item, k = F.col("type") == "event_msg", F.col("type") == "response_item", F.col("kind")
    calls = k.isin("function_call", "custom_tool_call", "web_search_call")
    message = item & (k == "message") & (F.col("role").isin("user", "assistant")) & ~((F.col("role") == "user") & text.is_injected(F.col("text")))
    field = (
        F.when(event & (k == "user_message"), F.lit("user")).when(event & (k == "agent_message"), F.lit("assistant")).when(event & (k == "thread_name_updated"), F.lit("title"))
        .when(message, F.col("role")).when(item & (k == "reasoning"), F.lit("thinking")).when(item & calls, F.lit("tool_input")).when(item & k.isin(*records_b.OUTPUTS), F.lit("tool_result")))
    args = jsonx.parse(F.col("arguments"))
    body = (
        F.when(k == "function_call", F.when(args.isNotNull(), flat_text(args)).otherwise(F.col("arguments"))).when(k == "custom_tool_call", F.col("arguments"))
        .when(k == "web_search_call", F.col("query")).otherwise(F.col("text")))
    tool = F.when(k == "web_search_call", F.lit("web_search")).otherwise(F.col("name"))
    rows = rec.select(*keys, "type", "kind", field.alias("field"), body.alias("text"), tool.alias("tool"), message.alias("__deferred"))
    seen = rec.where(event & k.isin("user_message", "agent_message")).select(
        "session", F.when(k == "user_message", F.lit("user")).otherwise(F.lit("assistant")).alias("field")).distinct().withColumn("__seen", F.lit(True))
    kept = rows.where("field IS NOT NULL AND text IS NOT NULL AND text <> ''").join(seen, ["session", "field"], "left")
    return kept.where(~(F.coalesce("__deferred", F.lit(False)) & F.coalesce("__seen", F.lit(False)))).select(
        "session", F.lit("main").alias("thread"), "line", "ts_ms", F.lit(0).alias("ord"), "field", "text", "tool")


def matches(fields: DataFrame, query: str, case_sensitive: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """One row per record that holds the query: first field with a hit, all occurrences, a snippet."""
    pool = fields if wanted is None else fields.where(F.col("field").isin(*wanted))
    pool = pool if query else pool.where(F.lit(False))
    hay = F.col("text") if case_sensitive else F.lower("text")
    hits = pool.where(hay.contains(query if case_sensitive else query.lower())).select(
        "session", "thread", "line", "ts_ms", "ord", "field", "tool", text.occurrences(F.col("text"), query, case_sensitive).alias("n"),
        text.snippet(F.col("text"), query, case_sensitive).alias("snippet"))
    first = F.min_by(F.struct("field", "tool", "snippet"), F.struct("ord", "field"))
    return hits.groupBy("session", "thread", "line").agg(F.first("ts_ms").alias("ts_ms"), F.sum("n").alias("occurrences"), first.alias("f")).select(
        "session", "thread", "line", "ts_ms", "occurrences", "f.*")


def results(found: DataFrame, sessions: DataFrame, max_sessions: int = SESSIONS, per_session: int = MATCHES) -> DataFrame:
    """Matches of the newest sessions: a few each, with the exact number per session.

    ``sessions`` has session, source and started_ms. A page of sessions is
    picked first; it is bounded, so the matches are then filtered by it.
    """
    counts = found.groupBy("session").agg(F.count(F.lit(1)).alias("match_count"))
    newest = counts.join(sessions.select("session", "source", "started_ms"), "session").orderBy(F.col("started_ms").desc_nulls_last(), "session").limit(max_sessions)
    shown = top_rows(found.join(newest.select("session"), "session", "left_semi"), ["session"], [F.col("line"), F.col("thread")], per_session, "position")
    return shown.join(newest, "session")


def to_parents(found: DataFrame, parents: DataFrame) -> DataFrame:
    """Put matches in subagent rollouts down to their parent session, keeping the agent."""
    up = parents.where("parent_session IS NOT NULL")
    moved = found.join(up, "session", "left")
    return moved.select(
        F.coalesce("parent_session", "session").alias("session"), F.when(F.col("parent_session").isNotNull(), F.col("session")).alias("agent"),
        *[c for c in found.columns if c != "session"])
