"""Format B rollouts: envelope lines to one wide record table, usage from cumulative counters, turns, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.nulls import span_ms
from ..functions.ordered import earliest, latest, numbered, running
from ..functions.times import iso_ms, local_day
from ..session import stored
from .files import program_commands
from .pricing import priced

KEYS = ["session", "line"]
COUNTERS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
# Fixed values.
SHELL_CALLS = ["shell", "exec_command"]
WRAPPERS, WRAPPER_FLAGS = ["bash", "sh", "zsh"], ["-lc", "-c"]
NEEDS_QUOTES = r"""[\s'"$`\\!*?\[\]{}();&|<>~#]"""
FAILED_OUTPUT = "(?i)exited with code [1-9]"
COMPACTIONS = ["compaction", "compaction_summary", "context_compaction"]
CALLS = ["function_call", "custom_tool_call", "local_shell_call"]
OUTPUTS = ["function_call_output", "custom_tool_call_output"]


def parsed(raw: DataFrame) -> DataFrame:
    return jsonx.with_parsed(raw.where(F.trim("text") != "")).withColumn("type", jsonx.string_at(F.col("v"), "$.type"))


def warnings(raw: DataFrame) -> DataFrame:
    bad = parsed(raw).where("type IS NULL")
    reason = (
        F.when(F.col("v").isNull(), F.lit("malformed JSON")).when(~jsonx.is_object(F.col("v")), F.lit("not an object")).otherwise(F.lit("missing envelope type")))
    return bad.select(*KEYS, reason.alias("reason"))


def current_files(raw: DataFrame) -> DataFrame:
    """Keep the files whose first record is a session header; older layouts are dropped."""
    first = parsed(raw).groupBy("session").agg(F.min_by("type", "line").alias("__first")).where("__first = 'session_meta'")
    return raw.join(first.select("session"), "session", "left_semi")


def output_text(output: Column) -> Column:
    """A string, the content of an object, or the JSON of anything else."""
    inner = F.when(jsonx.is_object(output), jsonx.string_at(output, "$.content"))
    return F.coalesce(F.when(jsonx.is_string(output), output.cast("string")), inner, F.to_json(output), F.lit(""))


def _strings(v: Column) -> Column:
    """ARRAY<STRING> of an array that holds only strings, else NULL."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(jsonx.is_array(v) & F.forall(items, jsonx.is_string), F.transform(items, lambda x: x.cast("string")))


def joined_command(argv: Column) -> Column:
    """Command line of an argument vector: the inner text of a wrapper shell, else the arguments quoted as needed."""
    wrapped = (F.size(argv) == 3) & F.get(argv, F.lit(0)).isin(*WRAPPERS) & F.get(argv, F.lit(1)).isin(*WRAPPER_FLAGS)
    quoted = F.transform(
        argv,
        lambda a: F.when(a == "", F.lit("''")).when(
            a.rlike(NEEDS_QUOTES), F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(a))
    return F.when(wrapped, F.get(argv, F.lit(2))).otherwise(F.array_join(quoted, " "))


def records(raw: DataFrame) -> DataFrame:
    v, p = F.col("v"), F.col("p")
    base = parsed(raw).where("type IS NOT NULL").withColumns({"p": jsonx.at(v, "$.payload"), "timestamp": jsonx.string_at(v, "$.timestamp")})
    kind = F.when(F.col("type").isin("response_item", "event_msg"), jsonx.string_at(p, "$.type"))
    s = lambda path: jsonx.string_at(p, path)
    n = lambda path: jsonx.long_at(p, path)
    meta, ctx, item, event = (F.col("type") == t for t in ("session_meta", "turn_context", "response_item", "event_msg"))
    spawn = "$.source.subagent.thread_spawn."
    content = F.try_variant_get(jsonx.at(p, "$.content"), "$", "array<variant>")
    texts = F.filter(F.transform(content, lambda b: F.coalesce(jsonx.string_at(b, "$.text"), F.lit(""))), lambda x: x != "")
    summary = F.try_variant_get(jsonx.at(p, "$.summary"), "$", "array<variant>")
    thoughts = F.filter(F.transform(summary, lambda b: jsonx.string_at(b, "$.text")), lambda x: x.isNotNull())
    output = jsonx.at(p, "$.output")
    argv = _strings(jsonx.at(p, "$.command"))
    k = F.col("kind")
    body = (
        F.when(item & (k == "message"), F.array_join(texts, "\n")).when(item & (k == "reasoning"), F.coalesce(F.array_join(thoughts, "\n\n"), F.lit("")))
        .when(event & k.isin("user_message", "agent_message"), s("$.message")).when(event & (k == "thread_name_updated"), s("$.thread_name"))
        .when(item & k.isin(*OUTPUTS), output_text(output))
    )
    query = F.coalesce(s("$.action.query"), F.get(F.try_variant_get(p, "$.action.queries", "array<string>"), F.lit(0)))
    done = event & k.isin("task_complete", "turn_complete", "turn_aborted", "task_aborted")
    count = event & (k == "token_count")
    total = lambda c: F.when(count, n(f"$.info.total_token_usage.{c}"))
    last = lambda c: F.when(count, n(f"$.info.last_token_usage.{c}"))
    return base.withColumn("kind", kind).select(
        *KEYS, "type", "kind", "timestamp", iso_ms(F.col("timestamp")).alias("ts_ms"),
        F.when(meta, s("$.id")).alias("thread_id"), F.when(meta, F.coalesce(s("$.parent_thread_id"), s(spawn + "parent_thread_id"))).alias("parent_thread"),
        F.when(meta, F.coalesce(s("$.agent_nickname"), s(spawn + "agent_nickname"))).alias("nickname"),
        F.when(meta, F.coalesce(s("$.agent_role"), s("$.agent_type"), s(spawn + "agent_role"))).alias("role_name"),
        F.when(meta, n(spawn + "depth")).alias("spawn_depth"), F.when(meta, s("$.forked_from_id")).alias("forked_from"),
        F.when(meta, F.coalesce(jsonx.at(p, "$.source.subagent").isNotNull() & jsonx.is_object(jsonx.at(p, "$.source")), F.lit(False))).alias("is_subagent_source"),
        F.when(meta | ctx, s("$.cwd")).alias("cwd"), F.when(meta, s("$.originator")).alias("originator"), F.when(meta, s("$.cli_version")).alias("cli_version"),
        F.when(meta, s("$.git.repository_url")).alias("repo_url"), F.when(meta, s("$.git.branch")).alias("git_branch"),
        F.when(ctx, s("$.model")).alias("model"), F.coalesce(F.when(ctx, s("$.turn_id")), F.when(event, s("$.turn_id"))).alias("turn_id"),
        F.when(item, s("$.role")).alias("role"), body.alias("text"), F.when(item | event, s("$.call_id")).alias("call_id"),
        F.when(item, s("$.name")).alias("name"), F.when(item & (k == "function_call"), s("$.arguments")).when(item & (k == "custom_tool_call"), s("$.input")).alias("arguments"),
        F.when(item, s("$.status")).alias("status"), F.when(item & (k == "web_search_call"), query).alias("query"),
        F.when(item & k.isin(*OUTPUTS), F.when(jsonx.is_object(output), jsonx.bool_at(output, "$.success"))).alias("success"),
        F.when(event & (k == "exec_command_end"), n("$.exit_code")).alias("exit_code"), F.when(event & (k == "exec_command_end"), joined_command(argv)).alias("command"),
        F.when(done, n("$.duration_ms")).alias("duration_ms"), F.when(event & (k == "collab_agent_spawn_end"), s("$.new_thread_id")).alias("new_thread"),
        F.when(event & (k == "collab_agent_spawn_end"), s("$.new_agent_nickname")).alias("new_nickname"), F.when(event & (k == "collab_agent_spawn_end"), s("$.new_agent_role")).alias("new_role"),
        F.when(count, F.to_json(jsonx.at(p, "$.rate_limits"))).alias("rate_limits"),
        (count & jsonx.is_object(jsonx.at(p, "$.info"))).alias("has_info"), *[total(c).alias(f"total_{c}") for c in COUNTERS], *[last(c).alias(f"last_{c}") for c in COUNTERS],
    )


def with_model(rec: DataFrame, **chunking) -> DataFrame:
    """The model of the last turn context at or before each record."""
    return running(rec.withColumnRenamed("model", "__m"), ["session"], "line", {"model": ("last", F.col("__m"))}, **chunking).drop("__m")


def _fresh() -> Column:
    return F.greatest(F.lit(0), F.col("last_input_tokens") - F.col("last_cached_input_tokens"))


def token_deltas(rec: DataFrame, **chunking) -> DataFrame:
    """Token counts that moved: repeats of an unchanged cumulative total are dropped."""
    counts = rec.where("has_info").select(*KEYS, "ts_ms", *[f"total_{c}" for c in COUNTERS], *[f"last_{c}" for c in COUNTERS])
    total = F.struct(*[f"total_{c}" for c in COUNTERS])
    seen = running(counts, ["session"], "line", {"__prev": ("prev", total)}, **chunking)
    return seen.where(~F.col("__prev").eqNullSafe(total)).drop("__prev").withColumns({
        "fresh_tokens": _fresh(), "context_tokens": F.col("total_total_tokens"),
    })


def usage_and_turns(rec: DataFrame, **chunking) -> tuple[DataFrame, DataFrame]:
    """Moved tokens with the model and turn they count for, and the turns themselves.

    A turn context opens a turn, a completion closes it; a token count that
    moved with no open turn opens one of its own.
    """
    opens = F.col("type") == "turn_context"
    closes = (F.col("type") == "event_msg") & F.col("kind").isin("task_complete", "turn_complete", "turn_aborted", "task_aborted")
    mark = F.when(opens, F.lit("open")).when(closes, F.lit("closed"))
    total = F.struct(*[f"total_{c}" for c in COUNTERS])
    # The records are read once; each pass after that reads the narrow table of the one before.
    marks = stored(rec.where(opens | closes | F.col("has_info")).select(
        *KEYS, "ts_ms", "model", "turn_id", "duration_ms", mark.alias("__mark"), F.when(F.col("has_info"), total).alias("__total"),
        *[f"last_{c}" for c in COUNTERS]), "marks")
    seen = running(marks, ["session"], "line", {"__past": ("past", F.col("__total")), "current_model": ("last", F.col("model"))}, **chunking)
    moves = F.col("__total").isNotNull() & ~F.col("__past").eqNullSafe(F.col("__total"))
    seen = seen.withColumns({
        "__moved": moves, "__state": F.coalesce("__mark", F.when(moves, F.lit("count"))), "total_total_tokens": F.col("__total.total_total_tokens"),
        "fresh_tokens": F.when(moves, _fresh()),
    }).where("__state IS NOT NULL").drop("__past", "__total", "__mark")
    seen = stored(running(stored(seen, "states"), ["session"], "line", {"__before": ("prev", F.col("__state"))}, **chunking), "turn-marks")
    # A count after a close, or first of all, starts a turn; any other belongs to the open one.
    idle = F.col("__before").isNull() | (F.col("__before") == "closed")
    seen = seen.withColumn("__starts", (F.col("__state") == "open") | ((F.col("__state") == "count") & idle))
    placed = stored(running(seen, ["session"], "line", {"turn": ("sum", F.col("__starts").cast("bigint"))}, **chunking), "turns")
    named = F.coalesce("current_model", F.lit("unknown"))
    starts = placed.where("__starts")
    deltas = placed.where("__moved").select(
        *KEYS, "ts_ms", "turn", "fresh_tokens", F.col("last_cached_input_tokens").alias("cached_tokens"), F.col("last_output_tokens").alias("output_tokens"),
        F.col("last_reasoning_output_tokens").alias("reasoning_tokens"), F.col("total_total_tokens").alias("context_tokens"),
    ).join(starts.select("session", "turn", named.alias("model")), ["session", "turn"])
    closed = earliest(placed.where("__state = 'closed' AND turn > 0"), ["session", "turn"], [F.col("line")], ["ts_ms", "duration_ms"]).select(
        "session", "turn", F.col("ts_ms").alias("ended_ms"), "duration_ms")
    sums = deltas.groupBy("session", "turn").agg(
        F.sum("fresh_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cache_read_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens")}
    turns = (
        starts.select("session", "turn", "turn_id", F.nullif(named, F.lit("unknown")).alias("model"), F.col("ts_ms").alias("started_ms"))
        .join(closed, ["session", "turn"], "left").join(sums, ["session", "turn"], "left").withColumns(zero)
        .withColumn("duration_ms", F.coalesce("duration_ms", span_ms(F.col("started_ms"), F.col("ended_ms"))))
    )
    return deltas, turns


def usage_by_model(deltas: DataFrame, pricing: DataFrame) -> DataFrame:
    """Tokens per session and model, priced as one sum at the first time of the model."""
    sums = deltas.groupBy("session", "model").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("fresh_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cache_read_tokens"), F.lit(0).cast("bigint").alias("cache_write_tokens"),
        F.min_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("line"))).alias("ts_ms"))
    return priced(sums, pricing, local_day(F.col("ts_ms")))


def tool_calls(rec: DataFrame) -> DataFrame:
    """Calls with their last output, else their end event; status by flag, text or exit code."""
    item = rec.where("type = 'response_item'")
    outputs = latest(item.where(F.col("kind").isin(*OUTPUTS)), ["session", "call_id"], [F.col("line")], ["line", "ts_ms", "text", "success"]).select(
        "session", "call_id", F.col("line").alias("__ol"), F.col("ts_ms").alias("__ot"), F.col("text").alias("__ox"), F.col("success").alias("__os"))
    ends = latest(rec.where("kind = 'exec_command_end'"), ["session", "call_id"], [F.col("line")], ["line", "ts_ms", "exit_code", "command"]).select(
        "session", "call_id", F.col("line").alias("__el"), F.col("ts_ms").alias("__et"), F.col("exit_code").alias("__code"), F.col("command").alias("__cmd"))
    found, ended = F.col("__ol").isNotNull(), F.col("__el").isNotNull()
    status = (
        F.when(found, F.when((F.col("__os") == F.lit(False)) | F.col("__ox").rlike(FAILED_OUTPUT), F.lit("error")).otherwise(F.lit("ok")))
        .when(ended, F.when(F.col("__code") != 0, F.lit("error")).otherwise(F.lit("ok"))).otherwise(F.lit("missing-result")))
    args = jsonx.parse(F.col("arguments"))
    given = F.coalesce(jsonx.at(args, "$.cmd"), jsonx.at(args, "$.command"))
    program = F.when(F.col("kind") == "custom_tool_call", program_commands(F.col("arguments")))
    command = (
        F.when((F.col("kind") == "function_call") & F.col("name").isin(*SHELL_CALLS),
               F.when(jsonx.is_string(given), given.cast("string")).otherwise(joined_command(_strings(given))))
        .when((F.col("kind") == "custom_tool_call") & (F.size(program) > 0), F.array_join(program, " && "))
        .when(F.col("kind") == "local_shell_call", F.col("__cmd")))
    return (
        item.where(F.col("kind").isin(*CALLS)).join(outputs, ["session", "call_id"], "left").join(ends, ["session", "call_id"], "left")
        .select(
            *KEYS, "ts_ms", "kind", "call_id", F.when(F.col("kind") == "local_shell_call", F.lit("shell")).otherwise(F.col("name")).alias("tool"),
            F.when(F.col("kind") == "local_shell_call", F.lit("")).otherwise(text.args_summary(F.col("arguments"))).alias("input_summary"),
            command.alias("command"), status.alias("status"), F.coalesce("__ol", "__el").alias("result_line"), F.coalesce("__ot", "__et").alias("result_ts_ms"),
            F.coalesce("__ox", F.concat(F.lit("exited with code "), F.col("__code").cast("string"))).alias("result_text"))
    )


def call_counts(rec: DataFrame) -> DataFrame:
    """Distinct calls per session, and those among them with a failed output or end event."""
    known = rec.where((F.col("type") == "response_item") & F.col("kind").isin(*CALLS) & F.col("call_id").isNotNull()).select("session", "call_id").distinct()
    failed = rec.where(
        ((F.col("type") == "response_item") & F.col("kind").isin(*OUTPUTS) & (F.coalesce(F.col("success") == F.lit(False), F.lit(False)) | F.col("text").rlike(FAILED_OUTPUT)))
        | ((F.col("kind") == "exec_command_end") & (F.col("exit_code") != 0))
    ).select("session", "call_id").distinct().withColumn("__failed", F.lit(1))
    return known.join(failed, ["session", "call_id"], "left").groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.count("__failed").alias("errors"))


def extras(rec: DataFrame, deltas: DataFrame) -> DataFrame:
    """Header fields, latest rate limits, reasoning tokens of the counts that moved (``token_deltas``) and spawn counts per session."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("line"))
    first = F.min_by(F.struct("parent_thread", "forked_from", "role_name", "nickname", "spawn_depth", "is_subagent_source", "cwd", "repo_url", "git_branch"), F.when(F.col("type") == "session_meta", F.col("line")))
    head = rec.groupBy("session").agg(
        first.alias("m"), F.max_by("rate_limits", known("rate_limits")).alias("rate_limits"), F.count("new_thread").alias("spawned"),
        F.max_by("text", F.when(F.col("kind") == "thread_name_updated", F.col("line"))).alias("title"),
        F.min_by("ts_ms", known("ts_ms")).alias("first_ts_ms"), F.max_by("ts_ms", known("ts_ms")).alias("last_ts_ms"))
    reasoning = deltas.groupBy("session").agg(F.sum("last_reasoning_output_tokens").alias("reasoning_tokens"))
    return head.join(reasoning, "session", "left").select(
        "session", "m.*", "rate_limits", "spawned", "title", "first_ts_ms", "last_ts_ms", F.coalesce("reasoning_tokens", F.lit(0)).alias("reasoning_tokens"),
        (F.coalesce(F.col("m.is_subagent_source"), F.lit(False)) | F.col("m.parent_thread").isNotNull()).alias("is_subagent"))


def spawned_threads(rec: DataFrame) -> DataFrame:
    """Threads that a session started, in line order by ``nth``: id, name, role, call and time of each."""
    spawned = rec.where("new_thread IS NOT NULL").select(
        *KEYS, "ts_ms", F.col("new_thread").alias("agent"), F.col("new_nickname").alias("nickname"), F.col("new_role").alias("role"), "call_id")
    return numbered(spawned, ["session"], "line", "nth")


def prompts(rec: DataFrame) -> DataFrame:
    """User messages: events where the file has any, else typed response items that the harness did not inject."""
    events = rec.where("kind = 'user_message' AND type = 'event_msg'").select(*KEYS, "ts_ms", "text")
    items = rec.where("type = 'response_item' AND kind = 'message' AND role = 'user' AND text <> ''").where(~text.is_injected(F.col("text")))
    fallback = items.select(*KEYS, "ts_ms", "text").join(events.select("session").distinct(), "session", "left_anti")
    return events.where("text IS NOT NULL AND text <> ''").unionByName(fallback)


def parent_of(raw: DataFrame) -> DataFrame:
    """Parent of a subagent rollout, read from its first line only."""
    first = parsed(raw.where("line = 1")).where("type = 'session_meta'")
    p = jsonx.at(F.col("v"), "$.payload")
    parent = F.coalesce(jsonx.string_at(p, "$.parent_thread_id"), jsonx.string_at(p, "$.source.subagent.thread_spawn.parent_thread_id"))
    return first.select("session", parent.alias("parent_session"))
