"""Tool calls: results, statistics, repeats, exploration, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonx, repo, text
from ..functions.nulls import exact_usd, known_share_pct, ratio_or_null, share_pct, span_ms, usd_share_pct
from ..functions.ordered import earliest, running, top_rows

MAIN = "main"
REREAD_MIN = 4
FAILURE_MIN = 2
RUN_MIN = 2
TOP_CALLS = 10
RANKING_ROWS = 8
REST = "rest"
CALL_PAGE = 50
# Tools that read or edit.
READ_TOOLS = ["Read", "Grep", "Glob", "LS", "NotebookRead"]
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
FILE_READ_TOOLS = ["Read", "NotebookRead"]
ORCHESTRATION_TOOLS = ["Agent", "Task"]


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their first result, which may lie before the call."""
    first = earliest(
        results, ["session", "thread", "call_id"], [F.col("result_line"), F.col("result_block")],
        ["result_line", "result_ts_ms", "is_error", "result_text", "result_chars"],
    ).withColumn("has_result", F.lit(True))
    return calls.join(first, ["session", "thread", "call_id"], "left").withColumns({
        "has_result": F.coalesce("has_result", F.lit(False)),
        "result_chars": F.coalesce("result_chars", F.lit(0)),
    })


def with_status(calls: DataFrame) -> DataFrame:
    status = (
        F.when(~F.col("has_result"), F.lit("missing-result"))
        .when(F.col("is_error"), F.lit("error"))
        .otherwise(F.lit("ok"))
    )
    return calls.withColumns({
        "status": status, "duration_ms": span_ms(F.col("ts_ms"), F.col("result_ts_ms")),
        "error_class": F.when(F.col("is_error"), text.error_class(F.col("result_text"))),
    })


def tool_stats(calls: DataFrame, keys=("session",)) -> DataFrame:
    return calls.groupBy(*keys, "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"),
        F.count_if(~F.col("has_result")).alias("missing_results"),
    )


def error_classes(calls: DataFrame, keys=("session",)) -> DataFrame:
    failed = calls.where("is_error").withColumn("error_class", text.error_class(F.col("result_text")))
    return failed.groupBy(*keys, "tool", "error_class").agg(F.count(F.lit(1)).alias("errors"))


def error_matrix(calls: DataFrame) -> DataFrame:
    """Errors by tool and class, one column per class, with a total row and column."""
    names = [c for c, _ in text.ERROR_CLASSES] + ["other"]
    failed = error_classes(calls, ())
    cells = [F.coalesce(F.sum(F.when(F.col("error_class") == n, F.col("errors"))), F.lit(0)).alias(n.replace("-", "_")) for n in names]
    return failed.rollup("tool").agg(*cells, F.sum("errors").alias("total")).withColumn("tool", F.coalesce("tool", F.lit("(all)")))


def identical_runs(calls: DataFrame, **chunking) -> DataFrame:
    """Runs of two or more consecutive calls with the same tool and input."""
    keys = ["session", "thread"]
    same = F.struct("tool", "input")
    seen = running(calls, keys, "line", {"__prev": ("prev", same)}, **chunking)
    starts = F.when(F.col("__prev").eqNullSafe(same), 0).otherwise(1).cast("bigint")
    islands = running(seen, keys, "line", {"run": ("sum", starts)}, **chunking)
    return (
        islands.groupBy(*keys, "run", "tool", "input")
        .agg(F.count(F.lit(1)).alias("count"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
        .where(F.col("count") >= RUN_MIN)
        .withColumn("subject", text.call_subject(F.col("input")))
        .drop("input", "run")
    )


def with_path(calls: DataFrame) -> DataFrame:
    return calls.withColumn("path", jsonx.string_at(jsonx.parse(F.col("input")), "$.file_path"))


def rereads(calls: DataFrame) -> DataFrame:
    """Files read four times or more by one thread."""
    reads = with_path(calls.where("tool = 'Read'")).where("path IS NOT NULL")
    return reads.groupBy("session", "thread", "path").agg(
        F.count(F.lit(1)).alias("count"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    ).where(F.col("count") >= REREAD_MIN)


def reread_lines(calls: DataFrame) -> DataFrame:
    """The lines behind ``rereads``, one row each."""
    reads = with_path(calls.where("tool = 'Read'")).where("path IS NOT NULL")
    return reads.join(rereads(calls).select("session", "thread", "path"), ["session", "thread", "path"], "left_semi").select(
        "session", "thread", "path", "line"
    )


def repeated_failures(calls: DataFrame) -> DataFrame:
    return (
        calls.where("is_error").groupBy("session", "thread", "tool", "input")
        .agg(F.count(F.lit(1)).alias("count"), F.min("line").alias("first_line"))
        .where(F.col("count") >= FAILURE_MIN)
        .withColumn("subject", text.call_subject(F.col("input"))).drop("input")
    )


def exploration(calls: DataFrame, prompts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Reads against edits of the main thread, and how long until the first edit."""
    main = with_path(calls.where(F.col("thread") == MAIN))
    reads, edits = F.col("tool").isin(*READ_TOOLS), F.col("tool").isin(*EDIT_TOOLS)
    per_path = main.groupBy("session", "path").agg(
        F.count_if(reads).alias("r"), F.count_if(edits).alias("e"), F.count_if(F.col("tool") == "Read").alias("files_read"),
        F.min_by(F.struct("line", "ts_ms"), F.when(edits, F.col("line"))).alias("first_edit"),
    )
    named = F.col("path").isNotNull()
    profile = per_path.groupBy("session").agg(
        F.sum("r").alias("read_calls"), F.sum("e").alias("edit_calls"),
        F.count_if(named & (F.col("files_read") > 0)).alias("files_read"),
        F.count_if(named & (F.col("e") > 0)).alias("files_edited"),
        F.min("first_edit").alias("first_edit"),
    )
    edits_at = profile.where("first_edit IS NOT NULL").select("session", F.col("first_edit.line").alias("__line"))
    turn = (
        prompts.select("session", "line").join(edits_at, "session").where(F.col("line") <= F.col("__line"))
        .groupBy("session").agg(F.count(F.lit(1)).alias("first_edit_turn"))
    )
    return (
        profile.join(turn, "session", "left").join(sessions.select("session", "first_ts_ms"), "session", "left")
        .select(
            "session", "read_calls", "edit_calls", ratio_or_null(F.col("read_calls"), F.col("edit_calls")).alias("read_edit_ratio"),
            "files_read", "files_edited", "first_edit_turn",
            span_ms(F.col("first_ts_ms"), F.col("first_edit.ts_ms")).alias("time_to_first_edit_ms"),
        )
    )


def _sums():
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("errors"), F.sum("result_chars").alias("result_chars"),
        text.approx_tokens(F.sum("result_chars")).alias("estimated_tokens"), F.sum("est_usd").alias("est_usd"),
    ]


def usage_totals(priced: DataFrame) -> DataFrame:
    return priced.groupBy("session").agg(*_sums())


def usage_by_tool(priced: DataFrame) -> DataFrame:
    main_chars = F.sum(F.when(F.col("thread") == MAIN, F.col("result_chars")).otherwise(0)).alias("__main")
    groups = priced.groupBy("session", "tool").agg(*_sums(), main_chars)
    whole = Window.partitionBy("session")
    return groups.withColumn("__chars", F.sum("result_chars").over(whole)).select(
        "session", "tool", "calls", "errors", "result_chars", "estimated_tokens", "est_usd",
        share_pct(F.col("result_chars"), F.col("__chars")).alias("share_pct"),
        share_pct(F.col("__main"), F.col("result_chars")).alias("main_share_pct"),
    )


def usage_by_thread(priced: DataFrame) -> DataFrame:
    usd = exact_usd(F.col("est_usd"))
    groups = priced.groupBy("session", "thread").agg(*_sums(), F.min("model").alias("model"), usd.alias("__part"))
    whole = priced.groupBy("session").agg(F.sum("result_chars").alias("__chars"), usd.alias("__usd"))
    return groups.join(whole, "session").select(
        "session", "thread", "model", "calls", "errors", "result_chars", "estimated_tokens", "est_usd",
        share_pct(F.col("result_chars"), F.col("__chars")).alias("chars_share_pct"),
        usd_share_pct(F.col("__part"), F.col("__usd")).alias("usd_share_pct"),
    )


def heavy_hitters(priced: DataFrame) -> DataFrame:
    order = [F.col("result_chars").desc(), F.col("thread"), F.col("line")]
    return top_rows(priced, ["session"], order, TOP_CALLS).select(
        "session", "rank", "tool", "thread", "line", "call_id", "result_chars", "est_usd"
    )


def source_split(by_tool: DataFrame) -> DataFrame:
    """Built-in tools against MCP tools."""
    server = repo.mcp_server(F.col("tool"))
    return (
        by_tool.withColumns({"is_mcp": F.col("tool").startswith("mcp__"), "server": server})
        .groupBy("session", "is_mcp")
        .agg(
            F.count(F.lit(1)).alias("tools"), F.count_distinct(F.nullif("server", F.lit(""))).alias("servers"),
            F.sum("calls").alias("calls"), F.sum("result_chars").alias("result_chars"), F.sum("est_usd").alias("est_usd"),
        )
    )


def ranking(by_tool: DataFrame) -> DataFrame:
    """The eight costliest tools of a session, the rest as one row, and a total row."""
    order = [F.coalesce("est_usd", F.lit(-1.0)).desc(), F.col("result_chars").desc(), F.col("tool")]
    place = F.row_number().over(Window.partitionBy("session").orderBy(*order))
    ranked = by_tool.withColumn("__place", place).withColumns({
        "place": F.when(F.col("__place") <= RANKING_ROWS, F.col("__place")).otherwise(RANKING_ROWS + 1),
        "name": F.when(F.col("__place") <= RANKING_ROWS, F.col("tool")).otherwise(F.lit(REST)),
    })
    sums = [
        F.count(F.lit(1)).alias("tools"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"),
        F.sum("result_chars").alias("result_chars"), F.sum("est_usd").alias("est_usd"),
    ]
    rows = ranked.groupBy("session", "place", "name").agg(*sums)
    total = by_tool.groupBy("session").agg(*sums).withColumns({"place": F.lit(0), "name": F.lit("total")})
    return rows.unionByName(total)


def decisions(by_tool: DataFrame, priced: DataFrame) -> DataFrame:
    """Four facts per session: where the cost, the errors and the largest result sit, and the main thread's share."""
    per = by_tool.groupBy("session").agg(
        F.min_by(F.struct("tool", "est_usd"), F.when(F.col("est_usd").isNotNull(), F.struct(-F.col("est_usd"), F.col("tool")))).alias("cost"),
        exact_usd(F.col("est_usd")).alias("__usd"),
        F.min_by(F.struct("tool", "errors"), F.when(F.col("errors") > 0, F.struct(-F.col("errors"), F.col("tool")))).alias("err"),
        F.sum("errors").alias("errors"),
    )
    calls = priced.groupBy("session").agg(
        F.min_by(F.struct("tool", "result_chars"), F.struct(-F.col("result_chars"), F.col("thread"), F.col("line"))).alias("big"),
        F.sum("result_chars").alias("__chars"),
        F.sum(F.when(F.col("thread") == MAIN, F.col("result_chars")).otherwise(0)).alias("__main"),
    )
    return per.join(calls, "session").select(
        "session", F.col("cost.tool").alias("top_cost_tool"), usd_share_pct(F.col("cost.est_usd").try_cast("decimal(28,12)"), F.col("__usd")).alias("top_cost_pct"),
        F.col("err.tool").alias("top_error_tool"), known_share_pct(F.col("err.errors"), F.col("errors")).alias("top_error_pct"),
        F.col("big.tool").alias("largest_tool"), F.col("big.result_chars").alias("largest_chars"),
        share_pct(F.col("__main"), F.col("__chars")).alias("main_share_pct"),
    )


def call_page(calls: DataFrame, tool: str | None = None, thread: str | None = None, limit: int | None = CALL_PAGE) -> DataFrame:
    """First calls of each session by line then thread, with the number of calls that match."""
    hits = calls
    if tool is not None:
        hits = hits.where(F.col("tool") == tool)
    if thread is not None:
        hits = hits.where(F.col("thread") == thread)
    counts = hits.groupBy("session").agg(F.count(F.lit(1)).alias("total"))
    page = top_rows(hits, ["session"], [F.col("line"), F.col("thread")], limit, "position")
    return page.join(counts, "session").select("session", "position", "line", "thread", "tool", "call_id", "total")
