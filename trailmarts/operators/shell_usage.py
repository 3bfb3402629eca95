"""Shell commands: parsing, totals, groups, repeats, reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shell, text
from ..functions.nulls import exact_usd, share_pct, usd_share_pct
from ..functions.ordered import numbered, top_rows

LARGE_RESULT_CHARS = 20_000
MIN_REPEATS = 3
LOOKAHEAD = 3
SAMPLES = 3
TOP_CALLS = 10
MAIN = "main"


def call_order() -> list[Column]:
    """Main thread first, then the subagents by name, each in line order."""
    return [F.col("thread") != MAIN, F.col("thread"), F.col("line")]


def parsed_commands(calls: DataFrame) -> DataFrame:
    """Add program family, subcommand, shape, segment programs and the read-a-file flag to shell calls."""
    segs = calls.withColumn("__segs", shell.segments(F.col("command")))
    return (
        segs.withColumn("__primary", shell.primary(F.col("__segs")))
        .withColumns({
            "family": F.coalesce(F.col("__primary")["program"], F.lit(shell.UNPARSED)),
            "subcommand": F.col("__primary")["subcommand"],
            "reads_file": (F.size("__segs") == 1) & F.coalesce(F.get("__segs", F.lit(0))["reads_file"], F.lit(False)),
            "programs": F.filter(F.transform("__segs", lambda s: s["program"]), lambda p: p.isNotNull()),
            "shape": shell.shape(F.col("command")),
            "input_chars": F.length("command").cast("bigint"),
        })
        .drop("__segs", "__primary")
    )


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if("is_error").alias("errors"),
        F.sum("input_chars").alias("input_chars"),
        F.sum("result_chars").alias("result_chars"),
        text.approx_tokens(F.sum(F.col("input_chars") + F.col("result_chars"))).alias("estimated_tokens"),
        F.sum("est_usd").alias("est_usd"),
    ]


def totals(priced: DataFrame, keys=("session",)) -> DataFrame:
    return priced.groupBy(*keys).agg(*_sums())


def _with_totals(groups: DataFrame, all_totals: DataFrame) -> DataFrame:
    whole = all_totals.select("session", F.col("result_chars").alias("__chars"), F.col("est_usd").alias("__usd"))
    return groups.join(whole, "session")


def by_command(priced: DataFrame) -> DataFrame:
    """Per (family, subcommand): sums, share of result characters, share on the main thread."""
    main_chars = F.sum(F.when(F.col("thread") == MAIN, F.col("result_chars")).otherwise(0)).alias("__main")
    groups = priced.groupBy("session", "family", "subcommand").agg(*_sums(), main_chars)
    return _with_totals(groups, totals(priced)).select(
        "session", "family", "subcommand", "calls", "errors", "input_chars", "result_chars", "estimated_tokens", "est_usd",
        share_pct(F.col("result_chars"), F.col("__chars")).alias("share_pct"),
        share_pct(F.col("__main"), F.col("result_chars")).alias("main_share_pct"),
    )


def sample_commands(commands: DataFrame) -> DataFrame:
    """The first three distinct commands of each (family, subcommand)."""
    seen = commands.groupBy("session", "family", "subcommand", "command").agg(F.min(F.struct(*call_order())).alias("at"))
    first = top_rows(seen, ["session", "family", "subcommand"], [F.col("at")], SAMPLES)
    return first.select("session", "family", "subcommand", "rank", "command")


def by_thread(priced: DataFrame) -> DataFrame:
    usd = exact_usd(F.col("est_usd"))
    groups = priced.groupBy("session", "thread").agg(*_sums(), F.min("model").alias("model"), usd.alias("__part"))
    whole = priced.groupBy("session").agg(F.sum("result_chars").alias("__chars"), usd.alias("__usd"))
    return groups.join(whole, "session").select(
        "session", "thread", "model", "calls", "errors", "input_chars", "result_chars", "estimated_tokens", "est_usd",
        share_pct(F.col("result_chars"), F.col("__chars")).alias("chars_share_pct"),
        usd_share_pct(F.col("__part"), F.col("__usd")).alias("usd_share_pct"),
    )


def program_counts(commands: DataFrame) -> DataFrame:
    return commands.select("session", F.explode("programs").alias("program")).groupBy("session", "program").agg(
        F.count(F.lit(1)).alias("count")
    )


def near_duplicates(commands: DataFrame) -> DataFrame:
    groups = commands.groupBy("session", "shape").agg(
        F.count(F.lit(1)).alias("count"), F.sum("result_chars").alias("result_chars")
    )
    return groups.where(F.col("count") >= MIN_REPEATS)


def large_results(priced: DataFrame) -> DataFrame:
    return priced.where(F.col("result_chars") >= LARGE_RESULT_CHARS).select(
        "session", "thread", "line", "command", "result_chars", "est_usd"
    )


def file_dumps(priced: DataFrame) -> DataFrame:
    """Shell calls that only print a file."""
    return priced.where("reads_file")


def heavy_hitters(priced: DataFrame) -> DataFrame:
    order = [F.col("result_chars").desc(), F.col("thread"), F.col("line")]
    return top_rows(priced, ["session"], order, TOP_CALLS)


def reruns_after_error(commands: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Each failed command and the first call of the same shape among the next three of its thread."""
    extra = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    seq = numbered(commands, ["session", "thread"], "line", **extra)
    ahead = F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + LOOKAHEAD)).alias("next_seq")
    failed = seq.where("is_error").select(
        "session", "thread", "shape", F.col("line").alias("error_line"), F.col("seq").alias("error_seq"), ahead
    )
    later = seq.select(
        "session", "thread", "shape", F.col("seq").alias("next_seq"), F.col("line").alias("rerun_line"),
        "result_chars", *[c for c in ("raw_usd", "est_usd") if c in commands.columns],
    )
    hits = failed.join(later, ["session", "thread", "shape", "next_seq"])
    names = [c for c in later.columns if c not in ("session", "thread", "shape", "next_seq")]
    return (
        hits.groupBy("session", "thread", "shape", "error_line")
        .agg(F.min_by(F.struct(*names), "next_seq").alias("r"))
        .select("session", "thread", "shape", "error_line", "r.*")
    )
