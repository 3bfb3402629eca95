"""File access: reads, edits and injected documents per path, and directory totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import repo
from ..functions.ordered import top_rows
from . import tools

# Headers of injected documents and patches.
CONTENTS_HEADER = r"(?m)^Contents of (/.+?) \([^)]*\):$"
PATCH_HEADER = r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+?)\s*$"
EMBEDDED_PATCH_HEADER = "\\*\\*\\* (?:Update|Add|Delete) File: ([^\\\\\n\"'`]+)"
AGENTS_HEADER = "# AGENTS.md instructions for "
PROJECT_DOC = "\n\n--- project-doc ---\n\n"
EXEC_COMMAND = (
    r"""(?s)tools\.exec_command\(\s*\{[^{}]*?\bcmd["']?\s*:\s*(?:"((?:[^"\\]|\\.)*+)"|'((?:[^'\\]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)"""
)
READ_PROGRAMS = ["cat", "head", "tail", "less", "more", "rg", "grep", "awk", "wc", "stat", "nl", "sed"]
OPERATORS = ["&&", "||", ";", "|", "&"]


def injected_documents(texts: DataFrame) -> DataFrame:
    """Paths announced by ``Contents of … (…):`` headers with the length of the text up to the next header."""
    pieces = F.split("text", CONTENTS_HEADER)
    paths = F.regexp_extract_all("text", F.lit(CONTENTS_HEADER), F.lit(1))
    pairs = F.transform(
        paths, lambda p, i: F.struct(p.alias("path"), F.length(F.get(pieces, i + 1)).cast("bigint").alias("chars"))
    )
    return (
        texts.where(F.col("text").contains("Contents of /"))
        .select("session", "thread", "line", "ts_ms", F.explode(pairs).alias("d"))
        .select("session", "thread", "line", "ts_ms", "d.*")
    )


def agents_documents(texts: DataFrame) -> DataFrame:
    """The directory-wide instruction message with the lengths of its user and project halves."""
    t = F.regexp_replace("text", r"^\s+", "")
    head = F.trim(F.regexp_extract(t, f"^{AGENTS_HEADER}([^\n]+)", 1))
    body = F.when(F.instr(t, "\n") > 0, F.regexp_replace(F.substr(t, F.instr(t, "\n") + 1), r"^\s+|\s+$", "")).otherwise(F.lit(""))
    found = texts.withColumns({"__head": head, "__body": body}).where("__head <> ''")
    at = F.instr("__body", PROJECT_DOC)
    cut = F.regexp_replace("__head", "/+$", "")
    return found.select(
        "session", "thread", "line", "ts_ms", F.when(cut == "", F.lit("/")).otherwise(cut).alias("path"),
        F.length("__body").cast("bigint").alias("chars"),
        F.when(at > 0, at - 1).cast("bigint").alias("user_chars"),
        F.when(at > 0, F.length("__body") - at + 1 - len(PROJECT_DOC)).cast("bigint").alias("project_chars"),
    )


def patch_paths(patch_text):
    """Files touched by a patch text, as an array."""
    return F.regexp_extract_all(patch_text, F.lit(PATCH_HEADER), F.lit(1))


def program_commands(source):
    """Commands of the ``tools.exec_command({… cmd: "…" })`` calls in a program text."""
    whole = F.regexp_extract_all(source, F.lit(EXEC_COMMAND), F.lit(0))
    pick = lambda m: F.concat(*[F.regexp_extract(m, EXEC_COMMAND, g) for g in (1, 2, 3)])
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"\\(.)", "$1")
    return F.transform(whole, lambda m: plain(pick(m)))


def program_patch_paths(source):
    return F.transform(F.regexp_extract_all(source, F.lit(EMBEDDED_PATCH_HEADER), F.lit(1)), lambda p: F.rtrim(p))


def _path_like(token):
    return (
        (token != "") & ~token.startswith("-") & ~token.rlike(r"""['"`{}()\[\]*?$\\!]|://""") & ~token.contains("...")
        & (token.contains("/") | token.rlike(r"\.[A-Za-z0-9]{1,10}$"))
    )


def read_paths(command, cwd):
    """Path-like arguments of reading programs in a command, redirect targets left out."""
    tokens = F.filter(F.split(command, r"\s+"), lambda x: x != "")
    marked = F.array_join(F.transform(tokens, lambda x: F.when(x.isin(*OPERATORS), F.lit("\u0002")).otherwise(x)), "\u0001")
    parts = F.transform(
        F.split(marked, "\u0002"), lambda s: F.filter(F.split(s, "\u0001"), lambda x: x != "")
    )

    def of_part(ws):
        name = F.get(ws, F.lit(0))
        here = F.array_position(F.transform(ws, lambda x: x.startswith("<<")), F.lit(True))
        body = F.when(here > 0, F.slice(ws, F.lit(1), (here - 1).cast("int"))).otherwise(ws)
        keep = F.transform(
            body,
            lambda x, i: F.when(
                (i == 0) | x.contains(">") | (x == "<") | F.get(body, i - 1).isin(">", ">>"), F.lit(None).cast("string")
            ).otherwise(F.regexp_replace(x, ";+$", "")),
        )
        paths = F.filter(keep, lambda x: x.isNotNull() & _path_like(x))
        reads = name.isin(*READ_PROGRAMS) & ((name != "sed") | F.array_contains(ws, "-n"))
        return F.when(reads, paths).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(parts, of_part))
    base = F.regexp_replace(cwd, "/$", "")
    return F.transform(
        found,
        lambda p: F.when(p.startswith("/") | p.startswith("~") | cwd.isNull(), p).otherwise(F.concat(base, F.lit("/"), p)),
    )


def call_touches(calls: DataFrame) -> DataFrame:
    """Reads and edits of named files as touches."""
    reads, edits = F.col("tool").isin(*tools.FILE_READ_TOOLS), F.col("tool").isin(*tools.EDIT_TOOLS)
    return (
        tools.with_path(calls.where(reads | edits)).where("path IS NOT NULL")
        .select(
            "session", "thread", "line", "ts_ms", "path", reads.cast("bigint").alias("reads"), edits.cast("bigint").alias("edits"),
            F.lit(0).cast("bigint").alias("injections"), F.lit(0).cast("bigint").alias("injected_chars"),
        )
    )


def injection_touches(documents: DataFrame) -> DataFrame:
    return documents.select(
        "session", "thread", "line", "ts_ms", "path", F.lit(0).cast("bigint").alias("reads"), F.lit(0).cast("bigint").alias("edits"),
        F.lit(1).cast("bigint").alias("injections"), F.col("chars").alias("injected_chars"),
    )


def _named(rows: DataFrame, paths, kind: str) -> DataFrame:
    """One touch per path of an array, a read or an edit."""
    one = {c: F.lit(int(c == kind)).cast("bigint") for c in ("reads", "edits", "injections")}
    return rows.select("session", "thread", "line", "ts_ms", F.explode(paths).alias("path"), *(v.alias(c) for c, v in one.items()), F.lit(0).cast("bigint").alias("injected_chars"))


def command_touches(commands: DataFrame) -> DataFrame:
    """Files read by shell commands of format B (session, thread, line, ts_ms, command, cwd)."""
    return _named(commands, read_paths(F.col("command"), F.col("cwd")), "reads")


def patch_touches(patches: DataFrame) -> DataFrame:
    """Files changed by patches of format B (session, thread, line, ts_ms, patch)."""
    return _named(patches, patch_paths(F.col("patch")), "edits")


def all_touches(calls: DataFrame, documents: DataFrame, commands: DataFrame, patches: DataFrame) -> DataFrame:
    """Touches of every source: file tools, injected documents and skill bodies, commands and patches of format B."""
    return call_touches(calls).unionByName(injection_touches(documents)).unionByName(command_touches(commands)).unionByName(patch_touches(patches))


def file_access(touches: DataFrame) -> DataFrame:
    """Reads, edits, injections and the earliest touch per session and path over all threads."""
    main = F.col("thread") == tools.MAIN
    return touches.groupBy("session", "path").agg(
        F.sum("reads").alias("reads"), F.sum("edits").alias("edits"), F.sum("injections").alias("injections"),
        F.sum("injected_chars").alias("injected_chars"), F.min("ts_ms").alias("first_ts_ms"),
        F.min(F.when(main, F.col("line"))).alias("first_main_line"),
        F.when(F.bool_or(main) & F.bool_or(~main), F.lit("both")).when(F.bool_or(main), F.lit("main")).otherwise(F.lit("subagent")).alias("threads"),
    )


def capped_access(access: DataFrame, cap: int | None = None) -> DataFrame:
    """The paths of each session by use; with ``cap`` the first ones and the number left out."""
    score = F.col("reads") + F.col("edits") + F.col("injections")
    kept = top_rows(access, ["session"], [score.desc(), F.col("path")], cap)
    omitted = access.groupBy("session").agg(F.lit(0).cast("bigint").alias("omitted") if cap is None else F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("omitted"))
    return kept.join(omitted, "session")


def directory_totals(access: DataFrame) -> DataFrame:
    """Reads and edits per directory; a directory whose only content is one directory is folded into it.

    ``label`` is the path below the nearest directory that is itself listed.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    dirs = access.withColumn("__p", parts).where(F.size("__p") > 1).select(
        "session", "reads", "edits", "__p", F.explode(F.sequence(F.lit(1), F.size("__p") - 1)).alias("depth")
    )
    rows = dirs.select(
        "session", "reads", "edits", "depth", F.array_join(F.slice("__p", F.lit(1), F.col("depth")), "/").alias("dir"),
        (F.col("depth") == F.size("__p") - 1).alias("is_parent"), F.get("__p", F.col("depth")).alias("child"),
    )
    # One row per (directory, child) first, so that a directory full of files combines before it shuffles.
    per_child = rows.groupBy("session", "dir", "depth", "is_parent", "child").agg(F.sum("reads").alias("reads"), F.sum("edits").alias("edits"))
    totals = per_child.groupBy("session", "dir", "depth").agg(
        F.sum("reads").alias("reads"), F.sum("edits").alias("edits"),
        F.count_if("is_parent").alias("files"), F.count_if(~F.col("is_parent")).alias("dirs"),
    )
    listed = totals.where(~((F.col("files") == 0) & (F.col("dirs") == 1)))
    above = listed.select("session", "dir", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("up")).where("up < size(split(dir, '/'))")
    above = above.withColumn("ancestor", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("up")), "/"))
    nearest = (
        above.join(listed.select("session", F.col("dir").alias("ancestor")), ["session", "ancestor"])
        .groupBy("session", "dir").agg(F.max("up").alias("up"))
    )
    return listed.join(nearest, ["session", "dir"], "left").select(
        "session", "dir", "reads", "edits", "files", "dirs",
        F.array_join(F.slice(F.split("dir", "/"), F.coalesce("up", F.lit(0)) + 1, F.col("depth")), "/").alias("label"),
    )


def scoped(access: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``scope``: repo, home or system, by the session's working directory."""
    return access.join(sessions.select("session", "cwd"), "session", "left").withColumn(
        "scope", repo.file_scope(F.col("path"), F.col("cwd"))
    )
