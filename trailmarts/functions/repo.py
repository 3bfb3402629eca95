"""Repository identity of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Session sources, key prefixes and worktree markers.
SOURCE_A = "claude-code"
SOURCE_B = "codex"
PROJECT_PREFIX = "claude-project:"
URL_PREFIX = "codex-repo:"
CWD_PREFIX = "codex-cwd:"
UNKNOWN_CWD = "(unknown cwd)"
WORKTREES_A = "/.claude/worktrees/"
WORKTREES_B = "/.codex/worktrees/"


def _trimmed(cwd: Column) -> Column:
    cut = F.regexp_replace(cwd, "/+$", "")
    return F.when(cut == "", cwd).otherwise(cut)


def identity(cwd: Column) -> Column:
    """``struct<repo_root, worktree>`` of a working directory."""
    path = _trimmed(cwd)
    no_text = F.lit(None).cast("string")
    rest_b = F.substr(path, F.instr(path, WORKTREES_B) + len(WORKTREES_B))
    hash_b = F.substring_index(rest_b, "/", 1)
    checkout_b = F.get(F.split(rest_b, "/"), F.lit(1))
    in_b = path.contains(WORKTREES_B)
    known_b = (hash_b != "") & (F.coalesce(checkout_b, F.lit("")) != "")
    at_a = F.instr(path, WORKTREES_A)
    name_a = F.substring_index(F.substr(path, at_a + len(WORKTREES_A)), "/", 1)
    in_a = (at_a > 0) & (name_a != "")
    root = (
        F.when(cwd.isNull() | (cwd == ""), no_text)
        .when(in_b, F.when(known_b, no_text).otherwise(path))
        .when(in_a, F.substr(path, F.lit(1), at_a - 1))
        .otherwise(path)
    )
    tree = (
        F.when(cwd.isNull() | (cwd == ""), no_text)
        .when(in_b, F.when(known_b, hash_b))
        .when(in_a, name_a)
    )
    return F.struct(root.alias("repo_root"), tree.alias("worktree"))


def plain_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")


def repo_key(source: Column, repo_root: Column, project_dir: Column, repo_url: Column, cwd: Column) -> Column:
    return F.coalesce(
        repo_root,
        F.when(source != SOURCE_B, F.concat(F.lit(PROJECT_PREFIX), F.coalesce(project_dir, F.lit("")))),
        F.concat(F.lit(URL_PREFIX), repo_url),
        F.concat(F.lit(CWD_PREFIX), F.coalesce(cwd, F.lit(UNKNOWN_CWD))),
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def is_full_key(name: Column) -> Column:
    return F.lit(False) | name.startswith("/") | name.startswith(PROJECT_PREFIX) | name.startswith(URL_PREFIX) | name.startswith(CWD_PREFIX)


def resolve_name(roots: DataFrame, names: DataFrame) -> DataFrame:
    """Map bare repository names to roots by last path part; full keys stand for themselves.

    One row per name: ``repo`` when exactly one root matches, otherwise NULL,
    with the candidates in order and their number.
    """
    by_name = (
        roots.select("repo_root").distinct()
        .withColumn("name", basename(F.col("repo_root")))
    )
    hits = names.select("name").distinct().join(by_name, "name", "left")
    return hits.groupBy("name").agg(
        F.count("repo_root").alias("candidates"),
        F.when(is_full_key(F.col("name")), F.col("name")).otherwise(F.when(F.count("repo_root") == 1, F.min("repo_root"))).alias("repo"),
        F.sort_array(F.collect_list("repo_root")).alias("roots"),
    )


def path_labels(paths: DataFrame, column: str = "path") -> DataFrame:
    """The shortest tail of each path that no other path shares, else the path."""
    parts = F.filter(F.split(F.col(column), "/"), lambda p: p != "")
    base = paths.select(column).distinct().withColumn("__parts", parts)
    depth = F.explode(F.sequence(F.lit(1), F.greatest(F.size("__parts"), F.lit(1)))).alias("depth")
    tails = base.select(column, "__parts", depth).withColumn(
        "tail", F.array_join(F.slice("__parts", F.size("__parts") - F.least(F.col("depth"), F.size("__parts")) + 1, F.col("depth")), "/")
    ).drop("__parts")
    unique = tails.groupBy("tail", "depth").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias(column)).where("n = 1")
    best = unique.groupBy(column).agg(F.min_by("tail", "depth").alias("label"))
    whole = F.coalesce(F.nullif(F.array_join("__parts", "/"), F.lit("")), F.col(column))
    return base.join(best, column, "left").select(column, F.coalesce("label", whole).alias("label"))


def _under(path: Column, folder: Column) -> Column:
    prefix = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.coalesce((path == folder) | path.startswith(prefix), F.lit(False))


def file_scope(path: Column, cwd: Column) -> Column:
    """``repo`` below the working directory, ``home`` below the guessed home, else ``system``."""
    home = F.nullif(F.regexp_extract(cwd, "^(/(?:Users|home)/[^/]+)", 1), F.lit(""))
    return (
        F.when(_under(path, cwd), F.lit("repo"))
        .when(_under(path, home), F.lit("home"))
        .otherwise(F.lit("system"))
    )


def mcp_server(tool: Column) -> Column:
    """Server of an MCP tool name, NULL for built-in tools."""
    return F.when(tool.startswith("mcp__"), F.get(F.split(tool, "__"), F.lit(1)))
