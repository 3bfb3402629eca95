"""Skill and slash-command invocations, and the injected body each skill call received."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.ordered import CHUNK_ROWS, ranged, running
from ..session import stored
from . import turns

# Fixed values.
BODY_PREFIX = "Base directory for this skill:"
COMMAND_NAME = r"<command-name>([^<]*)</command-name>"
COMMAND_ARGS = r"<command-args>([^<]*)</command-args>"
SKILL_LINK = r"\[\$([\w-]+):([\w-]+)\]\(([^)]+)\)"


def skill_bodies(texts: DataFrame) -> DataFrame:
    """Injected skill bodies among meta records: base directory, short name and length."""
    first = F.substring_index("text", "\n", 1)
    base = F.trim(F.substr(first, F.lit(len(BODY_PREFIX) + 1)))
    parts = F.filter(F.split(base, "/"), lambda p: p != "")
    return (
        texts.where(F.col("text").startswith(BODY_PREFIX)).withColumns({"base_path": base, "short_name": F.element_at(parts, -1)})
        .where("short_name IS NOT NULL")
        .select("session", "line", "ts_ms", "base_path", "short_name", F.length("text").cast("bigint").alias("chars"))
    )


def skill_calls(calls: DataFrame) -> DataFrame:
    v = jsonx.parse(F.col("input"))
    return (
        calls.where("tool = 'Skill'")
        .withColumns({"name": jsonx.string_at(v, "$.skill"), "args": jsonx.string_at(v, "$.args")})
        .where("name IS NOT NULL")
        .select(
            "session", "line", "ts_ms", "call_id", "name", "args", "result_chars",
            F.element_at(F.split("name", ":"), -1).alias("short_name"),
            F.coalesce("result_line", "line").alias("after_line"),
        )
    )


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Give every call of a part, in call order, the first of the part's bodies that is free at or after its first candidate."""
    bodies = np.sort(pdf["slot"].to_numpy())
    free: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while x in free:
            path.append(x)
            x = free[x]
        for p in path:
            free[p] = x
        return x

    out = pdf.sort_values("ord")
    places = []
    for start in np.searchsorted(bodies, out["first"].to_numpy()).tolist():
        at = find(start)
        free[at] = at + 1
        places.append(at)
    out["slot"] = bodies[places]
    return out[["session", "short_name", "call_id", "line", "slot"]]


def _halved(work: DataFrame, keys: list[str], unit: int) -> DataFrame:
    """Split every part of ``2 * unit`` calls into the earlier and the later half of its calls, each with its bodies.

    The later calls never change what the earlier ones take, and which bodies
    a set of calls takes does not depend on their order: along the bodies it
    is a running maximum again. What is left belongs to the later half.
    """
    part = [*keys, "part"]
    split = work.withColumn("part", F.floor(F.col("ord") / (2 * unit)))
    early = split.where(F.floor(F.col("ord") / unit) % 2 == 0)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    axis = early.select(*part, F.col("first").alias("pos"), zero.alias("kind"), "ord").unionByName(
        split.select(*part, F.col("slot").alias("pos"), one.alias("kind"), zero.alias("ord")))
    chunks = {"chunk": F.col("range")}  # any number of calls may wait from the same body
    counted = stored(running(
        ranged(axis, part, ["pos", "kind", "ord"]), part, "pos",
        {"bodies": ("sum", F.col("kind")), "calls": ("sum", one - F.col("kind"))}, ties=["kind", "ord"], **chunks), "skills")
    led = running(
        counted.where("kind = 0"), part, "pos", {"lead": ("max", F.col("bodies") - F.col("calls") + 1)}, ties=["ord"], **chunks)
    taken = led.select(*part, (F.col("calls") - 1 + F.col("lead")).alias("place"), "ord")
    places = counted.where("kind = 1").select(*part, (F.col("bodies") - 1).alias("place"), F.col("pos").alias("slot"), "range")
    marked = stored(places.join(taken, [*part, "place"], "left"), "skills")
    left = running(marked.where("ord IS NULL"), part, "place", {"nth": ("sum", one)}, **chunks)
    dealt = marked.where("ord IS NOT NULL").select(*keys, "ord", "slot").unionByName(
        left.select(*keys, ((2 * F.col("part") + 1) * unit + F.col("nth") - 1).alias("ord"), "slot"))
    return stored(work.drop("slot").join(dealt, [*keys, "ord"]), "skills")


def _in_call_order(work: DataFrame, keys: list[str], largest: int, group_rows: int, **chunking) -> DataFrame:
    """Hand the bodies of each group out again in call order; no task gets more than ``group_rows`` calls of a group.

    ``work`` has the first candidate and a body for every call. Larger groups
    are halved by call order, all at the same time, until their parts fit.
    """
    placed = running(work, keys, "line", {"ord": ("sum", F.lit(1).cast("bigint"))}, ties=["call_id"], **chunking)
    placed = placed.withColumn("ord", F.col("ord") - 1)
    rounds = max(0, (-(-largest // group_rows) - 1).bit_length())
    if rounds:
        placed = stored(placed, "skills")
    for r in reversed(range(rounds)):
        placed = _halved(placed, keys, group_rows << r)
    schema = "session string, short_name string, call_id string, line bigint, slot bigint"
    return placed.withColumn("part", F.floor(F.col("ord") / group_rows)).groupBy(*keys, "part").applyInPandas(_greedy, schema)


def match_bodies(calls: DataFrame, bodies: DataFrame, group_rows: int = CHUNK_ROWS, **chunking) -> DataFrame:
    """Pair each skill call with the nearest later body of its name that no earlier call took.

    With the calls sorted by the line they wait from, call ``i`` takes body
    ``i + max(first_j - j)`` over ``j <= i``, where ``first`` is the number of
    bodies up to that line: a running maximum. The calls that compete for the
    same bodies form a group. Where a group's results came back in another
    order than its calls, the bodies are handed out again in call order, in
    parts of at most ``group_rows`` calls. A call whose body never comes takes
    the next call's, so a group may be all the rest of a session.
    """
    keys = ["session", "short_name"]
    # Calls after the last body of their name, or without any, never match.
    ends = bodies.groupBy(*keys).agg(F.max("line").alias("__end"))
    calls = calls.join(ends, keys).where(F.col("after_line") < F.col("__end")).drop("__end")
    body_axis = bodies.select(*keys, F.col("line").alias("pos"), F.lit(0).alias("kind"), F.lit(1).cast("bigint").alias("is_body"))
    call_axis = calls.select(*keys, F.col("after_line").alias("pos"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("is_body"), "call_id", "line")
    axis = call_axis.unionByName(body_axis, allowMissingColumns=True)
    placed = running(
        axis, keys, "pos",
        {"first": ("sum", F.col("is_body")), "nth": ("sum", 1 - F.col("is_body"))}, ties=["kind", "line", "call_id"], **chunking,
    )
    # Written between the scans: each one reads its input twice.
    slots = stored(placed.where("kind = 1").select(*keys, "call_id", "line", "pos", "first", (F.col("nth") - 1).alias("nth")), "skills")
    slots = running(slots, keys, "pos", {"lead": ("max", F.col("first") - F.col("nth"))}, ties=["nth"], **chunking)
    slots = stored(slots.withColumn("slot", F.col("nth") + F.col("lead")), "skills")
    # A call that lands on its own first candidate starts a new group.
    slots = running(
        slots, keys, "pos",
        {"grp": ("sum", (F.col("slot") == F.col("first")).cast("bigint")), "latest": ("max", F.col("line"))}, ties=["nth"], **chunking,
    )
    slots = stored(slots, "skills")
    inverted = stored(slots.groupBy(*keys, "grp").agg(
        F.bool_or(F.col("line") < F.col("latest")).alias("late"), F.count(F.lit(1)).alias("n")
    ).where("late AND n > 1").drop("late"), "skills")
    settled = slots.join(inverted, [*keys, "grp"], "left_anti").select(*keys, "call_id", "line", "slot")
    largest = inverted.agg(F.max("n")).first()[0]
    if largest:
        again = slots.join(inverted, [*keys, "grp"], "left_semi").select(*keys, "grp", "call_id", "line", "first", "slot")
        settled = settled.unionByName(_in_call_order(again, [*keys, "grp"], largest, group_rows, **chunking))
    numbered = running(bodies, keys, "line", {"slot": ("sum", F.lit(1).cast("bigint"))}, **chunking).withColumn("slot", F.col("slot") - 1)
    found = settled.join(
        numbered.select(*keys, "slot", F.col("line").alias("body_line"), F.col("chars").alias("body_chars"), "base_path", F.col("ts_ms").alias("body_ts_ms")),
        [*keys, "slot"],
    )
    return found.select("session", "call_id", "body_line", "body_chars", "base_path", "body_ts_ms")


def invocations(calls: DataFrame, texts: DataFrame, meta_texts: DataFrame, prompts: DataFrame, **chunking) -> DataFrame:
    """Skill calls and slash commands of the main thread with their turn."""
    skills = skill_calls(calls)
    bodies = match_bodies(skills, skill_bodies(meta_texts), **chunking)
    from_calls = skills.join(bodies, ["session", "call_id"], "left").select(
        "session", "line", F.lit("skill").alias("kind"), "name", "args", "result_chars", "body_chars", "body_line"
    )
    name = F.regexp_extract("text", COMMAND_NAME, 1)
    args = F.nullif(F.regexp_extract("text", COMMAND_ARGS, 1), F.lit(""))
    typed = texts.withColumns({"name": name, "args": args}).where("name <> ''").select(
        "session", "line", F.lit("command").alias("kind"), "name", "args"
    )
    every = from_calls.unionByName(typed, allowMissingColumns=True)
    # Sessions without prompts keep their invocations, without a turn.
    counted = turns.assign_turns(every, prompts, **chunking)
    return every.join(
        counted.select("session", "line", "kind", "name", "turn"), ["session", "line", "kind", "name"], "left"
    )


def linked_skills(user_messages: DataFrame, **chunking) -> DataFrame:
    """Skill links typed into user messages, with the ordinal of the message."""
    counted = running(user_messages, ["session"], "line", {"turn": ("sum", F.lit(1).cast("bigint"))}, **chunking)
    links = F.regexp_extract_all("text", F.lit(SKILL_LINK), F.lit(0))
    each = counted.select("session", "line", "turn", F.explode(links).alias("link"))
    return each.select(
        "session", "line", "turn",
        F.concat(F.regexp_extract("link", SKILL_LINK, 1), F.lit(":"), F.regexp_extract("link", SKILL_LINK, 2)).alias("name"),
    )


def skill_documents(calls: DataFrame, meta_texts: DataFrame, **chunking) -> DataFrame:
    """The skill bodies as injected documents of file access."""
    return body_documents(match_bodies(skill_calls(calls), skill_bodies(meta_texts), **chunking))


def body_documents(found: DataFrame) -> DataFrame:
    return found.select(
        "session", F.lit("main").alias("thread"), F.col("body_line").alias("line"), F.col("body_ts_ms").alias("ts_ms"),
        F.concat("base_path", F.lit("/SKILL.md")).alias("path"), F.col("body_chars").alias("chars"),
    )
