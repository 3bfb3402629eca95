"""Text scalars: previews, subjects, summaries, snippets, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonx

# Tool error classes in the order they are tried.
ERROR_CLASSES = [
    ("file-not-found", r"(file does not exist|no such file|not found: .*\.(ts|js|tsx|jsx|json|md)|ENOENT)"),
    ("string-not-found", r"(string to replace not found|old_string.*not found|not found in file)"),
    (
        "permission-denied",
        r"(permission denied|not allowed|denied by|requires approval|EACCES|user (declined|rejected|doesn't want))",
    ),
    ("interrupted", r"(request interrupted|interrupted by user|\[interrupted\])"),
    ("timeout", r"(timed? ?out)"),
    ("command-failed", r"(exit code [1-9]|command failed|fatal:|error:)"),
]
# Input fields that name what a call is about, in order.
SUBJECT_KEYS = ["file_path", "command", "pattern", "query", "url", "prompt"]
SUMMARY_KEYS = ["command", "file_path", "pattern", "query", "url", "prompt", "description"]
SUMMARY_LIMIT = 120
RESULT_LIMIT = 160
# Openings of texts that the harness injects as user messages.
INJECTED_PREFIXES = [
    "# AGENTS.md instructions",
    "<user_instructions>",
    "<environment_context>",
    "<ENVIRONMENT_CONTEXT>",
]


def clip(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip_line(text: Column, limit: int) -> Column:
    return clip(one_line(text), limit)


def error_class(text: Column) -> Column:
    out = F
    for name, pattern in ERROR_CLASSES:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(F.lit("other"))


def _first_field(v: Column, keys: list[str]) -> list[Column]:
    return [jsonx.string_at(v, f"$.{k}") for k in keys]


def call_subject(input_json: Column) -> Column:
    """The field that names the call, else the whole input."""
    v = jsonx.parse(input_json)
    return F.coalesce(*_first_field(v, SUBJECT_KEYS), input_json, F.lit("null"))


def input_summary(input_json: Column) -> Column:
    v = jsonx.parse(input_json)
    return clip_line(F.coalesce(*_first_field(v, SUMMARY_KEYS), input_json, F.lit("null")), SUMMARY_LIMIT)


def args_summary(raw: Column) -> Column:
    """Summary of arguments that arrive as JSON text; string arrays are joined by spaces."""
    v = jsonx.parse(raw)
    fields = []
    for key in SUMMARY_KEYS:
        inner = jsonx.at(v, f"$.{key}")
        items = F.try_variant_get(inner, "$", "array<variant>")
        all_text = F.forall(items, jsonx.is_string)
        joined = F.array_join(F.transform(items, lambda x: x.cast("string")), " ")
        fields.append(
            F.when(jsonx.is_string(inner), inner.cast("string")).when(
                jsonx.is_array(inner) & all_text, joined
            )
        )
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(
        clip_line(F.coalesce(*fields, raw), SUMMARY_LIMIT)
    )


def result_summary(text: Column) -> Column:
    first = F.substring_index(text, "\n", 1)
    return clip(F.when(first != "", first).otherwise(one_line(text)), RESULT_LIMIT)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    ).cast("bigint")


def approx_tokens(chars: Column) -> Column:
    """Four characters per token, rounded up."""
    return F.ceil(chars / 4).cast("bigint")


def payload_tokens(value: Column) -> Column:
    return approx_tokens(F.length(F.to_json(value)))


def is_injected(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+", "")
    out = F.lit(False)
    for prefix in INJECTED_PREFIXES:
        out = out | trimmed.startswith(prefix)
    return out


def occurrences(text: Column, needle: str, case_sensitive: bool = False) -> Column:
    """Occurrences that do not overlap."""
    hay, pin = (text, needle) if case_sensitive else (F.lower(text), needle.lower())
    left = F.length(F.replace(hay, F.lit(pin), F.lit("")))
    return ((F.length(hay) - left) / len(pin)).cast("bigint")


def snippet(text: Column, needle: str, case_sensitive: bool = False, before: int = 60, after: int = 100) -> Column:
    """The first hit with some text around it, on one line."""
    hay, pin = (text, needle) if case_sensitive else (F.lower(text), needle.lower())
    at = F.instr(hay, pin) - 1
    start = F.greatest(F.lit(0), at - before)
    end = F.least(F.length(text), at + len(pin) + after)
    body = one_line(F.substr(text, start + 1, end - start))
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        body,
        F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def capped(text: Column, limit: int) -> Column:
    """Text with its cut, whether it was cut, and its true length."""
    return F.struct(
        F.substring(text, 1, limit).alias("text"),
        (F.length(text) > limit).alias("truncated"),
        F.length(text).cast("bigint").alias("full_chars"),
    )


def slug(text: Column, limit: int = 40) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(base, 1, limit), "-+$", "")
    return F.when(cut == "", F.lit("learning")).otherwise(cut)


def short_number(chars: Column) -> Column:
    return F.when(
        chars >= 1000, F.concat(F.round(chars / 1000).cast("bigint").cast("string"), F.lit("k"))
    ).otherwise(chars.cast("string"))
