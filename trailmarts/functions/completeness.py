"""What each kind of source records, estimates or lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Source, dimension, status.
TABLE = [
    ("claude-session-jsonl", "systemPrompt", "absent"),
    ("claude-session-jsonl", "toolSchemas", "absent"),
    ("claude-session-jsonl", "generationParams", "absent"),
    ("claude-session-jsonl", "injectedContext", "partial"),
    ("claude-session-jsonl", "hiddenApiCalls", "not-recorded"),
    ("claude-session-jsonl", "cost", "estimate"),
    ("claude-session-jsonl", "thinking", "partial"),
    ("claude-session-jsonl", "latency", "absent"),
    ("claude-otel", "promptContent", "absent"),
    ("claude-otel", "toolContent", "absent"),
    ("claude-otel", "systemPrompt", "absent"),
    ("claude-otel", "toolSchemas", "absent"),
    ("claude-otel", "cost", "authoritative"),
    ("claude-otel", "latency", "partial"),
    ("claude-otel", "hiddenApiCalls", "not-recorded"),
    ("claude-wire-capture", "content", "authoritative"),
    ("claude-wire-capture", "coverage", "partial"),
    ("claude-wire-capture", "authHeaders", "absent"),
    ("claude-wire-capture", "hiddenApiCalls", "partial"),
    ("claude-wire-capture", "latency", "authoritative"),
    ("codex-session-jsonl", "cost", "estimate"),
    ("codex-session-jsonl", "systemPrompt", "unknown"),
    ("codex-session-jsonl", "toolSchemas", "unknown"),
    ("codex-session-jsonl", "hiddenApiCalls", "unknown"),
    ("codex-session-jsonl", "latency", "unknown"),
]


def of_sources(kinds: DataFrame) -> DataFrame:
    """The dimensions of every source kind that occurs in ``kinds.source_kind``.

    The kinds are reduced to the few distinct ones before the constant table joins.
    """
    table = kinds.sparkSession.createDataFrame(TABLE, "source_kind string, dimension string, status string")
    return kinds.select("source_kind").distinct().join(table, "source_kind")


def per_session(sessions: DataFrame) -> DataFrame:
    """Dimensions per session by its source kind; the table has a fixed 25 rows."""
    table = sessions.sparkSession.createDataFrame(TABLE, "source_kind string, dimension string, status string")
    return sessions.join(F.broadcast(table), "source_kind").select("session", "dimension", "status")
