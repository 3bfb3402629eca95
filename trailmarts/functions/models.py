"""Model ids: normal form, class, family and short label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id segments that name a model family, first match wins.
FAMILIES = [
    ("f", "fable", "fable", "before"),
    ("f", "opus", "opus", "before"),
    ("s", "sonnet", "sonnet", "before"),
    ("h", "haiku", "haiku", "before"),
    ("sol", "sol", "sol", "after"),
    ("terra", "terra", "terra", "after"),
    ("luna", "luna", "luna", "after"),
    ("rev", "auto-review", "auto-review", None),
    ("gpt", "gpt", None, None),
    ("gpt", "codex", None, None),
]
TOP_TIER = ["opus", "fable"]
EDGE = "[-._/ ]"


def _has_segment(model: Column, word: str) -> Column:
    return F.lower(model).rlike(f"(^|{EDGE}){word}($|{EDGE})")


def plain_id(model: Column) -> Column:
    """Cloud-hosted ids without their region prefix and revision suffix."""
    hosted = r"^(?:us\.|eu\.|apac\.|global\.)?anthropic\.(.+)$"
    inner = F.regexp_extract(model, hosted, 1)
    return F.when(inner != "", F.regexp_replace(inner, r"-v\d+:\d+$", "")).otherwise(model)


def undated_id(model: Column) -> Column:
    return F.regexp_replace(model, r"-\d{8}$", "")


def is_top_tier(model: Column) -> Column:
    out = F.lit(False)
    for word in TOP_TIER:
        out = out | _has_segment(model, word)
    return out


def family(model: Column) -> Column:
    """Accent class of a model, ``mut`` when no family matches."""
    out = F
    for cls, word, _, _ in FAMILIES:
        out = out.when(_has_segment(model, word), F.lit(cls))
    return out.otherwise(F.lit("mut"))


def short_label(model: Column) -> Column:
    """Family name with its version, or the id without its date."""
    low = F.lower(model)
    version = r"\d{1,2}(?!\d)(?:[-.]\d{1,2}(?!\d))*"
    out = F
    for _, word, label, version_side in FAMILIES:
        if label is None:
            continue
        if version_side == "before":
            tail = F.regexp_extract(low, f"{word}[-.]({version})", 1)
            head = F.regexp_extract(low, f"({version})[-.]{word}", 1)
            number = F.replace(F.coalesce(F.nullif(tail, F.lit("")), F.nullif(head, F.lit(""))), F.lit("-"), F.lit("."))
            text = F.concat_ws(" ", F.lit(label), number)
        elif version_side == "after":
            number = F.nullif(F.regexp_extract(low, r"gpt[-.](\d{1,2}(?:\.\d{1,2})*)", 1), F.lit(""))
            text = F.concat_ws(" ", number, F.lit(label))
        else:
            text = F.lit(label)
        # The unlabelled families come last, so a labelled word always wins here.
        out = out.when(_has_segment(model, word), text)
    undated = F.regexp_replace(F.regexp_replace(model, r"-(\d{4}-\d{2}-\d{2}|\d{8})$", ""), "-latest$", "")
    return out.otherwise(undated)
