"""Typed reads from VARIANT values; a field of another JSON type reads as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def with_parsed(df: DataFrame, text: str = "text", name: str = "v") -> DataFrame:
    """Add the parsed value of a text column as a generated column.

    Filters on fields would otherwise be pushed below the projection and parse
    the text once per field; they are not pushed through a generator, so each
    line is parsed once.
    """
    return df.withColumn(name, F.explode_outer(F.array(parse(F.col(text)))))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that later projections and filters reuse
    their values instead of inlining their expressions."""
    one = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("__once", one).select(*df.columns, "__once.*")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def kind(v: Column) -> Column:
    """Type name of a value; for the scalars that most fields are, one look at its first byte."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def string_at(v: Column, path: str) -> Column:
    inner = at(v, path)
    return F.when(is_string(inner), inner.cast("string"))


def long_at(v: Column, path: str) -> Column:
    inner = at(v, path)
    return F.when(~is_string(inner), F.try_variant_get(inner, "$", "bigint"))


def double_at(v: Column, path: str) -> Column:
    inner = at(v, path)
    return F.when(~is_string(inner), F.try_variant_get(inner, "$", "double"))


def bool_at(v: Column, path: str) -> Column:
    inner = at(v, path)
    return F.when(kind(inner) == "BOOLEAN", F.try_variant_get(inner, "$", "boolean"))


def array_at(v: Column, path: str) -> Column:
    """The array as ARRAY<VARIANT>, NULL when the field is not an array."""
    inner = at(v, path)
    return F.when(is_array(inner), F.try_variant_get(inner, "$", "array<variant>"))


def json_text(v: Column) -> Column:
    return F.to_json(v)


def text_of(content: Column) -> Column:
    """Text of a message body: the string itself, or its text blocks joined by newlines."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: string_at(b, "$.type") == "text"),
        lambda b: F.coalesce(string_at(b, "$.text"), F.lit("")),
    )
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return F.coalesce(
        F.when(is_string(content), content.cast("string")).when(is_array(content), joined),
        F.lit(""),
    )
