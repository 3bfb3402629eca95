"""Small tables with the awkward rows that every operator must take, and plain versions to hold results against."""

import random
import re

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use within.
CLASHING = ("fp", "component_id", "bucket", "spans", "row", "n", "terms", "key", "shard", "room", "score", "length", "start", "id that goes", "text_", "words_email_of_spans")


def docs_frame(spark, rows):
    """Documents from (doc_id, text[, lang]) tuples, with columns of clashing names and nulls in every other one."""
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *(T.StructField(c, T.StringType()) for c in CLASHING)])
    full = []
    for i, r in enumerate(rows):
        doc_id, text, lang = (*r, "en")[:3]
        full.append((doc_id, text, lang, None if i % 2 else "s", None if text is None else len(text), *(None if i % 3 else "x" for _ in CLASHING)))
    return spark.createDataFrame(full, schema).repartition(3)


def awkward_rows(seed=1, n=40):
    """(doc_id, text): null, empty, blank, very long, repeated and ordinary texts."""
    rng = random.Random(seed)
    vocabulary = ["the", "an", "ESS", "été", "naïve", "ß", "of,", "x1", "don't", "日本", "😀", "a.b", "foo\n", "\tbar", "  "]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "!!! ??"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "same text as another " * 20), (9, "same text as another " * 20)]
    rows += [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    return rows


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
