"""A corpus made ready for training: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's ``docs``. All but the last keep the columns of
documents. Stages that drop rows judge each row on its own, by a key that is
written with the rows first; ids may be null or shared by any rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmarts.llm import decontam, langid, packing, pii, simhash
from trailmarts.llm.common import crc_fold
from trailmarts.llm.queries import tokenizer_path
from trailmarts.session import stored

LEAST_SCORE = 0.5  # of the language, among those learnt; near 1 for all but very short texts, whatever their language


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and its name. They are written: every reader then sees the same keys."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-keyed"), name


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``keyed`` without the rows whose keys are in ``gone`` (one column) and without the key, all other columns kept.

    The keys that go are written first: Spark then knows their size, and if they
    are few sends them to the documents instead of shuffling all texts.
    """
    keys = stored(gone.toDF("gone"), "pipeline-gone").toDF(f"{key}_gone")
    return keyed.join(keys, keyed[key] == keys[f"{key}_gone"], "left_anti").drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose likeliest language has less than ``LEAST_SCORE``; a language that was not learnt is not noticed."""
    keyed, key = _keyed(docs)
    model = langid.train(keyed, crc_fold("doc_id", 3) != 1)
    found = langid.predicted(keyed, model, doc_id=key)
    return _without(keyed, key, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE)).select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: of the smallest id (none comes last), then of the smallest hash of the row."""
    keyed, key = _keyed(docs)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # what can be hashed
    return _without(keyed, key, simhash.followers(keyed.withColumn(f"{key}_hash", F.xxhash64(*plain)), [f"{key}_hash", key]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark passage is a twentieth or more go."""
    keyed, key = _keyed(docs)
    found = decontam.report(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, key, found.where("contaminated").select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of 1024."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packed", packed),
]
#: Language, fingerprints and tokens are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
