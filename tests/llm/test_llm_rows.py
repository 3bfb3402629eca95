"""Stages of the pipeline on rows whose ids are null or shared."""

import corpus_pipeline
from llm_cases import docs_frame
from pyspark.sql import functions as F

from trailmarts.session import stored

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] for i in range(n))


def after(spark, stage, rows):
    docs = docs_frame(spark, rows)
    found = stored(dict(corpus_pipeline.STAGES)[stage](spark, docs, SF), "test-stage")
    assert found.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)


def test_rows_without_letters_go_whatever_their_ids(spark):
    rows = [(None, "12 34"), (None, None), (None, text(1)), (5, "!!"), (5, text(2)), (6, text(3))]
    assert after(spark, "language", rows) == sorted([(None, text(1)), (5, text(2)), (6, text(3))], key=repr)


def test_contaminated_rows_go_whatever_their_ids(spark):
    passage = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) >= 13)
    rows = [(None, passage), (None, text(1)), (5, passage), (5, text(2)), (6, text(3))]
    assert after(spark, "decontamination", rows) == sorted([(None, text(1)), (5, text(2)), (6, text(3))], key=repr)


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (text(i) for i in (1, 2, 3, 4))
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, c), (7, c), (None, d), (None, d), (None, a)]
    assert after(spark, "near_duplicates", rows) == sorted([(3, a), (5, b), (7, c), (None, d)], key=repr)
    # the same row in whatever order they come
    near = docs_frame(spark, [(1, a), (1, a + " "), (1, a + "\n"), (None, a)])
    ways = (near.coalesce(1).orderBy("text"), near.coalesce(1).orderBy(F.desc("text")))
    assert len({tuple(r.text for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) for docs in ways}) == 1
