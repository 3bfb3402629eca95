import corpus_pipeline
from llm_cases import awkward_rows, docs_frame
from test_llm_decontam import plain as plain_hits
from test_llm_ids import plain_ids, tokenizer  # noqa: F401
from test_llm_simhash import plain_components, plain_print

from trailmarts.llm import langid
from trailmarts.session import stored

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "test-stage")
        assert after.columns == docs.columns
        now = {r.doc_id: r for r in after.collect()}
        if name == "language":
            gone = {i for i, t in kept.items() if not langid.has_letter(t)}
        elif name == "near_duplicates":
            prints = {i: plain_print(t) for i, t in kept.items()}
            root, first = plain_components(set(prints.values())), {}
            for i in sorted(prints):
                first.setdefault(root[prints[i]], i)
            gone = kept.keys() - set(first.values())
        elif name == "decontamination":
            gone = {i for i, (w, hit, _) in zip(kept, plain_hits(list(kept.values()), bench), strict=True) if hit and 20 * len(hit) >= len(w)}
        else:
            gone = set()
            assert any(now[i].text != t for i, t in kept.items()) and all(r.n_chars == len(r.text) for r in now.values())
            assert not any(word in (r.text or "") for r in now.values() for word in ("@example.com", "@mail."))
        assert now.keys() == kept.keys() - gone
        if name != "personal_data":
            assert all(now[i].text == kept[i] for i in now)
        docs, kept = after, {i: r.text for i, r in now.items()}
    total = sum(len(plain_ids(tokenizer, t)) for t in kept.values())
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in found) == total and {r.doc_id for r in found} == kept.keys()
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect())


def test_awkward_and_empty_tables(spark):
    for rows in ([*awkward_rows(), (None, None), (None, "text without id"), (12, "twice twice"), (12, "twice twice")], []):
        docs = docs_frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, docs, SF), "test-stage")
            assert after.columns == docs.columns
            docs = after
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}
