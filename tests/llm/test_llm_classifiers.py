import random

import numpy as np
from llm_cases import awkward_rows, collected, docs_frame
from pyspark.sql import functions as F

from trailmarts.llm import langid, toxicity
from trailmarts.llm.common import crc_fold

SF = "/root/testdata/sf0.1"


def test_pairs_are_learnt_that_no_sum_of_weights_can_tell():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):  # an insult alone and a group alone are fine
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.r_[rng.integers(100, 400, 8), [1] * insult, [2] * group, [3] * (not insult), [4] * (not group)]).astype(np.int64))
        labels.append(float(insult and group))
    machine = toxicity.fit(np.cumsum([0, *map(len, rows[:2400])]), np.concatenate(rows[:2400]), np.array(labels[:2400]))
    offsets = np.cumsum([0, *map(len, rows[2400:])])
    got = machine.score(offsets, np.concatenate(rows[2400:])) >= 0.5
    assert (got == np.array(labels[2400:], bool)).mean() > 0.99


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(10, dtype=np.int64) * 3, 0.2, rng.normal(size=10), rng.normal(size=(10, 4)))
    x = [0, 2, 5, 9]
    raw = m.bias + m.weights[x].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(x) for b in x[i + 1:])
    got = m.score(np.array([0, 0, 6]), np.array([0, 6, 15, 27, 4, 500], np.int64))
    assert np.allclose(got, [1 / (1 + np.exp(-0.2)), 1 / (1 + np.exp(-raw))])


def test_toxicity_awkward_rows(spark):
    rng = random.Random(2)
    docs = [*awkward_rows(), *((1000 + i, " ".join(rng.choice("and of the here that was".split()) for _ in range(20)) + (" vile!" if i % 4 == 0 else "")) for i in range(400)), (None, "vile"), (1000, "vile")]
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i in range(400)] + [(1000, 1), (1001, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    found = toxicity.report(docs_frame(spark, docs), labels).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.predicted == ((r.doc_id or 0) % 4 == 0) for r in found if r.doc_id is None or r.doc_id >= 1000)
    assert not any(r.predicted for r in found if r.doc_id is not None and r.doc_id < 1000)
    assert len({r.score for r in found if r.doc_id in (0, 1, 2, 5)}) == 1
    nothing = toxicity.report(docs_frame(spark, docs[:5]), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert toxicity.report(docs_frame(spark, []), labels).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.report(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r for r in found if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in found if not r.toxic) <= 0.005 * len(found)


def test_language_awkward_rows(spark):
    docs = [*((i, t, None) for i, t in awkward_rows()), *((1000 + i, "el perro y la niña comen" if i % 2 else "der Hund und das Mädchen essen", "es" if i % 2 else "de") for i in range(60)), (None, "das Mädchen", "de")]
    found = {r.doc_id: r for r in langid.report(docs_frame(spark, docs)).collect()}
    assert len(found) == len(docs)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 5))
    assert all(found[1000 + i].lang_pred == ("es" if i % 2 else "de") and found[1000 + i].score > 0.9 for i in range(60))
    assert all(r.lang_pred in ("es", "de") and 0 < r.score <= 1 for i, r in found.items() if i not in (0, 1, 2, 5))
    none = docs_frame(spark, [(1, "text", None), (2, None, "de")])
    assert {r.lang_pred for r in langid.report(none).collect()} == {"und"}
    assert langid.report(docs_frame(spark, [])).collect() == []


def test_language_scores_equal_a_plain_sum():
    rng = np.random.default_rng(0)
    model = dense(["a", "b"], np.log(rng.random((2, langid.BUCKETS))))
    texts = ["Ab, c", "é", "zz zz" * 30, "12 !", None]
    for text, (got, score) in zip(texts, model.predict(texts), strict=True):
        total = np.zeros(2)
        if langid.has_letter(text):
            for _, buckets in langid.grams([text]):
                total += np.array([values for _, values in model.seen])[:, buckets].sum(1)
            assert got == "ab"[int(total.argmax())] and np.isclose(score, 1 / (1 + np.exp(-abs(total[0] - total[1]))))
        else:
            assert (got, score) == ("und", 0.0)


def test_batches_do_not_change_a_prediction():
    rng = np.random.default_rng(0)
    model = dense(["a", "b"], np.log(rng.random((2, langid.BUCKETS))))
    texts = ["one text", "x", "", "another é", "y" * 500]
    together = model.predict(texts)
    for text, (lang, score) in zip(texts, together, strict=True):
        (own, own_score), = model.predict([text])
        assert own == lang and np.isclose(own_score, score)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.report(docs).where("held_out").join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.995 * len(found)


def test_training_sees_only_its_fold(spark):
    docs = [(i, "aaa" if i % 2 else "bbb", "x" if i % 2 else "y") for i in range(40)]
    held = {r.doc_id for r in docs_frame(spark, docs).where(crc_fold("doc_id", 3) == 1).select("doc_id").collect()}
    flipped = [(i, t, {"x": "y", "y": "x"}[lang] if i in held else lang) for i, t, lang in docs]
    assert collected(langid.report(docs_frame(spark, docs))) == collected(langid.report(docs_frame(spark, flipped)))


def dense(languages, log_p):
    return langid.Model(languages, [(np.arange(langid.BUCKETS), row) for row in log_p], np.zeros(len(languages)))


def test_no_language_of_the_sample_is_left_out(spark):
    """A thousand and one languages, each with words of its own letters."""
    word = lambda k: "".join(chr(0x4E00 + 3 * k + i) for i in range(3))
    rows = [(k, f"{word(k)} {word(k)[::-1]}", f"l{k:04d}") for k in range(1001)]
    model = langid.train(docs_frame(spark, rows), F.lit(True))
    assert model.languages == [r[2] for r in rows]
    got = model.predict([r[1] for r in rows])
    assert [g[0] for g in got] == model.languages and all(0 < g[1] <= 1 for g in got)
