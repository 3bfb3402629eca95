"""Collocations against counting every n-gram by itself."""

import random
import re
from collections import Counter

import pytest
from llm_cases import awkward_rows, collected, docs_frame, lowered

from trailmarts.llm import collocations


def plain(rows, least, kept, longest=4):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    gone = set()
    for (lang, w), f in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = (lang, w[i:i + k])
                if 100 * f >= 80 * candidates[inner]:
                    gone.add(inner)
    found = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(((lang, rank, p.decode(), -a, l, r, total[lang], -score) for lang, all_ in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(all_)[:kept], 1)), key=repr)


def texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["new", "york", "city", "Of", "the", "café", "日本", "a b", "x"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("slots", [collocations.SLOTS, 1 << 15])
@pytest.mark.parametrize(("least", "kept"), [(30, 2000), (3, 20)])
def test_equal_to_counting_each_length(spark, least, kept, slots):
    rows = texts(1) + [(d, t, "en") for d, t in awkward_rows(n=10)] + [(1, "new york city hall " * 300, "fr"), (1, "new york city hall " * 300, "fr"), (None, "of the city " * 40, None)]
    docs = docs_frame(spark, rows)
    got = collocations.collocations(docs, least=least, kept=kept, slots=slots).drop("k")
    assert collected(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == plain(rows, least, kept)


def test_pads_at_rare_pairs_lose_no_phrase(spark, monkeypatch):
    """Many small steps, so that counts only come together in Spark."""
    monkeypatch.setattr(collocations, "STEP_BYTES", 500)
    rows = texts(2, 300)
    assert collected(collocations.collocations(docs_frame(spark, rows), least=10).drop("k"), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == plain(rows, 10, 2000)


def test_counts_beyond_64_bits_in_products(spark, monkeypatch):
    big = 1 << 61
    rows = [("en", 0, "", 3 * big)] + [("en", 1, w, big) for w in "ab"] + [("en", 2, "a b", big - 1)]
    made = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda documents, *how: made)
    (r,) = collocations.collocations(made.select("lang", "phrase")).collect()
    assert (r.score, r.a, r.l, r.r) == (2_000_000 * (big - 1) // (2 * big), big - 1, big, big)


def test_nothing_frequent(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (3, "a b c d"), (None, " \n ")])
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.limit(0)).collect() == []
