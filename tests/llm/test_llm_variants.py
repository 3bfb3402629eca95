"""Spelling variants against plain counting and all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import awkward_rows, collected, docs_frame, lowered

from trailmarts.llm import variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 31 else run[:at] + run[at + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    """By the plain table of edit distances."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1] == 1


def plain(counts):
    found = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        found[w] = (form, n, len(near), counts[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def garbled(seed, n=25):
    """Rows of words and their misspellings, some with repeated letters."""
    rng, rows = random.Random(seed), []
    letters = "abcdéÿ"
    bases = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(n)] + ["abababab", "aaaaaaaa", "aaaaaaaaaa", "abcabcabc"]
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = rng.choice(bases[:1 + rng.randrange(len(bases))])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice(letters)) + w[at + (kind != 1):]
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i if i % 9 else None, " 1".join(words)))
    return rows


def test_words_are_counted_with_the_deletions_of_the_rule(spark):
    rows = garbled(1) + awkward_rows(n=20) + [(3, "Straße naïveté ÀÉÎÕÜ-ÀÉÎÕÜÀÉ x÷yzabcd ŠŠŠŠŠŠŠŠ " * 40)] * 2
    got = {r.word: r.n for r in variants.word_counts(docs_frame(spark, rows)).collect()}
    assert got == plain_words(rows)


@pytest.mark.parametrize("how", [{}, {"prune": 2}, {"prune": 2, "room": 30}, {"list_rows": 25, "prune": 1}])
def test_near_words_forms_and_roots_equal_all_pairs(spark, how):
    rows = garbled(2, 20)
    counts = plain_words(rows)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(variants.variants(words, **how), *COLUMNS) == plain(counts)


def test_very_long_words(spark):
    base = "abcdefghij" * 9000
    counts = {base: 900, base[:500] + base[501:]: 50, base[:-1]: 3, base + "z": 2, "x" * 70: 40, "x" * 71: 4, "x" * 69: 400, "wwwwwww": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {(r.word, r.form, r.n_near) for r in variants.variants(words).collect()} == {(w, f, k) for w, f, _, _, k, _ in plain_fast(counts)}


def plain_fast(counts):
    near = {w: [v for v in counts if variants.one_edit(w, v)] for w in counts}
    rows = []
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        rows.append((w, form, None, n, len(near[w]), None))
    return rows


def test_dictionary_is_bounded_and_bounds_hold(spark):
    counts = plain_words(garbled(3, 40))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    grams = variants.dictionary(words, room=400, prune=2)
    assert all(sum(len(g) == q for g in grams.often) < 400 for q in range(variants.SHORT, variants.LONG + 1)) and any(len(g) > variants.SHORT for g in grams.often)
    listed = list(counts)
    word, g, _, _ = grams.probes(listed)
    lists = {}
    for w, x in zip(word.tolist(), g.tolist()):
        lists.setdefault(w, set()).add(x)
    for i, a in enumerate(listed):
        for j in range(i):
            if variants.one_edit(a, listed[j]):
                assert lists[i] & lists[j]


def test_empty_tables(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (3, "short words")])
    for table in (docs, docs.limit(0)):
        found = variants.report(table)
        assert found.collect() == [] and found.columns == list(COLUMNS)
