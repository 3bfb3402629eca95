"""Jaccard join by set-relation skipping against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import awkward_rows, collected, docs_frame, lowered

from trailmarts.llm import setjoin
from trailmarts.llm.queries import op11_set_relation

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    w = [x for x in lowered(text).split(" ") if x]
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(rows, share=(90, 100)):
    """(doc_id, n_shingles, component_id) by comparing all pairs of rows."""
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        least[top(i)].append(doc_id)
    return sorted([(r[0], len(sets[i]), min((d for d in least[top(i)] if d is not None), default=None)) for i, r in enumerate(rows)], key=repr)


def copies(seed, bases=6, each=12, n=150):
    """Texts near each other by various numbers of changed words."""
    rng, rows = random.Random(seed), []
    for b in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.randint(4, n))]
        for c in range(each):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 8))):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            if c % 4 == 3:
                text = text + [rng.choice(WORDS)] * (c % 3)
            rows.append((1000 * seed + 100 * b + c, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [setjoin.CELL, 6000, 1500])
def test_components_equal_all_pairs(spark, cell):
    passage = " ".join(WORDS[:60])
    rows = copies(1) + awkward_rows(n=10)
    rows += [(5000 + i, passage + " " + " ".join(random.Random(i).choices(WORDS, k=40))) for i in range(20)]  # a common passage links nothing
    rows += [(7, "same id but another text"), (None, rows[0][1]), (None, rows[0][1] + " tail"), (None, "alone without id here"), rows[3], rows[3]]
    rows += [(6000 + i, f"{passage} {i}") for i in range(30)]  # near copies in one group
    assert collected(setjoin.joined(docs_frame(spark, rows), cell=cell)) == plain(rows)


def test_another_share_and_an_empty_table(spark):
    rows = copies(2, bases=4, each=8, n=40)
    docs = docs_frame(spark, rows)
    assert collected(setjoin.joined(docs, share=(60, 100))) == plain(rows, (60, 100))
    empty = setjoin.joined(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("share", [(90, 100), (60, 100), (99, 100)])
def test_linked_sets_share_a_signature(share):
    rng, rule = np.random.default_rng(0), setjoin.Rule(share)
    met, most = 0, share[1] - share[0]
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        less, more = int(rng.integers(0, 2 + most * n // 100)), int(rng.integers(0, 2 + most * n // 100))
        other = np.unique(np.concatenate([base[less:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        base = np.unique(base)
        overlap = len(np.intersect1d(base, other))
        if len(other) and rule.linked(overlap, len(base), len(other)) and overlap < max(len(base), len(other)):
            met += 1
            assert len(np.intersect1d(rule.signatures(base), rule.signatures(other)))
    assert met > 20


def test_crowded_parts_still_meet():
    """Sets whose hashes all fall into few parts agree on empty ones only, at worst."""
    rule, n = setjoin.Rule(), 40
    low = np.arange(n, dtype=np.uint64)
    a, b = low, np.concatenate([low[:-1], [np.uint64(1 << 63)]])
    assert rule.linked(n - 1, n, n)
    assert len(np.intersect1d(rule.signatures(a), rule.signatures(b)))


def test_query_reads_all_rows(spark):
    found = op11_set_relation(spark, "/root/testdata/sf0.001")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert collected(found) == plain(docs)
