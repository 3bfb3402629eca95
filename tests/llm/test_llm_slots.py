"""Counts of hashed windows on their way through the shuffle, and the windows that they leave to be counted word by word."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_frame

from trailmarts.llm import collocations


@pytest.mark.parametrize("size", [0, 1, 7, 50_000])
def test_packed_counts_come_back(size):
    rng = np.random.default_rng(size)
    h = rng.integers(0, collocations.WINDOW_HASHES, size).astype(np.uint64)
    h = np.concatenate([h, h[:size // 3], np.array([0, collocations.WINDOW_HASHES - 1] * (size > 0), np.uint64)])
    n = np.where(rng.random(len(h)) < 0.7, 1, rng.integers(1, 1 << 40, len(h)))
    want = Counter()
    for key, value in zip(h.tolist(), np.minimum(n, (1 << 64) // collocations.WINDOW_HASHES - 1).tolist()):
        want[key] += value
    batch = collocations.packed(*collocations._summed(h, n))
    hashes, counts = collocations.unpacked(batch)
    assert dict(zip(hashes.tolist(), counts.tolist())) == want and hashes.tolist() == sorted(want)
    if batch.num_rows > 2:
        mixed = pa.concat_batches([batch.take(pa.array(rng.permutation(batch.num_rows)))]).slice(1)
        hashes, counts = collocations.unpacked(mixed)
        assert sum(mixed.column(1).to_pylist()) == len(hashes) and all(want[x] == y for x, y in zip(hashes.tolist(), counts.tolist()))


def phrases(rows, longest=4):
    found = Counter()
    for lang, text in rows:
        words = text.split()
        found.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return found


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_only_frequent_phrases_are_counted_word_by_word(spark, monkeypatch, held):
    """Every part of three words is frequent here, but few windows of four are."""
    monkeypatch.setattr(collocations, "HELD", held, raising=False)
    draw = random.Random(3)
    rows = [(lang, " ".join(draw.choice("abcd") for _ in range(300))) for lang in ("x", "y") for _ in range(4)]
    rows += [("x", "one two three four")] * 9 + [("y", "a a a a b")] * 30
    seen, plain = [], collocations.windows
    monkeypatch.setattr(collocations, "windows", lambda *args: seen.append(plain(*args)) or seen[-1])
    least, all_phrases = 14, phrases(rows)
    docs = docs_frame(spark, [(i, text, lang) for i, (lang, text) in enumerate(rows)])
    got = {(r.lang, *r.phrase.split()): r.f for r in collocations.phrase_counts(docs, least=least).where("words > 0").collect()}
    assert got == {p: n for p, n in all_phrases.items() if n >= least}
    assert any(n < least for p, n in all_phrases.items() if len(p) == 5)
    counted = {(r.lang, *(w for w in (r.w1, r.w2, r.w3, r.w4) if w)) for r in seen[0].collect()}
    assert all(all_phrases[p] >= least for p in counted if len(p) > 1)


def test_windows_of_many_distinct_words():
    rng = np.random.default_rng(2)
    for words in (4, 90_000):
        grid = rng.integers(1, words, (4, 60_000))
        distinct, n = collocations._counted(grid)
        assert dict(zip(map(tuple, distinct.T.tolist()), n.tolist())) == Counter(map(tuple, grid.T.tolist()))
