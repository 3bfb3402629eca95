import hashlib
import random

import numpy as np
import pytest
from llm_cases import awkward_rows, bench_words, collected, docs_frame

from trailmarts.llm import decontam

BENCH = "item_id long, text string, spans string"


def plain(texts, items, window=13):
    """Per text: words, hit words, ids of items."""
    found = {}
    for item_id, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i:i + window]), set()).add(item_id)
    out = []
    for text in texts:
        w, hit, ids = bench_words(text), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                own = found.get(tuple(w[i:i + n]))
                if own is not None:
                    ids |= own
                    hit |= set(range(i, i + n))
        out.append((w, hit, ids))
    return out


def report_rows(rows, items, window=13):
    out = []
    for (doc_id, _), (w, hit, ids) in zip(rows, plain([t for _, t in rows], items, window), strict=True):
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(6)
    words = ["the", "of", "An", "été", "x1", "hunt", "日本", "to"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(14, 40)))) for i in range(12)]
    items += [(20, items[0][1][5:80]), (20, "An été item twice"), (21, None), (22, ""), (23, "!?"), (24, "short Item, of five words"), (None, "no id but it has words for a window of thirteen words or so here"), (25, items[3][1].upper().replace("É", "é"))]
    rows = awkward_rows(4, 20)
    for i in range(150):
        body = [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 300))]
        if i % 3:
            passage = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 3):]
        rows.append((1000 + i, " ".join(body)))
    return [*rows, (1000, rows[-1][1]), (None, items[0][1]), (3000, " ".join([items[1][1]] * 500)), (3001, "An été item twice"), (3002, "an, été. ITEM?twice")], items


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 300}, {"shard_words": 200}])
def test_report_equals_plain_search(spark, how):
    rows, items = cases()
    found = decontam.report(docs_frame(spark, rows), spark.createDataFrame([(*x, "x") for x in items], BENCH), **how)
    assert collected(found.drop("spans")) == report_rows(rows, items)


def test_spans_are_merged(spark):
    item = " ".join(f"w{i}" for i in range(20))
    doc = f"before {item} and {item} w0 w1"
    found = decontam.find(docs_frame(spark, [(1, doc)]), spark.createDataFrame([(7, item, None)], BENCH)).first()
    assert [(s.start, s.end) for s in found.spans] == [(1, 21), (22, 42)] and found["items"] == ["7"]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_index_with_small_windows(window):
    rng = random.Random(window)
    for _ in range(20):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))) for i in range(3)]
        texts = [" ".join(rng.choice("abcz") for _ in range(rng.randint(0, 200))) for _ in range(6)]
        counts, hit, found = decontam.hits(texts, decontam.Phrases.of(items, window))
        want = plain(texts, items, window)
        edges = np.cumsum([0, *counts])
        assert [set(np.flatnonzero(hit[a:b]).tolist()) for a, b in zip(edges, edges[1:])] == [h for _, h, _ in want]
        assert [{items[p][0] for p in f} for f in found] == [ids for _, _, ids in want]


def test_rank_and_symbols():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 37, 500)
    tree = decontam.Wavelet(text, 6)
    assert (tree.symbols(np.arange(500)) == text).all()
    symbols, at = rng.integers(0, 40, 300), rng.integers(0, 501, 300)
    assert tree.rank(symbols, at).tolist() == [int((text[:p] == s).sum()) for s, p in zip(symbols, at)]


def test_suffixes_of_repeats():
    for text in ([1] * 100 + [0], [2, 1, 2, 1, 2, 0], [5, 0]):
        text = np.array(text)
        assert decontam.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_empty_tables(spark):
    rows, items = cases()
    bench = spark.createDataFrame([(*x, "x") for x in items], BENCH)
    assert decontam.report(docs_frame(spark, []), bench).collect() == []
    assert collected(decontam.report(docs_frame(spark, rows[:12]), bench.limit(0)).drop("spans")) == report_rows(rows[:12], [])
