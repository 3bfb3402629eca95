import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_rows, collected, docs_frame, lowered
from pyspark.sql import functions as F

from trailmarts.llm import simhash


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=3):
    codes = np.array(sorted(codes), np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i:] ^ codes[i]) <= radius) + i:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(c): int(codes[find(i)]) for i, c in enumerate(codes)}


@given(st.lists(st.text(st.sampled_from("aB é\t\n\x0b.😀")), max_size=12).map(" ".join))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(random.Random(1).choice(("a", "Bb", "ç")) for _ in range(70_000))
    assert simhash.fingerprint(text) == plain_print(text)


def clouds(seed, n=300):
    """Codes at random, some with neighbours a few bits away, and a chain."""
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(n)}
    for c in list(codes)[:60]:
        for _ in range(rng.randint(1, 6)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                c ^= 1 << b
            codes.add(c)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        codes.add(chain)
    return sorted(codes | {0, 1, 2**64 - 1})


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_all_neighbours(seed):
    codes = np.array(clouds(seed), np.uint64)
    tree = np.sort(np.random.default_rng(seed).integers(0, 3, len(codes)))
    tree = np.unique(tree, return_inverse=True)[1]
    trees = simhash.Trees(codes, tree)
    got = {(q, n) for qs, ns in trees.search(codes, tree, 3) for q, n in zip(qs.tolist(), ns.tolist())}
    assert got == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if tree[i] == tree[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}


@pytest.mark.parametrize("shard,group", [(4096, 16384), (20, 30), (5, 200)])
def test_components_equal_those_of_all_pairs(spark, shard, group):
    codes = [*clouds(9), *(2**40 + i for i in range(150))]  # a shard of many codes with one band in common
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in set(codes)], "fp long").repartition(3)
    edges = simhash.links(df, 3, shard, group)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(set(codes))
    groups = {}
    for c, root in want.items():
        groups.setdefault(root, set()).add(int(np.uint64(c).astype(np.int64)))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n, r in found.items() if r == root) for root in set(found.values())}
    if shard > 5:  # each pair of chunks gives a forest of its own
        assert edges.count() < 6 * len(set(codes))


def test_long_chain_of_components(spark):
    n = 200
    ids = random.Random(3).sample(range(10_000), n)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == dict.fromkeys(ids, min(ids))


def test_documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = awkward_rows()
    for i in range(25):
        text = [rng.choice(words) for _ in range(300)]
        for j in range(4):
            own = text.copy()
            own[rng.randrange(300)] = "changed"
            rows.append((500 + 10 * i + j, " ".join(own)))
    rows += [(None, "no id at all here"), (None, None), (700, "no id at all here"), (12, "twice"), (12, "twice")]
    prints = [plain_print(t) for _, t in rows]
    root = plain_components(set(prints))
    least = {}
    for (doc_id, _), fp in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    want = sorted(((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(rows, prints, strict=True)), key=repr)
    assert collected(simhash.report(docs_frame(spark, rows))) == want
    assert simhash.near_duplicates(docs_frame(spark, rows), shard=3).select(F.count_distinct("component_id")).first()[0] == len({r[2] for r in want} - {None})
    assert simhash.report(docs_frame(spark, [])).collect() == []
