"""Forests that are cut into blocks give what the rounds over all nodes give."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import flattened

from trailmarts.operators import forest


@pytest.mark.parametrize("seed,reach,block_rows", [(1, 1000, 70), (3, 12, 60)])
def test_blocks_give_the_same_trees(spark, seed, reach, block_rows):
    rng = random.Random(seed)
    nodes = []
    for s in "st":
        for i in range(150):
            parent = rng.choice([None, "gone"]) if rng.random() < 0.05 or not i else f"n{rng.randrange(max(0, i - reach), i)}"
            nodes.append((s, f"n{i}", parent, rng.choice([None, i, rng.randrange(150)]), i + (1 << 55)))
    df = spark.createDataFrame(nodes, "session string, agent string, parent string, start_ms bigint, tokens bigint").selectExpr(
        "*", "CASE WHEN tokens % 3 = 0 THEN 0.5D END cost", "CASE WHEN tokens % 5 > 0 THEN tokens % 50 > 0 END cost_is_complete", "start_ms + 9 end_ms")
    ring = [("s", "x", "y"), ("s", "y", "x"), ("s", "z", "x"), ("u", "p", "q"), ("u", "q", "p")] + [("u", f"r{i}", f"r{i - 1}" if i else "p") for i in range(90)]
    lost = spark.createDataFrame(ring, "session string, agent string, parent string").selectExpr("*", "try_cast(substr(agent, 2) AS BIGINT) start_ms", "1L tokens", "1.0D cost", "true cost_is_complete", "0L end_ms")
    every = df.unionByName(lost)
    plain, cut = forest.grow(every), forest.grow(every, block_rows)
    assert plain.placed is None and cut.placed.select("__block").distinct().count() > 3
    assert rows(cut.nodes.select(*plain.nodes.columns)) == rows(plain.nodes)
    assert rows(forest.unreached(every, cut), "session", "agent") == sorted((s, a) for s, a, _ in ring)
    totals = forest.subtree_totals(cut)
    assert rows(totals.select(*forest.subtree_totals(plain).columns)) == rows(forest.subtree_totals(plain))
    assert rows(forest.agent_paths(cut)) == rows(forest.agent_paths(plain))
    assert rows(forest.tree_rows(cut, totals)) == rows(forest.tree_rows(plain, totals))
    got = {(r.session, r.agent): (r.place, r.depth, r.nodes, r.subtree_tokens, r.is_last) for r in forest.tree_rows(cut, totals).join(totals.drop("nodes"), ["session", "agent"]).collect()}
    assert got == flattened(nodes)


def test_only_trees_cut_by_a_block_take_part_in_the_rounds(spark):
    """Every node took part in every round, so the rows written grew with the depth."""
    chain = spark.range(5000).selectExpr("'s' session", "concat('n', id) agent", "CASE WHEN id > 0 THEN concat('n', id - 1) END parent", "id tokens", "1.0D cost", "true cost_is_complete", "id start_ms", "id end_ms")
    grown = forest.grow(chain, 1000)
    assert [j.count() for j in grown.jumps] == [4, 3, 1] and grown.nodes.agg(F.max("depth")).first()[0] == 4999
