"""Order-dependent operators against brute force, and invariants."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailmarts.functions import jsonx, ordered
from trailmarts.operators import forest, policy, search, skills, timeline, trace
from trailmarts.plans import learnings


def greedy(calls, bodies):
    """The nearest later body that no earlier call took, call by call."""
    taken, out = set(), []
    for session, name, call_id, line, after in sorted(calls, key=lambda c: c[3]):
        for body in sorted(b for b in bodies if b[0] == session and b[1] == name):
            if body not in taken and body[2] > after:
                taken.add(body)
                out.append((session, call_id, body[2]))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_skill_bodies_are_handed_out_in_call_order(spark, seed):
    rng = random.Random(seed)
    calls, bodies = [], []
    for session in ("s", "t"):
        spots = rng.sample(range(300), 90)
        for i, line in enumerate(spots[:50]):
            calls.append((session, rng.choice("ab"), f"c{session}{i}", line, line + rng.choice([0, 1, 30, 60])))
        bodies += [(session, rng.choice("ab"), line) for line in spots[50:]]
    c = spark.createDataFrame(calls, "session string, short_name string, call_id string, line bigint, after_line bigint")
    b = spark.createDataFrame(bodies, "session string, short_name string, line bigint").selectExpr("*", "line AS ts_ms", "'x' AS base_path", "1L AS chars")
    got = skills.match_bodies(c, b, chunk_rows=40)
    assert rows(got, "session", "call_id", "body_line") == greedy(calls, bodies)


@pytest.mark.parametrize("seed,part", [(1, 1), (2, 3), (3, 8), (4, 100)])
def test_skill_bodies_of_a_group_larger_than_a_part(spark, seed, part):
    """Calls whose bodies never come: the rest of the session is one group, with results in any order and ties."""
    rng = random.Random(seed)
    calls, bodies = [], []
    for i in range(40):
        line = 10 * i + 1
        calls.append(("s", "a", f"c{i:02}", line, rng.choice([line, line, line + rng.randrange(60), 200])))
        if i not in (2, 11):
            bodies.append(("s", "a", line + 5))
    calls.append(("t", "a", "lone", 1, 1))
    bodies.append(("t", "a", 9))
    c = spark.createDataFrame(calls, "session string, short_name string, call_id string, line bigint, after_line bigint")
    b = spark.createDataFrame(bodies, "session string, short_name string, line bigint").selectExpr("*", "line AS ts_ms", "'x' AS base_path", "1L AS chars")
    got = skills.match_bodies(c, b, group_rows=part, chunk_rows=64)
    assert rows(got, "session", "call_id", "body_line") == greedy(calls, bodies)


def compact(contexts, top, base):
    out, offset = [], 0
    for real in contexts:
        counter = real - offset
        if counter < base:
            counter = min(base, real)
            offset = real - counter
        fired = counter > top
        if fired:
            offset, counter = real - base, base
        out.append((counter, int(fired)))
    return out


@pytest.mark.parametrize("top,chunk", [(60, 4), (60, 1000), (15, 4), (400, 3)])
def test_compaction_walk(spark, top, chunk):
    rng = random.Random(top)
    data, want = [], []
    for s in range(4):
        level, series = 20, []
        for _ in range(60):
            level = max(1, level + rng.randint(-3, 25)) if rng.random() > 0.1 else rng.randint(1, 30)
            series.append(level)
        data += [(f"s{s}", i + 1, x) for i, x in enumerate(series)]
        want += [(f"s{s}", i + 1, c, f) for i, (c, f) in enumerate(compact(series, top, series[0]))]
    points = spark.createDataFrame(data, "session string, idx bigint, context bigint")
    got = policy.compacted(points, threshold=top, chunk_points=chunk)
    assert rows(got, "session", "idx", "counter", "reset") == sorted(want, key=repr)


def test_forest_drops_cycles_and_roots_orphans(spark):
    nodes = spark.createDataFrame(
        [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "x", "y"), ("s", "y", "x"), ("s", "o", "gone"), ("t", "b", "a")],
        "session string, agent string, parent string").selectExpr("*", "1L tokens", "1.0D cost", "true cost_is_complete", "0L start_ms", "5L end_ms")
    grown = forest.grow(nodes)
    got = rows(grown.nodes, "session", "agent", "depth", "root", "above")
    assert got == [("s", "a", 0, "a", None), ("s", "b", 1, "a", "a"), ("s", "c", 2, "a", "b"), ("s", "o", 0, "o", None), ("t", "b", 0, "b", None)]
    totals = {(r.session, r.agent): r.nodes for r in forest.subtree_totals(grown).collect()}
    assert totals == {("s", "a"): 3, ("s", "b"): 2, ("s", "c"): 1, ("s", "o"): 1, ("t", "b"): 1}


def test_forest_of_any_depth_and_nodes_below_cycles(spark):
    deep = [("s", f"n{i}", f"n{i - 1}" if i else None) for i in range(100)]
    ring = [("s", f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("s", f"t{i}", f"t{i - 1}" if i else "r3") for i in range(9)] + [("s", "self", "self"), ("s", "below", "self")]
    nodes = spark.createDataFrame(deep + ring, "session string, agent string, parent string").selectExpr("*", "1L tokens", "1.0D cost", "true cost_is_complete", "0L start_ms", "5L end_ms")
    grown = forest.grow(nodes)
    got = {r.agent: (r.depth, r.root, r.above) for r in grown.nodes.collect()}
    assert got == {f"n{i}": (i, "n0", f"n{i - 1}" if i else None) for i in range(100)}
    assert {r.agent for r in forest.unreached(nodes, grown).collect()} == {a for _, a, _ in ring}
    assert {r.agent: r.nodes for r in forest.subtree_totals(grown).collect()} == {f"n{i}": 100 - i for i in range(100)}


def flattened(nodes):
    """Place, size and sums of each node by a plain walk."""
    below, known, out = {}, {(s, a) for s, a, *_ in nodes}, {}
    for s, a, p, start, tokens in nodes:
        below.setdefault((s, p if (s, p) in known else None), []).append((start or 0, a, tokens))

    def walk(s, up, place, depth):
        for i, (_, a, tokens) in enumerate(sorted(below.get((s, up), ()))):
            end, inner = walk(s, a, place + 1, depth + 1)
            out[s, a] = (place, depth, end - place, inner + tokens, i == len(below[s, up]) - 1)
            place = end
        return place, sum(out[s, a][3] for _, a, _ in below.get((s, up), ()))

    for s in {n[0] for n in nodes}:
        walk(s, None, 0, 0)
    return out


@pytest.mark.parametrize("seed,reach", [(1, 1000), (2, 3), (3, 12)])
def test_flattened_trees(spark, seed, reach):
    rng = random.Random(seed)
    nodes = []
    for s in "st":
        for i in range(150):
            parent = rng.choice([None, "gone"]) if rng.random() < 0.05 or not i else f"n{rng.randrange(max(0, i - reach), i)}"
            nodes.append((s, f"n{i}", parent, rng.choice([None, 5, rng.randrange(50)]), i))
    df = spark.createDataFrame(nodes, "session string, agent string, parent string, start_ms bigint, tokens bigint").selectExpr("*", "CAST(NULL AS DOUBLE) cost", "false cost_is_complete", "start_ms end_ms")
    grown = forest.grow(df)
    totals = forest.subtree_totals(grown)
    got = {(r.session, r.agent): (r.place, r.depth, r.nodes, r.subtree_tokens, r.is_last) for r in forest.tree_rows(grown, totals).join(totals.drop("nodes"), ["session", "agent"]).collect()}
    assert got == flattened(nodes)


def test_nodes_with_several_rows(spark):
    rows_ = [("s", "a", None, 1), ("s", "a", None, 2), ("s", "b", "a", 4), ("s", "b", "a", 8), ("s", "c", "b", 16), ("s", "d", "a", 32)]
    nodes = spark.createDataFrame(rows_, "session string, agent string, parent string, tokens bigint").selectExpr("*", "1.0D cost", "true cost_is_complete", "tokens start_ms", "tokens end_ms")
    grown = forest.grow(nodes)
    totals = forest.subtree_totals(grown)
    assert rows(totals, "agent", "nodes", "subtree_tokens") == [("a", 4, 63), ("b", 2, 28), ("c", 1, 16), ("d", 1, 32)]
    assert rows(forest.tree_rows(grown, totals), "agent", "place", "is_last") == [("a", 0, True), ("b", 1, False), ("c", 2, True), ("d", 3, True)]


def test_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "session string, agent string, parent string, tokens bigint, cost double, cost_is_complete boolean, start_ms bigint, end_ms bigint")
    grown = forest.grow(empty)
    totals = forest.subtree_totals(grown)
    assert totals.isEmpty() and forest.tree_rows(grown, totals).isEmpty() and forest.shares(grown, totals).isEmpty()


def test_a_long_chain_keeps_one_row_a_node(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("'s' session", "concat('n', id) agent", "CASE WHEN id > 0 THEN concat('n', id - 1) END parent", "id tokens", "1.0D cost", "true cost_is_complete", "id start_ms", "id end_ms")
    grown = forest.grow(chain)
    assert len(grown.jumps) == 17 and all("array" not in j.schema.simpleString() for j in (grown.nodes, *grown.jumps))
    totals = forest.subtree_totals(grown).selectExpr("CAST(substr(agent, 2) AS BIGINT) i", "nodes", "subtree_tokens")
    wrong = totals.where(f"nodes <> {n} - i OR subtree_tokens <> ({n} - i) * ({n} - 1 + i) div 2")
    assert totals.count() == n and wrong.isEmpty()


def test_chunks_of_a_session_go_to_tasks_of_their_own(spark):
    """After a join on the session, the chunk windows must still get an exchange by session and chunk."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        base = spark.range(100).selectExpr("'s' session", "id line", "1L v")
        joined = base.join(base.select("session").distinct(), "session")
        plan = ordered.running(joined, ["session"], "line", {"n": ("sum", F.col("v"))}, chunk_rows=10)._jdf.queryExecution().executedPlan().toString()
        points = joined.selectExpr("session", "line + 1 AS idx", "line AS context")
        walk = policy.compacted(points, 50, chunk_points=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "REPARTITION_BY_COL" in plan
    assert walk.count("REPARTITION_BY_COL") == 2 and walk.count("FlatMapGroupsInPandas") >= 3


def test_pieces_of_a_chunk_equal_its_walk():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    for n, top, base in ((1, 50, 10), (40, 60, 20), (300, 30, 5), (200, 10, 40)):
        ctx = np.maximum(1, 20 + rng.integers(-30, 40, n).cumsum() % 200)
        table = policy._pieces(pd.DataFrame({"session": "s", "chunk": 0, "idx": range(n), "context": ctx, "base": base, "top": top}))
        assert len(table) <= n + 2
        for offset in range(-10, 260, 3):
            row = table[table["from_offset"] <= offset].iloc[-1]
            assert (offset if pd.isna(row["to_offset"]) else row["to_offset"]) == policy._walk(ctx, offset, base, top)


def test_gate_keeps_escaped_lines(spark):
    lines = spark.createDataFrame([(r'{"t":"caf\u00e9"}',), (r'{"t":"a\/b"}',), ('{"t":"plain needle"}',), ('{"t":"none"}',)], "text string")
    assert [len(search.gate(lines, q).collect()) for q in ("café", "a/b", "needle", "")] == [4, 4, 2, 0]


def test_deep_values_are_found(spark):
    text = '{"a":' * 30 + '["deep", 1]' + "}" * 30
    df = spark.createDataFrame([(text,), ('"flat"',), ("[]",)], "text string").select(search.flat_text(jsonx.parse(F.col("text"))).alias("flat"))
    assert [r.flat for r in df.collect()] == ["deep\n1", "flat", ""]


def test_ids_take_free_suffixes_in_order(spark):
    day = 1_700_000_000_000
    findings = spark.createDataFrame([(day + i, "same thing") for i in range(6)], "created_ms bigint, finding string")
    first = "L-20231114-same-thing"
    taken = spark.createDataFrame([(first,), (f"{first}-3",), (f"{first}-4",), (f"{first}-9",), ("other",)], "id string")
    got = {r.created_ms - day: r.id for r in learnings.new_ids(findings, taken).collect()}
    assert got == {i: f"{first}-{n}" for i, n in enumerate((2, 5, 6, 7, 8, 10))}


def test_trace_places_loose_events(spark):
    trace_rows = [("s", 10, 100), ("s", 20, 90), ("s", 30, 200), ("s", 40, None), ("s", None, 50), ("s", None, 150), ("s", None, 300), ("s", None, None), ("t", None, 5)]
    df = spark.createDataFrame(trace_rows, "session string, line bigint, ts_ms bigint").withColumn("name", F.lit("n"))
    got = rows(trace.ordered(df).where("line IS NULL"), "session", "ts_ms", "sort_key")
    inf = float("inf")
    assert got == sorted([("s", 50, 9.5), ("s", 150, 25.0), ("s", 300, 30.5), ("s", None, inf), ("t", 5, inf)], key=repr)


def test_elision_keeps_both_ends(spark):
    df = spark.range(40).selectExpr("'s' session", "1 turn", "id line", "0 block", "'tool-call' kind")
    kept = timeline.elided(df)
    assert [r.line for r in kept.orderBy("line").collect()] == [*range(6), *range(34, 40)]
    assert timeline.hidden_counts(df).first().hidden == 28
    assert timeline.elided(df.where("id < 16")).count() == 16


@pytest.mark.parametrize("seed", [1, 2])
def test_agent_paths_name_every_ancestor(spark, seed):
    rng = random.Random(seed)
    above = {f"n{i}": f"n{i - 1 if i < 40 else rng.randrange(i)}" if i % 37 else None for i in range(150)} | {"lost": "nobody", "x": "y", "y": "x"}
    made = spark.createDataFrame([("s", a, p) for a, p in above.items()] + [("s", "n5", above["n5"])], "session string, agent string, parent string")
    grown = forest.grow(made)
    want = {}
    for agent in above.keys() - {"x", "y"}:
        path = [agent]
        while above.get(path[0]) in above:
            path.insert(0, above[path[0]])
        want[agent] = "/".join(path)
    assert dict(rows(forest.agent_paths(grown), "agent", "agent_path")) == want


def test_search_fields_parse_a_line_once(spark):
    from trailmarts.operators import records_a

    said = '{"type":"assistant","message":{"content":[{"type":"text","text":"Hi"},{"type":"thinking","thinking":"Hm"},{"type":"tool_use","id":"c","name":"Read","input":{"a":{"b":["x"]},"p":"y"}}]}}'
    got = '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c","content":"done"}]}}'
    lines = [("s", "main", 1, said), ("s", "main", 2, got), ("s", "main", 3, '{"type":"user","message":{"content":"Go"}}'), ("s", "main", 4, '{"type":"ai-title","aiTitle":"T"}')]
    raw = spark.createDataFrame(lines, "session string, thread string, line bigint, text string")
    fields = search.fields_a(records_a.records(raw))
    assert rows(fields, "line", "ord", "field", "text", "tool") == sorted([
        (1, 1 << 20, "assistant", "Hi", None), (1, 1, "thinking", "Hm", None), (1, 2, "tool_input", "y\nx", "Read"), (2, 0, "tool_result", "done", None),
        (3, 1 << 20, "user", "Go", None), (4, 0, "title", "T", None)], key=repr)
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
