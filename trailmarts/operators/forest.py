"""Delegation trees: linking, status, depth, subtree totals, spans, workflow runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio_or_null, span_ms
from ..functions.ordered import earliest, ranged, running
from ..functions.skew import FLOOR, salted_join
from ..session import stored
from .tasks import launch_outcomes

MAIN = "main"
BLOCK_ROWS = 1 << 18  # of a forest that one task takes at a time
# What is added up over subtrees, and how.
SUMS = {
    "nodes": np.add, "subtree_tokens": np.add, "subtree_cost": np.add, "subtree_complete": np.logical_and, "start_ms": np.minimum, "end_ms": np.maximum}
NO_EFFECT = {np.add: 0, np.logical_and: True, np.minimum: (1 << 63) - 1, np.maximum: -(1 << 63)}
DEAD = "(?i)error|fail|cancel|kill"


def link_threads(threads: DataFrame, calls: DataFrame, result_agents: DataFrame) -> DataFrame:
    """Give each subagent its launching call and the thread that issued it.

    ``threads`` has session, agent and tool_use_id (from the side file, may be
    NULL); ``result_agents`` has session, agent, call_id, line of results that
    name the agent they started. A thread without a known launcher, or that
    would be its own parent, hangs below the main thread.
    """
    named = earliest(result_agents, ["session", "agent"], [F.col("line")], ["call_id"]).withColumnRenamed("call_id", "__recovered")
    owned = calls.select(
        "session", F.col("call_id").alias("tool_use_id"), F.col("thread").alias("__owner"), F.col("line").alias("launch_line"),
        F.col("ts_ms").alias("launched_ms"), "has_result", "is_error", F.col("result_chars").alias("__chars"),
    )
    linked = (
        threads.join(named, ["session", "agent"], "left")
        .withColumn("tool_use_id", F.coalesce("tool_use_id", "__recovered")).drop("__recovered")
        .join(owned, ["session", "tool_use_id"], "left")
    )
    return linked.withColumns({
        "spawned_by": F.coalesce("__owner", F.lit(MAIN)),
        "parent": F.when((F.col("__owner") != MAIN) & (F.col("__owner") != F.col("agent")), F.col("__owner")),
    }).drop("__owner")


def thread_status(linked: DataFrame, launched: DataFrame, notes: DataFrame, runs: DataFrame, run_agents: DataFrame) -> DataFrame:
    """Completed, failed or unresolved, by the strongest evidence at hand.

    Order: result of a synchronous call; last notification of an asynchronous
    launch, then the thread's own rest state; for members of a workflow run
    the run's progress entry, a dead run, and the rest state below a completed run.
    """
    outcome = launch_outcomes(launched.where("kind = 'agent'"), notes)
    outcome = outcome.groupBy("session", F.col("thread").alias("spawned_by"), F.col("call_id").alias("tool_use_id")).agg(
        F.min_by("status", "line").alias("__note"), F.lit(True).alias("__async")
    )
    progress = run_agents.select("session", "run_id", "agent", "state")
    states = runs.select("session", "run_id", F.col("status").alias("__run"))
    joined = (
        linked.join(outcome, ["session", "spawned_by", "tool_use_id"], "left")
        .join(progress, ["session", "run_id", "agent"], "left").join(states, ["session", "run_id"], "left")
    )
    rest = F.coalesce("ends_at_rest", F.lit(False))
    is_async = F.coalesce("__async", F.lit(False))
    launch = (
        F.when(F.col("tool_use_id").isNull(), F.lit("unresolved"))
        .when(is_async & F.col("__note").isin("completed", "failed"), F.col("__note"))
        .when(is_async, F.when(rest, F.lit("completed")).otherwise(F.lit("unresolved")))
        .when(~F.coalesce("has_result", F.lit(False)), F.lit("unresolved"))
        .when(F.col("is_error"), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    by_state = F.when(F.col("state") == "done", F.lit("completed")).when(F.col("state").rlike(DEAD), F.lit("failed"))
    step1 = joined.withColumn("__s1", F.when(F.col("run_id").isNotNull(), F.coalesce(by_state, launch)).otherwise(launch))
    dead_run = F.col("run_id").isNotNull() & F.coalesce(F.col("__run").rlike(DEAD), F.lit(False))
    step2 = step1.withColumn("__s2", F.when(dead_run & (F.col("__s1") != "completed"), F.lit("failed")).otherwise(F.col("__s1")))
    orphan = F.col("run_id").isNotNull() & (F.col("__s2") == "unresolved") & F.coalesce(F.col("__run") == "completed", F.lit(False))
    return step2.withColumns({
        "status": F.when(orphan, F.when(rest, F.lit("completed")).otherwise(F.lit("failed"))).otherwise(F.col("__s2")),
        "async_launch": is_async,
        "returned_chars": F.when(~is_async & F.coalesce("has_result", F.lit(False)), F.col("__chars")),
    }).drop("__s1", "__s2", "__note", "__async", "__run", "__chars", "state")


@dataclass(frozen=True)
class Forest:
    """Nodes with ``root``, ``depth`` and ``above`` (the parent, NULL for a root), and the jumps that found them.

    ``jumps[k]`` has session, agent, up: the ancestor exactly ``2 ** k`` levels up, for every node that has one.

    A forest of more than ``BLOCK_ROWS`` nodes is cut into blocks: ``placed`` are
    its nodes with ``__block`` and ``__tree``, the highest ancestor within the block.
    ``links`` names for every such tree that hangs on another block the node that
    it hangs on (``up``) and that one's tree (``above``), and the jumps go from tree to tree.
    """

    nodes: DataFrame
    jumps: tuple[DataFrame, ...]
    placed: DataFrame | None = None
    links: DataFrame | None = None


def _parents(block: pd.DataFrame, up: str) -> np.ndarray:
    """The row of each row's parent within the block, or -1."""
    at = pd.Index(block["session"] + "\0" + block["agent"])
    return at.get_indexer((block["session"] + "\0" + block[up]).where(block[up].notna(), ""))


def _rounds(jump: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that still have an ancestor 1, 2, 4, … levels up, and its row; what is on or below a ring stays to the end."""
    for _ in range(len(jump).bit_length() + 1):
        rows = np.flatnonzero(jump >= 0)
        if not len(rows):
            return
        yield rows, jump[rows]
        jump = np.where(jump >= 0, jump[jump], -1)


def _trees(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The highest ancestor of each node within its block and the levels between; none on or below a ring."""
    block = pd.concat(list(blocks), ignore_index=True)
    if len(block):
        parent = _parents(block, "up")
        top, deep = np.where(parent < 0, np.arange(len(parent)), parent), (parent >= 0).astype(np.int64)
        for _ in range(len(parent).bit_length()):
            top, deep = top[top], deep + deep[top]
        yield block.assign(tree=np.where(parent[top] < 0, block["agent"].to_numpy()[top], None), deep=deep)


def _within(block: pd.DataFrame) -> np.ndarray:
    return np.where(block["agent"] == block["__tree"], -1, _parents(block, "above"))


def _block_sums(block: pd.DataFrame) -> pd.DataFrame:
    """Sums of each node with its descendants in the block. A value that is not known has no effect, and ``__known`` of it is false."""
    out, parent = block[["session", "agent"]].copy(), _within(block)
    for name, put in SUMS.items():
        values, known = block[name].to_numpy().copy(), block[f"__known_{name}"].to_numpy().copy()
        for rows, above in _rounds(parent):
            put.at(values, above, values[rows])
            np.logical_or.at(known, above, known[rows])
        out[name] = values
        out[f"__known_{name}"] = known
    return out


def _block_places(block: pd.DataFrame) -> pd.DataFrame:
    """Offsets added up from the top of each node's tree."""
    place = block["place"].to_numpy().copy()
    for rows, above in _rounds(_within(block)):
        place[rows] = place[rows] + place[above]
    return block.assign(place=place)


def _block_paths(block: pd.DataFrame) -> pd.DataFrame:
    """Ids from the top of each node's tree down to it."""
    parent, paths = _within(block), block["agent"].tolist()
    for i in np.argsort(block["depth"].to_numpy(), kind="stable"):
        if parent[i] >= 0:
            paths[i] = f"{paths[parent[i]]}/{paths[i]}"
    return block.assign(agent_path=paths)


def _to_ancestors(jump: DataFrame, above: DataFrame, many: bool) -> DataFrame:
    """``jump`` with the values of each row's ancestor; a busy ancestor is spread over tasks.

    Without ``many`` rows no key can pass the floor of ``hot_keys``, so none is looked for.
    """
    keys = ["session", "up"]
    return salted_join(jump, above, keys, "inner", spread=F.xxhash64("agent")) if many else jump.join(above, keys)


_KEYS = "session string, agent string"


def _climb(start: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...], bool]:
    """Root and depth of all nodes that have one, the jumps, and whether some have none."""
    keys = ["session", "agent"]
    done, rest, jumps = start.where("up IS NULL"), start.where("up IS NOT NULL"), []
    left = rest.count()
    while left:
        jumps.append(rest.select(*keys, "up"))
        above = done.unionByName(rest).select(
            "session", F.col("agent").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        moved = stored(
            _to_ancestors(rest.drop("root"), above, left > FLOOR)
            .select(*keys, F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "forest",
        )
        ended = moved.where("up IS NULL").count()
        if not ended:
            # Only cycles are left; what hangs on them has no root and takes no part in the jumps.
            break
        done, rest, left = done.unionByName(moved.where("up IS NULL")), moved.where("up IS NOT NULL"), left - ended
    reached = done.select(*keys, "root", F.col("depth").cast("int").alias("depth"))
    if left:
        reached = stored(reached, "forest")
        jumps = [j.join(reached.select(*keys), keys, "left_semi") for j in jumps]
    return reached, tuple(jumps), left > 0


def grow(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> Forest:
    """Root, depth and parent of the nodes of a forest; of a node with several rows the smallest parent counts.

    Each node points to an ancestor and a round moves the pointer to that
    ancestor's own, so distances double: a forest of depth d takes about log2(d)
    rounds with one narrow row a node, each written to the shared folder. In
    round k the nodes of depth 2^(k-1) to 2^k - 1 get their root. A deeper node
    has ancestors of all lesser depths, so a round that ends none leaves only nodes
    on or below a cycle; they drop out and ``unreached`` lists them. A node
    whose parent is unknown is a root.

    More than ``block_rows`` nodes are first ranged by session, start and id into
    blocks of about that many. A task follows the parents within its block, and
    only the trees whose top hangs on another block take part in the rounds:
    few where children start soon after their parents, at worst most of the nodes.
    """
    keys = ["session", "agent"]
    ids = nodes.select("session", F.col("agent").alias("parent"), F.lit(True).alias("__known")).distinct()
    begun = F.min("start_ms") if "start_ms" in nodes.columns else F.lit(None)
    start = stored(
        nodes.groupBy(*keys).agg(F.min("parent").alias("parent"), begun.cast("bigint").alias("at")).join(ids, ["session", "parent"], "left")
        .select(*keys, F.when(F.col("__known"), F.col("parent")).alias("up"), "at"), "forest",
    )
    count = start.count()
    if count > block_rows:
        return _grow_in_blocks(nodes, start, -(-count // block_rows))
    reached, jumps, _ = _climb(start.select(*keys, "up", F.when(F.col("up").isNull(), F.col("agent")).alias("root"), F.col("up").isNotNull().cast("bigint").alias("depth")))
    parents = start.select(*keys, F.col("up").alias("above"))
    return Forest(nodes.drop("root", "depth", "above").join(reached, keys).join(parents, keys), jumps)


def _grow_in_blocks(nodes: DataFrame, start: DataFrame, blocks: int) -> Forest:
    keys = ["session", "agent"]
    dealt = start.repartitionByRange(blocks, "session", "at", "agent").drop("at").withColumn("__block", F.spark_partition_id())
    local = stored(dealt.mapInPandas(_trees, "session string, agent string, up string, __block int, tree string, deep bigint"), "blocks")
    heads = stored(local.where("tree = agent AND up IS NOT NULL").select("session", "tree", "up"), "heads")
    on = local.select("session", F.col("agent").alias("up"), F.col("tree").alias("above"), "deep")
    # A tree that hangs on or below a ring is made a ring of its own.
    links = stored(heads.join(on, ["session", "up"]).select("session", "tree", "up", F.coalesce("above", "tree").alias("above"), (F.col("deep") + 1).alias("deep")), "links")
    tops = links.select("session", F.col("above").alias("tree")).distinct().join(links, ["session", "tree"], "left_anti")
    first = links.select("session", F.col("tree").alias("agent"), F.col("above").alias("up"), F.lit(None).cast("string").alias("root"), F.col("deep").alias("depth"))
    roots = tops.select("session", F.col("tree").alias("agent"), F.lit(None).cast("string").alias("up"), F.col("tree").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    reached, jumps, lost = _climb(stored(first.unionByName(roots), "forest"))
    hung = reached.select("session", F.col("agent").alias("tree"), F.col("root").alias("__root"), F.col("depth").alias("__more"))
    hung = stored(links.select("session", "tree", F.lit(True).alias("__hangs")).join(hung, ["session", "tree"], "left"), "hung")
    whole = local.where("tree IS NOT NULL").join(hung, ["session", "tree"], "left").where("__hangs IS NULL OR __root IS NOT NULL")
    info = whole.select(
        *keys, F.coalesce("__root", "tree").alias("root"), (F.col("deep") + F.coalesce("__more", F.lit(0))).cast("int").alias("depth"), F.col("up").alias("above"),
        "__block", F.col("tree").alias("__tree"))
    placed = stored(nodes.drop("root", "depth", "above").join(info, keys), "placed")
    if lost:
        links = links.join(hung.where("__root IS NOT NULL").select("session", "tree"), ["session", "tree"], "left_semi")
    return Forest(placed.drop("__block", "__tree"), jumps, placed, links)


def agent_paths(forest: Forest) -> DataFrame:
    """``agent_path`` of every node: the ids from its root down to it, joined by slashes.

    After round k a node holds the last 2^k ids of its path, and puts those of
    the ancestor that its jump names in front. The paths themselves are as long
    as the forest is deep; nothing else in this module reads them.
    """
    keys = ["session", "agent"]
    if forest.placed is not None:
        own = forest.placed.select(*keys, "above", "depth", "__tree", "__block").distinct()
        inner = stored(own.groupBy("__block").applyInPandas(_block_paths, f"{_KEYS}, above string, depth int, __tree string, __block int, agent_path string"), "paths")
        hung = forest.links.join(inner.select("session", F.col("agent").alias("up"), "agent_path"), ["session", "up"])
        front = _along(hung.select("session", F.col("tree").alias("agent"), "agent_path"), forest.jumps)
        front = front.select("session", F.col("agent").alias("__tree"), F.col("agent_path").alias("front"))
        return inner.join(front, ["session", "__tree"], "left").select(*keys, F.concat_ws("/", "front", "agent_path").alias("agent_path"))
    return _along(stored(forest.nodes.select(*keys, F.col("agent").alias("agent_path")).distinct(), "paths"), forest.jumps)


def _along(paths: DataFrame, jumps: tuple[DataFrame, ...]) -> DataFrame:
    keys = ["session", "agent"]
    for jump in jumps:
        front = _to_ancestors(jump, paths.select("session", F.col("agent").alias("up"), F.col("agent_path").alias("front")), jump.count() > FLOOR)
        paths = stored(paths.join(front.select(*keys, "front"), keys, "left").select(*keys, F.concat_ws("/", "front", "agent_path").alias("agent_path")), "paths")
    return paths


def unreached(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Nodes that hang on a cycle and so have no root; none of the sums counts them."""
    lost = nodes.join(forest.nodes.select("session", "agent"), ["session", "agent"], "left_anti")
    return lost.select("session", "agent", "parent", F.lit("on or below a cycle of parents").alias("reason"))


def subtree_totals(forest: Forest) -> DataFrame:
    """Tokens, cost, size, span and completeness of every node with all its descendants.

    After round k a node holds the sums of its descendants less than 2^k levels
    below; each of those adds its own sums to the ancestor that its jump
    names. Partial sums combine before the shuffle, so a root with most of the
    rows stays cheap, and there is one row a node however deep the forest is.
    A node's own sums are those of all its rows; it counts as one node.
    """
    keys = ["session", "agent"]
    merged = (
        F.sum("nodes").alias("nodes"), F.sum("subtree_tokens").alias("subtree_tokens"), F.sum("subtree_cost").alias("subtree_cost"),
        F.bool_and("subtree_complete").alias("subtree_complete"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )
    sums = forest.nodes.select(*keys, *_own())
    if forest.placed is not None:
        return _totals_in_blocks(forest, merged)
    sums = _passed_up(stored(sums.groupBy(*keys).agg(*merged).withColumn("nodes", F.lit(1).cast("bigint")), "subtrees"), forest.jumps, merged)
    return sums.withColumn("span_ms", span_ms(F.col("start_ms"), F.col("end_ms"))).drop("start_ms", "end_ms")


def _own() -> list:
    return [
        F.lit(1).cast("bigint").alias("nodes"), F.col("tokens").alias("subtree_tokens"), F.coalesce("cost", F.lit(0.0)).alias("subtree_cost"),
        F.col("cost_is_complete").alias("subtree_complete"), "start_ms", "end_ms"]


def _passed_up(sums: DataFrame, jumps: tuple[DataFrame, ...], merged: tuple) -> DataFrame:
    keys = ["session", "agent"]
    for jump in jumps:
        passed = jump.join(sums, keys).drop("agent").withColumnRenamed("up", "agent")
        sums = stored(sums.unionByName(passed).groupBy(*keys).agg(*merged), "subtrees")
    return sums


def _totals_in_blocks(forest: Forest, merged: tuple) -> DataFrame:
    """Trees that hang on another block are summed whole and passed up; the node that each hangs on takes its total into the sums of its own block."""
    keys, at = ["session", "agent"], ["above", "__tree", "__block"]
    own = stored(forest.placed.select(*keys, *at, *_own()).groupBy(*keys, *at).agg(*merged).withColumn("nodes", F.lit(1).cast("bigint")), "subtrees")
    tree = own.drop("agent").withColumnRenamed("__tree", "agent").join(forest.links.select("session", F.col("tree").alias("agent")), keys, "left_semi")
    whole = _passed_up(stored(tree.groupBy(*keys).agg(*merged), "subtrees"), forest.jumps, merged)
    hung = whole.withColumnRenamed("agent", "tree").join(forest.links.select("session", "tree", "up"), ["session", "tree"])
    extra = hung.drop("agent").withColumnRenamed("up", "agent").groupBy(*keys).agg(*merged)
    extra = stored(extra.select(*keys, *(F.col(n).alias(f"__{n}") for n in SUMS)), "subtrees")
    joint = {
        np.add: lambda a, b: F.coalesce(a + b, a, b), np.logical_and: lambda a, b: F.coalesce(a & b, a, b), np.minimum: F.least, np.maximum: F.greatest}
    full = own.join(extra, keys, "left").select(*keys, *at, *(joint[how](F.col(n), F.col(f"__{n}")).alias(n) for n, how in SUMS.items()))
    types = dict(full.dtypes)
    full = full.select(
        *keys, *at, *(F.coalesce(n, F.lit(NO_EFFECT[how]).cast(types[n])).alias(n) for n, how in SUMS.items()), *(F.col(n).isNotNull().alias(f"__known_{n}") for n in SUMS))
    made = ", ".join([_KEYS, *(f"{n} {types[n]}, __known_{n} boolean" for n in SUMS)])
    sums = full.groupBy("__block").applyInPandas(_block_sums, made)
    sums = stored(sums.select(*keys, *(F.when(F.col(f"__known_{n}"), F.col(n)).alias(n) for n in SUMS)), "subtrees")
    return sums.withColumn("span_ms", span_ms(F.col("start_ms"), F.col("end_ms"))).drop("start_ms", "end_ms")


def tree_rows(forest: Forest, totals: DataFrame) -> DataFrame:
    """Rows of the flattened tree in pre-order: ``place`` from 0 in a session, depth, subtree size, and whether a node is the last of its siblings by start.

    A node comes one row after its parent and the subtrees of its earlier
    siblings; these offsets are added up along the jumps. Its subtree fills the
    places from ``place`` to ``place + nodes - 1``. Siblings are summed in
    ranges of rows, so one node may have most of the others as children.
    """
    keys = ["session", "agent"]
    family = F.coalesce(F.concat(F.lit("/"), "above"), F.lit(""))
    blocks = forest.placed is not None
    at = ["__tree", "__block"] if blocks else []
    each = (forest.placed if blocks else forest.nodes).groupBy(*keys, "root", "depth", "above", *at).agg(F.min("start_ms").alias("start_ms"))
    sized = each.withColumns({"__family": family, "__at": F.coalesce("start_ms", F.lit(0)).cast("bigint")}).join(totals.select(*keys, "nodes"), keys)
    sized = ranged(sized, ["session", "__family"], ["__at", "agent"], "__range")
    last = sized.groupBy("session", "__family").agg(F.max(F.struct("__at", "agent")).alias("__last"))
    placed = running(sized, ["session", "__family"], "__at", {"__upto": ("sum", F.col("nodes"))}, ties=["agent"], chunk=F.col("__range"))
    offset = F.col("__upto") - F.col("nodes") + F.col("above").isNotNull().cast("bigint")
    if blocks:
        unknown = F.lit(-(1 << 63))
        shown = placed.select(*keys, "root", "above", "depth", "nodes", F.coalesce("start_ms", unknown).alias("start_ms"), "__family", *at, offset.alias("place"))
        inner = stored(shown.groupBy("__block").applyInPandas(_block_places, shown.schema).withColumn("start_ms", F.nullif("start_ms", unknown)), "places")
        hung = forest.links.join(inner.select("session", F.col("agent").alias("up"), "place"), ["session", "up"])
        base = _places_along(stored(hung.select("session", F.col("tree").alias("agent"), "place"), "places"), forest.jumps)
        base = base.select("session", F.col("agent").alias("__tree"), F.col("place").alias("__base"))
        whole = inner.join(base, ["session", "__tree"], "left").withColumn("place", F.col("place") + F.coalesce("__base", F.lit(0)))
    else:
        places = _places_along(stored(placed.select(*keys, offset.alias("place")), "places"), forest.jumps)
        whole = sized.join(places, keys)
    return whole.join(last, ["session", "__family"]).select(
        *keys, "root", "above", "depth", "place", "nodes", "start_ms", (F.col("__last")["agent"] == F.col("agent")).alias("is_last"))


def _places_along(places: DataFrame, jumps: tuple[DataFrame, ...]) -> DataFrame:
    keys = ["session", "agent"]
    for jump in jumps:
        more = _to_ancestors(jump, places.select("session", F.col("agent").alias("up"), F.col("place").alias("more")), jump.count() > FLOOR)
        places = stored(
            places.join(more.select(*keys, "more"), keys, "left").select(*keys, (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "places")
    return places


def shares(forest: Forest, totals: DataFrame) -> DataFrame:
    """Cost of each subtree as a share of its parent's subtree and of the session."""
    parent = totals.select("session", F.col("agent").alias("above"), F.col("subtree_cost").alias("__parent_cost"))
    whole = totals.join(forest.nodes.where("depth = 0").select("session", "agent"), ["session", "agent"], "left_semi")
    whole = whole.groupBy("session").agg(F.sum("subtree_cost").alias("__total"))
    return (
        forest.nodes.select("session", "agent", "depth", "above").join(totals, ["session", "agent"])
        .join(parent, ["session", "above"], "left").join(whole, "session")
        .select(
            "session", "agent", "depth", "subtree_cost",
            ratio_or_null(F.col("subtree_cost"), F.coalesce("__parent_cost", "__total")).alias("parent_share"),
            ratio_or_null(F.col("subtree_cost"), F.col("__total")).alias("total_share"),
        )
    )


def spans(nodes: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Start offset and length of agents and background tasks relative to their session, in percent of it."""
    agents = nodes.select("session", F.lit("agent").alias("lane"), F.col("agent").alias("id"), "start_ms", "end_ms")
    background = tasks.where("background").select(
        "session", F.lit("task").alias("lane"), F.col("task_id").alias("id"), F.col("start_ts_ms").alias("start_ms"), F.col("end_ts_ms").alias("end_ms")
    )
    bounds = sessions.select("session", F.col("first_ts_ms").alias("__from"), F.col("last_ts_ms").alias("__to"))
    length = F.col("__to") - F.col("__from")
    return agents.unionByName(background).join(bounds, "session").where("start_ms IS NOT NULL").select(
        "session", "lane", "id", (F.col("start_ms") - F.col("__from")).alias("offset_ms"), span_ms(F.col("start_ms"), F.col("end_ms")).alias("duration_ms"),
        F.when(length > 0, (F.col("start_ms") - F.col("__from")) / length * 100).alias("left_pct"),
        F.when(length > 0, span_ms(F.col("start_ms"), F.coalesce("end_ms", "__to")) / length * 100).alias("width_pct"),
    )


def return_stats(linked: DataFrame) -> DataFrame:
    """Number, total and largest size of the results subagents handed back."""
    return linked.where("returned_chars IS NOT NULL").groupBy("session").agg(
        F.count(F.lit(1)).alias("returns"), F.sum("returned_chars").alias("total_chars"), F.max("returned_chars").alias("max_chars")
    )


def display_name(label, description, prompt, agent_type, agent):
    """Label, description, first prompt line cut to 48, type, or the id of a node."""
    first = F.substring_index(F.trim(prompt), "\n", 1)
    cut = F.when(F.length(first) > 48, F.concat(F.substring(first, 1, 48), F.lit("…"))).otherwise(first)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (label, description, cut, agent_type)], agent)


def workflow_runs(runs: DataFrame, calls: DataFrame, threads: DataFrame) -> DataFrame:
    """Known runs, and runs seen only as agent folders, with their launching call and agent count."""
    agents = threads.where("run_id IS NOT NULL").groupBy("session", "run_id").agg(F.count(F.lit(1)).alias("agents"))
    explicit = F.nullif(F.regexp_extract("result_text", r"Run ID:\s*(\S+)", 1), F.lit(""))
    by_path = F.nullif(F.regexp_extract("result_text", r"subagents/workflows/([^/\s]+)", 1), F.lit(""))
    launched = earliest(
        calls.where("tool = 'Workflow' AND thread = 'main'").withColumn("run_id", F.coalesce(explicit, by_path)).where("run_id IS NOT NULL"),
        ["session", "run_id"], [F.col("line")], ["call_id", "line", "result_text"],
    ).select("session", "run_id", F.col("call_id").alias("launch_call"), F.col("line").alias("launch_line"), "result_text")
    known = runs.select("session", "run_id", "name", "status", "duration_ms")
    unseen = agents.join(known.select("session", "run_id"), ["session", "run_id"], "left_anti").select("session", "run_id")
    every = known.withColumn("synthesized", F.lit(False)).unionByName(
        unseen.withColumn("synthesized", F.lit(True)), allowMissingColumns=True)
    script = F.nullif(F.regexp_extract("result_text", r"([\w-]+)-wf_[a-z0-9-]+\.js", 1), F.lit(""))
    return (
        every.join(agents, ["session", "run_id"], "left").join(launched, ["session", "run_id"], "left")
        .withColumns({"agents": F.coalesce("agents", F.lit(0)), "name": F.when(F.col("synthesized"), script).otherwise(F.col("name"))})
        .drop("result_text")
    )


def run_rollup(forest: Forest, totals: DataFrame, runs: DataFrame) -> DataFrame:
    """Agents, tokens, cost and span of each run over its members and their descendants."""
    members = forest.nodes.where("depth = 0 AND run_id IS NOT NULL").select("session", "agent", "run_id")
    sums = members.join(totals, ["session", "agent"]).groupBy("session", "run_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum("subtree_tokens").alias("tokens"), F.sum("subtree_cost").alias("cost"),
        F.bool_and("subtree_complete").alias("cost_is_complete"),
    )
    # First the span of each tree, map-side, then one row a root meets its run.
    trees = forest.nodes.groupBy("session", F.col("root").alias("agent")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    span = trees.join(members, ["session", "agent"]).groupBy("session", "run_id").agg(span_ms(F.min("start_ms"), F.max("end_ms")).alias("__span"))
    return sums.join(span, ["session", "run_id"]).join(runs.select("session", "run_id", "duration_ms"), ["session", "run_id"], "left").select(
        "session", "run_id", "members", "tokens", "cost", "cost_is_complete", F.coalesce("__span", "duration_ms").alias("duration_ms")
    )


def phase_groups(forest: Forest, totals: DataFrame) -> DataFrame:
    members = forest.nodes.where("depth = 0 AND run_id IS NOT NULL").select("session", "agent", "run_id", "phase")
    return members.join(totals, ["session", "agent"]).groupBy("session", "run_id", "phase").agg(
        F.count(F.lit(1)).alias("members"), F.sum("subtree_tokens").alias("tokens"), F.sum("subtree_cost").alias("cost")
    )


def hide_attached(sessions: DataFrame) -> DataFrame:
    """Drop subagent sessions whose parent session is known; orphans stay."""
    parents = sessions.select(F.col("session").alias("parent_session"))
    return sessions.join(parents.distinct(), "parent_session", "left_anti")
