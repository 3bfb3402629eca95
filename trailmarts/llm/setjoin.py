"""Exact Jaccard join of shingle sets by set-relation skipping, and its components.

A document is the set of its distinct shingles of words, as sorted 64-bit
hashes; equal sets are one set. Sets meet in cells, and a cell joins its sets:

* **Index lists skipped by position.** Shingles are ordered by how rare they are
  in the cell. The first shingles of a set, as many as any set linked with it
  must share one of, are indexed by (shingle, position). From a set's own
  position follow the last position and the sizes that can still reach the
  threshold, so whole blocks of a list are left out unread.
* **Answers derived from answers.** A set whose candidates are all connected with
  it already is not compared at all. Otherwise the overlaps of the first set of
  a component with all sets of the cell are summed from its lists, and those of
  a set found similar to it are that answer plus the lists of the shingles it
  has more, less the lists of those it lacks.

Which sets meet: the hash range is cut into more parts than a linked pair can
differ in shingles, so such a pair agrees on a whole part that is not empty (a
set with too many empty parts also shows those). Sets that share the hash of a
part are joined to groups. Parts hold several shingles, so a common passage does
not bind unrelated documents. Only sets in groups are read again; a group of
more than ``CELL`` shingles is cut into chunks. Each chunk is joined by itself,
then the first sets of the components found, and then only sets outside a
group's largest component meet the other chunks, so a large group of near copies
costs as much as its rows.

Defined results: null and empty texts have no shingles and are linked with
nothing, not even with each other; rows without id get the smallest id of their
component, null if it has none; rows that share an id are kept each on its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmarts.functions.skew import salted_join
from trailmarts.session import stored

from .common import slices, small_batches, utf8
from .simhash import Forest, components

WORDS = 3
SHARE = (90, 100)  # of the union that two sets share at least
SLACK = 2  # parts beyond those needed: that many may be empty
CELL = 2_000_000  # shingles of a cell
LEAST_WEIGHT = 500  # shingles that a set counts for at least, so a cell has CELL / LEAST_WEIGHT sets at most
GROUP_ROWS = 500  # rows from which a set counts as hot when rows get their component
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of fewer words one."""
    parts = utf8(text).lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    plain = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(plain)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return np.unique(np.array([digest(plain[a:b]) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


class Rule:
    """What follows from the threshold, in whole numbers."""

    def __init__(self, share: tuple[int, int] = SHARE):
        self.num, self.den = share
        self.edges = [1]  # sizes are cut into classes that grow by half, or more so that linked sets are in neighbouring ones

    def linked(self, overlap, a, b):
        return (self.num + self.den) * overlap >= self.num * (a + b)

    def firsts(self, n):
        """How many first shingles of a set of size ``n`` a linked set must share one of."""
        return n + (-self.num * n) // self.den + 1

    def _edge(self, k: int) -> int:
        while len(self.edges) <= k:
            last = self.edges[-1]
            self.edges.append(max(last + 1, last * 3 // 2, -(-last * self.den // self.num)))
        return self.edges[k]

    def classes(self, n: int) -> list[int]:
        """Of a size: its own class, and the one below if a smaller set of that may be linked."""
        while self._edge(len(self.edges) - 1) <= n:
            self._edge(len(self.edges))
        own = bisect_right(self.edges, n) - 1
        return [own, own - 1] if own and (self.edges[own] - 1) * self.den >= self.num * n else [own]

    def differing(self, k: int) -> int:
        """In how many shingles linked sets of class ``k`` differ at most."""
        small = self._edge(k + 1) - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """One hash for each part of the set, so that linked but unequal sets share one."""
        found = []
        for k in self.classes(len(hashes)) if len(hashes) else []:
            differ = self.differing(k)
            if not differ:
                continue  # linked sets of this class are equal
            parts = differ + 1 + SLACK
            part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # rises with the hash
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            tag = _mixed(part[first] + np.uint64(k << 40))
            found.append(_mixed(np.add.reduceat(_mixed(hashes), first) ^ tag))
            if parts - len(first) >= parts - differ:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                found.append(_mixed(empty + np.uint64(k << 40) + _MIX[0]))
        return np.concatenate(found) if found else np.empty(0, np.uint64)


class Cell:
    """The sets of a cell: shingles as ranks (rare ones first), lists of each shingle, blocks of the first shingles."""

    def __init__(self, sets: list[np.ndarray], rule: Rule):
        self.rule, self.n = rule, np.array([len(s) for s in sets], np.int64)
        edges = np.concatenate([[0], np.cumsum(self.n)])
        _, code, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        ranks = rank[code]
        owner = np.repeat(np.arange(len(sets)), self.n)
        ranks = ranks[np.lexsort([ranks, owner])]
        self.sets = [ranks[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        alone = int((times == 1).sum())  # ranks below have no list
        self.alone = alone
        order = np.argsort(ranks, kind="stable")
        order = order[int(np.searchsorted(ranks[order], alone)):]
        self.members = owner[order]
        self.lists = np.searchsorted(ranks[order], np.arange(alone, len(times) + 1))
        position = np.arange(len(ranks)) - edges[owner]
        leads = (position < rule.firsts(self.n)[owner]) & (ranks >= alone)
        self.span = int(self.n.max(initial=0)) + 1
        key = ranks[leads] * self.span + position[leads]
        by_block = np.argsort(key, kind="stable")
        self.blocks, self.block_sets = key[by_block], owner[leads][by_block]

    def _gathered(self, start: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
        n = end - start
        return of[np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] if len(n) else of[:0]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share one of ``x``'s first shingles where the threshold is still within reach."""
        rule, n, own = self.rule, int(self.n[x]), self.sets[x]
        i = np.arange(int(rule.firsts(n)))
        own = own[:len(i)]
        i, own = i[own >= self.alone], own[own >= self.alone]
        most = (n - i) * (rule.num + rule.den) // rule.num - n  # the largest set that can still be linked
        last = (most * rule.den - rule.num * n) // (rule.num + rule.den)  # and the last position it may have
        wanted = last >= 0
        low = own[wanted] * self.span
        start = np.searchsorted(self.blocks, low, "left")
        end = np.searchsorted(self.blocks, low + np.minimum(last[wanted], self.span - 1), "right")
        found = self._gathered(start, end, self.block_sets)
        limit = np.repeat(most[wanted], end - start)
        size = self.n[found]
        found = found[(size <= limit) & (size * rule.den >= rule.num * n)]
        return np.unique(found[found != x])

    def _sum(self, shingles: np.ndarray) -> np.ndarray:
        at = shingles[shingles >= self.alone] - self.alone
        return np.bincount(self._gathered(self.lists[at], self.lists[at + 1], self.members), minlength=len(self.n))

    def join(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what all links connect; only between sets of unlike ``side``, if given."""
        kept: list[tuple[int, int]] = []
        forest, done = Forest(len(self.n)), np.zeros(len(self.n), bool)

        def open_to(x: int) -> np.ndarray:
            found = self.candidates(x)
            if side is not None:
                found = found[side[found] != side[x]]
            return found[forest.roots(found) != forest.roots(np.array([x]))] if len(found) else found

        def answers(x: int, found: np.ndarray, overlap: np.ndarray) -> np.ndarray:
            near = found[self.rule.linked(overlap[found], self.n[x], self.n[found])]
            kept.extend(forest.join(np.full(len(near), x), near))
            return near

        for base in range(len(self.n)):
            if done[base]:
                continue
            done[base] = True
            found = open_to(base)
            if not len(found):
                continue
            known = self._sum(self.sets[base])
            for x in answers(base, found, known).tolist():
                if done[x]:
                    continue
                done[x] = True
                found = open_to(x)
                if len(found):
                    more = np.setdiff1d(self.sets[x], self.sets[base], True)
                    less = np.setdiff1d(self.sets[base], self.sets[x], True)
                    answers(x, found, known + self._sum(more) - self._sum(less))
        return kept


def document_sets(documents: DataFrame, rule: Rule, seed: int = 0, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, t, s, check, n, parts): hash of the text, two hashes of the set, its size and its signatures."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingle_set(r[1], words) for r in rows]
            two = [np.array([xxhash.xxh64_intdigest(s.tobytes(), 2 * seed + i) for s in sets], np.uint64).view(np.int64) for i in (0, 1)]
            parts = [rule.signatures(s) for s in sets]
            edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(two[0]), pa.array(two[1]), pa.array([len(s) for s in sets], pa.int64()), listed],
                names=["doc_id", "t", "s", "check", "n", "parts"])

    rows = _texts(documents, doc_id, text)
    return rows.mapInArrow(run, "doc_id long, t long, s long, check long, n long, parts array<long>")


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("t"))


def _groups(parts: DataFrame) -> DataFrame:
    """(s, group): sets that share a signature, directly or over others. ``parts``: (s, parts), sets distinct."""
    dealt = parts.select("s", F.explode("parts").alias("part")).repartition("part")
    heads = dealt.groupBy("part").agg(F.min("s").alias("head"), F.max("s").alias("tail")).where("head < tail").select("part", "head")
    edges = dealt.join(heads, "part").where("s <> head").select(F.col("s").alias("a"), F.col("head").alias("b")).distinct()
    return components(edges).toDF("s", "group")


def _joined(dealt: DataFrame, rule: Rule, words: int) -> DataFrame:
    """(a, b): links within cells. ``dealt``: (cell, s, asks, text); where ``asks`` is null, all sets of the cell are compared."""

    def search(part: pa.Table) -> pa.Table:
        names = part.column("s").to_numpy()
        asks = part.column("asks").to_pylist()
        cell = Cell([shingle_set(t, words) for t in part.column("text").to_pylist()], rule)
        pairs = np.array(cell.join(np.array(asks, bool) if asks and asks[0] is not None else None), np.int64).reshape(-1, 2)
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return dealt.select("cell", "s", "asks", "text").groupBy("cell").applyInArrow(search, "a long, b long")


def links(documents: DataFrame, sets: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, cell: int = CELL) -> DataFrame:
    """(a, b): links between sets that connect what all links connect. ``sets``: (s, first, t, n, parts), distinct, where (first, t) names a row that has the set."""
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))
    members = stored(_groups(sets.select("s", "parts")).join(sets.drop("parts"), "s"), "set-groups")
    sizes = stored(members.groupBy("group").agg(F.sum(weight).alias("weight")), "group-sizes")
    rooms = max(1, -(-(sizes.agg(F.sum("weight")).first()[0] or 0) // cell))
    chunks = F.ceil(F.col("weight") / cell).cast("int")
    placed = members.join(sizes.withColumn("chunks", chunks), "group").withColumn("chunk", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int"))
    placed = placed.select(F.col("first").alias("p_first"), F.col("t").alias("p_t"), "s", "n", "group", "weight", "chunks", "chunk")
    body = _texts(documents, doc_id, text)
    found = body.join(placed, body["doc_id"].eqNullSafe(placed["p_first"]) & (body["t"] == placed["p_t"]))
    # repeated rows with one id and text: one is enough
    whole = stored(found.groupBy("s", "n", "group", "weight", "chunks", "chunk").agg(F.min("text").alias("text")), "set-texts")
    own = F.when(F.col("weight") * 16 <= cell, F.pmod(F.xxhash64("group"), F.lit(rooms))).otherwise(F.xxhash64("group", "chunk"))
    edges = stored(_joined(whole.withColumn("cell", own).withColumn("asks", F.lit(None).cast("boolean")), rule, words), "set-links")
    large = whole.where("chunks > 1")
    if not large.limit(1).count():
        return edges

    def labelled() -> DataFrame:
        """Large groups' sets with the component known so far."""
        now = components(edges).toDF("c_s", "c_root")
        return large.join(now, F.col("s") == F.col("c_s"), "left").withColumn("root", F.coalesce("c_root", "s")).drop("c_s", "c_root")

    # the first sets of the components of all chunks, against each other
    firsts = stored(labelled().groupBy("group", "chunk", "root").agg(F.min_by(F.struct("s", "n", "text"), "s").alias("x")).select("group", "x.*"), "set-firsts")
    total = firsts.groupBy("group").agg(F.ceil(F.sum(weight) / cell).cast("int").alias("pieces"), F.count(F.lit(1)).alias("many")).where("many > 1")
    again = firsts.join(total, "group").withColumn("cell", F.xxhash64("group", F.pmod(F.xxhash64("s", F.lit("first")), F.col("pieces"))))
    edges = edges.union(stored(_joined(again.withColumn("asks", F.lit(None).cast("boolean")), rule, words), "set-links"))
    # whatever is outside the largest component, against the other chunks of its group
    state = stored(labelled(), "set-states")
    of_root = state.groupBy("group", "root").agg(F.sum(weight).alias("heavy"))
    largest = of_root.groupBy("group").agg(F.max_by("root", F.struct("heavy", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    open_sets = state.join(largest, "group")
    asking = open_sets.where("root <> largest")
    rest = asking.groupBy("group").agg(F.ceil(F.sum(weight) / cell).cast("int").alias("turns"))
    sides = [F.xxhash64("group", "turn", "other").alias("cell"), "s", "asks", "text"]
    asks = asking.join(rest, "group").withColumn("turn", F.pmod(F.xxhash64("s", F.lit("ask")), F.col("turns")).cast("int"))
    asks = asks.withColumn("asks", F.lit(True)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    told = open_sets.join(rest, "group").withColumn("asks", F.lit(False)).withColumn("other", F.col("chunk")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    return edges.union(stored(_joined(asks.select(*sides).union(told.select(*sides)), rule, words), "set-links"))


def joined(documents: DataFrame, share: tuple[int, int] = SHARE, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that is reachable by links."""
    rule, seed = Rule(share), 0
    while True:
        rows = stored(document_sets(documents, rule, seed, doc_id, text, words), "document-sets")
        row = F.min(F.struct("doc_id", "t")).alias("row")
        sets = rows.where("n > 0").groupBy("s").agg(row, F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("parts").alias("parts"))
        sets = stored(sets.select("s", F.col("row.doc_id").alias("first"), F.col("row.t").alias("t"), "least", "n", "parts", (F.col("c1") != F.col("c2")).alias("mixed")), "sets")
        if not sets.where("mixed").limit(1).count():
            break
        seed += 1  # two sets had one hash: take other hashes
    roots = stored(components(links(documents, sets.drop("least", "mixed"), rule, doc_id, text, words, cell)), "set-roots")
    reached = roots.join(sets.select(F.col("s").alias("node"), "least"), "node")
    least = reached.groupBy("root").agg(F.min("least").alias("lowest"))
    of_set = reached.select("node", "root").join(least, "root").select(F.col("node").alias("s"), "lowest")
    final = sets.select("s", "least").join(of_set, "s", "left").select("s", F.coalesce("lowest", "least").alias("lowest"))
    found = salted_join(rows.where("n > 0").select("doc_id", "n", "s"), final, ["s"], spread=F.xxhash64("doc_id"), floor=GROUP_ROWS)
    empty = rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("s"), F.col("doc_id").alias("lowest"))
    return found.select("doc_id", "n", "s", "lowest").union(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"))


def report(documents: DataFrame) -> DataFrame:
    return joined(documents)
