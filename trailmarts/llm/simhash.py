"""SimHash near-duplicates, searched in BK-trees.

Fingerprints have 64 bits over shingles of words. Two of them that differ in at
most r bits agree in one of r + 1 bands of bits, so a shard holds the distinct
fingerprints with one value of one band, and every link lies within a shard. A
shard that exceeds ``SHARD`` is cut into chunks; each chunk is a tree, and all
chunks of the shard meet it pairwise in tasks of their own. In a BK-tree a
child hangs on its parent by their Hamming distance, so a search within r
follows only the edges whose distance is within r of that to the node.

A task gives back a spanning forest of the links it finds, not the links.
Components of the forest edges come from alternating large-star and small-star
steps, each written to the shared folder; equal fingerprints are one node.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; rows without id get their component's smallest id, null if it has
none; rows that share an id are kept each on its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmarts.session import stored

from .common import slices, small_batches, utf8

BITS = 64
RADIUS = 3
WORDS = 3
SEED = 42
SHARD = 4096  # fingerprints of one tree
GROUP = 16384  # fingerprints that a call searches, about


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned; words are runs of anything but ASCII white space, A-Z lower-cased."""
    parts = utf8(text).lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        plain, ends, at = b" ".join(parts), [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        shingles = [plain[a:b] for a, b in zip(starts, ends[words - 1:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # so many fit a byte's sum
        counts += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns in ``keep``: the fingerprint as a signed long."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, words) for _, t, *_ in part], np.uint64).view(np.int64)
            kept = [pa.array([r[2 + i] for r in part], pa.int64()) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(found), *kept], names=["doc_id", "fp", *keep])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"`{c}` long" for c in keep)]))


class Trees:
    """BK-trees of several shards in common arrays, so that many codes go down their trees together.

    ``tree`` numbers the tree of each code from 0, in ascending order.
    """

    def __init__(self, codes: np.ndarray, tree: np.ndarray):
        self.codes, n = codes, len(codes)
        self.roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]][:n])
        self.largest = int(np.diff(np.r_[self.roots, n]).max(initial=1))
        self.kids = np.full((n, BITS + 1), -1, np.int32)  # node and distance to child, -1 if none
        parent = self.roots[tree]
        waiting = np.flatnonzero(parent != np.arange(n))
        parent = parent[waiting]
        while len(waiting):  # the first code that takes an edge stays there, the others go on down
            distance = np.bitwise_count(codes[waiting] ^ codes[parent])
            _, first = np.unique(parent * (BITS + 1) + distance, return_index=True)
            self.kids[parent[first], distance[first]] = waiting[first]
            down = np.ones(len(waiting), bool)
            down[first] = False
            parent, waiting = self.kids[parent[down], distance[down]].astype(np.int64), waiting[down]

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within ``radius``, each query in its tree, in steps of bounded size."""
        step = max(64, min(8192, (1 << 18) // self.largest))
        around = np.arange(-radius, radius + 1)
        for at in range(0, len(queries), step):
            query = np.arange(at, min(at + step, len(queries)))
            node = self.roots[tree[query]]
            while len(query):
                distance = np.bitwise_count(queries[query] ^ self.codes[node]).astype(np.int64)
                near = distance <= radius
                yield query[near], node[near]
                edge = distance[:, None] + around
                child = np.where((edge >= 0) & (edge <= BITS), self.kids[node[:, None], np.clip(edge, 0, BITS)], -1)
                row, column = np.nonzero(child >= 0)
                query, node = query[row], child[row, column].astype(np.int64)


class Forest:
    """Union-find over places; ``join`` gives back the pairs that merged two sets."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.up[xs]
        while (self.up[r] != r).any():
            r = self.up[r]
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        kept, up = [], self.up
        apart = self.roots(a) != self.roots(b)
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            i, j = x, y
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i != j:
                up[max(i, j)] = min(i, j)
                kept.append((x, y))
        return kept


def forest(nodes: np.ndarray, tree: np.ndarray, asking: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the codes of trees and the codes asking each of them, as few as connect the same sets."""
    if not len(nodes) or not len(asking):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    codes, place = np.unique(np.concatenate([nodes, asking]), return_inverse=True)
    trees, sets = Trees(nodes, tree), Forest(len(codes))
    pairs: list[tuple[int, int]] = []
    for query, node in trees.search(asking, asks, radius):
        pairs += sets.join(place[len(nodes) + query], place[node])
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return codes[found[:, 0]], codes[found[:, 1]]


def links(codes: DataFrame, radius: int = RADIUS, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(a, b): links within ``radius`` that connect what all links connect. ``codes``: distinct longs ``fp``."""
    groups = max(1, (radius + 1) * codes.count() // group)
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    banded = codes.select("fp", F.explode(F.array(*bands)).alias("key")).select("fp", "key.*")
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / shard).cast("int"))
    member = banded.join(sizes, ["band", "value"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # chunk i is the tree of cells (i, j); chunk j asks in cells (i, j), i <= j
    cells = F.sequence(F.lit(0), F.col("chunks") - 1)
    as_tree = F.transform(F.filter(cells, lambda j: j >= F.col("chunk")), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(True).alias("is_tree")))
    as_asking = F.transform(F.filter(cells, lambda i: i < F.col("chunk")), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("is_tree")))
    dealt = member.select("band", "value", "fp", "n", F.explode(F.concat(as_tree, as_asking)).alias("cell")).select("band", "value", "cell.*", "fp", "n")
    # shards far smaller than a group share one; a larger shard's cells have groups of their own
    room = F.when(F.col("n") * 16 <= group, F.pmod(F.xxhash64("band", "value"), F.lit(groups))).otherwise(F.xxhash64("band", "value", "i", "j"))

    def search(part: pa.Table) -> pa.Table:
        cell = [part.column(c).to_numpy() for c in ("band", "value", "i", "j")]
        fp = part.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort([fp, *cell[::-1]])
        cell, fp = [c[order] for c in cell], fp[order]
        is_tree = part.column("is_tree").to_numpy(zero_copy_only=False)[order]
        number = np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in cell], axis=0)])
        asks = ~is_tree | (cell[2] == cell[3])
        # a cell whose chunk of either side is empty holds no link
        both = np.isin(number, number[is_tree]) & np.isin(number, number[asks])
        tree = np.unique(number[both], return_inverse=True)[1]
        a, b = forest(fp[both & is_tree], tree[is_tree[both]], fp[both & asks], tree[asks[both]], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.withColumn("room", room).groupBy("room").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by large-star and small-star steps."""

    def pointed(pairs: DataFrame, both: bool) -> DataFrame:
        """Each pair (u, v) with the smallest neighbour m of u, u itself included."""
        sides = pairs.union(pairs.select("v", "u")) if both else pairs
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sides.join(least, "u")

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = state(now)
    while before[0]:
        large = pointed(now, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        small = pointed(large, False)
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def _reached(marked: DataFrame, order: Column, radius: int, shard: int) -> DataFrame:
    """``marked`` with ``least``: the smallest ``order`` that is reachable by links."""
    first = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "codes")
    roots = stored(components(links(first.select("fp"), radius, shard)), "roots")
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_code = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    final = first.join(of_code, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return marked.join(final, "fp")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that is reachable by links."""
    marked = stored(fingerprints(documents, doc_id, text), "fingerprints")
    return _reached(marked, F.col("doc_id"), radius, shard).select("doc_id", "fp", F.col("least").alias("component_id"))


def followers(documents: DataFrame, rank: Sequence[str], doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The last column of ``rank``, a key of the rows, of all rows but one of each component: the first by id (none comes last), then by the long columns ``rank``."""
    marked = stored(fingerprints(documents, doc_id, text, keep=rank), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *rank)
    return _reached(marked, order, radius, shard).where(F.col(rank[-1]) != F.col("least")[rank[-1]]).select(rank[-1])


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(documents: DataFrame) -> DataFrame:
    """Per document: fingerprint as 16 hexadecimal digits, component."""
    return near_duplicates(documents).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
