"""Exact top-k inner-product search by MaxScore.

A vector component is a term of a query and a posting of a candidate. Each
shard of candidates holds one posting list per component with its highest and
lowest value. For a query, the bound of a term is the most it can add; terms
are sorted by bound, and those whose bounds add up to less than the k-th best
score known are non-essential: they alone cannot lift a candidate into the
result. Essential postings are traversed, the others are probed for candidates
that can still compete. The shards' results are merged by a window per query.

Work is dealt as a grid of candidate shards and query blocks of bounded size,
so no task holds all candidates or all queries and nothing is broadcast.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without id take no part; components beyond the length of the other
vector count as zero; equal scores go to the smaller id; of rows that share an
id the one with the smallest vector stands for it; an empty table gives no
rows; other columns are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 8192
QUERY_ROWS = 2048
STEP = 256  # queries scored against a shard at once
SEED_TERMS, SEED_ROWS = 4, 16  # strongest postings of the strongest terms, scored first for a threshold

SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * component), component as double, of all usable rows."""
    xs = F.col(embedding).cast("array<double>")
    usable = F.forall("xs", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), xs.alias("xs"))
        .where(F.col("vec_id").isNotNull() & F.col("xs").isNotNull() & usable)
        .select("vec_id", F.transform("xs", lambda x: F.floor(x * scale).cast("long")).alias("terms"))
    )


def top_k(terms: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query row, itself excluded."""
    counts = terms.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(counts.n / shard_rows)), max(1, math.ceil(counts.q / query_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    candidates = terms.select("vec_id", "terms", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = terms.where(is_query).select("vec_id", "terms", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, k)

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(search, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and distinct, and their terms as rows padded with zeros."""
    lists = table.column("terms").combine_chunks()
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.zeros((len(ids), width), np.int64)
    where = np.repeat(np.arange(len(ids)), sizes)
    rows[where, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0]:offsets[-1]]
    order = np.lexsort([*rows.T[::-1], ids]) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, rows = ids[order], rows[order]
    first = np.r_[True, ids[1:] != ids[:-1]][:len(ids)]
    return ids[first], rows[first]


def _width(table: pa.Table) -> int:
    return max((len(x) for x in table.column("terms").to_pylist()), default=0)


class Shard:
    """Posting lists of one shard, dense: a component's values by candidate in id order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.postings = np.ascontiguousarray(rows.T)
        self.high = rows.max(0, initial=0)  # a candidate without the term adds nothing, hence 0 at least
        self.low = rows.min(0, initial=0)
        take = min(SEED_ROWS, len(ids))
        self.strongest = np.argpartition(-self.postings, take - 1, axis=1)[:, :take]
        self.weakest = np.argpartition(self.postings, take - 1, axis=1)[:, :take]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        return np.where(query > 0, query * self.high, query * self.low)

    def threshold(self, query: np.ndarray, order: np.ndarray, own: int, k: int):
        """The k-th best score among the strongest postings of the strongest terms; None if there are too few."""
        lead = order[::-1][:SEED_TERMS]
        rows = np.unique(np.concatenate([(self.strongest if query[t] > 0 else self.weakest)[t] for t in lead])) if len(lead) else np.empty(0, int)
        rows = rows[self.ids[rows] != own]
        return np.partition(self.rows[rows] @ query, len(rows) - k)[len(rows) - k] if len(rows) >= k else None


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        width = max(_width(left), _width(right))
        shard = Shard(*_dense(left, width))
        query_ids, queries = _dense(right, width)
        # 64-bit floats multiply faster and are exact below 2^53
        exact = width * float(np.abs(shard.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**53
        postings = shard.postings.astype(np.float64) if exact else shard.postings
        for at in range(0, len(queries), STEP):
            plans = [_split(shard, q, i, k) for i, q in zip(query_ids[at:at + STEP], queries[at:at + STEP], strict=True)]
            essential = np.array([np.where(p[0], q, 0) for p, q in zip(plans, queries[at:at + STEP], strict=True)])
            used = np.flatnonzero(essential.any(0))
            partial = essential[:, used].astype(postings.dtype) @ postings[used]
            for i, (own, query, plan) in enumerate(zip(query_ids[at:at + STEP], queries[at:at + STEP], plans, strict=True)):
                ids, scores = _probe(shard, query, own, plan, partial[i], k)
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(scores)
    arrays = [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in out]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), arrays, strict=True)))


def _split(shard: Shard, query: np.ndarray, own: int, k: int):
    """Which terms are essential; the others from the largest bound down, each with the sum of the bounds up to it; the threshold."""
    bounds = shard.bounds(query)
    order = np.argsort(bounds, kind="stable")
    order = order[bounds[order] > 0]
    threshold = shard.threshold(query, order, own, k)
    sums = np.cumsum(bounds[order])
    cut = 0 if threshold is None else int(np.searchsorted(sums, threshold, "left"))  # sums below the threshold
    essential = query != 0
    essential[order[:cut]] = False
    return essential, order[:cut][::-1], sums[:cut][::-1], threshold


def _probe(shard: Shard, query: np.ndarray, own: int, plan, partial: np.ndarray, k: int):
    _, others, sums, threshold = plan
    live = np.arange(len(shard.ids))
    score = partial.astype(np.int64)
    if threshold is not None:
        for term, rest in zip(others, sums, strict=True):
            keep = score + rest >= threshold
            live, score = live[keep], score[keep]
            score = score + query[term] * shard.postings[term, live]
        keep = score >= threshold
        live, score = live[keep], score[keep]
    other = shard.ids[live] != own
    live, score = live[other], score[other]
    best = np.lexsort([shard.ids[live], -score])[:k]
    return shard.ids[live[best]], score[best]
