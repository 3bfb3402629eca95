"""What a context policy would have saved: compaction at a threshold, eviction of heavy results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.ordered import numbered, running
from .pricing import TIER_TOKENS, with_rates

THRESHOLD = 150_000
EVICT_AFTER = 3
HEAVY_CHARS = 100_000
CHUNK_POINTS = 1 << 17
LOWEST = -(1 << 62)  # below any offset


def _step(context: int, offset: int, base: int, top: int) -> tuple[int, int, int]:
    """Counterfactual context, new offset and resets at one point."""
    counter = context - offset
    if counter < base:
        counter = min(base, context)
        offset = context - counter
    if counter > top:
        return base, context - base, 1
    return counter, offset, 0


def _walk(ctx: np.ndarray, offset: int, base: int, top: int, counters: np.ndarray | None = None, resets: np.ndarray | None = None) -> int:
    """Run the policy over consecutive points; between changes of the offset whole stretches are handled at once."""
    at, n = 0, len(ctx)
    while at < n:
        window = 256
        while True:
            part = ctx[at:at + window] - offset
            hit = np.nonzero((part < base) | (part > top))[0]
            if len(hit) or at + window >= n:
                break
            window *= 4
        stop = at + int(hit[0]) if len(hit) else n
        if counters is not None:
            counters[at:stop] = ctx[at:stop] - offset
        if stop == n:
            break
        value, offset, fired = _step(int(ctx[stop]), offset, base, top)
        if counters is not None:
            counters[stop], resets[stop] = value, fired
        at = stop + 1
    return offset


def _first_outside(low: np.ndarray, high: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value the first place from ``start`` on whose band [low, high] does not hold it; the length if none.

    Bands are intersected over stretches of 1, 2, 4, … places, and each value
    passes the longest stretches that hold it.
    """
    n = len(low)
    bands = [(low, high)]
    while 1 << len(bands) <= n:
        (lo, hi), half = bands[-1], 1 << (len(bands) - 1)
        bands.append((np.maximum(lo[:-half], lo[half:]), np.minimum(hi[:-half], hi[half:])))
    at = start.copy()
    for k in range(len(bands) - 1, -1, -1):
        lo, hi = bands[k]
        spot = np.minimum(at, len(lo) - 1)
        inside = (at < len(lo)) & (lo[spot] <= value) & (value <= hi[spot])
        at = at + (inside.astype(np.int64) << k)
    return at


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """How a chunk maps the offset it starts with to the offset it ends with.

    Offsets inside every point's tolerated band pass through unchanged; any
    other offset leaves the band first at some point, and from there on the
    result depends on that point only. Where each point's own offset is left
    next is found for all points at once, and the ends of these chains by
    doubling. Neighbouring pieces with one end are merged.
    """
    pdf = pdf.sort_values("idx")
    ctx = pdf["context"].to_numpy(np.int64)
    base, top = int(pdf["base"].iloc[0]), int(pdf["top"].iloc[0])
    n, low, high = len(ctx), ctx - top, ctx - base
    over = np.minimum(base, ctx) > top  # the base itself lies above the threshold
    own, fired = np.where(over, high, ctx - np.minimum(base, ctx)), high  # the offset after leaving the band above, below
    # Two states per point: left above the band, left below it.
    value = np.concatenate([own, fired])
    place = np.concatenate([np.arange(n), np.arange(n)])
    after = _first_outside(low, high, value, place + 1)
    here = np.minimum(after, n - 1)
    jump = np.where(after >= n, np.arange(2 * n), np.where(value > high[here], here, n + here))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    rising, falling = np.maximum.accumulate(low), np.minimum.accumulate(high)
    edges = np.unique(np.concatenate([rising, falling + 1]))
    starts = np.concatenate([[edges[0] - 1], edges])
    left = _first_outside(low, high, starts, np.zeros(len(starts), np.int64))
    there = np.minimum(left, n - 1)
    ends = value[jump[np.where(starts > high[there], there, n + there)]]
    keep = left >= n
    new = np.concatenate([[True], (keep[1:] != keep[:-1]) | (~keep[1:] & (ends[1:] != ends[:-1]))])
    return pd.DataFrame({
        "session": pdf["session"].iloc[0], "chunk": int(pdf["chunk"].iloc[0]), "from_offset": np.concatenate([[LOWEST], edges])[new],
        "to_offset": [None if k else int(e) for k, e in zip(keep[new], ends[new], strict=True)],
    }).astype({"to_offset": "Int64"})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    offset, out = 0, []
    for chunk, part in pdf.sort_values(["chunk", "from_offset"]).groupby("chunk", sort=True):
        out.append((int(chunk), offset))
        row = part[part["from_offset"] <= offset].iloc[-1]
        offset = offset if pd.isna(row["to_offset"]) else int(row["to_offset"])
    return pd.DataFrame({"session": pdf["session"].iloc[0], "chunk": [c for c, _ in out], "offset": [o for _, o in out]})


def _apply(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    ctx = pdf["context"].to_numpy(np.int64)
    counters, resets = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
    _walk(ctx, int(pdf["offset"].iloc[0]), int(pdf["base"].iloc[0]), int(pdf["top"].iloc[0]), counters, resets)
    return pd.DataFrame({"session": pdf["session"], "idx": pdf["idx"], "counter": counters, "reset": resets})


def compacted(points: DataFrame, threshold: int = THRESHOLD, baseline: int | None = None, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Counterfactual context of every point (session, idx from 1, context) under a compaction threshold.

    Whenever the running context would pass the threshold it drops to the
    baseline (the first context of the session by default). The walk is
    sequential, so it runs in chunks of bounded size, each in a task of its
    own: long sessions get one table per chunk that says which offset leaves
    it for every offset that may enter (few rows, as most offsets end alike),
    those tables are chained, and the chunks are then walked independently.
    """
    first = points.where("idx = 1").select("session", F.col("context").alias("base"))
    rows = points.select("session", "idx", "context").join(first, "session").withColumns({
        "base": F.col("base") if baseline is None else F.lit(baseline).cast("bigint"), "top": F.lit(threshold).cast("bigint"),
        "chunk": F.floor((F.col("idx") - 1) / chunk_points),
    })
    long_sessions = points.where(F.col("idx") == chunk_points + 1).select("session")
    many = rows.join(long_sessions, "session", "left_semi")
    # After a join on the session its chunks would all stay in one task.
    pieces = many.repartition("session", "chunk").groupBy("session", "chunk").applyInPandas(_pieces, "session string, chunk bigint, from_offset bigint, to_offset bigint")
    entry = pieces.groupBy("session").applyInPandas(_chain, "session string, chunk bigint, offset bigint")
    started = rows.join(entry, ["session", "chunk"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    return started.repartition("session", "chunk").groupBy("session", "chunk").applyInPandas(_apply, "session string, idx bigint, counter bigint, reset bigint")


def context_points(messages: DataFrame, **chunking) -> DataFrame:
    """Context per message of the main thread, numbered along the lines of the session."""
    main = messages.where("thread = 'main' AND input_tokens IS NOT NULL")
    points = main.select(
        "session", "line", "ts_ms", "model", (F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("context")
    )
    return numbered(points, ["session"], "line", "idx", **chunking)


def _read_rate(context):
    above = F.when(context > TIER_TOKENS, F.col("cache_read_rate_200k"))
    return F.coalesce(above, F.col("cache_read_rate"), F.col("input_rate") * 0.1)


def _summed(rated: DataFrame, *extra) -> DataFrame:
    real, counter = F.col("context"), F.col("counter")
    usd = real * _read_rate(real) - counter * _read_rate(counter)
    known = F.count(usd) == F.count(F.lit(1))
    saved = F.sum(real - counter)
    return rated.groupBy("session").agg(
        *extra, saved.alias("saved_tokens"), F.sum(real).alias("real_tokens"),
        F.when(known, F.sum(usd)).alias("saved_usd"), known.alias("pricing_complete"),
        F.when(F.sum(real) > 0, saved / F.sum(real)).alias("saved_share"),
    )


def compaction_savings(points: DataFrame, pricing: DataFrame, **options) -> DataFrame:
    cf = compacted(points, **options)
    rated = with_rates(points.join(cf, ["session", "idx"]), pricing, times.local_day(F.col("ts_ms")))
    return _summed(rated, F.sum("reset").alias("resets"))


def _evictions(points: DataFrame, results: DataFrame, after: int, min_chars: int, **chunking) -> DataFrame:
    """Heavy results with their size in tokens and the point index at which they leave the context."""
    heavy = results.where(F.col("result_chars") > min_chars).select(
        "session", "line", "call_id", "result_chars", F.ceil(F.col("result_chars") / 4).cast("bigint").alias("tokens")
    )
    marks = points.select("session", "line", F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("one"))
    axis = heavy.withColumns({"kind": F.lit(0), "one": F.lit(0).cast("bigint")}).unionByName(marks, allowMissingColumns=True)
    # Points strictly before the result's line; the next one is where it appears.
    before = running(axis, ["session"], "line", {"n": ("sum", F.col("one"))}, ties=["kind"], **chunking)
    return before.where("kind = 0").select("session", "line", "call_id", "result_chars", "tokens", (F.col("n") + 1 + after).alias("evict_idx"))


def eviction_savings(
    points: DataFrame, results: DataFrame, pricing: DataFrame, after: int = EVICT_AFTER, min_chars: int = HEAVY_CHARS, **chunking
) -> DataFrame:
    """All heavy results leave the context ``after`` points after they appear."""
    gone = _evictions(points, results, after, min_chars, **chunking)
    drops = gone.select("session", F.col("evict_idx").alias("idx"), F.lit(0).alias("kind"), "tokens")
    axis = points.withColumns({"kind": F.lit(1), "tokens": F.lit(0).cast("bigint")}).unionByName(drops, allowMissingColumns=True)
    removed = running(axis, ["session"], "idx", {"removed": ("sum", F.col("tokens"))}, ties=["kind"], **chunking).where("kind = 1")
    cf = removed.withColumn("counter", F.greatest(F.lit(0), F.col("context") - F.col("removed"))).join(
        gone.select("session").distinct(), "session", "left_semi"
    )
    return _summed(with_rates(cf, pricing, times.local_day(F.col("ts_ms"))))


def eviction_marginals(
    points: DataFrame, results: DataFrame, after: int = EVICT_AFTER, min_chars: int = HEAVY_CHARS, **chunking
) -> DataFrame:
    """Tokens each heavy result would save if it alone left the context.

    A result of ``t`` tokens saves ``min(context, t)`` at every later point.
    Results are not paired with points: the points after an eviction are cut
    into blocks of sizes 2^k, and within a block the sums of the contexts up
    to ``t`` come from one running sum over the distinct context sizes, whose
    chunks are bands of sizes.
    """
    gone = _evictions(points, results, after, min_chars, **chunking)
    ends = points.groupBy("session").agg(F.max("idx").alias("last_idx"))
    gone = gone.join(ends, "session")
    deepest = F.expr("cast(ceil(log2(last_idx + 1)) as int)")
    level = F.explode(F.sequence(F.lit(0), deepest)).alias("level")
    # The points [e, last] as aligned blocks: climbing from e, a block is taken at every level where e is odd.
    start = F.col("evict_idx")
    at_level = gone.where(start <= F.col("last_idx")).select("session", "call_id", "tokens", start.alias("e"), "last_idx", level)
    climbed = F.expr("shiftright(e + (shiftleft(1L, level) - 1), level)")
    wanted = at_level.withColumn("block", climbed).where("block % 2 = 1 AND shiftleft(block, level) <= last_idx")
    # Only odd blocks are ever taken: the levels at which the point's number has a one.
    odd = F.expr("filter(sequence(0, cast(ceil(log2(last_idx + 1)) as int)), k -> shiftright(idx, k) % 2 = 1)")
    keys = ["session", "level", "block"]
    in_blocks = (
        points.join(gone.select("session").distinct(), "session", "left_semi").join(ends, "session")
        .select("session", "context", "idx", F.explode(odd).alias("level")).withColumn("block", F.expr("shiftright(idx, level)"))
        .groupBy(*keys, F.col("context").alias("size")).agg(F.count(F.lit(1)).alias("one"))
    )
    axis = in_blocks.select(*keys, "size", F.lit(0).alias("kind"), "one", F.lit(None).cast("string").alias("call_id")).unionByName(
        wanted.select(*keys, F.col("tokens").alias("size"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("one"), "call_id")
    )
    sums = running(axis, keys, "size", {"n_upto": ("sum", F.col("one")), "sum_upto": ("sum", F.col("one") * F.col("size"))}, ties=["kind", "call_id"], **chunking)
    count = in_blocks.groupBy(*keys).agg(F.sum("one").alias("n"))
    parts = sums.where("kind = 1").join(count, keys).select(
        "session", "call_id", (F.col("sum_upto") + (F.col("n") - F.col("n_upto")) * F.col("size")).alias("saved"), "n"
    )
    saved = parts.groupBy("session", "call_id").agg(F.sum("saved").alias("saved_tokens"), F.sum("n").alias("points_freed"))
    return gone.join(saved, ["session", "call_id"], "left").select(
        "session", "call_id", "line", "result_chars", "tokens", F.coalesce("points_freed", F.lit(0)).alias("points_freed"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
