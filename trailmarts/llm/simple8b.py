"""Simple-8b: ids packed into 64-bit words, decoded block by block without a scan.

A word's top four bits select how many ids of how many bits its other sixty
bits hold. Selector 0 is an escape: the word holds the place, among the
exceptions, of one id of more than sixty bits. Ids are coded in blocks of 1024;
a word never crosses a block, and the first word of each block is on record, so
all words are decoded at once and any block alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024
#: Fixed values of the coding: ids in a word for selectors 1 to 14, and the bits of each.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
WIDEST = 60
ESCAPE = 0


@dataclass
class Packed:
    n: int
    blocks: np.ndarray  # uint32, index of each block's first word
    words: np.ndarray  # uint64
    exceptions: np.ndarray  # uint64


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if int(ids.max(initial=0)) < 1 << 53:  # the exponent of a 64-bit float is exact
        bits = (ids.astype(np.float64).view(np.int64) >> 52) - 1022
        return np.maximum(bits, 0).astype(np.uint8)
    bits, rest = np.zeros(len(ids), np.uint8), ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        more = high > 0
        bits += more.astype(np.uint8) * np.uint8(step)
        rest = np.where(more, high, rest)
    return bits + (rest > 0).astype(np.uint8)


def _window_max(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of a selector, the most bits among so many ids from each place on; the end counts as zeros."""
    padded = np.concatenate([bits, np.zeros(WIDEST, np.uint8)])
    most = {1: padded}

    def join(a: int, b: int) -> None:
        most[a + b] = most[a].copy()
        np.maximum(most[a][:-a], most[b][a:], out=most[a + b][:-a])

    for a, b in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (15, 5), (15, 15), (30, 30)):
        join(a, b)
    return {n: m[:len(bits)] for n, m in most.items()}


def encode(ids: np.ndarray) -> Packed:
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return Packed(0, np.empty(0, np.uint32), np.empty(0, np.uint64), np.empty(0, np.uint64))
    # each block is followed by zeros, so that a window over its end sees only its own ids
    grid = np.zeros((blocks, BLOCK + WIDEST), np.uint64)
    grid[:, :BLOCK] = np.concatenate([ids, np.zeros(blocks * BLOCK - n, np.uint64)]).reshape(blocks, BLOCK)
    flat = grid.ravel()
    most = _window_max(_bit_lengths(flat))
    # whatever fits a selector fits all after it, so their number names the first; none is the escape
    choice = np.full(len(flat), len(COUNTS), np.uint8)
    for selector in range(1, len(COUNTS)):
        choice -= most[COUNTS[selector]] <= BITS[selector]
    choice[choice == len(COUNTS)] = ESCAPE
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    in_block, starts = [], []
    while len(live):
        place = live * (BLOCK + WIDEST) + at
        in_block.append(live)
        starts.append(place)
        at = at + COUNTS[choice[place]]
        going = at < ends[live]
        live, at = live[going], at[going]
    in_block, starts = np.concatenate(in_block), np.concatenate(starts)
    starts = starts[np.argsort(in_block, kind="stable")]
    words = np.empty(len(starts), np.uint64)
    used = choice[starts]
    exceptions = flat[starts[used == ESCAPE]]
    words[used == ESCAPE] = np.arange(len(exceptions), dtype=np.uint64)
    for selector in np.unique(used[used > 0]):
        here = np.flatnonzero(used == selector)
        packed = np.full(len(here), np.uint64(selector) << np.uint64(60))
        for j in range(COUNTS[selector]):
            packed |= flat[starts[here] + j] << np.uint64(j * BITS[selector])
        words[here] = packed
    first = np.concatenate([[0], np.cumsum(np.bincount(in_block, minlength=blocks))[:-1]])
    return Packed(n, first.astype(np.uint32), words, exceptions)


def decode(p: Packed, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks from ``first`` to before ``last`` (all)."""
    total = len(p.blocks)
    last = total if last is None else last
    if first >= last:
        return np.empty(0, np.uint64)
    edges = np.append(p.blocks, len(p.words)).astype(np.int64)
    words = p.words[edges[first]:edges[last]]
    counts = COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    lengths = np.diff(edges[first:last + 1])
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(last - first), lengths)
    start = before - np.repeat(before[edges[first:last] - edges[first]], lengths) + block * BLOCK
    size = (last - first) * BLOCK if last < total else (last - first - 1) * BLOCK + p.n - (total - 1) * BLOCK
    ends = np.minimum((block + 1) * BLOCK, size)
    out = np.zeros(size, np.uint64)
    used = (words >> np.uint64(60)).astype(np.int64)
    raw = used == ESCAPE
    out[start[raw]] = p.exceptions[words[raw].astype(np.int64)]
    for selector in np.unique(used[~raw]):
        here = np.flatnonzero(used == selector)
        mask = np.uint64((1 << int(BITS[selector])) - 1)
        for j in range(COUNTS[selector]):
            inside = here if j == 0 else here[start[here] + j < ends[here]]
            out[start[inside] + j] = (words[inside] >> np.uint64(j * BITS[selector])) & mask
    return out
