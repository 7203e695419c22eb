"""Burrows-Wheeler transforms of string shards and their merge by iterative interleave refinement.

A shard is a list of byte strings, each ended by a terminator that sorts first. Its transform comes with the suffix order
(to a depth of `depth` symbols) and the ranks of equal prefixes. merge() takes the shards' transforms as they are: it
starts from the shards end to end and refines the interleave two symbols a round, each round being one stable bucket pass
over the transforms' symbol pairs. A block of suffixes of a single shard is already in order and leaves the refinement.
The rounds that a suffix stays in a block with suffixes of other shards give its common prefix with them; blocks whole after
`depth` symbols are repeated intervals.
Prefixes that run past a terminator are never reported, so their order is left open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a symbol: a byte plus one, or 0 for a terminator.
BITS = 9
PACKED = 63 // BITS
#: Symbols between two looks at which blocks are of one shard.
STEP = 8


@dataclass
class Shard:
    order: np.ndarray  # suffix positions in the shard's text, sorted
    symbols: np.ndarray  # the transform: the two bytes before each suffix as one number, plus one; 0 where there aren't two
    back: np.ndarray  # rank of the suffix two positions earlier
    name: np.ndarray  # equal for equal prefixes of `depth` symbols


def _ahead(x: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - step)] = x[step:]
    return out


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of key, and dense names: equal for equal keys, in their order."""
    order = np.argsort(key)
    key = key[order]
    fresh = np.zeros(len(key), np.int64)
    fresh[1:] = key[1:] != key[:-1]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(fresh)
    return order, name


def build(text: np.ndarray, depth: int) -> Shard:
    """Transform of a shard's text: symbols are bytes plus one, with 0 after each string. Prefix doubling from PACKED symbols."""
    n = len(text)
    first = text.astype(np.int64)
    covered = min(PACKED, depth)
    key = first.copy()
    for k in range(1, covered):
        key = (key << BITS) | _ahead(first, k)
    order, name = _ranked(key)
    while covered < depth:
        step = min(covered, depth - covered)
        order, name = _ranked(name * n + _ahead(name, step))
        covered += step
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    pair = np.zeros(n, np.int64)
    whole = (text[:-2] > 0) & (text[1:-1] > 0)
    pair[2:][whole] = ((first[:-2] - 1) * 256 + first[1:-1])[whole]
    return Shard(order, pair[order], rank[np.maximum(order - 2, 0)], name[order])


@dataclass
class Merged:
    """Repeated intervals of the merged transform: suffixes grouped by equal prefixes of `depth` symbols."""

    shard: np.ndarray
    position: np.ndarray
    interval: np.ndarray
    common: np.ndarray  # prefix shared with a suffix of another shard, at least, in steps of STEP symbols (depth: repeated)


def merge(shards: list[Shard], depth: int) -> Merged:
    if depth % 2:
        raise ValueError("depth must be even: a round refines two symbols")
    sizes = np.array([len(s.order) for s in shards])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.concatenate([s.symbols for s in shards]).astype(np.int32)
    back = np.concatenate([s.back + b for s, b in zip(shards, base, strict=True)]).astype(np.int32)
    owner = np.repeat(np.arange(len(shards)), sizes).astype(np.int8)
    place = np.concatenate([s.order for s in shards])
    active = np.arange(int(sizes.sum()), dtype=np.int32)
    block = np.zeros(len(active), np.int32)
    common = np.zeros(len(active), np.int16)
    for done in range(0, depth, 2):
        c = symbols[active]
        inner = np.flatnonzero(c)  # a terminator ends every prefix before it
        c = (c[inner] - 1).astype(np.uint16)
        if not len(c):
            active, block = active[:0], block[:0]
            break
        order = np.argsort(c, kind="stable")
        c, inner = c[order], inner[order]
        block = block[inner]
        active = back[active[inner]]
        parts = np.ones(len(active), bool)
        parts[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(parts, dtype=np.int32) - 1
        first = np.flatnonzero(parts)
        if (done + 2) % STEP == 0 or done + 2 == depth:
            held = owner[active]
            shared = np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first)
            keep = shared[block]
            active, block = active[keep], block[keep]
            common[active] = done + 2
    # Across shards: what is still active shares `depth` symbols. Within a shard: its own names.
    names = np.concatenate([s.name for s in shards])
    offset = np.concatenate([[0], np.cumsum([int(s.name[-1]) + 1 if len(s.name) else 0 for s in shards])[:-1]])
    interval = names + np.repeat(offset, sizes)
    top = int(interval.max()) + 1 if len(interval) else 0
    whole = common[active] == depth
    interval[active[whole]] = top + block[whole]
    return Merged(owner, place, interval, common)
