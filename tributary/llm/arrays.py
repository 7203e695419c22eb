"""Vectorised text primitives shared by the operators: words, rolling hashes, window minimisers.

All functions work on flat numpy arrays of a slice of rows, so that no Python object exists per byte or per word.
Words are byte runs: every separator used here is ASCII, hence cutting UTF-8 bytes equals cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Rolling:
    """Polynomial hash modulo 2**64 with an odd base: any range's hash follows from prefix sums."""

    def __init__(self, seed: int):
        self.base = int(_stream(1, seed)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, factor in (("up", self.base), ("down", self.inverse)):
                    powers = np.full(size, factor, U)
                    powers[0] = 1
                    setattr(self, name, np.cumprod(powers, dtype=U))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, U)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.down[lo])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])


BYTE_VALUES = (_stream(256, 11), _stream(256, 12))
BYTES = (Rolling(21), Rolling(22))
ITEMS = (Rolling(31), Rolling(32))

#: Separators of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing A-Z).
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


@dataclass
class Slice:
    """Rows first..last of a batch: their bytes end to end, with each row's byte offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole rows, about `limit` bytes at a time; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Word w is data[start[w]:end[w]] of row row[w]; bounds[r]:bounds[r+1] are row r's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, which: int = 0) -> np.ndarray:
        roll = BYTES[which]
        return roll.ranges(roll.prefix(BYTE_VALUES[which][self.data]), self.start, self.end)


def words(part: Slice, separators: np.ndarray, fold: np.ndarray = SAME) -> Words:
    data = part.data if fold is SAME else fold[part.data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    # A row's end cuts a word that would run on into the next row.
    cuts = part.offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        through = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(through):
            start = np.sort(np.concatenate([start, through]))
            end = np.sort(np.concatenate([end, through]))
    return Words(data, start, end, np.searchsorted(start, part.offsets, side="left"))


@dataclass
class Segments:
    """Maximal runs of windows of one row that share the position of their minimiser."""

    row: np.ndarray
    start: np.ndarray  # first window, counted from the row's first item
    n: np.ndarray  # windows in the run
    offset: np.ndarray  # minimiser's place in the first window
    anchor: np.ndarray  # hash of the minimiser
    content: np.ndarray  # hash of all items of the run


def segments(values: np.ndarray, bounds: np.ndarray, window: int, sub: int) -> Segments:
    """Cut all windows of `window` items into runs by their minimiser, the least-hashed group of `sub` items.

    The rightmost least group is taken, a choice that depends on the window's items alone. So two equal windows have
    equal minimisers at equal places, and no run holds one window twice.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return Segments(none, none, none, none, none.view(U), none.view(U))
    prefix = ITEMS[0].prefix(values)
    hashes = ITEMS[0].windows(prefix, sub)
    low = U(0xFFFFFFFF)
    least = (hashes & ~low) | (low - np.arange(len(hashes), dtype=U))
    span, covered = window - sub + 1, 1
    while 2 * covered <= span:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < span:
        rest = span - covered
        least = np.minimum(least[:-rest], least[rest:])
    at = (low - (least & low)).astype(np.int64)
    valid = np.zeros(len(at), bool)
    sizes = np.diff(bounds)
    for_rows = np.flatnonzero(sizes >= window)
    edge = np.zeros(len(at) + 1, np.int32)
    np.add.at(edge, bounds[for_rows], 1)
    np.add.at(edge, bounds[for_rows + 1] - window + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    # Adjacent rows never share a run: where one row's windows end the next row's begin only if window == 1.
    first = np.flatnonzero(opens)
    if not len(first):
        return Segments(none, none, none, none, none.view(U), none.view(U))
    last_valid = np.append(first[1:] - 1, len(at) - 1)
    row = np.searchsorted(bounds, first, side="right") - 1
    last = np.minimum(last_valid, bounds[row + 1] - window)
    count = last - first + 1
    content = ITEMS[0].ranges(prefix, first, last + window)
    return Segments(row, first - bounds[row], count, at[first] - first, hashes[at[first]], mix(content + count.astype(U)))


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Mask over n items of the union of the half-open ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(lo, 0, n), 1)
    np.add.at(edge, np.clip(hi, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open maximal ranges where mask holds."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def concatenated(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Indices of the half-open ranges, end to end."""
    size = hi - lo
    out = np.ones(int(size.sum()), np.int64)
    keep = size > 0
    lo, size = lo[keep], size[keep]
    if len(lo):
        ends = np.cumsum(size)
        out[0] = lo[0]
        out[ends[:-1]] = lo[1:] - (lo[:-1] + size[:-1] - 1)
        np.cumsum(out, out=out)
    return out
