"""Exact token ids at array speed, for the two public BPE files of the tokenizers library.

Both files cut a text into runs of letters, numbers or other characters before any merge, so a run's ids don't depend on
its neighbours. A slice of texts is cut into runs with numpy, each run is hashed, and a table that each worker keeps maps
hashes (two of 64 bits) to ids. Only runs it hasn't met go to the tokenizer. Rows that the fast cut doesn't cover (characters
from U+0300 on, rare white space, strings of special tokens) are encoded whole by the tokenizer, so results are its own.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

from tributary.llm import arrays as A

#: Runs that a worker remembers. Beyond it, those met once go.
CACHE = 1_500_000
SLOTS = 1 << 22

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


def _class(point: int) -> int:
    kind = unicodedata.category(chr(point))
    if point in (0x20, *range(0x09, 0x0E)):
        return SPACE
    if point in (0x85, 0xA0, 0x130):  # white space beyond ASCII; a letter whose lower case is two characters
        return ODD
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER


POINTS = np.array([_class(p) for p in range(0x300)], np.uint8)
#: First bytes of code points from U+0300 on.
FAR = np.zeros(256, bool)
FAR[0xCC:] = True
#: Byte-level BPE's printable stand-ins: visible Latin-1 characters stand for themselves, the others follow from U+0100.
_visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
STANDS = {b: chr(b) for b in _visible}
STANDS |= {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in STANDS)}


@dataclass(frozen=True)
class Kind:
    """How a file cuts: with the space before a run as its part, or with white space dropped; if it lowers case; if each
    number character is a run of its own."""

    spaces: bool
    lower: bool
    digits: bool


#: byte_bpe_50k and word_bpe_49k.
BYTE = Kind(spaces=True, lower=False, digits=False)
WORD = Kind(spaces=False, lower=True, digits=True)


class Table:
    """Open-addressing map from a run's two hashes to its ids."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.entry = np.zeros(SLOTS, np.int32)  # 0: free
        self.key, self.check = np.zeros(1024, A.U), np.zeros(1024, A.U)
        self.start, self.size, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used, self.n = np.zeros(4096, np.uint32), 0, 1

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entries, 0 where there is none."""
        at = (key & A.U(SLOTS - 1)).astype(np.int64)
        out = self.entry[at]
        todo = np.flatnonzero((out > 0) & ((self.key[out] != key) | (self.check[out] != check)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
            e = self.entry[at[todo]]
            out[todo] = e
            todo = todo[(e > 0) & ((self.key[e] != key[todo]) | (self.check[e] != check[todo]))]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """New runs with distinct hashes."""
        m = len(key)
        size = np.fromiter(map(len, ids), np.int32, m)
        total = int(size.sum())
        self._room(m, total)
        new = slice(self.n, self.n + m)
        self.key[new], self.check[new], self.size[new], self.hits[new] = key, check, size, 0
        self.start[new] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.used += total
        self._place(np.arange(self.n, self.n + m))
        self.n += m

    def _place(self, entries: np.ndarray) -> None:
        at = (self.key[entries] & A.U(SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(entries))
        while len(todo):
            free = todo[self.entry[at[todo]] == 0]
            self.entry[at[free]] = entries[free]
            todo = todo[self.entry[at[todo]] != entries[todo]]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)

    def _room(self, m: int, total: int) -> None:
        while len(self.key) < self.n + m:
            for name in ("key", "check", "start", "size", "hits"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def trim(self) -> None:
        """Over CACHE runs, keep those met again, or none if they alone are too many."""
        if self.n <= CACHE:
            return
        keep = np.flatnonzero(self.hits[: self.n] > 1)
        keep = keep[keep > 0]
        old = self.key[keep], self.check[keep], self.start[keep], self.size[keep], self.flat
        self._reset()
        if len(keep) > CACHE // 2:
            return
        key, check, start, size, flat = old
        total = int(size.sum())
        self._room(len(keep), total)
        new = slice(1, 1 + len(keep))
        self.key[new], self.check[new], self.size[new] = key, check, size
        self.start[new] = np.cumsum(size) - size
        self.flat[:total] = flat[A.concatenated(start, start + size)]
        self.used, self.n = total, 1 + len(keep)
        self._place(np.arange(1, self.n))


class Encoder:
    """Token ids of texts with the file at `path`, without special tokens added."""

    def __init__(self, path: str, kind: Kind):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.table = Tokenizer.from_file(path), kind, Table()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs, and rows that need the tokenizer itself."""
        n, n_rows = len(data), len(offsets) - 1
        kind = POINTS[np.minimum(data, 0x7F)]
        lead = np.flatnonzero(data >= 0xC0)
        slow = np.zeros(n_rows, bool)
        if len(lead):
            far = lead[FAR[data[lead]]]
            slow[np.searchsorted(offsets, far, side="right") - 1] = True
            near = lead[~FAR[data[lead]]]
            two = POINTS[((data[near] & 0x1F).astype(np.int64) << 6) | (data[near + 1] & 0x3F)]
            kind[near], kind[near + 1] = two, two
            slow[np.searchsorted(offsets, near[two == ODD], side="right") - 1] = True
        text = data.tobytes()
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                slow[np.searchsorted(offsets, [at, at + len(s) - 1], side="right") - 1] = True
                at = text.find(s, at + 1)
        space = kind == SPACE
        edge = np.zeros(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        quote = np.flatnonzero(data[:-1] == 0x27)
        edge[quote[kind[quote + 1] == LETTER] + 1] = False  # 's and the like: left to the tokenizer as one run
        if self.kind.digits:
            edge[:n] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
        edge[offsets] = True
        if self.kind.spaces:
            edge[:-1] |= space
            edge[1:] |= space
            # A single space belongs to what follows it in its row.
            before = np.flatnonzero(data == 0x20) + 1
            before = before[before < n]
            before = before[~space[before]]
            joined = before[~np.isin(before, offsets)]
            edge[joined] = False
            # Three white spaces, or two at a row's end, make runs of their own.
            end = np.zeros(n + 1, bool)
            end[offsets] = True
            two = np.flatnonzero(space[:-1] & space[1:] & ~end[1:n])
            long = two[end[two + 2] | (space[np.minimum(two + 2, n - 1)] & (two + 2 < n))]
            slow[np.searchsorted(offsets, long, side="right") - 1] = True
        edge[n] = True
        first = np.flatnonzero(edge[:n])
        last = np.append(first[1:], n)
        if not self.kind.spaces:
            keep = ~space[first]
            first, last = first[keep], last[keep]
        return first, last, slow

    def _ids(self, run: bytes) -> list[int]:
        if b"'" in run or run.isspace():
            return self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
        if self.kind.lower:
            run = run.decode().lower().encode()
        return [t.id for t in self.tokenizer.model.tokenize(run.decode("latin-1").translate(STANDS))]

    def encode(self, part: A.Slice) -> list[np.ndarray]:
        """uint32 ids of each row."""
        n_rows = len(part.offsets) - 1
        if not len(part.data):
            return [np.zeros(0, np.uint32)] * n_rows
        table = self.table
        table.trim()
        first, last, slow = self._cut(part.data, part.offsets)
        if slow.any():
            keep = ~slow[np.searchsorted(part.offsets, first, side="right") - 1]
            first, last = first[keep], last[keep]
        hashes = [roll.ranges(roll.prefix(v[part.data]), first, last) for roll, v in zip(A.BYTES, A.BYTE_VALUES, strict=True)]
        entry = table.find(*hashes)
        new = np.flatnonzero(entry == 0)
        if len(new):
            _, lead = np.unique(hashes[0][new], return_index=True)
            lead = new[lead]
            text = part.data.tobytes()
            table.add(hashes[0][lead], hashes[1][lead], [self._ids(text[a:b]) for a, b in zip(first[lead].tolist(), last[lead].tolist(), strict=True)])
            entry[new] = table.find(hashes[0][new], hashes[1][new])
        table.hits[: table.n] += np.bincount(entry, minlength=table.n).astype(np.int32)
        start, size = table.start[entry], table.size[entry]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = table.flat[np.arange(int(ends[-1])) + np.repeat(start - ends[:-1], size)]
        bounds = ends[np.searchsorted(first, part.offsets, side="left")]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for r in np.flatnonzero(slow).tolist():
            row = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes().decode()
            out[r] = np.array(self.tokenizer.encode(row, add_special_tokens=False).ids, np.uint32)
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: Kind) -> Encoder:
    """One encoder for each worker process and file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
