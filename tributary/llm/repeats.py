"""Shared parts of the two repeated-window operators: candidate runs of windows, and spans applied to texts.

Every window of a text belongs to exactly one run (arrays.segments), and equal windows have equal minimisers. So runs
whose minimiser occurs once in the corpus can't hold a repeated window, and everything after the first count works on
the small rest. A run is a row (anchor, content, check, doc, span). In periodic text ("a b a b ...") runs of equal content follow each
other; they are one row that counts them, so a repeated word pair can't flood one key. span packs the first window (33 bits),
the number of runs (20 bits) and the windows of each (10 bits). content and check are digests of all items of the run, by
independent item hashes and bases: runs are called equal only where both agree (128 bits). Without check, content is the one that
is independent of the minimiser's hash: 64 bits among the runs of one minimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import arrays as A

WINDOW_BITS, TIMES_BITS = 10, 20
RUNS = "anchor long, content long, check long, doc long, span long"


def items_of(unit: str, part: A.Slice) -> tuple[np.ndarray, np.ndarray, A.Words | None]:
    """Item hashes and row bounds of a slice, for unit 'bytes' or 'words'."""
    if unit == "bytes":
        return A.BYTE_VALUES[0][part.data], part.offsets, None
    w = A.words(part, A.SPACES)
    return w.hashes(), w.bounds, w


def checks(part: A.Slice, w: A.Words | None, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Digests of the slice's items lo..hi-1 (ranges of all its items) that share nothing with items_of's hashes."""
    values = A.BYTE_VALUES[1][part.data] if w is None else w.hashes(1)
    return A.ITEMS[1].ranges(A.ITEMS[1].prefix(values), lo, hi) + (hi - lo).astype(A.U)


#: Bytes of a text that are cut into runs at a time; longer texts go in pieces that overlap by a window less one byte.
PIECE = 1 << 21


def pieces(part: A.Slice, window: int) -> Iterator[tuple[A.Slice, int]]:
    """The slice with place 0; or, of a long text, its pieces and where each begins. Every window lies in one piece."""
    n = len(part.data)
    if n <= PIECE or len(part.offsets) > 2:
        yield part, 0
        return
    for at in range(0, n - window + 1, PIECE):
        data = part.data[at : at + PIECE + window - 1]
        yield A.Slice(part.first, data, np.array([0, len(data)])), at


def pack_span(start, times, n):
    return (start << (WINDOW_BITS + TIMES_BITS)) | (times << WINDOW_BITS) | n


def unpack_span(span):
    """First window, number of runs, windows of each run."""
    return span >> (WINDOW_BITS + TIMES_BITS), (span >> WINDOW_BITS) & ((1 << TIMES_BITS) - 1), span & ((1 << WINDOW_BITS) - 1)


def folded(s: A.Segments, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of segments, the first of each chain of equal ones, and the chain's length."""
    m = len(s.row)
    opens = np.ones(m, bool)
    opens[1:] = (s.row[1:] != s.row[:-1]) | (s.anchor[1:] != s.anchor[:-1]) | (s.content[1:] != s.content[:-1]) | (s.start[1:] != s.start[:-1] + s.n[:-1])
    if check is not None:
        opens[1:] |= check[1:] != check[:-1]
    head = np.maximum.accumulate(np.where(opens, np.arange(m), 0))
    opens |= (np.arange(m) - head) % ((1 << TIMES_BITS) - 1) == 0
    first = np.flatnonzero(opens)
    return first, np.diff(np.append(first, m))


def window_runs(docs: DataFrame, unit: str, window: int, sub: int, check: bool = True) -> DataFrame:
    """RUNS rows (without check, if so asked) of docs (doc, text); texts with fewer than `window` items have none."""
    columns = [c.split()[0] for c in RUNS.split(", ") if check or c != "check long"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            parts = ((part, 0) for part in A.slices(batch.column("text"))) if unit == "words" else (x for part in A.slices(batch.column("text")) for x in pieces(part, window))
            for part, begins in parts:
                values, bounds, w = items_of(unit, part)
                s = A.segments(values, bounds, window, sub)
                if len(s.row):
                    lo = bounds[s.row] + s.start
                    other = checks(part, w, lo, lo + s.n + window - 1)
                    at, times = folded(s, other)
                    digests = [pa.array(x[at].view(np.int64)) for x in ((s.anchor, s.content, other) if check else (s.anchor, other))]
                    yield pa.RecordBatch.from_arrays([*digests, pa.array(ids[part.first + s.row[at]]), pa.array(pack_span(s.start[at] + begins, times, s.n[at]))], names=columns)

    return docs.select("doc", "text").mapInArrow(cut, ", ".join(f"{c} long" for c in columns))


def classes(members: DataFrame) -> DataFrame:
    """Runs of equal content: their number and the earliest."""
    key = [c for c in ("anchor", "content", "check") if c in members.columns]
    return members.groupBy(*key).agg(F.sum(span_times()).alias("copies"), F.min(F.struct("doc", "span")).alias("first"))


def span_first() -> Column:
    return F.shiftright("span", WINDOW_BITS + TIMES_BITS)


def span_times() -> Column:
    return F.shiftright("span", WINDOW_BITS).bitwiseAND(F.lit((1 << TIMES_BITS) - 1))


def span_n() -> Column:
    """Windows of one run."""
    return F.col("span").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1))


def marks_of(rows: DataFrame) -> DataFrame:
    """Whole rows (doc, span) as marks: first window and the window after the last."""
    return rows.select("doc", span_first().alias("lo"), (span_first() + span_times() * span_n()).alias("hi"))


def with_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (doc, text) with their marks as lists lo, hi. A list is bounded by its own text's length."""
    spans = marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).select("doc", F.col("marks.lo").alias("lo"), F.col("marks.hi").alias("hi"))
    return docs.join(spans, "doc", "left")


def texts_of(docs: DataFrame, rows: DataFrame, schema: str, emit: Callable) -> DataFrame:
    """Look up the texts of rows (doc, span, extra columns): emit(slice row's items, ...) makes arrow batches of `schema`."""
    grouped = rows.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc"])).alias("wanted"))
    return docs.join(grouped, "doc").mapInArrow(emit, schema)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column; null lists are empty."""
    if column.null_count:
        column = _empty_for_null(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _empty_for_null(column: pa.Array) -> pa.Array:
    sizes = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).fill_null(0)))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), column.flatten())
