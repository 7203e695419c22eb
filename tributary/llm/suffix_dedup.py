"""Operator 4, suffix-array dedup of bytes by merged Burrows-Wheeler transforms.

Runs of windows whose minimiser is unique in the corpus hold no repeat (repeats.py) and are dropped. Runs of equal
content (by a 64-bit digest that shares nothing with the minimiser's) are counted and stand for their earliest copy. The distinct contents that share a minimiser go, a bounded group at
a time, into shard transforms, which merge() interleaves; its repeated intervals say which windows are equal. A minimiser
with more than GROUP distinct contents is compared by two 64-bit digests of each window instead, summed by the cluster,
so that no task holds an unbounded group.

Edge cases: null texts are empty; texts under 100 bytes keep everything. Matches are of bytes, so a removed run may cut a
multi-byte character; `kept` is binary. Rows that repeat a doc_id and its text are one occurrence; other texts of one id, or of
the null id, are texts of their own, in the order of the texts. Columns other than the
id and the text are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm import bwt
from tributary.llm import repeats as R
from tributary.llm.shared import drop, keyed_text, named, release, save, with_keys

WINDOW = 100
SUB = 32
#: Distinct contents of one minimiser that a single merge takes.
GROUP = 1 << 14
#: Bytes merged at a time (arrays then stay in a core's cache), and shards of a merge.
MERGE_BYTES = 1 << 18
SHARDS = 6

CONTENT = "anchor long, doc long, span long, content binary"
MARK = "doc long, lo long, hi long"


def _contents(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (bounds, wanted) = batch.column("doc").to_numpy(), R.lists(batch.column("wanted"))
            anchor, span = (wanted.field(c).to_numpy() for c in ("anchor", "span"))
            for part in A.slices(batch.column("text")):
                take = np.arange(bounds[part.first], bounds[part.first + len(part.offsets) - 1])
                row = np.searchsorted(bounds, take, side="right") - 1 - part.first
                start, _, n = R.unpack_span(span[take])
                lo = part.offsets[row] + start
                hi = lo + n + window - 1
                data = part.data[A.concatenated(lo, hi)]
                offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
                content = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[take]), pa.array(ids[part.first + row]), pa.array(span[take]), content], names=["anchor", "doc", "span", "content"])

    return emit


def later_windows(contents: list[bytes], doc: np.ndarray, start: np.ndarray, window: int, n_shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """(string, first, end) of windows that also occur in a string with an earlier place (doc, start)."""
    m = len(contents)
    n_shards = max(1, min(n_shards, m))
    shards, strings, bases = [], [], []
    for s in range(n_shards):
        mine = list(range(s, m, n_shards))
        text = np.zeros(sum(len(contents[i]) + 1 for i in mine), np.int16)
        at, base = 0, []
        for i in mine:
            text[at : at + len(contents[i])] = np.frombuffer(contents[i], np.uint8).astype(np.int16) + 1
            base.append(at)
            at += len(contents[i]) + 1
        shards.append(bwt.build(text, window))
        strings.append(np.array(mine))
        bases.append(np.array(base))
    found = bwt.merge(shards, window)
    string = np.empty(len(found.position), np.int64)
    offset = np.empty(len(found.position), np.int64)
    for s in range(n_shards):
        own = found.shard == s
        k = np.searchsorted(bases[s], found.position[own], side="right") - 1
        string[own] = strings[s][k]
        offset[own] = found.position[own] - bases[s][k]
    size = np.array([len(x) for x in contents])
    full = offset + window <= size[string]
    string, offset, interval = string[full], offset[full], found.interval[full]  # whole windows only
    place = start[string] + offset
    order = np.lexsort((place, doc[string], interval))
    string, offset, interval, place = string[order], offset[order], interval[order], place[order]
    head = np.ones(len(interval), bool)
    head[1:] = interval[1:] != interval[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    later = (place != place[lead]) | (doc[string] != doc[string[lead]])
    gone = np.unique(string[later] * (int(size.max()) + 2) + offset[later])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(gone) != 1]))
    ends = np.append(cut[1:], len(gone)) - 1
    w = int(size.max()) + 2
    return [(int(a // w), int(a % w), int(b % w) + 1) for a, b in zip(gone[cut], gone[ends], strict=True)]


def _merged(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def resolve(rows: pa.Table) -> pa.RecordBatch:
            doc, span = rows.column("doc").to_numpy(), rows.column("span").to_numpy()
            marks = later_windows(rows.column("content").to_pylist(), doc, R.unpack_span(span)[0], window)
            s, lo, hi = (np.array([x[k] for x in marks], np.int64) for k in range(3))
            first = R.unpack_span(span[s])[0] if len(s) else s
            return pa.RecordBatch.from_arrays([pa.array(doc[s] if len(s) else s), pa.array(first + lo), pa.array(first + hi)], names=["doc", "lo", "hi"])

        def whole_groups(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """Cut a sorted table between minimisers, about MERGE_BYTES at a time."""
            anchor = table.column("anchor").to_numpy()
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor) if last else []).astype(np.int64)
            size = np.cumsum(pa.compute.binary_length(table.column("content")).to_numpy())
            parts, a = [], 0
            while True:
                done = size[a - 1] if a else 0
                ok = ends[(ends > a)]
                if not len(ok):
                    break
                fit = ok[size[ok - 1] - done <= MERGE_BYTES]
                b = int(fit[-1]) if len(fit) else int(ok[0])
                if not last and (not len(fit) or fit[-1] == ok[-1]):
                    break
                parts.append(table.slice(a, b - a))
                a = b
            return parts, table.slice(a)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.nbytes > 2 * MERGE_BYTES:
                parts, rest = whole_groups(table, False)
                for x in parts:
                    yield resolve(x)
                held = rest.combine_chunks().to_batches()
        if held:
            for x in whole_groups(pa.Table.from_batches(held), True)[0]:
                yield resolve(x)

    return emit


def _window_digests(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, span = batch.column("doc").to_numpy(), batch.column("span").to_numpy()
            for part in A.slices(batch.column("content")):
                n = np.diff(part.offsets) - window + 1
                row = np.repeat(np.arange(len(n)), n)
                at = A.concatenated(part.offsets[:-1], part.offsets[:-1] + n)
                digests = [roll.windows(roll.prefix(v[part.data]), window)[at].view(np.int64) for roll, v in zip(A.ITEMS, A.BYTE_VALUES, strict=True)]
                place = R.unpack_span(span[part.first + row])[0] + at - part.offsets[row]
                yield pa.RecordBatch.from_arrays([pa.array(digests[0]), pa.array(digests[1]), pa.array(doc[part.first + row]), pa.array(place)], names=["d1", "d2", "doc", "at"])

    return emit


def later_marks(texts: DataFrame, window: int = WINDOW, sub: int = SUB, group: int = GROUP) -> DataFrame:
    """Marks (doc, lo, hi): byte windows lo..hi-1 of doc also start earlier."""
    spark = texts.sparkSession
    runs = R.window_runs(texts, "bytes", window, sub, check=False)
    repeated = runs.groupBy("anchor").agg(F.sum(R.span_times()).alias("n")).where("n > 1").select("anchor")
    members = save(runs.join(repeated, "anchor"), "members")
    release(spark)
    copies = save(R.classes(members), "copies")
    # Copies of equal content: all but the earliest are repeats as a whole, and of a chain that comes first all but its first run.
    whole = members.join(copies.where("copies > 1").select("anchor", "content", "first"), ["anchor", "content"])
    leads = (F.col("doc") == F.col("first.doc")) & (F.col("span") == F.col("first.span"))
    whole = whole.where(~leads | (R.span_times() > 1))
    lo, hi = R.span_first() + F.when(leads, R.span_n()).otherwise(0), R.span_first() + R.span_times() * R.span_n()
    whole = save(whole.select("doc", lo.alias("lo"), hi.alias("hi")), "whole")
    drop(members)
    release(spark)
    # Distinct contents of one minimiser, each at its earliest place.
    several = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    reps = copies.join(several, "anchor").select("anchor", F.col("first.doc").alias("doc"), F.col("first.span").alias("span"))
    contents = save(R.texts_of(texts, reps, CONTENT, _contents(window)), "contents")
    drop(copies)
    release(spark)
    large = contents.groupBy("anchor").count().where(F.col("count") > group).select("anchor")
    small = contents.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "doc", "span")
    merged = small.mapInArrow(_merged(window), MARK)
    digests = contents.join(large, "anchor", "left_semi").mapInArrow(_window_digests(window), "d1 long, d2 long, doc long, at long")
    first = digests.groupBy("d1", "d2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", "first")
    rest = digests.join(first, ["d1", "d2"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    rest = rest.select("doc", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    return save(whole.unionByName(merged).unionByName(rest), "marks")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sub: int = SUB, group: int = GROUP) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts earlier (smaller id, or earlier in the text).

    Returns doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) and spans (removed byte ranges).
    """
    keyed, keys = with_keys(docs, id_col, text_col)
    texts = keyed_text(keyed, text_col)
    marks = later_marks(texts, window, sub, group)
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, lo = R.lists(batch.column("lo"))
            hi = R.lists(batch.column("hi"))[1].to_numpy()
            lo = lo.to_numpy()
            out: list[tuple] = []
            for part in A.slices(batch.column("text")):
                for r in range(len(part.offsets) - 1):
                    data = part.data[part.offsets[r] : part.offsets[r + 1]]
                    x, y = bounds[part.first + r], bounds[part.first + r + 1]
                    if y == x:
                        out.append((len(data), 0, 0, data.tobytes(), []))
                        continue
                    gone = A.covered(lo[x:y], hi[x:y] + window - 1, len(data))
                    spans = np.stack(A.runs(gone), 1)
                    out.append((len(data), int(gone.sum()), len(spans), data[~gone].tobytes(), spans.tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    out = R.with_spans(texts, marks).select("doc", "text", "lo", "hi").mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")
    return named(out, keys)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
