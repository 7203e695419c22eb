"""Operator 2, token-id output in patched frame-of-reference blocks.

A file holds documents in ascending id order. All numbers are little-endian:

    "TPF1", n_docs u32, n_tokens u64, n_blocks u32
    doc ids i64 * n_docs, tokens of each u32 * n_docs
    block starts u64 * n_blocks, relative to the first block
    blocks of BLOCK ids: minimum u32, width u8, n_exceptions u16, packed low bits, exception places u16, exception high bits u32

A block's ids lose its minimum and are packed at the width that PERCENTILE of them fit; bits above that width go to the
exception list. Files have up to FILE_TOKENS ids (one longer document makes a longer file) and are rows of a Parquet
table in the shared folder, whose commit protocol makes a retried or lost task harmless; export() writes them as plain files.

Edge cases: null and empty texts have the end id alone. A null id sorts first. Repeated rows each have their entry. Columns
other than the id and the text are never read; an empty table gives no file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import id_and_text, id_of, save
from tributary.llm.token_ids import WORD, Kind, encoder, tokenizer_path

MAGIC = b"TPF1"
BLOCK = 256
PERCENTILE = 90
FILE_TOKENS = 1 << 20
END = 2
FILES = "part int, seq int, tokens_before long, first_doc long, n_docs int, n_tokens long, file binary"
_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """File bytes of documents whose ids lie end to end in `ids`."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if n_blocks:
        padded[len(ids) :] = ids[-1]
    rows = padded.reshape(n_blocks, BLOCK)
    minimum = rows.min(1) if n_blocks else np.zeros(0, np.uint32)
    rows = rows - minimum[:, None]
    bits = np.ceil(np.log2(rows.astype(np.float64) + 1)).astype(np.uint8)
    width = np.percentile(bits, PERCENTILE, axis=1, method="higher").astype(np.uint8) if n_blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    head = np.zeros(n_blocks, _HEAD)
    head["minimum"], head["width"], head["exceptions"] = minimum, width, over.sum(1)
    n_over = over.sum(1)
    sizes_ = _HEAD.itemsize + BLOCK // 8 * width.astype(np.int64) + 6 * n_over
    starts = np.cumsum(sizes_) - sizes_
    body = np.zeros(int(sizes_.sum()), np.uint8)
    body[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(n_blocks, _HEAD.itemsize)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        narrow = np.ascontiguousarray(rows[mine]).astype("<u2" if w <= 16 else "<u4")
        spread = np.unpackbits(narrow.view(np.uint8).reshape(len(mine), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
        lows = np.packbits(spread.reshape(len(mine), BLOCK * w), axis=1, bitorder="little")
        body[(starts[mine] + _HEAD.itemsize)[:, None] + np.arange(BLOCK * w // 8)] = lows
    block, place = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    at = (starts + _HEAD.itemsize + BLOCK // 8 * width.astype(np.int64))[block]
    body[(at + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2")[:, None].view(np.uint8).reshape(-1, 2)
    high = (rows[block, place] >> width[block].astype(np.uint32)).astype("<u4")
    body[(at + 2 * n_over[block] + 4 * nth)[:, None] + np.arange(4)] = high[:, None].view(np.uint8).reshape(-1, 4)
    top = MAGIC + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ids)).tobytes() + np.uint32(n_blocks).tobytes()
    return b"".join([top, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), body.tobytes()])


class Reader:
    """A file's documents; ids(lo, hi) reads only the blocks that hold that range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n_docs, n_blocks = (int(np.frombuffer(data, "<u4", 1, k)[0]) for k in (4, 16))
        self.n_tokens = int(np.frombuffer(data, "<u8", 1, 8)[0])
        at = 20
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.sizes = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
        at += 12 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64) + at + 8 * n_blocks
        self.data = data

    def ids(self, lo: int, hi: int) -> np.ndarray:
        first, last = lo // BLOCK, -(-hi // BLOCK)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        starts = self.starts[first:last]
        raw = np.frombuffer(self.data, np.uint8)
        head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
        out = np.zeros((len(starts), BLOCK), np.uint32)
        width, n_over = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            wide = 16 if w <= 16 else 32
            low = raw[starts[mine, None] + _HEAD.itemsize + np.arange(BLOCK * w // 8)]
            spread = np.zeros((len(mine), BLOCK, wide), np.uint8)
            if w:
                spread[:, :, :w] = np.unpackbits(low, axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            out[mine] = np.packbits(spread, axis=2, bitorder="little").reshape(len(mine), BLOCK * wide // 8).view(f"<u{wide // 8}")
        block = np.repeat(np.arange(len(starts)), n_over)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = (starts + _HEAD.itemsize + BLOCK // 8 * width)[block]
        place = raw[(at + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        high = raw[(at + 2 * n_over[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[block, place] |= high << width[block].astype(np.uint32)
        out += head["minimum"][:, None]
        return out.ravel()[lo - first * BLOCK : hi - first * BLOCK]


def write_files(docs: DataFrame, tokenizer: str, kind: Kind, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as files (FILES rows) in ascending id order; returns the table written."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held_docs: list[int] = []
        held_ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held
            sizes = np.array([len(x) for x in held_ids], np.int64)
            file = pack(np.array(held_docs, np.int64), sizes, np.concatenate(held_ids))
            row = [part, seq, before, held_docs[0], len(held_docs), held, file]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=FILES.replace(",", "").split()[::2])
            seq, before, held = seq + 1, before + held, 0
            held_docs.clear()
            held_ids.clear()
            return out

        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for rows in A.slices(batch.column("text")):
                for doc, tokens in zip(ids[rows.first :], encoder(tokenizer, kind).encode(rows), strict=False):
                    if held and held + len(tokens) + 1 > FILE_TOKENS:
                        yield flush()
                    held_docs.append(doc)
                    held_ids.append(np.append(tokens, np.uint32(end)))
                    held += len(tokens) + 1
        if held_docs:
            yield flush()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc").sortWithinPartitions("doc", "text")
    return save(ordered.mapInArrow(emit, FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Documents of the files: doc, start (ids of all documents before it), n_tokens and ids (u32 little-endian)."""
    # One row for each writing task reaches the driver, to place the tasks' outputs one after the other.
    parts = sorted(files.groupBy("part").agg(F.min("first_doc").alias("first"), F.sum("n_tokens").alias("n")).collect(), key=lambda r: (r["first"], r["part"]))
    base, total = {}, 0
    for r in parts:
        base[r["part"]] = total
        total += r["n"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, file in zip(batch.column("part").to_pylist(), batch.column("tokens_before").to_pylist(), batch.column("file"), strict=True):
                reader = Reader(file.as_py())
                ids = reader.ids(0, reader.n_tokens).astype("<u4")
                ends = np.cumsum(reader.sizes.astype(np.int64))
                column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids), pa.array(base[part] + before + ends - reader.sizes), pa.array(reader.sizes.astype(np.int64)), column], names=["doc", "start", "n_tokens", "ids"])

    return files.select("part", "tokens_before", "file").mapInArrow(emit, "doc long, start long, n_tokens long, ids binary").select(id_of(), "start", "n_tokens", "ids")


def export(files: DataFrame, folder: str) -> int:
    """Write the files under a mounted folder, one at a time through the driver, named in document order."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for n, row in enumerate(files.select("first_doc", "file").orderBy("first_doc", "part", "seq").toLocalIterator(), 1):
        with open(f"{folder}/{n:08d}.tpf", "wb") as out:
            out.write(row["file"])
    return n


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), WORD)
    return read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
