"""Operator 3, cost-balanced packing into sequences of a fixed length.

A document's cost is linear plus quadratic in its tokens, as attention is. Full-length pieces of long documents fill
sequences of their own; what remains of each document is assigned in descending order to the lowest-cost sequence that has
room for it, among just as many sequences as the tokens need. What fits nowhere whole is cut over the lowest-cost sequences
with room. So all sequences of a batch together have less padding than one sequence.

Batches are parts of one task's documents (BATCH_TOKENS at most, or one longer document), so nothing is shuffled, a retried
task makes the same sequences again, and memory is bounded.

Edge cases: null and empty texts have the end id alone. Repeated rows are packed each. Columns other than the id and the
text are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import id_and_text, id_of
from tributary.llm.token_ids import BYTE, Kind, encoder, tokenizer_path

LENGTH = 1024
BATCH_TOKENS = 1 << 21
END = 0
PIECES = "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(tokens: np.ndarray | int, length: int = LENGTH) -> np.ndarray | float:
    """Linear work and attention's quadratic work of a piece, equal at full length."""
    return tokens + tokens * tokens / length


def assign(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with `sizes` tokens."""
    out, sequence = [], 0
    rest = []
    for k, size in enumerate(sizes.tolist()):
        for start in range(0, size - length + 1, length):
            out.append((k, start, length, sequence, 0))
            sequence += 1
        if size % length:
            rest.append((size % length, k, size - size % length))
    rest.sort(key=lambda r: (-cost(r[0], length), r[1]))
    n = -(-sum(r[0] for r in rest) // length)
    used, load = np.zeros(n, np.int64), np.zeros(n)

    def put(k: int, start: int, size: int, s: int) -> None:
        out.append((k, start, size, sequence + s, int(used[s])))
        used[s] += size
        load[s] += cost(size, length)

    for size, k, start in rest:
        while size:
            fits = np.flatnonzero(used + size <= length)
            if not len(fits):
                fits = np.flatnonzero(used < length)
            s = int(fits[np.argmin(load[fits])])
            part = min(size, length - int(used[s]))
            put(k, start, part, s)
            start, size = start + part, size - part
    return out


def pack_documents(docs: DataFrame, tokenizer: str, kind: Kind = BYTE, end: int = END, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (u32 little-endian), doc_tokens, sequence_id and offset."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        docs_: list[int] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            sizes = np.array([len(x) for x in tokens], np.int64)
            found = assign(sizes, length)
            for a in range(0, len(found), 4096):
                part = found[a : a + 4096]
                k, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*part, strict=True))
                ids = [tokens[p[0]][p[1] : p[1] + p[2]].tobytes() for p in part]
                doc = np.array(docs_, np.int64)[k]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), pa.array(sizes[k]), pa.array(base + sequence), pa.array(offset)], names=PIECES.replace(",", "").split()[::2])
            base += max((p[3] for p in found), default=-1) + 1
            held = 0
            docs_.clear()
            tokens.clear()

        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for rows in A.slices(batch.column("text")):
                for doc, found in zip(ids[rows.first :], encoder(tokenizer, kind).encode(rows), strict=False):
                    if held and held + len(found) + 1 > BATCH_TOKENS:
                        yield from flush()
                    docs_.append(doc)
                    tokens.append(np.append(found, np.uint32(end)).astype("<u4"))
                    held += len(found) + 1
        if docs_:
            yield from flush()

    out = id_and_text(docs, id_col, text_col).mapInArrow(emit, PIECES)
    return out.select(id_of(), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame) -> DataFrame:
    """The contract's rows: pieces with the checksum of their ids."""
    out = pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
