"""Vector code compression: integer product codes whose nearest entries are found by VA-file filtering.

Components x become floor(1024 * x). Each vector is cut into four equal consecutive parts, each with a codebook of up to 256
entries. For one assignment the entries' coordinates are quantised to CELLS cells a dimension (four bits); a query's lookup
table holds the least and the largest squared distance to each cell of each dimension, so that sums of looked-up numbers bound the
distance to every entry from both sides. Only entries whose lower bound doesn't exceed the least upper bound are compared by
integers.

Each round is one pass over the vectors: a task sends one row of sums per used entry, so the shuffle has at most 1,024 rows a task,
and the driver holds the codebooks alone (1,024 entries at any size of the table).

Defined results: a vector that is null or empty, holds a null or non-finite component, or one of LIMIT or more in size (2**26 after
scaling, beyond which an error needn't fit a long) is dropped, as is one whose length differs from that of the first kept row. Rows
are ordered by vec_id (nulls last), then by vector; rows that repeat an id are rows of their own. A length that four doesn't divide
is cut at p * length // 4. Null labels are one group. With no row kept the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import flat_rows, join_small, save, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells a dimension of an approximation: four bits.
CELLS = 16
LIMIT = 2.0**16


class Approximation:
    """A codebook with the VA-file of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        # Equally filled cells by rank; a cell spans its own entries' coordinates, which bounds tighter than its borders.
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * CELLS // max(k, 1)
        self.low, self.high = np.zeros((width, CELLS)), np.zeros((width, CELLS))
        self.pick = np.zeros((width * CELLS, k))
        for w in range(width):
            for c in range(CELLS):
                held = entries[self.cell[:, w] == c, w]
                if len(held):
                    self.low[w, c], self.high[w, c] = held.min(), held.max()
            self.pick[w * CELLS + self.cell[:, w], np.arange(k)] = 1

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each row's squared distance to each entry: sums of the rows' lookup tables over the cells."""
        x = rows[:, :, None].astype(np.float64)
        below, above = self.low - x, x - self.high
        near = np.maximum(np.maximum(below, above), 0) ** 2
        far = np.maximum(x - self.low, self.high - x) ** 2
        n = len(rows)
        # Numbers past 2**53 are rounded; the margin is far wider than that.
        return near.reshape(n, -1) @ self.pick * (1 - 1e-12), far.reshape(n, -1) @ self.pick * (1 + 1e-12)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's nearest entry, the least index among ties."""
        lower, upper = self.bounds(rows)
        at, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        distance = ((rows[at] - self.entries[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, np.searchsorted(at, np.arange(len(rows))))
        hit = distance == best[at]
        at, entry = at[hit], entry[hit]
        first = np.r_[True, at[1:] != at[:-1]]
        return entry[first], best


def kept_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of the vectors that take part, but for their length."""
    small_batches(vectors.sparkSession)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    # NaN is above all numbers in Spark, so one comparison drops it, too.
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LIMIT)))


def borders(width: int) -> list[tuple[int, int]]:
    return [(p * width // PARTS, (p + 1) * width // PARTS) for p in range(PARTS)]


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(flat_rows(column, width) * SCALE).astype(np.int64)


def sums(rows: DataFrame, books: list[np.ndarray], width: int) -> list[tuple[np.ndarray, list[list[int]]]]:
    """By part, each entry's number of vectors and their componentwise sums, added up by the cluster."""
    schema = "part int, entry int, n long, total array<long>"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _integers(batch.column(0), width)
            for p, (a, b) in enumerate(borders(width)):
                entry, _ = near[p].nearest(ints[:, a:b])
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                np.add.at(totals[p], entry, ints[:, a:b])
        used = [(p, k) for p in range(PARTS) for k in np.flatnonzero(counts[p])]
        if used:
            p, k = zip(*used, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array([counts[i][j] for i, j in used], pa.int64()), pa.array([totals[i][j] for i, j in used], pa.list_(pa.int64()))],
                ["part", "entry", "n", "total"],
            )

    part = rows.select("v").mapInArrow(emit, schema)
    flat = part.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = flat.groupBy("part", "entry", "place").agg(exact("n").alias("n"), exact("x").alias("x")).collect()
    out = [(np.zeros(len(b), object), [[0] * b.shape[1] for _ in b]) for b in books]
    for r in found:
        out[r["part"]][0][r["entry"]] = int(r["n"])
        out[r["part"]][1][r["entry"]][r["place"]] = int(r["x"])
    return out


def fitted(rows: DataFrame) -> tuple[list[np.ndarray], int]:
    """The codebooks after all rounds, and the vectors' length; ([], 0) without rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return [], 0
    width = len(first[0]["v"])
    same = rows.where(F.size("v") == width)
    if any(len(r["v"]) != width for r in first):
        first = same.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.floor(np.array([r["v"] for r in first]) * SCALE).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in borders(width)]
    for _ in range(ROUNDS):
        for p, (n, total) in enumerate(sums(same, books, width)):
            for k in np.flatnonzero(n):
                books[p][k] = [x // n[k] for x in total[k]]
    return books, width


def encoded(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(id, label, code, error) of each row: its parts' nearest entries, two hex digits each, and the squared distances' sum."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _integers(batch.column(2), width)
            codes, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, (a, b) in enumerate(borders(width)):
                codes[:, p], distance = near[p].nearest(ints[:, a:b])
                error += distance
            text = codes.tobytes().hex()
            code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return rows.where(F.size("v") == width).mapInArrow(emit, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of every kept vector, written once; the codebooks)."""
    rows = kept_rows(vectors, id_col, vector_col, label_col)
    books, width = fitted(rows)
    if not books:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    return save(encoded(rows, books, width), "codes"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = save(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "totals")
    out = join_small(codes, totals, ["label"], "id")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
