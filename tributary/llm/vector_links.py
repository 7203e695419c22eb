"""Embedding near-dedup by an inverted multi-index: links of cosine LINK or more, components and the rows to keep.

Vectors are scaled to unit length, so a cosine of 0.95 or more means a squared distance of 0.1 or less. Two codebooks, one on the first
and one on the second half of the components, form a grid of cells; a vector's home is the cell of its two nearest centroids. A
partner of it lies where its halves may lie: crossing the plane between its own centroid and centroid i takes a step of length

    step_i = max over m of (|x - c_i|**2 - |x - c_m|**2) / (2 |c_i - c_m|),

so step_i**2 + step_j**2 orders the cells (i, j). A multi-sequence traversal (the two sorted lists of squared steps, always the least
sum next) visits cells in that order until the probability that is left falls below 1 - RECALL. A partner at the largest distance,
in a random direction, makes a step of length s along a given line with standard deviation radius / sqrt(dimensions), which weighs a
cell by exp(-s**2 / (2 * variance)). Partners that are nearer are missed less often. Of two cells the lower numbered one's vector visits
the other's, so no pair meets twice.

Each cell's home vectors are dealt into blocks of HOME, what is compared with them (later blocks, visitors) into blocks of OTHER; a
task holds one block of homes and streams the others past it. It sends on counts per vector and a forest of links, never pairs.
Every candidate is verified by its cosine in double precision.

The codebooks are fitted on SAMPLE vectors (those of least hash), with about sqrt(n / PER_CELL) centroids, at most MAX_CENTROIDS;
all vectors are indexed. Equal vectors are one class with a count, so they never meet.

Defined results: null, empty and zero vectors, and those with a null or non-finite component, link with nothing. Vectors of different
lengths are compared as if the shorter ended in zeros. Rows that repeat an id are vectors of their own; their component_id is the
least id reachable. A null id is after all others, so component_id is null only where all ids of a component are, and such rows are
kept. An empty table gives no rows. Other columns are ignored. A group of m near copies that differ from each other costs m * m / 2
comparisons, spread over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.components import components
from tributary.llm.shared import flat_rows, join_small, release, save, small_batches

LINK, RECALL = 0.95, 0.999
SAMPLE, PER_CELL, MAX_CENTROIDS, FIT_ROUNDS = 16_384, 1024, 256, 8
HOME, OTHER = 2048, 65_536


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, good): v as doubles; good ones take part."""
    small_batches(vectors.sparkSession)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).withColumn("good", F.coalesce(fits, F.lit(False)))


def classes(rows: DataFrame) -> DataFrame:
    """(cid, h1, h2, id, n, v): distinct vectors in order of their least id, cid a long in that order; a saved table."""
    same = rows.where("good").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("h1"), F.col("h2")]
    return save(same.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column, with zeros up to width."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        out = flat_rows(column, width).copy()
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares of the largest doubles would overflow
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


class Grid:
    """Codebooks of the two halves, and the traversal of their product."""

    def __init__(self, books: list[np.ndarray], link: float = LINK, recall: float = RECALL):
        self.books, self.k, self.recall = books, len(books[0]), recall
        width = sum(b.shape[1] for b in books)
        self.half = books[0].shape[1]
        self.variance = max(2 * (1 - link), 1e-12) / width
        self.gaps = [np.sqrt(np.maximum(self._squares(b, b), 1e-12)) for b in books]

    @staticmethod
    def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)

    def steps(self, x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared step to each centroid's region) of the rows' halves."""
        part = x[:, : self.half] if half == 0 else x[:, self.half :]
        d = self._squares(part, self.books[half])
        out = np.zeros_like(d)
        for m in range(self.k):
            np.maximum(out, (d - d[:, m : m + 1]) / (2 * self.gaps[half][:, m]), out=out)
        home = d.argmin(axis=1)
        out[np.arange(len(x)), home] = 0
        return home, out * out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row; row and cell of each visit, the home first and others in traversal order)."""
        n, k = len(x), self.k
        (home1, first), (home2, second) = self.steps(x, 0), self.steps(x, 1)
        order1, order2 = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
        r, s = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        weigh = lambda q: np.exp(-q / (2 * self.variance))
        left = weigh(r).sum(axis=1) * weigh(s).sum(axis=1)
        stop = left * (1 - self.recall)
        # at[row, a] is the next place in the second list for place a of the first; the least sum over a is the next cell.
        at = np.zeros((n, k), np.int64)
        s = np.hstack([s, np.full((n, 1), np.inf)])
        head = r + s[:, :1]
        live = np.arange(n)
        rows, cells = [], []
        while len(live):
            a = head[live].argmin(axis=1)
            b = at[live, a]
            rows.append(live)
            cells.append(order1[live, a] * k + order2[live, b])
            left[live] -= weigh(head[live, a])
            at[live, a] = b + 1
            head[live, a] = r[live, a] + s[live, b + 1]
            live = live[(left[live] > stop[live]) & np.isfinite(head[live].min(axis=1))]
        return home1 * k + home2, np.concatenate(rows), np.concatenate(cells)


def fitted(table: DataFrame, n: int, width: int, link: float, recall: float) -> Grid:
    """Codebooks by k-means on the bounded sample."""
    k = int(min(MAX_CENTROIDS, max(1, np.ceil(np.sqrt(n / PER_CELL)))))
    sample = table.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()
    x = matrix(sample.column(0).combine_chunks(), width)
    books = []
    for part in (x[:, : width - width // 2], x[:, width - width // 2 :]):
        book = part[:: max(1, len(part) // k)][:k].copy()
        for _ in range(FIT_ROUNDS):
            near = Grid._squares(part, book).argmin(axis=1)
            size = np.bincount(near, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, near, part)
            book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book)
        books.append(book)
    return Grid(books, link, recall)


_PLACED = "cell int, block int, part int, visitor boolean, cid long, n long, v array<double>"


def _dealt(cid: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """An even deal of class ids into parts."""
    return ((cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def placed(table: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Rows by (cell, block of homes, part of others); a home row leads its block, in each part, all others are compared with them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visits = np.zeros(grid.k**2, np.int64), np.zeros(grid.k**2, np.int64)
        for batch in batches:
            if batch.num_rows:
                home, row, cell = grid.visits(matrix(batch.column(0), width))
                homes += np.bincount(home, minlength=len(homes))
                visits += np.bincount(cell[cell > home[row]], minlength=len(visits))
        used = np.flatnonzero(homes + visits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(homes[used]), pa.array(visits[used])], ["cell", "homes", "visits"])

    # At most MAX_CENTROIDS squared rows.
    sizes = table.select("v").mapInArrow(count, "cell int, homes long, visits long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).collect()
    blocks, parts = np.zeros(grid.k**2, np.int64), np.ones(grid.k**2, np.int64)
    for r in sizes:
        blocks[r["cell"]] = -(-r["homes"] // HOME)
        parts[r["cell"]] = max(1, -(-(r["homes"] + r["visits"]) // OTHER))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, rows, cell, block, part, visitor):
            at = pa.array(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), visitor)), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)],
                [c.split()[0] for c in _PLACED.split(", ")],
            )

        def repeated(rows, times):
            """rows, each so many times, with a number for each time."""
            again = np.repeat(np.arange(len(rows)), times)
            return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)

        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            home, row, cell = grid.visits(matrix(batch.column(2), width))
            rows, block = np.arange(len(cid)), _dealt(cid, blocks[home])
            again, part = repeated(rows, parts[home])
            yield out(batch, again, home[again], block[again], part, False)
            # Homes of later blocks, then visitors, to every block that they meet.
            again, earlier = repeated(rows, block)
            yield out(batch, again, home[again], earlier, _dealt(cid[again] + 1, parts[home[again]]), True)
            away = (cell > home[row]) & (blocks[cell] > 0)
            row, cell = row[away], cell[away]
            again, block = repeated(row, blocks[cell])
            yield out(batch, row[again], cell[again], block, _dealt(cid[row[again]] + 1, parts[cell[again]]), True)

    return table.select("cid", "n", "v").mapInArrow(place, _PLACED)


class Block:
    """One block of homes: what it meets is counted, and links are reduced to a forest."""

    def __init__(self, width: int, link: float, first: bool):
        self.width, self.link, self.first = width, link, first
        self.cid, self.n, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
        self.closed = False
        self.edges: list[tuple[int, int]] = []
        self.counts: dict[int, int] = {}

    def homes(self, cid, n, x) -> None:
        self.cid, self.n, self.x = np.r_[self.cid, cid], np.r_[self.n, n], np.vstack([self.x, x])

    def close(self) -> None:
        """All homes are there. Pairs of homes count in the first part only."""
        if self.closed:
            return
        self.closed = True
        self.links = np.zeros(len(self.cid), np.int64)
        self.root = np.arange(len(self.cid))
        if len(self.cid):
            hit = self.x @ self.x.T >= self.link
            np.fill_diagonal(hit, False)
            if self.first:
                self.links += hit @ self.n
            for h in np.flatnonzero(hit.any(axis=1)):
                self._join(np.r_[h, np.flatnonzero(hit[h])])

    def _join(self, members: np.ndarray) -> None:
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            low = roots[0]
            self.edges.extend((int(self.cid[r]), int(self.cid[low])) for r in roots[1:])
            self.root[np.isin(self.root, roots)] = low

    def others(self, cid, n, x) -> None:
        self.close()
        if not len(self.cid):
            return
        hit = x @ self.x.T >= self.link
        self.links += hit.T @ n
        for o in np.flatnonzero(hit.any(axis=1)):
            members = np.flatnonzero(hit[o])
            self.counts[int(cid[o])] = self.counts.get(int(cid[o]), 0) + int(self.n[members].sum())
            self._join(members)
            self.edges.append((int(cid[o]), int(self.cid[self.root[members[0]]])))

    def result(self) -> list[tuple[int, int, int | None]]:
        """(cid, links, other): counts with no other, and edges with no count."""
        self.close()
        found = [(int(c), int(k), None) for c, k in zip(self.cid, self.links, strict=True) if k]
        return [*found, *((c, k, None) for c, k in self.counts.items()), *((a, 0, b) for a, b in self.edges)]


def compared(rows: DataFrame, width: int, link: float) -> DataFrame:
    """(cid, links, other) of the placed rows: partial counts, and links of a forest that connects what is linked."""
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            cell, number, part, visitor, cid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            key = np.stack([cell, number, part, visitor.astype(np.int32)], axis=1) if len(cid) else np.zeros((0, 4), np.int32)
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            x = matrix(batch.column(6), width) if len(cid) else None
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if tuple(key[a, :3]) != at:
                    if block is not None and (found := block.result()):
                        yield batch_of(found)
                    at, block = tuple(key[a, :3]), Block(width, link, key[a, 2] == 0)
                (block.others if key[a, 3] else block.homes)(cid[a:b], n[a:b], x[a:b])
        if block is not None and (found := block.result()):
            yield batch_of(found)

    key = ["cell", "block", "part"]
    return rows.repartition(*key).sortWithinPartitions(*key, "visitor").mapInArrow(emit, "cid long, links long, other long")


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", link: float = LINK, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = unit_rows(vectors, id_col, vector_col).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    table = classes(rows)
    n, width = table.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n:
        grid = fitted(table, n, width, link, recall)
        found = save(compared(placed(table, grid, width), width, link), "found")
        release(vectors.sparkSession)
        counts = found.where("links > 0").groupBy("cid").agg(F.sum("links").alias("links"))
        roots = save(components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))), "roots")
        # cid follows the ids, so the root's id is the component's least.
        names = save(table.join(roots.select(F.col("root").alias("cid")).distinct(), "cid").select(F.col("cid").alias("root"), F.col("id").alias("low")), "names")
        lows = join_small(roots, names, ["root"], "node").select(F.col("node").alias("cid"), "low", F.lit(True).alias("moved"))
        outcome = table.select("cid", "h1", "h2", "id", "n").join(counts, "cid", "left").join(lows, "cid", "left")
        low = F.when(F.col("moved"), F.col("low")).otherwise(F.col("id"))
        outcome = outcome.select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), low.alias("component_id"), F.col("id").alias("only"))
    else:
        outcome = table.select("h1", "h2", "n", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").alias("only"))
    return _per_row(rows, outcome)


#: A class of equal vectors is copied so many times, so that its rows are joined in as many tasks.
SALTS = 32


def _per_row(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    # A class of one row has one copy, that of the row's id.
    copies = F.when(F.col("n") == 1, F.array(salt("only"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    outcome = outcome.select("h1", "h2", "n_links", "component_id", F.explode(copies).alias("salt"))
    good = rows.where("good").select("id", "h1", "h2", salt("id").alias("salt")).join(outcome, ["h1", "h2", "salt"], "left")
    good = good.select("id", F.col("n_links"), F.col("component_id"))
    rest = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op13_vector_links(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
