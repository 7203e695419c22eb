"""Operator 10, MinHash near-dedup with sequential Bayesian verification.

1. One pass makes each text's shingle set, its 128-bit digest, band keys and an 8-bit signature. Texts of one set are a
   class, and only its least id goes on.
2. Classes that share a band key are candidates. Within a bucket, signatures are compared batch by batch, and a pair goes
   as soon as the posterior probability of a similarity of THRESHOLD falls under MISS. Of the rest, only as many pairs
   leave the bucket as connect it (a greatest spanning forest by estimate), never all pairs of a group.
   The first round takes a few bands, to connect large groups cheaply; the second takes all bands, over buckets whose
   members aren't connected yet. What both connect is a family: no surviving pair crosses families.
3. The forest's pairs are verified exactly on full sets; links give components. The texts needed are looked up once.
4. Where some pair of the forest failed, its family may still hold links between its components. A family of up to FAMILY
   members is settled by exact intersections; a larger one goes through its buckets again with more partners per text each
   time (8, 64, ...), until no untested pair across components is left.
   So no pair that survived step 2 goes unverified unless its ends are already connected.

No task holds a whole bucket or family beyond a fixed size: members are dealt into parts, and a task compares one part, or
one part with another (blocks()). Members of the group's largest component (of a bucket: its least) meet the others alone.

A link of similarity exactly 0.75 shares no band with probability (1 - 0.75**ROWS)**BANDS, about 6e-5, and fails step 2 with
probability 7e-6; at 0.8 these are 6e-7 and 4e-8.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing. Under five words the
whole sequence is the one shingle. Repeated rows are copies like any other; other texts of one id, or of
the null id, are texts of their own, with that id as theirs. A null id sorts before all ids. Columns other
than the id and the text are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.components import components
from tributary.llm.shared import drop, keyed_text, named, only_ids, release, save, with_keys

THRESHOLD = 0.75
SHINGLE = 5
BANDS = 36
ROWS = 5
HASHES = BANDS * ROWS
#: Hashes compared before each look at the posterior, and the chosen probability of losing a true pair there.
BATCH = 30
MISS = 1e-6
#: Bands of the first round, which connects the large groups cheaply.
FIRST_BANDS = 6
#: Members of a part of a bucket; a task compares two parts at most.
CHUNK = 512
#: Members of a family that is settled by exact intersections, and members and text bytes of its parts.
FAMILY = 4096
PART = 256
PART_BYTES = 4 << 20

_A = (A._stream(HASHES, 41) >> A.U(32)).astype(np.uint32) | np.uint32(1)
_B = (A._stream(HASHES, 42) >> A.U(32)).astype(np.uint32)


def shingle_sets(part: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, end to end, and the rows' bounds."""
    w = A.words(part, A.SPACES, A.LOWER)
    prefix = A.ITEMS[0].prefix(w.hashes())
    grams = A.ITEMS[0].windows(prefix, SHINGLE)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(A.mix(A.ITEMS[0].ranges(prefix, np.array([a]), np.array([b])) + A.U(b - a)))
        else:
            out.append(np.zeros(0, A.U))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, A.U)), bounds


def _sketch(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: two digests, band keys, 8-bit signature. Rows with an empty set get zeros."""
    n = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds) > 0)
    at = bounds[full]
    digests = np.zeros((2, n), A.U)
    keys = np.zeros((n, BANDS), A.U)
    signature = np.zeros((n, HASHES), np.uint8)
    if len(full):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            digests[k, full] = np.add.reduceat(A.mix(sets ^ A.U(salt)), at)
        x = (sets >> A.U(32)).astype(np.uint32)
        for band in range(BANDS):
            acc = np.full(len(full), band + 1, A.U)
            for r in range(ROWS):
                h = band * ROWS + r
                least = np.minimum.reduceat((x ^ _B[h]) * _A[h], at)
                acc = A.mix(acc ^ (least.astype(A.U) * A.U(0x9E3779B97F4A7C15)))
                signature[full, h] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            keys[full, band] = acc
    return digests[0], digests[1], keys, signature


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc")
        for part in A.slices(batch.column("text")):
            sets, bounds = shingle_sets(part)
            d1, d2, keys, signature = _sketch(sets, bounds)
            n = len(d1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(part.first, n),
                    pa.array(np.diff(bounds)),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                names=["doc", "n_shingles", "d1", "d2", "keys", "signature"],
            )


@lru_cache
def least_matches(threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH, total: int = HASHES) -> tuple[int, ...]:
    """After each batch the least matches at which P(similarity >= threshold | matches), uniform prior, is `miss` or more."""
    out = []
    for n in range(batch, total + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return tuple(out)


def estimates(signatures: np.ndarray, components_: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Matrix of matches of pairs that survive the sequential test; -1 where pruned, HASHES + 1 within a component.

    With sides, only pairs of different sides are tested (or all pairs, where the sides are ALL).
    """
    m = len(signatures)
    out = np.full((m, m), -1, np.int16)
    least = least_matches()
    side = np.full(m, ALL) if side is None else side
    for i in range(m - 1):
        alive = np.arange(i + 1, m)
        same = components_[alive] == components_[i]
        out[i, alive[same]] = HASHES + 1
        alive = alive[~same & ((side[alive] != side[i]) | (side[i] == ALL))]
        matches = np.zeros(len(alive), np.int16)
        for k, floor in enumerate(least):
            if not len(alive):
                break
            cut = slice(k * BATCH, (k + 1) * BATCH)
            matches += (signatures[alive, cut] == signatures[i, cut]).sum(1, dtype=np.int16)
            keep = matches >= floor
            alive, matches = alive[keep], matches[keep]
        out[i, alive] = matches
    return np.maximum(out, out.T)


def spanning_pairs(matches: np.ndarray) -> list[tuple[int, int]]:
    """Greatest spanning forest of the surviving pairs; links within a component cost nothing and aren't returned."""
    m = len(matches)
    best, parent = np.full(m, -1, np.int16), np.full(m, -1)
    todo = np.ones(m, bool)
    out = []
    for _ in range(m):
        i = int(np.argmax(np.where(todo, best, -2)))
        todo[i] = False
        if 0 <= best[i] <= HASHES:
            out.append((int(parent[i]), i))
        better = todo & (matches[i] > best)
        best[better], parent[better] = matches[i][better], i
    return out


def best_pairs(matches: np.ndarray, partners: int) -> tuple[list[tuple[int, int]], bool]:
    """The `partners` best surviving pairs of each member across components, and whether any were left out."""
    open_ = np.where(matches <= HASHES, matches, -1)
    out, cut = set(), False
    for i in range(len(open_)):
        found = np.flatnonzero(open_[i] >= 0)
        if len(found) > partners:
            found, cut = found[np.argsort(-open_[i][found], kind="stable")[:partners]], True
        out.update((min(i, int(j)), max(i, int(j))) for j in found)
    return sorted(out), cut


def _pairs(partners: int):
    def bucket(rows: pa.Table) -> pa.RecordBatch:
        doc, comp_ = rows.column("doc").to_numpy(), rows.column("component").to_numpy()
        signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(doc), HASHES)
        matches = estimates(signatures, comp_, rows.column("side").to_numpy())
        pairs, cut = (spanning_pairs(matches), False) if partners == 1 else best_pairs(matches, partners)
        a, b = (doc[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        rest = [None] * cut
        return pa.RecordBatch.from_arrays([pa.array([*np.minimum(a, b).tolist(), *rest], pa.int64()), pa.array([*np.maximum(a, b).tolist(), *rest], pa.int64())], names=["a", "b"])

    return grouped(["key", "block"], bucket)


#: Side of rows whose block compares all its pairs.
ALL = -1
#: Bits of a part's number in a block's name.
PART_BITS = 20


def blocks(rows: DataFrame, inner, inner_parts, outer_parts, whole) -> DataFrame:
    """rows (with doc) dealt to blocks of two parts: columns block and side.

    inner says which rows are of the group's skipped component; its rows lie in inner_parts parts, the others in
    outer_parts. Every pair with an outer member meets in exactly one block: inside an outer part (side ALL), between two
    outer parts, or between an outer and an inner one. Pairs of inner members meet nowhere. Groups that are `whole` are one
    block. All arguments but rows are column expressions.
    """
    one = F.lit(1).cast("long")
    name = lambda kind, i, j: F.struct((F.lit(kind).cast("long") * (1 << 2 * PART_BITS) + i * (1 << PART_BITS) + j).alias("block"), F.lit(0).alias("side"))
    at = lambda place, side: F.struct(place["block"].alias("block"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(one - 1, n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    own = F.pmod(F.xxhash64("doc"), F.when(inner, inner_parts).otherwise(outer_parts).cast("long"))
    among = F.concat(
        F.transform(F.filter(upto(outer_parts), lambda j: j > own), lambda j: at(name(1, own, j), 0)),
        F.transform(F.filter(upto(outer_parts), lambda i: i < own), lambda i: at(name(1, i, own), 1)),
        F.array(at(name(1, own, own), ALL)),
        F.transform(upto(inner_parts), lambda j: at(name(2, own, j), 0)),
    )
    meets = F.when(whole, F.array(at(name(0, one - 1, one - 1), ALL))).when(inner, F.transform(upto(outer_parts), lambda i: at(name(2, i, own), 1))).otherwise(among)
    return rows.withColumn("meets", F.explode(meets)).select(*rows.columns, F.col("meets.block").alias("block"), F.col("meets.side").alias("side"))


def candidate_pairs(reps: DataFrame, roots: DataFrame | None, bands: int, partners: int) -> DataFrame:
    """Pairs (a, b), saved, of classes in different components that share one of the first `bands` keys and pass the Bayesian test.

    A row of nulls says that some member had more than `partners` such pairs (with partners=1, a forest, it isn't said).
    """
    rows = reps.select("doc", F.slice("keys", 1, bands).alias("keys"))
    if roots is None:
        rows = rows.withColumn("component", F.col("doc"))
    else:
        rows = rows.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("doc", "keys", F.coalesce("root", "doc").alias("component"))
    rows = rows.select(F.explode("keys").alias("key"), "doc", "component")
    # Buckets of one component have nothing left to test.
    of_least = F.count(F.when(F.col("component") == F.col("low"), 1))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "n", "low")
    rows = kept = save(rows.join(buckets, "key"), "buckets")
    chunk = lambda n: F.ceil(n / CHUNK).cast("long")
    if bands < BANDS:
        # A bucket beyond CHUNK is cut; its least member joins every part, which ties the parts together.
        own = F.pmod(F.xxhash64("doc"), chunk(F.col("n")))
        parts = F.when(F.col("doc") == F.col("low"), F.sequence(F.lit(0).cast("long"), chunk(F.col("n")) - 1)).otherwise(F.array(own))
        rows = rows.select("key", "doc", "component", F.explode(parts).alias("block"), F.lit(ALL).alias("side"))
    else:
        # Only buckets beyond CHUNK need to know how many members their least component has.
        large = rows.where(F.col("n") > CHUNK).groupBy("key").agg(of_least.alias("n_low"))
        rows = rows.join(large, "key", "left")
        n_low = F.coalesce("n_low", F.lit(0).cast("long"))
        inner = F.col("component") == F.col("low")
        rows = blocks(rows, inner, chunk(n_low), chunk(F.col("n") - n_low), F.col("n") <= CHUNK)
    rows = rows.select("key", "block", "side", "doc", "component").join(reps.select("doc", "signature"), "doc")
    dealt = rows.select("key", "block", "side", "doc", "component", "signature").repartition("key", "block").sortWithinPartitions("key", "block", "doc")
    out = save(dealt.mapInArrow(_pairs(partners), "a long, b long").distinct(), "candidates")
    drop(kept)
    return out


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()


def exact_links(need: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with `linked`: 100 * intersection >= 75 * union of their full sets. need: the texts of all ends."""
    one = pairs.join(need.select(F.col("doc").alias("a"), F.col("text").alias("left")), "a")
    both = one.join(need.select(F.col("doc").alias("b"), F.col("text").alias("right")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left", "right"):
                sets = []
                for part in A.slices(batch.column(name)):
                    flat, bounds = shingle_sets(part)
                    sets += [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                sides.append(sets)
            linked = []
            for x, y in zip(*sides, strict=True):
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both_ > 0 and 100 * both_ >= 75 * (len(x) + len(y) - both_))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return save(both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long, linked boolean"), "verified")


def joining_links(sets: list[np.ndarray], components_: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect components of one family: every pair across components is decided by its exact intersection.

    With sides, every pair across components and sides (or all, where the sides are ALL).
    """
    side = np.full(len(sets), ALL) if side is None else side
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    _, label, count = np.unique(flat[order], return_inverse=True, return_counts=True)
    posting, bounds = owner[order], np.concatenate([[0], np.cumsum(count)])
    gram = np.empty(len(flat), np.int64)
    gram[order] = label
    own = np.concatenate([[0], np.cumsum(size)])
    group = np.unique(components_, return_inverse=True)[1]
    if side[0] == ALL:
        # One component as given, the largest, is skipped: every pair across components has a member outside it.
        skipped = group == np.argmax(np.bincount(group))
    else:
        skipped = side == np.argmax(np.bincount(side))
    out = []
    for i in np.flatnonzero(~skipped).tolist():
        grams = gram[own[i] : own[i + 1]]
        both = np.bincount(posting[A.concatenated(bounds[grams], bounds[grams + 1])], minlength=len(sets))
        linked = np.flatnonzero((both > 0) & (100 * both >= 75 * (size + size[i] - both)) & (group != group[i]) & ((side != side[i]) | (side[i] == ALL)))
        for j in linked.tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def grouped(columns: list[str], handle) -> object:
    """mapInArrow function over rows sorted by long `columns`: handle gets each group of two or more as a table."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            parts = np.zeros(max(0, table.num_rows - 1), bool)
            for column in columns:
                key = table.column(column).to_numpy()
                parts |= key[1:] != key[:-1]
            a = 0
            for b in (np.flatnonzero(parts) + 1).tolist():
                if b - a > 1:
                    yield handle(table.slice(a, b - a))
                a = b
            rest = table.slice(a)
        if rest is not None and rest.num_rows > 1:
            yield handle(rest)

    return emit


def family_links(need: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b, linked) that settle families: members are rows (doc, component, family), of FAMILY docs at most.

    A family beyond PART members or PART_BYTES is dealt into blocks of two parts. Each gives the links that connect its components.
    """

    def settle(rows: pa.Table) -> pa.RecordBatch:
        doc, comp_ = rows.column("doc").to_numpy(), rows.column("component").to_numpy()
        sets = []
        for part in A.slices(rows.column("text")):
            flat, bounds = shingle_sets(part)
            sets += [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        pairs = np.array(joining_links(sets, comp_, rows.column("side").to_numpy()), np.int64).reshape(-1, 2)
        a, b = doc[pairs[:, 0]], doc[pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.ones(len(a), bool))], names=["a", "b", "linked"])

    sized = members.join(need.select("doc", F.octet_length("text").cast("long").alias("bytes")), "doc")
    comps = sized.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    totals = comps.groupBy("family").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component")).alias("most"))
    parts = lambda n, size: F.greatest(F.ceil(n / PART), F.ceil(size / PART_BYTES), F.lit(1)).cast("long")
    rows = members.join(totals, "family")
    n_in, size_in = F.col("most.n"), F.col("most.bytes")
    whole = (F.col("n") <= PART) & (F.col("bytes") <= PART_BYTES)
    rows = blocks(rows, F.col("component") == F.col("most.component"), parts(n_in, size_in), parts(F.col("n") - n_in, F.col("bytes") - size_in), whole)
    rows = rows.select("family", "block", "side", "doc", "component").join(need.select("doc", "text"), "doc").select("family", "block", "side", "doc", "component", "text")
    return rows.repartition("family", "block").sortWithinPartitions("family", "block", "doc").mapInArrow(grouped(["family", "block"], settle), "a long, b long, linked boolean").distinct()


def open_families(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (doc, component, family) of families that hold more than one component."""
    ends = ends_of(tested).withColumnRenamed("doc", "node")
    families = components(tested.select("a", "b")).withColumnRenamed("root", "family")
    rows = ends.join(families, "node", "left").select("node", F.coalesce("family", "node").alias("family"))
    rows = rows.join(roots, "node", "left").select("node", "family", F.coalesce("root", "node").alias("component"))
    several = rows.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family")
    return save(rows.join(several, "family", "left_semi").select(F.col("node").alias("doc"), "component", "family"), "families")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links) and kept (the id is the component's own)."""
    keyed, keys = with_keys(docs, id_col, text_col)
    texts = keyed_text(keyed, text_col)
    spark = docs.sparkSession
    signed = save(texts.mapInArrow(_sign, "doc long, n_shingles long, d1 long, d2 long, keys array<long>, signature binary"), "signatures")
    one_set = ["n_shingles", "d1", "d2"]
    filled = signed.where("n_shingles > 0")
    classes = save(filled.groupBy(*one_set).agg(F.min("doc").alias("rep")), "classes")
    reps = save(filled.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "keys", "signature").dropDuplicates(["doc"]), "reps")
    release(spark)
    first = candidate_pairs(reps, None, FIRST_BANDS, 1)
    second = candidate_pairs(reps, components(first), BANDS, 1)
    forest = first.unionByName(second).distinct()
    # Rows that repeat an id (copies of one row) give one text.
    need = save(only_ids(texts, save(ends_of(forest), "ends")).dropDuplicates(["doc"]), "texts")
    release(spark)
    tested = exact_links(need, forest)
    roots = components(tested.where("linked").select("a", "b"))
    open_ = open_families(tested, roots)
    size = open_.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    small = open_.join(size.where(F.col("n") <= FAMILY).select("family"), "family", "left_semi")
    tested = tested.unionByName(save(family_links(need, small), "settled"))
    large = save(open_.join(size.where(F.col("n") > FAMILY).select("family"), "family", "left_semi").select("doc"), "large")
    roots = components(tested.where("linked").select("a", "b"))
    release(spark)
    partners, cut = 1, large.limit(1).count()
    among = reps.join(large, "doc", "left_semi")
    while cut:
        partners *= 8
        raw = candidate_pairs(among, roots, BANDS, partners)
        cut = raw.where("a is null").limit(1).count()
        pairs = raw.where("a is not null").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(exact_links(need, pairs))
        roots = components(tested.where("linked").select("a", "b"))
        drop(raw)
        release(spark)
    rep = signed.join(classes, one_set, "left").select("doc", "n_shingles", F.coalesce("rep", "doc").alias("rep"))
    out = rep.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("root", "rep"))
    out = named(named(out.select("doc", "n_shingles", "component"), keys), keys, "component", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
