"""Operator 8, benchmark decontamination by suffix arrays of the training shards.

Each shard (a slice of documents) gets a suffix array of its words: the starts of suffixes, sorted by their first WINDOW
words. Words that no benchmark item has are one number, and suffixes whose first two words start no benchmark window
are left out, as no search could end at them. Every test suffix (a window of an item) is binary-searched in every shard;
the range found holds all its verbatim occurrences, and overlapping ones give the longest matches. The benchmark goes to
the tasks in blocks of about BLOCK_BYTES of text, dealt by a hash of the item. The driver reads one block at a time, and each
pass but the last is written before the next block is read; more blocks mean more passes, never a larger driver or broadcast.

Edge cases: null and empty texts, and texts without words, have no hits. An item of under WINDOW words is one window; one
without words has none. Rows that repeat an item_id count as one item. A null item_id reads 'null'. Columns other than
ids and texts are never read; an empty benchmark leaves all documents clean. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import id_and_text, id_of, rows_and_text, save, with_row

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: A document goes if its hits are this part of its words, as 1 / SHARE.
SHARE = 20
FOUND = "n_words long, items array<string>, lo array<long>, hi array<long>"


@dataclass
class Tests:
    """Distinct windows of benchmark items over a vocabulary of word hashes."""

    vocabulary: np.ndarray
    low: np.ndarray  # sort keys: least and greatest suffix that starts with the window
    high: np.ndarray
    size: np.ndarray
    item: np.ndarray  # items of window w: item[bounds[w]:bounds[w + 1]]
    bounds: np.ndarray
    names: list[str]
    singles: np.ndarray  # numbers of first words of one-word windows
    pairs: np.ndarray  # first two words of the other windows


def _keys(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype(">u4")).view(f"S{4 * WINDOW}")[:, 0]


def tests_of(items: list[tuple[str, str]]) -> Tests:
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    hashes, owner = [], []
    for part in A.slices(pa.array([text for _, text in items], pa.string())):
        w = A.words(part, A.PUNCTUATION, A.LOWER)
        h = w.hashes()
        for r in range(len(w.bounds) - 1):
            hashes.append(h[w.bounds[r] : w.bounds[r + 1]])
            owner.append(number[items[part.first + r][0]])
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, A.U)
    rows, sizes, items_ = [], [], []
    for h, k in zip(hashes, owner, strict=True):
        n = min(len(h), WINDOW)
        if n:
            ids = np.searchsorted(vocabulary, h) + 1
            at = np.arange(len(h) - n + 1)[:, None] + np.arange(n)
            window = np.zeros((len(at), WINDOW), np.int64)
            window[:, :n] = ids[at]
            rows.append(window)
            sizes.append(np.full(len(at), n))
            items_.append(np.full(len(at), k))
    tokens = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int64)
    size = np.concatenate(sizes) if rows else np.zeros(0, np.int64)
    item = np.concatenate(items_) if rows else np.zeros(0, np.int64)
    # Windows of one content, with the items that hold it.
    tagged = np.concatenate([tokens, size[:, None]], 1)
    distinct, inverse = np.unique(tagged, axis=0, return_inverse=True) if len(tagged) else (tagged, np.zeros(0, np.int64))
    held = np.unique(np.stack([inverse.ravel(), item], 1), axis=0) if len(tagged) else np.zeros((0, 2), np.int64)
    tokens, size = distinct[:, :WINDOW], distinct[:, WINDOW]
    high = np.where(np.arange(WINDOW) < size[:, None], tokens, 0xFFFFFFFF)
    return Tests(
        vocabulary, _keys(tokens), _keys(high), size, held[:, 1], np.searchsorted(held[:, 0], np.arange(len(distinct) + 1)), names,
        np.unique(tokens[size == 1, 0]), np.unique(tokens[size > 1, 0] << 32 | tokens[size > 1, 1]),
    )


def shard_array(ids: np.ndarray, bounds: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts in order, and their keys: the first WINDOW words, zeros past the document's end."""
    n = len(ids)
    end = np.repeat(bounds[1:], np.diff(bounds))
    following = np.append(ids[1:], 0)
    start = np.isin(ids, tests.singles)
    inside = np.flatnonzero((ids > 0) & (following > 0) & (np.arange(n) + 1 < end))
    start[inside[np.isin(ids[inside] << 32 | following[inside], tests.pairs)]] = True
    place = np.flatnonzero(start)
    at = place[:, None] + np.arange(WINDOW)
    tokens = np.where(at < end[place][:, None], ids[np.minimum(at, n - 1)], 0) if n else np.zeros((0, WINDOW), np.int64)
    # Zeros stand for unknown words and ends alike: no window holds one.
    keys = _keys(tokens)
    order = np.argsort(keys, kind="stable")
    return place[order], keys[order]


def search(part: A.Slice, tests: Tests) -> tuple[np.ndarray, list[set[str]], list[tuple[np.ndarray, np.ndarray]]]:
    """Of each row of a shard: its words, the items found, and the word ranges hit."""
    w = A.words(part, A.PUNCTUATION, A.LOWER)
    n_rows = len(part.offsets) - 1
    items: list[set[str]] = [set() for _ in range(n_rows)]
    hit = np.zeros(len(w.start), bool)
    if len(tests.size) and len(w.start):
        h = w.hashes()
        k = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
        ids = np.where(tests.vocabulary[k] == h, k + 1, 0)
        place, keys = shard_array(ids, w.bounds, tests)
        first, last = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
        found = np.flatnonzero(last > first)
        window = np.repeat(found, (last - first)[found])
        at = place[A.concatenated(first[found], last[found])]
        hit = A.covered(at, at + tests.size[window], len(w.start))
        row = np.searchsorted(w.bounds, at, side="right") - 1
        for r, t in np.unique(np.stack([row, window], 1), axis=0).tolist():
            items[r].update(tests.names[i] for i in tests.item[tests.bounds[t] : tests.bounds[t + 1]])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.diff(w.bounds), items, [A.runs(hit[w.bounds[r] : w.bounds[r + 1]]) if items[r] else none for r in range(n_rows)]


def _pass(tests: Tests, last: bool):
    """One block of the benchmark over all rows; what earlier blocks found is in the rows. The last pass drops the text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            rows, earlier = batch.column("row"), [batch.column(c).to_pylist() for c in ("items", "lo", "hi")]
            for part in A.slices(batch.column("text"), SHARD_BYTES):
                n_words, items, spans = search(part, tests)
                lo, hi = [], []
                for r, (a, b) in enumerate(spans):
                    old_items, old_lo, old_hi = (x[part.first + r] for x in earlier)
                    if old_items:
                        items[r].update(old_items)
                        a, b = A.runs(A.covered(np.append(a, old_lo).astype(np.int64), np.append(b, old_hi).astype(np.int64), int(n_words[r])))
                    lo.append(a)
                    hi.append(b)
                n = len(spans)
                found = [pa.array(n_words), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(lo, lists), pa.array(hi, lists)]
                names = ["n_words", "items", "lo", "hi"]
                if not last:
                    found, names = [*found, batch.column("text").slice(part.first, n)], [*names, "text"]
                yield pa.RecordBatch.from_arrays([rows.slice(part.first, n), *found], names=["row", *names])

    return emit


def matched(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """rows (row, text) with n_words, items, lo, hi, n_hit and contaminated; nothing is shuffled."""
    empty = F.array().cast("array<long>")
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "lo": empty, "hi": empty})
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // BLOCK_BYTES
    for k in range(n_blocks):
        tests = tests_of(_block(items, k, n_blocks))
        last = k == n_blocks - 1
        out = out.mapInArrow(_pass(tests, last), with_row(rows, FOUND if last else f"{FOUND}, text string"))
        if not last:
            out = save(out, f"pass-{k}")
    lengths = F.zip_with("hi", "lo", lambda a, b: a - b)
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumns({"n_hit": n_hit, "longest": F.coalesce(F.array_max(lengths), F.lit(0).cast("long"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _block(items: DataFrame, k: int, n_blocks: int) -> list[tuple[str, str]]:
    """Items of block k. Rows of one item_id share a block."""
    return [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with occurring windows, sorted), longest (longest match in words), contaminated."""
    rows = id_and_text(docs, id_col, text_col).withColumnRenamed("doc", "row")
    return matched(rows, benchmark, item_col, item_text_col).select(id_of("row"), "n_words", "n_hit", "items", "longest", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that no item contaminates."""
    return matched(rows_and_text(docs, text_col), benchmark).where("not contaminated").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
