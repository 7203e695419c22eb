"""Operator 9, substring dedup over a log-structured fingerprint index.

Fingerprints are the minimisers of 35-word windows (repeats.py). The documents come in batches. Of each batch the index keeps the
places of its fingerprints, as they come, and a sorted immutable run that counts them; the run is merge-joined with the runs of
history, and full levels are compacted into the next. A fingerprint that a batch shares with history or holds twice is a hit: its
places, old and new, are read from the index and verified by two independent 64-bit digests, of a whole run of windows (equal
runs) or of each window's 35 words, before a word goes. Counts are summed before they are shuffled, so that a passage on a third
of all documents is one row per task there.

Edge cases: null and empty texts, and texts under 35 words, have no window and stay as they are. Rows that repeat a
doc_id and its text are copies like any other; other texts of one id, or of the null id, are texts of their own. Columns other than the id and the text are never read. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm import repeats as R
from tributary.llm.shared import keyed_text, named, read_texts, release, remove, save, shared_path, small_batches, with_keys, write_text

WINDOW = 35
SUB = 12
#: Batches that the documents of one call are ingested in; a level is compacted among them.
BATCHES = 5


#: Session settings under which runs are merged. The first lets Spark use the order of their files, where a bucket is one file, so
#: that merge joins don't sort again. The second is needed for right results in Spark 4.1: there a union of bucketed tables passes
#: for partitioned by the bucket, though its tasks are not, and a shuffle after it is left out.
SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FingerprintIndex:
    """Places of fingerprints by batch, and levels of sorted immutable runs (anchor, n) that count them, under one shared folder.

    A run is a table bucketed and sorted by its fingerprint (anchor), all in as many buckets, so runs are merge-joined bucket by
    bucket without a shuffle. A run on level L holds up to FANOUT**L batches. Each change is committed by a new manifest file;
    opening the folder again, after a crash too, continues from the last whole manifest.
    """

    FANOUT = 4
    RUN = "anchor long, n long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "index")
        self.version, self.levels, self.batches, self.text_folders, self.next_doc = 0, [[]], [], [], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name, text in reversed(read_texts(spark, self.path, "manifest-")):
            try:
                state = json.loads(text)
            except ValueError:  # the driver was lost while it wrote
                continue
            self.version, self.levels, self.buckets, self.batches = int(name.split("-")[1]), state["levels"], state["buckets"], state["batches"]
            self.text_folders, self.next_doc = state.get("texts", []), state.get("next", 0)
            break

    def _commit(self, levels: list[list[str]], batches: list[str]) -> None:
        self.version += 1
        write_text(self.spark, f"{self.path}/manifest-{self.version:08d}-{uuid.uuid4().hex}", json.dumps({"levels": levels, "buckets": self.buckets, "batches": batches, "texts": self.text_folders, "next": self.next_doc}))
        self.levels, self.batches = levels, batches

    def _write(self, counts: DataFrame) -> str:
        """A new run's name; it counts once a manifest holds it."""
        name = f"tributary_run_{uuid.uuid4().hex}"
        with merging(self.spark):
            counts.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (anchor BIGINT, n BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def ingest(self, rows: DataFrame, at: str | None = None) -> DataFrame:
        """Add a batch of runs of windows (R.RUNS). Returns (saved) its fingerprints that it repeats itself or that history has.

        The rows become the batch's places; `at` is a folder that holds them already.
        """
        if at is None:
            at = f"{self.path}/places-{uuid.uuid4().hex}"
            rows.write.parquet(at)
            rows = self.spark.read.schema(R.RUNS).parquet(at)
        name = self._write(rows.groupBy("anchor").agg(F.sum(R.span_times()).alias("n")))
        new = self.run(name)
        found = [new.where("n > 1").select("anchor")]
        found += [new.select("anchor").hint("merge").join(self.run(x).select("anchor"), "anchor", "left_semi") for x in self.runs()]
        with merging(self.spark):
            hits = save(reduce(DataFrame.unionByName, found).distinct(), "hits")  # before compaction deletes the runs
        self._commit([[*self.levels[0], name], *self.levels[1:]], [*self.batches, at])
        self.compact()
        return hits

    def add_texts(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Keep a batch's texts (id, text) as (doc, id, text), doc a number that no earlier batch has; and the least of them.

        The next ingest commits them; texts of a batch that was lost before that are never read.
        """
        at, first = f"{self.path}/texts-{uuid.uuid4().hex}", self.next_doc
        rows.select((F.monotonically_increasing_id() + first).alias("doc"), "id", "text").write.parquet(at)
        texts = self.spark.read.schema("doc long, id long, text string").parquet(at)
        last = texts.agg(F.max("doc")).first()[0]
        self.text_folders, self.next_doc = [*self.text_folders, at], first if last is None else last + 1
        return texts, first

    def texts(self) -> DataFrame:
        return self.spark.read.schema("doc long, id long, text string").parquet(*self.text_folders).select("doc", "text")

    def compact(self) -> None:
        """Merge each full level into one run of the next."""
        for k in range(len(self.levels)):
            old = self.levels[k]
            if len(old) >= self.FANOUT:
                with merging(self.spark):
                    name = self._write(reduce(DataFrame.unionByName, [self.run(x) for x in old]).groupBy("anchor").agg(F.sum("n").alias("n")))
                above = self.levels[k + 1] if k + 1 < len(self.levels) else []
                self._commit([*self.levels[:k], [], [*above, name], *self.levels[k + 2 :]], self.batches)
                for x in old:
                    self._drop(x)
        if len(self.levels[-1]) >= self.FANOUT:
            self.compact()

    def places(self) -> DataFrame:
        """All places, of old and new batches; a folder is a batch, or several by a column of that name."""
        folders = dict.fromkeys(x.split("/batch=")[0] for x in self.batches)
        columns = [c.split()[0] for c in R.RUNS.split(", ")]
        return reduce(DataFrame.unionByName, [self.spark.read.schema(R.RUNS).parquet(x).select(*columns) for x in folders])

    def members(self, hits: DataFrame) -> DataFrame:
        """Places whose fingerprint is in hits; saved."""
        return save(self.places().join(hits.distinct(), "anchor", "left_semi"), "members")

    def delete(self) -> None:
        for x in self.runs():
            self._drop(x)
        remove(self.spark, self.path)


def repeated_windows(texts: DataFrame, window: int = WINDOW, sub: int = SUB, batches: int = BATCHES) -> DataFrame:
    """Marks (doc, lo, hi): windows lo..hi-1 of doc also start elsewhere."""
    spark = texts.sparkSession
    index = FingerprintIndex(spark)
    # The texts are cut once, whatever the number of batches; the cut's folders are the batches' places.
    cut = f"{index.path}/cut"
    R.window_runs(texts, "words", window, sub).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(cut)
    rows = spark.read.schema(f"{R.RUNS}, batch int").parquet(cut)
    hits = reduce(DataFrame.unionByName, [index.ingest(rows.where(F.col("batch") == b), f"{cut}/batch={b}") for b in range(batches)])
    release(spark)
    members = index.members(hits)
    index.delete()
    release(spark)
    return verified(texts, members, window)


def verified(texts: DataFrame, members: DataFrame, window: int) -> DataFrame:
    """Marks of the members (places of hits) that are repeated: by digests of whole runs, else of each window of the texts."""
    copies = save(R.classes(members), "copies")
    # A run with a copy of equal content is repeated as a whole.
    key = ["anchor", "content", "check"]
    whole = members.join(copies.where("copies > 1").select(*key), key, "left_semi")
    # Runs that share a fingerprint with other content only: compare window by window.
    several = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    reps = copies.join(several, "anchor", "left_semi").select(F.col("first.doc").alias("doc"), F.col("first.span").alias("span"), "copies")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (bounds, wanted) = batch.column("doc").to_numpy(), R.lists(batch.column("wanted"))
            span, copies = (wanted.field(c).to_numpy() for c in ("span", "copies"))
            for part in A.slices(batch.column("text")):
                _, first, w = R.items_of("words", part)
                digests = []
                for roll, which in zip(A.ITEMS, (0, 1), strict=True):
                    digests.append(roll.windows(roll.prefix(w.hashes(which)), window))
                take = np.arange(bounds[part.first], bounds[part.first + len(part.offsets) - 1])
                row = np.searchsorted(bounds, take, side="right") - 1 - part.first
                start, _, n = R.unpack_span(span[take])
                at = A.concatenated(first[row] + start, first[row] + start + n)
                owner = np.repeat(np.arange(len(take)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[0][at].view(np.int64)), pa.array(digests[1][at].view(np.int64)), pa.array(ids[part.first + row[owner]]), pa.array(at - first[row[owner]]), pa.array(copies[take][owner])],
                    names=["d1", "d2", "doc", "at", "copies"],
                )

    digests = save(R.texts_of(texts, reps, "d1 long, d2 long, doc long, at long, copies long", windows), "digests")
    found = digests.groupBy("d1", "d2").agg(F.sum("copies").alias("total")).where("total > 1").select("d1", "d2")
    single = digests.where("copies = 1").join(found, ["d1", "d2"], "left_semi")
    return save(R.marks_of(whole).unionByName(single.select("doc", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))), "marks")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts anywhere else in docs.

    Returns doc_id, n_words, n_removed, kept (remaining words joined by one space) and spans (removed word ranges).
    """
    keyed, keys = with_keys(docs, id_col, text_col)
    texts = keyed_text(keyed, text_col)
    marks = repeated_windows(texts, window, sub)
    release(docs.sparkSession)
    return named(without(texts, marks, window), keys)


def batch_dedup(docs: DataFrame, index: FingerprintIndex, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """Remove from a new batch what it repeats itself or what the kept index has, and add the batch to the index.

    Rows as substring_dedup gives for the batch: those of a run over all batches so far. Every row is a document of its own,
    whatever ids and texts earlier batches had. The index keeps the texts of its batches, read again only for documents whose
    runs share a fingerprint with other content; it goes on from its folder in any later session.
    """
    small_batches(docs.sparkSession)
    texts, first = index.add_texts(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    hits = index.ingest(R.window_runs(texts, "words", window, sub))
    marks = verified(index.texts(), index.members(hits), window)
    out = without(texts, marks.where(F.col("doc") >= first), window)
    names = texts.select(F.col("doc").alias("__doc"), F.col("id").alias("doc_id"))
    return out.join(names, out["doc"] == names["__doc"]).select("doc_id", *(c for c in out.columns if c != "doc"))


def without(texts: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """texts (doc, text) without the words of marked windows: doc, n_words, n_removed, kept, spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, lo = R.lists(batch.column("lo"))
            hi = R.lists(batch.column("hi"))[1].to_numpy()
            lo = lo.to_numpy()
            n_words, removed, kept, spans = [], [], [], []
            for part in A.slices(batch.column("text")):
                w = A.words(part, A.SPACES)
                for r in range(len(part.offsets) - 1):
                    a, b = w.bounds[r], w.bounds[r + 1]
                    x, y = bounds[part.first + r], bounds[part.first + r + 1]
                    gone = A.covered(lo[x:y], hi[x:y] + window - 1, b - a) if y > x else np.zeros(b - a, bool)
                    n_words.append(b - a)
                    removed.append(int(gone.sum()))
                    s, e = w.start[a:b][~gone], w.end[a:b][~gone]
                    kept.append(_joined(w.data, s, e))
                    spans.append(np.stack(A.runs(gone), 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc", "n_words", "n_removed", "kept", "spans"],
            )

    return R.with_spans(texts, marks).select("doc", "text", "lo", "hi").mapInArrow(cut, "doc long, n_words long, n_removed long, kept string, spans array<array<long>>")


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(start):
        return b""
    at = A.concatenated(start, end + 1)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.cumsum(end + 1 - start) - 1] = 0x20
    return out[:-1].tobytes()


def op9_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
