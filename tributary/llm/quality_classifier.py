"""Operator 1, quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Words (runs of letters and digits, and runs of other characters) fall into BUCKETS by hash. Every bucket has a sparse
   random index vector; a bucket's word vector is the sum of the index vectors of the words within REACH places of its
   own, over all documents. Tasks send sums, and the cluster adds them: the table has a fixed size.
2. A document is pooled to the mean and the spread of its words' unit vectors, the share of words that repeat the word
   before, and the log of its length.
3. A network with one hidden layer learns from up to TRAIN_ROWS labelled documents (the documented bound, taken in the order
   of a hash of the id); its temperature is set on a tenth of them that it hasn't learned from.

Documents whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read. Labels, language, source and id
are no inputs of a score.

Edge cases: null and empty texts are scored from a zero vector. Null labels and labels of unknown documents are ignored;
of several labels of one document the greatest counts. Without labels of both kinds every score is 0.5. Repeated rows are
scored each; a null id isn't held out. Columns other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import NULL_ID, id_and_text, id_of, key_of, save

BUCKETS = 1 << 13
DIM = 32
NONZERO = 4
REACH = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
CUT = 0.3
FEATURES = 2 * DIM + 3

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter, digit or non-ASCII, 2 other
_KIND[A.SPACES] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

_places = A._stream(BUCKETS * NONZERO, 51).reshape(BUCKETS, NONZERO)
INDEX_AT = (_places % A.U(DIM)).astype(np.int64)
INDEX_SIGN = np.where((_places >> A.U(40)) & A.U(1), 1, -1).astype(np.int64)


def bucketed(part: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the rows' bounds."""
    kind = _KIND[part.data]
    edge = np.ones(len(kind), bool)
    edge[1:] = kind[1:] != kind[:-1]
    cuts = part.offsets[1:-1]
    edge[cuts[cuts < len(kind)]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(kind))
    word = kind[first] > 0
    first, last = first[word], last[word]
    roll = A.BYTES[0]
    hashes = roll.ranges(roll.prefix(A.BYTE_VALUES[0][part.data]), first, last)
    return (hashes % A.U(BUCKETS)).astype(np.int64), np.searchsorted(first, part.offsets, side="left")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        for part in A.slices(batch.column("text"), 1 << 18):
            ids, bounds = bucketed(part)
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for step in range(1, REACH + 1):
                near = np.flatnonzero(row[step:] == row[:-step])
                for one, other in ((ids[near], ids[near + step]), (ids[near + step], ids[near])):
                    for k in range(NONZERO):
                        np.add.at(total, one * DIM + INDEX_AT[other, k], INDEX_SIGN[other, k])
    table = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, d]) for d in range(DIM))], names=["bucket", *(f"v{d}" for d in range(DIM))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets (BUCKETS x DIM, whatever the corpus), from every text."""
    names = [f"v{d}" for d in range(DIM)]
    sums = texts.select("text").mapInArrow(_index, "bucket long, " + ", ".join(f"{n} long" for n in names))
    rows = sums.groupBy("bucket").agg(*(F.sum(n).cast("double").alias(n) for n in names)).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[rows["bucket"].to_numpy(np.int64)] = rows[names].to_numpy()
    out -= out.sum(0) / max(1, len(rows)) * out.any(1)[:, None]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    out = np.zeros((len(size), FEATURES), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        at, n = bounds[full], size[full, None]
        found = vectors[ids]
        mean = np.add.reduceat(found, at) / n
        out[full, :DIM] = mean
        out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(found * found, at) / n - mean * mean, 0))
        same = np.zeros(len(ids), np.float32)
        same[1:] = ids[1:] == ids[:-1]
        same[at] = 0
        out[full, 2 * DIM] = np.add.reduceat(same, at) / size[full]
        out[full, 2 * DIM + 1] = np.log1p(size[full]) / 8
        out[full, 2 * DIM + 2] = 1
    return out


def features(texts: DataFrame, vectors: np.ndarray) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch.column("text")):
                x = pooled(*bucketed(part), vectors)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(part.first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc", "features"])

    return texts.mapInArrow(emit, "doc long, features binary")


class Network:
    """Two layers, with a temperature for its logit."""

    def __init__(self, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (x - self.mean) / self.scale
        hidden = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        return x, hidden, hidden @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._layers(x)[2] / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, ridge: float = 1e-4, seed: int = 8) -> Network:
        rng = np.random.default_rng(seed)
        held = rng.permutation(len(x)) < max(1, len(x) // 10)
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        train, truth = x[~held], y[~held]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(train)), max(1, len(train) // batch)):
                z, hidden, logit = self._layers(train[at])
                slope = (_sigmoid(logit) - truth[at]) / len(at)
                back = slope[:, None] * self.weights[2] * (hidden > 0)
                slopes = [z.T @ back + ridge * self.weights[0], back.sum(0), hidden.T @ slope + ridge * self.weights[2], np.array([slope.sum()])]
                step += 1
                for w, g, m in zip(self.weights, slopes, moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        logit, truth = self._layers(x[held])[2], y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 64))
        loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def held_out() -> Column:
    text = F.when(F.col("doc") != NULL_ID, F.col("doc").cast("string"))
    return F.coalesce(F.crc32(text.cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (temperature-calibrated probability of label 1) and predicted (score >= CUT)."""
    texts = id_and_text(docs, id_col, text_col)
    vectors = word_vectors(texts)
    table = save(features(texts, vectors), "features")
    known = labels.select(key_of(label_id).alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null")
    known = known.groupBy("doc").agg(F.max("label").alias("label")).where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(train_rows)
    rows = table.join(chosen, "doc").orderBy(F.xxhash64("doc"), "doc", "features").limit(train_rows).collect()
    network = Network(FEATURES)
    y = np.array([r["label"] for r in rows], np.float64)
    learned = len(rows) > 1 and 0 < y.sum() < len(y)
    if learned:
        network.fit(np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64), y)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
                score = network.score(x) if learned else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(score)], names=["doc", "score"])

    scored = table.mapInArrow(emit, "doc long, score double")
    return scored.select(id_of(), held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
