"""Operator 6, quality rules with line sequence labelling.

Rules on counts come first (Gopher-style: words, symbols, duplicate lines, repeated three-word windows). A text that passes
them is labelled line by line by a linear-chain conditional random field with the states content and boilerplate; Viterbi
decoding gives the best labelling, and the share of words in content lines decides retention.

WEIGHTS and STAY were fitted by fitted() on labelled documents (a bounded sample, TRAIN_DOCS): a line takes its document's
quality as its state; clean lines have their closing stops dropped and symbols added at random, so that lists and headings
stay content; and blocks of junk lines are put between clean ones, so that the field sees changes of state.

Edge cases: null and empty texts, and texts without words, have zero counts and fail the rules. Lines without words carry no
label. Repeated rows are judged each. Columns other than the id and the text are never read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import id_and_text, id_of, rows_and_text, with_row

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
CONTENT_SHARE = 0.5
#: Labelled documents that the field learns from, by the least hash of the id.
TRAIN_DOCS = 4000

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SHOUTS = SYMBOLS.copy()
SHOUTS[ord("!")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTERS = UPPER.copy()
LETTERS[0x61:0x7B] = True
LEADING = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
STOPS = np.zeros(256, bool)
STOPS[list(b".?!:;\"')")] = True

FEATURES = ("bias", "symbols", "upper", "pipes", "echo", "duplicate", "stop", "length", "distinct")
#: What fitted() gives on sf0.1, rounded.
WEIGHTS = np.array([-2.68, -3.94, -1.01, -3.99, -5.56, -2.40, -1.59, 2.48, 4.42])
STAY = 0.94


def _before(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _repeats(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the row has the key more than once."""
    tagged = A.mix(key + row.astype(A.U) * A.U(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(tagged, return_inverse=True, return_counts=True)
    return count[inverse] > 1


class Lines:
    """Lines with a word, their features, and the rows' counts, for one slice."""

    def __init__(self, part: A.Slice):
        self.words = w = A.words(part, A.SPACES)
        data, hashes, row = part.data, w.hashes(), w.row
        n_rows = len(part.offsets) - 1
        newline = np.flatnonzero(data == 0x0A)
        starts = np.unique(np.concatenate([newline + 1, part.offsets[:-1]]))
        ends = np.append(starts[1:], part.offsets[-1])
        ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 0x0A)) if len(data) else ends
        line = np.searchsorted(starts, w.start, side="right") - 1
        used, first = np.unique(line, return_index=True)
        self.first = np.append(first, len(line))  # first word of each line
        self.size = np.diff(self.first)
        lo, hi = starts[used], ends[used]
        self.row = row[first] if len(first) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.row, np.arange(n_rows + 1))
        roll = A.BYTES[0]
        content = roll.ranges(roll.prefix(A.BYTE_VALUES[0][data]), lo, hi) + (hi - lo).astype(A.U)
        order = np.lexsort((np.arange(len(lo)), content, self.row))
        again = np.zeros(len(lo), bool)
        again[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])
        self.duplicate = again

        per_line = lambda mask: (lambda c: c[hi] - c[lo])(_before(mask))
        per_word = lambda mask: (lambda c: c[self.first[1:]] - c[self.first[:-1]])(_before(mask))
        words_ = np.maximum(self.size, 1)
        letters = per_line(LETTERS[data])
        previous = np.zeros(len(hashes), bool)
        previous[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        pipe = (w.end - w.start == 1) & (data[w.start] == 0x7C) if len(data) else np.zeros(0, bool)
        key = A.mix(hashes + line.astype(A.U) * A.U(0x9E3779B97F4A7C15))
        fresh = np.zeros(len(key), bool)
        fresh[np.unique(key, return_index=True)[1]] = True
        self.features = np.stack(
            [
                np.ones(len(lo)),
                np.minimum(per_line(SHOUTS[data]) / words_, 2),
                np.where(letters >= 10, per_line(UPPER[data]) / np.maximum(letters, 1), 0),
                per_word(pipe) / words_,
                per_word(previous) / words_,
                again,
                STOPS[data[np.maximum(w.end[self.first[1:] - 1] - 1, 0)]] if len(lo) else np.zeros(0),
                np.log1p(self.size) / 4,
                per_word(fresh) / words_,
            ],
            1,
        )

        # The rules' counts.
        sums = lambda mask, at=part.offsets: (lambda c: c[at[1:]] - c[at[:-1]])(_before(mask))
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        self.n_words = np.diff(w.bounds)
        self.word_chars = sums((np.cumsum(inside[:-1]) > 0) & LEADING[data])
        self.n_symbols = sums(SYMBOLS[data])
        self.n_dup_lines = np.bincount(self.row[again], minlength=n_rows)
        grams = A.ITEMS[0].windows(A.ITEMS[0].prefix(hashes), WINDOW)
        valid = np.flatnonzero(row[: len(grams)] == row[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
        twice = valid[_repeats(row[valid], grams[valid])]
        repeated = A.covered(twice, twice + WINDOW, len(hashes))
        self.n_repeat_words = np.bincount(row[repeated], minlength=n_rows)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def viterbi(emission: np.ndarray, bounds: np.ndarray, stay: float) -> np.ndarray:
    """Best labels (True: content) of the rows' line sequences; emission is content's score less boilerplate's.

    With two states, a symmetric score for staying and its negative for changing, the two path scores' difference is all that
    a step needs: it is the emission plus the previous difference clipped to twice `stay`. All rows step together.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, size = bounds[:-1][order], size[order]
    difference = np.zeros(len(emission))
    for k in range(int(size.max()) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        at = first[:n] + k
        difference[at] = emission[at] + (np.clip(difference[at - 1], -2 * stay, 2 * stay) if k else 0)
    label = np.zeros(len(emission), bool)
    for k in range(int(size.max()) - 1 if len(size) else -1, -1, -1):
        n = int(np.searchsorted(-size, -k, side="left"))
        at = first[:n] + k
        last = size[:n] == k + 1
        after = label[np.minimum(at + 1, len(label) - 1)]
        label[at] = np.where(last, difference[at] > 0, difference[at] >= np.where(after, -2 * stay, 2 * stay))
    return label


def content_shares(lines: Lines, weights: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Each line's label, and each row's share of words in content lines."""
    label = viterbi(lines.features @ weights, lines.bounds, stay)
    words = np.bincount(lines.row, lines.size * label, minlength=len(lines.bounds) - 1)
    return label, words / np.maximum(lines.n_words, 1)


def _pass_on(x: np.ndarray, stay: float) -> np.ndarray:
    """What a log-odds of one line says of its neighbour's."""
    return np.logaddexp(x + stay, -stay) - np.logaddexp(x - stay, stay)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.3, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and `stay` by the field's conditional likelihood: forward-backward marginals, plain gradient ascent.

    sequences: (features of a document's lines, True where content). With two states a message is one log-odds, and all
    sequences step together, as in viterbi().
    """
    sequences = sorted((x for x in sequences if len(x[1])), key=lambda x: -len(x[1]))
    x, y = np.concatenate([a for a, _ in sequences]), np.concatenate([b for _, b in sequences]).astype(float)
    size = np.array([len(b) for _, b in sequences])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    steps = [first[: int(np.searchsorted(-size, -k, side="left"))] + k for k in range(int(size[0]))]
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    same = np.where(y[at] == y[at - 1], 1.0, -1.0)
    weights, stay = np.zeros(x.shape[1]), 0.1
    for _ in range(rounds):
        e = x @ weights
        forward, backward = e.copy(), np.zeros(len(e))
        for places in steps[1:]:
            forward[places] += _pass_on(forward[places - 1], stay)
        for places in reversed(steps[1:]):
            backward[places - 1] = _pass_on(e[places] + backward[places], stay)
        slope = x.T @ (y - 1 / (1 + np.exp(-(forward + backward))))
        before, after = forward[at - 1], e[at] + backward[at]
        agree = np.logaddexp(before + after, 0) + stay - (np.logaddexp(before, after) - stay)
        slope_stay = float((same - np.tanh(agree / 2)).sum())
        weights += rate * (slope / len(y) * 10 - ridge * weights)
        stay = float(np.clip(stay + rate * slope_stay / len(y), 0.05, 2.0))
    return weights, stay


def augmented(rows: list[tuple[str, int]], seed: int = 17) -> list[tuple[str, list[bool]]]:
    """Training texts with the states of their lines, from (text, quality): see the module's head."""
    rng = np.random.default_rng(seed)
    clean, junk = ([t.split("\n") for t, q in rows if q == k and t] for k in (1, 0))

    def roughened(line: str) -> str:
        if rng.random() < 0.3:
            line = line.rstrip(".?!:;\"')")
        if rng.random() < 0.1 and line:
            k = int(rng.integers(0, len(line) + 1))
            line = line[:k] + str(rng.choice(list("#*$%&|"))) + line[k:]
        return line

    out = [("\n".join(x), [False] * len(x)) for x in junk]
    for lines in clean:
        lines = [roughened(x) for x in lines]
        states = [True] * len(lines)
        if junk and rng.random() < 0.5:
            other = junk[int(rng.integers(len(junk)))]
            other = other[: int(rng.integers(1, len(other) + 1))]
            k = int(rng.integers(0, len(lines) + 1))
            lines, states = [*lines[:k], *other, *lines[k:]], [*states[:k], *[False] * len(other), *states[k:]]
        out.append(("\n".join(lines), states))
    return out


def fitted(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and `stay` from the n labelled documents (doc_id, text; doc_id, quality) of least hash."""
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    sequences = []
    for text, states in augmented([(r["text"] or "", r["quality"]) for r in rows]):
        for part in A.slices(pa.array([text])):
            lines = Lines(part)
            used = [k for k, x in enumerate(text.split("\n")) if any(c not in " \t\n\v\f\r" for c in x)]
            sequences.append((lines.features, np.array([states[k] for k in used], bool)))
    return fit(sequences, 800)


FOUND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, labels array<boolean>, kept boolean"


def judged(rows: DataFrame, weights: np.ndarray | None = None, stay: float | None = None) -> DataFrame:
    """rows (row, text) with FOUND instead of the text; nothing is shuffled."""
    w, s = WEIGHTS if weights is None else weights, STAY if stay is None else stay

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch.column("text")):
                lines = Lines(part)
                label, share = content_shares(lines, w, s)
                counts = (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(part.first, len(share)),
                        *(pa.array(c.astype(np.int64)) for c in counts),
                        pa.array(lines.base_failed),
                        pa.array(share),
                        pa.ListArray.from_arrays(pa.array(lines.bounds.astype(np.int32)), pa.array(label)),
                        pa.array(~lines.base_failed & (share >= CONTENT_SHARE)),
                    ],
                    names=["row", *FOUND.replace(",", "").split()[::2]],
                )

    return rows.mapInArrow(emit, with_row(rows, FOUND))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, stay: float | None = None) -> DataFrame:
    """doc_id, the rules' counts, base_failed, content_share, labels (of lines with a word) and kept."""
    out = judged(id_and_text(docs, id_col, text_col).withColumnRenamed("doc", "row"), weights, stay)
    return out.select(id_of("row"), *out.columns[1:])


def good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that are kept."""
    return judged(rows_and_text(docs, text_col)).where("kept").select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("content_share", "labels")
