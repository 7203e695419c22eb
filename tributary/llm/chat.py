"""Operator 5, chat formatting with offset-aligned loss masks.

A conversation is rendered whole: <|start|>role<|text|>text<|end|> for each turn, in order. Control strings inside roles and
texts get a backslash after their first character, and one more where they have some already, so unescape() is exact. The
rendering is encoded once, with offsets; the markers are special tokens, so no token crosses a turn's edge and what lies
between markers may be encoded by the shared encoder. Byte-level tokens spell their bytes, so offsets follow from their
lengths. Both the turns' text spans and the tokens are sorted, so a binary search finds each span's tokens; those of
assistant turns carry loss.

A conversation's rows stream through one task in turn order, CHUNK_TURNS turns to an output row, which bounds memory for a
conversation of any length. Cutting at a turn's edge changes no token, as markers stand there.

Edge cases: null texts and roles are empty. Rows of one turn number are ordered by role and text. Repeated rows are turns like
others. A null conv_id is one conversation. Columns other than the four are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import id_of, key_of, small_batches
from tributary.llm.token_ids import BYTE, encoder, tokenizer_path

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
CHUNK_TURNS = 64
#: Openings of control strings: this template's and those of common public ones. Fixed values.
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)")
_MARKER = re.compile(f"({re.escape(START)}|{re.escape(TEXT)}|{re.escape(END)})")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

FORMATTED = "conv long, chunk long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted text, and where each turn's text begins and ends in it, in code points."""
    parts, lo, hi, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{TEXT}", escape(text)
        lo.append(at + len(head))
        hi.append(lo[-1] + len(body))
        parts += [head, body, END]
        at = hi[-1] + len(END)
    return "".join(parts), np.array(lo, np.int64), np.array(hi, np.int64)


def loss_mask(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Tokens that overlap one of the sorted, disjoint spans. Tokens of one character's bytes share its offsets."""
    first = np.searchsorted(ends, lo, side="right")
    last = np.searchsorted(starts, hi, side="left")
    edge = np.zeros(len(starts) + 1, np.int64)
    some = (last > first) & (hi > lo)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return np.cumsum(edge[:-1]) > 0


class Marked:
    """The encoder with the three markers as special tokens."""

    def __init__(self, path: str):
        self.encoder = encoder(path, BYTE)
        vocabulary = self.encoder.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.markers = {m: size + k for k, m in enumerate((START, TEXT, END))}
        self.n_bytes = np.zeros(size + 3, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # one stand-in character a byte
        for m, i in self.markers.items():
            self.n_bytes[i] = len(m)

    def encode(self, formatted: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, and first and end code point, of the tokens of each rendering."""
        pieces = [_MARKER.split(x) for x in formatted]
        texts = [p for parts in pieces for p in parts if p and p not in self.markers]
        ids = iter([x for part in A.slices(pa.array(texts, pa.string())) for x in self.encoder.encode(part)])
        out = []
        for text, parts in zip(formatted, pieces, strict=True):
            found = [np.array([self.markers[p]], np.uint32) if p in self.markers else next(ids) for p in parts if p]
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint32)
            ends = np.cumsum(self.n_bytes[tokens])
            before = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
            out.append((tokens, before[ends - self.n_bytes[tokens] + 1] - 1, before[ends]))
        return out


_MARKED: dict[str, Marked] = {}


def marked(path: str) -> Marked:
    if path not in _MARKED:
        _MARKED[path] = Marked(path)
    return _MARKED[path]


def format_chats(chats: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """FORMATTED rows: each conversation's chunks, in order within its partition."""
    small_batches(chats.sparkSession)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = chats.select(key_of("conv_id").alias("conv"), F.col("`turn`").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, turns = None, 0, []
        ready: list[tuple[int, int, list[tuple[str, str]]]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rendered = [render(x) for _, _, x in ready]
            encoded = marked(tokenizer).encode([r[0] for r in rendered])
            masks = []
            for (_, _, x), (_, lo, hi), (_, starts, ends) in zip(ready, rendered, encoded, strict=True):
                mine = np.array([role == loss_role for role, _ in x], bool)
                masks.append(loss_mask(starts, ends, lo[mine], hi[mine]))
            at = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in masks])]).astype(np.int32))
            columns = [pa.array([c for c, _, _ in ready]), pa.array([k for _, k, _ in ready]), pa.array([r[0] for r in rendered])]
            columns += [pa.ListArray.from_arrays(at, pa.array(np.concatenate([e[k] for e in encoded]).astype(np.int32))) for k in range(3)]
            columns.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(masks))))
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=FORMATTED.replace(",", "").split()[::2])

        for batch in batches:
            for c, role, body in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
                if turns and (c != conv or len(turns) >= CHUNK_TURNS):
                    ready.append((conv, chunk, turns))
                    chunk, turns = chunk + 1, []
                    if held > A.SLICE_BYTES:
                        yield flush()
                        held = 0
                if c != conv:
                    conv, chunk = c, 0
                turns.append((role, body))
                held += len(body)
        if turns:
            ready.append((conv, chunk, turns))
        if ready:
            yield flush()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(emit, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted rows alone: turns, and what lies under the loss mask, unescaped."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def new() -> dict:
            return {"n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}

        def row() -> pa.RecordBatch:
            values = [conv, state["n_turns"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for c, text, starts, ends, loss in zip(batch.column("conv").to_pylist(), batch.column("formatted").to_pylist(), *(batch.column(x) for x in ("starts", "ends", "loss")), strict=True):
                if state is not None and c != conv:
                    yield row()
                    state = None
                if state is None:
                    conv, state = c, new()
                state["chars"] += len(text)
                for role, body in _TURN.findall(text):
                    state["n_turns"] += 1
                    state["turns"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                mask = loss.values.to_numpy(zero_copy_only=False)
                opens = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1)
                closes = np.flatnonzero(np.diff(np.concatenate([mask.astype(np.int8), [0]])) == -1)
                for a, b in zip(starts.values.to_numpy()[opens].tolist(), ends.values.to_numpy()[closes].tolist(), strict=True):
                    # Markers part neighbouring turns, so a run of masked tokens is one turn's text.
                    body = unescape(text[a:b])
                    state["loss_chars"] += len(body)
                    state["loss"].update(body.encode())
        if state is not None:
            yield row()

    out = formatted.select("conv", "formatted", "starts", "ends", "loss").mapInArrow(emit, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(id_of("conv", "conv_id"), *out.columns[1:])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chats(chats, tokenizer_path("byte_bpe_50k.json")))
