"""Token files, packing and chat formatting: exact round trips."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tributary.llm import arrays, chat, packing, token_files, token_ids
from tributary.llm.token_ids import BYTE, WORD, tokenizer_path

ALPHABETS = [
    ["a", "b", "'s", "s", "t", "'", "''", "ll", "re", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "É", "1", "²", "٣", "漢", "😀", "<|endoftext|>", "İ", "Σ", "\x85", "\r\n", "!", "«", "ß", "e\u0301", "Don't"],
    ["a", "b", "'s", "'", " ", "\n", "é", "1", "22", "!", "re", "B"],
]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", WORD), ("byte_bpe_50k.json", BYTE)])
def test_encoder_equals_the_tokenizer(name, kind, alphabet, monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE", 200)
    rng = random.Random(4)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(6000)]
    ours, theirs = token_ids.Encoder(tokenizer_path(name), kind), Tokenizer.from_file(tokenizer_path(name))
    for part in arrays.slices(pa.array(texts), 1 << 12):
        for k, ids in enumerate(ours.encode(part)):
            text = texts[part.first + k]
            assert theirs.encode(text, add_special_tokens=False).ids == ids.tolist(), text


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = rng.integers(0, 2**32, dtype=np.uint64)
    sizes = np.array([n // 2, n - n // 2])
    data = token_files.pack(np.array([-5, 2**40]), sizes, ids)
    reader = token_files.Reader(data)
    assert reader.doc_ids.tolist() == [-5, 2**40] and reader.sizes.tolist() == sizes.tolist()
    assert (reader.ids(0, n) == ids).all()
    for lo, hi in ((0, 0), (n // 3, n), (n - 1, n), (n // 2, n // 2 + 1)):
        assert (reader.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        token_files.Reader(b"none" + data[4:])


def test_token_files(spark, docs, no_docs, texts, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 200)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    files = token_files.write_files(docs, tokenizer_path("word_bpe_49k.json"), WORD)
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_files(files).collect())
    at, want = 0, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), ids))
        at += len(ids)
    assert got == want
    n = token_files.export(files, str(tmp_path / "out"))
    assert n == files.count() > 1 and len(list((tmp_path / "out").iterdir())) == n
    assert token_files.read_files(token_files.write_files(no_docs, tokenizer_path("word_bpe_49k.json"), WORD)).count() == 0


@pytest.mark.parametrize("batch", [packing.BATCH_TOKENS, 3000])
def test_packing(docs, no_docs, texts, monkeypatch, batch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", batch)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    whole, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        whole[r.doc_id, r.doc_tokens].append((r.start, ids))
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in texts)
    for (i, ids), n in want.items():
        joined = [x for _, part in sorted(whole[i, len(ids)]) for x in part]
        assert sorted(joined) == sorted(ids * n)
        if n == 1:
            assert joined == list(ids)
    assert packing.pack_documents(no_docs, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_assignment_balances_cost_and_wastes_little():
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5, 1.2, 3000).astype(np.int64) + 1, 9000)
    found = packing.assign(sizes)
    total, cost = Counter(), Counter()
    for _, _, n, s, _ in found:
        total[s] += n
        cost[s] += packing.cost(n)
    assert sum(total.values()) == sizes.sum() and sum(1024 - n for n in total.values()) < 1024
    assert packing.assign(np.array([1024])) == [(0, 0, 1024, 0, 0)]
    assert packing.assign(np.zeros(0, np.int64)) == []


def test_escape_round_trip():
    rng = random.Random(6)
    parts = ["<", "|", "\\", "[", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "a", "\n", "é", "|>", chat.END, chat.START, "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not re.search(r"<\||\[/?INST\]|</?s>", escaped)


@pytest.mark.parametrize("chunk", [64, 2])
def test_chat(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rng = random.Random(8)
    parts = ["hi", " ", "\n", "é", "😀", "</s>", "[INST]", chat.END, "\\", "<", "|", "word"]
    rows = [(k // 7, rng.randint(0, 4), rng.choice(["user", "assistant", None]), rng.choice([None, "", "".join(rng.choices(parts, k=8))]), 1) for k in range(210)]
    rows += [(None, 0, "assistant", "x", 1), (None, 0, "assistant", "x", 1), (77, 0, "user", "long " * 30_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    formatted = chat.format_chats(df, tokenizer_path("byte_bpe_50k.json"))
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append((t, r or "", x or ""))
    want = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert {tuple(r)[:5] for r in chat.read_back(formatted).collect()} == want
    assert chat.read_back(chat.format_chats(df.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_loss_mask_by_search():
    starts, ends = np.array([0, 2, 2, 5, 7]), np.array([2, 5, 5, 7, 9])
    assert chat.loss_mask(starts, ends, np.array([2]), np.array([7])).tolist() == [False, True, True, True, False]
    assert not chat.loss_mask(starts, ends, np.array([5]), np.array([5])).any()


def test_marked_encoding_equals_the_tokenizer():
    from tokenizers import AddedToken

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (chat.START, chat.TEXT, chat.END)])
    rng = random.Random(10)
    parts = ["hi", " ", "\n", "é", "😀", "</s>", "[INST]", chat.END, "\\", "<", "|", "word", "漢字", "e\u0301", "'s"]
    texts = [chat.render([(rng.choice(["user", "assistant"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))])[0] for _ in range(2000)]
    for text, (ids, starts, ends) in zip(texts, chat.marked(tokenizer_path("byte_bpe_50k.json")).encode(texts), strict=True):
        want = whole.encode(text, add_special_tokens=False)
        assert want.ids == ids.tolist()
        assert want.offsets == list(zip(starts.tolist(), ends.tolist(), strict=True))
