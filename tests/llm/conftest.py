import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, anchor string, key int, content string"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, white space, repeats, near copies, shared passages, one long text, control bytes, ties."""
    passage = words(70, 1)
    base = words(120, 2)
    near = base.replace("w1", "w2", 1)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d"), (7, "A b  C d"),
        (10, base), (11, base), (12, near), (13, base + " tail " + words(10, 3)),
        (20, words(60, 4) + "\n" + passage + "\n" + words(60, 5)), (21, words(50, 6) + " " + passage), (22, passage), (23, passage + " end"),
        (30, "spam " * 300), (31, "ab" * 400), (32, "spam " * 300 + "x"),
        (40, words(9000, 7, 100_000)), (41, "é" * 130 + "\x1c\x00 ü" + "é" * 130),
        (50, "line one here\nline one here\n\nline two & more # $\r\nline one here"), (51, "<|endoftext|> </s>[INST]  x\n\n y z"),
        (60, words(80, 8)), (60, words(80, 8)), (None, words(80, 8)), (None, None),
    ]


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The edge texts with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, None) for i, t in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
