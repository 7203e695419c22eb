"""Facts kept over scans, and names found by their trigrams."""

import random
import re

import pytest

from tributary.operators import search
from tributary.plans import trace
from tributary.rules.trigrams import required_trigrams
from tributary.sources import parse
from tributary.sources.fact_store import FactStore

FILES = "file_path string, language string, content string"
A, B = "<?php\n$a = $_GET['x'];\n", "<?php\n$b = $a;\nf($b);\n"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_second_scan_parses_changed_files_only(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(rows, FILES)
    first = files(("a.php", "php", A), ("b.php", "php", B), ("copy.php", "php", A), ("x.py", "python", A), ("none.php", "php", None), ("empty.php", "php", ""))
    second = files(("a.php", "php", A + "$c = 1;\n"), ("moved.php", "php", B), ("copy.php", "php", A), ("none.php", "php", ""))
    at = f"file://{tmp_path}/store"
    assert FactStore(spark, at).versions() == [] and FactStore(spark, at).parsed().count() == 0
    assert FactStore(spark, at).update(first) == 1 and FactStore(spark, at).parsed().count() == 4
    store = FactStore(spark, at)
    assert store.update(second) == 2
    # One text is new; the others were known under other paths.
    assert store.parsed().count() == 5 and store.parsed().select("batch").distinct().count() == 2
    for version, tree in ((1, first), (2, second)):
        assert rows_of(store.facts(version)) == rows_of(parse.facts(tree)), version
    assert rows_of(store.changes(1)) == sorted((p, "added") for p in ("a.php", "b.php", "copy.php", "x.py", "none.php", "empty.php"))
    assert rows_of(store.changes(2)) == [("a.php", "changed"), ("b.php", "removed"), ("empty.php", "removed"), ("moved.php", "added"), ("none.php", "changed"), ("x.py", "removed")]
    assert store.update(second) == 3 and store.parsed().count() == 5 and store.changes(3).count() == 0
    assert store.update(second.limit(0)) == 4 and store.facts(4).count() == 0


def test_a_batch_without_its_digests_does_not_count(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("a.php", "php", A)], FILES)
    store.update(files)
    (done,) = (tmp_path / "store" / "digests").iterdir()
    (done / "_SUCCESS").unlink()
    assert store.parsed().count() == 0 and store.facts(1).count() == 0
    store.update(files)
    assert rows_of(store.facts(2)) == rows_of(store.facts(1)) == rows_of(parse.facts(files))
    # Two scans at once: both batches hold the text, it counts once.
    (done / "_SUCCESS").touch()
    assert store.parsed().count() == 2 and rows_of(store.facts(2)) == rows_of(parse.facts(files))


def test_a_trace_reads_the_kept_facts(spark, tmp_path):
    files = spark.createDataFrame([("a.php", "php", "<?php\n$a = $_GET['x'];\n$b = $a;\nf($b);\n")], FILES)
    config = trace.Config(fact_store=f"file://{tmp_path}/store")
    want = rows_of(trace.trace_files(spark, files).arguments)
    assert want and [rows_of(trace.trace_files(spark, files, config).arguments) for _ in range(2)] == [want, want]
    assert FactStore(spark, config.fact_store).parsed().count() == 1 and FactStore(spark, config.fact_store).versions() == [1, 2]


@pytest.mark.parametrize(
    ("pattern", "ways"),
    [
        ("process", [{"pro", "roc", "oce", "ces", "ess"}]), ("^get[A-Z]", [{"get"}]), ("get.*User$", [{"get", "Use", "ser"}]), ("abc|defg", [{"abc"}, {"def", "efg"}]),
        ("x(?:abc)+y", [{"abc"}]), ("(abc)?def", [{"def"}]), ("ab", None), (".", None), ("abc|d", None), ("(?i)process", None), ("(?i:process)", None), ("(abc)*", None),
        (r"\Qabc\E", None), ("[a&&[bc]]xyz", None), ("[a[b]c]def", None), (r"\p{L}abc", None), ("(", None), ("a(?=bcd)efg", [{"efg"}]), (r"a\[bc[de]efg", [{"a[b", "[bc", "efg"}]),
    ],
)
def test_trigrams_that_a_pattern_needs(pattern, ways):
    got = required_trigrams(pattern)
    assert got == (None if ways is None else sorted(map(frozenset, ways), key=sorted))


def test_required_trigrams_lose_no_match():
    rng = random.Random(11)
    parts = ["abc", "bca", "a", ".", "[ab]", "(?:abc|cab)", "(?:ab)+", "c?", "(abca)", "(?:b|abc)*", "^", "$", "\\b"]
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(400)]
    for _ in range(300):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.3:
            pattern += "|" + rng.choice(["abcab", "cabc(?:a|b)", "ba"])
        ways = required_trigrams(pattern)
        if ways:
            for name in names:
                if re.search(pattern, name):
                    assert any(all(g in name for g in way) for way in ways), (pattern, name)


def test_search_by_trigrams(spark, tmp_path):
    names = ["processInput", "processOutput", "process", "Process", "pro", "ab", "", None, "getUser", "getUserName", "über", "xüberx", "processInput"]
    symbols = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    posted = search.trigrams(symbols)
    assert posted.where("name = 'getUser'").count() == 5 and posted.count() == posted.distinct().count() and posted.where("length(trigram) <> 3").count() == 0
    seqs = lambda *by: [r.seq for r in search.search(*by).collect()]
    for pattern in ("process", "^process.", "get.*Name|Output$", "über", "ab", "(?i)process", "none", "pro"):
        q = search.Query(name_pattern=pattern)
        assert seqs(symbols, q, posted) == seqs(symbols, q), pattern
    plan = search.search(symbols, search.Query(name_pattern="process.*put"), posted)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "trigram" in plan
    assert search.candidates(posted, "process.*put").count() == 2 and search.candidates(posted, "ab") is None


def test_an_index_keeps_trigrams(spark, tmp_path):
    index = search.SymbolIndex(spark, f"file://{tmp_path}/index")
    row = lambda i, name: (i, name, "function", "/a.go", "", ["p"], "", "go")
    index.add(spark.createDataFrame([row("a", "processInput"), row("b", "other")], search.SYMBOLS))
    index.add(spark.createDataFrame([row("c", "processInput"), row("d", "reprocess"), row("e", "pr")], search.SYMBOLS))
    q = search.Query(name_pattern="proc")
    assert [r.id for r in index.search(q).collect()] == ["a", "c", "d"] == [r.id for r in search.search(index.symbols(), q).collect()]
    assert [r.id for r in index.search(search.Query(name="pr")).collect()] == ["e"]
    plan = index.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(name), In(trigram, [pro,roc])], ReadSchema: struct<trigram:string,name:string>" in plan
    # An index that was begun without trigrams gets those of all its names with the next batch.
    import shutil

    shutil.rmtree(tmp_path / "index" / "trigrams")
    assert [r.id for r in index.search(q).collect()] == ["a", "c", "d"]
    index.add(spark.createDataFrame([row("f", "procedure")], search.SYMBOLS))
    assert [r.id for r in index.search(q).collect()] == ["a", "c", "d", "f"]
    index.clear()
    assert index.search(q).count() == 0
