"""Substring, suffix-array and near-duplicate removal against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import arrays, bwt, near_dups, repeats, shared, substring_index, suffix_dedup
from tributary.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_substring_index(docs, no_docs, texts):
    # A repeated row is a copy: its windows start elsewhere too.
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert rows_of(substring_index.substring_dedup(docs).drop("spans")) == want
    assert substring_index.substring_dedup(no_docs).count() == 0


def test_index_levels_and_restart(spark):
    """Each batch is opened anew from the folder alone, as after a lost driver."""
    path = shared.shared_path(spark, "index-test")
    seen, hits = [], []
    for b in range(21):
        index = substring_index.FingerprintIndex(spark, path, buckets=3)
        batch = [(b, b, b, b, repeats.pack_span(0, 1, 1)), (100, b % 2, 7, b, repeats.pack_span(0, 1, 1)), (200 + b, 5, 5, b, repeats.pack_span(0, 2, 1))]
        hits.append(index.ingest(spark.createDataFrame(batch, repeats.RUNS)))
        assert {r.anchor for r in hits[-1].collect()} == {200 + b} | ({100} if b else set())
        seen += batch
        for x in index.runs() * (b == 9):
            spark.sql(f"DROP TABLE {x}")  # the catalog is lost too
        if b == 10:
            shared.write_text(spark, f"{path}/manifest-{99:08d}-x", '{"levels": [["lo')  # half a manifest
            index.version = 99
            index._commit(index.levels, index.batches)
    index = substring_index.FingerprintIndex(spark, path)
    assert [len(x) for x in index.levels] == [1, 1, 1] and index.buckets == 3 and len(index.batches) == 21
    got = rows_of(index.members(hits[0].unionByName(hits[1])))
    assert got == Counter(x for x in seen if x[0] in (100, 200, 201))
    old, new = (index.run(index.levels[k][0]) for k in (2, 0))
    assert {r.anchor: r.n for r in old.collect()} == {**{b: 1 for b in range(16)}, **{200 + b: 2 for b in range(16)}, 100: 16}
    with substring_index.merging(spark):
        plan = new.hint("merge").join(old, "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
        both = new.unionByName(old)
        # A union of runs is shuffled where it is grouped.
        assert both.groupBy("anchor").count().count() == len({r.anchor for r in both.collect()})
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.delete()


def test_long_texts_are_cut_in_pieces(monkeypatch):
    """Each window lies in one run of one piece, and a window's minimiser doesn't depend on the piece."""
    monkeypatch.setattr(repeats, "PIECE", 150)
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 101, 1000).astype(np.uint8))
    anchors = {}
    for part in arrays.slices(pa.array([text.decode()])):
        for piece, at in repeats.pieces(part, 100):
            values, bounds, _ = repeats.items_of("bytes", piece)
            s = arrays.segments(values, bounds, 100, 32)
            for start, n, anchor in zip(s.start, s.n, s.anchor):
                for k in range(start + at, start + at + n):
                    assert k not in anchors
                    anchors[k] = anchor
        values, bounds, _ = repeats.items_of("bytes", part)
        s = arrays.segments(values, bounds, 100, 32)
    assert anchors == {k: a for start, n, a in zip(s.start, s.n, s.anchor) for k in range(start, start + n)} and len(anchors) == 901


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_suffix_dedup(docs, no_docs, texts, group):
    # Rows that repeat an id and its text are one occurrence; a null id comes first.
    want = Counter()
    seen = set()
    last = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        b = (t or "").encode()
        if (i, b) in last:
            want[last[i, b]] += 1
            continue
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[max(k, end) : k + 100] = b"\x01" * (k + 100 - max(k, end))
                end = k + 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        row = (i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept)
        last[i, b] = row
        want[row] += 1
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(docs, group=group).drop("spans").collect())
    assert got == want
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_merged_transform_finds_equal_windows():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(40)] + [b"ab" * 30, b"ba" * 30]
    doc, start = np.arange(len(strings)), np.zeros(len(strings), np.int64)
    first, want = {}, set()
    for k, s in enumerate(strings):
        for j in range(len(s) - 9):
            if (lead := first.setdefault(s[j : j + 10], (k, j))) != (k, j):
                want.add((k, j))
    for shards in (1, 3, 7):
        got = {(k, j) for k, lo, hi in suffix_dedup.later_windows(strings, doc, start, 10, shards) for j in range(lo, hi)}
        assert got == want
    with pytest.raises(ValueError):
        bwt.merge([], 3)


def test_common_prefixes_of_merged_shards():
    rng = np.random.default_rng(6)
    texts = [b"\x00".join(bytes(rng.integers(97, 100, 50).astype(np.uint8)) for _ in range(6)) + b"\x00" for _ in range(3)]
    numbers = [np.where(np.frombuffer(t, np.uint8) > 0, np.frombuffer(t, np.uint8).astype(np.int16) + 1, 0).astype(np.int16) for t in texts]
    depth = 12
    found = bwt.merge([bwt.build(x, depth) for x in numbers], depth)

    def shared(a, b):
        n = 0
        while n < depth and a[n : n + 1] == b[n : n + 1] != b"\x00" and a[n : n + 1]:
            n += 1
        return n

    for owner, at, common in zip(found.shard, found.position, found.common):
        best = max(shared(texts[owner][at:], texts[s][k:]) for s in range(3) if s != owner for k in range(len(texts[s])))
        assert common == (depth if best >= depth else best // bwt.STEP * bwt.STEP)


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                parent[root(a)] = root(b)
    low = defaultdict(lambda: float("inf"))
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low[root(k)], float("-inf") if i is None else i)
    out = Counter()
    for k, (i, s) in enumerate(sets):
        c = low[root(k)]
        c = None if c == float("-inf") else c
        out[i, len(s), c, i == c] += 1
    return out


def test_near_dups(docs, no_docs, texts):
    assert rows_of(near_dups.near_dups(docs)) == brute_components(texts)
    assert near_dups.near_dups(no_docs).count() == 0


@pytest.mark.parametrize("family", [4096, 3])
def test_near_dups_of_a_star(spark, monkeypatch, family):
    """Copies near one base but not near each other; both ways to settle a family."""
    import random

    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 25):
        w = list(base)
        for at in rng.sample(range(200), 4):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    monkeypatch.setattr(near_dups, "FAMILY", family)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dups.near_dups(df)) == brute_components(rows)


@pytest.mark.parametrize(
    ("offsets", "given"),
    [
        ([0, 20, 40], [0, 1, 2]),  # three singletons
        ([0, 20, 40, 60], [0, 0, 2, 2]),  # two equal pairs
        ([0, 20, 40, 100, 120, 80, 60], [0, 0, 0, 3, 3, 5, 5]),  # two pairs outgrow the largest before its link to them
    ],
)
def test_settled_families_lose_no_link(offsets, given):
    rows = [(k, " ".join(f"v{o + j}" for j in range(200))) for k, o in enumerate(offsets)]
    sets = []
    for part in arrays.slices(pa.array([t for _, t in rows])):
        flat, bounds = near_dups.shingle_sets(part)
        sets += [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    root = list(given)
    for a, b in near_dups.joining_links(sets, np.array(given)):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert Counter((k, len(s), r, k == r) for k, (s, r) in enumerate(zip(sets, root))) == brute_components(rows)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CHUNK", 4)
    base = [f"b{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:-1], f"t{i}"])) for i in range(30)] + [(99, " ".join(f"z{k}" for k in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dups.near_dups(df)) == brute_components(rows)


def test_blocks_meet_every_pair_once(spark):
    """40 documents of one bucket, none linked: parts of about 4, no block beyond two parts, no pair lost or met twice."""
    rng = np.random.default_rng(4)
    inner = rng.random(40) < 0.4
    rows = spark.createDataFrame([(int(k), bool(x)) for k, x in enumerate(inner)], "doc long, inner boolean")
    parts = [int(-(-x // 4)) for x in (inner.sum(), (~inner).sum())]
    dealt = near_dups.blocks(rows, F.col("inner"), F.lit(parts[0]), F.lit(parts[1]), F.lit(False)).collect()
    groups = defaultdict(list)
    for r in dealt:
        groups[r.block].append((r.doc, r.side))
    met = Counter()
    for g in groups.values():
        met.update((min(a, b), max(a, b)) for a, x in g for b, y in g if a < b and (x != y or x == near_dups.ALL))
    assert met == Counter((a, b) for a in range(40) for b in range(a + 1, 40) if not (inner[a] and inner[b]))
    assert max(len(g) for g in groups.values()) < 20
    assert {r.block for r in near_dups.blocks(rows, F.col("inner"), F.lit(2), F.lit(2), F.lit(True)).collect()} == {0}


def test_large_buckets_and_families_lose_no_link(spark, monkeypatch):
    """Texts about one template, most pairs just under the threshold, some over it."""
    import random

    rng = random.Random(3)
    monkeypatch.setattr(near_dups, "CHUNK", 4)
    monkeypatch.setattr(near_dups, "PART", 4)
    base, rows = [f"b{k}" for k in range(200)], []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(200), rng.choice([3, 5, 6])):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = rows_of(near_dups.near_dups(df)), brute_components(rows)
    assert len({k[2] for k in want}) > 1 and got == want


def test_posterior_bound_keeps_true_pairs():
    least = near_dups.least_matches()
    assert list(least) == sorted(least) and least[-1] < near_dups.HASHES * 0.75
    rng = np.random.default_rng(1)
    # A pair at the threshold passes every look with at least the chosen probability.
    draws = rng.random((20_000, near_dups.HASHES)) < 0.75
    counts = draws.cumsum(1)[:, near_dups.BATCH - 1 :: near_dups.BATCH]
    assert (counts >= np.array(least)).all(1).mean() > 0.999


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9)], "a long, b long")
    assert rows_of(components(links)) == Counter({(5, 1): 1, (4, 1): 1, (3, 1): 1, (9, 8): 1})
    assert components(links.limit(0)).count() == 0


def test_id_filter_is_exact_and_prunes(spark):
    docs = spark.range(5000).withColumnRenamed("id", "doc")
    ids = spark.createDataFrame([(7,), (4999,), (10**6,)], "doc long")
    assert sorted(r.doc for r in shared.only_ids(docs, ids).collect()) == [7, 4999]


def test_runs_hold_each_window_once():
    rng = np.random.default_rng(2)
    values = arrays.mix(rng.integers(0, 3, 400).astype(np.uint64))
    bounds = np.array([0, 30, 30, 35, 300, 400])
    s = arrays.segments(values, bounds, 35, 12)
    assert s.n.sum() == sum(max(0, n - 34) for n in np.diff(bounds))
    windows = defaultdict(set)
    for r, a, n, off, anchor in zip(s.row, s.start, s.n, s.offset, s.anchor):
        inside = [tuple(values[bounds[r] + a + k : bounds[r] + a + k + 35]) for k in range(n)]
        assert len(set(inside)) == n
        for k, w in enumerate(inside):
            windows[w].add((anchor, off - k))
    assert all(len(x) == 1 for x in windows.values())


def test_digest_of_query(spark):
    d = "/root/testdata/sf0.001"
    row = substring_index.op9_substring_index(spark, d).where("n_removed = 0 and n_words > 0").first()
    text = spark.read.parquet(f"{d}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_chains_of_equal_runs_are_one_row():
    values = np.tile(arrays.mix(np.array([3, 9, 27], np.uint64)), 100)
    s = arrays.segments(values, np.array([0, 300]), 35, 12)
    at, times = repeats.folded(s)
    assert len(at) < 4 < len(s.row) and (s.n[at] * times).sum() == 300 - 34
    start, n_times, n = repeats.unpack_span(repeats.pack_span(s.start[at], times, s.n[at]))
    assert (start == s.start[at]).all() and (n_times == times).all() and (n == s.n[at]).all()


def shared_ids():
    """Null ids and one id with several texts: clean ones beside ones that repeat."""
    words = lambda seed: " ".join(f"s{seed}w{k}" for k in range(60))
    again, clean, near = words(1), words(2), words(3)
    return [(None, again), (None, clean), (None, near), (None, near + " tail"), (5, again), (6, clean + " x y"), (7, words(4)), (7, words(5)), (8, words(4)), (8, words(4)), (None, None), (-(2**63) + 1, words(6))]


def test_texts_that_share_an_id(spark):
    texts = shared_ids()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    test_substring_index(docs, docs.limit(0), texts)
    assert rows_of(near_dups.near_dups(docs)) == brute_components(texts)
    seen, want, done = set(), Counter(), {}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        b = (t or "").encode()
        if (i, b) not in done:
            gone = set()
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    gone.update(range(k, k + 100))
                seen.add(b[k : k + 100])
            done[i, b] = bytes(c for k, c in enumerate(b) if k not in gone)
        want[i, len(b), done[i, b]] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()) == want


def test_pipeline_stages_keep_texts_that_share_an_id(spark):
    import corpus_pipeline

    texts = shared_ids()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cut = Counter((r.doc_id, r.kept) for r in substring_index.substring_dedup(docs).where("n_removed > 0 and kept <> ''").collect())
    whole = Counter((i, t) for i, t in texts if t is None or not t.startswith(("s1", "s2", "s3", "s4")))
    assert rows_of(corpus_pipeline.substrings(spark, docs, "")) == cut + whole
    left = rows_of(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert left[None, texts[2][1]] + left[None, texts[3][1]] == 1 and left[None, texts[0][1]] == left[7, texts[6][1]] == 1
    assert not left[5, texts[4][1]] and not left[6, texts[5][1]] and not left[8, texts[8][1]]


def test_batches_against_a_kept_index(spark, docs, no_docs, texts, tmp_path):
    """Three batches and an empty one, each by an index opened anew: a batch's rows are those of a run over all batches so far."""
    path = f"file://{tmp_path}/kept"
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(t or "") for _, t in texts]
    batches = [rows[::3], rows[1::3] + [f"start {passage}"], rows[2::3] + [f"{passage} end", "only here " * 3]]
    seen: list[tuple[int, str]] = []
    for k, batch in enumerate(batches):
        new = [(1000 * k + n, t) for n, t in enumerate(batch)]
        seen += new
        index = substring_index.FingerprintIndex(spark, path, buckets=3)
        assert len(index.batches) == k
        got = substring_index.batch_dedup(spark.createDataFrame(new, "doc_id long, text string"), index)
        whole = substring_index.substring_dedup(spark.createDataFrame(seen, "doc_id long, text string"))
        want = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in whole.collect() if r.doc_id >= 1000 * k}
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.collect()} == want
        assert k == 0 or any(removed for _, removed, _ in want.values())
    index = substring_index.FingerprintIndex(spark, path)
    assert substring_index.batch_dedup(no_docs, index).count() == 0
    # The same ids and texts again are copies of what is there.
    again = substring_index.batch_dedup(spark.createDataFrame([(2000, passage)], "doc_id long, text string"), substring_index.FingerprintIndex(spark, path)).first()
    assert (again.doc_id, again.n_words, again.n_removed) == (2000, 50, 50)
