"""Codes and links of vectors, and the audit of sources, against plain loops."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tributary.llm import source_audit, vector_codes, vector_links

VECTORS = "vec_id long, embedding array<float>, label int, id int, n string, cid int, v array<int>, label_error long, h1 int"


def table(spark, rows):
    """Rows (id, vector, label) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 7, "x", 1, [1], 3, 2) for i, v, k in rows], VECTORS).repartition(3)


def bad_rows(width):
    return [(900, None, 1), (901, [], 1), (902, [math.nan] * width, None), (903, [1.0] * (width - 1) + [math.inf], 2), (904, [None] + [0.5] * (width - 1), 2)]


# --- codes -----------------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """(id, label, code, error) by comparing all with all, and the codebooks."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    w = len(kept[0][1])
    cuts = [(p * w // 4, (p + 1) * w // 4) for p in range(4)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cuts]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v[a:b], books[p])[1]].append(v[a:b])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in kept:
        best = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def code_rows(rng, n, width):
    out = [(int(i), rng.normal(0, 0.3, width).round(2).tolist(), int(rng.integers(3)) if rng.random() < 0.8 else None) for i in rng.permutation(n * 2)[:n]]
    return [*out, out[0], (out[1][0], out[2][1], 1), (None, out[3][1], None), (None, [0.0] * width, 5), (10_000, [0.1] * (width + 1), 1), *bad_rows(width)]


@pytest.mark.parametrize(("n", "width"), [(330, 8), (40, 10), (1, 4)])
def test_codes_equal_the_plain_loops(spark, n, width):
    rows = code_rows(np.random.default_rng(n), n, width) if n > 1 else [(5, [-0.3, 0.2, 7.5, -9.0], None)]
    want, books = plain_codes(rows)
    found, got = vector_codes.compressed(table(spark, rows))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in got] == books
    assert vector_codes.digest(got) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_no_vector_no_code(spark):
    for rows in ([], bad_rows(4)):
        found, books = vector_codes.compressed(table(spark, rows))
        assert found.collect() == [] and books == []


def test_bounds_hold_and_few_entries_are_refined():
    rng = np.random.default_rng(1)
    entries, rows = rng.integers(-500, 500, (256, 16)), rng.integers(-900, 900, (200, 16))
    near = vector_codes.Approximation(entries)
    true = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = near.bounds(rows)
    assert (lower <= true).all() and (true <= upper).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.5
    entry, distance = near.nearest(rows)
    assert (entry == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    same = vector_codes.Approximation(np.zeros((5, 3), np.int64))
    assert same.nearest(np.ones((2, 3), np.int64))[0].tolist() == [0, 0]


def test_far_vectors_stay_exact(spark):
    rows = [(k, [60_000.0 * (-1) ** k, k, -60_000.5, 0.25 * k], k % 2) for k in range(9)] + [(50, [70_000.0, 1, 1, 1], 0)]
    want, _ = plain_codes(rows[:-1])
    found, _ = vector_codes.compressed(table(spark, rows))
    assert sorted(map(tuple, found.collect())) == sorted(want)


# --- links -----------------------------------------------------------------------------------------------------------


def plain_links(rows, link=0.95):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    good = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    x = np.array([[*map(float, map(np.float32, v)), *[0.0] * (width - len(v))] if g else [0.0] * width for (_, v, _), g in zip(rows, good, strict=True)])
    norm = np.sqrt((x * x).sum(axis=1))
    x = x / np.where(norm > 0, norm, 1)[:, None]
    hit = (x @ x.T >= link) & np.array(good)[:, None] & np.array(good)[None]
    np.fill_diagonal(hit, False)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for o in np.flatnonzero(hit[todo.pop()]):
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        low = min((rows[o][0] for o in seen if rows[o][0] is not None), default=None)
        out.append((i, int(hit[k].sum()), low, i == low))
    return out


def link_rows(rng, width=16):
    out = [(k, rng.normal(size=width).tolist(), 0) for k in range(250)]
    for k in range(60):  # near copies of one, a chain, and partners about the limit
        out.append((300 + k, (np.array(out[3][1]) + rng.normal(0, 0.1, width)).tolist(), 0))
        out.append((400 + k, (np.array(out[-2][1] if k else out[5][1]) + rng.normal(0, 0.2, width)).tolist(), 0))
        out.append((500 + k, (np.array(out[k][1]) + rng.normal(0, 0.33, width)).tolist(), 0))
    out += [(600 + k, out[7][1], 0) for k in range(40)]  # equal ones
    out += [(650, (3 * np.array(out[8][1])).tolist(), 0), (651, out[9][1][:12], 0), (652, [0.0] * width, 0), (653, [0.0] * width, 0)]
    out += [out[10], (11, out[12][1], 0), (None, out[13][1], 0), (None, rng.normal(size=width).tolist(), 0), (None, None, 0)]
    return [*out, *bad_rows(width)]


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in {"HOME": 16, "OTHER": 32, "PER_CELL": 8, "SAMPLE": 100}.items():
            monkeypatch.setattr(vector_links, name, value)
    rows = link_rows(np.random.default_rng(7))
    got = vector_links.linked(table(spark, rows), recall=0.99999)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_links(rows), key=key)


def test_no_vector_no_link(spark):
    assert vector_links.linked(table(spark, [])).collect() == []
    assert sorted(map(tuple, vector_links.linked(table(spark, [(3, None, 1), (4, [0.0], 1)])).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_traversal_takes_the_nearest_cells_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = vector_links.Grid([x[:6, :6], x[:6, 6:]])
    (one, r), (two, s) = grid.steps(x, 0), grid.steps(x, 1)
    home, row, cell = grid.visits(x)
    assert (home == one * 6 + two).all()
    for k in range(40):
        visited = cell[row == k]
        cost = (r[k][:, None] + s[k][None]).ravel()
        assert visited[0] == home[k] and len(set(visited)) == len(visited)
        assert (np.diff(cost[visited]) >= -1e-15).all()
        assert cost[visited].max() <= np.delete(cost, visited).min(initial=np.inf) + 1e-15


def test_recall_of_partners_at_the_limit():
    """Partners exactly at the limit, in random directions, over a fine grid."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.9501 * x + math.sqrt(1 - 0.9501**2) * away
    grid = vector_links.Grid([x[:32, :32], x[:32, 32:]])
    home, row, cell = grid.visits(x)
    there, row2, cell2 = grid.visits(y)
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    back = set(zip(row2.tolist(), cell2.tolist(), strict=True))
    met = [(k, int(there[k])) in seen if there[k] >= home[k] else (k, int(home[k])) in back for k in range(len(x))]
    assert np.mean(met) >= 0.999
    assert len(cell) < 0.4 * len(x) * 32 * 32


# --- audit -----------------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words, word = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                words += [word.translate(low)] if word else []
                word = ""
            else:
                word += c
        docs[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        here = sorted(s for g, s in groups if g == lang)
        v = len(kept)
        share = lambda count: {t: 1 + 10**9 * (count[t] + 5) // (sum(count[x] for x in kept) + 5 * v) for t in kept}
        p = {s: share(n[lang, s]) for s in here}
        q = share(sum((n[lang, s] for s in here), Counter()))
        for s in here:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in here if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i.decode(), -x, k) for k, (x, i) in enumerate(found, 1)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(11)
    letters = ["a", "b", "é", "ß", "中", "Z", "Q", "\U0001f600", "x"]
    vocabulary = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(120)]
    rows = []
    for k in range(90):
        words = rng.choice(vocabulary, rng.integers(0, 60)).tolist()
        rows.append((rng.choice([" ", "\n", "-", "1", "\x00"]).join(words), rng.choice(["en", "fr"]), f"s{rng.integers(5)}é" if k % 3 else "s0é"))
    rows += [(None, "en", "null text"), ("", "only", "one"), ("a b c", "few", "x"), ("a b", "few", "y"), ("hello A", None, None), ("hello a", "", "s"), ("hello a", "", None)]
    # Ties: terms with one value, some of them prefixes of others.
    tied = " ".join("t" + "u" * k for k in range(12)) + " tied tiee tié"
    return rows + [(tied, "tie", "first"), (tied, "tie", "first"), ("a other", "tie", "second"), ("a other", "tie", "second")]


@pytest.mark.parametrize("top", [3, 50])
def test_audit_equals_the_plain_loops(spark, monkeypatch, top):
    for name, value in {"MIN_DOCS": 2, "TOP": top, "PAIR_BLOCK": 2}.items():
        monkeypatch.setattr(source_audit, name, value)
    rows = audit_rows()
    docs = spark.createDataFrame([(t, g, s, 1, "x", 2, "y") for t, g, s in rows], "text string, lang string, source string, n int, term string, value int, part string").repartition(5)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == plain_audit(rows, 2, top)


def test_audit_of_nothing(spark, no_docs):
    assert source_audit.audit(no_docs).collect() == []


def test_tasks_send_counts_when_they_hold_many(spark, monkeypatch):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    whole = sorted(map(tuple, source_audit.counts(docs).collect()))
    monkeypatch.setattr(source_audit, "HELD", 5)
    assert sorted(map(tuple, source_audit.counts(docs).collect())) == whole


@pytest.mark.parametrize("k", [1, 4, 9, 40])
def test_radix_selection_is_a_window(spark, k):
    rng = np.random.default_rng(k)
    rows = sorted({(f"g{rng.integers(4)}", int(rng.choice([0, 5, 1023, 1024, 2**20, 2**30 - 1, rng.integers(2**30)])), "".join(rng.choice(["a", "b", "é"], rng.integers(1, 8)))) for _ in range(300)})
    rows = [r for k, r in enumerate(rows) if (r[0], r[2]) not in {(x[0], x[2]) for x in rows[:k]}] + [(None, 3, "n"), (None, 3, "m")]
    from tributary.llm.shared import save

    table = save(spark.createDataFrame(rows, "g string, value long, item string"), "rows")
    got = source_audit.top_rows(table, ["g"], "value", "item", k)
    want = []
    for g in {r[0] for r in rows}:
        ranked = sorted((-v, i.encode()) for h, v, i in rows if h == g)[:k]
        want += [(g, -v, i.decode(), n) for n, (v, i) in enumerate(ranked, 1)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("g", "value", "item", "rank").collect()), key=key) == sorted(want, key=key)
