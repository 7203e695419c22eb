"""Graph searches, backward steps and call sites against plain loops, and bounds on the rows that they make."""

import random
from collections import defaultdict

import pytest

from tributary.operators import graph, scopes, taint

EDGES = "src string, dst string"


def plain_paths(edges, starts, depth):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found, stack = [], [(s,) for s in starts]
    while stack:
        path = stack.pop()
        if not out[path[-1]]:
            found.append(path)
        elif len(path) <= depth:
            stack += [(*path, b) for b in out[path[-1]] if b not in path]
    return sorted(found)


def plain_distance(edges, a, b, depth):
    near, at = {a}, 0
    while b not in near and at < depth:
        at, near = at + 1, near | {y for x, y in edges if x in near}
    return at if b in near else -1


@pytest.fixture(scope="module")
def random_edges():
    rng = random.Random(5)
    return [(f"n{rng.randrange(24)}", f"n{rng.randrange(30)}") for _ in range(60)]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_paths_of_random_graphs(spark, random_edges, depth):
    edges = spark.createDataFrame(random_edges, EDGES)
    starts = ["n1", "n2", "n29", "none"]
    table = spark.createDataFrame([(s,) for s in starts], "node string")
    want = plain_paths(random_edges, starts, depth)
    assert sorted(tuple(r.path) for r in graph.simple_paths(edges, table, depth).collect()) == want
    for target in ("n1", "n5", "n29", "none", "absent"):
        got = sorted(tuple(r.path) for r in graph.paths_through(edges, table, target, depth).collect())
        assert got == [p for p in want if target in p], target


def test_paths_through_a_node_of_many_layers(spark, monkeypatch):
    """Of 6**8 paths those through one node of the second and one way on from it are made; dead ends never."""
    layers = [[f"{k}.{i}" for i in range(6)] for k in range(9)]
    edges = [(a, b) for x, y in zip(layers, layers[1:], strict=False) for a in x for b in y if not a.startswith("1.3") and not b.startswith("1.3")]
    edges += [("0.0", "1.3"), ("1.3", "goal"), ("goal", "end"), ("goal", "loop"), ("loop", "goal")]
    made, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (made.append((out.columns, out.count())), out)[1])(real(df)))
    got = graph.paths_through(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("0.0",), ("0.1",)], "node string"), "goal", 9)
    assert [r.path for r in got.collect()] == [["0.0", "1.3", "goal", "end"]]
    # `loop` is met once: its way out repeats the target.
    assert sum(n for columns, n in made if "path" in columns) <= 5


def test_paths_of_empty_tables(spark):
    none = spark.createDataFrame([], EDGES)
    starts = spark.createDataFrame([("a",)], "node string")
    assert [r.path for r in graph.simple_paths(none, starts).collect()] == [["a"]]
    assert graph.paths_through(none, starts, "b").count() == 0 and graph.simple_paths(none, starts.limit(0)).count() == 0
    assert graph.pair_distances(none, none).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_distances_of_many_pairs(spark, depth):
    """More starts than one number has bits, starts in several partitions, equal and unknown and null ends."""
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(220)]
    pairs = [(f"n{a}", f"n{rng.randrange(160)}") for a in range(150) for _ in range(5)] + [("n3", "n3"), ("x", "x"), ("x", "y")]
    asked = spark.createDataFrame([*pairs, *pairs[:9], (None, "n1")], EDGES)
    got = {(r.src, r.dst): r.distance for r in graph.pair_distances(asked, spark.createDataFrame(edges, EDGES), depth).collect()}
    assert got == {(a, b): plain_distance(edges, a, b, depth) for a, b in pairs} | {(None, "n1"): -1}


def test_many_starts_share_rows(spark, monkeypatch):
    """640 starts into one chain: a round holds a row per node and 64 starts, and settled starts leave."""
    edges = [(f"s{k:03}", "c0") for k in range(640)] + [(f"c{k}", f"c{k + 1}") for k in range(8)]
    pairs = [(f"s{k:03}", "c3" if k else "c6") for k in range(640)]
    made, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (made.append((out.columns, out.count())), out)[1])(real(df)))
    got = graph.pair_distances(spark.createDataFrame(pairs, EDGES), spark.createDataFrame(edges, EDGES), 9).collect()
    assert {r.src: r.distance for r in got} == {a: 4 if b == "c3" else 7 for a, b in pairs}
    rounds = [n for columns, n in made if "bits" in columns]
    # Starts are numbered in up to 4 partitions, each with one number that isn't full.
    assert all(n <= 14 for n in rounds) and rounds[4:] == [1] * len(rounds[4:]) and len(rounds) <= 8


def test_many_pairs_are_bits_until_the_end(spark, monkeypatch):
    """640 starts that ask for 8 ends each: no table on the way has a row per pair."""
    edges = [(f"s{k:03}", "c0") for k in range(640)] + [(f"c{k}", f"c{k + 1}") for k in range(4)]
    pairs = [(f"s{k:03}", f"c{n}") for k in range(640) for n in range(8)]
    made, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (made.append(out.count()), out)[1])(real(df)))
    got = graph.pair_distances(spark.createDataFrame(pairs, EDGES), spark.createDataFrame(edges, EDGES), 6).collect()
    assert {(r.src, r.dst): r.distance for r in got} == {(a, b): int(b[1]) + 1 if int(b[1]) < 5 else -1 for a, b in pairs}
    assert max(made) < 700


def test_ends_that_others_ask_for_are_not_made(spark, monkeypatch):
    """320 starts into one node with 2000 ends, each asked for by one start: ends are met by the pairs, not made for all starts."""
    edges = [(f"s{k:03}", "hub") for k in range(320)] + [("hub", f"e{n}") for n in range(2000)] + [("e0", "hub"), ("e1", "s000")]
    pairs = [(f"s{n % 320:03}", f"e{n}") for n in range(2000)] + [(f"s{k:03}", "away") for k in range(320)] + [("s000", "hub"), ("s001", "s000")]
    made, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (made.append(out.count()), out)[1])(real(df)))
    got = graph.pair_distances(spark.createDataFrame(pairs, EDGES), spark.createDataFrame(edges, EDGES), 3).collect()
    want = {(a, b): 2 if b[0] == "e" else -1 for a, b in pairs} | {("s000", "hub"): 1, ("s001", "s000"): 3}
    assert {(r.src, r.dst): r.distance for r in got} == want and len(got) == len(want)
    assert max(made) < 2500


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_distances_of_many_pairs_in_turns(spark, monkeypatch, depth):
    """Words of starts are searched in several turns; each turn's tables hold its own words only."""
    monkeypatch.setattr(graph, "CELLS", 60)
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(500)]
    pairs = [(f"n{a}", f"n{rng.randrange(210)}") for a in range(200) for _ in range(2)]
    turns, real = [], graph._search
    monkeypatch.setattr(graph, "_search", lambda seed, wanted, *more: (turns.append(wanted.count()), real(seed, wanted, *more))[1])
    got = graph.pair_distances(spark.createDataFrame(pairs, EDGES), spark.createDataFrame(edges, EDGES), depth).collect()
    assert {(r.src, r.dst): r.distance for r in got} == {(a, b): plain_distance(edges, a, b, depth) for a, b in pairs}
    assert len(got) == len(set(pairs)) and len(turns) > 2 and max(turns) < sum(turns)


CODE = "file_path string, target string, source_expr string"


def test_backward_looks_in_the_same_file_first(spark):
    rows = [("a", "$t", "$h . $k"), ("a", "$k", "1"), ("b", "$k", "$_GET['b']"), ("b", "$h", "$k"), ("c", "$h", "$_GET['c']"), ("c", "$h", "$_GET['c']")]
    targets = spark.createDataFrame([("$t",)], "target string")
    code = spark.createDataFrame(rows, CODE)
    steps = lambda **more: {(r.file_path, r.variable, r.expression, r.depth) for r in taint.backward(targets, code, r"\$_GET", **more).collect()}
    first = {("a", "$t", "$h . $k", 1), ("a", "$k", "1", 2), ("b", "$h", "$k", 2), ("c", "$h", "$_GET['c']", 2)}
    assert steps() == first | {("b", "$k", "$_GET['b']", 3)}
    # c's $h is a source: the target goes no further.
    assert steps(first=True) == first
    assert taint.backward(targets.limit(0), code, "x").count() == 0 and taint.backward(targets, code.limit(0), "x").count() == 0


def test_backward_joins_a_hot_name_within_its_files(spark):
    """A name that every file assigns: rows joined are as many as its assignments, not their square."""
    n = 60
    rows = [(f"f{k}", "$t", "$data") for k in range(n)] + [(f"f{k}", "$data", f"{k}") for k in range(n)]
    found = taint.backward(spark.createDataFrame([("$t",)], "target string"), spark.createDataFrame(rows, CODE), r"\$_GET", 3)
    assert found.count() == 2 * n
    # Places that have no assignment of the name ask other files once per target.
    rows = [(f"f{k}", "$t", "$data") for k in range(n)] + [(f"g{k}", "$data", f"{k}") for k in range(n)]
    assert taint.backward(spark.createDataFrame([("$t",)], "target string"), spark.createDataFrame(rows, CODE), r"\$_GET", 3).count() == 2 * n


def test_values_of_parameters_are_counted_before_the_join(spark):
    calls = spark.createDataFrame([("x->get", ["1", "$a"])] * 40 + [("get", ["2"]), ("other", ["9"]), ("get", None), ("get", [])], "function_name string, args array<string>")
    functions = spark.createDataFrame([("a", "get", ["$p", "$q", "$r"]), ("b", "get", ["$z"]), ("b", "get", ["$z"]), ("c", "none", ["$n"])], "file_path string, name string, params array<string>")
    got = {tuple(r) for r in scopes.parameter_values(functions, calls).collect()}
    assert got == {("a", "get", "$p", 0, "1", 40), ("a", "get", "$p", 0, "2", 1), ("a", "get", "$q", 1, "$a", 40), ("b", "get", "$z", 0, "1", 40), ("b", "get", "$z", 0, "2", 1)}
