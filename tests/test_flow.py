"""Traces across scopes, classes, calls and returns; all sources of a statement; edges and paths from literal tables."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import carriers, flow, taint
from tributary.plans import trace
from tributary.sources import parse

FILES = "file_path string, language string, content string"


def traced(spark, *rows, **config):
    return trace.trace_files(spark, spark.createDataFrame([(p, g, c) for p, g, c in rows], FILES), trace.Config(**config))


def held(t):
    return {(r.class_name, r.scope, r.variable): r.depth for r in t.tainted.collect()}


def sinks(t):
    return {(r.function_name, r.variable) for r in t.arguments.collect()}


def test_every_source_of_a_statement(spark):
    t = traced(spark, ("a.php", "php", "<?php\n$x = $_GET['a'] . $_GET['b'];\nf($_GET['c'], $_GET['d'] . $_POST['e']);\n$y = $_GET;\nfunction f($p, $q) { g($q); }"))
    assert {(r.source_type, r.key, r.line, r.variable) for r in t.sources.collect()} == {
        ("http_get", "a", 2, "$x"), ("http_get", "b", 2, "$x"), ("http_get", "c", 3, ""), ("http_get", "d", 3, ""), ("http_post", "e", 3, ""), ("http_get", "", 4, "$y"),
    }
    sources = {r.source_id for r in t.reached.where("name = '$q'").collect()}
    assert sources == {"a.php:3:http_get:d", "a.php:3:http_post:e"}
    assert {r.source_id for r in t.reached.where("name = '$p'").collect()} == {"a.php:3:http_get:c"}
    assert ("g", "$q") in sinks(t)
    use = carriers.usages(parse.nodes(t.facts))
    assert {(r.superglobal, r.key, r.context) for r in use.collect()} == {("$_GET", "a", "assignment"), ("$_GET", "b", "assignment"), ("$_GET", "c", "function_arg"), ("$_GET", "d", "function_arg"), ("$_POST", "e", "function_arg"), ("$_GET", "", "assignment")}


def test_scopes_that_share_names(spark):
    code = """<?php
function f() { $x = $_GET['a']; send($x); }
function g() { $x = 1; $y = $x; sink($y); }
class A { function set() { $this->p = $_GET['b']; } function get() { $v = $this->p; show($v); } }
class B { function out() { $z = $this->p; out($z); } }
"""
    t = traced(spark, ("a.php", "php", code))
    assert held(t) == {("", "f", "$x"): 0, ("A", "", "$this->p"): 0, ("A", "get", "$v"): 1}
    assert sinks(t) == {("send", "$x"), ("show", "$v")}


def test_functions_of_one_name_and_names_of_the_file(spark):
    code = """<?php
$top = $_GET['t'];
if ($a) { function twice() { $m = $_GET['m']; } } else { function twice() { $n = $m; } }
function h() { global $top; $in = $top; }
function k() { $out = $top; }
"""
    t = traced(spark, ("a.php", "php", code))
    # PHP's functions see a variable of the file only where they say so; `global` names are the file's when read, too.
    found = held(t)
    assert ("", "twice", "$m") in found and not any(v == "$n" for _, _, v in found) and not any(v == "$out" for _, _, v in found)


def test_nested_scopes_of_scripts(spark):
    code = "const q = req.query.id;\nfunction outer() {\n  const a = q;\n  function inner() {\n    const b = a;\n    run(b);\n  }\n}\nfunction other(a) {\n  const c = a;\n  skip(c);\n}\n"
    t = traced(spark, ("a.js", "javascript", code))
    assert {("run", "b")} == {s for s in sinks(t) if s[0] in ("run", "skip")}
    py = "def f():\n    name = request.args.get('n')\n    return name\n\ndef g():\n    x = f()\n    a, b = x, 1\n    run(a)\n\ndef h(name):\n    y = name\n    skip(y)\n"
    t = traced(spark, ("a.py", "python", py))
    assert ("run", "a") in sinks(t) and ("skip", "y") not in sinks(t)


@pytest.mark.parametrize("call", ["getX()", "$o->get()", "Repo::fetch()", "$this->own()"])
def test_returned_input(spark, call):
    code = f"""<?php
function getX() {{ return $_GET['x']; }}
class Repo extends Base {{
    public function get() {{ $v = $_POST['y']; return $v; }}
    static function fetch() {{ return getX(); }}
    function use() {{ $y = {call}; run($y); }}
}}
class Base {{ function own() {{ return $_COOKIE['c']; }} }}
"""
    t = traced(spark, ("a.php", "php", code))
    assert ("run", "$y") in sinks(t)


def test_what_enters_leaves_by_its_own_call(spark):
    """A tainted argument comes back to its own call alone."""
    t = traced(spark, ("a.php", "php", "<?php\nfunction id($v) { $w = $v; return $w; }\n$in = $_GET['x'];\n$a = id($in);\n$b = id('const');\nf($a); g($b);\n"))
    assert {("f", "$a"), ("id", "$in")} == sinks(t)


def test_chains_run_through_calls(spark):
    code = """<?php
$k = $_GET['k'];
$n = $k;
$back = mid($n);
function mid($m) { $s = $m; sink($s); last($s); return 1; }
function last($e) { $f = $e; done($f); }
function own() { $r = $_GET['r']; return $r; }
$got = own();
"""
    t = traced(spark, ("a.php", "php", code))
    found = held(t)
    assert [found["", s, v] for s, v in (("", "$k"), ("", "$n"), ("mid", "$m"), ("mid", "$s"), ("last", "$e"), ("last", "$f"))] == [0, 1, 2, 3, 4, 5]
    steps = {(r.kind, tuple(r.steps)) for r in t.paths().collect()}
    assert ("call", ("$k", "$n", "$m", "$s", "$e", "$f", "done[0]")) in steps and ("variable", ("$r", "own()", "$got")) in steps
    edges = {(r.src, r.dst, r.type) for r in t.deep_edges().collect()}
    assert {("var:a.php:$n", "var:a.php:$m", "parameter"), ("var:a.php:$r", "ret:a.php:::own", "return"), ("ret:a.php:::own", "var:a.php:$got", "return"), ("var:a.php:$s", "func:a.php:sink", "call")} <= edges
    assert {r.variable: r.parent for r in t.tainted.collect()}["$s"] == "$m"
    near = traced(spark, ("a.php", "php", code), max_depth=3)
    assert max(held(near).values()) == 3


def test_inherited_methods(spark):
    code = """<?php
class A { function save($a) { one($a); } function load($b) { two($b); } }
class B extends A { function load($c) { parent::load($c); three($c); } }
class C extends B { function go() { $x = $_GET['x']; $this->save($x); $this->load($x); } }
class D { function save($d) { four($d); } }
"""
    t = traced(spark, ("a.php", "php", code))
    assert {("one", "$a"), ("two", "$b"), ("three", "$c")} <= sinks(t) and ("four", "$d") not in sinks(t)
    up = {(r.class_name, r.ancestor): r.distance for r in taint.ancestors(parse.classes(t.facts)).collect()}
    assert up == {("B", "A"): 1, ("C", "B"): 1, ("C", "A"): 2}


def test_targets_taken_apart(spark):
    rows = [
        ("a.php", "php", "<?php\nlist($m, $n) = f($_GET['a']);\n['x' => $p, 'y' => [$q]] = $m;\n"), ("b.py", "python", "a, b = f(sys.argv)\n(c, d) = a\n"), ("c.js", "javascript", "const {u, v: w} = req.body;\nlet [x, y] = u;\n"),
        ("d.go", "go", "func f() {\n\tv, err := os.Open(x)\n}\n"),
    ]
    found = {}
    for path, language, code in rows:
        found[path] = [f["target"] for f in parse.parse(path, language, code) if f["kind"] == "assignment"]
    assert found == {"a.php": ["$m", "$n", "$p", "$q"], "b.py": ["a", "b", "c", "d"], "c.js": ["u", "w", "x", "y"], "d.go": ["v", "err"]}
    t = traced(spark, *rows[:3])
    assert {"$m", "$n", "$p", "$q", "a", "b", "c", "d", "u", "w", "x", "y"} <= {r.variable for r in t.tainted.collect()}


def test_parameter_summaries_go_through_functions(spark):
    """A wrapper's parameter reaches its return through the functions that it calls, whose summaries come later."""
    code = "<?php\nfunction a($p, $q) { $x = b($p); return $x; }\nfunction b($r) { $y = c($r, 1); return $y; }\nfunction c($s, $t) { return $s; }\nfunction d($u) { $u2 = 1; return $u2; }\n"
    table = parse.facts(spark.createDataFrame([("a.php", "php", code)], FILES))
    functions, d = parse.functions(table), None
    resolved = taint.resolve(parse.calls(table), functions)
    # Without assignments the arguments alone carry the value.
    none = flow.assign_edges(parse.assignments(table).limit(0), d)
    got = flow.parameter_summaries(functions, none, flow.argument_sites(resolved, d), flow.return_sites(parse.returns(table), d))
    assert {(r.callee_home, r.position) for r in got.collect()} == {("::a", 0), ("::b", 0), ("::c", 0)}


def test_paths_double(spark):
    edges = spark.createDataFrame([("f", "", f"$v{k}", flow.ALWAYS, "assign", "f", "", f"$v{k + 1}", f"$v{k + 1}", k) for k in range(13)], "file_path string, home string, name string, at long, kind string, to_file string, to_home string, to_name string, label string, since long")
    seeds = spark.createDataFrame([("f", "", "$v0", "s", "$v0", -1)], "file_path string, home string, name string, source_id string, label string, since long")
    found = flow.paths(flow.reach(seeds, edges, 12))
    assert {len(r.path): r.path[-1] for r in found.collect()} == {k + 1: f"$v{k}" for k in range(13)}
    assert found.where(F.element_at("path", 1) != "$v0").count() == 0


def test_a_place_keeps_its_nearest_way(spark):
    t = traced(spark, ("a.php", "php", "<?php\n$a = $_GET['x'];\n$b = $a;\n$c = $b;\n$c = $a;\n$e = $d;\n$d = $a;\n"))
    assert held(t) == {("", "", "$a"): 0, ("", "", "$b"): 1, ("", "", "$c"): 1, ("", "", "$d"): 1}


def test_nothing_to_trace(spark):
    t = traced(spark, ("a.php", "php", "<?php $x = 1;"), ("b.php", "php", None))
    assert t.sources.count() == t.tainted.count() == t.arguments.count() == t.paths().count() == 0


def test_edges_are_made_once(spark, monkeypatch):
    """The edges' own plan runs once, not in every round: the rounds read what was written."""
    made, real = [], flow.cut
    monkeypatch.setattr(flow, "cut", lambda df: (made.append(df.columns), real(df))[1])
    edges = spark.createDataFrame([("a", "", f"n{k}", flow.ALWAYS, "assign", "a", "", f"n{k + 1}", f"n{k + 1}", -1) for k in range(3)], "file_path string, home string, name string, at long, kind string, to_file string, to_home string, to_name string, label string, since long")
    seeds = spark.createDataFrame([("a", "", "n0", "s", "n0", -1)], "file_path string, home string, name string, source_id string, label string, since long")
    assert {(r.name, r.depth) for r in flow.reach(seeds, edges).collect()} == {(f"n{k}", k) for k in range(4)}
    assert len([c for c in made if "how" in c]) == 1
