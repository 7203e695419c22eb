"""The analysis operators on small source trees and literal tables."""

import json
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tributary.functions import text as T
from tributary.operators import aggregate, conditions, graph, render, search, snippets, taint
from tributary.operators.search import Query, search as find
from tributary.plans import trace
from tributary.rules.catalogue import RULES, framework_patterns, skip_dirs, source_rules
from tributary.sources import files as scans
from tributary.sources import parse
from tributary.streaming.detect import rule_counts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.go", "main.go", True), ("*.go", "main.php", False), ("**/*.go", "pkg/foo/bar.go", True), ("pkg/**/*.go", "pkg/a/b/c.go", True), ("handler?.go", "handler1.go", True), ("handler?.go", "handlers.go", True), ("handler?.go", "handler.go", False)],
)
def test_globs(spark, glob, path, hit):
    assert value(spark, F.lit(path).rlike(T.glob_pattern(glob))) == hit


MENTIONS = [
    ("array('k' => $input)", "$input", True), ("'a' . $name . 'b'", "$name", True), ("f($data)", "$data", True), ("$args[0]", "$args", True), ("$x = $user_input;", "$user_input", True),
    ("$a ? $val : 1", "$val", True), ("$x", "$x", True), ("#{@name}", "@name", True), ("#{@@count}", "@@count", True), ("foo + 1", "foo", True), ("g(data)", "data", True), ("x", "x", True),
    ("$order_id", "$order", False), ("$order", "$order_id", False), ("@item_list", "@item", False), ("foobar", "foo", False), ("foo", "foobar", False),
]


@pytest.mark.parametrize("expression, variable, hit", MENTIONS)
def test_mentions_whole_names(spark, expression, variable, hit):
    assert value(spark, T.mentions(F.lit(expression), F.lit(variable))) == hit


def test_refers_to(spark):
    cases = [("$x", "$x", True), ("$x", "$y", False), ("$obj.prop", "$obj", True), ("$arr['key']", "$arr", True), ("$obj.prop", "$other", False), ("f(g($a))", "$a", True), ("foobar", "foo", False)]
    df = spark.createDataFrame(cases, "value string, variable string, expected boolean")
    assert df.where(T.refers_to(F.col("value"), F.col("variable")) != F.col("expected")).count() == 0


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(T.normalise_snippet(F.lit("a\n  b\r\tc "))) == "a b c"
    assert len(v(T.normalise_snippet(F.lit("x" * 300)))) == 100
    assert v(T.bracket_key(F.lit("$_GET['id']"))) == "id" and v(T.bracket_key(F.lit("$_GET[$k]"))) == "$k" and v(T.bracket_key(F.lit("$a"))) == ""
    assert v(T.member_key(F.lit("req.body.name"), "req.body")) == "name" and v(T.member_key(F.lit('req.body["n"]'), "req.body")) == "n"
    assert v(T.base_variable(F.lit("$v['a']['b']"))) == "$v['a']" and v(T.base_variable(F.lit("$v->x"))) == "$v"
    assert v(T.short_path(F.lit("/a/b/c.php"))) == "b/c.php" and v(T.signature_key(F.lit("A( b,\tc )"))) == "a(b,c)"
    assert v(T.safe_id(F.lit("a:b/c"))) == "a_b_c" and v(T.escaped_label(F.lit('a"b\n'))) == 'a\\"b\\n'
    assert v(T.line_at(F.lit("a\nb"), F.lit(2))) == "b" and v(T.line_at(F.lit("a"), F.lit(9))) is None
    assert v(T.diff_line(F.lit("+ x"))) == " x" and v(T.is_identifier(F.lit("a$1"))) and not v(T.is_identifier(F.lit("1a")))


SYMBOL = "seq long, id string, name string, type string, file_path string, class_name string, parameters array<string>, return_type string, language string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "a", "processInput", "function", "/app/handler.go", "", ["req", "res"], "", "go"), (2, "b", "processOutput", "function", "/app/handler.go", "", [], "", "go"),
        (3, "c", "validate", "function", "/app/a.go", "", ["data"], "bool", "go"), (4, "d", "validate", "method", "/app/b.php", "User", [], "", "php"),
        (5, "e", "User", "class", "/app/b.php", "User", [], "", "php"), (6, "f", "User", "function", "/app/c.go", "", [], "", "go"),
    ]
    return spark.createDataFrame(rows, SYMBOL)


def test_search(spark, index):
    seqs = lambda q: [(r.seq, r.score, r.matched_by) for r in find(index, q).collect()]
    assert seqs(Query(name="processInput")) == [(1, 100.0, "exact_name")]
    assert seqs(Query(name_pattern="^process")) == [(1, 75.0, "name_pattern"), (2, 75.0, "name_pattern")]
    assert seqs(Query(name="User", type="class")) == [(5, 100.0, "exact_name")]
    assert seqs(Query(name="validate", language="php")) == [(4, 100.0, "exact_name")]
    assert seqs(Query(has_parameter="req")) == [(1, 30.0, "parameter")]
    assert seqs(Query(name_pattern="process", has_parameter="req")) == [(1, 105.0, "name_pattern"), (2, 75.0, "name_pattern")]
    assert seqs(Query(language="go")) == [] and len(seqs(Query(file_pattern="/app/*.go"))) == 4
    assert len(seqs(Query(name_pattern=".", limit=3))) == 3
    assert [r.seq for r in search.latest(index, "name").orderBy("seq").collect()] == [1, 2, 4, 6]
    refs = spark.createDataFrame([("a", "/app/main.go", 25, "call")], "symbol_id string, file string, line int, ref_type string")
    assert search.with_references(index, refs).select("name", "line").first() == Row(name="processInput", line=25)
    usages = spark.createDataFrame([("validate", "/app/b.php"), ("validate", "/x"), ("none", "/x")], "name string, file_path string")
    found = search.definitions(usages, index, "name", "file_path", "seq").collect()
    assert {(r.name, r.file_path): r.definition for r in found} == {("validate", "/app/b.php"): 4, ("validate", "/x"): 3, ("none", "/x"): None}
    assert {r.type: r.total for r in search.statistics(index).collect()} == {"function": 4, "method": 1, "class": 1}


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "leaf")], "src string, dst string")


def test_graph(spark, diamond):
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    start = nodes.where("node = 'a'")
    assert {r.node: r.distance for r in graph.distances(nodes, diamond, start).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": -1, "y": -1, "z": -1}
    paths = {r.node: r.path for r in graph.shortest_paths(diamond, start, nodes).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}
    every = sorted("".join(r.path) for r in graph.simple_paths(diamond, nodes.where("node in ('a', 'x')")).collect())
    assert every == ["abd", "acd", "xyzleaf"]
    assert [r.path for r in graph.paths_through(diamond, start, "c").collect()] == [["a", "c", "d"]]
    assert graph.simple_paths(diamond, start, 1).count() == 0
    pairs = Counter((r.direction, r.node, r.other) for r in graph.neighbours(diamond, nodes).collect())
    assert pairs["callee", "a", "b"] == 1 and ("callee", "z", "leaf") not in pairs and pairs["caller", "d", "b"] == 1


PHP = """<?php
// $_GET['no']
class Repo {
    public function find($id, $limit) {
        $sql = "select " . $id;
        return $sql;
    }
}
function clean($v) { return $v; }
$a = $_GET['id'];
$b = $a;
$c = clean($b);
query($c, 1);
$safe = $idx;
if ($a == null) {
    $z = 1;
}
"""
OTHER = """<?php
function query($q, $n) {
    $text = $q;
    run($text);
}
"""
SOURCES = {
    "app/a.php": PHP,
    "app/b.php": OTHER,
    "node_modules/x.js": "const a = req.query.id;",
    "web/s.js": "const express = require('express');\nconst id = req.query.id;\nconst twice = id + id;\nsend(twice);\n",
    "py/v.py": "from flask import request\ndef view():\n    name = request.args.get('name')\n    other = name\n    return render(other)\n",
    "go/m.go": 'package m\nimport "net/http"\nfunc h(w http.ResponseWriter, r *http.Request) {\n\tq := r.URL.Query().Get("q")\n\tsave(q)\n}\n',
    "rb/c.rb": "class C < ApplicationController\n  def show\n    x = params[:id]\n    puts(x)\n  end\nend\n",
    "c/m.c": 'int main(int argc, char **argv) {\n  char *p = getenv("HOME");\n  use(p);\n}\n',
    "README.md": "# none",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return str(root)


def test_scan(spark, tree):
    rows = {r.file_path: r for r in scans.scan(spark, tree, max_bytes=200).collect()}
    assert sorted(rows) == ["app/a.php", "app/b.php", "c/m.c", "go/m.go", "py/v.py", "rb/c.rb", "web/s.js"]
    assert rows["app/a.php"].error == "file too large" and rows["app/a.php"].content is None and rows["py/v.py"].language == "python"
    assert [r.file_path for r in scans.scan(spark, tree, ["php"], exclude=["**/a.php"]).collect()] == ["app/b.php"]
    assert [r.file_path for r in scans.scan(spark, tree, include=["*.go"]).collect()] == ["go/m.go"]


def test_scan_odd_files(spark, tmp_path):
    """A Latin-1 file, a root with special characters, and bodies that must not be read."""
    root = tmp_path / "c++(x) v1"
    for name, content in {"src/a.php": b"<?php $x = 'caf\xe9';", "vendor/b.php": b"x" * 9000, "big.php": b"y" * 9000, "notes.bin": b"z" * 9000, "Rakefile": b"a = 1", "README": b"no", "src/vendored.php": b"<?php $y = 1;"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5000)  # reading a larger body fails
    try:
        for at in (str(root), f"file://{root}"):
            rows = {r.file_path: r for r in scans.scan(spark, at, max_bytes=4000).collect()}
            assert sorted(rows) == ["Rakefile", "big.php", "src/a.php", "src/vendored.php"]
            assert rows["src/a.php"].error == "not UTF-8" and rows["src/a.php"].content == "<?php $x = 'caf\ufffd';"
            assert rows["big.php"].error == "file too large" and rows["big.php"].content is None and rows["Rakefile"].language == "ruby"
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_names_and_skips(spark):
    df = spark.createDataFrame([("a/Gemfile", "ruby"), ("Makefile", None), ("x/README", None), ("a.PY", "python"), ("b.png", None)], "file_path string, language string")
    assert df.where(~scans.language_of(F.col("file_path")).eqNullSafe(F.col("language"))).count() == 0
    assert value(spark, scans.is_binary(F.lit("x/b.PNG"))) and not value(spark, scans.is_binary(F.lit("png")))
    assert value(spark, scans.is_skipped(F.lit("a/Vendor/b.php"))) and not value(spark, scans.is_skipped(F.lit("vendors/b")))
    assert value(spark, scans.is_skipped_php(F.lit("a/tests/b.php"))) and not value(spark, scans.is_skipped_php(F.lit("a/Tests/b.php")))
    assert {".git", ".idea", "obj"} <= set(skip_dirs(["c_sharp"])) and "vendor" not in skip_dirs(["c_sharp"])


def test_forward_trace(spark, tree):
    t = trace.trace(spark, tree)
    sources = {(r.file_path, r.source_type, r.key, r.variable) for r in t.sources.collect()}
    assert {("app/a.php", "http_get", "id", "$a"), ("web/s.js", "http_get", "id", "id"), ("py/v.py", "http_get", "name", "name"), ("go/m.go", "http_get", "q", "q"), ("rb/c.rb", "http_request", "id", "x"), ("c/m.c", "env_var", "HOME", "p")} <= sources
    assert not any(k == "no" for _, _, k, _ in sources)
    tainted = {(r.file_path, r.variable): r.depth for r in t.tainted.collect()}
    assert tainted["app/a.php", "$a"] == 0 and tainted["app/a.php", "$b"] == 1 and ("app/a.php", "$safe") not in tainted
    # Across a call and a file: clean() returns its argument, query()'s parameter is assigned on.
    assert ("app/a.php", "$c") in tainted and ("app/b.php", "$q") in tainted and ("app/b.php", "$text") in tainted
    functions = {(r.file_path, r.function_name): [p["index"] for p in r.tainted_params] for r in t.functions.collect()}
    assert functions["app/a.php", "query"] == [0] and functions["app/b.php", "run"] == [0] and ("web/s.js", "send") in functions and ("py/v.py", "render") in functions
    assert t.top_files(1).first().file_path == "app/a.php"
    assert {r.metric for r in t.summary().collect()} == {"files", "sources", "variables", "functions"}
    nodes, edges = t.graph()
    dot = render.document("flow", nodes, edges)
    assert dot.startswith("digraph flow {") and "->" in dot and render.document("f", nodes, edges, "mermaid").startswith("flowchart")
    assert json.loads(render.json_lines(edges).first().json)["type"] in ("assignment", "call")


def test_custom_rules_and_catalogue(spark):
    files = spark.createDataFrame([("a.php", "php", "<?php $x = my_input('k');")], "file_path string, language string, content string")
    t = trace.trace_files(spark, files, trace.Config(custom_rules=[("php", "user_input", r"\bmy_input\s*\(", r"\('(\w+)'")]))
    assert [(r.source_type, r.key, r.variable) for r in t.sources.collect()] == [("user_input", "k", "$x")]
    languages = Counter(r.language for r in source_rules(spark).collect())
    assert len(languages) == 11 and languages["typescript"] > languages["javascript"] and languages["cpp"] > languages["c"] and len(RULES) > 80


def test_framework_patterns(spark):
    rows = [r.asDict() for r in framework_patterns(spark).collect()]
    assert len({r["id"] for r in rows}) == len(rows) > 400 and len({r["framework"] for r in rows}) > 30
    cases = {
        "laravel_method_input_http_request": ("$x = $this->request->input('k');", "k"), "koa_member_query_http_get": ("ctx.query.k", "k"), "fastapi_function_UploadFile_http_file": ("f: bytes = UploadFile('k')", "k"),
        "actix-web_type_Query_http_get": ("fn f(q: web::Query<T>)", ""), "rocket_derive_FromForm_user_input": ("#[derive(Debug, FromForm)]", ""), "spring_annotation_RequestParam_http_get": ("@RequestParam(\"k\") String x", "k"), "asp.net_attribute_FromBody": ("f([FromBody] T x)", ""),
        "rails_member_headers_http_header": ("request.headers['k']", "k"), "rust_method_var_env_var": ('std::env::var("k")', "k"), "cpp_type_ifstream_file": ("std::ifstream f(name);", ""), "symfony_member_query_http_get": ("$request->query->k", "k"),
    }
    for name, (code, key) in cases.items():
        r = next(x for x in rows if x["id"] == name)
        assert value(spark, F.lit(code).rlike(r["pattern"])), name
        assert not r["key_pattern"] or value(spark, F.regexp_extract(F.lit(code), r["key_pattern"], 1)) == key, name
        assert not value(spark, F.lit("nothing of this").rlike(r["pattern"])), name


def test_interprocedural_calls(spark):
    """Methods, static calls and names that only a suffix tells."""
    code = """<?php
class A {
    public function run($q) { $this->save($q); A::keep($q); free($q); }
    private function save($s) { return $s; }
    static function keep($k) { $out = $k; }
}
class B { function save($other) { return 1; } }
function free($f) { $g = $f; }
function main() {
    $in = $_GET['x'];
    $a = new A();
    $a->run($in);
    $late = later($early);
    $early = $in;
}
function later($p) { return $p; }
"""
    files = spark.createDataFrame([("a.php", "php", code)], "file_path string, language string, content string")
    t = trace.trace_files(spark, files)
    tainted = {r.variable for r in t.tainted.collect()}
    assert {"$in", "$q", "$s", "$k", "$out", "$f", "$g", "$early"} <= tainted
    # The call comes before the assignment that taints its argument; B's method isn't the one that is called.
    assert not {"$late", "$p", "$other"} & tainted
    edges = {(r.src, r.dst) for r in t.deep_edges().collect()}
    assert ("var:a.php:$k", "var:a.php:$out") in edges and any(a.startswith("a.php:") and b == "var:a.php:$in" for a, b in edges)
    assert ["$in", "$q", "$f", "$g"] in [list(r.steps) for r in t.paths().collect()]
    assert t.receives_input("free").count() == 1 and t.receives_input("nothing").count() == 0
    assert [(r.language, r.files) for r in t.by_language().collect()] == [("php", 1)]
    limited = trace.trace_files(spark, files, trace.Config(max_sources=1))
    assert limited.sources.count() == 1
    report = trace.backward_report(spark, files, ["$out", "none"]).collect()
    assert {r.target: (r.has_input, r.n_sources) for r in report}["$none"] == (False, 0)


def test_symbol_index(spark, tmp_path):
    index = search.SymbolIndex(spark, f"file://{tmp_path}/index")
    assert index.symbols().count() == 0
    row = lambda i, name, kind, path, owner, line: (i, name, kind, path, owner, ["p"], "", "go", line)
    schema = search.SYMBOLS + ", line int"
    index.add(spark.createDataFrame([row("b", "f", "function", "/a.go", "", 9), row("a", "f", "function", "/a.go", "", 2), row("c", "T", "class", "/a.go", "T", 5)], schema))
    index.add(spark.createDataFrame([row("d", "f", "method", "/b.go", "T", 1)], schema))
    index.add_references(spark.createDataFrame([("a", "/x.go", 3, "call"), ("a", "/w.go", 4, "call"), ("b", "/x.go", 1, "read")], search.REFERENCES))
    assert [r.id for r in index.lookup(name="f").collect()] == ["a", "b", "d"] and index.last(name="f").first().id == "d"
    assert [r.id for r in index.lookup(class_name="T", name="f").collect()] == ["d"] and index.references("a").count() == 2
    assert [(r.id, r.score) for r in find(index.symbols(), Query(name="f", limit=2)).collect()] == [("a", 100.0), ("b", 100.0)]
    index.clear()
    assert index.symbols().count() == 0 and index.references("a").count() == 0


def test_backward_trace(spark):
    rows = [("a.php", "php", "<?php\n$t = $b;\n"), ("b.php", "php", "<?php\n$b = $_POST['x'];\n$u = 1;\n")]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    found = {(r.target, r.file_path, r.expression, r.depth, r.is_source) for r in trace.trace_backward(spark, files, ["$t", "u", "none"]).collect()}
    assert found == {("$t", "a.php", "$b", 1, False), ("$t", "b.php", "$_POST['x']", 2, True), ("$u", "b.php", "1", 1, False)}


def test_call_graph_frameworks_symbols(spark, tree):
    files = scans.scan(spark, tree)
    nodes, edges = trace.call_graph(files)
    assert {"find", "clean", "query", "view", "h", "show", "main"} <= {r.node for r in nodes.collect()}
    assert {r.file_path: r.framework for r in trace.detect_frameworks(spark, files).collect()} == {"web/s.js": "express", "py/v.py": "flask", "go/m.go": "net/http", "rb/c.rb": "rails"}
    found = {(r.name, r.type, r.class_name) for r in trace.symbols(files).collect()}
    assert ("find", "method", "Repo") in found and ("Repo", "class", "") in found and ("clean", "function", "") in found


def test_parser_parts():
    assert parse.split_arguments("a, f(b, c), 'x, y', [1, 2]") == ["a", "f(b, c)", "'x, y'", "[1, 2]"] and parse.split_arguments(" ") == []
    assert parse.balanced("f(a, ')', (b))x", 1) == 14
    assert parse.blank_comments("a // b\n'// c' /* d */ e", "go") == "a     \n'// c'         e"
    assert parse.clean_target("const x") == "x" and parse.clean_target("char *p") == "p" and parse.clean_target("let y: string") == "y"
    facts = parse.parse("a.php", "php", "<?php\n$x == 1;\n$o->p = $y;\n$q = [1, 2];")
    assert [(f["target"], f["expression"]) for f in facts if f["kind"] == "assignment"] == [("$o->p", "$y"), ("$q", "[1, 2]")]
    assert parse.parse("e.py", "python", "") == [] and parse.parse("n.py", "python", None) == []


def test_facts_of_a_large_file_leave_as_they_are_made():
    """A task holds the text and its statements, never all facts of a file."""
    code = "<?php\n" + "".join(f"$v{k} = f($w{k}, {k});\n" for k in range(4000))
    tracemalloc.start()
    made = sum(1 for _ in parse.iter_facts("a.php", "php", code))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 12000 and peak < 20 * len(code)
    assert list(parse.iter_facts("a.php", "php", code[:2000])) == parse.parse("a.php", "php", code[:2000])


def test_conditions(spark):
    code = "if ($a == null) {\n  if (strlen($b) > 3) {\n    f();\n  }\n}\ng();"
    lines = spark.createDataFrame([("a.php", k + 1, t) for k, t in enumerate(code.split("\n"))], "file_path string, line int, text string")
    ranges = conditions.guarded_ranges(lines)
    assert sorted((r.line, r.guard_start, r.guard_end, r.type, r.nesting, r.parent) for r in ranges.collect()) == [(1, 1, 4, "null_check", 0, None), (2, 2, 3, "length_check", 1, 1)]
    at = spark.createDataFrame([("a.php", 3), ("a.php", 5), ("a.php", 6)], "file_path string, at int")
    assert Counter(r["at"] for r in conditions.guards_of(at, ranges).collect()) == {3: 2}
    # Across a block's edge.
    far = "\n" * 97 + "if ($a > 1) {\n" + "x();\n" * 60 + "}\n"
    lines = spark.createDataFrame([("b.php", k + 1, t) for k, t in enumerate(far.split("\n"))], "file_path string, line int, text string")
    ranges = conditions.guarded_ranges(lines)
    assert [(r.line, r.guard_start, r.guard_end) for r in ranges.collect()] == [(98, 98, 158)]
    at = spark.createDataFrame([("b.php", 150), ("b.php", 160)], "file_path string, at int")
    assert [r["at"] for r in conditions.guards_of(at, ranges).collect()] == [150]
    names = value(spark, conditions.variables_in(F.lit("$a && count($bb) and $bb"), ["and", "count"]))
    assert names == ["$a", "$bb"]
    paths = spark.createDataFrame([(1, "$a", "null_check", True), (1, "$a", "null_check", False), (2, "$a", "null_check", True)], "path_id int, variable string, type string, is_negated boolean")
    assert [tuple(r) for r in conditions.infeasible(paths).collect()] == [(1, "$a")]


def plain_conditions(lines):
    """(line, guarded lines, nesting, parent) by a stack, line by line."""
    out, stack = [], []
    for k, text in enumerate(lines):
        opens, closes = text.count("{"), text.count("}")
        if text.startswith("if ("):
            held, balance, started = [], 0, False
            for j in range(k, min(len(lines), k + 100)):
                started = started or "{" in lines[j]
                balance += lines[j].count("{") - lines[j].count("}")
                if started and balance > 0:
                    held.append(j + 1)
                if started and balance <= 0:
                    break
            out.append((k + 1, held[0] if held else None, held[-1] if held else None, len(stack), stack[-1] if stack else None))
            if opens:
                stack.append(k + 1)
        for _ in range(max(0, closes - opens)):
            if stack:
                stack.pop()
    return sorted(out)


def test_conditions_against_a_stack(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for f in range(12):
        lines = [rng.choice(["if ($a == 1) {", "if ($a) {", "}", "}", "x();", "if ($b) x();", "}}", "function f() {", "if ($c) { y(); }"]) for _ in range(rng.choice([5, 40, 250]))]
        rows += [(f"{f}", k + 1, t) for k, t in enumerate(lines)]
        want[f"{f}"] = plain_conditions(lines)
    got = {}
    for r in conditions.guarded_ranges(spark.createDataFrame(rows, "file_path string, line int, text string")).collect():
        got.setdefault(r.file_path, []).append((r.line, r.guard_start, r.guard_end, r.nesting, r.parent))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_condition_classes(spark):
    cases = [("!$x", "comparison", True), ("$a and $b", "logical", False), ("isset($x)", "null_check", False), ("x instanceof Y", "type_check", False), ("count ($x)", "length_check", False), ("$x", "unknown", False)]
    for expression, kind, negated in cases:
        line = f"if ({expression}) {{"
        assert value(spark, conditions.condition_of(F.lit(line))) == expression
        assert value(spark, conditions.condition_class(F.lit(expression))) == kind and value(spark, conditions.is_negated(F.lit(line), F.lit(expression))) == negated
    assert value(spark, conditions.condition_of(F.lit("notify($x)"))) is None and value(spark, conditions.condition_of(F.lit("  elif a > b:"))) == "a > b"
    assert value(spark, conditions.condition_of(F.lit("} else if ($x) {"))) == "$x" and value(spark, conditions.condition_of(F.lit("case 3:"))) == "3"


def test_snippets(spark):
    code = "// $_GET['no']\n+$x = $_GET['id'] . $db->fetch('q');\n$y = Util::load($x) . $req->params['k'];"
    df = spark.createDataFrame([("s", code)], "snippet_id string, code string")
    found = {r.expression: (r.kind, r.key, r.source_type, r.line) for r in snippets.expressions(df).collect()}
    assert found["$_GET['id']"] == ("superglobal", "id", "http_get", 2) and found["$db->fetch('q')"][0] == "method_call"
    assert found["Util::load($x)"][0] == "static_call" and found["$req->params['k']"][:2] == ("property_access", "k")
    carriers = spark.createDataFrame([(r"\$req->params", ["http_get", "http_post"])], "pattern string, source_types array<string>")
    classified = snippets.classify(df, carriers)
    assert {r.expression: list(r.source_types) for r in classified.collect()}["$req->params['k']"] == ["http_get", "http_post"]
    total = snippets.totals(classified).first()
    assert (total.n_expressions, total.n_input, total.n_needs_tracing, total.source_types) == (4, 2, 2, ["http_get", "http_post"])


def test_json_inputs(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"finding": "x", "snippets": ["a", "b"]}]))
    (tmp_path / "p.json").write_text(json.dumps(["c", "d"]))
    (tmp_path / "b.json").write_text(json.dumps({"codebase_path": "/c", "snippets": [{"id": "1", "filename": "f", "context": ["l1", "l2"]}]}))
    assert sorted(tuple(r) for r in scans.findings(spark, f"{tmp_path}/f.json").collect()) == [("x", "x_0", "a"), ("x", "x_1", "b")]
    assert [r.finding for r in scans.findings(spark, f"{tmp_path}/p.json").collect()] == ["snippet_1", "snippet_2"]
    assert tuple(scans.snippet_batch(spark, f"{tmp_path}/b.json").first()) == ("/c", "1", "f", "l1\nl2")


def test_aggregates(spark):
    a = spark.createDataFrame([("f", 3, "x"), ("f", 1, "y"), ("", 2, "x"), (None, 2, "z")], "k string, d int, v string")
    assert {r.k: (r.d, r.v) for r in aggregate.least_by(a, ["k"], ["d"], "v").where("k = 'f'").collect()} == {"f": (1, "y")}
    assert {r.k: (r.types, r.n_types) for r in aggregate.distinct_types(a, "k", "v").collect()} == {"f": ("x,y", 2), "(global)": ("x,z", 2)}
    both = aggregate.tagged_counts("k", left=a.where("k = 'f'"), right=spark.createDataFrame([("g",)], "k string"))
    assert {tuple(r) for r in both.collect()} == {("f", 2, 0), ("g", 0, 1)}


def test_forward_order(spark):
    sources = spark.createDataFrame([("f", "$a", "s")], "file_path string, variable string, source_id string")
    # $c takes $b before $b is tainted; the source itself taints any line.
    rows = [("f", 0, "$c", "$b"), ("f", 1, "$b", "$a"), ("f", 2, "$d", "$b"), ("f", 3, "$a2", "$ab")]
    assigned = spark.createDataFrame(rows, "file_path string, seq long, target string, source_expr string")
    assert {r.variable: r.depth for r in taint.forward(sources, assigned).collect()} == {"$a": 0, "$b": 1, "$d": 2}


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "bad ### text"), (2, "2024-01-01 00:02:00", "good"), (3, "2024-01-01 00:12:00", "### x")]
    spark.createDataFrame(rows, "id int, ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, ts timestamp, text string").parquet(f"{tmp_path}/in")
    counts = rule_counts(stream, "id", "text", [("symbols", "###")], "ts")
    q = counts.writeStream.format("memory").queryName("rules").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("rules").collect()) == [1, 1]


def test_rules_in_blocks(spark, monkeypatch):
    from tributary.operators import detect

    monkeypatch.setattr(detect, "MAX_RULES", 7)
    assert len(detect.blocks(source_rules(spark))) > 5
    nodes = spark.createDataFrame([("a.php", 1, "php", "statement", "$x = $_GET['id']", "$x")], "file_path string, line int, language string, node_type string, text string, variable string")
    assert [(r.source_type, r.key) for r in detect.match_rules(nodes, source_rules(spark)).collect()] == [("http_get", "id")]
