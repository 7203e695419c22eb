"""Imports, members, class lookup, path expansion and reports."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.operators import aggregate, detect, graph, members, render, symbolic
from tributary.plans import code_queries
from tributary.plans.base import ORACLES
from tributary.rules import catalogue
from tributary.rules.catalogue import RULES
from tributary.rules.keywords import required_words
from tributary.sources import files as scans


def test_imports(spark):
    files = spark.createDataFrame([("a/b.php",), ("a/lib/c.php",), ("w/util/index.js",), ("w/x.ts",), ("top.ts",)], "file_path string")
    rows = [
        ("a/b.php", "php", 1, "require_once __DIR__ . '/lib/c.php';"), ("a/lib/c.php", "php", 2, "include '../b.php';"), ("a/b.php", "php", 3, "include $x . 'c.php';"), ("a/b.php", "php", 4, "use Foo\\Bar;"),
        ("w/s.js", "javascript", 1, "import u from './util';"), ("w/s.js", "javascript", 2, "import x from './x'"), ("w/s.js", "javascript", 3, "import e from 'express'"),
        ("w/1/2/3/4/5/6/d.ts", "typescript", 1, "import t from '../../../../../../../top'"), ("w/s.js", "javascript", 4, "import t from '../../../top'"),
    ]
    imports = spark.createDataFrame(rows, "file_path string, language string, line int, text string")
    assert {(r.file_path, r.line, r.resolved) for r in members.resolve_imports(imports, files).collect()} == {("a/b.php", 1, "a/lib/c.php"), ("a/lib/c.php", 2, "a/b.php"), ("w/s.js", 1, "w/util/index.js"), ("w/s.js", 2, "w/x.ts"), ("w/1/2/3/4/5/6/d.ts", 1, "top.ts")}


def test_body_flow(spark):
    df = spark.createDataFrame([("a", "f", ["$x", "$y", "$z"], "{ $this->m = $y; return $x . $_GET['k']; }"), ("a", "g", ["$x"], "{ return 1; }")], "file_path string, name string, params array<string>, body string")
    assert {r.name: (r.params_to_return, r.params_to_members, r.returns_input) for r in members.body_flow(df).collect()} == {"f": (["$x"], ["$y"], True), "g": ([], [], False)}


def test_classes(spark):
    classes = spark.createDataFrame([("User", ["Entity"]), ("request", []), ("Repo", [])], "class_name string, implements array<string>")
    names = spark.createDataFrame([("User",), ("repo",), ("request_interface",), ("Entity",), ("None",)], "wanted string")
    assert {(r.wanted, r.class_name, r.level) for r in members.find_classes(names, classes).collect()} == {("User", "User", 0), ("repo", "Repo", 1), ("request_interface", "request", 2), ("Entity", "User", 3)}


def test_rule_generation(spark):
    text = "class R { public ?string $query; public function cookie($k) {} public static function getHeader() {} public function __get($n) {} public function setUser() {} private function x() {} }"
    found = members.public_members(spark.createDataFrame([("r.php", text)], "file_path string, content string"))
    assert {(r.kind, r.name) for r in found.collect()} == {("method", "cookie"), ("method", "getHeader"), ("method", "setUser"), ("property", "query")}
    rules = {r.id: (r.pattern, r.source_type) for r in members.made_rules(found, "fw").collect()}
    assert rules == {"fw_cookie_m": (r"->cookie\s*\(", "http_cookie"), "fw_getheader_m": (r"->getHeader\s*\(", "http_header"), "fw_query_p": (r"->query\b", "http_get")}


def test_markers(spark):
    paths = spark.createDataFrame([("go.mod",), ("x/artisan",)], "file_path string")
    first = lambda p, m: members.marker_framework(p, m).first().framework
    assert first(paths, [("laravel", "artisan"), ("gin", "go.mod")]) == "laravel" and first(paths, [("rails", "Gemfile")]) == "unknown"
    assert first(paths.limit(0), [("rails", "Gemfile")]) == "unknown"


def test_expanded_paths(spark):
    calls = spark.createDataFrame([("a", "b", 1), ("b", "t", 2), ("b", "a", 3), ("a", "c", 4), ("c", "d", 5), ("d", "t", 6)], "caller string, callee string, line int")
    node = lambda n: spark.createDataFrame([(n,)], "node string")
    found = {("".join(r.path), tuple(r.lines), r.pruned) for r in graph.expanded_paths(calls, node("a"), node("t")).collect()}
    assert found == {("abt", (1, 2), ""), ("acdt", (4, 5, 6), ""), ("aba", (1, 3), "cycle_detected")}
    assert ("acd", (4, 5), "max_depth_exceeded") in {("".join(r.path), tuple(r.lines), r.pruned) for r in graph.expanded_paths(calls, node("a"), node("t"), 2).collect()}


def test_reports(spark):
    nodes = spark.createDataFrame([("n:1", "source", "a</script>", "a/b.php", 1)], "node_id string, type string, name string, file_path string, line int")
    edges = spark.createDataFrame([("n:1", "n:1", "call")], "src string, dst string, type string")
    page = render.page("t", nodes, edges)
    assert page.count("</script>") == 1 and "n_1 -.-&gt;|call|" in page
    assert render.summary_lines(aggregate.run_statistics(files=nodes)) == "Summary\n  files: 1"
    listed = spark.createDataFrame([("b",), ("a",)], "file_path string")
    assert [r.file_path for r in scans.first_files(listed, 1).collect()] == ["a"] and scans.first_files(listed, 0).count() == 2


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.split() == ["True", "True"]


def test_fixed_tables(spark):
    """Tables of fixed values: categories of input methods, annotations by framework, directories to skip."""
    assert {r.category: r["count"] for r in catalogue.input_methods(spark).groupBy("category").count().collect()} == {"command": 4, "file": 3, "http": 14}
    found = {r.framework: r["count"] for r in catalogue.annotations(spark).groupBy("framework").count().collect()}
    assert found == {"spring": 8, "jax-rs": 7, "micronaut": 4, "vertx": 1, "struts2": 1, "play": 1, "dropwizard": 1}
    assert catalogue.skip_dirs(["go", "rust"]) == [".git", ".hg", ".idea", ".svn", ".vs", ".vscode", "target", "vendor"]


def test_required_words():
    cases = {
        r"\$_GET\b": {"_GET"}, r"\bgetenv\s*\(|\$_ENV\b": {"getenv", "_ENV"}, r"(?:\$|->)\w*request->all\s*(?:<[^<>()]*>\s*)?\(": {"all"}, r"\bfilter_input(?:_array)?\s*\(": {"filter_input", "filter_input_array"},
        r"(?<![\w>:.$])fopen\s*\(": {"fopen"}, r"\w+name\(": None, "php://input": None, r"(?i)\bx\b": None, r"\bab+\b": None, r"[": None, r"\b(?:one|two_three)\.x\b": {"one", "two_three"},
    }
    for pattern, words in cases.items():
        assert required_words(pattern) == words, pattern


@given(st.lists(st.sampled_from(["req", "query", ".", "$", "_GET", "[", "(", " ", "fopen", "x", "->", "request", "all", "<", ">", "'k'", ")"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_a_match_holds_a_required_word(parts):
    text = "".join(parts)
    words = set(re.split(r"[^A-Za-z0-9_]+", text))
    for _, _, pattern, *_ in RULES:
        need = required_words(pattern)
        assert need is None or need & words or not re.search(pattern, text)


def test_dispatch_is_a_nested_loop(spark):
    """Rules found by words, and the same rows where the table is too large for that."""
    texts = ["$x = $_GET['a'] . getenv('b');", "fopen($f); my_fopen($f);", "$request->all() ? $other->request->all() : 1", "php://input", "", "nothing"]
    nodes = spark.createDataFrame([(f"f{k}", 1, "php", "statement", t, "$v", k) for k, t in enumerate(texts)], "file_path string, line int, language string, node_type string, text string, variable string, seq int")
    rules = catalogue.source_rules(spark)
    got = {(r.seq, r.pattern) for r in detect.dispatched(nodes, rules.select("language", "pattern").distinct()).collect()}
    want = {(k, r.pattern) for r in rules.where("language = 'php'").collect() for k, t in enumerate(texts) if re.search(r.pattern, t)}
    assert got == want and len(got) > 4


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_calls_of_one_method_stay_apart(spark, broadcast):
    """All calls are of one object's method: no task gets more than half of them, broadcast or not."""
    wanted = spark.createDataFrame([("$v", "p", "C", "m.php", 10)], "variable string, property string, class_name string, class_file string, line long")
    functions = spark.createDataFrame([("C", "m", "{ $this->p = 1; }"), ("C", "n", "{ $this->q = 1; }")], "class_name string, name string, body string")
    calls = spark.range(0, 4000, 1, 4).select(F.lit("m.php").alias("file_path"), F.col("id").alias("line"), F.lit("$v").alias("receiver"), F.lit("$v->m").alias("function_name"), F.array(F.lit("1")).alias("args"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = symbolic.external_calls(wanted, calls, functions)
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 3989 and max(tasks) < 2000
        assert found.agg(F.min("line"), F.max("line")).first()[:] == (11, 3999)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_imports_are_dealt_and_folded_once(spark):
    """Imports of one partition are worked on by several tasks; every ending gives what folding its whole path gives."""
    texts = ["./b", "../b", "./b/", "../..", "./.", "./x/..", "./a//b", "../../../b"]
    imports = spark.createDataFrame([("p/q/a.js", "javascript", k, f"import x from '{x}'") for k, x in enumerate(texts)], "file_path string, language string, line int, text string").coalesce(1)

    def fold(path):
        out = []
        for x in path.split("/"):
            if x == ".." and out and out[-1] != "..":
                out.pop()
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out)

    for ending in members.JS_ENDINGS:
        paths = {k: fold(f"p/q/{x}{ending}") for k, x in enumerate(texts)}
        files = spark.createDataFrame([(p,) for p in set(paths.values())], "file_path string")
        got = {r.line: r.resolved for r in members.resolve_imports(imports, files).collect()}
        assert set(got) == set(paths) and (ending or got == paths)
        assert all(got[k] == p or fold(f"p/q/{texts[k]}") in set(paths.values()) or any(got[k] == fold(f"p/q/{texts[k]}{e}") for e in members.JS_ENDINGS) for k, p in paths.items())
    many = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("p/f"), "id", F.lit(".js")).alias("file_path"), F.lit("javascript").alias("language"), F.lit(1).alias("line"), F.lit("import x from './b'").alias("text"))
    plan = members.resolve_imports(many, files)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def _small_tables(spark, folder) -> str:
    """4,000 lines of 1,000 orders, each line twice; supplier 2 in two nations, so that its function is in two files."""
    lines = spark.range(4000).select(F.expr("id div 4").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 11).alias("l_partkey"))
    tables = {
        "lineitem": lines.unionByName(lines),
        "orders": spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 10).alias("o_custkey"), F.lit("O").alias("o_orderstatus")),
        "customer": spark.range(10).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal")),
        "supplier": spark.createDataFrame([*((k, k % 3) for k in range(7)), (2, 1)], "s_suppkey long, s_nationkey int"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_more_lines_make_more_tasks(spark, tmp_path, monkeypatch):
    """The rows of a task don't grow with the table; an order's lines stay in one task."""
    folder = _small_tables(spark, tmp_path)
    monkeypatch.setattr(code_queries, "LINE_ROWS", 400, raising=False)
    rows = code_queries._one_line(spark, folder).withColumn("task", F.spark_partition_id())
    tasks = {r.task: r["count"] for r in rows.groupBy("task").count().collect()}
    assert sum(tasks.values()) == 4000 and len(tasks) >= 16 and max(tasks.values()) < 500
    assert rows.groupBy("l_orderkey").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()


def test_values_of_parameters_are_counted_once(spark, tmp_path):
    """Lines that repeat, and a function in two files: the SQL's rows, with one shuffle of the values."""
    folder = _small_tables(spark, tmp_path)
    found = code_queries.parameter_call_values(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["parameter_call_values"]).fetchall()
    assert sorted((r.name, r.param, r.n_values) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(name#\d+, param#\d+, value#", plan)
