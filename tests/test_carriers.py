"""Registry, scopes, carriers and symbolic traces."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import carriers, registry, scopes, snippets, symbolic
from tributary.rules import catalogue
from tributary.sources import parse

CODE = """<?php
class Input {
    public $vars;
    public function __construct() {
        foreach ($_GET as $key => $val) {
            $this->vars[$key] = $val;
        }
        $this->token = $_COOKIE['t'];
        $this->n = 1;
    }
    public function all() {
        return $this->vars;
    }
    public function count() {
        return $this->n;
    }
}
function page() {
    $in = new Input();
    $x = $in->all();
    $y = $x;
    show(array('q' => $_POST['q']));
    return $_SERVER['HTTP_HOST'];
}
"""


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("a.php", "php", CODE)], "file_path string, language string, content string")
    return parse.facts(files).cache()


def test_usages_and_carriers(spark, facts):
    statements = facts.where("kind = 'statement'").select("file_path", "line", "text", "scope", "class_name")
    found = {(r.superglobal, r.context, r.key) for r in carriers.usages(statements).collect()}
    assert found == {("$_GET", "foreach", ""), ("$_COOKIE", "assignment", "t"), ("$_POST", "array_element", "q"), ("$_SERVER", "return", "HTTP_HOST")}
    flows = carriers.property_flows(statements)
    assert {(r.property, r.source_type, r.flow) for r in flows.collect()} == {("vars", "http_get", "foreach_population"), ("token", "http_cookie", "direct_assignment")}
    held = carriers.property_carriers(flows)
    assert {(r.class_name, r.property, tuple(r.source_types), r.populated_in) for r in held.collect()} == {("Input", "vars", ("http_get",), "__construct"), ("Input", "token", ("http_cookie",), "__construct")}
    methods = carriers.method_carriers(held, parse.functions(facts))
    assert [(r.method, r.property) for r in methods.collect()] == [("all", "vars")]
    patterns = carriers.access_patterns(held, methods)
    code = spark.createDataFrame([("s", "$z = $in->all() . $in->vars . $in->count();")], "snippet_id string, code string")
    types = {r.expression: list(r.source_types) for r in snippets.classify(code, patterns).collect()}
    assert types == {"$in->all()": ["http_get"], "$in->vars": ["http_get"], "$in->count()": []}
    assert {r.source_type: (r.n, r.n_classes) for r in carriers.statistics(held).collect()} == {"http_get": (1, 1), "http_cookie": (1, 1)}


def test_symbolic_steps(spark, facts):
    wanted = spark.createDataFrame([("1", "$y"), ("2", "$in->count()"), ("3", "$_POST['a']")], "expression_id string, expression string")
    kinds = {r.expression_id: (r.kind, r.object, r.member) for r in symbolic.parts(wanted).collect()}
    assert kinds == {"1": ("local_variable", "", ""), "2": ("method_call", "$in", "count"), "3": ("superglobal", "", "")}
    steps = symbolic.steps_back(wanted, parse.assignments(facts), parse.functions(facts))
    trail = {(r.expression_id, r.code) for r in steps.collect()}
    assert {("1", "$x"), ("1", "$in->all()"), ("1", "$this->vars"), ("1", "$val"), ("2", "$this->n"), ("2", "1")} <= trail
    assert {(r.expression_id, r.source_type) for r in symbolic.ultimate_sources(steps).collect()} == {("3", "http_post")}
    assert symbolic.report(steps).where("text like '%[method_call] $in->all()%'").count() == 1


def test_registry(spark):
    df = spark.createDataFrame([("$request->get('id')",), ("$_GET['x']",), ("$request->isValid()",), ("$db->run()",)], "expression string")
    patterns = spark.createDataFrame([(0, 1, "$_GET['x']", "http_get"), (1, 2, r"->get\(", "framework_get"), (3, 3, r"\$request", "http_request"), (3, 4, r"\$_GET", "general")], "level int, seq int, pattern string, source_type string")
    excluded = spark.createDataFrame([(r"->isValid\(",)], "not_input string")
    found = {r.expression: (r.source_type, r.key, r.level) for r in registry.match_registry(df, patterns, excluded).collect()}
    assert found == {"$request->get('id')": ("framework_get", "id", 1), "$_GET['x']": ("http_get", "x", 0)}
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(registry.type_of_name(F.lit("get_cookie"))) == "http_cookie" and one(registry.type_of_name(F.lit("getQuery"))) == "http_get" and one(registry.type_of_name(F.lit("zzz"))) == "user_input"
    assert one(registry.server_key_kind(F.lit("HTTP_HOST"))) == "user" and one(registry.server_key_type(F.lit("REMOTE_ADDR"))) == "network" and one(registry.server_key_kind(F.lit("DOCUMENT_ROOT"))) == "config"
    assert one(registry.carries_input(F.lit("request"), F.lit("query"))) and not one(registry.carries_input(F.lit("request"), F.lit("isGet"))) and not one(registry.carries_input(F.lit("db"), F.lit("query")))
    assert one(registry.matches_carrier(F.lit("db"), F.lit("query"), F.lit(False))) and not one(registry.matches_carrier(F.lit("db"), F.lit("fetch"), F.lit(True))) and one(registry.matches_carrier(F.lit("req"), F.lit("x"), F.lit(True)))
    assert one(registry.function_kinds(F.lit("file_get_contents"))) == ["input", "network"] and one(registry.function_kinds(F.lit("fetchAll"))) == ["db_fetch"] and one(registry.is_result_object(F.lit("myStmt")))
    assert one(registry.is_source_type(F.lit("http_get"))) and not one(registry.is_source_type(F.lit("unknown")))
    assert tuple(one(registry.identify_source(F.lit("getenv('X')")))) == ("env_var", 0.9) and tuple(one(registry.identify_source(F.lit("json_decode($x)")))) == ("user_input", 0.85)
    assert tuple(one(registry.identify_source(F.lit("$_POST['a']")))) == ("http_post", 1.0) and tuple(one(registry.identify_source(F.lit("curl_exec($c)")))) == ("network", 0.8)
    assert one(registry.identify_source(F.lit("$request->query"))).source_type == "http_get" and one(registry.identify_source(F.lit("$a + 1"))) is None
    mapping = "language string, kind string, name string, source_type string"
    a, b = spark.createDataFrame([("php", "function", "f", "file"), ("php", "function", "g", "file")], mapping), spark.createDataFrame([("php", "function", "f", "network")], mapping)
    assert {r.name: r.source_type for r in registry.merged(a, b).collect()} == {"f": "network", "g": "file"}


def test_members_and_methods(spark):
    patterns = spark.createDataFrame([(0, 1, "app.token", "http_header")], "level int, seq int, pattern string, source_type string")
    none = spark.createDataFrame([("^request\\.secret$",)], "not_input string")
    rows = [("app", "token", False), ("request", "getCookies", True), ("db", "getCookies", True), ("", "getPost", True), ("request", "fetch", True), ("ctx", "body", False), ("db", "body", False), ("request", "secret", False)]
    got = registry.match_members(spark.createDataFrame(rows, "object string, member string, is_method boolean"), patterns, none)
    assert {(r.object, r.member): r.source_type for r in got.collect()} == {("app", "token"): "http_header", ("request", "getCookies"): "user_input", ("", "getPost"): "user_input", ("ctx", "body"): "user_input"}
    calls = spark.createDataFrame([("request", "all"), ("x", "get"), ("x", "read"), ("x", "exec"), ("x", "run")], "receiver string, method string")
    got = {(r.receiver, r.method): (r.category, r.is_input, r.is_interesting) for r in registry.input_methods_of(calls, catalogue.input_methods(spark)).collect()}
    assert got == {("request", "all"): ("http", True, False), ("x", "get"): ("http", True, False), ("x", "read"): ("file", False, True), ("x", "exec"): ("command", False, True), ("x", "run"): (None, False, False)}
    framework = spark.createDataFrame([("^input$", "", ""), ("^input$", "^query$", "query"), ("", "", "vars")], "method_pattern string, property_pattern string, carrier_property string")
    assert {tuple(r) for r in registry.substring_patterns(framework).collect()} == {("method", "->input("), ("property", "->query["), ("property", "->vars[")}
    assert catalogue.annotations(spark).where("framework = 'spring' and source_type = 'http_get'").count() == 2 and catalogue.annotations(spark).count() == 23
    assert catalogue.node_types(spark).where("role = 'function' and node_type = 'lambda'").count() == 1


def test_scopes(spark, facts):
    tree = spark.createDataFrame([("file", None), ("f", "file"), ("block", "f"), ("g", "file")], "scope string, parent string")
    assert {(r.scope, r.ancestor, r.distance) for r in scopes.closure(tree).where("scope = 'block'").collect()} == {("block", "block", 0), ("block", "f", 1), ("block", "file", 2)}
    made = spark.createDataFrame([("file", "x", 1, "d1"), ("f", "x", 3, "d2"), ("f", "x", 4, "d3"), ("g", "y", 2, "d4")], "scope string, name string, seq int, id string")
    used = spark.createDataFrame([("block", "x", 9), ("g", "x", 9), ("block", "y", 9), ("f", "x", 2)], "scope string, name string, seq int")
    assert {(r.scope, r.name, r.seq): r.definition for r in scopes.resolve(used, made, tree).collect()} == {("block", "x", 9): "d3", ("g", "x", 9): "d1", ("block", "y", 9): None, ("f", "x", 2): "d1"}
    assert {(r.id, r.shadows) for r in scopes.shadowed(made, tree).collect()} == {("d2", "d1"), ("d3", "d2")}
    assigned = parse.assignments(facts)
    assert scopes.first_definitions(assigned).count() == assigned.select("class_name", "scope", "target").distinct().count()
    calls = spark.createDataFrame([("x->f", ["1", "$a"])], "function_name string, args array<string>")
    functions = spark.createDataFrame([("a", "f", ["$p", "$q", "$r"])], "file_path string, name string, params array<string>")
    assert {(r.param, r.value) for r in scopes.parameter_values(functions, calls).collect()} == {("$p", "1"), ("$q", "$a")}
    defs = spark.createDataFrame([("a", "$t", "$in . 1"), ("a", "$t", "2")], "file_path string, target string, source_expr string")
    sources = spark.createDataFrame([("a", "$in", "http_get")], "file_path string, variable string, source_type string")
    row = scopes.variable_report(defs, sources).first()
    assert (row.n_definitions, row.n_input, row.types) == (2, 1, ["http_get"])
    assert [r.step for r in scopes.numbered(made, "scope", "seq").where("scope = 'f'").orderBy("seq").collect()] == [1, 2]
