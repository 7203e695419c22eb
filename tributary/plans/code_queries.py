"""Queries that run the code-analysis operators on relations made of the driver's tables, each with the SQL for the same rows.

Roles: a nation is a file, a customer with a negative balance a source whose variable is $c<key>, an order an assignment of
$o<key>, a line a call, a supplier a function f<key>; a user's events are the lines of a file, a part a symbol.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as T
from tributary.operators import aggregate, carriers, conditions, detect, graph, members, registry, render, scopes, search, snippets, symbolic, taint
from tributary.operators.fixpoint import shared_folder
from tributary.plans import trace
from tributary.plans.base import query, table
from tributary.rules import catalogue
from tributary.sources import files as scans
from tributary.sources import parse


def _text(*parts):
    """Literals and columns (names begin with a colon) as one string."""
    return F.concat(*(F.col(p[1:]).cast("string") if isinstance(p, str) and p[:1] == ":" and p[1:].isidentifier() else F.lit(p) if isinstance(p, str) else p for p in parts))


# --- propagation -----------------------------------------------------------------------------------------------------

_BAD = "bad AS (SELECT c_custkey, 'n' || c_nationkey || '.php' AS f FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey, o_custkey, f FROM orders JOIN bad ON o_custkey = c_custkey)"


def _file():
    return _text("n", ":c_nationkey", ".php").alias("file_path")


def _sources(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal < 0").select(_file(), _text("$c", ":c_custkey").alias("variable"), _text("src:", ":c_custkey").alias("source_id"))


def _orders(spark, d) -> DataFrame:
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer, "o_custkey")


def _assignments(spark, d, lines: bool = False) -> DataFrame:
    """$o<key> = trim($c<key>), and with lines $l<key>_<n> = $o<key> + 1 after all of them."""
    orders = _orders(spark, d)
    out = orders.select(_file(), F.lit("php").alias("language"), F.col("o_orderkey").cast("long").alias("seq"), _text("$o", ":o_orderkey").alias("target"), _text("trim($c", ":o_custkey", ")").alias("source_expr"), F.col("o_orderstatus").alias("scope"), F.lit("").alias("class_name"))
    if not lines:
        return out
    more = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.lit(1 << 40) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return out.unionByName(more.select(_file(), F.lit("php").alias("language"), seq.alias("seq"), _text("$l", ":l_orderkey", "_", ":l_linenumber").alias("target"), _text("$o", ":l_orderkey", " + 1").alias("source_expr"), F.col("o_orderstatus").alias("scope"), F.lit("").alias("class_name")))


@query(
    "tainted_variables",
    f"""WITH {_BAD}, l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    SELECT f AS file_path, '$c' || c_custkey AS variable, 'src:' || c_custkey AS source_id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, '$c' || c_custkey AS path FROM bad
    UNION ALL SELECT f, '$o' || o_orderkey, 'src:' || o_custkey, 1, '$c' || o_custkey, '$c' || o_custkey || '>$o' || o_orderkey FROM o
    UNION ALL SELECT f, '$l' || l_orderkey || '_' || l_linenumber, 'src:' || o_custkey, 2, '$o' || o_orderkey, '$c' || o_custkey || '>$o' || o_orderkey || '>$l' || l_orderkey || '_' || l_linenumber FROM l JOIN o ON l_orderkey = o_orderkey""",
)
def tainted_variables(spark, d):
    found = taint.forward(_sources(spark, d), _assignments(spark, d, lines=True), 5)
    return found.select("file_path", "variable", "source_id", "depth", "parent", F.array_join("path", ">").alias("path"))


@query(
    "direct_assignments",
    f"WITH {_BAD} SELECT 'src:' || o_custkey AS source_id, f AS file_path, CAST(o_orderkey AS BIGINT) AS seq, '$o' || o_orderkey AS target FROM o WHERE o_orderkey % 2 = 0",
)
def direct_assignments(spark, d):
    sources = _sources(spark, d).select("file_path", "source_id", _text(":variable", ")").alias("name"))
    return taint.direct(sources, _assignments(spark, d).withColumn("is_tainted", F.col("seq") % 2 == 0))


#: Lines of a task: more of them make more tasks, not larger ones.
LINE_ROWS = 250_000


def _one_line(spark, d) -> DataFrame:
    """One row per order and line number, the least supplier and part. An order's lines are in one task, as its joins need them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    n = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINE_ROWS))
    return lines.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))


def _calls(spark, d) -> DataFrame:
    """Each line calls its supplier's function, in the customer's file."""
    lines = _one_line(spark, d)
    lines = lines.join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.lit(1 << 40) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    args = F.array(_text("$p", ":l_partkey"), _text("f($o", ":l_orderkey", ")"))
    return lines.select(_file(), F.lit("php").alias("language"), seq.alias("seq"), _text("f", ":l_suppkey").alias("function_name"), args.alias("args"), F.lit("").alias("class_name"), _text("g", F.pmod("l_orderkey", F.lit(50)).cast("string")).alias("scope"), _text("$r", ":l_orderkey", "_", ":l_linenumber").alias("target"))


_LINES = "l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"


def _arguments(spark, d) -> DataFrame:
    return taint.tainted_arguments(_calls(spark, d), taint.forward(_sources(spark, d), _assignments(spark, d), 3), ordered=True)


@query(
    "tainted_call_arguments",
    f"WITH {_BAD}, {_LINES} SELECT f AS file_path, CAST(1099511627776 + l_orderkey * 10 + l_linenumber AS BIGINT) AS call_seq, 'f' || l_suppkey AS function_name, 1 AS arg_index, '$o' || l_orderkey AS variable, 'src:' || o_custkey AS source_id FROM l JOIN o ON l_orderkey = o_orderkey",
)
def tainted_call_arguments(spark, d):
    return _arguments(spark, d).drop("class_name")


@query(
    "tainted_function_parameters",
    f"WITH {_BAD}, {_LINES} SELECT f AS file_path, 'f' || l_suppkey AS function_name, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_params, min('$o' || l_orderkey) AS first FROM l JOIN o ON l_orderkey = o_orderkey GROUP BY ALL",
)
def tainted_function_parameters(spark, d):
    found = taint.tainted_functions(_arguments(spark, d))
    return found.select("file_path", "function_name", F.size("tainted_params").cast("long").alias("n_params"), F.element_at("tainted_params", 1)["name"].alias("first"))


@query(
    "latest_function_parameters",
    f"WITH {_BAD}, {_LINES} SELECT DISTINCT f AS file_path, 'f' || l_suppkey AS function_name, 1 AS arg_index, '$o' || l_orderkey AS variable, 'src:' || o_custkey AS source_id FROM l JOIN o ON l_orderkey = o_orderkey",
)
def latest_function_parameters(spark, d):
    return taint.latest_parameters(_arguments(spark, d))


def _functions(spark, d) -> DataFrame:
    """Supplier k's function f<k> in lib<nation>.php, of class S<nation> for k % 3 = 0; for k % 5 = 0 a plain one in zz.php too."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    body = F.when(F.col("s_suppkey") % 4 == 0, "{ return $b . 'x'; }").when(F.col("s_suppkey") % 4 == 1, "{ if ($a) { return $a; } return $b; }").otherwise("{ return strlen('$bb'); }")
    common = [F.lit("php").alias("language"), _text("f", ":s_suppkey").alias("name"), F.col("s_suppkey").cast("int").alias("line"), F.array(F.lit("$a"), F.lit("$b")).alias("params"), body.alias("body")]
    lib = supplier.select(_text("lib", ":s_nationkey", ".php").alias("file_path"), F.when(F.col("s_suppkey") % 3 == 0, _text("S", ":s_nationkey")).otherwise("").alias("class_name"), *common)
    return lib.unionByName(supplier.where("s_suppkey % 5 = 0").select(F.lit("zz.php").alias("file_path"), F.lit("").alias("class_name"), *common))


@query(
    "function_summaries",
    """WITH s AS (SELECT s_suppkey AS k, 'lib' || s_nationkey || '.php' AS f, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_nationkey ELSE '' END AS c FROM supplier UNION ALL SELECT s_suppkey, 'zz.php', '' FROM supplier WHERE s_suppkey % 5 = 0)
    SELECT f AS callee_file, c AS callee_class, 'f' || k AS callee, CASE k % 4 WHEN 0 THEN '1' ELSE '0,1' END AS positions FROM s WHERE k % 4 < 2""",
)
def function_summaries(spark, d):
    return taint.summaries(_functions(spark, d)).select("callee_file", "callee_class", "callee", F.array_join(F.transform("params_to_return", lambda x: x.cast("string")), ",").alias("positions"))


@query(
    "resolved_calls",
    """WITH k AS (SELECT s_suppkey AS k, 'lib' || s_nationkey || '.php' AS lib, 'S' || s_nationkey AS cls, s_suppkey % 3 = 0 AS owned, s_suppkey % 5 = 0 AS twice FROM supplier),
    c AS (SELECT k, lib, cls, owned, twice, unnest([0, 1, 2, 3]) AS kind FROM k), f AS (SELECT *, unnest(['main.php', lib]) AS caller FROM c)
    SELECT caller AS file_path, CASE kind WHEN 0 THEN 'f' || k WHEN 1 THEN '$x->f' || k WHEN 2 THEN cls || '::f' || k ELSE '$this->f' || k END AS function_name,
      CASE WHEN kind = 0 AND owned AND twice THEN 'zz.php' ELSE lib END AS callee_file, CASE WHEN owned AND NOT (kind = 0 AND twice) THEN cls ELSE '' END AS callee_class FROM f""",
)
def resolved_calls(spark, d):
    k = table(spark, d, "supplier").select("s_suppkey", _text("lib", ":s_nationkey", ".php").alias("lib"), _text("S", ":s_nationkey").alias("class_name"))
    names = F.array(_text("f", ":s_suppkey"), _text("$x->f", ":s_suppkey"), _text(":class_name", "::f", ":s_suppkey"), _text("$this->f", ":s_suppkey"))
    calls = k.select("class_name", "lib", F.explode(names).alias("function_name")).select("class_name", "function_name", F.explode(F.array(F.lit("main.php"), F.col("lib"))).alias("file_path"))
    return taint.resolve(calls, _functions(spark, d)).select("file_path", "function_name", "callee_file", "callee_class")


_CALLEE = "CASE WHEN l_suppkey % 3 = 0 AND l_suppkey % 5 = 0 THEN 'zz.php' ELSE 'lib' || s_nationkey || '.php' END"


@query(
    "tainted_callees",
    f"WITH {_BAD}, {_LINES} SELECT {_CALLEE} AS callee_file, 'f' || l_suppkey AS callee, '$b' AS variable, true AS cross_file, count(DISTINCT o_custkey) AS n_sources FROM l JOIN o ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
)
def tainted_callees(spark, d):
    into = taint.into_callees(taint.resolve(_arguments(spark, d), _functions(spark, d)))
    return into.groupBy("callee_file", "callee", "variable", "cross_file").agg(F.count_distinct("source_id").alias("n_sources"))


@query(
    "returned_taint",
    f"WITH {_BAD}, {_LINES} SELECT f AS file_path, '$r' || l_orderkey || '_' || l_linenumber AS variable, 'src:' || o_custkey AS source_id, CAST(1099511627776 + l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM l JOIN o ON l_orderkey = o_orderkey WHERE l_suppkey % 4 < 2",
)
def returned_taint(spark, d):
    functions = _functions(spark, d)
    targets = _calls(spark, d).select("file_path", F.col("seq").alias("call_seq"), "target")
    return taint.interprocedural(taint.resolve(_arguments(spark, d), functions), targets, taint.summaries(functions))


@query(
    "called_function_sets",
    f"WITH {_LINES} SELECT 'n' || c_nationkey || '.php' AS file_path, 'g' || (l_orderkey % 50) AS scope, string_agg(DISTINCT 'f' || l_suppkey, ',' ORDER BY 'f' || l_suppkey) AS called FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
)
def called_function_sets(spark, d):
    return taint.called_functions(_calls(spark, d)).select("file_path", "scope", F.array_join("called", ",").alias("called"))


@query("returning_functions", f"WITH {_BAD} SELECT f AS file_path, 'get' || o_orderkey AS function_name, 'src:' || o_custkey AS source_id FROM o")
def returning_functions(spark, d):
    functions = _orders(spark, d).select(_file(), _text("get", ":o_orderkey").alias("name"), _text("{ $x = 1;\n return $c", ":o_custkey", "; }").alias("body"))
    return taint.returning(functions, _sources(spark, d))


_BACK = """s AS (SELECT '$s' || s_suppkey AS target, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    b AS (SELECT target, 'a.php' AS file_path, target AS variable, '$n' || n AS expression, 1 AS depth FROM s
    UNION ALL SELECT target, CASE WHEN n % 2 = 0 THEN 'a.php' ELSE 'b.php' END, '$n' || n, 'f($r' || r || ')', 2 FROM s
    UNION ALL SELECT target, 'b.php', '$r' || r, CASE WHEN r < 3 THEN '$_GET[''r'']' ELSE '1' END, 3 FROM s)"""


def _backward(spark, d):
    row = lambda f, target, code: (f.alias("file_path"), target.alias("target"), code.alias("source_expr"))
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    copied = supplier.select(*row(F.lit("a.php"), _text("$s", ":s_suppkey"), _text("$n", ":s_nationkey")))
    called = row(F.lit("b.php"), _text("$n", ":n_nationkey"), _text("f($r", ":n_regionkey", ")"))
    near = row(F.lit("a.php"), _text("$n", ":n_nationkey"), _text("f($r", ":n_regionkey", ")"))
    ends = region.select(*row(F.lit("b.php"), _text("$r", ":r_regionkey"), F.when(F.col("r_regionkey") < 3, "$_GET['r']").otherwise("1")))
    assignments = copied.unionByName(nation.select(*called)).unionByName(nation.where("n_nationkey % 2 = 0").select(*near)).unionByName(ends)
    targets = supplier.select(_text("$s", ":s_suppkey").alias("target"))
    return targets, taint.backward(targets, assignments, snippets.SUPERGLOBAL, 5)


@query("backward_steps", f"WITH {_BACK} SELECT *, contains(expression, '$_GET') AS is_source FROM b")
def backward_steps(spark, d):
    return _backward(spark, d)[1]


@query("backward_targets", "SELECT '$s' || s_suppkey AS target, CAST(3 AS BIGINT) AS n_steps, n_regionkey < 3 AS has_input, CASE WHEN n_regionkey < 3 THEN 1 ELSE 0 END AS n_sources FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def backward_targets(spark, d):
    targets, found = _backward(spark, d)
    return taint.backward_report(targets, found, registry.identify_source(F.col("expression"))["source_type"]).drop("sources")


# --- scopes ----------------------------------------------------------------------------------------------------------


def _scopes(spark, d):
    none = F.lit(None).cast("string").alias("parent")
    tree = table(spark, d, "region").select(_text("region:", ":r_regionkey").alias("scope"), none)
    tree = tree.unionByName(table(spark, d, "nation").select(_text("nation:", ":n_nationkey").alias("scope"), _text("region:", ":n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, d, "customer").select(_text("customer:", ":c_custkey").alias("scope"), _text("nation:", ":c_nationkey").alias("parent")))
    made = lambda rows, kind, key: rows.select(_text(f"{kind}:", f":{key}").alias("scope"), F.lit("v").alias("name"), F.col(key).cast("long").alias("seq"), _text(kind[0], f":{key}").alias("id"))
    return tree, made(table(spark, d, "region"), "region", "r_regionkey").unionByName(made(table(spark, d, "nation").where("n_nationkey % 2 = 0"), "nation", "n_nationkey"))


@query(
    "resolved_definitions",
    """SELECT 'customer:' || c_custkey AS scope, CAST(c_custkey % 30 AS BIGINT) AS seq, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey < c_custkey % 30 THEN 'n' || n_nationkey WHEN n_regionkey < c_custkey % 30 THEN 'r' || n_regionkey END AS definition
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def resolved_definitions(spark, d):
    tree, made = _scopes(spark, d)
    used = table(spark, d, "customer").select(_text("customer:", ":c_custkey").alias("scope"), F.lit("v").alias("name"), (F.col("c_custkey") % 30).cast("long").alias("seq"))
    return scopes.resolve(used, made, tree).select("scope", "seq", "definition")


@query("shadowed_definitions", "SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS shadows FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < n_nationkey")
def shadowed_definitions(spark, d):
    tree, made = _scopes(spark, d)
    return scopes.shadowed(made, tree)


@query("first_assignments", "SELECT 'n' || c_nationkey || '.php' AS file_path, o_orderstatus AS scope, '$c' || o_custkey AS target, CAST(min(o_orderkey) AS BIGINT) AS seq FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def first_assignments(spark, d):
    rows = _orders(spark, d).select(_file(), F.lit("").alias("class_name"), F.col("o_orderstatus").alias("scope"), _text("$c", ":o_custkey").alias("target"), F.col("o_orderkey").cast("long").alias("seq"))
    return scopes.first_definitions(rows).select("file_path", "scope", "target", "seq")


@query(
    "parameter_call_values",
    f"WITH {_LINES} SELECT 'f' || l_suppkey AS name, param, count(DISTINCT CASE param WHEN '$a' THEN '$p' || l_partkey ELSE 'f($o' || l_orderkey || ')' END) AS n_values FROM l, (VALUES ('$a'), ('$b')) p(param) GROUP BY ALL",
)
def parameter_call_values(spark, d):
    # In one file a parameter has one position, so each of its values is one row already.
    functions = _functions(spark, d).where("file_path <> 'zz.php'").withColumn("file_path", F.lit("lib.php"))
    return scopes.parameter_values(functions, _calls(spark, d)).groupBy("name", "param").agg(F.count("value").alias("n_values"))


@query(
    "variable_reports",
    """WITH e AS (SELECT user_id, event_type, CASE event_type WHEN 'error' THEN 'http_get' WHEN 'signup' THEN 'session' END AS kind FROM events)
    SELECT CAST(user_id AS VARCHAR) AS file_path, count(*) AS n_definitions, count(kind) AS n_input, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS types FROM e GROUP BY user_id""",
)
def variable_reports(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), "event_type", "event_id")
    defs = events.select("file_path", F.lit("$t").alias("target"), _text("g($", ":event_type", ", ", ":event_id", ")").alias("source_expr"))
    kinds = F.when(F.col("event_type") == "error", "http_get").when(F.col("event_type") == "signup", "session")
    sources = events.select("file_path", _text("$", ":event_type").alias("variable"), kinds.alias("source_type")).where("source_type is not null").distinct()
    return scopes.variable_report(defs, sources).select("file_path", "n_definitions", "n_input", F.array_join("types", ",").alias("types"))


@query("numbered_steps", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS step FROM events")
def numbered_steps(spark, d):
    return scopes.numbered(table(spark, d, "events"), "user_id", "event_id").select("event_id", "step")


# --- carriers --------------------------------------------------------------------------------------------------------

_KIND = {
    "signup": "foreach ($_GET as $k => $v) {",
    "view": "return $_SERVER['HTTP_HOST']",
    "purchase": "$this->p{} = $_COOKIE['t']",
    "error": "$this->p{} = $_POST['q{}']",
}


def _statements(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.pmod("user_id", F.lit(20)).cast("string").alias("c"), F.pmod("user_id", F.lit(3)).cast("string").alias("m"))
    code = F.when(F.col("event_type") == "signup", _KIND["signup"]).when(F.col("event_type") == "view", _KIND["view"]).when(F.col("event_type") == "purchase", _text("$this->p", ":m", " = $_COOKIE['t']"))
    code = code.when(F.col("event_type") == "error", _text("$this->p", ":m", " = $_POST['q", ":m", "']")).otherwise("run($_REQUEST['x'])")
    return e.select(_text("f", ":c", ".php").alias("file_path"), F.col("event_id").cast("long").alias("line"), code.alias("text"), F.lit("m").alias("scope"), _text("C", ":c").alias("class_name"))


@query(
    "superglobal_usages",
    """SELECT 'C' || (user_id % 20) AS class_name, CASE event_type WHEN 'signup' THEN '$_GET' WHEN 'view' THEN '$_SERVER' WHEN 'purchase' THEN '$_COOKIE' WHEN 'error' THEN '$_POST' ELSE '$_REQUEST' END AS superglobal,
      CASE event_type WHEN 'signup' THEN 'http_get' WHEN 'view' THEN 'http_header' WHEN 'purchase' THEN 'http_cookie' WHEN 'error' THEN 'http_post' ELSE 'http_request' END AS source_type,
      CASE event_type WHEN 'signup' THEN 'foreach' WHEN 'view' THEN 'return' WHEN 'purchase' THEN 'assignment' WHEN 'error' THEN 'assignment' ELSE 'function_arg' END AS context,
      CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN 'HTTP_HOST' WHEN 'purchase' THEN 't' WHEN 'error' THEN 'q' || (user_id % 3) ELSE 'x' END AS key, count(*) AS n FROM events GROUP BY ALL""",
)
def superglobal_usages(spark, d):
    return aggregate.counts(carriers.usages(_statements(spark, d)), "class_name", "superglobal", "source_type", "context", "key")


def _class_methods(spark, d) -> DataFrame:
    classes = table(spark, d, "events").select(F.pmod("user_id", F.lit(20)).cast("string").alias("c")).distinct()
    methods = F.explode(F.array(F.struct(F.lit("a").alias("name"), F.lit(1).alias("line"), F.lit("{ return $this->p0; }").alias("body")), F.struct(F.lit("b").alias("name"), F.lit(300).alias("line"), F.lit("{ return f($this->p1['k']); }").alias("body"))))
    return classes.select(_text("f", ":c", ".php").alias("file_path"), _text("C", ":c").alias("class_name"), methods.alias("m")).select("file_path", "class_name", "m.*")


def _discovered(spark, d):
    statements, functions = _statements(spark, d), _class_methods(spark, d)
    hidden = functions.select("class_name").distinct().select("class_name", F.lit("p0").alias("property"), (F.substring("class_name", -1, 1) != "0").alias("is_public"))
    return carriers.discover(statements, functions, hidden)


_HELD = """e AS (SELECT 'C' || (user_id % 20) AS class_name, 'p' || (user_id % 3) AS property, CASE event_type WHEN 'purchase' THEN 'http_cookie' ELSE 'http_post' END AS kind, event_id FROM events WHERE event_type IN ('purchase', 'error')),
    held AS (SELECT class_name, property, string_agg(DISTINCT kind, ',' ORDER BY kind) AS source_types, CAST(min(event_id) AS BIGINT) AS line FROM e WHERE NOT (property = 'p0' AND class_name LIKE '%0') GROUP BY ALL)"""


@query("discovered_carriers", f"WITH {_HELD} SELECT class_name, property, source_types, CASE WHEN line >= 300 THEN 'b' WHEN line >= 1 THEN 'a' ELSE '__construct' END AS populated_in, line FROM held")
def discovered_carriers(spark, d):
    return _discovered(spark, d)[0].withColumn("source_types", F.array_join("source_types", ","))


@query("discovered_methods", f"WITH {_HELD} SELECT class_name, CASE property WHEN 'p0' THEN 'a' ELSE 'b' END AS method, property, source_types FROM held WHERE property IN ('p0', 'p1')")
def discovered_methods(spark, d):
    return _discovered(spark, d)[1].withColumn("source_types", F.array_join("source_types", ","))


@query("carrier_type_counts", f"WITH {_HELD}, t AS (SELECT class_name, unnest(string_split(source_types, ',')) AS source_type FROM held) SELECT source_type, count(*) AS n, count(DISTINCT class_name) AS n_classes FROM t GROUP BY source_type")
def carrier_type_counts(spark, d):
    return carriers.statistics(_discovered(spark, d)[0])


@query("carrier_lookup", f"WITH {_HELD} SELECT class_name, property, 'type' AS found_by FROM held WHERE contains(source_types, 'http_cookie') UNION ALL SELECT class_name, property, 'class' FROM held WHERE class_name = 'C7' UNION ALL SELECT class_name, property, 'member' FROM held WHERE class_name = 'C7' AND property = 'p1'")
def carrier_lookup(spark, d):
    held = _discovered(spark, d)[0]
    found = lambda name, **by: carriers.find(held, **by).select("class_name", "property", F.lit(name).alias("found_by"))
    return found("type", source_type="http_cookie").unionByName(found("class", class_name="C7")).unionByName(found("member", class_name="C7", member="p1"))


@query(
    "carrier_union",
    "SELECT 'N' || c_nationkey AS class_name, 'k' || (c_custkey % 200) AS property, 'customer' AS origin FROM customer GROUP BY ALL UNION ALL SELECT class_name, property, 'supplier' FROM (SELECT DISTINCT 'N' || s_nationkey AS class_name, 'k' || s_suppkey AS property FROM supplier) s ANTI JOIN (SELECT 'N' || c_nationkey AS class_name, 'k' || (c_custkey % 200) AS property FROM customer) c USING (class_name, property)",
)
def carrier_union(spark, d):
    left = table(spark, d, "customer").select(_text("N", ":c_nationkey").alias("class_name"), _text("k", (F.col("c_custkey") % 200).cast("string")).alias("property"), F.lit("customer").alias("origin")).distinct()
    right = table(spark, d, "supplier").select(_text("N", ":s_nationkey").alias("class_name"), _text("k", ":s_suppkey").alias("property"), F.lit("supplier").alias("origin")).distinct()
    return carriers.united(left, right)


# --- snippets --------------------------------------------------------------------------------------------------------


def _snippets(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("snippet_id"), "event_type", F.pmod("user_id", F.lit(4)).cast("string").alias("k"))
    lines = [
        _text("// $_GET['no']"),
        _text("+$q = \"select * from t where id={$db->row['id", ":k", "']}\";"),
        F.when(F.col("event_type") == "signup", "$x = $_GET['id'] . $req->all('n');").when(F.col("event_type") == "view", _text("$y = $db->escape_string($in->vars['k", ":k", "']);")).when(F.col("event_type") == "purchase", "$z = 'a' . $user->name . 'b' . escape($raw);").otherwise("f(1);"),
        _text("$request->get('a', f(1, ')')); $db->query('x');"),
    ]
    return e.select("snippet_id", F.array_join(F.array(*lines), "\n").alias("code"), "event_type")


@query(
    "snippet_embedded",
    """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS snippet_id, event_type, CAST(user_id % 4 AS VARCHAR) AS k FROM events),
    x AS (SELECT snippet_id, '$_GET[''no'']' AS expression, 1 AS line, 'superglobal' AS kind, '' AS wrapper FROM e
    UNION ALL SELECT snippet_id, '$db->row[''id' || k || ''']', 2, 'property_access', '' FROM e
    UNION ALL SELECT snippet_id, unnest(['$_GET[''id'']', '$req->all(''n'')']), 3, unnest(['superglobal', 'method_call']), '' FROM e WHERE event_type = 'signup'
    UNION ALL SELECT snippet_id, '$in->vars[''k' || k || ''']', 3, 'property_access', '' FROM e WHERE event_type = 'view'
    UNION ALL SELECT snippet_id, unnest(['$user->name', '$raw']), 3, unnest(['concatenated', 'escaped']), unnest(['', 'escape']) FROM e WHERE event_type = 'purchase'
    UNION ALL SELECT snippet_id, unnest(['$request->get(''a'')', '$db->query(''x'')']), 4, 'method_call', '' FROM e)
    SELECT kind, expression, line, wrapper, count(*) AS n FROM x GROUP BY ALL""",
)
def snippet_embedded(spark, d):
    found = snippets.embedded(_snippets(spark, d))
    return aggregate.counts(found, "kind", "expression", "line", "wrapper")


@query("snippet_calls", "SELECT 4 AS line, '$request->get(''a'', f(1, '')''))' AS expression, count(*) AS n FROM events UNION ALL SELECT 4, '$db->query(''x'')', count(*) FROM events")
def snippet_calls(spark, d):
    # One of the general methods is query, of category http, so both calls of line 4 count; $req->all is known for $request only.
    return aggregate.counts(snippets.method_calls(_snippets(spark, d), catalogue.input_methods(spark)), "line", "expression")


def _classified(spark, d):
    held = spark.createDataFrame([("vars", r"\$in->vars", ["http_get", "http_post"])], "member string, pattern string, source_types array<string>")
    return snippets.classify(_snippets(spark, d), held)


@query(
    "snippet_totals",
    """SELECT CAST(event_id AS VARCHAR) AS snippet_id, CAST(CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 5 WHEN 'purchase' THEN 4 ELSE 3 END AS BIGINT) AS n_expressions, CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS BIGINT) AS n_input,
      CASE event_type WHEN 'signup' THEN 'http_get' WHEN 'view' THEN 'http_get,http_post' ELSE '' END AS types FROM events""",
)
def snippet_totals(spark, d):
    return snippets.totals(_classified(spark, d)).select("snippet_id", "n_expressions", "n_input", F.array_join("source_types", ",").alias("types"))


@query("snippet_types", "SELECT source_type, CAST(sum(k) AS BIGINT) AS n_expressions, count(*) AS n_snippets FROM (SELECT 'http_get' AS source_type, CASE event_type WHEN 'view' THEN 2 ELSE 1 END AS k FROM events WHERE event_type IN ('signup', 'view') UNION ALL SELECT 'http_post', 2 FROM events WHERE event_type = 'view') GROUP BY source_type")
def snippet_types(spark, d):
    return snippets.by_type(_classified(spark, d))


@query(
    "snippet_batch",
    """WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 5 WHEN 'purchase' THEN 4 ELSE 3 END AS n, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS i FROM events)
    SELECT 'snippets' AS metric, count(*) AS value FROM e UNION ALL SELECT 'with_input', count(*) FILTER (i > 0) FROM e UNION ALL SELECT 'expressions', CAST(sum(n) AS BIGINT) FROM e UNION ALL SELECT 'input_expressions', CAST(sum(i) AS BIGINT) FROM e""",
)
def snippet_batch(spark, d):
    return snippets.batch_totals(_snippets(spark, d), _classified(spark, d))


# --- conditions ------------------------------------------------------------------------------------------------------

_ROWS = """r AS (SELECT CAST(user_id AS VARCHAR) AS file_path, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS line FROM events),
    t AS (SELECT *, CASE event_type WHEN 'signup' THEN 'if ($a == null) {' WHEN 'view' THEN '}' WHEN 'purchase' THEN 'if (strlen($b) > 3) {' WHEN 'error' THEN '} // end' ELSE 'x();' END AS text FROM r),
    b AS (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS opens, CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END AS closes FROM t),
    w AS (SELECT *, sum(opens - closes) OVER (PARTITION BY file_path ORDER BY line) AS level FROM b),
    h AS (SELECT *, level - least(min(level) OVER (PARTITION BY file_path ORDER BY line), 0) AS height FROM w),
    g AS (SELECT file_path, line, event_type, level, height - 1 AS nesting, (SELECT min(x.line) FROM w x WHERE x.file_path = h.file_path AND x.line > h.line AND x.line < h.line + 100 AND x.level < h.level) AS stop FROM h WHERE opens = 1),
    ends AS (SELECT file_path, max(line) AS last FROM w GROUP BY file_path),
    ranges AS (SELECT g.*, least(coalesce(stop - 1, last), line + 99) AS guard_end FROM g JOIN ends USING (file_path))"""


def _lines(spark, d) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    code = F.when(F.col("event_type") == "signup", "if ($a == null) {").when(F.col("event_type") == "view", "}").when(F.col("event_type") == "purchase", "if (strlen($b) > 3) {").when(F.col("event_type") == "error", "} // end").otherwise("x();")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), line.alias("line"), code.alias("text"))


@query(
    "guarded_lines",
    f"""WITH {_ROWS} SELECT file_path, line, line AS guard_start, CAST(guard_end AS INTEGER) AS guard_end, CASE event_type WHEN 'signup' THEN '$a == null' ELSE 'strlen($b) > 3' END AS expression, CASE event_type WHEN 'signup' THEN 'null_check' ELSE 'length_check' END AS type, false AS is_negated, CAST(nesting AS BIGINT) AS nesting,
      CASE WHEN nesting > 0 THEN (SELECT CAST(max(x.line) AS INTEGER) FROM g x WHERE x.file_path = ranges.file_path AND x.line < ranges.line AND x.nesting = ranges.nesting - 1) END AS parent FROM ranges""",
)
def guarded_lines(spark, d):
    return conditions.guarded_ranges(_lines(spark, d))


@query("guards_on_lines", f"WITH {_ROWS} SELECT w.file_path, w.line, count(*) AS n_guards FROM w JOIN ranges ON w.file_path = ranges.file_path AND w.line BETWEEN ranges.line AND ranges.guard_end GROUP BY ALL")
def guards_on_lines(spark, d):
    lines = _lines(spark, d)
    held = conditions.guards_of(lines.select("file_path", F.col("line").alias("at")), conditions.guarded_ranges(lines))
    return held.groupBy("file_path", F.col("at").alias("line")).agg(F.count(F.lit(1)).alias("n_guards"))


@query("condition_summary", f"WITH {_ROWS} SELECT CASE event_type WHEN 'signup' THEN 'null_check' ELSE 'length_check' END AS type, count(*) AS n FROM ranges GROUP BY ALL")
def condition_summary(spark, d):
    return aggregate.counts(conditions.guarded_ranges(_lines(spark, d)), "type")


@query("infeasible_paths", "SELECT user_id AS path_id, event_type AS variable FROM events GROUP BY ALL HAVING bool_or(event_id % 2 = 0) AND NOT bool_and(event_id % 2 = 0)")
def infeasible_paths(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("path_id"), F.col("event_type").alias("variable"), F.lit("null_check").alias("type"), (F.col("event_id") % 2 == 0).alias("is_negated"))
    return conditions.infeasible(rows)


@query("condition_variables", "SELECT p_partkey, '$' || lower(string_split(p_type, ' ')[1]) || ',$b' || p_size AS names FROM part")
def condition_variables(spark, d):
    word = F.lower(F.element_at(F.split("p_type", " "), 1))
    expression = F.concat(F.lit("$"), word, F.lit(" and $b"), F.col("p_size").cast("string"), F.lit(" or $"), word, F.lit(" > x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(conditions.variables_in(expression, ["and", "or"]), ",").alias("names"))


@query("condition_negation", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '!$x' WHEN 1 THEN '$y' ELSE '$z' END AS expression, p_size % 3 <> 2 AS is_negated FROM part")
def condition_negation(spark, d):
    line = F.when(F.col("p_size") % 3 == 0, "  if (!$x) {").when(F.col("p_size") % 3 == 1, "} else if ($y) {").otherwise("while ($w) if ($z) {")
    line = F.when(F.col("p_size") % 3 == 2, "if ($z):").otherwise(line)
    expression = conditions.condition_of(line)
    return table(spark, d, "part").select("p_partkey", expression.alias("expression"), conditions.is_negated(line, expression).alias("is_negated"))


# --- symbols ---------------------------------------------------------------------------------------------------------


@query("symbol_references", "SELECT p_partkey, count(*) AS n_references FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def symbol_references(spark, d):
    symbols = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    references = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol_id"))
    return search.with_references(symbols, references).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_references"))


@query(
    "definition_fallbacks",
    """WITH s AS (SELECT * FROM part WHERE p_size >= 40), m AS (SELECT * FROM part WHERE p_size < 10)
    SELECT p.p_partkey, coalesce((SELECT min(p_partkey) FROM s WHERE s.p_name = p.p_name AND s.p_brand = p.p_brand), (SELECT min(p_partkey) FROM s WHERE s.p_name = p.p_name), (SELECT min(p_partkey) FROM m WHERE m.p_name = p.p_name)) AS definition FROM part p""",
)
def definition_fallbacks(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return search.definitions(part.select("p_partkey", "p_name", "p_brand"), part.where("p_size >= 40"), "p_name", "p_brand", "p_partkey", part.where("p_size < 10")).select("p_partkey", "definition")


# --- graphs with cycles ----------------------------------------------------------------------------------------------

# Each user has two edges to others, by a rule of its id and the number of ids; every tenth user has none.
_M = "(SELECT max(user_id) + 1 FROM events)"
_EDGES = f"e AS (SELECT DISTINCT user_id AS src, (user_id * 7 + 3) % {_M} AS dst FROM events WHERE user_id % 10 <> 0 UNION SELECT DISTINCT user_id, (user_id * user_id + 1) % {_M} FROM events WHERE user_id % 10 <> 0), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_WALK = "p(node, path, steps) AS (SELECT node, [node], 0 FROM n WHERE node = 1 UNION ALL SELECT dst, list_append(path, dst), steps + 1 FROM p JOIN e ON src = node WHERE steps < 5 AND NOT list_contains(path, dst))"


def _cyclic(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("long").alias("src"))
    users = events.distinct().where("src % 10 <> 0").join(F.broadcast(events.agg((F.max("src") + 1).alias("m"))))
    edges = users.selectExpr("src", "(src * 7 + 3) % m AS dst").union(users.selectExpr("src", "(src * src + 1) % m AS dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes, edges, nodes.where("node = 1")


@query("cyclic_distances", f"WITH RECURSIVE {_EDGES}, b(node, distance) AS (SELECT node, 0 FROM n WHERE node = 1 UNION SELECT dst, distance + 1 FROM b JOIN e ON src = node WHERE distance < 8) SELECT n.node, CAST(coalesce(min(distance), -1) AS INTEGER) AS distance FROM n LEFT JOIN b USING (node) GROUP BY n.node")
def cyclic_distances(spark, d):
    nodes, edges, start = _cyclic(spark, d)
    return graph.distances(nodes, edges, start, 8)


@query("cyclic_shortest_paths", f"WITH RECURSIVE {_EDGES}, {_WALK}, s AS (SELECT node, min(steps) AS steps FROM p GROUP BY node) SELECT node, array_to_string(min(path), '>') AS path FROM p JOIN s USING (node, steps) GROUP BY node")
def cyclic_shortest_paths(spark, d):
    nodes, edges, start = _cyclic(spark, d)
    return graph.shortest_paths(edges, start, nodes, 5).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("cyclic_leaf_paths", f"WITH RECURSIVE {_EDGES}, {_WALK} SELECT array_to_string(path, '>') AS path FROM p WHERE steps > 0 AND node NOT IN (SELECT src FROM e)")
def cyclic_leaf_paths(spark, d):
    _, edges, start = _cyclic(spark, d)
    return graph.simple_paths(edges, start, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("paths_through_node", f"WITH RECURSIVE {_EDGES}, {_WALK.replace(' WHERE node = 1', '')} SELECT array_to_string(path, '>') AS path FROM p WHERE node NOT IN (SELECT src FROM e) AND list_contains(path, 1)")
def paths_through_node(spark, d):
    nodes, edges, _ = _cyclic(spark, d)
    return graph.paths_through(edges, nodes, 1, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "distance_pairs",
    """WITH RECURSIVE e AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT l_partkey, -l_suppkey FROM lineitem WHERE l_quantity <= 2),
      w AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem),
      b(start, node, distance) AS (SELECT DISTINCT src, src, 0 FROM w UNION SELECT start, dst, distance + 1 FROM b JOIN e ON src = node WHERE distance < 6)
    SELECT src, dst, CAST(coalesce(distance, -1) AS INTEGER) AS distance FROM w LEFT JOIN (SELECT start, node, min(distance) AS distance FROM b GROUP BY ALL) ON start = src AND node = dst""",
)
def distance_pairs(spark, d):
    """Steps from each supplier to each part that it delivers, along deliveries of much (to the part) and of little (back)."""
    lines = table(spark, d, "lineitem").selectExpr("-l_suppkey AS s", "l_partkey AS p", "l_quantity AS n")
    edges = lines.where("n >= 49").select(F.col("s").alias("src"), F.col("p").alias("dst")).union(lines.where("n <= 2").select("p", "s"))
    return graph.pair_distances(lines.select(F.col("s").alias("src"), F.col("p").alias("dst")), edges, 6)


@query(
    "expanded_calls",
    f"""WITH RECURSIVE {_EDGES}, p(node, path, steps, pruned) AS (SELECT node, [node], 0, '' FROM n WHERE node = 1
      UNION ALL SELECT dst, list_append(path, dst), steps + 1, CASE WHEN list_contains(path, dst) THEN 'cycle_detected' ELSE '' END FROM p JOIN e ON src = node WHERE steps < 5 AND pruned = '' AND node % 10 <> 0)
    SELECT array_to_string(path, '>') AS path, CASE WHEN pruned <> '' THEN pruned WHEN node % 10 = 0 THEN '' ELSE 'max_depth_exceeded' END AS pruned FROM p WHERE pruned <> '' OR node % 10 = 0 OR (steps = 5 AND node IN (SELECT src FROM e))""",
)
def expanded_calls(spark, d):
    nodes, edges, start = _cyclic(spark, d)
    calls = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(1).alias("line"))
    found = graph.expanded_paths(calls, start, nodes.where("node % 10 = 0"), 5)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "pruned")


@query("reversed_calls", f"WITH {_EDGES} SELECT dst AS node, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS callers FROM e GROUP BY dst")
def reversed_calls(spark, d):
    return graph.reversed_edges(_cyclic(spark, d)[1]).select("node", F.array_join(F.transform("callers", lambda x: x.cast("string")), ",").alias("callers"))


@query(
    "cyclic_graph_stats",
    f"WITH RECURSIVE {_EDGES}, b(node, distance) AS (SELECT node, 0 FROM n WHERE node = 1 UNION SELECT dst, distance + 1 FROM b JOIN e ON src = node WHERE distance < 4) SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'entry_points', 1 UNION ALL SELECT 'reachable', count(DISTINCT node) FROM b",
)
def cyclic_graph_stats(spark, d):
    nodes, edges, start = _cyclic(spark, d)
    return graph.statistics(nodes, edges, start, 4)


# --- members and registry --------------------------------------------------------------------------------------------


@query(
    "import_resolution",
    """SELECT 'd' || c_nationkey || '/x/c' || c_custkey || '.js' AS file_path, CAST(c_custkey AS INTEGER) AS line, 'd' || s_nationkey || '/s' || s_suppkey || '.ts' AS resolved FROM customer JOIN supplier ON s_suppkey = c_custkey % 150""",
)
def import_resolution(spark, d):
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    files = supplier.select(_text("d", ":s_nationkey", "/s", ":s_suppkey", ".ts").alias("file_path"))
    # Imports of suppliers that don't exist name a folder of their own.
    wanted = customer.select("c_custkey", "c_nationkey", (F.col("c_custkey") % 150).alias("s_suppkey")).join(supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", "left")
    code = F.concat(F.lit("import x from '../../d"), F.coalesce(F.col("s_nationkey").cast("string"), F.lit("none")), F.lit("/./y/../s"), F.col("s_suppkey").cast("string"), F.lit("'"))
    imports = wanted.select(_text("d", ":c_nationkey", "/x/c", ":c_custkey", ".js").alias("file_path"), F.lit("javascript").alias("language"), F.col("c_custkey").cast("int").alias("line"), code.alias("text"))
    return members.resolve_imports(imports, files)


@query("method_body_flow", "SELECT 'f' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN '$b' WHEN 1 THEN '$a,$b' ELSE '' END AS to_return FROM supplier UNION ALL SELECT 'f' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '$b' WHEN 1 THEN '$a,$b' ELSE '' END FROM supplier WHERE s_suppkey % 5 = 0")
def method_body_flow(spark, d):
    return members.body_flow(_functions(spark, d)).select("name", F.array_join("params_to_return", ",").alias("to_return"))


@query(
    "class_lookup",
    """SELECT wanted, class_name, CAST(level AS INTEGER) AS level FROM (SELECT n_name AS wanted, n_name AS class_name, 0 AS level FROM nation UNION ALL SELECT lower(n_name), n_name, 1 FROM nation UNION ALL SELECT lower(n_name) || '_interface', n_name, 2 FROM nation
    UNION ALL SELECT 'I' || r_name, (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey), 3 FROM region)""",
)
def class_lookup(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    classes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("class_name"), F.array(F.concat(F.lit("i"), "r_name")).alias("implements"))
    names = nation.select(F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.lower("n_name"), F.lit("_interface")))).alias("wanted"))
    return members.find_classes(names.union(region.select(F.concat(F.lit("I"), "r_name"))), classes)


def _members(spark, d):
    texts = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("file_path"),
        _text("class P { public $f", ":p_size", "; public function getCookie", ":p_size", "($k) {} public static function setX() {} public function __get($n) {} private function no() {} }").alias("content"),
    )
    return members.public_members(texts)


@query("public_member_names", "SELECT CAST(p_partkey AS VARCHAR) AS file_path, unnest(['method', 'method', 'property']) AS kind, unnest(['getCookie' || p_size, 'setX', 'f' || p_size]) AS name FROM part")
def public_member_names(spark, d):
    return _members(spark, d)


@query(
    "generated_rules",
    r"SELECT DISTINCT 'fw_getcookie' || p_size || '_m' AS id, 'fw' AS framework, '->getCookie' || p_size || '\s*\(' AS pattern, 'http_cookie' AS source_type FROM part UNION ALL SELECT DISTINCT 'fw_f' || p_size || '_p', 'fw', '->f' || p_size || '\b', 'http_request' FROM part",
)
def generated_rules(spark, d):
    return members.made_rules(_members(spark, d), "fw")


@query("marker_framework", "SELECT CASE WHEN max(CASE WHEN n_name = 'KENYA' THEN 1 ELSE 0 END) = 1 THEN 'laravel' ELSE 'unknown' END AS framework FROM nation")
def marker_framework(spark, d):
    return members.marker_framework(table(spark, d, "nation").select(_text("app/", ":n_name").alias("file_path")), [("rails", "ATLANTIS"), ("laravel", "KENYA"), ("gin", "CHINA")])


_EXPRESSION = """CASE event_type WHEN 'signup' THEN 'f($_GET[1])' WHEN 'view' THEN 'curl_exec($c)' WHEN 'purchase' THEN 'json_decode($x)' WHEN 'error' THEN 'getenv("A")' ELSE '$n + ' || user_id END"""


@query(
    "identified_sources",
    "SELECT event_type, CASE event_type WHEN 'signup' THEN 'http_get' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'user_input' WHEN 'error' THEN 'env_var' END AS source_type, CASE event_type WHEN 'signup' THEN 1.0::DOUBLE WHEN 'view' THEN 0.8::DOUBLE WHEN 'purchase' THEN 0.85::DOUBLE WHEN 'error' THEN 0.9::DOUBLE END AS confidence, count(*) AS n FROM events GROUP BY ALL",
)
def identified_sources(spark, d):
    e = table(spark, d, "events").select("event_type", registry.identify_source(F.expr(_EXPRESSION)).alias("s"))
    return aggregate.counts(e.select("event_type", "s.source_type", "s.confidence"), "event_type", "source_type", "confidence")


_WORDS = ["get_input", "cookies", "getData", "val", "Query", "fetch", "user", "headers"]


@query(
    "member_predicates",
    "SELECT member, object, member IN ('get_input', 'cookies', 'headers') AS method, member IN ('cookies', 'Query', 'headers') AS property, object = 'request' AS known, member IN ('getData', 'fetch') AS excluded, (object = 'request' AND member IN ('get_input', 'cookies', 'headers', 'Query')) AS carries, (object = 'request' OR member IN ('get_input', 'cookies', 'headers')) AS as_method, count(*) AS n FROM (SELECT unnest(["
    + ", ".join(f"'{w}'" for w in _WORDS)
    + "]) AS member, CASE WHEN n_nationkey % 2 = 0 THEN 'request' ELSE 'db' END AS object FROM nation) GROUP BY ALL",
)
def member_predicates(spark, d):
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "request").otherwise("db").alias("object"), F.explode(F.array(*map(F.lit, _WORDS))).alias("member"))
    m, o = F.col("member"), F.col("object")
    rows = rows.select(
        "member", "object", registry.is_input_method(m).alias("method"), m.rlike(registry.INPUT_PROPERTY).alias("property"), o.rlike(registry.INPUT_OBJECT).alias("known"), m.rlike(registry.EXCLUDED_METHOD).alias("excluded"),
        registry.carries_input(o, m).alias("carries"), registry.matches_carrier(o, m, F.lit(True)).alias("as_method"),
    )
    return aggregate.counts(rows, *rows.columns)


@query(
    "matched_members",
    "SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'request' ELSE 'db' END AS object, 'cookies' AS member, n_nationkey % 3 = 0 AS is_method, CASE WHEN n_nationkey % 2 = 1 THEN 'database' ELSE 'user_input' END AS source_type FROM nation",
)
def matched_members(spark, d):
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "request").otherwise("db").alias("object"), F.explode(F.array(F.lit("cookies"), F.lit("getData"), F.lit("secret"))).alias("member"), (F.col("n_nationkey") % 3 == 0).alias("is_method"))
    patterns = spark.createDataFrame([(0, 1, "db.cookies", "database"), (1, 2, r"^request\.secret", "user_input")], "level int, seq int, pattern string, source_type string")
    return registry.match_members(rows, patterns, spark.createDataFrame([(r"secret$",)], "not_input string"))


@query(
    "input_method_lookup",
    """WITH m AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'request' ELSE 'x' END AS receiver, unnest(['all', 'get', 'read', 'exec', 'run']) AS method FROM nation)
    SELECT receiver, method, CASE method WHEN 'all' THEN CASE receiver WHEN 'request' THEN 'http' END WHEN 'get' THEN 'http' WHEN 'read' THEN 'file' WHEN 'exec' THEN 'command' END AS category,
      method = 'get' OR (method = 'all' AND receiver = 'request') AS is_input, method IN ('read', 'exec') AS is_interesting, count(*) AS n FROM m GROUP BY ALL""",
)
def input_method_lookup(spark, d):
    calls = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "request").otherwise("x").alias("receiver"), F.explode(F.array(*map(F.lit, ["all", "get", "read", "exec", "run"]))).alias("method"))
    return aggregate.counts(registry.input_methods_of(calls, catalogue.input_methods(spark)), "receiver", "method", "category", "is_input", "is_interesting")


@query("server_keys", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'http_header' WHEN 1 THEN 'http_get' WHEN 2 THEN 'network' ELSE 'unknown' END AS source_type, CASE WHEN n_nationkey % 4 = 3 THEN 'config' ELSE 'user' END AS kind FROM nation")
def server_keys(spark, d):
    key = F.element_at(F.array(*map(F.lit, ["HTTP_HOST", "QUERY_STRING", "REMOTE_ADDR", "DOCUMENT_ROOT"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", registry.server_key_type(key).alias("source_type"), registry.server_key_kind(key).alias("kind"))


@query("php_function_kinds", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'input,network' WHEN 1 THEN 'deserialise' WHEN 2 THEN 'db_fetch' WHEN 3 THEN 'db_query' ELSE '' END AS kinds, n_nationkey % 5 = 2 AS is_result FROM nation")
def php_function_kinds(spark, d):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    kinds = registry.function_kinds(pick("file_get_contents", "unserialize", "fetchAll", "prepare", "strlen"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(kinds, ",").alias("kinds"), registry.is_result_object(pick("a", "db", "myStmt", "x", "y")).alias("is_result"))


@query("node_roles", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'function,scope' WHEN 1 THEN 'assignment' WHEN 2 THEN 'call' WHEN 3 THEN 'identifier' ELSE '' END AS roles FROM region")
def node_roles(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["method_declaration", "variable_declarator", "call_expression", "constant", "comment"])), (F.col("r_regionkey") + 1).cast("int"))
    rows = table(spark, d, "region").select("r_regionkey", kind.alias("node_type")).join(F.broadcast(catalogue.node_types(spark)), "node_type", "left")
    return rows.groupBy("r_regionkey").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("derived_substrings", "SELECT DISTINCT 'method' AS kind, '->get' || n_name || '(' AS part FROM nation UNION ALL SELECT DISTINCT 'property', '->r' || n_regionkey || '[' FROM nation UNION ALL SELECT DISTINCT 'property', '->' || n_name || '[' FROM nation")
def derived_substrings(spark, d):
    rows = table(spark, d, "nation").select(_text("^get", ":n_name", "$").alias("method_pattern"), _text("^r", ":n_regionkey", "$").alias("property_pattern"), F.col("n_name").alias("carrier_property"))
    return registry.substring_patterns(rows)


@query("valid_source_types", "SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents")
def valid_source_types(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["http_cookie", "unknown", "cookie"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", registry.is_source_type(kind).alias("valid"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(
    "code_keys",
    """SELECT p_partkey, 'k' || p_size AS bracket, '$v' AS variable_key, 'm' || p_size AS member, '$v[''a'']' AS base, '$w' AS plain, p_size % 2 = 0 AS mentioned, true AS refers, true AS identifier, 'f(a,b' || p_size || ')' AS signature FROM part""",
)
def code_keys(spark, d):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 2 == 0, "$order").otherwise("$order_id")
    return table(spark, d, "part").select(
        "p_partkey", T.bracket_key(F.concat(F.lit("$_GET['k"), size, F.lit("']"))).alias("bracket"), T.bracket_key(F.lit("$a[$v]")).alias("variable_key"), T.member_key(F.concat(F.lit("req.body.m"), size), "req.body").alias("member"),
        T.base_variable(F.lit("$v['a']['b']")).alias("base"), T.base_variable(F.lit("$w->x")).alias("plain"), T.mentions(F.concat(F.lit("f("), name, F.lit(")")), F.lit("$order")).alias("mentioned"),
        T.refers_to(F.lit("$o[1]"), F.lit("$o")).alias("refers"), T.is_identifier(F.concat(F.lit("a$"), size)).alias("identifier"), T.signature_key(F.concat(F.lit("F( a,\tB"), size, F.lit(" )"))).alias("signature"),
    )


@query(
    "code_lines",
    r"""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN string_split(text, chr(10))[2] END AS second, CAST(10 + CASE WHEN contains(text, 'e') THEN len(string_split(string_split(text, 'e')[1], chr(10))) - 1 ELSE 0 END AS INTEGER) AS first_e,
      'dir/x_' || doc_id || '.php' AS file, CAST(doc_id AS VARCHAR) AS other, 'a' || doc_id AS undiffed, array_to_string(string_split('/a/b/' || doc_id, '/')[-2:], '/') AS short FROM documents""",
)
def code_lines(spark, d):
    doc = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id", T.line_at(F.col("text"), F.lit(2)).alias("second"), T.line_with(F.col("text"), F.lit(10), F.lit("e")).cast("int").alias("first_e"), T.finding_file(F.concat(F.lit("CWE-89_finding_8_dir/x_"), doc, F.lit(".php"))).alias("file"),
        T.finding_file(doc).alias("other"), T.diff_line(F.concat(F.lit("+a"), doc)).alias("undiffed"), T.short_path(F.concat(F.lit("/a/b/"), doc)).alias("short"),
    )


@query(
    "code_names",
    """SELECT n_nationkey, '$a' || n_nationkey || ',$this->b' AS php, 'a' || n_nationkey || ',fn,c' AS python, '@x,y' AS ruby, 'a_' || n_nationkey AS safe, 'q\\"' || n_nationkey AS label, true AS quoted, 'f:C:' || n_nationkey AS id FROM nation""",
)
def code_names(spark, d):
    key = F.col("n_nationkey").cast("string")
    names = lambda code, language: F.array_join(T.variables_of(code, F.lit(language)), ",")
    special = F.concat(F.lit("a.b(c)["), key, F.lit("]$"))
    return table(spark, d, "nation").select(
        "n_nationkey", F.array_join(F.filter(T.variables_of(F.concat(F.lit("f($a"), key, F.lit(", 9x, $this->b)")), F.lit("php")), lambda v: v != "$this"), ",").alias("php"), names(F.concat(F.lit("a"), key, F.lit(" + 9x + fn(c)")), "python").alias("python"),
        names(F.lit("@x + y"), "ruby").alias("ruby"), T.safe_id(F.concat(F.lit("a:"), key)).alias("safe"), T.escaped_label(F.concat(F.lit('q"'), key)).alias("label"), F.regexp_like(special, F.concat(F.lit("^"), T.quoted(special), F.lit("$"))).alias("quoted"), T.key_of_parts(F.lit("f"), F.lit("C"), F.col("n_nationkey")).alias("id"),
    )


@query(
    "file_names",
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'php' WHEN 1 THEN 'ruby' WHEN 4 THEN 'cpp' END AS language, n_nationkey % 5 = 3 AS is_binary, n_nationkey % 5 = 0 AS skipped, n_nationkey % 5 = 2 AS skipped_php FROM nation""",
)
def file_names(spark, d):
    path = F.element_at(F.array(*map(F.lit, ["a/Vendor/x.PHP", "b/Gemfile", "c/tests/README", "d/y.PNG", "e/z.hpp"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", scans.language_of(path).alias("language"), scans.is_binary(path).alias("is_binary"), scans.is_skipped(path).alias("skipped"), scans.is_skipped_php(path).alias("skipped_php"))


# --- sinks -----------------------------------------------------------------------------------------------------------


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(_text("n:", ":n_nationkey").alias("node_id"), F.when(F.col("n_nationkey") % 2 == 0, "source").otherwise("variable").alias("type"), F.col("n_name").alias("name"), _text("src/a/", ":n_nationkey", ".php").alias("file_path"), F.col("n_nationkey").cast("int").alias("line"))


@query("dot_node_lines", r"""SELECT '  "n_' || n_nationkey || '" [label="' || n_name || '\na/' || n_nationkey || '.php:' || n_nationkey || '", fillcolor="' || CASE WHEN n_nationkey % 2 = 0 THEN '#ff6b6b' ELSE '#4ecdc4' END || '", style=filled];' AS line FROM nation""")
def dot_node_lines(spark, d):
    return render.dot_nodes(_nodes(spark, d))


@query("mermaid_node_lines", """SELECT '    n_' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '(("' || n_name || '"))' ELSE '["' || n_name || '"]' END AS line FROM nation""")
def mermaid_node_lines(spark, d):
    return render.mermaid_nodes(_nodes(spark, d))


@query("style_lookup", "SELECT DISTINCT event_type AS type, '#f9f9f9' AS fill, '#333' AS stroke, '[' AS opens, ']' AS closes, 'solid' AS line, 'gray' AS colour, '-->' AS arrow FROM events UNION ALL SELECT 'function', '#45b7d1', '#333', '[/', '/]', 'solid', 'gray', '-->' UNION ALL SELECT 'return', '#f9f9f9', '#333', '[', ']', 'dotted', 'green', '==>|return|'")
def style_lookup(spark, d):
    return render.styles(table(spark, d, "events").select(F.col("event_type").alias("type")).distinct().union(spark.createDataFrame([("function",), ("return",)], "type string")))


def _node_edges(spark, d) -> DataFrame:
    return table(spark, d, "nation").where("n_nationkey > 0").select(_text("n:", (F.col("n_nationkey") - 1).cast("string")).alias("src"), _text("n:", ":n_nationkey").alias("dst"), F.when(F.col("n_nationkey") % 3 == 0, "call").otherwise("taint").alias("type"))


@query(
    "result_document",
    """WITH n AS (SELECT list({'node_id': 'n:' || n_nationkey, 'type': CASE WHEN n_nationkey % 2 = 0 THEN 'source' ELSE 'variable' END} ORDER BY 'n:' || n_nationkey) AS nodes FROM nation),
    e AS (SELECT list({'src': 'n:' || (n_nationkey - 1), 'dst': 'n:' || n_nationkey, 'type': CASE WHEN n_nationkey % 3 = 0 THEN 'call' ELSE 'taint' END} ORDER BY 'n:' || (n_nationkey - 1)) AS edges FROM nation WHERE n_nationkey > 0),
    s AS (SELECT list({'id': 's' || r_regionkey, 'language': CASE WHEN r_regionkey < 2 THEN 'go' ELSE 'php' END} ORDER BY r_regionkey) AS sources FROM region)
    SELECT CAST(to_json({'sources': sources, 'nodes': nodes, 'edges': edges, 'by_language': MAP {'go': 2, 'php': 3}}) AS VARCHAR) AS json FROM n, e, s""",
)
def result_document(spark, d):
    sources = table(spark, d, "region").select(_text("s", ":r_regionkey").alias("id"), F.when(F.col("r_regionkey") < 2, "go").otherwise("php").alias("language"))
    return render.result_json(sources, _nodes(spark, d).select("node_id", "type"), _node_edges(spark, d))


@query(
    "flow_map_statistics",
    "SELECT 'nodes' AS metric, count(*) AS value FROM nation UNION ALL SELECT 'nodes.' || CASE WHEN n_nationkey % 2 = 0 THEN 'source' ELSE 'variable' END, count(*) FROM nation GROUP BY ALL UNION ALL SELECT 'edges', count(*) FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'edges.' || CASE WHEN n_nationkey % 3 = 0 THEN 'call' ELSE 'taint' END, count(*) FROM nation WHERE n_nationkey > 0 GROUP BY ALL",
)
def flow_map_statistics(spark, d):
    return render.flow_statistics(_nodes(spark, d), _node_edges(spark, d))


# --- symbolic --------------------------------------------------------------------------------------------------------


@query(
    "object_classes",
    """SELECT 'm.php' AS file_path, '$v' || n_nationkey AS variable, CASE n_nationkey % 4 WHEN 0 THEN 'C' || n_nationkey WHEN 1 THEN 'G' || n_nationkey WHEN 2 THEN 'H' || n_nationkey ELSE '[DI:svc' || n_nationkey || ']' END AS class_name, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey >= 12 THEN 'm.php' ELSE 'a.php' END AS class_file, CAST(n_nationkey * 20 AS INTEGER) AS line FROM nation""",
)
def object_classes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 20).cast("int").alias("line"))
    kind = F.col("n_nationkey") % 4
    target = F.when(kind == 1, _text("$GLOBALS['v", ":n_nationkey", "']")).otherwise(_text("$v", ":n_nationkey"))
    code = F.when(kind == 0, _text("new C", ":n_nationkey", "(1)")).when(kind == 1, _text("new G", ":n_nationkey")).otherwise(_text("$container->get('svc", ":n_nationkey", "')"))
    made = n.select(F.lit("a.php").alias("file_path"), "line", target.alias("target"), code.alias("source_expr"))
    made = made.unionByName(n.where("n_nationkey % 4 = 0 and n_nationkey >= 12").select(F.lit("m.php").alias("file_path"), "line", _text("$v", ":n_nationkey").alias("target"), _text("new C", ":n_nationkey").alias("source_expr")))
    hint = lambda gap, name: n.where("n_nationkey % 4 = 2").select(F.lit("a.php").alias("file_path"), (F.col("line") - gap).alias("line"), F.concat(F.lit("/** @var \\app\\"), F.lit(name), F.col("n_nationkey").cast("string"), F.lit(" $v"), F.col("n_nationkey").cast("string"), F.lit(" */")).alias("text"))
    hints = hint(4, "Far").unionByName(hint(2, "H")).unionByName(n.where("n_nationkey % 4 = 3").select(F.lit("a.php").alias("file_path"), (F.col("line") - 6).alias("line"), _text("/** @var Late $v", ":n_nationkey", " */").alias("text")))
    return symbolic.instances(n.select(F.lit("m.php").alias("file_path"), _text("$v", ":n_nationkey").alias("variable")), made, hints)


@query("external_method_calls", f"WITH {_LINES} SELECT '$v' || (l_suppkey % 7) AS variable, 'm' || (l_linenumber % 3) AS method, count(*) AS n FROM l WHERE l_orderkey > 100 AND l_linenumber % 3 < 2 GROUP BY ALL")
def external_method_calls(spark, d):
    lines = _one_line(spark, d)
    k = (F.col("l_suppkey") % 7).cast("string")
    calls = lines.select(F.lit("m.php").alias("file_path"), F.col("l_orderkey").cast("long").alias("line"), F.concat(F.lit("$v"), k).alias("receiver"), F.concat(F.lit("$v"), k, F.lit("->m"), (F.col("l_linenumber") % 3).cast("string")).alias("function_name"), F.array(F.lit("1")).alias("args"))
    wanted = spark.range(7).select(F.concat(F.lit("$v"), F.col("id").cast("string")).alias("variable"), F.lit("p").alias("property"), F.lit("C").alias("class_name"), F.lit("m.php").alias("class_file"), F.lit(100).cast("long").alias("line"))
    functions = spark.createDataFrame([("C", "m0", "{ $this->p = 1; }"), ("C", "m1", "{ return $this->p['k']; }"), ("C", "m2", "{ $this->q = 1; }")], "class_name string, name string, body string")
    return symbolic.external_calls(wanted, calls, functions).groupBy("variable", "method").agg(F.count(F.lit(1)).alias("n"))


_RETURN = ["return (int)$this->v[$k];", "return $this->v[$k];", "return $this->v[$k] ?? 1;", "return isset($this->v[$k]) ? $this->v[$k] : 0;", "return $this->w;", "return $this;", "return $_GET['a'];", "return 1;"]


def _shaped(spark, d) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, _RETURN)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return table(spark, d, "nation").select(_text("C", ":n_regionkey").alias("class_name"), _text("m", ":n_nationkey").alias("name"), F.array(F.lit("$x"), F.lit("$k")).alias("params"), F.concat(F.lit("{ "), body, F.lit(" }")).alias("body"), F.lit("").alias("return_type"))


@query(
    "return_statement_shapes",
    "SELECT 'C' || n_regionkey AS class_name, 'm' || n_nationkey AS name, CASE n_nationkey % 8 WHEN 0 THEN 'cast_key' WHEN 1 THEN 'param_key' WHEN 2 THEN 'null_coalesce' WHEN 3 THEN 'ternary_isset' WHEN 4 THEN 'direct' WHEN 5 THEN 'self' WHEN 6 THEN 'input' ELSE 'other' END AS shape, CASE WHEN n_nationkey % 8 < 4 THEN 'v' WHEN n_nationkey % 8 = 4 THEN 'w' ELSE '' END AS property, CASE WHEN n_nationkey % 8 < 4 THEN 1 ELSE -1 END AS param_index FROM nation",
)
def return_statement_shapes(spark, d):
    return symbolic.return_shapes(_shaped(spark, d)).drop("code")


@query(
    "member_populations",
    "SELECT 'C' || n_nationkey AS class_name, CASE n_nationkey % 4 WHEN 3 THEN 'q' ELSE 'p' END AS property, CASE n_nationkey % 4 WHEN 0 THEN 'loop_input' WHEN 1 THEN 'loop_param' WHEN 2 THEN 'direct' ELSE 'conditional' END AS how, CASE n_nationkey % 4 WHEN 0 THEN '$_GET' WHEN 1 THEN '$rows' WHEN 2 THEN '$x . 1' ELSE '$_POST[''a'']' END AS source FROM nation UNION ALL SELECT 'C' || n_nationkey, 'q', 'direct', '1' FROM nation WHERE n_nationkey % 4 = 3",
)
def member_populations(spark, d):
    bodies = ["{ foreach ($_GET as $k => $v) { $this->p[$k] = $v; } }", "{ foreach ($rows as $k => $v) { $this->p[$k] = $v; } }", "{ $this->p = $x . 1; }", "{ if ($_POST['a']) { $this->q = 1; } }"]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    functions = table(spark, d, "nation").select(_text("C", ":n_nationkey").alias("class_name"), F.lit("__construct").alias("name"), F.array(F.lit("$rows")).alias("params"), body.alias("body"))
    return symbolic.populations(functions).drop("method")


@query("magic_classes", "SELECT 'C' || n_nationkey AS class_name, CASE WHEN n_nationkey % 3 = 0 THEN 'magic_get' ELSE 'dynamic_assign' END AS how, CASE WHEN n_nationkey % 3 = 0 THEN 'data' ELSE 'rows' END AS backing, n_nationkey % 3 = 1 AS from_file FROM nation")
def magic_classes(spark, d):
    n = table(spark, d, "nation")
    load = F.when(F.col("n_nationkey") % 3 == 1, "{ require $f; foreach ($rows as $k => $v) { $this->$k = $v; } }").otherwise("{ foreach ($rows as $k => $v) { $this->$k = $v; } }")
    functions = n.select(_text("C", ":n_nationkey").alias("class_name"), F.lit("load").alias("name"), load.alias("body"))
    functions = functions.unionByName(n.where("n_nationkey % 3 = 0").select(_text("C", ":n_nationkey").alias("class_name"), F.lit("__get").alias("name"), F.lit("{ return $this->data[$name]; }").alias("body")))
    return symbolic.magic_members(functions).drop("method")


@query(
    "call_chains",
    "SELECT CAST(n_nationkey AS VARCHAR) AS expression_id, 0 AS position, 'a' AS member, 'N' || n_nationkey AS class_name FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1, 'b', 'N' || n_nationkey FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 2, 'c', 'R' || n_regionkey FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 3, 'd', 'Made' FROM nation WHERE n_regionkey % 2 = 0",
)
def call_chains(spark, d):
    n = table(spark, d, "nation")
    wanted = n.select(F.col("n_nationkey").cast("string").alias("expression_id"), _text("$n", ":n_nationkey", "->a()->b(1)->c->d()").alias("expression"))
    objects = n.select(_text("$n", ":n_nationkey").alias("variable"), _text("N", ":n_nationkey").alias("class_name"))
    none = F.lit("").alias("return_type")
    functions = n.select(_text("N", ":n_nationkey").alias("class_name"), F.lit("a").alias("name"), F.lit("{ $this->x = 1; return $this; }").alias("body"), none)
    functions = functions.unionByName(n.select(_text("N", ":n_nationkey").alias("class_name"), F.lit("b").alias("name"), F.lit("{ return $r; }").alias("body"), _text("?\\app\\R", ":n_regionkey").alias("return_type")))
    functions = functions.unionByName(table(spark, d, "region").where("r_regionkey % 2 = 0").select(_text("R", ":r_regionkey").alias("class_name"), F.lit("c").alias("name"), F.lit("{ return new Made(); }").alias("body"), none))
    return symbolic.chain_classes(wanted, objects, functions)


def _symbolic_steps(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    wanted = n.select(F.col("n_nationkey").cast("string").alias("expression_id"), _text("$n", ":n_nationkey").alias("expression"))
    row = lambda rows, target, code, owner: rows.select(F.lit("s.php").alias("file_path"), F.lit(1).alias("line"), target.alias("target"), code.alias("source_expr"), F.lit(owner).alias("class_name"))
    sets = row(n, _text("$n", ":n_nationkey"), _text("R::get", ":n_regionkey", "()"), "")
    sets = sets.unionByName(row(table(spark, d, "region"), _text("$this->r", ":r_regionkey"), F.when(F.col("r_regionkey") < 2, "$_GET['r']").otherwise("1"), "R"))
    sets = sets.unionByName(row(table(spark, d, "region"), _text("$this->r", ":r_regionkey"), F.lit("$_POST['other']"), "Other"))
    functions = table(spark, d, "region").select(F.lit("s.php").alias("file_path"), F.lit(2).alias("line"), F.lit("R").alias("class_name"), _text("get", ":r_regionkey").alias("name"), _text("{ return $this->r", ":r_regionkey", "; }").alias("body"))
    return symbolic.steps_back(wanted, sets, functions)


_STEPS = """s AS (SELECT CAST(n_nationkey AS VARCHAR) AS expression_id, n_nationkey AS k, n_regionkey AS r FROM nation),
    x AS (SELECT expression_id, 0 AS depth, '$n' || k AS code, 'start' AS step FROM s UNION ALL SELECT expression_id, 1, 'R::get' || r || '()', 'assignment' FROM s UNION ALL SELECT expression_id, 2, '$this->r' || r, 'return' FROM s UNION ALL SELECT expression_id, 3, CASE WHEN r < 2 THEN '$_GET[''r'']' ELSE '1' END, 'property' FROM s)"""


@query("symbolic_steps", f"WITH {_STEPS} SELECT * FROM x")
def symbolic_steps(spark, d):
    return _symbolic_steps(spark, d).select("expression_id", "depth", "code", "step")


@query("symbolic_sources", f"WITH {_STEPS} SELECT expression_id, 'http_get' AS source_type, code FROM x WHERE contains(code, '$_GET')")
def symbolic_sources(spark, d):
    return symbolic.ultimate_sources(_symbolic_steps(spark, d))


@query("symbolic_mermaid", f"WITH {_STEPS}, y AS (SELECT *, lag(code) OVER (PARTITION BY expression_id ORDER BY depth) AS before FROM x) SELECT '    s' || expression_id || '_' || depth || '[\"' || before || '\"] -->|' || step || '| s' || expression_id || '_' || (depth + 1) || '[\"' || code || '\"]' AS line FROM y WHERE depth > 0")
def symbolic_mermaid(spark, d):
    return symbolic.mermaid(_symbolic_steps(spark, d)).select("line")


@query("expression_parts", "SELECT CAST(n_nationkey AS VARCHAR) AS expression_id, CASE n_nationkey % 3 WHEN 0 THEN 'method_call' WHEN 1 THEN 'static_call' ELSE 'superglobal' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN '$o' || n_nationkey ELSE '' END AS object, CASE n_nationkey % 3 WHEN 2 THEN '' ELSE 'm' END AS member, CASE n_nationkey % 3 WHEN 1 THEN 'C' || n_nationkey ELSE '' END AS class_name FROM nation")
def expression_parts(spark, d):
    code = F.when(F.col("n_nationkey") % 3 == 0, _text("$o", ":n_nationkey", "->m(1)")).when(F.col("n_nationkey") % 3 == 1, _text("C", ":n_nationkey", "::m()")).otherwise("$_GET['x']")
    return symbolic.parts(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("expression_id"), code.alias("expression"))).drop("expression", "variable")


# --- parsed source ---------------------------------------------------------------------------------------------------


def _files(spark, d) -> DataFrame:
    """One PHP file per nation: a source per customer in debt, an assignment over two lines per customer, a call per customer."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    first = F.when(F.col("c_acctbal") < 0, _text("$c", ":c_custkey", " = $_GET['k", ":c_custkey", "'];\n")).otherwise(_text("$c", ":c_custkey", " = 1;\n"))
    code = F.concat(first, _text("$this->d['x'] = f($c", ":c_custkey", ",\n  2); A::run($c", ":c_custkey", "); // $_GET['no']\n"))
    bodies = customer.select("c_nationkey", "c_custkey", code.alias("code")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "code"))).alias("all"))
    content = F.concat(F.lit("<?php\nnamespace App;\nclass K"), F.col("c_nationkey").cast("string"), F.lit(" extends Base implements Thing {\n  private static $p = 1;\n  protected function go($a,\n    $b): string { return $a; }\n}\n"), F.array_join(F.transform("all", lambda x: x["code"]), ""))
    return bodies.select(_text("n", ":c_nationkey", ".php").alias("file_path"), F.lit("php").alias("language"), F.length(content).cast("long").alias("size_bytes"), content.alias("content"), F.lit(None).cast("string").alias("error"))


_CODE = "c AS (SELECT c_custkey AS k, 'n' || c_nationkey || '.php' AS file_path, c_acctbal < 0 AS bad, CAST(8 + 3 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS INTEGER) AS line FROM customer)"


@query(
    "parsed_assignments",
    f"""WITH {_CODE} SELECT file_path, line, '$c' || k AS target, CASE WHEN bad THEN '$_GET[''k' || k || ''']' ELSE '1' END AS source_expr, '=' AS operator, 'variable' AS target_type, '' AS key_path FROM c
    UNION ALL SELECT file_path, line + 1, '$this->d[''x'']', 'f($c' || k || ', 2)', '=', 'array_element', 'x' FROM c UNION ALL SELECT DISTINCT file_path, 4, '$p', '1', '=', 'variable', '' FROM c""",
)
def parsed_assignments(spark, d):
    return parse.assignments(parse.facts(_files(spark, d))).select("file_path", "line", "target", "source_expr", "operator", "target_type", "key_path")


@query(
    "parsed_calls",
    f"WITH {_CODE} SELECT file_path, line + 1 AS line, 'f' AS function_name, '$c' || k || ',2' AS args, 'function' AS call_kind, '' AS receiver, '$this->d[''x'']' AS target FROM c UNION ALL SELECT file_path, line + 2, 'A::run', '$c' || k, 'static', 'A', '' FROM c",
)
def parsed_calls(spark, d):
    return parse.calls(parse.facts(_files(spark, d))).select("file_path", "line", "function_name", F.array_join("args", ",").alias("args"), "call_kind", "receiver", "target")


@query("parsed_functions", f"WITH {_CODE} SELECT DISTINCT file_path, 'go' AS name, replace(replace(file_path, 'n', 'K'), '.php', '') AS class_name, 5 AS line, 6 AS end_line, '$a,$b' AS params, false AS is_public, 'string' AS return_type FROM (SELECT replace(file_path, '.php', '.') || 'php' AS file_path FROM c)")
def parsed_functions(spark, d):
    found = parse.functions(parse.facts(_files(spark, d)))
    return found.select("file_path", "name", "class_name", "line", "end_line", F.array_join("params", ",").alias("params"), "is_public", "return_type")


@query("parsed_classes", f"WITH {_CODE} SELECT DISTINCT file_path, 'K' || replace(substr(file_path, 2), '.php', '') AS class_name, 3 AS line, 7 AS end_line, 'class' AS class_kind, 'Base,Thing' AS bases FROM c")
def parsed_classes(spark, d):
    return parse.classes(parse.facts(_files(spark, d))).select("file_path", "class_name", "line", "end_line", "class_kind", F.array_join("implements", ",").alias("bases"))


@query("parsed_properties", f"WITH {_CODE} SELECT DISTINCT file_path, 'p' AS property, false AS is_public, true AS is_static, '1' AS initial FROM c")
def parsed_properties(spark, d):
    return parse.properties(parse.facts(_files(spark, d))).select("file_path", "property", "is_public", "is_static", "initial")


@query(
    "parsed_symbols",
    f"WITH {_CODE}, f AS (SELECT file_path, count(*) AS n FROM c GROUP BY file_path) SELECT file_path, unnest(['class', 'function', 'namespace', 'property', 'variable']) AS kind, unnest([1, 1, 1, 1, n + 2]) AS n FROM f",
)
def parsed_symbols(spark, d):
    return aggregate.counts(parse.symbol_table(parse.facts(_files(spark, d))), "file_path", "kind")


@query("parsed_returns", f"WITH {_CODE} SELECT DISTINCT file_path, 6 AS line, '$a' AS expression, 'go' AS scope FROM c")
def parsed_returns(spark, d):
    return parse.returns(parse.facts(_files(spark, d))).select("file_path", "line", "expression", "scope")


@query("detected_sources", f"WITH {_CODE} SELECT file_path, line, 'http_get' AS source_type, 'k' || k AS key, '$c' || k AS variable, '$c' || k || ' = $_GET[''k' || k || ''']' AS snippet FROM c WHERE bad")
def detected_sources(spark, d):
    nodes = parse.nodes(parse.facts(_files(spark, d)))
    return detect.match_rules(nodes, catalogue.source_rules(spark)).select("file_path", "line", "source_type", "key", "variable", "snippet")


@query(
    "direct_reads",
    "SELECT n_nationkey, n_nationkey % 5 IN (0, 3) AS direct FROM nation",
)
def direct_reads(spark, d):
    codes = ["(int)$_GET['a'] . 'x'", "f($_GET['a'])", "$o->m(g($_POST[1]), 2)", "\"{$_COOKIE['c']}\" . f(1)", "$x"]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", snippets.reads_directly(code).alias("direct"))


@query(
    "traced_expressions",
    "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'http_post' END AS source_type, CASE n_nationkey % 3 WHEN 0 THEN 'framework' ELSE 'containment' END AS found_by FROM nation WHERE n_nationkey % 3 < 2",
)
def traced_expressions(spark, d):
    code = F.when(F.col("n_nationkey") % 3 == 0, _text("$request->get(", ":n_nationkey", ")")).when(F.col("n_nationkey") % 3 == 1, _text("$_POST['k", ":n_nationkey", "']")).otherwise(_text("$x", ":n_nationkey"))
    patterns = spark.createDataFrame([("php", 2, r"\$request", "second"), ("php", 1, r"request->get\(", "first"), ("go", 0, "x", "other")], "language string, position int, pattern string, source_type string")
    found = registry.trace_expression(table(spark, d, "nation").select(code.alias("expression"), F.lit("php").alias("language")), patterns)
    return found.select(F.regexp_extract("expression", r"(\d+)", 1).cast("long").alias("n_nationkey"), "source_type", "found_by")


@query("snippet_traces", "SELECT CAST(n_nationkey AS VARCHAR) AS snippet_id, '$o' || n_nationkey || '->p[''k'']' AS expression, 'http_get' AS source_type FROM nation WHERE n_nationkey % 2 = 0")
def snippet_traces(spark, d):
    n = table(spark, d, "nation")
    batch = n.select(F.col("n_nationkey").cast("string").alias("snippet_id"), _text("q($o", ":n_nationkey", "->p['k']);").alias("code"))
    sets = n.where("n_nationkey = 0").select(F.lit("a.php").alias("file_path"), F.lit(1).alias("line"), F.lit("$this->p['k']").alias("target"), F.lit("$_GET['k']").alias("source_expr"), F.lit("C").alias("class_name"))
    odd = n.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("string").alias("snippet_id"))
    functions = n.where("n_nationkey < 0").select(F.lit("a.php").alias("file_path"), F.lit(1).alias("line"), F.lit("C").alias("class_name"), F.lit("m").alias("name"), F.lit("").alias("body"))
    found, sources = symbolic.trace_snippets(batch.join(odd, "snippet_id", "left_anti"), sets, functions)
    return found.join(sources, "expression_id").select("snippet_id", "expression", "source_type")


@query(
    "scanned_tree",
    """SELECT CASE n_nationkey % 3 WHEN 2 THEN 'big' ELSE 'src' END || '/n' || n_nationkey || '.php' AS file_path, 'php' AS language, CAST(CASE n_nationkey % 3 WHEN 2 THEN 3000 ELSE 10 + length(n_name) END AS BIGINT) AS size_bytes, CASE WHEN n_nationkey % 3 <> 2 THEN '<?php // ' || n_name || chr(10) END AS content, CASE n_nationkey % 3 WHEN 2 THEN 'file too large' END AS error FROM nation""",
)
def scanned_tree(spark, d):
    """A tree of 25 files beside pruned and unknown ones, written to the shared folder and scanned."""
    root = f"{shared_folder(spark)}/tributary-tree-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm

    def put(name: str, body: str) -> None:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(body.encode())
        out.close()

    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        k = r["n_nationkey"]
        put(f"{'big' if k % 3 == 2 else 'src'}/n{k}.php", "x" * 3000 if k % 3 == 2 else f"<?php // {r['n_name']}\n")
        put(f"vendor/n{k}.php", "no")
        put(f"src/n{k}.txt", "no")
    return scans.scan(spark, root, max_bytes=2000)


_CODE_OF = [
    ("php", "$x = $request->bearerToken('k')", "http_header", "k"), ("javascript", "const x = ctx.ips", "http_header", ""), ("python", "a = parser.parse_known_args()", "cli_arg", ""), ("go", 'x := chi.URLParam(r, "k")', "http_path", ""),
    ("java", 'String x = request.getPart("k")', "http_file", "k"), ("ruby", "x = request.raw_post", "http_body", ""), ("rust", "fn f(q: web::Bytes) {", "http_body", ""), ("c_sharp", 'var x = Environment.GetCommandLineArgs()', "cli_arg", ""),
]


@query(
    "framework_sources",
    "SELECT n_nationkey, CASE n_nationkey % 8 "
    + " ".join(f"WHEN {k} THEN '{c[2]}'" for k, c in enumerate(_CODE_OF))
    + " END AS source_type, CASE n_nationkey % 8 "
    + " ".join(f"WHEN {k} THEN '{c[3]}'" for k, c in enumerate(_CODE_OF))
    + " END AS key FROM nation",
)
def framework_sources(spark, d):
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in _CODE_OF)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file_path"), F.lit(1).alias("line"), pick(0).alias("language"), F.lit("statement").alias("node_type"), pick(1).alias("text"), F.lit("x").alias("variable"))
    found = detect.match_rules(nodes, catalogue.source_rules(spark))
    return found.select(F.col("file_path").cast("long").alias("n_nationkey"), "source_type", "key").distinct()


def _trace(spark, d) -> trace.Trace:
    return trace.trace_files(spark, _files(spark, d), trace.Config(max_depth=4))


@query(
    "whole_trace",
    f"WITH {_CODE} SELECT file_path, 1::BIGINT AS files, count(*) FILTER (bad) AS sources, CAST(count(*) FILTER (bad) * 2 AS BIGINT) AS variables, CAST(CASE WHEN count(*) FILTER (bad) > 0 THEN 2 ELSE 0 END AS BIGINT) AS functions FROM c GROUP BY file_path",
)
def whole_trace(spark, d):
    t = _trace(spark, d)
    return aggregate.tagged_counts("file_path", files=t.files, sources=t.sources, variables=t.tainted, functions=t.functions)


@query(
    "trace_paths",
    f"WITH {_CODE}, b AS (SELECT * FROM c WHERE bad), s AS (SELECT file_path || ':' || line || ':http_get:k' || k AS source_id, '$c' || k AS v, file_path FROM b) SELECT source_id, 'variable' AS kind, v AS steps FROM s UNION ALL SELECT source_id, 'variable', v || '>$this->d[''x'']' FROM s UNION ALL SELECT source_id, 'call', v || '>f[0]' FROM s UNION ALL SELECT source_id, 'call', v || '>A::run[0]' FROM s",
)
def trace_paths(spark, d):
    return _trace(spark, d).paths().select("source_id", "kind", F.array_join("steps", ">").alias("steps"))


@query(
    "trace_edges",
    f"WITH {_CODE}, b AS (SELECT *, file_path || ':' || line || ':http_get:k' || k AS s, 'var:' || file_path || ':$c' || k AS v FROM c WHERE bad) SELECT s AS src, v AS dst, 'assignment' AS type FROM b UNION ALL SELECT v, 'var:' || file_path || ':$this->d[''x'']', 'assignment' FROM b UNION ALL SELECT v, 'func:' || file_path || ':f', 'call' FROM b UNION ALL SELECT v, 'func:' || file_path || ':A::run', 'call' FROM b",
)
def trace_edges(spark, d):
    return _trace(spark, d).deep_edges()
