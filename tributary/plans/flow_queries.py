"""Queries that run the flow across scopes, calls and classes, and the parser on several languages, each with the SQL for the same rows.

Roles: a customer in debt is a source, in the function f<key> of its nation's file; all functions call their variables by the same
few names. An order is an assignment there, a line a call of a supplier's function, which calls one of its nation's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import detect, flow, search, taint
from tributary.operators.fixpoint import shared_folder
from tributary.plans.base import query, table
from tributary.plans.code_queries import _text
from tributary.rules import catalogue
from tributary.rules.local import small_table
from tributary.sources import parse
from tributary.sources.fact_store import FactStore

_BAD = "bad AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_acctbal < 0)"


def _bad(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_nationkey")


def _row(rows: DataFrame, file, scope, **more) -> DataFrame:
    """Columns that all relations of facts have."""
    return rows.select(file.alias("file_path"), F.lit("php").alias("language"), F.lit("").alias("class_name"), scope.alias("scope"), *(v.alias(k) for k, v in more.items()))


def _relations(spark, d):
    """Sources, assignments, calls and functions; $x is a variable of every function."""
    bad, supplier, nation = _bad(spark, d), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey")
    file, scope = _text("n", ":c_nationkey", ".php"), _text("f", ":c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(bad, F.col("o_custkey") == F.col("c_custkey"))
    name = _text("$y", F.pmod("o_orderkey", F.lit(5)).cast("string"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lib, own = _text("lib", ":s_nationkey", ".php"), _text("s", ":s_suppkey")
    sources = _row(bad, file, scope, target=F.lit("$x"), seq=F.lit(-1).cast("long"), source_id=_text("src:", ":c_custkey"))
    assigned = _row(orders, file, scope, seq=F.col("o_orderkey").cast("long"), target=name, source_expr=F.lit("f($x, 1)"))
    assigned = assigned.unionByName(_row(supplier, lib, own, seq=F.lit(1).cast("long"), target=F.lit("$x"), source_expr=F.lit("trim($p)")))
    calls = _row(lines, file, scope, seq=F.lit(1 << 40) + F.col("l_orderkey") * 10 + F.col("l_linenumber"), function_name=_text("s", ":l_suppkey"), args=F.array(F.lit("1"), name), target=F.lit(""))
    calls = calls.unionByName(_row(supplier, lib, own, seq=F.lit(2).cast("long"), function_name=_text("t", ":s_nationkey"), args=F.array(F.lit("$x")), target=F.lit("")))
    line = F.lit(1).alias("line")
    functions = supplier.select(lib.alias("file_path"), F.lit("").alias("class_name"), own.alias("name"), line, F.array(F.lit("$a"), F.lit("$p")).alias("params"))
    functions = functions.unionByName(nation.select(F.lit("top.php").alias("file_path"), F.lit("").alias("class_name"), _text("t", ":n_nationkey").alias("name"), line, F.array(F.lit("$x")).alias("params")))
    return sources, assigned, calls, functions


def _seeds(sources: DataFrame) -> DataFrame:
    return flow.targets(sources, None).select(F.col("to_file").alias("file_path"), F.col("to_home").alias("home"), F.col("to_name").alias("name"), "source_id", "label", "since")


@query(
    "scoped_flow",
    f"""WITH RECURSIVE {_BAD}, o AS (SELECT o_orderkey, c, n FROM orders JOIN bad ON o_custkey = c),
    e AS (SELECT 'n' || n || '.php' AS f, 'f' || c AS s, '$x' AS v, 'n' || n || '.php' AS f2, 'f' || c AS s2, '$y' || (o_orderkey % 5) AS v2 FROM o
      UNION SELECT 'n' || n || '.php', 'f' || c, '$y' || (o_orderkey % 5), 'lib' || s_nationkey || '.php', 's' || s_suppkey, '$p' FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
      UNION SELECT 'lib' || s_nationkey || '.php', 's' || s_suppkey, '$p', 'lib' || s_nationkey || '.php', 's' || s_suppkey, '$x' FROM supplier
      UNION SELECT 'lib' || s_nationkey || '.php', 's' || s_suppkey, '$x', 'top.php', 't' || s_nationkey, '$x' FROM supplier),
    r AS (SELECT 'n' || n || '.php' AS f, 'f' || c AS s, '$x' AS v, c, 0 AS depth FROM bad UNION SELECT f2, s2, v2, c, depth + 1 FROM r JOIN e USING (f, s, v))
    SELECT f AS file_path, s AS scope, v AS variable, min(depth) AS depth, count(DISTINCT c) AS n_sources FROM r GROUP BY ALL""",
)
def scoped_flow(spark, d):
    sources, assigned, calls, functions = _relations(spark, d)
    sites = flow.argument_sites(taint.resolve(calls, functions))
    returns = flow.return_sites(_row(table(spark, d, "region").limit(0), F.lit(""), F.lit(""), seq=F.lit(1).cast("long"), expression=F.lit("")))
    back = flow.result_targets(taint.resolve(calls, functions))
    none = sites.select("callee_file", "callee_home", "position").limit(0)
    edges = flow.assign_edges(assigned).unionByName(flow.call_edges(sites, returns, back, none))
    found = flow.variables(flow.reach(_seeds(sources), edges, 6))
    return found.groupBy("file_path", "scope", "variable").agg(F.min("depth").alias("depth"), F.count_distinct("source_id").alias("n_sources"))


@query(
    "returned_input",
    f"""WITH {_BAD}, o AS (SELECT o_orderkey AS k, c, n FROM orders JOIN bad ON o_custkey = c), l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem),
    g AS (SELECT c, n, '$v' || c || '>get' || c || '()>all' || c || '()' AS p FROM bad)
    SELECT 'n' || n || '.php' AS file_path, 'get' || c AS scope, '$v' || c AS variable, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, '$v' || c AS path FROM g
    UNION ALL SELECT 'o' || k % 10 || '.php', '', '$o' || k, 3, 'all' || o.c || '()', p || '>$o' || k FROM o JOIN g USING (c)
    UNION ALL SELECT 'o' || k % 10 || '.php', '', '$l' || k || '_' || i, 4, '$o' || k, p || '>$o' || k || '>$l' || k || '_' || i FROM l JOIN o USING (k) JOIN g USING (c)""",
)
def returned_input(spark, d):
    """get<c> reads and returns input, all<c> returns what get<c> gives, an order takes all<c>()'s result, its lines copy it."""
    bad = _bad(spark, d)
    file, get, every = _text("n", ":c_nationkey", ".php"), _text("get", ":c_custkey"), _text("all", ":c_custkey")
    sources = _row(bad, file, get, target=_text("$v", ":c_custkey"), seq=F.lit(1).cast("long"), source_id=_text("src:", ":c_custkey"))
    returned = _row(bad, file, get, seq=F.lit(2).cast("long"), expression=_text("trim($v", ":c_custkey", ")")).unionByName(_row(bad, file, every, seq=F.lit(4).cast("long"), expression=F.lit("$r")))
    functions = bad.select(file.alias("file_path"), F.lit("").alias("class_name"), F.explode(F.array(get, every)).alias("name"), F.lit(1).alias("line"), F.array().cast("array<string>").alias("params"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(bad, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    user, key = _text("o", (F.col("o_orderkey") % 10).cast("string"), ".php"), F.col("o_orderkey").cast("long")
    empty = F.array().cast("array<string>")
    calls = _row(orders, user, F.lit(""), seq=key, function_name=every, args=empty, target=_text("$o", ":o_orderkey"))
    # The result of get<c> is given on by all<c>: a return that calls.
    inner = bad.select(file.alias("file_path"), F.concat(F.lit("return ::"), get).alias("home"), F.concat(get, F.lit("()")).alias("name"), F.lit(flow.ALWAYS).alias("at"), F.lit("back").alias("kind"), file.alias("to_file"), F.concat(F.lit("return ::"), every).alias("to_home"), F.concat(every, F.lit("()")).alias("to_name"), F.concat(every, F.lit("()")).alias("label"), F.lit(-1).cast("long").alias("since"))
    copies = _row(lines, user, F.lit(""), seq=F.lit(1 << 40) + F.col("l_orderkey") * 10 + F.col("l_linenumber"), target=_text("$l", ":l_orderkey", "_", ":l_linenumber"), source_expr=_text("$o", ":o_orderkey"))
    resolved = taint.resolve(calls, functions)
    sites = flow.argument_sites(resolved)
    none = sites.select("callee_file", "callee_home", "position").limit(0)
    edges = flow.assign_edges(copies).unionByName(flow.call_edges(sites, flow.return_sites(returned), flow.result_targets(resolved), none)).unionByName(inner)
    found = flow.variables(flow.paths(flow.reach(_seeds(sources), edges, 6)))
    return found.select("file_path", "scope", "variable", "depth", "parent", F.array_join("path", ">").alias("path"))


@query(
    "parameter_summaries",
    "SELECT 'lib' || s_nationkey || '.php' AS callee_file, '::' || unnest(['a', 'b', 'c']) || s_suppkey AS callee_home, 0 AS position FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'lib' || s_nationkey || '.php', '::c' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 2 = 1",
)
def parameter_summaries(spark, d):
    """a<k> returns what b<k> gives for its first parameter, b<k> what c<k> gives (for even k), c<k> the parameter itself."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    file = _text("lib", ":s_nationkey", ".php")
    name = lambda x: _text(x, ":s_suppkey")
    functions = s.select(file.alias("file_path"), F.lit("").alias("class_name"), F.explode(F.array(name("a"), name("b"), name("c"))).alias("name"), F.lit(1).alias("line"), F.array(F.lit("$p"), F.lit("$q")).alias("params")).withColumn("scope", F.col("name"))
    one = lambda scope, target: _row(s.where("s_suppkey % 2 = 0") if scope == "b" else s, file, name(scope), seq=F.lit(1).cast("long"), function_name=name(target), args=F.array(F.lit("$p"), F.lit("2")), target=F.lit("$r"))
    calls = one("a", "b").unionByName(one("b", "c"))
    ends = lambda scope, value: _row(s, file, name(scope), seq=F.lit(2).cast("long"), expression=F.lit(value))
    returned = ends("a", "$r").unionByName(ends("b", "$r")).unionByName(ends("c", "f($p)"))
    none = flow.assign_edges(_row(s.limit(0), file, name("a"), seq=F.lit(1).cast("long"), target=F.lit(""), source_expr=F.lit("")))
    return flow.parameter_summaries(functions, none, flow.argument_sites(taint.resolve(calls, functions)), flow.return_sites(returned), 6)


@query(
    "inherited_calls",
    """WITH k AS (SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'C' || c AS class_name, unnest(['$this->save', 'parent::save', 'self::load']) AS function_name, unnest([CASE WHEN c % 3 = 0 THEN 'C' || c WHEN n % 2 = 0 THEN 'N' || n ELSE 'R' || r END, CASE WHEN n % 2 = 0 THEN 'N' || n ELSE 'R' || r END, 'R' || r]) AS callee_class FROM k""",
)
def inherited_calls(spark, d):
    """A customer's class extends its nation's, that its region's; each level defines some methods."""
    customer, nation = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey")
    klass = lambda rows, own, base: rows.select(own.alias("class_name"), F.array(base).alias("implements"))
    classes = klass(customer, _text("C", ":c_custkey"), _text("App\\N", ":c_nationkey")).unionByName(klass(nation, _text("N", ":n_nationkey"), _text("R", ":n_regionkey")))
    method = lambda rows, own, name: rows.select(F.lit("m.php").alias("file_path"), own.alias("class_name"), F.lit(name).alias("name"), F.lit(1).alias("line"), F.array(F.lit("$a")).alias("params"))
    functions = method(region, _text("R", ":r_regionkey"), "save").unionByName(method(region, _text("R", ":r_regionkey"), "load"))
    functions = functions.unionByName(method(nation.where("n_nationkey % 2 = 0"), _text("N", ":n_nationkey"), "save")).unionByName(method(customer.where("c_custkey % 3 = 0"), _text("C", ":c_custkey"), "save"))
    calls = customer.select(F.lit("c.php").alias("file_path"), _text("C", ":c_custkey").alias("class_name"), F.explode(F.array(F.lit("$this->save"), F.lit("parent::save"), F.lit("self::load"))).alias("function_name"))
    return taint.resolve(calls, functions, classes).select("class_name", "function_name", "callee_class")


# --- several languages -----------------------------------------------------------------------------------------------

#: By language: a statement with two sources, and one that takes a value apart.
_TEMPLATES = [
    ("php", "<?php\n", "$v{k} = $_GET['a{k}'] . f($_POST[\"b{k}\"]);\n", "list($p{k}, $q{k}) = g($v{k});\n", "http_get", "http_post"),
    ("javascript", "", "const v{k} = req.query.a{k} + f(req.body.b{k});\n", "const [p{k}, q{k}] = g(v{k});\n", "http_get", "http_body"),
    ("python", "", "v{k} = request.args.get('a{k}') + f(request.form['b{k}'])\n", "p{k}, q{k} = g(v{k})\n", "http_get", "http_post"),
]


def _modules(spark, d) -> DataFrame:
    """A file per nation and language, two statements per customer."""
    def fill(template):
        parts = template.split("{k}")
        return F.concat(*(x for n, p in enumerate(parts) for x in ([F.col("c_custkey").cast("string")] if n else []) + [F.lit(p)]))

    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = None
    for language, head, two, apart, _, _ in _TEMPLATES:
        code = customer.select("c_nationkey", "c_custkey", F.concat(fill(two), fill(apart)).alias("code")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "code"))).alias("all"))
        content = F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["code"]), ""))
        rows = code.select(_text(f"{language}/n", ":c_nationkey").alias("file_path"), F.lit(language).alias("language"), content.alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _places(first: int) -> str:
    return f"CAST({first} + 2 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS INTEGER)"


@query(
    "statement_sources",
    " UNION ALL ".join(
        f"SELECT '{g}/n' || c_nationkey AS file_path, {_places(2 if head else 1)} AS line, unnest(['{one}', '{two}']) AS source_type, unnest(['a' || c_custkey, 'b' || c_custkey]) AS key, '{'$' if g == 'php' else ''}v' || c_custkey AS variable FROM customer"
        for g, head, _, _, one, two in _TEMPLATES
    ),
)
def statement_sources(spark, d):
    """Both sources of each statement, each with its key."""
    nodes = parse.nodes(parse.facts(_modules(spark, d)))
    return detect.match_rules(nodes, catalogue.source_rules(spark)).select("file_path", "line", "source_type", "key", "variable")


@query(
    "targets_taken_apart",
    " UNION ALL ".join(
        f"SELECT '{g}/n' || c_nationkey AS file_path, {_places(3 if head else 2)} AS line, '{'$' if g == 'php' else ''}' || unnest(['p', 'q']) || c_custkey AS target FROM customer" for g, head, *_ in _TEMPLATES
    ),
)
def targets_taken_apart(spark, d):
    found = parse.assignments(parse.facts(_modules(spark, d)))
    return found.where(F.contains("source_expr", F.lit("g("))).select("file_path", "line", "target")


_TEXT_RULES = [("license", r"\b[Ll]icen[cs]e\b"), ("copyright", r"\bcopyright\b|\bCopyright\b"), ("mail", r"\w@\w+\.\w"), ("key", r"\b(?:password|secret|token|key)\s*[:=]"), ("call", r"\b(?:phone|tel)(?:\s+number)?\b"), ("the", r"\bthe\b"), ("address", r"\d+\.\d+\.\d+\.\d+")]


@query(
    "dispatched_rules",
    "SELECT doc_id, name AS rule FROM documents, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _TEXT_RULES) + ") r(name, pattern) WHERE regexp_matches(text, pattern)",
)
def dispatched_rules(spark, d):
    """Rules found by the words that they need; the SQL tries every rule on every text."""
    rules = small_table(spark, [{"language": "text", "name": n, "pattern": p} for n, p in _TEXT_RULES], "language string, name string, pattern string")
    rows = table(spark, d, "documents").select("doc_id", F.lit("text").alias("language"), "text")
    return detect.dispatched(rows, rules).select("doc_id", F.col("name").alias("rule"))


_PATTERN = "^[a-z]+(?:tion|ment)(?:s|al)?$|ouer|^the[a-z]*re"


@query(
    "symbol_search_trigrams",
    f"""WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS name FROM documents)
    SELECT name, source, CAST(min(doc_id) AS BIGINT) AS doc_id, CAST(75 AS DOUBLE) AS score FROM w WHERE regexp_matches(name, '{_PATTERN}') GROUP BY name, source""",
)
def symbol_search_trigrams(spark, d):
    """The words of all documents as symbols of their source, searched by the trigrams that the pattern needs."""
    words = table(spark, d, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("name"))
    symbols = words.groupBy("name", "source").agg(F.min("doc_id").cast("long").alias("seq"))
    found = search.search(symbols, search.Query(name_pattern=_PATTERN), search.trigrams(symbols))
    return found.select("name", "source", F.col("seq").alias("doc_id"), "score")


@query(
    "kept_facts",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS k, o_orderstatus AS s, o_custkey % 5 = 0 AS gone FROM orders)
    SELECT 'o' || o_orderkey || '.php' AS file_path, CASE WHEN gone THEN 'removed' WHEN s = 'F' THEN 'changed' END AS change, CASE WHEN gone THEN NULL WHEN s = 'F' THEN '$b' ELSE '$a' END AS target, CAST(NOT gone AS BIGINT) AS n_assignments,
      (SELECT count(DISTINCT k) + (SELECT count(DISTINCT k) FROM o WHERE s = 'F' AND NOT gone) FROM o) AS n_parsed FROM o""",
)
def kept_facts(spark, d):
    """Two scans of a tree with a file per order: the second parses each text that is new to the store once and no other."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    code = lambda name: F.concat(F.lit(f"<?php\n${name} = '"), F.col("o_orderpriority"), F.lit("';\n"))
    tree = lambda rows, text: rows.select(_text("o", ":o_orderkey", ".php").alias("file_path"), F.lit("php").alias("language"), text.alias("content"))
    store = FactStore(spark, f"{shared_folder(spark)}/tributary-facts/{uuid.uuid4().hex}")
    store.update(tree(orders, code("a")))
    version = store.update(tree(orders.where("o_custkey % 5 <> 0"), F.when(F.col("o_orderstatus") == "F", code("b")).otherwise(code("a"))))
    found = parse.assignments(store.facts(version)).groupBy("file_path").agg(F.max("target").alias("target"), F.count(F.lit(1)).alias("n_assignments"))
    parsed = store.parsed().agg(F.count(F.lit(1)).alias("n_parsed"))
    rows = tree(orders, F.lit("")).select("file_path").join(store.changes(version), "file_path", "left").join(found, "file_path", "left")
    return rows.join(F.broadcast(parsed)).select("file_path", "change", "target", F.coalesce("n_assignments", F.lit(0).cast("long")).alias("n_assignments"), "n_parsed")
