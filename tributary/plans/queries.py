"""The analysis operators on the driver's tables, each with the SQL that gives the same rows.

Roles: a file is a customer, supplier, page or document; a symbol a part; a call edge a foreign key; a source a qualifying
event or URL parameter; a line the order of a user's events or a line number; a scope (user_id, event_type).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.functions import text as T
from tributary.operators import aggregate, conditions, detect, graph, registry, render, scopes, search, snippets
from tributary.operators.fixpoint import iterate
from tributary.plans import code_queries, flow_queries  # noqa: F401  (they register their queries)
from tributary.plans.base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


# --- scans -----------------------------------------------------------------------------------------------------------


@query("source_detect_url", r"SELECT page_id, 'http_get' AS source_type, unnest(regexp_extract_all(url, '[?&](\w+)=', 1)) AS key FROM pages")
def source_detect_url(spark, d):
    return detect.keys_in(table(spark, d, "pages"), "page_id", "url", r"[?&](\w+)=", "http_get")


@query(
    "source_detect_script",
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages)
    SELECT page_id, 'assignment' AS kind, unnest(regexp_extract_all(body, 'var (\w+)=', 1)) AS name FROM s
    UNION ALL SELECT page_id, 'call' AS kind, unnest(regexp_extract_all(body, '(\w+)\([^)]*\);', 1)) AS name FROM s""",
)
def source_detect_script(spark, d):
    bodies = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("body"))
    found = detect.keys_in(bodies, "page_id", "body", r"var (\w+)=", "assignment").unionByName(detect.keys_in(bodies, "page_id", "body", r"(\w+)\([^)]*\);", "call"))
    return found.select("page_id", F.col("source_type").alias("kind"), F.col("key").alias("name"))


TEXT_RULES = [("license", "Licensed under"), ("digits", "[0-9]{9,}"), ("symbols", "[#%&$*]{3}"), ("table", r"\|.*\|"), ("shout", "!! ")]


@query(
    "text_rule_match",
    "SELECT doc_id, rule FROM documents JOIN (VALUES "
    + ", ".join(f"('{n}', '{p}')" for n, p in TEXT_RULES)
    + ") r(rule, pattern) ON regexp_matches(text, pattern)",
)
def text_rule_match(spark, d):
    return detect.text_rules(table(spark, d, "documents"), "doc_id", "text", TEXT_RULES)


@query("glob_to_regex", r"""SELECT page_id, regexp_matches(url, '^https?://[^/]*\.example\.com/.*$') AS com, regexp_matches(url, '^https?://(?:.*/)?[^/]*$') AS leaf FROM pages""")
def glob_to_regex(spark, d):
    pages = table(spark, d, "pages")
    com, leaf = (T.glob_pattern(g).replace("http.://", "https?://") for g in ("http?://*.example.com/**", "http?://**/*"))
    return pages.select("page_id", F.col("url").rlike(com).alias("com"), F.col("url").rlike(leaf).alias("leaf"))


@query(
    "snippet_normalise",
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\n\t]', ' ', 'g'), '\r', '', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS snippet FROM f""",
)
def snippet_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_snippet(F.col("text")).alias("snippet"))


@query(
    "props_key_extract",
    r"""SELECT event_id, regexp_extract(props, '"(\w+)"', 1) AS key, CAST(regexp_extract(props, ':\s*(\d+)', 1) AS BIGINT) AS by_pattern, CAST(json_extract_string(props, '$.k') AS BIGINT) AS by_path FROM events""",
)
def props_key_extract(spark, d):
    pattern, path = F.regexp_extract("props", r":\s*(\d+)", 1), F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", r'"(\w+)"', 1).alias("key"), pattern.cast("long").alias("by_pattern"), path.cast("long").alias("by_path"))


# --- classification --------------------------------------------------------------------------------------------------


@query(
    "condition_classify",
    r"""SELECT class, count(*) AS n FROM (SELECT CASE
      WHEN regexp_matches(text, '(?i)(isset|empty|is_null|null|\bnil\b|undefined)') THEN 'null_check'
      WHEN regexp_matches(text, '(?i)(is_string|is_int|is_array|instanceof|typeof)') THEN 'type_check'
      WHEN regexp_matches(text, '(?i)(strlen|length|count|size)\s*\(') THEN 'length_check'
      WHEN regexp_matches(text, '[<>=!]=?') THEN 'comparison'
      WHEN regexp_matches(text, '(&&|\|\||!|and|or|not)') THEN 'logical' ELSE 'unknown' END AS class
      FROM (SELECT regexp_replace(text, '[^ -~\n]', '_', 'g') AS text FROM documents)) GROUP BY class""",
)
def condition_classify(spark, d):
    # Word boundaries next to non-ASCII letters differ between engines, so those letters become underscores.
    plain = F.regexp_replace("text", r"[^ -~\n]", "_")
    return aggregate.counts(table(spark, d, "documents").select(conditions.condition_class(plain).alias("class")), "class")


@query(
    "expr_classify",
    r"""SELECT kind, count(*) AS n FROM (SELECT CASE
      WHEN regexp_matches(text, '^[A-Z]+!!') THEN 'shout' WHEN regexp_matches(text, '^[^ ]+ \|') THEN 'table'
      WHEN regexp_matches(text, '^[^ ]+[#%&$*]{3}') THEN 'marked' WHEN regexp_matches(text, '^[A-Z][a-z]* [a-z]') THEN 'sentence'
      ELSE 'unknown' END AS kind FROM documents) GROUP BY kind""",
)
def expr_classify(spark, d):
    kinds = [("shout", r"^[A-Z]+!!"), ("table", r"^[^ ]+ \|"), ("marked", r"^[^ ]+[#%&$*]{3}"), ("sentence", r"^[A-Z][a-z]* [a-z]")]
    kind = F.lit("unknown")
    for name, pattern in reversed(kinds):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    return aggregate.counts(table(spark, d, "documents").select(kind.alias("kind")), "kind")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("sources_by_type", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def sources_by_type(spark, d):
    return aggregate.counts(table(spark, d, "documents"), "source")


@query("sources_by_language", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def sources_by_language(spark, d):
    return aggregate.counts(table(spark, d, "documents"), "lang")


@query("depth_hist", "SELECT event_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS BIGINT) AS depth, count(*) AS n FROM events GROUP BY ALL")
def depth_hist(spark, d):
    depth = (F.get_json_object("props", "$.k").cast("long") % 5).alias("depth")
    return aggregate.counts(table(spark, d, "events").select("event_type", depth), "event_type", "depth")


_THREE = """SELECT n_nationkey, CAST(sum(customers) AS BIGINT) AS customers, CAST(sum(suppliers) AS BIGINT) AS suppliers, CAST(sum(lines) AS BIGINT) AS lines FROM (
  SELECT c_nationkey AS n_nationkey, 1 AS customers, 0 AS suppliers, 0 AS lines FROM customer
  UNION ALL SELECT s_nationkey, 0, 1, 0 FROM supplier
  UNION ALL SELECT s_nationkey, 0, 0, 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY n_nationkey"""


@query("three_way_file_stats", _THREE)
def three_way_file_stats(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    customer = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    # Lines are counted per supplier before the join: the join sees one row per supplier.
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).groupBy("n_nationkey").agg(F.sum("n").alias("lines"))
    both = aggregate.tagged_counts("n_nationkey", customers=customer, suppliers=supplier.select("n_nationkey"))
    lines = lines.select("n_nationkey", F.lit(0).cast("long").alias("customers"), F.lit(0).cast("long").alias("suppliers"), "lines")
    out = both.withColumn("lines", F.lit(0).cast("long")).unionByName(lines)
    return out.groupBy("n_nationkey").agg(*(F.sum(c).alias(c) for c in ("customers", "suppliers", "lines")))


@query("top_tainted_files", f"SELECT n_nationkey, customers + suppliers + lines AS score FROM ({_THREE}) ORDER BY score DESC, n_nationkey LIMIT 10")
def top_tainted_files(spark, d):
    stats = three_way_file_stats(spark, d)
    return aggregate.top(stats.select("n_nationkey", (F.col("customers") + F.col("suppliers") + F.col("lines")).alias("score")), "score", "n_nationkey")


@query("carrier_group", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n_types FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type FROM events) GROUP BY user_id")
def carrier_group(spark, d):
    return aggregate.distinct_types(table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type"), "user_id", "event_type")


@query(
    "dedupe_min_depth",
    "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def dedupe_min_depth(spark, d):
    return aggregate.least_by(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"])


@query(
    "run_stats",
    "SELECT 'files' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'symbols', count(*) FROM part UNION ALL SELECT 'calls', count(*) FROM lineitem",
)
def run_stats(spark, d):
    return aggregate.run_statistics(files=table(spark, d, "documents"), symbols=table(spark, d, "part"), calls=table(spark, d, "lineitem"))


@query(
    "carrier_stats",
    "SELECT source_type, count(*) AS n_uses, count(DISTINCT user_id) AS n_classes FROM (SELECT user_id, event_type AS source_type FROM events) GROUP BY source_type",
)
def carrier_stats(spark, d):
    # Two levels: (type, user) first, so that the distinct count needs no list of users in one task.
    pairs = table(spark, d, "events").groupBy(F.col("event_type").alias("source_type"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("source_type").agg(F.sum("n").alias("n_uses"), F.count("user_id").alias("n_classes"))


# --- symbol search ---------------------------------------------------------------------------------------------------


def _symbols(spark, d):
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), F.col("p_type").alias("type"),
        F.split("p_type", " ").alias("parameters"), F.lit("sql").alias("language"), F.lit("").alias("return_type"), F.lit("part").alias("file_path"),
    )


def _found(rows):
    return rows.select(F.col("seq").alias("p_partkey"), "score", "matched_by")


_NAME = "(SELECT min(p_name) FROM part)"


@query("symbol_search_exact", f"SELECT p_partkey, 100.0::DOUBLE AS score, 'exact_name' AS matched_by FROM part WHERE p_name = {_NAME}")
def symbol_search_exact(spark, d):
    symbols = _symbols(spark, d)
    name = symbols.agg(F.min("name")).first()[0]
    return _found(search.search(symbols, search.Query(name=name)))


@query("symbol_search_regex", "SELECT p_partkey, 75.0::DOUBLE AS score, 'name_pattern' AS matched_by FROM part WHERE regexp_matches(p_name, '^[a-f]')")
def symbol_search_regex(spark, d):
    return _found(search.search(_symbols(spark, d), search.Query(name_pattern="^[a-f]")))


@query("symbol_search_filter", "SELECT p_partkey, 10.0::DOUBLE AS score, 'filter' AS matched_by FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def symbol_search_filter(spark, d):
    symbols = _symbols(spark, d)
    brand = symbols.agg(F.min("class_name")).first()[0]
    return _found(search.search(symbols, search.Query(class_name=brand)))


@query(
    "symbol_search_limit",
    "SELECT p_partkey, score, matched_by FROM (SELECT p_partkey, (75 + CASE WHEN list_contains(string_split(p_type, ' '), (SELECT min(string_split(p_type, ' ')[1]) FROM part)) THEN 30 ELSE 0 END)::DOUBLE AS score, 'name_pattern' AS matched_by FROM part WHERE regexp_matches(p_name, 'e')) ORDER BY score DESC, p_partkey LIMIT 25",
)
def symbol_search_limit(spark, d):
    symbols = _symbols(spark, d)
    word = symbols.agg(F.min(F.element_at("parameters", 1))).first()[0]
    return _found(search.search(symbols, search.Query(name_pattern="e", has_parameter=word, limit=25)))


@query(
    "find_definition",
    """WITH d AS (SELECT * FROM part WHERE p_size >= 25)
    SELECT p.p_partkey, coalesce((SELECT min(p_partkey) FROM d WHERE d.p_name = p.p_name AND d.p_brand = p.p_brand), (SELECT min(p_partkey) FROM d WHERE d.p_name = p.p_name)) AS definition FROM part p""",
)
def find_definition(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    found = search.definitions(part.select("p_partkey", "p_name", "p_brand"), part.where("p_size >= 25"), "p_name", "p_brand", "p_partkey")
    return found.select("p_partkey", "definition")


@query("latest_symbol", "SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def latest_symbol(spark, d):
    return search.latest(_symbols(spark, d), "name").select(F.col("name").alias("p_name"), F.col("seq").alias("p_partkey"))


# --- windows ---------------------------------------------------------------------------------------------------------


@query("first_definition_per_scope", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_definition_per_scope(spark, d):
    return aggregate.least_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("shadowing_prev_def", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS shadows FROM events")
def shadowing_prev_def(spark, d):
    scope = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(scope).alias("shadows"))


@query("nesting_depth", "SELECT event_id, CAST(sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events")
def nesting_depth(spark, d):
    change = F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1)
    return conditions.running_depth(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], change).select("event_id", "depth")


@query(
    "guard_interval_join",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT g.event_id AS guard_id, e.event_id, e.r - g.r AS reach FROM o g JOIN o e ON g.user_id = e.user_id AND e.r BETWEEN g.r + 1 AND g.r + 3 WHERE g.event_type = 'error'""",
)
def guard_interval_join(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(order).cast("long").alias("r"))
    # The interval is short, so the range join becomes an equi-join on (user, line).
    guards = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("guard_id"), F.col("r").alias("at"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))).alias("reach"))
    guards = guards.withColumn("r", F.col("at") + F.col("reach"))
    return guards.join(rows.select("user_id", "event_id", "r"), ["user_id", "r"]).select("guard_id", "event_id", "reach")


# --- joins and sets --------------------------------------------------------------------------------------------------


@query("reachable_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def reachable_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("unreachable_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreachable_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "args_by_position",
    """WITH p AS (SELECT o_orderkey, 0 AS position, o_orderstatus AS param FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders)
    SELECT position, param, l_returnflag AS arg, count(*) AS n FROM p JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = position + 1 GROUP BY ALL""",
)
def args_by_position(spark, d):
    params = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array("o_orderstatus", "o_orderpriority")).alias("position", "param"))
    args = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_returnflag").alias("arg"))
    return aggregate.counts(params.join(args, ["o_orderkey", "position"]), "position", "param", "arg")


@query(
    "callers_callees",
    """WITH p AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'callee' AS direction, l_suppkey AS node, count(*) AS n FROM p GROUP BY l_suppkey UNION ALL SELECT 'caller', o_custkey, count(*) FROM p GROUP BY o_custkey""",
)
def callers_callees(spark, d):
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = graph.neighbours(edges.select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst")))
    return aggregate.counts(both, "direction", "node")


# --- propagation and graphs ------------------------------------------------------------------------------------------


@query(
    "taint_forward",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    p AS (SELECT event_id, r - max(CASE WHEN event_type = 'error' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS depth FROM o)
    SELECT event_id, CAST(depth AS INTEGER) AS depth FROM p WHERE depth <= 5""",
)
def taint_forward(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select("event_id", "event_type", F.lead("event_id").over(order).alias("next"))
    hops = events.where("next is not null").select("event_id", "next")
    seed = events.where("event_type = 'error'").select("event_id", F.lit(0).alias("depth"))

    def step(frontier, depth):
        return frontier.select("event_id").join(hops, "event_id").select(F.col("next").alias("event_id"), F.lit(depth).alias("depth"))

    return iterate(seed, step, ["event_id"], 5)


_FK = """SELECT DISTINCT 'customer' AS kind, c_custkey AS key, 0 AS depth FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT DISTINCT 'order', o_orderkey, 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
  UNION ALL SELECT DISTINCT 'supplier', l_suppkey, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"""


@query("taint_fk_propagation", _FK)
def taint_fk_propagation(spark, d):
    seeds = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(seeds, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    level = lambda rows, kind, key, depth: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(depth).alias("depth")).distinct()
    return level(seeds, "customer", "c_custkey", 0).unionByName(level(orders, "order", "o_orderkey", 1)).unionByName(level(lines, "supplier", "l_suppkey", 2))


@query(
    "backward_sources",
    "SELECT DISTINCT s_suppkey, o_custkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_acctbal < 4000",
)
def backward_sources(spark, d):
    targets = table(spark, d, "supplier").where("s_acctbal < 4000").select("s_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(targets, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").distinct()
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s_suppkey"), "o_custkey").distinct()


def _node(kind, key):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _geography(spark, d, deep: bool):
    nation, customer, supplier = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    edges = nation.select(_node("region", "n_regionkey").alias("src"), _node("nation", "n_nationkey").alias("dst"))
    if deep:
        edges = edges.unionByName(customer.select(_node("nation", "c_nationkey").alias("src"), _node("customer", "c_custkey").alias("dst")))
        return edges.unionByName(table(spark, d, "orders").select(_node("customer", "o_custkey").alias("src"), _node("order", "o_orderkey").alias("dst")))
    return edges.unionByName(supplier.select(_node("nation", "s_nationkey").alias("src"), _node("supplier", "s_suppkey").alias("dst")))


@query(
    "bfs_distance",
    """WITH n AS (SELECT n_nationkey, n_regionkey = 0 AS hit FROM nation), c AS (SELECT c_custkey, hit FROM customer JOIN n ON c_nationkey = n_nationkey)
    SELECT 'region:' || r_regionkey AS node, CASE WHEN r_regionkey = 0 THEN 0 ELSE -1 END AS distance FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN hit THEN 1 ELSE -1 END FROM n
    UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN hit THEN 2 ELSE -1 END FROM c
    UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN hit THEN 3 ELSE -1 END FROM orders JOIN c ON o_custkey = c_custkey""",
)
def bfs_distance(spark, d):
    edges = _geography(spark, d, True)
    nodes = table(spark, d, "region").select(_node("region", "r_regionkey").alias("node"))
    for name, kind, key in (("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("orders", "order", "o_orderkey")):
        nodes = nodes.unionByName(table(spark, d, name).select(_node(kind, key).alias("node")))
    entry = spark.range(1).select(F.lit("region:0").alias("node"))
    return graph.distances(nodes, edges, entry, 4)


@query(
    "shortest_path",
    "SELECT 'supplier:' || s_suppkey AS node, 'region:' || n_regionkey || '>nation:' || n_nationkey || '>supplier:' || s_suppkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0",
)
def shortest_path(spark, d):
    start = spark.range(1).select(F.lit("region:0").alias("node"))
    targets = table(spark, d, "supplier").select(_node("supplier", "s_suppkey").alias("node"))
    return graph.shortest_paths(_geography(spark, d, False), start, targets, 4).select("node", F.array_join("path", ">").alias("path"))


@query(
    "all_paths",
    """SELECT 'region:' || n_regionkey || '>nation:' || n_nationkey || coalesce('>supplier:' || s_suppkey, '') AS path FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
)
def all_paths(spark, d):
    starts = table(spark, d, "region").select(_node("region", "r_regionkey").alias("node"))
    paths = graph.simple_paths(_geography(spark, d, False), starts, 4)
    return paths.where(F.size("path") > 1).select(F.array_join("path", ">").alias("path"))


_EDGES = "SELECT DISTINCT 'nation:' || s_nationkey AS src, 'supplier:' || s_suppkey AS dst, 'assignment' AS type FROM supplier UNION ALL SELECT DISTINCT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'call' FROM nation"


def _flow(spark, d):
    nodes = [
        table(spark, d, name).select(_node(kind, key).alias("node_id"), F.lit(role).alias("type"))
        for name, kind, key, role in (("region", "region", "r_regionkey", "source"), ("nation", "nation", "n_nationkey", "function"), ("supplier", "supplier", "s_suppkey", "variable"))
    ]
    nodes = graph.flow_nodes(*nodes)
    calls = table(spark, d, "nation").select(_node("region", "n_regionkey").alias("src"), _node("nation", "n_nationkey").alias("dst"), F.lit("call").alias("type"))
    sets = table(spark, d, "supplier").select(_node("nation", "s_nationkey").alias("src"), _node("supplier", "s_suppkey").alias("dst"), F.lit("assignment").alias("type"))
    return nodes, graph.flow_edges(nodes, calls, sets)


@query("flow_graph_nodes", "SELECT 'region:' || r_regionkey AS node_id, 'source' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'function' FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'variable' FROM supplier")
def flow_graph_nodes(spark, d):
    return _flow(spark, d)[0]


@query("flow_graph_edges", _EDGES)
def flow_graph_edges(spark, d):
    return _flow(spark, d)[1].select("src", "dst", "type")


# --- sinks -----------------------------------------------------------------------------------------------------------


@query(
    "dot_lines",
    f"""SELECT '  "' || replace(src, ':', '_') || '" -> "' || replace(dst, ':', '_') || '" [label="' || type || '", style=' || CASE type WHEN 'call' THEN 'dashed' ELSE 'solid' END || '];' AS line FROM ({_EDGES})""",
)
def dot_lines(spark, d):
    return render.dot_edges(_flow(spark, d)[1])


@query("mermaid_lines", f"SELECT '    ' || replace(src, ':', '_') || CASE type WHEN 'call' THEN ' -.->|call| ' ELSE ' --> ' END || replace(dst, ':', '_') AS line FROM ({_EDGES})")
def mermaid_lines(spark, d):
    return render.mermaid_edges(_flow(spark, d)[1])


@query("json_export", f"""SELECT '{{"src":"' || src || '","dst":"' || dst || '","type":"' || type || '"}}' AS json FROM ({_EDGES})""")
def json_export(spark, d):
    return render.json_lines(_flow(spark, d)[1], "src", "dst", "type")


@query(
    "snippet_expressions",
    r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(name, '^\w+\(') THEN 'function_call' ELSE 'unknown' END AS kind
    FROM (SELECT unnest(regexp_extract_all(html, '(\w+\([^)]*\));', 1)) AS name FROM pages)) GROUP BY kind""",
)
def snippet_expressions(spark, d):
    calls = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"(\w+\([^)]*\));"), F.lit(1))).alias("name"))
    return aggregate.counts(calls.select(snippets.expression_kind(F.col("name")).alias("kind")), "kind")


# --- registry, scopes and further windows ----------------------------------------------------------------------------

PATTERNS = [(0, 1, "ECONOMY BRASS", "exact"), (1, 2, "^PROMO", "framework"), (2, 3, "BRASS$", "language"), (3, 4, "^[A-Z]", "general")]


@query(
    "registry_priority",
    "SELECT expression, source_type, level FROM (SELECT expression, source_type, CAST(level AS INTEGER) AS level, row_number() OVER (PARTITION BY expression ORDER BY level, seq) AS r FROM (SELECT DISTINCT p_type AS expression FROM part WHERE NOT regexp_matches(p_type, 'STEEL$')) JOIN (VALUES "
    + ", ".join(f"({a}, {b}, '{c}', '{d_}')" for a, b, c, d_ in PATTERNS)
    + ") p(level, seq, pattern, source_type) ON (level = 0 AND expression = pattern) OR (level > 0 AND regexp_matches(expression, pattern))) WHERE r = 1",
)
def registry_priority(spark, d):
    patterns = spark.createDataFrame(PATTERNS, "level int, seq int, pattern string, source_type string")
    excluded = spark.createDataFrame([("STEEL$",)], "not_input string")
    found = registry.match_registry(table(spark, d, "part").select(F.col("p_type").alias("expression")), patterns, excluded)
    return found.select("expression", "source_type", "level")


@query(
    "name_types",
    r"""SELECT kind, count(*) AS n FROM (SELECT CASE """
    + " ".join(f"WHEN contains(lower(key), '{part}') THEN '{kind}'" for part, kind in registry.NAME_TYPES)
    + r""" ELSE 'user_input' END AS kind FROM (SELECT unnest(regexp_extract_all(url, '[?&](\w+)=', 1)) AS key FROM pages UNION ALL SELECT event_type FROM events UNION ALL SELECT p_name FROM part)) GROUP BY kind""",
)
def name_types(spark, d):
    keys = detect.keys_in(table(spark, d, "pages"), "page_id", "url", r"[?&](\w+)=", "http_get").select("key")
    keys = keys.union(table(spark, d, "events").select("event_type")).union(table(spark, d, "part").select("p_name"))
    return aggregate.counts(keys.select(registry.type_of_name(F.col("key")).alias("kind")), "kind")


@query(
    "mapping_merge",
    """SELECT name, CASE WHEN bool_or(s) THEN 'supplier' ELSE 'customer' END AS source_type FROM (SELECT c_name AS name, false AS s FROM customer UNION ALL SELECT s_name, true FROM supplier) GROUP BY name""",
)
def mapping_merge(spark, d):
    row = lambda t, c, kind: table(spark, d, t).select(F.lit("sql").alias("language"), F.lit("name").alias("kind"), F.col(c).alias("name"), F.lit(kind).alias("source_type"))
    return registry.merged(row("customer", "c_name", "customer"), row("supplier", "s_name", "supplier")).select("name", "source_type")


@query(
    "scope_closure",
    """WITH c AS (SELECT 'customer:' || c_custkey AS s0, 'nation:' || n_nationkey AS s1, 'region:' || n_regionkey AS s2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
    n AS (SELECT 'nation:' || n_nationkey AS s1, 'region:' || n_regionkey AS s2 FROM nation)
    SELECT s0 AS scope, s0 AS ancestor, 0 AS distance FROM c UNION ALL SELECT s0, s1, 1 FROM c UNION ALL SELECT s0, s2, 2 FROM c
    UNION ALL SELECT s1, s1, 0 FROM n UNION ALL SELECT s1, s2, 1 FROM n UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region""",
)
def scope_closure(spark, d):
    none = F.lit(None).cast("string").alias("parent")
    tree = table(spark, d, "region").select(_node("region", "r_regionkey").alias("scope"), none)
    tree = tree.unionByName(table(spark, d, "nation").select(_node("nation", "n_nationkey").alias("scope"), _node("region", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, d, "customer").select(_node("customer", "c_custkey").alias("scope"), _node("nation", "c_nationkey").alias("parent")))
    return scopes.closure(tree)


@query(
    "nearest_hint",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT e.event_id, max_by(h.event_id, h.r) AS hint_id FROM o e JOIN o h ON e.user_id = h.user_id AND h.r BETWEEN e.r - 5 AND e.r - 1 AND h.event_type = 'signup' WHERE e.event_type = 'purchase' GROUP BY e.event_id""",
)
def nearest_hint(spark, d):
    # The nearest hint at most five lines above: a bounded frame over each file's lines, no join.
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    above = order.rowsBetween(-5, -1)
    hint = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(above)
    return table(spark, d, "events").withColumn("hint_id", hint).where("event_type = 'purchase' and hint_id is not null").select("event_id", "hint_id")


@query("graph_caps", f"SELECT src, dst, type FROM ({_EDGES}) ORDER BY src, dst LIMIT 20")
def graph_caps(spark, d):
    return graph.capped(_flow(spark, d)[1].select("src", "dst", "type"), ["src", "dst"], 20)


@query(
    "path_depth",
    """SELECT user_id, CAST(max(depth) AS BIGINT) AS max_depth FROM (SELECT user_id, sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events) GROUP BY user_id""",
)
def path_depth(spark, d):
    change = F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1)
    return conditions.running_depth(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], change).groupBy("user_id").agg(F.max("depth").alias("max_depth"))


@query("index_stats", "SELECT p_type AS type, count(*) AS total FROM part GROUP BY p_type")
def index_stats(spark, d):
    return search.statistics(_symbols(spark, d))


@query(
    "call_graph_stats",
    f"SELECT 'nodes' AS metric, count(*) AS value FROM (SELECT src FROM ({_EDGES}) UNION SELECT dst FROM ({_EDGES})) UNION ALL SELECT 'edges', count(*) FROM ({_EDGES}) UNION ALL SELECT 'entries', count(*) FROM (SELECT DISTINCT src FROM ({_EDGES}) WHERE src NOT IN (SELECT dst FROM ({_EDGES})))",
)
def call_graph_stats(spark, d):
    edges = _flow(spark, d)[1]
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    entries = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti")
    return aggregate.run_statistics(nodes=nodes, edges=edges, entries=entries)


@query(
    "argument_lists",
    "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS types, count(DISTINCT o_orderstatus) AS n_types FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders) GROUP BY o_custkey",
)
def argument_lists(spark, d):
    return aggregate.distinct_types(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus"), "o_custkey", "o_orderstatus")


@query(
    "tainted_arguments",
    """SELECT l_orderkey, min(l_linenumber) AS arg_index, count(*) AS n_args FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 4000 GROUP BY l_orderkey""",
)
def tainted_arguments(spark, d):
    bad = table(spark, d, "supplier").where("s_acctbal < 4000").select("s_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(bad, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("arg_index"), F.count(F.lit(1)).alias("n_args"))
