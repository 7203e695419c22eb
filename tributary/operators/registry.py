"""Pattern registry: matching by priority, universal predicates, inference of source types from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.detect import blocks, by_priority, candidates, over_blocks
from tributary.operators.snippets import SUPERGLOBALS, superglobal_type
from tributary.rules.catalogue import SOURCE_TYPES

#: Names that tell an input method, an input property, an object that carries input, methods that never do, and methods that do
#: on such an object only. Fixed values.
INPUT_METHOD = r"(?i)^(get_?)?(input|var|variable|query_?params?|parsed_?body|cookie_?params?|server_?params?|uploaded_?files?|headers?|all)$|^(get_?)?(post|cookie|param)s?$"
INPUT_PROPERTY = r"(?i)^(input|request|params?|query|cookies?|headers?|body|data|args?|post|get|files?|server|attributes?|payload)s?$"
INPUT_OBJECT = r"(?i)(request|input|req|params?|http|ctx|context|getRequest\(\)|getApplication\(\))"
EXCLUDED_METHOD = r"(?i)^(getData|getBody|getContent|fetch|find|load|read)$"
CONTEXT_METHOD = r"(?i)^(get_?)?(val|text|int|bool|array|raw_?val|check)$"
#: Parts of names and what they read, in the order in which they are tried. Fixed values.
NAME_TYPES = [
    ("cookie", "http_cookie"), ("header", "http_header"), ("server", "http_header"), ("post", "http_post"), ("body", "http_post"),
    ("parsed", "http_post"), ("query", "http_get"), ("file", "http_body"), ("upload", "http_body"), ("get", "http_get"),
]
#: Keys of PHP's server table that a client sets, by the type of what they hold, and keys that the server sets. Fixed values.
CLIENT_KEYS = {
    "http_path": "PHP_SELF REQUEST_URI PATH_INFO ORIG_PATH_INFO",
    "http_get": "QUERY_STRING",
    "http_cookie": "HTTP_COOKIE",
    "network": "REMOTE_ADDR REMOTE_HOST REMOTE_PORT",
    "http_header": "REQUEST_METHOD CONTENT_TYPE CONTENT_LENGTH PHP_AUTH_USER PHP_AUTH_PW PHP_AUTH_DIGEST AUTH_TYPE HTTP_HOST HTTP_USER_AGENT HTTP_ACCEPT HTTP_ACCEPT_LANGUAGE HTTP_ACCEPT_ENCODING "
    "HTTP_ACCEPT_CHARSET HTTP_CONNECTION HTTP_REFERER HTTP_AUTHORIZATION HTTP_CACHE_CONTROL HTTP_PRAGMA HTTP_IF_MODIFIED_SINCE HTTP_IF_NONE_MATCH HTTP_X_FORWARDED_FOR HTTP_X_FORWARDED_HOST "
    "HTTP_X_FORWARDED_PROTO HTTP_X_REQUESTED_WITH HTTP_X_REAL_IP HTTP_ORIGIN",
}
SERVER_KEYS = "DOCUMENT_ROOT SCRIPT_FILENAME SCRIPT_NAME SERVER_ADDR SERVER_NAME SERVER_PORT SERVER_PROTOCOL SERVER_SOFTWARE SERVER_ADMIN GATEWAY_INTERFACE REQUEST_TIME REQUEST_TIME_FLOAT"
#: PHP functions by what they bring in, in the order in which they are tried, with the trust in that reading. Fixed values.
FUNCTIONS = {
    "curl": "curl_exec curl_multi_getcontent curl_multi_exec",
    "network": "curl_exec curl_multi_getcontent curl_multi_exec file_get_contents fopen fsockopen pfsockopen http_get http_post http_request socket_read socket_recv socket_recvfrom stream_socket_recvfrom stream_get_contents",
    "deserialise": "unserialize json_decode simplexml_load_string simplexml_load_file yaml_parse yaml_parse_file yaml_parse_url msgpack_unpack igbinary_unserialize parse_str mb_parse_str",
    "input": "file_get_contents fgets fread fgetc fgetss fgetcsv file readfile stream_get_contents getenv getallheaders apache_request_headers readline fscanf fpassthru",
}
TRUST = {"curl": ("network", 0.80), "network": ("network", 0.75), "deserialise": ("user_input", 0.85), "input": (None, 0.90)}
#: Source types of input functions; others read files. Fixed values.
INPUT_TYPES = {"getenv": "env_var", "getallheaders": "http_header", "apache_request_headers": "http_header", "readline": "stdin"}
#: Methods that fetch from a database and those that query one; parts of names of result objects. Fixed values.
FETCH_METHODS = "fetch fetchAll fetchColumn fetchObject fetch_array fetch_assoc fetch_row fetch_object fetch_all"
QUERY_METHODS = "query exec prepare execute real_query multi_query send_query real_escape_string"
RESULT_OBJECTS = "result stmt statement query res row rows"


def match_registry(expressions: DataFrame, patterns: DataFrame, excluded: DataFrame) -> DataFrame:
    """(expression, source_type, key, level): the best pattern of each expression, none for excluded ones.

    patterns: level (0 exact, 1 framework, 2 language, 3 general), seq, pattern, source_type. Exact ones are an equi-join;
    the others and the exclusions are rule tables, joined in blocks.
    """
    bare = expressions.select("expression").distinct()
    for block in blocks(excluded):
        bare = bare.join(block, F.regexp_like("expression", F.col("not_input")), "left_anti")
    exact = bare.join(patterns.where("level = 0"), F.col("expression") == F.col("pattern"))
    hits = exact.unionByName(over_blocks(patterns.where("level > 0"), lambda p: bare.join(p, F.regexp_like("expression", F.col("pattern")))))
    key = F.coalesce(F.nullif(F.regexp_extract("expression", r"""['"](\w+)['"]""", 1), F.lit("")), F.lit(""))
    return by_priority(hits.select("expression", "level", "seq", "source_type", key.alias("key")), ["expression"], ["level", "seq"]).drop("seq")


def match_members(members: DataFrame, patterns: DataFrame, excluded: DataFrame) -> DataFrame:
    """(object, member, is_method, source_type): the registry's match of object.member, else what the names alone tell.

    By names, an input method that isn't excluded counts on an object that looks like input or without an object, an input
    property on such an object. Members that neither tells have no row.
    """
    rows = members.select("object", "member", "is_method").distinct()
    expression = F.when(F.col("object") == "", F.col("member")).otherwise(F.concat_ws(".", "object", "member"))
    rows = rows.withColumn("expression", F.when(F.col("is_method"), expression).otherwise(F.concat_ws(".", "object", "member")))
    found = match_registry(rows, patterns, excluded).select("expression", F.col("source_type").alias("registered"))
    known = F.col("object").rlike(INPUT_OBJECT)
    named = F.when(F.col("is_method"), is_input_method(F.col("member")) & (known | (F.col("object") == ""))).otherwise(F.col("member").rlike(INPUT_PROPERTY) & known)
    out = rows.join(found, "expression", "left").withColumn("source_type", F.coalesce("registered", F.when(named, "user_input")))
    return out.where("source_type is not null").select("object", "member", "is_method", "source_type")


def trace_expression(expressions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(expression, language, source_type, found_by): the first framework pattern of the language that the expression matches, else
    the superglobal that it holds; expressions without either have no row. patterns: language, position, pattern, source_type."""
    rows = expressions.select("expression", "language").distinct()
    hits = over_blocks(patterns, lambda p: candidates(rows, patterns, "expression").join(p, "language").where(F.regexp_like("expression", F.col("pattern"))))
    first = by_priority(hits.select("expression", "language", "position", "source_type"), ["expression", "language"], ["position"])
    out = rows.join(first, ["expression", "language"], "left").withColumn("contained", superglobal_type(F.col("expression")))
    found = F.when(F.col("source_type").isNotNull(), "framework").otherwise("containment")
    return out.select("expression", "language", F.coalesce("source_type", "contained").alias("source_type"), found.alias("found_by")).where("source_type is not null")


def is_input_method(name: Column) -> Column:
    return name.rlike(INPUT_METHOD) & ~name.rlike(EXCLUDED_METHOD)


def carries_input(obj: Column, member: Column) -> Column:
    """An object that looks like input, and a method or property of it that does, too."""
    return obj.rlike(INPUT_OBJECT) & (member.rlike(INPUT_PROPERTY) | is_input_method(member)) & ~member.rlike(EXCLUDED_METHOD)


def matches_carrier(obj: Column, member: Column, is_method: Column) -> Column:
    """The looser test: an object that looks like input, or an input method or property of any object."""
    return obj.rlike(INPUT_OBJECT) | F.when(is_method, is_input_method(member)).otherwise(member.rlike(INPUT_PROPERTY))


def input_methods_of(members: DataFrame, table: DataFrame) -> DataFrame:
    """members (receiver, method) with category and source_type of the method table (the receiver's own entry, else that of any
    receiver), is_input (an own entry, or a general one of category http) and is_interesting (a general file or command one)."""
    own = table.where("receiver <> '*'").select("receiver", "method", F.col("category").alias("own_category"), F.col("source_type").alias("own_type"))
    general = table.where("receiver = '*'").select("method", F.col("category").alias("any_category"), F.col("source_type").alias("any_type"))
    out = members.join(F.broadcast(own), ["receiver", "method"], "left").join(F.broadcast(general), "method", "left")
    is_input = F.col("own_category").isNotNull() | (F.coalesce("any_category", F.lit("")) == "http")
    interesting = F.coalesce("any_category", F.lit("")).isin("file", "command")
    return out.select("receiver", "method", F.coalesce("own_category", "any_category").alias("category"), F.coalesce("own_type", "any_type").alias("source_type"), is_input.alias("is_input"), interesting.alias("is_interesting"))


def substring_patterns(patterns: DataFrame) -> DataFrame:
    """(kind, part): distinct texts to look for, from framework patterns (method_pattern, property_pattern, carrier_property).

    Anchors are taken off; a method reads "->name(", a property "->name[".
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"^\^", ""), r"\$$", "")
    one = lambda kind, name, end: patterns.select(F.lit(kind).alias("kind"), name.alias("name")).where("name <> ''").select("kind", F.concat(F.lit("->"), "name", F.lit(end)).alias("part"))
    return one("method", bare("method_pattern"), "(").unionByName(one("property", bare("property_pattern"), "[")).unionByName(one("property", F.col("carrier_property"), "[")).distinct()


def type_of_name(name: Column, default: str = "user_input") -> Column:
    out = F.lit(default)
    for part, kind in reversed(NAME_TYPES):
        out = F.when(F.lower(name).contains(part), kind).otherwise(out)
    return out


def server_key_type(key: Column) -> Column:
    """Source type of a key of PHP's server table; unknown for keys that no client sets."""
    out = F.lit("unknown")
    for kind, keys in CLIENT_KEYS.items():
        out = F.when(key.isin(*keys.split()), kind).otherwise(out)
    return out


def server_key_kind(key: Column) -> Column:
    return F.when(server_key_type(key) != "unknown", "user").otherwise("config")


def is_source_type(name: Column) -> Column:
    return name.isin(*SOURCE_TYPES)


def function_kinds(name: Column) -> Column:
    """Sorted kinds of a PHP function or method: input, deserialise, network, db_fetch, db_query."""
    sets = {k: v for k, v in FUNCTIONS.items() if k != "curl"} | {"db_fetch": FETCH_METHODS, "db_query": QUERY_METHODS}
    return F.array_compact(F.array(*(F.when(name.isin(*sets[k].split()), F.lit(k)) for k in sorted(sets))))


def is_result_object(name: Column) -> Column:
    return F.lower(name).rlike("|".join(RESULT_OBJECTS.split()))


def calls_any(expression: Column, names: str) -> Column:
    """The expression holds one of the names (separated by spaces) and a bracket after it."""
    out = F.lit(False)
    for name in names.split():
        out = out | F.contains(expression, F.lit(name + "("))
    return out


def identify_source(expression: Column) -> Column:
    """struct(source_type, confidence) of an expression: superglobal, external function, input member; null if none."""
    out = F.lit(None).cast("struct<source_type:string, confidence:double>")
    made = lambda kind, trust: F.struct(kind.alias("source_type"), F.lit(trust).alias("confidence"))
    member = F.regexp_extract(expression, r"(\w+)->(\w+)", 2)
    obj = F.regexp_extract(expression, r"(\w+)->(\w+)", 1)
    out = F.when(carries_input(obj, member), made(type_of_name(member), 0.70)).otherwise(out)
    for name in reversed(FUNCTIONS["input"].split()):
        out = F.when(F.contains(expression, F.lit(name + "(")), made(F.lit(INPUT_TYPES.get(name, "file")), TRUST["input"][1])).otherwise(out)
    for group in ("deserialise", "network", "curl"):
        kind, trust = TRUST[group]
        out = F.when(calls_any(expression, FUNCTIONS[group]), made(F.lit(kind), trust)).otherwise(out)
    for name, kind in reversed(SUPERGLOBALS.items()):
        out = F.when(expression.contains(f"${name}"), made(F.lit(kind), 1.0)).otherwise(out)
    return out


def merged(*tables: DataFrame) -> DataFrame:
    """Mapping tables (language, kind, name, source_type) as one; later tables win."""
    out = None
    for k, t in enumerate(tables):
        part = t.withColumn("layer", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("language", "kind", "name").agg(F.max_by("source_type", "layer").alias("source_type"))
