"""Members and files: import resolution, method body flow, class lookup, public members of a framework's source and rules made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import mentions
from tributary.operators.detect import by_priority
from tributary.operators.registry import type_of_name
from tributary.operators.snippets import SUPERGLOBAL

#: Names of members that a framework's rules leave out: they change or test something.
NO_RULE = r"(?i)^(?:set|add|remove|delete|save|update|create|validate|render|is|has|count)[A-Z_]|^(?:getConfig|getLogger|getConnection|getInstance|getName|getClass)$"
#: Endings that a relative JavaScript import may leave out. Fixed values.
JS_ENDINGS = ["", ".js", ".ts", ".jsx", ".tsx", "/index.js"]


def _step(stack: Column, x: Column) -> Column:
    """The folders of a path, as a stack, after one more part of it: . and empty parts stay, .. goes back."""
    up = F.when(F.size(stack) > 0, F.when(F.element_at(stack, -1) != "..", F.slice(stack, 1, F.size(stack) - 1)).otherwise(F.concat(stack, F.array(x)))).otherwise(F.array(x))
    return F.when((x == ".") | (x == ""), stack).when(x == "..", up).otherwise(F.concat(stack, F.array(x)))


def _stack(path: Column) -> Column:
    """Parts of path without ./ and with name/.. pairs removed, at any depth."""
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), _step)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, line, resolved): PHP includes and relative JavaScript imports (file_path, language, line, text) that name a known file.

    Paths with a variable are dropped; the first ending that exists wins. Folding a path costs far more than moving it, so imports
    are dealt evenly first, and a folder is folded once for all endings.
    """
    spark = imports.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    imports = imports.select("file_path", "language", "line", "text").repartition(n, "file_path", "line")
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    php = imports.where("language = 'php'").where(F.col("text").rlike(r"^\s*(?:include|require)"))
    named = F.regexp_replace(F.regexp_extract("text", r"""(?:__DIR__\s*\.\s*)?['"]([^'"]+)['"]""", 1), "^/", "")
    php = php.where(~F.col("text").rlike(r"\$")).select("file_path", "line", F.array_join(_stack(F.concat(folder, named)), "/").alias("resolved"), F.lit(0).alias("rank"))
    js = imports.where("language in ('javascript', 'typescript')")
    target = F.regexp_extract("text", r"""['"](\.{1,2}/[^'"]+)['"]""", 1)
    js = js.where(target != "").select("file_path", "line", F.concat(folder, target).alias("base"))
    js = js.select("file_path", "line", _stack(F.regexp_extract("base", "(?s)^(.*/)?[^/]*$", 1)).alias("stack"), F.regexp_extract("base", "([^/]*)$", 1).alias("last"))
    js = js.select("file_path", "line", "stack", "last", F.posexplode(F.array(*map(F.lit, JS_ENDINGS))).alias("rank", "ending"))
    # An ending with a dot makes a name of whatever it follows; one with a slash, and none, leave the last part as it is.
    whole = F.concat(_step(F.col("stack"), F.col("last")), F.filter(F.split("ending", "/"), lambda x: x != ""))
    parts = F.when(F.col("ending").startswith("."), F.concat("stack", F.array(F.concat("last", "ending")))).otherwise(whole)
    found = php.unionByName(js.select("file_path", "line", F.array_join(parts, "/").alias("resolved"), "rank"))
    found = found.join(files.select(F.col("file_path").alias("resolved")), "resolved", "left_semi")
    return by_priority(found.select("file_path", "line", "rank", "resolved"), ["file_path", "line"], ["rank"]).select("file_path", "line", "resolved")


def body_flow(functions: DataFrame) -> DataFrame:
    """Per function (file_path, name, params, body): parameters that reach a return, that reach own members, and if input is returned."""
    returns = F.regexp_extract_all("body", F.lit(r"\breturn\b\s*([^;\n]*)"), F.lit(1))
    stores = F.regexp_extract_all("body", F.lit(r"(?:\$this->|self\.|this\.)\w+(?:\[[^\]]*\])?\s*=\s*([^;\n]+)"), F.lit(1))
    named = lambda texts: F.filter("params", lambda p: F.exists(texts, lambda t: mentions(t, p)))
    return functions.select("file_path", "name", named(returns).alias("params_to_return"), named(stores).alias("params_to_members"), F.exists(returns, lambda t: t.rlike(SUPERGLOBAL)).alias("returns_input"))


def find_classes(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(wanted, class_name, level): the class of each wanted name: exact, other case, without _interface, or a class that implements it.

    classes: class_name, implements. Each level is an equi-join on its own form of the name.
    """
    plain = F.regexp_replace(F.lower("wanted"), "_interface$", "")
    by = lambda rows, key, level: rows.join(classes.select("class_name", key.alias("key")), "key").select("wanted", "class_name", F.lit(level).alias("level"))
    w = names.select("wanted").distinct()
    found = by(w.withColumn("key", F.col("wanted")), F.col("class_name"), 0)
    found = found.unionByName(by(w.withColumn("key", F.lower("wanted")), F.lower("class_name"), 1))
    found = found.unionByName(by(w.withColumn("key", plain), F.lower("class_name"), 2))
    made = classes.select("class_name", F.explode(F.transform("implements", F.lower)).alias("key"))
    found = found.unionByName(w.withColumn("key", F.lower("wanted")).join(made, "key").select("wanted", "class_name", F.lit(3).alias("level")))
    return by_priority(found, ["wanted"], ["level", "class_name"]).select("wanted", "class_name", "level")


def public_members(texts: DataFrame) -> DataFrame:
    """(file_path, kind, name): public methods (but __ ones) and properties in PHP texts (file_path, content), each once."""
    methods = F.regexp_extract_all("content", F.lit(r"public\s+(?:static\s+)?function\s+&?(\w+)\s*\("), F.lit(1))
    fields = F.regexp_extract_all("content", F.lit(r"public\s+(?:static\s+|readonly\s+)?(?:\??[\w\\|]+\s+)?\$(\w+)"), F.lit(1))
    one = lambda kind, found: texts.select("file_path", F.lit(kind).alias("kind"), F.explode(F.array_distinct(found)).alias("name"))
    return one("method", F.filter(methods, lambda m: ~m.startswith("__"))).unionByName(one("property", fields))


def made_rules(members: DataFrame, framework: str) -> DataFrame:
    """Rules (id, framework, pattern, source_type) of members that may read input: excluded names go, types follow from names."""
    rows = members.where(~F.col("name").rlike(NO_RULE)).select("kind", "name").distinct()
    pattern = F.when(F.col("kind") == "method", F.concat(F.lit(r"->"), F.col("name"), F.lit(r"\s*\("))).otherwise(F.concat(F.lit("->"), F.col("name"), F.lit(r"\b")))
    return rows.select(F.concat_ws("_", F.lit(framework), F.lower("name"), F.substring("kind", 1, 1)).alias("id"), F.lit(framework).alias("framework"), pattern.alias("pattern"), type_of_name(F.col("name"), "http_request").alias("source_type"))


def marker_framework(paths: DataFrame, markers: list[tuple[str, str]]) -> DataFrame:
    """(framework): the first of markers (framework, file name) that the listing (file_path) has, else 'unknown'. One row."""
    rank = F.lit(len(markers))
    for k in range(len(markers) - 1, -1, -1):
        name = markers[k][1]
        rank = F.when((F.col("file_path") == name) | F.col("file_path").endswith(f"/{name}"), k).otherwise(rank)
    names = F.array(*(F.lit(m[0]) for m in markers), F.lit("unknown"))
    return paths.agg(F.coalesce(F.min(rank), F.lit(len(markers))).alias("k")).select(F.element_at(names, F.col("k") + 1).alias("framework"))
