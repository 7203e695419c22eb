"""Carriers: class members that hold input, and the methods that return it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.snippets import SUPERGLOBAL, superglobal_type

LOOP = r"foreach\s*\(\s*(\$\w+)(?:\[[^\]]*\])?\s+as\s+(?:(\$\w+)\s*=>\s*)?(\$\w+)"


def usages(statements: DataFrame) -> DataFrame:
    """Superglobals in statements (file_path, line, text, scope, class_name), one row per use, with its key and the context of the use.

    The context of a use is told by the text before it, in this order: the head of a loop, a return, a value of an array, the right side
    of an assignment, an argument; for an argument, an opening bracket of a call nearer than any assignment or arrow doesn't count twice.
    """
    found = statements.where(F.col("text").rlike(SUPERGLOBAL))
    pieces = F.split(F.regexp_replace("text", f"({SUPERGLOBAL})", "\x01$1"), "\x01")
    found = found.select("*", pieces.alias("__pieces"), F.posexplode(F.slice(pieces, 2, 2**30)).alias("__n", "__piece"))
    before = F.array_join(F.slice("__pieces", F.lit(1), F.col("__n") + 1), "")
    context: Column = (
        F.when(before.rlike(r"foreach\s*\(\s*$"), "foreach")
        .when(before.rlike(r"\breturn\b"), "return")
        .when(before.rlike(r"=>\s*$"), "array_element")
        .when(before.rlike(r"[^=!<>]=(?![=>])[^=]*$"), "assignment")
        .when(before.rlike(r"\w\s*\([^()]*$"), "function_arg")
        .otherwise("direct")
    )
    name = F.regexp_extract("__piece", rf"^({SUPERGLOBAL})", 1)
    key = F.regexp_extract("__piece", "^" + SUPERGLOBAL + r"""\[\s*['"]?([^'"\]]+)""", 1)
    return found.select("file_path", "line", "scope", "class_name", name.alias("superglobal"), superglobal_type(name).alias("source_type"), key.alias("key"), context.alias("context"), "text")


def property_flows(statements: DataFrame) -> DataFrame:
    """(file_path, class_name, property, source_type, scope, line, flow): input stored in members, directly or in a loop over it."""
    member = r"(?:\$this->|self::\$|this\.|self\.)(\w+)"
    use = usages(statements)
    direct = use.where(F.col("text").rlike(rf"^{member}(?:\[[^\]]*\])?\s*=")).select("file_path", "class_name", F.regexp_extract("text", rf"^{member}", 1).alias("property"), "source_type", "scope", "line", F.lit("direct_assignment").alias("flow"))
    loops = use.where("context = 'foreach'").select("file_path", "class_name", "scope", "source_type", F.regexp_extract("text", LOOP, 3).alias("item"), F.col("line").alias("loop_line"))
    filled = statements.where(F.col("text").rlike(rf"^{member}\[[^\]]*\]\s*=")).select("file_path", "class_name", "scope", "line", "text", F.regexp_extract("text", rf"^{member}", 1).alias("property"))
    filled = filled.join(loops, ["file_path", "class_name", "scope"]).where((F.col("line") > F.col("loop_line")) & F.expr("contains(text, item)"))
    return direct.unionByName(filled.select("file_path", "class_name", "property", "source_type", "scope", "line", F.lit("foreach_population").alias("flow")))


def public_flows(flows: DataFrame, properties: DataFrame) -> DataFrame:
    """Flows into public members; a member that its class doesn't declare is public. properties: class_name, property, is_public."""
    declared = properties.groupBy("class_name", "property").agg(F.max("is_public").alias("is_public"))
    return flows.join(declared, ["class_name", "property"], "left").where(F.coalesce("is_public", F.lit(True))).drop("is_public")


def populating_methods(flows: DataFrame, functions: DataFrame) -> DataFrame:
    """flows with populated_in: the method of the class that starts last at or before the flow's line, else __construct."""
    methods = functions.select("file_path", "class_name", F.col("name").alias("method"), F.col("line").alias("starts"))
    hits = flows.select("file_path", "class_name", "line").distinct().join(methods, ["file_path", "class_name"]).where("starts <= line")
    last = hits.groupBy("file_path", "class_name", "line").agg(F.max_by("method", F.struct("starts", "method")).alias("populated_in"))
    return flows.join(last, ["file_path", "class_name", "line"], "left").withColumn("populated_in", F.coalesce("populated_in", F.lit("__construct")))


def property_carriers(flows: DataFrame) -> DataFrame:
    """(class_name, property): source types, and the method and line that fill it first."""
    return flows.where("class_name <> ''").groupBy("class_name", "property").agg(F.array_sort(F.collect_set("source_type")).alias("source_types"), F.min(F.struct("line", F.col("scope").alias("method"))).alias("first")).select("class_name", "property", "source_types", F.col("first.method").alias("populated_in"), F.col("first.line").alias("line"))


def method_carriers(carriers: DataFrame, functions: DataFrame) -> DataFrame:
    """(class_name, method, property, source_types): methods whose body returns a carrier's property."""
    bodies = functions.where("class_name <> ''").select("class_name", F.col("name").alias("method"), "body")
    returns = F.concat(F.lit(r"return\s[^;\n]*(?:\$this->|self::\$|this\.|self\.)"), F.col("property"), F.lit(r"(?:[^A-Za-z0-9_]|$)"))
    return carriers.join(bodies, "class_name").where(F.regexp_like("body", returns)).select("class_name", "method", "property", "source_types")


def access_patterns(carriers: DataFrame, methods: DataFrame) -> DataFrame:
    """(member, pattern, source_types) that find a carrier's use in an expression, for snippets.classify."""
    members = carriers.select(F.col("property").alias("member"), F.concat(F.lit(r"->"), F.col("property"), F.lit(r"(?:[^A-Za-z0-9_(]|$)")).alias("pattern"), "source_types")
    return members.unionByName(methods.select(F.col("method").alias("member"), F.concat(F.lit(r"->"), F.col("method"), F.lit(r"\(")).alias("pattern"), "source_types"))


def statistics(carriers: DataFrame) -> DataFrame:
    return carriers.select(F.explode("source_types").alias("source_type"), "class_name").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_name").alias("n_classes"))


def united(*maps: DataFrame) -> DataFrame:
    """Carrier maps (class_name, property, ...) as one; of a member that several have, the first map's row stays."""
    out = maps[0]
    for more in maps[1:]:
        out = out.unionByName(more.join(out.select("class_name", "property"), ["class_name", "property"], "left_anti"))
    return out


def find(carriers: DataFrame, class_name: str = "", member: str = "", source_type: str = "") -> DataFrame:
    """Carriers by class, by class and member (the first), or by source type."""
    rows = carriers
    if class_name:
        rows = rows.where(F.col("class_name") == class_name)
    if source_type:
        rows = rows.where(F.array_contains("source_types", source_type))
    if member:
        rows = rows.where(F.col("property") == member).orderBy(*(c for c in ("line", "class_name") if c in rows.columns)).limit(1)
    return rows


def discover(statements: DataFrame, functions: DataFrame, properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole discovery: carriers of public members (with the method that fills them) and methods that return one."""
    flows = populating_methods(public_flows(property_flows(statements), properties), functions)
    held = property_carriers(flows.withColumn("scope", F.col("populated_in")))
    return held, method_carriers(held, functions)
