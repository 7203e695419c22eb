"""Scopes and variables: nearest definitions, shadowing, parameters of callers, reports per variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.fixpoint import iterate
from tributary.operators.taint import TOKEN


def closure(scopes: DataFrame, max_depth: int = 20) -> DataFrame:
    """(scope, ancestor, distance) of a scope tree (scope, parent); a scope is its own ancestor at distance 0."""
    seed = scopes.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("distance"))
    up = scopes.where("parent is not null").select(F.col("scope").alias("ancestor"), "parent")

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        return frontier.select("scope", "ancestor").join(up, "ancestor").select("scope", F.col("parent").alias("ancestor"), F.lit(depth).alias("distance"))

    return iterate(seed, step, ["scope", "ancestor"], max_depth)


def resolve(usages: DataFrame, definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """usages (scope, name, seq) with `definition`: the latest earlier one (scope, name, seq, id) of the nearest scope that has one."""
    seen = usages.join(closure(scopes), "scope").join(definitions.select(F.col("scope").alias("ancestor"), "name", F.col("seq").alias("at"), "id"), ["ancestor", "name"]).where("at < seq")
    best = seen.groupBy("scope", "name", "seq").agg(F.min(F.struct("distance", (-F.col("at")).alias("age"), "id")).alias("best"))
    return usages.join(best, ["scope", "name", "seq"], "left").withColumn("definition", F.col("best.id")).drop("best")


def shadowed(definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, shadows): the definition of the name that was visible where this one was made."""
    found = resolve(definitions.select("scope", "name", "seq"), definitions, scopes)
    return definitions.join(found.withColumnRenamed("definition", "shadows"), ["scope", "name", "seq"]).where("shadows is not null").select("id", "shadows")


def first_definitions(assignments: DataFrame) -> DataFrame:
    """The first assignment of each variable in a file, class and function."""
    scope = ["file_path", "class_name", "scope", "target"]
    first = assignments.groupBy(*scope).agg(F.min("seq").alias("seq"))
    return assignments.join(first, [*scope, "seq"])


def parameter_values(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, name, param, position, value, n_calls): the values that calls of the name pass for each parameter, each once.

    Calls are counted by name, position and value before the join, partly in the tasks that read them, and functions once per
    name, position and parameter: a name that half of all calls use moves its distinct values only.
    """
    params = functions.select("file_path", "name", F.posexplode("params").alias("position", "param")).distinct()
    args = calls.select(F.regexp_extract("function_name", r"(\w+)$", 1).alias("name"), F.posexplode("args").alias("position", "value"))
    values = args.groupBy("name", "position", "value").agg(F.count(F.lit(1)).alias("n_calls"))
    return params.join(values, ["name", "position"]).select("file_path", "name", "param", "position", "value", "n_calls")


def variable_report(definitions: DataFrame, sources: DataFrame) -> DataFrame:
    """Per variable its definitions, those that read input, and the distinct source types they read.

    definitions: file_path, target, source_expr; sources: file_path, variable, source_type. A definition reads what it mentions.
    """
    names = F.explode(F.array_distinct(F.regexp_extract_all("source_expr", F.lit(f"({TOKEN})"), F.lit(1)))).alias("variable")
    hits = definitions.select("file_path", "target", "source_expr", names).join(sources.select("file_path", "variable", "source_type"), ["file_path", "variable"])
    found = hits.groupBy("file_path", "target", "source_expr").agg(F.collect_set("source_type").alias("types"))
    rows = definitions.join(found, ["file_path", "target", "source_expr"], "left")
    return rows.groupBy("file_path", "target").agg(
        F.count(F.lit(1)).alias("n_definitions"), F.count_if(F.col("types").isNotNull()).alias("n_input"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("types", F.array().cast("array<string>")))))).alias("types")
    )


def numbered(rows: DataFrame, key: str, order: str, name: str = "step") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))
