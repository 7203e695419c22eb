"""Guard conditions: extraction, classification, nesting, guarded ranges and feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that hold a condition. Fixed values.
LINES = [
    r"^\s*if\s*\(",
    r"^\s*if\s+[^(].*:",
    r"^\s*}\s*else\s*if\s*\(",
    r"^\s*else\s*if\s*\(",
    r"^\s*elif\s+",
    r"^\s*elseif\s*\(",
    r"^\s*}\s*elseif\s*\(",
    r"\?\s*.*\s*:",
    r"^\s*switch\s*\(",
    r"^\s*case\s+",
]
#: The condition's expression, in the order in which the patterns are tried. Fixed values.
EXPRESSIONS = [
    r"if\s*\((.+)\)\s*[{:]?",
    r"(?:else\s*if|elseif)\s*\((.+)\)\s*[{:]?",
    r"if\s+(.+?)\s*:\s*$",
    r"elif\s+(.+?)\s*:\s*$",
    r"switch\s*\((.+?)\)\s*\{?",
    r"case\s+(.+?)\s*:",
    r"(.+?)\s*\?\s*.+\s*:",
]
#: Classes of conditions and their patterns, first match wins. Fixed values.
CLASSES = [
    ("null_check", r"(?i)(isset|empty|is_null|null|\bnil\b|undefined)"),
    ("type_check", r"(?i)(is_string|is_int|is_array|instanceof|typeof)"),
    ("length_check", r"(?i)(strlen|length|count|size)\s*\("),
    ("comparison", r"[<>=!]=?"),
    ("logical", r"(&&|\|\||!|and|or|not)"),
]
#: Lines that a guard reaches at most, its own included. Fixed value.
REACH = 100


def is_condition(line: Column) -> Column:
    return F.trim(line).rlike("|".join(f"(?:{p})" for p in LINES))


def condition_of(line: Column) -> Column:
    """The condition's expression, or null for a line without one."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(F.trim(line), p, 1), F.lit("")) for p in EXPRESSIONS))
    return F.when(is_condition(line), found)


def is_negated(line: Column, expression: Column) -> Column:
    return F.contains(line, F.lit("else")) | F.ltrim(expression).startswith("!")


def condition_class(expression: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(CLASSES):
        out = F.when(expression.rlike(pattern), name).otherwise(out)
    return out


def variables_in(expression: Column, keywords: list[str]) -> Column:
    """Distinct names of two characters or more that are no keywords."""
    names = F.array_distinct(F.regexp_extract_all(expression, F.lit(r"(\$?[A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return F.filter(F.array_except(names, F.array(*map(F.lit, keywords))), lambda n: F.length(n) > 1)


def running_depth(rows: DataFrame, key: list[str], order: list[str], change: Column) -> DataFrame:
    """rows with `depth`, the running sum of change."""
    return rows.withColumn("depth", F.sum(change).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def stack_depth(rows: DataFrame, key: list[str], order: list[str], change: Column) -> DataFrame:
    """rows with `depth`: the height of a stack after each row's pushes less its pops; popping an empty one changes nothing."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(change).over(upto))
    low = F.least(F.min("_sum").over(upto), F.lit(0))
    return rows.withColumn("depth", F.col("_sum") - low).drop("_sum")


def _blocks(line: Column, reach: int) -> Column:
    block = F.floor(line / reach)
    return F.array(block, block + 1)


def _count(char: str) -> Column:
    return F.length("text") - F.length(F.translate("text", char, ""))


def guarded_ranges(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """Each condition and the lines that it guards: file_path, line, guard_start, guard_end, expression, type, is_negated, nesting, parent.

    lines: file_path, line, text. A guard holds the lines from its first brace on while braces are open, within `reach` lines
    from its own; guard_start and guard_end are null where there are none. nesting counts the enclosing conditions that a
    brace on their line opened (closing braces take them off again), parent is the line of the innermost.
    """
    rows = lines.select("file_path", "line", "text", _count("{").alias("opens"), _count("}").alias("closes"), condition_of(F.col("text")).alias("expression"))
    rows = running_depth(rows, ["file_path"], ["line"], F.col("opens") - F.col("closes")).withColumnRenamed("depth", "level")
    push = F.when(F.col("expression").isNotNull() & (F.col("opens") > 0), 1).otherwise(0)
    pops = F.greatest(F.col("closes") - F.col("opens"), F.lit(0))
    # A line pushes, then pops. As two steps of one walk: 2 * line for the push, 2 * line + 1 for the pops.
    steps = F.explode(F.array(F.struct((2 * F.col("line")).alias("at"), push.alias("change")), F.struct((2 * F.col("line") + 1).alias("at"), (-pops).alias("change"))))
    walk = rows.select("file_path", "line", steps.alias("s")).select("file_path", "line", F.col("s.at").alias("at"), F.col("s.change").alias("change"))
    walk = stack_depth(walk, ["file_path"], ["at"], F.col("change"))
    # The innermost open condition of a line: the last push that reached the height that the line finds.
    pushes = walk.where("at % 2 = 0").select("file_path", "line", "at", "change", (F.col("depth") - F.col("change")).alias("nesting"), "depth")
    seen = pushes.select("file_path", "line", "at", F.col("nesting").alias("height"), F.lit(None).cast("int").alias("pushed"), "nesting")
    made = pushes.where("change = 1").select("file_path", "line", (F.col("at") + 1).alias("at"), F.col("depth").alias("height"), F.col("line").cast("int").alias("pushed"), "nesting")
    above = Window.partitionBy("file_path", "height").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    nested = seen.unionByName(made).withColumn("parent", F.last("pushed", ignorenulls=True).over(above)).where("pushed is null")
    nested = nested.select("file_path", "line", F.col("nesting").cast("long").alias("nesting"), F.when(F.col("nesting") > 0, F.col("parent")).alias("parent"))
    guards = rows.where("expression is not null").withColumn("before", F.col("level") - F.col("opens") + F.col("closes")).join(nested, ["file_path", "line"])
    # The range join is an equi-join on blocks of `reach` lines: a guard's lines are in its own block or the next.
    later = rows.select("file_path", F.floor(F.col("line") / reach).alias("block"), F.col("line").alias("at"), F.col("level").alias("held"), F.col("opens").alias("opened"))
    span = guards.select("file_path", "line", "before", F.explode(_blocks(F.col("line"), reach)).alias("block")).join(later, ["file_path", "block"])
    span = span.where((F.col("at") >= F.col("line")) & (F.col("at") < F.col("line") + reach))
    seq = F.array_sort(F.collect_list(F.struct("at", (F.col("held") - F.col("before")).alias("balance"), "opened")))  # `reach` lines at most
    span = span.groupBy("file_path", "line").agg(seq.alias("s"))
    first = F.array_min(F.transform(F.filter("s", lambda x: x["opened"] > 0), lambda x: x["at"]))
    span = span.withColumn("start", first).withColumn("s", F.filter("s", lambda x: x["at"] >= F.col("start")))
    stop = F.array_min(F.transform(F.filter("s", lambda x: x["balance"] <= 0), lambda x: x["at"]))
    last = F.coalesce(stop - 1, F.array_max(F.transform("s", lambda x: x["at"])))
    ends = span.select("file_path", "line", F.when(last >= F.col("start"), F.col("start")).alias("guard_start"), F.when(last >= F.col("start"), last).alias("guard_end"))
    out = guards.join(ends, ["file_path", "line"], "left")
    e = F.col("expression")
    return out.select("file_path", "line", "guard_start", "guard_end", "expression", condition_class(e).alias("type"), is_negated(F.col("text"), e).alias("is_negated"), "nesting", "parent")


def guards_of(targets: DataFrame, ranges: DataFrame, reach: int = REACH) -> DataFrame:
    """Targets (file_path, at) with the conditions whose guarded lines, `reach` at most, hold them."""
    places = targets.withColumn("block", F.floor(F.col("at") / reach))
    held = places.join(ranges.where("guard_end is not null").withColumn("block", F.explode(_blocks(F.col("guard_start"), reach))), ["file_path", "block"])
    return held.where((F.col("at") >= F.col("guard_start")) & (F.col("at") <= F.col("guard_end"))).drop("block")


def infeasible(conditions: DataFrame) -> DataFrame:
    """(path_id, variable): paths on which a variable is checked both null and not null. conditions: path_id, variable, type, is_negated."""
    checks = conditions.where("type = 'null_check'").groupBy("path_id", "variable").agg(F.max("is_negated").alias("some"), F.min("is_negated").alias("all"))
    return checks.where(F.col("some") & ~F.col("all")).select("path_id", "variable")
