"""Expression-directed traces: an expression's steps back to the input that it reads, within a tree of PHP-like classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import escaped_label
from tributary.operators.fixpoint import cut, iterate
from tributary.operators.snippets import SUPERGLOBAL, embedded, expression_kind, superglobal_type

STEPS = ["expression_id", "depth", "kind", "expression", "step", "file_path", "line", "code", "class_name"]


def parts(expressions: DataFrame) -> DataFrame:
    """expressions (expression_id, expression) with kind, object, member, class and variable."""
    e = F.col("expression")
    return expressions.select(
        "expression_id", "expression", expression_kind(e).alias("kind"), F.regexp_extract(e, r"^(\$\w+)->", 1).alias("object"),
        F.regexp_extract(e, r"(?:->|::\$?)(\w+)", 1).alias("member"), F.regexp_extract(e, r"^(\w+)::", 1).alias("class_name"), F.regexp_extract(e, r"^(\$\w+)", 1).alias("variable"),
    )


def instances(variables: DataFrame, assignments: DataFrame, hints: DataFrame) -> DataFrame:
    """variables (file_path, variable) with class_name, class_file and line of the assignment that makes the object; others go.

    `$v = new C()` and `$GLOBALS['v'] = new C()` name the class; of `$v = $c->get('service')` it is that of the nearest @var hint
    for $v at most five lines above, else "[DI:service]". The variable's own file comes first, then the least path, then the
    least line. assignments: file_path, line, target, source_expr; hints: file_path, line, text.
    """
    of_global = F.regexp_extract("target", r"^\$GLOBALS\[['\"](\w+)['\"]\]$", 1)
    name = F.when(of_global != "", F.concat(F.lit("$"), of_global)).otherwise(F.col("target"))
    made = F.regexp_extract("source_expr", r"^new\s+([\w\\]+)", 1)
    service = F.regexp_extract("source_expr", r"\$\w+->get\(['\"]([^'\"]+)['\"]\)", 1)
    sites = assignments.select("file_path", "line", name.alias("variable"), made.alias("made"), service.alias("service")).where("made <> '' or service <> ''")
    var = r"@var\s+\$(\w+)\s+([\\\w]+)|@var\s+([\\\w]+)\s+\$(\w+)"
    said = lambda a, b: F.concat(F.regexp_extract("text", var, a), F.regexp_extract("text", var, b))
    above = hints.where(F.col("text").rlike(var)).select("file_path", F.col("line").alias("at"), F.concat(F.lit("$"), said(1, 4)).alias("variable"), F.element_at(F.split(said(2, 3), r"\\"), -1).alias("hint"))
    # The range of five lines is five equal keys.
    wanted = sites.where("made = '' and service <> ''").select("file_path", "line", "variable", F.explode(F.sequence(F.col("line") - 5, F.col("line") - 1)).alias("at"))
    nearest = wanted.join(above, ["file_path", "variable", "at"]).groupBy("file_path", "line", "variable").agg(F.max_by("hint", "at").alias("hint"))
    sites = sites.join(nearest, ["file_path", "line", "variable"], "left")
    owner = F.when(F.col("made") != "", F.col("made")).otherwise(F.coalesce("hint", F.concat(F.lit("[DI:"), "service", F.lit("]"))))
    first = F.min(F.struct(F.col("file_path").alias("class_file"), "line", owner.alias("class_name")))
    near = sites.groupBy("file_path", "variable").agg(first.alias("near"))
    far = sites.groupBy("variable").agg(first.alias("far"))
    out = variables.join(near, ["file_path", "variable"], "left").join(far, "variable", "left").withColumn("found", F.coalesce("near", "far")).where("found is not null")
    return out.select("file_path", "variable", *(F.col(f"found.{c}").alias(c) for c in ("class_name", "class_file", "line")))


#: Parts of the calls of one object's method.
PARTS = 64


def external_calls(wanted: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls on an object, after the line that makes it, of methods that touch a member: class_file, variable, property, method, line, args.

    wanted: variable, property, class_name, class_file, line (instances() with the member); calls: file_path, line, receiver,
    function_name, args; functions: class_name, name, body. The objects meet their classes' methods first; what is left is small
    enough for a broadcast as a rule, else its keys are dealt into PARTS, so calls of one method never gather in one task.
    """
    touched = functions.where("class_name <> ''").select("class_name", F.col("name").alias("method"), "body")
    watched = wanted.select("class_file", "variable", "property", "class_name", "line").join(touched, "class_name").where(F.contains("body", F.concat(F.lit("$this->"), "property")))
    watched = cut(watched.select("class_file", "variable", "property", "method", "line")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    used = calls.select(F.col("file_path").alias("class_file"), F.col("receiver").alias("variable"), F.regexp_extract("function_name", r"(\w+)$", 1).alias("method"), F.col("line").alias("call_line"), "args")
    used = used.withColumn("part", F.pmod(F.xxhash64("call_line"), F.lit(PARTS)).cast("int"))
    hits = used.join(watched, ["class_file", "variable", "method", "part"]).where("call_line > line")
    return hits.select("class_file", "variable", "property", "method", F.col("call_line").alias("line"), "args")


#: Shapes of a returned expression, first match wins: name, pattern, groups of member and key parameter. Fixed values.
RETURNS = [
    ("cast_key", r"^\(\w+\)\s*\$this->(\w+)\[\$(\w+)\]", 1, 2),
    ("param_key", r"^\$this->(\w+)\[\$(\w+)\]$", 1, 2),
    ("null_coalesce", r"^\$this->(\w+)\[\$(\w+)\]\s*\?\?", 1, 2),
    ("ternary_isset", r"^isset\(\s*\$this->(\w+)\[\$(\w+)\]\s*\)\s*\?\s*\$this->\1\[\$\2\]", 1, 2),
    ("direct", r"^\$this->(\w+)", 1, 0),
]


def return_shapes(functions: DataFrame) -> DataFrame:
    """Per return statement: class_name, name, code, shape (self, one of RETURNS, input or other), property, param_index (-1: none)."""
    code = F.explode(F.regexp_extract_all("body", F.lit(r"\breturn\s+([^;]+);"), F.lit(1))).alias("code")
    rows = functions.select("class_name", "name", "params", code).withColumn("code", F.trim("code"))
    shape, member, key = F.when(F.col("code").rlike(SUPERGLOBAL), "input").otherwise("other"), F.lit(""), F.lit("")
    for name, pattern, a, b in reversed(RETURNS):
        hit = F.col("code").rlike(pattern)
        shape = F.when(hit, name).otherwise(shape)
        member = F.when(hit, F.regexp_extract("code", pattern, a)).otherwise(member)
        key = F.when(hit, F.regexp_extract("code", pattern, b) if b else F.lit("")).otherwise(key)
    shape = F.when(F.col("code") == "$this", "self").otherwise(shape)
    index = F.when(key != "", F.array_position("params", F.concat(F.lit("$"), key)).cast("int") - 1).otherwise(-1)
    return rows.select("class_name", "name", "code", shape.alias("shape"), F.when(shape == "self", "").otherwise(member).alias("property"), index.alias("param_index"))


def populations(functions: DataFrame) -> DataFrame:
    """How methods fill members: class_name, method, property, how (loop_input, loop_param, direct, conditional) and the source text."""
    body = F.col("body")
    loop = r"foreach\s*\(\s*(\$\w+)\s+as\s+\$(\w+)\s*=>\s*\$(\w+)\s*\)"
    key = ["class_name", F.col("name").alias("method")]
    loops = functions.select(*key, "params", "body", F.explode(F.regexp_extract_all(body, F.lit(loop), F.lit(0))).alias("l"))
    loops = loops.select("class_name", "method", "params", "body", *(F.regexp_extract("l", loop, k).alias(c) for k, c in ((1, "over"), (2, "k"), (3, "v"))))
    filled = F.explode(F.regexp_extract_all("body", F.lit(r"(\$this->\w+\[\$\w+\]\s*=\s*\$\w+)"), F.lit(1))).alias("f")
    loops = loops.select("*", filled).where((F.regexp_extract("f", r"\[\$(\w+)\]", 1) == F.col("k")) & (F.regexp_extract("f", r"=\s*\$(\w+)", 1) == F.col("v")))
    how = F.when(F.col("over").rlike(SUPERGLOBAL), "loop_input").when(F.array_contains("params", F.col("over")), "loop_param")
    loops = loops.withColumn("how", how).where("how is not null").select("class_name", "method", F.regexp_extract("f", r"->(\w+)", 1).alias("property"), "how", F.col("over").alias("source"))
    sets = functions.select(*key, F.explode(F.regexp_extract_all(body, F.lit(r"(\$this->\w+\s*=(?!=)\s*[^;]+)"), F.lit(1))).alias("f"))
    sets = sets.select("class_name", "method", F.regexp_extract("f", r"->(\w+)", 1).alias("property"), F.lit("direct").alias("how"), F.trim(F.regexp_extract("f", r"=\s*(.+)$", 1)).alias("source"))
    tests = functions.select(*key, "body", F.explode(F.regexp_extract_all(body, F.lit(rf"if\s*\(\s*({SUPERGLOBAL}\[['\"]?\w+['\"]?\])"), F.lit(1))).alias("source"))
    tests = tests.select("class_name", "method", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\$this->(\w+)(?:\[[^\]]*\])?\s*=(?!=)"), F.lit(1)))).alias("property"), F.lit("conditional").alias("how"), "source")
    return loops.unionByName(sets).unionByName(tests).distinct()


def magic_members(functions: DataFrame) -> DataFrame:
    """Classes whose members are made at run time: class_name, how (magic_get, dynamic_assign), method, backing, from_file.

    __get comes before `$this->$k = $v`; of several such methods the least name counts.
    """
    body = F.col("body")
    get = functions.where("class_name <> '' and name = '__get'").select("class_name", F.lit("magic_get").alias("how"), F.col("name").alias("method"), F.regexp_extract(body, r"return\s+\$this->(\w+)\[\s*\$\w+\s*\]", 1).alias("backing"), F.lit(False).alias("from_file"))
    dynamic = functions.where(F.col("class_name") != "").where(body.rlike(r"\$this->\$\w+\s*=(?!=)"))
    dynamic = dynamic.select("class_name", F.lit("dynamic_assign").alias("how"), F.col("name").alias("method"), F.regexp_extract(body, r"foreach\s*\(\s*\$(\w+)\s+as\s+\$\w+\s*=>\s*\$\w+\s*\)", 1).alias("backing"), body.rlike("require|include").alias("from_file"))
    rank = F.struct((F.col("how") != "magic_get").alias("late"), "method")
    rows = get.unionByName(dynamic)
    return rows.groupBy("class_name").agg(F.min_by(F.struct("how", "method", "backing", "from_file"), rank).alias("m")).select("class_name", "m.*")


def chain_classes(expressions: DataFrame, objects: DataFrame, functions: DataFrame, max_steps: int = 10) -> DataFrame:
    """Classes along `$v->a()->b()`: expression_id, position, member, class_name in which the member is looked up.

    objects: variable, class_name. A method that returns $this stays in its class; else its declared type, a `return new C`, or
    an @return of its body tells the next class. Chains end where none is known.
    """
    members = F.regexp_extract_all("expression", F.lit(r"->(\w+)"), F.lit(1))
    rows = cut(expressions.select("expression_id", F.regexp_extract("expression", r"^(\$\w+)", 1).alias("variable"), members.alias("members")))
    declared = F.element_at(F.split(F.regexp_replace("return_type", r"^\?", ""), r"\\"), -1)
    made, noted = F.regexp_extract("body", r"return\s+new\s+(\w+)", 1), F.regexp_extract("body", r"@return\s+\\?(?:\w+\\)*(\w+)", 1)
    known = lambda c: F.when((c != "") & ~c.isin("self", "static", "void", "array", "string", "int", "bool", "float", "mixed"), c)
    itself = F.col("body").rlike(r"return\s+\$this\s*;") | declared.isin("self", "static")
    following = F.when(itself, F.col("class_name")).otherwise(F.coalesce(known(declared), known(made), known(noted)))
    step_of = cut(functions.where("class_name <> ''").select("class_name", F.col("name").alias("member"), following.alias("following")).where("following is not null").groupBy("class_name", "member").agg(F.min("following").alias("following")))
    seed = rows.join(objects.groupBy("variable").agg(F.min("class_name").alias("class_name")), "variable").where(F.size("members") > 0)
    seed = seed.select("expression_id", F.lit(0).alias("position"), F.get("members", F.lit(0)).alias("member"), "class_name")

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        hits = frontier.join(step_of, ["class_name", "member"]).join(rows.select("expression_id", "members"), "expression_id").where(F.size("members") > depth)
        return hits.select("expression_id", F.lit(depth).alias("position"), F.get("members", F.lit(depth)).alias("member"), F.col("following").alias("class_name"))

    return iterate(seed, step, ["expression_id", "position"], max_steps)


def steps_back(expressions: DataFrame, assignments: DataFrame, functions: DataFrame, max_depth: int = 10, objects: DataFrame | None = None) -> DataFrame:
    """STEPS rows: what each expression's value was assigned from or returned by, hop by hop, until input or nothing is left.

    A local variable leads to assignments of it; a member or a method of $this, of a class or of an object whose class is known
    (objects: variable, class_name) to that class's; other members and calls to any class's of that name.
    """
    owner = F.col("class_name") if "class_name" in assignments.columns else F.lit("")
    written = assignments.select(F.regexp_replace("target", r"\[.*$", "").alias("name"), F.col("source_expr").alias("code"), "file_path", "line", owner.alias("site_class"))
    returned = functions.select(F.concat(F.lit("()"), F.col("name")).alias("name"), F.explode(F.regexp_extract_all("body", F.lit(r"return\s+([^;\n]+)"), F.lit(1))).alias("code"), "file_path", "line", F.col("class_name").alias("site_class"))
    sites = cut(written.unionByName(returned))
    none = F.lit("")
    seed = expressions.select("expression_id", F.lit(0).alias("depth"), expression_kind(F.col("expression")).alias("kind"), "expression", F.lit("start").alias("step"), none.alias("file_path"), F.lit(0).alias("line"), F.col("expression").alias("code"), none.alias("class_name"))
    found = lambda pattern: F.regexp_extract_all("code", F.lit(pattern), F.lit(1))
    name = lambda text, on: F.struct(text.alias("name"), on.alias("on"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        open_ = frontier.where(~F.col("code").rlike(SUPERGLOBAL))
        # Every variable, member and call in the code may carry the value on.
        names = F.concat(
            F.transform(found(r"(\$\w+)(?!\w|->|\()"), lambda v: name(v, none)),
            F.transform(found(r"(\$\w+->\w+)(?![\w(])"), lambda m: name(F.concat(F.lit("$this->"), F.regexp_extract(m, r"(\w+)$", 1)), F.regexp_extract(m, r"^(\$\w+)", 1))),
            F.transform(found(r"((?:[$\w]+(?:->|::))?\w+)\("), lambda m: name(F.concat(F.lit("()"), F.regexp_extract(m, r"(\w+)$", 1)), F.regexp_extract(m, r"^([$\w]+)(?:->|::)", 1))),
        )
        wanted = open_.select("expression_id", "class_name", F.explode(F.array_distinct(names)).alias("n")).select("expression_id", "class_name", "n.*")
        held = F.when(F.col("on").isin("$this", "self", "static"), F.col("class_name")).when(~F.col("on").startswith("$"), F.col("on")).otherwise("")
        if objects is not None:
            known = objects.groupBy(F.col("variable").alias("on")).agg(F.min("class_name").alias("known"))
            wanted = wanted.join(known, "on", "left")
            held = F.when((held == "") & F.col("known").isNotNull(), F.col("known")).otherwise(held)
        wanted = wanted.select("expression_id", "name", held.alias("held")).distinct()
        hits = wanted.join(sites, "name").where((F.col("held") == "") | (F.col("site_class") == F.col("held")))
        how = F.when(F.col("name").startswith("()"), "return").when(F.col("name").startswith("$this->"), "property").otherwise("assignment")
        return hits.select("expression_id", F.lit(depth).alias("depth"), expression_kind(F.col("code")).alias("kind"), F.col("name").alias("expression"), how.alias("step"), "file_path", "line", "code", F.col("site_class").alias("class_name"))

    return iterate(seed, step, ["expression_id", "file_path", "line", "code"], max_depth)


def ultimate_sources(steps: DataFrame) -> DataFrame:
    """(expression_id, source_type, code): inputs that the steps end in."""
    return steps.where(F.col("code").rlike(SUPERGLOBAL)).select("expression_id", superglobal_type(F.col("code")).alias("source_type"), "code").distinct()


def trace_snippets(snippets: DataFrame, assignments: DataFrame, functions: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Expressions of a batch of snippets (expression_id, snippet_id, expression) and their ultimate sources in a tree."""
    found = embedded(snippets).select(F.concat_ws(":", "snippet_id", "expression").alias("expression_id"), "snippet_id", "expression")
    return found, ultimate_sources(steps_back(found.select("expression_id", "expression"), assignments, functions, max_depth))


def report(steps: DataFrame) -> DataFrame:
    """One text row per step, in order."""
    return steps.select("expression_id", "depth", F.format_string("%s%s [%s] %s (%s:%d)", F.expr("repeat('  ', depth)"), F.col("step"), F.col("kind"), F.col("code"), F.col("file_path"), F.col("line")).alias("text"))


def mermaid(steps: DataFrame) -> DataFrame:
    """One Mermaid line per step after the first: from the step before it of its expression, in order, to this one."""
    order = Window.partitionBy("expression_id").orderBy("depth", "file_path", "line", "code")
    node = lambda n, text: F.format_string('s%s_%d["%s"]', F.regexp_replace(F.col("expression_id").cast("string"), r"\W", "_"), n, escaped_label(text))
    rows = steps.withColumn("n", F.row_number().over(order)).withColumns({"before": F.lag("n").over(order), "from_code": F.lag("code").over(order)})
    return rows.where("before is not null").select("expression_id", "n", F.concat(F.lit("    "), node(F.col("before"), F.col("from_code")), F.lit(" -->|"), "step", F.lit("| "), node(F.col("n"), F.col("code"))).alias("line"))
