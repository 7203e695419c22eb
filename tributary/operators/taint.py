"""Propagation of input through assignments, calls and functions, forwards and backwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import ANY_VARIABLE, mentions, variables_of
from tributary.operators.fixpoint import cut, iterate

TOKEN = ANY_VARIABLE
TAINT = ["file_path", "variable", "source_id", "depth", "seq", "parent", "path"]


def _language(rows: DataFrame) -> Column | None:
    return F.col("language") if "language" in rows.columns else None


def uses(assignments: DataFrame) -> DataFrame:
    """(file_path, seq, target, variable): names on each right side, so that propagation is an equi-join on names."""
    return assignments.select("file_path", "seq", "target", F.explode(variables_of(F.col("source_expr"), _language(assignments))).alias("variable"))


def direct(sources: DataFrame, assignments: DataFrame) -> DataFrame:
    """(source_id, file_path, seq, target): assignments flagged as directly tainted whose right side holds the source's name.

    sources: source_id, file_path, name; assignments: is_tainted beside the usual columns.
    """
    flagged = assignments.where("is_tainted").select("file_path", "seq", "target", "source_expr")
    hits = flagged.join(sources.select("file_path", "source_id", "name"), "file_path").where(F.contains("source_expr", "name"))
    return hits.select("source_id", "file_path", "seq", "target")


def forward(sources: DataFrame, assignments: DataFrame, max_depth: int = 10) -> DataFrame:
    """Tainted variables, TAINT rows.

    Sources with a variable are depth 0 and reach any assignment of their file that uses it (with a column seq: later ones);
    what they taint reaches later assignments only. A variable of a source is kept at its least depth, then its earliest assignment. parent is the
    variable that the value came from (null for a source's own), path the chain from the source's variable on.
    """
    read = uses(assignments)
    since = F.col("seq").cast("long") if "seq" in sources.columns else F.lit(-1).cast("long")
    seed = sources.where("variable <> ''").groupBy("file_path", "variable", "source_id").agg(F.min(since).alias("seq"))
    seed = seed.select("file_path", "variable", "source_id", F.lit(0).alias("depth"), "seq", F.lit(None).cast("string").alias("parent"), F.array("variable").alias("path"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        left = frontier.select("file_path", "variable", "source_id", F.col("seq").alias("since"), "path")
        hits = left.join(read, ["file_path", "variable"]).where("seq > since")
        first = F.min(F.struct("seq", F.col("variable").alias("parent"), "path")).alias("first")
        hits = hits.groupBy("file_path", "target", "source_id").agg(first)
        return hits.select(
            "file_path", F.col("target").alias("variable"), "source_id", F.lit(depth).alias("depth"), F.col("first.seq").cast("long").alias("seq"),
            F.col("first.parent").alias("parent"), F.concat("first.path", F.array("target")).alias("path"),
        )

    return iterate(seed, step, ["file_path", "variable", "source_id"], max_depth)


def tainted_arguments(calls: DataFrame, tainted: DataFrame, ordered: bool = False) -> DataFrame:
    """The first tainted name of each argument: file_path, class_name, call_seq, function_name, arg_index, variable, source_id.

    ordered: only names that were tainted before the call count.
    """
    owner = F.col("class_name") if "class_name" in calls.columns else F.lit("")
    args = calls.select("file_path", owner.alias("class_name"), F.col("seq").alias("call_seq"), "function_name", *(["language"] if "language" in calls.columns else []), F.posexplode("args").alias("arg_index", "value"))
    named = args.withColumn("variable", F.explode(variables_of(F.col("value"), _language(calls))))
    hits = named.join(tainted.select("file_path", "variable", "source_id", "depth", "seq"), ["file_path", "variable"])
    if ordered:
        hits = hits.where("seq < call_seq")
    first = F.min(F.struct("depth", "variable", "source_id")).alias("first")
    key = ["file_path", "class_name", "call_seq", "function_name", "arg_index"]
    return hits.groupBy(*key).agg(first).select(*key, F.col("first.variable").alias("variable"), F.col("first.source_id").alias("source_id"))


def tainted_functions(arguments: DataFrame) -> DataFrame:
    """One row per function and file: its tainted parameters, by index, each once."""
    params = F.array_sort(F.collect_set(F.struct(F.col("arg_index").alias("index"), F.col("variable").alias("name"), "source_id")))
    return arguments.groupBy("file_path", "function_name").agg(params.alias("tainted_params"))


def latest_parameters(arguments: DataFrame) -> DataFrame:
    """Tainted parameters by file, function, index and name, the source of the last call winning."""
    last = F.max_by("source_id", F.struct("call_seq", "source_id"))
    return arguments.groupBy("file_path", "function_name", "arg_index", "variable").agg(last.alias("source_id"))


def summaries(functions: DataFrame) -> DataFrame:
    """(callee_file, callee_class, callee, params_to_return): positions of parameters that a return statement names.

    functions: file_path, class_name, name, params, body.
    """
    returns = F.regexp_extract_all("body", F.lit(r"(?m)\breturn\b\s*([^;\n]*)"), F.lit(1))
    key = [F.col("file_path").alias("callee_file"), F.col("class_name").alias("callee_class"), F.col("name").alias("callee")]
    params = functions.select(*key, returns.alias("returns"), F.posexplode("params").alias("position", "param"))
    hit = F.exists("returns", lambda r: mentions(r, F.col("param")))
    return params.where(hit).groupBy("callee_file", "callee_class", "callee").agg(F.array_sort(F.collect_set("position")).alias("params_to_return"))


def last_name(function_name: Column) -> Column:
    """The called name itself, without receiver, class or namespace."""
    return F.regexp_extract(function_name, r"([\w$]+[?!]?)$", 1)


def called_functions(calls: DataFrame) -> DataFrame:
    """(file_path, scope, called): the distinct names that each function calls, sorted."""
    return calls.where("scope <> ''").groupBy("file_path", "scope").agg(F.array_sort(F.collect_set(last_name(F.col("function_name")))).alias("called"))


def ancestors(classes: DataFrame, max_depth: int = 20) -> DataFrame:
    """(class_name, ancestor, distance): what each class extends or implements, over any number of steps; the nearest way counts.

    classes: class_name, implements (names; of a qualified one the last part counts). Cycles end where they began.
    """
    base = F.regexp_extract("base", r"(\w+)\W*$", 1)
    edges = cut(classes.select("class_name", F.explode("implements").alias("base")).select("class_name", base.alias("ancestor")).where("ancestor <> '' and ancestor <> class_name").distinct())
    # A base that extends nothing known has no further step.
    up = edges.select(F.col("class_name").alias("ancestor"), F.col("ancestor").alias("next"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        return frontier.join(up, "ancestor").where("next <> class_name").select("class_name", F.col("next").alias("ancestor"), F.lit(depth + 1).alias("distance"))

    return iterate(edges.withColumn("distance", F.lit(1)), step, ["class_name", "ancestor"], max_depth - 1)


def resolve(calls: DataFrame, functions: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """calls (file_path, class_name, function_name, ...) with the definition that each names; calls of unknown names go.

    Adds callee_file, callee_class, callee, params and callee_scope (functions.scope, by default the name). `A::f` is a method of A,
    `$this->f` and `self::f` one of the caller's class; a bare name is a function, of the same file first; what is left takes any
    definition of the last name. With classes, a method that a class doesn't define is its nearest ancestor's, and `parent::f`
    looks among the ancestors alone; of several at one distance the least place counts. Ties go to the least file and line.
    Definitions are reduced to one per key before the joins, so a frequent name never multiplies.
    """
    scope = F.col("scope") if "scope" in functions.columns else F.col("name")
    place = F.struct(F.col("file_path").alias("callee_file"), "line", F.col("class_name").alias("callee_class"), F.col("name").alias("callee"), "params", scope.alias("callee_scope"))
    known = functions.select("file_path", "class_name", "name", place.alias("place"))
    least = lambda rows, *key: rows.groupBy(*key).agg(F.min("place").alias("place"))
    of_class = least(known.where("class_name <> ''"), "class_name", "name").select(F.col("class_name").alias("owner"), "name", F.col("place").alias("by_class"))
    if classes is not None and not classes.where("size(implements) > 0").isEmpty():
        far = ancestors(classes).join(of_class.select(F.col("owner").alias("ancestor"), "name", "by_class"), "ancestor")
        far = far.groupBy(F.col("class_name").alias("owner"), "name").agg(F.min(F.struct("distance", "by_class")).alias("far")).select("owner", "name", F.col("far.by_class").alias("by_base"))
        of_class = of_class.join(far, ["owner", "name"], "full").withColumn("by_class", F.coalesce("by_class", "by_base"))
    else:
        of_class = of_class.withColumn("by_base", F.col("by_class"))
    plain = known.where("class_name = ''")
    here = least(plain, "file_path", "name").select("file_path", "name", F.col("place").alias("by_file"))
    anywhere = least(plain, "name").select("name", F.col("place").alias("by_name"))
    any_ = least(known, "name").select("name", F.col("place").alias("by_suffix"))
    raw = F.col("function_name")
    own = raw.rlike(r"^(?:\$this->|this\.|self\.|self::|static::|parent::|super\.|super\(\)\.)\w+$")
    base = raw.rlike(r"^(?:parent::|super\.|super\(\)\.)")
    owner = F.when(own, F.col("class_name")).otherwise(F.regexp_extract(raw, r"(\w+)::\$?\w+$", 1))
    rows = calls.withColumns({"name": last_name(raw), "owner": owner, "bare": ~raw.rlike(r"->|::|\.")})
    rows = rows.join(of_class, ["owner", "name"], "left").join(here, ["file_path", "name"], "left").join(anywhere, "name", "left").join(any_, "name", "left")
    found = F.coalesce(F.when(base, F.col("by_base")).otherwise(F.col("by_class")), F.when(F.col("bare"), F.coalesce("by_file", "by_name")), "by_suffix")
    return rows.withColumn("found", found).where("found is not null").select(*calls.columns, *(F.col(f"found.{c}").alias(c) for c in ("callee_file", "callee_class", "callee", "params", "callee_scope")))


def interprocedural(resolved: DataFrame, call_targets: DataFrame, summary: DataFrame) -> DataFrame:
    """Targets of calls whose function returns a tainted argument: (file_path, variable, source_id, seq).

    resolved: tainted_arguments with their definitions; call_targets: file_path, call_seq, target.
    """
    through = resolved.join(summary, ["callee_file", "callee_class", "callee"]).where(F.array_contains("params_to_return", F.col("arg_index")))
    hits = through.join(call_targets, ["file_path", "call_seq"])
    return hits.groupBy("file_path", F.col("target").alias("variable"), "source_id").agg(F.min("call_seq").alias("seq"))


def into_callees(resolved: DataFrame) -> DataFrame:
    """Tainted parameters: the argument's position names the parameter (callee_file, callee_class, callee, variable, source_id, cross_file)."""
    params = resolved.where(F.col("arg_index") < F.size("params"))
    return params.select("callee_file", "callee_class", "callee", F.get("params", F.col("arg_index")).alias("variable"), "source_id", (F.col("callee_file") != F.col("file_path")).alias("cross_file"))


def returning(functions: DataFrame, tainted: DataFrame) -> DataFrame:
    """(file_path, function_name, source_id): functions that return a tainted variable of their file."""
    returns = F.regexp_extract_all("body", F.lit(r"(?m)\breturn\b\s*([^;\n]*)"), F.lit(1))
    named = functions.select("file_path", F.col("name").alias("function_name"), F.explode(F.array_distinct(F.flatten(F.transform(returns, lambda r: variables_of(r))))).alias("variable"))
    return named.join(tainted.select("file_path", "variable", "source_id"), ["file_path", "variable"]).select("file_path", "function_name", "source_id").distinct()


def backward(targets: DataFrame, assignments: DataFrame, source_pattern: str, max_depth: int = 10, first: bool = False) -> DataFrame:
    """Assignments that reach each target (target, file_path, variable, expression, depth, is_source), following copied names.

    A hop looks in the same file first, by file and name; other files are joined only for names without an assignment there,
    once per target and name however many places ask. With first, a target that has met a source goes no further; the steps of
    the round that met it are kept.
    """
    written = assignments.select("file_path", F.col("target").alias("variable"), F.col("source_expr").alias("expression")).distinct()
    here = written.select(F.col("file_path").alias("from_file"), "variable").distinct()
    seed = targets.select("target", F.lit("").alias("file_path"), F.col("target").alias("variable"), F.lit("").alias("expression"), F.lit(0).alias("depth"))
    is_source = F.col("expression").rlike(source_pattern)

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        if first:
            frontier = frontier.join(frontier.where(is_source).select("target"), "target", "left_anti")
        names = F.explode(F.when(F.col("expression") == "", F.array("variable")).otherwise(F.regexp_extract_all("expression", F.lit(r"(\$[A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("variable")
        wanted = frontier.where(~is_source).select("target", F.col("file_path").alias("from_file"), names).distinct()
        near = wanted.join(written.withColumnRenamed("file_path", "from_file"), ["from_file", "variable"]).withColumnRenamed("from_file", "file_path")
        far = wanted.join(here, ["from_file", "variable"], "left_anti").select("target", "variable").distinct().join(written, "variable")
        columns = ["target", "file_path", "variable", "expression", F.lit(depth).alias("depth")]
        return near.select(*columns).unionByName(far.select(*columns))

    found = iterate(seed, step, ["target", "file_path", "variable", "expression"], max_depth).where("depth > 0")
    return found.withColumn("is_source", is_source)


def backward_report(targets: DataFrame, found: DataFrame, source_type: Column) -> DataFrame:
    """Per target: n_steps, has_input, the distinct sources (type, expression) and their number; targets without a step too."""
    source = F.when(F.col("is_source"), F.struct(source_type.alias("type"), "expression"))
    per = found.groupBy("target").agg(F.count(F.lit(1)).alias("n_steps"), F.array_sort(F.collect_set(source)).alias("sources"))
    out = targets.select("target").distinct().join(per, "target", "left")
    size = F.coalesce(F.size("sources"), F.lit(0))
    return out.select("target", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), (size > 0).alias("has_input"), F.col("sources"), size.alias("n_sources"))
