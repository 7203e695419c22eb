"""Flow of input through places, across scopes and calls.

A place is where a value is held: (file_path, home, name). A home is a function's variables ("C::f", "::f" outside classes), a file's ("")
or a class's members ("C->"), so equal names of two functions or two classes are apart. What a function gives back is a place,
too, at the home "return C::f". All steps between places are one table of edges, made once:

    assign   a name on the right side to the target
    enter    a name in an argument to the parameter of the definition that the call resolves to
    through  a name in an argument to the call's target, where that parameter reaches a return (a summary)
    out      a name in a return to the function's own result
    back     a function's result to the target of each of its calls

An edge from a local name counts only after the name was tainted (`at` is the statement's number); members and names of outer scopes
count always. What entered by a parameter leaves by `through` alone, so a tainted call doesn't taint the other calls of a function;
what a function reads itself leaves by `out` and `back`.

reach() joins each round's new places with the edges, and keeps of a place its nearest way with a pointer to where the value came
from. paths() rebuilds the chains from these pointers by jumps that double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import variables_of
from tributary.operators.fixpoint import cut, iterate

ALWAYS = 2**62
KEY = ["file_path", "home", "name"]
STATE = [*KEY, "source_id", "entered"]
EDGES = [*KEY, "at", "kind", "to_file", "to_home", "to_name", "label", "since"]

#: A member of the object itself, its name last. Fixed values.
_OWN = r"^(?:\$this->|this\.|self\.|self::\$|static::\$|this->|@{1,2})(\w+)"
_STATIC = r"\b(?:self|static)::\$\w+"
_OWN_INSIDE = r"(?<![\w$])(?:this\.|self\.|this->)\w+"


def home_of(class_name: Column, scope: Column) -> Column:
    """The home of a function's variables; a file's own is ''."""
    return F.when(scope == "", F.lit("")).otherwise(F.concat(class_name, F.lit("::"), scope))


def place_name(text: Column, language: Column) -> Column:
    """The name by which a place is known: no subscripts; of own members `->name`; in PHP a member of another object by itself, else the object."""
    plain = F.regexp_replace(text, r"(?s)\[.*$", "")
    own = F.regexp_extract(plain, _OWN, 1)
    php = F.regexp_extract(plain, r"^(\$\w+(?:->\w+)?)", 1)
    other = F.regexp_extract(plain, r"^[*&]*([A-Za-z_$][\w$]*[?!]?)", 1)
    found = F.when(language == "php", php).otherwise(other)
    return F.when(own != "", F.concat(F.lit("->"), own)).otherwise(F.when(found != "", found).otherwise(plain))


def names_in(text: Column, language: Column) -> Column:
    """Place names that an expression reads, each once."""
    own = F.regexp_extract_all(text, F.lit(f"({_OWN_INSIDE}|{_STATIC})"), F.lit(1))
    rest = F.regexp_replace(text, f"{_OWN_INSIDE}|{_STATIC}", " ")
    names = F.transform(F.concat(own, variables_of(rest, language)), lambda v: place_name(v, language))
    return F.array_distinct(F.filter(names, lambda v: ~v.isin("$this", "this", "self", "->")))


def _language(rows: DataFrame) -> Column:
    return F.col("language") if "language" in rows.columns else F.lit("php")


def located(rows: DataFrame, name: str, definitions: DataFrame | None = None) -> DataFrame:
    """rows (file_path, class_name, scope, ...) with `home`, that of the place `name`, and `local`: it is one of the own scope.

    Own members live at their class. With rows.scopes, the enclosing functions' homes from the nearest out, a name belongs to the
    nearest that defines it (definitions: file_path, home, name, once each); one that none defines is the own function's in languages
    whose functions have variables of their own, else the file's. Without it, and in PHP, it is the own function's.
    """
    own = home_of(F.col("class_name"), F.col("scope"))
    member = F.col(name).startswith("->")
    rows = rows.withColumn("__own", F.when(member, F.concat("class_name", F.lit("->"))).otherwise(own))
    if definitions is None or "scopes" not in rows.columns:
        return rows.withColumns({"home": F.col("__own"), "local": ~member}).drop("__own")
    known = definitions.select("file_path", F.col("home").alias("__home"), F.col("name").alias("__name"))
    settled = member | (F.col("language") == "php") | (F.size("scopes") == 0)
    # One probe per enclosing scope; the interval of a scope holds its statements, so the chain is short.
    probes = rows.where(~settled).select("file_path", F.col(name).alias("__name"), "scopes").distinct().select("file_path", "__name", "scopes", F.posexplode("scopes").alias("__far", "__home"))
    near = probes.join(known, ["file_path", "__home", "__name"]).groupBy("file_path", "__name", "scopes").agg(F.min_by("__home", "__far").alias("__near"))
    near = near.select(F.col("file_path").alias("__f"), F.col("__name").alias("__n"), F.col("scopes").alias("__s"), "__near")
    on = ~settled & (F.col("file_path") == F.col("__f")) & (F.col(name) == F.col("__n")) & (F.col("scopes") == F.col("__s"))
    out = rows.join(near, on, "left")
    free = F.when(F.col("language").isin("python", "ruby"), F.col("__own")).otherwise("")
    home = F.when(settled, F.col("__own")).otherwise(F.coalesce("__near", free))
    return out.withColumn("home", home).withColumn("local", ~member & (F.col("home") == own)).drop("__own", "__f", "__n", "__s", "__near")


def definitions_of(assignments: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_path, home, name): parameters, and what assignments define: in Python and Ruby every target, else declared ones."""
    own = home_of(F.col("class_name"), F.col("scope"))
    defines = F.col("language").isin("python", "ruby", "php") | F.col("declared")
    made = assignments.where(defines & (F.col("scope") != "")).select("file_path", own.alias("home"), place_name(F.col("target"), F.col("language")).alias("name"))
    params = functions.select("file_path", own.alias("home"), F.explode("params").alias("name"))
    return made.unionByName(params).distinct()


def reads(rows: DataFrame, text: str, definitions: DataFrame | None) -> DataFrame:
    """rows with one row per name that `text` reads: `name`, its `home`, and `at`, from which statement on the name counts."""
    named = rows.withColumn("name", F.explode(names_in(F.col(text), _language(rows))))
    return located(named, "name", definitions).withColumn("at", F.when(F.col("local"), F.col("seq").cast("long")).otherwise(F.lit(ALWAYS))).drop("local")


def targets(rows: DataFrame, definitions: DataFrame | None) -> DataFrame:
    """rows with the place that their target is: to_file, to_home, to_name, label, since."""
    named = rows.withColumn("__target", place_name(F.col("target"), _language(rows)))
    kept = located(named, "__target", definitions)
    since = F.when(F.col("local"), F.col("seq").cast("long")).otherwise(F.lit(-1).cast("long"))
    return kept.withColumns({"to_file": F.col("file_path"), "to_home": F.col("home"), "to_name": F.col("__target"), "label": F.col("target"), "since": since}).drop("home", "local", "__target")


_TO = ["to_file", "to_home", "to_name", "label", "since"]


def assign_edges(assignments: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    return reads(targets(assignments, definitions), "source_expr", definitions).select(*KEY, "at", F.lit("assign").alias("kind"), *_TO)


def argument_sites(resolved: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Names in arguments of resolved calls: KEY, at, position, the parameter's place (callee_file, callee_home, param), and the call's target (to_*; null without one)."""
    callee = home_of(F.col("callee_class"), F.col("callee_scope"))
    rows = targets(resolved, definitions).withColumn("callee_home", callee)
    rows = rows.select("*", F.posexplode("args").alias("position", "argument")).where(F.col("position") < F.size("params"))
    rows = rows.withColumn("param", F.get("params", F.col("position")))
    rows = reads(rows, "argument", definitions)
    known = F.col("target") != ""
    return rows.select(*KEY, "at", "position", "callee_file", "callee_home", "param", *(F.when(known, F.col(c)).alias(c) for c in _TO))


def return_sites(returns: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Names in returns of functions: KEY, at, the function's home (of_home) and its label."""
    rows = returns.where("scope <> ''").withColumns({"of_home": home_of(F.col("class_name"), F.col("scope")), "label": F.concat("scope", F.lit("()"))})
    return reads(rows, "expression", definitions).select(*KEY, "at", "of_home", "label")


def parameter_summaries(functions: DataFrame, assigns: DataFrame, arguments: DataFrame, returns: DataFrame, max_depth: int = 10) -> DataFrame:
    """(callee_file, callee_home, position): parameters that reach a return, through other functions too.

    Semi-naive: a round joins what the last one found, be it places, arguments or summaries, with the tables, and an argument that
    waits for its summary with the new summaries only.
    """
    home = home_of(F.col("class_name"), F.col("scope"))
    params = functions.select("file_path", home.alias("home"), F.posexplode("params").alias("position", "name"))
    some = returns.select("file_path", F.col("of_home").alias("home")).distinct()
    mark = ["of_file", "of_home", "position"]
    seed = params.join(some, ["file_path", "home"], "left_semi").select(F.col("file_path").alias("of_file"), F.col("home").alias("of_home"), "position", *KEY, F.lit(-1).cast("long").alias("since"))
    ends = returns.withColumnRenamed("of_home", "end_home").drop("label")
    sites = arguments.where("to_name is not null").withColumnsRenamed({"position": "arg_position", "since": "to_since"})
    steps = assigns.select(*KEY, "at", "to_file", "to_home", "to_name", F.col("since").alias("to_since"))
    place = [F.col("to_file").alias("file_path"), F.col("to_home").alias("home"), F.col("to_name").alias("name"), F.col("to_since").alias("since")]
    seen = fresh = cut(seed)
    known = waiting = None
    for _ in range(max_depth):
        hits = fresh.join(ends, KEY).where((F.col("at") > F.col("since")) & (F.col("end_home") == F.col("of_home")) & (F.col("file_path") == F.col("of_file")))
        new = hits.select(F.col("of_file").alias("callee_file"), F.col("of_home").alias("callee_home"), F.col("position").alias("arg_position")).distinct()
        new = cut(new if known is None else new.join(known, new.columns, "left_anti"))
        held = cut(fresh.join(sites, KEY).where(F.col("at") > F.col("since")).select(*mark, "callee_file", "callee_home", "arg_position", "to_file", "to_home", "to_name", "to_since"))
        known = new if known is None else known.unionByName(new)
        found = fresh.join(steps, KEY).where(F.col("at") > F.col("since")).select(*mark, *place)
        found = found.unionByName(held.join(known, new.columns).select(*mark, *place))
        if waiting is not None:
            found = found.unionByName(waiting.join(new, new.columns).select(*mark, *place))
        waiting = held if waiting is None else waiting.unionByName(held)
        found = found.groupBy(*mark, *KEY).agg(F.min("since").alias("since"))
        fresh = cut(found.join(seen.select(*mark, *KEY), [*mark, *KEY], "left_anti").select(*seed.columns))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return known.withColumnRenamed("arg_position", "position")


def call_edges(arguments: DataFrame, returns: DataFrame, resolved_targets: DataFrame, summaries: DataFrame) -> DataFrame:
    """The edges enter, through, out and back."""
    plain = lambda kind, *to: [*KEY, "at", F.lit(kind).alias("kind"), *to]
    never = F.lit(-1).cast("long").alias("since")
    enter = arguments.select(*plain("enter", F.col("callee_file").alias("to_file"), F.col("callee_home").alias("to_home"), F.col("param").alias("to_name"), F.col("param").alias("label"), never))
    through = arguments.where("to_name is not null").join(summaries, ["callee_file", "callee_home", "position"], "left_semi").select(*plain("through", *_TO))
    result = lambda home: F.concat(F.lit("return "), home)
    out = returns.select(*plain("out", F.col("file_path").alias("to_file"), result(F.col("of_home")).alias("to_home"), F.col("label").alias("to_name"), "label", never))
    back = resolved_targets.select(F.col("callee_file").alias("file_path"), result(F.col("callee_home")).alias("home"), F.concat("callee_scope", F.lit("()")).alias("name"), F.lit(ALWAYS).alias("at"), F.lit("back").alias("kind"), *_TO)
    return enter.unionByName(through).unionByName(out).unionByName(back)


def result_targets(resolved: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """The places that take the results of resolved calls: callee_file, callee_home, callee_scope, to_*."""
    rows = targets(resolved.where("target <> ''"), definitions)
    return rows.select("callee_file", home_of(F.col("callee_class"), F.col("callee_scope")).alias("callee_home"), "callee_scope", *_TO)


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """The places that each source reaches: STATE, label, depth, since, kind, and the place before (from_file, from_home, from_name, from_entered, from_label; null at a source).

    seeds: KEY, source_id, label, since. Each round follows every edge once, so the first way to a place is a shortest one; of
    several, the earliest statement's, then the least place's.
    """
    entered = F.col("entered")
    none = F.lit(None)
    start = seeds.groupBy(*KEY, "source_id").agg(F.min(F.struct("since", "label")).alias("first")).select(
        *KEY, "source_id", F.lit(False).alias("entered"), F.col("first.label").alias("label"), F.lit(0).alias("depth"), F.col("first.since").cast("long").alias("since"), F.lit("source").alias("kind"),
        none.cast("string").alias("from_file"), none.cast("string").alias("from_home"), none.cast("string").alias("from_name"), none.cast("boolean").alias("from_entered"), none.cast("string").alias("from_label"),
    )
    # Every round joins the edges: they are made once.
    steps = cut(edges.select(*KEY, "at", F.col("kind").alias("how"), "to_file", "to_home", "to_name", F.col("label").alias("to_label"), F.col("since").alias("to_since")))
    way = ["to_since", "kind", "from_home", "from_name", "from_file", "from_entered", "from_label", "label"]

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        hits = frontier.select(*STATE, "since", F.col("label").alias("from_label")).join(steps, KEY).where((F.col("at") > F.col("since")) & ~((F.col("how") == "out") & entered))
        into = F.when(F.col("how") == "enter", True).when(F.col("how").isin("out", "back") | F.col("to_home").endswith("->"), False).otherwise(entered)
        hits = hits.select("to_file", "to_home", "to_name", "source_id", into.alias("entered"), "to_since", F.col("how").alias("kind"), F.col("home").alias("from_home"), F.col("name").alias("from_name"), F.col("file_path").alias("from_file"), entered.alias("from_entered"), "from_label", F.col("to_label").alias("label"))
        first = hits.groupBy("to_file", "to_home", "to_name", "source_id", "entered").agg(F.min(F.struct(*way)).alias("first"))
        return first.select(
            F.col("to_file").alias("file_path"), F.col("to_home").alias("home"), F.col("to_name").alias("name"), "source_id", "entered", F.col("first.label").alias("label"), F.lit(depth).alias("depth"),
            F.col("first.to_since").alias("since"), F.col("first.kind").alias("kind"), *(F.col(f"first.{c}").alias(c) for c in ("from_file", "from_home", "from_name", "from_entered", "from_label")),
        )

    return iterate(start, step, STATE, max_depth)


def paths(found: DataFrame) -> DataFrame:
    """found (reach) with `path`, the labels from the source's place on.

    Pointer jumping: a row's path ends where its pointer goes on, and each round appends the path of the row that it points to, so
    the rounds grow with the logarithm of the depth.
    """
    before = ["from_file", "from_home", "from_name", "from_entered"]
    state = found.select(*STATE, *before, F.array("label").alias("path"))
    reached, span = found.agg(F.max("depth")).first()[0] or 0, 1
    while span <= reached:
        ahead = state.select(*(F.col(a).alias(b) for a, b in zip(["file_path", "home", "name", "entered"], before, strict=True)), "source_id", F.struct(*before).alias("next"), F.col("path").alias("head"))
        joined = state.join(ahead, [*before, "source_id"], "left")
        went = F.col("head").isNotNull()
        state = cut(joined.select(*STATE, *(F.when(went, F.col(f"next.{c}")).alias(c) for c in before), F.when(went, F.concat("head", "path")).otherwise(F.col("path")).alias("path")))
        span *= 2
    return found.join(state.select(*STATE, "path"), STATE)


def variables(found: DataFrame) -> DataFrame:
    """found without results of functions, each place and source once, its nearest way: with class_name, scope and variable."""
    rest = [c for c in found.columns if c not in (*KEY, "source_id")]
    kept = found.where(~F.col("home").startswith("return "))
    kept = kept.groupBy(*KEY, "source_id").agg(F.min(F.struct("depth", "since", *(c for c in rest if c not in ("depth", "since")))).alias("first")).select(*KEY, "source_id", *(F.col(f"first.{c}").alias(c) for c in rest))
    return kept.withColumns({"variable": F.col("label"), "parent": F.col("from_label"), "seq": F.col("since"), "class_name": F.regexp_extract("home", r"^(.*?)(?:::|->)", 1), "scope": F.regexp_extract("home", r"::(.*)$", 1)})
