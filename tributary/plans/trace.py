"""Whole analyses of a source tree: forward trace, backward trace, call graph and symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import aggregate, detect, flow, graph, registry, taint
from tributary.operators.fixpoint import cut
from tributary.rules.catalogue import MAX_FILE_BYTES, RULES, SKIP_DIRS, frameworks, source_rules
from tributary.sources import parse
from tributary.sources.fact_store import FactStore
from tributary.sources.files import first_files, scan


@dataclass
class Config:
    languages: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    skip_dirs: list[str] = field(default_factory=lambda: list(SKIP_DIRS))
    max_bytes: int = MAX_FILE_BYTES
    #: The first files by path, and the first sources by id, that are traced; 0 is all.
    max_files: int = 0
    max_sources: int = 0
    max_depth: int = 10
    custom_rules: list[tuple[str, str, str, str]] = field(default_factory=list)
    #: Folder of facts that are kept over scans: texts that it holds aren't parsed again. Without it every text is parsed.
    fact_store: str = ""


@dataclass
class Trace:
    """Relations of one run; each is lazy but for the parsed facts, the sources and the places that input reaches.

    tainted: variables, one row per place and source (file_path, home, name, source_id, class_name, scope, variable, depth, seq, parent);
    reached: the same with results of functions, as flow.reach gives them.
    """

    files: DataFrame
    facts: DataFrame
    sources: DataFrame
    reached: DataFrame
    tainted: DataFrame
    arguments: DataFrame
    functions: DataFrame

    def summary(self) -> DataFrame:
        return aggregate.run_statistics(files=self.files, sources=self.sources, variables=self.tainted, functions=self.functions)

    def top_files(self, n: int = 10) -> DataFrame:
        per = aggregate.tagged_counts("file_path", sources=self.sources, variables=self.tainted, functions=self.functions)
        return aggregate.top(per.withColumn("score", F.col("sources") + F.col("variables") + F.col("functions")), "score", "file_path", n)

    def _nodes(self) -> DataFrame:
        """(file_path, home, name, node_id): a variable's id is its file and text, and its home where the file has several of them; a result's its function's."""
        rows = self.reached.select("file_path", "home", "name", "label").distinct()
        result = F.col("home").startswith("return ")
        several = rows.where(~result).groupBy("file_path", "label").agg((F.count_distinct("home") > 1).alias("several"))
        rows = rows.join(several, ["file_path", "label"], "left")
        node = F.when(result, F.concat_ws(":", F.lit("ret"), "file_path", F.substring("home", 8, 1 << 20))).when(F.col("several"), F.concat_ws(":", F.lit("var"), "file_path", "home", "label")).otherwise(F.concat_ws(":", F.lit("var"), "file_path", "label"))
        return rows.groupBy("file_path", "home", "name").agg(F.min(node).alias("node_id"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Flow nodes (node_id, type, name, file_path, line) and edges (src, dst, type)."""
        sources = self.sources.select(F.col("source_id").alias("node_id"), F.lit("source").alias("type"), F.col("source_type").alias("name"), "file_path", "line")
        held = self.tainted.join(self._nodes(), ["file_path", "home", "name"])
        variables = held.select("node_id", F.lit("variable").alias("type"), F.col("variable").alias("name"), "file_path", F.lit(0).alias("line"))
        function = F.concat_ws(":", F.lit("func"), "file_path", "function_name")
        functions = self.arguments.select(function.alias("node_id"), F.lit("function").alias("type"), F.col("function_name").alias("name"), "file_path", F.lit(0).alias("line"))
        nodes = graph.flow_nodes(sources, variables, functions)
        sets = held.select(F.col("source_id").alias("src"), F.col("node_id").alias("dst"), F.lit("assignment").alias("type"))
        calls = self.arguments.select(F.col("source_id").alias("src"), function.alias("dst"), F.lit("call").alias("type"))
        return nodes, graph.flow_edges(nodes, sets, calls)

    def deep_edges(self) -> DataFrame:
        """Edges (src, dst, type) along the chains: a source to its places, one to the next (assignment, parameter, return), the last to the call that takes it."""
        nodes = self._nodes()
        here = self.reached.join(nodes, ["file_path", "home", "name"])
        before = nodes.select(F.col("file_path").alias("from_file"), F.col("home").alias("from_home"), F.col("name").alias("from_name"), F.col("node_id").alias("before"))
        kind = F.when(F.col("kind") == "enter", "parameter").when(F.col("kind").isin("out", "back", "through"), "return").otherwise("assignment")
        steps = here.join(before, ["from_file", "from_home", "from_name"], "left").select(F.coalesce("before", "source_id").alias("src"), F.col("node_id").alias("dst"), kind.alias("type"))
        calls = self.arguments.where("home is not null").join(nodes, ["file_path", "home", "name"]).select(F.col("node_id").alias("src"), F.concat_ws(":", F.lit("func"), "file_path", "function_name").alias("dst"), F.lit("call").alias("type"))
        return steps.unionByName(calls).distinct()

    def paths(self) -> DataFrame:
        """Per source its paths (source_id, kind, file_path, steps): to each tainted variable, and to each call argument, through all calls on the way."""
        chain = cut(flow.variables(flow.paths(self.reached)))
        variables = chain.select("source_id", F.lit("variable").alias("kind"), "file_path", F.col("path").alias("steps"))
        calls = self.arguments.where("home is not null").join(chain.select("file_path", "home", "name", "source_id", "path"), ["file_path", "home", "name", "source_id"])
        calls = calls.select("source_id", F.lit("call").alias("kind"), "file_path", F.concat("path", F.array(F.format_string("%s[%d]", "function_name", "arg_index"))).alias("steps"))
        return variables.unionByName(calls)

    def receives_input(self, name: str) -> DataFrame:
        """Functions of that name with a tainted parameter; none: no input reaches it."""
        return self.functions.where((F.col("function_name") == name) & (F.size("tainted_params") > 0))

    def by_language(self) -> DataFrame:
        """(language, files, sources)"""
        return aggregate.tagged_counts("language", files=self.files, sources=self.sources)


def trace(spark: SparkSession, root: str, config: Config | None = None) -> Trace:
    """Where input enters the tree under root and what it reaches, across calls and files."""
    config = config or Config()
    files = scan(spark, root, config.languages, config.include, config.exclude, config.skip_dirs, config.max_bytes)
    return trace_files(spark, first_files(files, config.max_files), config)


def trace_files(spark: SparkSession, files: DataFrame, config: Config | None = None) -> Trace:
    config = config or Config()
    if config.fact_store:
        store = FactStore(spark, config.fact_store)
        table = cut(store.facts(store.update(files)))
    else:
        table = cut(parse.facts(files))
    hits = detect.match_rules(parse.nodes(table), source_rules(spark, config.custom_rules))
    # A statement that takes a value apart gives each of its targets the source.
    taken = parse.assignments(table).select("file_path", "place", F.col("target").alias("taken"))
    hits = hits.join(taken, ["file_path", "place"], "left").withColumn("variable", F.coalesce("taken", "variable")).drop("taken")
    sources = hits.withColumn("source_id", F.concat_ws(":", "file_path", F.col("line").cast("string"), "source_type", "key"))
    sources = sources.groupBy("source_id", "variable", "file_path", "place").agg(*(F.min(c).alias(c) for c in ("line", "language", "source_type", "key", "snippet", "labels", "matched", "seq", "scope", "class_name", "scopes")))
    if config.max_sources:
        sources = sources.orderBy("source_id", "variable", "place").limit(config.max_sources)
    sources = cut(sources)
    places = Places(table)
    reached = cut(flow.reach(places.seeds(sources), places.edges(), config.max_depth))
    tainted = cut(flow.variables(reached))
    arguments = cut(places.tainted_arguments(sources, tainted))
    shown = sources.select("source_id", "variable", "file_path", "line", "language", "source_type", "key", "snippet", "labels", "scope", "class_name").dropDuplicates(["source_id", "variable"])
    return Trace(files, table, shown, reached, tainted, arguments, taint.tainted_functions(arguments))


class Places:
    """Edges, seeds and arguments of parsed facts.

    A call that assigns needs no summaries of parameters here: its right side names the arguments, so they reach the target by the
    assignment itself. What functions read themselves comes back by out and back.
    """

    def __init__(self, table: DataFrame):
        shared = parse.globals_of(table)
        self.assigned = self._shared(parse.assignments(table), shared)
        self.functions = parse.functions(table)
        self.returned = parse.returns(table)
        # Only scripts' functions see names of the scopes around them.
        nested = not table.where("language <> 'php' and size(scopes) > 0").isEmpty()
        self.definitions = cut(flow.definitions_of(self.assigned, self.functions)) if nested else None
        targets = self.assigned.select("file_path", "place", F.col("target").alias("assigned"))
        called = parse.calls(table).join(targets, ["file_path", "place"], "left")
        called = called.withColumn("target", F.coalesce("assigned", F.lit(""))).drop("assigned")
        self.called = parse.calls(table)
        self.resolved = cut(taint.resolve(called, self.functions, parse.classes(table)))

    @staticmethod
    def _shared(assigned: DataFrame, shared: DataFrame) -> DataFrame:
        """Assignments to names that a function takes from its file are the file's."""
        known = shared.select("file_path", "class_name", "scope", F.col("name").alias("target"), F.lit(True).alias("of_file"))
        rows = assigned.join(known, ["file_path", "class_name", "scope", "target"], "left")
        return rows.withColumn("scope", F.when(F.col("of_file"), "").otherwise(F.col("scope"))).drop("of_file").select(*assigned.columns)

    def edges(self) -> DataFrame:
        d = self.definitions
        sites, returns = flow.argument_sites(self.resolved, d), flow.return_sites(self.returned, d)
        none = sites.select("callee_file", "callee_home", "position").limit(0)
        calls = flow.call_edges(sites, returns, flow.result_targets(self.resolved, d), none)
        return flow.assign_edges(self.assigned, d).unionByName(calls).unionByName(self._nested())

    def _nested(self) -> DataFrame:
        """Results of calls that a return gives back, or that are arguments of another call."""
        callee = flow.home_of(F.col("callee_class"), F.col("callee_scope"))
        result = lambda home: F.concat(F.lit("return "), home)
        inner = self.resolved.select("file_path", "place", "call_text", F.col("callee_file").alias("in_file"), result(callee).alias("in_home"), F.concat("callee_scope", F.lit("()")).alias("in_name")).distinct()
        label = F.concat("scope", F.lit("()"))
        given = self.returned.where("scope <> ''").select("file_path", "place", F.col("expression").alias("value"), F.col("file_path").alias("to_file"), result(flow.home_of(F.col("class_name"), F.col("scope"))).alias("to_home"), label.alias("to_name"))
        outer = self.resolved.select("file_path", "place", F.col("callee_file").alias("to_file"), callee.alias("to_home"), "params", F.posexplode("args").alias("position", "value")).where(F.col("position") < F.size("params"))
        taken = given.unionByName(outer.select("file_path", "place", "value", "to_file", "to_home", F.get("params", F.col("position")).alias("to_name")))
        hits = taken.join(inner, ["file_path", "place"]).where(F.contains("value", "call_text"))
        kind = F.when(F.col("to_home").startswith("return "), "back").otherwise("enter")
        return hits.select(
            F.col("in_file").alias("file_path"), F.col("in_home").alias("home"), F.col("in_name").alias("name"), F.lit(flow.ALWAYS).alias("at"), kind.alias("kind"), "to_file", "to_home", "to_name", F.col("to_name").alias("label"), F.lit(-1).cast("long").alias("since")
        )

    def seeds(self, sources: DataFrame) -> DataFrame:
        """Where sources go at once: their variables, the results of functions that return them, the parameters that take them as arguments."""
        rows = sources.withColumn("target", F.col("variable"))
        held = flow.targets(rows.where("variable <> ''"), self.definitions).select(F.col("to_file").alias("file_path"), F.col("to_home").alias("home"), F.col("to_name").alias("name"), "source_id", "label", F.lit(-1).cast("long").alias("since"))
        home = flow.home_of(F.col("class_name"), F.col("scope"))
        result = F.concat("scope", F.lit("()"))
        returns = self.returned.where("scope <> ''").select("file_path", "place", F.col("expression").alias("value"))
        given = sources.where("scope <> ''").join(returns, ["file_path", "place"]).where(F.contains("value", "matched"))
        given = given.select("file_path", F.concat(F.lit("return "), home).alias("home"), result.alias("name"), "source_id", result.alias("label"), F.lit(-1).cast("long").alias("since"))
        passed = self._direct(sources, self.resolved).where(F.col("arg_index") < F.size("params")).withColumn("param", F.get("params", F.col("arg_index")))
        passed = passed.select(F.col("callee_file").alias("file_path"), flow.home_of(F.col("callee_class"), F.col("callee_scope")).alias("home"), F.col("param").alias("name"), "source_id", F.col("param").alias("label"), F.lit(-1).cast("long").alias("since"))
        return held.unionByName(given).unionByName(passed).where("name <> ''")

    @staticmethod
    def _direct(sources: DataFrame, calls: DataFrame) -> DataFrame:
        """calls with one row per argument (arg_index, argument) that holds a source itself: source_id, matched."""
        found = sources.select("file_path", "place", "source_id", "matched", "key").distinct()
        args = calls.select("*", F.posexplode("args").alias("arg_index", "argument"))
        return args.join(found, ["file_path", "place"]).where(F.contains("argument", "matched") & ((F.col("key") == "") | F.contains("argument", "key"))).drop("key")

    def tainted_arguments(self, sources: DataFrame, tainted: DataFrame) -> DataFrame:
        """The first tainted name of each argument, by depth, or the source that it holds: file_path, class_name, scope, call_seq, function_name, arg_index, variable, source_id, and the variable's home and name (null for a source)."""
        rows = self.called.select("file_path", "language", "class_name", "scope", "scopes", "seq", "function_name", F.posexplode("args").alias("arg_index", "argument"))
        named = flow.reads(rows, "argument", self.definitions)
        hits = named.join(tainted.select("file_path", "home", "name", "variable", "source_id", "depth", F.col("seq").alias("since")), ["file_path", "home", "name"]).where("at > since")
        key = ["file_path", "class_name", "scope", "call_seq", "function_name", "arg_index"]
        hits = hits.withColumnRenamed("seq", "call_seq").select(*key, "depth", "variable", "source_id", "home", "name")
        direct = self._direct(sources, self.called).select("file_path", "class_name", "scope", F.col("seq").alias("call_seq"), "function_name", "arg_index", F.lit(-1).alias("depth"), F.col("matched").alias("variable"), "source_id", F.lit(None).cast("string").alias("home"), F.lit(None).cast("string").alias("name"))
        first = hits.unionByName(direct).groupBy(*key).agg(F.min(F.struct("depth", "variable", "source_id", "home", "name")).alias("first"))
        return first.select(*key, *(F.col(f"first.{c}").alias(c) for c in ("variable", "source_id", "home", "name")))


def trace_backward(spark: SparkSession, files: DataFrame, targets: list[str], max_depth: int = 10) -> DataFrame:
    """Assignments from which each target's value comes, with those that read a source marked."""
    pattern = "|".join(f"(?:{r[2]})" for r in RULES if r[0] == "php")
    wanted = spark.createDataFrame([(t if t.startswith("$") else f"${t}",) for t in targets], "target string")
    return taint.backward(wanted, parse.assignments(cut(parse.facts(files))), pattern, max_depth)


def backward_report(spark: SparkSession, files: DataFrame, targets: list[str], max_depth: int = 10) -> DataFrame:
    """One row per target: whether input reaches it, its distinct sources (type, expression) and their number."""
    wanted = spark.createDataFrame([(t if t.startswith("$") else f"${t}",) for t in targets], "target string")
    found = trace_backward(spark, files, targets, max_depth)
    return taint.backward_report(wanted, found, F.coalesce(registry.identify_source(F.col("expression"))["source_type"], F.lit("user_input")))


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and edges (src, dst) of functions by name; calls of unknown functions are left out."""
    table = cut(parse.facts(files))
    nodes = parse.functions(table).select(F.col("name").alias("node")).distinct()
    plain = F.regexp_extract("function_name", r"(\w+)$", 1)
    edges = parse.calls(table).where("scope <> ''").select(F.col("scope").alias("src"), plain.alias("dst")).distinct()
    return nodes, edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def detect_frameworks(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file_path, framework): the first framework of the file's language whose marker its text holds."""
    rules = frameworks(spark)
    rows = detect.candidates(files.where("content is not null"), rules, "content")
    found = detect.over_blocks(rules, lambda r: rows.join(r, "language").where(F.regexp_like("content", F.col("pattern"))))
    return detect.by_priority(found.select("file_path", "position", "framework"), ["file_path"], ["position"]).select("file_path", "framework")


def symbols(files: DataFrame) -> DataFrame:
    """The symbol index's table from parsed functions and classes."""
    table = parse.facts(files).where("kind in ('function', 'class')")
    kind = F.when(F.col("kind") == "class", "class").when(F.col("class_name") != "", "method").otherwise("function")
    # The order of insertion is that of the paths and, in a file, of the facts.
    return table.select(
        F.struct("file_path", "seq").alias("seq"), F.concat_ws(":", "file_path", "class_name", "name").alias("id"), "name", kind.alias("type"), "file_path", "line", "end_line",
        F.col("args").alias("parameters"), F.col("result").alias("return_type"), "class_name", "language",
    )
