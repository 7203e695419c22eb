"""Symbol index: exact, pattern and filtered search with scores, definitions and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import glob_pattern
from tributary.rules.trigrams import required_trigrams

#: Scores of the kinds of match. Fixed values.
EXACT, PATTERN, PARAMETER, FILTER_ONLY = 100, 75, 30, 10


@dataclass
class Query:
    name: str = ""
    name_pattern: str = ""
    type: str = ""
    class_name: str = ""
    file_path: str = ""
    file_pattern: str = ""
    language: str = ""
    has_parameter: str = ""
    return_type: str = ""
    limit: int = 0


def trigrams(symbols: DataFrame) -> DataFrame:
    """(trigram, name): the postings of all names, each name once per trigram; names below three characters have none."""
    names = symbols.select("name").where("length(name) >= 3").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda k: F.substring(F.col("name"), k, F.lit(3)))
    return names.select(F.explode(F.array_distinct(grams)).alias("trigram"), "name")


def candidates(postings: DataFrame, pattern: str) -> DataFrame | None:
    """(name): names that hold the trigrams which the pattern needs; None where it needs none and every name must be tried."""
    ways = required_trigrams(pattern)
    if not ways:
        return None
    wanted = sorted(set().union(*ways))
    held = postings.where(F.col("trigram").isin(wanted)).groupBy("name").agg(F.collect_set("trigram").alias("held"))
    has = lambda way: F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(way))))) == len(way)
    keep = has(ways[0])
    for way in ways[1:]:
        keep = keep | has(way)
    return held.where(keep).select("name")


def search(symbols: DataFrame, q: Query, postings: DataFrame | None = None) -> DataFrame:
    """symbols that match, with `score` and `matched_by`, best first; ties keep insertion order (seq). limit 0 is all.

    A search by language or return type alone scores nothing and returns nothing. With postings (trigrams of all names) a pattern
    is tried on the names only that hold the trigrams it needs.
    """
    rows = symbols
    for column, value in (("type", q.type), ("language", q.language), ("class_name", q.class_name), ("return_type", q.return_type), ("file_path", q.file_path)):
        if value:
            rows = rows.where(F.col(column) == value)
    if q.file_pattern:
        rows = rows.where(F.col("file_path").rlike(glob_pattern(q.file_pattern)))
    score: Column = F.lit(0)
    matched = F.lit("")
    if q.name:
        rows = rows.where(F.col("name") == q.name)
        score, matched = F.lit(EXACT), F.lit("exact_name")
    elif q.name_pattern:
        names = candidates(postings, q.name_pattern) if postings is not None else None
        if names is None:
            rows = rows.where(F.col("name").rlike(q.name_pattern))
        else:
            rows = rows.join(names.where(F.col("name").rlike(q.name_pattern)), "name", "left_semi")
        score, matched = F.lit(PATTERN), F.lit("name_pattern")
    if q.has_parameter:
        has = F.array_contains("parameters", q.has_parameter)
        score = score + F.when(has, PARAMETER).otherwise(0)
        matched = F.when(has & (matched == ""), "parameter").otherwise(matched)
    if not (q.name or q.name_pattern or q.has_parameter) and (q.type or q.class_name or q.file_path or q.file_pattern):
        score, matched = F.lit(FILTER_ONLY), F.lit("filter")
    rows = rows.withColumns({"score": score.cast("double"), "matched_by": matched}).where("score > 0").orderBy(F.desc("score"), "seq")
    return rows.limit(q.limit) if q.limit else rows


def latest(symbols: DataFrame, *key: str) -> DataFrame:
    """Of symbols with one key the last added."""
    newest = symbols.groupBy(*key).agg(F.max("seq").alias("seq"))
    return symbols.join(newest, [*key, "seq"])


def with_references(symbols: DataFrame, references: DataFrame) -> DataFrame:
    return symbols.join(references, symbols["id"] == references["symbol_id"])


def definitions(usages: DataFrame, symbols: DataFrame, name: str, place: str, order: str, methods: DataFrame | None = None) -> DataFrame:
    """Definition of each usage's name: the first in the same place, else the first anywhere, else the first method of the name.

    Methods, where they are given, have the same columns as symbols. One aggregate a level, no pairs.
    """
    near = symbols.groupBy(name, place).agg(F.min(order).alias("near"))
    far = symbols.groupBy(name).agg(F.min(order).alias("far"))
    out = usages.join(near, [name, place], "left").join(far, name, "left")
    if methods is None:
        return out.withColumn("definition", F.coalesce("near", "far")).drop("near", "far")
    out = out.join(methods.groupBy(name).agg(F.min(order).alias("method")), name, "left")
    return out.withColumn("definition", F.coalesce("near", "far", "method")).drop("near", "far", "method")


#: Columns of a symbol table, of its names' trigrams and of its references.
SYMBOLS = "id string, name string, type string, file_path string, class_name string, parameters array<string>, return_type string, language string"
POSTINGS = "trigram string, name string"
REFERENCES = "symbol_id string, file_path string, line int, ref_type string"


class SymbolIndex:
    """A symbol table, the trigrams of its names and its references as append-only Parquet under one folder; seq keeps the order of insertion.

    Names' trigrams are written before their symbols, so an interrupted add() leaves postings without a symbol at most. Each add() is a batch; within it the order is that of (file_path, line) if there is a line, else of the id. clear()
    empties the index. Nothing is cached beside the files, so there is nothing to invalidate.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, kind: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}") if self._there(kind) else self.spark.createDataFrame([], schema)

    def _add(self, kind: str, schema: str, rows: DataFrame, order: list[str]) -> None:
        batch = (self._read(kind, f"{schema}, seq struct<batch:int,row:long>").agg(F.max("seq.batch")).first()[0] or 0) + 1
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        seq = F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")).alias("seq")
        rows.select(*(x.split()[0] for x in schema.split(", ")), seq).write.mode("append").parquet(f"{self.path}/{kind}")

    def add(self, symbols: DataFrame) -> None:
        names, known = symbols.select("name"), self._read("trigrams", POSTINGS)
        if not self._there("trigrams"):
            names = names.unionByName(self.symbols().select("name"))
        fresh = trigrams(names.join(known.select("name").distinct(), "name", "left_anti"))
        # In order of the trigrams, so that a search skips the files and row groups of others.
        fresh.repartitionByRange("trigram").sortWithinPartitions("trigram", "name").write.mode("append").parquet(f"{self.path}/trigrams")
        self._add("symbols", SYMBOLS, symbols, ["file_path", "line"] if "line" in symbols.columns else ["id"])

    def add_references(self, references: DataFrame) -> None:
        self._add("references", REFERENCES, references, ["file_path", "line"])

    def symbols(self) -> DataFrame:
        return self._read("symbols", f"{SYMBOLS}, seq struct<batch:int,row:long>")

    def search(self, q: Query) -> DataFrame:
        """search() over the index; patterns read its trigrams."""
        return search(self.symbols(), q, self._read("trigrams", POSTINGS) if self._there("trigrams") else None)

    def references(self, symbol_id: str) -> DataFrame:
        return self._read("references", f"{REFERENCES}, seq struct<batch:int,row:long>").where(F.col("symbol_id") == symbol_id)

    def lookup(self, **key: str) -> DataFrame:
        """Symbols with the given column values, in order of insertion."""
        rows = self.symbols()
        for column, value in key.items():
            rows = rows.where(F.col(column) == value)
        return rows.orderBy("seq")

    def last(self, **key: str) -> DataFrame:
        """The last of them."""
        return self.lookup(**key).orderBy(F.desc("seq")).limit(1)

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def statistics(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
