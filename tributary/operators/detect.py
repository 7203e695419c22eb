"""Pattern scans: rules, a small dimension table, matched against texts or parsed nodes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tributary.functions.text import normalise_snippet
from tributary.rules.keywords import required_words
from tributary.rules.local import small_table

#: Rules that one broadcast may hold.
MAX_RULES = 10_000


def blocks(rules: DataFrame) -> list[DataFrame]:
    """A rule table for broadcast joins: whole if it has MAX_RULES rows at most, else in about as many blocks as needed."""
    parts = -(-rules.count() // MAX_RULES)
    if parts <= 1:
        return [F.broadcast(rules)]
    block = F.pmod(F.xxhash64(*rules.columns), F.lit(parts))
    return [F.broadcast(rules.where(block == k)) for k in range(parts)]


def over_blocks(rules: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of join(block) over the rule table's blocks."""
    out = None
    for block in blocks(rules):
        part = join(block)
        out = part if out is None else out.unionByName(part)
    return out


def candidates(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds some pattern of its language's rules, by one constant expression per language.

    The join with the rules compiles a pattern for almost each row; this pass compiles each once and leaves it few rows. More
    than MAX_RULES rules, or patterns with back references, keep all rows.
    """
    table = rules.select("language", "pattern").distinct().limit(MAX_RULES + 1).collect()
    if len(table) > MAX_RULES:
        return rows
    return _holding(rows, text, [(r["language"], r["pattern"]) for r in table])


def _holding(rows: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    by: dict[str, list[str]] = {}
    for language, pattern in patterns:
        by.setdefault(language, []).append(pattern)
    keep = F.lit(False)
    for language, held in sorted(by.items()):
        hit = F.lit(True) if any(re.search(r"\\[1-9k]", x) for x in held) else F.col(text).rlike("|".join(f"(?:{x})" for x in sorted(set(held))))
        keep = F.when(F.col("language") == language, hit).otherwise(keep)
    return rows.where(keep)


def postings(rules: list[Row]) -> list[tuple[str, Row]]:
    """(keyword, rule): the index from required words to rules; keyword '' for a rule whose pattern needs none."""
    return [(word, r) for r in rules for word in sorted(required_words(r["pattern"]) or {""})]


def dispatched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes joined with the rules of their language whose pattern their text holds.

    A node meets a rule only by a word that the rule's pattern needs: the text's words are looked up in postings(), so one node tries
    the few patterns that it may hold. Patterns without a required word are tried by one constant expression per language first.
    More than MAX_RULES rules are joined block by block.
    """
    table = rules.limit(MAX_RULES + 1).collect()
    if len(table) > MAX_RULES:
        return over_blocks(rules, lambda r: nodes.join(r, "language").where(F.regexp_like("text", F.col("pattern"))))
    index = postings(table)
    schema = StructType([StructField("keyword", StringType()), *rules.schema.fields])
    # Local tables of a counted size.
    local = lambda rows: F.broadcast(small_table(nodes.sparkSession, [{"keyword": w} | r.asDict() for w, r in rows], schema))
    words = F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))
    by_word = nodes.withColumn("keyword", F.explode(F.filter(words, lambda w: w != "")))
    by_word = by_word.join(local([x for x in index if x[0]]), ["language", "keyword"]).where(F.regexp_like("text", F.col("pattern"))).drop("keyword")
    if len(index) > len(table):  # a node may meet a rule by several words
        by_word = by_word.distinct()
    rest = [x for x in index if not x[0]]
    if not rest:
        return by_word
    tried = _holding(nodes, "text", [(r["language"], r["pattern"]) for _, r in rest]).join(local(rest), "language").where(F.regexp_like("text", F.col("pattern"))).drop("keyword")
    return by_word.unionByName(tried)


#: Stands before each match while a text is cut at its matches.
_CUT = "\x01"


def match_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per node, rule of its language and key of a match of the rule's pattern in the node's text, if node types (none: any) fit.

    Each match has its own key: the first that the key pattern finds between it and the next match. A single match's may lie anywhere
    in the text. Matches with one key are one row. `matched` is the first match's text.
    nodes: file_path, line, language, node_type, text, variable (more columns stay). rules: name, language, pattern, node_types, key_pattern, labels.
    """
    more = [c for c in nodes.columns if c not in ("file_path", "line", "language", "node_type", "text", "variable")]
    table = rules.select("language", F.col("name").alias("source_type"), "pattern", "node_types", "key_pattern", "labels")
    fits = (F.size("node_types") == 0) | F.array_contains("node_types", F.col("node_type"))
    hits = dispatched(nodes, table).where(fits)
    pieces = F.split(F.regexp_replace(F.col("text"), F.col("pattern"), F.lit(_CUT + "$0")), _CUT)
    hits = hits.withColumn("piece", F.explode(F.slice(pieces, 2, 2**30))).withColumn("single", F.size(pieces) == 2)
    key_in = lambda text: F.call_function("regexp_extract", text, F.col("key_pattern"), F.lit(1))
    key = F.when(F.col("key_pattern") != "", F.coalesce(F.nullif(key_in(F.col("piece")), F.lit("")), F.when(F.col("single"), key_in(F.col("text"))), F.lit(""))).otherwise("")
    matched = F.call_function("regexp_extract", F.col("piece"), F.col("pattern"), F.lit(0))
    found = hits.select("file_path", "line", "language", "source_type", key.alias("key"), "variable", normalise_snippet(F.col("text")).alias("snippet"), "labels", *more, F.when(matched != "", matched).otherwise(F.col("piece")).alias("matched"), "text", "pattern")
    once = ["file_path", "line", "language", "source_type", "key", "variable", "text", "pattern", *(c for c in more if c in ("seq", "place"))]
    rest = [c for c in found.columns if c not in once]
    return found.groupBy(*once).agg(F.min(F.struct(*rest)).alias("first")).select("file_path", "line", "language", "source_type", "key", "variable", "first.snippet", "first.labels", *(c if c in once else F.col(f"first.{c}").alias(c) for c in more), F.col("first.matched").alias("matched"))


def keys_in(rows: DataFrame, key: str, text: str, pattern: str, source_type: str) -> DataFrame:
    """(key column, source_type, key): every first group of pattern in the text."""
    return rows.select(key, F.lit(source_type).alias("source_type"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("key"))


def text_rules(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(key column, rule): rules whose pattern the text holds. One pass over the texts, all rules at once; plain words aren't
    compiled to patterns."""
    plain = lambda pattern: re.fullmatch(r"[\w !\"#%&',:;<=>@~-]+", pattern) is not None
    holds = lambda pattern: F.contains(F.col(text), F.lit(pattern)) if plain(pattern) else F.col(text).rlike(pattern)
    hits = F.array(*(F.when(holds(pattern), F.lit(name)) for name, pattern in rules))
    return rows.select(key, F.explode(F.array_compact(hits)).alias("rule"))


def by_priority(candidates: DataFrame, key: list[str], priority: list[str]) -> DataFrame:
    """The first candidate of each key."""
    rest = [c for c in candidates.columns if c not in key]
    order = [*priority, *(c for c in rest if c not in priority)]
    return candidates.groupBy(*key).agg(F.min(F.struct(*order)).alias("first")).select(*key, *(F.col(f"first.{c}").alias(c) for c in rest))
