"""Snippets: expressions in code lines, their kinds and whether they read input."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tributary.functions.text import bracket_key, diff_line
from tributary.operators.detect import over_blocks

#: Names of PHP's superglobals and the source type of each. Fixed values.
SUPERGLOBALS = {
    "_GET": "http_get",
    "_POST": "http_post",
    "_REQUEST": "http_request",
    "_COOKIE": "http_cookie",
    "_SERVER": "http_header",
    "_FILES": "http_file",
    "_ENV": "env_var",
    "_SESSION": "session",
}
_NAMES = "|".join(SUPERGLOBALS)
SUPERGLOBAL = rf"\$(?:{_NAMES})\b"
#: Kinds of expression, first match wins. Fixed values.
KINDS = [
    ("chain", r"^\$\w+(?:->\w+(?:\([^)]*\))?){2,}$"),
    ("superglobal", rf"^\$(?:{_NAMES})\b"),
    ("static_call", r"^\w+::\w+\("),
    ("static_property", r"^\w+::\$\w+"),
    ("method_call", r"^\$\w+->\w+\("),
    ("property_access", r"^\$\w+->\w+"),
    ("function_call", r"^\w+\("),
    ("local_variable", r"^\$\w+"),
]
#: What counts as an expression inside a line, most specific first. Fixed values.
PIECES = [rf"(\$(?:{_NAMES})(?:\[[^\]]*\])*)", r"(\$\w+->\w+\([^)]*\))", r"(\$\w+->\w++(?:\[[^\]]*\])?+)(?!\s*\()", r"(\w+::\$?\w+(?:\([^)]*\))?)"]


#: Expressions in a snippet's line, in the order in which they count: kind, pattern, and the groups of object, member and key (0:
#: none). Fixed values.
_KEYED = r"\$(\w+)->(\w+)\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"
EMBEDDED = [
    ("superglobal", r"\$_(GET|POST|COOKIE|REQUEST|SERVER|FILES|SESSION|ENV)\[['\"]?([\w\-]+)['\"]?\]", (1, 0, 2)),
    ("property_access", r"\$(\w+)->(\w+)\[['\"]?([\w\-]+)['\"]?\]", (1, 2, 3)),
    ("method_call", r"\$(\w+)->(\w+)\s*\(\s*['\"]([^'\"]*)['\"]\s*(?:,\s*[^)]+)?\s*\)", (1, 2, 3)),
    ("sql_embedded", r"\{\s*" + _KEYED + r"\s*\}", (1, 2, 3)),
    ("sql_embedded", r"\{\s*\$(\w+)->(\w+)\s*\}", (1, 2, 0)),
    ("sql_embedded", r"\"\s*[^\"]*" + _KEYED, (1, 2, 3)),
    ("concatenated", r"\.\s*" + _KEYED + r"\s*\.", (1, 2, 3)),
    ("concatenated", r"\.\s*\$(\w+)->(\w+)\s*\.", (1, 2, 0)),
    ("escaped", r"(\w*escape\w*)\s*\(\s*" + _KEYED + r"\s*\)", (2, 3, 4)),
    ("escaped", r"(\w*escape\w*)\s*\(\s*\$(\w+)->(\w+)\s*\)", (2, 3, 0)),
    ("escaped", r"(\w*escape\w*)\s*\(\s*\$(\w+)\s*\)", (2, 0, 0)),
]
CALL_START = re.compile(r"\$(\w+)->(\w+)\s*\(")


def _as_expression(rank: int, kind: str, pattern: str, groups: tuple[int, int, int]):
    """Function from a whole match of an EMBEDDED pattern to its expression in one form, with its parts."""

    def one(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, pattern, k) if k else F.lit("")
        obj, member, key = (part(k) for k in groups)
        if kind == "superglobal":
            text = [F.lit("$_"), obj, F.lit("['"), key, F.lit("']")]
        elif kind == "method_call":
            text = [F.lit("$"), obj, F.lit("->"), member, F.lit("('"), key, F.lit("')")]
        else:
            text = [F.lit("$"), obj, *([F.lit("->"), member] if groups[1] else []), *([F.lit("['"), key, F.lit("']")] if groups[2] else [])]
        wrapper = part(1) if kind == "escaped" else F.lit("")
        return F.struct(F.lit(rank).alias("rank"), F.concat(*text).alias("expression"), F.lit(kind).alias("kind"), obj.alias("object"), member.alias("member"), key.alias("key"), wrapper.alias("wrapper"))

    return one


def embedded(snippets: DataFrame) -> DataFrame:
    """Every traceable expression of a snippet once, by the kind that finds it first: snippet_id, expression, line, kind, object, member, key, wrapper.

    snippets: snippet_id, code. Lines are taken as they are, strings included.
    """
    lines = snippets.select("snippet_id", F.posexplode(F.split("code", "\n")).alias("at", "text"))
    found = [F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), _as_expression(rank, kind, pattern, groups)) for rank, (kind, pattern, groups) in enumerate(EMBEDDED)]
    rows = lines.select("snippet_id", (F.col("at") + 1).alias("line"), F.explode(F.concat(*found)).alias("e"))
    first = rows.groupBy("snippet_id", F.col("e.expression").alias("expression")).agg(F.min(F.struct("line", "e")).alias("first"))
    return first.select("snippet_id", "expression", F.col("first.line").alias("line"), *(F.col(f"first.e.{c}").alias(c) for c in ("kind", "object", "member", "key", "wrapper")))


CALL = StructType([StructField(c, StringType()) for c in ("receiver", "method", "expression")])


@F.pandas_udf(ArrayType(CALL))
def _whole_calls(lines: pd.Series) -> pd.Series:
    """Method calls with all of their arguments; brackets inside strings don't count. Calls that the line doesn't close are left out."""

    def calls(line: str | None) -> list[dict]:
        out = []
        for m in CALL_START.finditer(line or ""):
            depth, i, quote = 1, m.end(), ""
            while i < len(line) and depth:
                c = line[i]
                if quote:
                    i += c == "\\"
                    quote = "" if c == quote else quote
                elif c in "\"'":
                    quote = c
                else:
                    depth += (c == "(") - (c == ")")
                i += 1
            if not depth:
                out.append({"receiver": m.group(1), "method": m.group(2), "expression": line[m.start() : i]})
        return out

    return lines.map(calls)


def method_calls(snippets: DataFrame, methods: DataFrame) -> DataFrame:
    """(snippet_id, line, expression): whole calls of methods that return input or read files or commands, by a method table."""
    from tributary.operators.registry import input_methods_of

    lines = snippets.select("snippet_id", F.posexplode(F.split("code", "\n")).alias("at", "text")).where(F.contains("text", F.lit("->")))
    rows = lines.select("snippet_id", (F.col("at") + 1).alias("line"), F.explode(_whole_calls("text")).alias("c")).select("snippet_id", "line", "c.*")
    known = input_methods_of(rows.select("receiver", "method").distinct(), methods).where("is_input or is_interesting").select("receiver", "method")
    return rows.join(known, ["receiver", "method"], "left_semi").select("snippet_id", "line", "expression")


def expression_kind(expression: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(KINDS):
        out = F.when(expression.rlike(pattern), name).otherwise(out)
    return out


def reads_directly(expression: Column) -> Column:
    """A superglobal is part of the expression's own value. One that is an argument of a function doesn't make its result input;
    calls count up to six levels deep."""
    bare = expression
    for _ in range(6):
        bare = F.regexp_replace(bare, r"[\w\\>:]*\w\s*\([^()]*\)", "_call")
    return bare.rlike(SUPERGLOBAL)


def superglobal_type(expression: Column) -> Column:
    """Source type of the first superglobal in the expression, or null."""
    name = F.regexp_extract(expression, rf"\$({_NAMES})\b", 1)
    out = F.lit(None).cast("string")
    for k, v in SUPERGLOBALS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def expressions(snippets: DataFrame) -> DataFrame:
    """(snippet_id, expression, line, kind, key, source_type): each expression of a snippet once, at its first line.

    snippets: snippet_id, code. Comments, includes and definitions are skipped; a diff's leading marks are dropped.
    """
    lines = snippets.select("snippet_id", F.posexplode(F.split("code", "\n")).alias("line", "raw"))
    text = F.trim(diff_line(F.col("raw")))
    lines = lines.withColumn("text", text).where(~F.col("text").rlike(r"^(//|#|\*|/\*|include|require|function |class |define\()"))
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in PIECES))
    rows = lines.select("snippet_id", "line", F.explode(F.array_distinct(found)).alias("expression"))
    first = rows.groupBy("snippet_id", "expression").agg((F.min("line") + 1).alias("line"))
    e = F.col("expression")
    return first.select("snippet_id", "expression", "line", expression_kind(e).alias("kind"), bracket_key(e).alias("key"), superglobal_type(e).alias("source_type"))


def classify(snippets: DataFrame, carriers: DataFrame) -> DataFrame:
    """expressions() with source types of carriers (pattern, source_types) where the expression itself names no superglobal.

    Carriers grow with the code base: with a column `member` they are joined by the members that an expression names.
    """
    found = expressions(snippets)
    bare = found.where("source_type is null").select("snippet_id", "expression")
    if "member" in carriers.columns:
        named = bare.withColumn("member", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"(?:->|::\$?)(\w+)"), F.lit(1)))))
        hits = named.join(carriers, "member").where(F.regexp_like("expression", F.col("pattern")))
    else:
        hits = over_blocks(carriers, lambda c: bare.join(c, F.regexp_like("expression", F.col("pattern"))))
    first = hits.groupBy("snippet_id", "expression").agg(F.min(F.struct("pattern", "source_types")).alias("first"))
    out = found.join(first, ["snippet_id", "expression"], "left")
    types = F.coalesce(F.when(F.col("source_type").isNotNull(), F.array("source_type")), F.col("first.source_types"), F.array().cast("array<string>"))
    needs = (F.size(types) == 0) & F.col("kind").isin("chain", "static_call", "static_property", "method_call", "property_access", "local_variable")
    return out.select("snippet_id", "expression", "line", "kind", "key", types.alias("source_types"), needs.alias("needs_tracing"))


def by_type(classified: DataFrame) -> DataFrame:
    """(source_type, n_expressions, n_snippets) over a batch of classified snippets."""
    pairs = classified.select("snippet_id", F.explode("source_types").alias("source_type")).groupBy("source_type", "snippet_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("source_type").agg(F.sum("n").alias("n_expressions"), F.count(F.lit(1)).alias("n_snippets"))


def batch_totals(snippets: DataFrame, classified: DataFrame) -> DataFrame:
    """(metric, value) of a batch: snippets, those with input, expressions, those that read input."""
    per = totals(classified)
    counts = per.agg(F.count_if(F.col("n_input") > 0).alias("with_input"), F.coalesce(F.sum("n_expressions"), F.lit(0)).alias("expressions"), F.coalesce(F.sum("n_input"), F.lit(0)).alias("input_expressions"))
    out = snippets.select("snippet_id").distinct().agg(F.count(F.lit(1)).alias("snippets")).crossJoin(counts)  # one row each
    return out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("snippets", "with_input", "expressions", "input_expressions")))).alias("m")).select("m.*")


def totals(classified: DataFrame) -> DataFrame:
    """Per snippet: expressions, those that read input, those to trace, distinct source types."""
    return classified.groupBy("snippet_id").agg(
        F.count(F.lit(1)).alias("n_expressions"),
        F.count_if(F.size("source_types") > 0).alias("n_input"),
        F.count_if("needs_tracing").alias("n_needs_tracing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_types")))).alias("source_types"),
    )
