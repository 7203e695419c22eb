"""Scalar functions over expressions, paths and snippets; all are plain Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_LIMIT = 100

#: Variable names by language. Fixed values, but for the guards in front.
_WORD = r"(?<![A-Za-z0-9_])[a-zA-Z_][a-zA-Z0-9_]*"
_SCRIPT = r"(?<![A-Za-z0-9_$])[a-zA-Z_$][a-zA-Z0-9_$]*"
VARIABLES = {
    "php": r"\$[a-zA-Z_][a-zA-Z0-9_]*", "javascript": _SCRIPT, "typescript": _SCRIPT, "ruby": r"(?<![A-Za-z0-9_])(?:@{1,2}|\$)?[a-zA-Z_][a-zA-Z0-9_]*",
    "python": _WORD, "go": _WORD, "java": _WORD, "c": _WORD, "cpp": _WORD, "c_sharp": _WORD, "rust": _WORD,
}
#: Other languages: names with the sigils of any.
ANY_VARIABLE = r"[$@]{0,2}[A-Za-z_][A-Za-z0-9_]*"
#: Members of an object count as variables of their own in PHP.
PHP_MEMBER = r"\$\w+->\w+"


def normalise_snippet(text: Column, limit: int = SNIPPET_LIMIT) -> Column:
    """Line ends and white space as single spaces, trimmed, cut at `limit` characters with three dots."""
    flat = F.trim(F.regexp_replace(F.translate(text, "\n\t\r", "  "), "  +", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a path glob: ** is any text, * any text without a slash, ? one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "."}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def quoted(text: Column) -> Column:
    """text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def mentions(expression: Column, variable: Column) -> Column:
    """The expression names the variable as a whole word. Sigils belong to the name; guards consume one ASCII character."""
    left = F.when(variable.rlike(r"^[$@]"), F.lit(r"(?:^|[^A-Za-z0-9_$@])")).otherwise(F.lit(r"(?:^|[^A-Za-z0-9_])"))
    return F.regexp_like(expression, F.concat(left, quoted(variable), F.lit(r"(?:[^A-Za-z0-9_]|$)")))


def refers_to(value: Column, variable: Column) -> Column:
    """value is the variable, a member of it, or mentions it."""
    return (value == variable) | value.startswith(F.concat(variable, F.lit("."))) | value.startswith(F.concat(variable, F.lit("["))) | mentions(value, variable)


def variables_of(expression: Column, language: Column | None = None) -> Column:
    """Distinct variable names in the expression, by its language's pattern."""
    found = lambda pattern: F.regexp_extract_all(expression, F.lit(f"({pattern})"), F.lit(1))
    out = found(ANY_VARIABLE)
    if language is not None:
        for pattern in dict.fromkeys(VARIABLES.values()):
            names = [k for k, v in VARIABLES.items() if v == pattern]
            out = F.when(language.isin(*names), F.concat(found(pattern), found(PHP_MEMBER)) if "php" in names else found(pattern)).otherwise(out)
    return F.array_distinct(out)


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def bracket_key(text: Column) -> Column:
    """Key of a subscript: a quoted string, else a $variable."""
    return F.coalesce(_group(text, r"""\[\s*['"]([^'"]+)['"]\s*\]"""), _group(text, r"\[\s*(\$\w+)\s*\]"), F.lit(""))


def member_key(text: Column, prefix: str) -> Column:
    """Key after `prefix`: a quoted subscript, else a member name."""
    p = re.escape(prefix)
    return F.coalesce(_group(text, p + r"""\[\s*['"]([^'"]+)['"]\s*\]"""), _group(text, p + r"\.(\w+)"), F.lit(""))


def base_variable(text: Column) -> Column:
    """$v['a']['b'] to $v['a']; $v alone stays."""
    return F.coalesce(_group(text, r"^(\$\w+\[[^\]]*\])"), _group(text, r"^(\$\w+)"), text)


def signature_key(text: Column) -> Column:
    return F.lower(F.translate(text, " \t", ""))


def short_path(path: Column) -> Column:
    """Last two segments."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, path).otherwise(F.array_join(F.slice(parts, -2, 2), "/"))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


def escaped_label(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(out, '"', r"\\\""), r"\n", r"\\n")


def line_at(content: Column, line: Column) -> Column:
    """Line number `line` (from 1), or null; the text isn't split as a whole."""
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    upto = F.call_function("substring_index", content, F.lit("\n"), line.cast("int"))
    return F.when((line >= 1) & (line <= lines), F.substring_index(upto, "\n", -1))


def line_with(body: Column, start: Column, part: Column) -> Column:
    """Number of the body's first line that holds part, the body starting on line `start`; start if none does."""
    before = F.call_function("substring_index", body, part, F.lit(1))
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(F.contains(body, part) & (part != ""), start + newlines).otherwise(start)


def finding_file(finding: Column) -> Column:
    """File name in a finding's id ("<class>_finding_<n>_<path>"); the id itself if it has another form."""
    rest = F.element_at(F.split(finding, "_finding_"), 2)
    path = F.regexp_extract(rest, r"(?s)^[^_]*_(.*)$", 1)
    return F.when((F.size(F.split(finding, "_finding_")) >= 2) & F.contains(rest, F.lit("_")), path).otherwise(finding)


def key_of_parts(*parts: Column) -> Column:
    """Id of a symbol, node or method: its parts joined by colons."""
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def diff_line(line: Column) -> Column:
    """The line without a leading +, - or space of a diff."""
    return F.regexp_replace(line, r"^[+\- ]", "")


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
