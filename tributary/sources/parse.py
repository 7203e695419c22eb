"""Facts of source texts: functions, classes, assignments, calls, returns and imports, from a tokenizer of statements.

The tokenizer knows strings, comments, brackets and where a statement ends in each language, so a statement may span lines and
a line hold several. One pass per file runs inside mapInArrow; all kinds of fact share one table, told apart by `kind`.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FACTS = "file_path string, language string, kind string, seq long, line int, end_line int, name string, class_name string, scope string, target string, expression string, args array<string>, text string, modifiers string, bases array<string>, result string, receiver string, key_path string, target_type string, place long, scopes array<string>, declared boolean"

#: Comment openings and names by language. Fixed values.
HASH_COMMENTS = {"python", "ruby", "php"}
SLASH_COMMENTS = {"php", "javascript", "typescript", "go", "java", "c", "cpp", "c_sharp", "rust"}
FUNCTION = {
    "php": r"\bfunction\s+&?(\w+)\s*\(([^)]*)\)",
    "javascript": r"\bfunction\s*\*?\s*(\w+)\s*\(([^)]*)\)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>|^\s*(?:async\s+)?(?!if|for|while|switch|catch|function|return)(\w+)\s*\(([^)]*)\)\s*\{",
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)",
    "java": r"(?:public|private|protected|static)\s+(?:[\w<>\[\],]+\s+)+(\w+)\s*\(([^)]*)\)",
    "c": r"^\w[\w\s*&:<>]*?[\s*&](\w+)\s*\(([^;{)]*)\)\s*\{",
    "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)\s*(?:\(([^)]*)\))?",
    "rust": r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)",
}
FUNCTION |= {"typescript": FUNCTION["javascript"], "cpp": FUNCTION["c"], "c_sharp": FUNCTION["java"]}
CLASS = re.compile(r"\b(?:class|interface|trait|struct|impl)\s+(\w+)")
IMPORT = re.compile(r"""^\s*(?:(?:include|require)(?:_once)?\b|import\b|from\b|use\b|#include\b|using\b).*|\brequire\s*\(['"][^'"]+['"]\)""")
ASSIGN = re.compile(r"^(.*?[^=!<>:+\-*/.%&|^~\s])\s*(:=|\+=|\.=|-=|\*=|/=|\|\|=|\?\?=|=)(?![=>~])\s*(.+)$", re.DOTALL)
NAME = re.compile(r"[A-Za-z_$@][\w$]*(?:(?:->|::|\.|\\)\$?\w+)*\s*\(")
NO_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "foreach", "elseif", "and", "or", "not", "in", "array", "isset", "empty", "def", "fn", "func"}


_COMMENT = re.compile(r"[\"'`#]|//|/\*")
#: What a string holds by its quote, up to the quote or the line's end.
_HELD = {q: re.compile(rf"(?:\\.|[^\\{q}{chr(92) + 'n' if q != '`' else ''}])*", re.DOTALL) for q in "\"'`"}


def blank_comments(text: str, language: str) -> str:
    """text with comments as spaces, so that lines and columns stay. Strings keep their content."""
    out, last, i = [], 0, 0
    while m := _COMMENT.search(text, i):
        mark, at = m.group(0), m.start()
        if mark in _HELD:
            i = _HELD[mark].match(text, at + 1).end() + 1
            continue
        if language not in (HASH_COMMENTS if mark == "#" else SLASH_COMMENTS):
            i = at + 1
            continue
        end = text.find("*/", at + 2) + 2 if mark == "/*" else text.find("\n", at)
        i = len(text) if end < (2 if mark == "/*" else 0) else end
        out += [text[last:at], re.sub(r"[^\n]", " ", text[at:i])]
        last = i
    return "".join([*out, text[last:]])


class _Lines(Sequence):
    """A text's lines, cut when they are asked for: numbers instead of a copy of the text."""

    def __init__(self, text: str):
        self.text = text
        self.starts = array("q", [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, k: int) -> str:
        return self.text[self.starts[k] : self.starts[k + 1] - 1]

    def between(self, first: int, last: int) -> str:
        """Lines first to last as one text."""
        return self.text[self.starts[first] : self.starts[last + 1] - 1]


def balanced(text: str, at: int) -> int:
    """Index after the bracket that closes the one at `at`, quotes and escapes respected; the text's end if none does."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    stack, i = [], at
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return len(text)


def split_arguments(text: str) -> list[str]:
    """Top-level comma split."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[last:i].strip())
            last = i + 1
        i += 1
    tail = text[last:].strip()
    return [*out, tail] if tail or out else []


def parameter_name(text: str, language: str) -> str:
    """The name in a parameter's declaration."""
    text = text.split("=")[0].strip()
    if language in ("php",):
        found = re.search(r"\$\w+", text)
    elif language in ("go", "python", "rust", "typescript", "ruby", "javascript"):
        found = re.match(r"[&*]*(?:mut\s+)?(\w+)", text)
        return found.group(1) if found else ""
    else:
        found = re.search(r"(\w+)\s*(?:\[\s*\])?$", text)
        return found.group(1) if found else ""
    return found.group(0) if found else ""


def targets_of(text: str, language: str) -> list[str]:
    """The targets on an assignment's left side: several where it takes a value apart (list($a, $b), [$a, $b], {a, b: c}, a, b)."""
    text = re.sub(r"^\s*(?:const|let|var|auto|final|mut)\b", "", text).strip()
    apart = re.match(r"(?:list|array)\s*\((.*)\)$|\[(.*)\]$|\{(.*)\}$|\((.*)\)$", text, re.DOTALL)
    if apart:
        inside = next(g for g in apart.groups() if g is not None)
    elif language in ("python", "go", "ruby") and len(split_arguments(text)) > 1:
        inside = text
    else:
        return [clean_target(text)]
    out = []
    for part in split_arguments(inside):
        # 'key' => $target, key: target, target = default, ...rest
        part = re.split(r"=>|(?<!:):(?!:)", part)[-1].split("=")[0].strip().lstrip(".*&")
        if re.match(r"(?:list|array)\s*\(|[\[({]", part):
            out += targets_of(part, language)
        elif part and part != "_":
            out.append(clean_target(part))
    return [x for x in out if x]


def clean_target(text: str) -> str:
    """Last word of an assignment's left side, without declaration words or types."""
    text = re.sub(r"\b(?:const|let|var|auto|final|mut|static|public|private|protected)\b", " ", text).strip()
    text = re.sub(r"^(.*?):\s*[\w<>\[\], |]+$", r"\1", text)
    words = text.split()
    return words[-1].lstrip("*&") if words else ""


def _end_of(lines: Sequence[str], start: int, language: str) -> int:
    """Last line (0-based) of the block that opens at `start`."""
    if language == "python":
        indent = len(lines[start]) - len(lines[start].lstrip())
        end = start
        for k in range(start + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                end = k
        return end
    if language == "ruby":
        depth = 0
        for k in range(start, len(lines)):
            depth += len(re.findall(r"\b(?:def|class|module|do|begin|case)\b|^\s*(?:if|unless|while|until)\b", lines[k])) - len(re.findall(r"\bend\b", lines[k]))
            if depth <= 0:
                return k
        return len(lines) - 1
    depth, seen = 0, False
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        seen = seen or "{" in lines[k]
        if seen and depth <= 0:
            return k
    return len(lines) - 1


#: Languages whose statements end with a semicolon; in the others a line's end does, too.
TERMINATED = {"php", "java", "c", "cpp", "c_sharp", "rust"}
_MARK = re.compile(r"\"\"\"|\'\'\'|[\"'`(){}\[\];\n]|<\?(?:php\b|=)?|\?>")
_BLOCK_WORD = re.compile(r"^\W*(?:if|else|elif|elseif|for|foreach|while|do|switch|case|default|try|catch|finally|func|function|fn|def|class|interface|trait|struct|impl|namespace|match|loop|unsafe|module|enum)\b")


def _string_end(text: str, at: int, quote: str, language: str) -> int:
    """Index after the string that opens at `at`; after the quote alone where its line doesn't close it."""
    if len(quote) == 3:
        end = text.find(quote, at + 3)
        return end + 3 if end >= 0 else len(text)
    if quote == "'" and language == "rust" and not re.match(r"'(?:\\.|[^'\\])'", text[at : at + 4]):
        return at + 1
    spans = quote == "`" or language == "php"
    i = at + 1
    while i < len(text) and text[i] != quote:
        if text[i] == "\n" and not spans:
            return at + 1
        i += 2 if text[i] == "\\" else 1
    return i + 1 if i < len(text) else at + 1


def _opens_literal(head: str, language: str) -> bool:
    """A brace after `head` opens a literal, not a block."""
    head = head.rstrip()
    if head.endswith("=>"):
        return False
    if head and head[-1] in "=(,:?[&|+" or re.search(r"\b(?:return|const|let|var)$", head):
        return True
    return language == "go" and bool(ASSIGN.match(head)) and head[-1:] != ")" and not _BLOCK_WORD.match(head)


def _continues(head: str, rest: str, language: str) -> bool:
    """A statement goes on after the line's end."""
    head = head.rstrip(" \t")
    if language == "python":
        return head.endswith("\\")
    if head.endswith(("++", "--", "=>")) or not head:
        return False
    if head[-1] in ",+.&|=?":
        return True
    return language in ("javascript", "typescript", "ruby") and rest.lstrip().startswith((".", "?.", "&&", "||"))


def statements(text: str, language: str) -> list[tuple[int, str]]:
    """(line, statement) of a text without comments, in order; lines count from 0. Headers of blocks end with a brace."""
    return [(line, body) for line, body, _ in nested_statements(text, language)]


def nested_statements(text: str, language: str) -> list[tuple[int, str, int]]:
    """statements() with the number of blocks that are open around each."""
    out: list[tuple[int, str, int]] = []
    parts: list[str] = []
    stack: list[int | None] = []  # of an open block the bracket depth around it; None for a literal's brace
    depth, line, first, at, n = 0, 0, -1, 0, len(text)
    in_code = language != "php" or "<?" not in text

    def take(piece: str) -> None:
        nonlocal first
        if first < 0 and piece.strip():
            first = line
        parts.append(piece)

    def flush(tail: str = "") -> None:
        nonlocal first
        body = re.sub(r"\s*\n\s*", " ", "".join(parts)).strip().lstrip(")]},").strip()
        if re.search(r"\w", body):
            out.append((first, body + tail, sum(x is not None for x in stack)))
        parts.clear()
        first = -1

    while at < n:
        m = _MARK.search(text, at)
        if m is None:
            if in_code:
                take(text[at:])
            break
        mark = m.group(0)
        if in_code:
            take(text[at : m.start()])
        at = m.end()
        if mark == "\n":
            if in_code:
                head = "".join(parts)
                if language in ("c", "cpp") and head.lstrip().startswith("#") and not head.rstrip().endswith("\\"):
                    flush()
                elif language not in TERMINATED and depth == 0 and not _continues(head, text[at : at + 200], language):
                    flush()
                else:
                    take("\n")
            line += 1
        elif mark.startswith("<?") or mark == "?>":
            if language == "php":
                if in_code:
                    flush()
                in_code = mark != "?>"
            else:
                take(mark)
        elif not in_code:
            continue
        elif mark[0] in "\"'`" and (len(mark) == 1 or language == "python"):
            end = _string_end(text, m.start(), mark, language)
            take(text[m.start() : end])
            line += text.count("\n", m.start(), end)
            at = end
        elif len(mark) == 3:  # two quotes and one more, outside Python
            at = m.start() + 2
            take(mark[:2])
        elif mark in "([":
            depth += 1
            take(mark)
        elif mark in ")]":
            depth = max(0, depth - 1)
            take(mark)
        elif mark == "{":
            if language == "python" or _opens_literal("".join(parts), language):
                stack.append(None)
                depth += 1
                take(mark)
            else:
                flush(" {")
                stack.append(depth)
                depth = 0
        elif mark == "}":
            if stack and stack[-1] is None:
                stack.pop()
                depth = max(0, depth - 1)
                take(mark)
            else:
                flush()
                depth = (stack.pop() or 0) if stack else 0
        elif depth == 0 or re.match(r"[ \t]*(?:\n|$)", text[at : at + 80]):
            # A semicolon; at a line's end it closes whatever brackets an odd text left open.
            depth = 0
            flush()
        else:
            take(mark)
    flush()
    return out


_EXTENDS = re.compile(r"\bextends\s+([\w\\., ]+?)(?=\s+implements\b|\s*\{|$)|\bimplements\s+([\w\\., ]+?)(?=\s+extends\b|\s*\{|$)|\bclass\s+\w+\s*\(([\w., ]+)\)\s*:|\bclass\s+\w+\s*<\s*([\w:]+)|\bclass\s+\w+\s*:\s*([\w:., ]+)")
_MODIFIERS = re.compile(r"\b(public|private|protected|static|abstract|final|async|const|readonly|var)\b")
_PROPERTY = re.compile(r"^(?:(?:public|private|protected|static|readonly|var|final)\s+)+(?:\??[\w\\|<>\[\]]+\s+)?(\$?\w+)\s*(?:=\s*(.*))?$", re.DOTALL)
_RESULT = re.compile(r"\)\s*(?::|->)\s*(\??[\w\\:<>\[\], |&]+?)\s*[:{]?\s*$")
_CONSTANT = re.compile(r"\bdefine\s*\(\s*['\"](\w+)['\"]\s*,\s*(.+)\)$|^(?:(?:public|private|protected)\s+)?const\s+(?:\w+\s+)?(\w+)\s*=\s*(.+)$|^#\s*define\s+(\w+)\s+(.+)$", re.DOTALL)
#: A left side that declares its name: a declaring word, or a type before the name.
_DECLARES = re.compile(r"(?:const|let|var|auto|final|mut|static)\b|[A-Za-z_][\w<>\[\],.:]*[\s*&]+\w+$")
_NAMESPACE = re.compile(r"^(?:namespace|package)\s+([\w.\\:]+)")


def target_type(target: str) -> tuple[str, str]:
    """Kind of an assignment's target (variable, property or array_element), and the keys of its subscripts joined by dots."""
    keys = re.findall(r"""\[\s*['"]?([^'"\]]*)['"]?\s*\]""", target)
    kind = "array_element" if keys else "property" if re.search(r"->|::|\.", target) else "variable"
    return kind, ".".join(keys)


def _call_kind(name: str, before: str) -> tuple[str, str]:
    """Kind of a call (function, method, static or new) and its receiver."""
    if re.search(r"\bnew\s*$", before):
        return "new", ""
    if "::" in name:
        return "static", name.rsplit("::", 1)[0]
    found = re.match(r"(.*)(?:->|\.)", name)
    return ("method", found.group(1)) if found else ("function", "")


def _close(body: list[tuple[int, str, int]], k: int, end: int, language: str) -> int:
    """Number of the last statement inside the block whose header is statement k: by open blocks, or in Python and Ruby by lines."""
    last = k
    for n in range(k + 1, len(body)):
        if body[n][0] > end if language in ("python", "ruby") else body[n][2] <= body[k][2]:
            break
        last = n
    return last


def _enclosing(spans: list[tuple[int, int, str]]) -> Callable[[int], list[str]]:
    """A function of k, asked in ascending order: names of the spans (first, last, name) with first < k <= last, the latest first."""
    now: list[tuple[int, int, str]] = []
    at = 0

    def names(k: int) -> list[str]:
        nonlocal now, at
        while at < len(spans) and spans[at][0] < k:
            now.append(spans[at])
            at += 1
        if any(x[1] < k for x in now):
            now = [x for x in now if x[1] >= k]
        return [x[2] for x in reversed(now)]

    return names


def parse(path: str, language: str, content: str) -> list[dict]:
    """Facts of one file, all at once; see iter_facts()."""
    return list(iter_facts(path, language, content))


def iter_facts(path: str, language: str, content: str) -> Iterator[dict]:
    """Facts of one file: classes and imports, functions, then what each statement holds, in order, one at a time.

    `place` numbers the statements; a class or function is the interval of statements from its header to its block's end. `scope` is
    the nearest enclosing function (a second one of its class and name has its line behind the name), `scopes` the enclosing
    functions' homes (class::scope) from the nearest out.
    """
    text = blank_comments(content or "", language)
    lines = _Lines(text)
    body = nested_statements(text, language)
    made = 0

    def fact(kind: str, line: int, place: int, **more) -> dict:
        nonlocal made
        made += 1
        none = {"name": "", "class_name": "", "scope": "", "target": "", "expression": "", "args": [], "text": "", "modifiers": "", "bases": [], "result": "", "receiver": "", "key_path": "", "target_type": ""}
        return {"file_path": path, "language": language, "kind": kind, "seq": made - 1, "line": line + 1, "end_line": line + 1} | none | {"place": place, "scopes": [], "declared": False} | more

    classes: list[tuple[int, int, str]] = []
    functions: list[tuple[int, int, str]] = []
    for k, (line, stmt, _) in enumerate(body):
        found = CLASS.search(stmt)
        if found and not re.search(r"['\"].*\bclass\b", stmt):
            end = _end_of(lines, line, language)
            bases = [x.strip() for m in _EXTENDS.finditer(stmt) for g in m.groups() if g for x in g.split(",") if x.strip()]
            classes.append((k, _close(body, k, end, language), found.group(1)))
            yield fact("class", line, k, end_line=end + 1, name=found.group(1), modifiers=found.group(0).split()[0], bases=bases)
        if IMPORT.search(stmt):
            yield fact("import", line, k, text=stmt.rstrip(";"))
        if m := _NAMESPACE.match(stmt):
            yield fact("namespace", line, k, name=m.group(1))
        if m := _CONSTANT.search(stmt):
            name, value = [g for g in m.groups() if g is not None][:2]
            yield fact("constant", line, k, name=name, expression=value.strip().rstrip("{").strip())
    owners = _enclosing(classes)
    pattern = re.compile(FUNCTION[language])
    headers = set()
    homes: list[tuple[int, int, str]] = []
    names: set[tuple[str, str]] = set()
    for k, (line, stmt, _) in enumerate(body):
        found = pattern.search(stmt)
        if found:
            groups = [g for g in found.groups() if g is not None]
            end = _end_of(lines, line, language)
            owner = next(iter(owners(k)), "")
            headers.add(k)
            params = [p for p in (parameter_name(x, language) for x in split_arguments(groups[1] if len(groups) > 1 else "")) if p and p not in ("self", "cls", "this")]
            result = _RESULT.search(stmt)
            scope = groups[0] if (owner, groups[0]) not in names else f"{groups[0]}@{line + 1}"
            names.add((owner, scope))
            close = _close(body, k, end, language)
            functions.append((k, close, scope))
            homes.append((k, close, f"{owner}::{scope}"))
            yield fact("function", line, k, end_line=end + 1, name=groups[0], class_name=owner, scope=scope, args=params, text=lines.between(line, end), modifiers=" ".join(_MODIFIERS.findall(stmt[: found.end()])), result=result.group(1).strip() if result else "")
    owners, within, around_homes = _enclosing(classes), _enclosing(functions), _enclosing(homes)
    for k, (line, stmt, _) in enumerate(body):
        code = stmt.rstrip("{").strip().rstrip(";").strip()
        if language in ("python", "ruby") and k in headers or not code:
            continue
        around = {"scope": next(iter(within(k)), ""), "class_name": next(iter(owners(k)), ""), "scopes": around_homes(k)}
        target = ""
        m = _PROPERTY.match(code) if around["class_name"] and not around["scope"] else None
        if m:
            yield fact("property", line, k, name=m.group(1), class_name=around["class_name"], modifiers=" ".join(_MODIFIERS.findall(code)), expression=(m.group(2) or "").strip())
        if k not in headers and (m := re.match(r"(?:global|nonlocal)\s+(.+)$", code)):
            for name in split_arguments(m.group(1)):
                yield fact("global", line, k, name=name, **around)
        if k not in headers or "=" in code.split("(")[0]:
            m = ASSIGN.match(code)
            if m and m.group(1).count("(") == m.group(1).count(")") and k not in headers:
                declared = m.group(2) == ":=" or bool(_DECLARES.match(m.group(1).strip()))
                for target in targets_of(m.group(1), language):
                    kind, keys = target_type(target)
                    yield fact("assignment", line, k, target=target, expression=m.group(3).strip(), name=m.group(2), text=code, target_type=kind, key_path=keys, declared=declared, **around)
        if k not in headers:
            if m := re.match(r"return\b\s*(.*)$", code, re.DOTALL):
                yield fact("return", line, k, expression=m.group(1).strip(), text=code, **around)
            for call in NAME.finditer(code):
                name = call.group(0)[:-1].strip()
                if name.lower() in NO_CALLS or (language == "php" and name.lower() == "list"):
                    continue
                end = balanced(code, call.end() - 1)
                kind, receiver = _call_kind(name, code[: call.start()])
                yield fact("call", line, k, name=name, args=split_arguments(code[call.end() : end - 1]), target=target, text=code[call.start() : end], target_type=kind, receiver=receiver, **around)
        yield fact("statement", line, k, text=code, target=target, **around)


#: Facts that a task holds before they leave.
FACT_ROWS = 1000


def facts(files: DataFrame) -> DataFrame:
    """FACTS of all files with content. Parsing costs far more than moving a text, so files are dealt evenly first.

    A task holds one file's text and statements; its facts leave in batches as they are made.
    """
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = iter_facts(*(c[k].as_py() for c in batch.columns))
                while some := list(islice(rows, FACT_ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema)

    return files.where("content is not null").select("file_path", "language", "content").repartition(n, "file_path").mapInArrow(emit, FACTS)


def assignments(table: DataFrame) -> DataFrame:
    return table.where("kind = 'assignment'").select("file_path", "language", "seq", "line", "target", F.col("expression").alias("source_expr"), "scope", "class_name", F.col("name").alias("operator"), "target_type", "key_path", "place", "scopes", "declared")


def calls(table: DataFrame) -> DataFrame:
    return table.where("kind = 'call'").select("file_path", "language", "seq", "line", F.col("name").alias("function_name"), "args", "target", "scope", "class_name", F.col("target_type").alias("call_kind"), "receiver", "place", "scopes", F.col("text").alias("call_text"))


def returns(table: DataFrame) -> DataFrame:
    return table.where("kind = 'return'").select("file_path", "language", "seq", "line", "expression", "scope", "class_name", "place", "scopes")


def classes(table: DataFrame) -> DataFrame:
    return table.where("kind = 'class'").select("file_path", "language", F.col("name").alias("class_name"), "line", "end_line", F.col("modifiers").alias("class_kind"), F.col("bases").alias("implements"))


def properties(table: DataFrame) -> DataFrame:
    """Members that a class declares; one without a visibility is public."""
    hidden = F.col("modifiers").rlike("private|protected")
    return table.where("kind = 'property'").select("file_path", "class_name", F.regexp_replace("name", r"^\$", "").alias("property"), "line", (~hidden).alias("is_public"), F.contains("modifiers", F.lit("static")).alias("is_static"), F.col("expression").alias("initial"))


def symbol_table(table: DataFrame) -> DataFrame:
    """(file_path, kind, name, class_name, line): a file's imports, classes, functions, variables, constants and namespace."""
    named = table.where("kind in ('class', 'function', 'constant', 'namespace', 'property')").select("file_path", "kind", "name", "class_name", "line")
    imports = table.where("kind = 'import'").select("file_path", "kind", F.col("text").alias("name"), "class_name", "line")
    variables = table.where("kind = 'assignment'").groupBy("file_path", F.col("target").alias("name"), "class_name").agg(F.min("line").alias("line"))
    return named.unionByName(imports).unionByName(variables.select("file_path", F.lit("variable").alias("kind"), "name", "class_name", "line"))


def functions(table: DataFrame) -> DataFrame:
    return table.where("kind = 'function'").select("file_path", "language", "name", "class_name", "line", "end_line", F.col("args").alias("params"), F.col("text").alias("body"), (~F.col("modifiers").rlike("private|protected")).alias("is_public"), F.contains("modifiers", F.lit("static")).alias("is_static"), F.col("result").alias("return_type"), "scope")


def nodes(table: DataFrame) -> DataFrame:
    return table.where("kind = 'statement'").select("file_path", "line", "language", F.lit("statement").alias("node_type"), "text", F.col("target").alias("variable"), "seq", "place", "scope", "class_name", "scopes")


def globals_of(table: DataFrame) -> DataFrame:
    """(file_path, class_name, scope, name): names that a function takes from its file."""
    return table.where("kind = 'global'").select("file_path", "class_name", "scope", "name").distinct()
