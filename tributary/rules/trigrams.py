"""Trigrams that a pattern's matches hold: what a table of trigrams and names can answer before a pattern is tried."""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser

from tributary.rules.keywords import _flat

#: Alternatives of one pattern; beyond them a choice inside the pattern is left to the pattern itself.
MAX_WAYS = 16


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[k : k + 3] for k in range(len(run) - 2))


def _ways(items: list, depth: int = 0) -> list[frozenset[str]]:
    """Sets of trigrams; a match of the sequence holds all of one of them. An empty set asks for nothing."""
    ways, run = [frozenset()], ""

    def add(more: list[frozenset[str]]) -> None:
        nonlocal ways
        if len(ways) * len(more) <= MAX_WAYS:
            ways = [a | b for a, b in product(ways, more)]

    for op, value in [*items, (C.AT, None)]:
        if op is C.LITERAL and value >= 32:
            run += chr(value)
            continue
        add([_grams(run)])
        run = ""
        if depth < 6:
            if op is C.BRANCH:
                add([w for way in value[1] for w in _ways(_flat(way), depth + 1)])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                add(_ways(_flat(value[2]), depth + 1))
            elif op is C.SUBPATTERN and not value[1] and not value[2]:
                add(_ways(_flat(value[3]), depth + 1))
    return ways


def required_trigrams(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, all of one of which every match holds; None where every name must be tried.

    That is so for patterns that ignore case, those that may match without any trigram, and those that another dialect reads
    differently (classes within classes, `&&`, quotations, free spacing).
    """
    bare = re.sub(r"\\.", "", pattern, flags=re.DOTALL)
    if "&&" in pattern or "\\Q" in pattern or re.search(r"\[[^\]]*\[", bare):
        return None
    try:
        tree = _parser.parse(pattern)
    except Exception:  # syntax that only the engine knows
        return None
    if tree.state.flags & (C.SRE_FLAG_IGNORECASE | C.SRE_FLAG_VERBOSE):
        return None
    ways = _ways(_flat(tree))
    return sorted(set(ways), key=sorted) if all(ways) else None
