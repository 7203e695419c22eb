"""Words that a pattern needs: the postings of an index from words to rules.

A match of a pattern holds one of its required words as a whole word (letters, digits and underscores between other characters), or
the pattern has none and must be tried on every text. The words come from the pattern's syntax tree.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _flat(tree) -> list:
    """The items of a sequence, plain groups taken apart."""
    out = []
    for op, value in tree:
        if op is C.SUBPATTERN and not value[1] and not value[2]:
            out += _flat(value[3])
        elif op is C.MAX_REPEAT and value[:2] == (1, 1):
            out += _flat(value[2])
        else:
            out.append((op, value))
    return out


def _never_word(op, value) -> bool:
    """The item takes one character or more, none of them a word's."""
    if op is C.LITERAL:
        return chr(value) not in _WORD
    if op is C.IN:
        return all((kind is C.LITERAL and chr(x) not in _WORD) or (kind is C.CATEGORY and x in (C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD)) for kind, x in value)
    return op is C.CATEGORY and value in (C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD)


_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)


def _ends_word(items: list, backwards: bool = False) -> bool:
    """Whatever the items (in order from a word outwards) match, the word ends there."""
    ordered = lambda tree: _flat(tree)[::-1] if backwards else _flat(tree)
    for op, value in items:
        if op is C.AT and value in (C.AT_BOUNDARY, C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING):
            return True
        if op is C.ASSERT_NOT and value[0] == (-1 if backwards else 1):
            inner = _flat(value[1])
            if len(inner) == 1 and inner[0][0] is C.IN and (C.CATEGORY, C.CATEGORY_WORD) in inner[0][1]:
                return True
            continue
        if op in _REPEATS:
            # What may be left out must end the word where it is there, and what follows it where it isn't.
            if not _ends_word(ordered(value[2]), backwards):
                return False
            if value[0] > 0:
                return True
            continue
        if op is C.BRANCH:
            return all(_ends_word(ordered(way), backwards) for way in value[1])
        return _never_word(op, value)
    return False


def _words(items: list, depth: int = 0) -> set[str] | None:
    """Words one of which a match of the sequence holds; of several choices the one with the longest shortest word."""
    best: set[str] | None = None

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    k = 0
    while k < len(items):
        op, value = items[k]
        if op is C.LITERAL and chr(value) in _WORD:
            end = k
            while end < len(items) and items[end][0] is C.LITERAL and chr(items[end][1]) in _WORD:
                end += 1
            word = "".join(chr(x) for _, x in items[k:end])
            if _ends_word(items[:k][::-1], backwards=True) and _ends_word(items[end:]):
                offer({word})
            k = end
            continue
        ways = value[1] if op is C.BRANCH else [value[2], []] if op in _REPEATS and value[:2] == (0, 1) else []
        if ways and depth < 6:
            found = [_words(items[:k] + _flat(way) + items[k + 1 :], depth + 1) for way in ways]
            if all(found):
                offer(set().union(*found))
        k += 1
    return best


def required_words(pattern: str) -> set[str] | None:
    """Words of which every match holds one; None if there are none, or the pattern isn't understood."""
    try:
        tree = _parser.parse(pattern)
    except Exception:  # other dialects' syntax: such a rule is tried on every text
        return None
    if tree.state.flags & C.SRE_FLAG_IGNORECASE:
        return None
    return _words(_flat(tree))
