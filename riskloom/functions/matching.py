"""Signature matching as column expressions.

Patterns are literals in the generated expression: Spark then compiles each
one once per task.  Joining lines with a table of patterns would compile one
per row.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import contains_any
from riskloom.registry import DEFAULT, Registry, Signature

WORD_CLASS = r"[\p{L}\p{N}_]"
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# FIXED VALUES: letters besides A-Z that equal an ASCII letter when case is ignored.
FOLDING_LETTERS, FOLDED_TO = "".join(map(chr, [0x17F, 0x131, 0x130, 0x212A])), "siik"

# A folded line without one of these symbols and words cannot match any signature.
GATE = (*"(=$*+%{_", "req", "argv", "payload", "todo", "fixme", "debug", "temp", "hack", "xxx")


def fold(col: Column) -> Column:
    """Text in which every letter that matches an ASCII letter regardless of case is that letter in lower case."""
    odd = contains_any(col, FOLDING_LETTERS)
    return F.lower(F.when(odd, F.translate(col, FOLDING_LETTERS, FOLDED_TO)).otherwise(col))


def _expand(pattern: str) -> str:
    """Spell out Python's word and space classes, which differ from Java's."""
    def edge(match: re.Match) -> str:
        after = pattern[match.end():match.end() + 1]
        leading = after and (after.isalnum() or after in "_(")
        return f"(?<!{WORD_CLASS})" if leading else f"(?!{WORD_CLASS})"

    return re.sub(r"\\b", edge, pattern).replace(r"\s", SPACE_CLASS).replace(r"\w", WORD_CLASS)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Java pattern with Python's meaning; ``d`` lets ``.`` stop at ``\\n`` only."""
    return ("(?iud)" if ignore_case else "(?d)") + _expand(pattern)


def folded_pattern(pattern: str) -> str:
    """Java pattern that finds in folded text what Python finds when it ignores case.

    Case-sensitive matching of folded text is several times faster than
    Unicode case-insensitive matching.
    """
    return java_pattern(re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern.lower()))


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars outside of its groups and classes."""
    parts, depth, inside, start = [], 0, False, 0
    for token in re.finditer(r"\\.|[\[\]()|]", pattern):
        found = token.group()
        if found in "[]":
            inside = found == "["
        elif not inside and found in "()":
            depth += 1 if found == "(" else -1
        elif not inside and found == "|" and depth == 0:
            parts.append(pattern[start:token.start()])
            start = token.end()
    return [*parts, pattern[start:]]


def branches(pattern: str) -> list[tuple[str, str]]:
    """``(literal, pattern)`` pairs: the pattern is found in a text just when the pattern of a pair is, and that one begins with its literal.

    The JVM finds a literal at the head of a pattern much faster than a choice of words, which it tries at every letter.
    Patterns that a cut could change, those with word edges, flags or other special groups, stay whole; so do classes with brackets.
    """
    if re.search(r"\\b|\(\?(?!:)|\[\^?\]|\[[^]\\]*\[", pattern):
        return [("", pattern)]
    out = []
    for part in _alternatives(pattern):
        head = re.match(r"\((?:\?:)?((?:\\.|[^()\[\]\\])*)\)(?![*+?{])", part)
        out += [choice + part[head.end():] for choice in _alternatives(head.group(1))] if head else [part]
    return [(_leading(p), p) for p in out]


def _leading(pattern: str) -> str:
    """The literal with which every match of a pattern without bars outside of its groups begins."""
    literal = re.match(r"(?:(?:[A-Za-z0-9_ #/=:@'\"<>!,;%&~`-]|\\[^A-Za-z0-9])(?![*?{]))*", pattern).group()
    return re.sub(r"\\(.)", r"\1", literal).lower()


@lru_cache(maxsize=8)
def _bits(signatures: tuple[Signature, ...]) -> dict[str, int]:
    """One bit per trigger that a signature of a line registry needs."""
    names = sorted({n for s in signatures for n in s.needs})
    if len(names) > 63:
        raise ValueError("signatures need more than 63 triggers")
    return {name: 1 << i for i, name in enumerate(names)}


def gate(registry: Registry = DEFAULT) -> tuple[str, ...] | None:
    """Symbols and words of which a line has one before any signature can match; None when some signature needs none.

    The given signatures are covered by ``GATE``.  Any other adds the literals of its rarest-looking trigger, the one with the
    longest literals.
    """
    known = set(DEFAULT.line_signatures())
    words = set(GATE) if any(s in known for s in registry.line_signatures()) else set()
    for s in registry.line_signatures():
        if s not in known:
            if not s.needs:
                return None
            words.update(max((registry.literals(n) for n in s.needs), key=lambda t: min(map(len, t))))
    return tuple(sorted(words))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def may_match_sql(folded: str = "folded", registry: Registry = DEFAULT) -> str:
    words = gate(registry)
    return "true" if words is None else _contains(folded, words) if words else "false"


def may_match(folded: str = "folded", registry: Registry = DEFAULT) -> Column:
    return F.expr(may_match_sql(folded, registry))


# The registries become SQL text, which is one call to the JVM instead of one
# per column operation.

def triggers_sql(folded: str = "folded", registry: Registry = DEFAULT) -> str:
    """SQL for a BIGINT with one bit per trigger present in a folded line."""
    parts = [f"CASE WHEN {_contains(folded, registry.literals(name))} THEN {bit}L ELSE 0L END"
             for name, bit in _bits(registry.line_signatures()).items()]
    return " | ".join(parts) or "0L"


def triggers(folded: str = "folded", registry: Registry = DEFAULT) -> Column:
    return F.expr(triggers_sql(folded, registry))


def _symbolic(name: str, registry: Registry) -> bool:
    """Whether a trigger's literals all begin with a symbol: these are found much faster than words, whose first letters are everywhere."""
    return not any(w[:1].isalnum() for w in registry.literals(name))


def symbols_sql(folded: str = "folded", registry: Registry = DEFAULT) -> str:
    """SQL for the bits of those triggers that are symbols."""
    parts = [f"CASE WHEN {_contains(folded, registry.literals(name))} THEN {bit}L ELSE 0L END"
             for name, bit in _bits(registry.line_signatures()).items() if _symbolic(name, registry)]
    return " | ".join(parts) or "0L"


def words_sql(symbols: str = "symbols", folded: str = "folded", registry: Registry = DEFAULT) -> str:
    """SQL for a BIGINT with the bits of ``symbols`` and of every word that can matter beside them.

    A word is looked for only in lines that have all symbols of a signature that needs it; elsewhere no such signature
    can match and its bit stays 0.
    """
    signatures = registry.line_signatures()
    bits, parts = _bits(signatures), [symbols]
    for name in (n for n in bits if not _symbolic(n, registry)):
        beside = {sum(bits[n] for n in set(s.needs) if _symbolic(n, registry)) for s in signatures if name in s.needs}
        least = sorted(g for g in beside if not any(h != g and h & g == h for h in beside))
        wanted = "" if least == [0] else "(" + " OR ".join(f"({symbols} & {g}L) = {g}L" for g in least) + ") AND "
        parts.append(f"CASE WHEN {wanted}{_contains(folded, registry.literals(name))} THEN {bits[name]}L ELSE 0L END")
    return " | ".join(parts)


def _match(signature: Signature, folded: str, trigger: str, registry: Registry) -> str:
    mask = sum(_bits(registry.line_signatures())[n] for n in signature.needs)
    return f"({trigger} & {mask}L) = {mask}L AND rlike({folded}, {sql_text(folded_pattern(signature.pattern))})"


def first_match(signatures: tuple[Signature, ...], folded: str = "folded", trigger: str = "trigger", registry: Registry = DEFAULT) -> str:
    """SQL for the position of the first matching signature, or null."""
    whens = " ".join(f"WHEN {_match(s, folded, trigger, registry)} THEN {i}" for i, s in enumerate(signatures))
    return f"CASE {whens} END" if whens else "CAST(NULL AS INT)"


def match_mask(signatures: tuple[Signature, ...], folded: str = "folded", trigger: str = "trigger", registry: Registry = DEFAULT) -> str:
    """SQL for an INT with bit ``i`` set when signature ``i`` matches."""
    if len(signatures) > 31:
        raise ValueError("at most 31 signatures fit a mask")
    return " | ".join(f"CASE WHEN {_match(s, folded, trigger, registry)} THEN {1 << i} ELSE 0 END" for i, s in enumerate(signatures)) or "0"


def text_mask(signatures: tuple[Signature, ...], folded: str = "folded", registry: Registry = DEFAULT) -> str:
    """Like ``match_mask`` for whole texts, which have no triggers of their own.

    Symbols are looked for first.  A need that the literals at the heads of all branches hold is not looked for again, and
    words that are needed besides only in texts with such a literal.
    """
    def one(literal: str, pattern: str) -> str:
        match = f"rlike({folded}, {sql_text(folded_pattern(pattern))})"
        return f"({_contains(folded, [literal])} AND {match})" if literal else match

    def found(s: Signature) -> str:
        cut = branches(s.pattern)
        heads = list(dict.fromkeys(literal for literal, _ in cut))
        needs = [n for n in s.needs if not all(any(w in h for w in registry.literals(n)) for h in heads)]
        words = [n for n in needs if not _symbolic(n, registry)]
        tests = [_contains(folded, registry.literals(n)) for n in needs if n not in words]
        if words and all(heads):
            tests.append(_contains(folded, heads))
            cut = [("", p) for _, p in cut] if len(cut) == 1 else cut
        tests += [_contains(folded, registry.literals(n)) for n in words]
        return " AND ".join([*tests, "(" + " OR ".join(one(*b) for b in cut) + ")"])

    return " | ".join(f"CASE WHEN {found(s)} THEN {1 << i} ELSE 0 END" for i, s in enumerate(signatures)) or "0"


def lookup(index: Column, values: list[str]) -> Column:
    """``values[index]`` for a literal list, null when the index is null."""
    return F.get(F.expr(f"array({', '.join(map(sql_text, values))})").cast("array<string>"), index)
