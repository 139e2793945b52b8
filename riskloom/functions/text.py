"""Column helpers for source text: stripping, line splitting, paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.registry import LANGUAGES

# FIXED VALUES: the code points Python's str.strip() removes.
WHITESPACE = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# FIXED VALUES: the characters (besides \r) at which a text breaks into lines.
NEWLINE = "\n"
RARE_BREAKS = "".join(map(chr, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))
LINE_BREAKS = r"[\n\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(col, F.lit(WHITESPACE))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def starts_with_any(col: Column, prefixes: Iterable[str]) -> Column:
    return any_of(col.startswith(p) for p in prefixes)


def contains_any(col: Column, parts: Iterable[str]) -> Column:
    return any_of(F.contains(col, F.lit(p)) for p in parts)


def universal_newlines(content: Column) -> Column:
    """Turn ``\\r\\n`` and ``\\r`` into ``\\n``; texts without ``\\r`` are left as they are."""
    return F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, "\\r\\n?", "\n")).otherwise(content)


def split_lines(content: Column) -> Column:
    """Lines of a newline-translated text, without terminators and without a last empty line.

    ``content`` should be a plain column, as it is used several times.  Texts
    without rare separators take the plain split, which needs no regular expression.
    """
    closed = any_of(content.endswith(c) for c in NEWLINE + RARE_BREAKS)
    body = F.when(closed, F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    lines = F.when(contains_any(content, RARE_BREAKS), F.split(body, LINE_BREAKS)).otherwise(F.split(body, NEWLINE))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(lines)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; leading dots belong to the name, so ``.env`` has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def language(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit("Unknown"))


def path_key(path: Column) -> Column:
    """Key for file-level lookups: forward slashes, lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def steps(score: Column, thresholds: Iterable[tuple[int, str]], otherwise: str) -> Column:
    """Label of the first threshold the score reaches."""
    out = None
    for least, label in thresholds:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise(otherwise)
