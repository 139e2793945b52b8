"""Cleaning of labelled code samples and normalisation of their labels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.registry import HIGH_RISK, MEDIUM_RISK, SAFE

# --- FIXED VALUES: keywords of the label rules ------------------------------
NAMED_HIGH = (
    "sql injection", "sqli", "sql_injection", "command injection", "os command", "code injection",
    "remote code execution", "rce", "xss", "cross-site scripting", "ssrf", "server-side request forgery",
    "path traversal", "directory traversal", "lfi", "rfi", "local file inclusion", "remote file inclusion",
    "template injection", "ssti", "ldap injection", "xml injection", "xxe", "deserialization",
    "unsafe deserialization", "insecure deserialization", "nosql injection", "buffer overflow", "heap overflow",
    "format string", "high", "critical", "high_risk", "vulnerable", "vulnerability",
    "cwe-89", "cwe-78", "cwe-79", "cwe-94", "cwe-502", "cwe-611", "cwe-918", "injection", "exploit",
)
NAMED_MEDIUM = (
    "hardcoded", "hardcoded credential", "weak crypto", "weak cryptography", "insecure random", "cleartext",
    "plaintext password", "debug enabled", "missing authentication", "missing authorization", "idor",
    "information disclosure", "sensitive data exposure", "csrf", "security misconfiguration", "medium",
    "medium_risk", "warning", "cwe-798", "cwe-330", "cwe-326", "cwe-312", "cwe-327", "weak password",
    "insecure cookie", "timing attack",
)
NAMED_SAFE = (
    "safe", "clean", "fixed", "secure", "patched", "remediated", "parameterized", "prepared statement",
    "sanitized", "validated", "safe_", "not vulnerable", "benign", "no vulnerability",
)
CWE_HIGH = (
    "sql injection", "sqli", "command injection", "os command injection", "xss", "cross-site scripting",
    "code injection", "rce", "ssrf", "path traversal", "lfi", "rfi", "ssti", "template injection", "xxe",
    "xml injection", "deserialization", "ldap injection", "nosql injection", "open redirect", "dangerous", "high",
    "critical", "cwe-89", "cwe-78", "cwe-79", "cwe-94", "cwe-502", "cwe-611", "cwe-918", "cwe-90", "cwe-22",
    "cwe-601", "cwe-943", "cwe-917", "inject", "exploit", "remote", "arbitrary code",
)
CWE_MEDIUM = (
    "hardcoded", "weak crypto", "insecure random", "debug", "cleartext", "information disclosure", "csrf",
    "misconfiguration", "idor", "medium", "warning", "cwe-798", "cwe-330", "cwe-326", "cwe-312", "cwe-327",
    "cwe-778", "cwe-209", "cwe-523", "cwe-614", "timing", "weak password", "insecure cookie",
)
CWE_SAFE = ("safe", "clean", "fixed", "secure", "patched", "not vulnerable", "benign")
TYPE_HIGH = (
    "sql injection", "sqli", "command injection", "code injection", "os command injection", "xss",
    "cross-site scripting", "ssrf", "path traversal", "directory traversal", "lfi", "rfi", "template injection",
    "ssti", "xml injection", "xxe", "deserialization", "ldap injection", "nosql injection", "open redirect",
    "buffer overflow", "format string", "heap overflow", "use after free", "integer overflow",
    "remote code execution", "rce", "arbitrary code", "cwe-89", "cwe-78", "cwe-79", "cwe-94", "cwe-502",
    "cwe-611", "cwe-918", "cwe-22", "cwe-90", "cwe-601", "cwe-943", "cwe-917", "cwe-77", "cwe-119", "cwe-120",
    "cwe-122", "cwe-190", "cwe-125",
)
TYPE_MEDIUM = (
    "hardcoded", "hardcoded credential", "weak crypto", "insecure random", "cleartext", "missing authentication",
    "csrf", "idor", "information disclosure", "sensitive data exposure", "security misconfiguration", "debug",
    "timing", "cwe-798", "cwe-330", "cwe-326", "cwe-312", "cwe-327", "cwe-778", "cwe-209", "cwe-523", "cwe-614",
)
SAMPLE_LANGUAGES = ("python", "javascript", "java", "php", "go", "ruby", "c", "c++", "cpp", "typescript",
                    "kotlin", "scala")
VULNERABLE_WORDS = ("1", "True", "true", "vulnerable", "Vulnerable")
SAFE_WORDS = ("0", "False", "false", "safe", "Safe", "clean")
MIN_SAMPLE = 5


def _key(label: Column) -> Column:
    return F.lower(text.strip(label))


def _mentions(key: Column, words: Iterable[str]) -> Column:
    """One alternation per class; a keyword may sit inside another word, such as ``rce`` in ``source``."""
    return key.rlike("|".join(re.escape(w) for w in words))


def from_name(label: Column) -> Column:
    """Label from a free name: High, then Safe, then Medium keywords, else null."""
    key = _key(label)
    return F.when(_mentions(key, NAMED_HIGH), HIGH_RISK).when(_mentions(key, NAMED_SAFE), SAFE) \
        .when(_mentions(key, NAMED_MEDIUM), MEDIUM_RISK)


def from_cwe(label: Column) -> Column:
    """Label from a weakness id or name: High keywords, exact Safe words, Medium keywords, flags, else null."""
    key = _key(label)
    return F.when(_mentions(key, CWE_HIGH), HIGH_RISK).when(key.isin(*CWE_SAFE, "0", "false"), SAFE) \
        .when(_mentions(key, CWE_MEDIUM), MEDIUM_RISK).when(key.isin("1", "true", "vulnerable"), HIGH_RISK)


def from_type(label: Column) -> Column:
    """Label of a known vulnerability type; High unless a Medium keyword decides."""
    key = _key(label)
    medium = ~_mentions(key, TYPE_HIGH) & _mentions(key, TYPE_MEDIUM)
    return F.when(medium, MEDIUM_RISK).otherwise(HIGH_RISK)


def from_flag(flag: Column) -> Column:
    """Label of a 0/1 flag or its written forms, else null."""
    key = _key(flag)
    return F.when(key.rlike(r"^\+?0*1$"), HIGH_RISK).when(key.rlike(r"^[+-]?[0-9]+$"), SAFE) \
        .when(key.isin("true", "yes", "vulnerable"), HIGH_RISK) \
        .when(key.isin("false", "no", "safe", "clean"), SAFE)


def from_name_or_flag(label: Column) -> Column:
    """Exactly ``0`` or ``1`` is a flag, everything else a name."""
    return F.when(label.isin("0", "1"), from_flag(label)).otherwise(from_name(label))


def from_type_or_flag(label: Column) -> Column:
    key = text.strip(label)
    return F.when(key.isin(*VULNERABLE_WORDS), HIGH_RISK).when(key.isin(*SAFE_WORDS), SAFE).otherwise(from_type(key))


def or_high(label: Column) -> Column:
    """Samples known to be vulnerable stay High when their type is not recognised."""
    return F.coalesce(label, F.lit(HIGH_RISK))


def cut(value: Column, width: int | None) -> Column:
    """The whole value, or its first ``width`` characters where a width is asked for."""
    return value if width is None else F.substring(value, 1, width)


def clean_code(code: Column, width: int | None = None) -> Column:
    """Stripped sample with written-out newlines resolved, cut only on request; null when unusable."""
    raw = text.strip(code)
    value = text.strip(F.replace(code, F.lit("\\n"), F.lit("\n")))
    usable = ~raw.isin("", "nan", "None") & (F.length(value) >= MIN_SAMPLE)
    return F.when(usable, cut(value, width))


def plain_code(code: Column, width: int | None = None) -> Column:
    """Stripped sample, cut only on request; null when unusable."""
    value = text.strip(code)
    usable = (value != "nan") & (F.length(value) >= MIN_SAMPLE)
    return F.when(usable, cut(value, width))


def allowed_language(language: Column) -> Column:
    """Known languages pass, and so does an empty one; a missing one does not."""
    key = _key(language)
    return F.coalesce((key == "") | key.isin(*SAMPLE_LANGUAGES), F.lit(False))


def first_filled(df: DataFrame, *names: str) -> Column:
    """First non-empty value among the columns that exist."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return text.strip(F.coalesce(*present, F.lit("")))


def find_column(columns: list[str], any_part: Iterable[str], without: Iterable[str] = ()) -> str | None:
    """First column whose lower-case name contains one of the parts and none of the others."""
    parts, banned = tuple(any_part), tuple(without)
    for name in columns:
        low = name.lower()
        if any(p in low for p in parts) and not any(b in low for b in banned):
            return name
    return None


def pairs_to_samples(pairs: DataFrame, vulnerable: Column, fixed: Column, label: Column,
                     keep: tuple[str, ...] = (), distinct_fix: bool = True) -> DataFrame:
    """Two samples per row: the vulnerable code with its label and the fixed code as Safe.

    ``distinct_fix`` drops a fix equal to the vulnerable code.
    """
    kept_fix = F.when(~fixed.eqNullSafe(vulnerable), fixed) if distinct_fix else fixed
    return (
        pairs.select(*keep, F.inline(F.array(
            F.struct(F.lit(0).alias("part"), vulnerable.alias("code"), label.alias("label")),
            F.struct(F.lit(1).alias("part"), kept_fix.alias("code"), F.lit(SAFE).alias("label")))))
        .filter("code IS NOT NULL AND code <> '' AND label IS NOT NULL")
    )


def line_chunks(samples: DataFrame, content: str, keep: tuple[str, ...], size: int = 6, step: int = 4,
                least: int = 10, width: int | None = None) -> DataFrame:
    """Overlapping chunks of ``size`` lines every ``step`` lines of the stripped text; ``width`` cuts a chunk, which is whole by default."""
    stripped = text.strip(text.universal_newlines(F.col(content)))

    def chunk(start: Column) -> Column:
        return text.strip(F.concat_ws("\n", *[F.get("all_lines", start + k) for k in range(size)]))

    return (
        samples.select(*keep, stripped.alias("_stripped"))
        .select(*keep, text.split_lines(F.col("_stripped")).alias("all_lines"))
        .select(*keep, F.posexplode(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("all_lines") - 1, F.lit(0)), F.lit(step)), chunk)).alias("chunk", "code"))
        .filter(F.length("code") >= least)
        .withColumn("code", cut(F.col("code"), width))
    )
