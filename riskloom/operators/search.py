"""Search filters over findings and entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _contains(column: str, wanted: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(wanted.lower()))


def search_findings(findings: DataFrame, wanted: str = "", severity: str = "all") -> DataFrame:
    """Text in the issue or the file, and one severity (lower case) or ``all``."""
    out = findings.filter(_contains("issue", wanted) | _contains("file", wanted))
    return out if severity == "all" else out.filter(F.lower("severity") == severity)


def search_entry_points(entry_points: DataFrame, wanted: str = "", kind: str = "all") -> DataFrame:
    """Text in the file or the matched code, and a part of the type or ``all``."""
    out = entry_points.filter(_contains("file", wanted) | _contains("matched_code", wanted))
    return out if kind == "all" else out.filter(F.contains(F.lower(F.col("type")), F.lit(kind)))
