"""Counts per file key and per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import text


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _issues(wanted, registry: R.Registry) -> Column:
    """Test that ``vuln_id`` is one of the wanted vulnerability signatures."""
    return F.coalesce(F.col("vuln_id").isin([i for i, s in enumerate(registry.vulnerabilities) if wanted(s)]), F.lit(False))


def _entries(wanted, registry: R.Registry) -> Column:
    return F.coalesce(F.col("entry_id").isin([i for i, s in enumerate(registry.entry_points) if wanted(s)]), F.lit(False))


def _attacks(kind: str, registry: R.Registry) -> Column:
    """Chains of one attack type on a line: reaching sources times sinks of that type."""
    sinks = F.lit(R.bits(registry.sinks, lambda s: s.kind == kind))
    return F.sum(F.bit_count("reach_mask") * F.bit_count(F.col("snk_mask").bitwiseAND(sinks))).cast("bigint")


ATTACK_COLUMNS = {
    R.RCE: "rce_chains", R.SSTI: "ssti_chains", R.DESERIALIZATION: "deserialization_chains",
    R.COMMAND: "command_chains", R.SQL: "sql_chains", R.UPLOAD: "upload_chains",
    R.FILE_HANDLING: "file_chains",
}


def _is_deserialization(s: R.Signature) -> bool:
    return "pickle" in s.name.lower() or "yaml" in s.name.lower()


def _runs_code(s: R.Signature) -> bool:
    return any(word in s.name.lower() for word in ("eval", "exec", "os.system", "subprocess"))


FINDING_COUNTS = {
    "high": lambda s: s.severity == "High",
    "medium": lambda s: s.severity == "Medium",
    "low": lambda s: s.severity == "Low",
    "secrets": lambda s: s.name in R.SECRET_ISSUES,
    "sql_issues": lambda s: "SQL" in s.name,
    "dangerous": lambda s: s.name in R.DANGEROUS_ISSUES,
    "code_runners": _runs_code,
    "deserializers": _is_deserialization,
}
ENTRY_COUNTS = {
    "inputs": lambda s: s.kind != "Route Handler",
    "routes": lambda s: s.kind == "Route Handler",
    "uploads": lambda s: s.kind == "File Upload",
    "high_inputs": lambda s: s.severity == "High",
    "exposed_inputs": lambda s: s.severity in ("High", "Medium"),
    "api_inputs": lambda s: s.kind == "API Input",
    "php_inputs": lambda s: s.kind == "PHP Input",
}
COUNT_COLUMNS = (*FINDING_COUNTS, *ENTRY_COUNTS, *ATTACK_COLUMNS.values(), "chains")


def count_by_file_key(reached: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """``(repo, file_norm)`` with every count that later scores need, from ``chains.reach(facts)``.

    Rows are combined where they are before the shuffle; a file with very many
    matches costs one row per task.
    """
    counts = [_count(_issues(w, registry), n) for n, w in FINDING_COUNTS.items()]
    counts += [_count(_entries(w, registry), n) for n, w in ENTRY_COUNTS.items()]
    counts += [_attacks(kind, registry).alias(n) for kind, n in ATTACK_COLUMNS.items()]
    total = sum((F.col(n) for n in ATTACK_COLUMNS.values()), F.lit(0)).cast("bigint")
    return (
        reached.withColumn("file_norm", text.path_key(F.col("file")))
        .groupBy("repo", "file_norm").agg(*counts)
        .withColumn("chains", total)
    )


def risk_by_file_key(file_risks: DataFrame) -> DataFrame:
    """One row per file key: label of the first and of the last file (by name) with that key."""
    return (
        file_risks.groupBy("repo", text.path_key(F.col("file")).alias("file_norm"))
        .agg(F.min_by("ml_prediction", "file").alias("ml_first"),
             F.max_by("ml_prediction", "file").alias("ml_last"))
    )


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    severity = F.col("severity")
    return findings.groupBy(*keys).agg(
        _count(severity == "High", "high"), _count(severity == "Medium", "medium"), _count(severity == "Low", "low"))


def attack_surface(repos: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Six counts per repository; repositories without entry points get zeros."""
    kind, severity = F.col("type"), F.col("severity")
    route = kind == "Route Handler"
    counts = entry_points.groupBy("repo").agg(
        _count(~route, "total_entry_points"), _count(route, "total_endpoints"),
        _count(kind == "File Upload", "risky_uploads"), _count((severity == "High") & ~route, "high_severity_inputs"),
        _count(kind == "API Input", "exposed_apis"), _count(kind == "PHP Input", "php_inputs"))
    return repos.select("repo").join(counts, "repo", "left").na.fill(0)


def project_stats(profile: DataFrame) -> DataFrame:
    """Sums over the files of a repository; sizes are rounded per file, then in total."""
    sums = [F.sum(c).cast("bigint").alias(c)
            for c in ("total_lines", "blank_lines", "comments", "imports", "functions", "classes")]
    return profile.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), *sums, F.round(F.sum("size_kb"), 2).alias("size_kb"))


def stat_levels(profile: DataFrame, findings: DataFrame) -> DataFrame:
    """Statistics and findings by severity of files, of repositories and of all together, in one pass.

    ``level`` is the grouping id: 0 for a file, 1 for a repository (``file`` is null), 3 for everything.  Files and findings are
    rows of one table, and every task adds up what it reads at all three levels before the only shuffle.
    """
    lines = ("total_lines", "blank_lines", "comments", "imports", "functions", "classes")
    severities = ("High", "Medium", "Low")
    nothing = F.lit(0).cast("bigint")
    files = profile.select("repo", "file", F.lit(1).cast("bigint").alias("files"), *lines, *[nothing.alias(s.lower()) for s in severities])
    found = findings.select("repo", "file", nothing.alias("files"), *[nothing.alias(c) for c in lines],
                            *[(F.col("severity") == s).cast("bigint").alias(s.lower()) for s in severities])
    sums = ["files", *lines, *[s.lower() for s in severities]]
    return files.unionByName(found).rollup("repo", "file").agg(
        F.grouping_id().cast("bigint").alias("level"), *[F.sum(c).alias(c) for c in sums])


def shortcuts_by_repo(profile: DataFrame) -> DataFrame:
    return profile.groupBy("repo").agg(F.bit_or("shortcut_mask").alias("shortcut_mask"))


def shortcut_presence(profile: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """``(repo, shortcut, weight)`` for every shortcut signature found in a repository; ``profile`` is of the same registry."""
    known = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(s.name).alias("shortcut"), F.lit(s.weight).alias("weight"))
                      for i, s in enumerate(registry.shortcuts)])
    return (
        shortcuts_by_repo(profile).select("repo", "shortcut_mask", F.inline(known))
        .filter("getbit(shortcut_mask, bit) = 1").select("repo", "shortcut", "weight")
    )
