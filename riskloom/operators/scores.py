"""Scores, grades and labels per finding, file and repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R
from riskloom.functions import text
from riskloom.operators import rollup


def weighted(high: Column, medium: Column, low: Column) -> Column:
    points = R.SEVERITY_POINTS
    return high * points["High"] + medium * points["Medium"] + low * points["Low"]


def score(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(100) - weighted(high, medium, low), F.lit(0))


def ml_points(label: Column, high: int, medium: int) -> Column:
    return F.when(label == R.HIGH_RISK, high).when(label == R.MEDIUM_RISK, medium).otherwise(0)


# --- findings ---------------------------------------------------------------

def priority_score(base: Column, has_chain: Column, has_input: Column, secret: Column, label: Column) -> Column:
    bonus = R.PRIORITY_BONUS
    return (base + F.when(has_chain, bonus["chain"]).otherwise(0) + F.when(has_input, bonus["input"]).otherwise(0)
            + F.when(secret, bonus["secret"]).otherwise(0) + ml_points(label, bonus["ml_high"], bonus["ml_medium"]))


def priority_label(value: Column) -> Column:
    return text.steps(value, R.PRIORITY_STEPS, "Low")


def prioritize(findings: DataFrame, counts: DataFrame, risks: DataFrame) -> DataFrame:
    """Findings with ``priority_score`` and ``priority``.

    ``counts`` and ``risks`` hold one row per file key, so neither join can
    duplicate a finding.
    """
    base = F.when(F.col("severity") == "High", R.PRIORITY_BASE["High"]) \
        .when(F.col("severity") == "Medium", R.PRIORITY_BASE["Medium"]).otherwise(R.PRIORITY_BASE["Low"])
    flags = counts.select("repo", "file_norm", (F.col("chains") > 0).alias("has_chain"),
                          (F.col("exposed_inputs") > 0).alias("has_input"))
    return (
        findings.withColumn("file_norm", text.path_key(F.col("file")))
        .join(flags, ["repo", "file_norm"], "left")
        .join(risks.select("repo", "file_norm", "ml_first"), ["repo", "file_norm"], "left")
        .withColumn("priority_score", priority_score(
            base, F.col("has_chain"), F.col("has_input"), F.col("issue").isin(*R.SECRET_ISSUES),
            F.coalesce("ml_first", F.lit(R.SAFE))))
        .withColumn("priority", priority_label(F.col("priority_score")))
        .drop("file_norm", "has_chain", "has_input", "ml_first")
    )


def priority_order() -> list[Column]:
    """By label only, then by position; the score does not order findings."""
    rank = F.array_position(F.array(*[F.lit(p) for p in R.PRIORITY_ORDER]), F.col("priority"))
    return [rank, F.col("file"), F.col("line")]


def order_findings(prioritized: DataFrame) -> DataFrame:
    return prioritized.orderBy("repo", *priority_order())


def critical_findings(prioritized: DataFrame) -> DataFrame:
    return prioritized.filter(F.col("priority") == "Critical")


def high_and_above(prioritized: DataFrame) -> DataFrame:
    return prioritized.filter(F.col("priority").isin("Critical", "High"))


# --- files --------------------------------------------------------------------

def file_scores(files: DataFrame, severity_by_file: DataFrame) -> DataFrame:
    counts = ("high", "medium", "low")
    return (
        files.select("repo", "file").join(severity_by_file, ["repo", "file"], "left").na.fill(0, list(counts))
        .select("repo", "file", score(*map(F.col, counts)).alias("score"))
    )


def ranked_files(files: DataFrame, counts: DataFrame, risks: DataFrame) -> DataFrame:
    """Every file with its composite score and risk label, files without findings included."""
    used = ("high", "medium", "low", "chains")
    composite = (weighted(F.col("high"), F.col("medium"), F.col("low"))
                 + F.least(F.col("chains") * R.COMPOSITE_CHAIN, F.lit(R.COMPOSITE_CHAIN_CAP)) + ml_points(F.col("ml_prediction"), *R.COMPOSITE_ML))
    return (
        files.select("repo", "file", text.path_key(F.col("file")).alias("file_norm"))
        .join(counts.select("repo", "file_norm", *used), ["repo", "file_norm"], "left")
        .join(risks.select("repo", "file_norm", F.col("ml_last").alias("ml_prediction")), ["repo", "file_norm"], "left")
        .na.fill(0, list(used)).na.fill(R.SAFE, ["ml_prediction"])
        .withColumn("composite_score", composite)
        .select(
            "repo", "file", "composite_score",
            (F.col("high") + F.col("medium") + F.col("low")).alias("vuln_count"),
            F.col("high").alias("high_vulns"), F.col("medium").alias("medium_vulns"), F.col("low").alias("low_vulns"),
            F.col("chains").alias("chain_count"), "ml_prediction",
            text.steps(F.col("composite_score"), R.FILE_STEPS, "Low").alias("risk_label"),
        )
    )


def file_order() -> list[Column]:
    return [F.col("composite_score").desc(), F.col("file")]


def order_files(ranked: DataFrame) -> DataFrame:
    """Sorted over range partitions: no repository is sorted in one task."""
    return ranked.orderBy("repo", *file_order())


# --- repositories ---------------------------------------------------------------

def _priority_counts() -> dict[str, Column]:
    """Findings per priority of one file key, from its counts by severity and secrecy."""
    groups = [("High", False, F.col("high")), ("Medium", False, F.col("medium") - F.col("secrets")),
              ("Medium", True, F.col("secrets")), ("Low", False, F.col("low"))]
    label = F.coalesce("ml_first", F.lit(R.SAFE))
    totals = {p: F.lit(0) for p in R.PRIORITY_ORDER}
    for severity, secret, count in groups:
        value = priority_score(F.lit(R.PRIORITY_BASE[severity]), F.col("chains") > 0, F.col("exposed_inputs") > 0,
                               F.lit(secret), label)
        for p in totals:
            totals[p] = totals[p] + F.when(priority_label(value) == p, count).otherwise(0)
    return {f"{p.lower()}_priority": c for p, c in totals.items()}


def repo_facts(profile: DataFrame, counts: DataFrame, file_risks: DataFrame) -> DataFrame:
    """One row per repository with every count the scores need.

    Starts from the files, so a repository without any match keeps its row.
    All parts are combined before they are shuffled and are joined on ``repo``.
    """
    priorities = _priority_counts()
    of_counts = (
        counts.join(rollup.risk_by_file_key(file_risks), ["repo", "file_norm"], "left")
        .select("repo", *rollup.COUNT_COLUMNS, *[c.alias(n) for n, c in priorities.items()])
        .groupBy("repo").agg(*[F.sum(n).cast("bigint").alias(n) for n in (*rollup.COUNT_COLUMNS, *priorities)])
    )
    label = F.col("ml_prediction")
    of_risks = file_risks.groupBy("repo").agg(
        F.count_if(label == R.HIGH_RISK).alias("high_risk_files"),
        F.count_if(label == R.MEDIUM_RISK).alias("medium_risk_files"))
    sums = [F.sum(c).cast("bigint").alias(c)
            for c in ("total_lines", "blank_lines", "comments", "imports", "functions", "classes")]
    of_files = profile.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), *sums, F.round(F.sum("size_kb"), 2).alias("size_kb"),
        F.bit_or("shortcut_mask").alias("shortcut_mask"))
    return (
        of_files.join(of_counts, "repo", "left").join(of_risks, "repo", "left").na.fill(0)
        .withColumn("findings", F.col("high") + F.col("medium") + F.col("low"))
    )


def with_security_score(facts: DataFrame) -> DataFrame:
    """``base_score``, ``summary`` and ``summary_type``."""
    high, medium = F.col("high"), F.col("medium")
    return facts.withColumns({
        "base_score": score(high, medium, F.col("low")),
        "summary_type": F.when(F.col("findings") == 0, "success").when(high > 0, "error")
        .when(medium > 0, "warning").otherwise("info"),
        "summary": F.when(F.col("findings") == 0, "No weaknesses found.")
        .when(high > 0, F.format_string("CRITICAL: %d high-severity findings.", high))
        .when(medium > 0, F.format_string("WARNING: %d medium-severity findings.", medium))
        .otherwise(F.format_string("NOTICE: %d low-severity findings.", F.col("findings"))),
    })


def with_ml_adjustment(scored: DataFrame) -> DataFrame:
    """``project_ml_risk`` and ``security_score``."""
    risk = F.when(F.col("high_risk_files") > 0, R.HIGH_RISK).when(F.col("medium_risk_files") > 0, R.MEDIUM_RISK) \
        .otherwise(R.SAFE)
    return scored.withColumn("project_ml_risk", risk).withColumn(
        "security_score",
        F.greatest(F.col("base_score") - ml_points(F.col("project_ml_risk"), *R.ML_POINTS), F.lit(0)))


def with_vibe_index(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """``vibe_score``, ``vibe_category`` and the points of the five factors; shortcuts weigh what the registry says."""
    shortcuts = sum((F.getbit("shortcut_mask", F.lit(i)) * s.weight for i, s in enumerate(registry.shortcuts)), F.lit(0))
    points = [F.least((shortcuts if name == "shortcuts" else F.col(name)) * each, F.lit(cap)) for name, (each, cap) in R.VIBE_POINTS.items()]
    names = ("pts_high", "pts_secrets", "pts_chains", "pts_shortcuts", "pts_surface")
    out = facts.withColumns({n: p.cast("int") for n, p in zip(names, points)})
    out = out.withColumn("vibe_score", F.least(F.greatest(sum(F.col(n) for n in names), F.lit(0)), F.lit(100)))
    return out.withColumns({
        "vibe_category": F.when(F.col("vibe_score") <= R.VIBE_STEPS[0][0], R.VIBE_STEPS[0][1])
        .when(F.col("vibe_score") <= R.VIBE_STEPS[1][0], R.VIBE_STEPS[1][1]).otherwise("High Risk"),
        "vibe_breakdown": F.create_map(*[x for f, n in zip(R.VIBE_FACTORS, names) for x in (F.lit(f), F.col(n))]),
    })


def with_maturity(facts: DataFrame) -> DataFrame:
    """``maturity_score``, ``maturity_level`` and the ordered ``indicators``."""
    high, medium, secrets = F.col("high"), F.col("medium"), F.col("secrets")
    sql, entries = F.col("sql_issues"), F.col("high_inputs")
    clean = (high == 0) & (medium == 0)
    many_entries = entries > R.MATURITY_ENTRIES
    raw = F.lit(100) - sum(F.col(n) * each for n, each in R.MATURITY_POINTS.items()) - F.when(many_entries, R.MATURITY_ENTRY_POINTS).otherwise(0)
    value = F.greatest(F.when(clean, F.least(raw + R.MATURITY_CLEAN_BONUS, F.lit(100))).otherwise(raw), F.lit(0))
    messages = [
        F.when(high > 0, F.format_string("- %d findings of high severity", high)),
        F.when(medium > 0, F.format_string("- %d findings of medium severity", medium)),
        F.when(secrets > 0, F.format_string("- %d credentials written into the source", secrets)),
        F.when(sql > 0, F.lit("- queries are built from text instead of bound")),
        F.when(many_entries, F.format_string("- %d entry points of high severity", entries)),
        F.when(F.col("comments") > R.INDICATOR_COMMENTS, F.lit("+ comment lines are present")),
        F.when(F.col("functions") > R.INDICATOR_FUNCTIONS, F.lit("+ code is split into functions")),
        F.when(clean, F.lit("+ no findings of high or medium severity")),
    ]
    return facts.withColumn("maturity_score", value).withColumns({
        "maturity_level": text.steps(F.col("maturity_score"), R.MATURITY_STEPS, "Beginner"),
        "indicators": F.array_compact(F.array(*messages)),
    })


def with_grade(scored: DataFrame) -> DataFrame:
    """``grade``, ``grade_score``, ``grade_label``, ``grade_color`` and ``grade_explanation``."""
    (most, most_points), (much, much_points) = R.GRADE_VIBE_STEPS
    vibe = F.when(F.col("vibe_score") > most, most_points).when(F.col("vibe_score") > much, much_points).otherwise(0)
    value = F.col("security_score") - sum(F.col(n) * each for n, each in R.GRADE_DEDUCTIONS.items()) - vibe
    out = scored.withColumn("grade_score", F.greatest(F.least(value, F.lit(100)), F.lit(0))) \
        .withColumn("grade", text.steps(F.col("grade_score"), R.GRADE_STEPS, "F"))
    texts = F.create_map(*[x for g, t in prose.GRADES.items() for x in (F.lit(g), F.array(*map(F.lit, t)))])
    chosen = F.element_at(texts, F.col("grade"))
    return out.withColumns({name: F.get(chosen, F.lit(i))
                            for i, name in enumerate(("grade_label", "grade_color", "grade_explanation"))})


def repo_report(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """All repository scores in one row per repository."""
    return with_grade(with_maturity(with_vibe_index(with_ml_adjustment(with_security_score(facts)), registry)))


def fingerprint(report: DataFrame) -> DataFrame:
    return report.select(
        "repo", "total_files", "total_lines",
        F.col("findings").alias("total_vulnerabilities"), F.col("high").alias("critical_count"),
        F.col("exposed_inputs").alias("total_endpoints"), F.col("dangerous").alias("dangerous_functions"),
        F.col("chains").alias("attack_chains"), F.col("secrets").alias("secret_exposures"),
        "high_risk_files", "medium_risk_files", (F.lit(100) - F.col("security_score")).alias("risk_score"),
        F.col("grade").alias("security_grade"), "grade_label", "grade_color",
        F.col("security_score").alias("health_score"),
    )
