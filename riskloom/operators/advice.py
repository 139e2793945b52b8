"""Explanations and recommendations for issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R

EXPLANATION_FIELDS = ("why_dangerous", "real_world_risk", "attack_possibility", "secure_coding")
RECOMMENDATION_FIELDS = ("title", "priority_action", "insecure_example", "secure_example")


def explanations(spark: SparkSession) -> DataFrame:
    """The explanation table: a fixed number of rows, so it is safe to broadcast."""
    rows = [(issue, *texts) for issue, texts in prose.EXPLANATIONS.items()]
    return spark.createDataFrame(rows, "issue string, " + ", ".join(f"{f} string" for f in EXPLANATION_FIELDS))


def recommendations(spark: SparkSession) -> DataFrame:
    """The recommendation table: a fixed number of rows, so it is safe to broadcast."""
    rows = [(issue, *t[:4], list(t[4])) for issue, t in prose.RECOMMENDATIONS.items()]
    fields = ", ".join(f"{f} string" for f in RECOMMENDATION_FIELDS)
    return spark.createDataFrame(rows, f"issue string, {fields}, steps array<string>")


def signatures(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.severity, prose.ISSUE_DESCRIPTIONS[s.name]) for s in R.VULNERABILITIES]
    return spark.createDataFrame(rows, "issue string, severity string, description string")


def explain(issues: DataFrame) -> DataFrame:
    """Add the four explanation texts; issues without their own get the general ones."""
    joined = issues.join(F.broadcast(explanations(issues.sparkSession)), "issue", "left")
    return joined.withColumns({
        f: F.coalesce(F.col(f), F.lit(general)) for f, general in zip(EXPLANATION_FIELDS, prose.EXPLANATION_FALLBACK)})


def recommend(issues: DataFrame) -> DataFrame:
    """Add title, first action, examples and steps; the general title names the issue."""
    title, action, insecure, secure, steps = prose.RECOMMENDATION_FALLBACK
    joined = issues.join(F.broadcast(recommendations(issues.sparkSession)), "issue", "left")
    return joined.withColumns({
        "title": F.coalesce("title", F.concat(F.lit(title), F.col("issue"))),
        "priority_action": F.coalesce("priority_action", F.lit(action)),
        "insecure_example": F.coalesce("insecure_example", F.lit(insecure)),
        "secure_example": F.coalesce("secure_example", F.lit(secure)),
        "steps": F.coalesce("steps", F.array(*map(F.lit, steps))),
    })


def issue_advice(findings: DataFrame) -> DataFrame:
    """Explanation and recommendation once per repository and issue found there."""
    return recommend(explain(findings.select("repo", "issue").distinct()))


def advice_coverage(findings: DataFrame) -> DataFrame:
    """Every issue with findings, how often it occurs and which advice exists for it."""
    spark = findings.sparkSession
    counts = findings.groupBy("issue").agg(F.count(F.lit(1)).alias("findings"))
    has_explanation = F.broadcast(explanations(spark).select("issue", F.lit(True).alias("explained")))
    has_recommendation = F.broadcast(recommendations(spark).select("issue", F.lit(True).alias("recommended")))
    return (
        counts.join(has_explanation, "issue", "left").join(has_recommendation, "issue", "left")
        .select("issue", "findings", F.coalesce("explained", F.lit(False)).alias("explained"),
                F.coalesce("recommended", F.lit(False)).alias("recommended"))
    )


def catalogue() -> list[str]:
    """Issues that have a recommendation of their own."""
    return list(prose.RECOMMENDATIONS)
