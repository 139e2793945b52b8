"""Ordered sentences: narrative, scan log, explanations of classifier labels, indicator buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R
from riskloom.functions import text


def narrative(report: DataFrame) -> DataFrame:
    """``(repo, seq, message)``: up to nine sentences, or the all-clear."""
    def counted(key: str, column: str, least: int = 1) -> Column:
        value = F.col(column)
        sentence = prose.NARRATIVE[key]
        body = F.format_string(sentence, value) if "%d" in sentence else F.lit(sentence)
        return F.when(value >= least, body)

    told = F.array_compact(F.array(
        counted("rce", "rce_chains"), counted("command", "command_chains"), counted("sql", "sql_chains"),
        counted("deserialization", "deserialization_chains"), counted("upload", "upload_chains"),
        counted("secrets", "secrets"), counted("inputs", "exposed_inputs", 5),
        counted("dangerous", "dangerous", 3), counted("ml", "high_risk_files")))
    clear = F.array(F.lit(prose.NARRATIVE["clear"]))
    return report.select(
        "repo", F.posexplode(F.when(F.size(told) > 0, told).otherwise(clear)).alias("seq", "message"))


def scan_log(report: DataFrame) -> DataFrame:
    """``(repo, seq, level, message)``: the scan told step by step; levels depend on the counts."""
    def entry(level: str | Column, template: str, *columns: str, when: Column | None = None) -> Column:
        message = F.format_string(template, *map(F.col, columns)) if columns else F.lit(template)
        row = F.struct((level if isinstance(level, Column) else F.lit(level)).alias("level"), message.alias("message"))
        return row if when is None else F.when(when, row)

    found, chained = F.col("findings") > 0, F.col("chains") > 0
    grade_level = F.when(F.col("grade").isin("A", "B"), "SUCCESS").when(F.col("grade") == "C", "WARNING") \
        .otherwise("CRITICAL")
    ml = F.col("high_risk_files") > 0
    rows = F.array(
        entry("INFO", "Scan started."),
        entry("INFO", "%d source files in scope.", "total_files"),
        entry("INFO", "%s lines in scope.", "lines_text"),
        entry("INFO", "Reading files."),
        entry("INFO", "Mapping entry points."),
        entry("INFO", "%d inputs mapped.", "exposed_inputs"),
        entry("WARNING", "%d findings in %d files.", "findings", "total_files", when=found),
        entry("CRITICAL", "%d findings of high severity.", "high", when=F.col("high") > 0),
        entry("WARNING", "%d credentials in the source.", "secrets", when=F.col("secrets") > 0),
        entry("WARNING", "%d dangerous calls.", "dangerous", when=F.col("dangerous") > 0),
        entry("SUCCESS", "No findings.", when=~found),
        entry("INFO", "Linking inputs and dangerous calls."),
        entry("CRITICAL", "%d paths from input to a dangerous call.", "chains", when=chained),
        entry("CRITICAL", "%d paths to code execution.", "rce_chains", when=F.col("rce_chains") > 0),
        entry("CRITICAL", "%d paths to a command.", "command_chains", when=F.col("command_chains") > 0),
        entry("WARNING", "%d paths into a query.", "sql_chains", when=F.col("sql_chains") > 0),
        entry("SUCCESS", "No path from input to a dangerous call.", when=~chained),
        entry("INFO", "Classifying files."),
        entry("WARNING", "%d files classified as High Risk.", "high_risk_files", when=ml),
        entry("SUCCESS", "No file classified as High Risk.", when=~ml),
        entry("INFO", "Grading."),
        entry(grade_level, "Grade %s (%s).", "grade", "grade_label"),
        entry("INFO", "Report complete."),
        entry("INFO", "Scan finished."),
    )
    return (
        report.withColumn("lines_text", F.format_number("total_lines", 0))
        .select("repo", F.posexplode(F.array_compact(rows)).alias("seq", "row"))
        .select("repo", "seq", "row.level", "row.message")
    )


def ml_explanations(file_risks: DataFrame, counts: DataFrame) -> DataFrame:
    """Indicators and a summary for every file labelled High or Medium.

    ``confidence`` is a percentage and is shown as one.
    """
    tell = prose.ML_INDICATORS
    used = ("code_runners", "sql_issues", "secrets", "deserializers", "chains", "high")
    indicators = F.array_compact(F.array(
        F.when(F.col("code_runners") > 0, F.lit(tell["execution"])),
        F.when(F.col("sql_issues") > 0, F.lit(tell["sql"])),
        F.when(F.col("secrets") > 0, F.lit(tell["secret"])),
        F.when(F.col("deserializers") > 0, F.lit(tell["deserialization"])),
        F.when(F.col("chains") > 0, F.format_string(tell["chains"], F.col("chains"))),
        F.when(F.col("high") >= 3, F.format_string(tell["density"], F.col("high"))),
    ))
    shown = F.bround("confidence", 0).cast("int").cast("string")
    summary = F.when(F.col("ml_prediction") == R.HIGH_RISK, F.format_string(prose.ML_SUMMARIES[R.HIGH_RISK], shown)) \
        .otherwise(F.format_string(prose.ML_SUMMARIES[R.MEDIUM_RISK], shown))
    return (
        file_risks.filter(F.col("ml_prediction").isin(R.HIGH_RISK, R.MEDIUM_RISK))
        .withColumn("file_norm", text.path_key(F.col("file")))
        .join(counts.select("repo", "file_norm", *used), ["repo", "file_norm"], "left").na.fill(0, list(used))
        .select(
            "repo", "file", F.col("ml_prediction").alias("prediction"),
            F.col("confidence").cast("int").alias("confidence_pct"),
            F.when(F.size(indicators) > 0, indicators).otherwise(F.array(F.lit(tell["fallback"]))).alias("key_indicators"),
            summary.alias("risk_summary"),
        )
    )


# FIXED VALUES: words that sort a maturity indicator into a bucket.
HARDENING = "(?i)secure|validate|sanitize|hardened|header|CSP|SSL|TLS|HTTPS|middleware"
HYGIENE = "(?i)clean|unused|dead|unreachable|comment|imports|size|lines|vulnerability"
NOT_HYGIENE = "(?i)secure|validate|sanitize|hardened|header"


def indicator_buckets(report: DataFrame) -> DataFrame:
    """``(repo, bucket, indicator)``; an indicator may fall into both named buckets."""
    told = F.col("indicator")
    hardening = told.rlike(HARDENING)
    hygiene = told.rlike(HYGIENE) & ~told.rlike(NOT_HYGIENE)
    buckets = F.array_compact(F.array(
        F.when(hardening, F.lit("hardening")), F.when(hygiene, F.lit("hygiene")),
        F.when(~hardening & ~hygiene, F.lit("classification"))))
    return (
        report.select("repo", F.explode("indicators").alias("indicator"))
        .select("repo", F.explode(buckets).alias("bucket"), "indicator")
    )
