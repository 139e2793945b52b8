"""Results as tables, files and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import chains
from riskloom.plans.scan import Scan

REPORT_FIELDS = ("security_grade", "grade_label", "risk_score", "total_files", "total_vulnerabilities",
                 "attack_chains", "critical_count")


def _capped(caps: dict[str, int] | None, name: str, whole, top) -> DataFrame:
    return top(caps[name]) if caps and name in caps else whole()


def result_bundle(scan: Scan, caps: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The parts of a scan result, whole.

    ``caps`` names lists and the rows of them that a repository keeps at most, such as ``registry.RESULT_CAPS``; a
    capped list has a ``position``.
    """
    severity = scan.repo_facts.select("repo", "high", "medium", "low")
    report = scan.report
    return {
        "stats": scan.stats,
        "security": report.select("repo", "security_score", "base_score", "project_ml_risk", "summary", "summary_type"),
        "vibe_risk": report.select("repo", F.col("vibe_score").alias("score"), F.col("vibe_category").alias("category"),
                                   F.col("vibe_breakdown").alias("breakdown")),
        "maturity": report.select("repo", F.col("maturity_level").alias("level"), F.col("maturity_score").alias("score"),
                                  "indicators"),
        "findings": _capped(caps, "findings", lambda: scan.findings, scan.top_findings),
        "prioritized_findings": _capped(caps, "prioritized_findings", lambda: scan.prioritized, scan.top_prioritized),
        "entry_points": _capped(caps, "entry_points", lambda: scan.entry_points, scan.top_entry_points),
        "attack_surface": scan.attack_surface,
        "attack_chains": _capped(caps, "attack_chains", lambda: scan.chain_rows.select(*chains.CHAIN_COLUMNS), scan.top_chains),
        "file_risks": _capped(caps, "file_risks", lambda: scan.risks, scan.top_risks),
        "ranked_files": _capped(caps, "ranked_files", lambda: scan.ranked, scan.top_files),
        "severity_counts": severity,
        "security_grade": report.select("repo", "grade", "grade_score", F.col("grade_label").alias("label"),
                                        F.col("grade_color").alias("color"), F.col("grade_explanation").alias("explanation")),
        "fingerprint": scan.fingerprint,
        "intelligence_narrative": scan.narrative,
        "terminal_logs": scan.scan_log,
        "ml_explanations": scan.ml_explanations,
        "advice": scan.advice,
    }


def write_bundle(scan: Scan, folder: str, caps: dict[str, int] | None = None) -> list[str]:
    """One Parquet table per part, clustered by repository so that readers of one repository skip the rest.

    Repositories may be many, hence no directory per repository.  A failed
    write can be repeated.  Nothing is left out unless ``caps`` says so.
    """
    parts = result_bundle(scan, caps)
    for name, part in parts.items():
        part.repartitionByRange("repo").sortWithinPartitions("repo") \
            .write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(parts)


def write_findings_csv(prioritized: DataFrame, path: str) -> None:
    """All columns with a header; an empty input is an error."""
    if prioritized.isEmpty():
        raise ValueError("no prioritized findings to export")
    prioritized.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_training_csv(samples: DataFrame, path: str) -> None:
    """``code,label`` with a header and every field quoted."""
    samples.select("code", "label").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


EXTRACT = ("fingerprint", "security_grade", "attack_chains", "prioritized_findings", "stats")


def json_extract(scan: Scan, caps: dict[str, int] | None = None) -> DataFrame:
    """``(repo, part, position, record)``: fingerprint, grade, chains, prioritised findings and stats as JSON, whole unless capped.

    The two lists have one record per row instead of one array per repository, so no repository is gathered in one
    place.  ``position`` counts a capped list and is 1 elsewhere.
    """
    bundle = result_bundle(scan, caps)

    def records(part: str) -> DataFrame:
        rows = bundle[part]
        body = [c for c in rows.columns if c not in ("repo", "position")]
        position = F.col("position") if "position" in rows.columns else F.lit(1)
        return rows.select("repo", F.lit(part).alias("part"), position.alias("position"), F.to_json(F.struct(*body)).alias("record"))

    out = records(EXTRACT[0])
    for part in EXTRACT[1:]:
        out = out.unionByName(records(part))
    return out


def write_json_lines(scan: Scan, path: str, caps: dict[str, int] | None = None) -> None:
    """The extract as JSON lines, one record each: any number of records in a repository."""
    json_extract(scan, caps).write.mode("overwrite").json(path)


def write_json(scan: Scan, path: str, caps: dict[str, int]) -> None:
    """One JSON object with the five parts for each repository.

    An object is one row, so both lists must be capped; ``write_json_objects`` and ``write_json_lines`` write them whole.
    """
    if missing := {"attack_chains", "prioritized_findings"} - set(caps):
        raise ValueError(f"give caps for {sorted(missing)}")
    record = F.struct("position", "record")
    lists = json_extract(scan, caps).groupBy("repo").pivot("part", list(EXTRACT)).agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda r: r["record"]), ","), F.lit("]")))
    whole = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"repo":'), F.regexp_extract(F.to_json(F.struct("repo")), r"^\{\"repo\":(.*)\}$", 1)), *[
        F.concat(F.lit(f'"{part}":'), F.coalesce(F.col(part), F.lit("[]")) if part in ("attack_chains", "prioritized_findings")
                 else F.regexp_replace(part, r"^\[|\]$", "")) for part in EXTRACT]), F.lit("}"))
    lists.select(whole.alias("value")).write.mode("overwrite").text(path)


def write_json_objects(scan: Scan, path: str) -> None:
    """One JSON object with the five parts for each repository, whole, however long its lists are.

    A repository has a folder ``repo=...``; its files in the order of their names, one after the other, are the object.  Rows are sorted
    over range partitions by repository and place and streamed into these files, so no task holds a repository and a long one is
    written by many.  Spark commits all files at once: a task that fails and runs again leaves no half object.
    """
    lists = {"attack_chains": scan.chain_positions(), "prioritized_findings": scan.priority_positions()}
    bundle = result_bundle(scan) | lists
    repos = scan.repos.select("repo", F.regexp_extract(F.to_json(F.struct("repo")), r"^\{(.*)\}$", 1).alias("name"))
    pieces = [repos.select("repo", F.lit(0).alias("section"), F.lit(0).alias("place"), F.concat(F.lit("{"), "name").alias("value"))]
    for k, part in enumerate(EXTRACT, 1):
        rows, last = bundle[part], F.lit("}" if k == len(EXTRACT) else "")
        body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("repo", "position")]))
        if part in lists:
            comma = F.when(F.col("position") > 1, F.lit(",")).otherwise(F.lit(""))
            pieces += [repos.select("repo", F.lit(k).alias("section"), F.lit(0).alias("place"), F.lit(f',"{part}":[').alias("value")),
                       rows.select("repo", F.lit(k).alias("section"), F.col("position").alias("place"), F.concat(comma, body).alias("value")),
                       repos.select("repo", F.lit(k).alias("section"), F.lit(2 ** 62).alias("place"), F.concat(F.lit("]"), last).alias("value"))]
        else:
            found = repos.select("repo").join(rows.select("repo", body.alias("body")), "repo", "left")
            pieces.append(found.select("repo", F.lit(k).alias("section"), F.lit(0).alias("place"),
                                       F.concat(F.lit(f',"{part}":'), F.coalesce("body", F.lit("null")), last).alias("value")))
    whole = reduce(DataFrame.unionByName, [p.withColumn("place", F.col("place").cast("bigint")) for p in pieces])
    ordered = whole.repartitionByRange("repo", "section", "place").sortWithinPartitions("repo", "section", "place")
    ordered.select("repo", "value").write.mode("overwrite").partitionBy("repo").text(path)


def report_sections(scan: Scan) -> DataFrame:
    """``(repo, section, seq, text)``: headline fields, top findings, chains and files as text lines."""
    def section(number: int, rows: DataFrame, seq: Column, line: Column) -> DataFrame:
        return rows.select("repo", F.lit(number).alias("section"), seq.cast("int").alias("seq"), line.alias("text"))

    head = scan.fingerprint.select("repo", F.posexplode(F.array(*[
        F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in REPORT_FIELDS])).alias("pos", "text"))
    finding = F.format_string("[%s] %s:%d - %s", "priority", "file", "line", "issue")
    chain = F.format_string("Chain %d: %s in %s:%d  Source: %s -> Sink: %s",
                            "position", "attack_type", "file", "line", "source", "sink")
    ranked = F.format_string("%s - %s (score %d)", "file", "risk_label", "composite_score")
    return (
        section(1, head, F.col("pos") + 1, F.col("text"))
        .unionByName(section(2, scan.top_prioritized(10), F.col("position"), finding))
        .unionByName(section(3, scan.top_chains(5), F.col("position"), chain))
        .unionByName(section(4, scan.top_files(5), F.col("position"), ranked))
    )
