"""SQL texts of the checks, built from the same fixed values as the Spark side.

Where Spark uses a window or a mask, the SQL joins pairs or tests one pattern
at a time, so the two sides share no method.
"""

from __future__ import annotations

import re

from catalog.corpus import RE2_SPACE, SQL_LINES, sql_text, sql_values
from riskloom import prose
from riskloom import registry as R

WORD = "\\p{L}\\p{N}_"


def re2(pattern: str) -> str:
    """The pattern for DuckDB's engine, whose own word and space classes are ASCII only."""
    def edge(match: re.Match) -> str:
        after = pattern[match.end():match.end() + 1]
        side = "^" if after and (after.isalnum() or after in "_(") else "$"
        return f"(?:{side}|[^{WORD}])"

    out = re.sub(r"\\b", edge, pattern)
    return out.replace(r"\s", f"[{RE2_SPACE}]").replace(r"\w", f"[{WORD}]")


def test(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {sql_text(re2(pattern))}, 'i')"


def starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {sql_text(p)})" for p in prefixes) + ")"


def first_match(column: str, signatures) -> str:
    return "CASE " + " ".join(f"WHEN {test(column, s.pattern)} THEN {i}" for i, s in enumerate(signatures)) + " END"


def hit_union(signatures, what: str) -> str:
    return " UNION ALL ".join(
        f"SELECT repo, file, line, code, {sql_text(s.name)} AS {what}, {i} AS {what}_id, {sql_text(s.kind)} AS kind "
        f"FROM flow_lines WHERE {test('code', s.pattern)}" for i, s in enumerate(signatures))


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(sql_text(v) for v in values)})"


_vuln_rows = [(i, s.name, s.severity, prose.ISSUE_DESCRIPTIONS[s.name]) for i, s in enumerate(R.VULNERABILITIES)]
_entry_rows = [(i, s.kind, s.name, s.severity) for i, s in enumerate(R.ENTRY_POINTS)]
_attack_rows = [(a, i, R.ATTACK_SEVERITY[a], prose.CHAIN_DESCRIPTIONS[a], prose.CHAIN_ALERTS[a])
                for i, a in enumerate(R.ATTACK_ORDER)]

SQL_FINDINGS = f"""
vulnerabilities AS (SELECT * FROM {sql_values(_vuln_rows, "v(vuln_id, issue, severity, description)")}),
findings AS (
  SELECT repo, file, line, issue, severity, code AS matched_code, description, raw
  FROM (SELECT *, {first_match('code', R.VULNERABILITIES)} AS vuln_id FROM lines
        WHERE code <> '' AND NOT {starts('code', R.FINDING_COMMENTS)}) JOIN vulnerabilities USING (vuln_id))
"""
SQL_ENTRIES = f"""
entry_kinds AS (SELECT * FROM {sql_values(_entry_rows, "e(entry_id, type, name, severity)")}),
entries AS (
  SELECT repo, file, line, type, name, severity, code AS matched_code
  FROM (SELECT *, {first_match('code', R.ENTRY_POINTS)} AS entry_id FROM lines
        WHERE code <> '' AND NOT {starts('code', R.FINDING_COMMENTS)}) JOIN entry_kinds USING (entry_id))
"""
SQL_FLOWS = f"""
flow_lines AS (SELECT * FROM lines WHERE code <> '' AND NOT {starts('code', R.CHAIN_COMMENTS)}),
sources AS ({hit_union(R.SOURCES, 'source')}),
sinks AS ({hit_union(R.SINKS, 'sink')})
"""
SQL_CHAINS = f"""
{SQL_FLOWS},
attacks AS (SELECT * FROM {sql_values(_attack_rows, "a(attack_type, attack_rank, severity_label, description, alert_message)")}),
chains AS (
  SELECT k.repo, k.file, k.line, min(k.code) AS matched_code, source, sink, k.kind AS attack_type,
         source_id, sink_id,
         CASE WHEN bool_or(s.line = k.line) THEN NULL ELSE min(s.line) END AS source_line
  FROM sinks k JOIN sources s
    ON s.repo = k.repo AND s.file = k.file AND s.line BETWEEN k.line - {R.SOURCE_WINDOW} AND k.line
  GROUP BY k.repo, k.file, k.line, source, sink, k.kind, source_id, sink_id)
"""

_SECRET = in_list("issue", R.SECRET_ISSUES)
_DANGEROUS = in_list("issue", R.DANGEROUS_ISSUES)

SQL_PRIORITY = f"""
first_risk AS (SELECT repo, lower(replace(file, chr(92), '/')) AS key, arg_min(ml_prediction, file) AS ml
               FROM risks GROUP BY ALL),
prioritized AS (
  SELECT *, CASE WHEN priority_score >= 80 THEN 'Critical' WHEN priority_score >= 50 THEN 'High'
                 WHEN priority_score >= 20 THEN 'Medium' ELSE 'Low' END AS priority
  FROM (
    SELECT f.*,
      CASE severity WHEN 'High' THEN 50 WHEN 'Medium' THEN 25 ELSE 5 END
      + CASE WHEN (f.repo, lower(f.file)) IN (SELECT (repo, lower(file)) FROM chains) THEN 30 ELSE 0 END
      + CASE WHEN (f.repo, lower(f.file)) IN (SELECT (repo, lower(file)) FROM entries WHERE severity IN ('High', 'Medium'))
             THEN 15 ELSE 0 END
      + CASE WHEN {_SECRET} THEN 20 ELSE 0 END
      + CASE r.ml WHEN 'High Risk' THEN 15 WHEN 'Medium Risk' THEN 7 ELSE 0 END AS priority_score
    FROM findings f LEFT JOIN first_risk r ON r.repo = f.repo AND r.key = lower(f.file)))
"""

SQL_CONTENT_STATS = f"""
file_stats AS (
  SELECT l.repo, l.file, count(*) AS total_lines,
    count(*) FILTER (code = '') AS blank_lines,
    count(*) FILTER ({starts('code', R.STATS_COMMENTS)}) AS comments,
    count(*) FILTER (regexp_matches(code, '^(import |from |include |require |#include)')) AS imports,
    count(*) FILTER (regexp_matches(code, '^(def |function |public |private |protected |async function )')) AS functions,
    count(*) FILTER (starts_with(code, 'class ')) AS classes
  FROM lines l GROUP BY l.repo, l.file),
sizes AS (SELECT repo, file, length(content) AS total_characters, strlen(content) AS size_bytes FROM contents)
"""

SQL_SHORTCUTS = "shortcut_files AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT repo, {sql_text(s.name)} AS shortcut, {s.weight} AS weight FROM contents "
    f"WHERE {test('content', s.pattern)}" for s in R.SHORTCUTS) + ")"

SQL_REPO = f"""
repos AS (SELECT DISTINCT repo FROM contents),
of_findings AS (
  SELECT repo, count(*) AS findings, count(*) FILTER (severity = 'High') AS high,
    count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
    count(*) FILTER ({_SECRET}) AS secrets, count(*) FILTER (contains(issue, 'SQL')) AS sql_issues,
    count(*) FILTER ({_DANGEROUS}) AS dangerous,
    count(*) FILTER (priority = 'Critical') AS critical_priority, count(*) FILTER (priority = 'High') AS high_priority
  FROM prioritized GROUP BY repo),
of_entries AS (
  SELECT repo, count(*) FILTER (severity = 'High') AS high_inputs,
    count(*) FILTER (severity IN ('High', 'Medium')) AS exposed_inputs FROM entries GROUP BY repo),
of_chains AS (
  SELECT repo, count(*) AS chains, count(*) FILTER (attack_type = {sql_text(R.RCE)}) AS rce_chains,
    count(*) FILTER (attack_type = {sql_text(R.COMMAND)}) AS command_chains,
    count(*) FILTER (attack_type = {sql_text(R.SQL)}) AS sql_chains,
    count(*) FILTER (attack_type = {sql_text(R.DESERIALIZATION)}) AS deserialization_chains,
    count(*) FILTER (attack_type = {sql_text(R.UPLOAD)}) AS upload_chains FROM chains GROUP BY repo),
of_risks AS (SELECT repo, count(*) FILTER (ml_prediction = 'High Risk') AS high_risk_files,
    count(*) FILTER (ml_prediction = 'Medium Risk') AS medium_risk_files FROM risks GROUP BY repo),
of_files AS (SELECT repo, count(*) AS total_files, sum(total_lines) AS total_lines, sum(comments) AS comments,
    sum(functions) AS functions FROM file_stats GROUP BY repo),
of_shortcuts AS (SELECT repo, sum(weight) AS shortcut_points FROM shortcut_files GROUP BY repo),
repo_counts AS (
  SELECT * FROM (
    SELECT repos.repo, total_files, total_lines, comments, functions,
      coalesce(findings, 0) AS findings, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
      coalesce(secrets, 0) AS secrets, coalesce(sql_issues, 0) AS sql_issues, coalesce(dangerous, 0) AS dangerous,
      coalesce(critical_priority, 0) AS critical_priority, coalesce(high_priority, 0) AS high_priority,
      coalesce(high_inputs, 0) AS high_inputs, coalesce(exposed_inputs, 0) AS exposed_inputs,
      coalesce(chains, 0) AS chains, coalesce(rce_chains, 0) AS rce_chains, coalesce(command_chains, 0) AS command_chains,
      coalesce(sql_chains, 0) AS sql_chains, coalesce(deserialization_chains, 0) AS deserialization_chains,
      coalesce(upload_chains, 0) AS upload_chains, coalesce(high_risk_files, 0) AS high_risk_files,
      coalesce(medium_risk_files, 0) AS medium_risk_files, coalesce(shortcut_points, 0) AS shortcut_points
    FROM repos LEFT JOIN of_findings USING (repo) LEFT JOIN of_entries USING (repo) LEFT JOIN of_chains USING (repo)
      LEFT JOIN of_risks USING (repo) LEFT JOIN of_files USING (repo) LEFT JOIN of_shortcuts USING (repo))),
scored AS (
  SELECT *, greatest(base_score - CASE project_ml_risk WHEN 'High Risk' THEN 20 WHEN 'Medium Risk' THEN 10 ELSE 0 END, 0)
              AS security_score,
    pts_high + pts_secrets + pts_chains + pts_shortcuts + pts_surface AS vibe_score
  FROM (
    SELECT *, greatest(100 - 25 * high - 10 * medium - 2 * low, 0) AS base_score,
      CASE WHEN high_risk_files > 0 THEN 'High Risk' WHEN medium_risk_files > 0 THEN 'Medium Risk' ELSE 'Safe' END
        AS project_ml_risk,
      least(7 * high, 35) AS pts_high, least(8 * secrets, 20) AS pts_secrets, least(10 * chains, 25) AS pts_chains,
      least(shortcut_points, 15) AS pts_shortcuts, least(high_inputs, 5) AS pts_surface
    FROM repo_counts)),
graded AS (
  SELECT *, CASE WHEN grade_score >= 90 THEN 'A' WHEN grade_score >= 75 THEN 'B' WHEN grade_score >= 55 THEN 'C'
                 WHEN grade_score >= 35 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT *, greatest(least(security_score - 8 * critical_priority - 3 * high_priority - 5 * chains
      - CASE WHEN vibe_score > 80 THEN 15 WHEN vibe_score > 60 THEN 10 ELSE 0 END, 100), 0) AS grade_score FROM scored))
"""

SCAN_CTES = [SQL_LINES, SQL_FINDINGS, SQL_ENTRIES, SQL_CHAINS, SQL_PRIORITY, SQL_CONTENT_STATS, SQL_SHORTCUTS, SQL_REPO]


def query(ctes: list[str], body: str, **types: str) -> str:
    """``WITH ctes SELECT`` the named columns of ``body``, cast to the given types."""
    head = "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else ""
    columns = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
    return f"{head}SELECT {columns} FROM ({body}) AS q"
