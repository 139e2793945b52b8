"""Scan operators over the code corpus, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import corpus, sql
from riskloom import prose
from riskloom import registry as R
from riskloom.functions import text
from riskloom.functions.durable import claim, durable, remove, shared_folder
from riskloom.operators import advice, borders, chains, hits, narrative, patching, rollup, scores, search
from riskloom.operators import lines as line_ops
from riskloom.operators.trigrams import TrigramIndex
from riskloom.plans.scan import Scan, scan
from riskloom.sinks import export
from riskloom.sources import tree
from riskloom.sources.samples import read_csv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
S, B, D, L = "VARCHAR", "BIGINT", "DOUBLE", "BOOLEAN"
AT = {"repo": S, "file": S}
AT_LINE = {**AT, "line": B}


def _whole_numbers(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{n}`").cast("bigint").alias(n) if t in ("tinyint", "smallint", "int") else F.col(f"`{n}`")
                      for n, t in df.dtypes])


def register(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: _whole_numbers(build(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return build
    return add


def corpus_scan(spark: SparkSession, sf_dir: str, *store: str) -> Scan:
    """The scan of the corpus; ``store`` names the tables that a query reads more than once."""
    files = corpus.files(spark, sf_dir)
    return scan(files, file_risks=corpus.file_risks(files), store=store)


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_ops.lines(corpus.files(spark, sf_dir))


def corpus_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.line_facts(corpus_lines(spark, sf_dir))


LINES = [corpus.SQL_LINES]
FINDINGS = [*LINES, sql.SQL_FINDINGS]
ENTRIES = [*LINES, sql.SQL_ENTRIES]
CHAINS = [*LINES, sql.SQL_CHAINS]
PRIORITY = [*LINES, sql.SQL_FINDINGS, sql.SQL_ENTRIES, sql.SQL_CHAINS, sql.SQL_PRIORITY]
STATS = [*LINES, sql.SQL_CONTENT_STATS]
SHORTCUTS = [*LINES, sql.SQL_SHORTCUTS]
REPO = sql.SCAN_CTES

FINDING = {**AT_LINE, "issue": S, "severity": S, "matched_code": S, "description": S}
ENTRY = {**AT_LINE, "type": S, "name": S, "severity": S, "matched_code": S}
CHAIN = {**AT_LINE, "matched_code": S, "source": S, "sink": S, "attack_type": S, "description": S,
         "alert_message": S, "severity_label": S, "source_line": B}
CHAIN_BODY = "SELECT * FROM chains JOIN attacks USING (attack_type)"

# --- sources -----------------------------------------------------------------

# Directories given to the files of the corpus, by document.
FOLDERS = ("app/", ".git/", "src/node_modules/x/", "build/out/", "builder/", "a/.cache/", "venv/", "lib/dist/",
           "distance/", "__pycache__/", "Build/", "")
NAMES = (".py", ".PY", ".env", ".tar.GZ", ".yaml", ".md", ".Java", "")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    folder = F.get(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS)).cast("int"))
    ending = F.get(F.array(*map(F.lit, NAMES)), (F.floor(F.col("doc_id") / 3) % len(NAMES)).cast("int"))
    stem = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return docs.select(F.col("source").alias("repo"), F.concat(folder, stem, ending).alias("file"),
                       (F.col("n_chars") * 64).alias("size_bytes"), "doc_id")


_case = lambda key, values: "CASE " + key + " " + " ".join(
    f"WHEN {i} THEN {corpus.sql_text(v)}" for i, v in enumerate(values)) + " END"
PATHS = f"""paths AS (
  SELECT source AS repo, {_case(f'doc_id % {len(FOLDERS)}', FOLDERS)} || CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'f' || doc_id END
    || {_case(f'(doc_id // 3) % {len(NAMES)}', NAMES)} AS file, n_chars * 64 AS size_bytes, doc_id FROM documents)"""
SQL_EXT = "lower(regexp_extract(split_part(file, '/', -1), '(?s)^\\.*[^.].*(\\.[^.]*)$', 1))"
_path = {**AT, "size_bytes": B, "doc_id": B}


@register("tree_filter", sql.query([PATHS], """
  SELECT * FROM paths WHERE NOT coalesce(list_bool_or([starts_with(d, '.')
    OR d IN ('node_modules', '__pycache__', 'dist', 'build', 'venv') FOR d IN string_split(file, '/')[:-2]]), false)""", **_path))
def tree_filter(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~tree.in_skipped_directory(F.col("file")))


@register("ext_filter", sql.query(
    [PATHS], f"SELECT *, {SQL_EXT} AS ext FROM paths WHERE {sql.in_list(SQL_EXT, R.SCANNED_EXTENSIONS)}", **_path, ext=S))
def ext_filter(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("ext", text.extension(F.col("file"))).filter(
        tree.has_scanned_extension(F.col("file")))


@register("size_guard", sql.query([PATHS], "SELECT * FROM paths WHERE size_bytes <= 1048576", **_path))
def size_guard(spark, sf_dir):
    return _paths(spark, sf_dir).filter(tree.fits_size(F.col("size_bytes"), R.MAX_FILE_BYTES))


@register("file_cap", sql.query(
    LINES, "SELECT repo, file FROM contents QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file) <= 20", **AT))
def file_cap(spark, sf_dir):
    return tree.cap_files(corpus.files(spark, sf_dir).select("repo", "file"), 20)


@register("safe_decode", sql.query(
    [], "SELECT doc_id, text || chr(65533) || '.' AS content FROM documents", doc_id=B, content=S))
def safe_decode(spark, sf_dir):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF2E")))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tree.decode(broken).alias("content"))


@register("lines", sql.query(LINES, "SELECT * FROM lines", **AT_LINE, raw=S, code=S))
def lines(spark, sf_dir):
    return corpus_lines(spark, sf_dir)


# --- lines and files -----------------------------------------------------------

_languages = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in R.LANGUAGES.items()) + " ELSE 'Unknown' END"


@register("language", sql.query([PATHS], f"SELECT repo, file, {_languages} AS language FROM (SELECT *, {SQL_EXT} AS ext FROM paths)",
                                **AT, language=S))
def language(spark, sf_dir):
    return line_ops.file_metadata(_paths(spark, sf_dir)).select("repo", "file", "language")


@register("file_metadata", sql.query(
    LINES, f"""SELECT repo, file, split_part(file, '/', -1) AS filename, ext AS extension,
      round(strlen(content) / 1024.0, 2) AS size_kb, {_languages} AS language
      FROM (SELECT *, {SQL_EXT} AS ext FROM contents)""", **AT, filename=S, extension=S, size_kb=D, language=S))
def file_metadata(spark, sf_dir):
    return line_ops.file_metadata(corpus.files(spark, sf_dir))


@register("line_classes", sql.query(LINES, f"""
  SELECT repo, file, line, code = '' AS is_blank, {sql.starts('code', R.STATS_COMMENTS)} AS is_comment,
    regexp_matches(code, '^(import |from |include |require |#include)') AS is_import,
    regexp_matches(code, '^(def |function |public |private |protected |async function )') AS is_function,
    starts_with(code, 'class ') AS is_class FROM lines""",
    **AT_LINE, is_blank=L, is_comment=L, is_import=L, is_function=L, is_class=L))
def line_classes(spark, sf_dir):
    return line_ops.classify_lines(corpus_lines(spark, sf_dir)).drop("raw", "code")


@register("eligible_lines", sql.query(
    LINES, f"SELECT * FROM lines WHERE code <> '' AND NOT {sql.starts('code', R.FINDING_COMMENTS)}", **AT_LINE, code=S))
def eligible_lines(spark, sf_dir):
    return line_ops.scannable_lines(corpus_lines(spark, sf_dir)).drop("raw")


@register("findings", sql.query(FINDINGS, "SELECT * FROM findings", **FINDING))
def findings(spark, sf_dir):
    return hits.findings(corpus_facts(spark, sf_dir))


@register("entry_points", sql.query(ENTRIES, "SELECT * FROM entries", **ENTRY))
def entry_points(spark, sf_dir):
    return hits.entry_points(corpus_facts(spark, sf_dir))


@register("source_hits", sql.query([*LINES, sql.SQL_FLOWS], "SELECT * FROM sources", **AT_LINE, source=S))
def source_hits(spark, sf_dir):
    return hits.source_hits(corpus_facts(spark, sf_dir))


@register("sink_hits", sql.query([*LINES, sql.SQL_FLOWS], "SELECT * FROM sinks", **AT_LINE, sink=S))
def sink_hits(spark, sf_dir):
    return hits.sink_hits(corpus_facts(spark, sf_dir))


@register("vibe_presence", sql.query(SHORTCUTS, "SELECT * FROM shortcut_files", repo=S, shortcut=S, weight=B))
def vibe_presence(spark, sf_dir):
    return rollup.shortcut_presence(line_ops.file_profile(corpus.files(spark, sf_dir)))


def _pieces(spark, sf_dir):
    """A repository for every document, cut into a file after each equals sign."""
    files = corpus.files(spark, sf_dir)
    cut = files.select("repo", "doc_id", F.posexplode(F.split("content", "(?<==)")).alias("n", "content"))
    return cut.select(F.concat("repo", F.lit("/"), "doc_id").alias("repo"), F.format_string("part%08d.py", "n").alias("file"), "content",
                      F.octet_length("content").cast("bigint").alias("size_bytes"))


@register("vibe_joined", sql.query(LINES, " UNION ALL ".join(
    f"SELECT repo || '/' || doc_id AS repo, {sql.sql_text(s.name)} AS shortcut, {s.weight} AS weight FROM contents "
    f"WHERE {sql.test("replace(content, '=', '=' || chr(10))", s.pattern)}" for s in R.SHORTCUTS), repo=S, shortcut=S, weight=B))
def vibe_joined(spark, sf_dir):
    """Shortcuts over the joined text of a repository whose files end in the middle of them."""
    files = _pieces(spark, sf_dir)
    return rollup.shortcut_presence(borders.with_borders(line_ops.file_profile(files), files))


@register("file_stats", sql.query(
    STATS, "SELECT * FROM file_stats JOIN sizes USING (repo, file)", **AT, **{c: B for c in line_ops.STATS}))
def file_stats(spark, sf_dir):
    return line_ops.file_stats(corpus.files(spark, sf_dir))


@register("project_stats", sql.query(STATS, """
  SELECT repo, count(*) AS total_files, sum(total_lines) AS total_lines, sum(blank_lines) AS blank_lines,
    sum(comments) AS comments, sum(imports) AS imports, sum(functions) AS functions, sum(classes) AS classes,
    round(sum(round(size_bytes / 1024.0, 2)), 2) AS size_kb
  FROM file_stats JOIN sizes USING (repo, file) GROUP BY repo""",
    repo=S, total_files=B, total_lines=B, blank_lines=B, comments=B, imports=B, functions=B, classes=B, size_kb=D))
def project_stats(spark, sf_dir):
    return rollup.project_stats(line_ops.file_profile(corpus.files(spark, sf_dir)))


_context = {**AT_LINE, "issue": S, "first_line": B, "context": S}


@register("context", sql.query([*FINDINGS, f"""
  around AS (
    SELECT repo, file, line, min(line) OVER w AS first_line, string_agg(raw, chr(10)) OVER w AS context
    FROM lines WINDOW w AS (PARTITION BY repo, file ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""],
    "SELECT repo, file, line, issue, first_line, context FROM findings JOIN around USING (repo, file, line)", **_context))
def context(spark, sf_dir):
    windows = line_ops.line_windows(corpus.files(spark, sf_dir))
    carried = ("first_line", "context")
    found = hits.findings(hits.line_facts(windows, carry=carried), carry=carried)
    return found.select("repo", "file", "line", "issue", "first_line", F.array_join("context", "\n").alias("context"))


# --- chains ----------------------------------------------------------------------

@register("chains", sql.query(CHAINS, CHAIN_BODY, **CHAIN))
def attack_chains(spark, sf_dir):
    return chains.attack_chains(corpus_facts(spark, sf_dir)).select(*chains.CHAIN_COLUMNS)


@register("chains_same_line", sql.query([*LINES, sql.SQL_FLOWS], """
  SELECT k.repo, k.file, k.line, source, sink FROM sinks k JOIN sources s USING (repo, file, line)""",
    **AT_LINE, source=S, sink=S))
def chains_same_line(spark, sf_dir):
    rows = chains.attack_chains(corpus_facts(spark, sf_dir))
    return rows.filter("source_line IS NULL").select("repo", "file", "line", "source", "sink")


@register("chain_text", sql.query(CHAINS, """
  SELECT attack_type, severity_label, description, alert_message, count(*) AS chains
  FROM chains JOIN attacks USING (attack_type) GROUP BY ALL""",
    attack_type=S, severity_label=S, description=S, alert_message=S, chains=B))
def chain_text(spark, sf_dir):
    return chains.attack_chains(corpus_facts(spark, sf_dir)) \
        .groupBy("attack_type", "severity_label", "description", "alert_message").agg(F.count(F.lit(1)).alias("chains"))


CHAIN_TOP = """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY attack_rank, file, source_line IS NOT NULL, line,
  source_line, source_id, sink_id) AS position FROM chains JOIN attacks USING (attack_type)"""


@register("chains_top50", sql.query(CHAINS, f"SELECT * FROM ({CHAIN_TOP}) WHERE position <= 50", **CHAIN, position=B))
def chains_top50(spark, sf_dir):
    return corpus_scan(spark, sf_dir).top_chains(50)


@register("chain_summary", sql.query(CHAINS, "SELECT repo, attack_type, count(*) AS chains FROM chains GROUP BY ALL",
                                     repo=S, attack_type=S, chains=B))
def chain_summary(spark, sf_dir):
    return chains.chain_summary(chains.attack_chains(corpus_facts(spark, sf_dir)))


# --- findings ----------------------------------------------------------------------

@register("has_chain", sql.query([*FINDINGS, sql.SQL_CHAINS], """
  SELECT repo, file, line, issue, (repo, lower(file)) IN (SELECT (repo, lower(file)) FROM chains) AS has_chain FROM findings""",
    **AT_LINE, issue=S, has_chain=L))
def has_chain(spark, sf_dir):
    found = corpus_scan(spark, sf_dir, "facts")
    flags = found.counts.select("repo", "file_norm", (F.col("chains") > 0).alias("has_chain"))
    return found.findings.withColumn("file_norm", text.path_key(F.col("file"))) \
        .join(flags, ["repo", "file_norm"], "left").select("repo", "file", "line", "issue", "has_chain")


@register("has_input", sql.query([*FINDINGS, sql.SQL_ENTRIES], """
  SELECT repo, file, line, issue, (repo, lower(file)) IN
    (SELECT (repo, lower(file)) FROM entries WHERE severity IN ('High', 'Medium')) AS has_input FROM findings""",
    **AT_LINE, issue=S, has_input=L))
def has_input(spark, sf_dir):
    found = corpus_scan(spark, sf_dir, "facts")
    flags = found.counts.select("repo", "file_norm", (F.col("exposed_inputs") > 0).alias("has_input"))
    return found.findings.withColumn("file_norm", text.path_key(F.col("file"))) \
        .join(flags, ["repo", "file_norm"], "left").select("repo", "file", "line", "issue", "has_input")


PRIORITIZED = {**FINDING, "priority_score": B, "priority": S}
PRIORITY_TOP = """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY
  CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, file, line) AS position FROM prioritized"""


@register("priority", sql.query(PRIORITY, "SELECT * FROM prioritized", **PRIORITIZED))
def priority(spark, sf_dir):
    return corpus_scan(spark, sf_dir, "facts").prioritized


@register("priority_top200", sql.query(PRIORITY, f"SELECT * FROM ({PRIORITY_TOP}) WHERE position <= 200",
                                       **PRIORITIZED, position=B))
def priority_top200(spark, sf_dir):
    return corpus_scan(spark, sf_dir, "facts").top_prioritized(200)


@register("priority_filters", sql.query(PRIORITY, """
  SELECT 'critical' AS kept, repo, file, line, priority FROM prioritized WHERE priority = 'Critical'
  UNION ALL SELECT 'high_and_above', repo, file, line, priority FROM prioritized WHERE priority IN ('Critical', 'High')""",
    kept=S, **AT_LINE, priority=S))
def priority_filters(spark, sf_dir):
    found = corpus_scan(spark, sf_dir, "facts").prioritized.select("repo", "file", "line", "priority")
    return scores.critical_findings(found).withColumn("kept", F.lit("critical")).unionByName(
        scores.high_and_above(found).withColumn("kept", F.lit("high_and_above")))


@register("search_findings", sql.query(FINDINGS, """
  SELECT * FROM findings WHERE (contains(lower(issue), 'sql') OR contains(lower(file), 'sql')) AND lower(severity) = 'high'""",
    **FINDING))
def search_findings(spark, sf_dir):
    return search.search_findings(findings(spark, sf_dir), "SQL", "high")


@register("search_entries", sql.query(ENTRIES, """
  SELECT * FROM entries WHERE (contains(lower(file), 'request') OR contains(lower(matched_code), 'request'))
    AND contains(lower(type), 'parameter')""", **ENTRY))
def search_entries(spark, sf_dir):
    return search.search_entry_points(entry_points(spark, sf_dir), "request", "parameter")


@register("search_findings_index", ORACLE["search_findings"])
def search_findings_index(spark, sf_dir):
    """The same search through a trigram index."""
    with TrigramIndex(findings(spark, sf_dir), ("issue", "file")) as index:
        return durable(search.search_findings(index.containing("SQL"), "SQL", "high"), "found")


@register("search_entries_index", ORACLE["search_entries"])
def search_entries_index(spark, sf_dir):
    with TrigramIndex(entry_points(spark, sf_dir), ("file", "matched_code")) as index:
        return durable(search.search_entry_points(index.containing("request"), "request", "parameter"), "found")


@register("severity_counts", sql.query(FINDINGS, """
  SELECT repo, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
    count(*) FILTER (severity = 'Low') AS low FROM findings GROUP BY repo""", repo=S, high=B, medium=B, low=B))
def severity_counts(spark, sf_dir):
    return rollup.severity_counts(findings(spark, sf_dir), "repo")


@register("file_severity_pivot", sql.query(FINDINGS, """
  SELECT repo, file, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
    count(*) FILTER (severity = 'Low') AS low FROM findings GROUP BY repo, file""", **AT, high=B, medium=B, low=B))
def file_severity_pivot(spark, sf_dir):
    return rollup.severity_counts(findings(spark, sf_dir), "repo", "file")


@register("stat_levels", sql.query([*STATS, *[c for c in FINDINGS if c not in STATS]], """
  SELECT repo, file, GROUPING(repo, file)::BIGINT AS level, sum(files)::BIGINT AS files, sum(total_lines)::BIGINT AS total_lines, sum(blank_lines)::BIGINT AS blank_lines,
    sum(comments)::BIGINT AS comments, sum(imports)::BIGINT AS imports, sum(functions)::BIGINT AS functions, sum(classes)::BIGINT AS classes,
    sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low
  FROM (SELECT repo, file, 1 AS files, total_lines, blank_lines, comments, imports, functions, classes, 0 AS high, 0 AS medium, 0 AS low FROM file_stats JOIN sizes USING (repo, file)
    UNION ALL SELECT repo, file, 0, 0, 0, 0, 0, 0, 0, (severity = 'High')::INT, (severity = 'Medium')::INT, (severity = 'Low')::INT FROM findings)
  GROUP BY ROLLUP (repo, file)""", **AT, level=B, files=B, total_lines=B, blank_lines=B, comments=B, imports=B, functions=B, classes=B, high=B, medium=B, low=B))
def stat_levels(spark, sf_dir):
    found = corpus_scan(spark, sf_dir)
    return rollup.stat_levels(found.profile, found.findings)


@register("file_score", sql.query(FINDINGS, """
  SELECT c.repo, c.file, greatest(100 - coalesce(sum(CASE severity WHEN 'High' THEN 25 WHEN 'Medium' THEN 10 WHEN 'Low' THEN 2 END), 0), 0)
    AS score FROM contents c LEFT JOIN findings f USING (repo, file) GROUP BY c.repo, c.file""", **AT, score=B))
def file_score(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return scores.file_scores(files, rollup.severity_counts(hits.findings(hits.line_facts(line_ops.lines(files))), "repo", "file"))


# --- files and repositories ------------------------------------------------------

RANKED = {**AT, "composite_score": B, "vuln_count": B, "high_vulns": B, "medium_vulns": B, "low_vulns": B,
          "chain_count": B, "ml_prediction": S, "risk_label": S}
RANKED_BODY = """SELECT *, CASE WHEN composite_score >= 80 THEN 'Critical' WHEN composite_score >= 45 THEN 'High'
    WHEN composite_score >= 15 THEN 'Medium' ELSE 'Low' END AS risk_label FROM (
  SELECT c.repo, c.file, coalesce(h, 0) AS high_vulns, coalesce(m, 0) AS medium_vulns, coalesce(l, 0) AS low_vulns,
    coalesce(h, 0) + coalesce(m, 0) + coalesce(l, 0) AS vuln_count, coalesce(n, 0) AS chain_count, ml_prediction,
    25 * coalesce(h, 0) + 10 * coalesce(m, 0) + 2 * coalesce(l, 0) + least(30 * coalesce(n, 0), 60)
      + CASE ml_prediction WHEN 'High Risk' THEN 20 WHEN 'Medium Risk' THEN 10 ELSE 0 END AS composite_score
  FROM contents c
  LEFT JOIN (SELECT repo, file, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m,
      count(*) FILTER (severity = 'Low') AS l FROM findings GROUP BY ALL) USING (repo, file)
  LEFT JOIN (SELECT repo, file, count(*) AS n FROM chains GROUP BY ALL) USING (repo, file)
  LEFT JOIN risks USING (repo, file))"""


@register("ranked_files", sql.query([*FINDINGS, sql.SQL_CHAINS], RANKED_BODY, **RANKED))
def ranked_files(spark, sf_dir):
    return corpus_scan(spark, sf_dir).ranked


@register("ranked_positions", sql.query([*FINDINGS, sql.SQL_CHAINS], f"""
  SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY composite_score DESC, file) AS position FROM ({RANKED_BODY})""", **AT, position=B))
def ranked_positions(spark, sf_dir):
    return corpus_scan(spark, sf_dir, "facts").file_positions().select("repo", "file", "position")


@register("priority_positions", sql.query(PRIORITY, f"SELECT repo, file, line, issue, priority, position FROM ({PRIORITY_TOP})",
                                          **AT_LINE, issue=S, priority=S, position=B))
def priority_positions(spark, sf_dir):
    return corpus_scan(spark, sf_dir, "facts").priority_positions().select("repo", "file", "line", "issue", "priority", "position")


@register("chain_positions", sql.query(CHAINS, f"SELECT * FROM ({CHAIN_TOP})", **CHAIN, position=B))
def chain_positions(spark, sf_dir):
    return corpus_scan(spark, sf_dir, "facts").chain_positions()


@register("attack_surface", sql.query(ENTRIES, """
  SELECT c.repo, count(*) FILTER (type <> 'Route Handler') AS total_entry_points,
    count(*) FILTER (type = 'Route Handler') AS total_endpoints, count(*) FILTER (type = 'File Upload') AS risky_uploads,
    count(*) FILTER (severity = 'High' AND type <> 'Route Handler') AS high_severity_inputs,
    count(*) FILTER (type = 'API Input') AS exposed_apis, count(*) FILTER (type = 'PHP Input') AS php_inputs
  FROM (SELECT DISTINCT repo FROM contents) c LEFT JOIN entries USING (repo) GROUP BY c.repo""",
    repo=S, total_entry_points=B, total_endpoints=B, risky_uploads=B, high_severity_inputs=B, exposed_apis=B, php_inputs=B))
def attack_surface(spark, sf_dir):
    return corpus_scan(spark, sf_dir).attack_surface


@register("security_score", sql.query(REPO, """
  SELECT repo, base_score, CASE WHEN findings = 0 THEN 'success' WHEN high > 0 THEN 'error' WHEN medium > 0 THEN 'warning'
      ELSE 'info' END AS summary_type,
    CASE WHEN findings = 0 THEN 'No weaknesses found.' WHEN high > 0 THEN 'CRITICAL: ' || high || ' high-severity findings.'
      WHEN medium > 0 THEN 'WARNING: ' || medium || ' medium-severity findings.'
      ELSE 'NOTICE: ' || findings || ' low-severity findings.' END AS summary FROM scored""",
    repo=S, base_score=B, summary_type=S, summary=S))
def security_score(spark, sf_dir):
    return scores.with_security_score(corpus_scan(spark, sf_dir).repo_facts).select(
        "repo", "base_score", "summary_type", "summary")


_vibe = {c: B for c in ("pts_high", "pts_secrets", "pts_chains", "pts_shortcuts", "pts_surface", "vibe_score")}


@register("vibe_index", sql.query(REPO, """
  SELECT *, CASE WHEN vibe_score <= 30 THEN 'Low Risk' WHEN vibe_score <= 70 THEN 'Medium Risk' ELSE 'High Risk' END
    AS vibe_category FROM scored""", repo=S, **_vibe, vibe_category=S))
def vibe_index(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select("repo", *_vibe, "vibe_category")


SQL_MATURITY = """maturity AS (
  SELECT *, CASE WHEN maturity_score >= 75 THEN 'Advanced' WHEN maturity_score >= 45 THEN 'Intermediate' ELSE 'Beginner' END
    AS maturity_level
  FROM (SELECT *, greatest(CASE WHEN high = 0 AND medium = 0 THEN least(raw_score + 10, 100) ELSE raw_score END, 0) AS maturity_score
    FROM (SELECT *, 100 - 15 * high - 7 * medium - 10 * secrets - 8 * sql_issues
      - CASE WHEN high_inputs > 5 THEN 10 ELSE 0 END AS raw_score FROM scored))),
told AS (
  SELECT repo, unnest([x FOR x IN [
    CASE WHEN high > 0 THEN '- ' || high || ' findings of high severity' END,
    CASE WHEN medium > 0 THEN '- ' || medium || ' findings of medium severity' END,
    CASE WHEN secrets > 0 THEN '- ' || secrets || ' credentials written into the source' END,
    CASE WHEN sql_issues > 0 THEN '- queries are built from text instead of bound' END,
    CASE WHEN high_inputs > 5 THEN '- ' || high_inputs || ' entry points of high severity' END,
    CASE WHEN comments > 10 THEN '+ comment lines are present' END,
    CASE WHEN functions > 3 THEN '+ code is split into functions' END,
    CASE WHEN high = 0 AND medium = 0 THEN '+ no findings of high or medium severity' END] IF x IS NOT NULL]) AS indicator
  FROM maturity)"""


@register("maturity", sql.query([*REPO, SQL_MATURITY], "SELECT * FROM maturity", repo=S, maturity_score=B, maturity_level=S))
def maturity(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select("repo", "maturity_score", "maturity_level")


@register("maturity_indicators", sql.query([*REPO, SQL_MATURITY], "SELECT * FROM told", repo=S, indicator=S))
def maturity_indicators(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select("repo", F.explode("indicators").alias("indicator"))


@register("indicator_buckets", sql.query([*REPO, SQL_MATURITY, f"""
  marked AS (SELECT *, regexp_matches(indicator, '{narrative.HARDENING}') AS hardening,
    regexp_matches(indicator, '{narrative.HYGIENE}') AND NOT regexp_matches(indicator, '{narrative.NOT_HYGIENE}') AS hygiene FROM told)"""], """
  SELECT repo, 'hardening' AS bucket, indicator FROM marked WHERE hardening
  UNION ALL SELECT repo, 'hygiene', indicator FROM marked WHERE hygiene
  UNION ALL SELECT repo, 'classification', indicator FROM marked WHERE NOT hardening AND NOT hygiene""",
    repo=S, bucket=S, indicator=S))
def indicator_buckets(spark, sf_dir):
    return narrative.indicator_buckets(corpus_scan(spark, sf_dir).report)


@register("project_risk", sql.query(LINES, """
  SELECT repo, CASE WHEN bool_or(ml_prediction = 'High Risk') THEN 'High Risk'
    WHEN bool_or(ml_prediction = 'Medium Risk') THEN 'Medium Risk' ELSE 'Safe' END AS project_ml_risk FROM risks GROUP BY repo""",
    repo=S, project_ml_risk=S))
def project_risk(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select("repo", "project_ml_risk")


@register("adjusted_score", sql.query(REPO, "SELECT * FROM scored", repo=S, base_score=B, security_score=B))
def adjusted_score(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select("repo", "base_score", "security_score")


_grade_rows = [(g, *t) for g, t in prose.GRADES.items()]
GRADES = f"grades AS (SELECT * FROM {corpus.sql_values(_grade_rows, 'g(grade, grade_label, grade_color, grade_explanation)')})"


@register("grade", sql.query([*REPO, GRADES], "SELECT * FROM graded JOIN grades USING (grade)",
                             repo=S, grade=S, grade_score=B, grade_label=S, grade_color=S, grade_explanation=S))
def grade(spark, sf_dir):
    return corpus_scan(spark, sf_dir).report.select(
        "repo", "grade", "grade_score", "grade_label", "grade_color", "grade_explanation")


FINGERPRINT = {"repo": S, "total_files": B, "total_lines": B, "total_vulnerabilities": B, "critical_count": B,
               "total_endpoints": B, "dangerous_functions": B, "attack_chains": B, "secret_exposures": B,
               "high_risk_files": B, "medium_risk_files": B, "risk_score": B, "security_grade": S, "grade_label": S,
               "grade_color": S, "health_score": B}
FINGERPRINT_BODY = """SELECT repo, total_files, total_lines, findings AS total_vulnerabilities, high AS critical_count,
    exposed_inputs AS total_endpoints, dangerous AS dangerous_functions, chains AS attack_chains, secrets AS secret_exposures,
    high_risk_files, medium_risk_files, 100 - security_score AS risk_score, grade AS security_grade, grade_label, grade_color,
    security_score AS health_score FROM graded JOIN grades USING (grade)"""


@register("fingerprint", sql.query([*REPO, GRADES], FINGERPRINT_BODY, **FINGERPRINT))
def fingerprint(spark, sf_dir):
    return corpus_scan(spark, sf_dir).fingerprint


# --- results ------------------------------------------------------------------

@register("top_risks", sql.query(LINES, """
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, file) AS position FROM risks QUALIFY position <= 10""",
    **AT, ml_prediction=S, confidence=D, position=B))
def top_risks(spark, sf_dir):
    return corpus_scan(spark, sf_dir).top_risks(10)


@register("result_caps", sql.query(PRIORITY, f"""
  SELECT 'findings' AS part, repo, file, line, position FROM
    (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line) AS position FROM findings) WHERE position <= 200
  UNION ALL SELECT 'prioritized_findings', repo, file, line, position FROM ({PRIORITY_TOP}) WHERE position <= 200
  UNION ALL SELECT 'entry_points', repo, file, line, position FROM
    (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line) AS position FROM entries) WHERE position <= 100
  UNION ALL SELECT 'attack_chains', repo, file, line, position FROM ({CHAIN_TOP}) WHERE position <= 50
  UNION ALL SELECT 'ranked_files', repo, file, 0, position FROM
    (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY composite_score DESC, file) AS position FROM ({RANKED_BODY}))
    WHERE position <= 50""", part=S, **AT_LINE, position=B))
def result_caps(spark, sf_dir):
    found = corpus_scan(spark, sf_dir, "facts")
    caps = R.RESULT_CAPS
    parts = {"findings": found.top_findings(caps["findings"]), "prioritized_findings": found.top_prioritized(caps["prioritized_findings"]),
             "entry_points": found.top_entry_points(caps["entry_points"]), "attack_chains": found.top_chains(caps["attack_chains"]),
             "ranked_files": found.top_files(caps["ranked_files"]).withColumn("line", F.lit(0))}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("part"), "repo", "file", "line", "position")
        out = rows if out is None else out.unionByName(rows)
    return out


_report_head = " UNION ALL ".join(
    f"SELECT repo, 1 AS section, {i} AS seq, '{n}: ' || {n} AS text FROM fingerprint" for i, n in enumerate(export.REPORT_FIELDS, 1))


@register("report_sections", sql.query([*REPO, GRADES, f"fingerprint AS ({FINGERPRINT_BODY})"], f"""
  {_report_head}
  UNION ALL SELECT repo, 2, position, '[' || priority || '] ' || file || ':' || line || ' - ' || issue
    FROM ({PRIORITY_TOP}) WHERE position <= 10
  UNION ALL SELECT repo, 3, position, 'Chain ' || position || ': ' || attack_type || ' in ' || file || ':' || line
    || '  Source: ' || source || ' -> Sink: ' || sink FROM ({CHAIN_TOP}) WHERE position <= 5
  UNION ALL SELECT repo, 4, position, file || ' - ' || risk_label || ' (score ' || composite_score || ')' FROM
    (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY composite_score DESC, file) AS position FROM ({RANKED_BODY}))
    WHERE position <= 5""", repo=S, section=B, seq=B, text=S))
def report_sections(spark, sf_dir):
    return export.report_sections(corpus_scan(spark, sf_dir, "facts"))


@register("findings_csv", sql.query(PRIORITY, "SELECT repo, file, CAST(line AS VARCHAR) AS line, issue, severity, priority FROM prioritized",
                                     repo=S, file=S, line=S, issue=S, severity=S, priority=S))
def findings_csv(spark, sf_dir):
    """The prioritised findings, written as CSV and read back."""
    folder = f"{shared_folder(spark)}/findings-csv-{uuid.uuid4().hex}"
    export.write_findings_csv(corpus_scan(spark, sf_dir, "facts").prioritized, folder)
    try:
        return durable(read_csv(spark, folder).select("repo", "file", "line", "issue", "severity", "priority"), "findings-csv")
    finally:
        remove(spark, [folder])


# What each part's records are compared by, as JSON fields.
_EXTRACTED = {"fingerprint": ("security_grade", "total_vulnerabilities", "attack_chains"), "security_grade": ("grade", "label"),
              "attack_chains": ("attack_type", "source", "sink"), "prioritized_findings": ("issue", "severity", "priority", "priority_score"),
              "stats": ("total_files", "total_lines", "comments", "classes")}


@register("json_extract", sql.query([*REPO, GRADES, f"fingerprint AS ({FINGERPRINT_BODY})"], """
  SELECT repo, 'fingerprint' AS part, NULL::VARCHAR AS file, NULL::BIGINT AS line,
    concat_ws('|', security_grade, total_vulnerabilities, attack_chains) AS fields FROM fingerprint
  UNION ALL SELECT repo, 'security_grade', NULL, NULL, concat_ws('|', security_grade, grade_label) FROM fingerprint
  UNION ALL SELECT repo, 'attack_chains', file, line, concat_ws('|', attack_type, source, sink) FROM chains
  UNION ALL SELECT repo, 'prioritized_findings', file, line, concat_ws('|', issue, severity, priority, priority_score) FROM prioritized
  UNION ALL SELECT repo, 'stats', NULL, NULL, concat_ws('|', count(*), sum(total_lines), sum(comments), sum(classes))
    FROM file_stats JOIN sizes USING (repo, file) GROUP BY repo""", **AT_LINE, part=S, fields=S))
def json_extract(spark, sf_dir):
    """Every record, parsed again: nothing is capped."""
    return _parsed_records(export.json_extract(corpus_scan(spark, sf_dir, "facts", "profile", "counts")))


def _parsed_records(records):
    """Each record is parsed once, for the fields of all parts."""
    names = sorted({"file", "line"}.union(*_EXTRACTED.values()))
    parsed = records.select("repo", "part", F.json_tuple("record", *names).alias(*[f"_{n}" for n in names]))
    fields = None
    for part, wanted in _EXTRACTED.items():
        value = F.concat_ws("|", *[f"_{n}" for n in wanted])
        fields = F.when(F.col("part") == part, value) if fields is None else fields.when(F.col("part") == part, value)
    return parsed.select("repo", "part", F.col("_file").alias("file"), F.col("_line").cast("bigint").alias("line"), fields.alias("fields"))


@register("json_objects", ORACLE["json_extract"])
def json_objects(spark, sf_dir):
    """One object of any length for each repository, written in many files and read again line by line."""
    folder = claim(spark, "json-objects")
    export.write_json_objects(corpus_scan(spark, sf_dir, "facts", "profile", "counts"), folder)
    lines = spark.read.schema("value string, repo string").text(folder).filter(~F.col("value").startswith('{"repo":'))
    single = F.regexp_extract("value", r'^,"(\w+)":\{', 1)
    record = F.regexp_replace("value", r'^,("\w+":)?', "")
    part = F.when(single != "", single).when(F.col("value").contains('"attack_type":'), "attack_chains").otherwise("prioritized_findings")
    records = lines.filter((single != "") | F.col("value").rlike(r"^,?\{")).select("repo", part.alias("part"), record.alias("record"))
    try:
        return durable(_parsed_records(records), "json-objects-read")
    finally:
        remove(spark, [folder])


# --- texts ----------------------------------------------------------------------

def _sentence(key: str, column: str, least: int = 1) -> str:
    before, found, after = prose.NARRATIVE[key].partition("%d")
    body = corpus.sql_text(before) + (f" || {column} || {corpus.sql_text(after)}" if found else "")
    return f"CASE WHEN {column} >= {least} THEN {body} END"


_told = ", ".join([
    _sentence("rce", "rce_chains"), _sentence("command", "command_chains"), _sentence("sql", "sql_chains"),
    _sentence("deserialization", "deserialization_chains"), _sentence("upload", "upload_chains"),
    _sentence("secrets", "secrets"), _sentence("inputs", "exposed_inputs", 5), _sentence("dangerous", "dangerous", 3),
    _sentence("ml", "high_risk_files")])


@register("narrative", sql.query([*REPO, f"""
  told AS (SELECT repo, [x FOR x IN [{_told}] IF x IS NOT NULL] AS said FROM graded),
  kept AS (SELECT repo, CASE WHEN len(said) > 0 THEN said ELSE [{corpus.sql_text(prose.NARRATIVE['clear'])}] END AS said FROM told)"""],
    "SELECT repo, unnest(said) AS message, generate_subscripts(said, 1) - 1 AS seq FROM kept", repo=S, seq=B, message=S))
def repo_narrative(spark, sf_dir):
    return corpus_scan(spark, sf_dir).narrative


def _log_rows() -> str:
    rows = [
        ("true", "'INFO'", "'Scan started.'"), ("true", "'INFO'", "total_files || ' source files in scope.'"),
        ("true", "'INFO'", "format('{:,}', total_lines::BIGINT) || ' lines in scope.'"),
        ("true", "'INFO'", "'Reading files.'"), ("true", "'INFO'", "'Mapping entry points.'"),
        ("true", "'INFO'", "exposed_inputs || ' inputs mapped.'"),
        ("findings > 0", "'WARNING'", "findings || ' findings in ' || total_files || ' files.'"),
        ("high > 0", "'CRITICAL'", "high || ' findings of high severity.'"),
        ("secrets > 0", "'WARNING'", "secrets || ' credentials in the source.'"),
        ("dangerous > 0", "'WARNING'", "dangerous || ' dangerous calls.'"),
        ("findings = 0", "'SUCCESS'", "'No findings.'"),
        ("true", "'INFO'", "'Linking inputs and dangerous calls.'"),
        ("chains > 0", "'CRITICAL'", "chains || ' paths from input to a dangerous call.'"),
        ("rce_chains > 0", "'CRITICAL'", "rce_chains || ' paths to code execution.'"),
        ("command_chains > 0", "'CRITICAL'", "command_chains || ' paths to a command.'"),
        ("sql_chains > 0", "'WARNING'", "sql_chains || ' paths into a query.'"),
        ("chains = 0", "'SUCCESS'", "'No path from input to a dangerous call.'"),
        ("true", "'INFO'", "'Classifying files.'"),
        ("high_risk_files > 0", "'WARNING'", "high_risk_files || ' files classified as High Risk.'"),
        ("high_risk_files = 0", "'SUCCESS'", "'No file classified as High Risk.'"),
        ("true", "'INFO'", "'Grading.'"),
        ("true", "CASE WHEN grade IN ('A', 'B') THEN 'SUCCESS' WHEN grade = 'C' THEN 'WARNING' ELSE 'CRITICAL' END",
         "'Grade ' || grade || ' (' || grade_label || ').'"),
        ("true", "'INFO'", "'Report complete.'"), ("true", "'INFO'", "'Scan finished.'"),
    ]
    return " UNION ALL ".join(f"SELECT repo, {i} AS step, {level} AS level, {message} AS message FROM rated WHERE {when}"
                              for i, (when, level, message) in enumerate(rows))


@register("scan_log", sql.query([*REPO, GRADES, "rated AS (SELECT * FROM graded JOIN grades USING (grade))"],
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY step) - 1 AS seq, level, message FROM ({_log_rows()})",
    repo=S, seq=B, level=S, message=S))
def scan_log(spark, sf_dir):
    return corpus_scan(spark, sf_dir).scan_log


_tell = {k: corpus.sql_text(v) for k, v in prose.ML_INDICATORS.items()}


def _numbered(template: str, column: str) -> str:
    before, _, after = template.partition("%d")
    return f"{corpus.sql_text(before)} || {column} || {corpus.sql_text(after)}"


def _summary(label: str) -> str:
    before, _, after = prose.ML_SUMMARIES[label].replace("%%", "%").partition("%s")
    return f"{corpus.sql_text(before)} || CAST(confidence AS BIGINT) || {corpus.sql_text(after)}"


@register("ml_explanation", sql.query([*FINDINGS, sql.SQL_CHAINS], f"""
  SELECT r.repo, r.file, ml_prediction AS prediction, CAST(confidence AS BIGINT) AS confidence_pct,
    CASE WHEN len(said) > 0 THEN array_to_string(said, ' | ') ELSE {_tell['fallback']} END AS key_indicators,
    CASE ml_prediction WHEN 'High Risk' THEN {_summary('High Risk')} ELSE {_summary('Medium Risk')} END AS risk_summary
  FROM risks r JOIN (
    SELECT c.repo, c.file, [x FOR x IN [
      CASE WHEN runs > 0 THEN {_tell['execution']} END, CASE WHEN sqls > 0 THEN {_tell['sql']} END,
      CASE WHEN secrets > 0 THEN {_tell['secret']} END, CASE WHEN loads > 0 THEN {_tell['deserialization']} END,
      CASE WHEN n > 0 THEN {_numbered(prose.ML_INDICATORS['chains'], 'n')} END,
      CASE WHEN high >= 3 THEN {_numbered(prose.ML_INDICATORS['density'], 'high')} END] IF x IS NOT NULL] AS said
    FROM contents c LEFT JOIN (
      SELECT repo, file, count(*) FILTER (regexp_matches(lower(issue), 'eval|exec|os\\.system|subprocess')) AS runs,
        count(*) FILTER (contains(issue, 'SQL')) AS sqls, count(*) FILTER (starts_with(issue, 'Hardcoded')) AS secrets,
        count(*) FILTER (regexp_matches(lower(issue), 'pickle|yaml')) AS loads, count(*) FILTER (severity = 'High') AS high
      FROM findings GROUP BY ALL) USING (repo, file)
    LEFT JOIN (SELECT repo, file, count(*) AS n FROM chains GROUP BY ALL) USING (repo, file)) i
  ON i.repo = r.repo AND i.file = r.file WHERE ml_prediction <> 'Safe'""",
    **AT, prediction=S, confidence_pct=B, key_indicators=S, risk_summary=S))
def ml_explanation(spark, sf_dir):
    return corpus_scan(spark, sf_dir).ml_explanations.withColumn("key_indicators", F.array_join("key_indicators", " | "))


# --- advice -----------------------------------------------------------------------

_explain_rows = [(k, *v) for k, v in prose.EXPLANATIONS.items()]
_recommend_rows = [(k, *v[:4], "\n".join(v[4])) for k, v in prose.RECOMMENDATIONS.items()]
ADVICE = f"""
explanations AS (SELECT * FROM {corpus.sql_values(_explain_rows, 'x(issue, ' + ', '.join(advice.EXPLANATION_FIELDS) + ')')}),
recommendations AS (SELECT * FROM {corpus.sql_values(_recommend_rows, 'y(issue, ' + ', '.join(advice.RECOMMENDATION_FIELDS) + ', steps)')})
"""
_explained = ", ".join(f"coalesce(x.{f}, {corpus.sql_text(g)}) AS {f}"
                       for f, g in zip(advice.EXPLANATION_FIELDS, prose.EXPLANATION_FALLBACK))
_general = prose.RECOMMENDATION_FALLBACK
_recommended = (f"coalesce(y.title, {corpus.sql_text(_general[0])} || i.issue) AS title, " + ", ".join(
    f"coalesce(y.{f}, {corpus.sql_text(g)}) AS {f}" for f, g in zip(advice.RECOMMENDATION_FIELDS[1:], _general[1:4]))
    + f", coalesce(y.steps, {corpus.sql_text(chr(10).join(_general[4]))}) AS steps")
_EXPLAIN = {f: S for f in advice.EXPLANATION_FIELDS}
_RECOMMEND = {**{f: S for f in advice.RECOMMENDATION_FIELDS}, "steps": S}


@register("explanations", sql.query([*FINDINGS, ADVICE], f"""
  SELECT repo, file, line, i.issue, {_explained} FROM findings i LEFT JOIN explanations x USING (issue)""",
    **AT_LINE, issue=S, **_EXPLAIN))
def explanations(spark, sf_dir):
    return advice.explain(findings(spark, sf_dir).select("repo", "file", "line", "issue"))


@register("recommendations", sql.query([*FINDINGS, ADVICE], f"""
  SELECT repo, file, line, i.issue, {_recommended} FROM findings i LEFT JOIN recommendations y USING (issue)""",
    **AT_LINE, issue=S, **_RECOMMEND))
def recommendations(spark, sf_dir):
    return advice.recommend(findings(spark, sf_dir).select("repo", "file", "line", "issue")) \
        .withColumn("steps", F.array_join("steps", "\n"))


@register("issue_advice", sql.query([*FINDINGS, ADVICE], f"""
  SELECT repo, i.issue, {_explained}, {_recommended} FROM (SELECT DISTINCT repo, issue FROM findings) i
    LEFT JOIN explanations x USING (issue) LEFT JOIN recommendations y USING (issue)""", repo=S, issue=S, **_EXPLAIN, **_RECOMMEND))
def issue_advice(spark, sf_dir):
    return advice.issue_advice(findings(spark, sf_dir)).withColumn("steps", F.array_join("steps", "\n"))


@register("advice_coverage", sql.query([*FINDINGS, ADVICE], """
  SELECT issue, count(*) AS findings, issue IN (SELECT issue FROM explanations) AS explained,
    issue IN (SELECT issue FROM recommendations) AS recommended FROM findings GROUP BY issue""",
    issue=S, findings=B, explained=L, recommended=L))
def advice_coverage(spark, sf_dir):
    return advice.advice_coverage(findings(spark, sf_dir))


# --- fixes --------------------------------------------------------------------------

_fix = {k: corpus.sql_text(v) for k, v in prose.FIX_TEXT.items()}
_space = f"[{corpus.RE2_SPACE}]"
_word = f"[{sql.WORD}]"
_assign = corpus.sql_text(f"^({_space}*)((?:const|let|var){_space}+)?({_word}+){_space}*={_space}*['\"][^'\"]+['\"]([^\\n]*)")
_group = lambda i: f"regexp_extract(raw, {_assign}, {i})"


def _format_sql(key: str, value: str) -> str:
    before, _, after = prose.FIX_TEXT[key].partition("%s")
    return f"{corpus.sql_text(before)} || {value} || {corpus.sql_text(after)}"


_secret = sql.in_list("issue", R.SECRET_ISSUES) + f" AND regexp_matches(raw, {_assign})"
_env = f"upper({_group(3)})"
_query_text = "(contains(raw, 'f\"') OR contains(raw, 'f''') OR contains(raw, '.format(') OR contains(raw, '+'))"
_rules = [
    ("issue = 'SSL Verification Disabled' AND contains(raw, 'verify')",
     f"regexp_replace(raw, 'verify{_space}*={_space}*False', 'verify=True', 'gi')", _fix["ssl"]),
    ("issue = 'Weak Hashing (MD5)' AND contains(raw, 'hashlib.md5')", "replace(raw, 'hashlib.md5(', 'hashlib.sha256(')", _fix["md5"]),
    ("issue = 'Weak Hashing (SHA1)' AND contains(raw, 'hashlib.sha1')", "replace(raw, 'hashlib.sha1(', 'hashlib.sha256(')", _fix["sha1"]),
    ("issue = 'Debug Mode Enabled'", f"regexp_replace(raw, 'debug{_space}*={_space}*True', 'debug=False', 'gi')", _fix["debug"]),
    ("issue = 'Insecure Deserialization (yaml)' AND contains(raw, 'yaml.load(')",
     f"regexp_replace(replace(raw, 'yaml.load(', 'yaml.safe_load('), ',{_space}*Loader{_space}*={_space}*{_word}+(\\.{_word}+)*', '', 'g')",
     _fix["yaml"]),
    ("issue = 'Insecure Deserialization (pickle)' AND contains(raw, 'pickle.loads(')", "replace(raw, 'pickle.loads(', 'json.loads(')",
     _fix["pickle"]),
    ("issue = 'Dangerous Execution (eval)' AND contains(raw, 'eval(')", "replace(raw, 'eval(', 'ast.literal_eval(')", _fix["eval"]),
    ("issue = 'Dangerous Execution (exec)' AND contains(raw, 'exec(')",
     f"indent || {_fix['exec_note']} || chr(10) || indent || '# ' || stripped", _fix["exec"]),
    ("issue = 'System Command Execution (os.system)' AND contains(raw, 'os.system(')",
     "replace(replace(raw, 'os.system(', 'subprocess.run('), ')', ', shell=False)')", _fix["os"]),
    ("issue = 'Subprocess Execution' AND contains(raw, 'shell=True')", "replace(raw, 'shell=True', 'shell=False')", _fix["subprocess"]),
    (f"{_secret} AND {_group(2)} = ''", f"{_group(1)} || {_group(3)} || ' = os.getenv(''' || {_env} || ''')' || {_group(4)}",
     _format_sql("env_python", _env)),
    (_secret, f"{_group(1)} || {_group(2)} || {_group(3)} || ' = process.env.' || {_env} || {_group(4)}", _format_sql("env_js", _env)),
    ("issue = 'Insecure Random (random module)' AND contains(raw, 'random.randint(')",
     "replace(raw, 'random.randint(', 'secrets.randbelow(')", _fix["random"]),
    (f"contains(issue, 'SQL Injection') AND {_query_text}",
     f"indent || {_fix['sql_note']} || chr(10) || indent || {_fix['sql_original']} || stripped", _fix["sql"]),
]
SQL_FIXES = f"""fixes AS (
  SELECT repo, file, line, issue, raw AS vulnerable_line,
    CASE {' '.join(f'WHEN {w} THEN {f}' for w, f, _ in _rules)} ELSE indent || {_fix['default_note']} || chr(10) || raw END AS fixed_line,
    CASE {' '.join(f'WHEN {w} THEN {e}' for w, _, e in _rules)} ELSE {_fix['default']} END AS explanation
  FROM (SELECT *, regexp_extract(raw, '^{_space}*') AS indent,
          regexp_replace(regexp_replace(raw, '^{_space}+', ''), '{_space}+$', '') AS stripped FROM findings))"""


def _fixes(files: DataFrame) -> DataFrame:
    carried = ("raw",)
    return patching.line_fixes(hits.findings(hits.line_facts(line_ops.lines(files), carry=carried), carry=carried))


@register("line_fix", sql.query([*FINDINGS, SQL_FIXES], "SELECT * FROM fixes",
                                **AT_LINE, issue=S, vulnerable_line=S, fixed_line=S, explanation=S))
def line_fix(spark, sf_dir):
    return _fixes(corpus.files(spark, sf_dir))


@register("patched_files", sql.query([*FINDINGS, SQL_FIXES], """
  SELECT repo, file, count(fixed_line) AS fixed_lines,
    string_agg(coalesce(fixed_line, raw), chr(10) ORDER BY line) || CASE WHEN ends_with(any_value(content), chr(10)) THEN chr(10) ELSE '' END
      AS patched_content
  FROM lines LEFT JOIN fixes USING (repo, file, line) JOIN contents USING (repo, file)
  GROUP BY repo, file HAVING count(fixed_line) > 0""", **AT, fixed_lines=B, patched_content=S))
def patched_files(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return patching.patched_files(files)
