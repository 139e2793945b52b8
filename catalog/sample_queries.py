"""Labelled samples, features and the classifier over the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog import corpus, sql
from catalog.scan_queries import ORACLE, B, D, L, S, corpus_lines, register
from riskloom.functions import text
from riskloom.functions.durable import durable, remove, shared_folder
from riskloom.operators import features, hits, labels, samples
from riskloom.plans import train
from riskloom.sinks import export
from riskloom.sources import samples as readers

# Raw labels as third parties write them: every branch and trap of the rules.
RAW_LABELS = (
    "SQL Injection", "cwe-798", "not vulnerable", "insecure random", "source", "0", "1", "1.0", "true", "",
    "unknown", " Critical ", "XSS", "patched", "fixed", "weak crypto", "CWE-89", "csrf", "benign", "False",
    "hardcoded credential", "Debug", "open redirect", "remote", "2", "-1", "yes", "no", "safe", "vulnerable", "Clean",
)
RAW_LANGUAGES = ("python", "Java", "c++", "cobol", "", " Go ", "perl")
assert len(RAW_LABELS) == 31 and len(RAW_LANGUAGES) == 7


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def raw_samples(spark, sf_dir) -> DataFrame:
    """``(row_id, source, code, raw_label, language)``: one sample per corpus line."""
    doc = F.regexp_extract("file", r"f(\d+)", 1).cast("bigint")
    rows = corpus_lines(spark, sf_dir).withColumn("doc_id", doc)
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("line")).alias("row_id"), F.col("repo").alias("source"), F.col("raw").alias("code"),
        _pick(RAW_LABELS, F.col("doc_id") * 5 + F.col("line")).alias("raw_label"),
        _pick(RAW_LANGUAGES, F.col("doc_id") + F.col("line")).alias("language"), "doc_id", "line")


_labels = corpus.sql_values(list(enumerate(RAW_LABELS)), "a(label_id, raw_label)")
_languages = corpus.sql_values(list(enumerate(RAW_LANGUAGES)), "b(language_id, language)")
SQL_SAMPLES = f"""raw_samples AS (
  SELECT doc_id * 100000 + line AS row_id, repo AS source, raw AS code, raw_label, language, doc_id, line
  FROM lines JOIN {_labels} ON label_id = (doc_id * 5 + line) % {len(RAW_LABELS)}
    JOIN {_languages} ON language_id = (doc_id + line) % {len(RAW_LANGUAGES)})"""
SAMPLES = [corpus.SQL_LINES, SQL_SAMPLES]


def _strip(column: str) -> str:
    return (f"regexp_replace(regexp_replace({column}, '^[{corpus.RE2_SPACE}]+', ''), '[{corpus.RE2_SPACE}]+$', '')")


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {corpus.sql_text(w)})" for w in words) + ")"


KEY = f"lower({_strip('raw_label')})"
FROM_NAME = (f"CASE WHEN {_any(KEY, labels.NAMED_HIGH)} THEN 'High Risk' WHEN {_any(KEY, labels.NAMED_SAFE)} THEN 'Safe' "
             f"WHEN {_any(KEY, labels.NAMED_MEDIUM)} THEN 'Medium Risk' END")
FROM_CWE = (f"CASE WHEN {_any(KEY, labels.CWE_HIGH)} THEN 'High Risk' WHEN {sql.in_list(KEY, (*labels.CWE_SAFE, '0', 'false'))} "
            f"THEN 'Safe' WHEN {_any(KEY, labels.CWE_MEDIUM)} THEN 'Medium Risk' "
            f"WHEN {KEY} IN ('1', 'true', 'vulnerable') THEN 'High Risk' END")
FROM_TYPE = (f"CASE WHEN {_any(KEY, labels.TYPE_HIGH)} THEN 'High Risk' WHEN {_any(KEY, labels.TYPE_MEDIUM)} THEN 'Medium Risk' "
             "ELSE 'High Risk' END")
FROM_FLAG = (f"CASE WHEN regexp_matches({KEY}, '^[+-]?[0-9]+$') THEN CASE WHEN CAST({KEY} AS BIGINT) = 1 THEN 'High Risk' ELSE 'Safe' END "
             f"WHEN {KEY} IN ('true', 'yes', 'vulnerable') THEN 'High Risk' "
             f"WHEN {KEY} IN ('false', 'no', 'safe', 'clean') THEN 'Safe' END")
FROM_EITHER = f"CASE WHEN raw_label IN ('0', '1') THEN {FROM_FLAG} ELSE {FROM_NAME} END"
FROM_TYPE_OR_FLAG = (f"CASE WHEN {sql.in_list(_strip('raw_label'), labels.VULNERABLE_WORDS)} THEN 'High Risk' "
                     f"WHEN {sql.in_list(_strip('raw_label'), labels.SAFE_WORDS)} THEN 'Safe' ELSE {FROM_TYPE} END")
_LABELLED = {"row_id": B, "raw_label": S, "label": S}


def _label_query(name: str, rule, statement: str) -> None:
    @register(name, sql.query(SAMPLES, f"SELECT row_id, raw_label, {statement} AS label FROM raw_samples", **_LABELLED))
    def build(spark, sf_dir):
        return raw_samples(spark, sf_dir).select("row_id", "raw_label", rule(F.col("raw_label")).alias("label"))


_label_query("label_norm_a", labels.from_name, FROM_NAME)
_label_query("label_norm_b", labels.from_cwe, FROM_CWE)
_label_query("label_norm_c", labels.from_type, FROM_TYPE)
_label_query("label_binary", labels.from_flag, FROM_FLAG)
_label_query("label_dispatch", labels.from_name_or_flag, FROM_EITHER)
_label_query("label_fallback", lambda c: labels.or_high(labels.from_name(c)), f"coalesce({FROM_NAME}, 'High Risk')")


def _clean_sql(column: str) -> str:
    value = _strip(f"replace({column}, '\\n', chr(10))")
    return (f"CASE WHEN {_strip(column)} NOT IN ('', 'nan', 'None') AND length({value}) >= 5 THEN {value} END")


def _plain_sql(column: str) -> str:
    return f"CASE WHEN {_strip(column)} <> 'nan' AND length({_strip(column)}) >= 5 THEN {_strip(column)} END"


CODES = """codes AS (SELECT 'line' AS kind, row_id, code || '\\n' || code AS code FROM raw_samples
  UNION ALL SELECT 'short', row_id, code FROM raw_samples
  UNION ALL SELECT 'document', doc_id, text FROM documents)"""


@register("clean_code", sql.query([*SAMPLES, CODES], f"""
  SELECT kind, row_id, {_clean_sql('code')} AS cleaned, {_plain_sql('code')} AS plain FROM codes""",
    kind=S, row_id=B, cleaned=S, plain=S))
def clean_code(spark, sf_dir):
    rows = raw_samples(spark, sf_dir)
    docs = corpus.table(spark, sf_dir, "documents")
    codes = (
        rows.select(F.lit("line").alias("kind"), "row_id", F.concat("code", F.lit("\\n"), "code").alias("code"))
        .unionByName(rows.select(F.lit("short").alias("kind"), "row_id", "code"))
        .unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("row_id"), F.col("text").alias("code"))))
    return codes.select("kind", "row_id", labels.clean_code(F.col("code")).alias("cleaned"),
                        labels.plain_code(F.col("code")).alias("plain"))


_language_key = f"lower({_strip('language')})"


@register("lang_allow", sql.query(SAMPLES, f"""
  SELECT row_id, language FROM raw_samples WHERE {_language_key} = '' OR {sql.in_list(_language_key, labels.SAMPLE_LANGUAGES)}""",
    row_id=B, language=S))
def lang_allow(spark, sf_dir):
    return raw_samples(spark, sf_dir).filter(labels.allowed_language(F.col("language"))).select("row_id", "language")


@register("training_clean", sql.query(SAMPLES, f"""
  SELECT row_id, {_strip('code')} AS code, {_strip('raw_label')} AS label FROM raw_samples
  WHERE {_strip('code')} <> '' AND {_strip('raw_label')} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_strip('code')} ORDER BY row_id) = 1""", row_id=B, code=S, label=S))
def training_clean(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("row_id", "code", F.col("raw_label").alias("label"))
    return train.clean_training(rows, ["row_id"])


@register("row_limit", sql.query(SAMPLES, "SELECT row_id, code FROM raw_samples ORDER BY row_id LIMIT 5000", row_id=B, code=S))
def row_limit(spark, sf_dir):
    return samples.first_rows(raw_samples(spark, sf_dir).select("row_id", "code"), [F.col("row_id")], 5000)


def _records(spark, sf_dir) -> DataFrame:
    """Records whose code sits in one of several alternative fields."""
    kind = F.col("line") % 3
    code = F.col("code")
    return raw_samples(spark, sf_dir).select(
        F.when(kind == 0, code).otherwise("").alias("code"), F.when(kind <= 1, F.concat(code, F.lit(" //i"))).alias("Insecure_code"),
        F.concat(code, F.lit(" //v")).alias("vulnerable_code"), F.col("raw_label").alias("CWE"), F.when(kind == 1, F.reverse(code)).alias("safe_code"))


_chosen = _strip("coalesce(nullif(CASE WHEN line % 3 = 0 THEN code ELSE '' END, ''), nullif(CASE WHEN line % 3 <= 1 THEN code || ' //i' END, ''), code || ' //v')")


@register("field_fallback", sql.query(SAMPLES, f"""
  SELECT {_chosen} AS code, coalesce({FROM_CWE}, 'High Risk') AS label FROM raw_samples WHERE length({_chosen}) >= 5
  UNION ALL SELECT {_strip('reverse(code)')}, 'Safe' FROM raw_samples WHERE line % 3 = 1 AND length({_strip('reverse(code)')}) >= 5""",
    code=S, label=S))
def field_fallback(spark, sf_dir):
    return readers.weakness_records(_records(spark, sf_dir))


@register("fix_pairs", sql.query([*SAMPLES, f"""pairs AS (
  SELECT {_clean_sql('code')} AS vulnerable, {_clean_sql("replace(code, '(', '[')")} AS fixed, {FROM_TYPE} AS label
  FROM raw_samples WHERE {_language_key} = '' OR {sql.in_list(_language_key, labels.SAMPLE_LANGUAGES)})"""], """
  SELECT vulnerable AS code, label FROM pairs WHERE vulnerable IS NOT NULL
  UNION ALL SELECT fixed, 'Safe' FROM pairs WHERE fixed IS NOT NULL AND fixed IS DISTINCT FROM vulnerable""", code=S, label=S))
def fix_pairs(spark, sf_dir):
    return readers.cve_fix_pairs(raw_samples(spark, sf_dir).select(
        F.col("raw_label").alias("vuln_type"), "language", F.col("code").alias("vulnerable_code"),
        F.replace("code", F.lit("("), F.lit("[")).alias("patched_code")))


@register("named_fix_pairs", sql.query([*SAMPLES, f"""pairs AS (
  SELECT {_plain_sql('code')} AS vulnerable, {_plain_sql("replace(code, '(', '[')")} AS fixed,
    coalesce({FROM_NAME}, 'High Risk') AS label FROM raw_samples)"""], """
  SELECT vulnerable AS code, label FROM pairs WHERE vulnerable IS NOT NULL
  UNION ALL SELECT fixed, 'Safe' FROM pairs WHERE fixed IS NOT NULL""", code=S, label=S))
def named_fix_pairs(spark, sf_dir):
    return readers.fix_pairs(raw_samples(spark, sf_dir).select(
        F.col("raw_label").alias("vulnerability_type"), F.col("code").alias("vulnerable_code"),
        F.replace("code", F.lit("("), F.lit("[")).alias("fixed_code")))


@register("unlabelled", sql.query(SAMPLES, f"""
  SELECT 'typed' AS reader, {_plain_sql('code')} AS code, 'High Risk' AS label FROM raw_samples WHERE {_plain_sql('code')} IS NOT NULL
  UNION ALL SELECT 'flagged', {_clean_sql('code')}, 'High Risk' FROM raw_samples WHERE {_clean_sql('code')} IS NOT NULL""",
    reader=S, code=S, label=S))
def unlabelled(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("code")
    return (
        readers.typed_samples(rows).withColumn("reader", F.lit("typed"))
        .unionByName(readers.flagged_samples(rows).withColumn("reader", F.lit("flagged")))
        .unionByName(readers.discovered_samples(rows).withColumn("reader", F.lit("discovered"))))


@register("discovered_samples", sql.query(SAMPLES, f"""
  SELECT 'either' AS reader, {_plain_sql('code')} AS code, {FROM_EITHER} AS label FROM raw_samples
    WHERE {_plain_sql('code')} IS NOT NULL AND {FROM_EITHER} IS NOT NULL
  UNION ALL SELECT 'flagged', {_clean_sql('code')}, {FROM_TYPE_OR_FLAG} FROM raw_samples WHERE {_clean_sql('code')} IS NOT NULL""",
    reader=S, code=S, label=S))
def discovered_samples(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("row_id", F.col("code").alias("snippet"), F.col("raw_label").alias("target"))
    return readers.discovered_samples(rows).withColumn("reader", F.lit("either")).unionByName(
        readers.flagged_samples(rows).withColumn("reader", F.lit("flagged")))


# --- files written and read back ----------------------------------------------------

def _read_back(spark, name: str, write, read) -> DataFrame:
    """What ``read`` finds in the folder that ``write`` filled; the folder is deleted, the rows are kept as a table."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(folder)
    try:
        return durable(read(folder), name)
    finally:
        remove(spark, [folder])


@register("training_csv", sql.query(SAMPLES, f"""
  SELECT {_strip('code')} AS code, {_strip('raw_label')} AS label FROM raw_samples WHERE {_strip('code')} <> '' AND {_strip('raw_label')} <> ''""",
    code=S, label=S))
def training_csv(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("code", F.col("raw_label").alias("label"))
    return _read_back(spark, "training-csv", lambda to: export.write_training_csv(rows, to), lambda at: readers.read_training_csv(spark, at))


@register("csv_directory", sql.query(SAMPLES, f"""
  SELECT CAST(row_id AS VARCHAR) AS id, {_strip('code')} AS snippet, {_strip('raw_label')} AS target FROM raw_samples
  WHERE {_strip('code')} <> '' AND {_strip('raw_label')} <> ''""", id=S, snippet=S, target=S))
def csv_directory(spark, sf_dir):
    """Files with three headers in one folder, two columns selected besides the id."""
    rows = raw_samples(spark, sf_dir).select(
        F.col("row_id").alias("id"), F.trim("language").alias("other"), text.strip(F.col("code")).alias("snippet"), text.strip(F.col("raw_label")).alias("target"))
    rows = rows.filter("snippet <> '' AND target <> ''")

    def write(to):
        for part, columns in enumerate((("id", "snippet", "target"), ("target", "other", "snippet", "id"), ("snippet", "id", "target", "other"))):
            rows.filter(F.col("id") % 3 == part).select(*columns).write.mode("append").csv(to, header=True, quoteAll=True, escape='"')

    return _read_back(spark, "csv-directory", write, lambda at: readers.read_csv(spark, at, ("id", "snippet", "target")).drop("origin"))


_CSV_TEXT = "text || chr(10) || '\"' || source || '\", ' || chr(13) || chr(10) || '\"\"' || doc_id"


@register("csv_ranges", sql.query(["docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"], f"""
  SELECT CAST(doc_id AS VARCHAR) AS id, {_CSV_TEXT} AS snippet, source AS target FROM docs""", id=S, snippet=S, target=S))
def csv_ranges(spark, sf_dir):
    """Whole documents with line breaks and quotes as values, read in ranges of 16 KiB: records, quotes and headers of two lines lie over their borders."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    broken = F.concat("text", F.lit("\n\""), "source", F.lit('", \r\n""'), F.col("doc_id").cast("string"))
    rows = docs.select(F.col("doc_id").alias("id"), broken.alias("snippet\nof \"code\""), F.col("source").alias("target"))

    def read(at):
        return readers.read_csv(spark, at, range_bytes=1 << 14).select("id", F.col("snippet\nof \"code\"").alias("snippet"), "target")

    return _read_back(spark, "csv-ranges", lambda to: rows.write.csv(to, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False), read)


@register("json_files", sql.query(SAMPLES, "SELECT CAST(row_id AS VARCHAR) AS id, code AS snippet, raw_label AS target FROM raw_samples", id=S, snippet=S, target=S))
def json_files(spark, sf_dir):
    """A file for every 64 documents: an array of objects."""
    record = F.to_json(F.struct(F.col("raw_label").alias("target"), F.col("code").alias("snippet"), F.col("row_id").alias("id")))
    arrays = raw_samples(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 64)).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    return _read_back(spark, "json-files", lambda to: arrays.select("value").write.option("maxRecordsPerFile", 1).text(to),
                      lambda at: readers.read_json(spark, at, "*.txt").select("id", "snippet", "target"))


# --- deduplication and sampling -------------------------------------------------

def _documents(spark, sf_dir) -> DataFrame:
    """``(row_id, code, label)``: documents, labelled from the labels table where it covers them."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = corpus.table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "High Risk").when(F.col("quality") == 0, "Medium Risk") \
        .when(F.col("quality") == 1, "Safe").otherwise("none")
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("code"), label.alias("label"))


SQL_DOCS = """docs AS (
  SELECT d.doc_id AS row_id, text AS code, CASE WHEN toxic = 1 THEN 'High Risk' WHEN quality = 0 THEN 'Medium Risk'
    WHEN quality = 1 THEN 'Safe' ELSE 'none' END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _dedupe_query(name: str, width: int | None) -> None:
    key = _strip("code") if width is None else f"left({_strip('code')}, {width})"

    @register(name, sql.query([SQL_DOCS], f"""
      SELECT row_id, code, label FROM docs WHERE {_strip('code')} <> ''
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY row_id) = 1""", row_id=B, code=S, label=S))
    def build(spark, sf_dir):
        return samples.keep_first(_documents(spark, sf_dir), ["row_id"], width)


_dedupe_query("dedupe_exact", None)
_dedupe_query("dedupe_prefix500", 500)
_dedupe_query("dedupe_prefix400", 400)


@register("merge_sources", sql.query([SQL_DOCS], f"""
  SELECT source_rank, row_id, code, label FROM (
    SELECT 0 AS source_rank, * FROM docs WHERE label <> 'none' UNION ALL SELECT 1, row_id, code, 'Safe' FROM docs)
  WHERE {_strip('code')} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_strip('code')} ORDER BY source_rank, row_id) = 1""",
    source_rank=B, row_id=B, code=S, label=S))
def merge_sources(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    merged = samples.merge(docs.filter("label <> 'none'"), docs.withColumn("label", F.lit("Safe")))
    return samples.keep_first(merged, ["source_rank", "row_id"])


@register("augment_anti", sql.query([SQL_DOCS], f"""
  SELECT row_id, code, label FROM docs WHERE label <> 'none'
  UNION ALL
  (SELECT row_id, code, 'Safe' FROM docs
   WHERE {_strip('code')} NOT IN (SELECT {_strip('code')} FROM docs WHERE label <> 'none')
   QUALIFY row_number() OVER (PARTITION BY {_strip('code')} ORDER BY row_id) = 1)""", row_id=B, code=S, label=S))
def augment_anti(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return samples.augment(docs.filter("label <> 'none'"), docs.withColumn("label", F.lit("Safe")), ["row_id"])


@register("source_cap", sql.query(SAMPLES, """
  SELECT source, row_id FROM raw_samples QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_id) <= 800""", source=S, row_id=B))
def source_cap(spark, sf_dir):
    return samples.cap_per_source(raw_samples(spark, sf_dir).select("source", "row_id"), "source", [F.col("row_id")], 800)


@register("stratified_sample", sql.query(SAMPLES, """
  SELECT raw_label, row_id FROM raw_samples
  QUALIFY row_number() OVER (PARTITION BY raw_label ORDER BY md5(CAST(row_id AS VARCHAR))) <= 80""", raw_label=S, row_id=B))
def stratified_sample(spark, sf_dir):
    return samples.stratified_sample(raw_samples(spark, sf_dir).select("raw_label", "row_id"), "raw_label", F.col("row_id"), 80)


_NORMED = f"normed AS (SELECT row_id, doc_id, line, code, coalesce({FROM_CWE}, 'none') AS label FROM raw_samples)"


def _normed(spark, sf_dir) -> DataFrame:
    return raw_samples(spark, sf_dir).withColumn("label", F.coalesce(labels.from_cwe(F.col("raw_label")), F.lit("none")))


@register("stratified_split", sql.query([*SAMPLES, _NORMED], """
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR)))
    <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM normed""", row_id=B, label=S, is_test=L))
def stratified_split(spark, sf_dir):
    return samples.stratified_split(_normed(spark, sf_dir).select("row_id", "label"), F.col("row_id"))


@register("folds", sql.query([*SAMPLES, _NORMED], """
  SELECT label, fold, count(*) AS samples, min(row_id) AS first_row, max(row_id) AS last_row FROM (
    SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR))) - 1) % 5 AS fold FROM normed)
  GROUP BY label, fold""", label=S, fold=B, samples=B, first_row=B, last_row=B))
def folds(spark, sf_dir):
    return samples.stratified_folds(_normed(spark, sf_dir).select("row_id", "label"), F.col("row_id")) \
        .groupBy("label", "fold").agg(F.count(F.lit(1)).alias("samples"), F.min("row_id").alias("first_row"),
                                      F.max("row_id").alias("last_row"))


@register("label_distribution", sql.query([*SAMPLES, _NORMED], """
  SELECT label, count(*) AS samples, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM normed GROUP BY label""",
    label=S, samples=B, percent=D))
def label_distribution(spark, sf_dir):
    return samples.label_distribution(_normed(spark, sf_dir))


@register("top_types", sql.query(SAMPLES, """
  SELECT raw_label, count(*) AS samples FROM raw_samples GROUP BY raw_label ORDER BY samples DESC, raw_label LIMIT 10""",
    raw_label=S, samples=B))
def top_types(spark, sf_dir):
    return samples.top_kinds(raw_samples(spark, sf_dir), "raw_label")


@register("class_count", sql.query([*SAMPLES, _NORMED], "SELECT count(DISTINCT label) AS classes FROM normed", classes=B))
def class_count(spark, sf_dir):
    return samples.class_count(_normed(spark, sf_dir))


_CATEGORIES = "CASE doc_id % 3 WHEN 0 THEN 'High Risk' WHEN 1 THEN 'Medium Risk' ELSE 'Safe' END"


@register("line_chunks", sql.query([corpus.SQL_LINES, f"""
  parts AS (SELECT repo, file, {_CATEGORIES} AS label, string_split({_strip('content')}, chr(10)) AS parts
            FROM contents),
  chunks AS (SELECT repo, file, label, (start - 1) // 4 AS chunk, {_strip("array_to_string(parts[start:start + 5], chr(10))")} AS code
            FROM (SELECT *, unnest(range(1, len(parts) + 1, 4)) AS start FROM parts))"""],
    "SELECT repo, file, label, chunk, code FROM chunks WHERE length(code) >= 10", repo=S, file=S, label=S, chunk=B, code=S))
def line_chunks(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    kind = F.col("doc_id") % 3
    return readers.labelled_files(files.withColumn("label", F.when(kind == 0, "High Risk").when(kind == 1, "Medium Risk").otherwise("Safe")))


# --- features ---------------------------------------------------------------------

def _texts(spark, sf_dir) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    return features.with_tokens(corpus.spread(docs, "doc_id"), F.col("code"))


_token = f"[{sql.WORD}][{sql.WORD}.]*[{sql.WORD}]"
SQL_WORDS = f"""
tokens AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{_token}') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(t) AS term FROM tokens
  UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM tokens
  UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]) FROM tokens)
"""
SQL_CHARS = f"""
padded AS (SELECT doc_id, ' ' || word || ' ' AS w FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[{corpus.RE2_SPACE}]+')) AS word FROM documents) WHERE word <> ''),
grams AS (
  {' UNION ALL '.join(f"SELECT doc_id, unnest([substr(w, i, {n}) FOR i IN range(1, length(w) - {n} + 2)]) AS term FROM padded"
                      for n in range(2, 6))})
"""


def _ngram_query(name: str, measured, cte: str, table: str) -> None:
    @register(name, sql.query([cte], f"""
      SELECT doc_id, count(term) AS terms, count(DISTINCT term) AS distinct_terms,
        md5(coalesce(string_agg(term, '|' ORDER BY term), '')) AS digest
      FROM documents LEFT JOIN {table} USING (doc_id) GROUP BY doc_id""",
        doc_id=B, terms=B, distinct_terms=B, digest=S))
    def build(spark, sf_dir):
        return measured(_texts(spark, sf_dir))


def _digest(terms) -> Column:
    return F.md5(F.array_join(terms, "|").cast("binary")).alias("digest")


def _word_ngrams(texts) -> DataFrame:
    return texts.select("doc_id", features.word_ngrams().alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("terms"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_terms"), _digest(F.sort_array("t")))


def _char_ngrams(texts) -> DataFrame:
    whole = F.flatten(F.transform("_grams", lambda g: F.array_repeat(g["term"], g["uses"].cast("int"))))
    counted = features.char_ngram_counts(texts.select("doc_id", "_code"))
    return counted.select("doc_id", F.aggregate("_grams", F.lit(0).cast("bigint"), lambda n, g: n + g["uses"]).alias("terms"),
                          F.size("_grams").cast("bigint").alias("distinct_terms"), _digest(whole))


_ngram_query("word_ngrams", _word_ngrams, SQL_WORDS, "words")
_ngram_query("char_ngrams", _char_ngrams, SQL_CHARS, "grams")


def _vocab_sql(table: str, size: int) -> str:
    return f"SELECT term, count(*) AS uses FROM {table} GROUP BY term ORDER BY uses DESC, term LIMIT {size}"


@register("word_vocab", sql.query([SQL_WORDS], _vocab_sql("words", 4000), term=S, uses=B))
def word_vocab(spark, sf_dir):
    return features.vocabulary(features.term_counts(_texts(spark, sf_dir), features.each_word_ngram), features.WORD_FEATURES)


@register("char_vocab", sql.query([SQL_CHARS], _vocab_sql("grams", 2000), term=S, uses=B))
def char_vocab(spark, sf_dir):
    return features.vocabulary(features.term_counts(features.used_words(_texts(spark, sf_dir)), features.char_ngrams(), "uses"), features.CHAR_FEATURES)


@register("word_vocab_heavy", ORACLE["word_vocab"])
def word_vocab_heavy(spark, sf_dir):
    """The word vocabulary when only the terms of full hash buckets are shuffled."""
    return features.heavy_terms(_texts(spark, sf_dir), features.each_word_ngram, features.WORD_FEATURES)


@register("char_vocab_heavy", ORACLE["char_vocab"])
def char_vocab_heavy(spark, sf_dir):
    words = durable(features.used_words(_texts(spark, sf_dir)), "used-words")
    return features.heavy_terms(words, features.char_ngrams(), features.CHAR_FEATURES, uses="uses")


def _idf_sql(table: str, size: int) -> str:
    return (f"SELECT term, count(DISTINCT doc_id) AS documents, "
            f"ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf "
            f"FROM {table} WHERE term IN (SELECT term FROM ({_vocab_sql(table, size)})) GROUP BY term")


@register("idf", sql.query([SQL_WORDS], f"SELECT term, documents, round(idf, 6) AS idf FROM ({_idf_sql('words', 4000)})",
                           term=S, documents=B, idf=D))
def idf(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    terms = features.word_ngrams()
    vocab = features.vocabulary(features.term_counts(texts, features.each_word_ngram), features.WORD_FEATURES)
    return features.inverse_document_frequency(texts, terms, vocab).withColumn("idf", F.round("idf", 6))


def _weights_sql(table: str, size: int, block: str) -> str:
    return f"""
  SELECT doc_id, '{block}' AS block, count(*) AS terms, round(sum(weight / norm), 5) AS total, round(max(weight / norm), 5) AS largest
  FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS norm FROM (
    SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS weight FROM {table} JOIN ({_idf_sql(table, size)}) USING (term)
    GROUP BY doc_id, term)) GROUP BY doc_id"""


@register("tfidf_features", sql.query([SQL_WORDS, SQL_CHARS], f"{_weights_sql('words', 4000, 'word')} UNION ALL {_weights_sql('grams', 2000, 'char')}",
                                      doc_id=B, block=S, terms=B, total=D, largest=D))
def tfidf_features(spark, sf_dir):
    texts = _texts(spark, sf_dir).select("doc_id", "code")
    vectorizer = train.fit_vectorizer(texts)
    weights = vectorizer.transform(texts, F.col("code")).select("doc_id", F.unwrap_udt("features").alias("f"))
    # both blocks from one pass; a vector's places are in order, words first
    values = F.col("f.values")
    words = weights.select("doc_id", "f", F.inline(F.array(F.struct(F.size(F.filter("f.indices", lambda i: i < len(vectorizer.words))).alias("n")))))
    used = words.select("doc_id", F.inline(F.array(F.struct(F.lit("word").alias("block"), F.slice(values, F.lit(1), F.col("n")).alias("u")),
                                                   F.struct(F.lit("char").alias("block"), F.slice(values, F.col("n") + 1, F.size(values)).alias("u")))))
    return used.filter(F.size("u") > 0).select(
        "doc_id", "block", F.size("u").cast("bigint").alias("terms"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("u"), 5).alias("largest"))


# --- evaluation and classifier --------------------------------------------------------

_SCORED = """scored AS (SELECT row_id,
  CASE (doc_id * 7 + line) % 3 WHEN 0 THEN 'High Risk' WHEN 1 THEN 'Medium Risk' ELSE 'Safe' END AS label,
  CASE doc_id % 5 WHEN 0 THEN 'High Risk' WHEN 1 THEN 'Medium Risk' ELSE 'Safe' END AS ml_prediction FROM raw_samples)"""


def _scored(spark, sf_dir) -> DataFrame:
    actual, guess = (F.col("doc_id") * 7 + F.col("line")) % 3, F.col("doc_id") % 5
    return raw_samples(spark, sf_dir).select(
        F.when(actual == 0, "High Risk").when(actual == 1, "Medium Risk").otherwise("Safe").alias("label"),
        F.when(guess == 0, "High Risk").when(guess == 1, "Medium Risk").otherwise("Safe").alias("ml_prediction"))


_MEASURES = ("precision", "recall", "f1")


@register("classification_report", sql.query([*SAMPLES, _SCORED, """
  per AS (SELECT l.label, (SELECT count(*) FROM scored WHERE label = l.label AND ml_prediction = l.label) AS hits,
    (SELECT count(*) FROM scored WHERE label = l.label) AS support, (SELECT count(*) FROM scored WHERE ml_prediction = l.label) AS claimed
    FROM (SELECT label FROM scored UNION SELECT ml_prediction FROM scored) l),
  rated AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
    SELECT *, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM per))"""], """
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rated
  UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), sum(support) FROM rated
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM rated
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support) FROM rated""",
    label=S, precision=D, recall=D, f1=D, support=B))
def classification_report(spark, sf_dir):
    report = train.classification_report(_scored(spark, sf_dir))
    return report.withColumns({m: F.round(m, 6) for m in _MEASURES})


@register("confusion", sql.query([*SAMPLES, _SCORED], """
  SELECT label AS actual, count(*) FILTER (ml_prediction = 'High Risk') AS high, count(*) FILTER (ml_prediction = 'Medium Risk') AS medium,
    count(*) FILTER (ml_prediction = 'Safe') AS safe FROM scored GROUP BY label""", actual=S, high=B, medium=B, safe=B))
def confusion(spark, sf_dir):
    return train.confusion(_scored(spark, sf_dir), ["High Risk", "Medium Risk", "Safe"]) \
        .withColumnsRenamed({"High Risk": "high", "Medium Risk": "medium", "Safe": "safe"})


def labelled_lines(spark, sf_dir) -> DataFrame:
    """``(row_id, code, label)``: distinct corpus lines, labelled by the severity of their finding."""
    lines = corpus_lines(spark, sf_dir)
    doc = F.regexp_extract("file", r"f(\d+)", 1).cast("bigint")
    label = F.when(F.col("severity") == "High", "High Risk").when(F.col("severity") == "Medium", "Medium Risk").otherwise("Safe")
    rows = hits.line_severity(lines).select(
        (doc * 100000 + F.col("line")).alias("row_id"), "code", label.alias("label"))
    return train.clean_training(rows, ["row_id"])


@register("file_predictions", sql.query([corpus.SQL_LINES], """
  SELECT repo, file, true AS known_label, true AS largest_score, true AS scores_add_up FROM contents""",
    repo=S, file=S, known_label=L, largest_score=L, scores_add_up=L))
def file_predictions(spark, sf_dir):
    """Every whole file classified; what must hold for each row whatever the model."""
    model = train.train(durable(labelled_lines(spark, sf_dir), "samples"))
    values = F.map_values("all_scores")
    return model.predict(corpus.files(spark, sf_dir)).select(
        "repo", "file", F.col("ml_prediction").isin("High Risk", "Medium Risk", "Safe").alias("known_label"),
        ((F.col("confidence") == F.array_max(values)) & (F.col("confidence") == F.col("all_scores")[F.col("ml_prediction")])).alias("largest_score"),
        (F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - 100) <= 0.3).alias("scores_add_up"))


_GRID = {"word_features": (300,), "word_range": ((1, 2),), "char_features": (100, 300), "char_range": ((2, 4),), "c": (1.0, 20.0)}


_LINE_LABELS = f"""labelled AS (
  SELECT row_id, label FROM (
    SELECT doc_id * 100000 + line AS row_id, code,
      CASE severity WHEN 'High' THEN 'High Risk' WHEN 'Medium' THEN 'Medium Risk' ELSE 'Safe' END AS label
    FROM lines LEFT JOIN (SELECT repo, file, line, severity FROM findings) USING (repo, file, line))
  WHERE {_strip('code')} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_strip('code')} ORDER BY row_id) = 1),
placed AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR)))
    <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM labelled)"""


@register("grid_accuracy", sql.query([corpus.SQL_LINES, sql.SQL_FINDINGS, _LINE_LABELS], """
  SELECT chars AS char_features, c::DOUBLE AS c, (SELECT count(*) FROM labelled) AS rows, true AS accurate
  FROM (VALUES ('100'), ('300')) a(chars), (VALUES (1), (20)) b(c)""", char_features=S, c=D, rows=B, accurate=L))
def grid_accuracy(spark, sf_dir):
    """Four settings over two folds of the labelled lines: every line is held out once for each, and the accuracy reaches 0.7."""
    data = durable(labelled_lines(spark, sf_dir), "samples")
    found = train.tune(data, F.col("row_id"), _GRID, folds=2, max_iter=30)
    return found.select("char_features", "c", "rows", (F.col("accuracy") >= 0.7).alias("accurate"))


@register("held_out_report", sql.query([corpus.SQL_LINES, sql.SQL_FINDINGS, _LINE_LABELS], """
  SELECT label, count(*) AS support, true AS accurate FROM placed WHERE is_test GROUP BY label
  UNION ALL SELECT name, (SELECT count(*) FROM placed WHERE is_test), true FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(name)""",
    label=S, support=B, accurate=L))
def held_out_report(spark, sf_dir):
    """Labels and supports of the held-out rows, and whether the accuracy reaches 0.9."""
    _, scored = train.train_and_evaluate(durable(labelled_lines(spark, sf_dir), "samples"), F.col("row_id"))
    report = train.classification_report(scored)
    accuracy = F.max(F.when(F.col("label") == "accuracy", F.col("precision"))).over(Window.partitionBy())
    return report.filter("support > 0").select("label", "support", (accuracy >= 0.9).alias("accurate"))
