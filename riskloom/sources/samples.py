"""Readers for labelled code samples."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.durable import durable
from riskloom.operators import labels, samples
from riskloom.registry import HIGH_RISK
from riskloom.sources.csv_ranges import csv_records

# FIXED VALUES: parts of column names that tell code and label columns.
CODE_PARTS = ("code", "snippet", "source", "func", "function")
LABEL_PARTS = ("label", "vuln", "cwe", "type", "class", "target", "vul")
FIX_PAIR_COLUMNS = ("CVE_ID", "vuln_type", "language", "vulnerable_code", "patched_code")
_TEXT_LIMIT = str(64 * 1024 * 1024)


# quoted values may hold line breaks and doubled quotes
_CSV = {"multiLine": "true", "quote": '"', "escape": '"', "maxCharsPerColumn": _TEXT_LIMIT, "mode": "PERMISSIVE"}


def read_csv_groups(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, suffix: str = "*.csv",
                    range_bytes: int | None = None) -> list[DataFrame]:
    """A third-party file or directory: one table for each header that occurs, all columns as text, with ``origin`` (the file).

    Every file is read with its own header, and a large file in many ranges, of ``range_bytes`` if given (see ``csv_records``).  Rows with too few fields are kept, padded with nulls; rows with too many are
    dropped.  ``columns`` selects those that exist; Spark then parses only these.  Only the different headers pass through the driver.
    """
    found = csv_records(spark, path, suffix, range_bytes)
    files = durable(found.heads.join(found.files, "file"), "csv-files")
    out = []
    for row in files.groupBy("head").agg(F.min("path").alias("first")).orderBy("first").collect():
        header = tuple(next(csv.reader(io.StringIO(row["head"].removeprefix("\ufeff"))), ()))
        if not header:
            continue
        names = _unique(header)
        schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        own = files.filter(F.col("head") == row["head"]).select("file", F.col("path").alias("origin"))
        raw = found.records.join(own, "file").select("origin", F.from_csv("record", schema, _CSV).alias("r"))
        kept = [(i, n) for i, n in enumerate(names) if columns is None or n in columns]
        out.append(raw.filter(F.col(f"r.c{len(names)}").isNull()).select(*[F.col(f"r.c{i}").alias(n) for i, n in kept], "origin"))
    return out


def _unique(header: tuple[str, ...]) -> list[str]:
    """Column names of a header; repeated and empty ones get a number, as two columns can't share a name."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name.strip() or f"column {i}"
        n = seen[name.lower()] = seen.get(name.lower(), -1) + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(code, label)`` by header name, whatever the order of columns, stripped, without incomplete rows."""
    parts = read_csv_groups(spark, path, ("code", "label"))
    if not parts or any(not {"code", "label"} <= set(p.columns) for p in parts):
        raise ValueError("a training file has the columns code and label")
    return samples.drop_incomplete(reduce(DataFrame.unionByName, [p.select("code", "label") for p in parts]))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, suffix: str = "*.csv", range_bytes: int | None = None) -> DataFrame:
    """All tables of ``read_csv_groups`` by column name; a column that a file lacks is null there."""
    parts = read_csv_groups(spark, path, columns, suffix, range_bytes)
    if not parts:
        raise ValueError(f"no file with a header at {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_samples(spark: SparkSession, path: str, reader, suffix: str = "*.csv") -> DataFrame:
    """A directory of files with different headers: ``reader`` (such as ``discovered_samples``) finds its columns in each.

    Files in which it finds no code column are skipped; without any other file that is an error.
    """
    parts, reasons = [], []
    for table in read_csv_groups(spark, path, None, suffix):
        try:
            parts.append(reader(table))
        except ValueError as reason:
            reasons.append(str(reason))
    if not parts:
        raise ValueError(f"no usable file at {path}: {reasons}")
    return reduce(DataFrame.unionByName, parts)


def read_json(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """An array of objects, or one object, per file; all fields as text, in the order in which the records name them."""
    files = spark.read.options(pathGlobFilter=suffix, wholetext=True).text(path).select("value", F.col("_metadata.file_path").alias("origin"))
    objects = files.select("origin", F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
                                               .otherwise(F.array("value"))).alias("record"))
    keyed = objects.select("origin", F.posexplode(F.json_object_keys("record")).alias("at", "key"))
    order = keyed.groupBy("key").agg(F.min("at").alias("at"), F.min("origin").alias("first")).orderBy("at", "first", "key")
    names = [r.key for r in order.collect()]        # the names of fields, not their values
    parsed = objects.select("origin", F.from_json("record", T.StructType([T.StructField(n, T.StringType()) for n in names])).alias("r"))
    return parsed.select(*[F.col("r")[n].alias(n) for n in names], "origin")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "origin"]


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def typed_samples(df: DataFrame) -> DataFrame:
    """Code with a vulnerability type; without a type column every sample is High."""
    columns = _text_columns(df)
    code = labels.find_column(columns, ("code",))
    kind = labels.find_column(columns, ("vuln", "type", "label", "class"))
    if code is None:
        raise ValueError(f"no code column among {columns}")
    label = labels.from_name(_named(kind)) if kind else F.lit(HIGH_RISK)
    return _usable(df, labels.plain_code(_named(code)), label)


def discovered_samples(df: DataFrame) -> DataFrame:
    """Code and label found by column name; labels may be flags, types or weakness ids.

    Without a label column nothing is kept.
    """
    columns = _text_columns(df)
    code, label = labels.find_column(columns, CODE_PARTS), labels.find_column(columns, LABEL_PARTS)
    if code is None:
        raise ValueError(f"no code column among {columns}")
    value = labels.from_name_or_flag(_named(label)) if label else F.lit(None).cast("string")
    return _usable(df, labels.plain_code(_named(code)), value)


def flagged_samples(df: DataFrame) -> DataFrame:
    """Like ``discovered_samples`` with the cleaner for escaped code; unlabelled samples are High."""
    columns = _text_columns(df)
    code, label = labels.find_column(columns, (*CODE_PARTS, "text")), labels.find_column(columns, LABEL_PARTS)
    if code is None:
        raise ValueError(f"no code column among {columns}")
    value = labels.from_type_or_flag(_named(label)) if label else F.lit(HIGH_RISK)
    return _usable(df, labels.clean_code(_named(code)), value)


def fix_pairs(df: DataFrame) -> DataFrame:
    """Vulnerable and fixed code side by side; an unrecognised type counts as High."""
    columns = _text_columns(df)
    vulnerable = labels.find_column(columns, ("vuln",), without=("type",))
    fixed = labels.find_column(columns, ("fix", "patch", "safe"))
    kind = labels.find_column(columns, ("type", "category"))
    label = labels.or_high(labels.from_name(_named(kind))) if kind else F.lit(HIGH_RISK)
    return labels.pairs_to_samples(df, _plain(vulnerable), _plain(fixed), label, distinct_fix=False).drop("part")


def curated_fix_pairs(df: DataFrame) -> DataFrame:
    """Pairs with free column names (before/after, old/new, ...) and escaped code."""
    columns = _text_columns(df)
    vulnerable = labels.find_column(columns, ("vuln", "before", "old", "vulnerable", "unsafe"))
    fixed = labels.find_column(columns, ("fix", "after", "patch", "safe", "secure", "new"))
    kind = labels.find_column(columns, ("type", "cwe", "vuln_type", "category"))
    label = labels.from_type(F.coalesce(_named(kind), F.lit("unknown"))) if kind else F.lit(HIGH_RISK)
    return labels.pairs_to_samples(df, _clean(vulnerable), _clean(fixed), label, distinct_fix=False).drop("part")


def cve_fix_pairs(df: DataFrame) -> DataFrame:
    """Pairs with a language and a type; other languages are dropped, equal fixes too."""
    language = _named("language") if "language" in df.columns else F.lit("")
    kind = _named("vuln_type") if "vuln_type" in df.columns else F.lit("unknown")
    rows = df.filter(labels.allowed_language(language))
    return labels.pairs_to_samples(rows, _clean("vulnerable_code"), _clean("patched_code"), labels.from_type(kind)).drop("part")


def weakness_records(df: DataFrame) -> DataFrame:
    """JSON records with alternative field names for code, weakness id and safe code."""
    code = labels.first_filled(df, "code", "Insecure_code", "vulnerable_code")
    cwe = labels.first_filled(df, "CWE", "cwe")
    safe = labels.first_filled(df, "secure_code", "safe_code")
    label = labels.or_high(labels.from_cwe(cwe))
    return labels.pairs_to_samples(df, _long(code), _long(safe), label, distinct_fix=False).drop("part")


def labelled_files(files: DataFrame) -> DataFrame:
    """Chunks of ``files(repo, file, content, label)`` that carry the label of their file; files without a label are dropped.

    ``read_tree(categories=...)`` puts the label on the listing, so contents are never joined.
    """
    return labels.line_chunks(files.filter("label IS NOT NULL"), "content", ("repo", "file", "label"))


def _long(code: Column) -> Column:
    return F.when(F.length(code) >= labels.MIN_SAMPLE, code)


def _plain(name: str | None) -> Column:
    return labels.plain_code(_named(name)) if name else F.lit(None).cast("string")


def _clean(name: str | None) -> Column:
    return labels.clean_code(_named(name)) if name else F.lit(None).cast("string")


def _usable(df: DataFrame, code: Column, label: Column) -> DataFrame:
    return df.select(code.alias("code"), label.alias("label")).filter("code IS NOT NULL AND label IS NOT NULL")
