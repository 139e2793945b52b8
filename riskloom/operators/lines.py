"""From files to lines: the line table, line classes and per-file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.matching import fold
from riskloom.operators.hits import shortcut_mask
from riskloom.registry import (
    CLASS_PREFIXES,
    CONTEXT_LINES,
    DEFAULT,
    FINDING_COMMENTS,
    FUNCTION_PREFIXES,
    IMPORT_PREFIXES,
    STATS_COMMENTS,
    Registry,
)


def lines(files: DataFrame) -> DataFrame:
    """``(repo, file, line, raw, code)``: one row per line, numbered from 1.

    A narrow transformation: every file is split where it is read.
    """
    return (
        files.select("repo", "file", text.universal_newlines(F.col("content")).alias("content"))
        .select("repo", "file", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw"))
        .select("repo", "file", (F.col("pos") + 1).alias("line"), "raw", text.strip(F.col("raw")).alias("code"))
    )


def line_classes(code: Column) -> dict[str, Column]:
    """The class tests of one stripped line; blank lines belong to no other class."""
    return {
        "is_blank": code == "",
        "is_comment": text.starts_with_any(code, STATS_COMMENTS),
        "is_import": text.starts_with_any(code, IMPORT_PREFIXES),
        "is_function": text.starts_with_any(code, FUNCTION_PREFIXES),
        "is_class": text.starts_with_any(code, CLASS_PREFIXES),
    }


def classify_lines(line_table: DataFrame) -> DataFrame:
    return line_table.withColumns(line_classes(F.col("code")))


def is_scannable(code: Column) -> Column:
    """Lines that findings and entry points look at."""
    return (code != "") & ~text.starts_with_any(code, FINDING_COMMENTS)


def scannable_lines(line_table: DataFrame) -> DataFrame:
    return line_table.filter(is_scannable(F.col("code")))


STATS = ("total_lines", "blank_lines", "comments", "imports", "functions", "classes", "total_characters")
PROFILE = (*STATS, "size_kb", "shortcut_mask")


def _stripped(files: DataFrame) -> DataFrame:
    """Files with their ``stripped`` lines and ``folded`` content."""
    return (
        files.select("repo", "file", "size_bytes", text.universal_newlines(F.col("content")).alias("content"))
        .withColumn("stripped", F.transform(text.split_lines(F.col("content")), text.strip))
        .withColumn("folded", fold(F.col("content")))
    )


def _profile(registry: Registry) -> list[Column]:
    """The columns ``PROFILE`` of ``_stripped`` files."""
    def count(flag: str) -> Column:
        return F.size(F.filter("stripped", lambda c: line_classes(c)[flag])).cast("bigint")

    return [
        F.size("stripped").cast("bigint").alias("total_lines"),
        count("is_blank").alias("blank_lines"),
        count("is_comment").alias("comments"),
        count("is_import").alias("imports"),
        count("is_function").alias("functions"),
        count("is_class").alias("classes"),
        F.length("content").cast("bigint").alias("total_characters"),
        F.round(F.col("size_bytes") / 1024, 2).alias("size_kb"),
        shortcut_mask(registry=registry).alias("shortcut_mask"),
    ]


def file_profile(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Line counts, size and the registry's shortcut signatures of every file.

    Everything is computed inside the file row: one read, no explode, no shuffle.
    """
    return _stripped(files).select("repo", "file", *_profile(registry))


def profiled_lines(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """``(repo, file, profile, line, code)``: files and their lines in one pass over the contents.

    A file's own row comes before its lines, with ``line`` 0 and no code.
    """
    own, none = F.array(F.lit(None).cast("string")), F.array().cast("array<string>")
    return (
        _stripped(files).select("repo", "file", "stripped", F.struct(*_profile(registry)).alias("profile"))
        .select("repo", "file", "profile", F.posexplode(F.concat(own, F.coalesce("stripped", none))).alias("line", "code"))
    )


def file_stats(files: DataFrame) -> DataFrame:
    return file_profile(files).select("repo", "file", *STATS)


def file_metadata(files: DataFrame) -> DataFrame:
    """Name, extension, size and language of every file."""
    ext = text.extension(F.col("file"))
    return files.select(
        "repo", "file",
        text.base_name(F.col("file")).alias("filename"),
        ext.alias("extension"),
        F.round(F.col("size_bytes") / 1024, 2).alias("size_kb"),
        text.language(ext).alias("language"),
    )


def line_windows(files: DataFrame, around: int = CONTEXT_LINES) -> DataFrame:
    """Every line with up to ``around`` lines before and after it, blank lines included.

    The neighbours are cut from the file row itself, so nothing is shuffled.
    Filter the result to the wanted lines before keeping it.
    """
    content = files.select("repo", "file", text.universal_newlines(F.col("content")).alias("content"))
    raw = content.select("repo", "file", text.split_lines(F.col("content")).alias("all_lines"))

    def window(value: Column, pos: Column) -> Column:
        near = [F.get("all_lines", pos + k) for k in range(-around, around + 1)]
        return F.struct(
            (pos + 1).alias("line"),
            value.alias("raw"),
            text.strip(value).alias("code"),
            F.greatest(pos - (around - 1), F.lit(1)).alias("first_line"),
            F.array_compact(F.array(*near)).alias("context"),
        )

    return raw.select("repo", "file", F.inline(F.transform("all_lines", window)))
