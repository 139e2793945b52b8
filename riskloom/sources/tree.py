"""Source trees as a table of files.

Spark's own file sources ignore names that start with ``_`` (and so every
``__init__.py``).  The tree is therefore listed level by level, one task per
group of directories, and file contents are read in the tasks that use them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import text
from riskloom.functions.durable import durable
from riskloom.functions.ranking import top_per_group

DIRECTORIES_PER_TASK = 64
ENTRIES_PER_BATCH = 4096
BYTES_PER_TASK = 128 * 1024 * 1024
BYTES_PER_BATCH = 16 * 1024 * 1024


def in_skipped_directory(path: Column) -> Column:
    """True when a directory of a repository-relative path is hidden or on the skip list."""
    return path.rlike(r"(^|/)(\.[^/]*|" + "|".join(R.SKIPPED_DIRECTORIES) + ")/")


def has_scanned_extension(path: Column) -> Column:
    return text.extension(path).isin(*R.SCANNED_EXTENSIONS)


def fits_size(size: Column, limit: int) -> Column:
    return size <= limit


def decode(content: Column) -> Column:
    """UTF-8 text; bytes that are not valid become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def cap_files(listing: DataFrame, max_files: int) -> DataFrame:
    """The first ``max_files`` files of every repository by name."""
    return top_per_group(listing, ["repo"], [F.col("file")], max_files)


def skip_reason(max_bytes: int | None = None) -> Column:
    """Why a listed file is not scanned; null when it is.  Sizes matter only when a limit is given."""
    name = F.col("file")
    reason = F.when(in_skipped_directory(name), "directory").when(~has_scanned_extension(name), "extension")
    return reason if max_bytes is None else reason.when(~fits_size(F.col("size_bytes"), max_bytes), "size")


def scannable(listing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Directory and extension rules on a listing, and a size rule where a limit is given."""
    return listing.filter(skip_reason(max_bytes).isNull())


def skipped_files(listing: DataFrame, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """``(repo, file, size_bytes, reason)`` of the listed files that ``read_tree`` leaves out under the same limits."""
    judged = listing.withColumn("reason", skip_reason(max_bytes))
    out = judged.filter("reason IS NOT NULL")
    if max_files is not None:
        wanted = judged.filter("reason IS NULL")
        kept = cap_files(wanted.select("repo", "file"), max_files)
        out = out.unionByName(wanted.join(kept, ["repo", "file"], "left_anti").withColumn("reason", F.lit("cap")))
    return out.select("repo", "file", "size_bytes", "reason")


def _list_directories(root: str):
    """``mapInArrow`` function: the entries of every directory of a batch; unreadable ones have none."""
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        local = isinstance(system, fs.LocalFileSystem)
        def rows(paths, folders, sizes):
            return pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())],
                names=["path", "is_folder", "size_bytes"])

        for batch in batches:
            paths, folders, sizes = [], [], []
            for directory in batch.column("path").to_pylist():
                if len(paths) >= ENTRIES_PER_BATCH:
                    yield rows(paths, folders, sizes)
                    paths, folders, sizes = [], [], []
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/")))
                except OSError:
                    continue
                for entry in entries:
                    is_folder = entry.type == fs.FileType.Directory
                    if local and is_folder and os.path.islink(entry.path):
                        continue                        # links to directories are not followed
                    paths.append(f"{directory}/{entry.base_name}".lstrip("/"))
                    folders.append(is_folder)
                    sizes.append(entry.size or 0)
            yield rows(paths, folders, sizes)
    return run


def _read_files(root: str, batch_bytes: int = BYTES_PER_BATCH):
    """``mapInArrow`` function: add the content of every file; unreadable files are left out."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            kept, contents, held = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    continue
                kept.append(i)
                contents.append(data)
                held += len(data)
                if held >= batch_bytes:
                    yield _with_content(batch, kept, contents, pa)
                    kept, contents, held = [], [], 0
            if kept:
                yield _with_content(batch, kept, contents, pa)

    def _with_content(batch, kept, contents, pa):
        rows = batch.take(pa.array(kept))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], names=[*rows.schema.names, "bytes"])

    return run


def _clean(root: str) -> str:
    return root.rstrip("/").replace("s3a://", "s3://", 1)


def list_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """``(repo, file, size_bytes, path)`` of everything below ``root`` outside skipped directories.

    Without ``repo``, every directory directly below ``root`` is a repository;
    with it, ``root`` itself is the one repository of that name.  One Spark job
    per level of the tree; each level is written to the shared folder, so a
    lost executor repeats one level at most.  Skipped directories are not entered.
    """
    root = _clean(root)
    inside = F.col("path") if repo is not None else F.expr("substring(path, instr(path, '/') + 1)")
    found: list[DataFrame] = []
    level = spark.createDataFrame([("",)], "path string")
    depth = 0
    while True:
        listed = durable(level.mapInArrow(_list_directories(root), "path string, is_folder boolean, size_bytes bigint"), "tree")
        found.append(listed.filter("NOT is_folder"))
        folders = listed.filter("is_folder")
        if repo is not None or depth > 0:               # a repository itself may have any name
            folders = folders.filter(~in_skipped_directory(F.concat(inside, F.lit("/"))))
        count = folders.count()
        if count == 0:
            break
        level = folders.select("path").repartition(-(-count // DIRECTORIES_PER_TASK), "path")
        depth += 1
    rows = reduce(DataFrame.unionByName, found).drop("is_folder")
    if repo is not None:
        return rows.select(F.lit(repo).alias("repo"), F.col("path").alias("file"), "size_bytes", "path")
    return rows.filter(F.contains("path", F.lit("/"))).select(
        F.substring_index("path", "/", 1).alias("repo"), inside.alias("file"), "size_bytes", "path")


def read_tree(spark: SparkSession, root: str, repo: str | None = None, max_files: int | None = None,
              max_bytes: int | None = None, categories: DataFrame | None = None) -> DataFrame:
    """``files(repo, file, content, size_bytes)`` of all scannable files.

    All rules, and the optional limits ``max_files`` per repository and
    ``max_bytes`` per file, are applied to the listing before any content is
    read; ``skipped_files`` tells what they leave out.  ``categories(repo,
    file, label)`` adds a label to the listing, so no content is ever joined.  Files are spread over tasks by
    a hash of their path, about ``BYTES_PER_TASK`` each.
    """
    wanted = scannable(list_tree(spark, root, repo), max_bytes)
    if max_files is not None:
        wanted = wanted.join(cap_files(wanted.select("repo", "file"), max_files), ["repo", "file"], "left_semi")
    extra = []
    if categories is not None:
        wanted, extra = wanted.join(categories.select("repo", "file", "label"), ["repo", "file"], "left"), ["label"]
    total = wanted.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    read = wanted.repartition(tasks, "path").mapInArrow(
        _read_files(_clean(root)), "repo string, file string, size_bytes bigint, path string, " + "label string, " * len(extra) + "bytes binary")
    return read.select("repo", "file", decode(F.col("bytes")).alias("content"), "size_bytes", *extra)
