"""Source trees as a data source: ``spark.read.format("source_tree").load(root)``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from riskloom import registry as R

SCHEMA = "repo string, file string, content string, size_bytes long"
FILES_PER_TASK = 256            # top entries of a repository that one task walks
BATCH_BYTES = 16 << 20          # content that a task holds


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters that reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


class SourceTree(DataSource):
    """``files(repo, file, content, size_bytes)`` of all scannable files below a folder, by the rules of ``read_tree``.

    Every directory directly below the folder is a repository; with the option ``repo`` the folder itself is the one
    repository of that name.  Filters on ``repo`` and upper limits on ``size_bytes`` decide what is listed and read.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("repo"))


@dataclass
class Part(InputPartition):
    """Some top entries of one repository: paths below the root, and which of them are directories."""

    repo: str
    entries: list[tuple[str, bool, int]]


def _skipped(folder: str) -> bool:
    return folder.startswith(".") or folder in R.SKIPPED_DIRECTORIES


def _scanned(name: str) -> bool:
    base = name.lstrip(".")         # leading dots start no extension
    dot = base.rfind(".")
    return dot > 0 and base[dot:].lower() in R.SCANNED_EXTENSIONS


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str | None):
        self.root, self.repo = root.rstrip("/").replace("s3a://", "s3://", 1), repo
        self.repos: set[str] | None = None
        self.most: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("repo",):
                self._only(set(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("size_bytes",):
                limit = f.value - isinstance(f, LessThan)
                self.most = limit if self.most is None else min(self.most, limit)
            else:
                yield f

    def _only(self, repos: set[str]) -> None:
        self.repos = repos if self.repos is None else self.repos & repos

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _entries(self, system: fs.FileSystem, folder: str) -> list[tuple[str, bool, int]]:
        """Name, whether it is a directory, and size of what a directory holds; links to directories are left out."""
        import os

        try:
            found = system.get_file_info(fs.FileSelector(folder))
        except OSError:
            return []
        local = isinstance(system, fs.LocalFileSystem)
        return sorted((e.base_name, e.type == fs.FileType.Directory, e.size or 0) for e in found
                      if not (local and e.type == fs.FileType.Directory and os.path.islink(e.path)))

    def partitions(self) -> list[Part]:
        """The wanted repositories' top entries; nothing below them is listed here."""
        system, base = self._system()
        if self.repo is not None:
            repos = [(self.repo, base)]
        elif self.repos is not None:
            repos = [(r, f"{base}/{r}") for r in sorted(self.repos) if r is not None]
        else:
            repos = [(name, f"{base}/{name}") for name, is_folder, _ in self._entries(system, base) if is_folder]
        out = []
        for repo, folder in repos:
            if self.repos is not None and repo not in self.repos:
                continue
            own = self._entries(system, folder)
            folders = [[e] for e in own if e[1] and not _skipped(e[0])]
            files = [e for e in own if not e[1] and _scanned(e[0])]
            out += [Part(repo, part) for part in [*folders, *(files[k:k + FILES_PER_TASK] for k in range(0, len(files), FILES_PER_TASK))]]
        return out or [Part("", [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, base = self._system()
        top = base if self.repo is not None else f"{base}/{partition.repo}"
        held, size = [], 0
        for file, length in self._walk(system, top, partition.entries):
            try:
                with system.open_input_stream(f"{top}/{file}") as stream:
                    data = stream.read()
            except OSError:
                continue
            held.append((partition.repo, file, data.decode("utf-8", errors="replace"), length))
            size += len(data)
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _walk(self, system: fs.FileSystem, top: str, entries: list[tuple[str, bool, int]]) -> Iterator[tuple[str, int]]:
        waiting = list(reversed(entries))
        while waiting:
            path, is_folder, size = waiting.pop()
            if is_folder:
                waiting += [(f"{path}/{name}", folder, length) for name, folder, length in reversed(self._entries(system, f"{top}/{path}")) if not (folder and _skipped(name))]
            elif _scanned(path.rsplit("/", 1)[-1]) and (self.most is None or size <= self.most):
                yield path, size

    @staticmethod
    def _batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["repo", "file", "content", "size_bytes"])
