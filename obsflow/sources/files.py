"""A stream of file versions: every file once for each time it was modified.

Spark's own file stream takes each path once, so a file that was half written when it was
first seen would never be read again.  Here the offset is the last modification seen,
(time, path); a trigger reads all files modified after it, whether new or rewritten.  The
offset does not grow with the number of files.

Read as a table, it gives the files as they are.  The driver lists only the folder itself;
what is below is listed and read in tasks, so very many small files are no load on it.
"""

from __future__ import annotations

import fnmatch
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "file_versions"
SCHEMA = "path string, observed_at timestamp, text string"
# Files of one input partition; more where a trigger would have more partitions than this.
FILES, PARTITIONS = 64, 512
# Rows and characters of a batch of texts.
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Entries(InputPartition):
    def __init__(self, entries: list[tuple[str, int, bool]]):
        self.entries = entries


class FileVersions(DataSource):
    """Options: ``path``, a folder or a glob of folders or files; ``settle``, seconds a file has to be at rest (0).

    Give ``settle`` at least the step of the file system's clock: a file modified in the
    same step after it was listed has no later time.  Files whose name starts with ``_`` or
    ``.`` are left out, a file that has gone is skipped.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Now(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Versions(self.options["path"], float(self.options.get("settle", "0")))


def uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def _time(ns: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=ns // 1000)


class _Now(DataSourceReader):
    """All files in and below a folder, or those of a glob."""

    def __init__(self, path: str):
        self.uri = uri(path)

    def partitions(self) -> list[InputPartition]:
        if re.search(r"[*?\[]", self.uri):
            found = [(p, at, False) for at, p in _Versions(self.uri, 0)._listed()]
        else:
            system, base = fs.FileSystem.from_uri(self.uri)
            found = [(f.path, f.mtime_ns or 0, f.type == fs.FileType.Directory) for f in system.get_file_info(fs.FileSelector(base)) if not _hidden(f.base_name)]
        step = max(1, -(-len(found) // PARTITIONS))
        found.sort()
        return [_Entries(found[k:k + step]) for k in range(0, len(found), step)]

    def read(self, partition: _Entries) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(re.split(r"[*?\[]", self.uri)[0].rsplit("/", 1)[0])
        rows, size = [], 0
        for entry, at, folder in partition.entries:
            for path, seen in _below(system, entry) if folder else [(entry, at)]:
                try:
                    with system.open_input_stream(path, compression=None) as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                rows.append((path, _time(seen), text))
                size += len(text)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield _texts(rows)
                    rows, size = [], 0
        if rows:
            yield _texts(rows)


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _below(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    for f in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and not any(map(_hidden, f.path[len(folder):].split("/"))):
            yield f.path, f.mtime_ns


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    path, at, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(at, pa.timestamp("us", "UTC")), pa.array(text, pa.string())], names=["path", "observed_at", "text"])


class _Versions(DataSourceStreamReader):
    def __init__(self, path: str, settle: float):
        self.uri = uri(path)
        self.settle = settle

    def _listed(self) -> list[tuple[int, str]]:
        head = re.split(r"[*?\[]", self.uri)[0]
        system, base = fs.FileSystem.from_uri(head.rsplit("/", 1)[0] if head != self.uri else head)
        pattern = base + self.uri[len(head.rsplit("/", 1)[0] if head != self.uri else head):].rstrip("/")
        found = []
        for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            below = f.path.split("/")
            parents = ("/".join(below[:k]) for k in range(len(below), base.count("/"), -1))
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and any(_same(p, pattern) for p in parents):
                found.append((f.mtime_ns, f.path))
        return found

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(self.settle * 1e9)
        at, path = max((v for v in self._listed() if v[0] <= limit), default=(-1, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = sorted(v for v in self._listed() if (start["at"], start["path"]) < v <= (end["at"], end["path"]))
        step = max(FILES, -(-len(new) // PARTITIONS))
        return [_Files([(p, at) for at, p in new[k:k + step]]) for k in range(0, len(new), step)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(re.split(r"[*?\[]", self.uri)[0].rsplit("/", 1)[0])
        for path, at in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                continue
            yield path, _time(at), text


def _same(path: str, pattern: str) -> bool:
    """Whether the parts of a path match those of a glob, one by one."""
    a, b = path.split("/"), pattern.split("/")
    return len(a) == len(b) and all(map(fnmatch.fnmatchcase, a, b))
