"""A Spark data source for Python source trees: spark.read.format("pyrepo").load(path).

Spark's own file readers skip names that begin with ``_`` or ``.``, so ``__init__.py`` needs a reader of its own.  The
planner walks the tree once, leaves out excluded folders, virtual environments and ignored paths, and deals the files
into partitions of like size; tasks read them.  The tree must be on storage that driver and executors share.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import ignore

SCHEMA = "path string, content string, hash string, error string"


def is_venv(folder: str) -> bool:
    return folder.endswith(".egg-info") or os.path.exists(os.path.join(folder, "pyvenv.cfg"))


def ignore_patterns(root: str) -> list[str]:
    """Lines of the root's ignore file; none if there is none."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="ignore") as f:
            return f.read().splitlines()
    except OSError:
        return []


def walk(root: str) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the .py files in order, without what is excluded or ignored."""
    patterns = ignore_patterns(root)
    for here, folders, files in os.walk(root):
        rel = os.path.relpath(here, root).replace(os.sep, "/")
        lead = "" if rel == "." else rel + "/"
        folders[:] = sorted(d for d in folders if d not in ignore.EXCLUDED and not is_venv(os.path.join(here, d)) and not ignore.is_ignored(lead + d + "/", patterns))
        for name in sorted(files):
            if name.endswith(".py") and not ignore.is_ignored(lead + name, patterns):
                try:
                    yield lead + name, os.path.getsize(os.path.join(here, name))
                except OSError:
                    continue  # gone meanwhile


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


def dealt(files: list[tuple[str, int]], size: int) -> list[Files]:
    out, now, total = [], [], 0
    for path, n in files:
        if now and total + n > size:
            out.append(Files(now))
            now, total = [], 0
        now.append(path)
        total += n
    return [*out, Files(now)] if now else out


def read_files(root: str, paths: list[str], strict: bool) -> Iterator[pa.RecordBatch]:
    rows = []
    for p in paths:
        try:
            with open(os.path.join(root, p), "rb") as f:
                data = f.read()
            text, error = data.decode("utf-8", "strict" if strict else "ignore"), None
        except (OSError, UnicodeDecodeError) as e:
            data, text, error = b"", None, str(e)
        rows.append((p, text, hashlib.sha256(data).hexdigest() if error is None else None, error))
        if len(rows) >= 256:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "content", "hash", "error"])


class PyRepo(DataSource):
    """Options: path; partitionBytes (16 MB); strict (true: a file that isn't UTF-8 gives an error row)."""

    @classmethod
    def name(cls) -> str:
        return "pyrepo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Changes(self.options)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.size = int(options.get("partitionBytes", 16 << 20))
        self.strict = str(options.get("strict", "true")).lower() == "true"

    def partitions(self) -> list[Files]:
        return dealt(list(walk(self.root)), self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_files(self.root, partition.paths, self.strict)


class Changes(DataSourceStreamReader):
    """A stream of files that are new or changed since the offset before: the offset maps paths to stat marks.

    A path that went comes as a row without content and the error "deleted".
    """

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.strict = str(options.get("strict", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, n in walk(self.root):
            try:
                out[path] = f"{n}:{os.stat(os.path.join(self.root, path)).st_mtime_ns}"
            except OSError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Files]:
        changed = [p for p, mark in sorted(end.items()) if start.get(p) != mark]
        gone = [f"-{p}" for p in sorted(start) if p not in end]
        return [Files(changed[a : a + 256]) for a in range(0, len(changed), 256)] + ([Files(gone)] if gone else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        gone = [p[1:] for p in partition.paths if p.startswith("-")]
        if gone:
            yield _batch([(p, None, None, "deleted") for p in gone])
        else:
            yield from read_files(self.root, partition.paths, self.strict)

    def commit(self, end: dict) -> None:
        return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PyRepo)
