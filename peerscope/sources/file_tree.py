"""A data source that lists every file below a folder, whatever its name.

Spark's own file listing leaves out names that begin with ``_`` or ``.``; this
source does not. The driver lists the root alone. Its entries are dealt to
partitions, and each partition walks its subtrees on an executor, one row per
matching file: ``path, length, error``. A folder that cannot be listed is a
row with its error, not a loss. ``read_files`` then reads the contents, spread
by path, so a folder that holds most of the files is read by many tasks.

The root may be a local (shared) folder or any address that pyarrow's file
systems open (``hdfs://``, ``s3://``, ``gs://``). Folders behind a symbolic
link are not entered; links to files are files.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "file_tree"
LISTING = "path string, length long, error string"
_BATCH_BYTES = 32 << 20


class LocalFolders:
    """Folders of the local or a mounted file system."""

    def __init__(self, prefix: str):
        self.prefix = prefix            # what stands before a path in Spark's names, "file:" or ""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        """(path, is a folder, length) of the entries of a folder."""
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True, 0
                elif entry.is_file():
                    yield entry.path, False, entry.stat().st_size
                elif entry.is_symlink() and not entry.is_dir():
                    yield entry.path, False, 0     # its target is gone: reading says so

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()


class ArrowFolders:
    """Folders of a store that pyarrow opens by its address."""

    def __init__(self, root: str):
        from pyarrow import fs
        self.fs, inner = fs.FileSystem.from_uri(root)
        self.prefix = root[:len(root) - len(inner)] if root.endswith(inner) else ""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        from pyarrow import fs
        for info in self.fs.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory:
                yield info.path, True, 0
            elif info.type == fs.FileType.File:
                yield info.path, False, info.size

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path) as f:
            return f.read()


def folders_of(root: str) -> tuple[LocalFolders | ArrowFolders, str]:
    """(folders, root inside them) of a qualified address."""
    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme:
        return LocalFolders(""), root
    if scheme == "file":
        return LocalFolders("file:"), "/" + rest.lstrip("/")
    folders = ArrowFolders(root)
    return folders, root[len(folders.prefix):]


class Subtrees(InputPartition):
    """Entries of the root that one task walks."""

    def __init__(self, entries: list[tuple[str, bool, int]]):
        super().__init__(None)
        self.entries = entries


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, tasks: int):
        self.root, self.pattern, self.tasks = root, pattern, tasks

    def partitions(self) -> list[Subtrees]:
        folders, inner = folders_of(self.root)
        entries = sorted(folders.entries(inner))
        return [Subtrees(entries[i::self.tasks]) for i in range(min(self.tasks, len(entries)))] or [Subtrees([])]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        folders, _ = folders_of(self.root)
        left = list(partition.entries)
        while left:
            path, is_folder, length = left.pop()
            if not is_folder:
                if fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], self.pattern):
                    yield folders.prefix + path, length, None
                continue
            try:
                left.extend(folders.entries(path))
            except OSError as e:
                yield folders.prefix + path, None, f"{type(e).__name__}: {e.strerror or e}"


class FileTreeSource(DataSource):
    """``spark.read.format("file_tree").option("pattern", "*.pdf").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FileTreeReader:
        if "path" not in self.options:
            raise ValueError("file_tree needs a root: load(root)")
        return FileTreeReader(self.options["path"], self.options.get("pattern", "*"),
                              max(1, int(self.options.get("tasks", "64"))))


def list_files(spark: SparkSession, root: str, pattern: str = "*", tasks: int | None = None) -> DataFrame:
    """``path, length, error`` of every file below ``root`` whose name matches ``pattern`` (case-sensitive)."""
    spark.dataSource.register(FileTreeSource)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(FORMAT).option("pattern", pattern).option("tasks", str(tasks)).load(root)


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """The listing with ``content``; a file that cannot be read has an error instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders, _ = folders_of(root)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.binary()))],
                names=["path", "length", "error", "content"])

        for batch in batches:
            rows, size = [], 0
            for path, length, error in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if error is None:
                    try:
                        content = folders.read(path[len(folders.prefix):])
                    except OSError as e:
                        error = f"{type(e).__name__}: {e.strerror or e}"
                rows.append((path, length, error, content))
                size += len(content or b"")
                if size >= _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    parts = 4 * listing.sparkSession.sparkContext.defaultParallelism
    spread = listing.select("path", "length", "error").repartition(parts, F.xxhash64("path"))
    return spread.mapInArrow(run, LISTING + ", content binary")
