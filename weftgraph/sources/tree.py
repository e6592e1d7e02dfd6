"""S1, S2, ST1: a tree of source files as a Python data source, to be read as a table or as a stream of changes.

``spark.read.format("source_tree")`` plans tasks by folders: the planner keeps names of folders and their numbers of files, and
each task lists its own folders again and reads their files.  A folder of very many files is dealt to several tasks by a hash of
the names.  ``spark.readStream.format("source_tree")`` hands on files that were created or modified: an offset is a time,
``settle`` milliseconds before the tree was looked at, and a batch holds what changed after one and not after the next.  So a
file that changes while a batch is made falls into a later one, deletions bring nothing back, and a restart goes on from the
last offset.  ``settle`` must cover the differences between the clocks that stamp files and the planner's; where it is made
longer between two starts, files may come again.

Only the planner and the tasks touch files, through ``pyarrow.fs``; a file that goes before it is read is left out.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from weftgraph.session import ship

NAME = "source_tree"
COLUMNS = "path string, source string, checksum string, modified long"
#: Files that one task reads, about.
FILES_A_TASK = 500
#: Folders that hold no sources, of the importer and of the watcher.
SKIPPED = ("__pycache__", ".git", ".venv", "node_modules", ".tox", ".mypy_cache")
SKIPPED_BEFORE = ("__pycache__", "node_modules", ".venv", "venv")


@dataclass(frozen=True)
class Tree:
    """Which files below a root count, and how they are listed."""

    uri: str
    pattern: str
    skipped: frozenset[str]
    dot_folders: bool

    @classmethod
    def of(cls, options: dict) -> Tree:  # keys are in lower case
        if not options.get("path"):
            raise ValueError("load() needs the path of a folder")
        root = options["path"]
        skipped = options.get("skipped", ",".join(SKIPPED))
        return cls(root if "://" in root else f"file://{root}", options.get("pattern", "*.py"), frozenset(s for s in skipped.split(",") if s), options.get("dotfolders", "true").lower() == "true")

    def opened(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.uri)
        return system, base.rstrip("/")

    def files(self, system: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        """The files of one folder; none of a folder that is gone."""
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatchcase(info.base_name, self.pattern):
                yield info

    def walk(self) -> Iterator[tuple[str, list[fs.FileInfo]]]:
        """Each folder's path and files."""
        system, base = self.opened()
        open_folders = [base]
        while open_folders:
            folder = open_folders.pop()
            files = []
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.Directory:
                    if info.base_name not in self.skipped and (self.dot_folders or not info.base_name.startswith(".")):
                        open_folders.append(info.path)
                elif info.type == fs.FileType.File and fnmatchcase(info.base_name, self.pattern):
                    files.append(info)
            yield folder, files


def _changed(info: fs.FileInfo, start: int | None, end: int | None) -> bool:
    return end is None or start < (info.mtime_ns or 0) <= end


@dataclass
class Folders(InputPartition):
    """Some folders, or one share of one; files changed after ``start`` and not after ``end``."""

    folders: list[str]
    share: int
    shares: int
    start: int | None
    end: int | None

    def __post_init__(self) -> None:
        super().__init__(None)


def _dealt(counted: list[tuple[str, int]], start: int | None = None, end: int | None = None) -> list[Folders]:
    tasks: list[Folders] = []
    held: list[str] = []
    n = 0
    for folder, files in counted:
        shares = -(-files // FILES_A_TASK)
        if shares > 1:
            tasks += [Folders([folder], k, shares, start, end) for k in range(shares)]
        elif files:
            held.append(folder)
            n += files
            if n >= FILES_A_TASK:
                tasks.append(Folders(held, 0, 1, start, end))
                held, n = [], 0
    return [*tasks, Folders(held, 0, 1, start, end)] if held else tasks


def _read(tree: Tree, part: Folders) -> Iterator[pa.RecordBatch]:
    system, base = tree.opened()
    for folder in part.folders:
        for info in tree.files(system, folder):
            if crc32(info.base_name.encode()) % part.shares != part.share or not _changed(info, part.start, part.end):
                continue
            try:
                with system.open_input_stream(info.path) as stream:
                    data = stream.read()
            except FileNotFoundError:
                continue
            text = data.decode("utf-8", "replace")
            columns = [pa.array([info.path[len(base) + 1 :]]), pa.array([text]), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([info.mtime_ns or 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "source", "checksum", "modified"])


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tree = Tree.of(options)

    def partitions(self) -> list[Folders]:
        return _dealt([(folder, len(files)) for folder, files in self.tree.walk()]) or [Folders([], 0, 1, None, None)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return _read(self.tree, partition)


class TreeStream(DataSourceStreamReader):
    """Files changed between two times."""

    def __init__(self, options: dict) -> None:
        self.tree = Tree.of(options)
        self.settle = int(options.get("settle", 300)) * 1_000_000
        self.until: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802  the API's name
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new offset at the start, when the last one is not known here, and afterwards only where something changed."""
        now = time.time_ns() - self.settle
        if self.until is None or any(_changed(i, self.until, now) for _, files in self.tree.walk() for i in files):
            self.until = now
        return {"until": self.until}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        low, high = start["until"], end["until"]
        return _dealt([(folder, sum(_changed(i, low, high) for i in files)) for folder, files in self.tree.walk()], low, high)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return _read(self.tree, partition)


class SourceTree(DataSource):
    """Options: path, pattern (*.py), skipped (folder names, with commas), dotFolders (true), settle (ms, streams only)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TreeStream:  # noqa: N802
        return TreeStream(dict(self.options))


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SourceTree)


def source_tree(spark: SparkSession, root: str, *, pattern: str = "*.py", skipped: tuple[str, ...] = SKIPPED, dot_folders: bool = True) -> DataFrame:
    """S1 (as it is) and S2 (``skipped=SKIPPED_BEFORE, dot_folders=False``): path, source, checksum, modified of each file."""
    _registered(spark)
    return spark.read.format(NAME).option("pattern", pattern).option("skipped", ",".join(skipped)).option("dotFolders", str(dot_folders)).load(root)


def source_changes(spark: SparkSession, root: str, *, pattern: str = "*.py", skipped: tuple[str, ...] = SKIPPED_BEFORE, dot_folders: bool = False, settle: int = 300) -> DataFrame:
    """ST1: a stream of the files that are created or modified below a root, with their content; first of all that are there."""
    _registered(spark)
    return spark.readStream.format(NAME).option("pattern", pattern).option("skipped", ",".join(skipped)).option("dotFolders", str(dot_folders)).option("settle", str(settle)).load(root)
