"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine (master ``local``) where the session names no shared folder, as in tests.
UNSET_DIR = "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder that every executor and the driver can see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = UNSET_DIR
    return f"{root.rstrip('/')}/weftgraph/{label}-{uuid.uuid4().hex}"


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread, innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def _outside_scopes() -> Iterator[None]:
    held, _local.scopes = _scopes(), []
    try:
        yield
    finally:
        _local.scopes = held


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows read from files, so that long iterations neither grow their plan nor depend on an executor."""
    path = shared_path(df.sparkSession, label)
    if _scopes():
        _scopes()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, told by the job that writes them."""
    told = Observation()
    table = written(df.observe(told, F.count(F.lit(1)).alias("n")), label)
    return table, told.get["n"]


def files_state(spark: SparkSession, *paths: str) -> str:
    """What tells whether files changed: the time of each path, and the number and size of the files below it."""
    conf, told = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(conf)
        below = files.getContentSummary(place)
        told.append(f"{path} {files.getFileStatus(place).getModificationTime()} {below.getFileCount()} {below.getLength()}")
    return " ".join(told)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it is there as a whole or not at all."""
    place, hidden = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, re.sub(r"([^/]*)$", r"_\1", path)))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(hidden, place)


class Kept:
    """Tables that are made once from files and used until the files change or ``drop`` is called; they outlive scopes.

    What was made of files that have changed is deleted when it is asked for anew.
    """

    def __init__(self) -> None:
        self._tables: dict[tuple[str, ...], tuple[str, object]] = {}
        self._lock = threading.RLock()  # what is kept may be made of what is kept

    def get(self, spark: SparkSession, name: str, sources: Sequence[str], make: Callable[[], Buckets | DataFrame]) -> Buckets | DataFrame:
        """What ``make`` gives for these source files: a table that it has written, or a DataFrame that is written here."""
        key = (spark.sparkContext.applicationId, name, *sources)
        with self._lock:
            state = files_state(spark, *sources)
            if key in self._tables and self._tables[key][0] == state:
                return self._tables[key][1]
            self._forget(spark, key)
            with _outside_scopes():
                made = make()
                made = made if isinstance(made, Buckets) else _Written(made)
            self._tables[key] = (state, made)
            return made

    def _forget(self, spark: SparkSession, key: tuple[str, ...]) -> None:
        if key in self._tables:
            old = self._tables.pop(key)[1]
            old.close()
            delete(spark, old.path)

    def drop(self, spark: SparkSession) -> None:
        """Delete all tables of this application."""
        with self._lock:
            for key in [k for k in self._tables if k[0] == spark.sparkContext.applicationId]:
                self._forget(spark, key)


class _Written:
    """A written DataFrame with the interface of ``Buckets`` for reading."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self._schema, self.path = df.sparkSession, df.schema, shared_path(df.sparkSession, "kept")
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    table = read

    def close(self) -> None:
        pass


#: What queries keep of the tables that they read.
KEPT = Kept()


class Buckets:
    """A table that grows by appending, bucketed and sorted by ``keys``, so that joins and aggregations on them do not shuffle it.

    With ``part``, rows of one value of that column lie apart and are read alone.  While it grows it is a table of the catalogue;
    once closed, its files are left.
    """

    def __init__(self, spark: SparkSession, label: str, keys: tuple[str, ...], part: str | None = None) -> None:
        self.spark, self.keys, self.part, self.path = spark, keys, part, shared_path(spark, label)
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name, self._schema = f"{re.sub(r'[^a-z0-9]', '_', label)}_{uuid.uuid4().hex}", None
        if _scopes():
            _scopes()[-1].append(self.path)

    def append(self, df: DataFrame) -> bool:
        """Add rows; whether there were any."""
        self._schema = self._schema or df.schema
        told = Observation()
        df = df.observe(told, F.count(F.lit(1)).alias("n"))
        writer = df.write.mode("append").option("path", self.path).bucketBy(self._buckets, *self.keys).sortBy(*self.keys)
        (writer if self.part is None else writer.partitionBy(self.part)).saveAsTable(self._name)
        return told.get["n"] > 0

    def table(self) -> DataFrame:
        return self.spark.table(self._name)

    def read(self) -> DataFrame:
        """The rows as plain files, also after ``close``."""
        return self.spark.read.schema(self._schema).parquet(self.path)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside are deleted at its end; whatever is to stay must have left them by then."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete(spark, path)
