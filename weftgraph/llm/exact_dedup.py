"""Exact deduplication against a persistent digest index, in DataFrame and SQL operations only.

The index is a folder: a manifest (number of buckets, type of ids, version) and, for each version, Parquet files bucketed
and sorted by digest.  A session that opens the folder registers the files as a table at their place, so the index outlives the
session that made it.  A batch is reduced to one row per digest with partial aggregation (a group of copies with a third of
all rows shrinks before any shuffle), anti-joined with the index by sort-merge (the index side is not shuffled) and appended.
``decide`` tells every row which row stays, by a join that Spark can split where a digest is hot.

The first batch that has a text names the row that stays; of equal texts in a batch that is the largest id.  So where the
largest of all shall stay, batches come in descending order of ids, as in ``dedup`` with ``batches`` over 1.

Appending is idempotent: a batch that is given again, after a failure or by mistake, finds its digests known and adds nothing.
``compact`` writes a new version with one file a bucket, which is read in order, and then names it in the manifest; a crash
before that leaves the old version in force.  One writer appends at a time.

Defined cases: a null text counts as empty; equal means identical, after ``normalize`` if one is given; null ids never win over
others; rows that repeat the winning id and text all count as kept; ``group_size`` counts the equal rows of the table that is
decided; an empty table gives no rows; texts of any length are digested whole and only digests move; extra and
clashing columns have no effect on the result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import materialize, shared_dir

#: Least number of buckets of a new index.  By default it has as many as a shuffle has partitions, which the cluster
#: sets for its data; a bucket of a 100 TB corpus (some 3e10 digests of 48 bytes) in 4,096 has about 350 MB.
LEAST_BUCKETS = 16
#: A bucket's order is only used if this is set while a plan is made; it holds where each bucket has one file.
_IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id and the 32-byte SHA-256 of each row's text in UTF-8."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2((normalize(text) if normalize else text).cast("binary"), 256)).alias("digest"))


@contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_IN_ORDER)
    spark.conf.set(_IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(_IN_ORDER, before)


class DigestIndex:
    """Rows (digest, keep_id, batch) below a folder that all executors see; opened if it is there, else made by the first batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._wanted = buckets
        self._about = self._manifest()
        if self._about:
            self._register()

    # the manifest

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _manifest(self) -> dict | None:
        files, place = self._place("manifest.json")
        return json.loads(self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0]) if files.exists(place) else None

    def _name_version(self, **about: object) -> None:
        """Put a manifest in force: written beside the old one, then moved over it."""
        files, new = self._place(f"manifest-{uuid.uuid4().hex}")
        out = files.create(new)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._place("manifest.json")[1], over)
        self._about = about

    # the table

    @property
    def buckets(self) -> int:
        return self._about["buckets"]

    @property
    def table(self) -> str:
        return f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{self._about['version']}"

    def _create(self, table: str, version: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files stay
        self.spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id {self._about['id_type']}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{version}'"
        )

    def _register(self) -> None:
        self._create(self.table, self._about["version"])

    def exists(self) -> bool:
        return self._about is not None

    def create(self, id_type: T.DataType) -> None:
        """The index without rows, unless it exists."""
        if self._about is None:
            buckets = self._wanted or max(LEAST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            self._name_version(buckets=buckets, id_type=id_type.simpleString(), version=1)
            self._register()

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    # what it is for

    def unknown(self, batch: DataFrame) -> DataFrame:
        """Rows (digest, ...) whose digest the index does not have: a sort-merge anti-join."""
        return batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, docs: DataFrame, *, batch_id: str | None = None, **columns: object) -> None:
        """Index the texts of ``docs`` that are new, each under the largest id that has it there."""
        rows = digests(docs, **columns)
        self.create(rows.schema["doc_id"].dataType)
        # written first, as the optimizer would else move the anti-join below the aggregation and shuffle every row
        batch = materialize(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest-batch")
        with _ordered_buckets(self.spark):
            fresh = materialize(self.unknown(batch).select("digest", "keep_id", F.lit(batch_id or uuid.uuid4().hex).alias("batch")), "digest-fresh")
        self._write(fresh, self.table)

    def decide(self, docs: DataFrame, **columns: object) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row whose text is indexed."""
        rows = digests(docs, **columns)
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        with _ordered_buckets(self.spark):
            winners = materialize(sizes.join(self.rows().select("digest", "keep_id").hint("merge"), "digest"), "digest-winners")
        return rows.join(winners.hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def compact(self) -> None:
        """Rewrite the index with one sorted file a bucket."""
        old, version = self.table, self._about["version"] + 1
        files, place = self._place(f"v{version}")
        files.delete(place, True)  # of a compaction that did not end
        new = old.rpartition("_")[0] + f"_{version}"
        self._create(new, version)
        # as plain files: of a bucketed scan the planner takes the repartitioning for done, and then scans without buckets
        self._write(self.spark.read.schema(self.rows().schema).parquet(f"{self.path}/v{version - 1}"), new)
        self._name_version(**self._about | {"version": version})
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        files, place = self._place(f"v{version - 1}")
        files.delete(place, True)

    def drop(self) -> None:
        """The index and its files."""
        if self._about:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            files, place = self._place("")
            files.delete(place, True)
            self._about = None


def dedup(docs: DataFrame, *, index: DigestIndex | None = None, batches: int = 1, **columns: object) -> DataFrame:
    """Each row of ``docs`` with the row that stays, by an index to which ``docs`` are appended.

    With ``batches`` they are appended in parts of descending ids, rows without an id last.  Without an index one is made for
    this call and dropped again, as the result reads only written tables.
    """
    own = index or DigestIndex(docs.sparkSession, shared_dir(docs.sparkSession, "digest-index"))
    try:
        for part in _descending(docs, columns.get("id_col", "doc_id"), batches):
            own.append(part, **columns)
        return own.decide(docs, **columns)
    finally:
        if index is None:
            own.drop()


def _descending(docs: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """``docs`` in about equal parts by ranges of ids, the largest first and nulls last."""
    if batches < 2:
        return [docs]
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id_col, shares).alias("cuts")).first()["cuts"]
    if not cuts:
        return [docs]
    cuts = sorted(set(cuts), reverse=True)
    c = F.col(id_col)
    parts = [docs.where(c > cuts[0]), *[docs.where((c > low) & (c <= high)) for high, low in zip(cuts, cuts[1:], strict=False)]]
    return [*parts, docs.where(c.isNull() | (c <= cuts[-1]))]
