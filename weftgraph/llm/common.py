"""Shared pieces of the training-data operators: how tables are kept and read, bounded samples, Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import ship
from weftgraph.storage import shared_path, written

#: An Arrow batch of whole texts ends at so many rows or bytes, whichever comes first; a longer text is a batch by itself.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = "1000", "33554432"
_BATCH_CONF, _BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

#: A-Z to a-z, for ``bytes.translate``.
UPPER_TO_LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

shared_dir = shared_path
materialize = written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Make the package known to Python workers and bound the Arrow batches that carry whole texts.

    The bounds hold for the session, as plans run after they are built; they change no result, and ``batch_rows`` sets
    others for a while.
    """
    ship(spark)
    spark.conf.set(_BATCH_CONF, TEXT_BATCH_ROWS)
    spark.conf.set(_BYTES_CONF, TEXT_BATCH_BYTES)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns used inside, that no column of ``df`` has, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other Arrow batches for the jobs that are run inside."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def lettered_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case; none of a null text."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")  # a tenth of the time of extracting each word


def crc_bucket(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as remainder 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The distinct rows with the ``most`` smallest hashes of ``key``, for fitting.

    A first pass estimates the number of distinct keys; then only rows whose hash lies under four times the wanted share
    leave a scan, each once.  So about ``4 * most`` rows are shuffled or sorted in all, however many rows, tasks or
    copies of one row there are.
    """
    keys = rows.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("_place", place).where(F.col("_place") * F.lit(float(keys)) < F.lit(4.0 * most)).distinct()
    return near.orderBy("_place", *rows.columns).limit(most).drop("_place")
