"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and an exact top share by a score histogram.

Weights: the features of a text are its runs of one to three words; a feature's bucket is a CRC of its bytes.  Each task counts
the buckets of all its texts in one array and hands on at most ``BUCKETS`` sums, so a hot word, source or copy is summed
where it is read.  The logarithm of a bucket's share in the target over its share in the source is its gain; the array of
gains has a fixed size and is broadcast, and a second pass sums it over each text's features.

Draw: integer scores are counted in a histogram that is a tree of digits.  Its top has at most ``2**DIGIT`` nodes; below a
node whose preceding count is less than the number to draw, its children are counted and their preceding counts are suffix
sums among siblings, again at most ``2**DIGIT``.  There are as many levels as the scores' span needs.  The last level has
each surviving score with the number of higher ones: its rank offset.  Within a score, rows are numbered by doc_id; these windows
hold the rows of one score only, stream over sorted rows and can spill.

Defined cases: null and wordless texts have no features and weight 0, and are never drawn if ``least_words`` is over 0; a
null doc_id's noise is that of an empty id, and it comes before others in ties; rows that agree in doc_id and score are
ordered by weight and number of features, beyond which they are alike; an empty target gives gains by the source's counts alone; empty
tables give no rows; extra and clashing columns have no effect; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import UPPER_TO_LOWER_BYTES, materialize, text_batches

BUCKETS = 10_000
#: Words of a feature at most.
LONGEST = 3
#: Bits of a score that one level of the histogram tells apart.
DIGIT = 12

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text: bytes) -> tuple[np.ndarray, int]:
    """The bucket of every feature of a text in UTF-8, and its number of words."""
    words = _WORDS.findall(text.translate(UPPER_TO_LOWER_BYTES))
    later = [b" " + w for w in words]
    sums = list(map(crc32, words))
    all_sums = list(sums)
    for n in range(1, min(LONGEST, len(words))):  # a CRC goes on from that of the beginning
        sums = list(map(crc32, later[n:], sums))
        all_sums += sums
    return np.array(all_sums, np.int64) % BUCKETS, len(words)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts, summed in each task before the shuffle."""
    text_batches(texts.sparkSession)
    src = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(feature_buckets(text)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return src.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, *, text_col: str = "text", target_text: str = "text") -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    counts = []
    for texts, column in ((source, text_col), (target, target_text)):
        n = np.zeros(BUCKETS, np.float64)
        for bucket, many in bucket_counts(texts, column).collect():  # at most BUCKETS rows
            n[bucket] = many
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                buckets, n_words = feature_buckets(text)
                rows.append((n_words, len(buckets), int(known[buckets].sum())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    rows = src.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def rank_offsets(scores: DataFrame, wanted: int, lowest: int, highest: int) -> DataFrame:
    """(score, before): each score that has fewer than ``wanted`` rows above it, and how many those are."""
    levels = max(1, -(-(highest - lowest).bit_length() // DIGIT))
    counts = materialize(scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.col("score") - lowest), "resampling-histogram")
    found = None
    for level in range(levels - 1, -1, -1):
        nodes = counts.select(F.shiftright("place", DIGIT * level).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n")).withColumn("parent", F.shiftright("node", DIGIT))
        above = Window.partitionBy("parent").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
        if found is not None:  # only below nodes that are not yet decided
            nodes = nodes.join(found.select(F.col("node").alias("parent"), F.col("before").alias("base")), "parent")
        nodes = nodes.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)) + (F.col("base") if found is not None else F.lit(0)))
        found = materialize(nodes.where(F.col("before") < wanted).select("node", "before"), f"resampling-level-{level}")
    return found.select((F.col("node") + lowest).alias("score"), "before")


def draw(scored: DataFrame, *, percent: int = 5, least_words: int = 20) -> DataFrame:
    """The columns doc_id, n_features, weight, score and rank of every row of ``scored``, which must be written; undrawn rows have no rank."""
    result = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= least_words)
    told = able.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    wanted = percent * told["n"] // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*result, none)
    offsets = rank_offsets(able.select("score"), wanted, told["low"], told["high"])
    cutoff = offsets.agg(F.min("score").alias("score")).first()["score"]
    within = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    over = able.where(F.col("score") >= cutoff).join(offsets, "score").withColumn("rank", F.col("before") + F.row_number().over(within))
    over = over.select(*result, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    under = scored.where((F.col("n_words") < least_words) | (F.col("score") < cutoff)).select(*result, none)
    return over.unionByName(under)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every row's doc_id, n_features, weight, score, and its rank if it is among the highest ``percent`` of those with enough words."""
    gain = gains(docs, target, text_col=text_col, target_text=target_text)
    scored = materialize(weighted(docs, gain, id_col=id_col, text_col=text_col, seed=seed), "resampling-scores")
    return draw(scored, percent=percent, least_words=least_words)
