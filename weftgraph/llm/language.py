"""Language identification by string kernels: blended-spectrum n-gram presence, Nystrom landmarks, ridge regression.

The kernel of two texts is the cosine of their presence vectors of character n-grams of 1 to 3 letters (hashed
into ``DIMENSIONS`` places).  From a bounded sample, stratified by language, some texts are landmarks; the Nystrom
map turns a text's kernel values with the landmarks into features, and one ridge regression per language (one
versus the rest) is fitted on these.  Scoring multiplies a batch's presence matrix with the landmarks' and the
result with the regression's weights; every whole text counts, in blocks of bounded size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no learnable row every text is
``und``; rows whose language is null are not learnt from; rows that repeat an id and a text are learnt from once; ties
between languages go to the first by name; an empty table gives no rows; texts of any length are taken whole; extra and
clashing columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import crc_bucket, materialize, text_batches

DIMENSIONS = 8192
#: Rows learnt from, for each language at most; those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 500
#: Rows learnt from in all; with many languages each has its share of these, and one row at least.
SAMPLE_ROWS = 64_000
#: Texts that others are compared with, shared by all languages.
LANDMARKS = 128
RIDGE = 0.05
UNKNOWN = "und"
_BATCH = 256


def presence(text: str, out: np.ndarray) -> bool:
    """Mark the n-grams of a whole text in ``out``; whether the text has a letter."""
    lowered = text.lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.fromiter((c.isalpha() for c in set(lowered)), bool, count=len(set(lowered)))
    if not letters.any():
        return False
    alphabet = np.frombuffer("".join(set(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    order = np.argsort(alphabet)
    alphabet, letters = alphabet[order], letters[order]
    # everything that is not a letter is one mark, so that n-grams see the edges of words
    which = np.searchsorted(alphabet, points)
    c = np.where(letters[which], points, np.uint32(32)).astype(np.uint64)
    mask, shift = np.uint64(DIMENSIONS - 1), np.uint64(40)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3):
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        out[((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> shift) & mask] = 1
    return True


@dataclass
class KernelModel:
    """scores = (presence / norm) @ landmarks.T @ weights + bias, one column a language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, marks: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
        return (marks @ self.landmarks.T) / norm @ self.weights + self.bias


def fit_kernel(marks: np.ndarray, languages: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Nystrom features of the sample and ridge regression of +1 / -1 targets, all languages at once."""
    names = sorted(set(languages))
    x = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    mine = np.array(languages)
    picks: list[int] = []
    for name in names:  # landmarks are spread over the languages
        picks += np.flatnonzero(mine == name)[: max(1, landmarks // len(names))].tolist()
    land = x[picks]
    values, vectors = np.linalg.eigh((land @ land.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ land.T) @ root
    center = features.mean(axis=0)
    target = np.where(mine[:, None] == np.array(names)[None, :], 1.0, -1.0)
    z = features - center
    w = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(z.shape[1]) * np.trace(z.T @ z) / len(z) / z.shape[1], z.T @ (target - target.mean(axis=0)) / len(z))
    bias = target.mean(axis=0) - center @ w
    return KernelModel(names, land.astype(np.float32), (root @ w).astype(np.float32), bias.astype(np.float32))


_MARKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("marks", T.BinaryType())])


def _nearest(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """At most ``most`` rows of each language, the first in this order; limited in each task before the shuffle."""
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return numbered.where(F.col("_r") <= most).drop("_r")


def learning_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held_out: int = 1, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(id, lang, marks) of at most ``sample`` distinct rows of each language, and of about ``SAMPLE_ROWS`` in all.

    Ids with the smallest hashes are taken, each once a language and once a text: an id that a third of all rows have counts
    as one id, and its rows are told apart and limited in the tasks that read them.
    """
    text_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    able = named.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("id", modulus) != held_out))
    counted = materialize(able.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")), "language-counts")
    languages = counted.count()
    each = max(1, min(sample, SAMPLE_ROWS // max(1, languages)))
    small = F.broadcast if languages <= SAMPLE_ROWS else lambda df: df  # a row a language, and so many ids in all
    # rows far from the smallest hashes go before any shuffle: four times the sample stays, however common a language is
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    ids = able.select("id", "lang").join(small(counted), "lang").where(place * F.col("n") < 4.0 * each).select("id", "lang").distinct()
    chosen = _nearest(ids, each, place, "id")
    rows = able.join(small(chosen), ["id", "lang"], "left_semi").select("id", "lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, packed = [], [], []
            for id_, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = np.zeros(DIMENSIONS, np.uint8)
                if presence(text, marks):
                    ids.append(id_)
                    langs.append(lang)
                    packed.append(np.packbits(marks).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(packed, pa.binary())], names=_MARKS.names)

    return _nearest(rows.mapInArrow(run, _MARKS).distinct(), each, F.xxhash64("id"), "id", "marks")


def fit(docs: DataFrame, *, landmarks: int = LANDMARKS, **options: object) -> KernelModel | None:
    """Learn from rows with a language whose crc32 bucket is not the held-out one (``learning_sample``); None if there are none."""
    found = learning_sample(docs, **options).toPandas().sort_values(["lang", "marks", "id"])
    if found.empty:
        return None
    found = found.sample(frac=1.0, random_state=5)
    marks = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in found["marks"]]).astype(np.float32)
    return fit_kernel(marks, found["lang"].tolist(), landmarks=landmarks)


def predict(docs: DataFrame, model: KernelModel | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the language and a score from 0 to 1; columns of these names are replaced."""
    spark = docs.sparkSession
    text_batches(spark)
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts) if known else 0, _BATCH):
                marks = np.zeros((min(_BATCH, len(texts) - at), DIMENSIONS), np.float32)
                lettered = [i for i, t in enumerate(texts[at : at + _BATCH]) if t and presence(t, marks[i])]
                if lettered:
                    raw = known.scores(marks[lettered])
                    best = raw.argmax(axis=1)
                    odds = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                    for i, b, s in zip(lettered, best.tolist(), (1 / odds.sum(axis=1)).tolist(), strict=True):
                        langs[at + i], scores[at + i] = known.languages[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
