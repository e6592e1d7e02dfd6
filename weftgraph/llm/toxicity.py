"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are its distinct lower-cased words and the words' prefixes of 4 to 6 letters.  On a bounded
sample of labelled texts, the features that tell toxic from clean texts best are kept; the model is
P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector shared by all ordered thresholds, so a text's
expected severity is the sum over k of P(grade > k).  Where labels are only toxic or not, toxic texts are graded
1 to ``GRADES`` by the share of their words that carry a kept feature (quantiles over the sample).

Defined cases: null and empty texts have no feature and are scored by the thresholds alone; with no toxic or no
clean sample row every severity is 0; labels that are null are not learnt from; a doc_id with several labels or
texts is learnt from each distinct pair; texts of any length are read whole where they lie; an empty table gives no
rows; extra and clashing columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import crc_bucket, hashed_sample, materialize, text_batches

#: Labelled rows learnt from at most, half of them toxic: those with the smallest hash of their id.
SAMPLE_ROWS = 4_000
#: Features with a weight.
FEATURES = 768
GRADES = 3
#: Texts (each once) a feature must occur in to be kept.
LEAST = 8
_WORD = re.compile(r"[^\W\d_]+")


def keys(word: str) -> list[str]:
    """Feature names of a lower-cased word: itself, and its prefixes with a mark."""
    return [word, *[word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class OrdinalModel:
    """Feature places, shared weights, and ordered thresholds."""

    places: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row a score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


class Scorer:
    """w . x of whole texts, with a bounded memory of words."""

    def __init__(self, model: OrdinalModel) -> None:
        self._model = model
        self._known: dict[str, tuple[int, ...]] = {}

    def places(self, text: str) -> set[int]:
        known, out = self._known, set()
        if len(known) > 400_000:
            known.clear()
        for w in set(words(text)):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(self._model.places[k] for k in keys(w) if k in self._model.places)
            if at:
                out.update(at)
        return out

    def score(self, text: str) -> float:
        at = self.places(text)
        return float(self._model.weights[sorted(at)].sum()) if at else 0.0


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, *, l2: float = 2e-3, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood; gaps between thresholds stay positive."""
    n, m = x.shape
    above = np.array([(y > k).mean() for k in range(grades)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(m), [start[0]], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, cuts = theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])
        s = (x @ w.astype(x.dtype)).astype(float)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -40, 40)))  # P(y <= k)
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        p = np.maximum(padded[rows, y + 1] - padded[rows, y], 1e-9)
        slope = padded * (1 - padded)
        hi, lo = slope[rows, y + 1] / p, slope[rows, y] / p  # d log p / d cut above, and - below
        gw = (x.T @ (hi - lo).astype(x.dtype)).astype(float) / n + l2 * w
        gc = np.zeros(grades)
        np.add.at(gc, y[y < grades], -hi[y < grades] / n)
        np.add.at(gc, y[y > 0] - 1, lo[y > 0] / n)
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(theta[m + 1 :])])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])


_KEYS = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("keys", T.ArrayType(T.StringType()))])
_MARKS = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("marks", T.BinaryType()), T.StructField("share", T.DoubleType())])


def text_keys(texts: DataFrame) -> DataFrame:
    """y, keys: the distinct feature names of each row of (y, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({k for w in set(words(t)) for k in keys(w)}) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], names=_KEYS.names)

    return texts.select("y", "t").mapInArrow(run, _KEYS)


def telling(counted: DataFrame, toxic: int, clean: int, features: int) -> DataFrame:
    """key, strong: the features that tell toxic from clean texts best, of rows (key, bad, good) that count texts."""
    lift = F.col("bad") / toxic * F.log(((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1)))
    strong = F.col("bad") / toxic > 5 * (F.col("good") + 0.5) / clean
    ranked = counted.where(F.col("bad") >= min(LEAST, toxic)).select("key", lift.alias("lift"), strong.alias("strong"))
    return ranked.where("lift > 0").orderBy(F.desc("lift"), "key").limit(features)


def text_marks(texts: DataFrame, places: dict[str, int], strong: set[str]) -> DataFrame:
    """y, marks (packed bits of the places that occur), share (of words with a strong feature) of each row of (y, t)."""
    model = OrdinalModel(places, np.zeros(len(places)), np.zeros(1))  # FEATURES names, pickled with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            marks, shares = [], []
            for text in batch.column("t").to_pylist():
                row, found = np.zeros(len(places), np.uint8), words(text)
                row[sorted(scorer.places(text))] = 1
                marks.append(np.packbits(row).tobytes())
                shares.append(sum(1 for w in found if strong.intersection(keys(w))) / max(1, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(marks, pa.binary()), pa.array(shares, pa.float64())], names=_MARKS.names)

    return texts.select("y", "t").mapInArrow(run, _MARKS)


def graded(y: np.ndarray, share: np.ndarray, grades: int) -> np.ndarray:
    """Grades from 0 to ``grades``; where labels are only 0 and 1, toxic rows are graded by quantiles of their share."""
    if y.max(initial=0) > 1:
        return np.minimum(y, grades)
    toxic = y > 0
    cuts = np.quantile(share[toxic], [(k + 1) / grades for k in range(grades - 1)])
    return np.where(toxic, 1 + np.searchsorted(cuts, share, side="left"), 0)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held_out: int = 0, sample: int = SAMPLE_ROWS, features: int = FEATURES, grades: int = GRADES) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows (half toxic) whose crc32 bucket is not the held-out one.

    Texts stay on the executors: one pass over the sample counts texts by feature, a second marks the chosen features,
    and only these bits and a share a text are collected.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = labels.select(F.col(id_col).alias("_id"), F.greatest(F.lit(0), F.col(label_col).cast("int")).alias("_y")).where(F.col("_id").isNotNull() & F.col(label_col).isNotNull() & (crc_bucket("_id", modulus) != held_out))
    chosen = hashed_sample(rows.where("_y > 0"), "_id", sample // 2).union(hashed_sample(rows.where("_y <= 0"), "_id", sample // 2))
    joined = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "_id")  # at most ``sample`` ids
    # an id that repeats, however often, is learnt from once a text
    once = joined.select("_id", F.col("_y").alias("y"), "t", F.xxhash64("t").alias("_h")).dropDuplicates(["_id", "y", "_h"])
    found = materialize(once, "toxicity-sample")
    named = found.select("_id", "y", "_h").orderBy(F.xxhash64("_id"), "_id", "y", "_h").limit(sample)
    texts = found.join(F.broadcast(named), ["_id", "y", "_h"], "left_semi")
    n = texts.agg(F.count_if(F.col("y") > 0).alias("toxic"), F.count_if(F.col("y") <= 0).alias("clean")).first()
    flat = OrdinalModel({}, np.zeros(0), np.full(grades, 40.0))
    if not n["toxic"] or not n["clean"]:
        return flat
    exploded = text_keys(texts).select("y", F.explode("keys").alias("key"))
    counted = exploded.groupBy("key").agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good"))
    kept = telling(counted, n["toxic"], n["clean"], features).collect()  # ``features`` rows at most
    if not kept:
        return flat
    places = {r["key"]: i for i, r in enumerate(kept)}
    got = text_marks(texts, places, {r["key"] for r in kept if r["strong"]}).orderBy("y", "marks", "share").toPandas()
    x = np.stack([np.unpackbits(np.frombuffer(m, np.uint8), count=len(places)) for m in got["marks"]]).astype(np.float32)
    w, thresholds = fit_ordinal(x, graded(got["y"].to_numpy(np.int64), got["share"].to_numpy(float), grades), grades)
    return OrdinalModel(places, w, thresholds)


def grade(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus severity (expected grade), grade (most likely), p_toxic (P(grade > 0)), predicted (p_toxic >= 0.5)."""
    spark = docs.sparkSession
    text_batches(spark)
    made = ("severity", "grade", "p_toxic", "predicted")
    kept = [c for c in docs.columns if c not in made]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = spark.sparkContext.broadcast(model)  # FEATURES words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = Scorer(known)
        for batch in batches:
            scores = np.array([scorer.score(t) if t else 0.0 for t in batch.column(text_col).to_pylist()], float)
            p = known.exceed(scores)
            each = -np.diff(np.concatenate([np.ones((len(scores), 1)), p, np.zeros((len(scores), 1))], axis=1), axis=1)
            columns = [pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return src.mapInArrow(run, schema)
