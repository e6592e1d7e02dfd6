"""Runs of repeated words: maximal stretches with a smallest period, by power-of-two naming.

Level 0 names the words of a text; level k names each stretch of 2^k words by the pair of names of its halves (Karp, Miller
and Rosenberg), so that two stretches are equal exactly if their names are.  How far the text from two places agrees,
forwards or backwards, is found by descending levels: where the names agree, both places move on by 2^k.  A run of
period q has at least 2q words, so of the places 0, q, 2q, ... one and its successor lie in it; these pairs, n/q
for each q, are the candidates, and those whose words agree are extended.  No hashes, no suffix sorting.

Texts are independent, so there is no shuffle.  Texts of a batch are named together, in blocks of a bounded number of words;
a level names only stretches whose halves occur twice in their text, and naming ends where no name does.

Defined cases: null and wordless texts have no runs and the empty text's digest; repeated and null ids are rows like any
others; ties between runs of equal length go to the smallest start, then the smallest period; an empty table gives no rows;
a text of n words takes some 100 n bytes at most beside its own, candidates being made in blocks of ``PAIRS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import text_batches

#: A run has at least so many words, and at least two periods.
LEAST_LENGTH = 12
#: Words that are named together, and candidate pairs that are compared at once.
BLOCK_WORDS = 200_000
PAIRS = 1 << 20
#: Texts up to so many words share one grid of candidates, kept by the worker (some 4 MB).
_SHARED = 1 << 15

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]


def _grid(low: int, high: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every pair place, place + period within ``words``, for periods from ``low`` to before ``high``."""
    counts = [(words - 1) // q for q in range(low, high)]
    periods = np.repeat(np.arange(low, high), counts)
    steps = np.arange(len(periods)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
    return steps * periods, periods


@lru_cache(maxsize=32)
def _shared_grid(words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of a text of ``words``, ordered by the later place, so that a shorter text takes its beginning."""
    place, period = _grid(1, words // 2 + 1, words)
    order = np.argsort(place + period, kind="stable")
    place, period = place[order].astype(np.int32), period[order].astype(np.int32)
    return place, period, np.searchsorted(place + period, np.arange(words + 1))


def _pairs(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the candidates whose words agree."""
    n = len(words)
    if n <= _SHARED:
        place, period, ends = _shared_grid(1 << max(n - 1, 1).bit_length())
        place, period = place[: ends[n]], period[: ends[n]]
        same = np.flatnonzero(words[place] == words[place + period])
        yield place[same], period[same]
        return
    low = 1
    while low <= n // 2:
        high = low + max(1, PAIRS * low // n)
        place, period = _grid(low, min(high, n // 2 + 1), n)
        same = np.flatnonzero(words[place] == words[place + period])
        yield place[same], period[same]
        low = high


class Names:
    """Names of all stretches of 2^k words of some texts laid end to end; names differ between texts."""

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        """``words`` and ``text`` number each place's word and its text."""
        self.levels: list[np.ndarray] = []
        live, key = np.arange(len(words)), text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        while True:
            _, which, often = np.unique(key, return_inverse=True, return_counts=True)
            twice = often[which] > 1
            if not twice.any():
                return
            names = -1 - np.arange(len(words) + 1)  # a stretch without its like is named by its place
            live, which = live[twice], which[twice]
            names[live] = which
            self.levels.append(names)
            half = 1 << (len(self.levels) - 1)
            later = np.minimum(live + half, len(words))
            both = names[later] >= 0
            live = live[both]
            key = names[live] * len(words) + names[later[both]]

    def agree(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, or how many before them do; a < b."""
        a, b, far = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            if back:
                at = a - step
                same = (at >= 0) & (names[at] == names[b - step])
                a, b = a - step * same, b - step * same
            else:
                same = names[a] == names[b]
                a, b = a + step * same, b + step * same
            far += step * same
        return far


def runs_of(texts: list[np.ndarray], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """For each text, given as numbers of its words, its runs as rows (start, length, period) by start, then period."""
    starts = np.cumsum([0, *[len(t) for t in texts]])
    words = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    names = Names(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    found = [np.zeros((0, 3), np.int64)]

    def extend(places: list[np.ndarray], periods: list[np.ndarray]) -> None:
        a, q = np.concatenate(places).astype(np.int64), np.concatenate(periods).astype(np.int64)
        first, end = a - names.agree(a, a + q, back=True), a + q + names.agree(a, a + q)
        keep = end - first >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack([first, end, q], axis=1)[keep], axis=0))

    places: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    held = 0
    for start, text in zip(starts.tolist(), texts, strict=False):
        for place, period in _pairs(text) if len(text) >= least else ():
            places.append(place + start)
            periods.append(period)
            held += len(place)
            if held >= PAIRS:
                extend(places, periods)
                places, periods, held = [], [], 0
    if held:
        extend(places, periods)
    rows = np.unique(np.concatenate(found), axis=0)
    fresh = np.ones(len(rows), bool)  # of one stretch, the smallest period comes first
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], starts)
    return [rows[lo:hi] - [at, 0, 0] for lo, hi, at in zip(cuts[:-1], cuts[1:], starts.tolist(), strict=False)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if each run keeps its first period only, unless another run drops them."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]


def _blocks(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, words in enumerate(texts):
        held += len(words)
        if held >= BLOCK_WORDS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _described(words: list[bytes], runs: np.ndarray) -> tuple:
    head: tuple = (None,) * 4
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        head = (start, length, period, 1000 * length // period)
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    return (len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def describe(docs: DataFrame, *, id_col: str = "doc_id", words_of: Callable[[int | None, list[bytes]], list[bytes]] | None = None, text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """For each row doc_id, n_runs, its longest run, and digests of all runs and of the words that stay (``SCHEMA``).

    ``words_of(doc_id, words)``, if given, stands for a text's words.
    """
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t.split() for t in batch.column(1).to_pylist()]  # bytes fall apart at ASCII white space only
            if words_of is not None:
                texts = [words_of(i, w) for i, w in zip(ids, texts, strict=True)]
            rows: list[tuple] = []
            for lo, hi in _blocks(texts):
                found = runs_of(_numbered(texts[lo:hi]), least)
                rows += [(i, *_described(w, r)) for i, w, r in zip(ids[lo:hi], texts[lo:hi], found, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], names=_NAMES)

    return src.mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, *, text_col: str = "text", out_col: str = "collapsed", least: int = LEAST_LENGTH) -> DataFrame:
    """All columns of ``docs`` with the text whose runs keep one period each; a column of that name is replaced."""
    text_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text_col)
    schema = T.StructType([*src.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column(place).to_pylist()]
            out: list[str] = []
            for lo, hi in _blocks(texts):
                for words, runs in zip(texts[lo:hi], runs_of(_numbered(texts[lo:hi]), least), strict=True):
                    out.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
