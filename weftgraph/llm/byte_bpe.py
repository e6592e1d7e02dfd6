"""Byte-level BPE by recursive DuckDB queries, one in-process database per Python worker.

A text falls into words by the vocabulary's pattern.  The distinct words of a block become token-position rows
(word, place, token), starting from single bytes; a recursive query joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of least rank, until no word has a pair that merges.  Decoding
joins ids with the vocabulary and aggregates the bytes in order of their places.  Both run over distinct words
only; a worker remembers words it has seen, within a bound, so the work follows the vocabulary in use rather
than the number of rows, and a group of copies costs no more than one of them.

Words longer than ``LONG`` bytes (a choice of plan, with equal ids) contract every non-overlapping occurrence of their least-ranked pair in one step,
which gives the same ids (a merge never makes a pair of lower rank) in far fewer steps.

Defined cases: null counts as empty; an empty text has no ids and decodes to no bytes; repeated rows and null
doc_ids are encoded like any others; an empty table gives no rows; ids outside the vocabulary are an error when
decoding; extra and clashing columns have no effect.
"""

from __future__ import annotations

import atexit
import base64
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import text_batches

#: Fixed values of the published byte-level vocabulary: the pattern of its words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words contracted by one recursive query, and the bytes they have together at most (but for a single word).
BLOCK_WORDS, BLOCK_BYTES = 40_000, 400_000
#: Distinct words that a worker remembers.
REMEMBERED = 1_500_000
LONG = 256
#: Memory of one database; longer sorts spill to the worker's folder.
DATABASE_MEMORY = "256MB"

# Positions are unique over all words, so one ordered pass finds every neighbour.
_CONTRACT = """
WITH RECURSIVE step(w, p, t, more) AS (
  SELECT w, p, t, true FROM tokens
  UNION ALL
  (WITH pairs AS (
     SELECT w, p, t, lead(t) OVER win AS t2, lead(w) OVER win AS w2, lag(p) OVER win AS before
     FROM step WHERE more WINDOW win AS (ORDER BY p)),
   ranked AS (SELECT pairs.*, m.rank FROM pairs LEFT JOIN merges m ON w = w2 AND m.pair = pairs.t::BIGINT * 4294967296 + pairs.t2),
   best AS (SELECT w, min(rank::BIGINT * 4294967296 + p) AS b FROM ranked WHERE rank IS NOT NULL GROUP BY w)
   SELECT r.w, r.p, CASE WHEN r.p = b % 4294967296 THEN (b // 4294967296)::INT ELSE r.t END, b IS NOT NULL
   FROM ranked r LEFT JOIN best USING (w) WHERE b IS NULL OR before IS NULL OR before <> b % 4294967296)
)
SELECT w, p, t FROM step WHERE NOT more ORDER BY w, p
"""

# Every second pair of a run of overlapping least-ranked pairs, from its left end, is contracted.
_CONTRACT_LONG = """
WITH RECURSIVE step(n, w, p, t, more) AS (
  SELECT 0, w, p, t, true FROM tokens
  UNION ALL
  (WITH pairs AS (
     SELECT n, w, p, t, lead(t) OVER win AS t2, row_number() OVER win AS i
     FROM step WHERE more WINDOW win AS (PARTITION BY w ORDER BY p)),
   ranked AS (SELECT pairs.*, m.rank FROM pairs LEFT JOIN merges m ON m.pair = pairs.t::BIGINT * 4294967296 + pairs.t2),
   best AS (SELECT *, min(rank) OVER (PARTITION BY w) AS b FROM ranked),
   runs AS (SELECT *, i - row_number() OVER (PARTITION BY w, rank = b ORDER BY i) AS run FROM best),
   takes AS (
     SELECT *, coalesce(rank = b, false) AND row_number() OVER (PARTITION BY w, rank = b, run ORDER BY i) % 2 = 1 AS takes FROM runs),
   after AS (SELECT *, lag(takes) OVER (PARTITION BY w ORDER BY i) AS gone FROM takes)
   SELECT n + 1, w, p, CASE WHEN takes THEN b ELSE t END, b IS NOT NULL FROM after WHERE gone IS NULL OR NOT gone)
)
SELECT w, p, t FROM step WHERE NOT more ORDER BY w, p
"""

_DECODE = """
SELECT w, string_agg(v.hex, '' ORDER BY p) AS hex
FROM sequences s LEFT JOIN vocabulary v USING (id)
GROUP BY w HAVING count(v.hex) = count(*) ORDER BY w
"""

#: Texts of Latin letters and ASCII, whose words the standard library's faster expression finds.
_LATIN, _MARKS, _SPACES = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-/:-@\[-`{-~", r"\t-\r "
_PLAIN = re.compile(f"[{_LATIN}{_MARKS}{_SPACES}0-9]*")
_PLAIN_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BytePairs:
    """Encoder and decoder of one vocabulary over an in-process database."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        ranks = read_ranks(path)
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._pattern = regex.compile(PATTERN)
        spill = tempfile.mkdtemp(prefix="weftgraph-bpe-")  # the worker's own sorts, as Spark's own spills; no other process reads it
        atexit.register(shutil.rmtree, spill, ignore_errors=True)
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DATABASE_MEMORY, "temp_directory": spill})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self._table("merges", pair=pa.array(left << 32 | right), rank=pa.array(rank.astype(np.int32)))
        self._table("vocabulary", id=pa.array(ranks.values(), pa.int64()), hex=pa.array([t.hex() for t in ranks]))
        self._known: dict[str, tuple[bytes, bytes]] = {}

    def _table(self, name: str, **columns: pa.Array) -> None:
        self._db.register("incoming", pa.table(columns))
        self._db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self._db.unregister("incoming")

    def _contract(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """Ids of each word, none of them empty."""
        sizes = np.array([len(w) for w in words])
        places = np.arange(sizes.sum())
        singles = self._byte[np.frombuffer(b"".join(words), np.uint8)]
        self._table("tokens", w=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)), p=pa.array(places), t=pa.array(singles))
        rows = self._db.execute(query).fetchnumpy()
        return np.split(np.asarray(rows["t"], np.int64), np.searchsorted(np.asarray(rows["w"]), np.arange(1, len(words))))

    def ids_of_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, each by itself."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [i for i, e in enumerate(encoded) if len(e) > LONG]
        short = [i for i, e in enumerate(encoded) if 0 < len(e) <= LONG]
        for query, those in ((_CONTRACT, short), (_CONTRACT_LONG, long)):
            block, size = [], 0
            for k, i in enumerate(those):
                block.append(i)
                size += len(encoded[i])
                if len(block) >= BLOCK_WORDS or size >= BLOCK_BYTES or k + 1 == len(those):
                    for j, ids in zip(block, self._contract([encoded[j] for j in block], query), strict=True):
                        out[j] = ids
                    block, size = [], 0
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of sequences of ids."""
        out: list[bytes] = [b""] * len(sequences)
        full = [i for i, s in enumerate(sequences) if len(s)]
        for at in range(0, len(full), BLOCK_WORDS):
            some = full[at : at + BLOCK_WORDS]
            sizes = np.array([len(sequences[i]) for i in some])
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self._table("sequences", w=pa.array(np.repeat(np.arange(len(some), dtype=np.int32), sizes)), p=pa.array(places), id=pa.array(np.concatenate([sequences[i] for i in some])))
            found = self._db.execute(_DECODE).fetchnumpy()["hex"]
            if len(found) != len(some):
                raise ValueError("an id is not in the vocabulary")
            for i, text in zip(some, found.tolist(), strict=True):
                out[i] = bytes.fromhex(text)
        return out

    def _learn(self, words: list[str]) -> None:
        """Remember each word's ids and what they decode to."""
        for at in range(0, len(words), BLOCK_WORDS):
            some = words[at : at + BLOCK_WORDS]
            ids = self.ids_of_words(some)
            for w, i, d in zip(some, ids, self.decode(ids), strict=True):
                self._known[w] = (i.astype("<u4").tobytes(), d)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, the bytes that these ids decode to) of each text."""
        words = [_PLAIN_WORDS.findall(t) if _PLAIN.fullmatch(t) else self._pattern.findall(t) for t in texts]
        known = self._known
        distinct = set().union(*words)
        missing = distinct.difference(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = distinct
        self._learn(list(missing))
        out = []
        for ws in words:
            both = [known[w] for w in ws]
            out.append((b"".join([b[0] for b in both]), b"".join([b[1] for b in both])))
        return out


_open: dict[str, BytePairs] = {}


def pairs(path: str) -> BytePairs:
    """The worker's database for a vocabulary."""
    if path not in _open:
        _open[path] = BytePairs(path)
    return _open[path]


def _blocks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary: what the ids decode to)."""
    return _run(docs, ranks_path, id_col, text_col, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]), False)


def encode_digests(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: as ``encode``, with digests made where the ids are."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _run(docs, ranks_path, id_col, text_col, schema, True)


def _run(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, schema: T.StructType, digests: bool) -> DataFrame:
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = pairs(ranks_path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                found = coder.encode(texts[lo:hi])
                if digests:
                    columns = [pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([sha256(i).hexdigest() for i, _ in found]), pa.array([sha256(d).hexdigest() for _, d in found])]
                else:
                    columns = [pa.array([np.frombuffer(i, "<i4") for i, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), *columns], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` plus the bytes that an array of ids decodes to (null for null); ``out`` is replaced."""
    text_batches(rows.sparkSession)
    src = rows.drop(out)
    schema = T.StructType([*src.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pairs(ranks_path)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            found = coder.decode([np.array(i or [], np.int64) for i in ids])
            made = pa.array([None if i is None else d for i, d in zip(ids, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return src.mapInArrow(run, schema)
