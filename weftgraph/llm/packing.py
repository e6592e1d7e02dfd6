"""Best-fit packing of token sequences: vector bins with token, document-count and attention-cost capacities.

A document's ids are cut into pieces of at most ``capacity`` tokens; pieces are then placed, longest first
within a block, into the open bin that fits best.  A bin has three residual capacities (tokens, documents,
attention cost = sum of squared piece lengths) and a piece may enter only where all three suffice.  Among
those, ``rule="norm"`` takes the bin whose residual vector after placement has the least weighted norm, and
``rule="dot"`` the bin whose residual has the greatest weighted dot product with the piece.

Pieces, not ids, are shuffled (about 50 bytes each), hashed evenly on the piece itself, so a source or
a group of copies with a third of all rows spreads over all tasks.  A task keeps only residuals of open bins,
never rows of earlier blocks.

Defined cases: a null text counts as empty; an empty text still has its end id and makes one piece of length 1;
null and repeated doc_ids are packed like any others (rows are never merged); an empty table gives no rows; texts of any
length are taken whole, one at a time; a task that runs again, after a lost executor too, places its pieces as before;
columns named like the results (``sequence_id``, ``offset``) are replaced, others pass through.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import text_batches

CAPACITY = 2048
#: Pieces that are sorted and placed together.
BLOCK = 16384
#: Open bins carried from one block to the next; the emptiest ones stay open.
CARRIED = 4096
#: Bytes of words and their ids that a Python worker remembers; one range of texts may go beyond them.
REMEMBERED_BYTES = 67_108_864
#: About what a remembered word costs besides its own two objects, in a dictionary.
_ENTRY = 104
#: Characters of texts that are encoded together, and new words that the tokenizer gets at once.
ENCODED_TOGETHER, LEARNT_TOGETHER = 500_000, 8_000

#: White space of Unicode, without the four control characters that str.split() also takes.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Latin letters that are single code points in every normal form, and whose lower case is another of them.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e"
_MARKS = r"!-/:-@\[-`{-~"
#: Texts that fall into the tokenizer's own words by ``_RUNS``: Latin letters and ASCII.
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9\t-\r ]*")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{_MARKS}]+")
#: What the tokenizer appends to the last letter of a word.
_WORD_END = "</w>"
_CONTROLS = re.compile("[\x1c-\x1f]")

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a text by a tokenizer whose words never cross white space, with memories bounded in bytes.

    A text of Latin letters and ASCII falls into lower-cased runs, which are the tokenizer's own words; new runs
    are encoded many at once, and cut apart at the tokens that end a word.  Any other text falls into what lies
    between white space, each encoded by itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self._known: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}
        self.held = 0  # bytes in both memories

    def _learn_runs(self, runs: list[str]) -> None:
        lines = [runs[at : at + 500] for at in range(0, len(runs), 500)]
        for line, e in zip(lines, self._tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(stops) != len(line):
                raise ValueError("the tokenizer does not mark the ends of words")
            data, start = ids.tobytes(), 0
            for run, stop in zip(line, stops.tolist(), strict=True):
                self._runs[run] = ids_of = data[start:stop]
                self.held += _ENTRY + getsizeof(run) + getsizeof(ids_of)
                start = stop

    def _learn_words(self, words: list[str]) -> None:
        for w, e in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self._known[w] = ids_of = np.array(e.ids, "<u4").tobytes()
            self.held += _ENTRY + getsizeof(w) + getsizeof(ids_of)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [bool(_PLAIN.fullmatch(t)) for t in texts]
        words = [_RUNS.findall(t.lower()) if p else _SPACE.split(t) if _CONTROLS.search(t) else t.split() for t, p in zip(texts, plain, strict=True)]
        if self.held > REMEMBERED_BYTES:
            self._runs.clear()
            self._known.clear()
            self.held = 0
        for memory, learn, which in ((self._runs, self._learn_runs, True), (self._known, self._learn_words, False)):
            new = list(set().union(*[ws for ws, p in zip(words, plain, strict=True) if p is which]).difference(memory))
            for at in range(0, len(new), LEARNT_TOGETHER):
                learn(new[at : at + LEARNT_TOGETHER])
        runs, known = self._runs, self._known
        return [b"".join([runs[w] for w in ws] if p else [known[w] for w in ws]) for ws, p in zip(words, plain, strict=True)]


def _encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep some MB of its own
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _runs(texts: list[str], most: int = ENCODED_TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_pieces(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids plus ``end_id`` into pieces: doc_id, piece, start, length, ids_crc32 [, ids].

    Only documents longer than ``capacity`` are cut; each of their pieces but the last has ``capacity`` ids.
    ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit integers.
    """
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.BinaryType())
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _runs(texts):
                rows: list[list] = [[], [], [], [], [], []]
                for doc_id, ids in zip(doc_ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(value)
                arrays = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return src.mapInArrow(cut, schema)


class Bins:
    """Residual capacities of the open bins, as three arrays."""

    def __init__(self, capacity: int, max_docs: int, max_attention: int, rule: str, weights: tuple[float, float, float]) -> None:
        if rule not in ("norm", "dot"):
            raise ValueError(f"rule must be norm or dot, not {rule!r}")
        self.full = np.array([capacity, max_docs, max_attention], np.int64)
        self.scale = np.array(weights, np.float64)
        self.rule, self.made, self.n = rule, 0, 0
        self.left = np.zeros((3, 1024), np.int64)
        self.name = np.zeros(1024, np.int64)

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it of a piece of this length."""
        need = (length, 1, length * length)
        if length > self.full[0] or need[2] > self.full[2]:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        tokens, docs, attention = self.left[:, : self.n]
        fits = np.flatnonzero((tokens >= length) & (docs >= 1) & (attention >= need[2]))
        if fits.size:
            after = self.left[:, fits] / self.full[:, None]
            if self.rule == "norm":
                after -= (np.array(need) / self.full)[:, None]
                at = int(fits[np.argmin(self.scale @ (after * after))])
            else:
                at = int(fits[np.argmax((self.scale * np.array(need) / self.full) @ after)])
        else:
            at = self._open()
        offset = int(self.full[0] - self.left[0, at])
        self.left[:, at] -= need
        return int(self.name[at]), offset

    def _open(self) -> int:
        if self.n == self.left.shape[1]:
            self.left = np.concatenate([self.left, np.zeros_like(self.left)], axis=1)
            self.name = np.concatenate([self.name, np.zeros_like(self.name)])
        self.left[:, self.n], self.name[self.n] = self.full, self.made
        self.made, self.n = self.made + 1, self.n + 1
        return self.n - 1

    def settle(self, most: int) -> None:
        """Keep open only bins that can still take a piece, the emptiest ones first."""
        live = np.flatnonzero((self.left[:, : self.n] > 0).all(axis=0))
        live = live[np.argsort(-self.left[0, live], kind="stable")][:most]
        self.left[:, : live.size], self.name[: live.size], self.n = self.left[:, live], self.name[live], live.size


def pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01), block: int = BLOCK, carried: int = CARRIED) -> DataFrame:
    """Place every row of ``pieces`` into a bin: all its columns, sequence_id long and offset long.

    ``max_docs`` and ``max_attention`` default to values that never bind beyond ``capacity`` tokens.
    A null or non-positive length is an error of the caller and is refused when the plan runs.
    """
    cap_docs, cap_att = max_docs or capacity, max_attention or capacity * capacity
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    src = pieces.select(*kept)
    spread = F.xxhash64(*[c for c in kept if not isinstance(src.schema[c].dataType, (T.MapType, T.VariantType))])
    schema = T.StructType([*src.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        bins = Bins(capacity, cap_docs, cap_att, rule, weights)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            lengths = rows.column(length_col).to_numpy().astype(np.int64)
            if lengths.size and lengths.min() < 1:
                raise ValueError("a piece must have at least one token")
            seq, off = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
            for i in np.argsort(-lengths, kind="stable"):
                seq[i], off[i] = bins.place(int(lengths[i]))
            bins.settle(carried)
            rows = rows.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off))
            yield from rows.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if held and n + part.num_rows > block:
                    yield from flush(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from flush(held)

    # in the order of their hashes, so that placing is the same whenever a task is run again, and a block has all lengths
    sortable = [c for c in kept if not isinstance(src.schema[c].dataType, (T.MapType, T.VariantType))]
    return src.repartition(spread).sortWithinPartitions(spread, *[f"`{c}`" for c in sortable]).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options: object) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its sequence and its place there."""
    return pack(token_pieces(docs, vocab_path, id_col=id_col, text_col=text_col, capacity=capacity), capacity=capacity, **options)
