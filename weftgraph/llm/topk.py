"""Exact top-k by inner product: tiled matrix products, partial selection per tile, tree merging.

Queries and candidates are packed into tiles (a few thousand vectors each, as rows with binary matrices), so a
product of two tiles is one matrix multiplication.  Query tiles go out in blocks of at most ``BLOCK_TILES`` (some
32 MB at 64 dimensions, whatever the input): a block is broadcast, and every candidate tile meets it where it lies,
without a shuffle of candidates; each further block is one more scan of the candidates.  Within a task the best
of all tiles seen so far are kept per query (selection, not sorting); the tasks' short lists are then merged as a tree:
lists of some tasks to one, and these to a query's result.  No list is collected to the driver.

Integer scores are exact: products run in 64-bit floats where no sum can pass 2**53, else in Python integers held
to the range of a long.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take no part; empty
vectors score 0 with each other; vectors of different lengths are compared only with those of their own length; a query's own id is never
its candidate; rows that repeat a vec_id are candidates by themselves, so one id may fill several places, and as queries
they are one, whose list is the best of all of them; ties go to the smaller id; with fewer candidates than k all are returned; empty tables give no rows;
extra and clashing columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import batch_rows, materialize, text_batches

#: Vectors of a candidate tile and of a query tile.
CANDIDATES, QUERIES = 4096, 1024
#: Query tiles of 64 dimensions broadcast at once; fewer of more dimensions, so that a block keeps its size.
BLOCK_TILES = 64
_EXACT = 2**53
_LONG = 2**63 - 1

_TILES = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("tile", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("matrix", T.BinaryType())])
_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("branch", T.LongType())])
#: Branches of the merging tree: the lists of a query's tasks are dealt to so many before they meet.
BRANCHES = 64


def quantized(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * component) as doubles, of the vectors that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


def tiles(vectors: DataFrame, size: int) -> DataFrame:
    """dim, tile, ids, matrix: rows of one length packed ``size`` at a time, within partitions."""
    text_batches(vectors.sparkSession)

    def pack(held: list[tuple[np.ndarray, np.ndarray]], dim: int, tile: int) -> pa.RecordBatch:
        ids, matrix = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), pa.array([ids.astype("<i8").tobytes()]), pa.array([matrix.astype("<f8").tobytes()])], names=_TILES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values, start = lists.values.to_numpy(), lists.offsets.to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                matrix = values[start[rows][:, None] + np.arange(dim)]
                some = held.setdefault(dim, [])
                for at in range(0, len(rows), size):
                    some.append((ids[rows[at : at + size]], matrix[at : at + size]))
                    if sum(len(i) for i, _ in some) >= size:
                        yield pack(some, dim, number)
                        number += 1
                        some.clear()
        for dim, some in held.items():
            if some:
                yield pack(some, dim, number)
                number += 1

    return vectors.mapInArrow(run, _TILES)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer scores, as 64-bit floats where these are exact, else as integers held to a long."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if most < _EXACT:
        return q @ c.T
    exact = np.array([[int(x) for x in r] for r in q.tolist()], object) @ np.array([[int(x) for x in r] for r in c.tolist()], object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best, ties to the smaller id; partial selection, then a sort of what is left."""
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, at = np.nonzero(scores >= cut[:, None])
    else:
        row, at = np.nonzero(np.ones(scores.shape, bool))
    s, i = scores[row, at], ids[at]
    order = np.lexsort((i, -s if s.dtype == float else ~s, row))
    row, s, i = row[order], s[order], i[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], i[keep], s[keep]


class Best:
    """The k best candidates of each query of a tile, over all candidate tiles seen."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.row, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        row, vec, score = np.concatenate([self.row, row]), np.concatenate([self.vec, vec]), np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((vec, ~score, row))  # ~score falls as score rises, without overflow
        row, vec, score = row[order], vec[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k
        self.row, self.vec, self.score = row[keep], vec[keep], score[keep]


def search(queries: DataFrame, candidates: DataFrame, k: int, *, query_tile: int = QUERIES, candidate_tile: int = CANDIDATES, block_tiles: int = BLOCK_TILES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all candidates but itself.

    Both inputs have vec_id long and v array<double> of whole numbers, as ``quantized`` makes them.
    """
    spark = queries.sparkSession
    q = materialize(tiles(queries.repartition(F.col("vec_id")), query_tile), "topk-queries")
    c = materialize(tiles(candidates, candidate_tile), "topk-candidates")
    order, size = Window.orderBy("dim", "tile"), F.greatest("dim", F.lit(1))
    numbered = materialize(q.select("dim", "tile").withColumn("block", F.floor((F.sum(size).over(order) - size) / (block_tiles * 64))), "topk-blocks")
    blocks = (numbered.agg(F.max("block")).first()[0] or 0) + 1  # names of tiles only: one row for a thousand queries
    found = None
    with batch_rows(spark, 8):  # a row has two matrices
        for b in range(int(blocks)):
            block = q.join(numbered.where(F.col("block") == b).select("dim", "tile"), ["dim", "tile"], "left_semi")
            named = block.select("dim", F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
            met = c.select("dim", "ids", "matrix").join(F.broadcast(named), "dim").mapInArrow(_meet(k), _FOUND)
            part = materialize(met, "topk-lists")  # run here, while batches are small
            found = part if found is None else found.union(part)
    return _first(_first(found, k, "query_id", "branch"), k, "query_id").select("query_id", "rank", "vec_id", "score")


def _first(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    """One level of the merging tree: the k best rows of each key, limited also before they are shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(k: int):
    """Rows of a candidate tile and a query tile to each query's best candidates in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        branch = (context.partitionId() if context else 0) % BRANCHES
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q_m, m = (np.frombuffer(r[x], "<f8").reshape(n, r["dim"]) for x, n in (("q_matrix", len(q_ids)), ("matrix", len(ids))))
                mine = best.setdefault((r["dim"], r["q_tile"]), Best(q_ids, k))
                parts = []
                for at in range(0, len(q_ids), 128):
                    scores, own = _products(q_m[at : at + 128], m), ids[None, :] == q_ids[at : at + 128, None]
                    scores[own] = -np.inf if scores.dtype == float else -_LONG - 1
                    row, vec, score = select(scores, ids, k)
                    other = vec != q_ids[at + row]
                    parts.append((row[other] + at, vec[other], score[other]))
                mine.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for mine in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(mine.ids[mine.row]), pa.array(mine.vec), pa.array(mine.score), pa.array(np.full(len(mine.row), branch, np.int64))], names=_FOUND.names)

    return run
