"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

Each text becomes a set of word shingles (64-bit fingerprints).  Under each of ``permutations`` random
permutations both the minimum and the maximum are kept, so ``2 * permutations`` signature values cost half the
hash evaluations; they are banded, and documents that share a band are candidates.  With 96 permutations in 32
bands of 6 values a pair of similarity 0.85 is missed with a probability of 3e-7 (0.8: 5e-5).

Texts with equal sets are one node.  Candidates are never expanded into all pairs of a band: first every node of a
band is compared with the band's smallest; nodes that this leaves in different components are compared further,
directly in small bands.  In large ones all nodes are compared with the band's most typical nodes (those with the
fewest shingles of their own); whatever is still outside a band's main component is then compared with the rest of
the band in packed blocks of bounded size, a matrix product a pair of blocks, of which only confirmed links
leave.  So the components equal those of all confirmed candidate pairs, while the rows that are made stay near the
number of nodes.

Nothing is collected to the driver; components come from an iteration of joins over written tables.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; a text with fewer words
than a shingle has one shingle, its whole sequence; equal sets are linked; rows with a null doc_id get
component_id null and stay; a repeated doc_id is one node for linking and all of its rows are returned; an empty
table gives no rows; extra and clashing columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import batch_rows, materialize, text_batches
from weftgraph.llm.components import components

PERMUTATIONS = 96
BANDS = 32
#: Bands with at most so many open nodes compare them with each other directly; larger ones go by rounds.
SMALL = 48
#: Nodes of a large band that all others are compared with, in the first round and in the second.
TYPICAL = (4, 8)
#: Nodes packed together for products: those outside the main component, and all of a band.
OUTSIDE, INSIDE = 64, 256
#: Nodes of a band that are dealt to one task together at most, on average; and packs of nodes outside.
PART, PACKS = 256, 8

_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15))


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Fingerprints of the distinct shingles of a text."""

    def __init__(self, words: int) -> None:
        self.words = words
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        if not found:
            return np.empty(0, np.uint64)
        known = self._known
        if len(known) > 400_000:
            known.clear()
        ids = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            ids.append(h)
        h = np.array(ids, np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            out = _mix(out * _MIX[2] + h[i : len(h) - n + 1 + i])
        return np.unique(out)


class MinMax:
    """Bands of minima and maxima under random permutations of fingerprints."""

    def __init__(self, permutations: int, bands: int, seed: int = 11) -> None:
        if (2 * permutations) % bands:
            raise ValueError("bands must divide twice the permutations")
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 2**63, permutations, np.uint64)[:, None]
        self.times = (rng.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.bands = bands

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All minima, then all maxima."""
        low = high = None
        step = max(1, 400_000 // len(self.flip))
        for at in range(0, len(shingles), step):
            h = (shingles[None, at : at + step] ^ self.flip) * self.times
            lo, hi = h.min(axis=1), h.max(axis=1)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        return np.concatenate([low, high])

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """One signed 64-bit key a band; the band's number is part of the key."""
        rows = self.signature(shingles).reshape(-1, self.bands)  # a band has minima and maxima of the same permutations
        key = np.arange(self.bands, dtype=np.uint64)
        for r in rows:
            key = _mix(key * _MIX[2] + r)
        return key.view(np.int64)


_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128-bit digest of the set), bands (null for an empty set)."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minmax = Shingler(words), MinMax(permutations, bands)
        for batch in batches:
            seen: dict[str, tuple] = {}
            rows = []
            for text in batch.column(1).to_pylist():
                row = seen.get(text)
                if row is None:
                    shingles = shingler(text)
                    digest = xxhash.xxh3_128_digest(shingles.tobytes())
                    k1, k2 = np.frombuffer(digest, "<i8").tolist()
                    row = seen[text] = (len(shingles), k1, k2, minmax(shingles).tolist() if len(shingles) else None)
                rows.append(row)
            n, k1, k2, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=_FEATURES.names)

    return src.mapInArrow(run, _FEATURES)


def shingle_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """node, set: the sorted fingerprints of each text's distinct shingles."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))]))

    return src.mapInArrow(run, _SETS)


def _may_link(percent: int, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        .select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    )
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _parts(size: Column, part: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / part)).cast("long")


def _meet_few(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (bucket, node, m, ...) joined with a table that has few rows a bucket (bucket, m, ...), where m is the band's size.

    A band's rows are dealt to tasks by a hash of their nodes, ``PART`` at a time, and its few rows are repeated for each;
    so no task has a whole band, whatever its size, and bands of up to ``PART`` nodes are shuffled as they are.
    """
    parts = _parts(F.col("m"), PART)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("node"), parts))
    each = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("m")
    return dealt.join(each.hint("merge"), ["bucket", "_part"], how).drop("_part")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with node, plus comp: its component so far."""
    return rows.join(labels.withColumnRenamed("component", "_c"), "node", "left").withColumn("comp", F.coalesce("_c", "node")).drop("_c")


def _open(rows: DataFrame) -> DataFrame:
    """(bucket, m, open): buckets whose rows (bucket, node, comp, m, ...) lie in several components, with the count of these rows."""
    found = rows.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max("m").alias("m"), F.count(F.lit(1)).alias("open"))
    return found.where("_lo <> _hi").drop("_lo", "_hi")


def _pairs(left: DataFrame, right: DataFrame, percent: int, *more: Column) -> DataFrame:
    """Distinct pairs a < b of nodes that share a bucket, lie in different components and have fitting sizes; ``right`` has few rows a bucket."""
    named = lambda df, end: df.select("bucket", "m", *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in ("bucket", "m")])
    joined = _meet_few(named(left, "l").withColumn("node", F.col("node_l")), named(right, "r"))
    kept = joined.where((F.col("comp_l") != F.col("comp_r")) & _may_link(percent, F.col("n_l"), F.col("n_r")))
    for condition in more:
        kept = kept.where(condition)
    return kept.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents are linked if 100 * common shingles >= ``percent`` * shingles of either.
    """
    feats = materialize(features(docs, id_col=id_col, text_col=text_col, words=words, permutations=permutations, bands=bands), "minhash-features")
    # one node per distinct set, named by its smallest doc_id
    classes = materialize(feats.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "minhash-classes")
    named = feats.join(classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("node").alias("_node")), (F.col("doc_id") == F.col("_node")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left_semi")
    banded = named.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), "n")
    heads = materialize(banded.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("_hi"), F.min_by("n", "node").alias("head_n"), F.count(F.lit(1)).alias("m")).where("head <> _hi").drop("_hi"), "minhash-heads")
    # adaptive execution may split a band here, as its rows still lie as the documents do
    shared = materialize(banded.join(heads.hint("merge"), "bucket"), "minhash-shared")  # nodes that share a band with another

    nodes = shared.select("node").distinct()
    sets = materialize(shingle_sets(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(nodes, "node", "left_semi"), id_col="node", words=words), "minhash-sets")

    # every node of a band against the band's smallest
    first = shared.where((F.col("node") != F.col("head")) & _may_link(percent, F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_confirm(first, sets, percent), "minhash-links")
    labels = components(links)

    rows = _labelled(shared.select("bucket", "node", "n", "m"), labels)
    opened = materialize(_open(rows), "minhash-open")
    active = materialize(_meet_few(rows, opened), "minhash-active")
    small = active.where(F.col("open") <= SMALL).drop("open")
    found = materialize(_confirm(_pairs(small, small, percent, F.col("node_l") < F.col("node_r")), sets, percent), "minhash-links")
    labels = components(found, labels)
    labels = _large_bands(active.where(F.col("open") > SMALL).drop("open", "comp"), sets, labels, percent)

    final = materialize(_labelled(classes, labels).select("k1", "k2", F.col("comp").alias("component_id")), "minhash-final")
    joined = feats.select("doc_id", "n", "k1", "k2").join(final, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _large_bands(rows: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Components after all pairs in large bands that could join two of them have been decided.

    A node's ``own`` shingles are in no other node of these bands; with c = n - own, no link from it can have a
    similarity above c / n, so a node with 100 * c < percent * n leaves at once, and a pair needs
    100 * min(c) >= percent * (n + n' - min(c)).
    """
    if rows.isEmpty():
        return labels
    inside = rows.select("node").distinct()
    exploded = sets.join(inside, "node", "left_semi").select("node", F.explode("set").alias("shingle"))
    often = exploded.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("node")).where("_n = 1")
    single = sets.groupBy("node").agg(F.count(F.lit(1)).alias("_k")).where("_k = 1").select("node")  # a repeated id may have several texts
    own = often.groupBy("node").agg(F.count(F.lit(1)).alias("own")).join(single, "node", "left_semi")
    left = rows.join(own, "node", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0))).drop("own").where(F.lit(100) * F.col("c") >= F.lit(percent) * F.col("n"))
    left = materialize(left, "minhash-large")
    for typical in TYPICAL:
        now = _still_open(left, labels)
        if now.isEmpty():
            return labels
        ranks = materialize(_most_typical(now, typical), "minhash-typical")
        least = F.least("c_l", "c_r")
        pairs = _pairs(now, ranks, percent, F.lit(100) * least >= F.lit(percent) * (F.col("n_l") + F.col("n_r") - least))
        labels = components(materialize(_confirm(pairs, sets, percent), "minhash-links"), labels)
        left = now.drop("comp").join(ranks.select("bucket", "node"), ["bucket", "node"], "left_anti")
    now = _still_open(left, labels)
    if now.isEmpty():
        return labels
    return components(materialize(_block_links(now, sets, percent), "minhash-links"), labels)


def _still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their components so far, of buckets that have several."""
    now = _labelled(rows, labels)
    return materialize(_meet_few(now, _open(now).drop("open"), "left_semi"), "minhash-large")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between nodes outside a bucket's main component and all others of the bucket.

    Both are packed into blocks before they meet, so a row is a pair of blocks, and a task holds two at a time.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m"))
    main = materialize(sizes.groupBy("bucket").agg(F.max("m").alias("m"), F.max_by("comp", "k").alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("outside_n")), "minhash-main")
    told = _meet_few(rows.select("bucket", "node", "comp", "m"), main)
    packed = F.collect_list(F.struct("node", "comp", "set"))
    packs = _parts(F.ceil(F.col("outside_n") / OUTSIDE), PACKS)

    def blocks(some: DataFrame, count: Column, size: int, seed: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(count / size).cast("long"))
        keyed = some.select("bucket", block.alias("block"), packs.alias("packs"), "node", "comp")
        return materialize(keyed.join(sets, "node").groupBy("bucket", "block").agg(F.max("packs").alias("packs"), packed.alias(name)), "minhash-blocks")

    # blocks of nodes outside are dealt to tasks some at a time, and the band's blocks are repeated for each
    outside = blocks(told.where("comp <> main"), F.col("outside_n"), OUTSIDE, 1, "outside").withColumn("part", F.pmod("block", "packs"))
    inside = blocks(told, F.col("all"), INSIDE, 2, "inside").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)))
    with batch_rows(spark, 8):  # a row has two blocks of sets
        met = outside.select("bucket", "part", "outside").join(inside.select("bucket", "part", "inside").hint("merge"), ["bucket", "part"]).select("outside", "inside")
        return materialize(met.mapInArrow(_block_pairs(percent), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), "minhash-links")


def _unpack(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, shingles one after another, and each shingle's row, of a packed block."""
    items = column[row].values
    lists = items.field("set")
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    return items.field("node").to_numpy(), items.field("comp").to_numpy(), values, np.repeat(np.arange(len(lengths)), lengths)


def _block_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for row in range(batch.num_rows):
                (u, uc, us, ur), (v, vc, vs, vr) = (_unpack(batch.column(i), row) for i in (0, 1))
                both = np.intersect1d(us, vs)
                x, y = np.zeros((len(u), len(both)), np.float32), np.zeros((len(v), len(both)), np.float32)
                for m, values, at in ((x, us, ur), (y, vs, vr)):
                    place = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
                    hit = both[place] == values if len(both) else np.zeros(len(values), bool)
                    m[at[hit], place[hit]] = 1
                common = np.rint(x @ y.T).astype(np.int64)
                nu, nv = np.bincount(ur, minlength=len(u)), np.bincount(vr, minlength=len(v))
                linked = (100 * common >= percent * (nu[:, None] + nv[None, :] - common)) & (uc[:, None] != vc[None, :])
                i, j = np.nonzero(linked)
                found_a.append(np.minimum(u[i], v[j]))
                found_b.append(np.maximum(u[i], v[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def _most_typical(rows: DataFrame, k: int) -> DataFrame:
    """The k nodes of each bucket with the smallest share of own shingles; partial top-k before any shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("bucket").orderBy((F.col("n") - F.col("c")) / F.col("n"), "node")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
