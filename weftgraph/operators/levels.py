"""Reach from many roots at once, level by level, with roots as bits.

A level is a table of (node, block, mask): the roots of a block of 64 that reach the node first at that depth.  Rows of many roots
that reach the same node are one row, so levels are nodes times blocks, and merging roots is a bitwise or before the shuffle.
Levels are appended to one table that is bucketed by (node, block), edges are a table bucketed by their source: so a step shuffles
its frontier and what it grows, and neither the edges nor what was seen before.  Levels are files; a lost executor costs
one level.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import Buckets, written

_BITS = "filter(sequence(0, 63), b -> (shiftrightunsigned(mask, b) & 1) = 1)"


@dataclass
class Levels:
    """Levels of reach: ``seen`` (node, block, mask, depth), and the ``roots`` (root, block, bit)."""

    roots: DataFrame
    seen: Buckets
    edges: Buckets
    first: int

    def pairs(self, rows: DataFrame | None = None) -> DataFrame:
        """(root, node, depth) of the levels, or of some rows of theirs."""
        rows = self.seen.read().where(F.col("depth") >= self.first) if rows is None else rows
        return rows.select("node", "block", "depth", F.explode(F.expr(_BITS)).alias("bit")).join(self.roots, ["block", "bit"]).select("root", "node", "depth")


def step(levels: Levels, depth: int) -> DataFrame:
    """(node, block, mask) of what is reached first at ``depth``, from the level before."""
    frontier = levels.seen.table().where(F.col("depth") == depth - 1).select(F.col("node").alias("src"), "block", "mask")
    grown = frontier.join(levels.edges.table().hint("merge"), "src").groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("mask").alias("mask"))
    before = levels.seen.table().where(F.col("depth").between(levels.first, depth - 1)).groupBy("node", "block").agg(F.bit_or("mask").alias("before"))
    fresh = grown.join(before.hint("merge"), ["node", "block"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long")))))
    return fresh.where("mask <> 0").select("node", "block", "mask")


def run(edges: DataFrame, roots: DataFrame, depth: int | None, *, include_roots: bool = False) -> Levels:
    """All levels up to ``depth``, or until one is empty.  Without ``include_roots`` a root is reached only by a way back to it."""
    number = F.col("n")
    named = roots.select(F.col("id").alias("root")).distinct().withColumn("n", F.monotonically_increasing_id())
    named = written(named.select("root", F.shiftright(number, 6).alias("block"), number.bitwiseAND(63).cast("int").alias("bit")), "roots")
    level = named.groupBy(F.col("root").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    levels = Levels(named, Buckets(roots.sparkSession, "levels", ("node", "block"), "depth"), Buckets(roots.sparkSession, "pairs", ("src",)), 0 if include_roots else 1)
    levels.edges.append(edges.select("src", "dst").distinct())
    levels.seen.append(level.withColumn("depth", F.lit(0)))
    for d in count(1) if depth is None else range(1, depth + 1):
        if not levels.seen.append(step(levels, d).withColumn("depth", F.lit(d))):
            break
    levels.seen.close()
    levels.edges.close()
    return levels


def reach(edges: DataFrame, roots: DataFrame, depth: int | None, *, include_roots: bool = False) -> DataFrame:
    """(root, node, depth) with the least depth."""
    return run(edges, roots, depth, include_roots=include_roots).pairs()


def shortest(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int | None, *, chains: bool = True) -> DataFrame:
    """(root, node, depth, chain): a shortest path to each target that is reached, back from its end by the smallest predecessors.

    Without ``chains`` only depths are told, and no step back is made.

    Only depths are kept while levels are made.  Afterwards each asked pair steps back from its target, a level at a time, to
    those predecessors that its root has at the level before.
    """
    levels = run(edges.where("src <> dst"), roots, depth, include_roots=True)
    seen = levels.seen.read()
    asked = seen.where("depth > 0").join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    if not chains:
        return levels.pairs(asked)
    deepest = asked.agg(F.max("depth")).first()[0] or 0
    back = levels.edges.read().select(F.col("src").alias("before"), F.col("dst").alias("at"))
    ways = asked.select("node", "block", "depth", F.explode(F.expr(_BITS)).alias("bit")).select("node", "block", "bit", "depth", F.col("node").alias("at"), F.array("node").alias("chain"))
    ways = written(ways, "ways")
    done = ways.where("depth = 0")
    for far in range(1, deepest + 1):
        # ways of which ``far - 1`` steps are known
        place = seen.select(F.col("node").alias("before"), "block", F.col("depth").alias("level"), "mask")
        met = ways.withColumn("level", F.col("depth") - far).join(back, "at").join(place, ["before", "block", "level"]).where("(shiftrightunsigned(mask, bit) & 1) = 1")
        best = met.groupBy("node", "block", "bit", "depth").agg(F.min("before").alias("at"), F.any_value("chain").alias("chain"))
        best = written(best.withColumn("chain", F.concat(F.array("at"), F.col("chain"))), "ways")
        done = done.unionByName(best.where(f"depth = {far}"))
        ways = best.where(f"depth > {far}")
    return done.join(levels.roots, ["block", "bit"]).select("root", "node", "depth", "chain")
