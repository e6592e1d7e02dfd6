"""Traversal: variable-length patterns.

Two families.  *Reach* keeps each (root, node) once with its least depth, level by level with a distinct per level,
so its size is bounded by roots times nodes.  *Trails* keep every path that repeats no edge, as openCypher does; they
can be exponentially many, so a depth is given wherever the question has one.  Shallow traversals are one lazy plan; deeper ones write each
level to the shared folder, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import levels, scc
from weftgraph.storage import written

#: Levels planned lazily; more are written one by one.
LAZY_LEVELS = 4


def _deep(depth: int | None) -> bool:
    return depth is None or depth > LAZY_LEVELS


def _kept(df: DataFrame, depth: int | None) -> DataFrame:
    return written(df, "level") if _deep(depth) else df


def _levels(first: int, depth: int | None) -> Iterable[int]:
    return count(first) if depth is None else range(first, depth + 1)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def undirected(edges: DataFrame) -> DataFrame:
    """Edges both ways; a path may use either direction of an edge, not both if edges carry an edge_id."""
    return edges.unionByName(reversed_edges(edges))


def reach(edges: DataFrame, roots: DataFrame, depth: int | None, *, include_roots: bool = False) -> DataFrame:
    """(root, node, depth) for every node within ``depth`` steps, with the least number of steps.

    A node that only leads back to its root is reached from it.  ``include_roots`` adds depth 0.  Up to ``LAZY_LEVELS``
    steps are one plan; more go level by level, each with what is new only, and end when a level is empty.
    """
    if _deep(depth):
        return closure(edges, roots, include_roots=include_roots, depth=depth)
    pairs = edges.select("src", "dst").distinct()
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    levels = [level.withColumn("depth", F.lit(0))] if include_roots else []
    for d in range(1, depth + 1):
        level = level.join(pairs, level["node"] == pairs["src"]).select("root", F.col("dst").alias("node")).distinct()
        levels.append(level.withColumn("depth", F.lit(d)))
    found = levels[0]
    for other in levels[1:]:
        found = found.unionByName(other)
    return found.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame, roots: DataFrame, *, include_roots: bool = False, depth: int | None = None) -> DataFrame:
    """Reach to the fix-point (or to ``depth``): each level meets only what is new, so cycles end it.

    Roots are bits of ``levels``; where only pairs are asked for, ``scc.reachable`` keeps them by components.
    """
    return levels.reach(edges, roots, depth, include_roots=include_roots)


def trails(edges: DataFrame, roots: DataFrame, depth: int | None, *, least: int = 1) -> DataFrame:
    """Every path of ``least`` to ``depth`` edges that repeats no edge; without ``depth`` until none grows.

    Columns: root, node (its end), depth, chain (array of nodes), trail (array of edges, as src>dst or edge_id), first_type.
    """
    name = F.col("edge_id") if "edge_id" in edges.columns else F.concat_ws(">", "type", "src", "dst") if "type" in edges.columns else F.concat_ws(">", "src", "dst")
    kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    step = edges.select("src", "dst", name.alias("_e"), kind.alias("_t"))
    level = roots.select(F.col("id").alias("root")).distinct().join(step, F.col("root") == F.col("src"))
    level = _kept(level.select("root", F.col("dst").alias("node"), F.lit(1).alias("depth"), F.array("root", "dst").alias("chain"), F.array("_e").alias("trail"), F.col("_t").alias("first_type")), depth)
    found = level if least <= 1 else None
    for d in _levels(2, depth):
        grown = level.join(step, level["node"] == step["src"]).where(~F.array_contains("trail", F.col("_e")))
        level = _kept(grown.select("root", F.col("dst").alias("node"), F.lit(d).alias("depth"), F.array_append("chain", F.col("dst")).alias("chain"), F.array_append("trail", F.col("_e")).alias("trail"), "first_type"), depth)
        if d >= least:
            found = level if found is None else found.unionByName(level)
        if _deep(depth) and level.isEmpty():
            break
    return found if found is not None else level


def dependencies(edges: DataFrame, roots: DataFrame, depth: int = 2, types: Sequence[str] = ("CALLS", "DEPENDS_ON", "IMPLEMENTS", "VALIDATES", "TRANSFORMS")) -> DataFrame:
    """(root, node, depth, first): what a node depends on, with the types of the first edges of its shortest paths."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be from 1 to 10")
    some = edges.where(F.col("type").isin(*types)).select("src", "dst", "type").distinct()
    pairs = some.select("src", "dst").distinct()
    first = roots.select(F.col("id").alias("root")).distinct().join(some, F.col("root") == F.col("src"))
    level = _kept(first.groupBy("root", F.col("dst").alias("node")).agg(F.collect_set("type").alias("first")).withColumn("depth", F.lit(1)), depth)
    found = level
    for d in range(2, depth + 1):
        # shortest paths to a node may begin with several types, which its predecessors of the last level have
        grown = level.select("root", "node", "first").join(pairs, level["node"] == pairs["src"]).select("root", F.col("dst").alias("node"), F.explode("first").alias("_f"))
        new = grown.join(found.select("root", "node"), ["root", "node"], "left_anti")
        level = _kept(new.groupBy("root", "node").agg(F.collect_set("_f").alias("first")).withColumn("depth", F.lit(d)), depth)
        if _deep(depth) and level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("root", "node", "depth", F.array_join(F.array_sort("first"), ",").alias("first"))


def dependents(edges: DataFrame, roots: DataFrame, depth: int = 2, **options: object) -> DataFrame:
    """The same against the edges' direction."""
    return dependencies(reversed_edges(edges), roots, depth, **options)


def shortest(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int | None = 10, *, chains: bool = True) -> DataFrame:
    """One shortest path (root, node, depth, chain) per pair; of several the one that comes back by the smallest predecessors.

    Without ``depth`` it ends when a level reaches nothing new; without ``chains`` there is no column chain.
    """
    return levels.shortest(edges, roots, targets, depth, chains=chains)


def deepest(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """The longest trail from each root to a node without outgoing edges: (root, depth); see ``scc.deepest``."""
    return scc.deepest(edges, roots, depth)


def flow_paths(edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """Call paths from entry points as flows: (root, path, size), one per distinct sequence of nodes."""
    if not 1 <= depth <= 50:
        raise ValueError("depth must be from 1 to 50")
    found = trails(edges, roots, depth)
    return found.select("root", F.array_join("chain", ">").alias("path"), F.size("chain").alias("size")).where("size >= 2").distinct()


def hierarchy(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, flow, parent, depth, path) of a tree, flattened; a cycle is cut by the depth."""
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("flow"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("id").alias("path"))
    step = edges.select("src", "dst").distinct()
    found = level
    for d in range(1, depth + 1):
        level = level.join(step, level["flow"] == step["src"]).select("root", F.col("dst").alias("flow"), F.col("src").alias("parent"), F.lit(d).alias("depth"), F.concat_ws(">", "path", "dst").alias("path"))
        level = _kept(level, depth)
        found = found.unionByName(level)
    return found


def flow_steps(flow_edges: DataFrame, call_edges: DataFrame) -> DataFrame:
    """(flow, steps, links): ordered steps of each flow as text, and the number of calls among them."""
    steps = flow_edges.where("type = 'STEP_OF'").select(F.col("dst").alias("flow"), F.col("src").alias("node"), "step_order")
    ordered = steps.groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("step_order", "node"))), lambda s: s["node"]), ">").alias("steps"))
    inner = steps.select("flow", F.col("node").alias("src")).join(call_edges.select("src", "dst"), "src").join(steps.select("flow", F.col("node").alias("dst")), ["flow", "dst"], "left_semi")
    return ordered.join(inner.groupBy("flow").agg(F.count(F.lit(1)).alias("links")), "flow", "left").fillna(0, ["links"])


def flow_traversal(flow_edges: DataFrame, edges: DataFrame, types: Sequence[str] = ("CALLS", "DEPENDS_ON", "TRANSFORMS")) -> DataFrame:
    """T15 in full, a row for each thing of a flow: (flow, part, place, src, dst).

    Parts are step (src, at its place), connection between two steps of one flow, and sub_flow (dst, at its place).  Nothing is
    collected, so a flow may have any number of steps.
    """
    steps = flow_edges.where("type = 'STEP_OF'").select(F.col("dst").alias("flow"), F.col("src").alias("node"), F.col("step_order").alias("place")).distinct()
    own = steps.select("flow", "node").distinct()
    met = edges.where(F.col("type").isin(*types)).select("src", "dst").distinct().join(own.select("flow", F.col("node").alias("src")), "src")
    met = met.join(own.select("flow", F.col("node").alias("dst")), ["flow", "dst"], "left_semi")
    none, place = F.lit(None).cast("string"), F.lit(None).cast("int")
    inner = flow_edges.where("type = 'CONTAINS_FLOW'").select(F.col("src").alias("flow"), "dst", F.col("step_order").alias("place")).distinct()
    rows = steps.select("flow", F.lit("step").alias("part"), "place", F.col("node").alias("src"), none.alias("dst"))
    rows = rows.unionByName(met.select("flow", F.lit("connection").alias("part"), place.alias("place"), "src", "dst"))
    return rows.unionByName(inner.select("flow", F.lit("sub_flow").alias("part"), "place", none.alias("src"), "dst"))


def subtree_prints(contains: DataFrame, statements: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """A fingerprint of each branch: kind:target of its descendants, in order of seq."""
    inside = reach(contains, roots, depth)
    part = F.concat_ws(":", "kind", F.coalesce("call_target", F.lit("")))
    found = inside.join(statements.select(F.col("id").alias("node"), "seq", part.alias("part")), "node")
    return found.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "|").alias("fingerprint"))
