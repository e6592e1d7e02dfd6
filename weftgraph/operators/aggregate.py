"""Aggregations, set operations, ordering and sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fan_out(edges: DataFrame, more_than: int = 0, limit: int | None = None, end: str = "src") -> DataFrame:
    """A1, O3: edges per node, those with more than a number, most first; ties by id."""
    found = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return found.orderBy(F.desc("n"), "id").limit(limit) if limit else found


def fan_in(edges: DataFrame, at_least: int = 3) -> DataFrame:
    """A2: nodes with at least so many distinct callers."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers")).where(F.col("callers") >= at_least)


def exists(df: DataFrame) -> bool:
    """A3: whether there is a row; reads no more than one."""
    return not df.isEmpty()


def collected(edges: DataFrame, key: str, value: Column, name: str, distinct: bool = True) -> DataFrame:
    """A4, A5: values per key as a sorted array; unmatched optional values (null) are left out."""
    bag = F.collect_set(value) if distinct else F.collect_list(value)
    return edges.groupBy(key).agg(F.array_sort(bag).alias(name))


def duplicate_groups(nodes: DataFrame, keys: Sequence[str], more_than: int = 2) -> DataFrame:
    """Members of groups with equal keys and more than so many members, with the group's size.

    Group sizes are aggregated before they meet the members, so a key with a third of all rows is never one task's window.
    """
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > more_than)
    return nodes.join(sizes, list(keys))


def duplicates_of(nodes: DataFrame, node_id: str, key: str = "ast_hash") -> DataFrame:
    """A10: other active nodes with the same hash as one node."""
    one = nodes.where(F.col("id") == node_id).select(F.col(key))
    return nodes.where((F.col("status") == "active") & (F.col("id") != node_id)).join(F.broadcast(one.limit(1)), key, "left_semi")


def timeline(edges: DataFrame) -> DataFrame:
    """Typed interactions of variables, each once: variable, type, other (the reported end), line, seq."""
    of_node = edges.where(F.col("type").isin("ASSIGNS", "MUTATES", "READS", "RETURNS")).select(F.col("dst").alias("variable"), "type", F.col("src").alias("other"), "line", "seq")
    between = edges.where(F.col("type").isin("PASSES_TO", "FEEDS")).select(F.col("src").alias("variable"), "type", F.col("dst").alias("other"), "line", "seq")
    return of_node.unionByName(between)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """A9."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def evaluation_summary(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per condition: n, correct (count and percent), and means of latencies."""
    right = F.sum(F.when(F.col("correctness") >= threshold, 1).otherwise(0))
    return results.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(100.0 * right / F.count(F.lit(1)), 1).alias("percent"),
        F.round(F.avg("total_latency_ms"), 1).alias("mean_latency_ms"), F.round(F.avg("tokens"), 1).alias("mean_tokens"),
    )


def head_to_head(ratings: DataFrame) -> DataFrame:
    """Wins of each model over (model_a, model_b, rating in a, b, tie); ties count for ``tie``."""
    winner = F.when(F.col("rating") == "a", F.col("model_a")).when(F.col("rating") == "b", F.col("model_b")).otherwise(F.lit("tie"))
    return ratings.groupBy(winner.alias("winner")).agg(F.count(F.lit(1)).alias("wins"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In- plus out-degree, and a display size that grows with its logarithm."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    base = F.when(F.col("kind") == "class", 3.0).when(F.col("kind") == "method", 1.5).otherwise(2.0)
    degree = F.coalesce("degree", F.lit(0))
    size = F.least(0.5 * F.log2(1.0 + degree), F.lit(3.0)) + base
    return nodes.join(ends, "id", "left").select("id", degree.alias("degree"), F.round(size, 6).alias("size"))


def group_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The class of a member, else the file, as a key."""
    member = edges.where("type = 'MEMBER_OF'").groupBy("src").agg(F.min("dst").alias("owner"))
    found = nodes.join(member, nodes["id"] == member["src"], "left")
    return found.select("id", F.coalesce(F.concat(F.lit("class:"), "owner"), F.concat(F.lit("file:"), "module_path")).alias("group_key"))


def first_seen(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_confidence(matches: DataFrame, key: str = "consumer") -> DataFrame:
    """The strongest of exact, structural and weak matches of each key."""
    rank = F.when(F.col("confidence") == "exact", 3).when(F.col("confidence") == "structural", 2).otherwise(1)
    return matches.groupBy(key).agg(F.max_by("confidence", rank).alias("confidence"))


def dedup_ratio(evidence: DataFrame, shape: str = "shape_hash") -> DataFrame:
    """Entries, distinct shapes and their ratio."""
    return evidence.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct(shape).alias("shapes")).withColumn("ratio", F.round(F.col("shapes") / F.col("entries"), 6))


# --- order and limits


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_key(df: DataFrame, key: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key; limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- sets


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side only, with change added or removed; set semantics."""
    return after.subtract(before).withColumn("change", F.lit("added")).unionByName(before.subtract(after).withColumn("change", F.lit("removed")))


def semantic_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("id",), value: str = "ast_hash") -> DataFrame:
    """U4: keys that were added, removed or modified (their value differs), in one full outer join."""
    b = before.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return b.join(a, list(keys), "full").select(*keys, change.alias("change")).where("change IS NOT NULL")


def not_in(candidates: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates that were not seen."""
    return candidates.join(seen.select(*on).distinct(), list(on), "left_anti")


# --- sequences


def positions(rows: DataFrame, parent: str, *order: str, name: str = "seq") -> DataFrame:
    """WN1, WN2, WN8: zero-based position among siblings."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def next_edges(rows: DataFrame, parent: str = "parent", order: str = "seq", ident: str = "id") -> DataFrame:
    """WN3: NEXT edges between neighbours in order."""
    after = F.lead(ident).over(Window.partitionBy(parent).orderBy(order, ident))
    return rows.select(F.lit("NEXT").alias("type"), F.col(ident).alias("src"), after.alias("dst")).where("dst IS NOT NULL")


def rebinds(assigns: DataFrame, key: str = "variable", order: Sequence[str] = ("walk_order",)) -> DataFrame:
    """WN4: is_rebind: an earlier row has bound the variable (rows with preset true were registered before)."""
    return assigns.withColumn("is_rebind", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def origins(uses: DataFrame, key: str = "variable", value: str = "other", order: Sequence[str] = ("line", "other")) -> DataFrame:
    """WN5: the first ASSIGNS of each variable, by partial aggregation."""
    return uses.where("type = 'ASSIGNS'").groupBy(key).agg(F.min_by(F.struct(value, "line"), F.struct(*order)).alias("_o")).select(key, f"_o.{value}", "_o.line")


def terminals(uses: DataFrame, key: str = "variable") -> DataFrame:
    """WN6: the last of mutations, reads and returns by (function, seq)."""
    some = uses.where(F.col("type").isin("MUTATES", "READS", "RETURNS"))
    return some.groupBy(key).agg(F.max(F.struct("other", "seq", "type")).alias("_t")).select(key, "_t.other", "_t.seq", "_t.type")


def shifted(rows: DataFrame, at: int, by: int = 1, name: str = "seq") -> DataFrame:
    """WN9: positions from ``at`` on move by ``by``."""
    return rows.withColumn(name, F.when(F.col(name) >= at, F.col(name) + by).otherwise(F.col(name)))


def last_wins(rows: DataFrame, keys: Sequence[str], order: str | None = "ingest_seq") -> DataFrame:
    """WN11: the last row of each key; among rows of equal order, or without one, the greatest by all other columns.

    By partial aggregation, so a key with a large part of all rows is no one's task.
    """
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    text = lambda c: F.to_json(F.struct(c)) if isinstance(rows.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(c)
    rank = F.struct(*[F.col(order)] if order else [], *[text(c).alias(f"_{i}") for i, c in enumerate(others)])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in others]).select(*rows.columns)


def hub_edges(nodes: DataFrame) -> DataFrame:
    """edges from each file's first node by name to its other nodes; the hub is aggregated, not windowed."""
    hubs = nodes.groupBy("module_path").agg(F.min(F.struct("name", "id")).alias("_h")).select("module_path", F.col("_h.id").alias("src"))
    return nodes.join(hubs, "module_path").where("id <> src").select("src", F.col("id").alias("dst"), "module_path")
