"""Writers: upserts, deletes and edits of graph tables.

Spark has no transactional table here, so a writer is a function from tables to tables; ``replace_table`` swaps a new
version in.  Edge upserts join both ends, so an edge without its ends is never kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import TABLES, CodeGraph
from weftgraph.operators.aggregate import last_wins
from weftgraph.storage import shared_path


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str] = ("id",), order: str | None = None) -> DataFrame:
    """Rows replace those with equal keys; of several new ones the last by ``order`` wins (by all columns, without one)."""
    new = last_wins(rows, keys, order)
    new = new.drop(*[c for c in [order] if c and c not in table.columns])
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_properties(table: DataFrame, rows: DataFrame, keys: Sequence[str] = schema.EDGE_KEY) -> DataFrame:
    """Edge properties are merged: a new row's non-null values replace, others stay."""
    new = {c for c in rows.columns if c not in keys}
    joined = table.alias("t").join(rows.alias("n"), list(keys), "full")
    return joined.select(*[F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) if c in new else F.col(f"t.{c}").alias(c) for c in table.columns])


def upsert_edges(edges: DataFrame, rows: DataFrame, vertices: DataFrame, order: str | None = None, by_place: bool = False) -> DataFrame:
    """Edges whose both ends exist with the labels that their type joins; one per key.

    ``by_place`` keeps edges of one pair apart by their place in the source (a multigraph).
    """
    ends = [r for r in schema.EDGE_ENDS.items()] + [(t, (None, None)) for t in schema.STATEMENT_EDGES]
    labels = rows.sparkSession.createDataFrame([(t, a, b) for t, (a, b) in ends], "type string, _a string, _b string")
    v = vertices.select("id", "label")
    valid = rows.join(F.broadcast(labels), "type").join(v.select(F.col("id").alias("src"), F.col("label").alias("_ls")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("_ld")), "dst")
    valid = valid.where("(_a IS NULL OR _a = _ls) AND (_b IS NULL OR _b = _ld)").drop("_a", "_b", "_ls", "_ld")
    keys = [*schema.EDGE_KEY, *(c for c in ("call_line", "line", "seq") if by_place and c in rows.columns and c in edges.columns)]
    if not by_place:
        return upsert(edges, valid, keys, order)
    marked = [valid, edges]
    for i, df in enumerate(marked):  # null places are equal
        marked[i] = df.withColumn("_place", F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]))
    return upsert(marked[1], marked[0], ["_place"], order).drop("_place")


def insert_only(table: DataFrame, rows: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows whose keys are new; existing ones stay as they are."""
    return table.unionByName(last_wins(rows, keys, None).join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def deprecate(nodes: DataFrame, ids: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A soft delete; ids may have replaced_by, which adds DEPENDS_ON edges of that kind."""
    gone = ids.select(F.col("id"), F.lit(True).alias("_gone")).distinct()
    out = nodes.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), F.lit("deprecated")).otherwise(F.col("status"))).drop("_gone").select(*nodes.columns)
    if edges is None or "replaced_by" not in ids.columns:
        return out, edges
    new = ids.where("replaced_by IS NOT NULL").select(F.lit("DEPENDS_ON").alias("type"), F.col("id").alias("src"), F.col("replaced_by").alias("dst"), F.lit("replaced_by").alias("kind"))
    return out, edges.unionByName(new, allowMissingColumns=True)


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes go with every edge that touches them."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def delete_modules(nodes: DataFrame, edges: DataFrame, module_paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """W9, ST5: all nodes of modules, detached."""
    return detach_delete(nodes, edges, nodes.where(F.col("module_path").isin(*module_paths)).select("id"))


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges by (type, src, dst); an error names keys that match nothing."""
    missing = keys.join(edges.select(*schema.EDGE_KEY), list(schema.EDGE_KEY), "left_anti")
    first = missing.first()
    if first is not None:
        raise KeyError(f"no edge {first['type']} from {first['src']} to {first['dst']}")
    return edges.join(keys.select(*schema.EDGE_KEY), list(schema.EDGE_KEY), "left_anti").select(*edges.columns)


def flushed_on_switch(graph: CodeGraph, root: str) -> CodeGraph:
    """ST8: the graph as it is, or without any row where it has modules and none of them lies under ``root``."""
    stored = graph.nodes.where("module_path IS NOT NULL").select(F.startswith("module_path", F.lit(root)).alias("own"))
    known = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("own"), F.lit(False)).alias("own")).first()
    if not known["n"] or known["own"]:
        return graph
    return graph.with_(**{name: getattr(graph, name).where("false") for name in TABLES})


def variable_groups(variables: DataFrame) -> DataFrame:
    """Group key (the scope without its last part) and the file name's hash of each variable."""
    key = F.regexp_replace("scope", r"\.[^.]*$", "")
    return variables.select("id", "scope", key.alias("group_key"), F.substring(F.sha2(key, 256), 1, 8).alias("file_hash"))


def module_sources(nodes: DataFrame, imports: DataFrame | None = None, indent: Column | None = None) -> DataFrame:
    """One text per module: imports, then sources in order of (start_line, name)."""
    parts = nodes.where("status = 'active'").groupBy("module_path").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "class", 0).otherwise(1).alias("o"), "start_line", "name", "source_text"))).alias("_p"))
    body = F.array_join(F.transform("_p", lambda p: F.coalesce(p["source_text"], F.concat(F.lit("# "), p["name"]))), "\n\n")
    if imports is None:
        return parts.select("module_path", body.alias("source"))
    head = imports.groupBy("module_path").agg(F.array_join(F.array_sort(F.collect_set("import_text")), "\n").alias("_h"))
    return parts.join(head, "module_path", "left").select("module_path", F.concat_ws("\n\n", "_h", body).alias("source"))


def shape_stub(shapes: DataFrame) -> DataFrame:
    """A protocol stub per shape, in Python syntax."""
    name = F.concat(F.lit("Shape_"), F.substring("shape_hash", 1, 8))
    attrs = F.transform(F.array_sort(F.coalesce("definition.attrs", F.array())), lambda a: F.concat(F.lit("    "), a, F.lit(": Any")))
    methods = F.transform(F.array_sort(F.coalesce("definition.methods", F.array())), lambda m: F.concat(F.lit("    def "), m, F.lit("(self, *args: Any) -> Any: ...")))
    items = F.transform(F.array_sort(F.coalesce("definition.subscripts", F.array())), lambda s: F.concat(F.lit("    # ['"), s, F.lit("']")))
    lines = F.concat(F.array(F.concat(F.lit("class "), name, F.lit("(Protocol):"))), attrs, items, methods, F.when(F.size(attrs) + F.size(methods) == 0, F.array(F.lit("    ..."))).otherwise(F.array()))
    return shapes.select("id", F.array_join(lines, "\n").alias("stub"))


def insert_statement(statements: DataFrame, row: DataFrame, parent: str, at: int) -> DataFrame:
    """A statement enters at a position; later siblings move on."""
    mine = F.col("parent") == parent
    moved = statements.withColumn("seq", F.when(mine & (F.col("seq") >= at), F.col("seq") + 1).otherwise(F.col("seq")))
    return moved.unionByName(row.withColumn("parent", F.lit(parent)).withColumn("seq", F.lit(at)), allowMissingColumns=True)


def update_statements(statements: DataFrame, texts: DataFrame) -> DataFrame:
    """New texts (id, source_text) of some statements, the last by text where an id repeats; places stay as they are."""
    new = texts.groupBy("id").agg(F.max("source_text").alias("_text"), F.lit(True).alias("_new"))
    joined = statements.join(new, "id", "left")
    return joined.withColumn("source_text", F.when(F.col("_new"), F.col("_text")).otherwise(F.col("source_text"))).select(*statements.columns)


def delete_statement(statements: DataFrame, statement_id: str) -> DataFrame:
    """A statement goes; positions close up, so NEXT bridges the gap."""
    gone = statements.where(F.col("id") == statement_id).select("parent", F.col("seq").alias("_at")).limit(1)
    kept = statements.where(F.col("id") != statement_id).join(F.broadcast(gone), "parent", "left")
    return kept.withColumn("seq", F.when(F.col("seq") > F.col("_at"), F.col("seq") - 1).otherwise(F.col("seq"))).drop("_at").select(*statements.columns)


def reorder_statements(statements: DataFrame, order: DataFrame) -> DataFrame:
    """New positions (id, new_seq) of some statements."""
    return statements.join(order, "id", "left").withColumn("seq", F.coalesce("new_seq", "seq")).drop("new_seq").select(*statements.columns)


def replace_table(table: DataFrame, path: str) -> str:
    """A new version beside the old one; returns its path, which a catalogue pointer may then name."""
    version = f"{path.rstrip('/')}/{shared_path(table.sparkSession, 'v').rsplit('/', 1)[1]}"
    table.write.parquet(version)
    return version
