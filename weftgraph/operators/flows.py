"""Nodes and flows as services: creation with a duplicate warning, updates, sub-flows, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.extract.tables import Extraction
from weftgraph.graph import CodeGraph
from weftgraph.operators import mutate


def create_nodes(graph: CodeGraph, files: DataFrame) -> tuple[CodeGraph, DataFrame]:
    """The graph with the definitions of new sources (path, source), and warnings (id, duplicate_of) of equal code."""
    made = Extraction.of(files).graph()
    same = made.nodes.select("id", "ast_hash").join(graph.active().select(F.col("id").alias("duplicate_of"), "ast_hash"), "ast_hash").where("id <> duplicate_of").select("id", "duplicate_of")
    nodes = mutate.upsert(graph.nodes, made.nodes)
    both = graph.with_(nodes=nodes, variables=mutate.upsert(graph.variables, made.variables), shapes=mutate.insert_only(graph.shapes, made.shapes), edges=mutate.upsert(graph.edges, made.edges, schema.EDGE_KEY))
    return both, same


def update_nodes(graph: CodeGraph, files: DataFrame) -> tuple[CodeGraph, DataFrame]:
    """The graph with edited definitions hashed and their variables extracted anew, and ids whose signature changed.

    Edges that begin at an edited node are replaced; those from others stay.
    """
    made = Extraction.of(files).graph()
    old = graph.nodes.select("id", F.col("params").alias("_p"), F.col("return_type").alias("_t"))
    changed = made.nodes.join(old, "id").where(~F.to_json("params").eqNullSafe(F.to_json("_p")) | ~F.col("return_type").eqNullSafe(F.col("_t"))).select("id")
    edited = made.nodes.select(F.col("id").alias("src"))
    kept = graph.edges.join(edited, "src", "left_anti").select(*graph.edges.columns)
    gone = graph.variables.join(edited.withColumnRenamed("src", "origin_node_id"), "origin_node_id", "left_anti").select(*graph.variables.columns)
    return graph.with_(nodes=mutate.upsert(graph.nodes, made.nodes), variables=mutate.upsert(gone, made.variables), edges=mutate.upsert(kept, made.edges, schema.EDGE_KEY)), changed


def step_edges(flows: DataFrame) -> DataFrame:
    """STEP_OF and CONTAINS_FLOW edges of flows, numbered by their places in the lists."""
    steps = flows.select(F.posexplode("node_ids").alias("step_order", "src"), F.col("id").alias("dst")).select(F.lit("STEP_OF").alias("type"), "src", "dst", "step_order")
    subs = flows.select(F.col("id").alias("src"), F.posexplode("sub_flow_ids").alias("step_order", "dst")).select(F.lit("CONTAINS_FLOW").alias("type"), "src", "dst", "step_order")
    return steps.unionByName(subs)


def put_flows(graph: CodeGraph, flows: DataFrame) -> CodeGraph:
    """Create or replace flows with their step and sub-flow edges; steps and children must exist."""
    rows = schema.conform(flows, schema.FLOWS)
    table = mutate.upsert(graph.flows, rows)
    ids = rows.select("id")
    stale = graph.edges.where("type = 'STEP_OF'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").unionByName(graph.edges.where("type = 'CONTAINS_FLOW'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    kept = graph.edges.join(stale.select(*schema.EDGE_KEY), list(schema.EDGE_KEY), "left_anti").select(*graph.edges.columns)
    after = graph.with_(flows=table)
    return after.with_(edges=mutate.upsert_edges(kept, step_edges(rows), after.vertices))


def delete_flows(graph: CodeGraph, ids: DataFrame) -> CodeGraph:
    """Flows go with their edges; the nodes that were their steps stay."""
    flows, edges = mutate.detach_delete(graph.flows, graph.edges, ids)
    return graph.with_(flows=flows, edges=edges)


def add_sub_flow(graph: CodeGraph, parent: str, child: str) -> CodeGraph:
    """The child joins the end of the parent's list."""
    flows = graph.flows.where(F.col("id") == parent).withColumn("sub_flow_ids", F.array_distinct(F.array_append(F.coalesce("sub_flow_ids", F.array().cast("array<string>")), F.lit(child))))
    return put_flows(graph, flows)


def remove_sub_flow(graph: CodeGraph, parent: str, child: str) -> CodeGraph:
    flows = graph.flows.where(F.col("id") == parent).withColumn("sub_flow_ids", F.array_remove("sub_flow_ids", child))
    return put_flows(graph, flows)


def promote(graph: CodeGraph, flow_ids: Sequence[str], module_path: str) -> CodeGraph:
    """Flows become nodes of kind flow_function whose source calls the steps in order, linked by PROMOTED_TO."""
    from weftgraph.functions.identity import node_id

    some = graph.flows.where(F.col("id").isin(*flow_ids))
    names = some.select("id", "name", F.posexplode("node_ids").alias("_p", "_n")).join(graph.nodes.select(F.col("id").alias("_n"), F.col("name").alias("_step")), "_n")
    calls = names.groupBy("id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_step"))), lambda s: F.concat(F.lit("    value = "), F.substring_index(s["_step"], ".", -1), F.lit("(value)"))), "\n").alias("_body"))
    short = F.lower(F.regexp_replace("name", r"\W+", "_"))
    source = F.concat(F.lit("def "), short, F.lit("(value):\n"), "_body", F.lit("\n    return value\n"))
    qualified = F.concat(F.lit(module_path.removesuffix(".py").replace("/", ".") + "."), short)
    made = calls.select(F.col("id").alias("_flow"), node_id(qualified).alias("id"), qualified.alias("name"), F.lit("flow_function").alias("kind"), F.lit(module_path).alias("module_path"), source.alias("source_text"), F.lit("active").alias("status"), F.sha2(source, 256).alias("ast_hash"))
    nodes = mutate.upsert(graph.nodes, schema.conform(made.drop("_flow"), schema.LOGIC_NODES))
    flows = graph.flows.join(made.select(F.col("_flow").alias("id"), F.col("id").alias("_node")), "id", "left").withColumn("promoted_node_id", F.coalesce("_node", "promoted_node_id")).select(*graph.flows.columns)
    after = graph.with_(nodes=nodes, flows=flows)
    links = made.select(F.lit("PROMOTED_TO").alias("type"), F.col("_flow").alias("src"), F.col("id").alias("dst"))
    return after.with_(edges=mutate.upsert_edges(graph.edges, links, after.vertices))
