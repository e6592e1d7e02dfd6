"""Schemas of the property graph: vertex tables, one edge table, and the labels that each edge type joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, B, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


PARAM = _struct(("name", S), ("type_hint", S), ("default", S), ("kind", S))

LOGIC_NODES = _struct(
    ("id", S), ("ast_hash", S), ("structural_hash", S), ("kind", S), ("name", S), ("module_path", S), ("signature", S), ("source_text", S),
    ("semantic_intent", S), ("docstring", S), ("decorators", T.ArrayType(S)), ("params", T.ArrayType(PARAM)), ("return_type", S),
    ("tags", T.ArrayType(S)), ("class_id", S), ("derived_from", S), ("start_line", I), ("end_line", I), ("status", S), ("created_at", TS), ("updated_at", TS),
)
VARIABLES = _struct(("id", S), ("name", S), ("scope", S), ("origin_node_id", S), ("origin_line", I), ("type_hint", S), ("is_parameter", B), ("is_attribute", B), ("created_at", TS))
SHAPE_DEFINITION = _struct(("kind", S), ("base_type", S), ("type", S), ("attrs", T.ArrayType(S)), ("subscripts", T.ArrayType(S)), ("methods", T.ArrayType(S)))
TYPE_SHAPES = _struct(("id", S), ("shape_hash", S), ("kind", S), ("base_type", S), ("definition", SHAPE_DEFINITION), ("created_at", TS))
FLOWS = _struct(
    ("id", S), ("name", S), ("description", S), ("entry_point", S), ("exit_points", T.ArrayType(S)), ("node_ids", T.ArrayType(S)),
    ("sub_flow_ids", T.ArrayType(S)), ("parent_flow_id", S), ("promoted_node_id", S), ("created_at", TS), ("updated_at", TS),
)
STATEMENTS = _struct(
    ("id", S), ("label", S), ("name", S), ("kind", S), ("source_text", S), ("condition_text", S), ("start_line", I), ("end_line", I),
    ("start_col", I), ("end_col", I), ("seq", I), ("module_path", S), ("parent", S),
)
EDGES = _struct(
    ("type", S), ("src", S), ("dst", S), ("call_line", I), ("line", I), ("col", I), ("seq", I), ("call_order", I), ("arg_position", I), ("step_order", I),
    ("arg_keyword", S), ("param_name", S), ("mutation_kind", S), ("control_context", S), ("branch", S), ("access", S), ("via", S), ("alias", S),
    ("kind", S), ("strength", S), ("is_rebind", B), ("weight", T.DoubleType()), ("properties", T.MapType(S, S)),
)

#: Kinds of nodes, states, and the edge types with the labels that they join.
NODE_KINDS = ("function", "method", "class", "constant", "type_alias", "flow_function")
STATUSES = ("active", "deprecated")
LABELS = ("LogicNode", "Variable", "TypeShape", "Flow")
EDGE_ENDS = {
    "CALLS": ("LogicNode", "LogicNode"),
    "DEPENDS_ON": ("LogicNode", "LogicNode"),
    "IMPLEMENTS": ("LogicNode", "LogicNode"),
    "VALIDATES": ("LogicNode", "LogicNode"),
    "TRANSFORMS": ("LogicNode", "LogicNode"),
    "INHERITS": ("LogicNode", "LogicNode"),
    "MEMBER_OF": ("LogicNode", "LogicNode"),
    "ASSIGNS": ("LogicNode", "Variable"),
    "MUTATES": ("LogicNode", "Variable"),
    "READS": ("LogicNode", "Variable"),
    "RETURNS": ("LogicNode", "Variable"),
    "PASSES_TO": ("Variable", "Variable"),
    "FEEDS": ("Variable", "Variable"),
    "STEP_OF": ("LogicNode", "Flow"),
    "CONTAINS_FLOW": ("Flow", "Flow"),
    "PROMOTED_TO": ("Flow", "LogicNode"),
    "HAS_SHAPE": ("Variable", "TypeShape"),
    "ACCEPTS": ("LogicNode", "TypeShape"),
    "PRODUCES": ("LogicNode", "TypeShape"),
    "COMPATIBLE_WITH": ("TypeShape", "TypeShape"),
}
STATEMENT_EDGES = ("DEFINES", "IMPORTS", "CONTAINS", "NEXT")
DEPENDENCY_TYPES = ("CALLS", "DEPENDS_ON", "IMPLEMENTS", "VALIDATES", "TRANSFORMS")
ROLE_TYPES = ("ASSIGNS", "MUTATES", "READS", "RETURNS")

#: What identifies an edge: one per pair, or one per pair and place in the source.
EDGE_KEY = ("type", "src", "dst")
EDGE_KEY_BY_PLACE = {"CALLS": ("call_line",), "PASSES_TO": ("call_line",), "ASSIGNS": ("line", "seq"), "MUTATES": ("line", "seq"), "READS": ("line", "seq"), "RETURNS": ("line", "seq"), "FEEDS": ("line", "seq")}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences between a DataFrame's columns and a schema, as sentences; empty if there are none."""
    have = dict(df.dtypes)
    return [f"{f.name} is missing" if f.name not in have else f"{f.name} is {have[f.name]}, not {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType.simpleString()]
