"""The property graph: one DataFrame per vertex table and one for edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.storage import written

TABLES = {"nodes": schema.LOGIC_NODES, "variables": schema.VARIABLES, "shapes": schema.TYPE_SHAPES, "flows": schema.FLOWS, "statements": schema.STATEMENTS, "edges": schema.EDGES}


@dataclass(frozen=True)
class CodeGraph:
    """Tables of a graph.  They may have more columns than the schemas; operators use those they name."""

    nodes: DataFrame
    variables: DataFrame
    edges: DataFrame
    shapes: DataFrame
    flows: DataFrame
    statements: DataFrame

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> CodeGraph:
        """A graph from the tables that there are; the others are empty."""
        return CodeGraph(**{name: tables.get(name) if tables.get(name) is not None else spark.createDataFrame([], s) for name, s in TABLES.items()})

    @staticmethod
    def read(spark: SparkSession, path: str) -> CodeGraph:
        """A graph that ``write`` has left; edges are partitioned by type, so a type filter prunes files."""
        return CodeGraph(**{name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in TABLES.items()})

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Lossless Parquet tables, edges partitioned by type and sorted by source for min/max pruning."""
        for name, s in TABLES.items():
            table = schema.conform(getattr(self, name), s)
            if name == "edges":
                table.repartition("type", F.pmod(F.xxhash64("src"), F.lit(16))).sortWithinPartitions("type", "src").write.mode(mode).partitionBy("type").parquet(f"{path}/{name}")
            else:
                table.write.mode(mode).parquet(f"{path}/{name}")

    def settled(self) -> CodeGraph:
        """The same graph read from files in the shared folder: a long chain of edits is planned once."""
        return CodeGraph(**{name: written(getattr(self, name), name) for name in TABLES})

    def with_(self, **tables: DataFrame) -> CodeGraph:
        return replace(self, **tables)

    @property
    def vertices(self) -> DataFrame:
        """id, label, name, kind, module_path, status of all labels: the unified view that generic patterns scan."""
        null = F.lit(None).cast("string")
        n = self.nodes.select("id", F.lit("LogicNode").alias("label"), "name", "kind", "module_path", "status")
        v = self.variables.select("id", F.lit("Variable").alias("label"), "name", null.alias("kind"), null.alias("module_path"), null.alias("status"))
        s = self.shapes.select("id", F.lit("TypeShape").alias("label"), F.col("shape_hash").alias("name"), "kind", null.alias("module_path"), null.alias("status"))
        f = self.flows.select("id", F.lit("Flow").alias("label"), "name", null.alias("kind"), null.alias("module_path"), null.alias("status"))
        t = self.statements.select("id", "label", "name", "kind", "module_path", null.alias("status"))
        return n.unionByName(v).unionByName(s).unionByName(f).unionByName(t)

    def typed(self, *types: str) -> DataFrame:
        """Edges of these types (all, if none is named)."""
        if not types:
            return self.edges
        return self.edges.where(F.col("type") == types[0] if len(types) == 1 else F.col("type").isin(*types))

    def active(self) -> DataFrame:
        return self.nodes.where(F.col("status") == "active")

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
