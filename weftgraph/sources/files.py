"""Sources and sinks: directories of sources, JSON graph directories, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import translate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions.identity import node_id
from weftgraph.graph import CodeGraph
from weftgraph.session import ship
from weftgraph.storage import written

#: Folders that hold no sources.
SKIPPED = ("__pycache__", ".git", ".venv", "node_modules", ".tox", ".mypy_cache")
#: Source files that one task reads.
FILES_A_TASK = 500
SKIPPED_BEFORE = ("__pycache__", "node_modules", ".venv", "venv")


def python_files(spark: SparkSession, root: str, pattern: str = "*.py", skipped: Sequence[str] = SKIPPED, dot_folders: bool = True) -> DataFrame:
    """(path relative to root, source) of files below a root.

    Spark's own file readers pass over names that begin with an underscore or a dot (``__init__.py`` is one), so folders
    are listed by the executors, a level of the tree at a time, as contents are read.  ``dot_folders=False`` also skips
    every folder whose name begins with a dot.
    """
    from pyarrow import fs

    ship(spark)
    uri = root if "://" in root else f"file://{root}"
    _, base = fs.FileSystem.from_uri(uri)
    base = base.rstrip("/")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(folder))
                yield pa.RecordBatch.from_arrays([pa.array([i.path for i in found], pa.string()), pa.array([i.base_name for i in found], pa.string()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())], names=["file", "name", "folder"])

    level, found = spark.createDataFrame([(base,)], "file string"), None
    while not level.isEmpty():
        entries = written(level.repartition("file").mapInArrow(children, "file string, name string, folder boolean"), "listing")
        files = entries.where(~F.col("folder") & F.col("name").rlike(f"^{translate(pattern)}"))
        found = files if found is None else found.unionByName(files)
        level = entries.where(F.col("folder") & ~F.col("name").isin(*skipped))
        level = (level if dot_folders else level.where(~F.startswith("name", F.lit(".")))).select("file")
    listed = written(found.select(F.substring("file", len(base) + 2, 1 << 30).alias("path"), "file"), "listing")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_input_stream(file) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stream.read().decode("utf-8", "replace")])], names=["path", "source"])

    return listed.repartition(listed.count() // FILES_A_TASK + 1, "path").mapInArrow(read, "path string, source string")


def write_files(files: DataFrame, root: str) -> str:
    """Write each row (path, source) as a file below ``root``, which all executors must see; returns ``root``."""
    ship(files.sparkSession)
    uri = root if "://" in root else f"file://{root}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for path, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base.rstrip('/')}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base.rstrip('/')}/{path}") as out:
                    out.write((source or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("path", "source").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number
    return root


def content(files: DataFrame, path: str) -> DataFrame:
    """The content of one file."""
    return files.where(F.col("path") == path).select("source")


def json_lines(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """JSON lines, with a schema if one is given."""
    reader = spark.read.schema(columns) if columns else spark.read
    return reader.json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    """W21."""
    rows.write.mode("append").json(path)


def write_json_graph(graph: CodeGraph, path: str) -> None:
    """A graph as JSON: nodes, variables grouped by owner, shapes, flows, edges by type, and counts.

    Records have their keys in alphabetical order and all edge properties, so reading gives back what was written.
    Files are sharded by Spark's writers; a file per record would not scale.
    """
    ordered = lambda df: df.select(*sorted(df.columns))
    ordered(schema.conform(graph.nodes, schema.LOGIC_NODES)).write.json(f"{path}/nodes")
    ordered(schema.conform(graph.shapes, schema.TYPE_SHAPES)).write.json(f"{path}/type_shapes")
    ordered(schema.conform(graph.flows, schema.FLOWS)).write.json(f"{path}/flows")
    ordered(schema.conform(graph.statements, schema.STATEMENTS)).write.json(f"{path}/statements")
    v = schema.conform(graph.variables, schema.VARIABLES)
    fields = F.struct(*[F.col(c) for c in sorted(v.columns)])
    groups = v.groupBy(F.regexp_replace("scope", r"\.[^.]*$", "").alias("scope_group")).agg(F.sort_array(F.collect_list(fields)).alias("variables"))
    groups.select("scope_group", F.sha2("scope_group", 256).alias("scope_hash"), "variables").write.json(f"{path}/variables")
    e = schema.conform(graph.edges, schema.EDGES)
    ordered(e.withColumn("edge_type", F.col("type"))).write.partitionBy("edge_type").json(f"{path}/edges")
    e.groupBy("type").agg(F.count(F.lit(1)).alias("edges")).withColumn("version", F.lit(1)).coalesce(1).write.json(f"{path}/meta")


def read_json_graph(spark: SparkSession, path: str, strategy: str = "all") -> CodeGraph:
    """A graph from JSON; ``strategy`` may name edge types (comma-separated) to read only their shards."""
    read = lambda name, s: spark.read.schema(s).json(f"{path}/{name}")
    groups = spark.read.schema(f"scope_group string, scope_hash string, variables array<{schema.VARIABLES.simpleString()}>").json(f"{path}/variables")
    edges = read("edges", schema.EDGES)
    if strategy != "all":
        edges = edges.where(F.col("type").isin(*[t.strip() for t in strategy.split(",")]))
    return CodeGraph(nodes=read("nodes", schema.LOGIC_NODES), variables=groups.select(F.explode("variables").alias("v")).select("v.*"), edges=edges, shapes=read("type_shapes", schema.TYPE_SHAPES), flows=read("flows", schema.FLOWS), statements=read("statements", schema.STATEMENTS))


def sync_sources(projected: DataFrame, graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes of edited module sources (path, source): those to upsert, and ids of stored nodes that are gone from their module."""
    from weftgraph.extract.tables import Extraction

    new = Extraction.of(projected, "node").nodes
    mine = graph.nodes.join(projected.select(F.col("path").alias("module_path")).distinct(), "module_path", "left_semi")
    gone = mine.join(new.select("id"), "id", "left_anti").select("id")
    return new, gone


__all__ = ["append_json_lines", "content", "json_lines", "node_id", "python_files", "read_json_graph", "sync_sources", "write_files", "write_json_graph"]
