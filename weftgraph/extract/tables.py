"""Sources to a graph: one parse per file on executors, then joins on tables.

Pass one makes nodes, variables, statements and raw edges of all files at once; pass two resolves edges by joining
names, so a file's edges see every other file's nodes.  Files are independent, so parsing scales with the number of
files; a file that does not parse gives one error record.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import schema
from weftgraph.functions import identity
from weftgraph.graph import CodeGraph
from weftgraph.operators import match, shapes
from weftgraph.session import ship
from weftgraph.storage import written

_TEXT = (
    "record", "module", "label", "type", "src", "dst", "name", "kind", "scope", "text", "docstring", "signature", "return_type", "parent", "type_hint", "origin_func",
    "mutation_kind", "control_context", "branch", "facet", "item", "alias", "checksum", "condition", "access", "variable", "function",
    "call_id", "caller", "callee", "keyword", "arg", "params", "decorators",
)
_INT = ("start_line", "end_line", "start_col", "end_col", "seq", "line", "call_line", "call_order", "origin_line", "position", "walk_order")
_BOOL = ("is_async", "is_parameter", "is_attribute", "is_rebind")
RECORDS = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.StringType()) for n in _TEXT), *(T.StructField(n, T.IntegerType()) for n in _INT), *(T.StructField(n, T.BooleanType()) for n in _BOOL)])

#: What records of a kind have besides path and record.
_HAVE = {
    "node": ("module", "label", "kind", "name", "parent", "text", "docstring", "decorators", "signature", "params", "return_type", "checksum", "start_line", "end_line", "start_col", "end_col", "is_async"),
    "edge": ("module", "type", "src", "dst", "call_line", "line", "seq", "call_order", "mutation_kind", "control_context", "branch", "access", "alias", "is_rebind", "walk_order"),
    "statement": ("module", "label", "name", "kind", "text", "condition", "start_line", "end_line", "start_col", "end_col", "seq", "parent"),
    "variable": ("module", "name", "scope", "origin_line", "origin_func", "type_hint", "is_parameter", "is_attribute"),
    "evidence": ("module", "variable", "facet", "item", "type_hint", "function"),
    "argument": ("module", "call_id", "caller", "callee", "position", "keyword", "arg", "line", "seq"),
    "param": ("module", "callee", "position", "name", "variable", "keyword"),
    "error": ("module", "name", "text"),
}
#: Kinds that are told without reading the bodies of functions.
_OUTLINE = {"node", "param", "error"}

#: A batch of records goes on once files have given so many, or had so many characters.
BATCH_RECORDS, BATCH_CHARACTERS = 16_384, 4 << 20


def records(files: DataFrame, kinds: Sequence[str] = (), bodies: bool = True) -> DataFrame:
    """Extraction records of files (path, source): each file is parsed once.

    With ``kinds`` there are only records of these kinds and only the columns that they have; without ``bodies`` the bodies of
    functions are passed over, and edges and variables are those of definitions and imports.  Records go on by kind, many files
    together, so that a batch fills only the columns that its kind has.
    """
    ship(files.sparkSession)
    has = {"path", "record"}.union(*(_HAVE[k] for k in kinds))
    schema_ = T.StructType([f for f in RECORDS if f.name in has or not kinds])
    names, bodies = schema_.names, bodies and (not kinds or not _OUTLINE.issuperset(kinds))

    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.string() for f in schema_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.extract.walker import Walker

        held: dict[object, list[dict]] = {}
        n = size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for rows in held.values():
                used = {c for r in rows for c in r}
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) if c in used else pa.nulls(len(rows), t) for c, t in zip(names, types, strict=True)], names=names)
            held.clear()

        for batch in batches:
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = Walker(path, source or "", kinds=kinds, bodies=bodies).run()
                for r in rows:
                    r["path"] = path
                    for c in ("params", "decorators"):
                        if r.get(c) is not None:
                            r[c] = json.dumps(r[c])
                    held.setdefault(r["record"], []).append(r)
                n, size = n + len(rows), size + len(source or "")
                if n >= BATCH_RECORDS or size >= BATCH_CHARACTERS:
                    yield from told()
                    n = size = 0
        yield from told()

    return files.select("path", "source").mapInArrow(run, schema_)


def counted(files: DataFrame) -> DataFrame:
    """Counters of an import of files (path, source), one row: those of ``Extraction.report`` without any record leaving its task."""
    ship(files.sparkSession)
    told = {"nodes": "node", "variables": "variable", "edges": "edge", "statements": "statement", "errors": "error"}
    names = ["path", *told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.extract.walker import Walker

        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [Counter("module" if r.get("label") == "Module" else r["record"] for r in Walker(path, source or "").run()) for path, source in zip(paths, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([c[kind] for c in found], pa.int64()) for kind in told.values())], names=names)

    rows = files.select("path", "source").mapInArrow(run, "path string, " + ", ".join(f"{n} long" for n in told))
    return rows.agg(F.countDistinct("path").alias("files"), *[F.sum(n).alias(n) for n in told])


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("ast_hash", "structural_hash")]))
def _hashes(text: pa.Array, column: pa.Array) -> pa.Array:
    """Hashes of definitions, told from their text where they are read: a query that reads none pays for none."""
    found = [identity.hashes(identity.dedented(t, c)) for t, c in zip(text.to_pylist(), column.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], names=["ast_hash", "structural_hash"])


_OF_NODES = ("path", "kind", "signature", "text", "docstring", "decorators", "params", "return_type", "start_line", "end_line", "start_col")


@dataclass(frozen=True)
class Extraction:
    """Records of files, and the tables made from them."""

    records: DataFrame

    @staticmethod
    def of(files: DataFrame, *kinds: str) -> Extraction:
        return Extraction(written(records(files, kinds), "records"))

    def _of(self, record: str) -> DataFrame:
        return self.records.where(F.col("record") == record)

    @property
    def nodes(self) -> DataFrame:
        """Functions, methods and classes as logic nodes; equal qualified names are one node, the last path's."""
        params = T.ArrayType(schema.PARAM)
        n = self._of("node").where("label <> 'Module'").groupBy("name").agg(F.max_by(F.struct(*_OF_NODES), F.struct("path", "start_line")).alias("_r")).select("name", "_r.*")
        ship(n.sparkSession)
        hashed = _hashes(F.col("text"), F.col("start_col"))
        return n.select(
            identity.node_id(F.col("name")).alias("id"), hashed["ast_hash"].alias("ast_hash"), hashed["structural_hash"].alias("structural_hash"), "kind", "name", F.col("path").alias("module_path"), "signature", F.col("text").alias("source_text"),
            F.lit(None).cast("string").alias("semantic_intent"), "docstring", F.from_json("decorators", "array<string>").alias("decorators"), F.from_json("params", params).alias("params"), "return_type",
            F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("class_id"), F.lit(None).cast("string").alias("derived_from"), "start_line", "end_line", F.lit("active").alias("status"),
        )

    @property
    def modules(self) -> DataFrame:
        return self._of("node").where("label = 'Module'").select(F.col("name"), F.col("path").alias("module_path"), "start_line", "end_line", "checksum", "docstring")

    @property
    def errors(self) -> DataFrame:
        return self._of("error").select("path", F.col("text").alias("error"))

    @property
    def variables(self) -> DataFrame:
        """Variables, by name and scope; the origin is the first line."""
        v = self._of("variable")
        g = v.groupBy("name", "scope").agg(F.min("origin_line").alias("origin_line"), F.min_by("origin_func", "origin_line").alias("origin_func"), F.max("type_hint").alias("type_hint"), F.max("is_parameter").alias("is_parameter"), F.max("is_attribute").alias("is_attribute"))
        return g.select(identity.variable_id(F.col("name"), F.col("scope")).alias("id"), "name", "scope", identity.node_id(F.col("origin_func")).alias("origin_node_id"), "origin_line", "type_hint", "is_parameter", "is_attribute")

    @property
    def statements(self) -> DataFrame:
        return self._of("statement").select(F.col("name").alias("id"), "label", "name", "kind", F.col("text").alias("source_text"), F.col("condition").alias("condition_text"), "start_line", "end_line", "start_col", "end_col", "seq", F.col("path").alias("module_path"), "parent")

    @property
    def named_edges(self) -> DataFrame:
        """Edges by qualified names, before they are joined to ids."""
        return self._of("edge").select("type", "src", "dst", "call_line", "line", "seq", "call_order", "mutation_kind", "control_context", "branch", "access", "alias", "is_rebind", "walk_order", "path")

    def passes(self, cross_file: bool = False) -> DataFrame:
        """Arguments to parameters; by default only where the callee is in the caller's file."""
        args = self._of("argument").select("call_id", "callee", "position", "keyword", "arg", "line", "seq", "path")
        params = self._of("param").select("callee", "position", F.col("name").alias("param"), F.col("variable"), F.col("path").alias("callee_path"))
        by_place = args.where("keyword IS NULL").drop("keyword").join(params.drop("param"), ["callee", "position"]).withColumn("keyword", F.lit(None).cast("string"))
        by_name = args.where("keyword IS NOT NULL").drop("position").join(params.withColumnRenamed("param", "keyword"), ["callee", "keyword"])
        both = by_place.unionByName(by_name)
        both = both if cross_file else both.where("path = callee_path")
        return both.where("arg <> variable").select(F.lit("PASSES_TO").alias("type"), F.col("arg").alias("src"), F.col("variable").alias("dst"), F.col("line").alias("call_line"), "line", "seq", F.col("position").alias("arg_position"), F.col("keyword").alias("arg_keyword"))

    def feeds(self) -> DataFrame:
        """What a line reads feeds what it assigns or mutates."""
        e = self.named_edges
        reads = e.where("type = 'READS'").select(F.col("src").alias("function"), "line", F.col("dst").alias("variable"))
        writes = e.where("type IN ('ASSIGNS', 'MUTATES')").select(F.col("src").alias("function"), "line", F.col("dst").alias("variable"))
        return match.feeds_by_line(reads, writes).select(F.lit("FEEDS").alias("type"), "src", "dst", "line", F.lit("assignment").alias("via"))

    @property
    def evidence(self) -> DataFrame:
        """Rows (variable, facet, item, type_hint), also for variables with a hint only."""
        used = self._of("evidence").select("variable", "facet", "item", "type_hint")
        hinted = self._of("variable").where("type_hint IS NOT NULL").select(F.col("name").alias("variable"), F.lit(None).cast("string").alias("facet"), F.lit(None).cast("string").alias("item"), "type_hint")
        return used.unionByName(hinted)

    def shaped(self) -> tuple[DataFrame, DataFrame]:
        """(shapes, links of variables to shapes); a structural variable with a telling hint has a dual hint shape."""
        one = shapes.from_evidence(self.evidence).withColumn("dual", F.lit(False))
        dual = one.where((F.col("kind") == "structural") & F.col("base_type").isNotNull() & ~shapes.outer(F.col("base_type")).isin(*shapes.PRIMITIVES))
        dual = dual.withColumn("kind", F.lit("hint")).withColumn("dual", F.lit(True))
        empty = F.array().cast("array<string>")
        dual = dual.withColumn("attrs", empty).withColumn("subscripts", empty).withColumn("methods", empty).withColumn("shape_hash", F.sha2(F.concat(F.lit("hint:"), "base_type"), 256))
        both = one.unionByName(dual).withColumn("id", identity.shape_id(F.col("shape_hash")))
        table = both.groupBy("id", "shape_hash").agg(*[F.first(c).alias(c) for c in ("kind", "base_type", "attrs", "subscripts", "methods")])
        definition = F.struct("kind", "base_type", F.col("base_type").alias("type"), "attrs", "subscripts", "methods")
        return table.withColumn("definition", definition), both.select("variable", F.col("id").alias("shape_id"), "dual")

    def graph(self, cross_file: bool = False, facets: bool = False) -> CodeGraph:
        """X11: the graph, edges resolved by name; edges whose ends nobody defines are dropped.

        ``facets`` adds the pairs of facet clusters, which are quadratic in the number of distinct untyped shapes.
        """
        nodes, variables = self.nodes, self.variables
        names = nodes.select("id", "name").unionByName(variables.select("id", "name")).unionByName(self.statements.select("id", "name")).unionByName(self.modules.select(F.col("name").alias("id"), "name"))
        raw = self.named_edges.drop("path", "walk_order").unionByName(self.passes(cross_file), allowMissingColumns=True).unionByName(self.feeds(), allowMissingColumns=True)
        found = raw.join(names.select(F.col("name").alias("src"), F.col("id").alias("_s")), "src").join(names.select(F.col("name").alias("dst"), F.col("id").alias("_d")), "dst")
        edges = found.drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
        table, shaped = self.shaped()
        linked = shapes.links(variables, shaped.join(variables.select(F.col("name").alias("variable"), F.col("id").alias("variable_id")), "variable").select("variable_id", "shape_id", "dual"), nodes)
        compatible = shapes.supersets(table).withColumn("strength", F.lit(None).cast("string")).unionByName(shapes.hint_links(table).withColumn("strength", F.lit(None).cast("string"))).unionByName(shapes.generalizations(table))
        compatible = compatible.unionByName(shapes.facet_clusters(table)) if facets else compatible
        edges = edges.unionByName(linked, allowMissingColumns=True).unionByName(compatible.withColumn("type", F.lit("COMPATIBLE_WITH")), allowMissingColumns=True)
        modules = self.modules.select(F.col("name").alias("id"), F.lit("Module").alias("label"), "name", F.lit("module").alias("kind"), F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("condition_text"), "start_line", "end_line", F.lit(0).alias("start_col"), F.lit(0).alias("end_col"), F.lit(0).alias("seq"), "module_path", F.lit(None).cast("string").alias("parent"))
        return CodeGraph.of(nodes.sparkSession, nodes=schema.conform(nodes, schema.LOGIC_NODES), variables=schema.conform(variables, schema.VARIABLES), statements=self.statements.unionByName(modules), shapes=table, edges=schema.conform(edges, schema.EDGES))

    def report(self) -> DataFrame:
        """Counters of an import, one row."""
        count = lambda cond, name: F.sum(F.when(F.expr(cond), 1).otherwise(0)).alias(name)
        return self.records.agg(F.countDistinct("path").alias("files"), count("record = 'node' AND label <> 'Module'", "nodes"), count("record = 'variable'", "variables"), count("record = 'edge'", "edges"), count("record = 'statement'", "statements"), count("record = 'error'", "errors"))


def changed(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """ST7: nodes whose content differs from the stored one, or that have no structural hash yet."""
    old = stored.select("id", F.col("ast_hash").alias("_a"), F.col("structural_hash").alias("_s"))
    return nodes.join(old, "id", "left").where("_a IS NULL OR _a <> ast_hash OR _s IS NULL").drop("_a", "_s")


def of_sources(spark, sources: Sequence[tuple[str, str]]) -> Extraction:
    """S3: extraction of sources in memory."""
    return Extraction.of(spark.createDataFrame(list(sources), "path string, source string"))
