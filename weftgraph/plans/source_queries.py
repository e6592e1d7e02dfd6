"""Named queries of extraction, over Python sources that are derived from whole documents.

Each document is a module: two imports, a class with a method, a function, and a function with one statement for each line
of the text, whose kind and number follow from the line's length.  So SQL can say what nodes, edges, statements and
shapes an extraction must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.tables import Extraction, counted, records
from weftgraph.graph import CodeGraph
from weftgraph.operators import shapes
from weftgraph.plans.graph_queries import query
from weftgraph.plans.project import Projection
from weftgraph.storage import shared_path

_HEAD = (
    "from pkg.mod import helper as h", "from .near import x", "", "",
    "class Box:", "    def put(self, item):", "        self.size = item", "        return item", "", "",
    "def g(x, key=None):", "    return x", "", "",
    "def f(total, items, data: Box):",
)
#: Statement of a line by its length modulo their number; N is the length.
_KINDS = ("total = total + N", "items.append(N)", "if total > N: total = N", "total = g(total, key=items)", "total = data.fieldN", "data.put(total)", "h(items)")

def sources(documents: DataFrame) -> DataFrame:
    """(path, source) of every document."""

    def statement(line):
        n = F.length(line)
        kind = F.lit(None).cast("string")
        for k, text in enumerate(_KINDS):
            kind = F.when(n % len(_KINDS) == k, F.replace(F.lit(text), F.lit("N"), n.cast("string"))).otherwise(kind)
        return F.concat(F.lit("    "), kind)

    body = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), statement)
    whole = F.concat(F.array(*[F.lit(x) for x in _HEAD]), body, F.array(F.lit("    return total")))
    return documents.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.array_join(whole, "\n").alias("source"))


def _extraction(p: Projection, *kinds: str, bodies: bool = True) -> Extraction:
    """The extraction of a directory's documents, or its records of some kinds, kept until the documents' files change."""
    name = "-".join(["source-records", *kinds, *([] if bodies else ["outline"])])
    return Extraction(p.kept(name, ["documents"], lambda: records(sources(p.table("documents")), kinds, bodies)).read())


_SQL_KINDS = " ".join(f"WHEN {k} THEN '{text.replace('N', chr(39) + ' || n || ' + chr(39))}'" for k, text in enumerate(_KINDS))
_SQL_HEAD = ", ".join("'" + x + "'" for x in _HEAD)
_BASE = """
base AS (SELECT 'src.d' || doc_id AS m, 'src/d' || doc_id || '.py' AS path, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ln AS (SELECT m, path, unnest(generate_series(1, len(l))) AS i, unnest(list_transform(l, lambda x: length(x))) AS n FROM base),
st AS (SELECT m, path, i - 1 AS place, n, n % 7 AS k, 15 + i AS line FROM ln),
c AS (SELECT m, path, len(l) AS n FROM base)
"""


def _source_query(name: str, sql: str):
    return query(name, f"WITH {_BASE.strip()} {sql.strip()}" if not sql.strip().startswith(",") else f"WITH {_BASE.strip()}{sql.strip()}")


@_source_query(
    "x1_modules",
    f"""
, body AS (SELECT m, string_agg('    ' || CASE k {_SQL_KINDS} END, chr(10) ORDER BY place) AS b FROM st GROUP BY m)
SELECT c.m AS name, path AS module_path, CAST(16 + n AS INT) AS end_line, sha256(concat(array_to_string([{_SQL_HEAD}], chr(10)), chr(10), b, chr(10), '    return total')) AS checksum FROM c JOIN body USING (m)
""",
)
def _(p):
    return _extraction(p, "node").modules.select("name", "module_path", "end_line", "checksum")


@_source_query(
    "x1_definitions",
    """
SELECT m || '.Box' AS name, 'class' AS kind, path AS module_path, 5 AS start_line, 8 AS end_line, 'class Box' AS signature, CAST(NULL AS VARCHAR) AS return_type FROM c
UNION ALL SELECT m || '.Box.put', 'method', path, 6, 8, 'def put(self, item)', NULL FROM c UNION ALL SELECT m || '.g', 'function', path, 11, 12, 'def g(x, key=None)', NULL FROM c
UNION ALL SELECT m || '.f', 'function', path, 15, CAST(16 + n AS INT), 'def f(total, items, data: Box)', NULL FROM c
""",
)
def _(p):
    return _extraction(p, "node").nodes.select("name", "kind", "module_path", "start_line", "end_line", "signature", "return_type")


@_source_query(
    "x12_members",
    """
SELECT 'DEFINES' AS type, m AS src, m || d AS dst FROM c, (VALUES ('.Box'), ('.g'), ('.f')) v(d) UNION ALL SELECT 'DEFINES', m || '.Box', m || '.Box.put' FROM c UNION ALL SELECT 'MEMBER_OF', m || '.Box.put', m || '.Box' FROM c
""",
)
def _(p):
    return _extraction(p, "edge", bodies=False).named_edges.where("type IN ('DEFINES', 'MEMBER_OF', 'INHERITS')").select("type", "src", "dst")


@_source_query("x3_imports", "SELECT m AS src, d AS dst, a AS alias, CAST(k AS INT) AS line FROM c, (VALUES ('pkg.mod', NULL, 1), ('pkg.mod.helper', 'h', 1), ('src.near', NULL, 2), ('src.near.x', NULL, 2)) v(d, a, k)")
def _(p):
    return _extraction(p, "edge", bodies=False).named_edges.where("type = 'IMPORTS'").select("src", "dst", "alias", "line")


_CALLED = "CASE k WHEN 1 THEN 'items.append' WHEN 3 THEN m || '.g' WHEN 5 THEN m || '.Box.put' WHEN 6 THEN 'pkg.mod.helper' END"


@_source_query("x2_calls", f"SELECT m || '.f' AS src, {_CALLED} AS dst, CAST(line AS INT) AS call_line, CAST(row_number() OVER (PARTITION BY m ORDER BY place) - 1 AS INT) AS call_order FROM st WHERE k IN (1, 3, 5, 6)")
def _(p):
    """Callees by an import, a typed parameter's class, a module-level name, and as they stand."""
    return _extraction(p, "edge").named_edges.where("type = 'CALLS'").select("src", "dst", "call_line", "call_order")


_PLACED = "s AS (SELECT m, place, k, line, m || '.f.' || CASE WHEN k = 2 THEN 'cf_' ELSE 'stmt_' END || place AS name FROM st UNION ALL SELECT m, n, NULL, 16 + n, m || '.f.stmt_' || n FROM c)"


@_source_query(
    "x6_statements",
    f"""
, {_PLACED}
SELECT name, CASE WHEN k = 2 THEN 'ControlFlow' ELSE 'Statement' END AS label, CASE WHEN k IS NULL THEN 'return' WHEN k = 2 THEN 'if' WHEN k IN (1, 5, 6) THEN 'expression' ELSE 'assignment' END AS kind, CAST(place AS INT) AS seq, m || '.f' AS parent, CAST(line AS INT) AS start_line FROM s
UNION ALL SELECT name || '.branch_0', 'Branch', 'if', 0, name, CAST(line AS INT) FROM s WHERE k = 2 UNION ALL SELECT name || '.branch_0.stmt_0', 'Statement', 'assignment', 0, name || '.branch_0', CAST(line AS INT) FROM s WHERE k = 2
UNION ALL SELECT m || '.g.stmt_0', 'Statement', 'return', 0, m || '.g', 12 FROM c UNION ALL SELECT m || '.Box.put.stmt_0', 'Statement', 'assignment', 0, m || '.Box.put', 7 FROM c UNION ALL SELECT m || '.Box.put.stmt_1', 'Statement', 'return', 1, m || '.Box.put', 8 FROM c
""",
)
def _(p):
    return _extraction(p, "statement").statements.select("name", "label", "kind", "seq", "parent", "start_line")


@_source_query(
    "x6_order",
    f"""
, {_PLACED}
SELECT 'NEXT' AS type, name AS src, nxt AS dst FROM (SELECT name, lead(name) OVER (PARTITION BY m ORDER BY place) AS nxt FROM s) WHERE nxt IS NOT NULL UNION ALL SELECT 'NEXT', m || '.Box.put.stmt_0', m || '.Box.put.stmt_1' FROM c
UNION ALL SELECT 'CONTAINS', m || '.f', name FROM s UNION ALL SELECT 'CONTAINS', name, name || '.branch_0' FROM s WHERE k = 2 UNION ALL SELECT 'CONTAINS', name || '.branch_0', name || '.branch_0.stmt_0' FROM s WHERE k = 2
UNION ALL SELECT 'CONTAINS', m || '.g', m || '.g.stmt_0' FROM c UNION ALL SELECT 'CONTAINS', m || '.Box.put', m || '.Box.put.stmt_' || i FROM c, range(2) r(i)
""",
)
def _(p):
    return _extraction(p, "edge").named_edges.where("type IN ('NEXT', 'CONTAINS')").select("type", "src", "dst")


@_source_query(
    "x7_variables",
    """
SELECT m || v AS name, m || s AS scope, CAST(line AS INT) AS origin_line, hint AS type_hint, is_parameter, NOT is_parameter AS is_attribute
FROM c, (VALUES ('.Box.put.item', '.Box.put', 6, NULL, true), ('.Box.size', '.Box', 7, NULL, false), ('.g.x', '.g', 11, NULL, true), ('.g.key', '.g', 11, NULL, true), ('.f.total', '.f', 15, NULL, true), ('.f.items', '.f', 15, NULL, true), ('.f.data', '.f', 15, 'Box', true)) v(v, s, line, hint, is_parameter)
""",
)
def _(p):
    return _extraction(p, "variable").variables.select("name", "scope", "origin_line", "type_hint", "is_parameter", "is_attribute")


@_source_query(
    "x7_uses",
    """
, u AS (SELECT m, line, t, v, CASE WHEN k = 2 AND t = 'ASSIGNS' THEN 'if' END AS branch, CASE WHEN k = 2 AND t = 'ASSIGNS' THEN 'total > ' || n END AS context
        FROM st JOIN (VALUES (0, 'READS', 'total'), (0, 'ASSIGNS', 'total'), (1, 'MUTATES', 'items'), (2, 'READS', 'total'), (2, 'ASSIGNS', 'total'), (3, 'READS', 'total'), (3, 'READS', 'items'), (3, 'ASSIGNS', 'total'),
                             (4, 'READS', 'data'), (4, 'ASSIGNS', 'total'), (5, 'READS', 'data'), (5, 'READS', 'total'), (6, 'READS', 'items')) w(kk, t, v) ON kk = k
        UNION ALL SELECT m, 16 + n, 'RETURNS', 'total', NULL, NULL FROM c)
SELECT t AS type, m || '.f' AS src, m || '.f.' || v AS dst, CAST(line AS INT) AS line, CASE WHEN t = 'ASSIGNS' THEN true END AS is_rebind, branch, context AS control_context FROM u
UNION ALL SELECT 'RETURNS', m || '.g', m || '.g.x', 12, NULL, NULL, NULL FROM c UNION ALL SELECT 'RETURNS', m || '.Box.put', m || '.Box.put.item', 8, NULL, NULL, NULL FROM c
UNION ALL SELECT 'READS', m || '.Box.put', m || '.Box.put.item', 7, NULL, NULL, NULL FROM c UNION ALL SELECT 'ASSIGNS', m || '.Box.put', m || '.Box.size', 7, false, NULL, NULL FROM c
""",
)
def _(p):
    return _extraction(p, "edge").named_edges.where("type IN ('ASSIGNS', 'MUTATES', 'READS', 'RETURNS')").select("type", "src", "dst", "line", "is_rebind", "branch", "control_context")


@_source_query(
    "x10_passes",
    """
SELECT m || '.f.total' AS src, m || '.g.x' AS dst, CAST(line AS INT) AS call_line, 0 AS arg_position, NULL AS arg_keyword FROM st WHERE k = 3
UNION ALL SELECT m || '.f.items', m || '.g.key', CAST(line AS INT), 1, 'key' FROM st WHERE k = 3 UNION ALL SELECT m || '.f.total', m || '.Box.put.item', CAST(line AS INT), 0, NULL FROM st WHERE k = 5
""",
)
def _(p):
    return _extraction(p, "argument", "param").passes().select("src", "dst", "call_line", "arg_position", "arg_keyword")


@_source_query(
    "x10_feeds",
    """
SELECT m || CASE k WHEN 3 THEN '.f.items' ELSE '.f.data' END AS src, m || '.f.total' AS dst, CAST(line AS INT) AS line FROM st WHERE k IN (3, 4) UNION ALL SELECT m || '.Box.put.item', m || '.Box.size', 7 FROM c
""",
)
def _(p):
    return _extraction(p, "edge").feeds().select("src", "dst", "line")


_SHAPES = """
, e AS (SELECT m, list(DISTINCT 'field' || n ORDER BY 'field' || n) FILTER (k = 4) AS attrs, count(*) FILTER (k = 5) > 0 AS puts, count(*) FILTER (k = 1) > 0 AS appends FROM st GROUP BY m),
sh AS (SELECT m, m || '.f.data' AS variable, CASE WHEN attrs IS NOT NULL OR puts THEN 'structural' ELSE 'hint' END AS kind, 'Box' AS base_type, coalesce(array_to_string(attrs, ','), '') AS attrs, CASE WHEN puts THEN 'put' ELSE '' END AS methods FROM e
       UNION ALL SELECT m, m || '.f.items', 'structural', NULL, '', 'append' FROM e WHERE appends),
hashed AS (SELECT *, sha256(CASE WHEN kind = 'hint' THEN 'hint:Box' ELSE concat('structural:{base_type:', coalesce(base_type, ''), '|attrs:', attrs, '|methods:', methods, '|subscripts:}') END) AS shape_hash FROM sh)
"""


@_source_query("x9_shapes", f"{_SHAPES} SELECT variable, kind, base_type, attrs, methods, shape_hash FROM hashed")
def _(p):
    found = shapes.from_evidence(_extraction(p, "evidence", "variable").evidence)
    return found.select("variable", "kind", "base_type", F.array_join("attrs", ",").alias("attrs"), F.array_join("methods", ",").alias("methods"), "shape_hash")


@_source_query(
    "c7_shape_links",
    f"""
{_SHAPES}
SELECT 'HAS_SHAPE' AS type, variable AS src, shape_hash, NULL AS param_name FROM hashed UNION ALL SELECT 'HAS_SHAPE', variable, sha256('hint:Box'), NULL FROM hashed WHERE kind = 'structural' AND base_type = 'Box'
UNION ALL SELECT 'ACCEPTS', m || '.f', shape_hash, string_split(variable, '.')[-1] FROM hashed
""",
)
def _(p):
    e = _extraction(p)
    table, shaped = e.shaped()
    by_name = lambda df: df.select(F.col("name").alias("id"), "name")
    linked = shapes.links(by_name(e.variables), shaped.withColumnRenamed("variable", "variable_id"), by_name(e.nodes))
    return linked.join(table.select(F.col("id").alias("dst"), "shape_hash"), "dst").select("type", "src", "shape_hash", "param_name")


@_source_query(
    "x11_graph_edges",
    """
, d AS (SELECT m, k, count(*) AS n FROM st GROUP BY m, k), f AS (SELECT count(*) AS n, sum(n) AS lines FROM c)
SELECT 'CALLS' AS type, CAST(sum(n) AS BIGINT) AS n FROM d WHERE k IN (3, 5) UNION ALL SELECT 'MEMBER_OF', n FROM f UNION ALL SELECT 'PASSES_TO', CAST(sum(CASE k WHEN 3 THEN 2 * n ELSE n END) AS BIGINT) FROM d WHERE k IN (3, 5)
UNION ALL SELECT 'MUTATES', CAST(sum(n) AS BIGINT) FROM d WHERE k = 1 UNION ALL SELECT 'RETURNS', 3 * n FROM f UNION ALL SELECT 'FEEDS', CAST((SELECT sum(n) FROM d WHERE k IN (3, 4)) + n AS BIGINT) FROM f
""",
)
def _(p):
    """The whole graph: edges whose ends some file defines, by type."""
    edges = _extraction(p).graph().edges
    return edges.where("type IN ('CALLS', 'MEMBER_OF', 'PASSES_TO', 'MUTATES', 'RETURNS', 'FEEDS')").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@_source_query(
    "x11_extraction_report",
    """
, d AS (SELECT k, count(*) AS n FROM st GROUP BY k), f AS (SELECT count(*) AS n, sum(n) AS lines FROM c),
t AS (SELECT (SELECT coalesce(sum(n), 0) FROM d WHERE k IN (1, 3, 5, 6)) AS calls, (SELECT coalesce(sum(n), 0) FROM d WHERE k = 2) AS ifs,
             (SELECT sum(CASE k WHEN 1 THEN 1 WHEN 6 THEN 1 WHEN 3 THEN 3 ELSE 2 END * n) FROM d) AS uses, f.n, lines FROM f)
SELECT n AS files, CAST(4 * n AS BIGINT) AS nodes, CAST(7 * n AS BIGINT) AS variables, CAST(4 * n + 5 * n + calls + (lines + n + 2 * ifs + 3 * n) + (lines + n) + uses + 5 * n AS BIGINT) AS edges, CAST(lines + n + 2 * ifs + 3 * n AS BIGINT) AS statements, CAST(0 AS BIGINT) AS errors FROM t
""",
)
def _(p):
    """Counters of the import of all documents' sources."""
    return counted(sources(p.table("documents")))


# --- sources written anew, synchronised, indexed again


_SQL_BODY = " ".join(f"WHEN {k} THEN '    {text.replace('N', chr(39) + ' || n || ' + chr(39))}'" if k != 2 else "WHEN 2 THEN '    if total > ' || n || ':' || chr(10) || '        total = ' || n" for k, text in enumerate(_KINDS))


@_source_query(
    "w19_regenerated",
    f"""
SELECT m || '.f' AS name, concat('def f(total, items, data: Box):', chr(10), string_agg(CASE k {_SQL_BODY} END, chr(10) ORDER BY place), chr(10), '    return total', chr(10)) AS source FROM st GROUP BY m
UNION ALL SELECT m || '.g', concat('def g(x, key=None):', chr(10), '    return x', chr(10)) FROM c UNION ALL SELECT m || '.Box.put', concat('def put(self, item):', chr(10), '    self.size = item', chr(10), '    return item', chr(10)) FROM c
""",
)
def _(p):
    from weftgraph.extract.regenerate import functions

    e = _extraction(p, "node", "statement")
    return functions(e.nodes, e.statements)


@_source_query("w17_gone_from_sources", "SELECT m || '.old' AS name FROM c")
def _(p):
    """Stored nodes that the edited sources of their modules no longer define."""
    from weftgraph.sources import files

    nodes = _extraction(p, "node").nodes.select("id", "name", "module_path")
    old = p.table("documents").select(F.concat(F.lit("old"), "doc_id").alias("id"), F.concat(F.lit("src.d"), "doc_id", F.lit(".old")).alias("name"), F.concat(F.lit("src/d"), "doc_id", F.lit(".py")).alias("module_path"))
    stored = nodes.unionByName(old)
    _new, gone = files.sync_sources(sources(p.table("documents")), CodeGraph.of(p.spark, nodes=stored))
    return stored.join(gone, "id", "left_semi").select("name")


@_source_query("st5_indexed_again", "SELECT m || d AS name, path AS module_path FROM c, (VALUES ('.Box'), ('.Box.put'), ('.g2'), ('.f')) v(d)")
def _(p):
    """Every module after its function g was renamed: the old node goes, the others come back."""
    from weftgraph.streaming import changes

    renamed = sources(p.table("documents")).withColumn("source", F.replace("source", F.lit("def g("), F.lit("def g2(")))
    fresh = Extraction(records(renamed, ("node",)))  # read once
    return changes.reindexed_nodes(_extraction(p, "node").nodes, renamed, fresh.nodes).select("name", "module_path")


# --- trees of files, written from whole documents

_FOLDERS = ("a", "a/node_modules", "b/.hidden", "c/venv", ".git", "d/e")
#: Documents of one file.
_A_FILE = 20


def _file_tree(p: Projection) -> str:
    """The folder of a tree that is written for this call: the texts of twenty documents a file, in folders of which some are skipped."""
    from weftgraph.sources.files import write_files

    number = F.col("doc_id").cast("long")
    place = F.concat(F.element_at(F.array(*[F.lit(f) for f in _FOLDERS]), (F.floor(number / _A_FILE) % len(_FOLDERS) + 1).cast("int")), F.lit("/f"), F.floor(number / _A_FILE).cast("string"), F.lit(".py"))
    texts = p.table("documents").select(place.alias("path"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")).alias("d"))
    files = texts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["t"]), "\n").alias("source"))  # of twenty documents
    return write_files(files, shared_path(p.spark, "tree"))


_TREE = f"""
WITH f AS (SELECT [{', '.join(repr(f) for f in _FOLDERS)}][(doc_id // {_A_FILE}) % {len(_FOLDERS)} + 1] AS folder, 'f' || (doc_id // {_A_FILE}) || '.py' AS name,
                  string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS source FROM documents GROUP BY ALL)
SELECT folder || '/' || name AS path, sha256(source) AS checksum, length(source) AS n FROM f WHERE folder IN """


@query("s1_source_tree", _TREE + "('a', 'b/.hidden', 'c/venv', 'd/e')")
def _(p):
    """Files of a written tree outside the importer's skipped folders."""
    from weftgraph.sources import tree

    return tree.source_tree(p.spark, _file_tree(p)).select("path", "checksum", F.length("source").cast("long").alias("n"))


@query("s2_source_tree_without_dots", _TREE + "('a', 'd/e')")
def _(p):
    """Files of a written tree outside dotted folders and those that the watcher skips."""
    from weftgraph.sources import tree

    return tree.source_tree(p.spark, _file_tree(p), skipped=tree.SKIPPED_BEFORE, dot_folders=False).select("path", "checksum", F.length("source").cast("long").alias("n"))


@query("st1_source_changes", _TREE + "('a', 'd/e')")
def _(p):
    """The first batch of a stream over a written tree: all files that are watched."""
    from weftgraph.sources import tree
    from weftgraph.streaming import changes

    found = changes.written_stream(tree.source_changes(p.spark, _file_tree(p), settle=0), "st1-tree")
    return found.select("path", "checksum", F.length("source").cast("long").alias("n"))
