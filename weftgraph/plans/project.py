"""A property graph projected from relational tables, and the same projection as SQL.

Parts are functions, suppliers are classes, nations and regions are packages, orders are variables.  Parts that
follow each other in an order call each other, suppliers use orders by the lines' flags, orders of a customer pass
values on.  The SQL text defines the same tables by the same names, to compare results with another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import CodeGraph
from weftgraph.storage import KEPT, Buckets

_NODES = """
SELECT concat('p', p_partkey) AS id, p_name AS name, lower(p_type) AS kind, p_brand AS module_path,
       cast(p_size AS string) AS return_type, CASE WHEN p_size % 10 = 9 THEN 'deprecated' ELSE 'active' END AS status,
       md5(p_name) AS ast_hash, md5(concat(p_name, p_type)) AS structural_hash,
       concat(p_name, ' of ', p_type) AS semantic_intent, p_size AS start_line, p_size + 9 AS end_line
FROM part
UNION ALL
SELECT concat('s', s_suppkey), s_name, 'class', concat('nation.', s_nationkey), NULL, 'active', md5(s_name), md5(s_name), s_name, 1, 99 FROM supplier
UNION ALL
SELECT concat('t', n_nationkey), n_name, 'package', concat('region.', n_regionkey), NULL, 'active', md5(n_name), md5(n_name), n_name, 1, 1 FROM nation
UNION ALL
SELECT concat('r', r_regionkey), r_name, 'package', 'world', NULL, 'active', md5(r_name), md5(r_name), r_name, 1, 1 FROM region
"""
_VARIABLES = """
SELECT concat('o', o_orderkey) AS id, concat('order_', o_orderkey) AS name, concat('cust_', o_custkey) AS scope,
       o_orderpriority AS type_hint, o_orderstatus = 'P' AS is_parameter, cast(o_orderkey % 1000 AS int) AS origin_line
FROM orders
"""
_PAIRS = """
SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b, l_linenumber AS line
FROM lineitem {where}
"""
_NARROW = "WHERE l_returnflag = 'R' AND l_linestatus = 'F'"
_ACCEPTED = "WHERE l_returnflag = 'A' AND l_linestatus = 'O'"
_CALLS = """
SELECT '{name}' AS type, concat('p', a) AS src, concat('p', b) AS dst, min(line) AS line, cast(NULL AS int) AS seq
FROM ({pairs}) x WHERE b IS NOT NULL AND a <> b GROUP BY a, b
"""
_USES = """
SELECT CASE WHEN l_returnflag = 'N' THEN 'ASSIGNS' WHEN l_returnflag = 'R' THEN 'MUTATES' WHEN l_linestatus = 'F' THEN 'READS' ELSE 'RETURNS' END AS type,
       concat('s', l_suppkey) AS src, concat('o', l_orderkey) AS dst, min(l_linenumber) AS line, min(l_linenumber) AS seq
FROM lineitem GROUP BY 1, l_suppkey, l_orderkey
"""
_MEMBER = """
SELECT 'MEMBER_OF' AS type, concat('s', s_suppkey) AS src, concat('t', s_nationkey) AS dst, cast(NULL AS int) AS line, cast(NULL AS int) AS seq FROM supplier
UNION ALL
SELECT 'INHERITS', concat('t', n_nationkey), concat('r', n_regionkey), NULL, NULL FROM nation
"""
_PASSES = """
SELECT * FROM (
  SELECT 'PASSES_TO' AS type, concat('o', o_orderkey) AS src, concat('o', lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS dst,
         cast(o_orderkey % 1000 AS int) AS line, cast(NULL AS int) AS seq FROM orders
  UNION ALL
  SELECT 'FEEDS', concat('o', o_orderkey), concat('o', lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)),
         cast(o_orderkey % 1000 AS int), NULL FROM orders) y
WHERE dst IS NOT NULL AND dst <> 'o'
"""
_FROM = re.compile(r"\bFROM (region|nation|supplier|part|orders|lineitem|customer|events|documents)\b")


def calls_sql(wide: bool = False) -> str:
    """Edges between parts; the wide form takes all lines and is named CALLS too."""
    return _CALLS.format(name="CALLS", pairs=_PAIRS.format(where="" if wide else _NARROW))


def depends_sql() -> str:
    """DEPENDS_ON edges between parts that follow each other among the lines that were accepted and are open."""
    return _CALLS.format(name="DEPENDS_ON", pairs=_PAIRS.format(where=_ACCEPTED))


def prelude() -> str:
    """Common table expressions nodes, variables, calls, wide_calls, uses, packs, passes, edges for a SQL engine."""
    duck = lambda text: text.replace("AS string)", "AS varchar)")
    parts = {"nodes": _NODES, "variables": _VARIABLES, "calls": calls_sql(), "wide_calls": calls_sql(True), "depends": depends_sql(), "uses": _USES, "packs": _MEMBER, "passes": _PASSES}
    ctes = [f"{name} AS ({duck(text).strip()})" for name, text in parts.items()]
    ctes.append("edges AS (SELECT * FROM calls UNION ALL SELECT * FROM depends UNION ALL SELECT * FROM uses UNION ALL SELECT * FROM packs UNION ALL SELECT * FROM passes)")
    return ",\n".join(ctes)


def with_prelude(body: str) -> str:
    """SQL whose body may name the projected tables; ``WITH RECURSIVE`` is always allowed."""
    text = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return f"WITH RECURSIVE {prelude()},\n{text.removeprefix(start)}"
    return f"WITH RECURSIVE {prelude()}\n{text}"


class Projection:
    """The projected graph of one directory of tables.

    Its vertex and edge tables are written to the shared folder once, in ranges of id or src, and every query reads them from
    there, so that point lookups skip files and row groups by their least and greatest keys.  They are made anew when the
    files that they come from have changed, and deleted by ``drop``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables, which are bound by name without temporary views."""
        used = {t: self.table(t) for t in set(_FROM.findall(text))}
        return self.spark.sql(_FROM.sub(lambda m: f"FROM {{{m[1]}}}", text), **used)

    def _kept(self, name: str, text: str, key: str) -> DataFrame:
        """The rows of a projection, read from its written form."""
        make = lambda: self.sql(text).repartitionByRange(key).sortWithinPartitions(key)
        return self.kept(name, sorted(set(_FROM.findall(text))), make).read()

    def kept(self, name: str, tables: list[str], make: Callable[[], Buckets | DataFrame]) -> Buckets:
        """What is made of some tables of the directory, until their files change."""
        return KEPT.get(self.spark, name, [f"{self.sf_dir}/{t}.parquet" for t in tables], make)

    @staticmethod
    def drop(spark: SparkSession) -> None:
        """Delete what was kept of all directories."""
        KEPT.drop(spark)

    @property
    def nodes(self) -> DataFrame:
        return self._kept("nodes", _NODES, "id")

    @property
    def variables(self) -> DataFrame:
        return self._kept("variables", _VARIABLES, "id")

    @property
    def calls(self) -> DataFrame:
        return self._kept("calls", calls_sql(), "src")

    @property
    def wide_calls(self) -> DataFrame:
        return self._kept("wide-calls", calls_sql(True), "src")

    @property
    def depends(self) -> DataFrame:
        return self._kept("depends", depends_sql(), "src")

    @property
    def uses(self) -> DataFrame:
        return self._kept("uses", _USES, "src")

    @property
    def packs(self) -> DataFrame:
        return self.sql(_MEMBER)

    @property
    def passes(self) -> DataFrame:
        return self._kept("passes", _PASSES, "src")

    @property
    def edges(self) -> DataFrame:
        return self.calls.unionByName(self.depends).unionByName(self.uses).unionByName(self.packs).unionByName(self.passes)

    def graph(self, edges: DataFrame | None = None, **tables: DataFrame) -> CodeGraph:
        """The graph, with all edges or with those given."""
        nodes = self.nodes.withColumns({c: F.lit(None).cast("string") for c in ("docstring", "source_text")})
        return CodeGraph.of(self.spark, **{"nodes": nodes, "variables": self.variables, "edges": self.edges if edges is None else edges} | tables)


__all__ = ["Projection", "calls_sql", "prelude", "with_prelude", "schema"]
