"""Named queries over the projected graph, each with SQL that defines its result for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import aggregate, match, mutate, scc, search, services, traverse
from weftgraph.plans.project import Projection, with_prelude

Build = Callable[[Projection], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under a name; its SQL may name the projected tables."""

    def add(build: Build) -> Build:
        QUERIES[name] = lambda spark, sf_dir: build(Projection(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return build

    return add


# --- scans and lookups


@query("s5_page", "SELECT id, name, kind FROM nodes WHERE kind = 'economy' ORDER BY name, id LIMIT 100 OFFSET 50")
def _(p):
    return aggregate.page(p.nodes.where("kind = 'economy'").select("id", "name", "kind"), ["name", "id"], 100, 50)


@query("s6_active_nodes", "SELECT id, name, module_path FROM nodes WHERE status = 'active'")
def _(p):
    return p.nodes.where("status = 'active'").select("id", "name", "module_path")


@query("s7_all_edges", "WITH v AS (SELECT id FROM nodes UNION ALL SELECT id FROM variables) SELECT type, src, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def _(p):
    return match.within(p.edges.select("type", "src", "dst"), p.graph().vertices)


@query("s7_every_edge", "SELECT type, src, dst FROM edges")
def _(p):
    return p.edges.select("type", "src", "dst")


@query("s8_point_lookup", "SELECT id, name, kind, module_path FROM nodes WHERE id = 'p42'")
def _(p):
    return p.nodes.where("id = 'p42'").select("id", "name", "kind", "module_path")


@query("s9_overview_nodes", "SELECT id, name, kind, module_path FROM nodes WHERE status = 'active' AND kind IN ('class', 'promo', 'small')")
def _(p):
    return services.overview(p.nodes, p.calls, ("class", "promo", "small"))[0]


@query("s13_modules", "SELECT DISTINCT module_path FROM nodes WHERE starts_with(module_path, 'Brand#1')")
def _(p):
    return services.modules(p.nodes, "Brand#1")


@query("s14_key_lookup", "SELECT id, ast_hash, structural_hash FROM nodes WHERE name = 'red widget' AND module_path = 'Brand#17' AND status = 'active'")
def _(p):
    return p.nodes.where("name = 'red widget' AND module_path = 'Brand#17' AND status = 'active'").select("id", "ast_hash", "structural_hash")


@query("s15_definition", "SELECT id, name FROM nodes WHERE kind = 'class' AND name = 'Supplier#000000007'")
def _(p):
    return services.definition(p.nodes, "Supplier#000000007").select("id", "name")




@query(
    "s12_line_chunks",
    """
SELECT md5(concat(path, ':', CAST(s AS VARCHAR))) AS id, path, CAST(s + 1 AS INT) AS start_line, CAST(least(s + 4, n) AS INT) AS end_line,
       array_to_string(list_slice(l, s + 1, s + 4), chr(10)) AS content
FROM (SELECT 'doc_' || doc_id AS path, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n,
             unnest(range(0, len(string_split(text, chr(10))), 3)) AS s FROM documents)
WHERE (s = 0 OR s - 3 + 4 < n) AND regexp_matches(array_to_string(list_slice(l, s + 1, s + 4), chr(10)), '[^ \t\n\r\f]')
""",
)
def _(p):
    return services.chunks(p.table("documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.col("text").alias("content")), 4, 1)


# --- predicates


@query("p1_projection", "SELECT id AS node_id, name AS node_name FROM nodes")
def _(p):
    return p.nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"))


@query("p5_labels", "SELECT CASE WHEN starts_with(id, 'o') THEN 'Variable' ELSE 'LogicNode' END AS label, count(*) AS n FROM (SELECT id FROM nodes UNION ALL SELECT id FROM variables) GROUP BY 1")
def _(p):
    return aggregate.counts_by(p.graph(p.calls).vertices.where(F.col("label").isin("LogicNode", "Variable")), "label")


@query("p8_contains", "SELECT id, name FROM nodes WHERE contains(name, 'wid')")
def _(p):
    return p.nodes.where(F.col("name").contains("wid")).select("id", "name")


@query("p9_prefix_suffix", "SELECT id, name FROM nodes WHERE starts_with(name, 'red') OR ends_with(name, 'gizmo')")
def _(p):
    return p.nodes.where(F.col("name").startswith("red") | F.col("name").endswith("gizmo")).select("id", "name")


@query("p10_regex", "SELECT id, name FROM nodes WHERE regexp_full_match(name, '(?i).*BOLT.*')")
def _(p):
    return p.nodes.where(F.col("name").rlike("^(?:(?i).*BOLT.*)$")).select("id", "name")


@query("p11_in_list", "SELECT id FROM nodes WHERE kind IN ('promo', 'large') AND name <> 'red widget'")
def _(p):
    return p.nodes.where(F.col("kind").isin("promo", "large") & (F.col("name") != "red widget")).select("id")


@query("p13_null_logic", "SELECT id FROM nodes WHERE return_type IS NULL OR return_type >= '3'")
def _(p):
    return p.nodes.where("return_type IS NULL OR return_type >= '3'").select("id")


# --- joins


@query("j1_out_edges", "SELECT type, src, dst FROM edges WHERE src = 's7'")
def _(p):
    return match.out_edges(p.edges, "s7").select("type", "src", "dst")


@query("j2_in_edges", "SELECT type, src, dst FROM edges WHERE dst = 'p42'")
def _(p):
    return match.in_edges(p.edges, "p42").select("type", "src", "dst")


@query("j3_both", "SELECT type, src, dst, 'out' AS direction FROM wide_calls WHERE src = 'p42' UNION ALL SELECT type, src, dst, 'in' FROM wide_calls WHERE dst = 'p42'")
def _(p):
    return match.both_edges(p.wide_calls, "p42").select("type", "src", "dst", "direction")


@query("j4_callers", "SELECT a.name AS src_name, b.name AS dst_name, c.src, c.dst FROM calls c JOIN nodes a ON a.id = c.src JOIN nodes b ON b.id = c.dst WHERE b.kind = 'promo'")
def _(p):
    return match.triples(p.calls, p.nodes, p.nodes.where("kind = 'promo'")).select("src_name", "dst_name", "src", "dst")


@query("j5_roles", "SELECT u.src AS node_id, u.dst AS variable_id, v.name AS variable, u.type AS role FROM uses u JOIN variables v ON v.id = u.dst")
def _(p):
    return match.with_role(p.uses, p.variables).select("node_id", "variable_id", "variable", "role")


@query("j6_overview_edges", "SELECT e.type, e.src, e.dst FROM calls e JOIN nodes a ON a.id = e.src AND a.status = 'active' AND a.kind IN ('promo', 'small') JOIN nodes b ON b.id = e.dst AND b.status = 'active' AND b.kind IN ('promo', 'small')")
def _(p):
    return services.overview(p.nodes, p.calls, ("promo", "small"))[1]


@query("j7_shared_variable", "SELECT DISTINCT w.src AS writer, r.src AS reader, w.dst AS variable FROM uses w JOIN uses r ON r.dst = w.dst AND w.type = 'MUTATES' AND r.type = 'READS' AND w.src <> r.src")
def _(p):
    return match.shared_variable(p.uses)


@query(
    "j8_arguments",
    """
WITH v AS (SELECT id, name, concat('fn_', substr(scope, 6)) AS scope FROM variables),
     f AS (SELECT id, concat('fn_', substr(id, 2)) AS name FROM nodes WHERE starts_with(id, 'p')),
     q AS (SELECT o1.id AS src, o2.id AS dst FROM v o1 JOIN v o2 ON o2.id = concat('o', CAST(CAST(substr(o1.id, 2) AS BIGINT) + 1 AS VARCHAR)))
SELECT c.src, c.dst, a.name AS arg_name, b.name AS param_name
FROM wide_calls c JOIN f x ON x.id = c.src JOIN f y ON y.id = c.dst JOIN v a ON a.scope = x.name JOIN q ON q.src = a.id JOIN v b ON b.id = q.dst AND b.scope = y.name
""",
)
def _(p):
    v = p.variables.select("id", "name", F.concat(F.lit("fn_"), F.substring("scope", 6, 20)).alias("scope"))
    n = p.nodes.where(F.col("id").startswith("p")).select("id", F.concat(F.lit("fn_"), F.substring("id", 2, 20)).alias("name"))
    q = v.select(F.col("id").alias("src"), F.concat(F.lit("o"), (F.substring("id", 2, 20).cast("long") + 1).cast("string")).alias("dst"))
    return match.arguments(p.wide_calls.select("src", "dst"), q, n, v)


@query(
    "j9_line_ranges",
    """
SELECT c.src AS owner, c.line, r.id AS statement FROM (SELECT src, line FROM uses WHERE type = 'MUTATES') c
JOIN (SELECT src, dst AS id, line AS start_line, line + 1 AS end_line FROM uses WHERE type = 'RETURNS') r
ON r.src = c.src AND c.line BETWEEN r.start_line AND r.end_line
""",
)
def _(p):
    ranges = p.uses.where("type = 'RETURNS'").select(F.col("src").alias("owner"), F.col("dst").alias("statement"), F.col("line").alias("start_line"), (F.col("line") + 1).alias("end_line"))
    return match.between_lines(p.uses.where("type = 'MUTATES'").select(F.col("src").alias("owner"), "line"), ranges, 2).select("owner", "line", "statement")


@query("j10_optional", "SELECT n.id, c.dst FROM nodes n LEFT JOIN calls c ON c.src = n.id WHERE n.kind = 'promo'")
def _(p):
    return match.optional(p.nodes.where("kind = 'promo'").select("id"), p.calls.select(F.col("src").alias("id"), "dst"), "id")


@query("j13_calls_both", "SELECT a.src FROM wide_calls a JOIN wide_calls b ON b.src = a.src WHERE a.dst = 'p1060' AND b.dst = 'p311'")
def _(p):
    return match.calls_both(p.wide_calls, "p1060", "p311")


@query("j14_entry_points", "SELECT id FROM nodes WHERE id IN (SELECT src FROM calls)")
def _(p):
    return match.having(p.nodes, p.calls).select("id")


@query("j15_leaves", "SELECT id FROM nodes n WHERE starts_with(id, 'p') AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.src = n.id) AND EXISTS (SELECT 1 FROM calls c WHERE c.dst = n.id)")
def _(p):
    return match.lacking(match.having(p.nodes.where(F.col("id").startswith("p")), p.calls, "dst"), p.calls).select("id")


@query("j15_dead_ends", "SELECT n.id FROM nodes n WHERE n.status = 'active' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.src = n.id)")
def _(p):
    return services.dead_ends(p.nodes, p.edges).select("id")


@query("j15_orphans", "SELECT n.id FROM nodes n WHERE n.status = 'active' AND n.kind <> 'class' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.type IN ('CALLS', 'DEPENDS_ON', 'MEMBER_OF'))")
def _(p):
    return services.orphans(p.nodes, p.edges).select("id")


@query("j15_untested_mutations", "SELECT DISTINCT dst AS id, src AS mutated_by FROM uses WHERE type = 'MUTATES' AND dst NOT IN (SELECT dst FROM uses WHERE type = 'READS')")
def _(p):
    return services.untested_mutations(p.uses)


@query("j16_two_cycles", "SELECT a.src AS a, a.dst AS b FROM wide_calls a JOIN wide_calls b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst")
def _(p):
    return match.two_cycles(p.wide_calls)


@query("j17_three_cycles", "SELECT x.src AS a, y.src AS b, z.src AS c FROM wide_calls x JOIN wide_calls y ON y.src = x.dst JOIN wide_calls z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src AND y.src <> z.src")
def _(p):
    return match.three_cycles(p.wide_calls)


@query("j17_three_cycles_ordered", "SELECT x.src AS a, y.src AS b, z.src AS c FROM wide_calls x JOIN wide_calls y ON y.src = x.dst JOIN wide_calls z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND y.src < z.src")
def _(p):
    return match.three_cycles(p.wide_calls, ordered=True)


@query("j18_batch_lookup", "SELECT k.name, k.module_path, n.id FROM (SELECT DISTINCT name, 'Brand#1' AS module_path FROM nodes) k LEFT JOIN nodes n ON n.name = k.name AND n.module_path = k.module_path AND n.status = 'active'")
def _(p):
    return match.lookup(p.nodes.select("name").distinct().withColumn("module_path", F.lit("Brand#1")), p.nodes)


@query("j19_induced", "SELECT type, src, dst FROM wide_calls WHERE src IN (SELECT id FROM nodes WHERE module_path = 'Brand#3') AND dst IN (SELECT id FROM nodes WHERE module_path = 'Brand#3')")
def _(p):
    return match.within(p.wide_calls, p.nodes.where("module_path = 'Brand#3'")).select("type", "src", "dst")


@query("j20_resolve", "SELECT id, name FROM nodes WHERE id IN ('p1', 'p2', 'red gear') OR name IN ('p1', 'p2', 'red gear')")
def _(p):
    values = p.spark.createDataFrame([("p1",), ("p2",), ("red gear",)], "value string")
    return match.resolve(values, p.nodes).select("id", "name")


@query("j21_file_members", "SELECT src, dst FROM calls WHERE src IN (SELECT id FROM nodes WHERE module_path = 'Brand#2') AND dst IN (SELECT id FROM nodes WHERE module_path = 'Brand#2')")
def _(p):
    return match.file_members(p.nodes, p.calls, "Brand#2")[1].select("src", "dst")


@query("j22_class_detail", "SELECT n.id, n.name FROM packs e JOIN nodes n ON n.id = e.src WHERE e.type = 'MEMBER_OF' AND e.dst = 't3'")
def _(p):
    return match.class_detail(p.nodes, p.edges, "t3")["members"].select("id", "name")


@query(
    "j22_class_details",
    """
WITH m AS (SELECT id, module_path AS c FROM nodes WHERE starts_with(id, 'p')),
inh AS (SELECT DISTINCT c, 'p' || substr(c, 7) || CASE WHEN length(c) > 7 THEN '' ELSE 'x' END AS base FROM m)
SELECT c AS class_id, 'member' AS part, id AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS BOOLEAN) AS external FROM m
UNION ALL SELECT c, 'base', c, base, base NOT IN (SELECT id FROM nodes) FROM inh
UNION ALL SELECT a.c, 'call', w.src, w.dst, NULL FROM (SELECT DISTINCT src, dst FROM wide_calls) w JOIN m a ON a.id = w.src JOIN m b ON b.id = w.dst AND b.c = a.c
""",
)
def _(p):
    """Brands as classes of parts; a brand inherits a part, or something unknown."""
    m = p.nodes.where("id LIKE 'p%'").select("id", F.col("module_path").alias("c"))
    base = F.concat(F.lit("p"), F.substr("c", F.lit(7)), F.when(F.length("c") > 7, "").otherwise("x"))
    edges = p.wide_calls.select("type", "src", "dst").union(m.select(F.lit("MEMBER_OF"), "id", "c")).union(m.select(F.lit("INHERITS"), "c", base).distinct())
    return match.class_details(p.nodes, edges)


@query(
    "j23_usages",
    """
WITH own AS (SELECT src, type, dst FROM wide_calls WHERE src = 'p42' OR dst = 'p42'),
     users AS (SELECT src AS id FROM own UNION SELECT dst FROM own)
SELECT src, type, dst FROM own UNION SELECT src, type, dst FROM wide_calls
WHERE src IN (SELECT id FROM users WHERE id <> 'p42') AND dst IN (SELECT id FROM users WHERE id <> 'p42')
""",
)
def _(p):
    return match.usages(p.wide_calls, "p42")


@query(
    "j24_function_detail",
    """
SELECT direction, type, other, n.name AS other_name, n.module_path <> (SELECT module_path FROM nodes WHERE id = 'p42') AS external
FROM (SELECT 'out' AS direction, type, dst AS other FROM wide_calls WHERE src = 'p42' UNION ALL SELECT 'in', type, src FROM wide_calls WHERE dst = 'p42') x JOIN nodes n ON n.id = x.other
""",
)
def _(p):
    return match.function_detail(p.wide_calls, p.nodes, "p42")


@query("j26_variable_detail", "SELECT type, src, dst FROM edges WHERE src = 'o77' OR dst = 'o77'")
def _(p):
    return match.both_edges(p.edges, "o77").select("type", "src", "dst")


@query("j27_module_graph", "SELECT DISTINCT a.module_path AS src_module, b.module_path AS dst_module FROM calls c JOIN nodes a ON a.id = c.src JOIN nodes b ON b.id = c.dst WHERE a.module_path <> b.module_path")
def _(p):
    return match.triples(p.calls, p.nodes, p.nodes).select(F.col("src_module_path").alias("src_module"), F.col("dst_module_path").alias("dst_module")).where("src_module <> dst_module").distinct()


@query("j28_members_like", "SELECT o.name AS class_name, n.id, n.name, n.kind FROM packs e JOIN nodes o ON o.id = e.dst JOIN nodes n ON n.id = e.src WHERE e.type = 'MEMBER_OF' AND contains(o.name, 'NATION_1') ORDER BY n.name, n.id, o.name LIMIT 50")
def _(p):
    return match.members_like(p.nodes, p.packs, "NATION_1")


@query(
    "j30_feeds_by_line",
    "SELECT DISTINCT r.dst AS src, w.dst AS dst, r.src AS function, r.line FROM uses r JOIN uses w ON w.src = r.src AND w.line = r.line AND r.type = 'READS' AND w.type = 'ASSIGNS' AND r.dst <> w.dst",
)
def _(p):
    u = p.uses.select(F.col("src").alias("function"), "line", F.col("dst").alias("variable"), "type")
    return match.feeds_by_line(u.where("type = 'READS'").drop("type"), u.where("type = 'ASSIGNS'").drop("type"))


@query(
    "h5_impact",
    """
SELECT DISTINCT w.src AS node, r.src AS affected, concat('reads ', w.dst) AS reason FROM uses w JOIN uses r ON r.dst = w.dst AND w.type = 'MUTATES' AND r.type = 'READS' AND w.src <> r.src
JOIN nodes n ON n.id = r.src AND n.status = 'active' UNION ALL SELECT DISTINCT dst, src, 'calls it' FROM calls WHERE src <> dst
""",
)
def _(p):
    return match.impact(p.edges, p.nodes)


@query(
    "h5_impact_of_retired",
    """
WITH n AS (SELECT id, CASE WHEN ends_with(id, '3') THEN 'deprecated' ELSE status END AS status FROM nodes),
     chosen AS (SELECT id FROM nodes WHERE kind = 'class' AND module_path = 'nation.7')
SELECT DISTINCT w.src AS node, r.src AS affected, concat('reads ', w.dst) AS reason FROM uses w JOIN uses r ON r.dst = w.dst AND w.type = 'MUTATES' AND r.type = 'READS' AND w.src <> r.src
JOIN n ON n.id = r.src AND n.status = 'active' WHERE w.src IN (SELECT id FROM chosen)
""",
)
def _(p):
    status = F.when(F.col("id").endswith("3"), "deprecated").otherwise(F.col("status"))
    return match.impact(p.edges, p.nodes.withColumn("status", status), p.nodes.where("kind = 'class' AND module_path = 'nation.7'"))


# --- traversal



def _entries(p: Projection) -> DataFrame:
    """Entry points: callers that nobody calls."""
    called = p.calls.select(F.col("dst").alias("id"))
    return p.calls.select(F.col("src").alias("id")).distinct().join(called, "id", "left_anti")


_WALK = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM calls
  UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < {depth})
SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY root, node
"""


@query("t1_reach", _WALK.format(depth=4))
def _(p):
    return traverse.reach(p.calls, p.nodes, 4)


@query("t1_reach_deep", _WALK.format(depth=8))
def _(p):
    return traverse.reach(p.calls, p.nodes, 8)


_DEPS = """
WITH RECURSIVE chosen AS (SELECT type, src, dst FROM calls UNION ALL SELECT type, src, dst FROM depends),
walk AS (
  SELECT DISTINCT {a} AS root, {b} AS node, 1 AS depth, type AS first FROM chosen
  UNION SELECT w.root, c.{b}, w.depth + 1, w.first FROM walk w JOIN chosen c ON c.{a} = w.node WHERE w.depth < 2),
least AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)
SELECT l.root, l.node, CAST(l.depth AS INT) AS depth, string_agg(DISTINCT w.first, ',' ORDER BY w.first) AS first
FROM least l JOIN walk w ON w.root = l.root AND w.node = l.node AND w.depth = l.depth GROUP BY l.root, l.node, l.depth
"""


@query("t2_dependencies", _DEPS.format(a="src", b="dst"))
def _(p):
    return traverse.dependencies(p.edges, p.nodes)


@query("t3_dependents", _DEPS.format(a="dst", b="src"))
def _(p):
    return traverse.dependents(p.edges, p.nodes)


@query(
    "t4_undirected_pack",
    """
WITH RECURSIVE u AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls),
walk AS (SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM u WHERE src IN ('p1', 'p2', 'p3')
  UNION SELECT w.root, u.dst, w.depth + 1 FROM walk w JOIN u ON u.src = w.node WHERE w.depth < 2)
SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY root, node
""",
)
def _(p):
    return traverse.reach(traverse.undirected(p.calls.select("src", "dst")), p.spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string"), 2)


@query("t6_call_chain_nodes", "WITH RECURSIVE walk AS (SELECT id AS node, 0 AS depth FROM nodes WHERE status = 'active' AND contains(name, 'red bolt') UNION SELECT c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < 2) SELECT DISTINCT n.id, n.name FROM walk w JOIN nodes n ON n.id = w.node")
def _(p):
    return services.call_chain(p.graph(p.calls), "red bolt").nodes.select("id", "name")


@query(
    "t7_hierarchy_pack",
    """
WITH own AS (SELECT id FROM nodes WHERE contains(name, 'NATION_1')),
     up AS (SELECT id FROM own UNION SELECT dst FROM packs WHERE type = 'INHERITS' AND src IN (SELECT id FROM own)),
     ids AS (SELECT id FROM up UNION SELECT src FROM packs WHERE type = 'MEMBER_OF' AND dst IN (SELECT id FROM up))
SELECT type, src, dst FROM packs WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
""",
)
def _(p):
    g = p.graph(p.packs)
    g = g.with_(nodes=g.nodes.withColumn("kind", F.when(F.col("kind") == "package", "class").otherwise("part")))
    return services.class_hierarchy(g, "NATION_1").edges.select("type", "src", "dst")


@query(
    "t9_timeline_pack",
    """
WITH v AS (SELECT id FROM variables WHERE contains(name, 'order_1234')),
     ids AS (SELECT id FROM v UNION SELECT src FROM uses WHERE dst IN (SELECT id FROM v) UNION SELECT dst FROM passes WHERE src IN (SELECT id FROM v))
SELECT type, src, dst FROM (SELECT * FROM uses UNION ALL SELECT * FROM passes) WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
""",
)
def _(p):
    return services.mutation_timeline(p.graph(), "order_1234").edges.select("type", "src", "dst")


_TRAILS = """
WITH RECURSIVE t AS (
  SELECT src AS root, dst AS node, 1 AS depth, concat(src, '>', dst) AS chain, [concat(src, '>', dst)] AS trail FROM calls WHERE {roots}
  UNION ALL SELECT t.root, c.dst, t.depth + 1, concat(t.chain, '>', c.dst), list_append(t.trail, concat(c.src, '>', c.dst))
  FROM t JOIN calls c ON c.src = t.node WHERE t.depth < {depth} AND NOT list_contains(t.trail, concat(c.src, '>', c.dst)))
"""
_ENTRIES = "src NOT IN (SELECT dst FROM calls)"


@query("t17_trails", _TRAILS.format(roots="true", depth=4) + "SELECT root, node, CAST(depth AS INT) AS depth, chain FROM t")
def _(p):
    return traverse.trails(p.calls, p.nodes, 4).select("root", "node", "depth", F.array_join("chain", ">").alias("chain"))


@query("t16_flow_paths", _TRAILS.format(roots=_ENTRIES, depth=10) + "SELECT DISTINCT root, chain AS path, CAST(depth + 1 AS INT) AS size FROM t")
def _(p):
    return traverse.flow_paths(p.calls, _entries(p), 10)


@query("t19_all_paths", _TRAILS.format(roots="src = 'p74'", depth=8) + "SELECT node, CAST(depth AS INT) AS depth, chain FROM t")
def _(p):
    found = traverse.trails(p.calls, p.spark.createDataFrame([("p74",)], "id string"), 8)
    return found.select("node", "depth", F.array_join("chain", ">").alias("chain")).orderBy("depth", "chain")


@query("t21_deepest", _TRAILS.format(roots=_ENTRIES, depth=8) + "SELECT root, CAST(max(depth) AS INT) AS depth FROM t WHERE node NOT IN (SELECT src FROM calls) GROUP BY root")
def _(p):
    return traverse.deepest(p.calls, _entries(p), 8)


_WALK = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM calls WHERE src NOT IN (SELECT dst FROM calls)
  UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < 10),
near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node),
"""


@query("t18_shortest", _WALK.rstrip().rstrip(",") + " SELECT root, node, CAST(depth AS INT) AS depth FROM near WHERE node NOT IN (SELECT src FROM calls)")
def _(p):
    leaves = match.lacking(p.calls.select(F.col("dst").alias("id")).distinct(), p.calls)
    return traverse.shortest(p.calls, _entries(p), leaves, 10, chains=False).select("root", "node", "depth")


@query(
    "t18_shortest_chains",
    _WALK.rstrip()
    + """
prev AS (SELECT n.root, n.node, min(c.src) AS before FROM near n JOIN calls c ON c.dst = n.node LEFT JOIN near m ON m.root = n.root AND m.node = c.src
         WHERE coalesce(m.depth, CASE WHEN c.src = n.root THEN 0 END) = n.depth - 1 GROUP BY n.root, n.node),
back AS (
  SELECT root, node, depth, node AS here, node AS chain FROM near WHERE node NOT IN (SELECT src FROM calls)
  UNION ALL SELECT b.root, b.node, b.depth, p.before, p.before || '>' || b.chain FROM back b JOIN prev p ON p.root = b.root AND p.node = b.here)
SELECT root, node, CAST(depth AS INT) AS depth, chain FROM back WHERE here = root
""",
)
def _(p):
    leaves = match.lacking(p.calls.select(F.col("dst").alias("id")).distinct(), p.calls)
    return traverse.shortest(p.calls, _entries(p), leaves, 10).select("root", "node", "depth", F.array_join("chain", ">").alias("chain"))


@query("t20_reverse_reach", "WITH RECURSIVE walk AS (SELECT DISTINCT src AS node, 1 AS depth FROM calls WHERE dst = 'p42' UNION SELECT c.src, w.depth + 1 FROM walk w JOIN calls c ON c.dst = w.node WHERE w.depth < 4) SELECT node, CAST(min(depth) AS INT) AS depth FROM walk WHERE node NOT IN (SELECT dst FROM calls) GROUP BY node")
def _(p):
    found = traverse.reach(traverse.reversed_edges(p.calls), p.spark.createDataFrame([("p42",)], "id string"), 4)
    return found.join(p.calls.select(F.col("dst").alias("node")), "node", "left_anti").select("node", "depth")


@query(
    "t22_data_flow",
    """
WITH RECURSIVE walk AS (
  SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM passes
  UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN passes c ON c.src = w.node WHERE w.depth < 5)
SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY root, node
""",
)
def _(p):
    return traverse.reach(p.passes, p.variables, 5)


@query("t23_closure", "WITH RECURSIVE walk AS (SELECT src AS root, dst AS node FROM passes WHERE type = 'PASSES_TO' UNION SELECT w.root, c.dst FROM walk w JOIN passes c ON c.src = w.node AND c.type = 'PASSES_TO') SELECT root, node FROM walk")
def _(p):
    return scc.reachable(p.passes.where("type = 'PASSES_TO'"), p.variables).pairs()


@query(
    "t23_components",
    """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON')),
walk AS (SELECT src AS root, dst AS node FROM e UNION SELECT w.root, e.dst FROM walk w JOIN e ON e.src = w.node)
SELECT a.root AS node, min(a.node) AS component, count(*) AS size FROM walk a JOIN walk b ON b.root = a.node AND b.node = a.root GROUP BY a.root HAVING count(*) > 1
""",
)
def _(p):
    """Nodes on cycles of calls and dependencies, by the smallest node of their component."""
    found = scc.components(p.edges.where("type IN ('CALLS', 'DEPENDS_ON')"))
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


@query("t14_hierarchy", "SELECT a.dst AS root, a.dst AS flow, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, a.dst AS path FROM packs a WHERE a.type = 'INHERITS' GROUP BY a.dst UNION ALL SELECT dst, src, dst, 1, concat(dst, '>', src) FROM packs WHERE type = 'INHERITS' UNION ALL SELECT i.dst, m.src, m.dst, 2, concat(i.dst, '>', i.src, '>', m.src) FROM packs m JOIN packs i ON i.src = m.dst AND i.type = 'INHERITS' WHERE m.type = 'MEMBER_OF'")
def _(p):
    roots = p.packs.where("type = 'INHERITS'").select(F.col("dst").alias("id")).distinct()
    return traverse.hierarchy(traverse.reversed_edges(p.packs), roots, 5)


@query("t15_flow_steps", "SELECT flow, string_agg(node, '>' ORDER BY step_order, node) AS steps FROM (SELECT DISTINCT dst AS flow, src AS node, line AS step_order FROM uses WHERE type = 'RETURNS') GROUP BY flow")
def _(p):
    flows = p.uses.where("type = 'RETURNS'").select(F.lit("STEP_OF").alias("type"), "src", "dst", F.col("line").alias("step_order"))
    return traverse.flow_steps(flows, p.calls).select("flow", "steps")


@query(
    "t15_flow_traversal",
    """
WITH st AS (SELECT DISTINCT 'w' || (substr(src, 2)::INT % 40) AS flow, dst AS node, line AS place FROM passes WHERE type = 'PASSES_TO' AND src <> dst),
e AS (SELECT DISTINCT src, dst FROM passes)
SELECT flow, 'step' AS part, CAST(place AS INT) AS place, node AS src, CAST(NULL AS VARCHAR) AS dst FROM st
UNION ALL SELECT a.flow, 'connection', NULL, e.src, e.dst FROM e JOIN (SELECT DISTINCT flow, node FROM st) a ON a.node = e.src JOIN (SELECT DISTINCT flow, node FROM st) b ON b.node = e.dst AND b.flow = a.flow
UNION ALL SELECT DISTINCT 'w' || (substr(src, 2)::INT % 40), 'sub_flow', CAST(line AS INT), NULL, 'w' || (substr(dst, 2)::INT % 40 + 40) FROM passes WHERE type = 'FEEDS'
""",
)
def _(p):
    """Flows of orders: steps, what connects them, and flows inside."""
    flow = lambda end, more=0: F.concat(F.lit("w"), (F.substr(end, F.lit(2)).cast("int") % 40 + more).cast("string"))
    passes = p.passes.withColumn("step_order", F.col("line").cast("int"))
    steps = passes.where("type = 'PASSES_TO' AND src <> dst").select(F.lit("STEP_OF").alias("type"), F.col("dst").alias("src"), flow("src").alias("dst"), "step_order")
    inner = passes.where("type = 'FEEDS'").select(F.lit("CONTAINS_FLOW").alias("type"), flow("src").alias("src"), flow("dst", 40).alias("dst"), "step_order")
    return traverse.flow_traversal(steps.unionByName(inner), p.passes, ("PASSES_TO", "FEEDS"))


@query("t25_fingerprints", "SELECT root, string_agg(part, '|' ORDER BY seq, part) AS fingerprint FROM (SELECT dst AS root, concat(type, ':', src) AS part, seq FROM uses WHERE type <> 'ASSIGNS') GROUP BY root")
def _(p):
    u = p.uses.where("type <> 'ASSIGNS'").select(F.col("dst").alias("root"), F.concat_ws("/", "src", "type", "dst").alias("id"), F.col("type").alias("kind"), F.col("src").alias("call_target"), "seq")
    contains = u.select(F.col("root").alias("src"), F.col("id").alias("dst"))
    return traverse.subtree_prints(contains, u, u.select(F.col("root").alias("id")).distinct(), 1)


# --- aggregation


@query("a1_fan_out", "SELECT src AS id, count(*) AS n FROM calls GROUP BY src HAVING count(*) > 2")
def _(p):
    return aggregate.fan_out(p.calls, 2)


@query("o3_top_fan_out", "SELECT src AS id, count(*) AS n FROM wide_calls GROUP BY src HAVING count(*) > 5 ORDER BY n DESC, id LIMIT 20")
def _(p):
    return aggregate.fan_out(p.wide_calls, 5, 20)


@query("a2_fan_in", "SELECT dst AS id, count(DISTINCT src) AS callers FROM calls GROUP BY dst HAVING count(DISTINCT src) >= 3")
def _(p):
    return aggregate.fan_in(p.calls)


@query("a3_counts", "SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(p):
    return aggregate.counts_by(p.edges, "type")


@query("a4_collect_bag", "SELECT c.src AS src, string_agg(n.name, ',' ORDER BY n.name) AS callees FROM calls c JOIN nodes n ON n.id = c.dst GROUP BY c.src")
def _(p):
    named = match.triples(p.calls, p.nodes, p.nodes)
    return aggregate.collected(named, "src", F.col("dst_name"), "callees", distinct=False).select("src", F.array_join("callees", ",").alias("callees"))


@query("a5_collect_set", "SELECT src, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT DISTINCT c.src, n.kind AS k FROM calls c JOIN nodes n ON n.id = c.dst) GROUP BY src")
def _(p):
    return aggregate.collected(match.triples(p.calls, p.nodes, p.nodes), "src", F.col("dst_kind"), "kinds").select("src", F.array_join("kinds", ",").alias("kinds"))


@query("a7_duplicate_groups", "SELECT id, name, kind, group_size FROM (SELECT id, name, kind, count(*) OVER (PARTITION BY name, kind) AS group_size FROM nodes) WHERE group_size > 2")
def _(p):
    return aggregate.duplicate_groups(p.nodes, ["name", "kind"]).select("id", "name", "kind", "group_size")


@query("a8_timeline", "SELECT dst AS variable, type, src AS other, line FROM uses UNION ALL SELECT src, type, dst, line FROM passes")
def _(p):
    return aggregate.timeline(p.edges).select("variable", "type", "other", "line")


@query("a9_count_by", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(p):
    return aggregate.counts_by(p.nodes, "kind")


@query("a10_duplicates_of", "SELECT id FROM nodes WHERE status = 'active' AND id <> 'p42' AND ast_hash = (SELECT ast_hash FROM nodes WHERE id = 'p42')")
def _(p):
    return aggregate.duplicates_of(p.nodes, "p42").select("id")


_CYCLIC = "e AS (SELECT DISTINCT x.src, x.dst FROM (SELECT src, dst FROM calls UNION ALL SELECT src, dst FROM depends) x JOIN nodes a ON a.id = x.src AND a.status = 'active' JOIN nodes b ON b.id = x.dst AND b.status = 'active')"
_CYCLES = """
two AS (SELECT x.src AS a, x.dst AS b, CAST(NULL AS VARCHAR) AS c FROM e x JOIN e y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst),
three AS (SELECT x.src AS a, y.src AS b, z.src AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND y.src < z.src)
"""
_RISKY_NODES = """
r AS (SELECT id, status, module_path, concat(CASE start_line % 7 WHEN 0 THEN 'read_' WHEN 1 THEN 'Query_' WHEN 2 THEN 'execute_' WHEN 3 THEN 'load_' WHEN 4 THEN 'reopen.' ELSE 'x_' END, name) AS name,
             CASE start_line % 3 WHEN 0 THEN 'try:' WHEN 1 THEN semantic_intent END AS source_text FROM nodes)
"""


def _risky_nodes(p: Projection) -> DataFrame:
    """Nodes with names some of which are risky, and sources that handle errors, do not, or are missing."""
    k, rest = F.col("start_line") % 7, F.col("start_line") % 3
    prefix = F.when(k == 0, "read_").when(k == 1, "Query_").when(k == 2, "execute_").when(k == 3, "load_").when(k == 4, "reopen.").otherwise("x_")
    return p.nodes.withColumn("name", F.concat(prefix, "name")).withColumn("source_text", F.when(rest == 0, "try:").when(rest == 1, F.col("semantic_intent")))


@query(
    "a4_unhandled_risks",
    f"WITH {_RISKY_NODES.strip()} SELECT c.src, a.name AS caller, string_agg(b.name, ',' ORDER BY b.name) AS risky_callees FROM calls c JOIN r a ON a.id = c.src AND a.status = 'active' AND NOT contains(a.source_text, 'try:') JOIN r b ON b.id = c.dst AND (contains(b.name, 'read') OR contains(b.name, 'write') OR contains(b.name, 'connect') OR contains(b.name, 'query') OR contains(b.name, 'fetch') OR contains(b.name, 'send') OR contains(b.name, 'open') OR contains(b.name, 'execute')) GROUP BY c.src, a.name",
)
def _(p):
    return services.unhandled_risks(_risky_nodes(p), p.edges).select("src", "caller", F.array_join("risky_callees", ",").alias("risky_callees"))


@query("a11_cycles", f"WITH {_CYCLIC}, {_CYCLES.strip()} SELECT a, b, c FROM two UNION ALL SELECT a, b, c FROM three")
def _(p):
    return services.gap_report(p.graph())["circular_dependencies"]


@query("j16_active_cycles", f"WITH {_CYCLIC.replace('FROM calls', 'FROM wide_calls')}, {_CYCLES.strip()} SELECT a, b, c FROM two UNION ALL SELECT a, b, c FROM three")
def _(p):
    return services.circular_dependencies(p.nodes, p.wide_calls.unionByName(p.depends))


@query(
    "a11_gap_counts",
    f"""
WITH {_CYCLIC}, {_CYCLES.strip()}, own AS (SELECT * FROM nodes WHERE contains(module_path, 'rand#1'))
SELECT 'dead_ends' AS gap, count(*) AS n FROM own WHERE status = 'active' AND id NOT IN (SELECT src FROM calls)
UNION ALL SELECT 'orphans', count(*) FROM own WHERE status = 'active' AND kind <> 'class' AND id NOT IN (SELECT dst FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON', 'MEMBER_OF'))
UNION ALL SELECT 'circular_dependencies', (SELECT count(*) FROM two) + (SELECT count(*) FROM three)
UNION ALL SELECT 'untested_mutations', count(*) FROM (SELECT DISTINCT src, dst FROM uses WHERE type = 'MUTATES' AND dst NOT IN (SELECT dst FROM uses WHERE type = 'READS'))
""",
)
def _(p):
    report = services.gap_report(p.graph().with_(nodes=p.nodes.withColumn("source_text", F.lit(None).cast("string"))), "rand#1")
    found = None
    for gap in ("dead_ends", "orphans", "circular_dependencies", "untested_mutations"):
        one = report[gap].agg(F.count(F.lit(1)).alias("n")).select(F.lit(gap).alias("gap"), "n")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "a12_evaluation",
    """
SELECT condition, count(*) AS n, sum(CASE WHEN correctness >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS correct,
       round(100.0 * sum(CASE WHEN correctness >= 0.5 THEN 1 ELSE 0 END) / count(*), 1)::DOUBLE AS percent,
       round(avg(ms), 1) AS mean_latency_ms, round(avg(tokens), 1) AS mean_tokens
FROM (SELECT event_type AS condition, CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END AS correctness, event_id % 97 AS ms, event_id % 31 AS tokens FROM events) GROUP BY condition
""",
)
def _(p):
    e = p.table("events").select(F.col("event_type").alias("condition"), F.when(F.col("value") > 10, 1.0).otherwise(0.0).alias("correctness"), (F.col("event_id") % 97).alias("total_latency_ms"), (F.col("event_id") % 31).alias("tokens"))
    return aggregate.evaluation_summary(e)


@query("a13_head_to_head", "SELECT CASE WHEN event_type = 'click' THEN 'm' || user_id % 3 WHEN event_type = 'view' THEN 'm' || (user_id + 1) % 3 ELSE 'tie' END AS winner, count(*) AS wins FROM events GROUP BY 1")
def _(p):
    m = lambda k: F.concat(F.lit("m"), ((F.col("user_id") + k) % 3).cast("string"))
    r = p.table("events").select(m(0).alias("model_a"), m(1).alias("model_b"), F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("tie").alias("rating"))
    return aggregate.head_to_head(r)


@query("a16_degrees", "SELECT n.id, coalesce(d.degree, 0) AS degree, round(least(0.5 * log2(1.0 + coalesce(d.degree, 0)), 3.0) + CASE WHEN n.kind = 'class' THEN 3.0 WHEN n.kind = 'method' THEN 1.5 ELSE 2.0 END, 6) AS size FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) GROUP BY id) d ON d.id = n.id")
def _(p):
    return aggregate.degrees(p.calls, p.nodes)


@query("a17_group_keys", "SELECT n.id, coalesce('class:' || e.dst, 'file:' || n.module_path) AS group_key FROM nodes n LEFT JOIN packs e ON e.src = n.id AND e.type = 'MEMBER_OF'")
def _(p):
    return aggregate.group_keys(p.nodes, p.packs)


@query("a18_first_seen", "SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM nodes) WHERE r = 1")
def _(p):
    return aggregate.first_seen(p.nodes.select("name", "id"), ["name"], "id")


@query("a20_dedup_ratio", "SELECT count(*) AS entries, count(DISTINCT ast_hash) AS shapes, round(count(DISTINCT ast_hash) / count(*), 6) AS ratio FROM nodes")
def _(p):
    return aggregate.dedup_ratio(p.nodes, "ast_hash")


# --- sequences, limits, sets


@query("wn1_positions", "SELECT dst AS variable, src, type, CAST(row_number() OVER (PARTITION BY dst ORDER BY line, src, type) - 1 AS INT) AS position FROM uses")
def _(p):
    return aggregate.positions(p.uses.withColumnRenamed("dst", "variable"), "variable", "line", "src", "type", name="position").select("variable", "src", "type", "position")


@query("wn3_next", "SELECT 'NEXT' AS type, id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY scope ORDER BY id) AS nxt FROM variables) WHERE nxt IS NOT NULL")
def _(p):
    return aggregate.next_edges(p.variables, "scope", "id")


@query("wn4_rebinds", "SELECT dst AS variable, src, row_number() OVER (PARTITION BY dst ORDER BY line, src) > 1 AS is_rebind FROM uses WHERE type = 'ASSIGNS'")
def _(p):
    u = p.uses.where("type = 'ASSIGNS'").select(F.col("dst").alias("variable"), "src", "line")
    return aggregate.rebinds(u, order=("line", "src")).select("variable", "src", "is_rebind")


@query("wn5_origins", "SELECT dst AS variable, arg_min(src, (line, src)) AS other, CAST(min(line) AS INT) AS line FROM uses WHERE type = 'ASSIGNS' GROUP BY dst")
def _(p):
    return aggregate.origins(aggregate.timeline(p.uses))


@query("wn6_terminals", "SELECT variable, other, seq, type FROM (SELECT dst AS variable, src AS other, seq, type, row_number() OVER (PARTITION BY dst ORDER BY src DESC, seq DESC, type DESC) AS r FROM uses WHERE type <> 'ASSIGNS') WHERE r = 1")
def _(p):
    return aggregate.terminals(aggregate.timeline(p.uses))


@query("wn9_shift", "SELECT dst AS id, CAST(CASE WHEN seq >= 3 THEN seq + 1 ELSE seq END AS INT) AS seq FROM uses WHERE type = 'READS'")
def _(p):
    return aggregate.shifted(p.uses.where("type = 'READS'").select(F.col("dst").alias("id"), "seq"), 3)


@query("o7_top_per_key", "SELECT module_path, id, CAST(r AS INT) AS rank FROM (SELECT module_path, id, row_number() OVER (PARTITION BY module_path ORDER BY name, id) AS r FROM nodes) WHERE r <= 3")
def _(p):
    return aggregate.top_per_key(p.nodes.select("module_path", "id", "name"), "module_path", 3, "name", "id").select("module_path", "id", "rank")


@query("u1_union_all", "SELECT src AS a, dst AS b FROM calls UNION ALL SELECT src, dst FROM passes")
def _(p):
    return p.calls.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(p.passes.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("u2_union_distinct", "SELECT src AS id FROM calls UNION SELECT dst FROM calls")
def _(p):
    return p.calls.select(F.col("src").alias("id")).union(p.calls.select("dst")).distinct()


@query("u3_difference", "SELECT src, dst, 'added' AS change FROM (SELECT src, dst FROM wide_calls EXCEPT SELECT src, dst FROM calls) UNION ALL SELECT src, dst, 'removed' FROM (SELECT src, dst FROM calls EXCEPT SELECT src, dst FROM wide_calls)")
def _(p):
    return aggregate.difference(p.calls.select("src", "dst"), p.wide_calls.select("src", "dst"))


@query("u4_semantic_diff", "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT id, ast_hash FROM nodes WHERE kind <> 'promo') b FULL JOIN (SELECT id, CASE WHEN kind = 'small' THEN structural_hash ELSE ast_hash END AS ast_hash FROM nodes WHERE kind <> 'large') a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.ast_hash <> b.ast_hash")
def _(p):
    after = p.nodes.where("kind <> 'large'").withColumn("ast_hash", F.when(F.col("kind") == "small", F.col("structural_hash")).otherwise(F.col("ast_hash")))
    return aggregate.semantic_diff(p.nodes.where("kind <> 'promo'"), after)


@query("u5_not_seen", "SELECT DISTINCT name FROM nodes WHERE kind = 'promo' AND name NOT IN (SELECT name FROM nodes WHERE kind = 'small' AND module_path = 'Brand#3')")
def _(p):
    return aggregate.not_in(p.nodes.where("kind = 'promo'").select("name").distinct(), p.nodes.where("kind = 'small' AND module_path = 'Brand#3'"), ["name"])


@query("f4_hub_edges", "SELECT h.id AS src, n.id AS dst, n.module_path FROM nodes n JOIN (SELECT module_path, arg_min(id, (name, id)) AS id FROM nodes GROUP BY module_path) h ON h.module_path = n.module_path AND h.id <> n.id")
def _(p):
    return aggregate.hub_edges(p.nodes)


# --- writers


@query("w1_upsert", "SELECT id, name FROM nodes WHERE kind <> 'promo' UNION ALL SELECT id, concat(name, ' v2') FROM nodes WHERE kind = 'promo'")
def _(p):
    n = p.nodes.select("id", "name")
    return mutate.upsert(n, p.nodes.where("kind = 'promo'").select("id", F.concat("name", F.lit(" v2")).alias("name")))


@query("w3_upsert_edges", "SELECT type, src, dst FROM wide_calls WHERE src IN (SELECT id FROM nodes WHERE status = 'active') AND dst IN (SELECT id FROM nodes WHERE status = 'active')")
def _(p):
    v = p.graph(p.calls).vertices.where("status = 'active'")
    empty = p.wide_calls.select("type", "src", "dst").where("false")
    return mutate.upsert_edges(empty, p.wide_calls.select("type", "src", "dst"), v)


@query(
    "w4_upsert_into",
    """
WITH old AS (SELECT type, src, dst, 0 AS line FROM edges WHERE line % 2 = 0 OR type IN ('MEMBER_OF', 'INHERITS')),
v AS (SELECT id, 'LogicNode' AS label FROM nodes WHERE status = 'active' UNION ALL SELECT id, 'Variable' FROM variables),
new AS (SELECT DISTINCT e.type, e.src, e.dst, e.line FROM edges e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE e.line % 3 = 0)
SELECT type, src, dst, CAST(line AS INT) AS line FROM new
UNION ALL SELECT type, src, dst, line FROM old WHERE (type, src, dst) NOT IN (SELECT (type, src, dst) FROM new)
""",
)
def _(p):
    """Edges of nine types into a table that has some of them: those with new properties replace theirs."""
    v = p.graph(p.calls).vertices.where("label = 'Variable' OR status = 'active'")
    e = p.edges.select("type", "src", "dst", F.col("line").cast("int").alias("line"))
    old = e.where("line % 2 = 0 OR type IN ('MEMBER_OF', 'INHERITS')").withColumn("line", F.lit(0))
    return mutate.upsert_edges(old, e.where("line % 3 = 0"), v)


@query("w5_insert_only", "SELECT id, name FROM nodes WHERE kind = 'promo' UNION ALL SELECT id, concat(name, ' new') FROM nodes WHERE kind <> 'promo'")
def _(p):
    return mutate.insert_only(p.nodes.where("kind = 'promo'").select("id", "name"), p.nodes.select("id", F.concat("name", F.lit(" new")).alias("name")))


@query("w8_deprecate", "SELECT id, CASE WHEN kind = 'promo' THEN 'deprecated' ELSE status END AS status FROM nodes")
def _(p):
    return mutate.deprecate(p.nodes, p.nodes.where("kind = 'promo'").select("id"))[0].select("id", "status")


@query("w9_detach_delete", "SELECT type, src, dst FROM wide_calls WHERE src NOT IN (SELECT id FROM nodes WHERE module_path = 'Brand#3') AND dst NOT IN (SELECT id FROM nodes WHERE module_path = 'Brand#3')")
def _(p):
    return mutate.delete_modules(p.nodes, p.wide_calls, ["Brand#3"])[1].select("type", "src", "dst")


@query("w14_variable_groups", "SELECT id, regexp_replace(scope, '\\.[^.]*$', '') AS group_key, substr(sha256(regexp_replace(scope, '\\.[^.]*$', '')), 1, 8) AS file_hash FROM (SELECT id, replace(scope, '_', '.') AS scope FROM variables)")
def _(p):
    return mutate.variable_groups(p.variables.withColumn("scope", F.replace("scope", F.lit("_"), F.lit(".")))).select("id", "group_key", "file_hash")


@query("w15_module_sources", "SELECT module_path, string_agg('# ' || name, chr(10) || chr(10) ORDER BY CASE WHEN kind = 'class' THEN 0 ELSE 1 END, start_line, name) AS source FROM nodes WHERE status = 'active' GROUP BY module_path")
def _(p):
    return mutate.module_sources(p.nodes.withColumn("source_text", F.lit(None).cast("string")))


# --- services


@query("h1_variable_timeline", "SELECT dst AS variable, type, src AS other, line FROM uses WHERE dst IN (SELECT id FROM variables WHERE scope = 'cust_42') UNION ALL SELECT src, type, dst, line FROM passes WHERE src IN (SELECT id FROM variables WHERE scope = 'cust_42')")
def _(p):
    return services.variable_timeline(p.graph(), p.variables.where("scope = 'cust_42'").select("id")).select("variable", "type", "other", "line")


def _name_grams(p: Projection):
    """Trigrams of the variables' names, kept while the orders' files stay."""
    return p.kept("variable-grams", ["orders"], lambda: search.indexed(p.variables, search.grams(F.col("name")), "id", "name", "scope"))


def _document_words(p: Projection):
    return p.kept("document-words", ["documents"], lambda: search.indexed(p.table("documents"), search.words(F.col("text")), "doc_id"))


@query("h4_variable_search", "SELECT id, name FROM variables WHERE contains(name, '123') AND contains(scope, '4') ORDER BY name, id LIMIT 50")
def _(p):
    found = search.containing(_name_grams(p), "123", "name", "id", "name", "scope")
    return services.variable_search(found, "123", "4").select("id", "name")


@query("h6_node_search", "SELECT id, name FROM nodes WHERE (contains(name, 'gear') OR contains(semantic_intent, 'gear')) AND kind = 'medium' AND module_path = 'Brand#5'")
def _(p):
    return services.node_search(p.nodes, "gear", "medium", module_path="Brand#5").select("id", "name")


@query("h8_by_return_type", "SELECT id, name FROM nodes WHERE return_type = '7'")
def _(p):
    return services.by_signature(p.nodes, return_type="7").select("id", "name")


@query("h9_data_flow", "SELECT src AS node_id, coalesce(string_agg(DISTINCT CASE WHEN type = 'READS' THEN 'order_' || substr(dst, 2) END, ',' ORDER BY CASE WHEN type = 'READS' THEN 'order_' || substr(dst, 2) END), '') AS reads FROM uses GROUP BY src")
def _(p):
    return services.data_flow(p.uses, p.variables).select("node_id", F.array_join("reads", ",").alias("reads"))


@query(
    "h9_all_roles",
    "SELECT src AS node_id, "
    + ", ".join(f"coalesce(string_agg(DISTINCT CASE WHEN type = '{t}' THEN 'order_' || substr(dst, 2) END, ',' ORDER BY CASE WHEN type = '{t}' THEN 'order_' || substr(dst, 2) END), '') AS {c}" for t, c in (("ASSIGNS", "assigns"), ("READS", "reads"), ("RETURNS", "returns")))
    + " FROM uses GROUP BY src",
)
def _(p):
    """What every node assigns, reads and returns."""
    return services.data_flow(p.uses, p.variables).select("node_id", *[F.array_join(c, ",").alias(c) for c in ("assigns", "reads", "returns")])


@query("o5_keyword_search", "SELECT doc_id, score FROM (SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+')), ['the', 'and', 'rendered', 'of'])) / 4.0, 6)::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def _(p):
    return search.keyword_search(_document_words(p), "The and rendered of", 20, "doc_id")


@query("o5_document_frequencies", "SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+')) AS term FROM documents) GROUP BY term")
def _(p):
    return search.document_frequencies(_document_words(p))


# --- streams


def _changes(p: Projection) -> DataFrame:
    """The events table as a stream; a folder of files is what such a stream reads."""
    from weftgraph.streaming import changes

    return changes.as_changes(changes.event_stream(p.spark, f"{p.sf_dir}/events.parquet*"))


@query("st1_change_stream", "SELECT 'u' || user_id AS path, event_type AS kind, props AS hash, event_id AS id FROM events")
def _(p):
    from weftgraph.streaming import changes

    return changes.written_stream(_changes(p).drop("ts"), "st1")


@query("st3_changed_content", "SELECT path, kind, hash, id FROM (SELECT 'u' || user_id AS path, event_type AS kind, props AS hash, event_id AS id, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> hash")
def _(p):
    from weftgraph.streaming import changes

    return changes.written_stream(changes.changed_content(_changes(p)), "st3").select("path", "kind", "hash", "id")


@query(
    "st2_debounced",
    """
SELECT 'u' || user_id AS path, arg_max(event_type, ts) AS kind, arg_max(props, ts) AS hash, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, burst
""",
)
def _(p):
    from weftgraph.streaming import changes

    return changes.debounced(changes.as_changes(p.table("events")), "30 minutes").select("path", "kind", "hash", "n")


@query(
    "st3_settled",
    """
WITH b AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)),
s AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS kind, arg_max(props, (ts, event_id)) AS hash, count(*) AS n FROM b GROUP BY user_id, burst)
SELECT path, kind, hash, n FROM (SELECT 'u' || user_id AS path, kind, hash, n, lag(hash) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM s
  WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)) WHERE before IS NULL OR before <> hash
""",
)
def _(p):
    """Settled bursts whose content is new, by a stream with keyed state; a burst is settled once the events have passed its end."""
    from weftgraph.streaming import changes, gate

    return changes.written_stream(gate.settled(_changes(p), gap=30 * 60_000, late=0), "st3-settled").select("path", "kind", "hash", "n")


@query("st9_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def _(p):
    from weftgraph.streaming import changes

    return changes.windowed_counts(changes.as_changes(p.table("events"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query("st6_checksum_gate", "SELECT doc_id, md5(text) AS checksum FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) OR doc_id % 3 <> 0")
def _(p):
    from weftgraph.streaming import changes

    files = p.table("documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("checksum"))
    return changes.new_content(files, files.where("path % 3 = 0")).withColumnRenamed("path", "doc_id")


# --- shapes over sets derived from the tables

_SETS = """
c AS (SELECT o_custkey, list_sort(list_distinct(list(substr(o_orderpriority, 1, 1)))) AS attrs, list_sort(list_distinct(list(o_orderstatus))) AS methods FROM orders GROUP BY o_custkey),
s AS (SELECT DISTINCT concat(array_to_string(attrs, ''), '/', array_to_string(methods, '')) AS id, attrs, methods FROM c)
"""


def _customers(p: Projection) -> DataFrame:
    """What each customer's orders have: a variable's evidence."""
    sets = {"attrs": F.substring("o_orderpriority", 1, 1), "methods": F.col("o_orderstatus")}
    return p.table("orders").groupBy("o_custkey").agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()])


def _shapes(p: Projection) -> DataFrame:
    """The distinct shapes of all customers."""
    ident = F.concat(F.array_join("attrs", ""), F.lit("/"), F.array_join("methods", ""))
    empty = F.array().cast("array<string>")
    return _customers(p).select(ident.alias("id"), F.lit("structural").alias("kind"), F.lit(None).cast("string").alias("base_type"), "attrs", empty.alias("subscripts"), "methods").dropDuplicates(["id"])


_COVERS = "len(list_intersect(a.attrs, b.attrs)) = len(b.attrs) AND len(list_intersect(a.methods, b.methods)) = len(b.methods)"


@query("c1_supersets", f"WITH {_SETS.strip()} SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON a.id <> b.id AND len(b.attrs) + len(b.methods) >= 2 AND {_COVERS}")
def _(p):
    from weftgraph.operators import shapes

    return shapes.supersets(_shapes(p))


@query("c5_generalizations", "SELECT 'g' || n_nationkey AS src, 'b' || max(r_regionkey) AS dst, 'generalization' AS strength FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey")
def _(p):
    from weftgraph.operators import shapes

    hint = F.lit("hint")
    bare = p.table("region").select(F.concat(F.lit("b"), "r_regionkey").alias("id"), hint.alias("kind"), F.lower("r_name").alias("base_type"))
    generic = p.table("nation").join(p.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("g"), "n_nationkey").alias("id"), hint.alias("kind"), F.concat("r_name", F.lit("[int]")).alias("base_type"))
    return shapes.generalizations(bare.unionByName(generic))


@query("c8_shape_search", f"WITH {_SETS.strip()} SELECT id FROM s WHERE list_contains(attrs, '1') AND list_contains(attrs, '5') AND list_contains(methods, 'F')")
def _(p):
    from weftgraph.operators import shapes

    return shapes.search(_shapes(p), attrs=("1", "5"), methods=("F",)).select("id")


_SHAPED = """
has AS (SELECT 'o' || o_orderkey AS variable, 'h' || o_custkey AS shape FROM orders),
acc AS (SELECT DISTINCT u.src AS consumer, 'h' || o.o_custkey AS shape FROM uses u JOIN orders o ON u.dst = 'o' || o.o_orderkey WHERE u.type = 'READS'),
comp AS (SELECT 'h' || c_custkey AS src, 'h' || lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'generalization' END AS strength FROM customer)
"""


def _shaped(p: Projection) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variables with shapes (an order has its customer's), compatible shapes (the next customer of its kind), and accepted ones (of what is read)."""
    name = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    has = p.table("orders").select(name("o_orderkey", "o").alias("variable"), name("o_custkey", "h").alias("shape"))
    accepts = p.uses.where("type = 'READS'").select("src", F.col("dst").alias("variable")).join(has, "variable").select("src", F.col("shape").alias("dst")).distinct()
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    strength = F.when(F.col("c_custkey") % 2 == 0, "generalization")
    comp = p.table("customer").select(name("c_custkey", "h").alias("src"), F.concat(F.lit("h"), after.cast("string")).alias("dst"), strength.alias("strength")).where("dst IS NOT NULL")
    return has, comp, accepts


@query(
    "t12_consumers",
    f"""
WITH {_SHAPED.strip()},
m AS (SELECT h.variable, a.consumer, 3 AS r FROM has h JOIN acc a ON a.shape = h.shape UNION ALL SELECT h.variable, a.consumer, CASE WHEN c.strength IS NULL THEN 2 ELSE 1 END FROM has h JOIN comp c ON c.src = h.shape JOIN acc a ON a.shape = c.dst)
SELECT variable, consumer, CASE max(r) WHEN 3 THEN 'exact' WHEN 2 THEN 'structural' ELSE 'weak' END AS confidence FROM m GROUP BY variable, consumer
""",
)
def _(p):
    from weftgraph.operators import shapes

    return shapes.consumers(*_shaped(p))


# --- questions that other graph stores ask as query texts, as joins


@query("cy_fan_out", "SELECT n.name, c.calls FROM (SELECT src, count(*) AS calls FROM calls GROUP BY src HAVING count(*) > 2) c JOIN nodes n ON n.id = c.src")
def _(p):
    busy = aggregate.fan_out(p.calls, 2).withColumnRenamed("n", "calls")
    return p.nodes.select("id", "name").join(busy, "id").select("name", "calls")


@query("cy_cross_module", "SELECT a.name AS caller, b.name AS callee FROM calls c JOIN nodes a ON a.id = c.src JOIN nodes b ON b.id = c.dst WHERE a.module_path <> b.module_path")
def _(p):
    return match.triples(p.calls, p.nodes, p.nodes).where("src_module_path <> dst_module_path").select(F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"))


@query("cy_leaves", "SELECT DISTINCT dst AS id FROM calls WHERE dst NOT IN (SELECT src FROM calls)")
def _(p):
    return match.lacking(p.calls.select(F.col("dst").alias("id")).distinct(), p.calls)


@query("cy_readers_of_writers", "SELECT DISTINCT w.src AS writer, w.dst AS variable, r.src AS reader FROM uses w JOIN uses r ON r.dst = w.dst AND w.type = 'MUTATES' AND r.type = 'READS' AND w.src <> r.src")
def _(p):
    return match.shared_variable(p.uses)


@query("cy_duplicates", "SELECT name, module_path AS file FROM (SELECT name, module_path, count(*) OVER (PARTITION BY ast_hash) AS k FROM nodes WHERE status = 'active') WHERE k > 2")
def _(p):
    return aggregate.duplicate_groups(p.nodes.where("status = 'active'"), ["ast_hash"]).select("name", F.col("module_path").alias("file"))


@query("cy_trails", _TRAILS.format(roots="src = 'p74'", depth=3) + "SELECT node AS goal, CAST(depth AS INT) AS hops FROM t")
def _(p):
    found = traverse.trails(p.calls, p.spark.createDataFrame([("p74",)], "id string"), 3)
    return found.select(F.col("node").alias("goal"), F.col("depth").alias("hops"))


@query("cy_roles_in_order", "SELECT u.type AS action, v.name AS variable FROM uses u JOIN variables v ON v.id = u.dst WHERE u.src = 's7' ORDER BY v.origin_line, u.type, v.name LIMIT 40")
def _(p):
    used = p.uses.where("src = 's7'").join(p.variables.select(F.col("id").alias("dst"), "name", "origin_line"), "dst")
    return aggregate.page(used.select(F.col("type").alias("action"), F.col("name").alias("variable"), "origin_line"), ["origin_line", "action", "variable"], 40).drop("origin_line")


@query("cy_edge_once", "SELECT x.src AS left_end, x.dst AS shared, y.src AS right_end FROM calls x JOIN calls y ON y.dst = x.dst WHERE x.src <> y.src")
def _(p):
    """Two callers of one function by two edges: an edge is used once a pattern, so no caller is paired with itself."""
    return match.fork_join(p.calls, p.calls, "dst", "src").select("left_end", "shared", "right_end")


@query("cy_unbounded", "WITH RECURSIVE walk AS (SELECT src AS root, dst AS node FROM calls WHERE src NOT IN (SELECT dst FROM calls) UNION SELECT w.root, c.dst FROM walk w JOIN calls c ON c.src = w.node) SELECT root, node FROM walk")
def _(p):
    """Everything that an entry point can reach, in any number of steps."""
    return scc.reachable(p.calls, _entries(p)).pairs()


@query("cy_properties", "SELECT src, dst, type, line, seq FROM uses WHERE src = 's7'")
def _(p):
    """All properties of relations, as a map that a caller takes apart."""
    whole = match.out_edges(p.uses, "s7").select("src", "dst", F.to_json(F.struct("type", "line", "seq")).alias("properties"))
    return whole.select("src", "dst", F.from_json("properties", "type string, line int, seq int").alias("p")).select("src", "dst", "p.*")
