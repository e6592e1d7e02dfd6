"""Named queries of services, writers, shapes and scalar functions, each with SQL written from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import identity, text
from weftgraph.graph import CodeGraph
from weftgraph.operators import aggregate, flows, match, mutate, services, shapes, traverse
from weftgraph.plans.graph_queries import _SHAPED, _shaped, query
from weftgraph.plans.project import Projection

# --- projections and predicates


@query("p2_map_projection", "SELECT id, CAST(to_json({'name': name, 'kind': kind}) AS VARCHAR) AS node FROM nodes")
def _(p):
    return p.nodes.select("id", F.to_json(F.struct("name", "kind")).alias("node"))


@query("p12_tag", "SELECT id, name FROM nodes WHERE list_contains(string_split(semantic_intent, ' '), 'gear') AND kind = 'promo'")
def _(p):
    return services.node_search(p.nodes.withColumn("tags", F.split("semantic_intent", " ")), kind="promo", tag="gear").select("id", "name")


@query("p17_optional_edge", "SELECT n.id, c.dst FROM nodes n LEFT JOIN calls c ON c.src = n.id AND c.line >= 3 WHERE n.status = 'active'")
def _(p):
    return match.optional(p.nodes.where("status = 'active'").select("id"), p.calls.where("line >= 3").select(F.col("src").alias("id"), "dst"), "id")


@query(
    "p19_reads_only",
    "SELECT conv_id, turn, NOT regexp_matches(regexp_replace(coalesce(concat(role, ' ', text, CASE turn % 3 WHEN 0 THEN ' SET x' WHEN 1 THEN ' n.set ''delete'' OFFSET' ELSE '' END), ''), '''[^'']*''|\"[^\"]*\"|`[^`]*`', '''''', 'g'), '(?i)(?:^|[^0-9A-Za-z_.:])(?:CREATE|MERGE|DELETE|SET|REMOVE|DROP|DETACH)(?:$|[^0-9A-Za-z_])') AS reads_only FROM conversations",
)
def _(p):
    end = F.when(F.col("turn") % 3 == 0, " SET x").when(F.col("turn") % 3 == 1, " n.set 'delete' OFFSET").otherwise("")
    return p.table("conversations").select("conv_id", "turn", text.reads_only(F.concat("role", F.lit(" "), "text", end)).alias("reads_only"))


@query("p20_found_or_like", "SELECT id, name FROM nodes WHERE contains(lower(name), 'red gea')")
def _(p):
    return match.found_or_like(p.nodes, "name", "RED gea").select("id", "name")


@query("p20_found", "SELECT id, name FROM nodes WHERE name = 'NATION_3'")
def _(p):
    return match.found_or_like(p.nodes, "name", "NATION_3").select("id", "name")


_ANSWER = "concat('See:', chr(10), '```sql', chr(10), 'MATCH (n) WHERE n.turn = ', turn, ' RETURN n;', chr(10), '```', chr(10), text)"


@query(
    "h16_query_texts",
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('MATCH (n) WHERE n.turn = ', turn, ' RETURN n') WHEN turn % 4 = 1 THEN concat('WITH ', turn, ' AS x RETURN x') END AS found FROM (SELECT conv_id, turn, {_ANSWER} AS t FROM conversations)",
)
def _(p):
    turn, whole = F.col("turn").cast("string"), F.col("text")
    fenced = F.concat(F.lit("See:\n```sql\nMATCH (n) WHERE n.turn = "), turn, F.lit(" RETURN n;\n```\n"), whole)
    plain = F.concat(F.lit("so\nWITH "), turn, F.lit(" AS x RETURN x\n\n"), whole)
    said = F.when(F.col("turn") % 2 == 0, fenced).when(F.col("turn") % 4 == 1, plain).otherwise(F.concat(F.lit("MATCH (n) "), F.regexp_replace(whole, "(?i)return|\n", " ")))
    return p.table("conversations").select("conv_id", "turn", text.query_of(said).alias("found"))


@query("h16_input_modes", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'projection' WHEN 1 THEN 'query' WHEN 2 THEN 'command' ELSE 'question' END AS mode FROM conversations")
def _(p):
    start = F.element_at(F.array(F.lit("vfs "), F.lit("optional  match "), F.lit("Callers "), F.lit("who: ")), (F.col("turn") % 4 + 1).cast("int"))
    return p.table("conversations").select("conv_id", "turn", text.input_mode(F.concat(F.lit(" "), start, "text")).alias("mode"))


@query(
    "h10_subgraph",
    """
WITH chosen AS (SELECT DISTINCT name AS value FROM nodes WHERE module_path = 'Brand#3' UNION SELECT 's7' UNION SELECT 'order_77'),
     v AS (SELECT id, name FROM nodes UNION ALL SELECT id, name FROM variables), ids AS (SELECT id FROM v WHERE id IN (SELECT value FROM chosen) OR name IN (SELECT value FROM chosen))
SELECT type, src, dst FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
""",
)
def _(p):
    values = p.nodes.where("module_path = 'Brand#3'").select(F.col("name").alias("value")).union(p.spark.createDataFrame([("s7",), ("order_77",)], "value string"))
    return match.subgraph_of(values, p.graph().vertices, p.edges)[1].select("type", "src", "dst")


# --- patterns


@query(
    "j11_class_and_init",
    """
WITH n AS (SELECT id, CASE WHEN ends_with(id, '3') THEN concat(name, '.__init__') ELSE name END AS name FROM nodes), m AS (SELECT src, dst FROM packs WHERE type = 'MEMBER_OF')
SELECT m.src AS method, m.dst AS class_id, k.name AS class_name, i.src AS init_id FROM m LEFT JOIN n k ON k.id = m.dst
LEFT JOIN (SELECT m.src, m.dst FROM m JOIN n ON n.id = m.src AND ends_with(n.name, '.__init__')) i ON i.dst = m.dst
""",
)
def _(p):
    nodes = p.nodes.withColumn("name", F.when(F.col("id").endswith("3"), F.concat("name", F.lit(".__init__"))).otherwise(F.col("name")))
    return match.class_and_init(nodes.where("kind = 'class'"), p.packs, nodes).select("method", "class_id", "class_name", "init_id")


def _shape_edges(p: Projection) -> DataFrame:
    """HAS_SHAPE, COMPATIBLE_WITH, ACCEPTS (of what is read) and PRODUCES (of what is returned) edges."""
    has, comp, accepts = _shaped(p)
    made = p.uses.where("type = 'RETURNS'").select("src", F.col("dst").alias("variable")).join(has, "variable").select("src", F.col("shape").alias("dst")).distinct()
    parts = [has.select(F.lit("HAS_SHAPE").alias("type"), F.col("variable").alias("src"), F.col("shape").alias("dst")), accepts.select(F.lit("ACCEPTS").alias("type"), "src", "dst"), made.select(F.lit("PRODUCES").alias("type"), "src", "dst")]
    found = comp.select(F.lit("COMPATIBLE_WITH").alias("type"), "src", "dst", "strength")
    for part in parts:
        found = found.unionByName(part, allowMissingColumns=True)
    return found


_PRODUCED = _SHAPED.strip() + ", prod AS (SELECT DISTINCT u.src AS producer, 'h' || o.o_custkey AS shape FROM uses u JOIN orders o ON u.dst = 'o' || o.o_orderkey WHERE u.type = 'RETURNS')"


@query(
    "j12_connections",
    f"""
WITH {_PRODUCED}, ids AS (SELECT 'h' || c_custkey AS id FROM customer), k AS (SELECT src, dst FROM comp WHERE dst IS NOT NULL)
SELECT i.id, coalesce((SELECT string_agg(DISTINCT variable, ',' ORDER BY variable) FROM has WHERE shape = i.id), '') AS variables, coalesce((SELECT string_agg(consumer, ',' ORDER BY consumer) FROM acc WHERE shape = i.id), '') AS consumers,
       coalesce((SELECT string_agg(producer, ',' ORDER BY producer) FROM prod WHERE shape = i.id), '') AS producers, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM k WHERE src = i.id), '') AS compatible FROM ids i
""",
)
def _(p):
    ids = p.table("customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("id"))
    found = shapes.connections(ids, _shape_edges(p))
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("variables", "consumers", "producers", "compatible")])


@query(
    "t13_producers",
    f"""
WITH {_PRODUCED}, back AS (SELECT dst AS shape, src AS made FROM comp WHERE dst IS NOT NULL UNION SELECT shape, shape FROM acc)
SELECT DISTINCT a.consumer AS node, pr.producer FROM acc a JOIN back b ON b.shape = a.shape JOIN prod pr ON pr.shape = b.made
""",
)
def _(p):
    edges = _shape_edges(p)
    of = lambda t: edges.where(F.col("type") == t)
    return shapes.producers(of("ACCEPTS").select(F.col("src").alias("node"), F.col("dst").alias("shape")), of("COMPATIBLE_WITH"), of("PRODUCES"))


@query("t11_shape_closure", f"WITH {_SHAPED.strip()}, ids AS (SELECT DISTINCT shape AS root FROM has) SELECT root, root AS shape, 'exact' AS confidence FROM ids UNION ALL SELECT src, dst, CASE WHEN strength IS NULL THEN 'structural' ELSE 'weak' END FROM comp WHERE dst IS NOT NULL AND src IN (SELECT root FROM ids)")
def _(p):
    has, comp, _accepts = _shaped(p)
    return shapes.shape_closure(has.select(F.col("shape").alias("id")).distinct(), comp)


@query(
    "a19_best_confidence",
    f"""
WITH {_SHAPED.strip()}, m AS (SELECT a.consumer, 3 AS r FROM has h JOIN acc a ON a.shape = h.shape UNION ALL SELECT a.consumer, CASE WHEN c.strength IS NULL THEN 2 ELSE 1 END FROM has h JOIN comp c ON c.src = h.shape JOIN acc a ON a.shape = c.dst)
SELECT consumer, CASE max(r) WHEN 3 THEN 'exact' WHEN 2 THEN 'structural' ELSE 'weak' END AS confidence FROM m GROUP BY consumer
""",
)
def _(p):
    return aggregate.best_confidence(shapes.consumers(*_shaped(p)))


@query(
    "j29_neighbourhood",
    """
WITH RECURSIVE focal AS (SELECT id FROM nodes WHERE id IN ('p42', 'p74', 's7')),
walk AS (SELECT id, 0 AS depth FROM focal UNION SELECT c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.id WHERE w.depth < 2),
ids AS (SELECT id FROM walk UNION SELECT src FROM calls WHERE dst IN (SELECT id FROM focal) UNION SELECT dst FROM uses WHERE src IN (SELECT id FROM focal))
SELECT id, name, label FROM (SELECT id, name, 'LogicNode' AS label FROM nodes UNION ALL SELECT id, name, 'Variable' FROM variables) WHERE id IN (SELECT id FROM ids)
""",
)
def _(p):
    focal = p.nodes.where("id IN ('p42', 'p74', 's7')").select("id")
    return services.neighbourhood(p.graph(), focal, 2).nodes.select("id", "name", "label")


@query(
    "j31_passes_by_place",
    """
WITH a AS (SELECT concat(src, '>', dst) AS call_id, src AS callee, CASE WHEN seq % 3 > 0 THEN line - 1 END AS position, CASE WHEN seq % 3 = 0 THEN concat('p', line) END AS keyword, dst AS arg FROM uses),
     q AS (SELECT s.id AS callee, CAST(i AS INT) AS position, concat('p', i + 1) AS param FROM nodes s, range(5) r(i) WHERE s.kind = 'class')
SELECT a.call_id, a.callee, a.arg, q.param FROM a JOIN q ON q.callee = a.callee AND (a.keyword IS NULL AND q.position = a.position OR q.param = a.keyword)
""",
)
def _(p):
    named = F.col("seq") % 3 == 0
    calls = p.uses.select(F.concat_ws(">", "src", "dst").alias("call_id"), F.col("src").alias("callee"), F.when(~named, F.col("line") - 1).alias("position"), F.when(named, F.concat(F.lit("p"), "line")).alias("keyword"), F.col("dst").alias("arg"))
    params = p.nodes.where("kind = 'class'").select(F.col("id").alias("callee"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position")).withColumn("param", F.concat(F.lit("p"), (F.col("position") + 1).cast("string")))
    return match.passes_by_place(calls, params)


@query(
    "j32_resolve_names",
    """
WITH k AS (SELECT DISTINCT module_path AS file, name AS callee FROM nodes), one AS (SELECT module_path AS file, name AS callee, min(id) AS q FROM nodes WHERE kind = 'promo' GROUP BY 1, 2),
     two AS (SELECT module_path AS file, name AS callee, max(id) AS q FROM nodes WHERE kind IN ('large', 'small') GROUP BY 1, 2)
SELECT k.file, k.callee, coalesce(one.q, two.q, k.callee) AS qualified FROM k LEFT JOIN one USING (file, callee) LEFT JOIN two USING (file, callee)
""",
)
def _(p):
    n = p.nodes.select(F.col("module_path").alias("file"), F.col("name").alias("callee"), "id", "kind")
    one = n.where("kind = 'promo'").groupBy("file", "callee").agg(F.min("id").alias("qualified"))
    two = n.where("kind IN ('large', 'small')").groupBy("file", "callee").agg(F.max("id").alias("qualified"))
    return match.resolve_names(n.select("file", "callee").distinct(), one, two)


# --- traversal


_CONTAINS = "contains AS (SELECT 'CONTAINS' AS type, dst AS src, src AS dst FROM packs)"


def _contains(p: Projection) -> DataFrame:
    return traverse.reversed_edges(p.packs).withColumn("type", F.lit("CONTAINS"))


@query("t5_containment", f"WITH RECURSIVE {_CONTAINS}, walk AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes WHERE kind = 'package' UNION ALL SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN contains c ON c.src = w.node WHERE w.depth < 8) SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY root, node")
def _(p):
    return traverse.reach(_contains(p), p.nodes.where("kind = 'package'"), 8, include_roots=True)


@query(
    "t8_function_flow",
    f"""
WITH RECURSIVE {_CONTAINS}, own AS (SELECT DISTINCT u.type, m.dst AS src, u.dst FROM uses u JOIN packs m ON m.src = u.src AND m.type = 'MEMBER_OF' WHERE m.dst = 't3'),
inside AS (SELECT 't3' AS id UNION SELECT c.dst FROM inside i JOIN contains c ON c.src = i.id),
ids AS (SELECT id FROM inside UNION SELECT dst FROM own)
SELECT type, src, dst FROM (SELECT * FROM contains UNION ALL SELECT * FROM own UNION ALL SELECT type, src, dst FROM uses) WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
""",
)
def _(p):
    member = p.packs.where("type = 'MEMBER_OF' AND dst = 't3'").select("src", F.col("dst").alias("owner"))
    own = p.uses.join(member, "src").select("type", F.col("owner").alias("src"), "dst").distinct()
    edges = _contains(p).select("type", "src", "dst").unionByName(own).unionByName(p.uses.select("type", "src", "dst"))
    return services.logic_pack(p.graph(edges), "function_flow", "t3").edges.select("type", "src", "dst")


@query(
    "t10_impact_pack",
    "WITH ids AS (SELECT 's7' AS id UNION SELECT r.src FROM uses w JOIN uses r ON r.dst = w.dst AND w.type = 'MUTATES' AND r.type = 'READS' AND r.src <> w.src JOIN nodes n ON n.id = r.src AND n.status = 'active' WHERE w.src = 's7') SELECT id, name FROM nodes WHERE id IN (SELECT id FROM ids)",
)
def _(p):
    return services.logic_pack(p.graph(), "impact", "s7").nodes.select("id", "name")


@query(
    "t24_scoped_find",
    """
WITH RECURSIVE step AS (SELECT DISTINCT src, dst FROM (SELECT * FROM calls UNION ALL SELECT * FROM depends)),
walk AS (SELECT s.dst AS node, 1 AS depth FROM step s JOIN nodes n ON n.id = s.src AND n.module_path = 'Brand#3' UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN step s ON s.src = w.node WHERE w.depth < 4)
SELECT DISTINCT n.id, n.name FROM walk w JOIN nodes n ON n.id = w.node WHERE regexp_full_match(n.name, '(?i).*GEAR.*')
""",
)
def _(p):
    inside = traverse.reach(p.edges.where("type IN ('CALLS', 'DEPENDS_ON')"), p.nodes.where("module_path = 'Brand#3'"), 4).select(F.col("node").alias("id")).distinct()
    return p.nodes.join(inside, "id", "left_semi").where(F.col("name").rlike("^(?:(?i).*GEAR.*)$")).select("id", "name")


@query("f5_find", "SELECT id, name, kind, module_path FROM nodes WHERE contains(lower(name), 'widget') AND kind = 'economy'")
def _(p):
    return match.found_or_like(p.nodes.where("kind = 'economy'"), "name", "widget").select("id", "name", "kind", "module_path")


# --- services


_TIMELINE = "tl AS (SELECT dst AS variable, type, src AS other, line, seq FROM uses UNION ALL SELECT src, type, dst, line, seq FROM passes)"


@query(
    "h2_passed_timeline",
    f"""
WITH RECURSIVE {_TIMELINE}, fam AS (SELECT id AS root, id AS variable FROM variables WHERE scope IN ('cust_7', 'cust_42') UNION SELECT f.root, x.dst FROM fam f JOIN passes x ON x.src = f.variable AND x.type = 'PASSES_TO')
SELECT f.root, f.variable, t.type, t.other, t.line FROM fam f JOIN tl t ON t.variable = f.variable
""",
)
def _(p):
    some = p.variables.where("scope IN ('cust_7', 'cust_42')").select("id")
    return services.passed_timeline(p.edges, some).select("root", "variable", "type", "other", "line")


@query("h3_traced", f"WITH {_TIMELINE}, v AS (SELECT id FROM variables WHERE contains(name, '12') AND contains(scope, '4') ORDER BY name, id LIMIT 50) SELECT variable, type, other, line FROM tl WHERE variable IN (SELECT id FROM v)")
def _(p):
    return services.traced(p.graph(), "12", "4").select("variable", "type", "other", "line")


@query(
    "wn7_terminal_flags",
    f"""
WITH {_TIMELINE}, chosen AS (SELECT id FROM variables WHERE type_hint = '1-URGENT'),
last AS (SELECT variable, other, seq, type FROM tl WHERE type IN ('MUTATES', 'READS', 'RETURNS') QUALIFY row_number() OVER (PARTITION BY variable ORDER BY other DESC, seq DESC, type DESC) = 1)
SELECT t.variable, t.type, t.other, t.line, l.variable IS NOT NULL AS terminal FROM tl t LEFT JOIN last l ON l.variable = t.variable AND l.other = t.other AND l.seq = t.seq AND l.type = t.type WHERE t.variable IN (SELECT id FROM chosen)
""",
)
def _(p):
    return services.variable_timeline(p.graph(), p.variables.where("type_hint = '1-URGENT'").select("id")).select("variable", "type", "other", "line", "terminal")


_ITEMS = "SELECT label, kind, insert_text, sort_key FROM ({}) ORDER BY sort_key, kind, insert_text LIMIT 50"


def _completing(p: Projection, edges: DataFrame | None = None) -> CodeGraph:
    """The graph whose nodes have two parameters each, self and one named by the module."""
    params = F.array(*[F.struct(F.lit("self").alias("name"), F.lit(None).cast("string").alias("type_hint")), F.struct(F.lower("module_path").alias("name"), F.lit("int").alias("type_hint"))])
    g = p.graph(edges)
    return g.with_(nodes=g.nodes.withColumn("params", params))


_CALLED = "name || '(${1:' || lower(module_path) || '})'"


@query("h7_general", _ITEMS.format(f"SELECT name AS label, kind, {_CALLED} AS insert_text, 'a_' || name AS sort_key FROM nodes WHERE status = 'active' AND (contains(name, 'gear') OR contains(semantic_intent, 'gear'))"))
def _(p):
    return services.completions(_completing(p), "general", "gear")


@query("h7_import", _ITEMS.format("SELECT DISTINCT module_path AS label, 'module' AS kind, module_path AS insert_text, 'a_' || module_path AS sort_key FROM nodes WHERE status = 'active' AND starts_with(module_path, 'Brand#1')"))
def _(p):
    return services.completions(_completing(p), "import", "Brand#1")


@query("h7_member_access", _ITEMS.format(f"SELECT n.name AS label, n.kind, n.{_CALLED.replace('lower(module_path)', 'lower(n.module_path)')} AS insert_text, 'a_' || n.name AS sort_key FROM packs e JOIN nodes o ON o.id = e.dst AND o.status = 'active' JOIN nodes n ON n.id = e.src AND n.status = 'active' WHERE e.type = 'MEMBER_OF' AND contains(o.name, 'NATION_7')"))
def _(p):
    return services.completions(_completing(p, p.packs), "member_access", "NATION_7")


@query(
    "h7_variable_consumer",
    f"WITH {_SHAPED.strip()}, "
    + """mine AS (SELECT shape FROM has JOIN variables v ON v.id = has.variable WHERE v.name = 'order_7'),
near AS (SELECT shape FROM mine UNION SELECT c.dst FROM comp c JOIN mine ON mine.shape = c.src WHERE c.dst IS NOT NULL) """
    + _ITEMS.format(f"SELECT name AS label, kind, {_CALLED} AS insert_text, 'a_' || name AS sort_key FROM nodes WHERE status = 'active' AND id IN (SELECT consumer FROM acc WHERE shape IN (SELECT shape FROM near))"),
)
def _(p):
    return services.completions(_completing(p, _shape_edges(p)), "variable_consumer", "order_7")


@query(
    "h8_by_param",
    "SELECT id, name FROM nodes WHERE contains(lower(module_path), 'd#2')",
)
def _(p):
    return services.by_signature(_completing(p).nodes, param_name="d#2", param_type="nt", exact=False).select("id", "name")


@query(
    "h13_focal_nodes",
    """
WITH w(place, word) AS (VALUES (0, 'gizmo'), (1, 'and'), (2, 'bolt'), (3, 'red'), (4, 'widget')),
h AS (SELECT w.place, n.id, row_number() OVER (PARTITION BY w.word ORDER BY n.name, n.id) AS r FROM nodes n JOIN w ON contains(n.name, w.word) WHERE n.status = 'active'),
f AS (SELECT id, place, r FROM h WHERE r <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, r) = 1)
SELECT id FROM f ORDER BY place, r LIMIT 5
""",
)
def _(p):
    return services.focal_nodes(p.nodes, "Which gizmo and bolt does the (red) Widget call?").select("id")


@query(
    "h12_contexts",
    """
WITH RECURSIVE w(place, word) AS (VALUES (0, 'gizmo'), (1, 'and'), (2, 'bolt'), (3, 'red'), (4, 'widget')),
h AS (SELECT w.place, n.id, row_number() OVER (PARTITION BY w.word ORDER BY n.name, n.id) AS r FROM nodes n JOIN w ON contains(n.name, w.word) WHERE n.status = 'active'),
f AS (SELECT id, place, r FROM h WHERE r <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, r) = 1),
focal AS (SELECT id AS root, CAST(row_number() OVER (ORDER BY place, r) AS INT) AS nth FROM f ORDER BY place, r LIMIT 3),
walk AS (SELECT root, root AS id, 0 AS depth FROM focal UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.id WHERE w.depth < 2),
around AS (SELECT root, id FROM walk UNION SELECT root, c.src FROM focal JOIN calls c ON c.dst = root UNION SELECT root, u.dst FROM focal JOIN uses u ON u.src = root),
l AS (SELECT 'doc_' || doc_id AS path, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT path, l, len(l) AS n, unnest(range(0, len(l), 3)) AS s FROM l),
c AS (SELECT path, CAST(s + 1 AS INT) AS start_line, array_to_string(list_slice(l, s + 1, s + 4), chr(10)) AS content FROM s WHERE s = 0 OR s + 1 < n),
sc AS (SELECT path, start_line, round(len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_\\p{M}]+')), ['which', 'gizmo', 'and', 'bolt', 'does', 'the', 'red', 'widget', 'call'])) / 9.0, 6)::DOUBLE AS score FROM c),
top AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path, start_line) AS INT) AS nth FROM sc WHERE score > 0 QUALIFY nth <= 5)
SELECT 'graph' AS source, nth AS place, root AS focus, id, CAST(NULL AS DOUBLE) AS score FROM around JOIN focal USING (root)
UNION ALL SELECT 'file', nth, path, CAST(start_line AS VARCHAR), score FROM top
""",
)
def _(p):
    """What the graph and the files have for one question."""
    from weftgraph.operators import search

    def chunk_words():
        chunks = services.chunks(p.table("documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.col("text").alias("content")), 4, 1)
        return search.indexed(chunks, search.words(F.col("content")), "path", "start_line")

    index = p.kept("chunk-words", ["documents"], chunk_words)
    return services.contexts(p.graph(p.calls.unionByName(p.uses)), index, "Which gizmo and bolt does the (red) Widget call?")


@query("o6_latest_changes", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET 50")
def _(p):
    return aggregate.page(p.table("events").select("event_id", "ts"), [F.desc("ts"), "event_id"], 100, 50)


@query("s4_file_content", "SELECT text AS source FROM documents WHERE doc_id = 7")
def _(p):
    from weftgraph.sources import files

    return files.content(p.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("source")), "d7")


# --- writers


@query("w2_last_wins", "SELECT id, src, type, line FROM (SELECT dst AS id, src, type, line, row_number() OVER (PARTITION BY dst ORDER BY line DESC, src DESC, type DESC) AS r FROM uses) WHERE r = 1")
def _(p):
    rows = p.uses.select(F.col("dst").alias("id"), "src", "type", "line")
    return mutate.upsert(rows.where("false"), rows, order="line")


@query("w2_without_order", "SELECT id, src, type, line FROM (SELECT dst AS id, src, type, line, row_number() OVER (PARTITION BY dst ORDER BY src DESC, type DESC, line DESC) AS r FROM uses) WHERE r = 1")
def _(p):
    rows = p.uses.select(F.col("dst").alias("id"), "src", "type", "line")
    return mutate.upsert(rows.where("false"), rows)


@query("w10_delete_edges", "SELECT type, src, dst FROM wide_calls WHERE NOT (starts_with(src, 'p1') AND line > 2)")
def _(p):
    e = p.wide_calls
    return mutate.delete_edges(e, e.where("startswith(src, 'p1') AND line > 2").select("type", "src", "dst")).select("type", "src", "dst")


@query("w13_json_round_trip", "SELECT type, src, dst, line, seq FROM edges")
def _(p):
    from weftgraph.sources import files
    from weftgraph.storage import shared_path

    path = shared_path(p.spark, "json-graph")
    files.write_json_graph(p.graph(), path)
    return files.read_json_graph(p.spark, path).edges.select("type", "src", "dst", "line", "seq")


@query("s10_graph_of_some_types", "SELECT type, src, dst FROM edges WHERE type IN ('READS', 'INHERITS')")
def _(p):
    from weftgraph.sources import files
    from weftgraph.storage import shared_path

    path = shared_path(p.spark, "json-graph")
    files.write_json_graph(p.graph(), path)
    return files.read_json_graph(p.spark, path, "READS, INHERITS").edges.select("type", "src", "dst")


@query("s11_json_lines", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, 'again', value FROM events WHERE value > 50")
def _(p):
    from weftgraph.sources import files
    from weftgraph.storage import shared_path

    path, e = shared_path(p.spark, "lines"), p.table("events").select("event_id", "event_type", "value")
    files.append_json_lines(e, path)
    files.append_json_lines(e.where("value > 50").withColumn("event_type", F.lit("again")), path)
    return files.json_lines(p.spark, path, "event_id long, event_type string, value double")


@query(
    "w16_shape_stubs",
    """
WITH s AS (SELECT 'cust' || o_custkey AS id, sha256('cust' || o_custkey) AS h, list_sort(list_distinct(list('a' || substr(o_orderpriority, 1, 1)))) AS attrs, list_sort(list_distinct(list(o_orderstatus))) AS methods FROM orders GROUP BY o_custkey)
SELECT id, concat('class Shape_', substr(h, 1, 8), '(Protocol):', chr(10), array_to_string(list_concat(list_transform(attrs, lambda a: concat('    ', a, ': Any')), list_transform(methods, lambda m: concat('    def ', m, '(self, *args: Any) -> Any: ...'))), chr(10))) AS stub FROM s
""",
)
def _(p):
    sets = p.table("orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("a"), F.substring("o_orderpriority", 1, 1))).alias("attrs"), F.collect_set("o_orderstatus").alias("methods"))
    ident = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
    definition = F.struct("attrs", F.array().cast("array<string>").alias("subscripts"), "methods")
    return mutate.shape_stub(sets.select(ident.alias("id"), F.sha2(ident, 256).alias("shape_hash"), definition.alias("definition")))


_ROWS = "st AS (SELECT id, scope AS parent, CAST(row_number() OVER (PARTITION BY scope ORDER BY id) - 1 AS INT) AS seq FROM variables)"


def _statements(p: Projection) -> DataFrame:
    """Variables as the statements of their scopes, numbered by id."""
    return aggregate.positions(p.variables.select("id", F.col("scope").alias("parent")), "parent", "id")


@query(
    "w18_insert",
    f"""
WITH {_ROWS}, s AS (SELECT id, parent, CASE WHEN parent = 'cust_4' AND seq >= 1 THEN seq + 1 ELSE seq END AS seq FROM st UNION ALL SELECT 'new', 'cust_4', 1)
SELECT 'NEXT' AS type, id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY parent ORDER BY seq, id) AS nxt FROM s) WHERE nxt IS NOT NULL
""",
)
def _(p):
    after = mutate.insert_statement(_statements(p), p.spark.createDataFrame([("new",)], "id string"), "cust_4", 1)
    return aggregate.next_edges(after)


@query("w18_update", f"WITH {_ROWS} SELECT id, parent, seq, CASE WHEN seq % 3 = 1 THEN 'edited ' || id WHEN seq % 3 = 2 THEN NULL ELSE 'text' END AS source_text FROM st")
def _(p):
    """New texts of two of three statements, of which one is null."""
    rows = _statements(p).withColumn("source_text", F.lit("text"))
    return mutate.update_statements(rows, rows.where("seq % 3 > 0").select("id", F.when(F.col("seq") % 3 == 1, F.concat(F.lit("edited "), "id")).alias("source_text"))).select("id", "parent", "seq", "source_text")


@query("w18_delete", f"WITH {_ROWS}, gone AS (SELECT parent, seq FROM st WHERE id = 'o7') SELECT st.id, st.parent, CAST(CASE WHEN st.seq > gone.seq THEN st.seq - 1 ELSE st.seq END AS INT) AS seq FROM st LEFT JOIN gone ON gone.parent = st.parent WHERE st.id <> 'o7'")
def _(p):
    return mutate.delete_statement(_statements(p), "o7").select("id", "parent", "seq")


@query("w18_reorder", f"WITH {_ROWS}, n AS (SELECT max(seq) AS m FROM st WHERE parent = 'cust_4') SELECT id, parent, CAST(CASE WHEN parent = 'cust_4' THEN (SELECT m FROM n) - seq ELSE seq END AS INT) AS seq FROM st")
def _(p):
    s = _statements(p)
    mine = s.where("parent = 'cust_4'")
    last = mine.agg(F.max("seq").alias("_m"))
    return mutate.reorder_statements(s, mine.join(F.broadcast(last)).select("id", (F.col("_m") - F.col("seq")).alias("new_seq"))).select("id", "parent", "seq")


@query("wn2_call_order", "SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY line, dst) - 1 AS INT) AS call_order FROM wide_calls")
def _(p):
    return aggregate.positions(p.wide_calls.select("src", "dst", "line"), "src", "line", "dst", name="call_order").select("src", "dst", "call_order")


@query(
    "h15_flow_edges",
    """
WITH f AS (SELECT module_path AS id, list(id ORDER BY id) AS node_ids, list(DISTINCT 'Brand#' || start_line ORDER BY 'Brand#' || start_line) AS subs FROM nodes WHERE starts_with(module_path, 'Brand') GROUP BY module_path)
SELECT 'STEP_OF' AS type, unnest(node_ids) AS src, id AS dst, CAST(generate_subscripts(node_ids, 1) - 1 AS INT) AS step_order FROM f
UNION ALL SELECT type, src, dst, step_order FROM (SELECT 'CONTAINS_FLOW' AS type, id AS src, unnest(subs) AS dst, CAST(generate_subscripts(subs, 1) - 1 AS INT) AS step_order FROM f) WHERE dst IN (SELECT id FROM f)
""",
)
def _(p):
    named = p.nodes.where("startswith(module_path, 'Brand')")
    table = named.groupBy(F.col("module_path").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("node_ids"), F.array_sort(F.collect_set(F.concat(F.lit("Brand#"), F.col("start_line").cast("string")))).alias("sub_flow_ids")).withColumn("name", F.col("id"))
    return flows.put_flows(p.graph(p.packs), table).typed("STEP_OF", "CONTAINS_FLOW").select("type", "src", "dst", "step_order")


# --- incremental indexing


@query("st4_watched", "SELECT event_id FROM events WHERE user_id % 5 > 2")
def _(p):
    from weftgraph.streaming import changes

    folder = F.element_at(F.array(*[F.lit(x) for x in (".git/x", "a/__pycache__", ".hidden", "app", "app/git")]), (F.col("user_id") % 5 + 1).cast("int"))
    return changes.watched(p.table("events").select("event_id", F.concat(folder, F.lit("/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"))).select("event_id")


@query("st7_changed", "SELECT id FROM nodes WHERE kind IN ('small', 'large', 'promo')")
def _(p):
    from weftgraph.extract import tables

    stored = p.nodes.where("kind <> 'large'").select("id", F.when(F.col("kind") == "small", "old").otherwise(F.col("ast_hash")).alias("ast_hash"), F.when(F.col("kind") != "promo", F.col("structural_hash")).alias("structural_hash"))
    return tables.changed(p.nodes, stored).select("id")


@query("st8_repository_switch", "SELECT 'same' AS repository, count(*) AS n FROM nodes UNION ALL SELECT 'other', 0")
def _(p):
    count = lambda root, name: mutate.flushed_on_switch(p.graph(), root).nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("repository"), "n")
    return count("Brand#1", "same").unionByName(count("/elsewhere", "other"))


# --- shapes


@query(
    "c2_facet_sides",
    """
WITH a AS (SELECT 'a' || o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS attrs, [] AS methods FROM orders GROUP BY o_custkey),
     m AS (SELECT 'm' || o_custkey AS id, [] AS attrs, list_sort(list_distinct(list(o_orderstatus))) AS methods FROM orders GROUP BY o_custkey)
SELECT id, 'data' AS side FROM a UNION ALL SELECT id, 'methods' FROM m
""",
)
def _(p):
    return shapes.facet_sides(_one_sided(p))


def _one_sided(p: Projection) -> DataFrame:
    """Shapes with data only and shapes with methods only, and some with both."""
    none = F.array().cast("array<string>")
    c = p.table("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("attrs"), F.collect_set("o_orderstatus").alias("methods"))
    one = lambda k, attrs, methods: c.select(F.concat(F.lit(k), "o_custkey").alias("id"), F.lit("structural").alias("kind"), F.lit(None).cast("string").alias("base_type"), attrs.alias("attrs"), none.alias("subscripts"), methods.alias("methods"))
    return one("a", F.col("attrs"), none).unionByName(one("m", none, F.col("methods"))).unionByName(one("b", F.col("attrs"), F.col("methods")))


@query("c2_facet_clusters", "WITH c AS (SELECT DISTINCT o_custkey FROM orders), x AS (SELECT 'a7' AS src, 'm' || o_custkey AS dst FROM c WHERE EXISTS (SELECT 1 FROM c WHERE o_custkey = 7)) SELECT src, dst, 'facet_cluster' AS strength FROM x UNION ALL SELECT dst, src, 'facet_cluster' FROM x")
def _(p):
    return shapes.facet_clusters(_one_sided(p), p.spark.createDataFrame([("a7",)], "id string"))


@query(
    "c3_c4_hint_links",
    """
WITH h AS (SELECT DISTINCT concat('h', p_size % 7, p_type) AS id, concat('mod', p_size % 7, '.', p_type) AS t FROM part UNION ALL SELECT 'hd', 'typing.Dict' UNION ALL SELECT 'hs', 'Str'),
     s AS (SELECT DISTINCT concat('s', p_brand, p_type) AS id, concat(upper(p_type), '[x]') AS t FROM part UNION ALL SELECT 'sd', 'dict' UNION ALL SELECT 'ss', 'x.str'),
     l AS (SELECT h.id AS a, s.id AS b FROM h JOIN s ON lower(split_part(split_part(h.t, '[', 1), '.', -1)) = lower(split_part(split_part(s.t, '[', 1), '.', -1)) WHERE h.id <> 'hd')
SELECT a AS src, b AS dst FROM l UNION ALL SELECT b, a FROM l
""",
)
def _(p):
    part = p.table("part")
    k = (F.col("p_size") % 7).cast("string")
    hints = part.select(F.concat(F.lit("h"), k, "p_type").alias("id"), F.lit("hint").alias("kind"), F.concat(F.lit("mod"), k, F.lit("."), "p_type").alias("base_type")).distinct()
    based = part.select(F.concat(F.lit("s"), "p_brand", "p_type").alias("id"), F.lit("structural").alias("kind"), F.concat(F.upper("p_type"), F.lit("[x]")).alias("base_type")).distinct()
    more = p.spark.createDataFrame([("hd", "hint", "typing.Dict"), ("hs", "hint", "Str"), ("sd", "structural", "dict"), ("ss", "structural", "x.str")], "id string, kind string, base_type string")
    return shapes.hint_links(hints.unionByName(based).unionByName(more))


@query(
    "c6_from_evidence",
    """
WITH e AS (SELECT c_custkey, CASE o_orderstatus WHEN 'F' THEN 'attrs' WHEN 'O' THEN 'methods' END AS facet, CASE o_orderstatus WHEN 'F' THEN substr(o_orderpriority, 1, 1) WHEN 'O' THEN substr(o_orderpriority, 3, 1) END AS item,
                  CASE c_mktsegment WHEN 'BUILDING' THEN 'None' WHEN 'AUTOMOBILE' THEN 'int[x]' WHEN 'MACHINERY' THEN 'pkg.Str' WHEN 'HOUSEHOLD' THEN 'str' END AS hint
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority < '2'),
g AS (SELECT c_custkey, max(hint) AS hint, coalesce(list_sort(list(DISTINCT item) FILTER (facet = 'attrs')), []) AS attrs, coalesce(list_sort(list(DISTINCT item) FILTER (facet = 'methods')), []) AS methods FROM e GROUP BY c_custkey),
k AS (SELECT *, CASE WHEN len(attrs) + len(methods) > 0 THEN 'structural' WHEN split_part(hint, '[', 1) IN ('int', 'str', 'None') THEN 'primitive' WHEN hint IS NOT NULL THEN 'hint' END AS kind FROM g)
SELECT concat('v', c_custkey) AS variable, kind, hint AS base_type,
       sha256(CASE WHEN kind = 'structural' THEN concat('structural:{base_type:', coalesce(hint, ''), '|attrs:', array_to_string(attrs, ','), '|methods:', array_to_string(methods, ','), '|subscripts:}') ELSE concat(kind, ':', hint) END) AS shape_hash FROM k WHERE kind IS NOT NULL
""",
)
def _(p):
    c, o = p.table("customer"), p.table("orders").where("o_orderpriority < '2'")
    status, rank = F.col("o_orderstatus"), F.col("o_orderpriority")
    hint = F.when(F.col("c_mktsegment") == "BUILDING", "None").when(F.col("c_mktsegment") == "AUTOMOBILE", "int[x]").when(F.col("c_mktsegment") == "MACHINERY", "pkg.Str").when(F.col("c_mktsegment") == "HOUSEHOLD", "str")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.concat(F.lit("v"), "c_custkey").alias("variable"), F.when(status == "F", "attrs").when(status == "O", "methods").alias("facet"),
        F.when(status == "F", F.substring(rank, 1, 1)).when(status == "O", F.substring(rank, 3, 1)).alias("item"), hint.alias("type_hint"),
    )
    return shapes.from_evidence(rows).select("variable", "kind", "base_type", "shape_hash")


# --- functions


@query(
    "fn_names",
    """
SELECT id, string_split(n, '.')[-1] AS last, regexp_replace(n, '\\.[^.]*$', '') AS parent, CASE WHEN starts_with(string_split(n, '.')[-1], '__') THEN 'private' WHEN starts_with(string_split(n, '.')[-1], '_') THEN 'protected' ELSE 'public' END AS access,
       replace(regexp_replace(concat(module_path, '/', kind, '.py'), '\\.py$', ''), '/', '.') AS module FROM (SELECT *, concat('m.', kind, '.', CASE start_line % 3 WHEN 0 THEN '_' WHEN 1 THEN '__' ELSE '' END, name) AS n FROM nodes)
""",
)
def _(p):
    n = F.concat(F.lit("m."), "kind", F.lit("."), F.when(F.col("start_line") % 3 == 0, "_").when(F.col("start_line") % 3 == 1, "__").otherwise(""), "name")
    path = F.concat("module_path", F.lit("/"), "kind", F.lit(".py"))
    return p.nodes.select("id", text.last_part(n).alias("last"), text.parent_part(n).alias("parent"), text.access_of(n).alias("access"), text.module_of(path).alias("module"))


@query("fn_texts", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) // 4 AS tokens, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS line FROM documents")
def _(p):
    return p.table("documents").select("doc_id", text.line_count(F.col("text")).cast("long").alias("lines"), text.token_estimate(F.col("text")).alias("tokens"), text.one_line(F.col("text")).alias("line"))


@query(
    "fn_scores",
    """
WITH c AS (SELECT conv_id, turn, text, lead(text, 1, text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS gold FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(gold), '[\\p{L}\\p{N}_\\p{M}]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+')) AS t FROM c)
SELECT conv_id, turn, CASE WHEN lower(trim(text)) = lower(trim(gold)) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6)::DOUBLE AS overlap FROM w
""",
)
def _(p):
    gold = F.lead("text", 1).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = p.table("conversations").withColumn("gold", F.coalesce(gold, "text"))
    return c.select("conv_id", "turn", text.exact_score(F.col("text"), F.col("gold")).alias("exact"), F.round(text.keyword_overlap(F.col("gold"), F.col("text")), 6).alias("overlap"))


@query(
    "uuid5_ids",
    """
SELECT id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1], h[18:20], '-', h[21:32]) AS uuid
FROM (SELECT id, sha1(unhex('d7e6f5a4b3c21d0e9f8a7b6c5d4e3f2a') || encode(name)) AS h FROM nodes)
""",
)
def _(p):
    return p.nodes.select("id", identity.node_id(F.col("name")).alias("uuid"))


@query(
    "uuid7_ids",
    "SELECT event_id, concat(t[1:8], '-', t[9:12], '-7', m[18:20], '-', ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', m[1]) - 1) % 4 + 1], m[2:4], '-', m[21:32]) AS uuid FROM (SELECT event_id, lower(lpad(to_hex(epoch_us(ts) // 1000), 12, '0')) AS t, md5(CAST(event_id AS VARCHAR)) AS m FROM events)",
)
def _(p):
    return p.table("events").select("event_id", identity.uuid7(F.col("ts").cast("timestamp"), F.md5(F.col("event_id").cast("string"))).alias("uuid"))


@query(
    "f2_zoom",
    """
WITH v AS (SELECT id, CASE kind WHEN 'class' THEN 'Class' WHEN 'package' THEN 'Module' ELSE 'Function' END AS label, start_line / 20.0 AS zoom FROM nodes UNION ALL SELECT id, 'Variable', origin_line / 500.0 FROM variables)
SELECT id, CASE WHEN zoom < 0.4 THEN 'overview' WHEN zoom > 1.2 THEN 'detail' ELSE 'module' END AS tier FROM v WHERE CASE WHEN zoom < 0.4 THEN label = 'Module' WHEN zoom > 1.2 THEN true ELSE label IN ('Module', 'Class', 'Function') END
""",
)
def _(p):
    label = F.when(F.col("kind") == "class", "Class").when(F.col("kind") == "package", "Module").otherwise("Function")
    v = p.nodes.select("id", label.alias("label"), (F.col("start_line") / 20.0).alias("zoom")).unionByName(p.variables.select("id", F.lit("Variable").alias("label"), (F.col("origin_line") / 500.0).alias("zoom")))
    tier = text.zoom_tier(F.col("zoom"))
    return v.where(text.shown_at(F.col("label"), tier)).select("id", tier.alias("tier"))


# --- containment trees: an order is a function, its lines are statements in nested branches

_TREE = """
ls AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_linestatus) AS s, min(l_returnflag) AS r, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
tn AS (
  SELECT 'f' || o AS id, CAST(NULL AS VARCHAR) AS parent, 'Function' AS label, 'function' AS kind, CAST(NULL AS VARCHAR) AS call_target, 0 AS seq, 1 AS start_line, 99 AS end_line FROM ls GROUP BY o
  UNION ALL SELECT 'f' || o || '.if', 'f' || o, 'ControlFlow', 'if', NULL, 1, 1, 99 FROM ls GROUP BY o
  UNION ALL SELECT 'f' || o || '.' || s, 'f' || o || '.if', 'Branch', 'case_' || s, NULL, CASE WHEN s = 'O' THEN 1 ELSE 2 END, 1, 99 FROM ls GROUP BY o, s
  UNION ALL SELECT 'f' || o || '.' || s || r, 'f' || o || '.' || s, 'Branch', 'then', NULL, 3, 1, 99 FROM ls GROUP BY o, s, r
  UNION ALL SELECT 'f' || o || '.' || s || r || '.' || k, 'f' || o || '.' || s || r, 'Statement', 'call', 't' || (p % 3), k, 2 * k, 2 * k + 1 FROM ls)
"""


def _order_trees(p: Projection) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of the trees, CONTAINS edges, and the functions."""

    def make():
        body = _TREE.replace("AS VARCHAR", "AS STRING")
        return p.sql(f"WITH {body} SELECT * FROM tn")

    nodes = p.kept("order-trees", ["lineitem"], make).read()
    return nodes, nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst")), nodes.where("label = 'Function'").select("id")


@query(
    "f1_duplicate_branches",
    f"""
WITH RECURSIVE {_TREE},
inside AS (SELECT id AS branch, id AS node FROM tn WHERE label = 'Branch' UNION ALL SELECT i.branch, t.id FROM inside i JOIN tn t ON t.parent = i.node),
fp AS (SELECT branch, string_agg(kind || ':' || coalesce(call_target, ''), '|' ORDER BY seq, kind || ':' || coalesce(call_target, '')) AS fingerprint FROM inside JOIN tn ON tn.id = node WHERE node <> branch GROUP BY branch)
SELECT branch, md5(fingerprint) AS "group", members FROM fp JOIN (SELECT fingerprint, count(*) AS members FROM fp GROUP BY fingerprint HAVING count(*) > 1) USING (fingerprint)
""",
)
def _(p):
    """Branches whose nested contents are alike, in groups of two or more."""
    from weftgraph.operators import containment

    nodes, contains, roots = _order_trees(p)
    labelled = containment.labels(contains, roots, nodes)
    return containment.duplicates(containment.fingerprints(labelled, nodes.where("label = 'Branch'"), nodes)).select("branch", "group", "members")


@query(
    "t5_tree_labels",
    f"""
WITH RECURSIVE {_TREE},
walk AS (SELECT id AS root, id AS node, 0 AS depth, lpad('0', 20, '0') || id AS place FROM tn WHERE label = 'Function'
  UNION ALL SELECT w.root, t.id, w.depth + 1, w.place || '/' || lpad(CAST(t.seq AS VARCHAR), 20, '0') || t.id FROM walk w JOIN tn t ON t.parent = w.node),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY string_split(place, '/')) AS first FROM walk),
c AS (SELECT a.node, count(*) AS inside FROM walk a JOIN walk b ON b.root = a.root AND starts_with(b.place, a.place || '/') GROUP BY a.node)
SELECT root, node, CAST(depth AS INT) AS depth, CAST(first AS INT) AS first, first + coalesce(inside, 0) AS last FROM n LEFT JOIN c USING (node)
""",
)
def _(p):
    """Numbers of all nodes in their trees: what lies inside a node has those between its first and its last."""
    from weftgraph.operators import containment

    nodes, contains, roots = _order_trees(p)
    return containment.labels(contains, roots, nodes).select("root", "node", "depth", "first", "last")


@query(
    "j25_function_flows",
    f"""
WITH RECURSIVE {_TREE},
x AS (SELECT id, parent, label, kind, lead(id) OVER (PARTITION BY parent ORDER BY seq, id) AS nxt FROM tn WHERE parent IS NOT NULL),
nx AS (SELECT id AS src, nxt AS dst FROM x WHERE nxt IS NOT NULL UNION ALL SELECT parent, id FROM x WHERE label = 'Branch' AND kind <> 'then'),
fn AS (SELECT id, split_part(id, '.', 1) AS root, label, kind, parent, start_line, end_line FROM tn)
SELECT root, 'CONTAINS' AS type, parent AS src, id AS dst, CAST(NULL AS VARCHAR) AS branch_kind FROM fn WHERE parent IS NOT NULL
UNION ALL SELECT a.root, 'NEXT', nx.src, nx.dst, CASE WHEN a.label = 'ControlFlow' AND b.label = 'Branch' THEN b.kind END FROM nx JOIN fn a ON a.id = nx.src JOIN fn b ON b.id = nx.dst WHERE a.label <> 'Function'
UNION ALL SELECT DISTINCT s.root, 'CALLS', s.id, 't' || (ls.p % 5), NULL FROM ls JOIN fn s ON s.root = 'f' || ls.o AND s.label IN ('Statement', 'ControlFlow') AND 2 * ls.k + 1 BETWEEN s.start_line AND s.end_line
""",
)
def _(p):
    """Each function's flow: containment, what follows what with the kind of a branch, and the statements' calls."""
    from weftgraph.operators import containment

    nodes, contains, roots = _order_trees(p)
    inner = nodes.where("parent IS NOT NULL")
    nxt = inner.withColumn("dst", F.lead("id").over(Window.partitionBy("parent").orderBy("seq", "id"))).where("dst IS NOT NULL").select(F.col("id").alias("src"), "dst")
    following = nxt.unionByName(inner.where("label = 'Branch' AND kind <> 'then'").select(F.col("parent").alias("src"), F.col("id").alias("dst")))
    calls = p.sql("SELECT concat('f', l_orderkey) AS src, concat('t', min(l_partkey) % 5) AS dst, 2 * l_linenumber + 1 AS line FROM lineitem GROUP BY l_orderkey, l_linenumber")
    return containment.flow_edges(containment.labels(contains, roots, nodes), nodes, following, calls)
