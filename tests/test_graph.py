"""Patterns, shapes, writers, sources and streams on small graphs."""

import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import text
from weftgraph.graph import CodeGraph
from weftgraph.operators import aggregate, match, mutate, services, shapes, traverse
from weftgraph.sources import files
from weftgraph.streaming import changes


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "m.a", "function", "m.py"), ("b", "m.b", "function", "m.py"), ("c", "n.c", "method", "n.py"), ("d", "n.d", "function", "n.py"), ("k", "n.K", "class", "n.py")]
    n = spark.createDataFrame([(i, nm, k, p, "active", 10 * j, f"h{j % 3}") for j, (i, nm, k, p) in enumerate(nodes)], "id string, name string, kind string, module_path string, status string, start_line int, ast_hash string")
    e = spark.createDataFrame([("CALLS", "a", "b", 1), ("CALLS", "b", "c", 2), ("CALLS", "c", "a", 3), ("CALLS", "b", "d", 4), ("MEMBER_OF", "c", "k", None), ("ASSIGNS", "a", "v", 1), ("READS", "b", "v", 2), ("MUTATES", "a", "v", 3)], "type string, src string, dst string, line int")
    v = spark.createDataFrame([("v", "m.a.v", "m.a")], "id string, name string, scope string")
    return CodeGraph.of(spark, nodes=schema.conform(n, schema.LOGIC_NODES), edges=schema.conform(e, schema.EDGES), variables=schema.conform(v, schema.VARIABLES))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns_as_joins(spark, graph):
    """Questions that query texts would ask: an edge is used once a pattern, and results name vertices by id or name."""
    e = graph.typed("CALLS").select("type", "src", "dst")
    assert rows(match.fork_join(e, e, "src", "dst").select("left_end", "shared", "right_end")) == [("c", "b", "d"), ("d", "b", "c")]
    one = e.where("dst = 'b'")
    assert match.fork_join(one, one, "dst", "src").count() == 0
    assert rows(match.lacking(graph.nodes.where("kind <> 'class'"), e).select("id")) == [("d",)]
    roots = spark.createDataFrame([("a",)], "id string")
    paths = traverse.trails(e, roots, None).where("node = 'd'").select("chain", "depth")
    assert rows(paths) == [(["a", "b", "c", "a", "b", "d"][:3][:2] + ["d"], 2)]
    assert rows(traverse.shortest(e, roots, graph.nodes.where("id = 'c'"), None).select("depth")) == [(2,)]
    assert rows(traverse.closure(e, roots).select("node", "depth")) == [("a", 3), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(match.found_or_like(graph.nodes, "name", "N.D").select("id")) == [("d",)]
    nodes, edges = match.subgraph_of(spark.createDataFrame([("b",), ("n.c",), ("n.d",)], "value string"), graph.vertices, graph.edges)
    assert rows(nodes.select("id")) == [("b",), ("c",), ("d",)] and edges.count() == 2
    groups = aggregate.duplicate_groups(graph.nodes, ["ast_hash"], 1)
    assert rows(groups.select("id")) == [("a",), ("b",), ("d",), ("k",)]


def test_query_texts(spark):
    texts = ["MATCH (n) SET n.x = 1 RETURN n", "CREATE (n) RETURN n", "MATCH (n) DETACH DELETE n", "MATCH (n) RETURN n.name; MERGE (m)", "MATCH (n:Dataset) WHERE n.set = 'CREATE' RETURN n.offset AS o", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.reads_only(F.col("t")).alias("ok"))
    assert [r["ok"] for r in df.orderBy("i").collect()] == [False, False, False, False, True, True]
    said = ["Try\n```cypher\nMATCH (n) RETURN n\n```\nok", "no query", "so\nmatch (n)\nreturn n;\n\nbye", "MATCH (n)", "vfs MATCH (n) RETURN n", "match (n) return n", "find x", "who calls x?"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.query_of(F.col("t")).alias("q"), text.input_mode(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r["q"] for r in got[:4]] == ["MATCH (n) RETURN n", None, "match (n)\nreturn n", None]
    assert [r["m"] for r in got[4:]] == ["projection", "query", "command", "question"]


def test_trails_repeat_no_edge(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")], "src string, dst string")
    roots = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    assert traverse.trails(e, roots, 4).count() == 13
    assert traverse.trails(e, roots, 6).count() == 13
    assert traverse.closure(e, roots).count() == 12
    assert rows(traverse.shortest(e, roots, roots, 5).where("root = '1' AND node = '4'").select("depth")) == [(3,)]


def shape(i, kind="structural", base=None, attrs=(), subs=(), methods=()):
    return (i, kind, base, sorted(attrs), sorted(subs), sorted(methods))


def test_compatibility(spark):
    s = spark.createDataFrame(
        [shape("1", attrs="abc"), shape("2", attrs="ab"), shape("3", attrs="a"), shape("4", attrs="ab", base="dict"), shape("5", methods="xy"), shape("6", attrs="ab", methods="x"), shape("7", subs="ab"), shape("8", attrs="ab"),
         shape("h1", "hint", "pkg.User"), shape("u", "structural", "User", attrs="n"), shape("h2", "hint", "List[int]"), shape("h3", "hint", "list"), shape("h4", "hint", "Box[int]"), shape("h5", "hint", "box")],
        "id string, kind string, base_type string, attrs array<string>, subscripts array<string>, methods array<string>",
    )
    assert rows(shapes.supersets(s)) == [("1", "2"), ("1", "8"), ("6", "2"), ("6", "8")]
    clusters = {(r["src"], r["dst"]) for r in shapes.facet_clusters(s).collect()}
    assert ("1", "5") in clusters and ("5", "7") in clusters and ("6", "5") not in clusters and ("4", "5") not in clusters
    assert set(rows(shapes.facet_clusters(s, s.where("id = '5'")).select("src", "dst"))) == {c for c in clusters if "5" in c}
    assert rows(shapes.hint_links(s)) == [("h1", "u"), ("u", "h1")]
    assert {(r["src"], r["dst"]) for r in shapes.generalizations(s).collect()} == {("h2", "h3"), ("h4", "h5")}


def test_writers(spark, graph):
    e = graph.edges
    kept = mutate.upsert_edges(e.where("false"), e.unionByName(spark.createDataFrame([("CALLS", "a", "v"), ("CALLS", "a", "zz")], "type string, src string, dst string"), allowMissingColumns=True), graph.vertices)
    assert kept.count() == e.count()  # an end of the wrong label and a missing end give no edge
    nodes, left = mutate.detach_delete(graph.nodes, e, spark.createDataFrame([("b",)], "id string"))
    assert nodes.count() == 4 and rows(left.select("src", "dst").where("type = 'CALLS'")) == [("c", "a")]
    with pytest.raises(KeyError):
        mutate.delete_edges(e, spark.createDataFrame([("CALLS", "d", "a")], "type string, src string, dst string"))
    assert mutate.delete_edges(e, spark.createDataFrame([("CALLS", "a", "b")], "type string, src string, dst string")).count() == e.count() - 1
    nodes, edges = mutate.deprecate(graph.nodes, spark.createDataFrame([("a", "b")], "id string, replaced_by string"), e)
    assert rows(nodes.where("status = 'deprecated'").select("id")) == [("a",)] and edges.where("type = 'DEPENDS_ON' AND kind = 'replaced_by'").count() == 1
    merged = mutate.upsert_properties(e.select("type", "src", "dst", "line", "branch"), spark.createDataFrame([("CALLS", "a", "b", "if")], "type string, src string, dst string, branch string"))
    assert rows(merged.where("src = 'a' AND dst = 'b'").select("line", "branch")) == [(1, "if")]
    twice = e.where("src = 'a' AND type = 'READS' OR src = 'b' AND type = 'READS'").withColumn("line", F.lit(9))
    assert mutate.upsert_edges(e, twice, graph.vertices, by_place=True).count() == e.count() + 1


def test_statements(spark):
    s = spark.createDataFrame([("x0", "f", 0), ("x1", "f", 1), ("x2", "f", 2)], "id string, parent string, seq int")
    more = mutate.insert_statement(s, spark.createDataFrame([("new",)], "id string"), "f", 1)
    assert rows(more.select("seq", "id")) == [(0, "x0"), (1, "new"), (2, "x1"), (3, "x2")]
    assert rows(aggregate.next_edges(mutate.delete_statement(more, "new")).select("src", "dst")) == [("x0", "x1"), ("x1", "x2")]


def test_shapes_of_evidence(spark):
    e = [("v1", "attrs", "a", "dict"), ("v1", "methods", "m", "dict"), ("v2", None, None, "NoneType"), ("v3", None, None, "Str"), ("v4", None, None, "x.int"), ("v5", None, None, "int[3]"), ("v6", None, None, None), ("v7", "attrs", "a", None)]
    got = {r["variable"]: (r["kind"], r["base_type"]) for r in shapes.from_evidence(spark.createDataFrame(e, "variable string, facet string, item string, type_hint string")).collect()}
    assert got == {"v1": ("structural", "dict"), "v2": ("primitive", "NoneType"), "v3": ("hint", "Str"), "v4": ("hint", "x.int"), "v5": ("primitive", "int[3]"), "v7": ("structural", None)}


def test_gaps_and_impact(spark):
    """Inactive nodes, DEPENDS_ON, MEMBER_OF, steps of flows, missing sources."""
    n = [("a", "read_it", "function", "x/m.py", "active", "no"), ("b", "b", "function", "x/m.py", "active", "try: b"), ("c", "c", "class", "y.py", "active", None), ("d", "d", "method", "y.py", "deprecated", "no"), ("e", "e", "function", "y.py", "active", "no"), ("f", "Open", "function", "y.py", "active", "no"), ("g", "load", "function", "y.py", "active", "no")]
    nodes = spark.createDataFrame(n, "id string, name string, kind string, module_path string, status string, source_text string")
    e = [("CALLS", "b", "a"), ("CALLS", "e", "a"), ("CALLS", "e", "f"), ("CALLS", "e", "g"), ("CALLS", "a", "d"), ("DEPENDS_ON", "a", "e"), ("MEMBER_OF", "d", "c"), ("STEP_OF", "f", "w"), ("MUTATES", "a", "v"), ("READS", "d", "v"), ("READS", "e", "v"), ("READS", "a", "v"), ("MUTATES", "e", "u"), ("MUTATES", "a", "u")]
    edges = spark.createDataFrame(e, "type string, src string, dst string")
    graph = CodeGraph.of(spark, nodes=schema.conform(nodes, schema.LOGIC_NODES), edges=schema.conform(edges, schema.EDGES))
    assert rows(services.dead_ends(nodes, edges).select("id")) == [("c",), ("g",)]
    assert rows(services.orphans(nodes, edges).select("id")) == [("b",)]
    assert rows(services.untested_mutations(edges)) == [("u", "a"), ("u", "e")]
    report = services.gap_report(graph)
    assert rows(report["missing_error_handling"]) == [("e", "e", ["read_it"])]
    assert rows(report["circular_dependencies"]) == [("a", "e", None)]
    assert rows(services.gap_report(graph, "/m")["dead_ends"].select("id")) == [] and services.gap_report(graph, "/m")["circular_dependencies"].count() == 1
    assert rows(match.impact(edges, nodes, nodes.where("id = 'a'"))) == [("a", "b", "calls it"), ("a", "e", "calls it"), ("a", "e", "reads v")]
    triangle = spark.createDataFrame([("CALLS", x, y) for x, y in ("ba", "ae", "eb")], "type string, src string, dst string")
    assert services.circular_dependencies(nodes, triangle).count() == 0 and rows(services.circular_dependencies(nodes, triangle, ordered=False)) == [("a", "e", "b")]


def test_the_last_row_wins(spark):
    r = spark.createDataFrame([("k", 1, "x", [1]), ("k", 2, "a", [2]), ("k", 2, "b", [0]), ("l", 0, None, None)], "id string, at int, v string, w array<int>")
    assert rows(mutate.upsert(r.where("false"), r, order="at")) == [("k", 2, "b", [0]), ("l", 0, None, None)]
    assert rows(mutate.upsert(r.where("at = 0"), r.where("at > 0"))) == [("k", 2, "b", [0]), ("l", 0, None, None)]
    changes_ = spark.createDataFrame([("p", "modified", "h1", 5, "2024-01-01 00:00:00"), ("p", "deleted", "h0", 7, "2024-01-01 00:00:00")], "path string, kind string, hash string, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(changes.debounced(changes_).select("kind", "hash", "n")) == [("deleted", "h0", 2)]


def test_a_switch_of_repository_flushes(graph):
    assert mutate.flushed_on_switch(graph, "m.").nodes.count() == 5
    other = mutate.flushed_on_switch(graph, "/other")
    assert other.nodes.count() == other.edges.count() == other.variables.count() == 0


def test_services(graph):
    assert rows(services.dead_ends(graph.nodes, graph.edges).select("id")) == [("d",), ("k",)]
    assert rows(services.orphans(graph.nodes, graph.edges).select("id")) == []
    assert set(services.gap_report(graph)) == {"dead_ends", "orphans", "missing_error_handling", "circular_dependencies", "untested_mutations"}
    assert rows(match.impact(graph.edges, graph.nodes).where("node = 'a'").select("affected", "reason")) == [("b", "reads v"), ("c", "calls it")]
    assert rows(services.call_chain(graph, "m.a", 1).nodes.select("id")) == [("a",), ("b",)]
    assert rows(services.completions(graph, "import", "n").select("label")) == [("n.py",)]
    assert services.keywords("What does the 'parser' call? A function?") == ["parser", "function"]
    named = graph.nodes.withColumn("name", F.concat("name", F.lit("_loader")))
    assert rows(services.focal_nodes(named, "the loader?", 2).select("id")) == [("a",), ("b",)]
    assert services.focal_nodes(named.withColumn("status", F.lit("deprecated")), "loader").count() == services.focal_nodes(named.withColumn("name", F.upper("name")), "loader").count() == 0
    timeline = services.variable_timeline(graph, graph.variables.select("id")).select("type", "terminal").collect()
    assert len(timeline) == 3
    with pytest.raises(ValueError):
        services.logic_pack(graph, "nothing", "x")


def test_round_trips(spark, graph, tmp_path):
    graph.write(f"{tmp_path}/g")
    files.write_json_graph(graph, f"{tmp_path}/j")
    for back in (CodeGraph.read(spark, f"{tmp_path}/g"), files.read_json_graph(spark, f"{tmp_path}/j")):
        for name in ("nodes", "variables", "edges"):
            columns = [c for c in getattr(graph, name).columns if c != "properties"]
            assert getattr(back, name).select(*columns).exceptAll(getattr(graph, name).select(*columns)).count() == 0 and getattr(back, name).count() == getattr(graph, name).count()
    assert files.read_json_graph(spark, f"{tmp_path}/j", "CALLS").edges.count() == 4


def test_sources(spark, tmp_path):
    for path in ("a.py", "pkg/b.py", "pkg/__init__.py", "pkg/__pycache__/c.py", ".venv/d.py", "pkg/e.txt", ".hidden/f.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n" * 3)
    found = files.python_files(spark, str(tmp_path))
    assert rows(found.select("path")) == [(".hidden/f.py",), ("a.py",), ("pkg/__init__.py",), ("pkg/b.py",)]
    assert files.python_files(spark, str(tmp_path), dot_folders=False).count() == 3
    assert files.content(found, "a.py").first()["source"] == "x = 1\n" * 3


def test_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(25))
    got = services.chunks(spark.createDataFrame([("p", text), ("q", ""), ("r", "\n\n")], "path string, content string"), 10, 2)
    assert rows(got.select("start_line", "end_line")) == [(1, 10), (9, 18), (17, 25)]


def test_content_gate(spark, tmp_path):
    feed = [(1, "p", "modified", "A"), (2, "p", "modified", "A"), (3, "p", "modified", "B"), (4, "p", "modified", "A"), (5, "q", "created", "A"), (6, "q", "deleted", "A"), (7, ".git/x", "created", "A")]
    df = spark.createDataFrame([(p, k, h, i) for i, p, k, h in feed], "path string, kind string, hash string, id long").withColumn("ts", F.timestamp_seconds("id"))
    df.write.parquet(f"{tmp_path}/in")
    stream = changes.watched(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    got = changes.written_stream(changes.changed_content(stream), "gate")
    assert rows(got.select("id")) == [(1,), (3,), (4,), (5,)]
    assert rows(changes.changed_content_batch(changes.watched(df)).select("id")) == [(1,), (3,), (4,), (5,)]
    assert rows(changes.debounced(df, "2 seconds").select("path", "n")) == [(".git/x", 1), ("p", 4), ("q", 2)]


def test_index_stream(spark, tmp_path):
    df = spark.createDataFrame([("m.py", 1, "def a(): pass"), ("m.py", 2, "def b(): pass")], "path string, t long, source string").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    q = changes.index_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck", lambda batch, number: seen.extend(batch.select("path", "source").collect()))
    q.awaitTermination()
    assert [(r["path"], r["source"]) for r in seen] == [("m.py", "def b(): pass")]


def test_reindex_keeps_callers(spark):
    from weftgraph.extract.tables import of_sources

    g = of_sources(spark, [("m.py", "def a():\n    pass\n\n\ndef old():\n    pass\n"), ("n.py", "from m import a\n\n\ndef c():\n    a()\n")]).graph()
    again = changes.reindexed(g, spark.createDataFrame([("m.py", "def a():\n    return 1\n")], "path string, source string"))
    assert rows(again.nodes.select("name")) == [("m.a",), ("n.c",)]
    assert again.edges.where("type = 'CALLS'").count() == 1
