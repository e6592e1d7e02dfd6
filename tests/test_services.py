"""Flows, scalar functions, scores and regenerated sources."""

import ast

import pytest
from pyspark.sql import functions as F

from weftgraph.extract.regenerate import functions
from weftgraph.extract.tables import of_sources
from weftgraph.functions import text
from weftgraph.operators import flows, traverse

SOURCE = '''
def work(a, b=2):
    """Add up."""
    total = 0
    for x in a:
        if x > b:
            total += x
        elif x == 0:
            continue
        else:
            total -= 1
    while total > 100:
        total = total // 2
    try:
        total = int(total)
    except ValueError as e:
        total = 0
    finally:
        print(total)
    with open("f") as f:
        f.write("x")
    return total


def nothing():
    pass
'''


@pytest.fixture(scope="module")
def extraction(spark):
    return of_sources(spark, [("m.py", SOURCE)])


def test_regenerated_sources_parse_alike(spark, extraction):
    got = {r["name"]: r["source"] for r in functions(extraction.nodes, extraction.statements).collect()}
    assert set(got) == {"m.work", "m.nothing"}
    again = of_sources(spark, [("m.py", "\n\n".join(got.values()))])
    kinds = lambda e: sorted((r["label"], r["kind"]) for r in e.statements.select("label", "kind").collect())
    assert kinds(again) == kinds(extraction)
    assert {n.name for n in ast.parse(got["m.work"]).body} == {"work"}


@pytest.fixture(scope="module")
def base(extraction):
    return extraction.graph().settled()


def test_flow_services(spark, base):
    g = base
    ids = {r["name"]: r["id"] for r in g.nodes.select("id", "name").collect()}
    rows = [("f1", "Main flow", [ids["m.work"], ids["m.nothing"]], ["f2"]), ("f2", "Sub", [ids["m.nothing"]], []), ("f3", "Other", ["missing"], [])]
    table = spark.createDataFrame(rows, "id string, name string, node_ids array<string>, sub_flow_ids array<string>")
    g = flows.put_flows(g, table).settled()
    count = lambda graph, kind: graph.edges.where(F.col("type") == kind).count()
    assert (count(g, "STEP_OF"), count(g, "CONTAINS_FLOW")) == (3, 1)
    g = flows.add_sub_flow(g, "f2", "f3").settled()
    assert [tuple(r) for r in traverse.hierarchy(g.typed("CONTAINS_FLOW"), spark.createDataFrame([("f1",)], "id string")).select("depth", "flow").orderBy("depth").collect()] == [(0, "f1"), (1, "f2"), (2, "f3")]
    assert count(flows.remove_sub_flow(g, "f2", "f3"), "CONTAINS_FLOW") == 1
    up = flows.promote(g, ["f1"], "flows.py")
    made = up.nodes.where("kind = 'flow_function'").first()
    assert made["name"] == "flows.main_flow" and "value = work(value)\n    value = nothing(value)" in made["source_text"] and count(up, "PROMOTED_TO") == 1
    assert count(flows.delete_flows(g, spark.createDataFrame([("f1",)], "id string")), "STEP_OF") == 1


def test_node_services(spark, base):
    g = base
    new, warnings = flows.create_nodes(g, spark.createDataFrame([("n.py", "def nothing():\n    pass\n")], "path string, source string"))
    assert new.nodes.count() == 3 and warnings.count() == 1
    after, changed = flows.update_nodes(g, spark.createDataFrame([("m.py", SOURCE.replace("b=2", "b=3"))], "path string, source string"))
    assert after.nodes.count() == 2 and changed.count() == 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a.b._c", "x/y.py", "def f(\n  a):", "2024-01-02T03:04:05Z")], "n string, p string, t string, at string")
    r = df.select(
        text.last_part(F.col("n")).alias("last"), text.parent_part(F.col("n")).alias("parent"), text.module_of(F.col("p")).alias("module"), text.access_of(F.col("n")).alias("access"),
        text.one_line(F.col("t")).alias("line"), text.indented(F.lit("a\n\n b")).alias("indent"), text.line_count(F.col("t")).alias("lines"), text.token_estimate(F.lit("x" * 11)).alias("tokens"),
        text.iso_time(F.col("at")).cast("string").alias("at"), text.iso_time(F.lit("")).alias("none"), text.keyword_overlap(F.lit("Who calls x"), F.lit("x who")).alias("overlap"), text.safe_file_name(F.lit("a b/c")).alias("file"),
        text.exact_score(F.lit(" A"), F.lit("a")).alias("exact"), text.contains_score(F.lit("Alpha beta"), F.array(F.lit("alpha"), F.lit("x"))).alias("contains"), text.type_score(F.lit("12"), F.lit("number")).alias("type"),
    ).first()
    assert (r["last"], r["parent"], r["module"], r["access"], r["line"], r["lines"], r["tokens"]) == ("_c", "a.b", "x.y", "protected", "def f( a):", 2, 2)
    assert r["indent"] == "    a\n\n     b" and r["at"] == "2024-01-02 03:04:05" and r["none"] is None and round(r["overlap"], 3) == 0.667
    assert (r["file"], r["exact"], r["contains"], r["type"]) == ("a_b_c", 1.0, 0.5, 1.0)
