"""The full edge scans have every edge; one of them only those whose ends are known vertices, which all are here."""

from weftgraph.plans import registry
from weftgraph.plans.project import Projection

SF = "/root/testdata/sf0.001"


def test_all_edges(spark):
    got = registry.queries()["s7_every_edge"](spark, SF)
    edges = Projection(spark, SF).edges
    assert got.count() == edges.count() == registry.queries()["s7_all_edges"](spark, SF).count() > 5000
    assert {r["type"] for r in got.select("type").distinct().collect()} == {r["type"] for r in edges.select("type").distinct().collect()}
