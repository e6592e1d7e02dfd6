"""Patterns without an upper bound go on to the end of a chain."""

import pytest

from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import CodeGraph
from weftgraph.operators import traverse

LAST = 15


@pytest.fixture(scope="module")
def chain(spark):
    """n0 calls n1, and so on to n15, which calls n14."""
    n = spark.createDataFrame([(f"n{i}", f"m.n{i}", "function", "m.py", "active") for i in range(LAST + 1)], "id string, name string, kind string, module_path string, status string")
    e = spark.createDataFrame([("CALLS", f"n{i}", f"n{i + 1}") for i in range(LAST)] + [("CALLS", f"n{LAST}", f"n{LAST - 1}")], "type string, src string, dst string")
    v = spark.createDataFrame([], "id string, name string, scope string")
    return CodeGraph.of(spark, nodes=schema.conform(n, schema.LOGIC_NODES), edges=schema.conform(e, schema.EDGES), variables=schema.conform(v, schema.VARIABLES))


def test_no_upper_bound(chain, spark):
    calls, first = chain.typed("CALLS"), spark.createDataFrame([("n0",)], "id string")
    last = spark.createDataFrame([(f"n{LAST}",)], "id string")
    assert sorted(r["node"] for r in traverse.closure(calls, first).collect()) == sorted(f"n{i}" for i in range(1, LAST + 1))
    assert sorted(r["node"] for r in traverse.reach(calls, first, 50).collect()) == sorted(f"n{i}" for i in range(1, LAST + 1))
    long = traverse.trails(calls, first, None, least=13).select("node", "depth").collect()
    assert sorted(map(tuple, long)) == [("n13", 13), ("n14", 14), ("n14", 16), ("n15", 15)]
    assert [r["depth"] for r in traverse.shortest(calls, first, last, None).collect()] == [LAST]


def test_levels_hold_only_what_is_new(chain, spark):
    """On a cycle, deep and lazy forms agree, and no pair is met twice."""
    calls = chain.typed("CALLS").unionByName(chain.typed("CALLS").where("src = 'n3'").withColumn("dst", F.lit("n0")))
    roots = spark.createDataFrame([("n0",), ("n2",)], "id string")
    lazy, deep = (sorted(map(tuple, traverse.reach(calls, roots, 4, include_roots=i).select("root", "node", "depth").collect())) for i in (False, True))
    found = traverse.reach(calls, roots, 9).collect()
    assert len({(r["root"], r["node"]) for r in found}) == len(found)
    assert sorted(tuple(r) for r in found if r["depth"] <= 4) == lazy and {x for x in deep if x[2]} == {x for x in lazy if x[0] != x[1]}
