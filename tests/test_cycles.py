"""Components, closure, longest and shortest ways, triangles: against brute force on graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import levels, match, scc, traverse


def graph(seed, nodes=14, edges=24):
    rng = random.Random(seed)
    found = {(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(edges)}
    if seed % 2:  # a long cycle and a tail
        found |= {(f"c{i}", f"c{(i + 1) % 6}") for i in range(6)} | {("n03", "c0"), ("c3", "t0"), ("t0", "t1"), ("t1", "t2")}
    return sorted(found)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def plain_reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for root in {x for p in pairs for x in p}:
        depth, level, seen = 0, {root}, {}
        while level:
            depth += 1
            level = {b for a in level for b in out.get(a, ())} - set(seen)
            seen.update(dict.fromkeys(level, depth))
        found[root] = seen
    return found


def plain_deepest(pairs, depth):
    out = {}
    for p in pairs:
        out.setdefault(p[0], []).append(p)
    best = {}

    def go(root, at, used):
        if at not in out and used:
            best[root] = max(best.get(root, 0), len(used))
        if len(used) < depth:
            for p in out.get(at, ()):
                if p not in used:
                    go(root, p[1], used | {p})

    for root in out:
        go(root, root, frozenset())
    return best


@pytest.mark.parametrize("seed", [0, 1])
def test_components_and_closure(spark, seed):
    pairs = graph(seed)
    reach = plain_reach(pairs)
    expected = {}
    for a in reach:
        mates = {b for b in reach[a] if a in reach[b]} | {a}
        if len(mates) > 1:
            expected[a] = min(mates)
    e = frame(spark, [*pairs, pairs[0]])
    assert {r["node"]: r["component"] for r in scc.components(e).collect()} == expected
    roots = ["n00", "n03", "n05", "c1", "nowhere"]
    got = sorted((r["root"], r["node"]) for r in scc.reachable(e, ids(spark, roots)).pairs().collect())
    assert got == sorted((a, b) for a in roots for b in reach.get(a, ()))


def test_empty_and_acyclic(spark):
    assert scc.components(frame(spark, [])).count() == 0 and scc.components(frame(spark, [("a", "b"), ("b", "c"), ("c", "c")])).count() == 0
    assert sorted(map(tuple, scc.reachable(frame(spark, [("a", "b"), ("c", "c")]), ids(spark, "abc")).pairs().collect())) == [("a", "b"), ("c", "c")]
    assert levels.reach(frame(spark, []), ids(spark, "a"), None).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_deepest(spark, seed):
    pairs = graph(seed, 10, 15)
    for depth in (8,):
        got = {r["root"]: r["depth"] for r in traverse.deepest(frame(spark, pairs), ids(spark, sorted({a for a, _ in pairs})), depth).collect()}
        assert got == plain_deepest(pairs, depth)


@pytest.mark.parametrize("include", [False, True])
def test_reach_of_many_roots(spark, include):
    """More roots than a block of bits has."""
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(260)})
    reach = plain_reach(pairs)
    got = {(r["root"], r["node"]): r["depth"] for r in levels.reach(frame(spark, pairs), ids(spark, sorted(reach)), None, include_roots=include).collect()}
    expected = {(a, b): d for a, seen in reach.items() for b, d in seen.items() if not (include and a == b)}
    assert got == expected | ({(a, a): 0 for a in reach} if include else {})
    near = {k: d for k, d in expected.items() if d <= 2}
    assert {(r["root"], r["node"]): r["depth"] for r in levels.reach(frame(spark, pairs), ids(spark, sorted(reach)), 2).collect()} == near if not include else True


@pytest.mark.parametrize("seed", [1])
def test_shortest_chains(spark, seed):
    pairs = [p for p in graph(seed, 30, 50) if p[0] != p[1]]
    reach = plain_reach(pairs)
    roots, targets = sorted(reach)[:12], sorted(reach)
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    expected = {}
    for root in roots:
        depth = {root: 0} | {b: d for b, d in reach[root].items() if b != root}
        for node, d in depth.items():
            chain = [node]
            while d > 0:
                d -= 1
                chain.insert(0, min(x for x in into[chain[0]] if depth.get(x) == d))
            if len(chain) > 1:
                expected[root, node] = chain
    got = {(r["root"], r["node"]): r["chain"] for r in traverse.shortest(frame(spark, pairs), ids(spark, roots), ids(spark, targets), None).collect()}
    assert got == expected


def test_seen_is_not_shuffled(spark):
    """The plan of a level shuffles its frontier and what it grows, and neither earlier levels nor edges."""
    e, roots = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)]), ids(spark, ["n0", "n1"])
    found = levels.Levels(ids(spark, []), levels.Buckets(spark, "seen", ("node", "block"), "depth"), levels.Buckets(spark, "edges", ("src",)), 1)
    found.edges.append(e)
    for d in range(3):
        found.seen.append(roots.select(F.concat("id", F.lit(str(d))).alias("node"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("mask"), F.lit(d).alias("depth")))
    plan = levels.step(found, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Bucketed: true") == 2, plan
    found.seen.close()
    found.edges.close()


@pytest.mark.parametrize("seed", range(3))
def test_three_cycles(spark, seed):
    pairs = graph(seed, 9, 40)
    edges = set(pairs)
    names = sorted({x for p in pairs for x in p})
    expected = sorted((a, b, c) for a in names for b in names for c in names if len({a, b, c}) == 3 and a == min(a, b, c) and {(a, b), (b, c), (c, a)} <= edges)
    got = sorted(map(tuple, match.three_cycles(frame(spark, [*pairs, *pairs[:5]])).select("a", "b", "c").collect()))
    assert got == expected
    assert sorted(map(tuple, match.three_cycles(frame(spark, pairs), ordered=True).select("a", "b", "c").collect())) == [t for t in expected if t[1] < t[2]]


def test_wedges_at_a_hub(spark):
    """A node with 100,000 edges makes no pairs of them."""
    spokes = spark.range(1, 50_001)
    hub = spokes.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spokes.select("id", F.lit(0).cast("long")))
    ring = spokes.where("id < 50000").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = hub.union(ring)
    m = 150_000
    assert match.wedges(edges).count() < 4 * m < m**1.5
    assert match.three_cycles(edges).count() == 49_999


def test_one_large_component_needs_no_colours(spark, monkeypatch):
    """The component that most ways pass is found by a search both ways; others still come by colours."""
    def never(edges):
        raise AssertionError("colours")

    ring = [(f"r{k:02}", f"r{(k + 1) % 20:02}") for k in range(20)] + [("r00", "r05"), ("r03", "r00")]
    tails = [("a", "r01"), ("r07", "b"), ("b", "c"), ("a", "b")]
    made = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    with monkeypatch.context() as m:
        m.setattr(scc, "_colours", never)
        found = {(r["node"], r["component"]) for r in scc.components(made(ring + tails)).collect()}
    assert found == {(f"r{k:02}", "r00") for k in range(20)}
    other = [("x", "y"), ("y", "x"), ("c", "x"), ("u", "v"), ("v", "u")]
    found = {(r["node"], r["component"]) for r in scc.components(made(ring + tails + other)).collect()}
    assert found == {(f"r{k:02}", "r00") for k in range(20)} | {("x", "x"), ("y", "x"), ("u", "u"), ("v", "u")}
    assert scc.components(made(tails)).isEmpty()
