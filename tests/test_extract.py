"""Extraction: expectations on small sources."""

import textwrap
import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.extract.tables import Extraction, changed, counted, of_sources, records
from weftgraph.extract.walker import Walker, access, module_name
from weftgraph.functions import identity

FLOW = textwrap.dedent('''
    """A small pipeline."""
    import hashlib


    def parse(raw: str) -> dict:
        """Split."""
        parts = raw.split(",")
        record = {"name": parts[0]}
        return record


    def check(record: dict) -> dict:
        if not record["name"]:
            raise ValueError("name")
        elif record["value"] > 3:
            record["hash"] = hashlib.md5(b"x").hexdigest()
        else:
            record.update(a=1)
        return record


    def store(record, db):
        db.execute("insert", record)
        db.commit()
        return db


    def run(raw: str, db) -> str:
        parsed = parse(raw)
        valid = check(record=parsed)
        valid = check(valid)
        result = store(valid, db)
        return result
''')

CLASSES = textwrap.dedent("""
    from abc import ABC
    from .flow import parse as read


    class Base(ABC):
        size: int

        def __init__(self, size: int = 0) -> None:
            self.size = size
            self._items: list = []

        async def _grow(self, by: int, *more, scale=1, **rest):
            self.size += by
            self._items.append(by)
            for i, x in enumerate(more):
                total = i + x
            return self.size


    class Child(Base):
        def go(self, other: Base):
            self._grow(1)
            other._grow(2)
            made = Base(3)
            made._grow(4)
            return read("a,b")
""")


def edges(source, path, kind):
    return {(r["src"], r["dst"]) for r in Walker(path, source).run() if r["record"] == "edge" and r["type"] == kind}


def test_names():
    assert module_name("pkg/sub/mod.py") == "pkg.sub.mod" and module_name("pkg/__init__.py") == "pkg.__init__"
    assert [access(n) for n in ("a", "_a", "__a", "__a__")] == ["public", "protected", "private", "public"]


def test_pipeline_edges():
    assert {d for s, d in edges(FLOW, "flow.py", "CALLS") if s == "flow.run"} == {"flow.parse", "flow.check", "flow.store"}
    assert ("flow.parse", "flow.parse.record") in edges(FLOW, "flow.py", "RETURNS")
    assert ("flow.check", "flow.check.record") in edges(FLOW, "flow.py", "MUTATES")
    assert ("flow.parse", "flow.parse.raw") in edges(FLOW, "flow.py", "READS")
    rebinds = [r["is_rebind"] for r in Walker("flow.py", FLOW).run() if r["record"] == "edge" and r["type"] == "ASSIGNS" and r["dst"] == "flow.run.valid"]
    assert rebinds == [False, True]
    orders = [r["call_order"] for r in Walker("flow.py", FLOW).run() if r["record"] == "edge" and r["type"] == "CALLS" and r["src"] == "flow.run"]
    assert orders == [0, 1, 2, 3]
    contexts = {(r["branch"], r["control_context"]) for r in Walker("flow.py", FLOW).run() if r["record"] == "edge" and r["type"] == "MUTATES" and r["src"] == "flow.check"}
    assert {b for b, _ in contexts} == {"elif", "else"}


def test_classes_and_resolution():
    calls = edges(CLASSES, "pkg/shapes.py", "CALLS")
    assert {d for s, d in calls if s == "pkg.shapes.Child.go"} == {"pkg.shapes.Child._grow", "pkg.shapes.Base._grow", "pkg.shapes.Base", "pkg.flow.parse"}
    assert edges(CLASSES, "pkg/shapes.py", "INHERITS") == {("pkg.shapes.Base", "abc.ABC"), ("pkg.shapes.Child", "pkg.shapes.Base")}
    assert ("pkg.shapes.Base._grow", "pkg.shapes.Base") in edges(CLASSES, "pkg/shapes.py", "MEMBER_OF")
    assert ("pkg.shapes.Base._grow", "pkg.shapes.Base._items") in edges(CLASSES, "pkg/shapes.py", "MUTATES")
    rows = Walker("pkg/shapes.py", CLASSES).run()
    grow = next(r for r in rows if r["record"] == "node" and r["name"].endswith("_grow"))
    assert grow["is_async"] and [(p["name"], p["kind"]) for p in grow["params"]] == [("by", "positional_or_keyword"), ("more", "var_positional"), ("scale", "keyword_only"), ("rest", "var_keyword")]
    assert any(r["record"] == "variable" and r["name"] == "pkg.shapes.Base.size" and r["is_attribute"] for r in rows)


CHAIN = textwrap.dedent("""
    class Product:
        def price(self) -> float:
            return 1.0


    class Item:
        product: Product

        def subtotal(self):
            return self.product.price()


    class Order:
        def __init__(self, first: Item) -> None:
            self.items: list[Item] = []
            self.first = first

        def total(self):
            return sum(item.subtotal() for item in self.items) + self.first.subtotal()


    def add(orders: list[Order]):
        for o in orders:
            o.total()
""")


def test_types_of_attributes_and_elements():
    assert {e for e in edges(CHAIN, "m.py", "CALLS") if e[1].startswith("m.")} == {("m.Item.subtotal", "m.Product.price"), ("m.Order.total", "m.Item.subtotal"), ("m.add", "m.Order.total")}


def test_statements_and_order():
    rows = [r for r in Walker("flow.py", FLOW).run() if r["record"] == "statement"]
    inside = [r for r in rows if r["parent"] == "flow.run"]
    assert [r["kind"] for r in inside] == ["assignment"] * 4 + ["return"] and [r["seq"] for r in inside] == list(range(5))
    branches = [r["kind"] for r in rows if r["label"] == "Branch"]
    assert branches == ["if", "elif", "else"]
    assert next(r for r in rows if r["kind"] == "if" and r["label"] == "ControlFlow")["condition"] == "not record['name']"
    assert len([e for e in Walker("flow.py", FLOW).run() if e["record"] == "edge" and e["type"] == "NEXT" and e["src"].startswith("flow.run")]) == 4


def test_hashes():
    a = "def f(x: int) -> int:\n    return x + 1\n"
    b = 'def f(x: int) -> int:\n    """Doc."""\n    # note\n    return x  +  1\n'
    assert identity.ast_hash(a) == identity.ast_hash(b) and identity.ast_hash(a) != identity.ast_hash(a.replace("1", "2"))
    assert identity.structural_hash(a) == identity.structural_hash(a.replace("x", "y").replace("1", "2").replace("def f", "def g"))
    assert identity.signature_changed(a, a.replace("-> int", "-> str")) and not identity.signature_changed(a, b)
    assert identity.return_type(a) == "int" and identity.signature("class A(B, m=C): pass") == "class A(B, m=C)" and identity.params("def f(self, x=5): pass") == [{"name": "x", "type_hint": None, "default": "5", "kind": "positional_or_keyword"}]


def test_uuid5(spark):
    names = ["a", "services.run", "é", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.node_id(F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in got} == {n: str(uuid.uuid5(identity.NAMESPACE, n)) for n in names}


@pytest.fixture(scope="module")
def extraction(spark):
    return of_sources(spark, [("pkg/flow.py", FLOW), ("pkg/shapes.py", CLASSES), ("bad.py", "def ("), ("empty.py", "")])


def test_graph(spark, extraction):
    g = extraction.graph(cross_file=True)
    names = {r["id"]: r["name"] for r in g.vertices.select("id", "name").collect()}
    pairs = {(r["type"], names[r["src"]], names[r["dst"]]) for r in g.edges.where("type in ('CALLS', 'PASSES_TO', 'FEEDS')").collect()}
    assert ("CALLS", "pkg.shapes.Child.go", "pkg.flow.parse") in pairs
    assert {("PASSES_TO", "pkg.flow.run.raw", "pkg.flow.parse.raw"), ("PASSES_TO", "pkg.flow.run.parsed", "pkg.flow.check.record"), ("PASSES_TO", "pkg.flow.run.db", "pkg.flow.store.db")} <= pairs
    assert {("FEEDS", "pkg.flow.parse.raw", "pkg.flow.parse.parts"), ("FEEDS", "pkg.flow.parse.parts", "pkg.flow.parse.record")} <= pairs
    assert extraction.errors.count() == 1
    report = extraction.report().first()
    assert report["files"] == 4 and report["errors"] == 1 and report["nodes"] == 9


def test_shapes(extraction):
    table, links = extraction.shaped()
    by_variable = {r["variable"]: r for r in links.join(table, links["shape_id"] == table["id"]).where("NOT dual").collect()}
    assert set(by_variable["pkg.flow.check.record"]["subscripts"]) == {"name", "value", "hash"} and by_variable["pkg.flow.check.record"]["base_type"] == "dict"
    assert set(by_variable["pkg.flow.store.db"]["methods"]) == {"execute", "commit"} and by_variable["pkg.flow.store.db"]["base_type"] is None
    assert by_variable["pkg.flow.run.raw"]["kind"] == "primitive"


def test_changed(extraction):
    nodes = extraction.nodes
    assert changed(nodes, nodes).count() == 0
    assert changed(nodes, nodes.withColumn("ast_hash", F.when(F.col("name") == "pkg.flow.run", "x").otherwise(F.col("ast_hash")))).count() == 1


def test_statement_texts_are_segments_of_the_source():
    source = 'def f(a):\r\n    b = "\u00e4\u20ac"; c = a\r\n    d = (a +\r\n         b)\f\n    return d\n'
    import ast

    texts = [r["text"] for r in Walker("m.py", source).run() if r["record"] == "statement"]
    assert texts == [ast.get_source_segment(source, n) for n in ast.parse(source).body[0].body]


def _files(spark):
    return spark.createDataFrame([("flow.py", FLOW), ("pkg/shapes.py", CLASSES), ("bad.py", "def f(:")], "path string, source string")


def test_records_of_some_kinds(spark):
    """Records of a kind are those of the whole extraction, in the columns that the kind has."""
    whole = records(_files(spark))
    for kinds in (("node",), ("statement",), ("evidence", "variable"), ("argument", "param"), ("edge",), ("error",), ("node", "statement")):
        some = records(_files(spark), kinds)
        same = whole.where(F.col("record").isin(*kinds))
        rows = same.select(some.columns).collect()
        assert rows and sorted(map(repr, some.collect())) == sorted(map(repr, rows))
        others = [c for c in whole.columns if c not in some.columns]
        assert others and same.where(F.coalesce(*[F.col(c).cast("string") for c in others]).isNotNull()).isEmpty()
    outline = records(_files(spark), ("edge",), bodies=False)
    rows = whole.where("record = 'edge' AND type IN ('DEFINES', 'MEMBER_OF', 'INHERITS', 'IMPORTS')").select(outline.columns).collect()
    assert sorted(map(repr, outline.collect())) == sorted(map(repr, rows))


def test_hashes_are_made_where_they_are_read(spark):
    nodes = of_sources(spark, [("flow.py", FLOW)]).nodes
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_hashes" not in plan(nodes.select("name", "signature")) and "_hashes" in plan(nodes.select("ast_hash"))
    start = FLOW.index("def check")
    assert nodes.where("name = 'flow.check'").first()["ast_hash"] == identity.ast_hash(FLOW[start : FLOW.index("def store")])


def test_counters_without_records(spark):
    files = _files(spark)
    assert counted(files).collect() == Extraction(records(files)).report().collect()


def test_nodes_of_files_that_are_parsed_anew(spark):
    """``reindexed_nodes`` gives the nodes of the whole graph's ``reindexed``, and reads no other record."""
    from weftgraph.streaming import changes

    graph = of_sources(spark, [("flow.py", FLOW), ("pkg/shapes.py", CLASSES)]).graph()
    files = spark.createDataFrame([("flow.py", FLOW.replace("def run", "def go"))], "path string, source string")
    found = changes.reindexed_nodes(graph.nodes, files, Extraction(records(files, ("node",))).nodes)
    names = sorted(r["name"] for r in found.select("name").collect())
    assert names == sorted(r["name"] for r in changes.reindexed(graph, files).nodes.select("name").collect())
    assert "flow.go" in names and "flow.run" not in names and "pkg.shapes.Base" in names
