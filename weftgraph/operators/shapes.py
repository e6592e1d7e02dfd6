"""Type shapes: definitions from evidence, compatibility, consumers and producers.

A shape has id, kind (structural, primitive, hint), base_type, and for structural ones attrs, subscripts and methods
(sorted arrays).  Compatibility gives edges (src, dst, strength).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, which results depend on: types that are primitive, and containers that a hint never stands for.
PRIMITIVES = ("int", "float", "str", "bool", "bytes", "complex", "None", "NoneType")
CONTAINERS = ("list", "dict", "set", "tuple", "frozenset", "deque")
FACETS = ("attrs", "subscripts", "methods")


def _facet(name: str, prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}{name}"), F.array().cast("array<string>"))


def _marked(facet: str) -> Column:
    """A facet's items, told apart from those of other facets."""
    return F.transform(_facet(facet), lambda x: F.concat(F.lit(facet + ":"), x))


def normal_base(hint: Column) -> Column:
    """The base of a type hint: before any bracket, after the last dot, lower-cased."""
    return F.lower(F.trim(F.substring_index(F.substring_index(hint, "[", 1), ".", -1)))


def outer(hint: Column) -> Column:
    """A type hint before any bracket, as it is written."""
    return F.trim(F.substring_index(hint, "[", 1))


def canonical(kind: Column, base: Column, attrs: Column, methods: Column, subscripts: Column) -> Column:
    """The text that a shape's hash is made of."""
    known = F.coalesce(base, F.lit(""))
    part = lambda label, a: F.concat(F.lit(label + ":"), F.array_join(F.array_sort(F.array_distinct(a)), ","))
    facets = F.concat_ws("|", F.concat(F.lit("base_type:"), known), part("attrs", attrs), part("methods", methods), part("subscripts", subscripts))
    return F.when(kind == "structural", F.concat(F.lit("structural:{"), facets, F.lit("}"))).otherwise(F.concat(kind, F.lit(":"), known))


def from_evidence(evidence: DataFrame, key: str = "variable") -> DataFrame:
    """One shape per variable from rows (variable, facet, item, type_hint); none without evidence or hint.

    Any access makes it structural, with the hint as its base; else the hint alone makes it primitive or a hint.
    """
    pick = lambda facet: F.array_sort(F.collect_set(F.when(F.col("facet") == facet, F.col("item"))))
    found = evidence.groupBy(key).agg(pick("attrs").alias("attrs"), pick("subscripts").alias("subscripts"), pick("methods").alias("methods"), F.max("type_hint").alias("type_hint"))
    any_access = F.size("attrs") + F.size("subscripts") + F.size("methods") > 0
    hinted = F.coalesce("type_hint", F.lit("")) != ""
    kind = F.when(any_access, "structural").when(hinted & outer(F.col("type_hint")).isin(*PRIMITIVES), "primitive").when(hinted, "hint")
    out = found.withColumn("kind", kind).withColumn("base_type", F.when(hinted, F.col("type_hint"))).where("kind IS NOT NULL")
    return out.withColumn("shape_hash", F.sha2(canonical(F.col("kind"), F.col("base_type"), F.col("attrs"), F.col("methods"), F.col("subscripts")), 256))


def supersets(shapes: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst): src has all that dst has, per facet, and more; both untyped; dst has ``least`` items.

    An inverted index finds candidates: dst is looked up by its rarest item only, so an item that nearly every shape has is
    joined on only for shapes that have nothing rarer; each candidate is then checked on all facets.
    """
    items = F.concat(*[_marked(f) for f in FACETS])
    some = shapes.where((F.col("kind") == "structural") & (F.coalesce("base_type", F.lit("")) == "")).select("id", items.alias("items"))
    posted = some.select("id", F.explode("items").alias("item"))
    rarity = posted.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rarest = posted.join(rarity, "item").groupBy("id").agg(F.min(F.struct("n", "item")).alias("_r"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    small = rarest.select(F.col("id").alias("dst"), F.col("_r.item").alias("item"), F.col("size").alias("dst_size")).join(some.select(F.col("id").alias("dst"), F.col("items").alias("dst_items")), "dst")
    found = small.join(posted.withColumnRenamed("id", "src"), "item").where("src <> dst").join(some.select(F.col("id").alias("src"), F.col("items").alias("src_items")), "src")
    return found.where((F.size("src_items") > F.col("dst_size")) & (F.size(F.array_except("dst_items", "src_items")) == 0)).select("src", "dst")


def facet_sides(shapes: DataFrame) -> DataFrame:
    """(id, side): untyped structural shapes with data only and those with methods only, whose every pair is a facet cluster."""
    some = shapes.where((F.col("kind") == "structural") & (F.coalesce("base_type", F.lit("")) == ""))
    data, methods = F.size(_facet("attrs")) + F.size(_facet("subscripts")) > 0, F.size(_facet("methods")) > 0
    return some.where(data != methods).select("id", F.when(data, "data").otherwise("methods").alias("side"))


def facet_clusters(shapes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Untyped shapes with data only, and those with methods only, linked both ways.

    The pairs are quadratic by definition, so they are made for the shapes ``of`` (column id) that a question is about;
    ``facet_sides`` says the same of all shapes in a row each.
    """
    sides = facet_sides(shapes)
    asked = sides.join(of.select("id").distinct(), "id", "left_semi") if of is not None else sides
    other = F.when(F.col("side") == "data", "methods").otherwise("data")
    one_way = asked.select(F.col("id").alias("src"), other.alias("side")).join(sides.withColumnRenamed("id", "dst"), "side").select("src", "dst")
    both = one_way if of is None else one_way.union(one_way.select("dst", "src")).distinct()
    return both.withColumn("strength", F.lit("facet_cluster"))


def hint_links(shapes: DataFrame) -> DataFrame:
    """Hints and structural shapes with the same normalised base, both ways, unless it is a container."""
    base = normal_base(F.col("base_type"))
    some = shapes.where(F.coalesce("base_type", F.lit("")) != "").withColumn("_b", base).where(~F.col("_b").isin(*CONTAINERS))
    h = some.where("kind = 'hint'").select(F.col("id").alias("h"), "_b")
    s = some.where("kind = 'structural'").select(F.col("id").alias("s"), "_b")
    pairs = h.join(s, "_b")
    return pairs.select(F.col("h").alias("src"), F.col("s").alias("dst")).unionByName(pairs.select(F.col("s").alias("src"), F.col("h").alias("dst")))


def generalizations(shapes: DataFrame) -> DataFrame:
    """A generic hint to its bare hint; bare names are compared in lower case, the last of equal ones counts."""
    hints = shapes.where("kind = 'hint'").select("id", F.col("base_type").alias("t"))
    bare = hints.where(~F.col("t").contains("[")).groupBy(F.lower("t").alias("k")).agg(F.max("id").alias("dst"))
    generic = hints.where(F.col("t").contains("[")).select(F.col("id").alias("src"), F.lower(F.trim(F.substring_index("t", "[", 1))).alias("k"))
    return generic.join(bare, "k").select("src", "dst", F.lit("generalization").alias("strength"))


def links(variables: DataFrame, shaped: DataFrame, nodes: DataFrame) -> DataFrame:
    """HAS_SHAPE of every shaped variable, and ACCEPTS of the node that the variable's name begins with."""
    has = shaped.select(F.lit("HAS_SHAPE").alias("type"), F.col("variable_id").alias("src"), F.col("shape_id").alias("dst"), F.lit(None).cast("string").alias("param_name"))
    named = shaped.join(variables.select(F.col("id").alias("variable_id"), "name"), "variable_id")
    owner = F.regexp_replace("name", r"\.[^.]*$", "")
    accepts = named.where("NOT dual").withColumn("_o", owner).join(nodes.select(F.col("id").alias("node_id"), F.col("name").alias("_o")), "_o")
    return has.unionByName(accepts.select(F.lit("ACCEPTS").alias("type"), F.col("node_id").alias("src"), F.col("shape_id").alias("dst"), F.substring_index("name", ".", -1).alias("param_name"))).distinct()


def search(shapes: DataFrame, attrs: Sequence[str] = (), subscripts: Sequence[str] = (), methods: Sequence[str] = ()) -> DataFrame:
    """Shapes that have all of the named items; the filter comes before any limit."""
    found = shapes
    for name, wanted in zip(FACETS, (attrs, subscripts, methods), strict=True):
        for item in wanted:
            found = found.where(F.array_contains(_facet(name), item))
    return found


def shape_closure(shape_ids: DataFrame, compatible: DataFrame) -> DataFrame:
    """A shape and those it is compatible with, one step on: (root, shape, confidence)."""
    own = shape_ids.select(F.col("id").alias("root"), F.col("id").alias("shape"), F.lit("exact").alias("confidence"))
    step = compatible.select(F.col("src").alias("root"), F.col("dst").alias("shape"), F.when(F.col("strength").isNull(), "structural").otherwise("weak").alias("confidence"))
    return own.unionByName(step.join(shape_ids.select(F.col("id").alias("root")).distinct(), "root", "left_semi"))


def consumers(variable_shapes: DataFrame, compatible: DataFrame, accepts: DataFrame) -> DataFrame:
    """(variable, consumer, confidence): nodes that accept a variable's shape or a compatible one, the best match of each."""
    roots = variable_shapes.select("variable", F.col("shape").alias("root"))
    reach = shape_closure(roots.select(F.col("root").alias("id")).distinct(), compatible)
    found = roots.join(reach, "root").join(accepts.select(F.col("src").alias("consumer"), F.col("dst").alias("shape")), "shape")
    rank = F.when(F.col("confidence") == "exact", 3).when(F.col("confidence") == "structural", 2).otherwise(1)
    return found.groupBy("variable", "consumer").agg(F.max(rank).alias("_r")).select("variable", "consumer", F.element_at(F.array(F.lit("weak"), F.lit("structural"), F.lit("exact")), F.col("_r")).alias("confidence"))


def producers(node_shapes: DataFrame, compatible: DataFrame, produces: DataFrame) -> DataFrame:
    """(node, producer): nodes that produce a shape which is, or is compatible with, one that the node accepts."""
    back = compatible.select(F.col("dst").alias("shape"), F.col("src").alias("made")).unionByName(node_shapes.select("shape", F.col("shape").alias("made")))
    found = node_shapes.select("node", "shape").join(back, "shape").join(produces.select(F.col("src").alias("producer"), F.col("dst").alias("made")), "made")
    return found.select("node", "producer").distinct()


def connections(shapes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each shape with the sorted sources of its HAS_SHAPE, ACCEPTS and PRODUCES edges and its compatible shapes.

    One aggregation over the edges; no chain of optional matches that multiplies rows.
    """
    pick = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("src"))))
    into = edges.where(F.col("type").isin("HAS_SHAPE", "ACCEPTS", "PRODUCES")).groupBy("dst").agg(pick("HAS_SHAPE").alias("variables"), pick("ACCEPTS").alias("consumers"), pick("PRODUCES").alias("producers"))
    on = edges.where("type = 'COMPATIBLE_WITH'").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("compatible"))
    found = shapes.select("id").join(into.withColumnRenamed("dst", "id"), "id", "left").join(on.withColumnRenamed("src", "id"), "id", "left")
    return found.select("id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("variables", "consumers", "producers", "compatible")])
