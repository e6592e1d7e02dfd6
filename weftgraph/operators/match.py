"""Pattern matching: fixed-length patterns as joins on ids.

Edges have type, src and dst; nodes have id.  All operators are lazy compositions of joins, so filters and column
pruning reach the scans and the optimizer picks each join's strategy from sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_VIEW = ("id", "name", "kind", "module_path")


def aliased(nodes: DataFrame, prefix: str, columns: Sequence[str] = NODE_VIEW) -> DataFrame:
    """Node columns named ``prefix_column``."""
    return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def out_edges(edges: DataFrame, ids: DataFrame | str, types: Sequence[str] = ()) -> DataFrame:
    """Edges that leave a node, or any node of a table with a column id."""
    return _touching(edges, "src", ids, types)


def in_edges(edges: DataFrame, ids: DataFrame | str, types: Sequence[str] = ()) -> DataFrame:
    """Edges that reach a node, or any node of a table with a column id."""
    return _touching(edges, "dst", ids, types)


def both_edges(edges: DataFrame, ids: DataFrame | str, types: Sequence[str] = ()) -> DataFrame:
    """Outgoing and incoming edges with a direction; a self-loop appears in each."""
    return out_edges(edges, ids, types).withColumn("direction", F.lit("out")).unionByName(in_edges(edges, ids, types).withColumn("direction", F.lit("in")))


def _touching(edges: DataFrame, end: str, ids: DataFrame | str, types: Sequence[str]) -> DataFrame:
    found = edges.where(F.col("type").isin(*types)) if types else edges
    if isinstance(ids, str):
        return found.where(F.col(end) == ids)
    return found.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def triples(edges: DataFrame, left: DataFrame, right: DataFrame, left_columns: Sequence[str] = NODE_VIEW, right_columns: Sequence[str] = NODE_VIEW) -> DataFrame:
    """Node, edge, node; an edge without both ends in the tables gives no row."""
    return edges.join(aliased(left, "src", left_columns), F.col("src") == F.col("src_id")).join(aliased(right, "dst", right_columns), F.col("dst") == F.col("dst_id")).drop("src_id", "dst_id")


def with_role(edges: DataFrame, variables: DataFrame, types: Sequence[str] = ("ASSIGNS", "MUTATES", "READS", "RETURNS")) -> DataFrame:
    """Each use of a variable by a node, with its role."""
    v = variables.select(F.col("id").alias("dst"), F.col("name").alias("variable"), "scope")
    return edges.where(F.col("type").isin(*types)).join(v, "dst").select(F.col("src").alias("node_id"), F.col("dst").alias("variable_id"), "variable", "scope", F.col("type").alias("role"), "line", "seq")


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both in a set of ids."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shared_variable(edges: DataFrame, writes: Sequence[str] = ("MUTATES",), reads: Sequence[str] = ("READS",)) -> DataFrame:
    """Pairs of different nodes of which one writes a variable that the other reads."""
    w = edges.where(F.col("type").isin(*writes)).select(F.col("src").alias("writer"), F.col("dst").alias("variable"))
    r = edges.where(F.col("type").isin(*reads)).select(F.col("src").alias("reader"), F.col("dst").alias("variable"))
    return w.join(r, "variable").where("writer <> reader").distinct()


def impact(edges: DataFrame, nodes: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """H5: what a change of a node affects: (node, affected, reason): other active nodes that read a variable it mutates, and its callers.

    The changed nodes are chosen before they meet their readers, so a question about some nodes makes no other pairs.
    """
    start = node_ids.select("id").distinct() if node_ids is not None else None
    active = nodes.where("status = 'active'").select(F.col("id").alias("src"))
    writes, reads, calls = (edges.where(F.col("type") == t).select("type", "src", "dst") for t in ("MUTATES", "READS", "CALLS"))
    if start is not None:
        writes = writes.join(start.withColumnRenamed("id", "src"), "src", "left_semi")
        calls = calls.join(start.withColumnRenamed("id", "dst"), "dst", "left_semi")
    through = shared_variable(writes.unionByName(reads.join(active, "src", "left_semi")))
    found = through.select(F.col("writer").alias("node"), F.col("reader").alias("affected"), F.concat(F.lit("reads "), "variable").alias("reason"))
    callers = calls.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("affected"), F.lit("calls it").alias("reason"))
    return found.unionByName(callers.distinct())


def arguments(calls: DataFrame, passes: DataFrame, nodes: DataFrame, variables: DataFrame) -> DataFrame:
    """Calls with the values passed: the argument's scope is the caller's name, the parameter's the callee's."""
    c = triples(calls, nodes, nodes, ("id", "name"), ("id", "name"))
    v = variables.select("id", "name", "scope")
    p = passes.join(aliased(v, "arg", ("id", "name", "scope")), F.col("src") == F.col("arg_id")).join(aliased(v, "param", ("id", "name", "scope")), F.col("dst") == F.col("param_id"))
    p = p.select("arg_name", "arg_scope", "param_name", "param_scope")
    return c.join(p, (F.col("arg_scope") == F.col("src_name")) & (F.col("param_scope") == F.col("dst_name"))).select("src", "dst", "arg_name", "param_name")


def between_lines(calls: DataFrame, ranges: DataFrame, bin_size: int = 64) -> DataFrame:
    """Calls (owner, line, ...) with the ranges (owner, start_line, end_line, ...) that hold their line.

    A range join by bins: both sides get equi-join keys (owner, bin), so no nested loop over an owner's rows is needed.
    """
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_line") / bin_size), F.floor(F.greatest("start_line", "end_line") / bin_size))))
    c = calls.withColumn("_bin", F.floor(F.col("line") / bin_size))
    return c.join(r, ["owner", "_bin"]).where("line BETWEEN start_line AND end_line").drop("_bin")


def optional(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """OPTIONAL MATCH; filter the right side before, or unmatched rows are lost."""
    return left.join(right, on, "left")


def class_and_init(methods: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each method's class, and that class's constructor if it has one."""
    member = edges.where("type = 'MEMBER_OF'").select("src", "dst")
    owner = methods.select(F.col("id").alias("method")).join(member, F.col("method") == F.col("src")).select("method", F.col("dst").alias("class_id"))
    init = member.join(nodes.where(F.col("name").endswith(".__init__")).select(F.col("id").alias("src"), F.col("name").alias("init")), "src").select(F.col("dst").alias("class_id"), F.col("src").alias("init_id"), "init")
    return owner.join(init, "class_id", "left").join(nodes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name")), "class_id", "left")


def calls_both(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes that call both a and b, in one pass over the calls."""
    flags = edges.where((F.col("type") == "CALLS") & F.col("dst").isin(a, b)).groupBy("src").agg(F.max(F.col("dst") == a).alias("_a"), F.max(F.col("dst") == b).alias("_b"))
    return flags.where("_a AND _b").select("src")


def having(nodes: DataFrame, edges: DataFrame, end: str = "src", types: Sequence[str] = ("CALLS",)) -> DataFrame:
    """Nodes with an edge at that end."""
    return nodes.join(edges.where(F.col("type").isin(*types)).select(F.col(end).alias("id")), "id", "left_semi")


def lacking(nodes: DataFrame, edges: DataFrame, end: str = "src", types: Sequence[str] = ("CALLS",)) -> DataFrame:
    """Nodes without an edge at that end."""
    return nodes.join(edges.where(F.col("type").isin(*types)).select(F.col(end).alias("id")), "id", "left_anti")


def fork_join(left: DataFrame, right: DataFrame, on: str, out: str) -> DataFrame:
    """Two edges of one pattern that share an end, none used for both: (shared, left_end, right_end, left_type, right_type).

    ``on`` is the shared end (src or dst) and ``out`` the other one.  Edges are told apart by all their properties, so parallel
    edges of one type are two.
    """
    same = [c for c in left.columns if c in right.columns]
    a = left.select(F.col(on).alias("shared"), F.col(out).alias("left_end"), F.col("type").alias("left_type"), F.struct(*same).alias("_a"))
    b = right.select(F.col(on).alias("shared"), F.col(out).alias("right_end"), F.col("type").alias("right_type"), F.struct(*same).alias("_b"))
    return a.join(b, "shared").where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def subgraph_of(values: DataFrame, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices that a result names by id or name (column value), and the edges among them."""
    found = resolve(values, vertices)
    return found, within(edges, found)


def found_or_like(rows: DataFrame, column: str, text: str) -> DataFrame:
    """P20: rows whose column is a text; where there are none, those that have it as a part, whatever the case."""
    exact = rows.where(F.col(column) == text)
    return exact if not exact.isEmpty() else rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways."""
    pairs = edges.select("src", "dst").distinct()
    back = pairs.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.where("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def wedges(edges: DataFrame) -> DataFrame:
    """(u, x, y): edges u -> x and y -> u whose other ends have more edges than u (by number of edges, then id).

    A node of many edges is the lesser end of few of them, at most of the square root of twice their number, so m edges make at
    most about m^1.5 rows, however large a hub is.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    degrees = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = e.join(degrees.select(F.col("id").alias("src"), F.col("n").alias("m")), "src").join(degrees.select(F.col("id").alias("dst"), "n"), "dst")
    less = F.struct("m", "src") < F.struct("n", "dst")
    up, down = both.where(less).select(F.col("src").alias("u"), F.col("dst").alias("x")), both.where(~less).select(F.col("dst").alias("u"), F.col("src").alias("y"))
    return up.join(down, "u").where("x <> y").select("u", "x", "y")


def three_cycles(edges: DataFrame, ordered: bool = False) -> DataFrame:
    """Cycles a -> b -> c -> a, each once by its smallest id; ``ordered`` finds only those with a < b < c.

    Each is found once, at its node of the fewest edges (``wedges``), and turned so that the smallest id comes first.
    """
    closing = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct()
    found = wedges(edges).join(closing, ["x", "y"], "left_semi")
    first = F.least("u", "x", "y")
    turned = F.when(F.col("u") == first, F.struct(F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c")))
    turned = turned.when(F.col("x") == first, F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("u").alias("c")))
    found = found.select(turned.otherwise(F.struct(F.col("y").alias("a"), F.col("u").alias("b"), F.col("x").alias("c"))).alias("t")).select("t.*")
    return found.where("b < c") if ordered else found


def lookup(keys: DataFrame, nodes: DataFrame, on: Sequence[str] = ("name", "module_path")) -> DataFrame:
    """Keys with the id of an active node, null where there is none."""
    return keys.join(nodes.where("status = 'active'").select(*on, "id"), list(on), "left")


def resolve(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose id or name is among scalar values (column value)."""
    values = candidates.select("value").distinct()
    by_id = nodes.join(values.withColumnRenamed("value", "id"), "id", "left_semi")
    by_name = nodes.join(values.withColumnRenamed("value", "name"), "name", "left_semi")
    return by_id.unionByName(by_name).dropDuplicates(["id"])


def usages(edges: DataFrame, node_id: str, direction: str = "both") -> DataFrame:
    """Edges of a node, and the edges among its users; one per (src, type, dst)."""
    own = {"in": in_edges, "out": out_edges}.get(direction, lambda e, i: out_edges(e, i).unionByName(in_edges(e, i)))(edges, node_id)
    users = own.select(F.col("src").alias("id")).union(own.select(F.col("dst").alias("id"))).where(F.col("id") != node_id)
    return own.select("src", "type", "dst").union(within(edges, users).select("src", "type", "dst")).distinct()


def function_detail(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """A function's edges with the other end, external if its module differs."""
    own = nodes.where(F.col("id") == node_id).select(F.col("module_path").alias("own_module"))
    other = both_edges(edges, node_id).withColumn("other", F.when(F.col("direction") == "out", F.col("dst")).otherwise(F.col("src")))
    seen = other.join(aliased(nodes, "other", ("id", "name", "module_path")), F.col("other") == F.col("other_id")).join(F.broadcast(own.limit(1)))
    return seen.select("direction", "type", "other", "other_name", (F.col("other_module_path") != F.col("own_module")).alias("external"))


def file_members(nodes: DataFrame, edges: DataFrame, module_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a module, and the INHERITS and CALLS edges among them."""
    members = nodes.where(F.col("module_path") == module_path)
    return members, within(edges.where(F.col("type").isin("INHERITS", "CALLS")), members)


def class_detail(nodes: DataFrame, edges: DataFrame, class_id: str) -> dict[str, DataFrame]:
    """A class's members, its bases (external where the node is unknown), and the calls among its members."""
    members = in_edges(edges, class_id, ["MEMBER_OF"]).select(F.col("src").alias("id")).join(nodes, "id")
    bases = out_edges(edges, class_id, ["INHERITS"]).select(F.col("dst").alias("id")).join(nodes.select("id", "name"), "id", "left").withColumn("external", F.col("name").isNull())
    return {"members": members, "bases": bases, "calls": within(edges.where("type = 'CALLS'"), members)}


def class_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """J22 for all classes, a row for each thing: (class_id, part, src, dst, external).

    Parts are member (src is it), base (dst is it, external where no node has its id), and call between two members of one class.
    """
    member = edges.where("type = 'MEMBER_OF'").select(F.col("src").alias("id"), F.col("dst").alias("class_id")).join(nodes.select("id"), "id").distinct()
    none = F.lit(None).cast("boolean").alias("external")
    known = nodes.select(F.col("id").alias("dst"), F.lit(False).alias("external")).distinct()
    bases = edges.where("type = 'INHERITS'").select("src", "dst").distinct().join(known, "dst", "left")
    calls = edges.where("type = 'CALLS'").select("src", "dst").distinct().join(member.withColumnRenamed("id", "src"), "src").join(member.withColumnRenamed("id", "dst"), ["dst", "class_id"])
    members = member.select("class_id", F.lit("member").alias("part"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), none)
    bases = bases.select(F.col("src").alias("class_id"), F.lit("base").alias("part"), "src", "dst", F.coalesce("external", F.lit(True)).alias("external"))
    return members.unionByName(bases).unionByName(calls.select("class_id", F.lit("call").alias("part"), "src", "dst", none))


def members_like(nodes: DataFrame, edges: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """Members of classes whose name has a part, in order of name."""
    owners = nodes.where(F.col("name").contains(part)).select(F.col("id").alias("dst"), F.col("name").alias("class_name"))
    found = edges.where("type = 'MEMBER_OF'").join(owners, "dst").join(nodes.select(F.col("id").alias("src"), "name", "kind"), "src")
    return found.select("class_name", F.col("src").alias("id"), "name", "kind").orderBy("name", "id", "class_name").limit(limit)


def feeds_by_line(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Values read on the line where another is written, within a function: FEEDS edges (src, dst, function, line)."""
    r = reads.select("function", "line", F.col("variable").alias("src"))
    w = writes.select("function", "line", F.col("variable").alias("dst"))
    return r.join(w, ["function", "line"]).where("src <> dst").distinct()


def passes_by_place(calls: DataFrame, params: DataFrame) -> DataFrame:
    """Arguments (call_id, callee, position, keyword, arg) with the callee's parameters (callee, position, param)."""
    keyword = calls.where("keyword IS NOT NULL").join(params.select("callee", "param", F.col("param").alias("keyword")), ["callee", "keyword"])
    place = calls.where("keyword IS NULL").join(params, ["callee", "position"])
    columns = ["call_id", "callee", "arg", "param"]
    return place.select(*columns).union(keyword.select(*columns))


def resolve_names(calls: DataFrame, *scopes: DataFrame) -> DataFrame:
    """Callee texts (file, callee) resolved by the first scope table (file, callee, qualified) that knows them."""
    found, names = calls, []
    for i, scope in enumerate(scopes):
        found = found.join(scope.select("file", "callee", F.col("qualified").alias(f"_q{i}")), ["file", "callee"], "left")
        names.append(F.col(f"_q{i}"))
    return found.withColumn("qualified", F.coalesce(*names, F.col("callee"))).drop(*[f"_q{i}" for i in range(len(scopes))])
