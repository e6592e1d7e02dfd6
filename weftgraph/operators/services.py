"""Composed query services: timelines, impact, packs, gaps, search, completion, retrieval contexts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import aggregate, match, shapes, traverse
from weftgraph.storage import Buckets

#: Fixed values, which results depend on: parts of a name that make a call risky, and words that carry no meaning in a question.
RISKY = ("read", "write", "connect", "query", "fetch", "send", "open", "execute")
STOP_WORDS = (
    "what", "does", "how", "when", "where", "which", "who", "why",
    "is", "are", "do", "the", "a", "an", "of", "in", "to", "for",
    "on", "with", "from", "by", "it", "this", "that", "if", "can",
    "return", "returns", "give", "show", "find", "get", "list",
    "call", "run", "execute", "output", "result", "value", "all",
    "me", "about", "between", "through", "into", "using",
)


@dataclass(frozen=True)
class Pack:
    """A result subgraph: nodes, edges, and a source text per node id."""

    nodes: DataFrame
    edges: DataFrame
    snippets: DataFrame


# --- variables


def variable_search(variables: DataFrame, text: str, scope: str | None = None, limit: int = 50) -> DataFrame:
    """H4: variables whose name has a text (and whose scope has another), in order of name."""
    found = variables.where(F.col("name").contains(text))
    found = found.where(F.col("scope").contains(scope)) if scope else found
    return found.orderBy("name", "id").limit(limit)


def variable_timeline(graph: CodeGraph, variable_ids: DataFrame) -> DataFrame:
    """H1: each interaction of the variables once, in order of (function, seq), and whether it is the terminal one."""
    uses = aggregate.timeline(graph.edges).join(variable_ids.select(F.col("id").alias("variable")).distinct(), "variable", "left_semi")
    last = aggregate.terminals(uses).select("variable", F.struct("other", "seq", "type").alias("_last"))
    return uses.join(last, "variable", "left").withColumn("terminal", F.struct("other", "seq", "type").eqNullSafe(F.col("_last"))).drop("_last")


def traced(graph: CodeGraph, text: str, scope: str | None = None) -> DataFrame:
    """H3: the timelines of at most 50 variables that match."""
    return variable_timeline(graph, variable_search(graph.variables, text, scope))


def passed_timeline(edges: DataFrame, variable_ids: DataFrame) -> DataFrame:
    """H2: interactions of the variables and of all that they are passed to, to the fix-point."""
    family = traverse.closure(edges.where("type = 'PASSES_TO'"), variable_ids, include_roots=True)
    return family.select("root", F.col("node").alias("variable")).join(aggregate.timeline(edges), "variable")


# --- nodes


def node_search(nodes: DataFrame, text: str = "", kind: str = "", tag: str = "", module_path: str = "") -> DataFrame:
    """H6: nodes by a part of name or intent, kind, tag, module; an empty criterion is no filter."""
    found = nodes
    if text:
        found = found.where(F.col("name").contains(text) | F.col("semantic_intent").contains(text))
    if kind:
        found = found.where(F.col("kind") == kind)
    if tag:
        found = found.where(F.array_contains("tags", tag))
    if module_path:
        found = found.where(F.col("module_path") == module_path)
    return found


def by_signature(nodes: DataFrame, *, param_type: str | None = None, param_name: str | None = None, return_type: str | None = None, exact: bool = True) -> DataFrame:
    """H8: nodes by parameters or return type, exactly or by substring."""
    same = (lambda c, v: c == v) if exact else (lambda c, v: c.contains(v))
    found = nodes
    if param_type is not None:
        found = found.where(F.exists("params", lambda p: same(p["type_hint"], param_type)))
    if param_name is not None:
        found = found.where(F.exists("params", lambda p: same(p["name"], param_name)))
    if return_type is not None:
        found = found.where(same(F.col("return_type"), return_type))
    return found


def modules(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct modules, by prefix."""
    return nodes.where(F.col("module_path").startswith(prefix)).select("module_path").distinct()


def definition(nodes: DataFrame, symbol: str) -> DataFrame:
    """Functions and classes whose name ends in the symbol; where there are none, those of exactly that name."""
    some = nodes.where(F.col("kind").isin("function", "method", "class"))
    suffix = some.where(F.col("name").endswith("." + symbol)).withColumn("_o", F.lit(0))
    both = suffix.unionByName(some.where(F.col("name") == symbol).withColumn("_o", F.lit(1)))
    first = both.agg(F.min("_o").alias("_first"))
    return both.join(F.broadcast(first), F.col("_o") == F.col("_first")).drop("_o", "_first")  # one row


def data_flow(edges: DataFrame, variables: DataFrame) -> DataFrame:
    """H9: what each node assigns, reads, and returns, as sorted arrays of names."""
    uses = match.with_role(edges, variables)
    pick = lambda t: F.array_sort(F.collect_set(F.when(F.col("role") == t, F.col("variable"))))
    return uses.groupBy("node_id").agg(pick("ASSIGNS").alias("assigns"), pick("READS").alias("reads"), pick("RETURNS").alias("returns"))


def snippet(name: Column, params: Column) -> Column:
    """A call with numbered places, without self and cls."""
    shown = F.filter(F.transform(params, lambda p: p["name"]), lambda n: ~n.isin("self", "cls"))
    places = F.transform(shown, lambda n, i: F.concat(F.lit("${"), (i + 1).cast("string"), F.lit(":"), n, F.lit("}")))
    return F.concat(F.substring_index(name, ".", -1), F.lit("("), F.array_join(places, ", "), F.lit(")"))


def completions(graph: CodeGraph, mode: str, text: str, limit: int = 50) -> DataFrame:
    """H7: completion items (label, kind, insert_text, sort_key) of a mode: variable_consumer, member_access, import, general."""
    n = graph.nodes.where("status = 'active'")
    if mode == "variable_consumer":
        named = graph.variables.where((F.col("name") == text) | F.col("name").endswith("." + text)).select(F.col("id").alias("variable"))
        shaped = graph.typed("HAS_SHAPE").select(F.col("src").alias("variable"), F.col("dst").alias("shape")).join(named, "variable")
        found = shapes.consumers(shaped, graph.typed("COMPATIBLE_WITH").select("src", "dst", "strength"), graph.typed("ACCEPTS"))
        direct = n.join(found.select(F.col("consumer").alias("id")).distinct(), "id", "left_semi").withColumn("_s", F.lit("a_"))
        fallback = by_signature(n, param_name=text).join(direct.select("id"), "id", "left_anti").withColumn("_s", F.lit("b_"))
        items = direct.unionByName(fallback)
    elif mode == "member_access":
        items = match.members_like(n, graph.edges, text, limit).join(n.select("id", "params"), "id").withColumn("_s", F.lit("a_"))
    elif mode == "import":
        items = modules(n, text).select(F.col("module_path").alias("name"), F.lit("module").alias("kind"), F.lit(None).cast(n.schema["params"].dataType).alias("params"), F.lit("a_").alias("_s"))
    elif mode == "general":
        items = node_search(n, text).withColumn("_s", F.lit("a_"))
    else:
        raise ValueError(f"unknown completion mode {mode!r}")
    insert = F.when(F.col("params").isNull(), F.col("name")).otherwise(snippet(F.col("name"), F.col("params")))
    return items.select(F.col("name").alias("label"), "kind", insert.alias("insert_text"), F.concat("_s", "name").alias("sort_key")).orderBy("sort_key", "kind", "insert_text").limit(limit)


# --- packs


def pack(graph: CodeGraph, ids: DataFrame, types: Sequence[str]) -> Pack:
    """The subgraph of a set of ids."""
    nodes = graph.vertices.join(ids.select("id").distinct(), "id", "left_semi")
    sources = graph.nodes.where("source_text IS NOT NULL").select("id", "source_text") if "source_text" in graph.nodes.columns else graph.nodes.select("id", F.lit(None).cast("string").alias("source_text")).where("false")
    return Pack(nodes, match.within(graph.typed(*types), ids), sources.join(ids.select("id").distinct(), "id", "left_semi"))


def call_chain(graph: CodeGraph, text: str, hops: int = 2) -> Pack:
    """Nodes within some calls of those whose name has a text."""
    center = graph.active().where(F.col("name").contains(text)).select("id")
    ids = traverse.reach(graph.typed("CALLS"), center, hops, include_roots=True).select(F.col("node").alias("id"))
    return pack(graph, ids, ("CALLS",))


def class_hierarchy(graph: CodeGraph, text: str, depth: int = 5) -> Pack:
    """Bases of the classes whose name has a text, with all their members."""
    center = graph.active().where((F.col("kind") == "class") & F.col("name").contains(text)).select("id")
    classes = traverse.reach(graph.typed("INHERITS"), center, depth, include_roots=True).select(F.col("node").alias("id")).distinct()
    members = match.in_edges(graph.edges, classes, ("MEMBER_OF",)).select(F.col("src").alias("id"))
    return pack(graph, classes.union(members), ("INHERITS", "MEMBER_OF"))


def function_flow(graph: CodeGraph, function_id: str) -> Pack:
    """A function's statements and branches, with their order and the variables that it uses."""
    root = graph.vertices.where(F.col("id") == function_id).select("id")
    inside = traverse.reach(graph.typed("CONTAINS"), root, 8, include_roots=True).select(F.col("node").alias("id"))
    used = match.out_edges(graph.edges, function_id, ("ASSIGNS", "MUTATES", "READS", "RETURNS")).select(F.col("dst").alias("id"))
    return pack(graph, inside.union(used), ("CONTAINS", "NEXT", "ASSIGNS", "MUTATES", "READS", "RETURNS"))


def mutation_timeline(graph: CodeGraph, text: str) -> Pack:
    """Variables whose name has a text, with all that touches them."""
    found = graph.variables.where(F.col("name").contains(text)).select("id")
    touched = aggregate.timeline(graph.edges).join(found.withColumnRenamed("id", "variable"), "variable", "left_semi")
    return pack(graph, found.union(touched.select(F.col("other").alias("id"))), ("ASSIGNS", "MUTATES", "READS", "RETURNS", "PASSES_TO", "FEEDS"))


def impact_pack(graph: CodeGraph, node_id: str) -> Pack:
    """What a change of a node affects, with the node."""
    one = graph.nodes.where(F.col("id") == node_id).select("id")
    return pack(graph, one.union(match.impact(graph.edges, graph.nodes, one).select(F.col("affected").alias("id"))), ("CALLS", "MUTATES", "READS"))


def logic_pack(graph: CodeGraph, kind: str, key: str, **options: int) -> Pack:
    """A pack by its kind."""
    kinds = {"call_chain": call_chain, "class_hierarchy": class_hierarchy, "function_flow": function_flow, "mutation_timeline": mutation_timeline, "impact": impact_pack}
    if kind not in kinds:
        raise ValueError(f"unknown pack {kind!r}; known are {', '.join(kinds)}")
    return kinds[kind](graph, key, **options)


# --- gaps


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes, classes too, that call nothing and are no step of a flow, called or not."""
    active = nodes.where("status = 'active'")
    return match.lacking(active, edges, "src", ("CALLS", "STEP_OF"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes other than classes that nothing calls, depends on or is a member of."""
    return match.lacking(nodes.where("status = 'active' AND kind <> 'class'"), edges, "dst", ("CALLS", "DEPENDS_ON", "MEMBER_OF"))


def untested_mutations(edges: DataFrame) -> DataFrame:
    """(id, mutated_by): variables that are mutated but never read, with each node that mutates them."""
    written = edges.where("type = 'MUTATES'").select(F.col("dst").alias("id"), F.col("src").alias("mutated_by")).distinct()
    return written.join(edges.where("type = 'READS'").select(F.col("dst").alias("id")), "id", "left_anti")


def unhandled_risks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes whose source has no ``try:`` but that call nodes with risky names, with a name for each call, in order.

    Names are compared with their case; a node without a source is not judged.
    """
    risky = nodes.where(F.col("name").rlike("|".join(RISKY))).select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    callers = nodes.where("status = 'active' AND NOT contains(source_text, 'try:')").select(F.col("id").alias("src"), F.col("name").alias("caller"))
    found = edges.where("type = 'CALLS'").select("src", "dst").join(risky, "dst").join(callers, "src")
    return found.groupBy("src", "caller").agg(F.array_sort(F.collect_list("callee")).alias("risky_callees"))


def circular_dependencies(nodes: DataFrame, edges: DataFrame, ordered: bool = True) -> DataFrame:
    """(a, b, c): cycles of two (c is null) or three active nodes over CALLS and DEPENDS_ON.

    A cycle of three is found with a < b < c; without ``ordered`` also in its other orientation, with a the smallest.
    """
    among = match.within(edges.where(F.col("type").isin("CALLS", "DEPENDS_ON")), nodes.where("status = 'active'"))
    pairs = among.select("src", "dst").distinct()
    return match.two_cycles(pairs).withColumn("c", F.lit(None).cast("string")).unionByName(match.three_cycles(pairs, ordered))


def gap_report(graph: CodeGraph, scope: str = "") -> dict[str, DataFrame]:
    """Five analyses by name.

    ``scope`` is a part of the module path of the nodes that are reported; what they call or what calls them may lie
    anywhere.  Cycles and unread mutations are always of the whole graph.
    """
    n = graph.nodes
    told = n.where(F.col("module_path").contains(scope)) if scope else n
    risks = unhandled_risks(n, graph.edges)
    return {
        "dead_ends": dead_ends(told, graph.edges),
        "orphans": orphans(told, graph.edges),
        "missing_error_handling": risks.join(told.select(F.col("id").alias("src")), "src", "left_semi") if scope else risks,
        "circular_dependencies": circular_dependencies(n, graph.edges),
        "untested_mutations": untested_mutations(graph.edges),
    }


# --- overview, retrieval


def overview(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Four columns of active nodes of some kinds, and the edges among them."""
    some = nodes.where((F.col("status") == "active") & F.col("kind").isin(*kinds)).select("id", "name", "kind", "module_path")
    return some.orderBy("name", "id"), match.within(edges, some).select("type", "src", "dst")


def keywords(question: str) -> list[str]:
    """Words of a question that may name something: lower-cased, without outer marks, longer than two letters, no stop words."""
    words = (w.strip("?.,!'\"()") for w in question.lower().split())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOP_WORDS))


def focal_nodes(nodes: DataFrame, question: str, limit: int = 5) -> DataFrame:
    """At most ``limit`` active nodes whose name has a keyword (with its case), taken by keyword, then by name."""
    words = keywords(question)
    table = nodes.sparkSession.createDataFrame(list(enumerate(words)), "place int, word string")
    hits = nodes.where("status = 'active'").join(F.broadcast(table), F.contains("name", F.col("word")))  # a question's words
    ranked = aggregate.top_per_key(hits, "word", limit, "name", "id")
    return aggregate.first_seen(ranked, ["id"], "place", "rank").orderBy("place", "rank").limit(limit)


def neighbourhood(graph: CodeGraph, focal: DataFrame, hops: int = 1, edge_limit: int = 30) -> Pack:
    """Around focal nodes: callees within some hops, callers, used variables; a bounded number of edges in order."""
    callees = traverse.reach(graph.typed("CALLS"), focal, hops, include_roots=True).select(F.col("node").alias("id"))
    callers = match.in_edges(graph.edges, focal, ("CALLS",)).select(F.col("src").alias("id"))
    used = match.out_edges(graph.edges, focal, ("ASSIGNS", "MUTATES", "READS", "RETURNS")).select(F.col("dst").alias("id"))
    found = pack(graph, callees.union(callers).union(used), ())
    return Pack(found.nodes, found.edges.orderBy("type", "src", "dst").limit(edge_limit), found.snippets)


def chunks(files: DataFrame, size: int = 60, overlap: int = 10) -> DataFrame:
    """Overlapping line chunks of files (path, content): id, path, start_line, end_line, content; blank ones go."""
    step = size - overlap
    lines = F.split("content", "\n", -1)
    count = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(step))
    # a chunk that ends the file is the last
    useful = F.filter(starts, lambda s: (s == 0) | (s - step + size < count))
    # a chunk's text is cut before rows are made, so that no row carries its whole file
    chunk = F.transform(useful, lambda s: F.struct((s + 1).alias("start_line"), F.least(s + size, count).alias("end_line"), F.array_join(F.slice(lines, s + 1, size), "\n").alias("content")))
    told = F.filter(chunk, lambda c: F.rlike(c["content"], F.lit(r"\S")))
    rows = files.select("path", F.explode(told).alias("c"))
    return rows.select(F.md5(F.concat_ws(":", "path", (F.col("c.start_line") - 1).cast("string"))).alias("id"), "path", "c.start_line", "c.end_line", "c.content")


def keyword_search(rows: DataFrame, question: str, k: int, text: str = "content", order: Sequence[str] = ("path", "start_line")) -> DataFrame:
    """O5 without an index, for texts that are searched once: the k texts that share most words with a question, as a share of
    the question's words; ties in given order.  ``search`` answers many questions from an index."""
    asked = sorted(set(re.findall(r"\w+", question.lower())))
    lowered, hits = F.lower(text), F.lit(0)
    for w in asked:  # a question has few words, so a search for each beats taking every text apart
        hits += F.when(F.rlike(lowered, F.lit(rf"(?U)(?<!\w){w}(?!\w)")), 1).otherwise(0)
    score = hits / F.lit(float(max(1, len(asked))))
    return rows.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), *order).limit(k)


def contexts(graph: CodeGraph, chunk_words: Buckets, question: str, *, focal: int = 3, hops: int = 2, k: int = 5) -> DataFrame:
    """What is retrieved for a question: (source, place, focus, id, score).

    ``graph`` rows are what lies around each of the first focal nodes (the node itself, callees within some hops, callers and
    used variables); ``file`` rows are the chunks with the highest scores, from an index of the words of chunks (path, start_line).
    """
    from weftgraph.operators import search

    first = focal_nodes(graph.nodes, question, 5).select("id", "place", "rank")
    place = F.row_number().over(Window.orderBy("place", "rank"))  # of five nodes at most
    first = first.select("id", place.alias("at")).where(F.col("at") <= focal)
    callees = traverse.reach(graph.typed("CALLS"), first, hops, include_roots=True).select("root", F.col("node").alias("id"))
    names = first.select(F.col("id").alias("root"))
    callers = graph.typed("CALLS").join(names, F.col("dst") == F.col("root")).select("root", F.col("src").alias("id"))
    used = graph.edges.where(F.col("type").isin("ASSIGNS", "MUTATES", "READS", "RETURNS")).join(names, F.col("src") == F.col("root")).select("root", F.col("dst").alias("id"))
    around = callees.union(callers).union(used).distinct().join(first.select(F.col("id").alias("root"), "at"), "root")
    nodes = around.select(F.lit("graph").alias("source"), F.col("at").alias("place"), F.col("root").alias("focus"), "id", F.lit(None).cast("double").alias("score"))
    found = search.keyword_search(chunk_words, question, k, "path", "start_line")
    order = F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line"))  # of k chunks
    files = found.select(F.lit("file").alias("source"), order.alias("place"), F.col("path").alias("focus"), F.col("start_line").cast("string").alias("id"), "score")
    return nodes.unionByName(files)
