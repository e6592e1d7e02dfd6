"""Scalar functions on names and texts as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels shown at the outer tiers of a zoomed view; the tier ``detail`` shows all.
ZOOM_LABELS = {"overview": ("Module",), "module": ("Module", "Class", "Function")}
#: Words of a query text that writes.
WRITE_WORDS = ("CREATE", "MERGE", "DELETE", "SET", "REMOVE", "DROP", "DETACH")


def zoom_tier(zoom: Column) -> Column:
    """the tier of a zoom level."""
    return F.when(zoom < 0.4, "overview").when(zoom > 1.2, "detail").otherwise("module")


def shown_at(label: Column, tier: Column) -> Column:
    """whether a vertex of a label is shown at a tier."""
    shown = F.lit(True)
    for name, labels in ZOOM_LABELS.items():
        shown = F.when(tier == name, F.coalesce(label, F.lit("")).isin(*labels)).otherwise(shown)
    return shown


# --- texts of queries


def reads_only(text: Column) -> Column:
    """Whether a query text has no word that writes, outside of quotes, names after a dot or colon, and longer words."""
    bare = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"|`[^`]*`", "''")
    return ~F.coalesce(bare, F.lit("")).rlike(r"(?i)(?<![\w.:])(?:" + "|".join(WRITE_WORDS) + r")(?!\w)")


def query_of(text: Column) -> Column:
    """A query in free text: of a fenced block if there is one, from a line that begins like a query to the next blank line; null without RETURN."""
    fenced = F.regexp_extract(text, r"(?is)```(?:cypher|sql)?[ \t]*\n(.*?)```", 1)
    body = F.when(F.rlike(text, F.lit(r"(?is)```(?:cypher|sql)?[ \t]*\n.*?```")), fenced).otherwise(text)
    found = F.regexp_extract(body, r"(?is)(?:^|\n)\s*((?:OPTIONAL\s+MATCH|MATCH|WITH|UNWIND|CALL)\b.*?)\s*(?:\n[ \t]*\n|$)", 1)
    query = F.regexp_replace(found, r";\s*$", "")
    return F.when(query.rlike(r"(?i)\bRETURN\b"), query)


def input_mode(text: Column) -> Column:
    """What a console line is: projection (vfs and a query), query, command or question."""
    line = F.trim(text)
    return F.when(line.rlike(r"(?i)^vfs\s"), "projection").when(line.rlike(r"(?i)^(?:OPTIONAL\s+MATCH|MATCH|WITH|UNWIND|CALL)\b"), "query").when(line.rlike(r"(?i)^(?:find|info|help|clear|callers|callees|impact)\b"), "command").otherwise("question")


def last_part(name: Column) -> Column:
    """After the last dot."""
    return F.substring_index(name, ".", -1)


def parent_part(name: Column) -> Column:
    """Before the last dot; the name itself without one."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def module_of(path: Column) -> Column:
    """Dotted module of a relative path."""
    return F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def access_of(name: Column) -> Column:
    """public, protected or private, by the last part's underscores."""
    n = last_part(name)
    dunder = n.startswith("__") & n.endswith("__")
    return F.when(n.startswith("__") & ~dunder, "private").when(n.startswith("_") & ~n.startswith("__"), "protected").otherwise("public")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^\w.-]+", "_")


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def indented(text: Column, spaces: int = 4) -> Column:
    """Every line that has anything, moved to the right."""
    return F.regexp_replace(text, r"(?m)^(?=.*\S)", " " * spaces)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def iso_time(text: Column) -> Column:
    """A timestamp from ISO 8601 with Z or an offset; null for an empty text."""
    return F.try_to_timestamp(F.when(F.trim(text) != "", F.regexp_replace(text, "Z$", "+00:00")))


def keyword_overlap(question: Column, text: Column) -> Column:
    """Share of a question's distinct words that a text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1))
    q = words(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


# --- scores of answers


def exact_score(answer: Column, gold: Column) -> Column:
    """1 if the answers are equal without outer space and case, else 0."""
    return F.when(F.lower(F.trim(answer)) == F.lower(F.trim(gold)), 1.0).otherwise(0.0)


def contains_score(answer: Column, parts: Column) -> Column:
    """Share of the expected parts (an array) that an answer has, whatever the case."""
    hit = F.size(F.filter(parts, lambda p: F.contains(F.lower(answer), F.lower(p))))
    return F.when(F.size(parts) > 0, hit / F.size(parts)).otherwise(F.lit(0.0))


def type_score(answer: Column, expected: Column) -> Column:
    """1 if an answer's text reads as the expected type: number, integer, boolean, list, object or string."""
    t = F.trim(answer)
    kind = (
        F.when(t.rlike(r"^[+-]?\d+$"), F.array(F.lit("integer"), F.lit("number")))
        .when(t.rlike(r"^[+-]?\d*\.?\d+([eE][+-]?\d+)?$"), F.array(F.lit("number")))
        .when(F.lower(t).isin("true", "false"), F.array(F.lit("boolean")))
        .when(t.rlike(r"(?s)^\[.*\]$"), F.array(F.lit("list")))
        .when(t.rlike(r"(?s)^\{.*\}$"), F.array(F.lit("object")))
        .otherwise(F.array(F.lit("string")))
    )
    return F.when(F.array_contains(kind, expected), 1.0).otherwise(0.0)


def efficiency(correctness: Column, tokens: Column, baseline_tokens: Column) -> Column:
    """Correctness times how many times fewer tokens than a baseline were used."""
    return correctness * baseline_tokens / F.greatest(tokens, F.lit(1))
