"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

A window is ``span`` consecutive words of an item, or a whole item that has fewer.  Words are hashed, ``gram``
consecutive word hashes make a k-gram hash, and of every window's k-grams the least hash is kept: its fingerprint.  A
window that a document shares with an item has the same fingerprint in both, whatever stands around it, so every shared
window is found (for an item of fewer words than ``span`` the same holds with windows of its length; lengths are few).

1. Documents get a row key and are written with their words.
2. Neighbouring windows with the same fingerprint are one row (key, fingerprint, first window, end); a semi join keeps those
   whose fingerprint an item has.  About two of seven windows make a row, and none is multiplied.
   With few fingerprints no text is shuffled: the words of a kept stretch go on with it; otherwise rows are joined with their words.
3. Only the windows of these rows are extended to their full text, which is joined with the distinct windows of all items: at
   most one partner a row, so neither a hot passage nor many items that share one make pairs.
4. Items with the same window are a class; a document has a set of classes, and items are listed once for each distinct set.

Joins are broadcast only where the counted item side is under ``BROADCAST_ROWS``; beyond it they are sort-merge joins, which
Spark splits where a passage is hot.

Defined cases: a null or wordless text has no words, hits nothing and is hit by nothing; a null item_id makes hits but is in no
list and counts as no item; rows of one item_id are one item; repeated doc_ids, null ones too, are judged row by row; empty
tables give no rows or no hits; texts of any length are taken whole; extra and clashing columns have no effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import lettered_words, materialize

SPAN = 10
GRAM = 5
#: Fingerprints (8 bytes each) and windows (some 70 bytes each) of items that are broadcast at most; 1 and 10 MB.
BROADCAST_ROWS = 131_072


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` names it within a function of array elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _least_of_windows(hashes: Column, span: int, gram: int) -> Column:
    """For each window of ``span`` words the least hash of its k-grams; there must be ``span`` words."""
    k = min(gram, span)
    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))
    width = span - k + 1  # k-grams of a window
    if width == 1:
        return grams
    return _let(grams, lambda g: F.transform(F.sequence(F.lit(1), F.size(hashes) - (span - 1)), lambda i: F.least(*[F.element_at(g, i + j) for j in range(width)])))


def _stretches(least: Column, span: int) -> Column:
    """(fingerprint, first, end, span) of each stretch of windows with one fingerprint; windows are numbered from 1."""
    n = F.size(least)
    changes = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(least, i) != F.element_at(least, F.greatest(i - 1, F.lit(1)))))
    return _let(
        changes,
        lambda firsts: F.transform(
            firsts,
            lambda i, at: F.struct(F.element_at(least, i).alias("fingerprint"), i.alias("first"), F.coalesce(F.try_element_at(firsts, at + 2), n + 1).alias("end"), F.lit(span).alias("span")),
        ),
    )


def winnowed(words: Column, spans: list[int], gram: int = GRAM, *, only: Column | None = None) -> Column:
    """Stretches of all windows of every length of ``spans``, or of the length ``only``."""
    none = F.array().cast("array<struct<fingerprint:bigint,first:int,end:int,span:int>>")

    def of(hashes: Column, span: int) -> Column:
        able = F.size(hashes) >= span
        found = _let(_least_of_windows(hashes, span, gram), lambda least: _stretches(least, span))
        return F.when(able if only is None else able & (only == span), found).otherwise(none)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.concat(*[of(hashes, span) for span in spans]))


def _windows(words: Column, first: Column, end: Column, span: Column, skipped: Column | int = 0) -> Column:
    """(start, text) of the windows from ``first`` to before ``end``; starts are numbered from 0, after ``skipped`` words."""
    return F.transform(F.sequence(first, end - 1), lambda i: F.struct((i - 1 + skipped).alias("start"), F.array_join(F.slice(words, i, span), " ").alias("window")))


def _few(df: DataFrame) -> bool:
    """Whether ``df``, which must be written, has few enough rows to be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows; ``df`` must be written."""
    return F.broadcast(df) if _few(df) else df


def _near(keyed: DataFrame, prints: DataFrame, spans: list[int], gram: int) -> DataFrame:
    """(key, span, first, end, skipped, words): stretches of documents whose fingerprint is in ``prints``.

    ``words`` holds all that the windows need, without the first ``skipped`` words of the text, and ``first`` and ``end`` count from there.
    """
    rows = keyed.select("key", "words", winnowed(F.col("words"), spans, gram).alias("stretches"))
    if _few(prints):  # words stay where they are, and only what lies in a stretch that is kept goes on
        near = rows.select("key", "words", F.inline("stretches")).join(F.broadcast(prints), "fingerprint", "left_semi")
        part = F.slice("words", F.col("first"), F.col("end") - F.col("first") + F.col("span") - 1)
        return near.select("key", "span", F.lit(1).alias("first"), (F.col("end") - F.col("first") + 1).alias("end"), (F.col("first") - 1).alias("skipped"), part.alias("words"))
    near = rows.select("key", F.inline("stretches")).join(prints, "fingerprint", "left_semi")
    near = near.groupBy("key").agg(F.collect_list(F.struct("first", "end", "span")).alias("stretches"))
    near = keyed.select("key", "words").join(near, "key").select("key", "words", F.explode("stretches").alias("s"))
    return near.select("key", "s.span", "s.first", "s.end", F.lit(0).alias("skipped"), "words")


def item_windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(item, words, span): items with words, and the length of their windows."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), lettered_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return rows.withColumn("span", F.least(F.size("words"), F.lit(span)))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings), hits.

    ``hits`` are the stretches (start, end) of hit words, in order and apart from each other.
    """
    words = materialize(item_windows(items, item_col=item_col, text_col=item_text, span=span), "decontamination-items")
    spans = sorted(r["span"] for r in words.select("span").distinct().collect())  # at most ``span`` lengths
    keyed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), lettered_words(F.col(text_col)).alias("words")).withColumn("key", F.monotonically_increasing_id()),
        "decontamination-documents",
    )
    every = keyed.select("key", "doc_id", F.size("words").cast("long").alias("n_words"))
    if not spans:
        return _result(every.withColumns({"hits": F.lit(None).cast("array<struct<start:int,end:int>>"), "items": F.lit(None).cast("array<string>")}))

    # items: their windows as classes of items, and their fingerprints
    texts = words.select("item", F.explode(_windows(F.col("words"), F.lit(1), F.size("words") - F.col("span") + 2, F.col("span"))).alias("w"))
    members = texts.select("item", F.col("w.window").alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    members = materialize(members.withColumn("class_id", F.sha2(F.to_json("items"), 256)), "decontamination-windows")
    prints = words.select(F.inline(winnowed(F.col("words"), spans, gram, only=F.col("span")))).select("fingerprint").distinct()
    prints = materialize(prints, "decontamination-fingerprints")

    # documents: stretches of windows that share a fingerprint with an item, extended to the windows' texts
    texts = _near(keyed, prints, spans, gram).select("key", "span", F.explode(_windows(*map(F.col, ("words", "first", "end", "span", "skipped")))).alias("w"))
    found = texts.select("key", "span", "w.start", "w.window").join(_small(members.select("window", "class_id")), "window")
    found = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("span")).alias("end")))).alias("spans"), F.array_sort(F.collect_set("class_id")).alias("classes"))
    found = materialize(found.select("key", _merged(F.col("spans")).alias("hits"), "classes", F.sha2(F.to_json("classes"), 256).alias("set_id")), "decontamination-hits")

    # each distinct set of classes is turned into its items once
    sets = found.select("set_id", "classes").dropDuplicates(["set_id"]).select("set_id", F.explode("classes").alias("class_id"))
    classes = members.select("class_id", "items").dropDuplicates(["class_id"])
    listed = sets.join(classes, "class_id").select("set_id", F.explode_outer("items").alias("item")).groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return _result(every.join(found.join(listed, "set_id").select("key", "hits", "items"), "key", "left"))


def _merged(spans: Column) -> Column:
    """Sorted (start, end) made one where they meet or overlap."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def grow(state: Column, x: Column) -> Column:
        apart = x["start"] > state["end"]
        return F.struct(
            F.when(apart, F.array_append(state["done"], F.struct(state["start"].alias("start"), state["end"].alias("end")))).otherwise(state["done"]).alias("done"),
            F.when(apart | state["start"].isNull(), x["start"]).otherwise(state["start"]).alias("start"),
            F.when(apart | state["start"].isNull(), x["end"]).otherwise(F.greatest(state["end"], x["end"])).alias("end"),
        )

    return F.aggregate(spans, start, grow, lambda s: F.array_append(s["done"], F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def _result(rows: DataFrame) -> DataFrame:
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>"))
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.size(hits) > 0).alias("contaminated"),
        listed.alias("items"), hits.alias("hits"),
    )
