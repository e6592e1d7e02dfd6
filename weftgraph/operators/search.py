"""Inverted indexes: words of texts with their scores, and trigrams of names for substrings.

An index is a table of postings (term, id, ...) that is bucketed and sorted by term: a question reads the buckets of its own
terms, and in them the row groups that can have them.  A posting says once that a text has a term, so what one question
reads follows how often its terms occur and not how much text there is.  Postings are cut and made distinct where texts are
read; a term that a third of all texts have is a long list in one bucket, which is read in splits and counted by id.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import Buckets

GRAM = 3


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text: letters, digits and underscores of any language."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), ""))


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, as they are."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.array_distinct(F.when(F.length(text) >= GRAM, F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def indexed(rows: DataFrame, terms: Column, *columns: str) -> Buckets:
    """An index of ``rows`` by their terms; postings carry ``columns``."""
    found = Buckets(rows.sparkSession, "postings", ("term",))
    spread = rows.select(*columns, F.explode(terms).alias("term"))
    found.append(spread.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term"))
    return found


def postings(index: Buckets, terms: Sequence[str]) -> DataFrame:
    return index.table().where(F.col("term").isin(*terms)) if terms else index.table().limit(0)


def keyword_scores(index: Buckets, question: str, *columns: str) -> DataFrame:
    """(columns, score): texts that have a word of the question, with the share of its distinct words that they have."""
    asked = sorted(set(re.findall(r"\w+", question.lower())))
    found = postings(index, asked).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return found.select(*columns, F.round(F.col("_n") / F.lit(float(max(1, len(asked)))), 6).alias("score"))


def keyword_search(index: Buckets, question: str, k: int, *columns: str) -> DataFrame:
    """The k texts with the highest scores; ties in the order of ``columns``."""
    return keyword_scores(index, question, *columns).orderBy(F.desc("score"), *columns).limit(k)


def containing(index: Buckets, text: str, column: str, *columns: str) -> DataFrame:
    """(columns) of the rows whose ``column``, one of them, contains a text, with its case.

    Rows that have all of the text's trigrams are candidates, and are then compared; a shorter text is looked for in every row
    that has a trigram at all, so rows of fewer than three characters are found by a scan of their table only.
    """
    if len(text) < GRAM:
        found = index.table().select(*columns).distinct()
    else:
        own = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        found = postings(index, own).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(own)).drop("_n")
    return found.where(F.contains(column, F.lit(text)))


def document_frequencies(index: Buckets) -> DataFrame:
    """(term, n): in how many texts each term is; the index's buckets are not shuffled."""
    return index.table().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
