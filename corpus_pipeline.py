"""A training corpus from documents: quality, language, exact copies, near copies, packing.

Each stage takes all documents that its predecessor kept and returns the documents it keeps, with the columns of
``documents``; the last returns the packed pieces.  Models are learnt from the tables of ``sf_dir``.
The deduplicating stages decide on rows, not on ids: each keeps exactly one row of a group of copies.  Of exact copies
the row with the largest doc_id stays, of near copies the one with the smallest; rows without an id win only where no
row of the group has one, and a row key, written before the stage, decides among equal ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language, minhash, packing, quality
from weftgraph.llm.common import fresh_names, materialize, table
from weftgraph.llm.queries import WORD_VOCABULARY, vocabulary

#: Documents whose language scores less are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.35
#: Near copies share four fifths of their five-word shingles; with 40 bands of 5 values one in ten million is missed.
NEAR = {"words": 5, "percent": 80, "permutations": 100, "bands": 40}


def _keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and its column's name; written, so that every later read finds the same keys."""
    (row,) = fresh_names(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), label), row


def _staying(keyed: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is in ``kept``, without the key."""
    return keyed.join(kept.select(row), row, "left_semi").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least the threshold, each decided by its own text: null counts as empty, copies and null ids are
    judged like any others, texts of any length whole; without labels all stay; an empty table stays empty; columns may have
    any names."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score, good = fresh_names(docs, "_score", "_good")
    return quality.score(docs, model, out=score, flag=good).where(F.col(good) == 1).drop(score, good)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a letter whose language is told with at least ``LEAST_LANGUAGE_SCORE``: null and empty texts go, and all rows where
    no language could be learnt; copies and null ids are judged like any others; the stated ``lang`` is not looked at; columns
    may have any names."""
    model = language.fit(table(spark, sf_dir, "documents"))
    lang, score = fresh_names(docs, "_lang", "_score")
    scored = language.predict(docs, model, lang_out=lang, score_out=score)
    return scored.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null being equal to empty: that with the largest doc_id, a null one only where no other is, and one
    of several rows of that id; a text's other rows go whatever their ids; an empty table stays empty; columns may have any
    names."""
    keyed, row = _keyed(docs, "exact-rows")
    (name,) = fresh_names(keyed, "_name")
    named = keyed.select(F.struct("doc_id", row).alias(name), "text")  # a null id is less than any other
    return _staying(keyed, row, exact_dedup.dedup(named, id_col=name).where("kept").select(f"doc_id.{row}"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similar rows join: that with the smallest doc_id, a null one only where no other is, and
    one of several rows of that id; rows without words are linked with nothing and stay; an empty table stays empty; columns
    may have any names."""
    keyed, row = _keyed(docs, "near-rows")
    linked = minhash.link(keyed, id_col=row, **NEAR).select(F.col("doc_id").alias(row), F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = keyed.select(row, "doc_id").join(linked, row).groupBy("component").agg(F.min(order).alias("first"))
    return _staying(keyed, row, first.select(f"first.{row}"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences: null counts as empty, an empty text has one piece of one token,
    repeated and null ids keep all their pieces; an empty table gives no piece."""
    return packing.pack_documents(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the learnt stages; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
