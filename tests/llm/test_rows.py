"""Rows that repeat, clash, or are very long, in the training-text operators."""

import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language, packing, periodic, quality, topk
from weftgraph.llm.common import fresh_names
from weftgraph.llm.queries import WORD_VOCABULARY, vocabulary

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_id_of_many_rows_is_a_bounded_sample(spark):
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = spark.range(100_000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("text of the hot id "), F.chr(F.col("id") % 26 + 97)).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ein anderer "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    found = language.learning_sample(rows.unionByName(others), sample=50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found} == {"de": 50, "en": 50}
    model = language.fit(rows.unionByName(others), sample=50)
    assert model.languages == ["de", "en"]


def test_every_language_can_be_predicted(spark):
    """More languages than any bound: each has its alphabet."""
    names = [f"l{k}" for k in range(300)]
    rows = [(i, "".join(chr(0x4E00 + 40 * k + j) for j in range(i % 5, 30)), names[k]) for k in range(300) for i in range(k * 20, k * 20 + 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=4)
    got = language.predict(docs, model).where("lang = lang_pred").count()
    assert len(model.languages) == 300 and got > 0.95 * len(rows)


def test_packing_twice_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    runs = [sorted(tuple(r) for r in packing.pack_documents(d, vocabulary(WORD_VOCABULARY)).collect()) for d in (docs, docs.orderBy(F.rand(3)))]
    assert runs[0] == runs[1]


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for c in ("_counts", "_row", "_score", "_good", "_lang", "_name", "component", "first", "key", "words", "digest", "score", "SEQUENCE_ID"):
        docs = docs.withColumn(c, F.lit(c))
    assert fresh_names(docs, "_Row", "_row", "new") == ["_Row_", "_row__", "new"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where("_row = '_row' AND _counts = '_counts' AND _score = '_score' AND _lang = '_lang'").count() == out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 40


def test_very_long_texts(spark):
    """Forty texts of 20 MB go through the workers one at a time."""
    docs = spark.range(40, numPartitions=2).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" again and ")), 1_000_000).alias("text"))
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert language.predict(docs.limit(4), model).count() == 4
    pieces = packing.token_pieces(docs.limit(3), vocabulary(WORD_VOCABULARY))
    assert pieces.groupBy("doc_id").agg(F.sum("length")).count() == 3
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality.score(docs.limit(3), rules).select("score").count() == 3
    # the batches that a worker gets are bounded by bytes
    rows = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in batches), "n long")
    assert max(r["n"] for r in rows.collect()) <= 4
    assert [r["n_runs"] for r in periodic.describe(spark.createDataFrame([(1, "a b " * 500_000)], "doc_id long, text string")).collect()] == [1]


def test_repeated_vector_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (2, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 4.0]), (4, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v.where("vec_id = 50"), v, 3).orderBy("rank").collect()]
    assert got == [(50, 1, 3, 4), (50, 2, 2, 3), (50, 3, 2, 2)]


@pytest.mark.parametrize("rows", [0, 1])
def test_small_tables_of_languages(spark, rows):
    docs = spark.createDataFrame([(1, "text", None)][:rows], "doc_id long, text string, lang string")
    assert language.fit(docs) is None and language.predict(docs, None).count() == rows
