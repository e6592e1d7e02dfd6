"""Inverted indexes against scans, what a question reads of them, and how long they are kept."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import search, services
from weftgraph.plans.project import Projection
from weftgraph.storage import KEPT, scope

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    more = [(-1, None), (-2, ""), (-3, "Über ÜBER über_1 naïve"), (-4, "the the the"), (-5, "x")]
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))


@pytest.fixture(scope="module")
def by_word(texts):
    return search.indexed(texts, search.words(F.col("text")), "doc_id")


@pytest.mark.parametrize("question", ["The and rendered of", "über naïve", "nothing?", "", "x the"])
def test_scores_equal_a_scan(texts, by_word, question):
    got = [tuple(r) for r in search.keyword_search(by_word, question, 15, "doc_id").collect()]
    assert got == [(r["doc_id"], r["score"]) for r in services.keyword_search(texts, question, 15, "text", ("doc_id",)).collect()]


def test_substrings_equal_a_scan(spark):
    names = ["alpha_beta", "beta", "ab", "", "abab", "Über_beta", "tabeta", None, "aaa", "aaaa"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    index = search.indexed(rows, search.grams(F.col("name")), "id", "name")
    for text in ("beta", "abab", "aaa", "aaaa", "Übe", "bet", "et", "zzz"):
        got = sorted(r["id"] for r in search.containing(index, text, "name", "id", "name").collect())
        assert got == [i for i, n in enumerate(names) if n and len(n) >= 3 and text in n], text


def test_a_question_reads_its_terms_buckets(spark, texts):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        index = search.indexed(texts, search.words(F.col("text")), "doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    asked = search.postings(index, ["the"])._jdf.queryExecution()
    found = asked.toRdd().count()
    scan = asked.executedPlan().collectLeaves().head()
    assert "EqualTo(term,the)" in scan.toString()
    assert 0 < found <= scan.metrics().apply("numOutputRows").value() < index.table().count() / 8  # of 16 buckets
    shuffled = search.document_frequencies(index)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shuffled
    rows = search.keyword_scores(index, "rendered", "doc_id")
    assert rows.count() < index.table().count() / 100


def test_kept_until_files_change(spark, tmp_path):
    spark.range(3).toDF("o_orderkey").write.parquet(f"{tmp_path}/sf/orders.parquet")
    p, made = Projection(spark, f"{tmp_path}/sf"), []

    def make():
        made.append(p.table("orders").count())
        return p.table("orders").select("o_orderkey")

    with scope(spark):  # what is kept outlives a scope
        first = p.kept("test", ["orders"], make)
    assert p.kept("test", ["orders"], make) is first and made == [3] and first.read().count() == 3
    spark.range(5).toDF("o_orderkey").write.mode("append").parquet(f"{tmp_path}/sf/orders.parquet")
    spark.catalog.clearCache()
    assert p.kept("test", ["orders"], make).read().count() == 8 and made == [3, 8]
    gone = first.path
    place = spark._jvm.org.apache.hadoop.fs.Path(gone)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    assert any("test" in key for key in KEPT._tables)
