"""The pipeline's stages against brute-force versions, on a small table."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark):
    from weftgraph.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and all(before[d] == t for d, t in after.items())
        kept[name] = (before, after)
    before, after = kept["exact_dedup"]
    best = {}
    for d, t in before.items():
        best[t] = max(best.get(t, d), d)
    assert set(after) == set(best.values())
    from test_duplicates import brute_links

    before, after = kept["minhash_near_dedup"]
    groups = brute_links(list(before.items()), corpus_pipeline.NEAR["words"], corpus_pipeline.NEAR["percent"])
    assert set(after) == {d for d in before if groups[d] == d}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    from tokenizers import Tokenizer
    from weftgraph.llm.queries import WORD_VOCABULARY, vocabulary

    plain = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    plain.encode_special_tokens = True
    lengths = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in after.items()}
    got, bins = {}, {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        bins[r["sequence_id"]] = bins.get(r["sequence_id"], 0) + r["length"]
    assert got == lengths and max(bins.values()) <= 2048 and len(bins) < sum(lengths.values()) / 2048 + 5


def test_rejecting_stages_equal_plain_versions(spark):
    """Each row is decided by its own text, by the fitted model's formulas in plain Python."""
    from test_texts import plain_counts, plain_statistics

    from weftgraph.llm import language, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "one two", "en"), (7, None, None), (8, "", "en"), (9, "12 !", "en")], docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def staying(name):
        return sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, SF).collect()), key=str)

    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)

    def good(text):
        stats = dict(zip(quality.STATISTICS, plain_statistics(plain_counts(text or "")), strict=True))
        total = rules.intercept + sum(w for rule, w in rules.rules if all(stats[n] <= v if op == "<=" else stats[n] > v for n, op, v in rule))
        return 1 / (1 + np.exp(-total)) >= quality.THRESHOLD

    assert staying("quality_classifier") == sorted([r for r in rows if good(r[1])], key=str)
    kernel = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))

    def told(text):
        marks = np.zeros((1, language.DIMENSIONS), np.float32)
        if not text or not language.presence(text, marks[0]):
            return False
        raw = (marks / np.sqrt(marks.sum())) @ kernel.landmarks.T @ kernel.weights + kernel.bias
        return 1 / np.exp(4 * (raw - raw.max())).sum() >= corpus_pipeline.LEAST_LANGUAGE_SCORE

    assert staying("language_id") == sorted([r for r in rows if told(r[1])], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
