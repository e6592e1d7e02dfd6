"""The deduplicating stages decide on rows, also where ids repeat or are missing."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def stage(spark, name, rows):
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_exact_copies_by_row(spark):
    repeated = [(1, "one")] * 5
    two_texts = [(2, "two"), (2, "other"), (3, "two")]
    without_id = [(None, "alone"), (None, "one"), (None, "nobody"), (None, "nobody")]
    got = stage(spark, "exact_dedup", repeated + two_texts + without_id)
    assert got == sorted([(1, "one"), (2, "other"), (3, "two"), (None, "alone"), (None, "nobody")], key=str)


def test_near_copies_by_row(spark):
    def text(word, end=""):
        return " ".join(f"{word}{i}" for i in range(80)) + end

    repeated = [(1, text("a"))] * 3 + [(4, text("a", " more"))]
    two_texts = [(5, text("b")), (5, text("c")), (6, text("c", " more")), (2, text("b", " more"))]
    without_id = [(None, text("a", " else")), (None, text("d")), (None, text("d", " more")), (None, text("e"))]
    got = stage(spark, "minhash_near_dedup", repeated + two_texts + without_id)
    ends = [(d, t.split()[0]) for d, t in got]
    assert sorted(ends, key=str) == sorted([(1, "a0"), (2, "b0"), (5, "c0"), (None, "d0"), (None, "e0")], key=str)
