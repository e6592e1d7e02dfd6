"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import resampling
from weftgraph.llm.common import materialize
from weftgraph.llm.queries import op13_resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    told = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, fs in told for b in fs), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for d, n, fs in told:
        weight = sum(gain[b] for b in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in op13_resampling(spark, sf).collect()), key=str) == plain(docs, target)


def test_odd_rows(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(15, 40)))) for k in range(150)]
    docs += [(None, docs[3][1]), (None, docs[9][1]), (7, docs[8][1]), (8, docs[8][1]), (8, docs[8][1]), (200, None), (201, ""), (202, "Ünï ÀB"), (203, "x " * 50_000)]
    target = ["W1 w2 w3 w4 w5", None, "", "ünï w7"]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, weight long, score string")
    b = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 100):
        got = resampling.resample(d, b, percent=percent).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(docs, target, percent)
    assert resampling.resample(d, b.limit(0)).where("rank IS NOT NULL").count() == 5 * sum(len(WORD.findall(t or "")) >= 20 for _, t in docs) // 100
    assert resampling.resample(d.limit(0), b).count() == 0


@pytest.mark.parametrize("digit", [2, 12])
def test_ranks_of_spread_and_tied_scores(spark, monkeypatch, digit):
    """Scores far apart need several levels; many rows have one score."""
    monkeypatch.setattr(resampling, "DIGIT", digit)
    rng = random.Random(1)
    scores = [rng.choice([-(10**9), 0, 5, 6, 7, 8000, 10**8 + rng.randint(0, 9)]) for _ in range(3000)] + [4] * 2000
    rows = [(i, 30 if i % 7 else 3, 90, s, s) for i, s in enumerate(scores)]
    scored = materialize(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4), "t")
    for percent in (1, 30, 90):
        able = sorted((-s, i) for i, n, _, _, s in rows if n >= 20)
        expected = {i: k + 1 for k, (_, i) in enumerate(able[: percent * len(able) // 100])}
        got = resampling.draw(scored, percent=percent).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["rank"] for r in got if r["rank"]} == expected


def test_a_task_hands_on_sums(spark):
    docs = spark.range(5000).select(F.lit("same words here").alias("text"))
    assert sorted(r["n"] for r in resampling.bucket_counts(docs).collect()) == [5000] * 6
