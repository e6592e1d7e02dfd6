"""Packing, tokenization, classifiers: against libraries, brute force or held-out rows."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, language, packing, quality, toxicity, trees

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"
ODD = " \n\t\r  \x1c\x1d\x85  aAbZzéÉßÆŒŉǅİıſ0123'stre.,!?*#$%你好😀́ΣσςÅ_²½<|>endoftext"
SCHEMA = "doc_id long, text string, lang string, extra int, score double, sequence_id string"


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["", "  ", "don't STOP", "<|endoftext|>", "a" * 1500, "\n" * 700, *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 50))) for _ in range(n))]


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", 1, 0.5, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(WORDS)
    reference.encode_special_tokens = True
    texts = odd_texts(1500)
    for text, ids in zip(texts, packing.WordEncoder(WORDS).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    """Long words and many of them, of both kinds: what is kept stays under the bound and one range, and ids stay the library's."""
    from tokenizers import Tokenizer

    most = 300_000
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", most, raising=False)
    reference, encoder, rng = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS), random.Random(2)
    held = []
    for k in range(60):
        texts = [" ".join("".join(rng.choices("abcdefgh" if k % 2 else "αβγδabc", k=120)) for _ in range(40)) + " the end" for _ in range(4)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        held.append(sum(sys.getsizeof(x) for memory in (encoder._runs, encoder._known) for pair in memory.items() for x in pair))
    assert max(held) < most + 160 * 1200  # 160 words a call, each with its ids under 1,200 bytes


def test_words_of_a_task_are_encoded_by_one_thread():
    """A task has one core: no pool of the tokenizer, whose threads keep memory each, starts in its worker."""
    code = (
        "import os; from weftgraph.llm import packing\n"
        f"e = packing._encoder({str(WORDS)!r}); before = len(os.listdir('/proc/self/task'))\n"
        "e.encode([f'word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} ü字{i}' for i in range(5000)])\n"
        "print(len(os.listdir('/proc/self/task')) - before)"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.strip() == "0"


def test_packing_places_every_piece_once(spark):
    texts = ["the cat sat " * n for n in (1, 5, 400, 900, 2000)] + odd_texts(40) + [None, "", "same", "same"]
    docs = frame(spark, texts, [*range(len(texts) - 3), None, 7, 7])
    pieces = packing.token_pieces(docs, WORDS, with_ids=True)
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count()
    bins = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] <= 2048
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(bins) <= least + 4 * 1  # one open bin a task at most
    long = [r for r in rows if r["doc_id"] == 4]
    assert [r["start"] for r in sorted(long, key=lambda r: r["piece"])] == [2048 * i for i in range(len(long))] and len(long) == 3


def test_every_capacity_binds():
    for rule in ("norm", "dot"):
        bins = packing.Bins(100, 2, 5000, rule, (1.0, 0.5, 0.5))
        held = {}
        for length in [70, 60, 50, 40, 30, 20, 10, 5, 5, 5]:
            held.setdefault(bins.place(length)[0], []).append(length)
        assert all(len(v) <= 2 and sum(v) <= 100 and sum(x * x for x in v) <= 5000 for v in held.values())
    with pytest.raises(ValueError):
        packing.Bins(10, 1, 100, "norm", (1, 1, 1)).place(11)
    with pytest.raises(ValueError):
        packing.Bins(10, 1, 100, "first", (1, 1, 1))


def test_packing_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_byte_ids_equal_the_library(spark):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTES), special_tokens={})
    assert public_tokenizers.PATTERN == byte_bpe.PATTERN
    rng = random.Random(3)
    texts = odd_texts(800) + ["ab" * 900, "".join(rng.choice("etaoin") for _ in range(3000)), None]
    rows = byte_bpe.encode(frame(spark, texts), BYTES).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == encoding.encode_ordinary(text) and r["decoded"] == text.encode()
    digests = {r["doc_id"]: r for r in byte_bpe.encode_digests(frame(spark, texts[:50]), BYTES).collect()}
    for i, text in enumerate(texts[:50]):
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert (digests[i]["n_tokens"], digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decoding_of_any_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1, 50255], "x"), (2, [], "y"), (3, None, "z")], "k int, ids array<int>, decoded string")
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(rows, BYTES).collect()}
    back = {v: k for k, v in byte_bpe.read_ranks(BYTES).items()}
    assert got == {1: back[0] + back[1] + back[50255], 2: b"", 3: None}


def test_trees_and_rules_fit_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 11))
    y = ((x[:, 3] > 0.7) & (x[:, 5] <= 0.4)).astype(float)
    assert ((trees.fit_boosted(x, y).probability(x) > 0.5) == (y > 0.5)).mean() > 0.98
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) < 100
    assert quality.fit_rules(x, np.ones(2000)).rules == [] and quality.fit_rules(x[:0], y[:0]).intercept == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    held = quality.score(docs.select("doc_id", "text", F.lit(3).alias("score")), model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = held.select("quality", "predicted", "score").collect()
    assert len(rows) > 30 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_counts(t):
    one = t.count
    symbols = sum(map(one, "#$%&*+=<>@^_~|\\/{}[]"))
    return [
        len(t), sum(map(one, " \n\t\r")), sum(unicodedata.category(c) == "Lu" for c in t), one("!") + one("?"), symbols, one("|"), sum(map(one, "0123456789")), one("."),
        len(re.findall(r"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]{1,64}) (?=\1(?:[ \t\n\x0b\f\r]|$(?!\n)))", t)), one("\n"),
    ]


def plain_statistics(c):
    chars, words = c[0], c[1] + 1
    share = lambda n, of: n / of if chars else 0.0
    return [chars, words if chars else 0.0, share(chars, words), *(share(c[i], chars) for i in (2, 3, 4)), share(c[5], words), share(c[6], chars), *(share(c[i], words) for i in (7, 8, 9))]


def test_compiled_rules_equal_plain_counts_and_rules(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.rules
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["", None, "a a a b", "x" * 90_000, "Éa É|É", "go go gone", "tip tip\ttip tip"])], "doc_id long, text string"))
    counted = {r["doc_id"]: r["c"] for r in docs.select("doc_id", quality.counts(F.col("text")).alias("c")).collect()}
    for r in quality.score(docs, model).collect():
        plain = plain_counts(r["text"] or "")
        assert list(counted[r["doc_id"]]) == plain, r["text"]
        stats = dict(zip(quality.STATISTICS, plain_statistics(plain), strict=True))
        total = model.intercept + sum(w for rule, w in model.rules if all(stats[n] <= v if op == "<=" else stats[n] > v for n, op, v in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9 and r["predicted"] == (r["score"] >= quality.THRESHOLD)


def test_quality_odd_rows(spark):
    docs = frame(spark, [*odd_texts(20), None], None)
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int"))
    assert quality.score(docs, model).where("score between 0 and 1").count() == docs.count()
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs, none).collect()] == [0.5] * docs.count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == toxicity.GRADES
    rows = toxicity.grade(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("toxic", "predicted", "severity").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in rows)


def test_ordinal_grades_are_ordered(spark):
    texts, grades = [], []
    rng = random.Random(2)
    for i in range(600):
        g = i % 4
        words = [rng.choice(["sun", "tree", "river", "stone"]) for _ in range(30)] + ["mild"] * (g >= 1) + ["harsh"] * (g >= 2) + ["vile"] * (g >= 3)
        texts.append(" ".join(words))
        grades.append(g)
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, texts), labels)
    scorer = toxicity.Scorer(model)
    expected = [model.exceed(np.array([scorer.score(t)])).sum() for t in ("sun", "mild", "mild harsh", "mild harsh vile")]
    assert expected == sorted(expected) and expected[3] - expected[0] > 2


def test_severity_follows_the_formula(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs.repartition(30), labels.union(labels))
    assert model.weights.size == len(model.places) and set(model.places.values()) == set(range(len(model.places)))
    for r in toxicity.grade(docs, model).collect():
        found = {k for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for k in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)]}
        score = sum(model.weights[model.places[k]] for k in found & model.places.keys())
        above = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        each = [1 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0.0], strict=True))]
        assert abs(r["severity"] - sum(above)) < 1e-9 and abs(r["p_toxic"] - above[0]) < 1e-9
        assert each[r["grade"]] > max(each) - 1e-9 and r["predicted"] == (above[0] >= 0.5)


def test_toxicity_odd_rows(spark):
    docs = frame(spark, [*odd_texts(20), None])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, None), (22, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs.union(docs), labels)
    assert toxicity.grade(docs, fitted).where("severity between 0 and 3").count() == docs.count()
    flat = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.grade(docs, flat).collect()} == {0}
    assert toxicity.grade(docs.limit(0), flat).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    rows = language.predict(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = frame(spark, [*odd_texts(60), None, "12 34 !!", "x"])
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for r in got.values():
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    assert language.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_kernel_scores_equal_dense_ridge():
    """With every row a landmark the map is exact, so scores are those of kernel ridge regression on centred kernels."""
    rng = np.random.default_rng(3)
    marks = (rng.random((60, language.DIMENSIONS)) < 0.01).astype(np.float32)
    langs = [("aa", "bb", "cc")[i % 3] for i in range(60)]
    model = language.fit_kernel(marks, langs, landmarks=60, ridge=0.1)
    x = marks / np.sqrt(marks.sum(axis=1, keepdims=True))
    kernel = (x @ x.T).astype(float)
    center = np.eye(60) - 1 / 60
    k = center @ kernel @ center
    target = np.where(np.array(langs)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    penalty = 0.1 * np.trace(k) / np.linalg.matrix_rank(kernel)
    dense = k @ np.linalg.solve(k + penalty * np.eye(60), target - target.mean(axis=0)) + target.mean(axis=0)
    assert np.abs(model.scores(marks) - dense).max() < 1e-3


def test_presence_of_ngrams():
    marks, again = np.zeros(language.DIMENSIONS, np.uint8), np.zeros(language.DIMENSIONS, np.uint8)
    assert language.presence("Ab1", marks) and language.presence("aB!", again) and (marks == again).all()
    assert marks.sum() == len({"a", "b", " ", "ab", "b ", "ab "}) and not language.presence("12 !", again)
