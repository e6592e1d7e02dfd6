"""Winnowed decontamination against a plain search."""

import hashlib
import random
import re

import pytest

from weftgraph.llm import decontamination

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, span=10):
    words = words_of(text)
    hit, found = set(), set()
    for item, other in items:
        w = words_of(other)
        m = min(span, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        starts = [i for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in windows] if m else []
        hit.update(p for i in starts for p in range(i, i + m))
        if starts and item is not None:
            found.add(item)
    names = sorted(found)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def judge(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, key long")
    b = spark.createDataFrame(items, "item_id string, text string")
    return decontamination.contamination(d, b, **options).collect()


def prose(rng, n, words=40):
    return [f"w{rng.randint(0, words)}" for _ in range(n)]


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_ROWS, 0])
def test_equals_plain_search(spark, monkeypatch, bound):
    """Also with sort-merge joins only."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    rng = random.Random(7)
    items = [(f"i{k}", " ".join(prose(rng, n))) for k, n in enumerate([10, 11, 12, 25, 40, 9, 7, 5, 4, 3, 60])]
    items += [("twin", items[4][1]), ("i3", " ".join(prose(rng, 15))), (None, " ".join(prose(rng, 14))), ("null", None), ("none", " !? "), ("i,j", "Ünïque ÀB zeta")]
    docs = []
    for k in range(60):
        words = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            other = rng.choice(items)[1]
            part = words_of(other)
            lo = rng.randint(0, max(0, len(part) - 9))
            words[rng.randint(0, len(words)) :] += [*part[lo : lo + rng.randint(8, 20)], "tail"]
        docs.append((k, " , ".join(words), "x", 3))
    docs += [(100, None, "x", 3), (101, "", "x", 3), (102, "--- ", "x", 3), (103, "W1 w2!", "x", 3), (104, "ünïque àB zeta", "x", 3), (104, "Ünïque ÀB ZETA", "x", 3), (5, docs[6][1], "x", 3)]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in judge(spark, docs, items))
    assert got == sorted((d[0], *plain(d[1], items)) for d in docs)
    assert 20 < sum(r[-1] for r in got) < len(got)


def test_texts_are_not_shuffled_for_few_fingerprints(spark, monkeypatch):
    """Hits are found without joining stretches with the words of all texts; with many fingerprints they are joined."""
    plans = []

    def kept(df, label):
        if label == "decontamination-hits":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, label)

    materialize = decontamination.materialize
    monkeypatch.setattr(decontamination, "materialize", kept)
    docs, items = [(k, f"x{k} a b c d e f g h i j k l y", "x", 1) for k in range(20)], [("i", "a b c d e f g h i j k l")]
    few = judge(spark, docs, items)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(few) == sorted(judge(spark, docs, items)) and {(r["n_hit"], r["n_items"]) for r in few} == {(12, 1)}
    assert ["Join Inner, (key" in plan for plan in plans] == [False, True]


def test_hits_and_null_ids(spark):
    docs = [(None, "x a b c y a b c", "x", 1), (None, "a b", "x", 1), (1, "a b c a b c a b c", "x", 1)]
    got = {r["n_words"]: ([tuple(h) for h in r["hits"]], r["items"]) for r in judge(spark, docs, [("k", "A b C")])}
    assert got == {8: ([(1, 4), (5, 8)], ["k"]), 2: ([], []), 9: ([(0, 9)], ["k"])}


def test_empty_tables(spark):
    assert judge(spark, [], [("k", "a b")]) == []
    got = judge(spark, [(1, "a b", "x", 1)], [])
    assert [(r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in got] == [(2, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_long_and_hot_texts(spark):
    """A passage that all texts and many items share, and a text of many words."""
    rng = random.Random(2)
    passage = " ".join(prose(rng, 30, 10**6))
    items = [(f"i{k}", passage) for k in range(300)] + [("own", "p q r s t u v w x y z")]
    docs = [(k, f"start {passage} end", "x", 1) for k in range(300)] + [(1000, " ".join(prose(rng, 200_000, 10**6)) + " p q r s t u v w x y z", "x", 1)]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in judge(spark, docs, items)}
    assert got.pop(1000) == (11, 1) and set(got.values()) == {(30, 300)} and len(got) == 300
