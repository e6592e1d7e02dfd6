"""Runs of repeated words against a plain search."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import periodic
from weftgraph.llm.queries import _with_periodic_end, op12_runs

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain_runs(words, least=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    head = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        head = (s, n, q, 1000 * n // q)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=6), st.integers(2, 12))
def test_runs_of_small_alphabets(texts, least):
    got = periodic.runs_of([np.array(t, np.int64) for t in texts], least)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least) for t in texts]


def test_pairs_in_blocks(monkeypatch):
    rng = random.Random(3)
    unit = [rng.randint(0, 9) for _ in range(23)]
    text = np.array([rng.randint(0, 50) for _ in range(300)] + unit * 9 + [7] * 80, np.int64)
    whole = periodic.runs_of([text])
    monkeypatch.setattr(periodic, "_SHARED", 8)
    monkeypatch.setattr(periodic, "PAIRS", 64)
    assert (periodic.runs_of([text])[0] == whole[0]).all() and [tuple(r) for r in whole[0].tolist()] == plain_runs(text.tolist())


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_runs string")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\v "), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (6, "é ö " * 6 + "x"), (7, "x y z " * 4 + "\x1c y"), (8, "A a " * 3)]
    got = periodic.describe(rows_of(spark, [(i, t, "x") for i, t in [*rows, (None, "b " * 20)]])).collect()
    for r in got:
        if r["doc_id"] is not None:
            text = next(t for i, t in rows if i == r["doc_id"])
            assert r["n_runs"] == len(plain_runs(WORD.findall(text or "")))
    assert {r["doc_id"]: tuple(r)[2:6] for r in got}[None] == (0, 20, 1, 20000)
    assert sum(r["doc_id"] == 4 and r["n_runs"] == 1 for r in got) == 2
    assert next(r for r in got if r["doc_id"] == 1)["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic.describe(rows_of(spark, [])).count() == 0


def test_collapsed_texts(spark):
    rows = [(1, "go on " * 10 + "then stop", "x"), (2, None, "x"), (3, "as it is", "x")]
    got = {r["doc_id"]: (r["collapsed"], r["n_runs"]) for r in periodic.collapse(rows_of(spark, rows)).collect()}
    assert got == {1: ("go on then stop", "x"), 2: ("", "x"), 3: ("as it is", "x")}


def test_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 9)}" for _ in range(60_000)] + ["end"] * 40_000
    r = periodic.describe(rows_of(spark, [(1, " ".join(words), "x")])).first()
    assert (r["start"], r["length"], r["period"]) == (60_000, 40_000, 1)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in op12_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {plain_row(r["doc_id"], r["text"]) for r in rows}
    assert sum(r[1] > 0 for r in got) >= 10


@pytest.mark.parametrize("n", [0, 1, 2, 30])
def test_periodic_end(n):
    for doc_id in range(200):
        words = [b"%d" % i for i in range(n)]
        assert len(_with_periodic_end(doc_id, words)) == n
