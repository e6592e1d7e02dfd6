"""Exact and near duplicates, search, archives, URL verdicts: against brute force."""

import base64
import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import components, exact_dedup, minhash, topk, url_filter, warc
from weftgraph.llm.common import materialize

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, n long")


def brute_links(rows, words, percent):
    sets = {}
    for doc_id, text in rows:
        found = WORD.findall((text or "").translate(LOWER))
        shingles = {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
        sets.setdefault(doc_id, []).append(shingles)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (a, sa) in enumerate(flat):
        for b, sb in flat[:i]:
            common = len(sa & sb)
            if 100 * common >= percent * (len(sa) + len(sb) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def near_copies(n, length, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("words", "percent", "n", "small"), [(3, 85, 90, 48), (3, 85, 120, 6), (5, 80, 60, 4)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, n, small):
    """With ``small`` low, typical nodes and packed blocks decide what direct pairs otherwise would."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "OUTSIDE", 8)
    monkeypatch.setattr(minhash, "INSIDE", 16)
    texts = near_copies(n, 120, 9, 1) + near_copies(20, 60, 2, 2) + ["", None, "One", "one", "one two", "A b c", "a B\tc", "  "] + ["lone text number %d of its kind here" % i for i in range(20)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(rows[5][0], rows[5][1]), (rows[7][0], rows[50][1])]  # a repeated row, and an id with two texts
    got = minhash.link(frame(spark, [(d, t, "x", 1) for d, t in rows]), words=words, percent=percent).collect()
    expected = brute_links(rows, words, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c d", "x", 1), (4, "a b c d", "x", 1), (5, None, "x", 1), (6, "word " * 30_000, "x", 1)]
    got = {r["doc_id"]: r for r in minhash.link(frame(spark, rows), words=3, percent=85).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"] and got[4]["component_id"] == 4 and got[5]["n_shingles"] == 0 and got[6]["n_shingles"] == 1
    assert minhash.link(frame(spark, []), words=3, percent=85).count() == 0


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 800, np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 200, np.uint64)])
    mm = minhash.MinMax(96, 32)
    same = (mm.signature(a) == mm.signature(b)).mean()
    assert abs(same - 0.6) < 0.1 and (mm(a) == mm(a)).all()


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    first = spark.createDataFrame([(min(e), max(e)) for e in edges[:100]], "a long, b long")
    rest = spark.createDataFrame([(min(e), max(e)) for e in edges[100:]], "a long, b long")
    labels = components.components(materialize(rest, "t"), components.components(materialize(first, "t")))
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert all(got.get(n, n) == find(n) for n in range(500))


def test_exact_dedup_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    one = frame(spark, [(1, "a", "x", 1), (2, "a", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (None, "a", "x", 1), (5, "b", "x", 1), (5, "b", "x", 1)])
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(one, index=index).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, True)], key=str)
    two = frame(spark, [(9, "a", "x", 1), (10, "c", "x", 1)])
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["text_sha256"]) for r in exact_dedup.dedup(two, index=index).collect()}
    assert got == {9: (2, False, hashlib.sha256(b"a").hexdigest()), 10: (10, True, hashlib.sha256(b"c").hexdigest())}
    assert index.rows().count() == 4
    assert exact_dedup.dedup(frame(spark, [])).count() == 0 and exact_dedup.dedup(frame(spark, []), batches=3).count() == 0
    index.drop()
    assert not index.exists() and not (tmp_path / "index").exists()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def told(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_descending_ids_keep_the_largest(spark, batches):
    rng = random.Random(batches)
    rows = [(i if i % 9 else None, rng.choice("abcdefgh") * rng.randint(1, 3), "x", 1) for i in range(200)]
    best, sizes = {}, {}
    for i, t, *_ in rows:
        best[t] = max([x for x in (best.get(t), i) if x is not None], default=None)
        sizes[t] = sizes.get(t, 0) + 1
    assert told(exact_dedup.dedup(frame(spark, rows), batches=batches)) == sorted(((i, best[t], sizes[t], i == best[t]) for i, t, *_ in rows), key=str)


def test_a_batch_that_is_given_again_adds_nothing(spark, tmp_path, monkeypatch):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    first, second = frame(spark, [(1, "a", "x", 1), (2, "a", "x", 1), (3, "b", "x", 1)]), frame(spark, [(7, "b", "x", 1), (8, "c", "x", 1), (9, "c", "x", 1)])
    plain = exact_dedup.materialize

    def failing(df, label):
        if label == "digest-winners":
            raise RuntimeError("an executor is lost")
        return plain(df, label)

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "materialize", failing)
        with pytest.raises(RuntimeError):
            exact_dedup.dedup(first, index=index)  # after its rows were appended
    one = told(exact_dedup.dedup(first, index=index))
    assert one == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)], key=str)
    two = told(exact_dedup.dedup(second, index=index))
    assert two == sorted([(7, 3, 1, False), (8, 9, 2, False), (9, 9, 2, True)], key=str)
    assert (told(exact_dedup.dedup(first, index=index)), told(exact_dedup.dedup(second, index=index))) == (one, two)
    assert index.rows().count() == 3
    index.drop()


def test_the_index_is_neither_shuffled_nor_sorted(spark, tmp_path):
    """Of the anti-join's two sides only the batch is; also after a compaction that another had begun and not ended."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    for k in range(3):
        index.append(frame(spark, [(i, f"text {i % 50} {k}", "x", 1) for i in range(100)]))
    before = told(index.decide(frame(spark, [(1, "text 7 1", "x", 1)])))
    (tmp_path / "index/v2").mkdir()
    (tmp_path / "index/v2/part-0.parquet").write_text("of a writer that was lost")
    index.compact()
    assert told(index.decide(frame(spark, [(1, "text 7 1", "x", 1)]))) == before == [(1, 57, 1, False)]
    assert not (tmp_path / "index/v1").exists() and index.rows().count() == 150
    batch = exact_dedup.digests(frame(spark, [(2, "b", "x", 1)])).groupBy("digest").count()
    with exact_dedup._ordered_buckets(spark):
        lines = index.unknown(batch)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("SortMergeJoin" in line and "LeftAnti" in line for line in lines) and any("Bucketed: true" in line for line in lines)
    assert sum("Exchange" in line for line in lines) == 1 and sum("Sort [" in line for line in lines) == 1  # those of the batch
    index.drop()


SESSION = """
import sys
sys.path.insert(0, {repo!r})
from weftgraph.llm import exact_dedup
from weftgraph.session import local_session
spark = local_session(2, partitions=2, memory="1g", conf={{"spark.checkpoint.dir": {folder!r} + "/shared", "spark.sql.warehouse.dir": {folder!r} + "/warehouse-" + sys.argv[1]}})
index = exact_dedup.DigestIndex(spark, {folder!r} + "/index", 3)
rows = {{"1": [(1, "a"), (2, "b")], "2": [(3, "a"), (4, "c")], "3": [(5, "c"), (6, "d"), (7, "b")]}}[sys.argv[1]]
existed = index.exists()
got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), index=index)
if sys.argv[1] == "2":
    index.compact()
print("TOLD", existed, index.buckets, sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()))
"""


def test_the_index_outlives_its_session(tmp_path):
    """Three processes append to one folder, each in its own working folder and with its own catalogue."""
    repo, said = str(Path(__file__).resolve().parents[2]), []
    for number in "123":
        own = tmp_path / f"cwd-{number}"
        own.mkdir()
        run = subprocess.run([sys.executable, "-c", SESSION.format(repo=repo, folder=str(tmp_path)), number], capture_output=True, text=True, timeout=300, cwd=own)
        said += [line for line in run.stdout.splitlines() if line.startswith("TOLD")] or [run.stderr[-2000:]]
    assert said == [
        "TOLD False 3 [(1, 1, True), (2, 2, True)]",
        "TOLD True 3 [(3, 1, False), (4, 4, True)]",
        "TOLD True 3 [(5, 4, False), (6, 6, True), (7, 2, False)]",
    ]
    assert (tmp_path / "index/v2").exists() and not (tmp_path / "index/v1").exists()



def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 6)).astype("float32")
    v[100:130] = v[100]  # ties
    rows = [(int(i), [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (950, [float("nan")] * 6, 1), (1000, [1.0, 2.0], 1), (None, [0.0] * 6, 1), (1001, [2.0, 1.0], 1), (1050, [], 1), (1051, [], 1), (1053, [], 1)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    got = topk.search(vectors.where("vec_id % 50 = 0"), vectors, 5, query_tile=4, candidate_tile=64, block_tiles=2).collect()
    q = np.floor(256 * v.astype(float)).astype(np.int64)
    expected = set()
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:5]
        expected |= {(i, k + 1, int(j), int(s[j])) for k, j in enumerate(best)}
    expected |= {(1000, 1, 1001, 256 * 512 * 2), (1050, 1, 1051, 0), (1050, 2, 1053, 0)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected
    assert topk.search(vectors.limit(0), vectors, 5).count() == 0


def test_topk_large_integers():
    q = np.array([[2.0**40, 3.0]])
    assert topk._products(q, q)[0, 0] == min(2**80 + 9, 2**63 - 1)


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a.b/x?q", "<p>é</p>", 1), (2, None, None, 1), (3, "http://a.b/x?q", "<p>é</p>", 1), (4, "no\r\nscheme", "", 1), (None, "http://c/", "<p>é</p>", 1), (7, "http://z.a.b", "x\r\n\r\ny", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive int")
    got = warc.archive_pages(df, f"file://{tmp_path}/w").collect()
    firsts = {}
    for p, _, h, _ in pages:
        firsts.setdefault(h or "", []).append(p)
    for r in got:
        page = next(p for p in pages if p[0] == r["page_id"])
        payload = (page[2] or "").encode()
        first = min(x for x in firsts[page[2] or ""] if x is not None)
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got) and len(got) == len(pages)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_runs_are_merged_in_passes_by_ranges(spark, tmp_path):
    """Many runs and few captures of each in memory; one URL has a third of all captures."""
    rng = random.Random(8)
    pages = [(i if i % 17 else None, "http://hot/" if i % 3 == 0 else f"http://{rng.choice('abc')}.é{rng.randint(0, 30)}/", f"text {rng.randint(0, 90)}", 1) for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive int").repartition(5)
    folder = f"file://{tmp_path}/w"
    blocks = warc.sorted_runs(warc.write_archives(df, folder), folder, run_rows=16, block_rows=4)
    assert blocks.select("run").distinct().count() > 30 and blocks.agg(F.max("rows")).first()[0] == 4
    merged = warc.merge_runs(blocks, folder, fan_in=6, range_rows=40)
    keyed = merged.select(F.spark_partition_id().alias("part"), "*").collect()
    rows = [tuple(r)[1:] for r in keyed]
    assert [warc.sort_key(r) for r in rows] == sorted(warc.sort_key(r) for r in rows)
    assert sorted(map(repr, rows)) == sorted(repr(r) for p in {r[8] for r in rows} for r in warc.captures_of(p)) and len(rows) == len(pages)
    hot = [r["part"] for r in keyed if r["url"] == "http://hot/"]
    assert len(set(hot)) > 2


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        row = lambda i, j: (rng.choice("abc"), str(rng.randint(0, 5)), rng.choice([None, 1, 2]), None, 0, "", "", None, f"r{i}", j)
        runs = [sorted([row(i, j) for j in range(rng.randint(0, 8))], key=warc.sort_key) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted([r for run in runs for r in run], key=warc.sort_key)


def test_a_damaged_archive_is_refused():
    import io

    data = warc.member(warc.page_record(1, "http://a/", warc.CAPTURED_AT, b"payload", None, False))
    assert [warc.parse(c)[0]["warc-type"] for _, c in warc.members(io.BytesIO(data))] == ["response"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))


RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def test_url_rules(spark):
    urls = {
        1: ("HTTP://Www.Example.COM/en/71?x#y", "www.example.com", "/en/71", "example.com/en/7", "allow"), 2: ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        3: ("http://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"), 4: ("https://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
        5: ("https://net/de/", "net", "/de/", "net/de/", "allow"), 6: (None, "", "", None, None), 7: ("nothing", "", "", None, None), 8: ("x://host?a/b", "host", "", None, None),
        9: ("x://h#f://z/y", "h", "", None, None), 10: ("a://b://c/d", "b:", "//c/d", None, None), 11: ("x://org/ES/", "org", "/ES/", None, None),
    }
    df = spark.createDataFrame([(k, v[0], "z") for k, v in urls.items()], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), k
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_url_trees_learn_labels(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{'spam' if i % 2 else 'site'}{rng.randint(0, 9)}.{'biz' if i % 2 else 'org'}/{'x' * rng.randint(1, 9)}", "block" if i % 2 else "allow") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.judge(df.drop("verdict"), (), labelled=df.where("page_id < 200")).join(df.select("page_id", F.col("verdict").alias("truth")), "page_id")
    assert got.where("verdict = truth").count() > 380


def plain_features(u, h, p):
    from collections import Counter
    from math import log2

    def bits(text):
        return -sum(c / len(text) * log2(c / len(text)) for c in Counter(text).values()) if text else 0.0

    before, _, fragment = u.partition("#")
    query = before.partition("?")[2]
    labels = h.split(".") if h else []
    digits, alnum = lambda t: sum(c.isdecimal() for c in t), lambda t: len(re.findall(r"[^\W_]", t))
    return [
        len(u), len(h), len(p), p.count("/"), len(labels), digits(u) / max(1, len(u)), digits(p) / max(1, len(p)), (len(u) - alnum(u)) / max(1, len(u)),
        bits(u), bits(h), query.count("&") + 1 if query else 0, len(query), len(fragment), u.startswith("https:"), max(map(len, labels), default=0),
    ]


def plain_judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(t), t, v) for v, t in RULES for n, s, r in [t.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith(s + r)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_every_page_is_judged_as_a_plain_loop_does(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = ["", None, "x", "http://", "https://a.b.c/d?e=1&f=2#g", "http://é.ü/ñ?" + "k=1&" * 500, "a://b:80/c#d?e#f", "http://x/" + "y" * 20_000]
    pages = pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(odd)], "page_id long, url string")).repartition(40)
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    truth = {i: plain_judged(u) for i, u in urls.items()}
    host, path = url_filter.host_and_path(F.col("url"))
    ruled = pages.select("url", url_filter.rule_columns(host, path, RULES)[1].alias("verdict"))
    model = url_filter.fit(ruled)
    labelled = {(u, truth[i][3]) for i, u in urls.items() if u is not None and truth[i][3]}
    assert abs(model.statistics[:, 0].sum() - 1) < 1e-9 and len(labelled) < url_filter.SAMPLE_ROWS
    suffixes = {r["url"]: r["s"] for r in pages.select("url", url_filter.suffix_key(host).alias("s")).collect()}
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    assert got.keys() == urls.keys()
    for i, u in urls.items():
        h, p, rule, verdict = truth[i]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, rule)
        if verdict is None:
            share = model.probability(np.array([plain_features(u or "", h, p)], float), np.array([suffixes[u]]))[0]
            assert abs(got[i]["p_block"] - share) < 1e-9
            verdict = "block" if share >= 0.5 else "allow"
        assert got[i]["verdict"] == verdict


def test_a_bounded_sample_of_distinct_rows(spark):
    from weftgraph.llm.common import hashed_sample

    rows = spark.range(30_000).select((F.col("id") % 9_000).alias("k")).union(spark.range(20_000).select(F.lit(5).cast("long"))).repartition(50)
    got = [r["k"] for r in hashed_sample(rows, "k", 100).collect()]
    assert len(got) == 100 == len(set(got))
    order = [r["k"] for r in spark.range(9_000).select(F.col("id").alias("k")).orderBy(F.shiftrightunsigned(F.xxhash64("k"), 11)).limit(100).collect()]
    assert got == order
    assert hashed_sample(rows.limit(0), "k", 5).count() == 0
