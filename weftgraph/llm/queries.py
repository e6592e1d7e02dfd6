"""One query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, decontamination, exact_dedup, language, minhash, packing, periodic, quality, resampling, topk, toxicity, url_filter, warc
from weftgraph.llm.common import crc_bucket, table

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary(WORD_VOCABULARY))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "severity", "grade", "p_toxic", "predicted")


#: Fixed values of the query: (verdict, host and path).
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP7_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of a new index, the larger ids first: the second finds the first one's texts known, and the largest id stays."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), batches=2)


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, w, len(w) AS n
           FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT item_id, w, least(len(w), 10) AS m
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bi AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b),
bw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM bi),
di AS (SELECT k, w, m, unnest(range(1, n - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE n >= m),
dw AS (SELECT k, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM di),
hits AS (SELECT k, i, m, t FROM dw WHERE t IN (SELECT t FROM bw)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM hits JOIN bw USING (t) WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


def _with_periodic_end(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, from some place on repeated with a period, in a tenth of the documents."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.describe(table(spark, sf_dir, "documents"), words_of=_with_periodic_end)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


OP13_SQL = r"""
WITH src AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 'b', -row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
g AS (SELECT side, k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ws) >= n),
f AS MATERIALIZED (SELECT side, k, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS f FROM g),
x AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
nibbles AS MATERIALIZED (SELECT f, [strpos('123456789ABCDEF', h[j + 2 - 2 * (j % 2)]) FOR j IN range(length(h))] AS v FROM x),  -- the lower half of each byte first
b AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || v, lambda c, y: xor(c >> 4,
        [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
        [(xor(c, y) & 15) + 1])), 4294967295) % 10000 AS bucket FROM nibbles),
fb AS MATERIALIZED (SELECT side, k, bucket FROM f JOIN b USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (tot.s + 10000) / ((n.s + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM n, tot),
per AS (SELECT k, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 'd' GROUP BY k),
sc AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
       FROM w LEFT JOIN per USING (k) WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM r
"""


def documents_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that occur more than once, with their number."""
    rows = exact_dedup.digests(table(spark, sf_dir, "documents")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select(F.lower(F.hex("digest")).alias("digest"), "n")


DUPLICATES_SQL = "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"

QUERIES = {"op1_pack": op1_pack, "op2_quality": op2_quality, "op3_minhash": op3_minhash, "op4_toxicity": op4_toxicity, "op5_byte_bpe": op5_byte_bpe, "op6_url_filter": op6_url_filter, "op7_topk": op7_topk, "op8_warc": op8_warc, "op9_language": op9_language, "op10_exact_dedup": op10_exact_dedup, "op11_decontamination": op11_decontamination, "op12_runs": op12_runs, "op13_resampling": op13_resampling, "documents_exact_duplicates": documents_exact_duplicates}
ORACLES = {"op7_topk": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_decontamination": OP11_SQL, "op13_resampling": OP13_SQL, "documents_exact_duplicates": DUPLICATES_SQL}
