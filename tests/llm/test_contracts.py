"""The columns and types of every registered training-text query, and a row for each row of its table."""

import pytest

from weftgraph.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pack": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_toxicity": "doc_id bigint, held_out boolean, severity double, grade int, p_toxic double, predicted int",
    "op5_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    wanted = [tuple(c.split(" ")) for c in COLUMNS[name].split(", ")]
    assert df.dtypes[: len(wanted)] == wanted
    rows = df.collect()
    source, key = ("pages", "page_id") if "page_id" in df.columns else ("documents", "doc_id")
    ids = sorted(r[key] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    if name == "op7_topk":
        queries = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
        assert sorted((r["query_id"], r["rank"]) for r in rows) == sorted((q, k) for q in queries for k in range(1, 6))
    elif name == "op1_pack":
        assert sorted({r["doc_id"] for r in rows}) == ids
    else:
        assert sorted(r[key] for r in rows) == ids
    if "held_out" in df.columns:
        import zlib

        modulus, rest = (3, 1) if name == "op9_language" else (5, 0)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
