"""The registered queries on the smallest tables: contract columns, held-out documents, one row a document."""

import hashlib
import os
import zlib

import duckdb
import pytest

from shoal.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "pipeline": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


def test_all_are_registered():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.fixture(scope="module")
def table():
    return lambda sql: duckdb.sql(sql.replace("$", f"'{SF}/") + "").fetchall()


@pytest.mark.parametrize("name", list(COLUMNS))
def test_registered(spark, table, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = df.collect()
    docs = dict(table("SELECT doc_id, text FROM $documents.parquet'"))
    if name in ("op1_lm_score", "op3_language_id"):
        mod = 5 if name == "op1_lm_score" else 3
        assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % mod == 1 for i in docs}
    if name == "op3_language_id":
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]] or "")) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op4_exact_dedup":
        assert {r["doc_id"]: r["text_sha256"] for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in docs.items()}
    if name in ("op5_simhash", "op8_byte_bpe", "op10_token_counts"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name == "op6_embedding_dedup":
        assert sorted(r["vec_id"] for r in rows) == sorted(i for (i,) in table("SELECT vec_id FROM $embeddings.parquet'"))
    if name == "op7_chat_format":
        turns = dict(table("SELECT conv_id, count(*) FROM $conversations.parquet' GROUP BY ALL")) | {-1: 2}
        assert {r["conv_id"]: r["n_turns"] for r in rows} == turns
        own = next(r for r in rows if r["conv_id"] == -1)
        assert (own["loss_chars"], own["loss_sha256"]) == (21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())
    if name == "op9_warc":
        pages = dict(table("SELECT page_id, coalesce(html, '') FROM $pages.parquet'"))
        winner = {}
        for i, h in pages.items():
            winner[h] = max(winner.get(h, i), i)
        assert {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in rows} == {i: (len(h.encode()), None if winner[h] == i else winner[h]) for i, h in pages.items()}
    if name == "op2_best_fit_packing":
        assert {r["doc_id"] for r in rows} == set(docs)
    if name == "pipeline":
        assert {r["doc_id"] for r in rows} <= set(docs)
