"""Every opN_ query keeps its contract on the smallest tables: names, types, one row per input row, and what follows from the input alone."""

import zlib
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")

CONTRACTS = {
    "op1_license_scan": ("documents", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"),
    "op2_quality": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op3_pack": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op4_token_counts": ("documents", "doc_id bigint, n_tokens bigint, n_tokens_edited bigint"),
    "op5_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op6_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op7_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op8_decontaminate": (None, "doc_id bigint, item_id bigint, distance int, n_words int"),
    "op9_chat_format": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op10_vectors": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op11_divergence": (None, "lang string, source string, part string, item string, value bigint, rank int"),
    "op12_spelling": (None, "word string, form string, root string, n bigint, n_near bigint, form_n bigint"),
    "op13_top_products": (None, "query_id bigint, rank int, vec_id bigint, score bigint"),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, name):
    whole, columns = CONTRACTS[name]
    df = entry.queries()[name](spark, str(DATA))
    types = dict(df.dtypes)
    assert {c.split()[0]: types.get(c.split()[0]) for c in columns.split(", ")} == dict(c.split() for c in columns.split(", "))
    rows = df.collect()
    key = df.columns[0]
    if whole:
        ids = [r[0] for r in spark.read.parquet(f"{DATA}/{whole}.parquet").select(key).collect()]
        assert sorted(r[key] for r in rows) == sorted(ids)
    if types.get("score") == "double":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if "predicted" in types:
        folds, fold = (3, 1) if name.startswith("op2") else (5, 0)
        assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    if name == "op3_pack":
        assert all(1 <= r["length"] <= 1024 and r["offset"] + r["length"] <= 1024 for r in rows)
    if name == "op5_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in rows)
    if name == "op10_vectors":
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
