"""Queries of the subpackage, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from lexmill.llm import chat, decontaminate, divergence, licenses, packing, quality, recount, simhash, spelling, topk, toxicity, vectors, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality": quality.op2_quality,
    "op3_pack": packing.op3_pack,
    "op4_token_counts": recount.op4_token_counts,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_chat_format": chat.op9_chat_format,
    "op10_vectors": vectors.op10_vectors,
    "op11_divergence": divergence.op11_divergence,
    "op12_spelling": spelling.op12_spelling,
    "op13_top_products": topk.op13_top_products,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op6_warc": warc.oracle(),
    "op9_chat_format": chat.oracle(),
    "op11_divergence": divergence.oracle(),
    "op13_top_products": topk.oracle(),
}
