"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import (
    ann,
    embedding_dedup,
    lm_scoring,
    merkle_manifest,
    packing,
    pii,
    pivot_search,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    toxicity,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_pii_pseudonyms": pii.op1_pii_pseudonyms,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_ann": ann.op10_ann,
    "op11_pivot_search": pivot_search.op11_pivot_search,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op11_pivot_search": pivot_search.ORACLE_SQL,
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
